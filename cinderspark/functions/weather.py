"""Fire weather: the Canadian Fire Weather Index equations (Van Wagner, 1987) and circular wind means."""

from __future__ import annotations

from math import exp, log, sqrt

from pyspark.sql import Column
from pyspark.sql import functions as F

#: Effective day length for the duff and drought codes, by month, northern hemisphere.
DUFF_DAYS = (6.5, 7.5, 9.0, 12.8, 13.9, 13.9, 12.4, 10.9, 9.4, 8.0, 7.0, 6.0)
DROUGHT_DAYS = (-1.6, -1.6, -1.6, 0.9, 3.8, 5.8, 6.4, 5.0, 2.4, 0.4, -1.6, -1.6)
#: Danger classes, upper bounds exclusive.
DANGER = ((5.2, "very low"), (11.2, "low"), (21.3, "moderate"), (38.0, "high"), (50.0, "very high"))
START = (85.0, 6.0, 15.0)


def fine_fuel(temp: float, rh: float, wind: float, rain: float, before: float) -> float:
    moisture = 147.2 * (101 - before) / (59.5 + before)
    if rain > 0.5:
        wet = rain - 0.5
        gain = 42.5 * wet * exp(-100 / (251 - moisture)) * (1 - exp(-6.93 / wet))
        if moisture > 150:
            gain += 0.0015 * (moisture - 150) ** 2 * sqrt(wet)
        moisture = min(moisture + gain, 250.0)
    warm = 0.18 * (21.1 - temp) * (1 - exp(-0.115 * rh))
    humid = exp((rh - 100) / 10)
    drying = 0.942 * rh**0.679 + 11 * humid + warm
    wetting = 0.618 * rh**0.753 + 10 * humid + warm

    def rate(share: float) -> float:
        return (0.424 * (1 - share**1.7) + 0.0694 * sqrt(wind) * (1 - share**8)) * 0.581 * exp(0.0365 * temp)

    if moisture > drying:
        moisture = drying + (moisture - drying) * 10 ** -rate(rh / 100)
    elif moisture < wetting:
        moisture = wetting - (wetting - moisture) * 10 ** -rate((100 - rh) / 100)
    return 59.5 * (250 - moisture) / (147.2 + moisture)


def duff(temp: float, rh: float, rain: float, before: float, month: int) -> float:
    if rain > 1.5:
        net = 0.92 * rain - 1.27
        moisture = 20 + exp(5.6348 - before / 43.43)
        if before <= 33:
            slope = 100 / (0.5 + 0.3 * before)
        else:
            slope = 14 - 1.3 * log(before) if before <= 65 else 6.2 * log(before) - 17.2
        moisture += 1000 * net / (48.77 + slope * net)
        before = max(0.0, 244.72 - 43.43 * log(moisture - 20))
    rate = 1.894 * (max(temp, -1.1) + 1.1) * (100 - rh) * DUFF_DAYS[month - 1] * 1e-6  # equation 16
    return before + 100 * rate  # 17


def drought(temp: float, rain: float, before: float, month: int) -> float:
    if rain > 2.8:
        store = 800 * exp(-before / 400)
        before = max(before - 400 * log(1 + 3.937 * (0.83 * rain - 1.27) / store), 0.0)
    loss = 0.36 * (max(temp, -2.8) + 2.8) + DROUGHT_DAYS[month - 1]
    return max(before + max(loss, 0.0) / 2, 0.0)


def initial_spread(ffmc: float, wind: float) -> float:
    m = 147.2 * (101 - ffmc) / (59.5 + ffmc)
    of_wind = exp(0.05039 * wind)  # equation 24
    of_fuel = 91.9 * exp(-0.1386 * m) * (1 + m**5.31 / 4.93e7)  # 25
    return 0.208 * of_wind * of_fuel  # 26


def buildup(dmc: float, dc: float) -> float:
    """Equations 27a and 27b; a code below zero counts as zero, and so does a result, whose power is taken next."""
    p, d = max(dmc, 0.0), max(dc, 0.0)
    if not p:
        return 0.0
    share = 0.8 * d / (p + 0.4 * d)
    return max(p * share if p <= 0.4 * d else p - (1 - share) * (0.92 + (0.0114 * p) ** 1.7), 0.0)


def fire_weather(isi: float, bui: float) -> float:
    fuel = 0.626 * bui**0.809 + 2 if bui <= 80 else 1000 / (25 + 108.64 * exp(-0.023 * bui))
    b = 0.1 * isi * fuel
    return exp(2.72 * (0.434 * log(b)) ** 0.647) if b > 1 else b


def danger_class(fwi: Column) -> Column:
    """What no range holds (negative, NULL) is called extreme."""
    out = F.when((fwi >= 0) & (fwi < DANGER[0][0]), DANGER[0][1])
    for (low, _), (high, name) in zip(DANGER, DANGER[1:]):
        out = out.when((fwi >= low) & (fwi < high), name)
    return out.otherwise("extreme")


def vector_mean(speed: Column, direction: Column) -> tuple[Column, Column]:
    """(bearing, speed) aggregates of the mean wind vector."""
    u = F.avg(speed * F.sin(F.radians(direction)))
    v = F.avg(speed * F.cos(F.radians(direction)))
    return F.pmod(F.degrees(F.atan2(u, v)) + 360, F.lit(360.0)), F.hypot(u, v)
