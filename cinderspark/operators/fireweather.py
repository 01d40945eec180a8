"""Daily fire weather from hourly records."""

from __future__ import annotations

import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..functions import weather as fw
from ..shipping import ship

#: Local noon, in UTC.
NOON = 11


def rolling_rain(hourly: DataFrame, by: list[str], rows: int = 24) -> DataFrame:
    """``rain24``: the sum over a station's last ``rows`` rows (``by`` names it); a missing hour stretches the window, as it counts rows."""
    w = Window.partitionBy(*by).orderBy("ts").rowsBetween(1 - rows, 0)
    return hourly.withColumn("rain24", F.sum("precip").over(w))


def noon_rows(hourly: DataFrame, by: list[str]) -> DataFrame:
    """Noon values with the rain of the 24 hours before, taken before the other hours go."""
    return rolling_rain(hourly, by).where(F.hour("ts") == NOON)


def fire_weather_index(noon: DataFrame, station: str = "station", start: tuple[float, float, float] = fw.START) -> DataFrame:
    """The codes carried from day to day for each station, rounded to 2 places at the end only.

    A day depends on the one before, so a station is folded in date order;
    stations run side by side.
    """
    ship(noon.sparkSession)
    columns = ["temp", "rh", "wind", "rain24"]

    def fold(key: tuple, days: pd.DataFrame) -> pd.DataFrame:
        ffmc, dmc, dc = start
        out = []
        for ts, temp, rh, wind, rain in days.sort_values("ts")[["ts", *columns]].itertuples(index=False):
            rh = min(max(rh, 0.0), 100.0)
            ffmc = fw.fine_fuel(temp, rh, wind, rain, ffmc)
            dmc = fw.duff(temp, rh, rain, dmc, ts.month)
            dc = fw.drought(temp, rain, dc, ts.month)
            isi, bui = fw.initial_spread(ffmc, wind), fw.buildup(dmc, dc)
            values = (temp, rh, wind, rain, ffmc, dmc, dc, isi, bui, fw.fire_weather(isi, bui))
            out.append((key[0], ts.normalize(), *(round(v, 2) for v in values)))
        return pd.DataFrame(out, columns=[station, "date", *columns, "ffmc", "dmc", "dc", "isi", "bui", "fwi"])

    kind = dict(noon.dtypes)[station]
    schema = f"{station} {kind}, date timestamp, " + ", ".join(f"{c} double" for c in [*columns, "ffmc", "dmc", "dc", "isi", "bui", "fwi"])
    return noon.select(station, "ts", *columns).groupBy(station).applyInPandas(fold, schema)


def share_below(days: DataFrame, value: str, than: DataFrame) -> DataFrame:
    """Percent of all rows strictly below the one value of ``than``."""
    one = than.select(F.col(value).alias("_v"))
    return days.crossJoin(F.broadcast(one)).agg(F.bround(F.avg((F.col(value) < F.col("_v")).cast("int")) * 100, 2).alias("pct_below"))


def season_means(days: DataFrame, date: str, value: str, months: tuple[int, ...] = (6, 7, 8)) -> DataFrame:
    """(year, mean, rank) of the days in some months: sums of hundredths, divided once, to 2 places; the rank is one more
    than the years below.  What is ranked is one row a year."""
    cents = F.sum(F.bround(F.col(value) * 100).cast("long"))
    season = days.where(F.month(date).isin(*months)).groupBy(F.year(date).alias("year"))
    means = season.agg(F.bround(cents / F.count(F.lit(1)) / 100, 2).alias("mean"))
    return means.withColumn("rank", F.rank().over(Window.orderBy("mean")).cast("long"))
