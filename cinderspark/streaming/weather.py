"""Streaming forms of the hourly weather plans: the same results from unbounded input."""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

from ..functions import weather as fw
from ..shipping import ship


def hourly_means(readings: DataFrame, late: str = "2 hours") -> DataFrame:
    """Event-time hourly means of readings (ts, station, value); readings later than ``late`` are dropped."""
    windowed = readings.withWatermark("ts", late).groupBy("station", F.window("ts", "1 hour"))
    return windowed.agg(F.avg("value").alias("mean"), F.count(F.lit(1)).alias("n")).select("station", F.col("window.start").alias("ts"), "mean", "n")


def first_readings(readings: DataFrame, late: str = "2 hours") -> DataFrame:
    """One reading for each station and time, whichever comes first."""
    return readings.withWatermark("ts", late).dropDuplicatesWithinWatermark(["station", "ts"])


_STATE = "ffmc double, dmc double, dc double, last timestamp, late long"
_OUT = "station string, ts timestamp, ffmc double, dmc double, dc double, fwi double, late long"


def streaming_fwi(noon: DataFrame, start: tuple[float, float, float] = fw.START) -> DataFrame:
    """The fire weather index of noon rows (station, ts, temp, rh, wind, rain24) as they come.

    The three codes are each station's state.  Rows of a batch are folded in
    time order; a row at or before the last one folded comes too late to count and
    is left out, and ``late`` says how many of a station's were so far.
    """
    ship(noon.sparkSession)

    def fold(key: tuple, frames: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        ffmc, dmc, dc, last, late = state.get if state.exists else (*start, None, 0)
        rows = pd.concat(list(frames)).sort_values("ts")
        out = []
        for r in rows.itertuples(index=False):
            if last is not None and r.ts <= last:
                late += 1
                continue
            rh = min(max(r.rh, 0.0), 100.0)
            ffmc = fw.fine_fuel(r.temp, rh, r.wind, r.rain24, ffmc)
            dmc = fw.duff(r.temp, rh, r.rain24, dmc, r.ts.month)
            dc = fw.drought(r.temp, r.rain24, dc, r.ts.month)
            index = fw.fire_weather(fw.initial_spread(ffmc, r.wind), fw.buildup(dmc, dc))
            last = r.ts
            out.append((key[0], r.ts, round(ffmc, 2), round(dmc, 2), round(dc, 2), round(index, 2), late))
        state.update((ffmc, dmc, dc, last, late))
        yield pd.DataFrame(out, columns=["station", "ts", "ffmc", "dmc", "dc", "fwi", "late"])

    return noon.groupBy("station").applyInPandasWithState(fold, _OUT, _STATE, "append", GroupStateTimeout.NoTimeout)
