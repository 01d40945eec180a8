"""Map labels: merging by name, and thinning by distance."""

from __future__ import annotations

from math import cos, radians

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.text import LANDMARK_RANK, is_junction, name_key, place_rank, population, sector_rank
from ..shipping import ship


def place_labels(nodes: DataFrame) -> DataFrame:
    """Settlements and landmarks with kind, rank and population; other classes, junctions and nameless nodes go."""
    people = population(F.col("population"))
    landmark = F.col("place").isin("peak", "locality")
    settled = F.col("place").isin("city", "town", "village", "hamlet")
    kept = nodes.where(F.col("name").isNotNull() & F.col("lat").isNotNull() & (settled | (landmark & ~is_junction(F.col("name")))))
    kind = F.when(landmark, "sector").when(F.col("place") == "city", "town").otherwise(F.col("place"))
    return kept.select(
        "name",
        "lat",
        "lon",
        kind.alias("kind"),
        F.coalesce(place_rank(F.col("place"), people), F.lit(LANDMARK_RANK)).alias("rank"),
        F.when(settled, people).otherwise(F.lit(0)).alias("pop"),
        F.when(settled, "place").otherwise("landmark").alias("src"),
    )


def sector_labels(areas: DataFrame, bbox: tuple[float, float, float, float]) -> DataFrame:
    """Areas as labels at the middle of their boxes, within the bounds, the more problems the higher."""
    w, s, e, n = bbox
    known = areas.where("name IS NOT NULL AND problems_count > 0 AND south IS NOT NULL AND north IS NOT NULL")
    mid = known.withColumn("lat", (F.col("south") + F.col("north")) / 2).withColumn("lon", (F.col("west") + F.col("east")) / 2)
    inside = F.col("lon").between(w, e) & F.col("lat").between(s, n)
    return mid.where(inside).select(
        "name", "lat", "lon", F.lit("sector").alias("kind"), sector_rank(F.col("problems_count")).alias("rank"), F.col("problems_count").cast("long").alias("pop"), F.lit("sector").alias("src")
    )


def first_by_name(labels: DataFrame) -> DataFrame:
    """One label for each spelling-insensitive name: sectors before others, then rank, population, name."""
    order = Window.partitionBy(name_key(F.col("name"))).orderBy(F.col("src") != "sector", "rank", F.desc("pop"), "name", "lat", "lon")
    return labels.withColumn("_n", F.row_number().over(order)).where("_n = 1").drop("_n")


#: Degrees of a map's side.
SHEET = 2


def sheet(lat: Column, lon: Column) -> Column:
    """The map that a place is on: maps are labelled apart, so their number grows with the area and none is large."""
    return F.format_string("%d/%d", (F.floor(lat / SHEET) * SHEET).cast("int"), (F.floor(lon / SHEET) * SHEET).cast("int"))


def thin(labels: DataFrame, by: str, cap: int = 200, apart: float = 700.0, lat0: float = 48.38) -> DataFrame:
    """For each map (column ``by``), non-landmarks first (best ``cap``), then the landmark farthest from all kept, again
    and again, while it is ``apart`` metres away.  Each choice depends on the last, so the labels of a map are one group,
    of which non-landmarks beyond ``cap`` and, where they fill it, all landmarks are left out before they meet;
    without any label kept, the first landmark starts."""
    ship(labels.sparkSession)
    kx, ky = 111320.0 * cos(radians(lat0)), 111320.0
    order = ["rank", F.desc("pop"), "name", "lat", "lon"]
    firm = labels.where("src != 'landmark'").withColumn("_n", F.row_number().over(Window.partitionBy(by).orderBy(*order))).where(F.col("_n") <= cap).drop("_n")
    full = firm.groupBy(by).agg(F.count(F.lit(1)).alias("_n")).where(F.col("_n") >= cap).select(by)
    needed = firm.unionByName(labels.where("src = 'landmark'").join(full, by, "left_anti").select(firm.columns))

    def pick(key: tuple, rows: pd.DataFrame) -> pd.DataFrame:
        rows = rows.assign(_p=-rows["pop"]).sort_values(["rank", "_p", "name", "lat", "lon"], kind="stable").reset_index(drop=True)
        at = np.column_stack([rows["lon"] * kx, rows["lat"] * ky])
        rest = (rows["src"] == "landmark").to_numpy()
        chosen = np.flatnonzero(~rest).tolist()
        if not chosen and len(rows):
            chosen, rest[0] = [0], False
        gap = np.full(len(rows), np.inf)
        for k in chosen:
            gap = np.minimum(gap, np.hypot(*(at - at[k]).T))
        while len(chosen) < cap and rest.any():
            best = int(np.where(rest, gap, -1.0).argmax())
            if gap[best] < apart:
                break
            chosen.append(best)
            rest[best] = False
            gap = np.minimum(gap, np.hypot(*(at - at[best]).T))
        out = rows.loc[sorted(chosen)]
        return out.assign(lat=out["lat"].round(5), lon=out["lon"].round(5))[[by, "name", "lat", "lon", "kind", "rank"]]

    kind = dict(labels.dtypes)[by]
    return needed.groupBy(by).applyInPandas(pick, f"{by} {kind}, name string, lat double, lon double, kind string, rank int")
