"""Window sampling around point features, and rollups of the samples."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.raster import BURNED, SEVERITY_LABELS, percent_where, percentile, severity_class, severity_label


def neighbourhood(features: DataFrame, cells: DataFrame, height: int, width: int, radius: int = 2, snap: str = "round") -> DataFrame:
    """Features joined with the cells of their (2r+1)-square window: an equi-join on exploded offsets.

    Features (id, row_f, col_f) whose centre is off the grid are left out; windows
    are cut at the grid's edge.  ``snap`` is "round" (half to even, from the
    corner) or "floor" (the pixel that holds the point).
    """
    to = F.bround if snap == "round" else F.floor
    centre = features.select("id", to("row_f").cast("long").alias("ry"), to("col_f").cast("long").alias("rx"))
    centre = centre.where(f"ry >= 0 AND ry < {height} AND rx >= 0 AND rx < {width}")
    offsets = F.array(*[F.lit(k) for k in range(-radius, radius + 1)])
    spots = centre.withColumn("dy", F.explode(offsets)).withColumn("dx", F.explode(offsets))
    spots = spots.select("id", (F.col("ry") + F.col("dy")).alias("y"), (F.col("rx") + F.col("dx")).alias("x"))
    return spots.join(cells, ["y", "x"])


def sample(features: DataFrame, cells: DataFrame, height: int, width: int, radius: int = 2, snap: str = "round") -> DataFrame:
    """dNBR statistics around each feature; ``cells`` has y, x, dnbr, ok.

    Unusable cells are left out unless the window has no usable one.  A feature
    off the grid has ``in_aoi`` false, one without values nothing else.
    """
    near = neighbourhood(features, cells.select("y", "x", "dnbr", "ok"), height, width, radius, snap)
    q = lambda c, p: F.percentile(c, F.lit(p))
    both = near.groupBy("id").agg(
        F.max("ok").alias("any_ok"),
        *[
            f(F.when(F.col("ok"), F.col("dnbr")) if good else F.col("dnbr")).alias(f"{n}_{int(good)}")
            for good in (True, False)
            for n, f in (
                ("med", lambda c: q(c, 0.5)),
                ("p25", lambda c: q(c, 0.25)),
                ("p75", lambda c: q(c, 0.75)),
                ("lo", F.min),
                ("hi", F.max),
                ("n", F.count),
            )
        ],
    )
    pick = lambda n: F.when(F.col("any_ok"), F.col(f"{n}_1")).otherwise(F.col(f"{n}_0")).alias(n)
    stats = both.select("id", *[pick(n) for n in ("med", "p25", "p75", "lo", "hi", "n")]).where("n > 0")
    four = lambda c: F.bround(c, 4)
    stats = stats.select(
        "id",
        four("med").alias("dnbr_median"),
        four("p25").alias("dnbr_p25"),
        four("p75").alias("dnbr_p75"),
        four(F.col("p75") - F.col("p25")).alias("dnbr_iqr"),
        four("lo").alias("dnbr_min"),
        four("hi").alias("dnbr_max"),
        severity_class(F.col("med")).alias("cls"),
        (severity_class(F.col("p25")) != severity_class(F.col("p75"))).alias("edge"),
        F.col("n").alias("n_px"),
    )
    to = F.bround if snap == "round" else F.floor
    inside = (to("row_f") >= 0) & (to("row_f") < height) & (to("col_f") >= 0) & (to("col_f") < width)
    return features.withColumn("in_aoi", inside).join(stats, "id", "left").withColumn("severity", severity_label(F.col("cls")))


def rollup(samples: DataFrame, keys: list[str], least: int, extra: dict[str, Column] | None = None) -> DataFrame:
    """Sampled features by key: how many, their median and how much burned; keys must be known."""
    known = samples.where("dnbr_median IS NOT NULL")
    for k in keys:
        known = known.where(F.col(k).isNotNull())
    out = known.groupBy(*keys).agg(
        F.count(F.lit(1)).alias("problems"),
        F.bround(percentile(F.col("dnbr_median"), 0.5), 6).alias("dnbr_median"),
        F.bround(percent_where(F.col("dnbr_median") >= BURNED), 1).alias("pct_burned"),
        *[c.alias(n) for n, c in (extra or {}).items()],
    )
    return out.where(F.col("problems") >= least)


def circuits(samples: DataFrame) -> DataFrame:
    """By (area, colour), at least five features."""
    extra = {
        "dnbr_p90": F.bround(percentile(F.col("dnbr_median"), 0.9), 6),
        "n_unresolved": F.sum(F.coalesce(F.col("edge").cast("long"), F.lit(0))),
    }
    return rollup(samples, ["area_name", "colour"], 5, extra)


def colours(samples: DataFrame) -> DataFrame:
    """By colour alone, which lumps unrelated circuits: kept because it is reported."""
    extra = {"dnbr_max": F.max("dnbr_median"), "n_edge": F.sum(F.coalesce(F.col("edge").cast("long"), F.lit(0)))}
    return rollup(samples, ["colour"], 1, extra)


def areas(samples: DataFrame) -> DataFrame:
    return rollup(samples, ["area_name"], 10)


def class_counts(samples: DataFrame) -> DataFrame:
    """Features in each severity class, in class order, zeros included."""
    spark = samples.sparkSession
    names = spark.createDataFrame(list(enumerate(SEVERITY_LABELS)), "cls int, label string")
    n = samples.where("cls IS NOT NULL").groupBy("cls").agg(F.count(F.lit(1)).alias("n"))
    return names.join(n, "cls", "left").select("cls", "label", F.coalesce("n", F.lit(0)).alias("n"))
