"""Statistics over pixels: classes, histograms, zones, cross tables."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.raster import BURNED, SCL_NAMES, SEVERITY_LABELS, at_least, hectares, percent_where
from .quantiles import exact_quantiles


def class_areas(classed: DataFrame, res: float = 10.0) -> DataFrame:
    """Hectares in each severity class, classes without pixels included, no-data excluded."""
    names = classed.sparkSession.createDataFrame(list(enumerate(SEVERITY_LABELS)), "cls int, label string")
    n = classed.where("cls >= 0").groupBy("cls").agg(F.count(F.lit(1)).alias("n"))
    joined = names.join(n, "cls", "left").withColumn("n", F.coalesce("n", F.lit(0)))
    return joined.select("cls", "label", F.bround(hectares(F.col("n"), res), 1).alias("ha"))


def scl_histogram(cells: DataFrame, scl: str, by: list[str] | None = None) -> DataFrame:
    """Percent of all pixels in each scene class, those over 0.01 %, named "code:name"."""
    by = by or []
    n = cells.groupBy(*by, F.col(scl).alias("code")).agg(F.count(F.lit(1)).alias("n"))
    pct = F.col("n") * 100.0 / F.sum("n").over(Window.partitionBy(*by))
    named = F.concat_ws(":", "code", F.get(F.array(*map(F.lit, SCL_NAMES)), F.col("code")))
    return n.withColumn("pct", pct).where("pct > 0.01").select(*by, named.alias("class"), F.bround("pct", 2).alias("pct"))


def probe(cells: DataFrame, scl: str, by: str) -> DataFrame:
    """Share of missing and of usable pixels for each scene."""
    from ..functions.raster import usable

    return cells.groupBy(by).agg(
        F.bround(percent_where(F.col(scl) == 0), 2).alias("nodata_pct"), F.bround(percent_where(usable(F.col(scl))), 2).alias("valid_pct")
    )


def zones(cells: DataFrame, zone: str, least_ha: float = 5.0, res: float = 10.0) -> DataFrame:
    """Severity by class of land: area from all pixels, the rest from those with a value.

    Classes are few and large, so their percentiles go through ``exact_quantiles``.
    """
    inside = cells.where(F.col(zone) >= 0).select(zone, "dnbr", "rdnbr")
    out = inside.groupBy(zone).agg(
        hectares(F.count(F.lit(1)), res).alias("ha"),
        F.bround(F.sum((F.col("dnbr") >= BURNED).cast("long")) * 100.0 / F.nullif(F.count("dnbr"), F.lit(0)), 1).alias("pct_burned"),
    )
    q = exact_quantiles(inside, [zone], {"dnbr": [0.5, 0.9], "rdnbr": [0.5]})
    three = lambda c, k, n: F.bround(F.get(c, F.lit(k)), 3).alias(n)
    q = q.select(zone, three("dnbr", 0, "dnbr_median"), three("dnbr", 1, "dnbr_p90"), three("rdnbr", 0, "rdnbr_median"))
    return out.where(F.col("ha") >= least_ha).join(q, zone).withColumn("ha", F.bround("ha", 1))


def threshold_table(cells: DataFrame, forest: Column, farmland: Column, thresholds: tuple[float, ...] = (0.10, BURNED), res: float = 10.0) -> DataFrame:
    """Burned hectares at each threshold: in all, in forest, on farmland outside forest, in neither."""
    marked = cells.select("dnbr", "ok", forest.alias("f"), farmland.alias("a"))
    each = marked.select("*", F.explode(F.array(*map(F.lit, thresholds))).alias("threshold"))
    hit = at_least(F.col("dnbr"), F.col("threshold")) & F.col("ok")
    ha = lambda c: F.bround(hectares(F.sum(c.cast("long")), res), 1)
    return each.groupBy("threshold").agg(
        ha(hit).alias("total"), ha(hit & F.col("f")).alias("forest"), ha(hit & ~F.col("f") & F.col("a")).alias("farmland"), ha(hit & ~F.col("f") & ~F.col("a")).alias("neither")
    )


def overlap(cells: DataFrame, mask: Column, scl: str) -> DataFrame:
    """Scene classes within a mask, percent of the masked pixels; none if it is empty."""
    n = cells.where(mask).groupBy(F.col(scl).alias("code")).agg(F.count(F.lit(1)).alias("n"))
    return n.select("code", F.bround(F.col("n") * 100.0 / F.sum("n").over(Window.partitionBy()), 2).alias("pct"))


def quantile_bins(rows: DataFrame, x: str, y: str, bins: int = 8) -> DataFrame:
    """Mean, median and size of y in the quantile bins of x: right-closed, the lowest value included, equal edges merged."""
    known = rows.where(F.col(x).isNotNull()).select(x, y)
    edges = exact_quantiles(known, [], {x: [k / bins for k in range(bins + 1)]}).select(F.array_distinct(x).alias("edges"))
    below = F.size(F.filter("edges", lambda e: e < F.col(x)))
    binned = known.crossJoin(F.broadcast(edges)).select(F.greatest(F.lit(1), below).alias("bin"), y)
    out = binned.groupBy("bin").agg(F.bround(F.avg(y), 3).alias("mean"), F.count(F.lit(1)).alias("size"))
    middle = exact_quantiles(binned, ["bin"], {y: [0.5]}).select("bin", F.bround(F.get(y, F.lit(0)), 3).alias("median"))
    return out.join(middle, "bin").select("bin", "mean", "median", "size")


def equal_bins(rows: DataFrame, x: str, bins: int = 46) -> DataFrame:
    """A histogram on [0, max]: the last bin holds the maximum, empty bins are listed; bar heights out of 100."""
    top = rows.agg(F.max(x).alias("top"))
    place = F.least(F.lit(bins), (F.floor(F.col(x) / (F.col("top") / bins)) + 1).cast("int"))
    n = rows.where(F.col(x) >= 0).crossJoin(F.broadcast(top)).groupBy(place.alias("bin")).agg(F.count(F.lit(1)).alias("n"))
    every = rows.sparkSession.range(1, bins + 1).select(F.col("id").cast("int").alias("bin"))
    joined = every.join(n, "bin", "left").withColumn("n", F.coalesce("n", F.lit(0)))
    peak = F.max("n").over(Window.partitionBy())
    return joined.select("bin", "n", F.greatest(F.lit(1), F.bround(F.col("n") * 100.0 / peak).cast("int")).alias("height"))
