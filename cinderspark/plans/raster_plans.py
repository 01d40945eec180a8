"""Per-pixel plans: reflectance, indices, classes, masks, areas, histograms."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import raster as R
from ..operators import zonal
from ..operators.quantiles import exact_quantiles
from ..sources.derived import pixels
from .registry import query


def delta(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Pixels with the ratios, their difference and the usable mask."""
    px = pixels(spark, sf_dir)
    both = px.withColumns({"npre": R.nbr(F.col("nir_pre"), F.col("swir_pre")), "npost": R.nbr(F.col("nir_post"), F.col("swir_post"))})
    both = both.withColumn("dnbr", F.col("npre") - F.col("npost"))
    return both.withColumns({"rdnbr": R.rdnbr(F.col("npre"), F.col("dnbr")), "ok": R.usable(F.col("scl_pre")) & R.usable(F.col("scl_post"))})


def classed(spark: SparkSession, sf_dir: str) -> DataFrame:
    return delta(spark, sf_dir).withColumn("cls", R.severity_class(F.col("dnbr")))


@query("r1_reflectance", "SELECT y, x, greatest((dn_pre - 1000) / 10000::DOUBLE, 0::DOUBLE) AS refl FROM px", "px")
def r1(spark, sf_dir):
    return pixels(spark, sf_dir).select("y", "x", R.reflectance(F.col("dn_pre"), F.lit(-1000)).alias("refl"))


@query("r3_nbr", "SELECT y, x, round_even(npre, 6) AS nbr_pre, round_even(npost, 6) AS nbr_post FROM delta", "delta")
def r3(spark, sf_dir):
    return delta(spark, sf_dir).select("y", "x", F.bround("npre", 6).alias("nbr_pre"), F.bround("npost", 6).alias("nbr_post"))


@query("r4_dnbr", "SELECT y, x, round_even(dnbr, 6) AS dnbr FROM delta", "delta")
def r4(spark, sf_dir):
    return delta(spark, sf_dir).select("y", "x", F.bround("dnbr", 6).alias("dnbr"))


@query("r5_rdnbr", "SELECT y, x, round_even(rdnbr, 5) AS rdnbr FROM delta", "delta")
def r5(spark, sf_dir):
    return delta(spark, sf_dir).select("y", "x", F.bround("rdnbr", 5).alias("rdnbr"))


@query("r6_classify", "SELECT y, x, cls, label FROM classed LEFT JOIN names ON code = cls", "classed", "names")
def r6(spark, sf_dir):
    return classed(spark, sf_dir).select("y", "x", "cls", R.severity_label(F.col("cls")).alias("label"))


@query("r7_burned_mask", "SELECT y, x, coalesce(dnbr >= 0.27, false) AS burned FROM delta", "delta")
def r7(spark, sf_dir):
    return delta(spark, sf_dir).select("y", "x", R.at_least(F.col("dnbr")).alias("burned"))


@query("r8_low_mask", "SELECT y, x, coalesce(dnbr >= 0.10, false) AND ok AS low FROM delta", "delta")
def r8(spark, sf_dir):
    return delta(spark, sf_dir).select("y", "x", (R.at_least(F.col("dnbr"), R.LOW) & F.col("ok")).alias("low"))


@query("r9_valid_mask", "SELECT y, x, ok FROM delta", "delta")
def r9(spark, sf_dir):
    return delta(spark, sf_dir).select("y", "x", "ok")


@query("r10_masked_class", "SELECT y, x, CASE WHEN ok THEN cls ELSE -1 END AS cls FROM classed", "classed")
def r10(spark, sf_dir):
    return classed(spark, sf_dir).select("y", "x", F.when(F.col("ok"), F.col("cls")).otherwise(-1).alias("cls"))


@query("r14_hectares", "SELECT fuel, count(*) * 100 / 10000::DOUBLE AS ha FROM px GROUP BY fuel", "px")
def r14(spark, sf_dir):
    return pixels(spark, sf_dir).groupBy("fuel").agg(R.hectares(F.count(F.lit(1))).alias("ha"))


@query("p3_finite", "SELECT count(*) AS n FROM delta WHERE dnbr IS NOT NULL", "delta")
def p3(spark, sf_dir):
    return delta(spark, sf_dir).where(F.col("dnbr").isNotNull()).agg(F.count(F.lit(1)).alias("n"))


@query("j3_pair_alignment", "SELECT y, x, nir_pre, nir_post FROM px WHERE nir_pre IS NOT NULL AND nir_post IS NOT NULL", "px")
def j3(spark, sf_dir):
    return pixels(spark, sf_dir).where("nir_pre IS NOT NULL AND nir_post IS NOT NULL").select("y", "x", "nir_pre", "nir_post")


SCL_SQL = """SELECT scl_pre || ':' || ['nodata','saturated','dark','shadow','vegetation','bare','water','unclassified','cloud_medium','cloud_high','cirrus','snow'][scl_pre + 1] AS class,
    round_even(n * 100.0::DOUBLE / t, 2) AS pct FROM (SELECT scl_pre, count(*) AS n, sum(count(*)) OVER () AS t FROM px GROUP BY scl_pre) WHERE n * 100.0::DOUBLE / t > 0.01"""


@query("g1_scl_histogram", SCL_SQL, "px")
def g1(spark, sf_dir):
    return zonal.scl_histogram(pixels(spark, sf_dir), "scl_pre")


@query(
    "g2_scene_probe",
    """SELECT fuel AS scene, round_even(sum((scl_pre = 0)::INT) * 100.0::DOUBLE / count(*), 2) AS nodata_pct,
    round_even(sum((scl_pre NOT IN (0, 1, 3, 8, 9, 10))::INT) * 100.0::DOUBLE / count(*), 2) AS valid_pct FROM px GROUP BY fuel""",
    "px",
)
def g2(spark, sf_dir):
    return zonal.probe(pixels(spark, sf_dir).withColumnRenamed("fuel", "scene"), "scl_pre", "scene")


AREAS_SQL = "SELECT code AS cls, label, round_even(count(y) * 100 / 10000::DOUBLE, 1) AS ha FROM names LEFT JOIN classed ON cls = code GROUP BY code, label"


@query("g3_class_areas", AREAS_SQL, "classed", "names")
def g3(spark, sf_dir):
    return zonal.class_areas(classed(spark, sf_dir))


@query("g4_burned_total", f"SELECT round_even(sum(ha), 1) AS total_ha FROM ({AREAS_SQL}) WHERE contains(label, 'severity')", "classed", "names")
def g4(spark, sf_dir):
    areas = zonal.class_areas(classed(spark, sf_dir))
    return areas.where(F.col("label").contains("severity")).agg(F.bround(F.sum("ha"), 1).alias("total_ha"))


@query(
    "g5_scar_overlap",
    """SELECT scl_post AS code, round_even(count(*) * 100.0::DOUBLE / sum(count(*)) OVER (), 2) AS pct FROM delta
    WHERE coalesce(dnbr >= 0.27, false) GROUP BY scl_post""",
    "delta",
)
def g5(spark, sf_dir):
    return zonal.overlap(delta(spark, sf_dir), R.at_least(F.col("dnbr")), "scl_post")


@query(
    "g6_global_percentiles",
    """SELECT round_even(quantile_cont(dnbr, 0.5), 4) AS d50, round_even(quantile_cont(dnbr, 0.99), 4) AS d99, round_even(max(dnbr), 4) AS dmax,
    round_even(quantile_cont(rdnbr, 0.5), 4) AS r50, round_even(quantile_cont(rdnbr, 0.99), 4) AS r99, round_even(max(rdnbr), 4) AS rmax FROM delta""",
    "delta",
)
def g6(spark, sf_dir):
    d = delta(spark, sf_dir).select("dnbr", "rdnbr")
    four = lambda c: F.bround(c, 4)
    q = exact_quantiles(d, [], {"dnbr": [0.5, 0.99, 1.0], "rdnbr": [0.5, 0.99, 1.0]})
    return q.select(*[four(F.get(c, F.lit(k))).alias(f"{c[0]}{n}") for c in ("dnbr", "rdnbr") for k, n in enumerate(("50", "99", "max"))])


@query(
    "g12_zonal_severity",
    """SELECT fuel, round_even(count(*) / 100::DOUBLE, 1) AS ha, round_even(sum((dnbr >= 0.27)::INT) * 100.0::DOUBLE / nullif(count(dnbr), 0), 1) AS pct_burned,
    round_even(median(dnbr), 3) AS dnbr_median, round_even(quantile_cont(dnbr, 0.9), 3) AS dnbr_p90, round_even(median(rdnbr), 3) AS rdnbr_median
    FROM delta WHERE fuel >= 0 GROUP BY fuel HAVING count(*) / 100::DOUBLE >= 0.5""",
    "delta",
)
def g12(spark, sf_dir):
    return zonal.zones(delta(spark, sf_dir), "fuel", least_ha=0.5)


CROSS_SQL = """SELECT t AS threshold, round_even(sum((h)::INT) / 100::DOUBLE, 1) AS total, round_even(sum((h AND f)::INT) / 100::DOUBLE, 1) AS forest,
    round_even(sum((h AND NOT f AND a)::INT) / 100::DOUBLE, 1) AS farmland, round_even(sum((h AND NOT f AND NOT a)::INT) / 100::DOUBLE, 1) AS neither
    FROM (SELECT t, coalesce(dnbr >= t, false) AND ok AS h, fuel IN (0, 1, 2) AS f, fuel = 4 AS a FROM delta, (SELECT unnest([0.10, 0.27])::DOUBLE AS t)) GROUP BY t"""


@query("g13_threshold_crosstab", CROSS_SQL, "delta")
def g13(spark, sf_dir):
    return zonal.threshold_table(delta(spark, sf_dir), F.col("fuel").isin(0, 1, 2), F.col("fuel") == 4)


@query(
    "g14_forest_summary",
    """SELECT round_even(sum((fuel IN (0, 1, 2))::INT) / 100::DOUBLE, 1) AS forest_ha, round_even(sum((fuel = 4)::INT) / 100::DOUBLE, 1) AS farmland_ha,
    round_even(sum((fuel IN (0, 1, 2) AND fuel = 4)::INT) / 100::DOUBLE, 1) AS both_ha, round_even(sum((ok AND coalesce(dnbr >= 0.27, false))::INT) / 100::DOUBLE, 1) AS burned_ha,
    round_even(sum((NOT ok)::INT) / 100::DOUBLE, 1) AS unusable_ha FROM delta""",
    "delta",
)
def g14(spark, sf_dir):
    forest, farm = F.col("fuel").isin(0, 1, 2), F.col("fuel") == 4
    ha = lambda c: F.bround(R.hectares(F.sum(c.cast("long"))), 1)
    return delta(spark, sf_dir).agg(
        ha(forest).alias("forest_ha"), ha(farm).alias("farmland_ha"), ha(forest & farm).alias("both_ha"),
        ha(F.col("ok") & R.at_least(F.col("dnbr"))).alias("burned_ha"), ha(~F.col("ok")).alias("unusable_ha"),
    )


@query(
    "g15_partial_effects",
    """SELECT greatest(1, len(list_filter(e, lambda v: v < x)))::INT AS bin, round_even(avg(d), 3) AS mean, round_even(median(d), 3) AS median, count(*) AS size
    FROM (SELECT nir_pre AS x, dnbr AS d FROM delta WHERE nir_pre IS NOT NULL AND dnbr IS NOT NULL),
         (SELECT list_distinct(quantile_cont(nir_pre, [0, 0.125, 0.25, 0.375, 0.5, 0.625, 0.75, 0.875, 1])) AS e FROM delta WHERE dnbr IS NOT NULL)
    GROUP BY 1""",
    "delta",
)
def g15(spark, sf_dir):
    return zonal.quantile_bins(delta(spark, sf_dir).where("dnbr IS NOT NULL"), "nir_pre", "dnbr")


HIST_SQL = """WITH v AS (SELECT dn_pre::DOUBLE AS x FROM px), t AS (SELECT max(x) AS top FROM v),
    h AS (SELECT least(46, (floor(x / (top / 46)) + 1)::INT) AS bin, count(*) AS n FROM v, t WHERE x >= 0 GROUP BY 1)
    SELECT b::INT AS bin, coalesce(n, 0) AS n, greatest(1, round_even(coalesce(n, 0) * 100.0::DOUBLE / max(coalesce(n, 0)) OVER (), 0)::INT) AS height
    FROM (SELECT unnest(range(1, 47)) AS b) LEFT JOIN h ON h.bin = b"""


@query("g27_histogram", HIST_SQL, "px")
def g27(spark, sf_dir):
    return zonal.equal_bins(pixels(spark, sf_dir).select(F.col("dn_pre").cast("double").alias("x")), "x")


@query("u1_mask_algebra", "SELECT count(*) FILTER (b AND f) AS both, count(*) FILTER (b OR f) AS either, count(*) FILTER (b AND NOT f) AS only_burned FROM (SELECT coalesce(dnbr >= 0.27, false) AS b, fuel IN (0, 1, 2) AS f FROM delta)", "delta")
def u1(spark, sf_dir):
    masks = delta(spark, sf_dir).select(R.at_least(F.col("dnbr")).alias("b"), F.col("fuel").isin(0, 1, 2).alias("f"))
    n = lambda c: F.count_if(c)
    return masks.agg(n(F.col("b") & F.col("f")).alias("both"), n(F.col("b") | F.col("f")).alias("either"), n(F.col("b") & ~F.col("f")).alias("only_burned"))


@query("u5_late_mask", "SELECT y, x FROM delta WHERE coalesce(dnbr >= 0.10, false) AND NOT (coalesce(dnbr >= 0.27, false) AND ok)", "delta")
def u5(spark, sf_dir):
    d = F.col("dnbr")
    return delta(spark, sf_dir).where(R.at_least(d, R.LOW) & ~(R.at_least(d) & F.col("ok"))).select("y", "x")


@query("t5_classes_by_area", f"SELECT label, ha, row_number() OVER (ORDER BY ha DESC, label)::INT AS place FROM ({AREAS_SQL})", "classed", "names")
def t5(spark, sf_dir):
    from pyspark.sql import Window

    areas = zonal.class_areas(classed(spark, sf_dir))
    return areas.select("label", "ha", F.row_number().over(Window.orderBy(F.desc("ha"), "label")).alias("place"))


@query(
    "k6_fixed_stretch",
    """SELECT y, x, (least(greatest(coalesce(red_pre, 0) / 0.30, 0), 1) * 255)::DOUBLE AS r255, floor(least(greatest(coalesce(green_pre, 0) / 0.30, 0), 1) * 255)::INT AS g,
    floor(least(greatest(coalesce(blue_pre, 0) / 0.30, 0), 1) * 255)::INT AS b FROM px""".replace("(least(greatest(coalesce(red_pre, 0) / 0.30, 0), 1) * 255)::DOUBLE AS r255", "floor(least(greatest(coalesce(red_pre, 0) / 0.30, 0), 1) * 255)::INT AS r"),
    "px",
)
def k6(spark, sf_dir):
    byte = lambda c: F.floor(F.least(F.greatest(F.coalesce(c, F.lit(0.0)) / F.lit(0.30), F.lit(0.0)), F.lit(1.0)) * 255).cast("int")
    return pixels(spark, sf_dir).select("y", "x", *[byte(F.col(f"{c}_pre")).alias(c[0]) for c in ("red", "green", "blue")])


@query(
    "k7_colormap_alpha",
    "SELECT y, x, round_even(least(greatest((coalesce(dnbr, -0.3) + 0.3) / 1.3, 0), 1), 6) AS level, CASE WHEN coalesce(dnbr, -0.3) < 0.10 THEN 0 ELSE 255 END AS alpha FROM delta",
    "delta",
)
def k7(spark, sf_dir):
    v = F.coalesce("dnbr", F.lit(-0.3))
    level = F.least(F.greatest((v + 0.3) / 1.3, F.lit(0.0)), F.lit(1.0))
    return delta(spark, sf_dir).select("y", "x", F.bround(level, 6).alias("level"), F.when(v < 0.10, 0).otherwise(255).alias("alpha"))


@query("k8_class_palette", "SELECT y, x, CASE WHEN cls >= 0 THEN ['#1a9850','#91cf60','#ffffbf','#fee08b','#fdae61','#f46d43','#a50026'][cls + 1] END AS colour, CASE WHEN cls < 3 THEN 0 ELSE 255 END AS alpha FROM classed", "classed")
def k8(spark, sf_dir):
    palette = F.array(*map(F.lit, ("#1a9850", "#91cf60", "#ffffbf", "#fee08b", "#fdae61", "#f46d43", "#a50026")))
    return classed(spark, sf_dir).select("y", "x", F.when(F.col("cls") >= 0, F.get(palette, F.col("cls"))).alias("colour"), F.when(F.col("cls") < 3, 0).otherwise(255).alias("alpha"))


@query(
    "k11_percentile_stretch",
    """WITH p AS (SELECT unnest([red_pre, green_pre, blue_pre]) AS v FROM px), q AS (SELECT quantile_cont(v, 0.02) AS lo, quantile_cont(v, 0.98) AS hi FROM p WHERE v IS NOT NULL)
    SELECT y, x, round_even(least(greatest((red_pre - lo) / greatest(hi - lo, 1e-6), 0), 1), 5) AS r FROM px, q WHERE red_pre IS NOT NULL""",
    "px",
)
def k11(spark, sf_dir):
    px = pixels(spark, sf_dir)
    pooled = px.select(F.explode(F.array("red_pre", "green_pre", "blue_pre")).alias("v"))
    low, high = exact_quantiles(pooled, [], {"v": [0.02, 0.98]}).first().v
    level = (F.col("red_pre") - low) / max(high - low, 1e-6)
    return px.where("red_pre IS NOT NULL").select("y", "x", F.bround(F.least(F.greatest(level, F.lit(0.0)), F.lit(1.0)), 5).alias("r"))


@query(
    "k12_quicklook_quality",
    """SELECT fuel AS scene, round_even(sum((scl_pre = 0 OR nir_pre IS NULL)::INT) * 100.0::DOUBLE / count(*), 1) AS nodata,
    sum((scl_pre = 0 AND (x + y) % 16 < 3)::INT)::BIGINT AS hatched FROM px GROUP BY fuel""",
    "px",
)
def k12(spark, sf_dir):
    missing = (F.col("scl_pre") == 0) | F.col("nir_pre").isNull()
    hatch = (F.col("scl_pre") == 0) & ((F.col("x") + F.col("y")) % 16 < 3)
    px = pixels(spark, sf_dir).withColumnRenamed("fuel", "scene")
    return px.groupBy("scene").agg(F.bround(R.percent_where(missing), 1).alias("nodata"), F.sum(hatch.cast("long")).alias("hatched"))
