"""Domain views over the star-schema tables: rasters, hourly weather, features, catalogues.

Sums are of integers and divided once, so a view is the same whatever order its
rows are added in.
"""

from __future__ import annotations

from functools import reduce
from math import isqrt

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .tables import read

FUELS = ("closed conifer", "open conifer", "broadleaf", "heath", "mixed")


def side(spark: SparkSession, sf_dir: str) -> int:
    """Side of the pixel raster, from the row count in the files' footers."""
    return max(1, isqrt(read(spark, sf_dir, "lineitem").count() // 24))


def pixels(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The two-date raster: y, x, bands and scene class before and after, fuel code.

    Both dates come out of one aggregation, so the dates' alignment costs no join.
    """
    s = side(spark, sf_dir)
    items = read(spark, sf_dir, "lineitem")
    hundredths = lambda c: F.round(F.col(c) * 100).cast("long")
    rows = items.select(
        (F.col("l_partkey") % s).alias("y"),
        (F.col("l_orderkey") % s).alias("x"),
        (F.year("l_shipdate") < 1998).alias("pre"),
        F.col("l_quantity").cast("long").alias("q"),
        hundredths("l_discount").alias("d"),
        hundredths("l_tax").alias("t"),
    )
    sums = []
    for name, when in (("pre", F.col("pre")), ("post", ~F.col("pre"))):
        sums += [F.sum(F.when(when, F.col(c))).alias(f"{c}_{name}") for c in ("q", "d", "t")]
        sums.append(F.sum(when.cast("long")).alias(f"n_{name}"))
    cells = rows.groupBy("y", "x").agg(*sums)
    out = []
    for name in ("pre", "post"):
        q, d, t, n = (F.col(f"{c}_{name}") for c in ("q", "d", "t", "n"))
        some = n > 0
        out += [
            F.when(some, q / (n * 50)).alias(f"nir_{name}"),
            F.when(some, d / (n * 10)).alias(f"swir_{name}"),
            F.when(some, t / (n * 20)).alias(f"red_{name}"),
            F.when(some, (q % 97) / F.lit(300.0)).alias(f"green_{name}"),
            F.when(some, (d % 31) / F.lit(200.0)).alias(f"blue_{name}"),
            F.coalesce((q + F.col("y") * F.col("x")) % 12, F.lit(0)).cast("int").alias(f"scl_{name}"),
            F.coalesce(q, F.lit(0)).alias(f"dn_{name}"),
        ]
    fuel = (F.floor(F.col("y") / 5) + F.floor(F.col("x") / 7)) % 6 - 1
    return cells.select("y", "x", *out, fuel.cast("int").alias("fuel"))


def dense(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The dense raster: one row of cells for each vector, values as doubles."""
    vectors = read(spark, sf_dir, "embeddings")
    return vectors.select(
        F.col("vec_id").alias("y"), F.col("label").cast("int").alias("label"), F.posexplode("embedding").alias("x", "v")
    ).select("y", F.col("x").cast("long").alias("x"), F.col("v").cast("double").alias("v"), "label")


def hourly(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One row of weather for each hour with events."""
    per = (
        read(spark, sf_dir, "events")
        .groupBy(F.date_trunc("hour", "ts").alias("ts"))
        .agg(F.sum(F.round(F.col("value") * 100).cast("long")).alias("s"), F.count(F.lit(1)).alias("n"))
    )
    s, n = F.abs(F.col("s")), F.col("n")
    return per.select(
        "ts",
        (F.lit(12.0) + (s % 2300) / F.lit(100.0)).alias("temp"),
        (F.lit(20.0) + (s % 7000) / F.lit(100.0)).alias("rh"),
        ((s % 3000) / F.lit(100.0)).alias("wind"),
        (s % 360).cast("double").alias("dir"),
        ((s % 4100) / F.lit(100.0)).alias("gust"),
        F.when(n % 7 == 0, (s % 500) / F.lit(100.0)).otherwise(0.0).alias("precip"),
        ((s % 2200) * F.lit(1.0)).alias("blh"),
    )


def problems(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Point features with area and cluster, by two outer joins with small tables."""
    s = side(spark, sf_dir)
    c = read(spark, sf_dir, "customer")
    areas = read(spark, sf_dir, "nation").select(
        F.col("n_nationkey").alias("area_id"), F.col("n_name").alias("area_name"), F.col("n_regionkey").alias("cluster_id")
    )
    clusters = read(spark, sf_dir, "region").select(F.col("r_regionkey").alias("cluster_id"), F.col("r_name").alias("cluster_name"))
    key = F.col("c_custkey")
    base = c.select(
        key.alias("id"),
        F.col("c_name").alias("name"),
        F.nullif(F.col("c_nationkey"), F.lit(24)).alias("area_id"),
        F.nullif(F.col("c_mktsegment"), F.lit("MACHINERY")).alias("colour"),
        (key % 70).cast("int").alias("grade_no"),
        ((key * 7919) % (10 * s) / F.lit(10.0)).alias("col_f"),
        ((key * 104729) % (10 * s) / F.lit(10.0)).alias("row_f"),
        (F.lit(2.4) + (key % 400) / F.lit(1000.0)).alias("lon"),
        (F.lit(48.2) + (key % 300) / F.lit(1000.0)).alias("lat"),
    )
    return base.join(areas, "area_id", "left").join(clusters, "cluster_id", "left")


def catalogue(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Scene items: id, time, cloud, baseline, whether the offset is applied, bounding box."""
    o = read(spark, sf_dir, "orders")
    k = F.col("o_orderkey")
    baselines = F.array(*[F.lit(b) for b in ("02.14", "03.99", "04.00", "05.10", "abc")])
    return o.select(
        F.concat(F.lit("S2_"), k.cast("string")).alias("id"),
        F.col("o_orderdate").alias("datetime"),
        (F.floor(F.col("o_totalprice")).cast("long") % 100).alias("cloud"),
        F.when(k % 11 != 0, F.get(baselines, (k % 5).cast("int"))).alias("baseline"),
        F.when(k % 3 == 0, F.lit(True)).when(k % 3 == 1, F.lit(False)).alias("applied"),
        (F.lit(2.0) + (k % 100) / F.lit(100.0)).alias("west"),
        (F.lit(48.0) + (k % 80) / F.lit(100.0)).alias("south"),
    )


def orbits(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Object keys that carry a sensing window and a variable, one for each event."""
    e = read(spark, sf_dir, "events")
    variable = F.when(F.col("user_id") % 3 == 0, "PRODUCT_aerosol_index").otherwise("PRODUCT_carbonmonoxide")
    stamp = lambda c: F.date_format(c, "yyyyMMdd'T'HHmmss")
    end = F.col("ts") + F.expr("INTERVAL 100 MINUTES")
    return e.select(
        F.concat(
            F.lit("COGT/OFFL/L2/"), F.date_format("ts", "yyyy/MM/dd"), F.lit("/S5P_"), F.col("event_id").cast("string"), F.lit("_"),
            stamp(F.col("ts")), F.lit("_"), stamp(end), F.lit("_"), variable, F.lit("_4326.tif"),
        ).alias("key"),
        F.pmod(F.floor(F.col("value")).cast("long"), F.lit(100)).cast("double").alias("coverage"),
    )


def places(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Map label candidates: suppliers and nations with a class, a free-text population and a place."""
    s, n = read(spark, sf_dir, "supplier"), read(spark, sf_dir, "nation")
    k = F.col("s_suppkey")
    classes = F.array(*[F.lit(c) for c in ("city", "town", "village", "hamlet", "peak", "locality", "other")])
    prefix = F.when(k % 9 == 0, "Carrefour de ").when(k % 9 == 1, "Croix de ").otherwise("")
    pops = F.array(*[F.lit(p) for p in ("1 234", "1234 (2019)", "", "499", "500", "10000", "none")])
    nodes = s.select(
        F.concat(prefix, F.col("s_name")).alias("name"),
        F.get(classes, (k % 7).cast("int")).alias("place"),
        F.when(k % 5 != 0, F.get(pops, (k % 7).cast("int"))).alias("population"),
        (F.lit(48.2) + (k * 37 % 300) / F.lit(1000.0)).alias("lat"),
        (F.lit(2.4) + (k * 53 % 400) / F.lit(1000.0)).alias("lon"),
    )
    m = F.col("n_nationkey")
    return nodes.unionByName(
        n.select(
            F.initcap("n_name").alias("name"),
            F.lit("village").alias("place"),
            (m * 700).cast("string").alias("population"),
            (F.lit(48.25) + m / F.lit(100.0)).alias("lat"),
            (F.lit(2.45) + m / F.lit(100.0)).alias("lon"),
        )
    )


def polygons(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A rectangle and a triangle for each nation, in pixel coordinates; a later one covers an earlier one."""
    n, k = read(spark, sf_dir, "nation"), F.col("n_nationkey")
    d = lambda c: c.cast("double")
    x, y = d(k * 5 % 43) + 0.25, d(k * 11 % 41) + 0.75
    point = lambda a, b: F.struct(a.alias("x"), b.alias("y"))
    box = F.array(point(x, y), point(x + 6, y), point(x + 6, y + 4), point(x, y + 4))
    tri = F.array(point(x + 3, y + 2), point(x + 11, y + 3), point(x + 5, y + 9))
    shapes = n.select(k.alias("k"), F.posexplode(F.array(box, tri)).alias("part", "ring"))
    return shapes.select((F.col("k") * 2 + F.col("part")).cast("int").alias("seq"), (F.col("k") % 5).cast("int").alias("code"), "ring")


def swaths(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Geographic fields of ten dates: y, x, date, value (with gaps), for baselines and anomalies.

    Bands of 40 vectors go to the dates in turn, so that every vector is a row of some field and fields grow with the table.
    """
    band = F.floor(F.col("y") / 40)
    gap = F.pmod(F.col("y") * 7 + F.col("x") * 3, F.lit(11)) == 0
    return dense(spark, sf_dir).select(
        (band % 10).cast("int").alias("day"),
        (F.floor(band / 10) * 40 + F.col("y") % 40).alias("y"),
        "x",
        F.when(~gap, F.col("v")).alias("v"),
        "label",
    )


def any_of(*conditions: Column) -> Column:
    return reduce(lambda a, b: a | b, conditions)
