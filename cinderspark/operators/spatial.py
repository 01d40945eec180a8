"""Polygons and lines to cells."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def inside(ring: Column, x: Column, y: Column) -> Column:
    """Whether a point is inside a ring, by the parity of crossings to its right."""
    n = F.size(ring)

    def crossing(k: Column) -> Column:
        a, b = F.get(ring, k), F.get(ring, F.pmod(k + 1, n))
        spans = (a["y"] > y) != (b["y"] > y)
        at = (b["x"] - a["x"]) * (y - a["y"]) / F.nullif(b["y"] - a["y"], F.lit(0.0)) + a["x"]
        return (spans & (x < at)).cast("int")

    places = F.sequence(F.lit(0), n - 1)
    return F.aggregate(places, F.lit(0), lambda s, k: s + F.coalesce(crossing(k), F.lit(0))) % 2 == 1


def rasterise(polygons: DataFrame, height: int, width: int) -> DataFrame:
    """(y, x, code, seq): cells whose centre is in a polygon; of several the last polygon counts.

    A polygon meets only the cells of its own bounding box, so the work follows
    the polygons' area; empty rings meet none.
    """
    xs, ys = F.transform("ring", lambda p: p["x"]), F.transform("ring", lambda p: p["y"])
    low = lambda c: F.greatest(F.floor(F.array_min(c)).cast("long"), F.lit(0))
    high = lambda c, n: F.least(F.ceil(F.array_max(c)).cast("long"), F.lit(n - 1))
    boxed = polygons.where("size(ring) >= 3").select("seq", "code", "ring", low(xs).alias("x0"), high(xs, width).alias("x1"), low(ys).alias("y0"), high(ys, height).alias("y1"))
    boxed = boxed.where("x0 <= x1 AND y0 <= y1")
    cells = boxed.withColumn("y", F.explode(F.sequence("y0", "y1"))).withColumn("x", F.explode(F.sequence("x0", "x1")))
    hit = cells.where(inside(F.col("ring"), F.col("x") + 0.5, F.col("y") + 0.5))
    return hit.groupBy("y", "x").agg(F.max_by("code", "seq").alias("code"), F.max("seq").alias("seq"))


def burn_lines(lines: DataFrame, height: int, width: int) -> DataFrame:
    """(y, x): every cell that a segment (x0, y0, x1, y1) touches.

    A segment is cut where it crosses grid lines; the middle of each piece is
    inside one cell.
    """
    dx, dy = F.col("x1") - F.col("x0"), F.col("y1") - F.col("y0")

    def cuts(a: str, b: str, d: Column) -> Column:
        first, last = F.floor(F.least(a, b)).cast("long") + 1, F.ceil(F.greatest(a, b)).cast("long") - 1
        return F.when(first <= last, F.transform(F.sequence(first, last), lambda k: (k - F.col(a)) / d)).otherwise(F.array().cast("array<double>"))

    ts = F.array_sort(F.array_distinct(F.concat(F.array(F.lit(0.0), F.lit(1.0)), cuts("x0", "x1", dx), cuts("y0", "y1", dy))))
    pieces = lines.withColumn("t", ts).withColumn("k", F.explode(F.sequence(F.lit(0), F.size("t") - 2)))
    mid = (F.get("t", F.col("k")) + F.get("t", F.col("k") + 1)) / 2
    cells = pieces.select(
        F.floor(F.col("y0") + mid * dy).cast("long").alias("y"), F.floor(F.col("x0") + mid * dx).cast("long").alias("x")
    )
    return cells.where(f"y >= 0 AND y < {height} AND x >= 0 AND x < {width}").distinct()
