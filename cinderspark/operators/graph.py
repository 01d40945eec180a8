"""Connected components of an edge table, by alternating stars.

Each round joins every node's larger neighbours to its least one (large star),
then all of a node's smaller neighbours to their least (small star); rounds
repeat until the edges stay the same, in a number that grows with the logarithm
of the longest path.  Edges only ever meet by node, as pre-aggregated minima and
equi-joins whose skew adaptive execution splits; each round's edges are written
to the shared folder.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..scratch import delete_path, scratch_path


def _star(edges: DataFrame, large: bool) -> DataFrame:
    """edges (u, v), u > v.  One star operation; the result has u > v again."""
    around = edges.select("u", "v")
    if large:
        around = around.unionByName(edges.select(F.col("v").alias("u"), F.col("u").alias("v")))
    least = around.groupBy("u").agg(F.min("v").alias("m"))
    met = around.join(least.select("u", F.least("m", "u").alias("m")), "u")
    if large:
        moved = met.where("v > u").select(F.col("v").alias("u"), F.col("m").alias("v"))
        own = least.where("m < u").select("u", F.col("m").alias("v"))
        return moved.unionByName(own).where("u > v").distinct()
    moved = met.where("v > m").select(F.col("v").alias("u"), F.col("m").alias("v"))
    return moved.unionByName(least.select("u", F.col("m").alias("v"))).distinct()


def connected_components(edges: DataFrame, a: str, b: str, label: str = "components") -> DataFrame:
    """(node, root) for every node of an edge between two nodes, root being the least node reachable."""
    spark = edges.sparkSession
    state = edges.select(F.greatest(a, b).alias("u"), F.least(a, b).alias("v")).where("u > v").distinct()
    path, before = None, None
    while True:
        new = scratch_path(spark, label)
        state.write.parquet(new)
        current = spark.read.schema("u long, v long").parquet(new)
        if path:
            delete_path(spark, path)
        path = new
        now = current.agg(F.count(F.lit(1)), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)"))).first()
        if now == before or now[0] == 0:
            break
        before = now
        state = _star(_star(current, large=True), large=False)
    return current.select(F.col("u").alias("node"), F.col("v").alias("root")).unionByName(
        current.select(F.col("v").alias("node"), F.col("v").alias("root")).distinct()
    )
