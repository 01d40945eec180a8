"""Reading one grid on another: bilinear for values, nearest for codes."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def bilinear(targets: DataFrame, grid: DataFrame, value: str, keys: list[str]) -> DataFrame:
    """Values of ``grid`` (y, x, value) at the fractional places (row_f, col_f) of ``targets``, cell centres at
    whole places plus a half.  Missing neighbours are left out and the weights of the others made up to one:
    each target meets its four neighbours by an equi-join."""
    at = targets.select(*keys, (F.col("row_f") - 0.5).alias("r"), (F.col("col_f") - 0.5).alias("c"))
    corners = F.array(*[F.struct(F.lit(a).alias("a"), F.lit(b).alias("b")) for a in (0, 1) for b in (0, 1)])
    near = at.withColumn("k", F.explode(corners)).withColumns(
        {"y": (F.floor("r") + F.col("k.a")).cast("long"), "x": (F.floor("c") + F.col("k.b")).cast("long")}
    )
    near = near.withColumn("w", (1 - F.abs(F.col("r") - F.col("y"))) * (1 - F.abs(F.col("c") - F.col("x"))))
    met = near.join(grid.where(F.col(value).isNotNull()).select("y", "x", value), ["y", "x"]).where("w > 0")
    return met.groupBy(*keys).agg((F.sum(F.col("w") * F.col(value)) / F.sum("w")).alias(value))


def nearest(targets: DataFrame, grid: DataFrame, value: str, keys: list[str]) -> DataFrame:
    """The code of the cell that holds each place."""
    at = targets.select(*keys, F.floor("row_f").cast("long").alias("y"), F.floor("col_f").cast("long").alias("x"))
    return at.join(grid.select("y", "x", value), ["y", "x"]).select(*keys, value)
