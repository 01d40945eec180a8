"""Ranks over a whole table without bringing it to one task."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..scratch import staged


def global_rank(rows: DataFrame, order: list[Column | str], name: str = "place") -> DataFrame:
    """Number the rows from 1 in an order: ranges are sorted side by side and shifted by the rows before them."""
    ranged = rows.repartitionByRange(*order).sortWithinPartitions(*order)
    at = F.monotonically_increasing_id()
    numbered = ranged.select("*", F.shiftright(at, 33).alias("__part"), at.bitwiseAND(F.lit((1 << 33) - 1)).alias("__at"))
    numbered = staged(numbered, "ranked")
    sizes = numbered.groupBy("__part").agg(F.count(F.lit(1)).alias("__n"))
    before = F.sum("__n").over(Window.orderBy("__part").rowsBetween(Window.unboundedPreceding, -1))
    base = sizes.select("__part", F.coalesce(before, F.lit(0)).alias("__base"))
    return numbered.join(base, "__part").withColumn(name, F.col("__base") + F.col("__at") + 1).drop("__part", "__at", "__base")
