"""Shared plumbing: table access and skew helpers."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..scratch import clear_scratch, delete_path, scratch_path, shared_dir, staged
from ..shipping import ship

__all__ = ["clear_scratch", "delete_path", "hot_keys", "one_row_each", "salted_join", "scratch_path", "shared_dir", "staged", "table"]


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """One of the input tables; any path that Spark's readers can open works."""
    ship(spark)
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


#: Fan-out of a hot key in a salted join.
SALTS = 32
#: A key is hot above this share of all rows, so there are at most as many hot keys as this says.
HOT_KEYS = 1024


def hot_keys(keyed: DataFrame, key: str) -> DataFrame:
    """Keys holding over 1/HOT_KEYS of the rows: at most HOT_KEYS rows, so safe to broadcast.

    Two rows of a key are never hot; counting is pre-aggregated map-side.
    ``keyed`` is a staged table, whose row count stands in its files' footers.
    """
    cut = max(2.0, keyed.count() / HOT_KEYS)
    return keyed.groupBy(key).agg(F.count(F.lit(1)).alias("_n")).where(F.col("_n") > cut).select(key)


def salted_join(rows: DataFrame, lookup: DataFrame, key: str, hot: DataFrame) -> DataFrame:
    """Inner join of many ``rows`` per key with ``lookup`` (few rows per key).

    Rows of a hot key are dealt over SALTS tasks and the lookup row is repeated
    that often for hot keys only.
    """
    flags = F.broadcast(hot.select(F.col(key), F.lit(True).alias("_hot")))
    spread = F.when(F.col("_hot"), F.pmod(F.monotonically_increasing_id(), F.lit(SALTS)).cast("int"))
    left = rows.join(flags, key, "left").withColumn("_salt", F.coalesce(spread, F.lit(0))).drop("_hot")
    copies = F.when(F.col("_hot"), F.sequence(F.lit(0), F.lit(SALTS - 1))).otherwise(F.array(F.lit(0)))
    right = lookup.join(flags, key, "left").withColumn("_salt", F.explode(copies)).drop("_hot")
    return left.join(right, [key, "_salt"]).drop("_salt")


def one_row_each(docs: DataFrame, keyed: DataFrame, keepers: DataFrame, key: list[str], text_col: str) -> DataFrame:
    """One row of ``docs`` for each row of ``keepers`` (``key``, and ``n``: how many rows of ``docs`` have it), all columns kept.

    ``keyed`` is ``docs`` with the columns of ``key``.  Where a key has several rows, that of the longest text stays,
    then of the largest hash of all columns; these are combined in each map task first, so that a row given very
    often meets itself in few copies.
    """
    kept = keyed.join(keepers.where("n = 1"), key, "left_semi").select(docs.columns)
    repeated = keepers.where("n > 1")
    if repeated.limit(1).count():
        plain = [f.name for f in docs.schema.fields if "map<" not in f.dataType.simpleString()]
        order = F.struct(F.length(F.coalesce(F.col(text_col), F.lit(""))), F.xxhash64(*plain))
        best = keyed.join(repeated, key, "left_semi").groupBy(*key).agg(F.max_by(F.struct(*docs.columns), order).alias("__row"))
        kept = kept.unionByName(best.select("__row.*"))
    return kept
