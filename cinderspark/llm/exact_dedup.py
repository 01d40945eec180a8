"""Operator 10: exact de-duplication by skew-safe combining, in DataFrame operations.

Texts are equal when identical after white space of ``[\\x20\\x09-\\x0D]`` is
deleted.  Equal texts are combined in three steps that each compare whole
contents, the digest only deciding where rows meet:

1. locally: the partial aggregation of each map task leaves one row per content;
2. salted: rows meet by (digest, content, salt), where only digests that hold
   over 1/HOT_KEYS of all rows are salted;
3. globally: the salt winners of those few digests meet by (digest, content);
   what wasn't salted is a whole group after step 2.

Where a digest turns out to stand for two contents, its documents are told apart
by content once more, so a collision never merges groups.

The row with most code points in its original text stays, then the smallest id.
A null text is empty, and all empty texts are equal.  A null id loses to any
other.  Rows that repeat id and text are rows of one group and share their
``kept``; ``deduplicate`` returns one of them.  An empty table gives no rows.
Ids are integers of any width up to 64 bits.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .runtime import SALTS, hot_keys, one_row_each, salted_join, staged

#: What normalisation deletes.
SPACES = " \t\n\x0b\x0c\r"
_ID_SPAN = "18446744073709551616"  # 2^64
_ID_TOP = "9223372036854775807"


def normalised(text: Column) -> Column:
    return F.translate(F.coalesce(text, F.lit("")), SPACES, "")


def sha256_hex(text: Column) -> Column:
    return F.sha2(text, 256)


def _preference(n_chars: Column, doc_id: Column) -> Column:
    """One number that is largest for the longest text, then the smallest id: a fixed-width
    maximum stays in the hash aggregate, where that of a struct would sort whole texts."""
    wide = lambda c: c.cast("decimal(38,0)")
    by_id = F.coalesce(wide(F.lit(_ID_TOP)) - wide(doc_id), wide(F.lit(-1)))
    return (wide(n_chars) * wide(F.lit(_ID_SPAN)) + by_id + wide(F.lit(1))).cast("decimal(38,0)")


def _preferred_id(preference: Column) -> Column:
    wide = lambda c: c.cast("decimal(38,0)")
    rest = F.pmod(preference, wide(F.lit(_ID_SPAN)))
    return F.when(rest > 0, (wide(F.lit(_ID_TOP)) + wide(F.lit(1)) - rest).cast("long"))


def exact_groups(
    docs: DataFrame,
    id_col: str = "doc_id",
    text_col: str = "text",
    digest: Callable[[Column], Column] = sha256_hex,
) -> DataFrame:
    """One row per document: ``id_col``, ``keep_id``, ``group_size``, ``kept``, ``text_sha256``.

    ``digest`` deals rows out and may collide: contents decide.
    """
    plain = normalised(F.col(text_col))
    rows = docs.select(
        F.col(id_col).cast("long").alias("doc_id"),
        F.length(F.coalesce(F.col(text_col), F.lit(""))).alias("n_chars"),
        plain.alias("content"),
        digest(plain).alias("digest"),
    )
    digests = staged(rows.select("doc_id", "digest", sha256_hex(F.col("content")).alias("text_sha256")), "op10-digests")
    hot = staged(hot_keys(digests, "digest"), "op10-hot")

    flagged = rows.join(F.broadcast(hot.withColumn("hot", F.lit(True))), "digest", "left").withColumn(
        "hot", F.coalesce("hot", F.lit(False))
    )
    salt = F.when(F.col("hot"), F.pmod(F.spark_partition_id(), F.lit(SALTS))).otherwise(F.lit(0))
    met = (
        flagged.withColumn("salt", salt)
        .groupBy("digest", "content", "hot", "salt")
        .agg(F.max(_preference(F.col("n_chars"), F.col("doc_id"))).alias("best"), F.count(F.lit(1)).alias("n"))
    )
    # a cold row is a whole group already and its content is needed no more; a hot one is the winner of a salt
    won = staged(met.select("digest", F.when(F.col("hot"), F.col("content")).alias("content"), "hot", "best", "n"), "op10-winners")
    cold = won.where(~F.col("hot")).select("digest", "best", F.col("n").alias("group_size"))
    merged = won.where("hot").groupBy("digest", "content").agg(F.max("best").alias("best"), F.sum("n").alias("group_size"))
    groups = cold.unionByName(merged.drop("content")).select("digest", _preferred_id(F.col("best")).alias("keep_id"), "group_size")
    out = salted_join(digests, groups, "digest", hot)
    clashing = groups.groupBy("digest").count().where("count > 1").select("digest")
    if clashing.limit(1).count():
        # distinct contents under one digest: these few documents are told apart by content itself
        clear = out.join(clashing, "digest", "left_anti")
        doubtful = rows.join(clashing, "digest", "left_semi")
        best = doubtful.groupBy("digest", "content").agg(
            F.max(_preference(F.col("n_chars"), F.col("doc_id"))).alias("best"), F.count(F.lit(1)).alias("group_size")
        )
        settled = doubtful.join(best, ["digest", "content"]).select(
            "doc_id",
            sha256_hex(F.col("content")).alias("text_sha256"),
            _preferred_id(F.col("best")).alias("keep_id"),
            "group_size",
        )
        out = clear.select("doc_id", "text_sha256", "keep_id", "group_size").unionByName(settled)
    return out.select(
        F.col("doc_id").alias(id_col),
        "keep_id",
        "group_size",
        F.col("doc_id").eqNullSafe(F.col("keep_id")).alias("kept"),
        "text_sha256",
    )


def deduplicate(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """The rows that stay, with all their columns; of rows that repeat id and text, one: that of the longest original
    text, then of the largest hash of all its columns.

    Rows are matched by id and digest, so ids that are null or given twice do no harm.
    """
    mark = lambda c: F.coalesce(c.cast("string"), F.lit(""))
    key = ["__op10_id", "__op10_digest"]
    keepers = exact_groups(docs, id_col, text_col).where("kept")
    keepers = keepers.groupBy(mark(F.col(id_col)).alias(key[0]), F.col("text_sha256").alias(key[1])).agg(F.count(F.lit(1)).alias("n"))
    keyed = docs.withColumns({key[0]: mark(F.col(id_col).cast("long")), key[1]: sha256_hex(normalised(F.col(text_col)))})
    return one_row_each(docs, keyed, staged(keepers, "op10-keepers"), key, text_col)
