"""Operator 6: token ids as ORC files, in ascending document order.

Documents are dealt into ranges of (id, hash of the text), as many as FILE_BYTES
of text make, sorted, encoded, and written one file a range: row by row the id,
the number of ids before it in its range, the count and the ids with the end id
appended, in run-length encoded integer columns with row indexes, and Bloom
filters on the document id.  Ranges are numbered in the order of ids, and files
carry the number, so a range's place in the whole stream is the sum of the totals
before it, even if the writer is told to cut ranges into several files; these totals
are written beside the files, one row a range, as the last step.  Readers
split files by stripe, and a filter on document ids skips files, stripes and row
groups by their statistics and Bloom filters.

A null text is empty: it has the end id only.  Null document ids come first.
Rows that share an id stand in the order of a 64-bit hash of their texts, then of
the texts; rows that share both are written as often as they come, and an id of
very many rows goes to as many ranges as it fills.  An empty table gives an empty
folder of one file.  Ids are integers; other columns are ignored.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator, Sequence

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .arrow_maps import bounded_batches, slices
from .encoder import blocks, encoder
from .runtime import scratch_path

#: Text in a file, about, when there are enough files to keep all cores busy; and at least.
FILE_BYTES, LEAST_BYTES = 128 << 20, 4 << 20
#: Rows of one id and text are dealt over so many keys, so that ranges can cut between them.
SPREAD = 1024
#: Folder of the ranges' totals; readers of the files pass over a name that starts so.
TOTALS = "_totals"
SCHEMA = "doc_id long, before long, n_tokens long, ids array<int>"


def write_token_files(
    docs: DataFrame, path: str, vocab_path: str, end_id: int = 2, id_col: str = "doc_id", text_col: str = "text"
) -> None:
    text = F.coalesce(F.col(text_col), F.lit(""))
    spread = F.pmod(F.monotonically_increasing_id(), F.lit(SPREAD))
    key = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).alias("_text"), F.xxhash64(text).alias("_hash"), spread.alias("_spread"))
    size = docs.agg(F.sum(F.octet_length(text))).first()[0] or 0
    cores = docs.sparkSession.sparkContext.defaultParallelism
    files = max(-(-size // FILE_BYTES), min(-(-size // LEAST_BYTES), 2 * cores), 1)
    end = int(end_id).to_bytes(4, "little")

    def encode(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        enc, before = encoder(vocab_path), 0
        for batch in batches:
            for part in slices(batch, "_text"):
                texts = [t or "" for t in part.column("_text").to_pylist()]
                ids = [x + end for s, e in blocks(texts) for x in enc.encode(texts[s:e])]
                counts = np.array([len(x) // 4 for x in ids], np.int64)
                ends = np.cumsum(counts)
                lists = pa.ListArray.from_arrays(
                    pa.array(np.concatenate([[0], ends]).astype(np.int32)), pa.array(np.frombuffer(b"".join(ids), "<i4"))
                )
                yield pa.RecordBatch.from_arrays(
                    [part.column("doc_id"), pa.array(before + ends - counts), pa.array(counts), lists],
                    names=["doc_id", "before", "n_tokens", "ids"],
                )
                before += int(ends[-1])

    (
        bounded_batches(key.repartitionByRange(files, "doc_id", "_hash", "_spread").sortWithinPartitions("doc_id", "_hash", "_text"))
        .select("doc_id", "_text")
        .mapInArrow(encode, SCHEMA)
        .write.option("orc.bloom.filter.columns", "doc_id")
        .option("orc.create.index", "true")
        .option("orc.row.index.stride", "1000")
        .option("orc.stripe.size", str(16 << 20))
        .option("compression", "zstd")
        .orc(path)
    )
    spark = docs.sparkSession
    written = spark.read.schema(SCHEMA).orc(path).select(_range().alias("_range"), (F.col("before") + F.col("n_tokens")).alias("_end"))
    written.groupBy("_range").agg(F.max("_end").alias("_size")).coalesce(1).write.parquet(f"{path}/{TOTALS}")


def read_token_files(spark: SparkSession, path: str, doc_ids: Sequence[int] | None = None) -> DataFrame:
    """The rows as written, with ``start``: the number of ids of all documents before.

    ``doc_ids`` restricts the read; the restriction reaches the files' indexes.
    """
    rows = spark.read.schema(SCHEMA).orc(path).withColumn("_range", _range())
    if doc_ids is not None:
        rows = rows.where(F.col("doc_id").isin(list(doc_ids)))
    return _placed(rows, spark, path)


def _range() -> Column:
    """The number of the range that a file holds, or holds a part of."""
    return F.regexp_extract(F.col("_metadata.file_name"), r"^part-(\d+)", 1).cast("long")


def _placed(rows: DataFrame, spark: SparkSession, path: str) -> DataFrame:
    """Add each range's place: one row a range is all that is sorted and joined."""
    sizes = spark.read.schema("_range long, _size long").parquet(f"{path}/{TOTALS}")
    earlier = Window.orderBy("_range").rowsBetween(Window.unboundedPreceding, -1)
    base = sizes.select("_range", F.coalesce(F.sum("_size").over(earlier), F.lit(0)).alias("_base"))
    return rows.join(base, "_range").withColumn("start", F.col("_base") + F.col("before")).drop("_range", "_base", "before")


def token_checks(spark: SparkSession, path: str) -> DataFrame:
    """``doc_id``, ``start``, ``n_tokens``, ``ids_crc32`` of every document, from the files."""
    rows = spark.read.schema(SCHEMA).orc(path).withColumn("_range", _range())

    def crc(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            ids = batch.column("ids")
            values = np.ascontiguousarray(ids.values.to_numpy(), "<i4").view(np.uint8)
            at = (ids.offsets.to_numpy().astype(np.int64) * 4).tolist()
            sums = [zlib.crc32(values[s:e]) for s, e in zip(at, at[1:])]
            kept = [batch.column(c) for c in ("_range", "doc_id", "before", "n_tokens")]
            yield pa.RecordBatch.from_arrays(
                [*kept, pa.array(sums, pa.int64())], names=["_range", "doc_id", "before", "n_tokens", "ids_crc32"]
            )

    light = bounded_batches(rows).mapInArrow(crc, "_range long, doc_id long, before long, n_tokens long, ids_crc32 long")
    return _placed(light, spark, path).select("doc_id", "start", "n_tokens", "ids_crc32")


def write_and_check(docs: DataFrame, vocab_path: str, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Write the files to the shared folder and read the checks back."""
    path = scratch_path(docs.sparkSession, "op6-tokens")
    write_token_files(docs, path, vocab_path, id_col=id_col, text_col=text_col)
    return token_checks(docs.sparkSession, path)
