"""Running a function over the Arrow batches of a DataFrame in bounded pieces."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import pyarrow as pa
from pyspark.sql import DataFrame

#: Bytes of text handed to a function at once.
SLICE_BYTES = 4_000_000
#: Bytes that Spark puts into a batch for a Python worker, about, where the session doesn't say.
BATCH_BYTES = 8_000_000
_BATCH_SETTING = "spark.sql.execution.arrow.maxBytesPerBatch"


def bounded_batches(df: DataFrame) -> DataFrame:
    """``df``, in a session whose batches have a bound in bytes: long texts would make batches of 10,000 rows large."""
    conf = df.sparkSession.conf
    if _BATCH_SETTING not in conf.getAll:
        conf.set(_BATCH_SETTING, str(BATCH_BYTES))
    return df


def slices(batch: pa.RecordBatch, text: str) -> Iterator[pa.RecordBatch]:
    """Zero-copy slices of about SLICE_BYTES of the text column, one row at least."""
    n = batch.num_rows
    if not n:
        return
    rows = max(1, int(n * SLICE_BYTES / max(1, batch.column(text).nbytes)))
    for start in range(0, n, rows):
        yield batch.slice(start, rows)


def map_texts(
    df: DataFrame, text: str, schema: str, work: Callable[[pa.RecordBatch, list[str]], dict[str, pa.Array]]
) -> DataFrame:
    """``work(batch, texts)`` gives the columns of ``schema``, in its order, for each slice; a null text comes as empty."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in slices(batch, text):
                texts = [t or "" for t in part.column(text).to_pylist()]
                made = work(part, texts)
                yield pa.RecordBatch.from_arrays(list(made.values()), names=list(made))

    return bounded_batches(df).mapInArrow(run, schema)


def keep_texts(df: DataFrame, text: str, keep: Callable[[list[str]], list[bool]]) -> DataFrame:
    """The rows whose text ``keep`` says yes to, with all their columns: the decision goes with the row, not with an id."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in slices(batch, text):
                yield part.filter(pa.array(keep([t or "" for t in part.column(text).to_pylist()]), pa.bool_()))

    return bounded_batches(df).mapInArrow(run, df.schema)
