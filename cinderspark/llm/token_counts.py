"""Operator 2: token counts of whole documents by a two-tier lookup, map-side only.

Tier one is a table of the lengths (in tokens) of frequent pre-tokens, fitted on
a bounded sample of documents and broadcast; tier two is the cache of each
Python worker, where a pre-token that the table lacks is encoded once.  No
pre-token is shuffled but the table's own candidates: each task of the fit
hands on its CANDIDATES most frequent ones at most.  The table only saves work:
counts are exact whatever it holds.

Null text counts as empty (0 tokens).  Repeated rows give repeated rows, rows
that share an id are counted each, an empty table gives no rows, and other
columns are ignored.  Pre-tokens that are equally frequent enter the table in
order of their spelling.  Pieces and pre-tokens over KEPT_CHARS are counted
where they stand and kept nowhere.  Ids are integers.
"""

from __future__ import annotations

import uuid
from collections import Counter
from collections.abc import Iterator

import pyarrow as pa
from pyspark import Broadcast
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .arrow_maps import map_texts, slices
from .encoder import KEPT_CHARS, Encoder, Generations, encoder
from .worker import kept

#: Documents the table is fitted on, about.
SAMPLE_DOCS = 4000
#: Pre-tokens that a task of the fit hands on, and that the table holds, at most.
CANDIDATES = 4096
TABLE_ENTRIES = 32_768
#: Longest pre-token in the table, so the broadcast stays under 4 MB.
TABLE_CHARS = 32


def frequent_pretokens(docs: DataFrame, vocab_path: str, id_col: str, text_col: str) -> dict[str, int]:
    """The broadcast tier: at most TABLE_ENTRIES pre-tokens with their token counts."""
    every = max(1, -(-docs.count() // SAMPLE_DOCS))
    sample = docs.where(F.pmod(F.xxhash64(id_col), F.lit(every)) == 0).select(F.col(text_col).alias("_text"))

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        enc, seen = encoder(vocab_path), Counter()
        for batch in batches:
            for part in slices(batch, "_text"):
                for text in part.column(0).to_pylist():
                    seen.update(p for p in enc.cut(text or "") if len(p) <= TABLE_CHARS)
                if len(seen) > 64 * CANDIDATES:
                    seen = Counter(dict(seen.most_common(16 * CANDIDATES)))
        top = seen.most_common(CANDIDATES)
        yield pa.RecordBatch.from_arrays([pa.array([p for p, _ in top], pa.string()), pa.array([n for _, n in top], pa.int64())], names=["p", "n"])

    merged = sample.mapInArrow(count, "p string, n long").groupBy("p").agg(F.sum("n").alias("n"))
    words = [r.p for r in merged.orderBy(F.desc("n"), "p").limit(TABLE_ENTRIES).collect()]
    ids = encoder(vocab_path).bpe.encode_words([w.encode() for w in words])
    return {w: len(i) // 4 for w, i in zip(words, ids)}


class LengthCounter:
    """Token counts of texts: the table first, then the worker's cache."""

    def __init__(self, vocab_path: str, table: dict[str, int]):
        self.enc = Encoder(vocab_path)
        self.table = table
        self.pieces, self.misses = Generations(), Generations()
        if self.enc.lowered:  # a lower-case word by itself is its own pre-token
            self.pieces.young.update(table)

    def count(self, texts: list[str]) -> list[int]:
        self.misses.age()
        self.pieces.age()
        known = self.pieces.young
        plans, missed, loose = [], [], []
        for text in texts:
            pieces = self.enc._plain(text)
            if pieces is None:
                head = self.enc._long(text)
            else:
                head = [] if self.enc.lowered else self.enc.cut(pieces.pop(0))
                values = list(map(known.get, pieces))
                if None in values:
                    missed += [p for p, v in zip(pieces, values) if v is None]
                else:
                    pieces = sum(values)
            loose += [p for p in head if type(p) is str]
            plans.append((pieces, head))
        new = self.pieces.recall(dict.fromkeys(missed))
        cuts = list(map(self.enc.cut_piece, new))
        length = self._lengths([p for c in cuts for p in c] + loose)
        long: dict[str, int] = {}
        for p, c in zip(new, cuts):
            (known if len(p) <= KEPT_CHARS else long)[p] = sum(map(length.__getitem__, c))
        of = (lambda p: known[p] if p in known else long[p]) if long else known.__getitem__
        return [
            sum(1 if type(h) is int else length[h] for h in head)
            + (0 if pieces is None else pieces if type(pieces) is int else sum(map(of, pieces)))
            for pieces, head in plans
        ]

    def _lengths(self, pretokens: list[str]) -> dict[str, int]:
        out, cache = {}, self.misses.young
        unknown = []
        for p in dict.fromkeys(pretokens):
            v = self.table.get(p)
            if v is None:
                v = cache.get(p)
            if v is None:
                unknown.append(p)
            else:
                out[p] = v
        new = self.misses.recall(unknown)
        if len(new) < len(unknown):
            out.update((p, cache[p]) for p in unknown if p in cache)
        fresh = {p: len(ids) // 4 for p, ids in zip(new, self.enc.bpe.encode_words([p.encode() for p in new]))}
        cache.update((p, n) for p, n in fresh.items() if len(p) <= KEPT_CHARS)
        out.update(fresh)
        return out


def counter(vocab_path: str, fitted: str, spread: Broadcast) -> LengthCounter:
    """The worker's counter for a fitted table."""
    return kept(("counter", vocab_path, fitted), lambda: LengthCounter(vocab_path, spread.value))


def count_tokens(
    docs: DataFrame, vocab_path: str, limit: int = 2048, id_col: str = "doc_id", text_col: str = "text"
) -> DataFrame:
    """``id_col``, ``n_bytes`` (UTF-8), ``n_tokens``, ``over_limit`` (n_tokens > limit)."""
    spread = docs.sparkSession.sparkContext.broadcast(frequent_pretokens(docs, vocab_path, id_col, text_col))
    fitted = uuid.uuid4().hex
    key = docs.select(
        F.col(id_col).cast("long").alias("doc_id"),
        F.coalesce(F.octet_length(text_col), F.lit(0)).cast("long").alias("n_bytes"),
        F.col(text_col).alias("_text"),
    )

    def work(batch: pa.RecordBatch, texts: list[str]) -> dict:
        counts = pa.array(counter(vocab_path, fitted, spread).count(texts), pa.int64())
        return {"doc_id": batch.column("doc_id"), "n_bytes": batch.column("n_bytes"), "n_tokens": counts}

    counted = map_texts(key, "_text", "doc_id long, n_bytes long, n_tokens long", work)
    return counted.withColumn("over_limit", F.col("n_tokens") > limit).withColumnRenamed("doc_id", id_col)
