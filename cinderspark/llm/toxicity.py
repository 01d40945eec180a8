"""Operator 3: toxicity from the nearest labelled examples, by exact TF-IDF cosine over a block-max index.

Features are a text's words and the runs of GRAM letters in its longer words,
kept when at least LEAST_DOCS labelled examples have them and the label depends
on them (chi-square over CHI, more often toxic); a feature's weight is
(1 + ln tf) * idf, and vectors have length one.  Examples stand in blocks; for
each feature the index holds its largest weight in each block.  A query bounds
every block by its weights times those maxima and scores blocks in full, best
bound first, until no block can reach its k-th neighbour: the neighbours are
those of a full scan.  An example is no neighbour of a text that equals it, so
that a labelled document is scored by others' labels, as any document is, and
its evidence never cites itself.  Neighbours vote with the square of their cosine, a small
prior holding the share among examples without any kept feature; an isotonic
fit of the examples' own leave-one-out votes calibrates the result.

The model is fitted on at most MOST_EXAMPLES labelled ids, chosen by a hash of
the id, all of them training rows (crc32 of the id as text, modulo 5, not 0).
Of several texts of an id the one with the largest hash is its example.  Ids, languages, sources and labels are no features.  A text without a kept
feature (an empty or null one too) gets the calibrated prior; without labelled
examples every score is 0.  Of repeated labels of an id the largest counts.
Repeated rows are repeated in the result; an empty table gives no rows.  Ties
between neighbours go to the smaller id.  Ids are integers.
"""

from __future__ import annotations

import uuid
from collections import Counter
from collections.abc import Sequence
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
import xxhash
from pyspark import Broadcast
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .arrow_maps import keep_texts, map_texts
from .runtime import staged
from .worker import kept as held

#: Labelled rows the model is fitted on, at most.
MOST_EXAMPLES = 8192
#: Examples that must have a feature; chi-square that it must reach.
LEAST_DOCS, CHI = 4, 20.0
GRAM = 5
NEIGHBOURS = 40
#: Examples in a block of the index.
BLOCK = 64
#: Weight of the prior against a neighbour of cosine 1.
PRIOR_WEIGHT = 0.5
#: Words whose features a worker keeps.
KEPT_WORDS = 400_000
_OUTER = ".,;:!?\"'()[]{}<>«»“”|*_-"


def word_features(word: str) -> tuple[str, ...]:
    """Features of a lower-case word; its runs of letters take in a mark for either end."""
    core = word.strip(_OUTER)
    if not core:
        return ()
    if len(core) < GRAM:
        return (core,)
    marked = f"^{core}$"
    return (core, *{marked[i : i + GRAM] for i in range(len(marked) - GRAM + 1)})


def text_digest(text: str) -> int:
    """What tells a text from others: 64 bits, as a signed number."""
    return xxhash.xxh64_intdigest(text.encode("utf-8", "surrogatepass")) - (1 << 63)


@dataclass
class Model:
    features: dict[str, int]
    idf: np.ndarray
    ids: np.ndarray  # of the examples, in block order
    toxic: np.ndarray
    rows: np.ndarray  # CSR of their vectors
    columns: np.ndarray
    values: np.ndarray
    prior: float
    digests: np.ndarray  # of the examples' texts
    knots: np.ndarray = field(default_factory=lambda: np.array([0.0, 1.0]))
    heights: np.ndarray = field(default_factory=lambda: np.array([0.0, 1.0]))

    def vector(self, counts: dict[int, int]) -> tuple[np.ndarray, np.ndarray]:
        at = np.fromiter(counts, np.int64, len(counts))
        w = (1 + np.log(np.fromiter(counts.values(), np.float64, len(counts)))) * self.idf[at]
        return at, w / np.linalg.norm(w)

    def calibrated(self, raw: np.ndarray) -> np.ndarray:
        """Mostly the isotonic fit; a trace of the vote keeps the order within its steps."""
        return np.clip(0.98 * np.interp(raw, self.knots, self.heights) + 0.02 * raw, 0, 1)


class BlockMax:
    """The searching side of a model."""

    def __init__(self, model: Model):
        self.model = model
        n = len(model.ids)
        self.starts = np.arange(0, n, BLOCK)
        self.order = np.argsort(model.ids, kind="stable")
        size = len(model.idf)
        block_of = np.repeat(np.arange(n) // BLOCK, np.diff(model.rows))
        key = model.columns.astype(np.int64) * max(1, len(self.starts)) + block_of
        kept, seat = np.unique(key, return_inverse=True)
        self.peak = np.zeros(len(kept))
        np.maximum.at(self.peak, seat, model.values)
        self.peak_block = kept % max(1, len(self.starts))
        self.peak_rows = np.searchsorted(kept, np.arange(size + 1) * max(1, len(self.starts)))
        self.dense = np.zeros(size)
        self.words: dict[str, tuple[int, ...]] = {}
        self.same: dict[int, list[int]] = {}
        for k, d in enumerate(model.digests.tolist()):
            self.same.setdefault(d, []).append(k)

    def counts(self, text: str) -> Counter:
        """How often the text has each kept feature."""
        if len(self.words) > KEPT_WORDS:
            self.words = {}
        tokens = text.lower().split()
        found = list(map(self.words.get, tokens))
        if None in found:
            index = self.model.features
            for k, f in enumerate(found):
                if f is None:
                    w = tokens[k]
                    found[k] = f = tuple(index[x] for x in word_features(w) if x in index)
                    if len(w) <= 64:
                        self.words[w] = f
        return Counter(x for f in found if f for x in f)

    def neighbours(self, at: np.ndarray, w: np.ndarray, k: int, without: Sequence[int] = ()) -> tuple[np.ndarray, np.ndarray]:
        """(examples, cosines) of the k nearest but those ``without``, best first, smaller ids first on ties."""
        m = self.model
        spans = [(self.peak_rows[a], self.peak_rows[a + 1]) for a in at.tolist()]
        blocks = np.concatenate([self.peak_block[s:e] for s, e in spans])
        bound = np.bincount(blocks, np.concatenate([self.peak[s:e] * x for (s, e), x in zip(spans, w.tolist())]), len(self.starts))
        self.dense[at] = w
        best_i, best_s, floor = np.zeros(0, np.int64), np.zeros(0), 0.0
        ranked = np.argsort(-bound, kind="stable")
        for b in ranked.tolist():
            if bound[b] <= 0 or (len(best_i) >= k and bound[b] < floor - 1e-9):
                break
            first = self.starts[b]
            last = min(first + BLOCK, len(m.ids))
            s, e = m.rows[first], m.rows[last]
            score = np.add.reduceat(self.dense[m.columns[s:e]] * m.values[s:e], m.rows[first:last] - s)
            who = np.arange(first, last)
            some = score > max(floor - 1e-9, 0)
            for own in without:
                if first <= own < last:
                    some[own - first] = False
            best_i, best_s = np.concatenate([best_i, who[some]]), np.concatenate([best_s, score[some]])
            if len(best_i) > k:
                top = np.lexsort((m.ids[best_i], -np.round(best_s, 9)))[:k]
                best_i, best_s = best_i[top], best_s[top]
                floor = best_s[-1]
        self.dense[at] = 0
        top = np.lexsort((m.ids[best_i], -np.round(best_s, 9)))[:k]
        return best_i[top], best_s[top]

    def vote(self, near: np.ndarray, cosine: np.ndarray) -> float:
        w = cosine**2
        return float((w @ self.model.toxic[near] + PRIOR_WEIGHT * self.model.prior) / (w.sum() + PRIOR_WEIGHT))

    def score(self, text: str, k: int = NEIGHBOURS) -> tuple[float, list[tuple[int, float, int]]]:
        """(raw vote, evidence: up to three nearest examples with cosine and label)."""
        counts = self.counts(text)
        if not counts or not len(self.model.ids):
            return self.model.prior, []
        near, cosine = self.neighbours(*self.model.vector(counts), k, self.same.get(text_digest(text), ()))
        evidence = [(int(self.model.ids[i]), float(c), int(self.model.toxic[i])) for i, c in zip(near[:3], cosine[:3])]
        return self.vote(near, cosine), evidence


def isotonic(x: np.ndarray, y: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Knots and heights of the best non-decreasing fit (pool adjacent violators)."""
    xs, seat = np.unique(x, return_inverse=True)
    weight = np.bincount(seat).astype(float)
    mean = np.bincount(seat, y) / weight
    pools: list[list[float]] = []
    for k in range(len(xs)):
        pools.append([mean[k], weight[k], k, k])
        while len(pools) > 1 and pools[-2][0] >= pools[-1][0]:
            b, a = pools.pop(), pools.pop()
            w = a[1] + b[1]
            pools.append([(a[0] * a[1] + b[0] * b[1]) / w, w, a[2], b[3]])
    knots, heights = [], []
    for h, _, s, e in pools:
        knots += [xs[int(s)], xs[int(e)]] if s < e else [xs[int(s)]]
        heights += [h, h] if s < e else [h]
    return np.array(knots), np.array(heights)


def is_training(doc_id: Column) -> Column:
    return F.crc32(doc_id.cast("string")) % 5 != 0


def _examples(docs: DataFrame, labels: DataFrame, id_col: str, text_col: str, label_col: str) -> DataFrame:
    """(doc_id, toxic, digest, features, counts) of the bounded labelled sample, staged: one row for each id."""
    known = labels.where(F.col(label_col).isNotNull() & F.col(id_col).isNotNull() & is_training(F.col(id_col)))
    known = known.groupBy(F.col(id_col).cast("long").alias("doc_id")).agg(F.max(F.col(label_col).cast("int")).alias("toxic"))
    every = max(1, -(-known.count() * 10 // (MOST_EXAMPLES * 9)))
    sample = known.where(F.pmod(F.xxhash64("doc_id"), F.lit(every)) == 0).orderBy(F.xxhash64("doc_id"), "doc_id").limit(MOST_EXAMPLES)
    text = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.coalesce(F.col(text_col), F.lit("")).alias("_text"))
    met = text.join(F.broadcast(sample), "doc_id")
    chosen = met.groupBy("doc_id", "toxic").agg(F.max_by("_text", F.struct(F.xxhash64("_text"), "_text")).alias("_text"))

    def work(batch: pa.RecordBatch, texts: list[str]) -> dict:
        seen = [Counter(f for w in t.lower().split() for f in word_features(w)) for t in texts]
        return {
            "doc_id": batch.column("doc_id"),
            "toxic": batch.column("toxic"),
            "digest": pa.array([text_digest(t) for t in texts], pa.int64()),
            "features": pa.array([list(c) for c in seen], pa.list_(pa.string())),
            "counts": pa.array([list(c.values()) for c in seen], pa.list_(pa.int32())),
        }

    made = map_texts(chosen, "_text", "doc_id long, toxic int, digest long, features array<string>, counts array<int>", work)
    return staged(made, "op3-examples")


def fit(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text", label_col: str = "toxic") -> Model:
    examples = _examples(docs, labels, id_col, text_col, label_col)
    total = examples.agg(F.sum("toxic").alias("pos"), F.count(F.lit(1)).alias("n")).first()
    pos, n = float(total.pos or 0), float(total.n)
    met = examples.select("toxic", F.explode("features").alias("f")).groupBy("f").agg(
        F.sum("toxic").cast("double").alias("a"), F.count(F.lit(1)).cast("double").alias("df")
    )
    b, neg = F.col("df") - F.col("a"), n - pos
    chi = n * F.pow(F.col("a") * (neg - b) - b * (pos - F.col("a")), F.lit(2.0)) / (F.col("df") * (n - F.col("df")) * pos * neg)
    if pos and neg:
        kept = met.where((F.col("df") >= LEAST_DOCS) & (F.col("df") < n) & (F.col("a") * n > F.col("df") * pos))
        kept = kept.withColumn("chi", chi).where(F.col("chi") >= CHI).orderBy(F.desc("chi"), "f").collect()
    else:
        kept = []
    features = {r.f: k for k, r in enumerate(kept)}
    idf = np.array([np.log((n + 1) / (r.df + 1)) + 1 for r in kept])
    words = F.transform(F.arrays_zip("features", "counts"), lambda p: p)
    pairs = F.filter(words, lambda p: p["features"].isin(list(features))) if features else F.array()
    rows = examples.select("doc_id", "toxic", "digest", pairs.alias("p")).collect()
    return _model(features, idf, [(r.doc_id, r.toxic, {features[x.features]: x.counts for x in r.p}, r.digest) for r in rows])


def _model(features: dict[str, int], idf: np.ndarray, rows: list[tuple[int, int, dict[int, int], int]]) -> Model:
    bare = [y for _, y, c, _ in rows if not c]
    prior = (sum(bare) + 0.5 * bool(rows) * (sum(r[1] for r in rows) / max(1, len(rows)))) / (len(bare) + 0.5)
    # like examples share blocks, which keeps the blocks' maxima telling
    rows = sorted((r for r in rows if r[2]), key=lambda r: (r[1], min(r[2]), len(r[2]), r[0]))
    empty = np.zeros(0)
    model = Model(features, idf, np.array([r[0] for r in rows], np.int64), np.array([r[1] for r in rows], float), np.zeros(1, np.int64), empty.astype(np.int64), empty, prior, np.array([r[3] for r in rows], np.int64))
    if rows:
        parts = [model.vector(r[2]) for r in rows]
        model.rows = np.concatenate([[0], np.cumsum([len(a) for a, _ in parts])])
        model.columns = np.concatenate([a for a, _ in parts])
        model.values = np.concatenate([w for _, w in parts])
        index = BlockMax(model)
        raw = np.array([index.vote(*index.neighbours(a, w, NEIGHBOURS, index.same[d])) for (a, w), d in zip(parts, model.digests.tolist())])
        raw = np.concatenate([raw, np.full(len(bare), prior)])
        model.knots, model.heights = isotonic(raw, np.concatenate([model.toxic, bare]))
    return model


def index_of(name: str, spread: Broadcast) -> BlockMax:
    """The worker's index of a broadcast model."""
    return held(("toxicity", name), lambda: BlockMax(spread.value))


def score_documents(
    docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text", label_col: str = "toxic"
) -> DataFrame:
    """``id_col``, ``held_out``, ``score`` (0 to 1), ``predicted`` (1 if score >= 0.5), ``evidence``."""
    spread = docs.sparkSession.sparkContext.broadcast(fit(docs, labels, id_col, text_col, label_col))
    name = uuid.uuid4().hex
    key = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).alias("_text"))
    kind = pa.list_(pa.struct([("doc_id", pa.int64()), ("cosine", pa.float64()), ("toxic", pa.int32())]))

    def work(batch: pa.RecordBatch, texts: list[str]) -> dict:
        index = index_of(name, spread)
        scored = [index.score(t) for t in texts]
        score = index.model.calibrated(np.array([s for s, _ in scored]))
        evidence = [[{"doc_id": i, "cosine": c, "toxic": y} for i, c, y in e] for _, e in scored]
        return {"doc_id": batch.column("doc_id"), "score": pa.array(score), "evidence": pa.array(evidence, kind)}

    schema = "doc_id long, score double, evidence array<struct<doc_id:long,cosine:double,toxic:int>>"
    return map_texts(key, "_text", schema, work).select(
        F.col("doc_id").alias(id_col),
        F.coalesce(~is_training(F.col("doc_id")), F.lit(False)).alias("held_out"),
        "score",
        (F.col("score") >= 0.5).cast("int").alias("predicted"),
        "evidence",
    )


def reject_toxic(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """The rows that aren't predicted toxic, with all their columns; ids may be null or given twice."""
    spread = docs.sparkSession.sparkContext.broadcast(fit(docs, labels, id_col, text_col))
    name = uuid.uuid4().hex

    def keep(texts: list[str]) -> list[bool]:
        index = index_of(name, spread)
        return (index.model.calibrated(np.array([index.score(t)[0] for t in texts])) < 0.5).tolist()

    return keep_texts(docs, text_col, keep)
