"""Operator 8: near-duplicates by 64-bit SimHash and vantage-point trees.

A text is lower-cased (A-Z only) and cut into words at ``[\\x20\\x09-\\x0D]``;
its shingles are all runs of ``words`` words, repeats included (a shorter text
is one shingle).  A fingerprint bit is 1 if set in over half the shingles'
XXH64 (seed 42).  Fingerprints that differ in at most ``bits`` bits are linked.

Distinct fingerprints are dealt over the leaves of a routing tree, fitted on a
bounded sample; each also visits the later leaves that its ball of ``bits``
overlaps, so every pair within reach meets in exactly one leaf.  A leaf's visitors
are dealt over as many pieces as PIECE_POINTS make, each with all the leaf's own
points, so that no task's share grows with the input.  There a local tree finds
the links and hands on at most one edge for each point, so no group of copies is
listed as pairs.  Components come from an alternating star over those edges.  Neither fingerprints nor components reach the driver but for the
sample.

A null, empty or blank text has fingerprint 0 and is linked like any other.
Repeated rows are repeated in the result.  A null id takes no part in a
component's least id; a component of null ids only has a null id.  An empty
table gives no rows.  Ids are integers.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..operators.graph import connected_components
from .arrow_maps import map_texts
from .runtime import hot_keys, one_row_each, salted_join, staged
from .vptree import Routing, fit_routing, link

#: Fingerprints the routing tree is fitted on, at most.
SAMPLE = 16_384
#: Routing leaves: at least so many, and one for each so many distinct fingerprints.
LEAST_DEPTH, LEAF_POINTS = 6, 131_072
#: Visitors that a task takes with a leaf's points, about.
PIECE_POINTS = 524_288
#: Shingle hashes whose bits are summed at once.
CHUNK = 65_536


def fingerprint(text: str, words: int = 4) -> int:
    tokens = text.encode("utf-8", "surrogatepass").lower().split()
    if not tokens:
        return 0
    joined = b" ".join(tokens)
    if len(tokens) <= words:
        hashes = np.array([xxhash.xxh64_intdigest(joined, 42)], np.uint64)
    else:
        ends = np.cumsum(np.fromiter(map(len, tokens), np.int64, len(tokens)) + 1)
        starts = np.concatenate([[0], ends[:-words]]).tolist()
        digest = xxhash.xxh64_intdigest
        hashes = np.array([digest(joined[s:e], 42) for s, e in zip(starts, (ends[words - 1 :] - 1).tolist())], np.uint64)
    ones = np.zeros(64, np.int64)
    for s in range(0, len(hashes), CHUNK):
        octets = hashes[s : s + CHUNK].view(np.uint8).reshape(-1, 8)
        ones += np.unpackbits(octets, axis=1, bitorder="little").sum(0, dtype=np.int64)
    return int.from_bytes(np.packbits(2 * ones > len(hashes), bitorder="little").tobytes(), "little")


def fingerprints(docs: DataFrame, words: int = 4, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(doc_id, fp, digest, n_chars): fp is the fingerprint's 64 bits as a signed long, digest tells texts of one id apart."""
    text = F.coalesce(F.col(text_col), F.lit(""))
    key = docs.select(
        F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).alias("_text"), F.xxhash64(text).alias("digest"), F.length(text).alias("n_chars")
    )

    def work(batch: pa.RecordBatch, texts: list[str]) -> dict:
        fps = np.array([fingerprint(t, words) for t in texts], np.uint64).view(np.int64)
        return {"doc_id": batch.column("doc_id"), "fp": pa.array(fps, pa.int64()), "digest": batch.column("digest"), "n_chars": batch.column("n_chars")}

    return map_texts(key, "_text", "doc_id long, fp long, digest long, n_chars int", work)


def _routing(points: DataFrame, bits: int) -> tuple[Routing, np.ndarray]:
    """The routing tree, and the pieces that each leaf's visitors are dealt over, as the sample's visits tell."""
    n = points.count()
    depth = max(LEAST_DEPTH, int(np.ceil(np.log2(max(1, n) / LEAF_POINTS))))
    every = max(1, -(-n // (SAMPLE // 2)))
    sample = points.where(F.pmod(F.xxhash64("fp"), F.lit(every)) == 0).limit(SAMPLE).toPandas()["fp"]
    known = sample.to_numpy(np.int64).view(np.uint64)
    tree = fit_routing(known, depth)
    visits = np.bincount(tree.visits(known, bits)[1], minlength=tree.leaves)
    return tree, np.maximum(1, np.ceil(visits * (n / max(1, len(known))) / PIECE_POINTS)).astype(np.int64)


def links(points: DataFrame, bits: int) -> DataFrame:
    """Edges (a, b) between distinct fingerprints whose components are those of all pairs within ``bits``."""
    tree, pieces = _routing(points, bits)
    step = 65_536

    def deal(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            fps = batch.column(0).to_numpy()
            for s in range(0, len(fps), step):
                part = np.ascontiguousarray(fps[s : s + step]).view(np.uint64)
                home = tree.home(part)
                who, leaf = tree.visits(part, bits)
                later = leaf > home[who]
                who, leaf = who[later], leaf[later]
                copies = pieces[home]  # a point stands in each piece of its leaf
                own = np.repeat(np.arange(len(part)), copies)
                place = np.arange(len(own)) - np.repeat(np.cumsum(copies) - copies, copies)
                mixed = (part[who] * np.uint64(0x9E3779B97F4A7C15)) >> np.uint64(33)
                leaves = np.concatenate([home[own], leaf]).astype(np.int32)
                piece = np.concatenate([place, mixed.astype(np.int64) % pieces[leaf]]).astype(np.int32)
                point = np.concatenate([part[own], part[who]]).view(np.int64)
                visiting = np.arange(len(leaves)) >= len(own)
                for t in range(0, len(leaves), step):
                    yield pa.RecordBatch.from_arrays(
                        [pa.array(x[t : t + step]) for x in (leaves, piece, point, visiting)], names=["leaf", "piece", "fp", "visiting"]
                    )

    def search(key: tuple, group: pa.Table) -> pa.Table:
        fps = group.column("fp").to_numpy().view(np.uint64)
        visiting = group.column("visiting").to_numpy()
        points = np.concatenate([fps[~visiting], fps[visiting]])
        root = link(fps[~visiting], fps[visiting], bits, own=key[1].as_py() == 0)
        moved = np.flatnonzero(root != np.arange(len(points)))
        signed = points.view(np.int64)
        return pa.table({"a": signed[moved], "b": signed[root[moved]]})

    dealt = points.select("fp").mapInArrow(deal, "leaf int, piece int, fp long, visiting boolean")
    return dealt.groupBy("leaf", "piece").applyInArrow(search, "a long, b long")


def _components(docs: DataFrame, words: int, bits: int, id_col: str, text_col: str) -> DataFrame:
    """(doc_id, fp, digest, n_chars, root, component_id), one row per document; root is a fingerprint that names the component."""
    prints = staged(fingerprints(docs, words, id_col, text_col), "op8-prints")
    points = staged(prints.groupBy("fp").agg(F.min("doc_id").alias("least")), "op8-points")
    roots = connected_components(links(points, bits), "a", "b", "op8-edges")
    rooted = points.join(roots, points.fp == roots.node, "left").select(
        "fp", "least", F.coalesce("root", "fp").alias("root")
    )
    rooted = staged(rooted, "op8-rooted")
    component = rooted.groupBy("root").agg(F.min("least").alias("component_id"))
    labels = salted_join(rooted.select("fp", "root"), component, "root", staged(hot_keys(rooted, "root"), "op8-hot-roots"))
    return salted_join(prints, labels, "fp", staged(hot_keys(prints, "fp"), "op8-hot"))


def near_groups(
    docs: DataFrame, words: int = 4, bits: int = 4, id_col: str = "doc_id", text_col: str = "text"
) -> DataFrame:
    """One row per document: ``id_col``, ``fingerprint`` (16 hex digits), ``component_id`` (least id reachable)."""
    return _components(docs, words, bits, id_col, text_col).select(
        F.col("doc_id").alias(id_col), F.lpad(F.lower(F.hex("fp")), 16, "0").alias("fingerprint"), "component_id"
    )


def deduplicate(docs: DataFrame, words: int = 4, bits: int = 4, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One document of each component, that of the least id, with all its columns.

    A null id loses to any other.  Where several rows of a component share its least id, that of the longest text
    stays, then of the largest hash of its text, then of all its columns.
    """
    mark = lambda c: F.coalesce(c.cast("string"), F.lit(""))
    key = ["__op8_id", "__op8_digest"]
    first = _components(docs, words, bits, id_col, text_col).where(F.col("doc_id").eqNullSafe(F.col("component_id")))
    texts = first.groupBy("doc_id", "root", "digest").agg(F.max("n_chars").alias("n_chars"), F.count(F.lit(1)).alias("n"))
    best = texts.groupBy("doc_id", "root").agg(F.max_by(F.struct("digest", "n"), F.struct("n_chars", "digest")).alias("b"))
    keepers = staged(best.select(mark(F.col("doc_id")).alias(key[0]), F.col("b.digest").alias(key[1]), F.col("b.n").alias("n")), "op8-keepers")
    keyed = docs.withColumns({key[0]: mark(F.col(id_col).cast("long")), key[1]: F.xxhash64(F.coalesce(F.col(text_col), F.lit("")))})
    return one_row_each(docs, keyed, keepers, key, text_col)
