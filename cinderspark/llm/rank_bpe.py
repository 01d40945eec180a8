"""Byte-pair encoding on contiguous rank arrays.

A pre-token is an array of symbol ids with, beside it, the rank of every adjacent
pair.  The ranks are scanned for the lowest (leftmost on ties), the boundary
there is deleted, and the two neighbouring ranks are looked up again, until no
pair has a rank.  Many pre-tokens stand in one matrix, so each scan, deletion
and refresh is one vector operation over all of them.  A pre-token
over SHORT symbols is merged alone with a heap over a linked list, which gives
the same merges in n log n.
"""

from __future__ import annotations

import heapq
import json
from functools import lru_cache

import numpy as np

#: Longest row of a matrix; longer pre-tokens go to the heap.
SHORT = 48
#: Rank of a pair that doesn't merge.
NO_RANK = np.int32(2**31 - 1)
#: Rows merged at once.
ROWS = 8192


@lru_cache(maxsize=1)
def byte_alphabet() -> list[str]:
    """The printable character that byte-level vocabularies write for each byte."""
    plain = [*range(ord("!"), ord("~") + 1), *range(ord("¡"), ord("¬") + 1), *range(ord("®"), ord("ÿ") + 1)]
    out, extra = [""] * 256, 256
    for b in range(256):
        if b in plain:
            out[b] = chr(b)
        else:
            out[b] = chr(extra)
            extra += 1
    return out


class RankBpe:
    """Vocabulary and merges of a tokenizers ``.json`` file with a byte-level BPE model."""

    def __init__(self, path: str):
        with open(path, encoding="utf-8") as f:
            spec = json.load(f)
        model = spec["model"]
        self.vocab: dict[str, int] = model["vocab"]
        suffix = model.get("end_of_word_suffix") or ""
        alphabet = byte_alphabet()
        self.first = np.array([self.vocab[c] for c in alphabet], np.int32)
        self.last = np.array([self.vocab[c + suffix] for c in alphabet], np.int32) if suffix else self.first
        self.special = {t["content"]: t["id"] for t in spec["added_tokens"]}
        pairs = [m if isinstance(m, list) else m.split(" ") for m in model["merges"]]
        left = np.array([self.vocab[a] for a, _ in pairs], np.int64)
        right = np.array([self.vocab[b] for _, b in pairs], np.int64)
        made = [self.vocab[a + b] for a, b in pairs]
        self._index((left << 32) | right, np.array(made, np.int32))
        self._words_of_ids(suffix)

    def _index(self, keys: np.ndarray, made: np.ndarray) -> None:
        """Open-addressed table of pair -> rank, as arrays.  A pair given twice keeps its last rank."""
        bits = max(4, int(2 * len(keys)).bit_length() + 1)
        size = 1 << bits
        self._shift, self._mask = np.uint64(64 - bits), np.int64(size - 1)
        self._keys = np.full(size, -1, np.int64)
        self._rank = np.full(size, NO_RANK, np.int32)
        self.made = np.append(made, np.int32(-1))
        self._probes = 1
        self.rank_of = dict(zip(keys.tolist(), range(len(keys))))  # for one pair at a time
        for rank, (key, slot) in enumerate(zip(keys.tolist(), self._slot(keys).tolist())):
            probe = 1
            while self._keys[slot] not in (-1, key):
                slot, probe = (slot + 1) & (size - 1), probe + 1
            self._keys[slot], self._rank[slot] = key, rank
            self._probes = max(self._probes, probe)

    def _slot(self, keys: np.ndarray) -> np.ndarray:
        with np.errstate(over="ignore"):
            return ((keys.astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15)) >> self._shift).astype(np.int64)

    def _words_of_ids(self, suffix: str) -> None:
        back = {c: b for b, c in enumerate(byte_alphabet())}
        specials = {i: c for c, i in self.special.items()}
        words = [b""] * (max([*self.vocab.values(), *specials]) + 1)
        for token, i in self.vocab.items():
            body, end = (token[: -len(suffix)], b" ") if suffix and token.endswith(suffix) else (token, b"")
            words[i] = (bytes(back[c] for c in body) if all(c in back for c in body) else body.encode()) + end
        for i, c in specials.items():
            words[i] = c.encode()
        self._lengths = np.array([len(w) for w in words], np.int64)
        self._starts = np.concatenate([[0], np.cumsum(self._lengths)[:-1]])
        self._bytes = np.frombuffer(b"".join(words), np.uint8)

    def ranks(self, left: np.ndarray, right: np.ndarray) -> np.ndarray:
        """Rank of each pair; NO_RANK where either symbol is absent (-1) or they don't merge."""
        keys = (left.astype(np.int64) << 32) | right.astype(np.int64)
        slot = self._slot(keys)
        found = self._keys[slot]
        out = np.where(found == keys, self._rank[slot], NO_RANK)
        seek = np.flatnonzero((found != keys) & (found != -1) & (left >= 0) & (right >= 0))
        for _ in range(self._probes - 1):
            if not len(seek):
                break
            slot_s = (slot[seek] + 1) & self._mask
            slot[seek] = slot_s
            found = self._keys[slot_s]
            hit = found == keys[seek]
            out[seek[hit]] = self._rank[slot_s[hit]]
            seek = seek[~hit & (found != -1)]
        return np.where((left < 0) | (right < 0), NO_RANK, out)

    def merge_matrix(self, words: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
        """Ids of words of at most SHORT bytes, all merged together: flat ids, and how many each word has.

        Column w of the matrices is word w.  ``key`` holds rank * 64 + place for
        each boundary, so its minimum down a column is the lowest rank at its
        leftmost place; a deleted boundary has no rank.
        """
        n = np.array([len(w) for w in words], np.int64)
        width, count = int(n.max()), len(words)
        place = np.arange(width, dtype=np.int32)[:, None]
        flat = np.frombuffer(b"".join(words), np.uint8)
        ends = np.cumsum(n)
        inside = (place < n).T
        symbols = self.first[flat]
        symbols[ends - 1] = self.last[flat[ends - 1]]
        grid = np.full((count, width), -1, np.int32)
        grid[inside] = symbols
        part = np.ascontiguousarray(grid.T)
        after = np.repeat(place + 1, count, 1)
        before = np.repeat(place - 1, count, 1)
        key = np.full((width, count), NO_RANK, np.int32)
        if width > 1:
            rank = self.ranks(part[:-1].ravel(), part[1:].ravel()).reshape(width - 1, count)
            np.copyto(key[:-1], rank * 64 + place[:-1], where=rank != NO_RANK)
        whole = part
        column = np.arange(count)
        live = n.astype(np.int32)
        while len(column):
            best = key.min(0)
            go = np.flatnonzero(best != NO_RANK)
            if len(go) < len(column):
                if not len(go):
                    break
                if len(go) < 0.8 * len(column):
                    if part is not whole:
                        whole[:, column] = part
                    part, after, before, key = part[:, go], after[:, go], before[:, go], key[:, go]
                    column, live, best = column[go], live[go], best[go]
                    go = np.arange(len(column))
            best = best[go]
            at, made = best & 63, self.made[best >> 6]
            # delete the boundary after `at`: its right part goes
            right = after[at, go]
            beyond = after[right, go]
            part[at, go] = made
            part[right, go] = -1
            key[right, go] = NO_RANK
            after[at, go] = beyond
            more = beyond < live[go]
            g = go[more]
            before[beyond[more], g] = at[more]
            # refresh the neighbouring ranks
            fresh = np.full(len(go), NO_RANK, np.int32)
            if len(g):
                rank = self.ranks(made[more], part[beyond[more], g])
                fresh[more] = np.where(rank == NO_RANK, NO_RANK, rank * 64 + at[more])
            key[at, go] = fresh
            left = before[at, go]
            some = left >= 0
            if some.any():
                h, left = go[some], left[some]
                rank = self.ranks(part[left, h], made[some])
                key[left, h] = np.where(rank == NO_RANK, NO_RANK, rank * 64 + left)
        if part is not whole:
            whole[:, column] = part
        grid = whole.T
        kept = grid >= 0
        return grid[kept], kept.sum(1)

    def merge_long(self, word: bytes) -> np.ndarray:
        """Ids of one long word: a heap of (rank, position) over a linked list of parts."""
        ids = self.first[np.frombuffer(word, np.uint8)]
        ids[-1] = self.last[word[-1]]
        rank = self.ranks(ids[:-1], ids[1:])
        part, size = ids.tolist(), len(ids)
        after, before = list(range(1, size + 1)), list(range(-1, size - 1))
        heap = [(r, k, part[k], part[k + 1]) for k, r in enumerate(rank.tolist()) if r != NO_RANK]
        heapq.heapify(heap)

        rank_of = self.rank_of.get

        def push(k: int) -> None:
            r = rank_of(part[k] << 32 | part[after[k]])
            if r is not None:
                heapq.heappush(heap, (r, k, part[k], part[after[k]]))

        while heap:
            r, k, a, b = heapq.heappop(heap)
            right = after[k]
            if part[k] != a or right >= size or part[right] != b:
                continue
            part[k], part[right] = int(self.made[r]), -1
            after[k] = after[right]
            if after[k] < size:
                before[after[k]] = k
                push(k)
            if before[k] >= 0:
                push(before[k])
        return np.array([p for p in part if p >= 0], np.int32)

    def encode_words(self, words: list[bytes]) -> list[bytes]:
        """Ids of each pre-token (non-empty bytes), as little-endian unsigned 32-bit integers."""
        out: list[bytes] = [b""] * len(words)
        short = [k for k, w in enumerate(words) if len(w) <= SHORT]
        if len(short) > ROWS // 8:
            short.sort(key=lambda k: len(words[k]))
        for s in range(0, len(short), ROWS):
            block = short[s : s + ROWS]
            ids, counts = self.merge_matrix([words[k] for k in block])
            flat = ids.astype("<u4").tobytes()
            end = (4 * np.cumsum(counts)).tolist()
            start = 0
            for k, e in zip(block, end):
                out[k] = flat[start:e]
                start = e
        if len(short) < len(words):
            for k, w in enumerate(words):
                if len(w) > SHORT:
                    out[k] = self.merge_long(w).astype("<u4").tobytes()
        return out

    def decode(self, ids: np.ndarray) -> bytes:
        """The bytes that the ids stand for."""
        if not len(ids):
            return b""
        n = self._lengths[ids]
        ends = np.cumsum(n)
        gather = np.arange(ends[-1]) + np.repeat(self._starts[ids] - (ends - n), n)
        return self._bytes[gather].tobytes()


