"""Encoding whole texts through caches kept by each Python worker.

Both vocabularies cut a text into pre-tokens that never reach over the place
where white space follows anything else, so the ids of a text are those of its
space-separated pieces in order.  Pieces repeat; each worker keeps the ids of
the pieces and of the pre-tokens that it has met, in two generations of bounded
size, and all the new pre-tokens of a batch are merged together.
"""

from __future__ import annotations

import gc
import json
import os.path
import re
import unicodedata
from collections.abc import Iterable

import regex

from .rank_bpe import RankBpe
from .worker import kept

#: Entries in a generation of a cache; two generations are kept.
GENERATION = 300_000
#: Longer pieces and pre-tokens aren't kept.
KEPT_CHARS = 64
#: White space besides the space and the line feed.
OTHER_SPACES = "\t\x0b\x0c\r\x1c\x1d\x1e\x1f\x85\xa0\u1680\u2000\u2001\u2002\u2003\u2004\u2005\u2006\u2007\u2008\u2009\u200a\u2028\u2029\u202f\u205f\u3000"
#: Marks that end a word: the word and the mark are pre-tokens of their own.
STOPS = frozenset(".,;:!?")
#: The patterns by which the two public vocabularies cut pre-tokens.
BYTE_PATTERN = r"""'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"""
WORD_PATTERN = r"""'s|'t|'re|'ve|'m|'ll|'d|[\p{L}]+|[\p{N}]|[^\s\p{L}\p{N}]+"""


class Generations:
    """A cache of bounded size: when the young entries are many, they become the old ones,
    and old entries that are met again come back."""

    def __init__(self, limit: int = GENERATION):
        self.young: dict[str, bytes] = {}
        self.old: dict[str, bytes] = {}
        self.limit = limit

    def age(self) -> None:
        if len(self.young) > self.limit:
            self.old, self.young = self.young, {}

    def recall(self, keys: Iterable[str]) -> list[str]:
        """Bring back what is old; return the keys that are new."""
        if not self.old:
            return list(keys)
        new, young, old = [], self.young, self.old.get
        for k in keys:
            v = old(k)
            if v is None:
                new.append(k)
            else:
                young[k] = v
        return new


def lowers(spec: dict) -> bool:
    """Whether a tokenizers file lower-cases and drops white space (else it keeps every byte); an error for any other scheme."""
    cutter, normal = spec["pre_tokenizer"] or {}, spec["normalizer"]
    if normal is None and cutter.get("type") == "ByteLevel" and cutter.get("use_regex") and not cutter.get("add_prefix_space"):
        return False
    steps = [n["type"] for n in (normal or {}).get("normalizers", [])]
    cuts = cutter.get("pretokenizers") or [{}]
    if steps == ["NFC", "Replace", "Lowercase"] and (cuts[0].get("pattern") or {}).get("Regex") == WORD_PATTERN:
        return True
    raise ValueError("a vocabulary file whose normalizer and pre-tokenizer this encoder doesn't follow")


def _marks_apart(text: str) -> str:
    """A text with a space before full stops and commas that stand between a letter and a space.

    A mark after a letter is a pre-token of its own, or starts one, so where white space is dropped the pre-tokens stay
    the same; pieces are then words alone, of which there are fewer.
    """
    for mark in (". ", ", "):
        parts = text.split(mark)
        if len(parts) > 1:
            apart = " " + mark
            text = "".join([p + apart if p[-1:].isalpha() else p + mark for p in parts[:-1]]) + parts[-1]
    return text


class Encoder:
    """Ids of whole texts, as little-endian unsigned 32-bit bytes."""

    def __init__(self, path: str):
        self.bpe = RankBpe(path)
        with open(path, encoding="utf-8") as f:
            self.lowered = lowers(json.load(f))
        self.pattern = regex.compile(WORD_PATTERN if self.lowered else BYTE_PATTERN)
        # a special string is found by what all of them start with; where there is none, nothing matches
        self.special = re.compile("(" + "|".join(map(re.escape, sorted(self.bpe.special, key=len, reverse=True))) + ")" if self.bpe.special else "((?!))")
        self.special_mark = os.path.commonprefix(list(self.bpe.special)) if self.bpe.special else "\0no special strings"
        self.pieces, self.pretokens = Generations(), Generations()

    # --- cutting -----------------------------------------------------------
    def cut(self, text: str) -> list[str]:
        """Pre-tokens of a stretch of text without special strings."""
        if self.lowered:
            if not text.isascii():
                text = unicodedata.normalize("NFC", text)
                if "Σ" in text:  # character by character, so that a sigma's place in its word doesn't matter
                    return self.pattern.findall("".join(map(str.lower, text)))
            text = text.lower()
            if text.isalpha():
                return [text]
            if text[-1:] in STOPS and text[:-1].isalpha():
                return [text[:-1], text[-1]]
        return self.pattern.findall(text)

    def cut_piece(self, piece: str) -> list[str]:
        """Pre-tokens of a piece as ``_plain`` gives it."""
        if self.lowered or piece[:1] == "\n":
            return self.cut(piece)
        if piece.isalpha():
            return [" " + piece]
        if piece[-1:] in STOPS and piece[:-1].isalpha():
            return [" " + piece[:-1], piece[-1]]
        return self.pattern.findall(" " + piece)

    def _plain(self, text: str) -> list[str] | None:
        """The pieces of a text; None if it needs the long way.

        Lower-case vocabulary: pieces without their white space.  The other: a
        piece that starts with a line feed stands for itself, and so does the
        first; the others stand for themselves with a space before them.
        """
        if self.special_mark in text:
            return None
        if self.lowered:
            return None if any(c in text for c in "\x1c\x1d\x1e\x1f") else _marks_apart(text).split()
        if "  " in text or " \n" in text or "\n\n" in text or any(f"{c} " in text or f"{c}\n" in text for c in OTHER_SPACES):
            return None
        return text.replace("\n", " \n").split(" ")

    def _long(self, text: str) -> list[str | int]:
        """Pre-tokens, and the ids of special strings."""
        out: list[str | int] = []
        for k, part in enumerate(self.special.split(text)):
            if k % 2:
                out.append(self.bpe.special[part])
            elif part:
                out += self.cut(part)
        return out

    # --- encoding ----------------------------------------------------------
    def encode(self, texts: list[str]) -> list[bytes]:
        """Ids of each text.  Nothing here refers to itself, so the collector, which would walk the batch's many lists
        again and again, waits until the end."""
        collecting = gc.isenabled()
        gc.disable()
        try:
            return self._encode(texts)
        finally:
            if collecting:
                gc.enable()

    def _encode(self, texts: list[str]) -> list[bytes]:
        self.pieces.age()
        self.pretokens.age()
        young, pre = self.pieces.young, self.pretokens.young
        get = young.get
        plans: list = []
        missed: list[str] = []
        loose: list[str] = []
        for text in texts:
            pieces = self._plain(text)
            if pieces is None:
                head, values = self._long(text), None
                loose += [p for p in head if type(p) is str]
            else:
                head = [] if self.lowered else self.cut(pieces.pop(0))
                loose += head
                values = list(map(get, pieces))
                if None in values:
                    holes = [k for k, v in enumerate(values) if v is None]
                    missed += [pieces[k] for k in holes]
                    pieces = [(k, pieces[k]) for k in holes]
                else:
                    pieces = ()
            plans.append((pieces, head, values))
        own = self._learn(missed, loose)
        out = []
        for holes, head, values in plans:
            first = b"".join([h.to_bytes(4, "little") if type(h) is int else pre[h] if h in pre else own[0][h] for h in head])
            if values is None:
                out.append(first)
                continue
            for k, p in holes:
                values[k] = young[p] if p in young else own[1][p]
            out.append(first + b"".join(values))
        return out

    def _learn(self, missed: list[str], loose: list[str]) -> tuple[dict[str, bytes], dict[str, bytes]]:
        """Put ids for the missed pieces and the loose pre-tokens into the caches.

        What is too long to keep is returned: pre-tokens and pieces of this batch.
        """
        young, pre = self.pieces.young, self.pretokens.young
        new = self.pieces.recall(dict.fromkeys(missed))
        cuts = list(map(self.cut_piece, new))
        single = [c[0] if len(c) == 1 else None for c in cuts]
        parts = dict.fromkeys(x for c in cuts if len(c) > 1 for x in c)
        parts.update(dict.fromkeys(loose))
        unknown = self.pretokens.recall([p for p in parts if p not in pre])
        alone = [s for s in single if s is not None]
        ids = self.bpe.encode_words([w.encode() for w in alone + unknown])
        long_pre: dict[str, bytes] = {}
        long_pieces: dict[str, bytes] = {}
        for p, v in zip(unknown, ids[len(alone) :]):
            (pre if len(p) <= KEPT_CHARS else long_pre)[p] = v
        singles = iter(ids)
        if long_pre:
            pre = {**{x: pre[x] for x in parts if x in pre}, **long_pre}
        for p, c, s in zip(new, cuts, single):
            if s is not None:
                v = next(singles)
            elif len(c) == 2:
                v = pre[c[0]] + pre[c[1]]
            else:
                v = b"".join([pre[x] for x in c])
            if len(p) <= KEPT_CHARS:
                young[p] = v
            else:
                long_pieces[p] = v
        return long_pre, long_pieces


def encoder(path: str) -> Encoder:
    """The worker's encoder of a vocabulary file: one per process, with its caches, until another operator runs."""
    return kept(("encoder", path), lambda: Encoder(path))


#: Characters encoded at once.
BLOCK_CHARS = 4_000_000


def blocks(texts: list[str]) -> Iterable[tuple[int, int]]:
    """Ranges of texts of about BLOCK_CHARS characters, one text at least."""
    start = size = 0
    for k, text in enumerate(texts):
        if size and size + len(text) > BLOCK_CHARS:
            yield start, k
            start, size = k, 0
        size += len(text)
    if start < len(texts):
        yield start, len(texts)
