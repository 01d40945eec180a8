"""Operator 9: benchmark decontamination by template canonicalisation.

Words become template words: numbers, names and units turn into typed
placeholders (``<num>``, ``<name>``, ``<unit>``), other words are lower-cased
and stripped of outer punctuation.  All windows of WINDOW template words of the
benchmark are hashed into a table.  One scan of the documents hashes theirs and
hands on those that a bit map of the benchmark's hashes lets pass (its size is
bounded, whatever the benchmark's); these are joined with the table by hash, and
the template words themselves are compared.  Matches of a document and an item
are put together by alignment (a document's place less the item's), and within an
alignment the slots must be consistent: one value of the item always stands for
one value of the document, and the other way round, be it a number, a name or a
unit.  A document is contaminated by an item when consistent windows cover
COVERAGE of the item's words, so a question with other numbers or names is caught
and a chance phrase isn't.

A name is a capitalised word that doesn't start a sentence; a unit is a word of
UNITS right after a number.  An item shorter than a window is one window of its
own length, which is slid over every document; an item of a placeholder alone
is thus met by every document with such a word.  Items without words match
nothing; null texts are empty.  Rows are told apart by a number of their own (by
their texts in ``decontaminate``), so ids may be null or given twice and repeated
rows are repeated in the result; an item given twice is matched once as each.  Of items that cover equally much the
one of the smallest id is reported.  Empty tables give no rows, or no matches.
Ids are integers.
"""

from __future__ import annotations

import re
import uuid
from collections import defaultdict
from collections.abc import Iterator, Sequence

import numpy as np
import pyarrow as pa
import xxhash
from pyspark import Broadcast
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .arrow_maps import bounded_batches, map_texts
from .runtime import SALTS, hot_keys, salted_join, staged
from .worker import kept

#: Words of a window, and the covered share of an item's words that counts.
WINDOW = 5
COVERAGE = 0.5
#: Bits of the map of window hashes for each window, tried PROBES times; the map has 2^LEAST_BITS bits at least and 2^MOST_BITS (32 MB) at most.
BITS_EACH, PROBES = 32, 4
LEAST_BITS, MOST_BITS = 20, 28
#: Words whose codes a worker keeps, and the longest of them.
KEPT_WORDS, KEPT_CHARS = 400_000, 64
#: Contaminated texts whose digests (32 bytes) are broadcast, at most; more are shuffled.
MOST_BROADCAST = 65_536

NUM, NAME, UNIT = "<num>", "<name>", "<unit>"
#: Units, and numbers written as words, in English, French, German and Spanish.
UNITS = frozenset(
    """% ° °c °f mm cm m km mg g kg t ml cl l s ms min h hr hrs day days week weeks month months year years second
    seconds minute minutes hour hours inch inches foot feet ft yard yards mile miles mph kmh km/h kph ounce ounces oz
    pound pounds lb lbs ton tons tonne tonnes gram grams kilogram kilograms meter meters metre metres kilometer
    kilometers kilometre kilometres centimeter centimeters centimetre centimetres liter liters litre litres gallon
    gallons percent degree degrees dollar dollars cent cents euro euros usd eur gbp jour jours semaine semaines mois an
    ans heure heures gramme grammes kilogramme mètre mètres kilomètre kilomètres tag tage woche wochen monat monate
    jahr jahre stunde stunden gramm meile meilen día días semana semanas mes meses año años hora horas gramo gramos
    metro metros kilómetro kilómetros litro litros""".split()
)
NUMBER_WORDS = frozenset(
    """zero one two three four five six seven eight nine ten eleven twelve thirteen fourteen fifteen sixteen seventeen
    eighteen nineteen twenty thirty forty fifty sixty seventy eighty ninety hundred thousand million billion deux trois
    quatre cinq sept huit neuf dix onze douze vingt trente cent mille zwei drei vier fünf sechs sieben acht neun zehn
    elf zwölf zwanzig hundert tausend dos tres cuatro cinco seis siete ocho nueve diez once doce veinte cien mil""".split()
)
_NUMBER = re.compile(r"[$€£#]?[+-]?\d[\d.,:/]*(?:st|nd|rd|th|er|e)?")
_NUMBER_UNIT = re.compile(r"[$€£]?[+-]?\d[\d.,]*([^\W\d]+|%|°[cf]?)")
_OUTER = " \t.,;:!?\"'()[]{}<>«»“”‘’…|*_-–—"
_ENDS = (".", "!", "?", ":", "|", '."', '!"', '?"', ".)", "…")


def word_forms(word: str) -> tuple[str, str, bool, bool]:
    """(template at a sentence's start, template elsewhere, is a unit after a number, ends a sentence)."""
    core = word.strip(_OUTER)
    low = core.lower()
    ends = word.endswith(_ENDS)
    if not low:
        return "", "", word.strip() in UNITS, ends
    if low in NUMBER_WORDS or _NUMBER.fullmatch(low):
        return NUM, NUM, False, ends
    m = _NUMBER_UNIT.fullmatch(low)
    if m and m[1] in UNITS:
        return NUM, NUM, False, ends
    elsewhere = NAME if core[0].isupper() else low
    return low, elsewhere, low in UNITS, ends


def template(text: str) -> tuple[list[str], list[str]]:
    """Template words and the words they came from; words that are all punctuation go."""
    out, own, start, after_number = [], [], True, False
    for word in text.split():
        first, elsewhere, unit, ends = word_forms(word)
        t = UNIT if unit and after_number else first if start else elsewhere
        if t:
            out.append(t)
            own.append(word.strip(_OUTER).lower() or word)
        after_number, start = t == NUM, ends
    return out, own


#: Fixed at random: odd multipliers of a window's words.
_ODD = np.random.default_rng(20).integers(0, 2**63, 64, np.uint64) * np.uint64(2) + np.uint64(1)


def code_of(template_word: str) -> int:
    """64 bits that stand for a template word; 0 for none."""
    return xxhash.xxh64_intdigest(template_word.encode("utf-8", "surrogatepass")) | 1 if template_word else 0


def window_hashes(codes: np.ndarray, size: int) -> np.ndarray:
    """Hashes of all runs of ``size`` codes, as signed longs."""
    n = len(codes) - size + 1
    if n <= 0:
        return np.zeros(0, np.int64)
    h = np.full(n, size, np.uint64)
    for k in range(size):
        h += codes[k : k + n] * _ODD[k]
    h = (h ^ (h >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    h = (h ^ (h >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return (h ^ (h >> np.uint64(31))).view(np.int64)


class Words:
    """Codes of the words that a worker has met."""

    def __init__(self) -> None:
        self.forget()

    def forget(self) -> None:
        self.seat: dict[str, int] = {}
        self.size = 0
        self.codes = np.zeros((1024, 2), np.uint64)  # at a sentence's start, and elsewhere
        self.flags = np.zeros((1024, 3), bool)  # is a unit after a number, is a number, ends a sentence

    def _learn(self, word: str, made: list[tuple]) -> int:
        core, ends = word, False
        if not core.isalpha() and core[-1] in ".,":
            core, ends = core[:-1], core[-1] == "."
        low = core.lower()
        if core.isalpha() and low not in NUMBER_WORDS and low not in UNITS:  # most words: told at once
            code = code_of(low)
            made.append((code, _NAME_CODE if core[0].isupper() else code, False, False, ends))
        else:
            first, elsewhere, unit, ends = word_forms(word)
            made.append((code_of(first), code_of(elsewhere), unit, first == NUM, ends))
        row = self.size + len(made) - 1
        if len(word) <= KEPT_CHARS:
            self.seat[word] = row
        return row

    def of(self, words: list[str]) -> tuple[np.ndarray, np.ndarray]:
        """Codes of a text's template words, and the places of the words that they came from."""
        if self.size > KEPT_WORDS:
            self.forget()
        rows = list(map(self.seat.get, words))
        if None in rows:
            made: list[tuple] = []
            for k, r in enumerate(rows):
                if r is None:
                    r = self.seat.get(words[k])
                    rows[k] = self._learn(words[k], made) if r is None else r
            self._add(made)
        at = np.array(rows, np.int64)
        codes, flags = self.codes[at], self.flags[at]
        start, after = np.ones(len(at), bool), np.zeros(len(at), bool)
        start[1:], after[1:] = flags[:-1, 2], flags[:-1, 1]
        out = np.where(start, codes[:, 0], codes[:, 1])
        out[flags[:, 0] & after] = _UNIT_CODE
        real = np.flatnonzero(out)
        return out[real], real

    def _add(self, made: list[tuple]) -> None:
        need = self.size + len(made)
        if need > len(self.codes):
            room = max(need, 2 * len(self.codes))
            self.codes = np.concatenate([self.codes, np.zeros((room - len(self.codes), 2), np.uint64)])
            self.flags = np.concatenate([self.flags, np.zeros((room - len(self.flags), 3), bool)])
        self.codes[self.size : need] = np.array([m[:2] for m in made], np.uint64).reshape(-1, 2)
        self.flags[self.size : need] = np.array([m[2:] for m in made], bool).reshape(-1, 3)
        self.size = need


_NAME_CODE, _UNIT_CODE = code_of(NAME), code_of(UNIT)


def template_at(words: list[str], place: int) -> str:
    """The template word that ``template`` makes of one word of a text."""
    first, elsewhere, unit, _ = word_forms(words[place])
    before = word_forms(words[place - 1]) if place else ("", "", False, True)
    return UNIT if unit and before[0] == NUM else first if before[3] else elsewhere


class Finder:
    """The scanning side: which windows of a text may be windows of the benchmark."""

    def __init__(self, bits: bytes, sizes: Sequence[int]):
        self.bits = np.frombuffer(bits, np.uint8)
        self.sizes = sizes
        self.words = Words()

    def find(self, text: str) -> list[dict]:
        words = text.split()
        if not words or not self.sizes:
            return []
        codes, places = self.words.of(words)
        out = []
        for size in self.sizes:
            h = window_hashes(codes, size)
            at = np.arange(len(h))
            for slot in _slots(h, len(self.bits) * 8):
                some = self.bits[slot[at] >> 3] >> (slot[at] & 7).astype(np.uint8) & 1 == 1
                at = at[some]
                if not len(at):
                    break
            for p in at.tolist():
                span = places[p : p + size].tolist()
                own = [words[k].strip(_OUTER).lower() or words[k] for k in span]
                out.append(
                    {"h": int(h[p]), "p": p, "first_word": span[0], "end_word": span[-1] + 1, "words": [template_at(words, k) for k in span], "own": own}
                )
        return out


def _slots(h: np.ndarray, size: int) -> Iterator[np.ndarray]:
    """The places in a map of ``size`` bits that hashes stand at."""
    low, high = h & (size - 1), (h >> 32) & (size - 1)
    for k in range(PROBES):
        yield (low + k * high) & (size - 1)


_HITS = "array<struct<h:long,p:int,first_word:int,end_word:int,words:array<string>,own:array<string>>>"
_HIT = pa.list_(
    pa.struct(
        [("h", pa.int64()), ("p", pa.int32()), ("first_word", pa.int32()), ("end_word", pa.int32()), ("words", pa.list_(pa.string())), ("own", pa.list_(pa.string()))]
    )
)


def benchmark_windows(benchmark: DataFrame, window: int = WINDOW, item_col: str = "item_id", text_col: str = "text") -> DataFrame:
    """(item, item_id, n, h, o, item_words, item_own) for each window of each item, staged: ``item`` numbers the rows of
    the benchmark, ``n`` is an item's words, ``o`` a window's offset."""

    def cut(batch: pa.RecordBatch, texts: list[str]) -> dict:
        made = [template(t) for t in texts]
        hashes = [window_hashes(np.array([code_of(t) for t in ts], np.uint64), min(window, len(ts))).tolist() if ts else [] for ts, _ in made]
        strings = pa.list_(pa.string())
        return {
            "item_id": batch.column("item_id"),
            "words": pa.array([ts for ts, _ in made], strings),
            "own": pa.array([own for _, own in made], strings),
            "hashes": pa.array(hashes, pa.list_(pa.int64())),
        }

    rows = benchmark.select(F.col(item_col).cast("long").alias("item_id"), F.col(text_col).alias("_text"))
    items = map_texts(rows, "_text", "item_id long, words array<string>, own array<string>, hashes array<long>", cut)
    items = staged(items.withColumn("item", F.monotonically_increasing_id()), "op9-items")
    size = F.least(F.lit(window), F.size("words"))
    part = lambda c: F.slice(c, F.col("o") + 1, F.col("size"))
    each = items.select("item", "item_id", F.size("words").alias("n"), size.alias("size"), "words", "own", F.posexplode("hashes").alias("o", "h"))
    return each.select("item", "item_id", "n", "size", "h", "o", part("words").alias("item_words"), part("own").alias("item_own"))


def _bit_map(windows: DataFrame) -> bytes:
    """The map of the windows' hashes, as bytes whose lowest bit comes first: its size is bounded."""
    bits = min(MOST_BITS, max(LEAST_BITS, int(np.ceil(np.log2(max(1, BITS_EACH * windows.count()))))))
    mask = F.lit((1 << bits) - 1)
    low, high = F.col("h").bitwiseAND(mask), F.shiftright("h", 32).bitwiseAND(mask)
    slots = F.explode(F.array(*[(low + k * high).bitwiseAND(mask) + 1 for k in range(PROBES)]))
    slot = F.col("slot")
    parts = windows.select("h").distinct().select(slots.alias("slot")).groupBy(F.bitmap_bucket_number(slot).alias("bucket")).agg(F.bitmap_construct_agg(F.bitmap_bit_position(slot)).alias("bits"))
    out = np.zeros((1 << bits) // 8, np.uint8)
    for r in parts.collect():  # at most 2^(MOST_BITS - 15) rows of 4096 bytes
        part = np.frombuffer(bytes(r.bits), np.uint8)
        out[(r.bucket - 1) * 4096 : r.bucket * 4096] = part
    return out.tobytes()


def _candidates(key: DataFrame, windows: DataFrame) -> DataFrame:
    """The rows of ``key`` (key, _text) with ``hits``: the windows that may be the benchmark's, in place of the text."""
    sizes = sorted(r["size"] for r in windows.select("size").distinct().collect())  # WINDOW values at most
    spread = key.sparkSession.sparkContext.broadcast(_bit_map(windows))
    name = uuid.uuid4().hex
    kind = dict(key.dtypes)["key"]

    def work(batch: pa.RecordBatch, texts: list[str]) -> dict:
        finder = _finder(name, spread, sizes)
        return {"key": batch.column("key"), "hits": pa.array([finder.find(t) for t in texts], _HIT)}

    return map_texts(key, "_text", f"key {kind}, hits {_HITS}", work)


def _finder(name: str, bits: Broadcast, sizes: Sequence[int]) -> Finder:
    """The worker's finder of a broadcast map."""
    return kept(("templates", name), lambda: Finder(bits.value, sizes))


def score_pair(n: int, hits: list[dict], window: int = WINDOW) -> tuple[float, bool, int, int]:
    """(covered share, slots differ, first word, word after the last) of an item of ``n`` words from the windows that
    it shares with a document.

    A window counts if its slots agree with each other and with the windows before it in its alignment.  An item
    that is one short window is judged at each of its places by itself: the best place counts, then the first.
    """
    lines: dict[tuple, list[dict]] = defaultdict(list)
    for hit in sorted(hits, key=lambda x: (x["o"], x["p"])):
        lines[hit["p"] - hit["o"]].append(hit)
    covered: set[int] = set()
    differ, low, high = False, 0, 0
    best = None
    for shift in sorted(lines):
        there: dict[str, str] = {}
        back: dict[str, str] = {}
        for hit in lines[shift]:
            slots = {(a, b) for t, a, b in zip(hit["words"], hit["item_own"], hit["own"]) if t in (NUM, NAME, UNIT)}
            agree = len(slots) == len({a for a, _ in slots}) == len({b for _, b in slots})
            if not agree or any(there.get(a, b) != b or back.get(b, a) != a for a, b in slots):
                continue
            there.update(slots)
            back.update((b, a) for a, b in slots)
            other = any(a != b for a, b in slots)
            if n < window:
                if best is None or best[1] > other:
                    best = (1.0, other, hit["first_word"], hit["end_word"])
                continue
            low = min(low, hit["first_word"]) if covered else hit["first_word"]
            high, differ = max(high, hit["end_word"]), differ or other
            covered.update(range(hit["o"], hit["o"] + len(hit["words"])))
    return best or (len(covered) / n, differ, low, high)


def _matches(hits: DataFrame, windows: DataFrame, coverage: float, window: int) -> DataFrame:
    """(row, item_id, coverage, reworded, first_word, end_word) of the items that contaminate a row, from (row, hits) staged."""
    kind = dict(hits.dtypes)["row"]
    each = hits.select("row", F.explode("hits").alias("t")).select("row", "t.*")
    hot = staged(hot_keys(each.select("h"), "h"), "op9-hot")
    met = salted_join(each, windows, "h", hot).where(F.col("words") == F.col("item_words"))
    hit = F.struct("p", "o", "first_word", "end_word", "words", "own", "item_own")
    pairs = met.groupBy("row", "item", "item_id", "n").agg(F.collect_list(hit).alias("hits"))

    def score(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        names = ["row", "item_id", "coverage", "reworded", "first_word", "end_word"]
        for batch in batches:
            made = [score_pair(n, hits, window) for n, hits in zip(batch.column("n").to_pylist(), batch.column("hits").to_pylist())]
            columns = [pa.array([m[k] for m in made], kind) for k, kind in enumerate((pa.float64(), pa.bool_(), pa.int32(), pa.int32()))]
            yield pa.RecordBatch.from_arrays([batch.column("row"), batch.column("item_id"), *columns], names=names)

    schema = f"row {kind}, item_id long, coverage double, reworded boolean, first_word int, end_word int"
    return bounded_batches(pairs.select("row", "item_id", "n", "hits")).mapInArrow(score, schema).where(F.col("coverage") >= coverage)


def find_matches(
    docs: DataFrame,
    benchmark: DataFrame,
    coverage: float = COVERAGE,
    window: int = WINDOW,
    id_col: str = "doc_id",
    text_col: str = "text",
    item_col: str = "item_id",
    item_text: str = "text",
) -> DataFrame:
    """One row per document: ``doc_id``, and ``matches``: the items that contaminate it, with place and evidence,
    those that cover most first, then those of smaller ids (a null id last)."""
    windows = benchmark_windows(benchmark, window, item_col, item_text)
    key = docs.select(F.col(id_col).cast("long").alias("key"), F.col(text_col).alias("_text"))
    light = staged(_candidates(key, windows).withColumn("row", F.monotonically_increasing_id()), "op9-hits")
    found = _matches(light.where(F.size("hits") > 0).select("row", "hits"), windows, coverage, window)
    match = F.struct("item_id", "coverage", "reworded", "first_word", "end_word")
    order = F.struct((-F.col("coverage")).alias("a"), F.col("item_id").isNull().alias("b"), F.col("item_id").alias("c"), match.alias("m"))
    per = found.groupBy("row").agg(F.transform(F.array_sort(F.collect_list(order)), lambda x: x["m"]).alias("matches"))
    none = F.array().cast(dict(per.dtypes)["matches"])
    return light.select("row", F.col("key").alias("doc_id")).join(per, "row", "left").select("doc_id", F.coalesce("matches", none).alias("matches"))


def contamination(docs: DataFrame, benchmark: DataFrame, id_col: str = "doc_id", **options) -> DataFrame:
    """One row per document: ``id_col``, ``contaminated``, ``n_items``, ``item_id`` and ``coverage`` of the item
    that covers most (then the smallest id), and ``reworded``: whether only slots with other values match it."""
    found = find_matches(docs, benchmark, id_col=id_col, **options)
    top = F.try_element_at("matches", F.lit(1))
    return found.select(
        F.col("doc_id").alias(id_col),
        (F.size("matches") > 0).alias("contaminated"),
        F.size("matches").cast("long").alias("n_items"),
        top["item_id"].alias("item_id"),
        F.coalesce(top["coverage"], F.lit(0.0)).alias("coverage"),
        F.coalesce(top["reworded"], F.lit(False)).alias("reworded"),
    )


def decontaminate(
    docs: DataFrame,
    benchmark: DataFrame,
    coverage: float = COVERAGE,
    window: int = WINDOW,
    text_col: str = "text",
    item_col: str = "item_id",
    item_text: str = "text",
) -> DataFrame:
    """The rows that no item contaminates, with all their columns; ids play no part and may be null or given twice.

    A text alone decides, so rows are matched by its SHA-256: the documents are read twice and never written, and
    what is staged are the windows that distinct texts may share with the benchmark.  ``docs`` must therefore give
    the same texts each time it is read, as files do.
    """
    windows = benchmark_windows(benchmark, window, item_col, item_text)
    mark = "__op9_text"
    keyed = docs.withColumn(mark, F.unhex(F.sha2(F.coalesce(F.col(text_col), F.lit("")), 256)))
    key = keyed.select(F.col(mark).alias("key"), F.col(text_col).alias("_text"))
    met = _candidates(key, windows).where(F.size("hits") > 0)
    hits = staged(met.groupBy(F.col("key").alias("row")).agg(F.any_value("hits").alias("hits")), "op9-hits")
    bad = staged(_matches(hits, windows, coverage, window).select(F.col("row").alias(mark)).distinct(), "op9-contaminated")
    if bad.count() <= MOST_BROADCAST:
        return keyed.join(F.broadcast(bad), mark, "left_anti").select(docs.columns)
    # the rows of a text may be many, so they are dealt over SALTS tasks and the contaminated texts stand in each
    salt = "__op9_salt"
    spread = keyed.withColumn(salt, F.pmod(F.monotonically_increasing_id(), F.lit(SALTS)).cast("int"))
    copies = bad.withColumn(salt, F.explode(F.sequence(F.lit(0), F.lit(SALTS - 1))))
    return spread.join(copies, [mark, salt], "left_anti").select(docs.columns)
