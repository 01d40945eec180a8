"""Operator 5: secrets in whole texts, in DataFrame expressions only.

Three base kinds are found by pattern, leftmost and non-overlapping per kind:
``assign`` (a keyword, ``:`` or ``=``, and a value of 12 characters or more),
``access`` (AKIA and 18 characters or more in all) and ``hex`` (16 lower-case
hexadecimal digits or more).  The method adds ``entropy`` spans: a candidate is
a run of WINDOW or more characters of ``[A-Za-z0-9+/_=-]`` with a digit; a
window slides over it, the counts of its characters are kept, and with each step
one count goes up, one goes down and the entropy changes by those two terms; the
span reaches from the first to the last window whose entropy is over the limit of
the candidate's character class.  Candidates on the allow-list give no entropy span; base spans
are never suppressed.

Spans count code points, the end is exclusive.  A null text is empty: no spans,
and the digest of the empty string.  Repeated rows are repeated in the result; an
empty table gives no rows; columns other than the two named are ignored.
"""

from __future__ import annotations

from collections.abc import Callable
from math import log2

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: The base patterns, as the contract states them.
ASSIGN = r"""(?i:password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)"""
ACCESS = r"AKIA[A-Z0-9]{14,}"
HEX = r"[0-9a-f]{16,}"
ASSIGN_VALUE = 12
KINDS = ("assign", "access", "hex", "entropy")

WINDOW = 20
#: One try for each run: it starts where no such character stands before, so that long runs cost their length.
CANDIDATE = r"(?<![A-Za-z0-9+/_=-])(?=[A-Za-z+/_=-]*[0-9])[A-Za-z0-9+/_=-]{20,}"
#: Bits per character that a window must pass, by the class of the candidate's characters.
ENTROPY_LIMITS = (("^[0-9]+$", 2.95), ("^[0-9a-fA-F]+$", 3.05), ("^[A-Za-z0-9]+$", 3.65), ("", 3.75))
#: What looks random and isn't secret: UUIDs, plain numbers, placeholders, alphabets.
ALLOWED = (
    r"^[0-9a-fA-F]{8}-[0-9a-fA-F]{4}-[0-9a-fA-F]{4}-[0-9a-fA-F]{4}-[0-9a-fA-F]{12}$"
    r"|^[0-9_+-]+$|[Ee][Xx][Aa][Mm][Pp][Ll][Ee]|[Pp]laceholder|PLACEHOLDER|[Cc]hangeme|CHANGEME|[Xx]{6}"
    r"|abcdefghij|ABCDEFGHIJ|0123456789abcdef"
)


def bound(value: Column, body: Callable[[Column], Column]) -> Column:
    """``body`` of a value that is worked out once, however often the body names it."""
    return F.get(F.transform(F.array(value), body), F.lit(0))


def located(text: Column, pattern: str) -> Column:
    """array<struct<s, e, m>> of the matches of a pattern that never matches nothing.

    What lies between the matches gives their places; a text without a match
    costs one search.  n matches are walked in root n pieces of root n, since
    adding to an array copies it.
    """
    p = F.lit(pattern)
    kind = "array<struct<s:int,e:int,m:string>>"
    between, found = F.split(text, pattern, -1), F.regexp_extract_all(text, p, F.lit(0))

    def step(state: Column, pair: Column) -> Column:
        start = state["at"] + F.length(pair["b"])
        end = start + F.length(pair["m"])
        return F.struct(
            end.alias("at"),
            F.concat(state["out"], F.array(F.struct(start.alias("s"), end.alias("e"), pair["m"].alias("m")))).alias("out"),
        )

    def walk(pairs: Column) -> Column:
        width = F.ceil(F.sqrt(F.size(pairs))).cast("int")

        def piece(state: Column, k: Column) -> Column:
            begin = F.struct(state["at"].alias("at"), F.array().cast(kind).alias("out"))
            walked = F.aggregate(F.slice(pairs, k * width + 1, width), begin, step)
            return bound(walked, lambda w: F.struct(w["at"].alias("at"), F.concat(state["out"], F.array(w["out"])).alias("out")))

        pieces = F.sequence(F.lit(0), F.floor((F.size(pairs) - 1) / width).cast("int"))
        none = F.struct(F.lit(0).alias("at"), F.array().cast(f"array<{kind}>").alias("out"))
        return F.aggregate(pieces, none, piece, lambda s: F.flatten(s["out"]))

    def paired(found: Column) -> Column:
        return F.zip_with(F.slice(between, F.lit(1), F.size(found)), found, lambda b, m: F.struct(b.alias("b"), m.alias("m")))

    return F.when(text.rlike(pattern), bound(bound(found, paired), walk)).otherwise(F.array().cast(kind))


#: Terms n log2 n as whole numbers of 2^-32 bits, so that sums never drift.
_UNIT = 1 << 32
_TERMS = [round(n * log2(n) * _UNIT) if n else 0 for n in range(WINDOW + 1)]
#: Counts stand five bits each, twelve to a word, by the character's place from FIRST on.
FIRST, BITS, PER_WORD, WORDS = ord("+"), 5, 12, (ord("z") - ord("+")) // 12 + 1


def _most_sum(candidate: Column) -> Column:
    """What the sum of a window's terms must be under for its entropy to be over the candidate's limit."""
    most = lambda bits: F.lit(round(WINDOW * (log2(WINDOW) - bits) * _UNIT))
    out = most(ENTROPY_LIMITS[-1][1])
    for pattern, bits in reversed(ENTROPY_LIMITS[:-1]):
        out = F.when(candidate.rlike(pattern), most(bits)).otherwise(out)
    return out


def entropy_reach(candidate: Column) -> Column:
    """struct<first, last>: the places in a candidate that windows over its limit reach from and to; nulls if none.

    The state holds the counts of the window's characters and the sum of n log2 n
    over them; a step takes one character in and lets one go.
    """
    growth = F.array(*[F.lit(b - a) for a, b in zip(_TERMS, _TERMS[1:])])
    shift = lambda name, word, k: F.call_function(name, word, (k % PER_WORD * BITS).cast("int"))
    word_of = lambda k: F.floor(k / PER_WORD).cast("int")
    count = lambda words, k: shift("shiftright", F.get(words, word_of(k)), k).bitwiseAND(F.lit(31)).cast("int")
    one = lambda k: shift("shiftleft", F.lit(1).cast("long"), k)

    def walk(codes: Column, most: Column) -> Column:
        earlier = F.concat(F.array_repeat(F.lit(-1), WINDOW), codes)
        pairs = F.slice(F.zip_with(codes, earlier, lambda c, g: F.struct(c.alias("comes"), g.alias("goes"))), F.lit(1), F.size(codes))

        def step(st: Column, p: Column) -> Column:
            comes, goes = p["comes"], p["goes"]
            full = goes >= 0
            n_in = count(st["words"], comes) - F.when(full & (comes == goes), 1).otherwise(0)
            less = F.when(full, F.get(growth, count(st["words"], goes) - 1)).otherwise(F.lit(0).cast("long"))
            words = F.transform(
                st["words"],
                lambda w, i: w + F.when(i == word_of(comes), one(comes)).otherwise(0) - F.when(full & (i == word_of(goes)), one(goes)).otherwise(0),
            )
            moved = F.struct((st["at"] + 1).alias("at"), words.alias("words"), (st["sum"] - less + F.get(growth, n_in)).alias("sum"))

            def judged(m: Column) -> Column:
                over = (m["at"] >= WINDOW) & (m["sum"] < most)
                return F.struct(
                    m["at"].alias("at"),
                    m["words"].alias("words"),
                    m["sum"].alias("sum"),
                    F.when(over, F.coalesce(st["first"], m["at"] - WINDOW)).otherwise(st["first"]).alias("first"),
                    F.when(over, m["at"]).otherwise(st["last"]).alias("last"),
                )

            return bound(moved, judged)

        nothing = F.lit(None).cast("int")
        zero = F.lit(0).cast("long")
        start = F.struct(
            F.lit(0).alias("at"), F.array_repeat(zero, WORDS).alias("words"), zero.alias("sum"), nothing.alias("first"), nothing.alias("last")
        )
        return F.aggregate(pairs, start, step, lambda s: F.struct(s["first"].alias("first"), s["last"].alias("last")))

    codes = F.transform(F.split(candidate, ""), lambda c: F.ascii(c) - FIRST)
    both = F.struct(codes.alias("codes"), _most_sum(candidate).alias("most"))
    return bound(both, lambda b: walk(b["codes"], b["most"]))


def scan_secrets(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``id_col``, ``findings`` array<struct<start, rank, end>> sorted by place (rank: the kind's place in KINDS)."""

    def spans(col: str, rank: int) -> Column:
        return F.transform(col, lambda x: F.struct(x["s"].alias("start"), F.lit(rank).alias("rank"), x["e"].alias("end")))

    text = F.coalesce(F.col(text_col), F.lit(""))
    value = lambda x: F.length(F.regexp_extract(x["m"], ASSIGN, 1)) >= ASSIGN_VALUE
    found = docs.select(
        F.col(id_col).alias("_id"),
        F.filter(located(text, ASSIGN), value).alias("assign"),
        located(text, ACCESS).alias("access"),
        located(text, HEX).alias("hex"),
        F.filter(located(text, CANDIDATE), lambda x: ~x["m"].rlike(ALLOWED)).alias("candidates"),
    )
    reached = F.transform("candidates", lambda x: F.struct(x["s"].alias("at"), entropy_reach(x["m"]).alias("r")))
    entropy = F.transform(
        F.filter("reached", lambda x: x["r"]["first"].isNotNull()),
        lambda x: F.struct((x["at"] + x["r"]["first"]).alias("s"), (x["at"] + x["r"]["last"]).alias("e")),
    )
    found = found.withColumn("reached", reached).withColumn("entropy", entropy)
    parts = [spans(kind, rank) for rank, kind in enumerate(KINDS)]
    return found.select(F.col("_id").alias(id_col), F.array_sort(F.concat(*parts)).alias("findings"))


def _joined(findings: Column) -> Column:
    names = F.array(*map(F.lit, KINDS))
    return F.array_join(F.transform(findings, lambda x: F.concat_ws(":", F.get(names, x["rank"]), x["start"], x["end"])), ",")


def secret_digests(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row per document: counts by kind, the digest of the base spans, and all spans."""
    found = scan_secrets(docs, id_col, text_col)
    count = lambda rank: F.size(F.filter("findings", lambda x: x["rank"] == rank)).cast("long")
    return found.select(
        id_col,
        *[count(rank).alias(f"n_{kind}") for rank, kind in enumerate(KINDS)],
        F.sha2(_joined(F.filter("findings", lambda x: x["rank"] < 3)), 256).alias("base_sha256"),
        _joined(F.col("findings")).alias("spans"),
    )
