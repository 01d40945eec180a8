"""Exact percentiles of groups of any size, with linear interpolation between closest ranks.

The built-in exact percentile holds every distinct value of a group in one
buffer, which is right for groups of up to SMALL rows.  For larger ones the
wanted ranks are searched: a bracket of values is cut into PARTS equal parts, one
pass counts each part and notes its least and largest value, and the part that
holds the rank becomes the bracket.  A bracket's ends are values that occur and
stand in different parts, so each pass shrinks it, until both ends are the same
value.  What reaches the driver is counts, never values by the row; groups of
over SMALL rows are at most as many as all rows make.
"""

from __future__ import annotations

from math import ceil, floor

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..scratch import staged

#: Rows of a group whose values may stand in one buffer.
SMALL = 1_000_000
#: Parts that a bracket is cut into.
PARTS = 512


def exact_quantiles(rows: DataFrame, keys: list[str], wanted: dict[str, list[float]], small: int = SMALL) -> DataFrame:
    """``keys``, and for each column of ``wanted`` an array<double> under its name, in the order of its percentiles.

    Missing values don't count; a group without values gives nulls.  Without keys there is one group, of all rows.
    """
    known = rows.select(*keys, *[F.col(c).cast("double").alias(c) for c in wanted])
    large = known.groupBy(*keys).agg(F.count(F.lit(1)).alias("_n"), *[F.count(c).alias(f"_n_{c}") for c in wanted]).where(F.col("_n") > small).collect()
    every = [_builtin(c, qs).alias(c) for c, qs in wanted.items()]
    if not large:
        return known.groupBy(*keys).agg(*every)
    known = staged(known, "quantiles")
    shape = _shape(known, keys)
    sizes = {tuple(r[k] for k in keys): r for r in large}
    found: dict[tuple, list[list[float | None]]] = {g: [] for g in sizes}
    for c, qs in wanted.items():
        ranks = {(g, n): r[f"_n_{c}"] for g, r in sizes.items() for q in qs if r[f"_n_{c}"] for n in _ranks(q, r[f"_n_{c}"])}
        values = _at_ranks(known, keys, c, ranks)
        for g, r in sizes.items():
            found[g].append([_between(q, r[f"_n_{c}"], values, g) if r[f"_n_{c}"] else None for q in qs])
    spark = rows.sparkSession
    out = spark.createDataFrame([(*g, *v) for g, v in found.items()], shape + ", ".join(f"{c} array<double>" for c in wanted))
    if not keys:
        return out
    rest = known.join(F.broadcast(spark.createDataFrame(list(sizes), _shape(known, keys, "_g_").rstrip(", "))), _same(keys), "left_anti")
    return out.unionByName(rest.groupBy(*keys).agg(*every))


def _builtin(column: str, qs: list[float]) -> Column:
    blank = F.array(*[F.lit(None).cast("double") for _ in qs])
    return F.coalesce(F.percentile(column, F.array(*map(F.lit, qs))), blank)


def _shape(known: DataFrame, keys: list[str], name: str = "") -> str:
    return "".join(f"{name}{f.name} {f.dataType.simpleString()}, " for f in known.select(*keys).schema.fields)


def _same(keys: list[str]) -> Column:
    """The group of a row is that of a bracket, whose keys carry a prefix; missing keys are a group like any other."""
    match = F.lit(True)
    for k in keys:
        match = match & F.col(k).eqNullSafe(F.col(f"_g_{k}"))
    return match


def _ranks(q: float, n: int) -> tuple[int, int]:
    return floor(q * (n - 1)), ceil(q * (n - 1))


def _between(q: float, n: int, values: dict, group: tuple) -> float:
    low, high = _ranks(q, n)
    a, b = values[group, low], values[group, high]
    return a + (b - a) * (q * (n - 1) - low)


def _at_ranks(known: DataFrame, keys: list[str], column: str, ranks: dict[tuple, int]) -> dict[tuple, float]:
    """The values at 0-based ranks of groups."""
    spark = known.sparkSession
    values = known.where(F.col(column).isNotNull()).select(*keys, F.col(column).alias("_v"))
    ends = values.groupBy(*keys).agg(F.min("_v").alias("low"), F.max("_v").alias("high")).collect()
    of_group = {tuple(r[k] for k in keys): (r.low, r.high) for r in ends}
    # (group, rank) -> bracket, and the values below it
    open_ = {at: (*of_group[at[0]], 0) for at in ranks}
    found: dict[tuple, float] = {}
    while open_:
        for at in [at for at, (low, high, _) in open_.items() if low == high]:
            found[at] = open_.pop(at)[0]
        if not open_:
            break
        brackets = sorted({(at[0], low, high) for at, (low, high, _) in open_.items()}, key=str)
        frame = spark.createDataFrame([(*g, k, low, high) for k, (g, low, high) in enumerate(brackets)], _shape(known, keys, "_g_") + "_k int, _low double, _high double")
        inside = values.join(F.broadcast(frame), _same(keys)).where("_v >= _low AND _v <= _high")
        # halves, so that the widest bracket doesn't overflow; the narrowest has no width in floating point
        width = F.col("_high") / 2 - F.col("_low") / 2
        share = F.when(width > 0, (F.col("_v") / 2 - F.col("_low") / 2) / width).otherwise((F.col("_v") > F.col("_low")).cast("double"))
        part = F.least(F.floor(share * PARTS), F.lit(PARTS - 1))
        counts = inside.groupBy("_k", part.alias("_part")).agg(F.count(F.lit(1)).alias("n"), F.min("_v").alias("low"), F.max("_v").alias("high")).collect()
        parts: dict[int, list] = {}
        for r in sorted(counts, key=lambda r: (r["_k"], r["_part"])):
            parts.setdefault(r["_k"], []).append(r)
        of_bracket = {b: parts[k] for k, b in enumerate(brackets)}
        for at, (low, high, below) in open_.items():
            for r in of_bracket[at[0], low, high]:
                if at[1] < below + r.n:
                    open_[at] = (r.low, r.high, below)
                    break
                below += r.n
    return found
