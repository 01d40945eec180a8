"""Sampling for models, folds, cross-validation and permutation importance."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..shipping import ship
from .boosting import Trees, r2
from .ranking import global_rank


def hashed_sample(rows: DataFrame, keys: list[str], n: int, seed: int = 0) -> DataFrame:
    """``n`` rows without replacement, the same for the same keys and seed."""
    return rows.orderBy(F.xxhash64(F.lit(seed), *keys), *keys).limit(n)


def block_folds(rows: DataFrame, block: str, folds: int = 5) -> DataFrame:
    """(block, n, fold): blocks from the largest down, dealt to and fro over the folds, so sizes stay level."""
    sizes = rows.groupBy(block).agg(F.count(F.lit(1)).alias("n"))
    k = F.col("_place") - 1
    turn, place = F.floor(k / folds) % 2, k % folds
    return global_rank(sizes, [F.desc("n"), block], "_place").select(block, "n", F.when(turn == 0, place).otherwise(folds - 1 - place).cast("int").alias("fold"))


def random_folds(rows: DataFrame, keys: list[str], folds: int = 5, seed: int = 0) -> DataFrame:
    return rows.withColumn("fold", F.pmod(F.xxhash64(F.lit(seed), *keys), F.lit(folds)).cast("int"))


def _sorted(table: pa.Table, columns: list[str]) -> dict[str, np.ndarray]:
    """Columns as doubles, rows in one order whatever order they came in."""
    out = {c: table.column(c).cast(pa.float64()).to_numpy() for c in columns}
    order = np.lexsort([out[c] for c in reversed(columns)])
    return {c: v[order] for c, v in out.items()}


def _fitted(data: dict[str, np.ndarray], keep: np.ndarray, features: list[str], target: str, trees: int, categories: list[str]) -> Trees:
    x = np.stack([data[f][keep] for f in features], 1)
    return Trees().fit(x, data[target][keep], trees, tuple(features.index(c) for c in categories))


def _matrix(data: dict[str, np.ndarray], features: list[str]) -> np.ndarray:
    return np.stack([data[f] for f in features], 1)


def cross_validate(
    rows: DataFrame, features: list[str], target: str, fold: str = "fold", trees: int = 300, folds: int = 5, categories: list[str] | None = None
) -> DataFrame:
    """(fold, n, r2) of boosted trees, each fold held out once; the folds' models are fitted side by side.

    ``rows`` is a sample of at most ``boosting.MOST_ROWS`` rows, since a task holds it.
    """
    ship(rows.sparkSession)
    columns = [*features, target, fold]

    def held_out(key: tuple, table: pa.Table) -> pa.Table:
        k = key[0].as_py()
        data = _sorted(table, columns)
        test = data[fold] == k
        if not test.any():
            return pa.table({"fold": pa.array([], pa.int32()), "n": pa.array([], pa.int64()), "r2": pa.array([], pa.float64())})
        model = _fitted(data, ~test, features, target, trees, categories or [])
        score = r2(data[target][test], model.predict(_matrix(data, features)[test]))
        return pa.table({"fold": pa.array([k], pa.int32()), "n": pa.array([int(test.sum())], pa.int64()), "r2": pa.array([score])})

    each = rows.select(*columns, F.explode(F.sequence(F.lit(0), F.lit(folds - 1))).alias("_model"))
    return each.groupBy("_model").applyInArrow(held_out, "fold int, n long, r2 double")


def permutation_importance(
    rows: DataFrame,
    features: list[str],
    target: str,
    keys: list[str],
    fold: str = "fold",
    trees: int = 300,
    repeats: int = 5,
    seed: int = 0,
    categories: list[str] | None = None,
) -> DataFrame:
    """(feature, importance, std): the loss of R2 on fold 0 when a feature's values change places.

    ``rows`` is a sample of at most ``boosting.MOST_ROWS`` rows; ``keys`` put them in an order of their own.
    """
    ship(rows.sparkSession)
    columns = [*keys, *features, target, fold]

    def losses(table: pa.Table) -> pa.Table:
        data = _sorted(table, columns)
        test = data[fold] == 0
        model = _fitted(data, ~test, features, target, trees, categories or [])
        x, y = _matrix(data, features)[test], data[target][test]
        base = r2(y, model.predict(x))
        rng = np.random.default_rng(seed)
        mean, std = [], []
        for f in range(len(features)):
            lost = []
            for _ in range(repeats):
                moved = x.copy()
                moved[:, f] = rng.permutation(moved[:, f])
                lost.append(base - r2(y, model.predict(moved)))
            mean.append(float(np.mean(lost)))
            std.append(float(np.std(lost)))
        return pa.table({"feature": features, "importance": mean, "std": std})

    made = rows.select(*columns).groupBy(F.lit(0).alias("_sample")).applyInArrow(losses, "feature string, importance double, std double")
    return made.select("feature", F.bround("importance", 4).alias("importance"), F.bround("std", 4).alias("std"))


def fit_trees(rows: DataFrame, features: list[str], target: str, trees: int = 300, categories: list[str] | None = None) -> DataFrame:
    """``rows`` with ``prediction``: boosted trees fitted on all of them, a sample of at most ``boosting.MOST_ROWS`` rows."""
    ship(rows.sparkSession)
    names = rows.columns

    def predicted(table: pa.Table) -> pa.Table:
        data = {c: table.column(c).cast(pa.float64()).to_numpy() for c in [*features, target]}
        order = np.lexsort([data[c] for c in (target, *features)])
        model = _fitted({c: v[order] for c, v in data.items()}, np.ones(len(order), bool), features, target, trees, categories or [])
        return table.select(names).append_column("prediction", pa.array(model.predict(_matrix(data, features))))

    schema = ", ".join(f"`{n}` {t}" for n, t in rows.dtypes) + ", prediction double"
    return rows.groupBy(F.lit(0).alias("_sample")).applyInArrow(predicted, schema)
