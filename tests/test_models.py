"""The registered model queries run the operators' whole job."""

import inspect
from pathlib import Path

import pytest

from cinderspark.operators import validation
from cinderspark.plans import registry

DATA = Path("/root/testdata/sf0.001")
pytestmark = pytest.mark.skipif(not DATA.exists(), reason="the test tables are absent")
SCHEMAS = {
    "fit_trees": "y long, x long, dnbr double, prediction double",
    "cross_validate": "fold int, n long, r2 double",
    "permutation_importance": "feature string, importance double, std double",
}


@pytest.mark.parametrize("name", ["m1_boosted_trees", "m2_cross_validation", "m3_permutation_importance", "t8_importance_order"])
def test_trees_and_repeats_of_the_reference(spark, monkeypatch, name):
    asked = []
    for f, schema in SCHEMAS.items():
        shape = inspect.signature(getattr(validation, f))

        def note(*args, shape=shape, schema=schema, **options):
            bound = shape.bind(*args, **options)
            bound.apply_defaults()
            asked.append((bound.arguments["trees"], bound.arguments.get("repeats", 5)))
            return spark.createDataFrame([], schema)

        monkeypatch.setattr(validation, f, note)
    registry.plans[name](spark, str(DATA))
    assert asked and set(asked) == {(300, 5)}


def sample(spark, n=3000):
    import numpy as np

    rng = np.random.default_rng(9)
    x, z, fuel = rng.normal(size=n), rng.normal(size=n), rng.integers(0, 4, n)
    y = np.where(x > 0, 2.0, -1.0) + np.array([0.0, 3.0, -2.0, 0.5])[fuel] + 0.1 * rng.normal(size=n)
    rows = [(k, k // 100, *map(float, v)) for k, v in enumerate(zip(x, z, fuel, y))]
    return spark.createDataFrame(rows, "k long, block long, x double, z double, fuel double, y double"), (x, z, fuel, y)


def test_one_cut_is_the_best_cut():
    """A tree of one level against all cuts of all features."""
    import numpy as np

    from cinderspark.operators.boosting import Trees

    rng = np.random.default_rng(1)
    x = np.round(rng.normal(size=(200, 3)), 1)
    y = x[:, 1] ** 2 + 0.3 * rng.normal(size=200)
    model = Trees(rate=1.0, depth=1, least=5).fit(x, y, 1)
    best = min(
        ((y[left] - y[left].mean()) ** 2).sum() + ((y[~left] - y[~left].mean()) ** 2).sum()
        for f in range(3)
        for left in (x[:, f] <= v for v in np.unique(x[:, f])[:-1])
        if min(left.sum(), (~left).sum()) >= 5
    )
    assert ((y - model.predict(x)) ** 2).sum() == pytest.approx(best)
    group = rng.integers(0, 6, 300)
    y = np.array([5.0, 0, 5, 0, 5, 0])[group]
    one = Trees(rate=1.0, depth=1).fit(group[:, None].astype(float), y, 1, categories=(0,))
    assert one.predict(group[:, None].astype(float)) == pytest.approx(y)  # categories part in any way
    assert Trees().fit(np.zeros((0, 2)), np.zeros(0), 5).predict(np.ones((1, 2))).tolist() == [0.0]
    with pytest.raises(ValueError):
        Trees().fit(np.zeros((500_001, 1)), np.zeros(500_001), 1)


def test_trees_folds_and_importance(spark):
    rows, (x, z, fuel, y) = sample(spark)
    fitted = validation.fit_trees(rows, ["x", "z", "fuel"], "y", trees=60, categories=["fuel"])
    assert fitted.columns == [*rows.columns, "prediction"] and fitted.count() == 3000
    assert sum((r.prediction - r.y) ** 2 for r in fitted.collect()) < 0.03 * ((y - y.mean()) ** 2).sum()
    folds = validation.block_folds(rows, "block")
    sizes = {r.fold: r.n for r in folds.groupBy("fold").sum("n").withColumnRenamed("sum(n)", "n").collect()}
    assert sorted(sizes) == [0, 1, 2, 3, 4] and set(sizes.values()) == {600}
    blocked = rows.join(folds.select("block", "fold"), "block")
    scores = validation.cross_validate(blocked, ["x", "z", "fuel"], "y", trees=60, categories=["fuel"]).collect()
    assert sorted(r.fold for r in scores) == [0, 1, 2, 3, 4] and sum(r.n for r in scores) == 3000 and min(r.r2 for r in scores) > 0.95
    loss = {r.feature: r.importance for r in validation.permutation_importance(blocked, ["x", "z", "fuel"], "y", ["k"], trees=60, categories=["fuel"]).collect()}
    assert loss["fuel"] > 0.3 and loss["x"] > 0.3 and abs(loss["z"]) < 0.05


def test_hashed_sample(spark):
    rows = spark.range(5000).withColumnRenamed("id", "k")
    first = sorted(r.k for r in validation.hashed_sample(rows, ["k"], 700).collect())
    assert len(set(first)) == 700 and first == sorted(r.k for r in validation.hashed_sample(rows.repartition(7), ["k"], 700).collect())
    assert first != sorted(r.k for r in validation.hashed_sample(rows, ["k"], 700, seed=1).collect())
    assert 2200 < sum(first) / 700 < 2800 and validation.hashed_sample(rows, ["k"], 9999).count() == 5000


def test_chip_choice(spark):
    import numpy as np

    from cinderspark.operators import morphology as M
    from cinderspark.plans.shape_plans import MIN_PURITY, pick_at_size

    rng = np.random.default_rng(3)
    for share in (0.97, 0.75, 0.55):
        c = np.zeros((20, 24), bool)
        c[3:15, 4:20] = rng.random((12, 16)) < share
        burnt = rng.random(c.shape) < 0.4
        frame = lambda m: spark.createDataFrame([(y, x, bool(v)) for (y, x), v in np.ndenumerate(m)], "y long, x long, m boolean")
        patch = {(r.y, r.x) for r in M.largest(frame(c)).collect()}
        size = 4
        pad = np.pad

        def around(m, y, x):
            wide = pad(m, size)
            return wide[y + size - 2 : y + size + 2, x + size - 2 : x + size + 2].mean()

        purity = {p: around(c, *p) for p in patch}
        middle = tuple(int(np.rint(np.mean([p[k] for p in patch]))) for k in (0, 1))
        enough = [p for p in patch if purity[p] >= MIN_PURITY]
        if middle in enough:
            want, how = middle, "centroid"
        elif enough:
            want, how = min(enough, key=lambda p: (-around(burnt, *p), p)), "burnt-in-patch"
        else:
            want, how = min(patch, key=lambda p: (-purity[p], p)), "purest-in-patch"
        got = pick_at_size(frame(c), frame(burnt), size).first()
        assert (got.y, got.x, got.how) == (*want, how) and got.purity == pytest.approx(purity[want])
