"""Fits in tasks against Spark ML's and against their definitions."""

import numpy as np
import pytest
from pyspark.ml import Estimator
from pyspark.ml.classification import DecisionTreeClassifier, GBTClassifier, OneVsRest
from pyspark.sql import functions as F

from gaugewright.operators import fits, folds, models


@pytest.fixture(scope="module")
def rows(spark):
    rng = np.random.default_rng(3)
    x = rng.normal(size=(240, 5))
    y = (x[:, 0] + 0.5 * x[:, 1] ** 2 + 0.3 * rng.normal(size=240) > 0.3).astype(int) + (x[:, 2] > 1)
    return spark.createDataFrame([(i, a, int(b)) for i, (a, b) in enumerate(zip(x.tolist(), y.tolist(), strict=True))], "row long, features array<double>, label long").persist()


@pytest.mark.parametrize("name", ["rf", "gb", "svm", "dt"])
def test_no_jobs_for_levels_and_stages(spark, rows, monkeypatch, name):
    """A fold of a small table is fitted without Spark ML, whose jobs took the time; each row is predicted once."""
    monkeypatch.setattr(Estimator, "fit", lambda *_: pytest.fail("a Spark ML fit"))
    found, times = models.out_of_fold(rows, folds.folds(rows, "row", "label", n_splits=2, n_repetitions=1), "row", [name])
    assert [t["error"] for t in times] == [None, None]
    got = found.collect()
    assert sorted(r["row_id"] for r in got) == list(range(240))
    assert np.mean([r["y_true"] == r["y_pred"] for r in got]) > (0.6 if name == "svm" else 0.75)
    assert all((r["proba"] is None) == (name in ("svm", "gb")) for r in got) and all(r["proba"] is None or sum(r["proba"]) == pytest.approx(1) for r in got)


@pytest.mark.parametrize("kind", ["tree", "boosted"])
def test_same_as_spark(spark, rows, monkeypatch, kind):
    """Predictions alone: Spark ML merges leaves of one prediction, which changes shares."""
    known = models.ModelRegistry()
    known.register("m", lambda: DecisionTreeClassifier(maxDepth=4, seed=1) if kind == "tree" else OneVsRest(classifier=GBTClassifier(maxIter=4, maxDepth=2, seed=1)))
    assigned = folds.folds(rows, "row", "label", n_splits=2, n_repetitions=1)
    here = {r["row_id"]: r for r in models.out_of_fold(rows, assigned, "row", ["m"], registry=known)[0].collect()}
    monkeypatch.setattr(fits, "FIT_BYTES", 0)
    there = {r["row_id"]: r for r in models.out_of_fold(rows, assigned, "row", ["m"], registry=known)[0].collect()}
    assert len(here) == len(there) == 240
    assert {(i, r["y_true"], r["y_pred"]) for i, r in here.items()} == {(i, r["y_true"], r["y_pred"]) for i, r in there.items()}


def test_both_ways_to_split():
    rng = np.random.default_rng(5)
    node = np.sort(rng.integers(0, 7, 500))
    bins, label = rng.integers(0, 9, 500), rng.integers(0, 4, 500)
    table = np.bincount(node * 4 + label, minlength=28).reshape(7, 4)
    given = (bins, node, label, table, table.sum(axis=1), (table**2).sum(axis=1), 9)
    counted = {(n, b): s for n, b, s in zip(*fits._by_counts(*given), strict=True)}
    for n, b, s in zip(*fits._by_order(*given), strict=True):
        inside = node == n
        parts = [np.bincount(label[inside & side], minlength=4) for side in (bins <= b, bins > b)]
        assert s == pytest.approx(sum((p**2).sum() / p.sum() for p in parts)) == counted[n, b]


def test_machine_is_optimal():
    rng = np.random.default_rng(2)
    x = rng.normal(size=(150, 4)) * [1, 5, 0.1, 1]
    x[:, 3] = 2.0
    y = x[:, 0] + x[:, 1] / 5 + rng.normal(size=150) > 0.5
    w, b = fits.machine(x, y, 1 / 150)
    scale = np.append(x[:, :3].std(axis=0, ddof=1), 1.0)
    loss = lambda v, c: ((v * scale) ** 2).sum() / 2 + np.maximum(0, 1 - np.where(y, 1, -1) * (x @ v + c)).sum()
    least = loss(w, b)
    assert w[3] == 0
    for size in (1e-1, 1e-2, 1e-3):
        for _ in range(100):
            assert loss(w + size * np.append(rng.normal(size=3), 0) / scale, b + size * rng.normal()) >= least - 1e-7


def test_other_tables_and_models(spark, rows, monkeypatch):
    """Larger tables, unknown parameters, gaps and odd labels are left to Spark ML."""
    assigned = folds.folds(rows, "row", "label", n_splits=2, n_repetitions=1)
    assert fits.collected(rows, assigned, "row") is not None
    assert fits.collected(rows.withColumn("label", F.col("label") + 0.5), assigned, "row") is None
    assert fits.collected(rows.withColumn("features", F.when(F.col("row") > 3, F.col("features")).otherwise(F.array(F.lit(1.0)))), assigned, "row") is None
    assert fits.collected(rows.withColumn("features", F.transform("features", lambda v: F.when(v < 1, v))), assigned, "row") is None
    assert fits.plan(DecisionTreeClassifier(impurity="entropy")) is None and fits.plan(GBTClassifier()) is None
    monkeypatch.setattr(fits, "FIT_BYTES", 1000)
    assert fits.collected(rows, assigned, "row") is None


def test_one_job_for_all_folds(spark, rows):
    """Fits to a small table are one table's plan, whatever the number of folds; the driver holds features no wider than they are."""
    narrow = rows.withColumn("features", F.col("features").cast("array<float>")).orderBy(F.desc("row"))
    assigned = folds.folds(narrow, "row", "label", n_splits=3, n_repetitions=2)
    table, keys = fits.collected(narrow, assigned, "row")
    want = narrow.orderBy("row").collect()
    assert table.x.dtype == np.float32 and keys.to_pylist() == [r["row"] for r in want]
    assert table.x.tolist() == [r["features"] for r in want] and table.y.tolist() == [r["label"] for r in want]
    assert {(r["row"], r["repetition_id"], r["fold_id"]) for r in assigned.collect()} == {(i, k, int(table.fold[k, i])) for i in range(240) for k in range(2)}
    assert fits.collected(narrow, assigned.unionByName(assigned.limit(1)), "row") is None
    found, times = models.out_of_fold(narrow, assigned, "row", ["dt", "svm"])
    assert "Union" not in found._jdf.queryExecution().logical().toString()
    assert found.groupBy("model", "repetition_id").agg(F.countDistinct("row_id").alias("n")).where("n = 240").count() == 4 == found.count() / 240
    assert len(times) == 12 and all(t["error"] is None and t["train_time"] > 0 and t["eval_time"] > 0 for t in times)


def test_half_the_sums_of_boosted_trees(monkeypatch):
    """Rows are counted once for all trees, and of two children the smaller alone is summed: three passes of all columns a tree instead of six."""
    rng = np.random.default_rng(4)
    x = rng.normal(size=(4000, 6))
    y = x[:, 0] + x[:, 1] * x[:, 2] + rng.normal(size=4000) > 0
    codes = fits.binned(x, [fits.thresholds(c, 32) for c in x.T])
    read, plain = [], np.bincount
    monkeypatch.setattr(np, "bincount", lambda a, *b, **c: (read.append(len(a)), plain(a, *b, **c))[1])
    margins = fits.boosted(codes, y, codes, 20, 3, 0.1, 32)
    assert ((margins > 0) == y).mean() > 0.7
    assert sum(read) < 20 * 6 * 4000 * 5


def test_repeated_rows_are_one(monkeypatch):
    """A forest's tree from how often rows were drawn, by either way to split, is that from the rows themselves; only drawn rows are sorted."""
    rng = np.random.default_rng(6)
    x, y = rng.normal(size=(3000, 5)).round(1), rng.integers(0, 4, 3000)
    fold = np.where(np.arange(3000) < 600, 1, 0)[None, :].astype(np.int32)
    made = {"kind": "RandomForestClassifier", "numTrees": 2, "maxDepth": 30, "maxBins": 32, "seed": 7}
    read, plain = [], fits._best
    monkeypatch.setattr(fits, "_best", lambda codes, rows, *a: (read.append(len(rows)), plain(codes, rows, *a))[1])
    out = fits.part(fits.Table(x, y, fold), made, 0, 1, 0)
    assert max(read) < 0.7 * 2400
    known = fold[0] == 0
    cuts = [fits.thresholds(c, 32) for c in x[known].T]
    codes, seen = fits.binned(x[known], cuts), fits.binned(x[~known], cuts)
    want = np.zeros_like(out)
    for t in range(2):
        draws = np.random.default_rng([7, 0, 1, t])
        rows = draws.integers(0, 2400, 2400)
        want += fits.grow(codes[:, rows], y[known][rows], 4, 30, 3, draws)(seen)
    assert np.array_equal(out, want)


def test_room_for_narrow_features(spark, rows, monkeypatch):
    """Features count as wide as they are: 120,000 rows of 64 floats and 10 classes, at which Spark ML took over, fit a task."""
    assert 120_000 * (64 * 4 + 8 * (9 + 8)) <= fits.FIT_BYTES
    assigned = folds.folds(rows, "row", "label", n_splits=2, n_repetitions=1)
    monkeypatch.setattr(fits, "FIT_BYTES", 240 * 8 * (5 + 2 + 8) - 1)
    assert fits.collected(rows, assigned, "row") is None
    assert fits.collected(rows.withColumn("features", F.col("features").cast("array<float>")), assigned, "row") is not None
