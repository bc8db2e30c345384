"""Summaries, scores, metrics and statistics against golden values and brute force."""

import itertools
import math

import numpy as np
import pytest
from pyspark.sql import functions as F

from gaugewright.functions import distributions
from gaugewright.operators import composite, robustness, scoring, significance, summary

DEMO = [  # f1, roc_auc, accuracy, precision, recall, total_time, stability_score, cv
    ("LogisticRegression", 0.85, 0.89, 0.86, 0.84, 0.86, 0.05, 0.95, 0.02),
    ("RandomForest", 0.92, 0.94, 0.91, 0.90, 0.92, 0.5, 0.90, 0.03),
    ("SVM", 0.88, 0.90, 0.87, 0.86, 0.88, 2.0, 0.92, 0.025),
]


@pytest.fixture(scope="module")
def parts(spark):
    return spark.createDataFrame([("demo", *r) for r in DEMO], "dataset string, model string, f1 double, roc_auc double, accuracy double, precision double, recall double, total_time double, stability_score double, cv double")


@pytest.fixture(scope="module")
def frame(parts):
    return composite.scored(composite.normalize(composite.raw_scores(parts, ["dataset", "model"])))


def matrix(spark, rows, names="abcdefghij"):
    return spark.createDataFrame([("x", i, names[j], float(v)) for i, r in enumerate(rows) for j, v in enumerate(r)], "dataset string, obs int, model string, score double")


def test_composite_golden(frame):
    got = {r["model"]: r for r in frame.collect()}
    for model, cbs in (("LogisticRegression", 0.2), ("RandomForest", 0.853846153846), ("SVM", 0.295238095238)):
        assert got[model]["cbs"] == pytest.approx(cbs, abs=1e-10)
    assert got["RandomForest"]["time_score"] == pytest.approx(0.538461538, abs=1e-8)
    assert got["SVM"]["stability_score"] == pytest.approx(0.4)
    assert [r["model"] for r in composite.top(frame, 1).collect()] == ["RandomForest"]


def test_minmax_rules(spark):
    df = spark.createDataFrame([("a", "m1", 1.0), ("a", "m2", None), ("a", "m3", 3.0), ("b", "m1", 2.0), ("c", "m1", None)], "dataset string, model string, v double")
    got = {(r["dataset"], r["model"]): r["x"] for r in df.withColumn("x", composite.minmax(F.col("v"), ["dataset"])).collect()}
    assert got == {("a", "m1"): 0.0, ("a", "m2"): 0.5, ("a", "m3"): 1.0, ("b", "m1"): 1.0, ("c", "m1"): 0.5}
    with pytest.raises(ValueError, match="positive"):
        composite.normalized_weights({"a": 0.0})


def test_monte_carlo_golden(frame):
    got = {r["model"]: r["mean_rank"] for r in robustness.monte_carlo(frame, robustness.dirichlet_weights(frame.sparkSession, 5000)).collect()}
    assert got == {"LogisticRegression": pytest.approx(2.8208), "RandomForest": pytest.approx(1.0016), "SVM": pytest.approx(2.1776)}


def test_weight_grid_and_audit(frame, parts):
    assert robustness.weight_grid(frame).count() == 126
    audit = {r["metric"]: r for r in robustness.normalization_audit(parts, frame).collect()}
    assert all(r["rank_correlation"] == pytest.approx(1.0) for r in audit.values())
    assert robustness.redundancy(frame).count() == 20


def test_stability(spark):
    long = spark.createDataFrame([("d", "m", 0, i, "f1", v) for i, v in enumerate([0.85, 0.87, 0.84, 0.88, 0.86])] + [("d", "z", 0, 0, "f1", None), ("d", "z", 0, 1, "f1", 0.0)], "dataset string, model string, repetition_id int, fold_id int, metric string, value double")
    got = {r["model"]: r for r in summary.stability(long, ["dataset", "model"]).collect()}
    assert got["m"]["mean"] == pytest.approx(0.86) and got["m"]["std"] == pytest.approx(0.0141421, abs=1e-6)
    assert got["z"]["cv"] == 0 and got["z"]["n"] == 1
    levels = {r["model"]: r["mean"] for r in summary.summarize_levels(long, ["dataset", "model"]).where("level = 'overall'").collect()}
    assert levels["z"] is None
    assert {r["model"]: r["best_fold"] for r in summary.best_worst(long, ["dataset", "model"]).collect()} == {"m": 3, "z": 1}


def test_predictions(spark):
    y, p, s = [0, 1, 1, 0, 1, 0, 1, 1, 0, 1], [0, 1, 1, 0, 1, 1, 1, 1, 0, 1], [0.1, 0.8, 0.7, 0.15, 0.9, 0.4, 0.8, 0.7, 0.2, 0.9]
    df = spark.createDataFrame([("m", i, str(a), str(b), a, c) for i, (a, b, c) in enumerate(zip(y, p, s, strict=True))], "model string, row_id int, y_true string, y_pred string, positive int, score double")
    cells = {(r["y_true"], r["y_pred"]): r["n"] for r in scoring.confusion(df, ["model"]).collect()}
    assert cells == {("0", "0"): 3, ("0", "1"): 1, ("1", "0"): 0, ("1", "1"): 6}
    got = scoring.fold_metrics(df, ["model"]).first()
    assert got["accuracy"] == pytest.approx(0.9) and got["n_classes"] == 2
    assert got["mcc"] == pytest.approx(18 / math.sqrt(7 * 6 * 4 * 3))
    assert scoring.auc(df, ["model"]).first()["roc_auc"] == 1.0
    assert scoring.auc(df.where("positive = 1"), ["model"]).first()["roc_auc"] is None


def test_tied_auc(spark):
    rng = np.random.default_rng(0)
    rows = [("m", int(a), float(b)) for a, b in zip(rng.integers(0, 2, 200), rng.integers(0, 9, 200), strict=True)]
    pos, neg = [s for _, a, s in rows if a], [s for _, a, s in rows if not a]
    want = np.mean([(x > z) + 0.5 * (x == z) for x in pos for z in neg])
    assert scoring.auc(spark.createDataFrame(rows, "model string, positive int, score double"), ["model"]).first()["roc_auc"] == pytest.approx(want)


def test_holm(spark):
    df = spark.createDataFrame([("x", str(i), "b", p) for i, p in enumerate([0.01, 0.04, 0.03, 0.002])], "dataset string, model_a string, model_b string, p_value double")
    got = {r["model_a"]: (r["p_value_adj"], r["significant"]) for r in significance.holm(df, ["dataset"]).collect()}
    assert [got[str(i)][0] for i in range(4)] == pytest.approx([0.03, 0.06, 0.06, 0.008])
    assert [got[str(i)][1] for i in range(4)] == [True, False, False, True]


def test_corrected_t_golden(spark):
    scores = matrix(spark, zip([0.86, 0.85, 0.87, 0.84, 0.86], [0.91, 0.92, 0.90, 0.91, 0.93], [0.87, 0.88, 0.86, 0.87, 0.89], strict=True), ["LR", "RF", "SVM"])
    got = {(r["model_a"], r["model_b"]): r for r in significance.corrected_t(scores, n_splits=10).collect()}
    assert got["LR", "RF"]["p_value_raw"] == pytest.approx(0.00435913, abs=1e-7)
    assert got["LR", "SVM"]["p_value_raw"] == pytest.approx(0.145557, abs=1e-5)
    assert got["RF", "SVM"]["p_value_raw"] == 0 and got["RF", "SVM"]["statistic"] == float("inf")
    low, high = next((r["low"], r["high"]) for r in significance.t_interval(scores).collect() if r["model"] == "LR")
    assert (low, high) == pytest.approx((0.841843, 0.870157), abs=1e-6)
    with pytest.raises(ValueError, match="n_splits > 1"):
        significance.corrected_t(scores, n_splits=1)
    flat = significance.corrected_t(matrix(spark, [(0.5, 0.5)] * 3), n_splits=5).first()
    assert (flat["statistic"], flat["p_value_raw"], flat["significant"]) == (0.0, 1.0, False)


def test_friedman_and_ranks(spark):
    scores = matrix(spark, [(0.90, 0.90, 0.70), (0.80, 0.75, 0.75), (0.60, 0.60, 0.60), (0.95, 0.85, 0.85)])
    assert [r["average_rank"] for r in significance.average_ranks(scores).orderBy("model").collect()] == pytest.approx([1.375, 2.125, 2.5])
    plain = significance.friedman(matrix(spark, [(0.80, 0.78, 0.76), (0.82, 0.79, 0.77), (0.81, 0.80, 0.75), (0.83, 0.81, 0.78)])).first()
    assert plain["statistic"] == pytest.approx(8.0) and plain["p_value"] == pytest.approx(math.exp(-4))
    even = significance.friedman(matrix(spark, [(1, 2, 3, 4), (1, 2, 4, 3), (2, 1, 3, 4)])).first()
    assert even["df"] == 3 and even["p_value"] == pytest.approx(distributions.chi2_sf(even["statistic"], 3))


def test_alignment(spark):
    rows = [("x", o, m, float(o)) for m in "ab" for o in (2, 0, 1)] + [("x", 99, "a", 1.0)]
    assert significance.aligned(spark.createDataFrame(rows, "dataset string, obs int, model string, score double")).select("obs").distinct().count() == 3
    with pytest.raises(Exception, match="duplicate observation"):
        significance.aligned(spark.createDataFrame([*rows, ("x", 0, "a", 5.0)], "dataset string, obs int, model string, score double")).collect()


@pytest.mark.parametrize(("k", "alpha", "q"), [(3, 0.05, 2.343), (5, 0.05, 2.728), (10, 0.05, 3.164), (3, 0.10, 2.052), (5, 0.10, 2.459), (10, 0.10, 2.920)])
def test_nemenyi_constants(k, alpha, q):
    assert distributions.nemenyi_q(k, alpha) == pytest.approx(q, abs=1e-3)


def test_nemenyi_equal(spark):
    got = significance.nemenyi(matrix(spark, [[0.75] * 5] * 5)).collect()
    assert len(got) == 10 and all(r["rank_a"] == 3 and r["p_value"] == pytest.approx(1) for r in got)


def test_wilcoxon_exact():
    d = [0.3, -0.1, 0.5, 0.2, 0.7, -0.4, 0.9]
    w, p, mode = distributions.wilcoxon(d)
    ranks = np.argsort(np.argsort(np.abs(d))) + 1
    ways = [sum(r for r, s in zip(range(1, 8), signs, strict=True) if s) for signs in itertools.product((0, 1), repeat=7)]
    assert mode == "exact" and w == sum(r for r, x in zip(ranks, d, strict=True) if x < 0)
    assert p == pytest.approx(min(1, 2 * sum(x <= w for x in ways) / len(ways)))
    assert distributions.wilcoxon([0.0, 0.0]) == (0.0, 1.0, "none")


def test_tails():
    assert distributions.t_two_sided(2.1447866879169273, 14) == pytest.approx(0.05, abs=1e-9)
    assert distributions.t_two_sided(2.262157162740992, 9) == pytest.approx(0.05, abs=1e-9)
    assert distributions.t_quantile(0.975, 4) == pytest.approx(2.7764451051977987)
    assert distributions.chi2_sf(3.841458820694124, 1) == pytest.approx(0.05, abs=1e-9)
    assert distributions.chi2_sf(7.814727903251179, 3) == pytest.approx(0.05, abs=1e-9)


def test_effects(spark):
    x, y = [2, 3, 4, 5], [1, 2, 3, 4]
    got = significance.effects(matrix(spark, zip(x, y, strict=True))).first()
    assert got["cliffs_delta"] == pytest.approx(0.4375) and got["cohens_d_paired"] is None and got["d_level"] == "undefined"
    assert significance.effects(matrix(spark, zip([2, 3, 4, 6], y, strict=True))).first()["cohens_d_paired"] == pytest.approx(2.5)
