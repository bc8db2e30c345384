"""Places, running sums and quantiles against plain Python."""

import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from gaugewright.operators import features, folds, scoring
from gaugewright.operators.order import placed, quantiles, running

RANDOM = random.Random(7)
ROWS = [(i, RANDOM.choice(["a", "b", None]), RANDOM.choice([None, 0.5, float(RANDOM.randrange(40)), RANDOM.random()])) for i in range(600)]


@pytest.fixture(scope="module")
def rows(spark):
    return spark.createDataFrame(ROWS, "id long, class string, score double").repartition(5)


def test_places(rows):
    got = {r["id"]: (r["place__"], r["n__"]) for r in placed(rows, ["class"], folds.seeded(3, "id"), "id").collect()}
    import hashlib

    for label in ("a", "b", None):
        ids = sorted((i for i, c, _ in ROWS if c == label), key=lambda i: (hashlib.md5(f"3:{i}".encode()).hexdigest(), i))
        assert [got[i] for i in ids] == [(k + 1, len(ids)) for k in range(len(ids))]


def test_split_keeps_columns_and_shares(rows):
    found = folds.three_way(rows.withColumn("n_", F.lit(1)).withColumn("place_", F.lit(2)), "id", "class", 0.5, 0.25).collect()
    assert found[0].asDict().keys() == {"id", "class", "score", "n_", "place_", "part"}
    assert len(found) == len(ROWS)
    for label in ("a", "b", None):
        n = sum(c == label for _, c, _ in ROWS)
        assert abs(sum(r["part"] == "test" for r in found if r["class"] == label) - n / 4) <= 0.5


def test_running_sums_by_few_ranges(rows):
    counts = rows.where("score is not null").groupBy("class", "score").agg(F.count(F.lit(1)).alias("n"))
    for ranges, whole in ((2, 1), (3, 1), (256, 1), (256, 150), (256, 10**6)):  # every key is cut, some are, none is
        for r in running(counts, ["class"], "score", "n", ranges=ranges, whole=whole).collect():
            mine = [s for _, c, s in ROWS if c == r["class"] and s is not None]
            assert (r["below__"], r["all__"], r["n"]) == (sum(s < r["score"] for s in mine), len(mine), mine.count(r["score"]))


def test_quantiles(rows):
    got = quantiles(rows.withColumn("none", F.lit(None).cast("double")).withColumn("one", F.when(F.col("id") == 3, 5)), ["score", "none", "one"], [0.0, 0.25, 0.5, 0.9, 1.0])
    assert got["none"] is None and got["one"] == [5.0] * 5
    assert np.allclose(got["score"], np.quantile([s for _, _, s in ROWS if s is not None], [0, 0.25, 0.5, 0.9, 1]))
    assert quantiles(rows.limit(0), ["score"], [0.5]) == {"score": None}
    assert features.scaling(rows.limit(0), ["score"], "robust") == {"score": (0.0, 1.0)}


def test_area_counts_pairs(rows):
    got = {r["class"]: r for r in scoring.auc(rows.withColumn("positive", (F.col("id") % 3 == 0).cast("int")), ["class"]).collect()}
    for label in ("a", "b", None):
        mine = [(i % 3 == 0, s) for i, c, s in ROWS if c == label and s is not None]
        high, low = [s for p, s in mine if p], [s for p, s in mine if not p]
        pairs = sum((h > x) + (h == x) / 2 for h in high for x in low)
        assert got[label]["n_positive"] == len(high) and abs(got[label]["roc_auc"] - pairs / len(high) / len(low)) < 1e-12
    assert scoring.auc(rows.where("id = 3").withColumn("positive", F.lit(1)).fillna(0.5), []).first()["roc_auc"] is None
