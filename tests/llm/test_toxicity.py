import random

import numpy as np
import pyarrow as pa
from pyspark.sql import functions as F

from gaugewright.llm import toxicity as tox
from gaugewright.llm.toxicity import _threshold, toxicity, without_toxic


def corpus(n, seed=0):
    rng = random.Random(seed)
    plain = ["".join(rng.choice(["an", "er", "ti", "ou", "th", "re"]) for _ in range(rng.randrange(1, 4))) for _ in range(300)]
    rows = []
    for i in range(n):
        words = [rng.choice(plain) for _ in range(rng.choice([3, 20, 120]))]
        bad = rng.random() < 0.25
        if bad:
            for _ in range(2):
                words.insert(rng.randrange(len(words)), rng.choice(["zork", "blix"]) + rng.choice(["", "ed", "ing", "ous", "al"]))
        rows.append((i, " ".join(words), int(bad)))
    return rows


def test_learns_stems(spark, documents):
    rows = corpus(900)
    docs = documents([(i, t) for i, t, _ in rows] + [(5000, None), (5001, ""), (5002, "zorkish " * 20_000), (None, "x"), (3, rows[3][1])])
    labels = spark.createDataFrame([(i, y, 1) for i, _, y in rows] + [(None, 1, 1), (1, 7, 1), (2, None, 1), (0, 1 - rows[0][2], 1)], "doc_id long, toxic int, quality int")
    learn = F.crc32(F.col("doc_id").cast("string")) % 4 != 2
    got = toxicity(docs, labels, learn).withColumn("held", ~learn).collect()
    assert len(got) == 905 and all(0 <= r["score"] <= 1 for r in got)
    by = {r["doc_id"]: r for r in got}
    y = np.array([y for i, _, y in rows if by[i]["held"]])
    s = np.array([by[i]["score"] for i, _, _ in rows if by[i]["held"]])
    assert ((s >= 0.3) == y).mean() > 0.97
    assert by[5002]["score"] > 0.3 and by[5000]["score"] == by[5001]["score"] < 0.3
    kept = {r["doc_id"] for r in without_toxic(docs, labels, learn).collect()}
    assert kept == {r["doc_id"] for r in got if not r["toxic"]}
    assert without_toxic(docs, labels, learn).columns == docs.columns


def test_gradient():
    """A step's direction is that of finite differences."""
    rng = np.random.default_rng(1)
    parts = list(tox.features(pa.array(["one two three", "", "four", "two five six seven"])))
    _, _, buckets, first = parts[0]
    label = np.array([1.0, 0.0, 1.0, 0.0])
    width = len(tox.WIDTHS) * tox.FILTERS
    model = tox.Model(rng.normal(0, 1, (tox.BUCKETS, tox.DIMENSIONS)).astype(np.float32), rng.normal(0, 1, (tox.DIMENSIONS, len(tox._BLOCKS) * tox.FILTERS)).astype(np.float32), rng.normal(0, 1, width).astype(np.float32), rng.normal(0, 1, width).astype(np.float32), 0.1)

    def loss():
        z = tox.logits(model, buckets, first).astype(float)
        return float(np.mean(np.logaddexp(0, z) - label * z))

    for name, at in (("filters", (3, 5)), ("filters", (7, 20)), ("weight", (2,)), ("embedding", (int(buckets[0, 0]), 4))):
        value = getattr(model, name)
        old, step = value[at], 1e-2
        value[at] = old + step
        up = loss()
        value[at] = old - step
        slope = (up - loss()) / (2 * step)
        value[at] = old
        before = {n: getattr(model, n).copy() for n in ("filters", "bias", "weight", "embedding")}
        memory = {n: np.zeros_like(v) for n, v in before.items()} | {"offset": 0.0}
        offset = model.offset
        tox._step(model, memory, buckets, first, label, np.ones(tox.BUCKETS, bool), 1e-3)
        grad2 = memory[name][at]
        for n, v in before.items():
            setattr(model, n, v)
        model.offset = offset
        # the memory of an embedding that several columns share adds squares of parts
        assert abs(np.sqrt(grad2) - abs(slope)) <= 0.05 * abs(slope) + 2e-3, name


def test_labels_of_one_class(spark, documents):
    docs = documents([(1, "a"), (2, "b")])
    none = spark.createDataFrame([], "doc_id long, toxic int")
    assert {r["score"] for r in toxicity(docs, none, F.lit(True)).collect()} == {0.0}
    ones = spark.createDataFrame([(1, 1)], "doc_id long, toxic int")
    assert {r["score"] for r in toxicity(docs, ones, F.lit(True)).collect()} == {1.0}
    assert toxicity(documents([]), ones, F.lit(True)).count() == 0
    assert without_toxic(docs, none, F.lit(True)).count() == 2


def test_thresholds():
    score, label = np.array([0.9, 0.8, 0.6, 0.5, 0.45, 0.3, 0.2, 0.1, 0.05, 0.01]), np.array([1, 1, 1, 1, 1, 0, 0, 0, 0, 0.0])
    assert _threshold(score, label, 0.3) == (0.45 + 0.3) / 2
    assert _threshold(score[:3], label[:3], 0.3) == 0.3


def test_long_texts_do_not_cut_the_sample(spark, documents, monkeypatch):
    """Texts that don't fit into the sample's bytes are left out, and no others."""
    rows, seen, train = corpus(200), [], tox.train
    monkeypatch.setattr(tox, "train", lambda texts, *rest: seen.append(len(texts)) or train(texts, *rest))
    labels = spark.createDataFrame([(i, y) for i, _, y in rows] + [(1000 + i, i % 2) for i in range(8)], "doc_id long, toxic int")
    docs = documents([(i, t) for i, t, _ in rows] + [(1000 + i, "long " * 60_000) for i in range(8)])
    tox.Judge(docs, labels, F.lit(True), 2000, 4000, 1 << 18)
    assert seen == [200]


def test_learns_from_all_labels(spark, documents, monkeypatch):
    """Parts of any number learn side by side from every label: a word that only rows beyond the first ones have counts too."""
    monkeypatch.setattr(tox, "PART_ROWS", 300)
    rows, learned = corpus(1200), []
    trained = tox.train_parts
    monkeypatch.setattr(tox, "train_parts", lambda dealt, n, parts: learned.append((n, dealt.count(), parts)) or trained(dealt, n, parts, steps=80))
    docs = documents([(i, t) for i, t, _ in rows])
    labels = spark.createDataFrame([(i, y) for i, _, y in rows if i < 1000], "doc_id long, toxic int")
    judge = tox.Judge(docs, labels, F.lit(True))
    (n, dealt, parts) = learned[0]
    assert n == dealt and 700 < n < 900 and parts == 4
    score = judge.scores(pa.array([t for i, t, _ in rows if i >= 1000]))
    y = np.array([y for i, _, y in rows if i >= 1000])
    assert ((score >= 0.3) == y).mean() > 0.95
    again = tox.Judge(docs.repartition(7), labels, F.lit(True)).scores(pa.array([t for i, t, _ in rows if i >= 1000]))
    assert (again == score).all()
