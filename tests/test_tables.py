"""Audits, cleaning, folds, features, sources and streams on small tables."""

import json

import duckdb
import numpy as np
import pytest
from pyspark.sql import functions as F

from gaugewright.operators import clean, features, folds, leakage, models, profile, significance
from gaugewright.plans import catalogues, experiment
from gaugewright.sources import provenance, reports, tables
from gaugewright.streaming import folds as stream


def names(df, column="column"):
    return sorted(r[column] for r in df.collect())


def test_identifiers(spark):
    """Column names with an identifier's word, and text or whole numbers that never repeat; not fractions, however different."""
    towns = ["Ulm", "Graz", "Bern", "Ulm", "Linz", "Graz"]
    df = spark.createDataFrame([(i // 2, f"k{i}", 7 * i + 3, i / 7, towns[i], i % 2 == 0) for i in range(6)], "member_no long, plate string, serial long, weight double, town string, is_open boolean")
    reasons = {r["column"]: r["reason"] for r in profile.identifiers(df).collect()}
    assert set(reasons) == {"member_no", "plate", "serial"} and "Name" in reasons["member_no"] and reasons["plate"].startswith("Fully")
    assert profile.identifiers(df.limit(0)).count() == 0


def test_audit(spark):
    shops, grades = ["north", "south", "west"], ["A", "B", "C?", "D"]
    rows = [(shops[i % 3], grades[i % 4], "same", int(i == 70), float(i), 3.0 * i - 2, "N/A" if i % 9 == 0 else str(i)) for i in range(150)]
    df = spark.createDataFrame(rows, "customer_group string, grade string, unit string, rare long, size double, twice double, note string")
    kinds = {r["column"]: r["kind"] for r in profile.constant_features(df).collect()}
    assert kinds == {"unit": "constant", "rare": "near_constant"}
    assert names(profile.grouped_entities(df, ["customer"])) == ["customer_group"]
    assert names(profile.corrupted_labels(df, "grade"), "label") == ["C?"]
    note = profile.placeholders(df, "size").where("column = 'note'").collect()
    assert {(r["token"], r["n"]) for r in note if r["token"] == "N/A"} == {("N/A", 17)}
    assert [r["column"] for r in profile.leakage_pearson(df, "size", "size").where("leaks").collect()] == ["twice"]
    assert profile.duplicates(df, []).first()["duplicates"] == 0


def test_sanitize(spark):
    """Corrupted and missing targets go, so do identifiers and repeated rows; placeholders become null and texts of numbers numbers, but never the target."""
    bad = clean.CORRUPTED
    rows = [("u1", "3.5__", "---", "0"), ("u2", "7", "red", "1"), ("u3", "_______", "red", "1"), ("u4", "8", "blue", bad), ("u5", "9", "blue", None), ("u6", "7", "red", "1")]
    df = spark.createDataFrame(rows, "user_key string, amount string, colour string, outcome string")
    got = clean.sanitize(df, "outcome")
    assert got.columns == ["amount", "colour", "outcome"] and dict(got.dtypes) == {"amount": "double", "colour": "string", "outcome": "string"}
    assert {tuple(r) for r in got.collect()} == {(3.5, None, "0"), (7.0, "red", "1"), (None, "red", "1")} and got.count() == 3


def test_remediation(spark, tmp_path):
    bad = clean.CORRUPTED
    rows = [(str(i), f"name {i}", ["12_", "__3__", "15"][i % 3], [bad, "low", "high", "high"][i % 4]) for i in range(12)]
    df = spark.createDataFrame(rows, ["ID", "Name", "Delay", "Payment_Behaviour"])
    done, stats = clean.remediate_financial(df)
    assert done.columns == ["Delay", "Payment_Behaviour"] and dict(done.dtypes)["Delay"] == "double" and done.count() == 9
    assert stats.select("before_rows", "dropped_rows", "after_rows").first()[:] == (12, 3, 9)
    pulse = spark.createDataFrame([(60 + i % 4, i % 2) for i in range(20)], "pulse long, target long")
    done, stats = clean.remediate_heart(pulse)
    assert done.count() == 4 and stats.first()["duplicate_pct"] == pytest.approx(80.0)
    # a file is cleaned by its path, or by its target, wherever it is read
    (tmp_path / "my_heart.csv").write_text("pulse,target\n60,1\n60,1\n70,0\n")
    (tmp_path / "credit.csv").write_text("ID,Delay,Payment_Behaviour\n1,5_,low\n2,6,!@9#%8\n")
    (tmp_path / "plain.csv").write_text("pulse,target\n60,1\n60,1\n")
    assert tables.read_csv(spark, str(tmp_path / "my_heart.csv"), "target").count() == 2
    assert [tuple(r) for r in tables.read_csv(spark, str(tmp_path / "credit.csv"), "Payment_Behaviour").collect()] == [(5.0, "low")]
    assert tables.read_csv(spark, str(tmp_path / "plain.csv"), "target").count() == 2


def test_numbers_are_whole(spark):
    df = spark.createDataFrame([("1d", " 7 ", None), ("2", "8", None)], "a string, b string, c string")
    got = dict(clean.coerce_numbers(df).dtypes)
    assert got == {"a": "string", "b": "double", "c": "double"}


def test_folds(spark):
    df = spark.createDataFrame([(i, i % 3, i % 2) for i in range(120)], "a long, b long, target long")
    assigned = folds.folds(df, "a", "target", seed=7)
    assert folds.validate(assigned, 120, 5, 3).first()["valid"]
    assert assigned.exceptAll(folds.folds(df.repartition(7), "a", "target", seed=7)).count() == 0
    assert {r["n"] for r in folds.fold_info(assigned, "target").collect()} == {12}
    parts = {r["part"]: r["count"] for r in folds.three_way(df, "a", "target", 0.7, 0.15).groupBy("part").count().collect()}
    assert parts == {"train": 84, "validation": 18, "test": 18}
    with pytest.raises(ValueError, match="n_splits=5"):
        folds.check_feasible(spark.createDataFrame([(0,), (1,), (0,), (1,)], "y long"), "y", 5)
    with pytest.raises(ValueError, match="smallest class count"):
        folds.check_feasible(spark.createDataFrame([(0,)] * 4 + [(1,)] * 2, "y long"), "y", 3)
    assert folds.fallback_splits(spark.createDataFrame([(0,)] * 4 + [(1,)], "y long"), "y") == (2, False)


def test_leakage(spark):
    df = spark.createDataFrame([(i, i // 4, "ab"[i % 2]) for i in range(200)], "row long, user_id long, y string")
    leaks = leakage.fold_leakage(folds.folds(df, "row", "y").join(df.select("row", "user_id"), "row"), "user_id")
    assert leaks.agg(F.avg("pct_rows_leaked")).first()[0] > 80
    got = leakage.risk(leakage.group_statistics(df, "user_id"), leaks, 2).first()
    assert got["recommendation"] == "StratifiedGroupKFold recommended" and got["confidence"] == "HIGH"
    assert names(leakage.candidates(df, "y")) == ["user_id"]


def test_features(spark):
    train = spark.createDataFrame([(1, 1.0, "a", "u"), (2, 2.0, "b", "u"), (3, 4.0, "a", "v"), (4, None, None, "v")], "k long, x double, c string, d string")
    test = spark.createDataFrame([(5, 10.0, "zzz", "u")], "k long, x double, c string, d string")
    assert features.scaling(train, ["x"], "standard")["x"] == pytest.approx((7 / 3, np.std([1, 2, 4])))
    assert features.scaling(train, ["x"], "robust")["x"] == pytest.approx((2.0, 1.5))
    assert features.scaling(spark.createDataFrame([(3.0,), (3.0,)], "x double"), ["x"], "minmax")["x"] == (3.0, 1.0)
    prep = features.Preparation(keep=["k"], encoding="ordinal").fit(train)
    assert prep.transform(test).first()["c"] == -1.0
    assert prep.feature_names(train) == ["x", "c", "d"]
    assert features.Preparation(keep=["k"]).fit(train).transform(test).columns == ["k", "x", "c=b", "d=v"]
    with pytest.raises(RuntimeError, match="fit before"):
        features.Preparation().transform(test)


def test_predictions_and_metrics(spark, tmp_path):
    """Every row is predicted once in each repetition, predictions are kept, and metrics are those that SQL makes of them."""
    rows = spark.createDataFrame([(i, [float(i % 7), float(i * i % 11)], float(i % 3)) for i in range(90)], "row long, features array<double>, label double")
    assigned = folds.folds(rows, "row", "label", n_splits=3, n_repetitions=2)
    sink = str(tmp_path / "predictions")
    got = models.cross_validate(rows, assigned, "row", ["dt", "svm"], sink=sink)
    kept = tables.read_predictions(spark, sink)
    assert kept.groupBy("model", "repetition_id").agg(F.countDistinct("row_id").alias("n"), F.count(F.lit(1)).alias("m")).where("n <> 90 or m <> 90").count() == 0 and kept.count() == 360
    base = duckdb.connect()
    base.execute(f"CREATE VIEW p AS SELECT * FROM read_parquet('{sink}/*/*/*/*.parquet', hive_partitioning = true)")
    sql = """
      WITH c AS (SELECT model, repetition_id, fold_id, y_true AS y, count(*) AS support, count(*) FILTER (WHERE y_true = y_pred) AS hits FROM p GROUP BY ALL),
      q AS (SELECT model, repetition_id, fold_id, y_pred AS y, count(*) AS predicted FROM p GROUP BY ALL)
      SELECT model, repetition_id, fold_id, sum(hits) / sum(support) AS accuracy, sum(support * coalesce(hits / predicted, 0)) / sum(support) AS precision, sum(support * 2.0 * hits / (support + coalesce(predicted, 0))) / sum(support) AS f1
      FROM c LEFT JOIN q USING (model, repetition_id, fold_id, y) GROUP BY ALL"""
    want = {r[:3]: r[3:] for r in base.execute(sql).fetchall()}
    assert len(want) == 12
    for r in got.collect():
        assert (r["accuracy"], r["precision"], r["f1"]) == pytest.approx(want[r["model"], r["repetition_id"], r["fold_id"]])
        assert (r["roc_auc"] is None) == (r["model"] == "svm")
    found, times = models.run_fold(rows, assigned, "row", "dt", 1, 2)
    assert found.count() == 30 and times["error"] is None and {r["fold_id"] for r in found.collect()} == {2}


def test_models_by_name(spark):
    known = models.default_models()
    assert known.exists("RF") and not known.exists("nothing") and known.info("rf")["parameters"]["numTrees"] == 100 and known.info("gb")["one_against_rest"]
    assert known.by_estimator()["LogisticRegression"] == ["logisticregression"]
    assert known.create("lr", 50).getRegParam() == pytest.approx(1 / 50) and known.create("svm", 20).getClassifier().getRegParam() == pytest.approx(1 / 20)
    rows = spark.createDataFrame([(i, [float(i % 2), 1.0], i % 2) for i in range(20)], "row long, features array<double>, label long")
    with pytest.raises(RuntimeError, match="fit before"):
        models.Classifier("dt").predictions(rows, "row")
    fitted = models.Classifier("dt").fit(rows)
    assert fitted.score(rows, "row")["accuracy"] == 1.0
    assert {r["y_true"] for r in fitted.predictions(rows.drop("label"), "row").collect()} == {None}


def test_prepared(spark, tmp_path):
    rows = spark.createDataFrame([(i, float(i % 5), "ab"[i % 2], ["no", "yes"][i % 2]) for i in range(100)], "row long, x double, kind string, target string")
    made = experiment.prepare_dataset(rows, "target", "row", test_size=0.2)
    assert (made.train.count(), made.test.count(), made.classes, made.feature_names) == (80, 20, ["no", "yes"], ["x", "kind=b"])
    assert made.train.join(made.test, "row").count() == 0
    assert experiment.score_test(made, "row", ["dt"]).first()["accuracy"] == 1.0
    registry = tables.DatasetRegistry()
    (tmp_path / "a.csv").write_text("x,target\n1,p\n2,q\n3,p\n")
    registry.register("a", tables.Dataset(str(tmp_path / "a.csv"), "target"))
    registry.register("gone", tables.Dataset(str(tmp_path / "gone.csv"), "target"))
    found = experiment.audit_all(spark, registry, str(tmp_path / "audits"))
    assert "## imbalance" in found["a"] and "FileNotFoundError" in found["gone"] and (tmp_path / "audits" / "a_audit.md").exists()
    assert "town_id" in experiment.identifier_report(rows.withColumnRenamed("kind", "town_id")) and "Separation" in experiment.leakage_report(rows, "target", "row")
    chart = reports.svg_bars(spark.createDataFrame([("a<b", 1.0), ("c", 500.0)], "name string, v double"), "name", "v", "Title")
    assert chart.count("<rect") == 2 and "a&lt;b" in chart and "logarithmic" in chart


def test_score_problems(spark):
    rows = [("d", i, m, 0.5 + i) for i in range(4) for m in "xy"]
    good = spark.createDataFrame(rows, "dataset string, obs long, model string, score double")
    assert significance.checked(good) is good
    bad = spark.createDataFrame([*rows[:-1], ("d", 9, "x", float("nan")), ("d", 0, "x", 1.0), ("d", 0, None, 1.0), ("e", 0, "x", None)], good.schema)
    found = {(r["dataset"], r["problem"]): r["n"] for r in significance.problems(bad).collect()}
    assert found == {("d", "score is not finite"): 1, ("d", "row without a model"): 1, ("d", "repeated observation of a model"): 1, ("d", "observation that some model lacks"): 2, ("e", "score is not finite"): 1, ("e", "fewer than two models"): 1, ("e", "fewer than two observations"): 1}
    with pytest.raises(ValueError, match="e: fewer than two models"):
        significance.checked(bad)


def test_cross_validation(spark):
    rows = spark.createDataFrame([(i, [float(i % 10), float(i % 3)], float(i % 2)) for i in range(60)], "row long, features array<double>, label double")
    assigned = folds.folds(rows, "row", "label", n_splits=2, n_repetitions=1)
    registry, seen = models.default_models(), []
    registry.register("Broken", lambda: (_ for _ in ()).throw(RuntimeError("no fit")))
    got = models.cross_validate(rows, assigned, "row", ["lr", "Broken"], registry=registry, on_fold=seen.append).collect()
    assert len(got) == 4 == len(seen)
    assert all((r["error"] is None) == (r["model"] == "lr") for r in got)
    done = spark.createDataFrame([("lr", 0, 0)], "model string, repetition_id int, fold_id int")
    assert len(models.cross_validate(rows, assigned, "row", ["lr"], done=done).collect()) == 1
    with pytest.raises(KeyError):
        registry.create("nothing")
    with pytest.raises(TypeError):
        registry.register("x", 3)


def test_sources(spark, tmp_path):
    path = tmp_path / "t.csv"
    path.write_text("a,b,Class\n1,x,0\n2,y,1  \n")
    assert tables.read_csv(spark, str(path), "Class").count() == 2
    assert tables.detect_target(spark, str(path)) == "Class"
    with pytest.raises(ValueError, match="target"):
        tables.read_csv(spark, str(path), "nothing")
    with pytest.raises(FileNotFoundError):
        tables.read_csv(spark, str(tmp_path / "none.csv"), "Class")
    np.save(tmp_path / "x.npy", np.ones((3, 2)))
    np.save(tmp_path / "y.npy", np.arange(3))
    assert tables.read_numpy(spark, str(tmp_path / "x.npy"), str(tmp_path / "y.npy")).count() == 3
    for d, models_ in (("d1", "ab"), ("d2", "a")):
        (tmp_path / "runs" / d).mkdir(parents=True)
        (tmp_path / "runs" / d / "raw_results.csv").write_text("model,overall__accuracy_mean\n" + "".join(f"{m},0.5\n" for m in models_))
    many = tables.read_many_results(spark, str(tmp_path / "runs"))
    assert many.count() == 3 and names(tables.strict_matrix(many), "model") == ["a", "a"]
    registry = tables.DatasetRegistry()
    registry.register("t", tables.Dataset(str(path), "Class"))
    assert registry.load(spark, "t").count() == 2 and registry.names("regression") == []
    with pytest.raises(KeyError):
        registry.get("u")


def test_provenance(spark, tmp_path):
    a, b = spark.range(100).withColumn("x", F.lit("é")), spark.range(100).repartition(7).withColumn("x", F.lit("é"))
    assert provenance.table_fingerprint(a) == provenance.table_fingerprint(b) != provenance.table_fingerprint(a.limit(99))
    one, two = tmp_path / "1", tmp_path / "2"
    one.write_text("a  \nb\n")
    two.write_text("a\nb")
    assert provenance.file_fingerprint(str(one)) == provenance.file_fingerprint(str(two))
    provenance.write_json({"a": np.float64(1).item()}, str(tmp_path / "j.json"))
    assert json.loads((tmp_path / "j.json").read_text()) == {"a": 1.0}
    assert [p.name for p in tmp_path.glob("*.tmp")] == []
    log = provenance.JsonLog(str(tmp_path / "log"))
    log.write("info", "x", n=1)
    assert json.loads((tmp_path / "log").read_text())["meta"] == {"n": 1}
    with pytest.raises(ValueError, match="experiment_id"):
        provenance.metadata()
    with pytest.raises(ValueError, match="models"):
        provenance.validate_config({"dataset": {}})
    text = reports.report("R", {"t": (spark.createDataFrame([("a", 1.23456789)], "m string, v double"), ["m"])})
    assert "| a | 1.23457 |" in text


def test_stream(spark, tmp_path):
    rows = [("2024-01-01 00:00:00", "d", "m", 0, i, "f1", 0.5 + i / 10) for i in range(3)]
    df = spark.createDataFrame(rows, "ts string, dataset string, model string, repetition_id int, fold_id int, metric string, value double").withColumn("ts", F.col("ts").cast("timestamp"))
    df.coalesce(1).write.parquet(str(tmp_path / "in"))
    df.limit(1).coalesce(1).write.mode("append").parquet(str(tmp_path / "in"))
    stream.to_parquet(stream.running_summary(stream.fold_stream(spark, str(tmp_path / "in"))), str(tmp_path / "out"), str(tmp_path / "state")).awaitTermination(120)
    got = spark.read.parquet(str(tmp_path / "out")).first()
    assert (got["n"], got["mean"]) == (3, pytest.approx(0.6))


def test_models_in_full(spark, monkeypatch):
    """Models as large as the reference's, on all classes, 5 folds and 3 repetitions."""
    registry = models.default_models()
    assert registry.create("dt").getMaxDepth() == registry.create("rf").getMaxDepth() == 30 and registry.create("rf").getNumTrees() == 100
    assert registry.create("gb").getClassifier().getMaxIter() == 100
    seen = []

    def stop(rows, assigned, key, names):
        seen.append((rows, assigned))
        raise InterruptedError

    monkeypatch.setattr(models, "cross_validate", stop)
    with pytest.raises(InterruptedError):
        next(c.queries["model_cv_gbt_ovr"] for c in catalogues() if "model_cv_gbt_ovr" in c.queries)(spark, "/root/testdata/sf0.001")
    rows, assigned = seen[0]
    assert rows.select("label").distinct().count() == 10 and assigned.select("repetition_id", "fold_id").distinct().count() == 15
