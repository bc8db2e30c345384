"""Whole runs on small files."""

import json

import pytest

from gaugewright import __main__ as cli
from gaugewright.operators import models
from gaugewright.plans import experiment


@pytest.fixture
def table(tmp_path):
    path = tmp_path / "t.csv"
    path.write_text("feat1,feat2,kind,target\n" + "".join(f"{round((i % 10) * 0.1, 2)},{i % 3 + 1},{'abc'[i % 3]},{i % 2}\n" for i in range(60)))
    return str(path)


def config(path, names):
    return {"experiment_id": "e", "run_id": "r", "random_state": 0, "n_splits": 3, "n_repetitions": 1, "dataset": {"filepath": path, "target": "target", "test_size": 0.33, "preprocessing": {"encoding": "ordinal"}}, "models": names, "evaluation": {"primary_metric": "accuracy"}}


def test_run_and_resume(spark, tmp_path, table):
    registry, fits = models.default_models(), []

    def counted(name):
        make = registry._makers[name]

        def made():
            fits.append(name)
            return make()

        return made

    for name in ("logisticregression", "decisiontree"):
        registry.register(name, counted(name))
    registry.register("broken", lambda: (_ for _ in ()).throw(RuntimeError("no")))
    out = tmp_path / "out"
    whole = experiment.run_experiment(spark, config(table, ["lr", "dt", "broken"]), str(out), model_registry=registry)
    assert len(fits) == 6 and not (out / "checkpoint.jsonl").exists()
    got = {(r["model"], r["fold_id"]): r["accuracy"] for r in whole["fold_metrics"].collect()}
    assert set(got) == {(m, f) for m in ("lr", "dt") for f in range(3)}
    assert whole["cbs_scores"].count() == 2 and whole["comparisons"].count() == 1
    meta = json.loads((out / "metadata.json").read_text())
    assert meta["random_state"] == 0 and meta["n_splits"] == 3 and "Scores" in (out / "report.md").read_text()
    studied = experiment.robustness_study(whole["normalized_results"], str(tmp_path / "study"), iterations=50)
    assert studied["weight_robustness"].count() == 84 and (tmp_path / "study" / "metric_influence").exists()
    # a run that broke off after two folds of the first model does the others only, with the same result
    rows = [{"model": "lr", "repetition_id": 0, "fold_id": f, "error": None, "accuracy": got["lr", f], "f1": 0.5, "train_time": 1.0, "eval_time": 1.0} for f in range(2)]
    (out / "checkpoint.jsonl").write_text("".join(json.dumps(r) + "\n" for r in rows))
    fits.clear()
    again = experiment.run_experiment(spark, config(table, ["lr", "dt"]), str(out), model_registry=registry)
    assert sorted(fits) == ["decisiontree"] * 3 + ["logisticregression"]
    assert {(r["model"], r["fold_id"]): r["accuracy"] for r in again["fold_metrics"].collect()} == pytest.approx(got)


def test_command_line(spark, tmp_path, table, capsys, monkeypatch):
    assert cli.main(["audit", table, "--target", "target"]) == 0
    assert "## identifiers" in capsys.readouterr().out
    for d in ("d1", "d2", "d3"):
        (tmp_path / "runs" / d).mkdir(parents=True)
        (tmp_path / "runs" / d / "raw_results.csv").write_text("model,overall__accuracy_mean\na,0.5\nb,0.6\nc,0.7\n")
    assert cli.main(["aggregate", "--results_dir", str(tmp_path / "runs"), "--out_dir", str(tmp_path / "cmp")]) == 0
    assert spark.read.option("header", True).csv(str(tmp_path / "cmp" / "friedman")).first()["statistic"] == "6.0"
    with pytest.raises(ValueError, match="models"):
        experiment.run_experiment(spark, {"dataset": {}}, str(tmp_path / "x"))
