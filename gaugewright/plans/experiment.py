"""Whole runs: an experiment from its configuration, the robustness of its scores, the comparison of many, the audit of a table."""

from __future__ import annotations

import json
from dataclasses import dataclass
from functools import reduce
from pathlib import Path
from typing import Any

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from gaugewright.operators import composite, features, folds, leakage, models, profile, robustness, significance, summary
from gaugewright.sources import provenance, reports, tables

_FOLD = ["dataset", "model", "repetition_id", "fold_id"]


def _labelled(rows: DataFrame, target: str) -> tuple[DataFrame, list[Any]]:
    """Rows with a label from 0 on by sorted class; classes are few."""
    classes = [r[0] for r in rows.select(target).where(F.col(target).isNotNull()).distinct().orderBy(target).collect()]
    codes = rows.sparkSession.createDataFrame([(c, float(i)) for i, c in enumerate(classes)], f"`{target}` {rows.schema[target].dataType.simpleString()}, label double")
    return rows.join(F.broadcast(codes), target), classes


@dataclass
class Prepared:
    """Training and test rows (key, label, features) of a table, and how they were made."""

    train: DataFrame
    test: DataFrame
    preparation: features.Preparation
    classes: list[Any]
    feature_names: list[str]


def prepare_dataset(rows: DataFrame, target: str, key: str, *, test_size: float = 0.3, stratify: bool = True, scaling: str | None = "standard", encoding: str = "onehot", seed: int = 42) -> Prepared:
    """Split rows, fit the preparation on the training part alone, and transform both; rows without a target are left out."""
    labelled, classes = _labelled(rows, target)
    parts = folds.split(labelled, key, "label" if stratify else None, test_size, seed=seed)
    train, test = (parts.where(F.col("part") == p).drop("part", target) for p in ("train", "test"))
    made = features.Preparation(keep=[key, "label"], scaling=scaling, encoding=encoding).fit(train)
    names = made.feature_names(train)
    shaped = lambda df: made.transform(df).select(key, "label", F.array(*[F.col(f"`{c}`").cast("double") for c in names]).alias("features"))
    return Prepared(shaped(train), shaped(test), made, classes, names)


def score_test(prepared: Prepared, key: str, names: list[str], *, registry: models.ModelRegistry | None = None) -> DataFrame:
    """Metrics on the test part of models that are fitted to the whole training part."""
    scored = [models.Classifier(n, registry).fit(prepared.train).predictions(prepared.test, key).select(F.lit(n).alias("model"), F.lit(0).alias("repetition_id"), F.lit(0).alias("fold_id"), "*") for n in names]
    return models.measured(reduce(DataFrame.unionByName, scored)).drop("repetition_id", "fold_id")


def run_experiment(spark: SparkSession, config: dict[str, Any], out: str, *, registry: tables.DatasetRegistry | None = None, model_registry: models.ModelRegistry | None = None) -> dict[str, DataFrame]:
    """Load, split, prepare, cross-validate, summarise, score and compare; results are written to ``out`` and returned by name.

    Finished folds are kept in ``out/checkpoint.jsonl``; a run that is begun again leaves them out and, when it
    is through, removes the file. Configuration: dataset {registered_name, or filepath and target; test_size,
    stratify, preprocessing {scaling, encoding}}, models (names), random_state, n_splits, n_repetitions,
    evaluation {primary_metric}, experiment_id, run_id.
    """
    provenance.validate_config(config)
    entry, seed = config["dataset"], config.get("random_state", config.get("seed", 42))
    splits, repetitions = config.get("n_splits", 5), config.get("n_repetitions", 3)
    name = entry.get("registered_name") or entry.get("name") or Path(entry["filepath"]).stem
    folder = Path(out)
    folder.mkdir(parents=True, exist_ok=True)
    if entry.get("registered_name"):
        if registry is None:
            raise ValueError("a registered dataset needs a registry")
        rows, target = registry.load(spark, entry["registered_name"]), registry.get(entry["registered_name"]).target
    else:
        target = entry.get("target") or tables.detect_target(spark, entry["filepath"])
        rows = tables.read_csv(spark, entry["filepath"], target)
    at = str(folder / "rows.parquet")
    if not Path(at, "_SUCCESS").exists():  # row ids stay the same for a run that is begun again
        rows.withColumn("row_id", F.monotonically_increasing_id()).write.mode("overwrite").parquet(at)
    rows, classes = _labelled(spark.read.parquet(at), target)
    stratify = "label" if entry.get("stratify", True) else None
    how = entry.get("preprocessing", {})
    prepared = prepare_dataset(spark.read.parquet(at), target, "row_id", test_size=entry.get("test_size", 0.3), stratify=stratify is not None, scaling=how.get("scaling", "standard"), encoding=how.get("encoding", "onehot"), seed=seed)
    train = data = prepared.train
    folds.check_feasible(train, "label", splits)
    prepared.test.write.mode("overwrite").parquet(str(folder / "test.parquet"))
    assigned = folds.folds(train, "row_id", "label", n_splits=splits, n_repetitions=repetitions, seed=seed)
    assigned.write.mode("overwrite").parquet(str(folder / "folds.parquet"))
    assigned = spark.read.parquet(str(folder / "folds.parquet"))

    kept = folder / "checkpoint.jsonl"
    before = [json.loads(line) for line in kept.read_text().splitlines()] if kept.exists() else []
    done = spark.createDataFrame([(r["model"], r["repetition_id"], r["fold_id"]) for r in before], "model string, repetition_id int, fold_id int")
    log = provenance.JsonLog(str(folder / "run.log"))

    def on_fold(row: dict[str, Any]) -> None:
        with kept.open("a") as f:
            f.write(json.dumps(row, default=float) + "\n")
        log.write("error" if row["error"] else "info", "fold done", **{k: row[k] for k in ("model", "repetition_id", "fold_id", "error")})

    made = models.cross_validate(data, assigned, "row_id", list(config["models"]), registry=model_registry, done=done, on_fold=on_fold, sink=str(folder / "predictions"))
    names = made.columns
    results = made.unionByName(spark.createDataFrame([tuple(r.get(c) for c in names) for r in before], made.schema)).withColumn("dataset", F.lit(name)).withColumn("total_time", F.col("train_time") + F.col("eval_time"))
    results.write.mode("overwrite").parquet(str(folder / "fold_metrics.parquet"))
    wide = spark.read.parquet(str(folder / "fold_metrics.parquet")).where("error is null")
    primary = config.get("evaluation", {}).get("primary_metric", "accuracy")
    found = evaluate(wide, primary=primary, n_splits=splits)
    for key, df in found.items():
        tables.write_csv(df, str(folder / key))
    provenance.write_json(provenance.metadata(experiment_id=str(config.get("experiment_id", name)), run_id=str(config.get("run_id", "run")), dataset=name, random_state=int(seed), n_splits=splits, n_repetitions=repetitions, models=list(config["models"]), classes=[str(c) for c in classes], config=config, data=provenance.table_fingerprint(rows)), str(folder / "metadata.json"))
    (folder / "report.md").write_text(reports.report(f"Experiment on {name}", {"Scores": (found["cbs_scores"], ["dataset", "baseline_rank", "model"]), "Comparisons": (found["comparisons"], ["dataset", "model_a", "model_b"])}))
    kept.unlink(missing_ok=True)
    return found | {"fold_metrics": wide}


def evaluate(wide: DataFrame, *, primary: str = "accuracy", n_splits: int = 5) -> dict[str, DataFrame]:
    """Summaries, normalised components, scores, ranking and comparisons of fold metrics."""
    keys = ["dataset", "model"]
    long = summary.to_long(wide, _FOLD, [*summary.QUALITY, *summary.TIMES])
    parts = composite.components(wide, keys, primary=primary)
    frame = composite.scored(composite.normalize(composite.raw_scores(parts, keys)))
    scores = wide.select("dataset", (F.col("repetition_id") * n_splits + F.col("fold_id")).alias("obs"), "model", F.col(primary).alias("score"))
    aligned = significance.aligned(scores)
    tests = significance.corrected_t(aligned, n_splits=n_splits).join(significance.effects(aligned), ["dataset", "model_a", "model_b"])
    return {
        "summary": summary.summarize(long, keys), "components": parts, "normalized_results": frame.select(*keys, *composite.COMPONENTS), "cbs_scores": frame.select(*keys, "cbs", "baseline_rank"),
        "stability": summary.stability(long, keys), "comparisons": tests, "ranking": significance.model_ranking(scores), "efficiency": summary.efficiency(wide, keys),
    }


def robustness_study(normalized: DataFrame, out: str | None = None, *, perturbation: float = 0.01, noise_std: float = 0.02, iterations: int = 2000, cv: DataFrame | None = None) -> dict[str, DataFrame]:
    """All robustness analyses of normalised components (dataset, model, ...), written as CSV below ``out`` if it is given.

    cv (dataset, model, cv), if there is one, spreads the noise of the scenario of fold variability.
    """
    spark, frame = normalized.sparkSession, composite.scored(normalized)
    small = robustness.small_perturbations(frame, perturbation).withColumn("scenario", F.lit("small_perturbation"))
    noisy = robustness.noise_perturbations(frame, robustness.noise_table(spark, 128), F.lit(noise_std)).withColumn("scenario", F.lit("noisy_measurement"))
    varied = frame.join(cv.select("dataset", "model", "cv"), ["dataset", "model"], "left") if cv is not None else frame.withColumn("cv", F.lit(None).cast("double"))
    folded = robustness.noise_perturbations(varied, robustness.noise_table(spark, 256, 43), F.coalesce("cv", F.lit(noise_std))).withColumn("scenario", F.lit("fold_variability"))
    sensitivity = small.unionByName(noisy, allowMissingColumns=True).unionByName(folded, allowMissingColumns=True)
    grid = robustness.weight_grid(frame)
    found = {
        "sensitivity_analysis": sensitivity, "sensitivity_ranking": robustness.sensitivity_ranking(sensitivity), "weight_robustness": grid.join(robustness.grid_agreement(grid), ["dataset", "metric", "perturbation_level", "direction"]), "metric_influence": robustness.dominance(frame),
        "correlation_analysis": robustness.correlations(frame), "redundancy_pairs": robustness.redundancy(frame), "ranking_stability": robustness.monte_carlo(frame, robustness.dirichlet_weights(spark, iterations)),
    }
    for name, df in found.items() if out else ():
        tables.write_csv(df, f"{out}/{name}")
    if out:
        Path(out, "robustness_report.md").write_text(robustness_report(found))
        Path(out, "metric_influence.svg").write_text(reports.svg_bars(found["metric_influence"].groupBy("metric").agg(F.avg("mean_leave_one_out_impact").alias("impact")), "metric", "impact", "Mean impact of leaving a component out"))
    return found


def robustness_report(found: dict[str, DataFrame]) -> str:
    """The analyses of a robustness study as Markdown: how often each model comes first, which components move the score, which repeat each other."""
    order = {"ranking_stability": ["dataset", "mean_rank", "model"], "sensitivity_ranking": ["dataset", "scenario", "metric"], "metric_influence": ["dataset", "metric"], "redundancy_pairs": ["dataset"]}
    return reports.report("Robustness of the composite score", {name: (found[name], order[name]) for name in order if name in found})


def identifier_report(df: DataFrame) -> str:
    """Columns that identify rows, with reasons, as Markdown."""
    return reports.report("Identifiers", {"Columns": (profile.identifiers(df), ["column"])})


def leakage_report(df: DataFrame, target: str, row_id: str) -> str:
    """Columns that give the target away, and groups that folds would cut through, as Markdown."""
    return reports.report("Leakage", {"Correlation": (profile.leakage_pearson(df, target, row_id), ["column"]), "Separation": (profile.leakage_separation(df, target), ["column"]), "Groups": (leakage.candidates(df, target), ["column"])})


def remediation_report(stats: DataFrame) -> str:
    """Before and after a remediation, as Markdown."""
    return reports.report("Remediation", {"Counts": (stats, [stats.columns[0]])})


def audit_all(spark: SparkSession, registry: tables.DatasetRegistry, out: str | None = None) -> dict[str, str]:
    """The audit of every registered dataset as Markdown by name, and below ``out`` if it is given; one that can't be read has its error."""
    found = {}
    for name in registry.names():
        entry = registry.get(name)
        try:
            rows = registry.load(spark, name).withColumn("row_", F.monotonically_increasing_id())
            found[name] = audit_report(rows, entry.target, "row_")
        except (FileNotFoundError, ValueError) as e:
            found[name] = f"# Audit\n\n{type(e).__name__}: {e}\n"
        if out:
            Path(out).mkdir(parents=True, exist_ok=True)
            Path(out, f"{name}_audit.md").write_text(found[name])
    return found


def compare_runs(spark: SparkSession, folder: str, metric: str = "overall__accuracy_mean") -> dict[str, DataFrame]:
    """Friedman, Nemenyi, signed-rank tests and ranking over the datasets of a folder of results, of the models that all have."""
    scores = tables.strict_matrix(tables.read_many_results(spark, folder, metric)).select(F.lit("all").alias("group"), F.col("dataset").alias("obs"), "model", "score")
    return {"friedman": significance.friedman(scores, ["group"]), "nemenyi": significance.nemenyi(scores, ["group"]), "wilcoxon": significance.wilcoxon(scores, ["group"]), "ranking": significance.model_ranking(scores, ["group"])}


def audit_report(df: DataFrame, target: str, row_id: str) -> str:
    """All checks of a table as Markdown."""
    order = {"metadata": ["n_samples"], "placeholders": ["column", "token"], "corrupted_labels": ["label"], "duplicates": ["duplicates"], "imbalance": ["n_classes"]}
    return reports.report("Audit", {name: (found, order.get(name, ["column"])) for name, found in profile.audit(df, target, row_id).items()})
