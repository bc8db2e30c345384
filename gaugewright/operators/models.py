"""Models by name, out-of-fold predictions, and cross-validation that leaves out folds already done.

A model is a function of nothing to a Spark ML estimator with columns features and label. Kernel support
vector machines have no Spark counterpart: ``svm`` is a linear one, one against the rest.
"""

from __future__ import annotations

import time
from collections.abc import Callable
from functools import reduce
from multiprocessing.pool import ThreadPool
from threading import Lock
from typing import Any

import numpy as np
from pyspark.ml import Estimator, Model
from pyspark.ml.classification import DecisionTreeClassifier, GBTClassifier, LinearSVC, LogisticRegression, OneVsRest, RandomForestClassifier
from pyspark.ml.functions import array_to_vector, vector_to_array
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from gaugewright.operators import fits
from gaugewright.operators.scoring import auc_one_vs_rest, fold_metrics

Maker = Callable[[], Estimator]
_FOLD = ["model", "repetition_id", "fold_id"]

#: Bytes of features that a task of a fit is worth: a boosted tree is several jobs, whose tasks on a few rows are all overhead.
TASK_BYTES = 32 << 20


class ModelRegistry:
    """Makers by name and alias; names are compared in lower case."""

    def __init__(self) -> None:
        self._makers: dict[str, Maker] = {}
        self._l2: dict[str, float] = {}
        self._aliases = {"lr": "logisticregression", "dt": "decisiontree", "rf": "randomforest", "svm": "linearsvm", "gb": "gradientboosting"}

    def register(self, name: str, maker: Maker, *, l2: float = 0.0) -> None:
        """l2: weight of the squared coefficients against the summed loss of all rows, whatever their number; Spark's is against their mean."""
        if not callable(maker):
            raise TypeError("a model is registered as a function that makes an estimator")
        self._makers[name.lower()], self._l2[name.lower()] = maker, l2

    def _key(self, name: str) -> str:
        key = self._aliases.get(name.lower(), name.lower())
        if key not in self._makers:
            raise KeyError(f"unknown model {name!r}; known: {self.names()}")
        return key

    def create(self, name: str, rows: int = 0) -> Estimator:
        """A new estimator; rows: those it will be fitted to, which a model with an l2 term needs."""
        made = self._makers[key := self._key(name)]()
        if self._l2.get(key) and rows:
            (made.getClassifier() if isinstance(made, OneVsRest) else made).setRegParam(self._l2[key] / rows)
        return made

    def names(self) -> list[str]:
        return sorted(self._makers)

    def exists(self, name: str) -> bool:
        return self._aliases.get(name.lower(), name.lower()) in self._makers

    def info(self, name: str) -> dict[str, Any]:
        """Estimator, parameters that differ from its defaults, l2 term and aliases of a model."""
        key = self._key(name)
        made = self.create(key)
        inner = made.getClassifier() if isinstance(made, OneVsRest) else made
        return {"name": key, "estimator": type(inner).__name__, "one_against_rest": inner is not made, "parameters": {p.name: v for p, v in inner._paramMap.items()}, "l2": self._l2.get(key, 0.0), "aliases": sorted(a for a, k in self._aliases.items() if k == key)}

    def by_estimator(self) -> dict[str, list[str]]:
        """Names by the estimator they make."""
        found: dict[str, list[str]] = {}
        for name in self.names():
            found.setdefault(self.info(name)["estimator"], []).append(name)
        return found


def default_models(seed: int = 42) -> ModelRegistry:
    found = ModelRegistry()
    found.register("LogisticRegression", lambda: LogisticRegression(maxIter=1000, standardization=False), l2=1.0)
    found.register("DecisionTree", lambda: DecisionTreeClassifier(maxDepth=30, seed=seed))
    found.register("RandomForest", lambda: RandomForestClassifier(numTrees=100, maxDepth=30, seed=seed))
    found.register("LinearSVM", lambda: OneVsRest(classifier=LinearSVC(), parallelism=2), l2=1.0)
    found.register("GradientBoosting", lambda: OneVsRest(classifier=GBTClassifier(maxIter=100, maxDepth=3, seed=seed), parallelism=2))
    return found


def _vectors(rows: DataFrame) -> DataFrame:
    return rows.withColumns({"features": array_to_vector(F.col("features").cast("array<double>")), **({"label": F.col("label").cast("double")} if "label" in rows.columns else {})})


def _scored(fitted: Model, rows: DataFrame, key: str) -> DataFrame:
    """(row_id, y_true, y_pred, proba) of rows; proba is null for a model without probabilities, y_true for rows without a label."""
    found = fitted.transform(rows)
    text = lambda c: F.col(c).cast("int").cast("string")
    proba = vector_to_array("probability") if "probability" in found.columns else F.lit(None).cast("array<double>")
    return found.select(F.col(key).alias("row_id"), (text("label") if "label" in rows.columns else F.lit(None).cast("string")).alias("y_true"), text("prediction").alias("y_pred"), proba.alias("proba"))


class Classifier:
    """A model by name that fits rows (features as an array, label) and predicts others; asking before it is fitted is an error."""

    def __init__(self, name: str, registry: ModelRegistry | None = None):
        self.name, self.registry, self.fitted = name, registry or default_models(), None

    def fit(self, rows: DataFrame) -> Classifier:
        self.fitted = self.registry.create(self.name, rows.count()).fit(_vectors(rows))
        return self

    def predictions(self, rows: DataFrame, key: str) -> DataFrame:
        """(row_id, y_true, y_pred, proba) for each row."""
        if self.fitted is None:
            raise RuntimeError("fit before predictions")
        return _scored(self.fitted, _vectors(rows), key)

    def score(self, rows: DataFrame, key: str) -> dict[str, Any]:
        """The metrics of the predictions of labelled rows."""
        found = self.predictions(rows, key).select(F.lit(self.name).alias("model"), F.lit(0).alias("repetition_id"), F.lit(0).alias("fold_id"), "*")
        return {k: v for k, v in measured(found).first().asDict().items() if k not in _FOLD}


def worklist(models: DataFrame, folds: DataFrame, done: DataFrame) -> DataFrame:
    """(model, repetition_id, fold_id) that have no result yet."""
    work = folds.select("repetition_id", "fold_id").distinct().crossJoin(F.broadcast(models.select("model")))
    return work.join(done.select("model", "repetition_id", "fold_id").distinct(), ["model", "repetition_id", "fold_id"], "left_anti")


def out_of_fold(rows: DataFrame, folds: DataFrame, key: str, names: list[str], *, registry: ModelRegistry | None = None, done: DataFrame | None = None, on_fold: Callable[[dict, DataFrame | None], None] | None = None, sink: str | None = None, parallelism: int = 8) -> tuple[DataFrame, list[dict]]:
    """Predictions (model, repetition_id, fold_id, row_id, y_true, y_pred, proba) of each row by the models of the folds it is tested in, and a row of times for each fit.

    On a table that fits a task, models that ``fits`` knows are fitted by tasks with some trees or classes each, all fits in
    one job, or in a job each with ``on_fold`` or ``sink``. Other fits are jobs of Spark ML. Jobs run side by side, ``parallelism`` at a time. With ``sink``, predictions are
    written there in folders by model, repetition and fold, which replace what stood there, else they are kept in memory. ``on_fold`` gets a
    fit's row and its predictions, one at a time; there a model that fails has a row with its error, and no predictions.
    Without ``on_fold`` nobody would be told: the first failure ends the run and is raised.
    """
    registry = registry or default_models()
    spark = rows.sparkSession
    folds = folds.select(key, "repetition_id", "fold_id").persist()
    models = spark.createDataFrame([(n,) for n in names], "model string")
    # a row for each fit, and for each fold
    work = [tuple(w) for w in sorted(worklist(models, folds, done if done is not None else models.withColumn("repetition_id", F.lit(-1)).withColumn("fold_id", F.lit(-1))).collect())]
    table = fits.collected(rows, folds, key) if work and "label" in rows.columns else None
    small = fits.Fits(spark, *table, rows.schema[key].dataType.simpleString()) if table else None
    if table:
        sizes = {(r, int(f)): int(n) for r, of in enumerate(table[0].fold) for f, n in zip(*np.unique(of[of >= 0], return_counts=True), strict=True)}
        width = 8 * table[0].x.shape[1]
    else:
        sizes = {(r[0], r[1]): r[2] for r in rows.select(key).join(folds, key).groupBy("repetition_id", "fold_id").count().collect()}
        width = 8 * (rows.agg(F.max(F.size("features"))).first()[0] or 1)
    del table
    joined = _vectors(rows).join(folds, key).persist()
    lock, kept, failed = Lock(), [], []
    kind = f"model string, repetition_id int, fold_id int, row_id {rows.schema[key].dataType.simpleString()}, y_true string, y_pred string, proba array<double>"

    def ready(model: str, repetition: int, fold: int) -> tuple[int, Estimator, dict[str, Any] | None]:
        """Rows to fit to, the estimator, and its parameters if it is fitted in tasks."""
        n = sum(k for (r, f), k in sizes.items() if r == repetition and f != fold)
        made = registry.create(model, n)
        return n, made, fits.plan(made) if small else None

    def told(row: dict, e: Exception) -> None:
        row["error"] = f"{type(e).__name__}: {str(e)[:200]}"
        if not on_fold:
            failed.append((f"{row['model']} failed in repetition {row['repetition_id']}, fold {row['fold_id']}: {row['error']}", e))

    def one(item: tuple[str, int, int]) -> tuple[dict, DataFrame | None]:
        model, repetition, fold = item
        if failed:
            return {}, None
        row, found = {"model": model, "repetition_id": int(repetition), "fold_id": int(fold), "error": None}, None
        part = joined.where(F.col("repetition_id") == repetition)
        try:
            began = time.perf_counter()
            n, made, planned = ready(*item)
            if planned:
                given = small.predictions([(*item, planned)]).drop("train_time", "eval_time").persist()
                given.count()
                scored = given.drop(*_FOLD)
            else:
                given, train = None, part.where(F.col("fold_id") != fold)
                fitted = made.fit(train.coalesce(tasks) if (tasks := -(-n * width // TASK_BYTES) or 1) < joined.rdd.getNumPartitions() else train)
                scored = _scored(fitted, part.where(F.col("fold_id") == fold), key)
            row["train_time"] = time.perf_counter() - began
            began = time.perf_counter()
            if sink:
                path = f"{sink}/model={model}/repetition_id={repetition}/fold_id={fold}"
                scored.write.mode("overwrite").parquet(path)
                scored = spark.read.schema(scored.schema).parquet(path)
                if given is not None:
                    given.unpersist()
            else:
                scored = (scored if given is None else given).persist()
                scored.count()
                kept.append(scored)
            found = scored.select(F.lit(model).alias("model"), F.lit(repetition).cast("int").alias("repetition_id"), F.lit(fold).cast("int").alias("fold_id"), "row_id", "y_true", "y_pred", "proba")
            row["eval_time"] = time.perf_counter() - began
        except Exception as e:  # a model that fails doesn't end a run that is told of it
            told(row, e)
        if on_fold:
            with lock:
                on_fold(row, found)
        return row, found

    def together() -> tuple[DataFrame | None, list[dict]]:
        """Predictions and rows of the fits in tasks, all in one job; the other fits stay in work."""
        items, rest = [], []
        for item in work:
            try:
                planned = ready(*item)[2]
            except Exception as e:
                told({"model": item[0], "repetition_id": item[1], "fold_id": item[2]}, e)
                return None, []
            (items.append((*item, planned)) if planned else rest.append(item))
        if not items:
            return None, []
        scored = small.predictions(items).persist()
        times = {tuple(r[:3]): (r[3], r[4]) for r in scored.groupBy(*_FOLD).agg(F.max("train_time"), F.max("eval_time")).collect()}
        work[:] = rest
        return scored, [{"model": m, "repetition_id": r, "fold_id": f, "error": None} | dict(zip(("train_time", "eval_time"), times.get((m, r, f), (None, None)), strict=True)) for m, r, f, _ in items]

    try:
        first, times = together() if small and not on_fold and not sink else (None, [])
        with ThreadPool(max(1, min(parallelism, len(work)))) as pool:
            made = pool.map(one, [] if failed else work, chunksize=1)
    finally:
        joined.unpersist()
        folds.unpersist()
    if failed:
        for scored in kept:
            scored.unpersist()
        raise RuntimeError(failed[0][0]) from failed[0][1]
    whole = reduce(DataFrame.unionByName, [p for _, p in made if p is not None], spark.createDataFrame([], kind) if first is None else first.drop("train_time", "eval_time"))
    if kept:  # one table for all fits, as each use of theirs would be a stage for every one
        whole = whole.coalesce(spark.sparkContext.defaultParallelism).persist()
        whole.count()
        for scored in kept:
            scored.unpersist()
    return whole, times + [r for r, _ in made]


def measured(predictions: DataFrame) -> DataFrame:
    """Metrics of out-of-fold predictions for each model, repetition and fold; roc_auc over the labels that a fold has, null without probabilities."""
    long = predictions.where("proba is not null").select(*_FOLD, "y_true", F.posexplode("proba").alias("label", "score")).withColumn("label", F.col("label").cast("string"))
    seen = long.join(predictions.select(*_FOLD, F.col("y_true").alias("label")).distinct(), [*_FOLD, "label"], "left_semi")
    return fold_metrics(predictions, _FOLD).join(auc_one_vs_rest(seen, _FOLD), _FOLD, "left")


def prediction_summary(predictions: DataFrame) -> DataFrame:
    """Rows and hits of out-of-fold predictions by model, label and prediction, over all folds."""
    return predictions.groupBy("model", "y_true", "y_pred").agg(F.count(F.lit(1)).alias("n"), F.countDistinct("row_id").alias("n_rows"))


def run_fold(rows: DataFrame, folds: DataFrame, key: str, name: str, repetition: int, fold: int, *, registry: ModelRegistry | None = None) -> tuple[DataFrame, dict]:
    """Predictions and times of one model in one fold."""
    others = folds.select("repetition_id", "fold_id").distinct().where(~((F.col("repetition_id") == repetition) & (F.col("fold_id") == fold)))
    found, times = out_of_fold(rows, folds, key, [name], registry=registry, done=others.withColumn("model", F.lit(name)))
    return found, times[0]


def cross_validate(rows: DataFrame, folds: DataFrame, key: str, names: list[str], *, registry: ModelRegistry | None = None, done: DataFrame | None = None, on_fold: Callable[[dict], None] | None = None, sink: str | None = None, parallelism: int = 8) -> DataFrame:
    """Metrics of each model and fold over rows (key, features as an array, label).

    ``done`` (model, repetition_id, fold_id) names what to leave out. ``on_fold`` gets each row as it is done, and a model
    that fails has a row with its error; without it, a failure is raised, and metrics of all folds come from one pass over their predictions. ``sink`` keeps the predictions, as
    out_of_fold does.
    """
    rows_of: list[dict] = []

    def told(row: dict, found: DataFrame | None) -> None:
        if found is not None:
            row |= {k: v for k, v in measured(found).first().asDict().items() if k not in _FOLD}
        on_fold(row)

    predictions, rows_of = out_of_fold(rows, folds, key, names, registry=registry, done=done, on_fold=told if on_fold else None, sink=sink, parallelism=parallelism)
    if not on_fold and rows_of:
        by = {tuple(r[k] for k in _FOLD): r.asDict() for r in measured(predictions).collect()}  # a row for each fit
        if lost := [at for r in rows_of if (at := tuple(r[k] for k in _FOLD)) not in by]:
            raise RuntimeError(f"no predictions of {lost[:5]}")
        rows_of = [r | by[tuple(r[k] for k in _FOLD)] for r in rows_of]
    schema = "model string, repetition_id int, fold_id int, error string, accuracy double, precision double, recall double, f1 double, mcc double, roc_auc double, n_samples long, n_classes long, train_time double, eval_time double"
    columns = [c.split()[0] for c in schema.split(", ")]
    return rows.sparkSession.createDataFrame([tuple(r.get(n) for n in columns) for r in rows_of], schema)
