"""Reading and writing tables, and the catalogue of named datasets."""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass, field
from pathlib import Path
from typing import Any

import numpy as np
from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

#: Names that a target column goes by, in the order they are looked for.
TARGET_NAMES = ["target", "Outcome", "Class", "y", "label", "payment_behaviour", "Payment_Behaviour", "kredit", "G3"]


def remediation_for(path: str, target: str) -> Callable[[DataFrame], DataFrame] | None:
    """The cleaning that a file needs by its path or target: the credit table's, the heart table's, or none."""
    from gaugewright.operators import clean

    if "Financial" in path or target == "Payment_Behaviour":
        return lambda df: clean.remediate_financial(df, target)[0]
    if "heart" in path.lower() and target == "target":
        return lambda df: clean.remediate_heart(df, target)[0]
    return None


def read_csv(spark: SparkSession, path: str, target: str, *, remediation: Callable[[DataFrame], DataFrame] | None = None, schema: str | None = None, **options: Any) -> DataFrame:
    """A CSV table with a header that has the target column, cleaned as it is said or as its path or target asks; FileNotFoundError and ValueError say what is missing."""
    reader = spark.read.option("header", True).options(**options)
    try:
        df = (reader.schema(schema) if schema else reader.option("inferSchema", True)).csv(path)
    except AnalysisException as e:
        if "PATH_NOT_FOUND" in str(e):
            raise FileNotFoundError(path) from e
        raise
    if remediation := remediation or (remediation_for(path, target) if target in df.columns else None):
        df = remediation(df)
    if target not in df.columns:
        raise ValueError(f"target {target!r} is not among the columns {df.columns}")
    return df


def read_numpy(spark: SparkSession, x_path: str, y_path: str) -> DataFrame:
    """(row_id, features, label) of two .npy files, which fit on the driver."""
    x, y = np.load(x_path), np.load(y_path)
    if len(x) != len(y):
        raise ValueError(f"{len(x)} rows and {len(y)} labels")
    return spark.createDataFrame([(i, [float(v) for v in row], float(t)) for i, (row, t) in enumerate(zip(x, y, strict=True))], "row_id long, features array<double>, label double")


def detect_target(spark: SparkSession, path: str) -> str:
    """The first column that goes by a target's name, else the last; reads the header alone."""
    columns = spark.read.option("header", True).csv(path).columns
    return next((n for n in TARGET_NAMES if n in columns), columns[-1])


def read_results(spark: SparkSession, folder: str) -> dict[str, DataFrame]:
    """normalized, cbs and, if there is one, raw results of a run's folder."""
    found = {}
    for name, file, needed in (("normalized", "normalized_results.csv", True), ("cbs", "cbs_scores.csv", True), ("raw", "raw_results.csv", False)):
        try:
            found[name] = spark.read.option("header", True).option("inferSchema", True).csv(f"{folder}/{file}")
        except AnalysisException as e:
            if needed:
                raise FileNotFoundError(f"{folder}/{file}") from e
    return found


def read_many_results(spark: SparkSession, folder: str, metric: str = "overall__accuracy_mean") -> DataFrame:
    """(dataset, model, score) of all folder/*/raw_results.csv that have the metric; the folder's name is the dataset's."""
    parts = []
    jvm = spark._jvm.org.apache.hadoop.fs
    pattern = jvm.Path(f"{folder}/*/raw_results.csv")
    # as many as there are datasets
    for status in pattern.getFileSystem(spark._jsc.hadoopConfiguration()).globStatus(pattern) or []:
        path = status.getPath()
        df = spark.read.option("header", True).option("inferSchema", True).csv(path.toString())
        if metric in df.columns and "model" in df.columns:
            parts.append(df.select(F.lit(path.getParent().getName()).alias("dataset"), "model", F.col(metric).cast("double").alias("score")))
    if not parts:
        return spark.createDataFrame([], "dataset string, model string, score double")
    out = parts[0]
    for p in parts[1:]:
        out = out.unionByName(p)
    return out


def strict_matrix(scores: DataFrame) -> DataFrame:
    """Mean score by dataset and model, of the models that all datasets have."""
    means = scores.where("score is not null").groupBy("dataset", "model").agg(F.avg("score").alias("score"))
    n = means.agg(F.countDistinct("dataset").alias("n_datasets"))
    whole = means.groupBy("model").agg(F.count(F.lit(1)).alias("n")).crossJoin(F.broadcast(n)).where("n = n_datasets").select("model")
    return means.join(F.broadcast(whole), "model", "left_semi")


def write_csv(df: DataFrame, path: str) -> None:
    """A result table as one CSV file with a header."""
    df.coalesce(1).write.mode("overwrite").option("header", True).csv(path)


def write_predictions(predictions: DataFrame, path: str) -> None:
    """Predictions in a folder for each model."""
    predictions.write.mode("overwrite").partitionBy("model").parquet(path)


def read_predictions(spark: SparkSession, path: str) -> DataFrame:
    """Predictions in folders by model, or by model, repetition and fold."""
    return spark.read.parquet(path)


@dataclass
class Dataset:
    """An entry of the catalogue."""

    path: str
    target: str
    description: str = ""
    task: str = "classification"
    remediation: Callable[[DataFrame], DataFrame] | None = None
    extra: dict[str, Any] = field(default_factory=dict)


class DatasetRegistry:
    """Datasets by name; a name registered again takes its new entry."""

    def __init__(self) -> None:
        self._held: dict[str, Dataset] = {}

    def register(self, name: str, dataset: Dataset) -> None:
        self._held[name] = dataset

    def get(self, name: str) -> Dataset:
        if name not in self._held:
            raise KeyError(f"dataset {name!r} is not registered; known: {sorted(self._held)}")
        return self._held[name]

    def names(self, task: str | None = None) -> list[str]:
        return sorted(n for n, d in self._held.items() if task in (None, d.task))

    def exists(self, name: str) -> bool:
        return name in self._held

    def clear(self) -> None:
        self._held.clear()

    def load(self, spark: SparkSession, name: str, **options: Any) -> DataFrame:
        entry = self.get(name)
        read = spark.read.parquet(entry.path) if Path(entry.path).suffix == ".parquet" else None
        if read is None:
            return read_csv(spark, entry.path, entry.target, remediation=entry.remediation, **options)
        return entry.remediation(read) if entry.remediation else read


def default_registry(folder: str) -> DatasetRegistry:
    """A catalogue with the two datasets that need remediation, in a folder."""
    from gaugewright.operators import clean

    found = DatasetRegistry()
    found.register("Financial", Dataset(f"{folder}/Financial.csv", "Payment_Behaviour", remediation=lambda df: clean.remediate_financial(df)[0]))
    found.register("heart", Dataset(f"{folder}/heart.csv", "target", remediation=lambda df: clean.remediate_heart(df)[0]))
    return found
