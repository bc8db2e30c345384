"""Splits and folds by seeded hash order: a row's place depends on its key and the seed alone, not on partitions.

A long table folds(row key, repetition_id, fold_id) says where each row is tested; it trains in the others.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from gaugewright.operators.order import placed


def seeded(seed: Column | int, key: str) -> Column:
    """The order of rows for a seed."""
    return F.md5(F.concat(F.lit(seed).cast("string") if isinstance(seed, int) else seed.cast("string"), F.lit(":"), F.col(key).cast("string")))


def split(df: DataFrame, key: str, label: str | None, test_size: float, *, seed: int = 42) -> DataFrame:
    """df with a column part, train or test: of each class, or of all rows, round(n * test_size) test rows."""
    return three_way(df, key, label, 1 - test_size, 0.0, seed=seed)


def three_way(df: DataFrame, key: str, label: str | None, train: float, validation: float, *, seed: int = 42) -> DataFrame:
    """df with a column part: the first rows of a class in hash order test, then validation, the rest train.

    Without classes the rows are ordered in classes of their hash's first digits, so no task gets them all.
    """
    rows = df if label else df.withColumn("class__", F.substring(seeded(seed, key), 1, 2))
    test, val = F.round(F.col("n__") * round(1 - train - validation, 9)), F.round(F.col("n__") * validation)
    part = F.when(F.col("place__") <= test, "test").when(F.col("place__") <= test + val, "validation").otherwise("train")
    return placed(rows, [label or "class__"], seeded(seed, key), key).withColumn("part", part).drop("n__", "place__", "class__")


def folds(df: DataFrame, key: str, label: str | None, *, n_splits: int = 5, n_repetitions: int = 3, seed: int = 42) -> DataFrame:
    """(key, label, repetition_id, fold_id): rows of a class dealt out in turn, in the order of seed plus repetition."""
    columns = [key] + ([label] if label else [])
    rows = df.select(*columns).withColumn("repetition_id", F.explode(F.sequence(F.lit(0), F.lit(n_repetitions - 1))))
    order = seeded(F.col("repetition_id") + seed, key)
    if not label:
        rows = rows.withColumn("class__", F.substring(order, 1, 2))
    found = placed(rows, ["repetition_id", label or "class__"], order, key)
    return found.withColumn("fold_id", ((F.col("place__") - 1) % n_splits).cast("int")).drop("n__", "place__", "class__")


def fold_info(assigned: DataFrame, label: str) -> DataFrame:
    """Test and train sizes of each fold, and the percentage of each class among its test rows."""
    counts = assigned.groupBy("repetition_id", "fold_id", label).agg(F.count(F.lit(1)).alias("n"))
    by_fold, by_rep = Window.partitionBy("repetition_id", "fold_id"), Window.partitionBy("repetition_id")
    return counts.withColumn("test_size", F.sum("n").over(by_fold)).withColumn("train_size", F.sum("n").over(by_rep) - F.col("test_size")).withColumn("test_pct", 100.0 * F.col("n") / F.col("test_size"))


def validate(assigned: DataFrame, n_rows: int, n_splits: int, n_repetitions: int) -> DataFrame:
    """One row: whether every repetition covers each row once with every fold used."""
    by_rep = assigned.groupBy("repetition_id").agg(F.count(F.lit(1)).alias("n"), F.countDistinct("fold_id").alias("k"))
    return by_rep.agg(F.count(F.lit(1)).alias("repetitions"), F.min((F.col("n") == n_rows) & (F.col("k") == n_splits)).alias("covers")).withColumn("valid", F.col("covers") & (F.col("repetitions") == n_repetitions))


def check_feasible(df: DataFrame, label: str, n_splits: int) -> None:
    """An error where there are fewer rows, or rows of a class, than folds."""
    n, least = df.groupBy(label).agg(F.count(F.lit(1)).alias("n")).agg(F.sum("n"), F.min("n")).first()
    if n_splits > (n or 0):
        raise ValueError(f"n_splits={n_splits} cannot be greater than the number of samples: {n or 0}")
    if n_splits > least:
        raise ValueError(f"n_splits={n_splits} cannot be greater than the smallest class count: {least}")


def fallback_splits(df: DataFrame, label: str) -> tuple[int, bool]:
    """(number of folds, whether stratified) that the smallest class allows."""
    least = df.groupBy(label).agg(F.count(F.lit(1)).alias("n")).agg(F.min("n")).first()[0] or 0
    return (2, False) if least < 2 else (max(2, min(5, least)), True)
