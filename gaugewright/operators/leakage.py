"""Group leakage: how much of a test set has its entity in training."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from gaugewright.operators.profile import distinct_counts

#: Words in the names of columns that may group rows.
GROUP_WORDS = ["customer_id", "student_id", "user_id", "session_id", "device_id", "member_id", "account_id", "group_id", "subject_id", "id"]


def candidates(df: DataFrame, target: str, words: list[str] = GROUP_WORDS) -> DataFrame:
    """Columns named like groups, neither unique nor constant."""
    named = [c for c in df.columns if c != target and any(w in c.lower() for w in words)]
    return distinct_counts(df, named).where("n_unique > 1 and n_unique < n_rows and top >= 2").select("column", "n_unique", F.col("top").alias("max_group_size"))


def group_statistics(df: DataFrame, group: str) -> DataFrame:
    """Sizes of groups: number, mean, median, extremes, std, and how many groups and rows are of repeated ones."""
    sizes = df.where(F.col(group).isNotNull()).groupBy(group).agg(F.count(F.lit(1)).alias("n"))
    again = F.col("n") > 1
    # the median's task holds the different sizes of groups: of m rows fewer than sqrt(2 m)
    found = sizes.agg(
        F.count(F.lit(1)).alias("n_groups"), F.sum("n").alias("n_rows"), F.avg("n").alias("mean_size"), F.median("n").alias("median_size"), F.max("n").alias("max_size"), F.min("n").alias("min_size"),
        F.coalesce(F.stddev_samp("n"), F.lit(0.0)).alias("std_size"), F.count_if(again).alias("n_repeated"), F.coalesce(F.sum(F.when(again, F.col("n"))), F.lit(0)).alias("rows_repeated"),
    )
    return found.withColumn("pct_repeated", 100.0 * F.col("n_repeated") / F.col("n_groups")).withColumn("pct_rows_repeated", 100.0 * F.col("rows_repeated") / F.col("n_rows"))


def fold_leakage(assigned: DataFrame, group: str) -> DataFrame:
    """For each repetition and fold: test rows and groups, and the percentage of each whose group is in another fold too.

    One count by group and fold and one window over a group's folds; rows of a group are never compared.
    """
    cells = assigned.groupBy("repetition_id", group, "fold_id").agg(F.count(F.lit(1)).alias("n"))
    elsewhere = F.count(F.lit(1)).over(Window.partitionBy("repetition_id", group)) > 1
    found = cells.withColumn("leaked", elsewhere.cast("int"))
    return found.groupBy("repetition_id", "fold_id").agg(F.sum("n").alias("test_rows"), F.count(F.lit(1)).alias("test_groups"), (100.0 * F.sum(F.col("n") * F.col("leaked")) / F.sum("n")).alias("pct_rows_leaked"), (100.0 * F.sum("leaked") / F.count(F.lit(1))).alias("pct_groups_leaked"))


def split_leakage(parts: DataFrame, group: str) -> DataFrame:
    """The same for one split with a column part: groups of test rows that train rows have."""
    cells = parts.groupBy(group).agg(F.count_if(F.col("part") == "test").alias("test"), F.count_if(F.col("part") == "train").alias("train")).where("test > 0")
    both = F.col("train") > 0
    return cells.agg(F.sum("test").alias("test_rows"), F.count(F.lit(1)).alias("test_groups"), (100.0 * F.sum(F.when(both, F.col("test")).otherwise(0)) / F.sum("test")).alias("pct_rows_leaked"), (100.0 * F.count_if(both) / F.count(F.lit(1))).alias("pct_groups_leaked"))


def risk(statistics: DataFrame, fold_leaks: DataFrame, n_classes: int) -> DataFrame:
    """Recommendation and confidence from group sizes and the mean leakage over folds."""
    mean = fold_leaks.agg(F.avg("pct_rows_leaked").alias("cv_pct"))
    found = statistics.crossJoin(F.broadcast(mean)).withColumn("unique_ratio", F.col("n_groups") / F.col("n_rows"))
    category = (F.col("unique_ratio") < 0.05) & (F.col("n_groups") < 30)
    genuine = (F.col("mean_size") >= 2) & (F.col("pct_rows_repeated") > 50) & (F.col("unique_ratio") > 0.01)
    few = (F.col("pct_rows_repeated") < 10) | (F.col("mean_size") < 1.5)
    safe, group = "Safe for current StratifiedKFold", "StratifiedGroupKFold recommended" if n_classes <= 10 else "GroupKFold recommended"
    advice = F.when(category, safe).when(genuine & (F.col("cv_pct") > 80), group).when(genuine & (F.col("cv_pct") > 50), "GroupKFold recommended").when(few, safe).otherwise("Insufficient evidence")
    sure = F.when(category | (genuine & (F.col("cv_pct") > 80)), "HIGH").when(genuine & (F.col("cv_pct") > 50), "MEDIUM").when(few, "HIGH").otherwise("LOW")
    return found.select("n_groups", "unique_ratio", "mean_size", "pct_rows_repeated", "cv_pct", advice.alias("recommendation"), sure.alias("confidence"))


def verdict(risks: DataFrame) -> DataFrame:
    """One recommendation for a table from those of its columns (column, recommendation): the strongest group one by column order, else safe; safe too without columns."""
    group = F.col("recommendation").contains("GroupKFold")
    first = F.min(F.when(group, F.struct((~F.col("recommendation").startswith("Stratified")).cast("int").alias("weaker"), "column", "recommendation")))
    found = risks.agg(first.alias("g"), F.count(F.lit(1)).alias("n_columns"))
    return found.select("n_columns", F.coalesce("g.recommendation", F.lit("Safe for current StratifiedKFold")).alias("recommendation"), F.when(F.col("g").isNull(), "HIGH").otherwise("MEDIUM").alias("confidence"))


def runtime_estimate(tables: DataFrame, *, folds: int = 25) -> DataFrame:
    """Estimated seconds of five models over (dataset, n_rows, n_features), and a cost class."""
    size, wide = F.col("n_rows") / 1000.0, F.col("n_features") / 10.0
    seconds = (F.pow(size, F.lit(2.5)) * wide + size * wide * (2 + 3 + 2 * 0.5)) * folds
    cost = F.when(F.col("estimate_s") < 60, "Safe to rerun now").when(F.col("estimate_s") < 600, "High compute cost").otherwise("Very high compute cost")
    return tables.withColumn("estimate_s", seconds).withColumn("cost_class", cost).withColumn("svm_bottleneck", F.col("n_rows") > 10000).withColumn("memory_bottleneck", F.col("n_rows") * F.col("n_features") > 500000)
