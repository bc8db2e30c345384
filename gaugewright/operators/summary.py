"""Aggregation of fold metrics: a long table (keys, metric, value) of one row per fold and metric."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from gaugewright.functions.columns import ratio

QUALITY = ["f1", "roc_auc", "accuracy", "precision", "recall"]
TIMES = ["train_time", "eval_time", "total_time"]


def to_long(wide: DataFrame, keys: list[str], metrics: list[str]) -> DataFrame:
    """One row for each key and metric."""
    return wide.unpivot(keys, metrics, "metric", "value")


def summarize(long: DataFrame, keys: list[str], *, ddof: int = 1) -> DataFrame:
    """mean, std, min, max and n of the values that aren't null, by key and metric; the std of one value is null for ddof 1."""
    std = F.stddev_samp("value") if ddof else F.stddev_pop("value")
    return long.groupBy(*keys, "metric").agg(F.avg("value").alias("mean"), std.alias("std"), F.min("value").alias("min"), F.max("value").alias("max"), F.count("value").alias("n"))


def summarize_levels(long: DataFrame, keys: list[str]) -> DataFrame:
    """Population statistics overall, by repetition and by fold in one pass; a null among the values makes its group's null."""
    whole = lambda c: F.when(F.count("value") == F.count(F.lit(1)), c)
    columns = [F.col(k) for k in [*keys, "metric"]]
    sets = [columns, [*columns, F.col("repetition_id")], [*columns, F.col("fold_id")]]
    level = F.when(F.grouping("repetition_id") == 0, "repetition").when(F.grouping("fold_id") == 0, "fold").otherwise("overall")
    found = long.groupingSets(sets, *columns, F.col("repetition_id"), F.col("fold_id")).agg(level.alias("level"), whole(F.avg("value")).alias("mean"), whole(F.stddev_pop("value")).alias("std"), whole(F.min("value")).alias("min"), whole(F.max("value")).alias("max"))
    return found.select(*keys, "metric", "level", F.coalesce("repetition_id", "fold_id").alias("group_id"), "mean", "std", "min", "max")


def run_totals(runs: DataFrame, keys: list[str]) -> DataFrame:
    """Numbers of folds and repetitions, and totals of sizes and times."""
    n, reps = F.count(F.lit(1)), F.countDistinct("repetition_id")
    return runs.groupBy(*keys).agg(n.alias("n_folds"), reps.alias("n_repetitions"), (n / reps).alias("folds_per_repetition"), F.sum("n_samples").alias("n_samples"), *[F.sum(t).alias(t) for t in TIMES])


def best_worst(long: DataFrame, keys: list[str]) -> DataFrame:
    """The folds with the greatest and the least value; of equal ones the first by repetition and fold; missing values lose."""
    place = lambda sign: F.struct((sign * F.col("value")).alias("v"), (-F.col("repetition_id")).alias("r"), (-F.col("fold_id")).alias("f"))
    found = long.where("value is not null").groupBy(*keys, "metric").agg(F.max(place(1)).alias("best"), F.max(place(-1)).alias("worst"))
    side = lambda s, sign: [(-F.col(f"{s}.r")).alias(f"{s}_repetition"), (-F.col(f"{s}.f")).alias(f"{s}_fold"), (sign * F.col(f"{s}.v")).alias(f"{s}_value")]
    return found.select(*keys, "metric", *side("best", 1), *side("worst", -1))


def stability(long: DataFrame, keys: list[str]) -> DataFrame:
    """mean, population std, min, max, range, n, coefficient of variation (0 for a mean of 0 or less) and score 1 / (1 + it)."""
    found = summarize(long, keys, ddof=0).where("n > 0")
    cv = F.when(F.col("mean") > 0, F.col("std") / F.col("mean")).otherwise(0.0)
    return found.withColumn("range", F.col("max") - F.col("min")).withColumn("cv", cv).withColumn("stability_score", 1 / (1 + F.col("cv")))


def cross_repetition_stability(long: DataFrame, keys: list[str]) -> DataFrame:
    """Stability of the repetitions' means."""
    means = long.groupBy(*keys, "metric", "repetition_id").agg(F.avg("value").alias("value"))
    return stability(means, keys)


def stability_level(cv: Column, threshold: float = 0.05) -> Column:
    """High up to the threshold, Medium up to twice, else Low; Unknown without a value."""
    return F.when(cv.isNull(), "Unknown").when(cv <= threshold, "High").when(cv <= 2 * threshold, "Medium").otherwise("Low")


def assess(long: DataFrame, keys: list[str], *, metric: str = "f1", threshold: float = 0.05) -> DataFrame:
    """Stability of one metric as a level."""
    found = stability(long.where(F.col("metric") == metric), keys)
    return found.select(*keys, F.col("mean").alias("primary_metric_mean"), F.col("std").alias("primary_metric_std"), F.col("cv").alias("primary_metric_cv"), (F.col("cv") <= threshold).alias("is_stable"), stability_level(F.col("cv"), threshold).alias("stability_level"))


def fold_timing(runs: DataFrame) -> DataFrame:
    """Total, per-sample and relative times of each fold; 0 where there is nothing to divide by."""
    return runs.withColumn("train_time_per_sample", ratio(F.col("train_time"), F.col("n_train"))).withColumn("eval_time_per_sample", ratio(F.col("eval_time"), F.col("n_test"))).withColumn("train_eval_ratio", F.when(F.col("train_time") > 0, F.col("eval_time") / F.col("train_time")).otherwise(0.0))


def timing(runs: DataFrame, keys: list[str]) -> DataFrame:
    """mean, population std, min, max and total of each time, and the number of folds."""
    found = [f(t).alias(f"{t}_{n}") for t in TIMES for n, f in (("mean", F.avg), ("std", F.stddev_pop), ("min", F.min), ("max", F.max), ("total", F.sum))]
    return runs.groupBy(*keys).agg(*found, F.count(F.lit(1)).alias("n_folds"))


def efficiency(runs: DataFrame, keys: list[str]) -> DataFrame:
    """Average times of a fold, score 1 / (1 + average total time) and total cost."""
    found = timing(runs, keys)
    return found.select(*keys, *[F.col(f"{t}_mean").alias(f"avg_{t}") for t in TIMES], F.when(F.col("total_time_mean") > 0, 1 / (1 + F.col("total_time_mean"))).otherwise(1.0).alias("efficiency_score"), F.col("total_time_total").alias("total_cost"))


def range_errors(long: DataFrame, bounded: list[str] = QUALITY) -> DataFrame:
    """A row for each value that is missing, not finite, or outside [0, 1] for a bounded metric."""
    odd = F.when(F.col("value").isNull() | F.isnan("value"), "missing").when(F.abs("value") == float("inf"), "not finite").when(F.col("metric").isin(bounded) & ((F.col("value") < 0) | (F.col("value") > 1)), "outside [0, 1]")
    return long.withColumn("error", odd).where("error is not null")


def normal_interval(long: DataFrame, keys: list[str], *, confidence: float = 0.95) -> DataFrame:
    """Mean and normal interval: 1.96 standard errors at 95 %, 2.576 at any other confidence."""
    z = 1.96 if confidence == 0.95 else 2.576
    margin = z * F.col("std") / F.sqrt("n")
    return summarize(long, keys).select(*keys, "metric", "mean", (F.col("mean") - margin).alias("low"), (F.col("mean") + margin).alias("high"))
