"""The composite score: components by dataset and model, min-max normalised across a dataset's models, weighted and ranked."""

from __future__ import annotations

from functools import reduce
from operator import add

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from gaugewright.functions.columns import avg_rank
from gaugewright.operators.summary import QUALITY

#: The components and their weights.
WEIGHTS = {"f1": 0.30, "roc_auc": 0.20, "accuracy": 0.10, "precision": 0.10, "recall": 0.10, "time_score": 0.10, "stability_score": 0.10}
COMPONENTS = list(WEIGHTS)


def normalized_weights(weights: dict[str, float]) -> dict[str, float]:
    """Weights over their sum; an error unless that is positive."""
    total = sum(weights.values())
    if total <= 0:
        raise ValueError("composite weights must sum to a positive value")
    return {k: v / total for k, v in weights.items()}


def components(folds: DataFrame, keys: list[str], *, primary: str = "f1") -> DataFrame:
    """Means of the quality metrics (none: 0), total time and the primary metric's coefficient of variation and stability score."""
    mean = F.avg(primary)
    cv = F.when(F.count(primary) > 0, F.when(mean > 0, F.stddev_pop(primary) / mean).otherwise(0.0))  # as summary.stability has it
    return folds.groupBy(*keys).agg(*[F.coalesce(F.avg(m), F.lit(0.0)).alias(m) for m in [*QUALITY, "total_time"]], cv.alias("cv"), (1 / (1 + cv)).alias("stability_score"))


def raw_scores(parts: DataFrame, keys: list[str]) -> DataFrame:
    """Components before normalisation: time inverted, and stability score, else the inverted coefficient of variation."""
    return parts.select(*keys, *QUALITY, (1 / (1 + F.col("total_time"))).alias("time_score"), F.coalesce(F.col("stability_score"), 1 / (1 + F.col("cv"))).alias("stability_score"))


def minmax(value: Column, keys: list[str]) -> Column:
    """A value between its group's least and greatest: 1 for all if these are equal, 0.5 for a missing value and if all are missing."""
    over = Window.partitionBy(*keys)
    low, high = F.min(value).over(over), F.max(value).over(over)
    return F.when(low.isNull(), 0.5).when(low == high, 1.0).when(value.isNull(), 0.5).otherwise((value - low) / F.nullif(high - low, F.lit(0.0)))


def normalize(raw: DataFrame, keys: list[str] = ["dataset"]) -> DataFrame:  # noqa: B006
    """Each component by min-max across the models of a key."""
    return raw.select(*keys, "model", *[minmax(F.col(c), keys).alias(c) for c in COMPONENTS])


def weighted(weights: dict[str, float]) -> Column:
    """Weighted sum of components; a missing one counts 0."""
    return reduce(add, [F.lit(w) * F.coalesce(F.col(m), F.lit(0.0)) for m, w in weights.items()])


def scored(normalized: DataFrame, keys: list[str] = ["dataset"], weights: dict[str, float] = WEIGHTS) -> DataFrame:  # noqa: B006
    """Components with the score, each one's contribution to it and share of it, and the average-tie rank."""
    missing = [m for m in weights if m not in normalized.columns]
    if missing:
        raise ValueError(f"missing component columns {missing}")
    share = normalized_weights(weights)
    found = normalized.withColumn("cbs", weighted(share))
    parts = {f"contribution__{m}": F.lit(w) * F.col(m) for m, w in share.items()}
    shares = {f"contribution_pct__{m}": F.when(F.col("cbs") > 0, F.lit(w) * F.col(m) / F.col("cbs")) for m, w in share.items()}
    found = found.withColumns(parts | shares)
    # equal scores may differ in the last bits of their sums
    tied = found.withColumn("cbs_key", F.round("cbs", 12))
    return tied.withColumn("baseline_rank", avg_rank("cbs_key", keys)).drop("cbs_key")


def ranking(frame: DataFrame, keys: list[str] = ["dataset"]) -> DataFrame:  # noqa: B006
    """Position of each model by score, equal ones by name."""
    order = Window.partitionBy(*keys).orderBy(F.desc(F.round("cbs", 12)), "model")
    return frame.select(*keys, "model", "cbs", F.row_number().over(order).alias("position"), "baseline_rank")


def top(frame: DataFrame, k: int = 3, keys: list[str] = ["dataset"]) -> DataFrame:  # noqa: B006
    """The k best models of each key."""
    return ranking(frame, keys).where(F.col("position") <= k)


def against_saved(frame: DataFrame, saved: DataFrame, keys: list[str] = ["dataset"]) -> DataFrame:  # noqa: B006
    """Scores beside saved ones (keys, model, cbs) and their difference; null where none was saved."""
    before = saved.select(*keys, "model", F.col("cbs").alias("saved_cbs"))
    return frame.select(*keys, "model", "cbs").join(before, [*keys, "model"], "left").withColumn("difference", F.col("cbs") - F.col("saved_cbs"))
