"""Robustness of the composite score. Frames have a column dataset; every analysis is done within each."""

from __future__ import annotations

from functools import reduce
from operator import add

import numpy as np
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from gaugewright.functions.columns import avg_rank, clip, safe_corr, t_two_sided
from gaugewright.operators.composite import COMPONENTS, WEIGHTS, normalized_weights, raw_scores, weighted

LEVELS = (0.05, 0.10, 0.20)


def _weights_table(spark: SparkSession, rows: list[tuple], keys: str) -> DataFrame:
    """A table of weight vectors: as many rows as scenarios, so it can go to every task."""
    return F.broadcast(spark.createDataFrame(rows, f"{keys}, " + ", ".join(f"w_{m} double" for m in COMPONENTS)))


def _score() -> Column:
    return reduce(add, [F.col(f"w_{m}") * F.coalesce(F.col(m), F.lit(0.0)) for m in COMPONENTS])


def _ranked(scores: DataFrame, keys: list[str], value: str, to: str) -> DataFrame:
    return scores.withColumn("key_", F.round(value, 12)).withColumn(to, avg_rank("key_", keys)).drop("key_")


def small_perturbations(frame: DataFrame, delta: float = 0.01, weights: dict[str, float] = WEIGHTS) -> DataFrame:
    """Change of the score when one component moves by delta either way within [0, 1]: in closed form, one row a model, component and direction."""
    share = normalized_weights(weights)
    long = frame.unpivot(["dataset", "model", "cbs"], COMPONENTS, "metric", "baseline_metric")
    weight = F.element_at(F.create_map(*[F.lit(x) for kv in share.items() for x in kv]), F.col("metric"))
    ways = F.explode(F.array(F.struct(F.lit("up").alias("direction"), F.lit(delta).alias("perturbation")), F.struct(F.lit("down").alias("direction"), F.lit(-delta).alias("perturbation")))).alias("way")
    moved = long.select("*", ways).select("dataset", "model", "metric", "way.direction", "baseline_metric", "way.perturbation", F.col("cbs").alias("baseline_cbs"))
    change = weight * (clip(F.col("baseline_metric") + F.col("perturbation")) - F.col("baseline_metric"))
    return moved.withColumn("delta_cbs", change).withColumn("perturbed_cbs", F.col("baseline_cbs") + F.col("delta_cbs")).withColumn("absolute_delta_cbs", F.abs("delta_cbs"))


def noise_perturbations(frame: DataFrame, noise: DataFrame, spread: Column, weights: dict[str, float] = WEIGHTS) -> DataFrame:
    """Score under noise on one component: noise (sample_id, z) of standard normal draws, times spread.

    One row a model and component: mean score, its change, mean absolute change, std and 95 % quantile interval.
    """
    share = normalized_weights(weights)
    weight = F.element_at(F.create_map(*[F.lit(x) for kv in share.items() for x in kv]), F.col("metric"))
    long = frame.withColumn("spread", spread).unpivot(["dataset", "model", "cbs", "spread"], COMPONENTS, "metric", "baseline_metric")
    drawn = long.join(F.broadcast(noise)).withColumn("score", F.col("cbs") + weight * (clip(F.col("baseline_metric") + F.col("spread") * F.col("z")) - F.col("baseline_metric")))
    found = drawn.groupBy("dataset", "model", "metric").agg(
        F.max("baseline_metric").alias("baseline_metric"), F.max("spread").alias("perturbation"), F.max("cbs").alias("baseline_cbs"), F.avg("score").alias("perturbed_cbs"),
        F.avg(F.abs(F.col("score") - F.col("cbs"))).alias("absolute_delta_cbs"), F.stddev_samp("score").alias("cbs_std"), F.percentile("score", F.lit(0.025)).alias("cbs_lower"), F.percentile("score", F.lit(0.975)).alias("cbs_upper"),
    )
    return found.withColumn("delta_cbs", F.col("perturbed_cbs") - F.col("baseline_cbs"))


def noise_table(spark: SparkSession, samples: int, seed: int = 42) -> DataFrame:
    """Seeded standard normal draws. One set serves all models and components, so their changes differ by nothing but themselves."""
    return spark.createDataFrame(list(enumerate(noise_draws(samples, seed))), "sample_id int, z double")


def noise_draws(samples: int, seed: int = 42) -> list[float]:
    return np.random.default_rng(seed).standard_normal(samples).tolist()


def sensitivity_ranking(sensitivity: DataFrame) -> DataFrame:
    """Mean absolute change by scenario and component, with its dense rank within the scenario."""
    means = sensitivity.groupBy("dataset", "scenario", "metric").agg(F.avg("absolute_delta_cbs").alias("mean_absolute_delta_cbs"))
    order = Window.partitionBy("dataset", "scenario").orderBy(F.desc(F.round("mean_absolute_delta_cbs", 12)))
    return means.withColumn("rank", F.dense_rank().over(order))


def weight_grid_vectors(levels: tuple[float, ...] = LEVELS, weights: dict[str, float] = WEIGHTS) -> list[tuple]:
    """(component, level, direction, its weight before and after, all weights) for each component moved by each level either way and all renormalised."""
    base, rows = normalized_weights(weights), []
    for level in levels:
        for metric in COMPONENTS:
            for direction, sign in (("decrease", -1), ("increase", 1)):
                moved = normalized_weights(base | {metric: max(0.0, base[metric] * (1 + sign * level))})
                rows.append((metric, level, direction, base[metric], moved[metric], *[moved[m] for m in COMPONENTS]))
    return rows


def agreement(pairs: DataFrame, keys: list[str], a: str, b: str, item: str = "model") -> DataFrame:
    """Spearman and Kendall tau-b correlation of two rankings, and pairs that they order in opposite ways; null where either is constant."""
    rho = pairs.groupBy(*keys).agg(safe_corr(a, b).alias("spearman"))
    left, right = pairs.select(*keys, *[F.col(c).alias(f"{c}_1") for c in (item, a, b)]), pairs.select(*keys, *[F.col(c).alias(f"{c}_2") for c in (item, a, b)])
    both = left.join(right, keys).where(F.col(f"{item}_1") < F.col(f"{item}_2"))
    x, y = F.signum(F.col(f"{a}_1") - F.col(f"{a}_2")), F.signum(F.col(f"{b}_1") - F.col(f"{b}_2"))
    tau = both.groupBy(*keys).agg(F.sum(x * y).alias("s"), F.sum(F.abs(x)).alias("n1"), F.sum(F.abs(y)).alias("n2"), F.sum((x * y < 0).cast("long")).alias("reversals"))
    kendall = F.when((F.col("n1") > 0) & (F.col("n2") > 0), F.col("s") / F.nullif(F.sqrt(F.col("n1") * F.col("n2")), F.lit(0.0)))
    return rho.join(tau, keys, "left").select(*keys, "spearman", kendall.alias("kendall"), F.coalesce("reversals", F.lit(0)).cast("long").alias("reversals"))


def weight_grid(frame: DataFrame, levels: tuple[float, ...] = LEVELS, weights: dict[str, float] = WEIGHTS) -> DataFrame:
    """Score and rank of every model under each weight vector of the grid, with the shift from the baseline."""
    grid = _weights_table(frame.sparkSession, weight_grid_vectors(levels, weights), "metric string, perturbation_level double, direction string, baseline_weight double, perturbed_weight double")
    scored = frame.select("dataset", "model", "cbs", "baseline_rank", *COMPONENTS).join(grid).withColumn("perturbed_cbs", _score())
    scenario = ["dataset", "metric", "perturbation_level", "direction"]
    ranked = _ranked(scored, scenario, "perturbed_cbs", "perturbed_rank")
    return ranked.select(*scenario, "model", "baseline_weight", "perturbed_weight", F.col("cbs").alias("baseline_cbs"), "perturbed_cbs", (F.col("perturbed_cbs") - F.col("cbs")).alias("score_delta"), "baseline_rank", "perturbed_rank", (F.col("perturbed_rank") - F.col("baseline_rank")).alias("rank_shift"))


def grid_agreement(grid: DataFrame) -> DataFrame:
    """Agreement of baseline and perturbed ranks in each scenario of a weight grid."""
    return agreement(grid, ["dataset", "metric", "perturbation_level", "direction"], "baseline_rank", "perturbed_rank")


def dirichlet_weights(spark: SparkSession, samples: int = 5000, *, concentration: float = 20.0, seed: int = 42, weights: dict[str, float] = WEIGHTS) -> DataFrame:
    """Seeded Dirichlet draws around the weights."""
    return _weights_table(spark, [(i, *row) for i, row in enumerate(dirichlet_draws(samples, concentration, seed, weights))], "sample_id int")


def dirichlet_draws(samples: int = 5000, concentration: float = 20.0, seed: int = 42, weights: dict[str, float] = WEIGHTS) -> list[list[float]]:
    alpha = np.maximum(np.array([weights[m] for m in COMPONENTS]) * concentration, 1e-6)
    return np.random.default_rng(seed).dirichlet(alpha, size=samples).tolist()


def collapsed(frame: DataFrame) -> DataFrame:
    """One row a dataset and model of a frame that has several: the means of its components, missing ones left out."""
    return frame.groupBy("dataset", "model").agg(*[F.avg(m).alias(m) for m in COMPONENTS if m in frame.columns])


def monte_carlo(frame: DataFrame, vectors: DataFrame) -> DataFrame:
    """Distribution of each model's score and rank over weight vectors (sample_id, w_...)."""
    sample = ["dataset", "sample_id"]
    scored = frame.select("dataset", "model", "cbs", "baseline_rank", *COMPONENTS).join(vectors).withColumn("score", _score())
    ranked = _ranked(scored, sample, "score", "rank")
    first = F.row_number().over(Window.partitionBy(*sample).orderBy(F.desc(F.round("score", 12)), "model"))
    drawn = ranked.withColumn("first", (first == 1).cast("double"))
    by_model = drawn.groupBy("dataset", "model").agg(
        F.max("cbs").alias("baseline_cbs"), F.max("baseline_rank").alias("baseline_rank"), F.avg("score").alias("cbs_mean"), F.stddev_samp("score").alias("cbs_std"), F.avg("rank").alias("mean_rank"), F.stddev_samp("rank").alias("rank_std"),
        F.avg("first").alias("top1_probability"), F.avg((F.col("rank") == 1).cast("double")).alias("rank_1_frequency"), F.avg((F.col("rank") != F.col("baseline_rank")).cast("double")).alias("rank_reversal_frequency"),
    )
    agreed = agreement(drawn, sample, "baseline_rank", "rank").groupBy("dataset").agg(F.avg("spearman").alias("mean_spearman"), F.avg("kendall").alias("mean_kendall"), F.avg(F.col("reversals").cast("double")).alias("mean_reversals"))
    return by_model.join(agreed, "dataset", "left")


def _long_frame(frame: DataFrame) -> DataFrame:
    parts = F.explode(F.array(*[F.struct(F.lit(m).alias("metric"), F.col(m).alias("value"), F.col(f"contribution__{m}").alias("contribution"), F.col(f"contribution_pct__{m}").alias("share")) for m in COMPONENTS])).alias("c")
    return frame.select("dataset", "model", "cbs", parts).select("dataset", "model", "cbs", "c.*")


def dominance(frame: DataFrame, weights: dict[str, float] = WEIGHTS) -> DataFrame:
    """How much of the score each component makes: contributions, their variance, leave-one-out impact, correlation with the score, and dense ranks."""
    share = normalized_weights(weights)
    weight = F.element_at(F.create_map(*[F.lit(x) for kv in share.items() for x in kv]), F.col("metric"))
    long = _long_frame(frame).withColumn("weight", weight)
    long = long.withColumn("without", (F.col("cbs") - F.col("contribution")) / F.greatest(F.lit(1e-12), 1 - F.col("weight")))
    for c in ("cbs", "value"):
        long = long.withColumn(f"{c}_key", F.round(c, 12)).withColumn(f"{c}_rank", avg_rank(f"{c}_key", ["dataset", "metric"]))
    found = long.groupBy("dataset", "metric").agg(
        F.max("weight").alias("weight"), F.avg("contribution").alias("mean_contribution"), F.coalesce(F.var_samp("contribution"), F.lit(0.0)).alias("contribution_variance"), F.avg("share").alias("mean_contribution_pct"), F.max("share").alias("max_contribution_pct"), F.min("share").alias("min_contribution_pct"),
        F.avg(F.abs(F.col("cbs") - F.col("without"))).alias("mean_leave_one_out_impact"), safe_corr("cbs", "value").alias("pearson_cbs_corr"), safe_corr("cbs_rank", "value_rank").alias("spearman_cbs_corr"), F.avg("value").alias("metric_mean"), F.stddev_samp("value").alias("metric_std"),
    )
    total = F.sum("contribution_variance").over(Window.partitionBy("dataset"))
    rank = lambda c: F.dense_rank().over(Window.partitionBy("dataset").orderBy(F.desc_nulls_last(F.round(c, 12))))
    return found.withColumn("variance_contribution_pct", F.when(total > 0, F.col("contribution_variance") / total)).withColumn("impact_rank", rank("mean_leave_one_out_impact")).withColumn("contribution_rank", rank("mean_contribution_pct"))


def _p_of(r: Column, n: Column) -> Column:
    """p-value of a correlation of n pairs, from t with n - 2 degrees of freedom."""
    t = F.when(F.abs(r) >= 1 - 1e-12, F.lit(float("inf"))).otherwise(r * F.sqrt((n - 2) / F.nullif(1 - r * r, F.lit(0.0))))
    return F.when(n > 2, t_two_sided(t, (n - 2).cast("int")))


def correlations(frame: DataFrame) -> DataFrame:
    """Pearson and Spearman correlation of the score with each component, and their p-values."""
    long = _long_frame(frame)
    for c in ("cbs", "value"):
        long = long.withColumn(f"{c}_key", F.round(c, 12)).withColumn(f"{c}_rank", avg_rank(f"{c}_key", ["dataset", "metric"]))
    found = long.groupBy("dataset", "metric").agg(safe_corr("cbs", "value").alias("pearson_r"), safe_corr("cbs_rank", "value_rank").alias("spearman_r"), F.count(F.lit(1)).alias("n"))
    return found.select("dataset", "metric", "pearson_r", _p_of(F.col("pearson_r"), F.col("n")).alias("pearson_p"), "spearman_r", _p_of(F.col("spearman_r"), F.col("n")).alias("spearman_p"))


def redundancy(frame: DataFrame, least: float = 0.90) -> DataFrame:
    """Pairs among the score and its components whose correlation is at least ``least`` either way, in the order of the columns."""
    names = ["cbs", *COMPONENTS]
    pairs = [(a, b) for i, a in enumerate(names) for b in names[i + 1 :]]
    found = frame.groupBy("dataset").agg(*[safe_corr(a, b).alias(f"{a}|{b}") for a, b in pairs])
    long = found.unpivot("dataset", [f"`{a}|{b}`" for a, b in pairs], "pair", "pearson_r").where(F.abs("pearson_r") >= least)
    return long.select("dataset", F.split_part("pair", F.lit("|"), F.lit(1)).alias("metric_a"), F.split_part("pair", F.lit("|"), F.lit(2)).alias("metric_b"), "pearson_r")


def _audited(long: DataFrame) -> DataFrame:
    """Ranges, spread, rank agreement and artefacts of (dataset, metric, model, raw, norm)."""
    for c in ("raw", "norm"):
        long = long.withColumn(f"{c}_key", F.round(c, 12)).withColumn(f"{c}_rank", avg_rank(f"{c}_key", ["dataset", "metric"]))
    found = long.groupBy("dataset", "metric").agg(
        F.min("raw").alias("raw_min"), F.max("raw").alias("raw_max"), F.stddev_samp("raw").alias("raw_std"), F.min("norm").alias("normalized_min"), F.max("norm").alias("normalized_max"), F.stddev_samp("norm").alias("normalized_std"),
        safe_corr("raw_rank", "norm_rank").alias("rank_correlation"), F.sum(F.abs(F.col("raw_rank") - F.col("norm_rank"))).alias("ranking_distortion"), F.countDistinct("raw_key").alias("unique_raw_values"), F.countDistinct("norm_key").alias("unique_normalized_values"), F.min((F.col("norm") >= 0) & (F.col("norm") <= 1)).alias("bounded_0_1"),
    )
    reasons = F.concat_ws("; ", F.when(~F.col("bounded_0_1"), "outside [0, 1]"), F.when((F.col("unique_raw_values") > 1) & (F.col("unique_normalized_values") <= 1), "collapsed to one value"), F.when(F.col("ranking_distortion") > 0, "rank distortion"))
    return found.withColumn("compression_ratio", F.when(F.col("raw_std") > 1e-15, F.col("normalized_std") / F.col("raw_std"))).withColumn("artifact_reason", reasons).withColumn("artifact_flag", F.col("artifact_reason") != "")


def normalization_audit(parts: DataFrame, frame: DataFrame) -> DataFrame:
    """Raw against normalised components, aligned by model."""
    raw = raw_scores(parts, ["dataset", "model"]).unpivot(["dataset", "model"], COMPONENTS, "metric", "raw")
    norm = frame.unpivot(["dataset", "model"], COMPONENTS, "metric", "norm")
    return _audited(raw.join(norm, ["dataset", "model", "metric"]))


def proxy_audit(parts: DataFrame, frame: DataFrame, weights: dict[str, float] = WEIGHTS) -> DataFrame:
    """The score from raw components against that from normalised ones."""
    raw = raw_scores(parts, ["dataset", "model"]).select("dataset", "model", weighted(normalized_weights(weights)).alias("raw"))
    return _audited(raw.join(frame.select("dataset", "model", F.col("cbs").alias("norm")), ["dataset", "model"]).withColumn("metric", F.lit("cbs_proxy")))



def cross_domain(monte_carlo_: DataFrame, audit: DataFrame, agreed: DataFrame, dominance_: DataFrame) -> DataFrame:
    """A row a dataset: greatest top-1 probability, mean spread of the score, compression and rank agreement of normalisation, agreement over the weight grid, and the mean leave-one-out impact with the component of the greatest."""
    parts = [
        monte_carlo_.groupBy("dataset").agg(F.max("top1_probability").alias("top1_probability"), F.avg("cbs_std").alias("cbs_std")),
        audit.groupBy("dataset").agg(F.avg("compression_ratio").alias("compression_ratio"), F.avg("rank_correlation").alias("rank_correlation")),
        agreed.groupBy("dataset").agg(F.avg("spearman").alias("weight_agreement")),
        dominance_.groupBy("dataset").agg(F.avg("mean_leave_one_out_impact").alias("mean_impact"), F.min_by("metric", F.struct(-F.round("mean_leave_one_out_impact", 12), "metric")).alias("top_metric")),
    ]
    return reduce(lambda a, b: a.join(b, "dataset", "left"), parts)


__all__ = ["agreement", "collapsed", "correlations", "cross_domain", "dirichlet_draws", "dirichlet_weights", "dominance", "grid_agreement", "monte_carlo", "noise_draws", "noise_perturbations", "noise_table", "normalization_audit", "proxy_audit", "redundancy", "sensitivity_ranking", "small_perturbations", "weight_grid", "weight_grid_vectors"]
