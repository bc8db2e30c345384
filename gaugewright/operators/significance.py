"""Significance tests on a long table of scores (keys, obs, model, score), and effect sizes."""

from __future__ import annotations

import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from gaugewright.functions import distributions
from gaugewright.functions.columns import avg_rank, chi2_tail, t_two_sided


def aligned(scores: DataFrame, keys: list[str] = ["dataset"]) -> DataFrame:  # noqa: B006
    """Scores of the observations that every model of a key has.

    A model with two scores for an observation is an error, raised when the result is computed.
    """
    once = scores.where("score is not null").groupBy(*keys, "obs", "model").agg(F.when(F.count(F.lit(1)) > 1, F.raise_error(F.lit("duplicate observation of a model")).cast("double")).otherwise(F.max("score")).alias("score"))
    models = once.groupBy(*keys).agg(F.countDistinct("model").alias("k"))
    whole = once.groupBy(*keys, "obs").agg(F.count(F.lit(1)).alias("n")).join(models, keys).where("n = k").select(*keys, "obs")
    return once.join(whole, [*keys, "obs"], "left_semi")


def problems(scores: DataFrame, keys: list[str] = ["dataset"]) -> DataFrame:  # noqa: B006
    """(keys, problem, n) of what keeps scores from being compared pair by pair; no rows if nothing does.

    Problems: scores that are missing or not finite, rows without a model's name, repeated observations of a
    model, observations that some model lacks, keys with fewer than two models or two observations.
    """
    bad = F.col("score").isNull() | F.isnan(F.col("score").cast("double")) | (F.abs("score") == float("inf"))
    by_model = scores.groupBy(*keys, "obs", "model").agg(F.count(F.lit(1)).alias("rows"), F.count_if(bad).alias("bad"))
    by_obs = by_model.groupBy(*keys, "obs").agg(F.count("model").alias("has"), F.sum("bad").alias("bad"), F.count_if(F.col("model").isNull()).alias("unnamed"), F.count_if(F.col("rows") > 1).alias("repeated"))
    models = by_model.groupBy(*keys).agg(F.countDistinct("model").alias("n_models"))
    whole = by_obs.join(models, keys).groupBy(*keys).agg(
        F.sum("bad").alias("bad"), F.sum("unnamed").alias("unnamed"), F.sum("repeated").alias("repeated"), F.count(F.lit(1)).alias("n_obs"), F.max("n_models").alias("n_models"), F.count_if(F.col("has") < F.col("n_models")).alias("lacking"),
    )
    named = {"score is not finite": F.col("bad"), "row without a model": F.col("unnamed"), "repeated observation of a model": F.col("repeated"), "observation that some model lacks": F.col("lacking"), "fewer than two models": (F.col("n_models") < 2).cast("int"), "fewer than two observations": (F.col("n_obs") < 2).cast("int")}
    listed = F.array(*[F.struct(F.lit(k).alias("problem"), v.cast("long").alias("n")) for k, v in named.items()])
    return whole.select(*keys, F.explode(listed).alias("p")).select(*keys, "p.problem", "p.n").where("n > 0")


def checked(scores: DataFrame, keys: list[str] = ["dataset"]) -> DataFrame:  # noqa: B006
    """The scores, or a ValueError that names what is wrong with them."""
    if found := problems(scores, keys).orderBy(*keys, "problem").limit(20).collect():
        raise ValueError("; ".join(f"{', '.join(str(r[k]) for k in keys)}: {r['problem']} ({r['n']})" for r in found))
    return scores


def model_ranking(scores: DataFrame, keys: list[str] = ["dataset"], *, higher_is_better: bool = True) -> DataFrame:  # noqa: B006
    """Mean score of each model and its average-tie rank."""
    means = scores.groupBy(*keys, "model").agg(F.avg("score").alias("mean_score")).withColumn("key_", F.round("mean_score", 12))
    return means.withColumn("rank", avg_rank("key_", keys, descending=higher_is_better)).drop("key_")


def row_ranks(scores: DataFrame, keys: list[str] = ["dataset"], *, higher_is_better: bool = True) -> DataFrame:  # noqa: B006
    """Average-tie rank of each model within its observation."""
    return scores.withColumn("key_", F.round("score", 12)).withColumn("rank", avg_rank("key_", [*keys, "obs"], descending=higher_is_better)).drop("key_")


def average_ranks(scores: DataFrame, keys: list[str] = ["dataset"], *, higher_is_better: bool = True) -> DataFrame:  # noqa: B006
    return row_ranks(scores, keys, higher_is_better=higher_is_better).groupBy(*keys, "model").agg(F.avg("rank").alias("average_rank"))


def friedman(scores: DataFrame, keys: list[str] = ["dataset"], *, alpha: float = 0.05) -> DataFrame:  # noqa: B006
    """Tie-corrected chi-square statistic, degrees of freedom and p-value; all rows tied gives a null statistic."""
    ranks = row_ranks(scores, keys).withColumn("tied", F.count(F.lit(1)).over(Window.partitionBy(*keys, "obs", F.round("score", 12))).cast("double"))
    # the sum of t^3 - t over groups of t ties is that of t^2 - 1 over their rows
    by_model = ranks.groupBy(*keys, "model").agg(F.sum("rank").alias("r"), F.count(F.lit(1)).cast("double").alias("n"), F.sum(F.col("tied") * F.col("tied") - 1).alias("ties"))
    found = by_model.groupBy(*keys).agg(F.count(F.lit(1)).cast("double").alias("k"), F.max("n").alias("n"), F.sum(F.col("r") * F.col("r")).alias("r2"), F.sum("ties").alias("ties"))
    n, k = F.col("n"), F.col("k")
    top = 12 / (n * k * (k + 1)) * F.col("r2") - 3 * n * (k + 1)
    correction = 1 - F.col("ties") / (n * k * (k * k - 1))
    found = found.withColumn("statistic", F.when(correction > 0, top / F.nullif(correction, F.lit(0.0)))).withColumn("df", (k - 1).cast("int"))

    @F.pandas_udf("double")
    def odd_tail(x: pd.Series, df: pd.Series) -> pd.Series:
        return pd.Series([None if pd.isna(a) else distributions.chi2_sf(a, int(b)) for a, b in zip(x, df, strict=True)], dtype="float64")

    p = F.when(F.col("df") % 2 == 0, chi2_tail(F.col("statistic"), F.col("df"))).otherwise(odd_tail("statistic", "df"))
    return found.select(*keys, k.cast("int").alias("n_models"), n.cast("int").alias("n_observations"), "statistic", "df", p.alias("p_value")).withColumn("significant", F.col("p_value") < alpha)


def differences(scores: DataFrame, keys: list[str] = ["dataset"]) -> DataFrame:  # noqa: B006
    """(keys, model_a, model_b, obs, x, y, d) for each pair of models by name and each observation of both."""
    a = scores.select(*keys, "obs", F.col("model").alias("model_a"), F.col("score").alias("x"))
    b = scores.select(*keys, "obs", F.col("model").alias("model_b"), F.col("score").alias("y"))
    return a.join(b, [*keys, "obs"]).where("model_a < model_b").withColumn("d", F.col("x") - F.col("y"))


def holm(table: DataFrame, keys: list[str], p: str = "p_value", *, alpha: float = 0.05, order: list[str] = ["model_a", "model_b"]) -> DataFrame:  # noqa: B006
    """Holm's step-down: adjusted p-values and decisions among the rows of a key."""
    over = Window.partitionBy(*keys).orderBy(p, *order)
    m = F.count(F.lit(1)).over(Window.partitionBy(*keys))
    running = over.rowsBetween(Window.unboundedPreceding, Window.currentRow)
    found = table.withColumn("left_", m - F.row_number().over(over) + 1)
    found = found.withColumn("p_value_adj", F.max(F.least(F.lit(1.0), F.col(p) * F.col("left_"))).over(running))
    return found.withColumn("significant", F.min((F.col(p) <= alpha / F.col("left_")).cast("int")).over(running) == 1).drop("left_")


def corrected_t(scores: DataFrame, keys: list[str] = ["dataset"], *, n_splits: int, alpha: float = 0.05, ddof: int = 1) -> DataFrame:  # noqa: B006
    """Corrected resampled t-test of each pair, Holm-adjusted.

    A variance of 1e-24 or less counts as none: statistic 0 and p 1 for equal means, else infinite and 0.
    """
    if n_splits <= 1:
        raise ValueError(f"the corrected resampled t-test needs n_splits > 1, not {n_splits}")
    variance = F.var_samp("d") if ddof == 1 else F.var_pop("d")
    found = differences(scores, keys).groupBy(*keys, "model_a", "model_b").agg(F.avg("d").alias("mean"), variance.alias("variance"), F.count(F.lit(1)).alias("n"))
    corrected = F.coalesce(F.col("variance"), F.lit(0.0)) * (1.0 / F.col("n") + 1.0 / (n_splits - 1))
    none = F.coalesce(F.col("variance"), F.lit(0.0)) <= 1e-24
    flat = F.when(F.abs("mean") <= 1e-12, 0.0).when(F.col("mean") > 0, float("inf")).otherwise(float("-inf"))
    found = found.withColumn("statistic", F.when(none, flat).otherwise(F.col("mean") / F.sqrt(F.nullif(corrected, F.lit(0.0)))))
    p = F.when(none, F.when(F.col("statistic") == 0, 1.0).otherwise(0.0)).otherwise(t_two_sided(F.col("statistic"), F.greatest(F.col("n") - 1, F.lit(1)).cast("int")))
    tested = found.select(*keys, "model_a", "model_b", "statistic", p.alias("p_value_raw")).withColumn("p_value", F.col("p_value_raw"))
    return holm(tested, keys, "p_value_raw", alpha=alpha).withColumn("decision", F.when(F.col("significant"), "reject").otherwise("keep"))


def signed_ranks(scores: DataFrame, keys: list[str] = ["dataset"]) -> DataFrame:  # noqa: B006
    """W+ and W- of each pair without zero differences, and the lesser as the statistic."""
    pair = [*keys, "model_a", "model_b"]
    d = differences(scores, keys).withColumn("d", F.round("d", 12)).where("d <> 0").withColumn("size", F.abs("d"))
    ranked = d.withColumn("rank", avg_rank("size", pair, descending=False))
    found = ranked.groupBy(*pair).agg(F.sum(F.when(F.col("d") > 0, F.col("rank")).otherwise(0.0)).alias("w_plus"), F.sum(F.when(F.col("d") < 0, F.col("rank")).otherwise(0.0)).alias("w_minus"), F.count(F.lit(1)).alias("n"))
    return found.withColumn("statistic", F.least("w_plus", "w_minus"))


def wilcoxon(scores: DataFrame, keys: list[str] = ["dataset"], *, alpha: float = 0.05) -> DataFrame:  # noqa: B006
    """Signed-rank test of each pair, Holm-adjusted; one pair's differences, as many as observations, are tested in one task."""
    pair = [*keys, "model_a", "model_b"]

    @F.pandas_udf("statistic double, p_value double, mode string")
    def tested(d: pd.Series) -> pd.DataFrame:
        return pd.DataFrame([distributions.wilcoxon(list(x)) for x in d], columns=["statistic", "p_value", "mode"])

    found = differences(scores, keys).groupBy(*pair).agg(F.sort_array(F.collect_list(F.round("d", 12))).alias("d")).withColumn("t", tested("d"))
    return holm(found.select(*pair, "t.*").withColumnRenamed("p_value", "p_value_raw").withColumn("p_value", F.col("p_value_raw")), keys, "p_value_raw", alpha=alpha)


def nemenyi(scores: DataFrame, keys: list[str] = ["dataset"], *, alpha: float = 0.05) -> DataFrame:  # noqa: B006
    """Rank difference of each pair, the critical difference and the p-value from the studentised range."""
    ranks = average_ranks(scores, keys)
    sizes = scores.groupBy(*keys).agg(F.countDistinct("model").cast("int").alias("k"), F.countDistinct("obs").cast("int").alias("n"))
    a, b = (ranks.select(*keys, F.col("model").alias(f"model_{s}"), F.col("average_rank").alias(f"rank_{s}")) for s in "ab")

    @F.pandas_udf("cd double, p_value double")
    def tail(gap: pd.Series, k: pd.Series, n: pd.Series) -> pd.DataFrame:
        critical = {int(x): distributions.nemenyi_q(int(x), alpha) for x in set(k)}
        rows = []
        for g, m, size in zip(gap, k, n, strict=True):
            error = (m * (m + 1) / (6 * size)) ** 0.5
            rows.append((critical[int(m)] * error, distributions.studentized_range_sf(g / error * 2**0.5, int(m))))
        return pd.DataFrame(rows, columns=["cd", "p_value"])

    pairs = a.join(b, keys).where("model_a < model_b").join(sizes, keys).withColumn("rank_difference", F.abs(F.col("rank_a") - F.col("rank_b")))
    return pairs.withColumn("t", tail("rank_difference", "k", "n")).select(*keys, "model_a", "model_b", "rank_a", "rank_b", "rank_difference", "t.cd", "t.p_value", (F.col("t.p_value") <= alpha).alias("significant"))


def critical_difference(scores: DataFrame, q: float, keys: list[str] = ["dataset"]) -> DataFrame:  # noqa: B006
    """Critical rank difference for a given critical value."""
    sizes = scores.groupBy(*keys).agg(F.countDistinct("model").alias("k"), F.countDistinct("obs").alias("n"))
    return sizes.withColumn("cd", F.lit(q) * F.sqrt(F.col("k") * (F.col("k") + 1) / (6.0 * F.col("n"))))


def t_interval(scores: DataFrame, keys: list[str] = ["dataset"], *, confidence: float = 0.95) -> DataFrame:  # noqa: B006
    """Mean and Student interval of each model; the mean alone where there is one score."""

    @F.pandas_udf("double")
    def quantile(df: pd.Series) -> pd.Series:
        known = {int(x): distributions.t_quantile(0.5 + confidence / 2, int(x)) for x in set(df) if x > 0}
        return pd.Series([known.get(int(x), 0.0) for x in df], dtype="float64")

    found = scores.groupBy(*keys, "model").agg(F.avg("score").alias("mean"), F.stddev_samp("score").alias("std"), F.count("score").alias("n"))
    margin = F.coalesce(quantile(F.col("n") - 1) * F.col("std") / F.sqrt("n"), F.lit(0.0))
    return found.select(*keys, "model", "mean", (F.col("mean") - margin).alias("low"), (F.col("mean") + margin).alias("high"))


def bootstrap(scores: DataFrame, keys: list[str] = ["dataset"], *, resamples: int = 10_000, confidence: float = 0.95, seed: int = 42) -> DataFrame:  # noqa: B006
    """Percentile bootstrap interval of each model's mean."""

    @F.pandas_udf("low double, high double")
    def interval(values: pd.Series) -> pd.DataFrame:
        return pd.DataFrame([distributions.bootstrap_interval(list(x), resamples=resamples, confidence=confidence, seed=seed) for x in values], columns=["low", "high"])

    found = scores.groupBy(*keys, "model").agg(F.avg("score").alias("mean"), F.transform(F.sort_array(F.collect_list(F.struct("obs", "score"))), lambda s: s["score"]).alias("values"))
    return found.withColumn("i", interval("values")).select(*keys, "model", "mean", "i.low", "i.high")


def effect_level(value: Column, bands: tuple[float, float, float]) -> Column:
    small, medium, large = bands
    return F.when(value.isNull(), "undefined").when(F.abs(value) < small, "negligible").when(F.abs(value) < medium, "small").when(F.abs(value) < large, "medium").otherwise("large")


def effects(scores: DataFrame, keys: list[str] = ["dataset"]) -> DataFrame:  # noqa: B006
    """Paired and pooled Cohen's d and Cliff's delta of each pair of models, with their bands.

    Paired d is null for fewer than two differences or none that vary; pooled d is 0 without variance.
    Cliff's delta comes from ranks of both models' scores together, so no pair of scores is compared.
    """
    pair = [*keys, "model_a", "model_b"]
    d = differences(scores, keys)
    found = d.groupBy(*pair).agg(F.avg("d").alias("m"), F.stddev_samp("d").alias("s"), F.avg("x").alias("mx"), F.avg("y").alias("my"), F.var_samp("x").alias("vx"), F.var_samp("y").alias("vy"), F.count(F.lit(1)).alias("n"))
    pooled = F.sqrt((F.col("vx") + F.col("vy")) / 2)
    found = found.withColumn("cohens_d_paired", F.when(F.col("s") > 1e-12, F.col("m") / F.col("s"))).withColumn("cohens_d_pooled", F.when(pooled > 1e-12, (F.col("mx") - F.col("my")) / pooled).otherwise(0.0))
    both = d.select(*pair, F.explode(F.array(F.struct(F.lit(1).alias("own"), F.round("x", 12).alias("v")), F.struct(F.lit(0).alias("own"), F.round("y", 12).alias("v")))).alias("e")).select(*pair, "e.own", "e.v")
    ranked = both.withColumn("rank", avg_rank("v", pair, descending=False))
    n, m = F.sum("own").cast("double"), F.sum(1 - F.col("own")).cast("double")
    delta = ranked.groupBy(*pair).agg((2 * (F.sum(F.when(F.col("own") == 1, F.col("rank")).otherwise(0.0)) - n * (n + 1) / 2) / (n * m) - 1).alias("cliffs_delta"))
    out = found.join(delta, pair)
    return out.select(*pair, "cohens_d_paired", "cohens_d_pooled", "cliffs_delta", effect_level(F.col("cohens_d_paired"), (0.2, 0.5, 0.8)).alias("d_level"), effect_level(F.col("cliffs_delta"), (0.147, 0.33, 0.474)).alias("delta_level"))
