"""Queries on score matrices: ranks, tests, intervals, effect sizes, robustness of the composite score."""

from __future__ import annotations

from pyspark.sql import functions as F

from gaugewright.operators import composite, robustness, significance
from gaugewright.operators.composite import COMPONENTS, WEIGHTS
from gaugewright.plans.base import Catalogue, Inputs
from gaugewright.sources.tables import strict_matrix

catalogue = Catalogue()
add = catalogue.add

_PAIR = "dataset model_a model_b"
add("score_matrix_aligned", "dataset obs:l model score:d", lambda t: t.scores, "sc", "SELECT * FROM sc")
add("model_ranking", "dataset model mean_score:d rank:d", lambda t: significance.model_ranking(t.scores), "sc", "SELECT *, rank() OVER (PARTITION BY dataset ORDER BY round(mean_score, 12) DESC) + (count(*) OVER (PARTITION BY dataset, round(mean_score, 12)) - 1) / 2.0 AS rank FROM (SELECT dataset, model, avg(score) AS mean_score FROM sc GROUP BY ALL)")
add("average_ranks", "dataset model average_rank:d", lambda t: significance.average_ranks(t.scores), "rr", "SELECT dataset, model, avg(rank) AS average_rank FROM rr GROUP BY ALL")
_FRIEDMAN = """
SELECT *, 4 AS df, exp(-statistic / 2) * (1 + statistic / 2) AS p_value, exp(-statistic / 2) * (1 + statistic / 2) < 0.05 AS significant FROM (
  SELECT dataset, CAST(k AS INTEGER) AS n_models, n AS n_observations, (12 / (n * k * (k + 1)) * r2 - 3 * n * (k + 1)) / (1 - ties / (n * k * (k * k - 1))) AS statistic FROM (
    SELECT dataset, count(*)::DOUBLE AS k, max(n) AS n, sum(r * r) AS r2, sum(ties) AS ties FROM (
      SELECT dataset, model, sum(rank) AS r, count(*)::DOUBLE AS n, sum(tied * tied - 1)::DOUBLE AS ties FROM {rr} GROUP BY ALL) GROUP BY ALL))"""
add("friedman", "dataset n_models:l n_observations:l statistic:d df:l p_value:d significant", lambda t: significance.friedman(t.scores), "rr", _FRIEDMAN.replace("{rr}", "rr"))

_T = "abs(statistic)"
_THETA = f"atan({_T} / sqrt(n - 1))"
_SERIES = " + ".join(f"{c!r} * pow(cos({_THETA}), {2 * i})" for i, c in enumerate([1.0, 1 / 2, 3 / 8, 5 / 16, 35 / 128, 63 / 256, 231 / 1024]))
_TESTED = f"""
SELECT dataset, model_a, model_b, statistic, CASE WHEN variance <= 1e-24 THEN CASE WHEN statistic = 0 THEN 1 ELSE 0 END ELSE greatest(0, 1 - sin({_THETA}) * ({_SERIES})) END AS p FROM (
  SELECT *, CASE WHEN variance <= 1e-24 THEN CASE WHEN abs(mean) <= 1e-12 THEN 0 ELSE sign(mean) * 'Infinity'::DOUBLE END ELSE mean / sqrt(variance * (1.0 / n + 1.0 / 4)) END AS statistic
  FROM (SELECT dataset, model_a, model_b, avg(d) AS mean, var_samp(d) AS variance, count(*) AS n FROM df GROUP BY ALL))"""
_HOLM = "SELECT *, max(least(1, p * left_)) OVER w AS p_value_adj, min(CASE WHEN p <= 0.05 / left_ THEN 1 ELSE 0 END) OVER w = 1 AS significant FROM (SELECT *, count(*) OVER (PARTITION BY dataset) - row_number() OVER (PARTITION BY dataset ORDER BY p, model_a, model_b) + 1 AS left_ FROM ({table})) WINDOW w AS (PARTITION BY dataset ORDER BY p, model_a, model_b ROWS UNBOUNDED PRECEDING)"


def _full(t: Inputs):
    """Scores of datasets whose models all have fifteen observations."""
    whole = t.scores.groupBy("dataset").agg(F.countDistinct("obs").alias("n")).where("n = 15").select("dataset")
    return t.scores.join(F.broadcast(whole), "dataset", "left_semi")


_FULL = "SEMI JOIN (SELECT dataset FROM sc GROUP BY 1 HAVING count(DISTINCT obs) = 15) USING (dataset)"
add("corrected_t_pairwise", f"{_PAIR} statistic:d p_value_raw:d p_value_adj:d significant decision", lambda t: significance.corrected_t(_full(t), n_splits=5), "sc df", f"SELECT *, p AS p_value_raw, CASE WHEN significant THEN 'reject' ELSE 'keep' END AS decision FROM ({_HOLM.format(table=_TESTED)}) {_FULL}")
add(
    "holm_adjust", f"{_PAIR} p:d p_value_adj:d significant", lambda t: significance.holm(significance.differences(t.scores).groupBy("dataset", "model_a", "model_b").agg((F.abs(F.avg("d")) * 3).alias("p")), ["dataset"], "p"), "df",
    _HOLM.format(table="SELECT dataset, model_a, model_b, abs(avg(d)) * 3 AS p FROM df GROUP BY ALL"),
)
add("mean_ci_t", "dataset model mean:d low:d high:d", lambda t: significance.t_interval(_full(t)), "sc", f"SELECT dataset, model, avg(score) AS mean, avg(score) - 2.1447866879169273 * stddev_samp(score) / sqrt(15) AS low, avg(score) + 2.1447866879169273 * stddev_samp(score) / sqrt(15) AS high FROM sc {_FULL} GROUP BY ALL")
_EFFECTS = "SELECT dataset, model_a, model_b, avg(d) / stddev_samp(d) AS cohens_d_paired, (avg(x) - avg(y)) / sqrt((var_samp(x) + var_samp(y)) / 2) AS cohens_d_pooled FROM df GROUP BY ALL"
_DELTA = "SELECT a.dataset, a.model AS model_a, b.model AS model_b, avg(sign(round(a.score, 12) - round(b.score, 12))) AS cliffs_delta FROM sc a JOIN sc b ON a.dataset = b.dataset AND a.model < b.model GROUP BY ALL"
_BAND = "CASE WHEN abs({c}) < {a} THEN 'negligible' WHEN abs({c}) < {b} THEN 'small' WHEN abs({c}) < {d} THEN 'medium' ELSE 'large' END"
add("cohens_d_paired", f"{_PAIR} cohens_d_paired:d", lambda t: significance.effects(t.scores), "df", _EFFECTS)
add("cohens_d_pooled", f"{_PAIR} cohens_d_pooled:d", lambda t: significance.effects(t.scores), "df", _EFFECTS)
add("cliffs_delta", f"{_PAIR} cliffs_delta:d", lambda t: significance.effects(t.scores), "sc", _DELTA)
add("effect_size_bands", f"{_PAIR} d_level delta_level", lambda t: significance.effects(t.scores), "df", f"SELECT dataset, model_a, model_b, {_BAND.format(c='cohens_d_paired', a=0.2, b=0.5, d=0.8)} AS d_level, {_BAND.format(c='cliffs_delta', a=0.147, b=0.33, d=0.474)} AS delta_level FROM ({_EFFECTS}) JOIN ({_DELTA}) USING (dataset, model_a, model_b)")
add("nemenyi_critical_difference", "dataset k:l n:l cd:d", lambda t: significance.critical_difference(t.scores, 2.728), "sc", "SELECT *, 2.728 * sqrt(k * (k + 1) / (6.0 * n)) AS cd FROM (SELECT dataset, count(DISTINCT model) AS k, count(DISTINCT obs) AS n FROM sc GROUP BY ALL)")
add("nemenyi", f"{_PAIR} rank_a:d rank_b:d rank_difference:d cd:d p_value:d significant", lambda t: significance.nemenyi(t.scores))
add(
    "wilcoxon_statistic", f"{_PAIR} w_plus:d w_minus:d statistic:d n:l", lambda t: significance.signed_ranks(t.scores), "df",
    "SELECT *, least(w_plus, w_minus) AS statistic FROM (SELECT dataset, model_a, model_b, sum(CASE WHEN d > 0 THEN r ELSE 0 END) AS w_plus, sum(CASE WHEN d < 0 THEN r ELSE 0 END) AS w_minus, count(*) AS n FROM (SELECT *, rank() OVER (PARTITION BY dataset, model_a, model_b ORDER BY abs(d)) + (count(*) OVER (PARTITION BY dataset, model_a, model_b, abs(d)) - 1) / 2.0 AS r FROM (SELECT dataset, model_a, model_b, round(d, 12) AS d FROM df) WHERE d <> 0) GROUP BY ALL)",
)
add("wilcoxon_pairwise", f"{_PAIR} statistic:d p_value_raw:d p_value_adj:d mode significant", lambda t: significance.wilcoxon(t.scores))
add("bootstrap_ci", "dataset model mean:d low:d high:d", lambda t: significance.bootstrap(t.scores))

_SHARES = " ".join(f"contribution__{m}:d contribution_pct__{m}:d" for m in COMPONENTS)
add("contribution_frame", f"dataset model cbs:d baseline_rank:d {_SHARES}", lambda t: t.frame, "frame", "SELECT *, " + ", ".join(f"{w}::DOUBLE * {m} AS contribution__{m}, CASE WHEN cbs > 0 THEN {w}::DOUBLE * {m} / cbs END AS contribution_pct__{m}" for m, w in WEIGHTS.items()) + " FROM frame")
_SMALL = "SELECT dataset, model, metric, direction, value AS baseline_metric, perturbation, cbs AS baseline_cbs, cbs + delta AS perturbed_cbs, delta AS delta_cbs, abs(delta) AS absolute_delta_cbs FROM (SELECT *, weight * (least(greatest(value + perturbation, 0), 1) - value) AS delta FROM cl, (VALUES ('up', 0.01), ('down', -0.01)) AS w(direction, perturbation))"
add("sensitivity_small", "dataset model metric direction baseline_metric:d perturbation:d baseline_cbs:d perturbed_cbs:d delta_cbs:d absolute_delta_cbs:d", lambda t: robustness.small_perturbations(t.frame), "cl", _SMALL)
add("sensitivity_ranking", "dataset scenario metric mean_absolute_delta_cbs:d rank:l", lambda t: robustness.sensitivity_ranking(robustness.small_perturbations(t.frame).withColumn("scenario", F.lit("small_perturbation"))), "cl", f"SELECT *, dense_rank() OVER (PARTITION BY dataset ORDER BY round(mean_absolute_delta_cbs, 12) DESC) AS rank FROM (SELECT dataset, 'small_perturbation' AS scenario, metric, avg(absolute_delta_cbs) AS mean_absolute_delta_cbs FROM ({_SMALL}) GROUP BY ALL)")


def _noisy(draws: list[float], spread: str, join: str) -> str:
    """Scores under the same draws, in SQL."""
    values = ", ".join(f"({z!r}::DOUBLE)" for z in draws)
    return f"""
SELECT dataset, model, metric, max(value) AS baseline_metric, max(spread) AS perturbation, max(cbs) AS baseline_cbs, avg(score) AS perturbed_cbs, avg(score) - max(cbs) AS delta_cbs,
  avg(abs(score - cbs)) AS absolute_delta_cbs, stddev_samp(score) AS cbs_std, quantile_cont(score, 0.025) AS cbs_lower, quantile_cont(score, 0.975) AS cbs_upper
FROM (SELECT *, cbs + weight * (least(greatest(value + spread * z, 0), 1) - value) AS score FROM (SELECT *, CAST({spread} AS DOUBLE) AS spread FROM cl {join}) CROSS JOIN (VALUES {values}) AS d(z))
GROUP BY dataset, model, metric"""


add("sensitivity_noise", "dataset model metric baseline_metric:d perturbation:d baseline_cbs:d perturbed_cbs:d delta_cbs:d absolute_delta_cbs:d cbs_std:d cbs_lower:d cbs_upper:d", lambda t: robustness.noise_perturbations(t.frame, robustness.noise_table(t.spark, 128), F.lit(0.02)), "cl", _noisy(robustness.noise_draws(128), "0.02", ""))
add("sensitivity_fold_variability", "dataset model metric baseline_metric:d perturbation:d baseline_cbs:d perturbed_cbs:d delta_cbs:d absolute_delta_cbs:d cbs_std:d cbs_lower:d cbs_upper:d", lambda t: robustness.noise_perturbations(t.frame.join(t.parts.select("dataset", "model", "cv"), ["dataset", "model"]), robustness.noise_table(t.spark, 256), F.col("cv")), "cl parts", _noisy(robustness.noise_draws(256), "cv", "JOIN (SELECT dataset, model, cv FROM parts) USING (dataset, model)"))

_VALUES = ", ".join("(" + ", ".join(f"'{x}'" if isinstance(x, str) else f"{x!r}::DOUBLE" for x in row) + ")" for row in robustness.weight_grid_vectors())
_GRID = (
    "SELECT *, rank() OVER (PARTITION BY dataset, metric, perturbation_level, direction ORDER BY round(perturbed_cbs, 12) DESC) + (count(*) OVER (PARTITION BY dataset, metric, perturbation_level, direction, round(perturbed_cbs, 12)) - 1) / 2.0 AS perturbed_rank FROM ("
    + f"SELECT dataset, model, cbs, baseline_rank, metric, perturbation_level, direction, baseline_weight, perturbed_weight, {' + '.join(f'w_{m} * {m}' for m in COMPONENTS)} AS perturbed_cbs FROM frame, (VALUES {_VALUES}) AS g(metric, perturbation_level, direction, baseline_weight, perturbed_weight, {', '.join(f'w_{m}' for m in COMPONENTS)}))"
)
_SCENARIO = "dataset metric perturbation_level:d direction"
add("weight_grid", f"{_SCENARIO} model baseline_weight:d perturbed_weight:d baseline_cbs:d perturbed_cbs:d score_delta:d baseline_rank:d perturbed_rank:d rank_shift:d", lambda t: robustness.weight_grid(t.frame), "frame", f"SELECT *, cbs AS baseline_cbs, perturbed_cbs - cbs AS score_delta, perturbed_rank - baseline_rank AS rank_shift FROM ({_GRID})")
_AGREE = f"""
WITH g AS (SELECT * FROM ({_GRID})),
s AS (SELECT dataset, metric, perturbation_level, direction, CASE WHEN min(baseline_rank) < max(baseline_rank) AND min(perturbed_rank) < max(perturbed_rank) THEN corr(baseline_rank, perturbed_rank) END AS spearman FROM g GROUP BY ALL),
p AS (SELECT a.dataset, a.metric, a.perturbation_level, a.direction, sign(a.baseline_rank - b.baseline_rank) AS x, sign(a.perturbed_rank - b.perturbed_rank) AS y FROM g a JOIN g b ON a.dataset = b.dataset AND a.metric = b.metric AND a.perturbation_level = b.perturbation_level AND a.direction = b.direction AND a.model < b.model),
k AS (SELECT dataset, metric, perturbation_level, direction, CASE WHEN sum(abs(x)) > 0 AND sum(abs(y)) > 0 THEN sum(x * y) / sqrt(sum(abs(x)) * sum(abs(y))) END AS kendall, sum(CASE WHEN x * y < 0 THEN 1 ELSE 0 END) AS reversals FROM p GROUP BY ALL)
SELECT * FROM s JOIN k USING (dataset, metric, perturbation_level, direction)"""
for _name, _column in (("rank_reversals", "reversals:l"), ("rank_correlation_spearman", "spearman:d"), ("rank_correlation_kendall", "kendall:d")):
    add(_name, f"{_SCENARIO} {_column}", lambda t: robustness.grid_agreement(robustness.weight_grid(t.frame)), "frame", _AGREE)
add("dirichlet_weights", "sample_id:l " + " ".join(f"w_{m}:d" for m in COMPONENTS), lambda t: robustness.dirichlet_weights(t.spark), "", "SELECT * FROM (VALUES " + ", ".join(f"({i}, {', '.join(f'{x!r}::DOUBLE' for x in row)})" for i, row in enumerate(robustness.dirichlet_draws())) + f") AS t(sample_id, {', '.join(f'w_{m}' for m in COMPONENTS)})")
add("monte_carlo_summary", "dataset model baseline_cbs:d baseline_rank:d cbs_mean:d cbs_std:d mean_rank:d rank_std:d top1_probability:d rank_1_frequency:d rank_reversal_frequency:d mean_spearman:d mean_kendall:d mean_reversals:d", lambda t: robustness.monte_carlo(t.frame, robustness.dirichlet_weights(t.spark, 2000)))

_DOMINANCE = """
SELECT *, contribution_variance / nullif(sum(contribution_variance) OVER (PARTITION BY dataset), 0) AS variance_contribution_pct,
  dense_rank() OVER (PARTITION BY dataset ORDER BY round(mean_leave_one_out_impact, 12) DESC) AS impact_rank, dense_rank() OVER (PARTITION BY dataset ORDER BY round(mean_contribution_pct, 12) DESC) AS contribution_rank FROM (
  SELECT dataset, metric, max(weight) AS weight, avg(contribution) AS mean_contribution, coalesce(var_samp(contribution), 0) AS contribution_variance, avg(share) AS mean_contribution_pct, max(share) AS max_contribution_pct, min(share) AS min_contribution_pct,
    avg(abs(cbs - (cbs - contribution) / (1 - weight))) AS mean_leave_one_out_impact, CASE WHEN min(value) < max(value) THEN corr(cbs, value) END AS pearson_cbs_corr, CASE WHEN min(value) < max(value) THEN corr(cbs_rank, value_rank) END AS spearman_cbs_corr,
    avg(value) AS metric_mean, stddev_samp(value) AS metric_std FROM clr GROUP BY ALL)"""
add("metric_dominance", "dataset metric weight:d mean_contribution:d contribution_variance:d variance_contribution_pct:d mean_contribution_pct:d max_contribution_pct:d min_contribution_pct:d mean_leave_one_out_impact:d pearson_cbs_corr:d spearman_cbs_corr:d metric_mean:d metric_std:d impact_rank:l contribution_rank:l", lambda t: robustness.dominance(t.frame), "clr", _DOMINANCE)
_P3 = "CASE WHEN abs({r}) >= 1 - 1e-12 THEN 0 ELSE 1 - 2 / pi() * (atan(abs({r}) / sqrt(1 - {r} * {r})) + abs({r}) * sqrt(1 - {r} * {r})) END"
add(
    "cbs_correlation", "dataset metric pearson_r:d pearson_p:d spearman_r:d spearman_p:d", lambda t: robustness.correlations(t.frame), "clr",
    f"SELECT *, {_P3.format(r='pearson_r')} AS pearson_p, {_P3.format(r='spearman_r')} AS spearman_p FROM (SELECT dataset, metric, CASE WHEN min(value) < max(value) THEN corr(cbs, value) END AS pearson_r, CASE WHEN min(value) < max(value) THEN corr(cbs_rank, value_rank) END AS spearman_r FROM clr GROUP BY ALL)",
)
_NAMES = ["cbs", *COMPONENTS]
add("redundancy_pairs", "dataset metric_a metric_b pearson_r:d", lambda t: robustness.redundancy(t.frame), "frame", "SELECT * FROM (" + " UNION ALL ".join(f"SELECT dataset, '{a}' AS metric_a, '{b}' AS metric_b, CASE WHEN min({a}) < max({a}) AND min({b}) < max({b}) THEN corr({a}, {b}) END AS pearson_r FROM frame GROUP BY 1" for i, a in enumerate(_NAMES) for b in _NAMES[i + 1 :]) + ") WHERE abs(pearson_r) >= 0.9")
_AUDIT = """
SELECT *, CASE WHEN raw_std > 1e-15 THEN normalized_std / raw_std END AS compression_ratio, artifact_reason <> '' AS artifact_flag FROM (
  SELECT *, concat_ws('; ', CASE WHEN NOT bounded_0_1 THEN 'outside [0, 1]' END, CASE WHEN unique_raw_values > 1 AND unique_normalized_values <= 1 THEN 'collapsed to one value' END, CASE WHEN ranking_distortion > 0 THEN 'rank distortion' END) AS artifact_reason FROM (
    SELECT dataset, metric, min(raw) AS raw_min, max(raw) AS raw_max, stddev_samp(raw) AS raw_std, min(norm) AS normalized_min, max(norm) AS normalized_max, stddev_samp(norm) AS normalized_std, CASE WHEN min(a) < max(a) AND min(b) < max(b) THEN corr(a, b) END AS rank_correlation, sum(abs(a - b)) AS ranking_distortion,
      count(DISTINCT round(raw, 12)) AS unique_raw_values, count(DISTINCT round(norm, 12)) AS unique_normalized_values, bool_and(norm >= 0 AND norm <= 1) AS bounded_0_1 FROM (
      SELECT *, rank() OVER (PARTITION BY dataset, metric ORDER BY round(raw, 12) DESC) + (count(*) OVER (PARTITION BY dataset, metric, round(raw, 12)) - 1) / 2.0 AS a, rank() OVER (PARTITION BY dataset, metric ORDER BY round(norm, 12) DESC) + (count(*) OVER (PARTITION BY dataset, metric, round(norm, 12)) - 1) / 2.0 AS b FROM ({source})) GROUP BY ALL))"""
_AUDIT_SPEC = "dataset metric raw_min:d raw_max:d raw_std:d normalized_min:d normalized_max:d normalized_std:d compression_ratio:d rank_correlation:d ranking_distortion:d unique_raw_values:l unique_normalized_values:l bounded_0_1 artifact_flag artifact_reason"
_IN = ", ".join(COMPONENTS)
add("normalization_audit", _AUDIT_SPEC, lambda t: robustness.normalization_audit(t.parts, t.frame), "raw frame", _AUDIT.replace("{source}", f"SELECT * FROM (SELECT dataset, model, metric, raw FROM raw UNPIVOT (raw FOR metric IN ({_IN}))) JOIN (SELECT dataset, model, metric, norm FROM frame UNPIVOT (norm FOR metric IN ({_IN}))) USING (dataset, model, metric)"))
add("cbs_proxy_audit", _AUDIT_SPEC, lambda t: robustness.proxy_audit(t.parts, t.frame), "raw frame", _AUDIT.replace("{source}", f"SELECT dataset, 'cbs_proxy' AS metric, p.raw, f.cbs AS norm FROM (SELECT dataset, model, {' + '.join(f'{w}::DOUBLE * {m}' for m, w in WEIGHTS.items())} AS raw FROM raw) p JOIN frame f USING (dataset, model)"))


def _matrix(t: Inputs):
    return strict_matrix(t.scores.where("NOT (dataset = 'BUILDING' AND model = '5-LOW')").select("dataset", "model", "score"))


_MEANS = "SELECT dataset, model, avg(score) AS score FROM sc WHERE NOT (dataset = 'BUILDING' AND model = '5-LOW') GROUP BY ALL"
_STRICT = f"SELECT * FROM ({_MEANS}) SEMI JOIN (SELECT model FROM ({_MEANS}) GROUP BY 1 HAVING count(*) = (SELECT count(DISTINCT dataset) FROM ({_MEANS}))) USING (model)"
add("multidataset_matrix", "dataset model score:d", lambda t: t.scores.groupBy("dataset", "model").agg(F.avg("score").alias("score")), "sc", "SELECT dataset, model, avg(score) AS score FROM sc GROUP BY ALL")
add("multidataset_strict_intersection", "dataset model score:d", _matrix, "sc", _STRICT)
add(
    "multidataset_friedman", "n_models:l n_observations:l statistic:d df:l p_value:d significant", lambda t: significance.friedman(t.scores.groupBy("dataset", "model").agg(F.avg("score").alias("score")).select(F.lit("all").alias("group"), F.col("dataset").alias("obs"), "model", "score"), ["group"]), "sc",
    _FRIEDMAN.replace("{rr}", "(SELECT 'all' AS dataset, model, rank() OVER (PARTITION BY dataset ORDER BY round(score, 12) DESC) + (count(*) OVER (PARTITION BY dataset, round(score, 12)) - 1) / 2.0 AS rank, count(*) OVER (PARTITION BY dataset, round(score, 12)) AS tied FROM (SELECT dataset, model, avg(score) AS score FROM sc GROUP BY ALL))"),
)

add("cbs_saved_vs_recomputed", "dataset model cbs:d saved_cbs:d difference:d", lambda t: composite.against_saved(t.frame, t.frame.where("model <> '5-LOW'").select("dataset", "model", F.round(F.col("cbs") + 3.1e-10, 3).alias("cbs"))), "frame", "SELECT dataset, f.model, cbs, CASE WHEN f.model <> '5-LOW' THEN round(cbs + 3.1e-10::DOUBLE, 3) END AS saved_cbs, CASE WHEN f.model <> '5-LOW' THEN cbs - round(cbs + 3.1e-10::DOUBLE, 3) END AS difference FROM frame f")
add("cross_domain_rollup", "dataset top1_probability:d cbs_std:d compression_ratio:d rank_correlation:d weight_agreement:d mean_impact:d top_metric", lambda t: robustness.cross_domain(robustness.monte_carlo(t.frame, robustness.dirichlet_weights(t.spark, 2000)), robustness.normalization_audit(t.parts, t.frame), robustness.grid_agreement(robustness.weight_grid(t.frame)), robustness.dominance(t.frame)))

add("collapsed_components", "dataset model f1:d roc_auc:d accuracy:d precision:d recall:d", lambda t: robustness.collapsed(t.folds), "fm", "SELECT dataset, model, avg(f1) AS f1, avg(roc_auc) AS roc_auc, avg(accuracy) AS accuracy, avg(precision) AS precision, avg(recall) AS recall FROM fm GROUP BY ALL")
add(
    "score_problems", "dataset problem n:l", lambda t: significance.problems(t.folds.where("f1 > 0.5 or fold_id <> 4").select("dataset", (F.col("repetition_id") * 5 + F.col("fold_id")).alias("obs"), "model", F.when(F.col("fold_id") != 3, F.col("f1")).alias("score"))), "fm",
    "WITH s AS (SELECT dataset, repetition_id * 5 + fold_id AS obs, model, CASE WHEN fold_id <> 3 THEN f1 END AS score FROM fm WHERE f1 > 0.5 OR fold_id <> 4), k AS (SELECT dataset, count(DISTINCT model) AS k FROM s GROUP BY 1), o AS (SELECT dataset, obs, count(DISTINCT model) AS n FROM s GROUP BY 1, 2) "
    "SELECT dataset, 'score is not finite' AS problem, count(*) AS n FROM s WHERE score IS NULL GROUP BY 1 UNION ALL SELECT dataset, 'observation that some model lacks', count(*) FROM o JOIN k USING (dataset) WHERE n < k GROUP BY 1",
)
