"""Queries on fold metrics: summaries, stability, timing, scores, predictions."""

from __future__ import annotations

from pyspark.sql import functions as F

from gaugewright.operators import composite, scoring, summary
from gaugewright.operators.composite import COMPONENTS
from gaugewright.plans.base import BINARY, CLASSES, KEYS, METRICS, SHARES, Catalogue

catalogue = Catalogue()
add = catalogue.add

_STATS = "avg(value) AS mean, {std}(value) AS std, min(value) AS min, max(value) AS max, count(value) AS n"
_FOLDS = "dataset model repetition_id:l fold_id:l"

add("fold_metrics_wide", f"{_FOLDS} " + " ".join(f"{m}:d" for m in METRICS) + " n_samples:l", lambda t: t.folds, "fm", "SELECT * FROM fm")
add("fold_metrics_long", f"{_FOLDS} metric value:d", lambda t: t.long, "fl", "SELECT * FROM fl")
for _name, _by in (("cv_summary", []), ("cv_summary_by_repetition", ["repetition_id"]), ("cv_summary_by_fold", ["fold_id"])):
    add(_name, "dataset model " + "".join(f"{b}:l " for b in _by) + "metric mean:d std:d min:d max:d n:l", lambda t, by=_by: summary.summarize(t.long, [*KEYS, *by]), "fl", f"SELECT {', '.join(['dataset', 'model', *_by])}, metric, {_STATS.format(std='stddev_samp')} FROM fl GROUP BY ALL")
add("run_totals", "dataset model n_folds:l n_repetitions:l folds_per_repetition:d n_samples:l train_time:d eval_time:d total_time:d", lambda t: summary.run_totals(t.folds, KEYS), "fm", "SELECT dataset, model, count(*) AS n_folds, count(DISTINCT repetition_id) AS n_repetitions, count(*) / count(DISTINCT repetition_id) AS folds_per_repetition, sum(n_samples) AS n_samples, sum(train_time) AS train_time, sum(eval_time) AS eval_time, sum(total_time) AS total_time FROM fm GROUP BY ALL")
add(
    "pipeline_summary_grouping_sets", "dataset model metric level group_id:l mean:d std:d min:d max:d", lambda t: summary.summarize_levels(t.long, KEYS), "fl",
    "SELECT dataset, model, metric, CASE WHEN grouping(repetition_id) = 0 THEN 'repetition' WHEN grouping(fold_id) = 0 THEN 'fold' ELSE 'overall' END AS level, coalesce(repetition_id, fold_id) AS group_id, avg(value) AS mean, stddev_pop(value) AS std, min(value) AS min, max(value) AS max FROM fl GROUP BY GROUPING SETS ((dataset, model, metric), (dataset, model, metric, repetition_id), (dataset, model, metric, fold_id))",
)
add(
    "best_worst_fold", "dataset model metric best_repetition:l best_fold:l best_value:d worst_repetition:l worst_fold:l worst_value:d", lambda t: summary.best_worst(t.long, KEYS), "fl",
    "SELECT dataset, model, metric, max(repetition_id) FILTER (WHERE b = 1) AS best_repetition, max(fold_id) FILTER (WHERE b = 1) AS best_fold, max(value) FILTER (WHERE b = 1) AS best_value, max(repetition_id) FILTER (WHERE w = 1) AS worst_repetition, max(fold_id) FILTER (WHERE w = 1) AS worst_fold, max(value) FILTER (WHERE w = 1) AS worst_value FROM (SELECT *, row_number() OVER (PARTITION BY dataset, model, metric ORDER BY value DESC, repetition_id, fold_id) AS b, row_number() OVER (PARTITION BY dataset, model, metric ORDER BY value, repetition_id, fold_id) AS w FROM fl) GROUP BY ALL",
)

_STABLE = "avg({v}) AS mean, stddev_pop({v}) AS std, min({v}) AS min, max({v}) AS max, max({v}) - min({v}) AS range, count(*) AS n, CASE WHEN avg({v}) > 0 THEN stddev_pop({v}) / avg({v}) ELSE 0 END AS cv, 1 / (1 + CASE WHEN avg({v}) > 0 THEN stddev_pop({v}) / avg({v}) ELSE 0 END) AS stability_score"
_STABLE_SPEC = "metric mean:d std:d min:d max:d range:d n:l cv:d stability_score:d"
add("stability_by_metric", f"dataset model {_STABLE_SPEC}", lambda t: summary.stability(t.long, KEYS), "fl", f"SELECT dataset, model, metric, {_STABLE.format(v='value')} FROM fl GROUP BY ALL")
add("stability_by_repetition", f"dataset model repetition_id:l {_STABLE_SPEC}", lambda t: summary.stability(t.long, [*KEYS, "repetition_id"]), "fl", f"SELECT dataset, model, repetition_id, metric, {_STABLE.format(v='value')} FROM fl GROUP BY ALL")
add("cross_rep_stability", f"dataset model {_STABLE_SPEC}", lambda t: summary.cross_repetition_stability(t.long, KEYS), "fl", f"SELECT dataset, model, metric, {_STABLE.format(v='m')} FROM (SELECT dataset, model, metric, repetition_id, avg(value) AS m FROM fl GROUP BY ALL) GROUP BY ALL")
add(
    "stability_assessment", "dataset model primary_metric_mean:d primary_metric_std:d primary_metric_cv:d is_stable stability_level", lambda t: summary.assess(t.long, KEYS), "fl",
    f"SELECT dataset, model, mean AS primary_metric_mean, std AS primary_metric_std, cv AS primary_metric_cv, cv <= 0.05 AS is_stable, CASE WHEN cv <= 0.05 THEN 'High' WHEN cv <= 0.1 THEN 'Medium' ELSE 'Low' END AS stability_level FROM (SELECT dataset, model, {_STABLE.format(v='value')} FROM fl WHERE metric = 'f1' GROUP BY ALL)",
)
_TIMING = ", ".join(f"{f}({t}) AS {t}_{n}" for t in summary.TIMES for n, f in (("mean", "avg"), ("std", "stddev_pop"), ("min", "min"), ("max", "max"), ("total", "sum")))
add("timing_aggregate", "dataset model " + " ".join(f"{t}_{n}:d" for t in summary.TIMES for n in ("mean", "std", "min", "max", "total")) + " n_folds:l", lambda t: summary.timing(t.folds, KEYS), "fm", f"SELECT dataset, model, {_TIMING}, count(*) AS n_folds FROM fm GROUP BY ALL")
add("efficiency_compare", "dataset model avg_train_time:d avg_eval_time:d avg_total_time:d efficiency_score:d total_cost:d", lambda t: summary.efficiency(t.folds, KEYS), "fm", "SELECT dataset, model, avg(train_time) AS avg_train_time, avg(eval_time) AS avg_eval_time, avg(total_time) AS avg_total_time, CASE WHEN avg(total_time) > 0 THEN 1 / (1 + avg(total_time)) ELSE 1 END AS efficiency_score, sum(total_time) AS total_cost FROM fm GROUP BY ALL")
add(
    "fold_timing", f"{_FOLDS} train_time:d eval_time:d total_time:d train_time_per_sample:d eval_time_per_sample:d train_eval_ratio:d", lambda t: summary.fold_timing(t.folds.withColumn("n_train", F.col("n_samples") * 4).withColumn("n_test", F.col("n_samples"))), "fm",
    "SELECT *, train_time / (n_samples * 4) AS train_time_per_sample, eval_time / n_samples AS eval_time_per_sample, CASE WHEN train_time > 0 THEN eval_time / train_time ELSE 0 END AS train_eval_ratio FROM fm",
)
add("metric_range_violations", f"{_FOLDS} metric value:d error", lambda t: summary.range_errors(t.long.withColumn("value", F.when(F.col("fold_id") == 4, F.col("value") + 0.9).otherwise(F.col("value")))), "fl", "SELECT dataset, model, repetition_id, fold_id, metric, v AS value, 'outside [0, 1]' AS error FROM (SELECT *, CASE WHEN fold_id = 4 THEN value + 0.9 ELSE value END AS v FROM fl) WHERE metric NOT LIKE '%time' AND (v < 0 OR v > 1)")
add("normal_ci", "dataset model metric mean:d low:d high:d", lambda t: summary.normal_interval(t.long, KEYS), "fl", "SELECT dataset, model, metric, avg(value) AS mean, avg(value) - 1.96 * stddev_samp(value) / sqrt(count(*)) AS low, avg(value) + 1.96 * stddev_samp(value) / sqrt(count(*)) AS high FROM fl GROUP BY ALL")

_COMPONENTS = " ".join(f"{m}:d" for m in COMPONENTS)
add("component_scores", f"dataset model {_COMPONENTS}", lambda t: composite.raw_scores(t.parts, KEYS), "raw", "SELECT * FROM raw")
add("normalized_scores", f"dataset model {_COMPONENTS}", lambda t: composite.normalize(composite.raw_scores(t.parts, KEYS)), "norm", "SELECT * FROM norm")
add("cbs_scores", "dataset model cbs:d", lambda t: t.frame, "frame", "SELECT * FROM frame")
_POSITION = "SELECT dataset, model, cbs, row_number() OVER (PARTITION BY dataset ORDER BY round(cbs, 12) DESC, model) AS position, baseline_rank FROM frame"
add("cbs_ranking", "dataset model cbs:d position:l baseline_rank:d", lambda t: composite.ranking(t.frame), "frame", _POSITION)
add("cbs_topk", "dataset model cbs:d position:l", lambda t: composite.top(t.frame), "frame", f"SELECT * FROM ({_POSITION}) WHERE position <= 3")

_MATRIX = "SELECT a.model, a.label AS y_true, b.label AS y_pred, count(c.row_id) AS n FROM {l} a JOIN {l} b ON a.model = b.model LEFT JOIN classes c ON c.model = a.model AND c.y_true = a.label AND c.y_pred = b.label GROUP BY ALL".replace("{l}", "(SELECT DISTINCT model, y_true AS label FROM classes UNION SELECT DISTINCT model, y_pred FROM classes)")
_PER = "SELECT model, label, sum(t) AS support, sum(p) AS predicted, sum(h) AS hits FROM (SELECT model, y_true AS label, 1 AS t, 0 AS p, 0 AS h FROM classes UNION ALL SELECT model, y_pred, 0, 1, CASE WHEN y_true = y_pred THEN 1 ELSE 0 END FROM classes) GROUP BY ALL"
_PRF = f"SELECT *, CASE WHEN predicted > 0 THEN hits / predicted ELSE 0 END AS precision, CASE WHEN support > 0 THEN hits / support ELSE 0 END AS recall, CASE WHEN support + predicted > 0 THEN 2 * hits / (support + predicted) ELSE 0 END AS f1 FROM ({_PER})"


def _classes(t):
    return scoring.confusion(t.sql(CLASSES), ["model"])


add("confusion_matrix", "model y_true y_pred n:l", _classes, "classes", _MATRIX)
add("per_class_metrics", "model label support:l precision:d recall:d f1:d", lambda t: scoring.per_class(_classes(t), ["model"]), "classes", _PRF)
_MEANS = {
    "weighted": "sum(precision * support) / sum(support) AS precision, sum(recall * support) / sum(support) AS recall, sum(f1 * support) / sum(support) AS f1",
    "macro": "avg(precision) AS precision, avg(recall) AS recall, avg(f1) AS f1",
    "micro": "sum(hits) / sum(support) AS precision, sum(hits) / sum(support) AS recall, 2 * sum(hits) / (sum(support) + sum(predicted)) AS f1",
}
for _kind, _sql in _MEANS.items():
    add(f"classification_metrics_{_kind}", "model accuracy:d precision:d recall:d f1:d", lambda t, kind=_kind: scoring.averaged(_classes(t), ["model"], kind), "classes", f"SELECT model, sum(hits) / sum(support) AS accuracy, {_sql} FROM ({_PRF}) GROUP BY ALL")
add(
    "mcc_multiclass", "model mcc:d", lambda t: scoring.matthews(_classes(t), ["model"]), "classes",
    f"SELECT model, (sum(hits)::DOUBLE * sum(support) - sum(support::DOUBLE * predicted)) / sqrt((sum(support)::DOUBLE * sum(support) - sum(predicted::DOUBLE * predicted)) * (sum(support)::DOUBLE * sum(support) - sum(support::DOUBLE * support))) AS mcc FROM ({_PER}) GROUP BY ALL",
)
_AREA = "(sum(CASE WHEN positive = 1 THEN r ELSE 0 END) - sum(positive) * (sum(positive) + 1) / 2.0) / nullif(sum(positive) * sum(1 - positive), 0)"


def _binary(t):
    return t.sql(BINARY)


def _ovr(t):
    return scoring.auc_one_vs_rest(t.sql(SHARES), ["model"])


add("roc_auc_binary", "model roc_auc:d n_positive:l", lambda t: scoring.auc(_binary(t), ["model"]), "two", f"SELECT model, {_AREA} AS roc_auc, sum(positive) AS n_positive FROM (SELECT *, rank() OVER (PARTITION BY model ORDER BY score) + (count(*) OVER (PARTITION BY model, score) - 1) / 2.0 AS r FROM two) GROUP BY ALL")
add(
    "roc_auc_ovr_weighted", "model roc_auc:d", _ovr, "shares",
    f"SELECT model, sum(a * n) / sum(n) AS roc_auc FROM (SELECT model, label, {_AREA} AS a, sum(positive) AS n FROM (SELECT model, label, CASE WHEN y_true = label THEN 1 ELSE 0 END AS positive, rank() OVER (PARTITION BY model, label ORDER BY score) + (count(*) OVER (PARTITION BY model, label, score) - 1) / 2.0 AS r FROM shares) GROUP BY ALL) GROUP BY ALL",
)
add(
    "fold_scores_binary", "model accuracy:d precision:d recall:d f1:d mcc:d n_samples:l n_classes:l", lambda t: scoring.fold_metrics(_binary(t), ["model"]), "two",
    "WITH p AS (SELECT model, label, sum(t) AS support, sum(p) AS predicted, sum(h) AS hits FROM (SELECT model, y_true AS label, 1 AS t, 0 AS p, 0 AS h FROM two UNION ALL SELECT model, y_pred, 0, 1, CASE WHEN y_true = y_pred THEN 1 ELSE 0 END FROM two) GROUP BY ALL) SELECT model, sum(hits) / sum(support) AS accuracy, sum(CASE WHEN predicted > 0 THEN hits / predicted * support ELSE 0 END) / sum(support) AS precision, sum(hits) / sum(support) AS recall, sum(2 * hits / (support + predicted) * support) / sum(support) AS f1, (sum(hits)::DOUBLE * sum(support) - sum(support::DOUBLE * predicted)) / sqrt((sum(support)::DOUBLE * sum(support) - sum(predicted::DOUBLE * predicted)) * (sum(support)::DOUBLE * sum(support) - sum(support::DOUBLE * support))) AS mcc, sum(support) AS n_samples, count(*) AS n_classes FROM p GROUP BY ALL",
)
