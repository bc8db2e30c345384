"""Queries on raw tables: audits, cleaning, splits and folds, feature preparation, group leakage, models, work lists."""

from __future__ import annotations

from pyspark.sql import functions as F

from gaugewright.operators import clean, features, folds, leakage, models, profile, scoring
from gaugewright.plans.base import DIRTY, HOLES, Catalogue, Inputs

catalogue = Catalogue()
add = catalogue.add


def _columns_sql(table: str, columns: list[str], each: str, where: str) -> str:
    """The same expression for each column of a table, one row a column."""
    return "SELECT * FROM (" + " UNION ALL ".join(f"SELECT '{c}' AS \"column\", " + each.replace("{c}", c) + f" FROM {table}" for c in columns) + f") WHERE {where}"


_CUSTOMER, _ORDERS, _PART = ["c_custkey", "c_name", "c_nationkey", "c_acctbal", "c_mktsegment"], ["o_orderkey", "o_custkey", "o_orderstatus", "o_totalprice", "o_orderdate", "o_orderpriority"], ["p_partkey", "p_name", "p_brand", "p_type", "p_size", "p_retailprice"]
_DIRTY = ["c_custkey", "c_name", "segment", "code", "balance", "target"]

add("dataset_metadata", "n_samples:l n_features:l n_target_classes:l target_type n_numeric:l n_categorical:l", lambda t: profile.metadata(t.table("orders"), "o_orderstatus"), "", "SELECT count(*) AS n_samples, 5 AS n_features, count(DISTINCT o_orderstatus) AS n_target_classes, 'classification' AS target_type, 3 AS n_numeric, 1 AS n_categorical FROM orders")
add("class_distribution", "o_orderstatus n:l pct:d", lambda t: scoring.class_shares(t.table("orders"), [], "o_orderstatus"), "", "SELECT o_orderstatus, count(*) AS n, 100.0 * count(*) / sum(count(*)) OVER () AS pct FROM orders GROUP BY 1")
add("missing_values", "column n_missing:l", lambda t: profile.missing_values(t.sql(DIRTY)), "dirty", _columns_sql("dirty", _DIRTY, "count(*) - count({c}) AS n_missing", "n_missing > 0"))
_CELLS = " UNION ALL ".join(f"SELECT c_custkey AS row_, '{c}' AS \"column\", coalesce(trim(CAST({c} AS VARCHAR)), 'nan') AS value, {'CAST(' + c + ' AS DOUBLE)' if c in ('c_custkey', 'balance') else 'NULL::DOUBLE'} AS num FROM dirty" for c in _DIRTY)
_TOKENS = ", ".join("'" + p.replace("'", "''") + "'" for p in profile.PLACEHOLDERS)
add(
    "audit_placeholders", "column token n:l", lambda t: profile.placeholders(t.sql(DIRTY), "c_custkey"), "dirty",
    f"WITH cells AS ({_CELLS}) SELECT \"column\", token, count(*) AS n FROM (SELECT \"column\", value AS token FROM cells WHERE value IN ({_TOKENS}) UNION ALL SELECT \"column\", CAST(CAST(num AS BIGINT) AS VARCHAR) FROM cells WHERE num IN (-999, -9999, 999, 9999) UNION ALL SELECT \"column\", '__digits__' FROM cells WHERE regexp_matches(value, '^__[0-9]+__$') UNION ALL SELECT \"column\", '**text**' FROM cells WHERE regexp_matches(value, '^\\*\\*.*\\*\\*$')) GROUP BY ALL",
)
add("audit_placeholder_examples", "column token example", lambda t: profile.placeholders(t.sql(DIRTY), "c_custkey").where("token in ('__digits__', '**text**')"), "dirty", f"WITH cells AS ({_CELLS}) SELECT \"column\", token, arg_min(value, row_) AS example FROM (SELECT *, CASE WHEN regexp_matches(value, '^__[0-9]+__$') THEN '__digits__' WHEN regexp_matches(value, '^\\*\\*.*\\*\\*$') THEN '**text**' END AS token FROM cells) WHERE token IS NOT NULL GROUP BY ALL")
_NAMED = "(" + " OR ".join(f"contains(lower(\"column\"), '{w}')" for w in profile.IDENTIFIER_WORDS) + ")"
add(
    "audit_identifiers", "column reason unique_ratio:d", lambda t: profile.identifiers(t.table("customer")), "",
    f"SELECT *, CASE WHEN named AND fully THEN 'Name heuristic and fully unique values' WHEN named THEN 'Name heuristic' ELSE 'Fully unique values' END AS reason FROM (SELECT *, {_NAMED} AS named, u = n AND \"column\" <> 'c_acctbal' AS fully, u / n AS unique_ratio FROM ({_columns_sql('customer', _CUSTOMER, 'count(DISTINCT {c}) AS u, count(*) AS n', 'true')})) WHERE named OR fully",
)
add("audit_high_cardinality", "column unique_values:l ratio:d", lambda t: profile.high_cardinality(t.table("part"), "p_type"), "", _columns_sql("part", ["p_name", "p_brand"], "count(DISTINCT {c}) AS unique_values, count(DISTINCT {c}) / count(*) AS ratio", "unique_values > 50 OR (ratio > 0.05 AND unique_values > 10)"))
add("audit_grouped_entities", "column n_groups:l max_repetitions:l avg_repetitions:d", lambda t: profile.grouped_entities(t.table("events")), "", "SELECT * FROM (SELECT 'user_id' AS \"column\", count(*) AS n_groups, max(n) AS max_repetitions, sum(n) / count(*) AS avg_repetitions FROM (SELECT user_id, count(*) AS n FROM events GROUP BY 1) UNION ALL SELECT 'event_id', count(*), max(n), sum(n) / count(*) FROM (SELECT event_id, count(*) AS n FROM events GROUP BY 1)) WHERE n_groups > 1 AND avg_repetitions > 1")
add("audit_corrupted_labels", "label n:l", lambda t: profile.corrupted_labels(t.sql(DIRTY), "target"), "dirty", "SELECT target AS label, count(*) AS n FROM dirty WHERE regexp_matches(target, '[!@#$%^&*()_+={}\\[\\]|\\\\:;\"''<>,.?/~`]') GROUP BY 1")
_CONSTANT = "SELECT *, 'x' AS always, CASE WHEN c_custkey = 1 THEN 'a' ELSE 'b' END AS mostly FROM {customer}"
add(
    "audit_constant_features", "column kind top_share:d", lambda t: profile.constant_features(t.sql(_CONSTANT)), "",
    "SELECT \"column\", CASE WHEN u = 1 THEN 'constant' ELSE 'near_constant' END AS kind, top / n AS top_share FROM (" + " UNION ALL ".join(f"SELECT '{c}' AS \"column\", count(*) AS u, max(n) AS top, sum(n) AS n FROM (SELECT {c}, count(*) AS n FROM ({_CONSTANT.format(customer='customer')}) WHERE {c} IS NOT NULL GROUP BY 1)" for c in [*_CUSTOMER, "always", "mostly"]) + ") WHERE u = 1 OR top / n > 0.99",
)
add("audit_duplicates", "duplicates:l near_duplicates:l", lambda t: profile.duplicates(t.table("documents").select("doc_id", "text", "lang", "source").withColumn("doc_id", F.col("doc_id") % 500), ["doc_id"]), "", "WITH d AS (SELECT doc_id % 500 AS doc_id, text, lang, source FROM documents) SELECT duplicates, further - duplicates AS near_duplicates FROM (SELECT sum(n - 1) AS duplicates FROM (SELECT count(*) AS n FROM d GROUP BY doc_id, text, lang, source)), (SELECT sum(n - 1) AS further FROM (SELECT count(*) AS n FROM d GROUP BY text, lang, source))")
add("audit_imbalance", "n_classes:l imbalance_ratio:d", lambda t: profile.imbalance(t.table("orders"), "o_orderstatus"), "", "SELECT count(*) AS n_classes, max(n) / min(n) AS imbalance_ratio FROM (SELECT count(*) AS n FROM orders GROUP BY o_orderstatus)")
add(
    "audit_leakage_pearson", "column correlation:d leaks", lambda t: profile.leakage_pearson(t.sql("SELECT c_custkey, c_nationkey, c_acctbal, CASE c_mktsegment WHEN 'BUILDING' THEN 1.0D WHEN 'MACHINERY' THEN 2.0D ELSE 0.0D END AS hint, c_mktsegment FROM {customer}"), "c_mktsegment", "c_custkey"), "",
    "WITH f AS (SELECT c_mktsegment, row_number() OVER (ORDER BY min(c_custkey)) - 1 AS code FROM customer GROUP BY 1), d AS (SELECT c.*, f.code::DOUBLE AS code, CASE c.c_mktsegment WHEN 'BUILDING' THEN 1.0 WHEN 'MACHINERY' THEN 2.0 ELSE 0.0 END AS hint FROM customer c JOIN f USING (c_mktsegment)) SELECT *, abs(correlation) > 0.95 AS leaks FROM (SELECT 'c_custkey' AS \"column\", corr(c_custkey, code) AS correlation FROM d UNION ALL SELECT 'c_nationkey', corr(c_nationkey, code) FROM d UNION ALL SELECT 'c_acctbal', corr(c_acctbal, code) FROM d UNION ALL SELECT 'hint', corr(hint, code) FROM d)",
)
add(
    "audit_leakage_separation", "column n_values:l separates", lambda t: profile.leakage_separation(t.sql("SELECT o_orderstatus, o_orderpriority, concat(o_orderstatus, '-', cast(o_orderkey % 3 AS string)) AS hint FROM {orders}"), "o_orderstatus"), "",
    "WITH d AS (SELECT o_orderstatus AS y, o_orderpriority, o_orderstatus || '-' || (o_orderkey % 3) AS hint FROM orders) SELECT \"column\", count(*) AS n_values, bool_and(k = 1) AND count(*) > 1 AS separates FROM (SELECT 'o_orderpriority' AS \"column\", o_orderpriority, count(DISTINCT y) AS k FROM d GROUP BY ALL UNION ALL SELECT 'hint', hint, count(DISTINCT y) FROM d GROUP BY ALL) GROUP BY 1",
)

_BLANK = "CASE WHEN NOT ({c} IN ('_______', '---', '#F%$D@*&8', '_', 'nan', 'NAN', 'NaN') OR regexp_matches({c}, '^__.*__$') OR regexp_matches({c}, '^\\*\\*.*__$') OR regexp_matches({c}, '^\\*\\*.*\\*\\*')) THEN {c} END"
_KEPT = "target IS NOT NULL AND target <> '!@9#%8'"
add(
    "sanitize_customers", "balance:d segment code:d target", lambda t: clean.sanitize(t.sql(DIRTY), "target"), "dirty",
    f"SELECT DISTINCT balance, {_BLANK.format(c='segment')} AS segment, CAST(rtrim(code, '_') AS DOUBLE) AS code, target FROM dirty WHERE {_KEPT}",
)
add(
    "sanitize_events", "event_id:l event_type props", lambda t: clean.blank_placeholders(t.sql("SELECT event_id, CASE WHEN event_id % 5 = 0 THEN '_' ELSE event_type END AS event_type, CASE WHEN event_id % 7 = 0 THEN '**x**y' ELSE props END AS props FROM {events}")), "",
    "SELECT event_id, CASE WHEN event_id % 5 <> 0 THEN event_type END AS event_type, CASE WHEN event_id % 7 <> 0 THEN props END AS props FROM events",
)
add("numeric_coercion", "c_custkey:l code:d", lambda t: clean.coerce_numbers(t.sql(DIRTY)), "dirty", "SELECT c_custkey, CAST(rtrim(code, '_') AS DOUBLE) AS code FROM dirty")
add("dedup_keep_first", "doc_id:l source", lambda t: clean.keep_first(t.table("documents"), "doc_id", ["text", "lang"]), "", "SELECT doc_id, source FROM documents QUALIFY row_number() OVER (PARTITION BY text, lang ORDER BY doc_id) = 1")
add("remediation_stats", "before_rows:l dropped_rows:l after_rows:l before_columns:l after_columns:l", lambda t: clean.remediate_financial(t.sql(DIRTY), "target")[1], "dirty", "SELECT count(*) AS before_rows, count(*) FILTER (WHERE target = '!@9#%8') AS dropped_rows, count(*) - count(*) FILTER (WHERE target = '!@9#%8') AS after_rows, 6 AS before_columns, 6 AS after_columns FROM dirty")
add("dedup_stats", "before_rows:l after_rows:l duplicate_pct:d", lambda t: clean.remediate_heart(t.table("documents").select("text", "lang"))[1], "", "SELECT count(*) AS before_rows, count(DISTINCT (text, lang)) AS after_rows, 100.0 * (count(*) - count(DISTINCT (text, lang))) / count(*) AS duplicate_pct FROM documents")

_ORDER = "md5('42:' || o_orderkey)"


def _orders(t: Inputs):
    return t.table("orders").select("o_orderkey", "o_custkey", "o_orderstatus")


_PLACED = f"SELECT o_orderkey, o_custkey, o_orderstatus, row_number() OVER (PARTITION BY o_orderstatus ORDER BY {_ORDER}, o_orderkey) AS place, count(*) OVER (PARTITION BY o_orderstatus) AS n FROM orders"
_SPLIT = f"SELECT *, CASE WHEN place <= round(n * 0.3::DOUBLE) THEN 'test' ELSE 'train' END AS part FROM ({_PLACED})"
add("stratified_split", "o_orderkey:l part", lambda t: folds.split(_orders(t), "o_orderkey", "o_orderstatus", 0.3), "", _SPLIT)
add("train_val_test_split", "o_orderkey:l part", lambda t: folds.three_way(_orders(t), "o_orderkey", "o_orderstatus", 0.7, 0.15), "", f"SELECT *, CASE WHEN place <= round(n * 0.15::DOUBLE) THEN 'test' WHEN place <= round(n * 0.15::DOUBLE) + round(n * 0.15::DOUBLE) THEN 'validation' ELSE 'train' END AS part FROM ({_PLACED})")
_FOLDS = "SELECT o_orderkey, o_custkey, o_orderstatus, r AS repetition_id, (row_number() OVER (PARTITION BY r, o_orderstatus ORDER BY md5((42 + r) || ':' || o_orderkey), o_orderkey) - 1) % 5 AS fold_id FROM orders, range(3) AS reps(r)"


def _assigned(t: Inputs):
    return folds.folds(_orders(t), "o_orderkey", "o_orderstatus")


add("stratified_folds", "o_orderkey:l repetition_id:l fold_id:l", _assigned, "", _FOLDS)
add("kfold_plain", "o_orderkey:l repetition_id:l fold_id:l", lambda t: folds.folds(_orders(t), "o_orderkey", None), "", "SELECT o_orderkey, r AS repetition_id, (row_number() OVER (PARTITION BY r, substr(md5((42 + r) || ':' || o_orderkey), 1, 2) ORDER BY md5((42 + r) || ':' || o_orderkey), o_orderkey) - 1) % 5 AS fold_id FROM orders, range(3) AS reps(r)")
add("fold_info", "repetition_id:l fold_id:l o_orderstatus n:l test_size:l train_size:l test_pct:d", lambda t: folds.fold_info(_assigned(t), "o_orderstatus"), "", f"SELECT *, sum(n) OVER (PARTITION BY repetition_id, fold_id) AS test_size, sum(n) OVER (PARTITION BY repetition_id) - sum(n) OVER (PARTITION BY repetition_id, fold_id) AS train_size, 100.0 * n / sum(n) OVER (PARTITION BY repetition_id, fold_id) AS test_pct FROM (SELECT repetition_id, fold_id, o_orderstatus, count(*) AS n FROM ({_FOLDS}) GROUP BY ALL)")
add("fold_validation", "repetitions:l covers valid", lambda t: folds.validate(_assigned(t), t.table("orders").count(), 5, 3), "", "SELECT 3 AS repetitions, true AS covers, true AS valid")

_PARTED = "SELECT *, CASE WHEN c_custkey % 4 = 0 THEN 'test' ELSE 'train' END AS part FROM holes"


def _holes(t: Inputs):
    df = t.sql(HOLES)
    return df.where("c_custkey % 4 <> 0"), df


def _fitted(make, *columns, **options):
    def run(t: Inputs):
        train, df = _holes(t)
        return make(train, list(columns), **options)(df)

    return run


add("impute_mean_median", "c_custkey:l balance:d median:d", lambda t: features.impute_numeric(_holes(t)[0].withColumn("median", F.col("balance")), ["median"], "median")(features.impute_numeric(_holes(t)[0], ["balance"])(_holes(t)[1].withColumn("median", F.col("balance")))), "holes", "SELECT c_custkey, coalesce(balance, (SELECT avg(balance) FROM holes WHERE c_custkey % 4 <> 0)) AS balance, coalesce(balance, (SELECT median(balance) FROM holes WHERE c_custkey % 4 <> 0)) AS median FROM holes")
add("impute_most_frequent", "c_custkey:l segment", _fitted(features.impute_text, "segment"), "holes", "SELECT c_custkey, coalesce(segment, (SELECT segment FROM holes WHERE segment IS NOT NULL AND c_custkey % 4 <> 0 GROUP BY 1 ORDER BY count(*) DESC, segment LIMIT 1)) AS segment FROM holes")
_TRAIN = "(SELECT * FROM holes WHERE c_custkey % 4 <> 0)"
for _kind, _centre, _scale in (("standard", "avg({c})", "stddev_pop({c})"), ("minmax", "min({c})", "max({c}) - min({c})"), ("robust", "median({c})", "quantile_cont({c}, 0.75) - quantile_cont({c}, 0.25)")):
    add(f"scale_{_kind}", "c_custkey:l balance:d nation:d", _fitted(features.scale, "balance", "nation", kind=_kind), "holes", "SELECT c_custkey, (balance - m1) / s1 AS balance, (nation - m2) / s2 AS nation FROM holes, (SELECT " + ", ".join(f"{_centre.format(c=c)} AS m{i}, {_scale.format(c=c)} AS s{i}" for i, c in ((1, "balance"), (2, "nation"))) + f" FROM {_TRAIN})")
add("encode_onehot", "c_custkey:l automobile:l building:l furniture:l household:l machinery:l odd:l", lambda t: _fitted(features.onehot, "segment", "parity")(t).select("c_custkey", *[F.col(f"`segment={s.upper()}`").alias(s) for s in ("automobile", "building", "furniture", "household", "machinery")], F.col("`parity=odd`").alias("odd")), "holes", "SELECT c_custkey, " + ", ".join(f"coalesce(segment = '{s.upper()}', false)::INT AS {s}" for s in ("automobile", "building", "furniture", "household", "machinery")) + ", (parity = 'odd')::INT AS odd FROM holes")
add("encode_ordinal", "c_custkey:l segment:l", _fitted(features.ordinal, "segment"), "holes", f"SELECT c_custkey, coalesce(code, -1) AS segment FROM holes LEFT JOIN (SELECT segment, row_number() OVER (ORDER BY segment) - 1 AS code FROM (SELECT DISTINCT segment FROM {_TRAIN} WHERE segment IS NOT NULL)) USING (segment)")

_SIZES = "SELECT user_id, count(*) AS n FROM events GROUP BY 1"
_STATISTICS = f"SELECT *, 100.0 * n_repeated / n_groups AS pct_repeated, 100.0 * rows_repeated / n_rows AS pct_rows_repeated FROM (SELECT count(*) AS n_groups, sum(n) AS n_rows, avg(n) AS mean_size, median(n) AS median_size, max(n) AS max_size, min(n) AS min_size, stddev_samp(n) AS std_size, count(*) FILTER (WHERE n > 1) AS n_repeated, sum(n) FILTER (WHERE n > 1) AS rows_repeated FROM ({_SIZES}))"
add("group_candidates", "column n_unique:l max_group_size:l", lambda t: leakage.candidates(t.table("events"), "event_type"), "", f"SELECT 'user_id' AS \"column\", count(*) AS n_unique, max(n) AS max_group_size FROM ({_SIZES})")
add("group_statistics", "n_groups:l n_rows:l mean_size:d median_size:d max_size:l min_size:l std_size:d n_repeated:l rows_repeated:l pct_repeated:d pct_rows_repeated:d", lambda t: leakage.group_statistics(t.table("events"), "user_id"), "", _STATISTICS)
_EVENT_FOLDS = "SELECT event_id, user_id, event_type, r AS repetition_id, (row_number() OVER (PARTITION BY r, event_type ORDER BY md5((42 + r) || ':' || event_id), event_id) - 1) % 5 AS fold_id FROM events, range(3) AS reps(r)"
_LEAKS = f"SELECT repetition_id, fold_id, sum(n) AS test_rows, count(*) AS test_groups, 100.0 * sum(CASE WHEN k > 1 THEN n ELSE 0 END) / sum(n) AS pct_rows_leaked, 100.0 * count(*) FILTER (WHERE k > 1) / count(*) AS pct_groups_leaked FROM (SELECT *, count(*) OVER (PARTITION BY repetition_id, user_id) AS k FROM (SELECT repetition_id, user_id, fold_id, count(*) AS n FROM ({_EVENT_FOLDS}) GROUP BY ALL)) GROUP BY ALL"


def _event_leaks(t: Inputs):
    events = t.table("events")
    assigned = folds.folds(events, "event_id", "event_type").join(events.select("event_id", "user_id"), "event_id")
    return leakage.fold_leakage(assigned, "user_id")


add("group_leakage_simulation", "repetition_id:l fold_id:l test_rows:l test_groups:l pct_rows_leaked:d pct_groups_leaked:d", _event_leaks, "", _LEAKS)
add("group_leakage_split", "test_rows:l test_groups:l pct_rows_leaked:d pct_groups_leaked:d", lambda t: leakage.split_leakage(folds.split(_orders(t), "o_orderkey", "o_orderstatus", 0.3), "o_custkey"), "", f"SELECT sum(test) AS test_rows, count(*) AS test_groups, 100.0 * sum(CASE WHEN train > 0 THEN test ELSE 0 END) / sum(test) AS pct_rows_leaked, 100.0 * count(*) FILTER (WHERE train > 0) / count(*) AS pct_groups_leaked FROM (SELECT o_custkey, count(*) FILTER (WHERE part = 'test') AS test, count(*) FILTER (WHERE part = 'train') AS train FROM ({_SPLIT}) GROUP BY 1) WHERE test > 0")
add(
    "group_leakage_risk", "n_groups:l unique_ratio:d mean_size:d pct_rows_repeated:d cv_pct:d recommendation confidence", lambda t: leakage.risk(leakage.group_statistics(t.table("events"), "user_id"), _event_leaks(t), 5), "",
    f"SELECT *, CASE WHEN category THEN 'Safe for current StratifiedKFold' WHEN genuine AND cv_pct > 80 THEN 'StratifiedGroupKFold recommended' WHEN genuine AND cv_pct > 50 THEN 'GroupKFold recommended' WHEN few THEN 'Safe for current StratifiedKFold' ELSE 'Insufficient evidence' END AS recommendation, CASE WHEN category OR (genuine AND cv_pct > 80) THEN 'HIGH' WHEN genuine AND cv_pct > 50 THEN 'MEDIUM' WHEN few THEN 'HIGH' ELSE 'LOW' END AS confidence FROM (SELECT *, unique_ratio < 0.05 AND n_groups < 30 AS category, mean_size >= 2 AND pct_rows_repeated > 50 AND unique_ratio > 0.01 AS genuine, pct_rows_repeated < 10 OR mean_size < 1.5 AS few FROM (SELECT *, n_groups / n_rows AS unique_ratio, (SELECT avg(pct_rows_leaked) FROM ({_LEAKS})) AS cv_pct FROM ({_STATISTICS})))",
)
add("group_leakage_verdict", "n_columns:l recommendation confidence", lambda t: leakage.verdict(leakage.risk(leakage.group_statistics(t.table("events"), "user_id"), _event_leaks(t), 5).withColumn("column", F.lit("user_id"))), "", "SELECT 1 AS n_columns, CASE WHEN NOT (n_groups / n_rows < 0.05 AND n_groups < 30) AND mean_size >= 2 AND pct_rows_repeated > 50 AND n_groups / n_rows > 0.01 AND cv > 50 THEN CASE WHEN cv > 80 THEN 'StratifiedGroupKFold recommended' ELSE 'GroupKFold recommended' END ELSE 'Safe for current StratifiedKFold' END AS recommendation, CASE WHEN NOT (n_groups / n_rows < 0.05 AND n_groups < 30) AND mean_size >= 2 AND pct_rows_repeated > 50 AND n_groups / n_rows > 0.01 AND cv > 50 THEN 'MEDIUM' ELSE 'HIGH' END AS confidence FROM (SELECT *, (SELECT avg(pct_rows_leaked) FROM (" + _LEAKS + ")) AS cv FROM (" + _STATISTICS + "))")
_TABLES = [("customer", 5), ("part", 6), ("orders", 6), ("events", 6)]


def _sizes(t: Inputs):
    parts = [t.table(n).agg(F.lit(n).alias("dataset"), F.count(F.lit(1)).alias("n_rows"), F.lit(k).alias("n_features")) for n, k in _TABLES]
    out = parts[0]
    for p in parts[1:]:
        out = out.unionByName(p)
    return leakage.runtime_estimate(out)


add("runtime_cost_estimate", "dataset n_rows:l estimate_s:d cost_class svm_bottleneck memory_bottleneck", _sizes, "", "SELECT *, CASE WHEN estimate_s < 60 THEN 'Safe to rerun now' WHEN estimate_s < 600 THEN 'High compute cost' ELSE 'Very high compute cost' END AS cost_class, n_rows > 10000 AS svm_bottleneck, n_rows * n_features > 500000 AS memory_bottleneck FROM (SELECT *, 25 * (pow(n_rows / 1000.0, 2.5) * (n_features / 10.0) + n_rows / 1000.0 * (n_features / 10.0) * 6) AS estimate_s FROM (" + " UNION ALL ".join(f"SELECT '{n}' AS dataset, count(*) AS n_rows, {k} AS n_features FROM {n}" for n, k in _TABLES) + "))")
add("resume_worklist", "model repetition_id:l fold_id:l", lambda t: models.worklist(t.folds.select("model").distinct(), t.folds, t.folds.where("dataset = 'BUILDING' AND (repetition_id < 1 OR model < '3')")), "fm", "SELECT m.model, f.repetition_id, f.fold_id FROM (SELECT DISTINCT model FROM fm) m, (SELECT DISTINCT repetition_id, fold_id FROM fm) f ANTI JOIN (SELECT model, repetition_id, fold_id FROM fm WHERE dataset = 'BUILDING' AND (repetition_id < 1 OR model < '3')) d ON d.model = m.model AND d.repetition_id = f.repetition_id AND d.fold_id = f.fold_id")


def _cv(name: str):
    def run(t: Inputs):
        rows = t.table("embeddings").select("vec_id", F.col("embedding").alias("features"), "label")
        assigned = folds.folds(rows, "vec_id", "label")
        return models.cross_validate(rows, assigned, "vec_id", [name]).drop("train_time", "eval_time", "error")

    return run


for _name, _model in (("logreg", "LogisticRegression"), ("tree", "DecisionTree"), ("forest", "RandomForest"), ("svm_ovr", "LinearSVM"), ("gbt_ovr", "GradientBoosting")):
    add(f"model_cv_{_name}", "model repetition_id:l fold_id:l accuracy:d precision:d recall:d f1:d mcc:d roc_auc:d n_samples:l n_classes:l", _cv(_model))


def _out_of_fold(t: Inputs):
    """How often each row of embeddings is predicted out of fold: once in each repetition, under its own label."""
    rows = t.table("embeddings").select("vec_id", F.col("embedding").alias("features"), "label")
    found, _ = models.out_of_fold(rows, folds.folds(rows, "vec_id", "label", n_splits=2, n_repetitions=2), "vec_id", ["DecisionTree"])
    return found.groupBy("model", F.col("row_id").alias("vec_id"), "y_true").agg(F.count(F.lit(1)).alias("n"), F.countDistinct("repetition_id").alias("n_repetitions"))


add("out_of_fold_coverage", "model vec_id:l y_true n:l n_repetitions:l", _out_of_fold, "", "SELECT 'DecisionTree' AS model, vec_id, CAST(label AS VARCHAR) AS y_true, 2 AS n, 2 AS n_repetitions FROM embeddings")
_LABELLED = "SELECT c_custkey AS row_key, CASE WHEN c_custkey % 9 = 0 THEN '---' ELSE CAST(c_nationkey AS STRING) || '_' END AS code, CAST(c_nationkey % 2 AS STRING) AS target FROM {customer}"
add("sanitize_numeric_labels", "code:d target", lambda t: clean.sanitize(t.sql(_LABELLED), "target", drop_ids=False, drop_duplicates=False).select("code", "target"), "", "SELECT CASE WHEN c_custkey % 9 = 0 THEN NULL ELSE c_nationkey END AS code, CAST(c_nationkey % 2 AS VARCHAR) AS target FROM customer")
