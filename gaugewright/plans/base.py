"""Input frames of the queries, and the shape that results and SQL share."""

from __future__ import annotations

from collections.abc import Callable
from functools import cached_property

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from gaugewright.operators import composite, summary

KEYS = ["dataset", "model"]
FOLD = [*KEYS, "repetition_id", "fold_id"]
METRICS = [*summary.QUALITY, *summary.TIMES]

#: Inputs that both engines read from the same text: customers with placeholders, sentinels, corrupted and missing targets; customers and orders with missing values; predictions.
DIRTY = """
SELECT c_custkey, c_name,
  CASE WHEN c_custkey % 7 = 0 THEN '_______' WHEN c_custkey % 11 = 0 THEN '---' WHEN c_custkey % 13 = 0 THEN '__10000__' WHEN c_custkey % 17 = 0 THEN '**8000**' ELSE c_mktsegment END AS segment,
  CASE WHEN c_custkey % 19 = 0 THEN NULL WHEN c_custkey % 5 = 0 THEN CAST(c_nationkey AS STRING) || '_' ELSE CAST(c_nationkey AS STRING) END AS code,
  CASE WHEN c_custkey % 23 = 0 THEN CAST(-999 AS DOUBLE) ELSE c_acctbal END AS balance,
  CASE WHEN c_custkey % 29 = 0 THEN '!@9#%8' WHEN c_custkey % 31 = 0 THEN NULL ELSE c_mktsegment END AS target
FROM {customer}"""
HOLES = """
SELECT c_custkey, CASE WHEN c_custkey % 11 = 0 THEN NULL ELSE c_acctbal END AS balance, CASE WHEN c_custkey % 13 = 0 THEN NULL ELSE c_mktsegment END AS segment,
  CAST(c_nationkey AS DOUBLE) AS nation, CASE WHEN c_custkey % 2 = 0 THEN 'even' ELSE 'odd' END AS parity
FROM {customer}"""
BINARY = "SELECT 'toxic' AS model, CAST(l.doc_id AS BIGINT) AS row_id, CAST(quality AS STRING) AS y_true, CAST(toxic AS STRING) AS y_pred, quality AS positive, CAST(n_chars AS DOUBLE) AS score FROM {labels} l JOIN {documents} d ON l.doc_id = d.doc_id"
CLASSES = "SELECT o_orderpriority AS model, o_orderkey AS row_id, o_orderstatus AS y_true, CASE o_custkey % 3 WHEN 0 THEN 'F' WHEN 1 THEN 'O' ELSE 'P' END AS y_pred FROM {orders}"
SHARES = "SELECT o_orderpriority AS model, o_orderkey AS row_id, o_orderstatus AS y_true, label, CASE label WHEN 'F' THEN o_totalprice WHEN 'O' THEN CAST(o_custkey % 97 AS DOUBLE) ELSE CAST(o_orderkey % 89 AS DOUBLE) END AS score FROM {orders}, (SELECT 'F' AS label UNION ALL SELECT 'O' UNION ALL SELECT 'P') AS labels"

TABLES = ["region", "nation", "customer", "supplier", "part", "orders", "lineitem", "events", "documents", "embeddings", "labels", "conversations"]

#: Added before results are rounded, so that a decimal that ends in a five there goes the same way whatever its last bits are.
NUDGE = 3.1e-10

#: Common table expressions, in the order in which they build on each other.
CTES = {
    "dirty": DIRTY.format(customer="customer"),
    "holes": HOLES.format(customer="customer"),
    "two": BINARY.format(labels="labels", documents="documents"),
    "classes": CLASSES.format(orders="orders"),
    "shares": SHARES.format(orders="orders"),
    "fm": """
SELECT c_mktsegment AS dataset, o_orderpriority AS model, CAST(o_orderkey % 3 AS INTEGER) AS repetition_id, CAST((o_orderkey // 3) % 5 AS INTEGER) AS fold_id,
  round(avg(l_discount) * 10, 8) AS f1, round(avg(l_tax) * 10, 8) AS roc_auc, round(avg(CASE WHEN l_returnflag = 'R' THEN 1 ELSE 0 END), 8) AS accuracy,
  round(avg(CASE WHEN l_linestatus = 'O' THEN 1 ELSE 0 END), 8) AS precision, round(avg(CASE WHEN o_orderstatus = 'F' THEN 1 ELSE 0 END), 8) AS recall,
  round(avg(l_quantity) / 10, 8) AS train_time, round(avg(l_linenumber) / 100, 8) AS eval_time, round(avg(l_quantity) / 10, 8) + round(avg(l_linenumber) / 100, 8) AS total_time, count(*) AS n_samples
FROM lineitem JOIN orders ON l_orderkey = o_orderkey JOIN customer ON o_custkey = c_custkey GROUP BY 1, 2, 3, 4""",
    "fl": f"SELECT dataset, model, repetition_id, fold_id, metric, value FROM fm UNPIVOT (value FOR metric IN ({', '.join(METRICS)}))",
    "parts": f"""
SELECT dataset, model, {', '.join(f'avg({m}) AS {m}' for m in summary.QUALITY)}, avg(total_time) AS total_time,
  CASE WHEN avg(f1) > 0 THEN stddev_pop(f1) / avg(f1) ELSE 0 END AS cv, 1 / (1 + CASE WHEN avg(f1) > 0 THEN stddev_pop(f1) / avg(f1) ELSE 0 END) AS stability_score
FROM fm GROUP BY 1, 2""",
    "raw": f"SELECT dataset, model, {', '.join(summary.QUALITY)}, 1 / (1 + total_time) AS time_score, stability_score FROM parts",
    "norm": f"""
SELECT dataset, model, {', '.join(f'CASE WHEN max({m}) OVER w = min({m}) OVER w THEN 1 ELSE ({m} - min({m}) OVER w) / (max({m}) OVER w - min({m}) OVER w) END AS {m}' for m in composite.COMPONENTS)}
FROM raw WINDOW w AS (PARTITION BY dataset)""",
    "cbs": f"SELECT *, {' + '.join(f'CAST({w} AS DOUBLE) * {m}' for m, w in composite.WEIGHTS.items())} AS cbs FROM norm",
    "frame": "SELECT *, rank() OVER (PARTITION BY dataset ORDER BY round(cbs, 12) DESC) + (count(*) OVER (PARTITION BY dataset, round(cbs, 12)) - 1) / 2.0 AS baseline_rank FROM cbs",
    "cl": "SELECT dataset, model, cbs, baseline_rank, metric, value, weight, weight * value AS contribution, CASE WHEN cbs > 0 THEN weight * value / cbs END AS share FROM (SELECT dataset, model, cbs, baseline_rank, metric, value FROM frame UNPIVOT (value FOR metric IN (" + ", ".join(composite.COMPONENTS) + "))) JOIN (VALUES " + ", ".join(f"('{m}', CAST({w} AS DOUBLE))" for m, w in composite.WEIGHTS.items()) + ") AS t(metric, weight) USING (metric)",
    "clr": "SELECT *, " + ", ".join(f"rank() OVER (PARTITION BY dataset, metric ORDER BY round({c}, 12) DESC) + (count(*) OVER (PARTITION BY dataset, metric, round({c}, 12)) - 1) / 2.0 AS {n}" for c, n in (("cbs", "cbs_rank"), ("value", "value_rank"))) + " FROM cl",
    "sc": "SELECT dataset, repetition_id * 5 + fold_id AS obs, model, f1 AS score FROM fm SEMI JOIN (SELECT dataset, repetition_id, fold_id FROM fm GROUP BY 1, 2, 3 HAVING count(*) = 5) USING (dataset, repetition_id, fold_id)",
    "rr": "SELECT *, rank() OVER (PARTITION BY dataset, obs ORDER BY round(score, 12) DESC) + (count(*) OVER (PARTITION BY dataset, obs, round(score, 12)) - 1) / 2.0 AS rank, count(*) OVER (PARTITION BY dataset, obs, round(score, 12)) AS tied FROM sc",
    "df": "SELECT a.dataset, a.model AS model_a, b.model AS model_b, a.obs, a.score AS x, b.score AS y, a.score - b.score AS d FROM sc a JOIN sc b ON a.dataset = b.dataset AND a.obs = b.obs AND a.model < b.model",
}
#: What each expression builds on.
NEEDS = {"fl": ["fm"], "parts": ["fm"], "raw": ["parts"], "norm": ["raw"], "cbs": ["norm"], "frame": ["cbs"], "cl": ["frame"], "clr": ["cl"], "sc": ["fm"], "rr": ["sc"], "df": ["sc"]}


class Inputs:
    """The test tables of a folder and the frames that queries share."""

    def __init__(self, spark: SparkSession, folder: str):
        self.spark, self.folder = spark, folder

    def table(self, name: str) -> DataFrame:
        return self.spark.read.parquet(f"{self.folder}/{name}.parquet")

    def sql(self, text: str, **more: DataFrame) -> DataFrame:
        tables = {t: self.table(t) for t in TABLES if "{" + t + "}" in text}
        return self.spark.sql(text, **tables, **more)

    @cached_property
    def folds(self) -> DataFrame:
        """Fold metrics: line items are added up by order before any join, so what is shuffled is a row for each order."""
        flag = lambda c, v: F.count_if(F.col(c) == v)
        lines = self.table("lineitem").groupBy("l_orderkey").agg(
            F.count(F.lit(1)).alias("n"), F.sum("l_discount").alias("discount"), F.sum("l_tax").alias("tax"), flag("l_returnflag", "R").alias("returned"), flag("l_linestatus", "O").alias("open"), F.sum("l_quantity").alias("quantity"), F.sum("l_linenumber").alias("lines")
        )
        orders = self.table("orders").select("o_orderkey", "o_custkey", "o_orderpriority", "o_orderstatus")
        joined = lines.join(orders, F.col("l_orderkey") == F.col("o_orderkey")).join(self.table("customer").select("c_custkey", "c_mktsegment"), F.col("o_custkey") == F.col("c_custkey"))
        keys = [F.col("c_mktsegment").alias("dataset"), F.col("o_orderpriority").alias("model"), (F.col("o_orderkey") % 3).cast("int").alias("repetition_id"), F.expr("cast((o_orderkey div 3) % 5 as int)").alias("fold_id")]
        n = F.sum("n").cast("double")
        mean = lambda total, factor=1.0: F.round(total / n * factor, 8)
        found = joined.groupBy(*keys).agg(
            mean(F.sum("discount"), 10.0).alias("f1"), mean(F.sum("tax"), 10.0).alias("roc_auc"), mean(F.sum("returned")).alias("accuracy"), mean(F.sum("open")).alias("precision"), mean(F.sum(F.when(F.col("o_orderstatus") == "F", F.col("n")).otherwise(0))).alias("recall"),
            mean(F.sum("quantity"), 0.1).alias("train_time"), mean(F.sum("lines"), 0.01).alias("eval_time"), F.sum("n").alias("n_samples"),
        )
        return found.withColumn("total_time", F.col("train_time") + F.col("eval_time")).select(*FOLD, *METRICS, "n_samples")

    @cached_property
    def long(self) -> DataFrame:
        return summary.to_long(self.folds, FOLD, METRICS)

    @cached_property
    def parts(self) -> DataFrame:
        return composite.components(self.folds, KEYS)

    @cached_property
    def frame(self) -> DataFrame:
        return composite.scored(composite.normalize(composite.raw_scores(self.parts, KEYS)))

    @cached_property
    def scores(self) -> DataFrame:
        from gaugewright.operators.significance import aligned

        return aligned(self.folds.select("dataset", (F.col("repetition_id") * 5 + F.col("fold_id")).alias("obs"), "model", F.col("f1").alias("score")))


def shaped(df: DataFrame, spec: str) -> DataFrame:
    """Columns of a spec: ``name`` as it is, ``name:l`` as a long, ``name:d`` as a double rounded to six places."""

    def column(item: str) -> Column:
        name, _, kind = item.partition(":")
        c = F.col(f"`{name}`")
        return {"": c, "l": c.cast("long"), "d": F.round(c.cast("double") + F.lit(NUDGE), 6) + F.lit(0.0)}[kind].alias(name)

    return df.select(*[column(x) for x in spec.split()])


def shaped_sql(spec: str, ctes: str, body: str) -> str:
    """SQL for the columns of a spec from a body, with the common table expressions it uses."""

    def column(item: str) -> str:
        name, _, kind = item.partition(":")
        return {"": f'"{name}"', "l": f'CAST("{name}" AS BIGINT) AS "{name}"', "d": f'round(CAST("{name}" AS DOUBLE) + {NUDGE}::DOUBLE, 6) + 0.0::DOUBLE AS "{name}"'}[kind]

    wanted: list[str] = []

    def want(name: str) -> None:
        for n in NEEDS.get(name, []):
            want(n)
        if name not in wanted:
            wanted.append(name)

    for name in ctes.split():
        want(name)
    head = "WITH " + ", ".join(f"{n} AS ({CTES[n]})" for n in wanted) + " " if wanted else ""
    return f"{head}SELECT {', '.join(column(x) for x in spec.split())} FROM ({body}) AS result"


class Catalogue:
    """Queries by name: a function of Inputs, and SQL where there is any."""

    def __init__(self) -> None:
        self.queries: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
        self.sql: dict[str, str] = {}

    def add(self, name: str, spec: str, make: Callable[[Inputs], DataFrame], ctes: str = "", body: str | None = None) -> None:
        self.queries[name] = lambda spark, folder: shaped(make(Inputs(spark, folder)), spec)
        if body is not None:
            self.sql[name] = shaped_sql(spec, ctes, body)
