"""Audits of a raw table: every column's figures in one aggregate where the check allows it.

Column names that hold keywords are looked at on the driver; that needs no job.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from gaugewright.functions.columns import safe_corr

#: Words in the names of identifier, group and date columns; placeholder texts and numbers; characters that no class label should have.
IDENTIFIER_WORDS = ["id", "ssn", "name", "key", "subject", "student", "customer", "user", "member", "identity"]
ENTITY_WORDS = ["customer_id", "student_id", "user_id", "subject_id", "member_id", "group_id", "id"]
DATE_WORDS = ["date", "time", "timestamp", "year", "month"]
PLACEHOLDERS = ["_______", "#F%$D@*&8", "?", "NULL", "None", "NA", "N/A", "NaN", "", "-", "nan", "_", "--"]
SENTINELS = [-999, -9999, 999, 9999]
WRAPPED = {"__digits__": r"^__[0-9]+__$", "**text**": r"^\*\*.*\*\*$"}
LABEL_MARKS = r"""[!@#$%^&*()_+={}\[\]|\\:;"'<>,.?/~`]"""


def numeric_columns(df: DataFrame) -> list[str]:
    return [f.name for f in df.schema.fields if isinstance(f.dataType, T.NumericType)]


def text_columns(df: DataFrame) -> list[str]:
    return [f.name for f in df.schema.fields if isinstance(f.dataType, T.StringType)]


def _named(df: DataFrame, words: list[str]) -> list[str]:
    return [c for c in df.columns if any(w in c.lower() for w in words)]


def _columns(df: DataFrame, columns: list[str], *make) -> DataFrame:
    """(n_rows, column, figures...): make gives (name, aggregate of a column's name); one aggregate for all columns."""
    parts = [F.struct(F.lit(c).alias("column"), *[f(c).alias(name) for name, f in make]) for c in columns]
    kind = T.ArrayType(T.StructType([T.StructField("column", T.StringType())]))
    listed = F.array(*parts) if parts else F.array().cast(kind)
    return df.agg(F.count(F.lit(1)).alias("n_rows"), listed.alias("c")).select("n_rows", F.inline("c"))


def _entries(df: DataFrame, columns: list[str]) -> DataFrame:
    """(column, value) of all cells as text."""
    cells = F.array(*[F.struct(F.lit(c).alias("column"), F.col(f"`{c}`").cast("string").alias("value")) for c in columns]).cast("array<struct<column:string,value:string>>")
    return df.select(F.explode(cells).alias("e")).select("e.column", "e.value")


def distinct_counts(df: DataFrame, columns: list[str] | None = None) -> DataFrame:
    """Exact number of different values of each column, nulls left out, and of rows.

    Values are counted in long form by (column, value), which a cluster spreads over all tasks and combines
    before the shuffle; distinct counts of many columns side by side would copy each row once for each.
    """
    columns = df.columns if columns is None else columns
    values = _entries(df, columns).where("value is not null").groupBy("column", "value").agg(F.count(F.lit(1)).alias("n"))
    found = values.groupBy("column").agg(F.count(F.lit(1)).alias("n_unique"), F.max("n").alias("top"), F.sum("n").alias("n_values"))
    named = df.sparkSession.createDataFrame([(c,) for c in columns], "column string")  # a row a column
    return named.join(F.broadcast(found), "column", "left").na.fill(0).crossJoin(F.broadcast(df.agg(F.count(F.lit(1)).alias("n_rows"))))


def metadata(df: DataFrame, target: str) -> DataFrame:
    """Rows, features by kind, classes of the target, and whether that makes a classification: a text or fewer than 20 values."""
    if target not in df.columns:
        raise ValueError(f"no column {target!r} among {df.columns}")
    features = df.drop(target)
    textual = target in text_columns(df)
    return df.agg(F.count(F.lit(1)).alias("n_samples"), F.countDistinct(target).alias("n_target_classes")).select(
        "n_samples", F.lit(len(features.columns)).alias("n_features"), "n_target_classes", F.when(F.lit(textual) | (F.col("n_target_classes") < 20), "classification").otherwise("regression").alias("target_type"),
        F.lit(len(numeric_columns(features))).alias("n_numeric"), F.lit(len(text_columns(features))).alias("n_categorical"),
    )


def missing_values(df: DataFrame) -> DataFrame:
    """Columns with missing values and how many; NaN counts as missing."""
    floats = {f.name for f in df.schema.fields if isinstance(f.dataType, (T.DoubleType, T.FloatType))}
    none = lambda c: F.count_if(F.col(c).isNull() | F.isnan(c) if c in floats else F.col(c).isNull())
    return _columns(df, df.columns, ("n_missing", none)).where("n_missing > 0").select("column", "n_missing")


def placeholders(df: DataFrame, row_id: str) -> DataFrame:
    """(column, token, n, example): cells that hold a placeholder text, a sentinel number or a wrapped value, and the first example by row_id.

    A missing cell counts as the text ``nan``.
    """
    cells = df.select(F.col(row_id).alias("row_"), F.explode(F.array(*[F.struct(F.lit(c).alias("column"), F.coalesce(F.trim(F.col(f"`{c}`").cast("string")), F.lit("nan")).alias("value"), F.lit(c in numeric_columns(df)).alias("numeric")) for c in df.columns])).alias("e")).select("row_", "e.*")
    tokens = F.array(
        F.when(F.col("value").isin(PLACEHOLDERS), F.col("value")),
        F.when(F.col("numeric") & F.col("value").try_cast("double").isin([float(x) for x in SENTINELS]), F.col("value").try_cast("double").cast("long").cast("string")),
        *[F.when(F.col("value").rlike(pattern), F.lit(name)) for name, pattern in WRAPPED.items()],
    )
    hits = cells.withColumn("token", F.explode(F.filter(tokens, lambda t: t.isNotNull())))
    return hits.groupBy("column", "token").agg(F.count(F.lit(1)).alias("n"), F.min_by("value", "row_").alias("example"))


def high_cardinality(df: DataFrame, target: str) -> DataFrame:
    """Text columns with more than 50 values, or more than 10 that are over 5 % of the rows."""
    found = distinct_counts(df, [c for c in text_columns(df) if c != target]).withColumn("ratio", F.col("n_unique") / F.col("n_rows"))
    return found.where("n_unique > 50 or (ratio > 0.05 and n_unique > 10)").select("column", F.col("n_unique").alias("unique_values"), "ratio")


def grouped_entities(df: DataFrame, words: list[str] = ENTITY_WORDS) -> DataFrame:
    """Columns named like entities whose values repeat: groups, largest and average repetition."""
    found = distinct_counts(df, _named(df, words)).where("n_unique > 1 and n_unique < n_rows")
    return found.select("column", F.col("n_unique").alias("n_groups"), F.col("top").alias("max_repetitions"), (F.col("n_rows") / F.col("n_unique")).alias("avg_repetitions"))


def corrupted_labels(df: DataFrame, target: str) -> DataFrame:
    """Class labels with punctuation, and their counts."""
    return df.groupBy(F.col(target).cast("string").alias("label")).agg(F.count(F.lit(1)).alias("n")).where(F.col("label").rlike(LABEL_MARKS))


def identifiers(df: DataFrame, words: list[str] = IDENTIFIER_WORDS) -> DataFrame:
    """Columns named like identifiers, and text or whole-number columns whose values are all different."""
    named = F.col("column").isin(_named(df, words)) if _named(df, words) else F.lit(False)
    whole = [f.name for f in df.schema.fields if isinstance(f.dataType, (T.StringType, T.IntegralType))]
    unique = (F.col("n_unique") == F.col("n_rows")) & (F.col("column").isin(whole) if whole else F.lit(False))
    reason = F.when(named & unique, "Name heuristic and fully unique values").when(named, "Name heuristic").otherwise("Fully unique values")
    return distinct_counts(df).where((F.col("n_rows") > 0) & (named | unique)).select("column", reason.alias("reason"), (F.col("n_unique") / F.col("n_rows")).alias("unique_ratio"))


def constant_features(df: DataFrame, share: float = 0.99) -> DataFrame:
    """Columns of one value, and those where the most frequent makes more than ``share`` of the values; a column without values is neither."""
    found = distinct_counts(df).where("n_unique > 0").withColumn("top_share", F.col("top") / F.col("n_values"))
    kind = F.when(F.col("n_unique") == 1, "constant").when(F.col("top_share") > share, "near_constant")
    return found.withColumn("kind", kind).where("kind is not null").select("column", "kind", "top_share")


def duplicates(df: DataFrame, identifiers: list[str]) -> DataFrame:
    """Rows that equal an earlier one, and further ones that do so without the identifier columns; nulls equal each other."""
    def extra(columns: list[str]) -> DataFrame:
        # hash aggregation on all columns: equal rows meet wherever they were, combined before the shuffle
        return df.groupBy(*columns).agg(F.count(F.lit(1)).alias("n")).agg(F.coalesce(F.sum(F.col("n") - 1), F.lit(0)).alias("n"))

    exact, near = extra(df.columns).withColumnRenamed("n", "duplicates"), extra([c for c in df.columns if c not in identifiers])
    return exact.crossJoin(F.broadcast(near)).select("duplicates", (F.col("n") - F.col("duplicates")).alias("near_duplicates"))


def imbalance(df: DataFrame, target: str) -> DataFrame:
    """Greatest over least class count, 1 for a single class."""
    counts = df.where(F.col(target).isNotNull()).groupBy(target).agg(F.count(F.lit(1)).alias("n"))
    return counts.agg(F.count(F.lit(1)).alias("n_classes"), (F.max("n") / F.min("n")).alias("imbalance_ratio"))


def leakage_pearson(df: DataFrame, target: str, row_id: str, least: float = 0.95) -> DataFrame:
    """Correlation of each numeric column with the target, whose texts count by first appearance (a missing one as -1), and whether it exceeds ``least``."""
    if target in text_columns(df):
        first = df.where(F.col(target).isNotNull()).groupBy(target).agg(F.min(row_id).alias("first_"))
        # a code for each class
        codes = first.withColumn("code_", (F.row_number().over(Window.orderBy("first_")) - 1).cast("double")).select(target, "code_")
        coded = df.join(codes, target, "left").na.fill(-1.0, ["code_"])
    else:
        coded = df.withColumn("code_", F.col(target).cast("double"))
    parts = [F.struct(F.lit(c).alias("column"), safe_corr(c, "code_").alias("correlation")) for c in numeric_columns(df) if c != target]
    return coded.agg(F.array(*parts).cast("array<struct<column:string,correlation:double>>").alias("c")).select(F.inline("c")).withColumn("leaks", F.coalesce(F.abs("correlation") > least, F.lit(False)))


def leakage_separation(df: DataFrame, target: str) -> DataFrame:
    """Text columns of several values each of which has one class alone: perfect separation."""
    columns = [c for c in text_columns(df) if c != target]
    cells = df.where(F.col(target).isNotNull()).select(F.col(target).cast("string").alias("y"), F.explode(F.array(*[F.struct(F.lit(c).alias("column"), F.col(c).alias("value")) for c in columns]).cast("array<struct<column:string,value:string>>")).alias("e")).select("y", "e.*").where("value is not null")
    values = cells.groupBy("column", "value").agg(F.min("y").alias("low"), F.max("y").alias("high"))
    return values.groupBy("column").agg(F.count(F.lit(1)).alias("n_values"), F.min(F.col("low") == F.col("high")).alias("pure")).select("column", "n_values", (F.col("pure") & (F.col("n_values") > 1)).alias("separates"))


def date_columns(df: DataFrame) -> list[str]:
    """Columns named like dates."""
    return _named(df, DATE_WORDS)


def audit(df: DataFrame, target: str, row_id: str) -> dict[str, DataFrame]:
    """All checks of a table by name."""
    ids = [r["column"] for r in identifiers(df).collect()]  # a row for each column at most
    return {
        "metadata": metadata(df, target), "missing": missing_values(df), "placeholders": placeholders(df, row_id), "high_cardinality": high_cardinality(df, target), "grouped_entities": grouped_entities(df), "corrupted_labels": corrupted_labels(df, target),
        "identifiers": identifiers(df), "constants": constant_features(df), "duplicates": duplicates(df, ids), "imbalance": imbalance(df, target), "leakage_pearson": leakage_pearson(df, target, row_id), "leakage_separation": leakage_separation(df, target),
    }


