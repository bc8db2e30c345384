"""Cleaning of raw tables."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from gaugewright.functions.columns import NUMERIC
from gaugewright.operators.profile import identifiers, text_columns

#: The corrupted class label, cells that mean nothing, and patterns of such (the last is open at its end).
CORRUPTED = "!@9#%8"
BLANKS = ["_______", "---", "#F%$D@*&8", "_", "nan", "NAN", "NaN"]
BLANK_PATTERNS = [r"^__.*__$", r"^\*\*.*__$", r"^\*\*.*\*\*"]
FINANCIAL_IDS = ["ID", "Customer_ID", "Name", "SSN"]


def without_corrupted(df: DataFrame, target: str, *, keep_missing: bool = False) -> DataFrame:
    """Rows whose target isn't the corrupted label, and, unless they are kept, has a value."""
    kept = df.where(F.coalesce(F.col(target).cast("string"), F.lit("nan")) != CORRUPTED)
    return kept if keep_missing else kept.where(F.col(target).isNotNull())


def blanked(value: Column) -> Column:
    """A text, null if it is a placeholder."""
    odd = value.isin(BLANKS)
    for pattern in BLANK_PATTERNS:
        odd = odd | value.rlike(pattern)
    return F.when(~odd, value)


def blank_placeholders(df: DataFrame) -> DataFrame:
    return df.withColumns({c: blanked(F.col(c)) for c in text_columns(df)})


def coerce_numbers(df: DataFrame, except_for: list[str] = []) -> DataFrame:  # noqa: B006
    """Text columns whose values are all numbers, but for underscores at the end, as doubles; other columns stay as they are.

    One aggregate looks at all columns. A column without values becomes a double of nulls.
    """
    columns = [c for c in text_columns(df) if c not in except_for]
    if not columns:
        return df
    text = {c: F.regexp_replace(F.col(c), "_+$", "") for c in columns}
    missing = {c: text[c].isin("nan", "None", "NaN") for c in columns}
    odd = df.agg(*[F.count_if(F.col(c).isNotNull() & ~missing[c] & ~text[c].rlike(NUMERIC)).alias(c) for c in columns]).first()
    return df.withColumns({c: F.when(~missing[c], F.trim(text[c]).try_cast("double")) for c in columns if not odd[c]})


def keep_first(df: DataFrame, order: str, columns: list[str] | None = None) -> DataFrame:
    """Of rows equal in ``columns`` (all but order) the first by ``order``."""
    columns = [c for c in df.columns if c != order] if columns is None else columns
    first = F.row_number().over(Window.partitionBy(*columns).orderBy(order))
    return df.withColumn("nth_", first).where("nth_ = 1").drop("nth_")


def sanitize(df: DataFrame, target: str, *, drop_ids: bool = True, drop_duplicates: bool = True, clean_placeholders: bool = True, clean_targets: bool = True) -> DataFrame:
    """Without corrupted or missing targets, identifier columns (found on what is left), placeholders and equal rows, numbers as numbers; the target stays of its type."""
    if clean_targets:
        df = without_corrupted(df, target)
    if drop_ids:
        df = df.drop(*[r["column"] for r in identifiers(df).collect() if r["column"] != target])  # a row for each column at most
    if clean_placeholders:
        df = coerce_numbers(blank_placeholders(df), [target])
    return df.dropDuplicates() if drop_duplicates else df


def remediate_financial(df: DataFrame, target: str = "Payment_Behaviour") -> tuple[DataFrame, DataFrame]:
    """The cleaned credit table, and a row of before and after counts."""
    kept = without_corrupted(df, target, keep_missing=True)
    done = coerce_numbers(blank_placeholders(kept.drop(*FINANCIAL_IDS)), [target])
    counts = df.agg(F.count(F.lit(1)).alias("before_rows"), F.count_if(F.coalesce(F.col(target).cast("string"), F.lit("nan")) == CORRUPTED).alias("dropped_rows"))
    return done, counts.withColumns({"after_rows": F.col("before_rows") - F.col("dropped_rows"), "before_columns": F.lit(len(df.columns)), "after_columns": F.lit(len(done.columns))})


def remediate_heart(df: DataFrame, target: str = "target") -> tuple[DataFrame, DataFrame]:
    """Different rows only, and a row of duplicate figures."""
    done = df.dropDuplicates()
    counts = df.agg(F.count(F.lit(1)).alias("before_rows")).crossJoin(F.broadcast(done.agg(F.count(F.lit(1)).alias("after_rows"))))
    return done, counts.withColumn("duplicate_pct", 100.0 * (F.col("before_rows") - F.col("after_rows")) / F.col("before_rows"))
