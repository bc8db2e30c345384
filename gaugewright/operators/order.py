"""Places in sorted order, sums over smaller values and exact quantiles, by counts of ranges: no task has a whole class or column.

Keys may be null; equal values share a row of counts. Column names that end in two underscores are used inside.
"""

from __future__ import annotations

from math import floor

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def _key(*columns: str | Column) -> Column:
    """One value for several, equal where each is equal or both are null; rows are grouped, joined and sorted by it with one shuffle."""
    return F.struct(*columns) if columns else F.lit(0)


def placed(df: DataFrame, by: list[str], order: Column, key: str) -> DataFrame:
    """df with place__, from 1, of each row among those of ``by``, sorted by (order, key), and their number n__.

    order is a hexadecimal hash. Rows are sorted within the 4096 ranges of its first three digits; a range begins
    where the counts of those before it end, so a class is as many tasks as it has ranges.
    """
    ranged = df.withColumn("order__", order).withColumn("cell__", _key(*by, F.substring("order__", 1, 3).alias("range__")))
    of = Window.partitionBy(*[f"cell__.{c}" for c in by])  # of the ranges' counts, 4096 a class
    counts = ranged.groupBy("cell__").agg(F.count(F.lit(1)).alias("here__"))
    starts = counts.select("cell__", (F.sum("here__").over(of.orderBy("cell__.range__")) - F.col("here__")).alias("before__"), F.sum("here__").over(of).alias("n__"))
    numbered = ranged.withColumn("place__", F.row_number().over(Window.partitionBy("cell__").orderBy("order__", key)))
    return numbered.join(starts, "cell__").withColumn("place__", F.col("place__") + F.col("before__")).drop("cell__", "order__", "before__")


def running(counts: DataFrame, keys: list[str], value: str, amount: str, *, ranges: int = 256, whole: int = 1_000_000) -> DataFrame:
    """counts (keys, value, amount: a row for each value) with below__, the sum of the amounts of smaller values, and all__, that of all.

    Keys with more than ``whole`` values are cut at approximate quantiles into ranges of about as many each. Sums
    within a range start from the exact sums of those before it, so cuts move work between tasks and change no
    result. What is broadcast is 2 KB for each key that is cut, so at most that for ``whole`` rows of counts.
    """
    keyed = counts.withColumn("key__", _key(*keys))
    cuts = keyed.groupBy("key__").agg(F.count(F.lit(1)).alias("n__"), F.percentile_approx(value, [i / ranges for i in range(1, ranges)], 10 * ranges).alias("cuts__")).where(F.col("n__") > whole).drop("n__")
    smaller = F.when(F.col("cuts__").isNull(), 0).otherwise(F.size(F.filter("cuts__", lambda c: c < F.col(value))))
    ranged = keyed.join(F.broadcast(cuts), "key__", "left").withColumn("cell__", F.struct("key__", smaller.alias("range__"))).drop("cuts__", "key__")
    of = Window.partitionBy("cell__.key__")  # of the ranges' sums, at most ``ranges`` a key
    starts = ranged.groupBy("cell__").agg(F.sum(amount).alias("here__")).select("cell__", (F.sum("here__").over(of.orderBy("cell__.range__")) - F.col("here__")).alias("before__"), F.sum("here__").over(of).alias("all__"))
    summed = ranged.withColumn("below__", F.sum(amount).over(Window.partitionBy("cell__").orderBy(value)) - F.col(amount))
    return summed.join(starts, "cell__").withColumn("below__", F.col("below__") + F.col("before__")).drop("cell__", "before__")


def quantiles(df: DataFrame, columns: list[str], shares: list[float]) -> dict[str, list[float] | None]:
    """Exact quantiles of each column, interpolated between neighbours; None for a column without values."""
    cells = df.select(F.explode(F.array(*[F.struct(F.lit(c).alias("column"), F.col(c).cast("double").alias("value")) for c in columns])).alias("e")).select("e.*").where("value is not null")
    found = running(cells.groupBy("column", "value").agg(F.count(F.lit(1)).alias("n")), ["column"], "value", "n")

    def at(share: float, up: bool) -> Column:
        position = F.lit(share) * (F.col("all__") - 1)
        place = F.ceil(position) if up else F.floor(position)
        return F.max(F.when((F.col("below__") <= place) & (place < F.col("below__") + F.col("n")), F.col("value")))

    ends = [at(s, up).alias(f"{i}{'u' if up else 'l'}") for i, s in enumerate(shares) for up in (False, True)]
    rows = {r["column"]: r for r in found.groupBy("column").agg(F.max("all__").alias("n"), *ends).collect()}  # a row a column

    def between(row, i: int) -> float:
        low, high, position = row[f"{i}l"], row[f"{i}u"], shares[i] * (row["n"] - 1)
        return low if low == high else low + (high - low) * (position - floor(position))

    return {c: [between(rows[c], i) for i in range(len(shares))] if c in rows else None for c in columns}
