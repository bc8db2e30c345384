"""Column builders: ranks, guarded statistics, numeric parsing, tails of distributions."""

from __future__ import annotations

import math

from pyspark.sql import Column, Window
from pyspark.sql import functions as F

#: A decimal number in full, so that neither hexadecimal nor type suffixes pass.
NUMERIC = r"^\s*[+-]?([0-9]+\.?[0-9]*|\.[0-9]+)([eE][+-]?[0-9]+)?\s*$"


def avg_rank(value: str, keys: list[str], *, descending: bool = True) -> Column:
    """Rank of a value among those of its keys, equal values sharing the mean of their ranks; null values have none."""
    order = F.col(value).desc_nulls_last() if descending else F.col(value).asc_nulls_last()
    tied = F.count(F.lit(1)).over(Window.partitionBy(*keys, value))
    return F.when(F.col(value).isNotNull(), F.rank().over(Window.partitionBy(*keys).orderBy(order)) + (tied - 1) / F.lit(2.0).cast("double"))


def safe_corr(x: str, y: str) -> Column:
    """Pearson correlation of the complete pairs; null where either is constant or fewer than two are."""
    both = F.col(x).isNotNull() & F.col(y).isNotNull()
    a, b = (F.when(both, F.col(c)) for c in (x, y))
    return F.when((F.min(a) < F.max(a)) & (F.min(b) < F.max(b)), F.covar_pop(a, b) / F.nullif(F.stddev_pop(a) * F.stddev_pop(b), F.lit(0.0)))


def number(text: Column) -> Column:
    """The double that a text spells in full, else null."""
    return F.when(text.rlike(NUMERIC), F.trim(text).try_cast("double"))


def clip(value: Column) -> Column:
    """A value held between 0 and 1."""
    return F.least(F.greatest(value, F.lit(0.0)), F.lit(1.0))


def ratio(top: Column, bottom: Column, otherwise: float | None = 0.0) -> Column:
    """top / bottom, or ``otherwise`` where bottom is 0."""
    return F.when(bottom != 0, top.cast("double") / bottom).otherwise(F.lit(otherwise).cast("double"))


def t_two_sided(t: Column, df: Column) -> Column:
    """Two-sided p-value of Student's t for whole degrees of freedom, by its finite trigonometric series; infinite t gives 0."""
    theta = F.atan(F.abs(t) / F.sqrt(df.cast("double")))
    cos2, sine = F.cos(theta) * F.cos(theta), F.sin(theta)

    def series(terms: Column, factor) -> Column:
        start = F.struct(F.lit(1.0).alias("term"), F.lit(1.0).alias("sum"))
        grow = lambda acc, j: F.struct((acc["term"] * factor(j) * cos2).alias("term"), (acc["sum"] + acc["term"] * factor(j) * cos2).alias("sum"))
        return F.when(terms >= 1, F.aggregate(F.sequence(F.lit(1), F.greatest(terms, F.lit(1))), start, grow, lambda acc: acc["sum"])).otherwise(F.lit(1.0))

    even = sine * series((df / 2 - 1).cast("int"), lambda j: (2 * j - 1) / (2.0 * j))
    odd = (theta + F.when(df > 1, sine * F.cos(theta) * series(((df - 3) / 2).cast("int"), lambda j: 2.0 * j / (2 * j + 1))).otherwise(0.0)) * (2 / math.pi)
    return F.when(F.abs(t) == float("inf"), 0.0).otherwise(F.greatest(F.lit(0.0), 1 - F.when(df % 2 == 0, even).otherwise(odd)))


def chi2_tail(x: Column, df: Column) -> Column:
    """Upper tail of the chi-square distribution for even degrees of freedom, in closed form; use distributions.chi2_sf for odd ones."""
    start = F.struct(F.lit(1.0).alias("term"), F.lit(1.0).alias("sum"))
    grow = lambda acc, j: F.struct((acc["term"] * x / (2.0 * j)).alias("term"), (acc["sum"] + acc["term"] * x / (2.0 * j)).alias("sum"))
    terms = (df / 2 - 1).cast("int")
    return F.exp(-x / 2) * F.when(terms >= 1, F.aggregate(F.sequence(F.lit(1), F.greatest(terms, F.lit(1))), start, grow, lambda acc: acc["sum"])).otherwise(F.lit(1.0))
