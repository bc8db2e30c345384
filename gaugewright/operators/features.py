"""Feature preparation, fitted on training rows: imputation, scaling, encoding. A fitted step is a function of frames."""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass, field

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from gaugewright.operators.order import quantiles
from gaugewright.operators.profile import numeric_columns, text_columns

Step = Callable[[DataFrame], DataFrame]


def impute_numeric(train: DataFrame, columns: list[str], strategy: str = "mean", fill: float = 0.0) -> Step:
    """Missing numbers by the mean, the exact median or a constant."""
    if strategy == "constant":
        values = dict.fromkeys(columns, fill)
    elif strategy == "median":
        values = {c: q[0] for c, q in quantiles(train, columns, [0.5]).items() if q}
    elif strategy == "mean":
        row = train.agg(*[F.avg(c).alias(c) for c in columns]).first()
        values = {c: row[c] for c in columns if row[c] is not None}
    else:
        raise ValueError(f"strategy {strategy!r}")
    return lambda df: df.withColumns({c: F.coalesce(F.col(c).cast("double"), F.lit(float(v))) for c, v in values.items()})


def most_frequent(train: DataFrame, columns: list[str]) -> DataFrame:
    """(column, value, n) of each text column's most frequent value, the smallest of several."""
    cells = train.select(F.explode(F.array(*[F.struct(F.lit(c).alias("column"), F.col(c).alias("value")) for c in columns])).alias("e")).select("e.*").where("value is not null")
    return cells.groupBy("column", "value").agg(F.count(F.lit(1)).alias("n")).groupBy("column").agg(F.min_by(F.struct("value", "n"), F.struct(-F.col("n"), "value")).alias("v")).select("column", "v.value", "v.n")


def impute_text(train: DataFrame, columns: list[str], strategy: str = "most_frequent", fill: str = "missing") -> Step:
    """Missing texts by the most frequent one or a constant."""
    values = dict.fromkeys(columns, fill) if strategy == "constant" else {r["column"]: r["value"] for r in most_frequent(train, columns).collect()}  # a row a column
    return lambda df: df.na.fill(values)


def scaling(train: DataFrame, columns: list[str], kind: str = "standard") -> dict[str, tuple[float, float]]:
    """(centre, scale) of each column: mean and population std, least and range, or median and interquartile range; a scale of 0 is 1."""
    if kind == "robust":
        return {c: (q[1], (q[2] - q[0]) or 1.0) if q else (0.0, 1.0) for c, q in quantiles(train, columns, [0.25, 0.5, 0.75]).items()}
    makes = {
        "standard": lambda c: (F.avg(c), F.stddev_pop(c)),
        "minmax": lambda c: (F.min(c).cast("double"), (F.max(c) - F.min(c)).cast("double")),
    }
    make = makes[kind]
    row = train.agg(*[x.alias(f"{c}|{i}") for c in columns for i, x in enumerate(make(c))]).first()
    return {c: (float(row[f"{c}|0"] or 0.0), float(row[f"{c}|1"] or 0.0) or 1.0) for c in columns}


def scale(train: DataFrame, columns: list[str], kind: str = "standard") -> Step:
    fitted = scaling(train, columns, kind)
    return lambda df: df.withColumns({c: (F.col(c) - F.lit(m)) / F.lit(s) for c, (m, s) in fitted.items()})


def categories(train: DataFrame, columns: list[str]) -> dict[str, list[str]]:
    """Sorted values of each column; columns to encode have values enough for the driver, as each becomes a feature or a code."""
    row = train.agg(*[F.array_sort(F.collect_set(c)).alias(c) for c in columns]).first()
    return {c: row[c] for c in columns}


def onehot(train: DataFrame, columns: list[str]) -> Step:
    """A 0/1 column for each value, but the second alone where there are two; values that training didn't have give zeros."""
    fitted = categories(train, columns)
    new = {f"{c}={v}": (F.col(c).eqNullSafe(F.lit(v))).cast("double") for c, vs in fitted.items() for v in (vs[1:] if len(vs) == 2 else vs)}
    return lambda df: df.withColumns(new).drop(*columns)


def ordinal(train: DataFrame, columns: list[str]) -> Step:
    """A value's place in sorted order, -1 for one that training didn't have."""
    fitted = categories(train, columns)
    return lambda df: df.withColumns({c: (F.coalesce(F.array_position(F.array(*map(F.lit, vs)), F.col(c)), F.lit(0)) - 1).cast("double") if vs else F.lit(-1.0) for c, vs in fitted.items()})


@dataclass
class Preparation:
    """Imputes and scales numbers, imputes and encodes texts; columns of other kinds are dropped, ``keep`` passes through."""

    numeric: list[str] | None = None
    textual: list[str] | None = None
    keep: list[str] = field(default_factory=list)
    scaling: str | None = "standard"
    encoding: str = "onehot"
    numeric_fill: str = "mean"
    text_fill: str = "most_frequent"
    steps: list[Step] | None = None

    def fit(self, train: DataFrame) -> Preparation:
        numeric = [c for c in numeric_columns(train) if c not in self.keep] if self.numeric is None else self.numeric
        textual = [c for c in text_columns(train) if c not in self.keep] if self.textual is None else self.textual
        columns = [*self.keep, *numeric, *textual]
        self.steps = [lambda df: df.select(*columns)]
        if numeric:
            self._add(train, lambda t: impute_numeric(t, numeric, self.numeric_fill))
            if self.scaling:
                self._add(train, lambda t: scale(t, numeric, self.scaling))
        if textual:
            self._add(train, lambda t: impute_text(t, textual, self.text_fill))
            self._add(train, lambda t: (onehot if self.encoding == "onehot" else ordinal)(t, textual))
        return self

    def _add(self, train: DataFrame, make: Callable[[DataFrame], Step]) -> None:
        self.steps.append(make(self.transform(train)))

    def transform(self, df: DataFrame) -> DataFrame:
        if self.steps is None:
            raise RuntimeError("fit before transform")
        for step in self.steps:
            df = step(df)
        return df

    def fit_transform(self, train: DataFrame) -> DataFrame:
        return self.fit(train).transform(train)

    def feature_names(self, df: DataFrame) -> list[str]:
        return [c for c in self.transform(df).columns if c not in self.keep]
