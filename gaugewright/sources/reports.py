"""Markdown and plot data of small result tables."""

from __future__ import annotations

import math
from html import escape
from typing import Any

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def shown(value: Any) -> str:
    """A cell: six significant digits for numbers with a fraction, a dash for none."""
    if value is None:
        return "-"
    return f"{value:.6g}" if isinstance(value, float) else str(value)


def markdown_table(df: DataFrame, order: list[str], most: int = 1000) -> str:
    """A result table as Markdown, in order; of more than ``most`` rows it says so."""
    rows = df.orderBy(*order).limit(most + 1).collect()
    lines = ["| " + " | ".join(df.columns) + " |", "|" + "---|" * len(df.columns)]
    lines += ["| " + " | ".join(shown(v) for v in r) + " |" for r in rows[:most]]
    return "\n".join([*lines, *(["(more rows follow)"] if len(rows) > most else [])]) + "\n"


def report(title: str, sections: dict[str, tuple[DataFrame, list[str]]]) -> str:
    """A Markdown report with a table a section."""
    return f"# {title}\n\n" + "\n".join(f"## {name}\n\n{markdown_table(df, order)}" for name, (df, order) in sections.items())


def svg_bars(df: DataFrame, label: str, value: str, title: str, most: int = 50) -> str:
    """A bar chart of the ``most`` greatest values as an SVG text, on a logarithmic scale where values span a factor of 100."""
    rows = bars(df, label, value).where(F.col(value).isNotNull()).limit(most).collect()
    log = bool(rows and rows[0]["log_scale"] and min(r[value] for r in rows) > 0)
    size = lambda v: math.log10(v / min(r[value] for r in rows)) + 1 if log else max(v, 0.0)
    longest = max((size(float(r[value])) for r in rows), default=0.0) or 1.0
    lines = [f'<text x="10" y="18" font-size="14">{escape(title)}{" (logarithmic)" if log else ""}</text>']
    for i, r in enumerate(rows):
        y, width = 30 + 22 * i, 360 * size(float(r[value])) / longest
        lines += [f'<text x="150" y="{y + 13}" text-anchor="end" font-size="11">{escape(str(r[label]))}</text>', f'<rect x="156" y="{y}" width="{width:.1f}" height="16" fill="#4c78a8"/>', f'<text x="{162 + width:.1f}" y="{y + 13}" font-size="11">{escape(shown(float(r[value])))}</text>']
    return f'<svg xmlns="http://www.w3.org/2000/svg" width="600" height="{40 + 22 * len(rows)}">\n' + "\n".join(lines) + "\n</svg>\n"


def bars(df: DataFrame, label: str, value: str) -> DataFrame:
    """Data of a bar chart: labels and values from the greatest, and whether a logarithmic scale suits (values over a factor of 100)."""
    spread = df.agg((F.max(value) / F.nullif(F.min(value), F.lit(0)) > 100).alias("log_scale"))
    return df.select(label, value).crossJoin(F.broadcast(spread)).orderBy(F.desc(value), label)
