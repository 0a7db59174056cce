"""Small result tables as Markdown. A report is for people: it refuses tables beyond MOST_ROWS."""

from __future__ import annotations

import math

from pyspark.sql import DataFrame

MOST_ROWS = 5_000


def cell(value, percent: bool = False) -> str:
    """A value as a report shows it: missing as a dash, shares as percentages, numbers with separators."""
    if value is None or isinstance(value, float) and math.isnan(value):
        return "–"
    if percent:
        return f"{100 * value:.1f}"
    if isinstance(value, bool):
        return "yes" if value else "no"
    if isinstance(value, int):
        return f"{value:,}"
    if isinstance(value, float):
        return f"{value:.4g}"
    return str(value).replace("|", "\\|").replace("\n", " ")


def markdown(df: DataFrame, percent: tuple[str, ...] = (), title: str | None = None) -> str:
    rows = df.limit(MOST_ROWS + 1).collect()
    if len(rows) > MOST_ROWS:
        raise ValueError("a report shows a small table; aggregate it first")
    lines = [f"## {title}", ""] if title else []
    lines += ["| " + " | ".join(df.columns) + " |", "|" + "---|" * len(df.columns)]
    lines += ["| " + " | ".join(cell(r[c], c in percent) for c in df.columns) + " |" for r in rows]
    return "\n".join(lines) + "\n"
