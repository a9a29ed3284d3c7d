"""Small results as text: JSON lines, Markdown tables, and timing summaries."""

from __future__ import annotations

import math

from pyspark.sql import DataFrame


def json_lines(df: DataFrame) -> DataFrame:
    """One JSON document per row, in a column ``value``, still distributed."""
    from pyspark.sql import functions as F

    return df.select(F.to_json(F.struct(*[F.col(f"`{c}`") for c in df.columns])).alias("value"))


def markdown(df: DataFrame, most: int = 200) -> str:
    """A Markdown table of a result that is small; raises if it has over ``most`` rows."""
    rows = df.limit(most + 1).collect()
    if len(rows) > most:
        raise ValueError(f"more than {most} rows; write a table instead")
    show = lambda v: "" if v is None else f"{v:.4g}" if isinstance(v, float) else str(v).replace("|", "\\|")
    lines = ["| " + " | ".join(df.columns) + " |", "|" + "---|" * len(df.columns)]
    return "\n".join(lines + ["| " + " | ".join(map(show, r)) + " |" for r in rows])


def latencies(seconds: list[float]) -> dict[str, float]:
    """Least, median, nearest-rank 95th percentile and greatest."""
    s = sorted(seconds)
    n = len(s)
    return {"min": s[0], "median": (s[(n - 1) // 2] + s[n // 2]) / 2, "p95": s[max(1, math.ceil(0.95 * n)) - 1], "max": s[-1]}
