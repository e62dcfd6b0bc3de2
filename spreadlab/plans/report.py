"""Markdown from small results."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame

from ..config import STEP_SECONDS

MAX_ROWS = 1000
_DAY = 86400


def percent(v: float | None) -> str:
    return "n/a" if v is None else f"{100 * v:.2f} %"


def number(v: float | None) -> str:
    return "n/a" if v is None else f"{v:.3f}"


def duration(bars: float | None, interval: str) -> str:
    """A number of bars with its length in days: ``40 x 15m = 0.4 days``."""
    if bars is None:
        return "n/a"
    return f"{bars:.0f} x {interval} = {bars * STEP_SECONDS[interval] / _DAY:.1f} days"


def _cell(v, show) -> str:
    if show:
        return show(v)
    return "n/a" if v is None else f"{v:.4f}" if isinstance(v, float) else str(v)


def table(df: DataFrame, shown: dict | None = None, write: Callable[[DataFrame], object] | None = None, where: str = "") -> str:
    """Rows as a table; ``shown`` formats columns. Of more than ``MAX_ROWS`` rows the first are shown, counted, and ``write`` puts all of them ``where`` the text says."""
    shown, rows = shown or {}, df.take(MAX_ROWS + 1)
    lines = ["| " + " | ".join(df.columns) + " |", "|" + "---|" * len(df.columns)]
    lines += ["| " + " | ".join(_cell(v, shown.get(c)) for c, v in zip(df.columns, r, strict=True)) + " |" for r in rows[:MAX_ROWS]]
    if len(rows) > MAX_ROWS:
        if write:
            write(df)
        lines += ["", f"The first {MAX_ROWS} of {df.count()} rows" + (f"; all are in {where}." if write else ".")]
    return "\n".join([*lines, ""])


def markdown(df: DataFrame, title: str, shown: dict | None = None) -> str:
    return f"# {title}\n\n{table(df, shown)}"


def document(title: str, *parts: tuple[str, str]) -> str:
    """Sections (heading, text) under a title; an empty heading continues the section before."""
    return "\n".join([f"# {title}", "", *[f"## {h}\n\n{t}\n" if h else f"{t}\n" for h, t in parts]])
