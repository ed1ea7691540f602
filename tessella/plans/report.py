"""Markdown reports from collected metric tables."""

from __future__ import annotations

import textwrap

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

Element = tuple


def number(value: object, digits: int = 2) -> str:
    """A number with grouped thousands; other values as they are, null as a dash."""
    if value is None:
        return "-"
    if isinstance(value, bool) or not isinstance(value, int | float):
        return str(value)
    return f"{value:,}" if isinstance(value, int) else f"{value:,.{digits}f}"


def percent(value: float | None, digits: int = 2) -> str:
    """A percentage, unknown as a dash."""
    return "-" if value is None else f"{value:.{digits}f} %"


def shortened(text: str | None, length: int = 60) -> str:
    """A text on one line of at most ``length`` characters, with an ellipsis where it was cut."""
    line = " ".join((text or "").split())
    return line if len(line) <= length else line[: length - 1].rstrip() + "…"


def wrapped(text: str, width: int = 80) -> str:
    """A text in lines of at most ``width`` characters, cut between words."""
    return "\n".join(textwrap.wrap(text, width))


def table_of(df: DataFrame, title: str, rows: int = 20) -> Element:
    """A table element of the first rows of a small, ordered result."""
    return "table", title, df.columns, [[number(x) for x in r] for r in df.limit(rows).collect()]


def inventory(frames: dict[str, DataFrame]) -> DataFrame:
    """``name, columns, n_rows`` of named tables."""
    parts = [df.agg(F.count("*").alias("n_rows")).select(F.lit(n).alias("name"), F.lit(len(df.columns)).alias("columns"), "n_rows") for n, df in frames.items()]
    out = parts[0]
    for p in parts[1:]:
        out = out.unionByName(p)
    return out


def render(elements: list[Element]) -> str:
    """Markdown of a list of headings, paragraphs, bullets, tables, callouts and page breaks."""
    out = []
    for kind, *rest in elements:
        if kind in ("h1", "h2", "h3"):
            out.append("#" * int(kind[1]) + " " + rest[0])
        elif kind == "p":
            out.append(rest[0])
        elif kind == "bullets":
            out.append("\n".join(f"- {x}" for x in rest[0]))
        elif kind == "callout":
            out.append(f"> {rest[0]}")
        elif kind == "table":
            title, columns, rows = rest
            cell = lambda x: str(x).replace("|", "\\|").replace("\n", " ")
            lines = [columns, ["---"] * len(columns), *rows]
            out.append(f"**{title}**\n\n" + "\n".join("| " + " | ".join(map(cell, r)) + " |" for r in lines))
        elif kind == "pagebreak":
            out.append("---")
        else:
            raise ValueError(f"unknown element {kind!r}")
    return "\n\n".join(out) + "\n"
