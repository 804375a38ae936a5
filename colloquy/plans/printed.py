"""Results as people read them.  The rows are a page of at most 50, so this is done on the driver."""

from __future__ import annotations

import math
from collections.abc import Callable, Iterable

from ..schema import OTHER_HARNESS


def percent(x: float) -> int:
    """Rounded, halves upwards."""
    return math.floor(x * 100 + 0.5)


def _block(n: int, head: str, r: dict, summary: Callable[[dict], str | None], path: Callable[[dict], str], more: str = "") -> str:
    short = summary(r)
    line = f"   Summary: {short}\n" if short else ""
    return f'{n}. {head}\n{more}{line}   "{r["snippet"]}"\n   Lines {r["line_start"]}-{r["line_end"]} in {path(r)}\n'


def results(rows: Iterable[dict], summary=lambda r: None, path=lambda r: r["archive_path"]) -> str:
    out = []
    for n, r in enumerate(rows, 1):
        match = f" - {percent(r['similarity'])}% match" if r.get("similarity") is not None else ""
        other = f", {OTHER_HARNESS}" if r.get("harness") == OTHER_HARNESS else ""
        out.append(_block(n, f"[{r['project']}, {r['timestamp'][:10]}{other}]{match}", r, summary, path))
    return "\n".join(out) or "No results found."


def concept_results(rows: Iterable[dict], concepts: list[str], summary=lambda r: None, path=lambda r: r["archive_path"]) -> str:
    out = []
    for n, r in enumerate(rows, 1):
        each = ", ".join(f"{c}: {percent(s)}%" for c, s in zip(concepts, r["similarities"], strict=True))
        out.append(_block(n, f"[{r['project']}, {r['timestamp'][:10]}] - {percent(r['average'])}% avg match", r, summary, path, f"   Concepts: {each}\n"))
    return "\n".join(out) or f"No conversations found matching all concepts: {', '.join(concepts)}"
