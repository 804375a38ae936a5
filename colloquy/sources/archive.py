"""Copies of transcripts and summary files beside them.

Both are whole files that people open: <root>/<harness>/<project>/<name>.gz and <name>-summary.txt.
"""

from __future__ import annotations

import os
from collections.abc import Callable, Iterable
from dataclasses import dataclass

from pyspark.sql import Column
from pyspark.sql import functions as F

from ..schema import ERROR_PREFIX, SUMMARY_SHOWN
from .transcripts import write_gzip


def archive_path(root: str, harness: str, project: str, source: str) -> str:
    name = os.path.basename(source)
    return f"{root}/{harness}/{project}/{name if name.endswith('.gz') else name + '.gz'}"


def archive_path_column(root: str, harness: Column, project: Column, source: Column) -> Column:
    name = F.element_at(F.split(source, "/"), -1)
    return F.concat_ws("/", F.lit(root), harness, project, F.when(name.endswith(".gz"), name).otherwise(F.concat(name, F.lit(".gz"))))


def summary_path(archived: str) -> str:
    base = archived.removesuffix(".gz").removesuffix(".jsonl")
    return f"{base}-summary.txt"


def summary_path_column(archived: Column) -> Column:
    return F.concat(F.regexp_replace(F.regexp_replace(archived, r"\.gz$", ""), r"\.jsonl$", ""), F.lit("-summary.txt"))


def resolve(root: str, stored: str, harness: str, project: str) -> str:
    """The stored path if there is a file, else its copy if there is one, else the stored path."""
    copy = archive_path(root, harness, project, stored)
    return stored if os.path.exists(stored) or not os.path.exists(copy) else copy


def copy_if_changed(source: str, target: str) -> bool:
    """Copies a transcript unless there is a copy of the same modification time (to a millisecond)."""
    if os.path.exists(target) and abs(os.stat(source).st_mtime_ns - os.stat(target).st_mtime_ns) < 1_000_000:
        return False
    write_gzip(source, target)
    return True


@dataclass(frozen=True)
class SummaryState:
    kind: str  # "missing", "empty", "error" or "valid"
    text: str = ""


def state_of(raw: str | None) -> SummaryState:
    if raw is None:
        return SummaryState("missing")
    text = raw.strip()
    if not text:
        return SummaryState("empty")
    if text.startswith(ERROR_PREFIX):
        return SummaryState("error", text[len(ERROR_PREFIX) :].strip())
    return SummaryState("valid", text)


def kind_column(raw: Column) -> Column:
    """The kind of state that a summary file's text says."""
    text = F.trim(F.regexp_replace(raw, r"^\s+|\s+$", ""))
    return F.when(text == "", "empty").when(text.startswith(ERROR_PREFIX), "error").otherwise("valid")


def read_summary(path: str) -> SummaryState:
    try:
        with open(path, encoding="utf-8") as f:
            return state_of(f.read())
    except OSError:
        return state_of(None)


def write_summary(path: str, text: str) -> None:
    os.makedirs(os.path.dirname(path), exist_ok=True)
    with open(path, "w", encoding="utf-8") as f:
        f.write(text.strip() + "\n" if text.strip() else "")


def write_error(path: str, error: object) -> None:
    os.makedirs(os.path.dirname(path), exist_ok=True)
    with open(path, "w", encoding="utf-8") as f:
        f.write(f"{ERROR_PREFIX} {str(error).splitlines()[0] if str(error) else ''}\n")


def shown(state: SummaryState) -> str | None:
    return state.text if state.kind == "valid" and len(state.text) < SUMMARY_SHOWN else None


def summarise(candidates: Iterable[dict], transcript: Callable[[dict], str], writers: dict[str, Callable[[str], str]]) -> tuple[int, int]:
    """Asks each candidate's writer (by harness) for a summary and stores it; returns (written, failed).

    A conversation without text gets the empty mark, which counts as written; an error is kept and tried again later.
    """
    done = failed = 0
    for c in candidates:
        path = summary_path(c["archive_path"])
        try:
            text = transcript(c)
            write_summary(path, writers[c["harness"]](text) if text else "")
            done += 1
        except Exception as e:  # noqa: BLE001 - any failure of a writer is recorded beside the transcript
            write_error(path, e)
            failed += 1
    return done, failed
