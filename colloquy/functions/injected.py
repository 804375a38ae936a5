"""Turns that a program put in the user's place, and what of them is worth keeping."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from .text import trimmed

#: Fixed values of the transcript format: prompt sources of a person, and what older injected turns contain.
PERSON = ("typed", "queued")
MARKERS = ("<task-notification>", "<command-name>", "<local-command", "<system-reminder>")


def is_injected(text: Column, prompt_source: Column, is_meta: Column) -> Column:
    """A stated source decides; else the meta flag; else a marker in the text."""
    marked = F.lit(False)
    for m in MARKERS:
        marked = marked | text.contains(m)
    return F.when(prompt_source.isNotNull(), ~prompt_source.isin(*PERSON)).when(F.coalesce(is_meta, F.lit(False)), F.lit(True)).otherwise(marked)


def _inner(text: Column, tag: str) -> Column:
    found = F.regexp_extract_all(text, F.lit(f"(?s)<{tag}>(.*?)</{tag}>"), F.lit(1))
    return F.filter(F.transform(found, trimmed), lambda x: x != "")


def payload(text: Column) -> Column:
    """A notification's summaries and results; else a command and its arguments; else a local command's output; else ''."""
    body = F.regexp_replace(F.regexp_replace(text, r"(?s)^.*?<task-notification>", ""), r"(?s)</task-notification>.*$", "")
    notified = F.array_join(F.concat(_inner(body, "summary"), _inner(body, "result")), "\n\n")
    command, args, out = (F.get(_inner(text, t), F.lit(0)) for t in ("command-name", "command-args", "local-command-stdout"))
    return (
        F.when(text.contains("<task-notification>"), notified)
        .when(command.isNotNull(), F.concat_ws(" ", command, args))
        .otherwise(F.coalesce(out, F.lit("")))
    )
