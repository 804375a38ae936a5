"""Predicates of searches, as columns.

The two search paths read dates differently, and both readings are kept.  A vector search compares timestamps as text, and
a bound that is the beginning of a timestamp takes in all that begin with it.  A text search compares milliseconds.
"""

from __future__ import annotations

import re
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..schema import DEFAULT_HARNESS, LIMIT, MOST

DATE = re.compile(r"^\d{4}-\d{2}-\d{2}$")


@dataclass(frozen=True)
class SearchFilter:
    project: str | None = None
    session_id: str | None = None
    harness: str | None = None
    after: str | None = None
    before: str | None = None


@dataclass(frozen=True)
class SearchRequest:
    """A checked request; raises ValueError where a value is out of range."""

    query: str | tuple[str, ...]
    limit: int = LIMIT
    mode: str = "hybrid"
    where: SearchFilter = SearchFilter()

    def __post_init__(self):
        if isinstance(self.query, str) and len(self.query) < 2:
            raise ValueError("a query has two characters at least")
        if not isinstance(self.query, str) and (not 2 <= len(self.query) <= 5 or any(len(q) < 2 for q in self.query)):
            raise ValueError("from two to five concepts of two characters at least")
        if not 1 <= self.limit <= MOST:
            raise ValueError(f"a limit is from 1 to {MOST}")
        if self.mode not in ("hybrid", "both", "vector", "text"):
            raise ValueError("a mode is hybrid, both, vector or text")
        for bound in (self.where.after, self.where.before):
            if bound is not None and not DATE.match(bound):
                raise ValueError("dates are YYYY-MM-DD")
        if "" in (self.where.project, self.where.session_id):
            raise ValueError("a project or session has a name")
        if self.where.harness not in (None, "claude", "codex"):
            raise ValueError("a harness is claude or codex")


def harness_of(column: Column | str = "harness") -> Column:
    """Rows without a harness are of the first one."""
    return F.coalesce(F.col(column) if isinstance(column, str) else column, F.lit(DEFAULT_HARNESS))


def equal(where: SearchFilter) -> Column:
    out = F.lit(True)
    if where.project is not None:
        out = out & (F.col("project") == where.project)
    if where.session_id is not None:
        out = out & (F.col("session_id") == where.session_id)
    if where.harness is not None:
        out = out & (harness_of() == where.harness)
    return out


def lexical(where: SearchFilter) -> Column:
    """The vector path: rows without a timestamp never match a bound."""
    out, at = equal(where), F.nullif(F.col("timestamp"), F.lit(""))
    if where.after is not None:
        out = out & (at >= where.after)
    if where.before is not None:
        out = out & (F.substring(at, 1, len(where.before)) <= where.before)
    return F.coalesce(out, F.lit(False))


def epoch_ms(timestamp: Column) -> Column:
    """Milliseconds; 0 where there is no time, or one before 1970."""
    return F.greatest(F.coalesce(F.unix_millis(F.try_to_timestamp(timestamp)), F.lit(0)), F.lit(0))


def by_epoch(where: SearchFilter) -> Column:
    """The text path: a bound that is no date doesn't bind; a date is its first instant."""
    out, at = equal(where), epoch_ms(F.col("timestamp"))
    if where.after is not None:
        out = out & (at >= F.coalesce(F.unix_millis(F.try_to_timestamp(F.lit(where.after))), at))
    if where.before is not None:
        out = out & (at <= F.coalesce(F.unix_millis(F.try_to_timestamp(F.lit(where.before))), at))
    return F.coalesce(out, F.lit(False))


def searchable() -> Column:
    return ~F.coalesce(F.col("is_sidechain"), F.lit(False))


def matching_ids(exchanges: DataFrame, where: SearchFilter) -> DataFrame | None:
    """ids that a filter leaves; None where it asks nothing, which isn't the same as an empty result."""
    return None if where == SearchFilter() else exchanges.filter(lexical(where)).select("id")


def substring_scan(exchanges: DataFrame, query: str, where: SearchFilter = SearchFilter(), limit: int = LIMIT) -> DataFrame:
    """Exchanges one of whose sides contains the query in any case, newest id first; bounds are compared as plain text."""
    needle = query.lower()
    hit = F.lower("user_message").contains(needle) | F.lower("assistant_message").contains(needle)
    out = equal(where) & hit & searchable()
    if where.after is not None:
        out = out & (F.col("timestamp") >= where.after)
    if where.before is not None:
        out = out & (F.col("timestamp") <= where.before)
    return exchanges.filter(out).orderBy(F.desc("id")).limit(limit)
