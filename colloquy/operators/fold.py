"""Lines of transcripts folded into exchanges of one user turn and the answers after it.

A user line opens an exchange and all assistant lines up to the next user line belong to it; answers before the first user
line and exchanges without an answer go.  A running count of user lines over a file is the exchange's number; the rest
is one aggregation.  Files are independent, so both are partitioned by path.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.injected import is_injected, payload
from ..functions.text import is_blank
from ..sources.transcripts import basename, get, parsed, project_of_path, text_at

BLOCKS = "array<struct<type:string,text:string>>"


def fold(turns: DataFrame, key: str, order: str, carried: dict[str, str] | None = None) -> DataFrame:
    """One row for each answered user turn: key, line_start, line_end, user_text, answers, and what the turns carry.

    ``turns``: key, order, role, text.  ``carried`` names columns and whose value stands: "user" (the user line's), or
    "last" (the last that isn't null, user or answer).
    """
    turn = F.sum((F.col("role") == "user").cast("long")).over(Window.partitionBy(key).orderBy(order).rowsBetween(Window.unboundedPreceding, 0))
    user, answer = F.col("role") == "user", F.col("role") == "assistant"
    extra = []
    for column, whose in (carried or {}).items():
        known = F.col(column).isNotNull()
        extra.append((F.max_by(column, F.when(known, F.col(order))) if whose == "last" else F.min_by(column, F.when(user, F.col(order)))).alias(column))
    return (
        turns.withColumn("_turn", turn)
        .filter("_turn > 0")
        .groupBy(key, "_turn")
        .agg(
            F.min(F.when(user, F.col(order))).alias("line_start"),
            F.max(F.when(answer, F.col(order))).alias("line_end"),
            F.max(F.when(user, F.col("text"))).alias("user_text"),
            F.array_sort(F.collect_list(F.when(answer, F.struct(F.col(order).alias("at"), F.col("text"))))).alias("_answers"),
            *extra,
        )
        .filter("line_end is not null")
        .withColumn("answers", F.transform("_answers", lambda a: a["text"]))
        .drop("_turn", "_answers")
    )


def content_text(path: str, typed: bool) -> Column:
    """A message's text: a string as it is; of a list the texts of its blocks (only of type text, if ``typed``), by lines."""
    blocks = F.filter(get(path, BLOCKS), lambda b: b["text"].isNotNull() & (((b["type"] == "text") & (b["text"] != "")) if typed else F.lit(True)))
    return F.coalesce(text_at(path), F.array_join(F.transform(blocks, lambda b: b["text"]), "\n"))


def _exchanges(folded: DataFrame, harness: str, now: str) -> DataFrame:
    human = is_injected(F.col("user_text"), F.col("prompt_source"), F.col("is_meta"))
    return folded.select(
        F.lit(harness).alias("harness"),
        "project",
        "session_id",
        "git_branch",
        F.coalesce("timestamp", F.lit(now)).alias("timestamp"),
        F.when(human, payload(F.col("user_text"))).otherwise(F.col("user_text")).alias("user_message"),
        F.array_join("answers", "\n\n").alias("assistant_message"),
        F.col("path").alias("archive_path"),
        "line_start",
        "line_end",
        F.lit(1).alias("embedding_version"),
        F.coalesce("is_sidechain", F.lit(False)).alias("is_sidechain"),
        human.alias("user_is_injected"),
    )


def fold_a(lines: DataFrame, now: str) -> DataFrame:
    """Exchanges of the first format; ``now`` stands for a timestamp that no line has."""
    text = content_text("message.content", typed=True)
    turns = (
        parsed(lines)
        .select(
            "path",
            "line_no",
            text_at("type").alias("role"),
            text.alias("text"),
            text_at("timestamp").alias("timestamp"),
            text_at("sessionId").alias("session_id"),
            text_at("gitBranch").alias("git_branch"),
            text_at("promptSource").alias("prompt_source"),
            get("isMeta", "boolean").alias("is_meta"),
            get("isSidechain", "boolean").alias("is_sidechain"),
            F.coalesce(get("isCompactSummary", "boolean"), F.lit(False)).alias("recap"),
        )
        .filter("role in ('user', 'assistant') and not recap")
        .filter(~is_blank(F.col("text")))
    )
    carried = {"timestamp": "last"} | {c: "user" for c in ("session_id", "git_branch", "prompt_source", "is_meta", "is_sidechain")}
    return _exchanges(fold(turns, "path", "line_no", carried).withColumn("project", project_of_path(F.col("path"))), "claude", now)


def fold_b(lines: DataFrame, now: str) -> DataFrame:
    """Exchanges of the second format.

    Project, session and branch are those known just before the next user line, so a change of folder after an answer
    still counts for that exchange.  An answer without a timestamp makes the exchange one of ``now``.
    """
    kind, role = text_at("type"), text_at("payload.role")
    text = content_text("payload.content", typed=False)
    message = (kind == "response_item") & (text_at("payload.type") == "message") & role.isin("user", "assistant") & ~is_blank(text)
    context = kind.isin("session_meta", "turn_context")
    meta = kind == "session_meta"
    rows = parsed(lines).select(
        "path",
        "line_no",
        F.when(F.coalesce(message, F.lit(False)), role).alias("role"),
        text.alias("text"),
        F.when(F.coalesce(message, F.lit(False)), F.coalesce(text_at("timestamp"), F.lit(now))).alias("timestamp"),
        F.when(context, basename(F.nullif(text_at("payload.cwd"), F.lit("")))).alias("project"),
        F.when(meta, text_at("payload.id")).alias("session_id"),
        F.when(meta, text_at("payload.git.branch")).alias("git_branch"),
    )
    seen = Window.partitionBy("path").orderBy("line_no")
    to_here = seen.rowsBetween(Window.unboundedPreceding, 0)
    rows = rows.withColumns({c: F.last(c, ignorenulls=True).over(to_here) for c in ("project", "session_id", "git_branch")})
    turn = F.sum(F.coalesce((F.col("role") == "user").cast("long"), F.lit(0))).over(to_here)
    rows = rows.withColumn("_group", turn)
    last = Window.partitionBy("path", "_group").orderBy("line_no").rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)
    rows = rows.withColumns({c: F.last(c).over(last) for c in ("project", "session_id", "git_branch")})
    turns = rows.filter("role is not null").withColumns({"prompt_source": F.lit(None).cast("string"), "is_meta": F.lit(None).cast("boolean"), "is_sidechain": F.lit(False)})
    carried = {"timestamp": "last"} | {c: "user" for c in ("project", "session_id", "git_branch", "prompt_source", "is_meta", "is_sidechain")}
    folded = fold(turns, "path", "line_no", carried)
    return _exchanges(folded.withColumn("project", F.coalesce("project", project_of_path(F.col("path")))), "codex", now)
