"""Row types and the settings of the engine."""

from __future__ import annotations

import os
from dataclasses import dataclass, field
from pathlib import Path

EXCHANGE = (
    "id long, harness string, project string, session_id string, git_branch string, timestamp string, user_message string, "
    "assistant_message string, archive_path string, line_start long, line_end long, embedding_version int, "
    "is_sidechain boolean, user_is_injected boolean"
)
VECTOR = "id long, embedding array<float>"
CURSOR = "source_path string, line_end long"
POSTING = "term string, id long, tf long, positions array<int>"
LENGTH = "id long, dl long"
DELETED = "id long"

#: Fixed values of the engine's behaviour.
RRF_K = 60
CANDIDATES = 50
CONCEPT_DEPTH = 5
LIMIT, MOST = 10, 50
SNIPPET = 200
EMBEDDED = 2000
TOKEN_BYTES = 40
TRANSCRIPT = 24_000
QUIET_MS = 2 * 60 * 60 * 1000
SUMMARIES = 10
SUMMARY_SHOWN = 300
TTL_DAYS = 180
DAY_MS = 86_400_000
IDLE_DAYS = 30
SWEEP_SECONDS = 60
PROBED_LINES = 50
DEFAULT_HARNESS, OTHER_HARNESS = "claude", "codex"
ERROR_PREFIX = "[error]"


def _home() -> str:
    return os.environ.get("HOME") or os.environ.get("USERPROFILE") or str(Path.home())


def source_dirs() -> list[str]:
    """The folders that hold transcripts: one for each format, each moved by an environment variable."""
    first = os.environ.get("CLAUDE_CONFIG_DIR") or os.path.join(_home(), ".claude")
    second = os.environ.get("CODEX_HOME") or os.path.join(_home(), ".codex")
    return [os.path.join(first, "projects"), os.path.join(second, "sessions")]


def ttl_days(setting: str | None) -> float:
    """Days that a conversation is kept; 0 keeps all. Unset: 180; what isn't a positive number: 0."""
    if setting is None:
        return TTL_DAYS
    try:
        days = float(setting)
    except ValueError:
        return 0
    return days if days > 0 else 0


@dataclass(frozen=True)
class Config:
    """Where the engine keeps its tables and copies, and how long."""

    root: str
    sources: list[str] = field(default_factory=source_dirs)
    ttl_days: float = TTL_DAYS
    summary_limit: int = SUMMARIES
    dimension: int = 64

    @property
    def archive(self) -> str:
        return f"{self.root}/archive"
