"""Schemas of the tables that the package reads and writes, as DDL: they are parsed where a session is at hand."""

from __future__ import annotations

ROLES = ("user", "assistant")
SOURCES = ("claude-code", "codex", "chatgpt", "gemini", "claude-web", "memory", "course", "antigravity", "book")

TURN = "idx int, role string, ts timestamp, text string, machine_summary boolean"
DOC = (
    "doc_id string, source string, conv_id string, title string, project string, started_at timestamp, started_day date, ended_at timestamp, "
    "sensitivity string, cwd string, git_branch string, turns array<struct<idx:int, role:string, ts:timestamp, text:string, machine_summary:boolean>>"
)
CLAIM = "entity string, topic string, key string, kind string, text string, stated_on date, source_doc_id string, confidence string, rationale string"
REVIEW = "doc_id string, source_fingerprint string, reason string, reviewed_on date, note string"
FILE_STATE = "path string, size bigint, mtime_ns bigint, ctime_ns bigint, policy_version string"

CLAIM_KINDS = ("entscheidung", "fakt", "praeferenz", "offen")
CONFIDENCES = ("high", "medium")


def columns(ddl: str) -> list[str]:
    """Names in a flat schema."""
    return [c.split()[0] for c in ddl.split(",")]
