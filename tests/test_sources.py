from __future__ import annotations

import json

import pytest

from mnemoframe.functions.privacy import Policy
from mnemoframe.sources import notes, registry

POLICY = Policy()


def put(path, *rows):
    path.parent.mkdir(parents=True, exist_ok=True)
    path.write_text("\n".join(r if isinstance(r, str) else json.dumps(r) for r in rows), encoding="utf-8")


def said(kind, content, **more):
    return {"type": kind, "sessionId": "s1", "timestamp": "2026-05-01T10:00:00.000Z", "cwd": "/home/me/dev/shop", "gitBranch": "main", "message": {"role": kind, "content": content}} | more


def docs(spark, source, root, **options):
    return {d.conv_id: d for d in registry.read(spark, source, f"file://{root}", options.pop("policy", POLICY), **options).collect()}


def test_claude_code(spark, tmp_path):
    blocks = [{"type": "thinking", "text": "hm"}, {"type": "text", "text": "hello"}, {"type": "tool_use", "name": "x"}, {"type": "text", "text": "there"}]
    put(
        tmp_path / "-home-me-dev-shop" / "s1.jsonl",
        {"type": "ai-title", "aiTitle": "first", "sessionId": "s1"}, said("user", "wir nehmen postgres"), said("assistant", blocks, timestamp="2026-05-02T23:30:00+05:00"), said("user", "meta", isMeta=True), said("user", "side", isSidechain=True),
        said("user", [{"type": "tool_result", "content": "x"}]), said("user", "<system-reminder>no</system-reminder>"), {"type": "ai-title", "aiTitle": "second"}, "[1]", '{"type": "user", "cut',
    )
    put(tmp_path / "-home-me-dev-shop" / "s1" / "subagents" / "deep.jsonl", said("user", "deep", sessionId="deep"))
    put(tmp_path / "-home-me-dev-shop" / "auto.jsonl", said("user", "mnemoframe-automation go", sessionId="auto"), said("assistant", "done", sessionId="auto"))
    put(tmp_path / "-home-me-dev-acme-poc" / "s2.jsonl", said("user", "anything", sessionId="s2", cwd=""))
    put(tmp_path / "-home-me" / "s3.jsonl", said("user", "API_KEY=" + "abc123" * 5, sessionId="s3"))
    got = docs(spark, "claude-code", tmp_path, home_prefix="-home-me-")
    assert set(got) == {"s1", "s2", "s3"}
    d = got["s1"]
    assert [(t.role, t.text) for t in d.turns] == [("user", "wir nehmen postgres"), ("assistant", "hello\nthere")]
    assert (d.title, d.project, d.cwd, d.git_branch, d.sensitivity) == ("second", "dev-shop", "/home/me/dev/shop", "main", "clean")
    assert str(d.started_day) == "2026-05-01" and d.doc_id.startswith("claude-code/2026/2026-05-01--claude-code--second--")
    assert got["s2"].sensitivity == "nda" and got["s3"].sensitivity == "nda" and got["s3"].project == "_home"
    assert "abc123" not in got["s3"].turns[0].text
    repo = spark.createDataFrame([("/home/me/dev/shop", "acme-poc")], "cwd string, repo string")
    assert docs(spark, "claude-code", tmp_path, home_prefix="-home-me-", repo_of=repo)["s1"].sensitivity == "nda"
    forced = Policy(overrides=frozenset({("claude-code", "s1")}))
    assert docs(spark, "claude-code", tmp_path, policy=forced)["s1"].sensitivity == "nda"


def test_codex(spark, tmp_path):
    event = lambda kind, text: {"type": "event_msg", "timestamp": "2026-05-03T08:00:00Z", "payload": {"type": kind, "message": text}}
    item = lambda role, *texts: {"type": "response_item", "timestamp": "2026-05-03T08:00:00Z", "payload": {"type": "message", "role": role, "content": [{"type": "input_text", "text": t} for t in texts]}}
    put(tmp_path / "2026/05/03/rollout-a.jsonl", {"type": "session_meta", "payload": {"id": "a", "cwd": "/x/shop"}}, {"type": "session_meta", "payload": {"id": "b", "cwd": "/y"}}, event("user_message", "\n# Plan\nmore"), event("agent_message", "ok"), item("user", "twice"))
    put(
        tmp_path / "2026/05/04/rollout-c.jsonl", item("user", "<environment_context>x", "# Context from my IDE setup\n\n## My request for Codex:\nfix it"), item("assistant", "[external_agent_tool_call x", "sure"),
        item("user", "<scheduled-task>daily</scheduled-task>"), item("developer", "no"),
    )
    put(tmp_path / "other.jsonl", event("user_message", "no rollout"))
    got = docs(spark, "codex", tmp_path)
    assert set(got) == {"a", "rollout-c"}
    assert (got["a"].title, got["a"].project, [t.text for t in got["a"].turns]) == ("Plan", "shop", ["# Plan\nmore", "ok"])
    assert [(t.role, t.text, t.machine_summary) for t in got["rollout-c"].turns] == [("user", "fix it", False), ("assistant", "sure", False), ("user", "<scheduled-task>daily</scheduled-task>", True)]


def test_chatgpt(spark, tmp_path):
    node = lambda parent, role, *parts, kind="text": {"parent": parent, "message": role and {"author": {"role": role}, "content": {"content_type": kind, "parts": list(parts)}, "create_time": 1_770_000_000.5}}
    mapping = {"r": node(None, None), "u": node("r", "user", "hi", {"image": 1}, kind="multimodal_text"), "dead": node("u", "assistant", "dead"), "a": node("u", "assistant", "yes"), "s": node("a", "system", "sys"), "code": node("s", "assistant", "x", kind="code"), "u2": node("code", "user", "more")}
    put(tmp_path / "chatgpt/conversations-1.json", [{"conversation_id": "c", "title": "T", "create_time": 1_760_000_000, "update_time": 1_770_000_001, "current_node": "u2", "mapping": mapping}, {"id": "loop", "current_node": "p", "mapping": {"p": node("q", "user", "round"), "q": node("p", "assistant", "and round")}}])
    got = docs(spark, "chatgpt", tmp_path)
    assert [(t.role, t.text) for t in got["c"].turns] == [("user", "hi"), ("assistant", "yes"), ("user", "more")]
    assert str(got["c"].started_day) == "2025-10-09" and got["c"].title == "T"
    assert [t.text for t in got["loop"].turns] == ["and round", "round"]


def test_gemini_and_claude_web(spark, tmp_path):
    put(tmp_path / "gemini/my-activity.json", [{"title": "Prompted what is it", "time": "2026-01-02T03:04:05Z", "safeHtmlItem": [{"html": "<p>it &amp; that</p>"}, {"html": "<b>more</b>"}]}, {"title": "Prompted ", "time": "x"}])
    got = docs(spark, "gemini", tmp_path)
    assert [(t.role, t.text) for t in got["my-activity-0"].turns] == [("user", "what is it"), ("assistant", "it & that\n\nmore")] and len(got) == 1
    put(tmp_path / "claude/conversations.json", [{"uuid": "w", "name": "N", "created_at": "2026-01-02T03:04:05Z", "updated_at": "2026-01-03T03:04:05Z", "chat_messages": [{"sender": "human", "text": "", "content": [{"type": "text", "text": "asked"}, {"type": "image"}]}, {"sender": "assistant", "text": " told "}, {"sender": "tool", "text": "x"}]}])
    got = docs(spark, "claude-web", tmp_path)
    assert [(t.role, t.text) for t in got["w"].turns] == [("user", "asked"), ("assistant", "told")] and str(got["w"].started_day) == "2026-01-02"


def test_notes_and_courses(spark, tmp_path):
    put(tmp_path / "notes/a.md", "---\ncreated: 2026-01-01\nmodified: 2026-02-01\nproject: 'it''s'\n---\n# Title A\nbody")
    put(tmp_path / "memory/shop/m.md", "plain memory")
    put(tmp_path / "private/p.md", "# P\nsecret plan")
    put(tmp_path / "private/memory/x/q.md", "q")
    put(tmp_path / "notes/n.md", "---\nsensitivity: nda\n---\nx")
    put(tmp_path / "notes/empty.md", "  ")
    got = docs(spark, "memory", tmp_path)
    assert set(got) == {"notes/a.md", "memory/shop/m.md", "private/p.md", "private/memory/x/q.md", "notes/n.md"}
    a = got["notes/a.md"]
    assert (a.title, a.project, str(a.started_day), a.sensitivity, a.cwd) == ("Title A", "it's", "2026-01-01", "clean", "notes")
    assert (got["memory/shop/m.md"].project, got["private/memory/x/q.md"].project, got["private/p.md"].project) == ("shop", "x", "private")
    assert {k for k, d in got.items() if d.sensitivity == "nda"} == {"private/p.md", "private/memory/x/q.md", "notes/n.md"}
    assert got["memory/shop/m.md"].started_day is not None
    put(tmp_path / "courses/k/1.md", "---\ncourse: K\nmodule: deep/M\nlesson: L\nsensitivity: clean\n---\nforeign text")
    c = docs(spark, "course", tmp_path)["courses/k/1.md"]
    assert (c.title, c.project, c.sensitivity, c.turns[0].role) == ("M: L", "K", "copyright", "assistant")


def test_render_round_trip(spark, docs_of):
    import datetime as dt

    from conftest import make_doc, turn

    rows = [make_doc("a.md", [turn(0, "user", "x\n## user\n## assistant · 2026-01-01\nz", ts=dt.datetime(2026, 1, 1, 5)), turn(1, "user", "sum", machine=True), turn(2, "assistant", "end")], title="it's: a #title", day="2026-01-01")]
    docs = docs_of(rows)
    back = notes.parse_rendered(notes.render(docs)).first()
    was = docs.first()
    assert [(t.idx, t.role, t.ts, t.text, t.machine_summary) for t in back.turns] == [(t.idx, t.role, t.ts, t.text, t.machine_summary) for t in was.turns]
    assert (back.title, back.started_day, back.sensitivity, back.conv_id) == (was.title, was.started_day, "clean", "a.md")
    bare = spark.createDataFrame([("x", "---\nsource: codex\nconv_id: 1\n---\n\n## user\n\nhi\n"), ("y", "no front")], "doc_id string, rendered string")
    assert [(r.doc_id, r.sensitivity) for r in notes.parse_rendered(bare).collect()] == [("x", "nda")]


def test_unknown_source(spark):
    with pytest.raises(ValueError):
        registry.read(spark, "nope", "x", POLICY)


def test_file_sink(spark, tmp_path, docs_of):
    from conftest import make_doc, turn

    from mnemoframe.sources import files

    rows = spark.createDataFrame([("a/b.md", "ä\n"), ("c.md", None), ("a/b c[1].md", "x")], "path string, content string").repartition(3)
    for _ in range(2):
        assert files.write_files(rows, f"file://{tmp_path}/out") == 3
    found = {p.relative_to(tmp_path / "out").as_posix(): p.read_text() for p in (tmp_path / "out").rglob("*") if p.is_file() and not p.name.endswith(".crc")}
    assert found == {"a/b.md": "ä\n", "c.md": "", "a/b c[1].md": "x"}
    for bad in ("/etc/x", "a/../x"):
        with pytest.raises(ValueError):
            files.write_files(spark.createDataFrame([(bad, "x")], "path string, content string"), f"file://{tmp_path}/out")
    assert files.write_files(rows.where("false"), f"file://{tmp_path}/out") == 0
    docs = docs_of([make_doc("codex/2026/a.md", [turn(0, "user", "hallo")])])
    assert files.export(docs, f"file://{tmp_path}/vault") == 1 and "hallo" in (tmp_path / "vault/codex/2026/a.md").read_text()
