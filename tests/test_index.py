"""The segmented index, documents in buckets and readers by ranges, against whole scans and whole builds."""

from __future__ import annotations

import datetime as dt
import random

import pytest
from conftest import make_doc, turn
from pyspark.sql import functions as F
from test_sources import put, said

from mnemoframe.functions.privacy import Policy
from mnemoframe.operators import index as ix
from mnemoframe.operators import search
from mnemoframe.operators import segments as sg
from mnemoframe.plans import engine as en
from mnemoframe.sources import registry as sources

WORDS = [f"wort{i}" for i in range(60)] + ["übung", "c++", "ñandú", "100%", "a_b", "x"]


def some_docs(rng, n, name="d"):
    said = lambda: " ".join(rng.choice(WORDS[: rng.choice([8, 66])]) for _ in range(rng.randint(0, 40)))
    return [make_doc(f"{name}{i:04}", [turn(0, "user", said()), turn(1, "assistant", said())], title=rng.choice(WORDS), sensitivity=rng.choice(["clean", "clean", "nda"])) for i in range(n)]


@pytest.fixture(scope="module")
def rows():
    return some_docs(random.Random(2), 300)


@pytest.fixture(scope="module")
def index(docs_of, rows):
    return sg.build(docs_of(rows))


def folded(row):
    return f"{row[3]} {' '.join(t[3] for t in row[-1])}".lower()


def test_grams_name_every_document_with_the_terms(spark, index, rows):
    rng = random.Random(3)
    texts = {r[0]: folded(r) for r in rows}
    picks = [t[i : i + n] for t in rng.sample(sorted(texts.values()), 12) for n in (1, 2, 3, 9) if len(t) > 20 for i in [rng.randrange(len(t) - n)]]
    for terms in [[p] for p in picks[:8]] + [rng.sample(picks, 2) for _ in range(4)] + [["nothing like it"], ["WORT1", "X"]]:
        for every in (True, False):
            read = sg.read_at(index.docs, sg.candidates(index, terms, every)).select("doc_id", sg.whole(F.col("title"), F.col("turns")).alias("w")).collect()
            test = all if every else any
            assert {r.doc_id for r in read if test(t.lower() in r.w for t in terms)} == {d for d, w in texts.items() if test(t.lower() in w for t in terms)}
    asked = [(i, t) for i, p in enumerate(picks) for t in {p, rng.choice(picks)}]
    got = {(r.query, r.doc_id) for r in sg.containing(index, spark.createDataFrame([*asked, (99, "")], "query int, term string")).collect()}
    assert got == {(i, d) for i in range(len(picks)) for d, w in texts.items() if all(t.lower() in w for q, t in asked if q == i)}


def test_few_texts_are_read(index, rows):
    """A rare word's documents alone pass the grams."""
    word = min(WORDS, key=lambda w: sum(w in folded(r) for r in rows))
    some = sum(word in folded(r) for r in rows)
    assert 0 < some <= sg.read_at(index.docs, sg.candidates(index, [word])).count() <= some + 30 < len(rows)


@pytest.mark.parametrize("k", [5, 100])
def test_top_bm25_equals_scoring_all(spark, index, rows, docs_of, k):
    rng = random.Random(4)
    terms = spark.createDataFrame([(q, w) for q in range(12) for w in {*rng.sample(WORDS[:60], 3), rng.choice(WORDS[:8]), "unbekannt"}], "q int, term string")
    docs = docs_of(rows)
    body = ix.search_text(F.col("turns"))
    all_ = ix.bm25(ix.postings(docs, title=F.col("title"), body=body).cache(), ix.doc_lengths(docs, title=F.col("title"), body=body).cache(), terms, by=["q"])
    shown = docs.where("sensitivity = 'clean'").select("doc_id")
    want = {}
    for r in sorted(all_.join(shown, "doc_id").collect(), key=lambda r: (r.q, -round(r.score, 9), r.doc_id)):
        want.setdefault(r.q, []).append((r.doc_id, round(r.score, 9)))
    found, counts = sg.top_bm25(index, terms, k, index.docs.where("sensitivity = 'clean'"), by=["q"])
    got = {}
    for r in sorted(found.collect(), key=lambda r: (r.q, -r.score, r.doc_id)):
        got.setdefault(r.q, []).append((r.doc_id, pytest.approx(r.score, abs=2e-9)))
    assert got == {q: v[:k] for q, v in want.items()}
    assert all(r.n_read <= r.n_blocks for r in counts.collect())


def test_blocks_below_the_best_are_not_read(spark, docs_of):
    """Documents that hold a word often stand together: most other blocks can't reach them."""
    rows = [make_doc(f"d{i:05}", [turn(0, "user", ("kafka " * 9 if 640 <= i < 704 else "kafka und sonst noch viele andere dinge hier ") + f"nr{i}")]) for i in range(3000)]
    terms = spark.createDataFrame([("kafka",)], "term string")
    found, counts = sg.top_bm25(sg.build(docs_of(rows).coalesce(1)), terms, 10)
    assert {r.doc_id for r in found.collect()} <= {f"d{i:05}" for i in range(640, 704)}
    assert counts.first().n_read * 3 <= counts.first().n_blocks


def hits(index, query):
    return [(r.doc_id, pytest.approx(r.score), r.matched_terms) for r in search.search(index, query, limit=50, today=dt.date(2026, 7, 20)).collect()]


def test_index_by_segments_equals_a_whole_one(spark, tmp_path, monkeypatch):
    logs, rng = tmp_path / "logs", random.Random(5)
    monkeypatch.setattr(en, "SEGMENTS", 3)
    monkeypatch.setattr(en, "MAX_PATHS", 3)
    e = en.Engine(spark, f"file://{tmp_path}/data")
    text = lambda: " ".join(rng.choice(WORDS) for _ in range(30))
    for i in range(8):
        put(logs / "p" / f"s{i}.jsonl", said("user", text(), sessionId=f"s{i}"))
    assert e.ingest("claude-code", f"file://{logs}", limit=7)["added"] == 7 and e.docs().count() == 7  # in turns of three files
    assert e.ingest("claude-code", f"file://{logs}")["added"] == 1
    query = "wort1 wort2 übung"
    hits(e.index(), query)
    assert [s["docs"] for s in e._manifest()["segments"]] == [8]
    for step in range(4):
        put(logs / "p" / f"s{step}.jsonl", said("user", text(), sessionId=f"s{step}"), said("assistant", text(), sessionId=f"s{step}", timestamp="2026-05-01T12:00:00.000Z"))
        before = e._manifest()["docs"]
        assert e.ingest("claude-code", f"file://{logs}")["replaced"] == 1
        assert sum(before[b] != v for b, v in e._manifest()["docs"].items()) == 1  # one changed session, one bucket
        index = e.index()
        entries = e._manifest()["segments"]
        assert len(entries) <= 3 and index.n == 8 and (step > 1 or entries[-1]["docs"] == 1)
        assert hits(index, query) == hits(sg.build(e.docs()), query)
    assert e.ingest("claude-code", f"file://{logs}", full=True)["replaced"] == 8
    entries = e._manifest()["segments"]
    e.index()
    assert e._manifest()["segments"] == entries  # what was read again and is the same isn't indexed again
    assert e.sweep() > 0 and hits(e.index(), query) == hits(sg.build(e.docs()), query) and e.sweep() == 0


def test_a_failing_write_changes_nothing(spark, tmp_path, monkeypatch):
    logs = tmp_path / "logs"
    put(logs / "p" / "s1.jsonl", said("user", "eins"))
    e = en.Engine(spark, f"file://{tmp_path}/data")
    e.ingest("claude-code", f"file://{logs}")
    put(logs / "p" / "s2.jsonl", said("user", "zwei", sessionId="s2"))
    monkeypatch.setattr(e, "_table", lambda df: lambda p: (_ for _ in ()).throw(OSError("disk full")), raising=False)
    with pytest.raises(OSError):
        e.ingest("claude-code", f"file://{logs}")
    monkeypatch.undo()
    assert e.docs().count() == 1 and e.ingest("claude-code", f"file://{logs}")["added"] == 1 and e.docs().count() == 2


def test_sessions_are_the_same_by_any_ranges(spark, tmp_path):
    rng = random.Random(6)
    for i in range(3):
        put(tmp_path / "p" / f"s{i}.jsonl", *[said(rng.choice(["user", "assistant"]), f"zeile {k} " + "x" * rng.randint(0, 200), sessionId=f"s{i}") for k in range(60)])
    with (tmp_path / "p" / "s0.jsonl").open("a") as f:
        f.write('\n\n{"type": "user", "cut')
    seen = set()
    for size in ("128m", "1000", "333", "64"):
        spark.conf.set("spark.sql.files.maxPartitionBytes", size)
        spark.conf.set("spark.sql.files.openCostInBytes", "0")
        try:
            rows = sources.read(spark, "claude-code", f"file://{tmp_path}", Policy()).collect()
        finally:
            spark.conf.unset("spark.sql.files.maxPartitionBytes")
            spark.conf.unset("spark.sql.files.openCostInBytes")
        seen.add(repr(sorted((r.doc_id, [(t.idx, t.role, t.text) for t in r.turns]) for r in rows)))
    assert len(seen) == 1
    (turns,) = {tuple(t.idx for t in r.turns) for r in rows if r.conv_id == "s1"}
    assert turns == tuple(range(len(turns)))


def test_repositories_are_read_from_the_folders(spark, tmp_path):
    from mnemoframe.sources.repos import repos_of

    main = tmp_path / "shop"
    (main / ".git/worktrees/fix").mkdir(parents=True)
    (main / "src").mkdir()
    tree = tmp_path / "elsewhere/neutral"
    tree.mkdir(parents=True)
    (tree / ".git").write_text(f"gitdir: {main}/.git/worktrees/fix\n")
    (tmp_path / "plain").mkdir()
    folders = [str(main), str(main / "src"), str(tree), str(tmp_path / "plain"), str(tmp_path / "gone"), "", "relative"]
    got = {r.cwd: r.repo for r in repos_of(spark.createDataFrame([(f,) for f in folders], "cwd string")).collect()}
    assert got == {str(main): "shop", str(main / "src"): "shop", str(tree): "shop"}
    put(tmp_path / "logs" / "neutral" / "s1.jsonl", said("user", "hallo", cwd=str(tree)))
    assert [r.project for r in sources.read(spark, "claude-code", f"file://{tmp_path}/logs", Policy()).collect()] == ["shop"]


def test_many_names_by_a_join_are_those_one_by_one(spark):
    from mnemoframe.operators import recall

    rng = random.Random(9)
    names = ["shop", "shop-admin", "new york", "c++", "über", "übersicht", "日本", "a.b", "x\\Ey", "teamco", "team"]
    texts = [f"{rng.choice(['', 'x', '-', ' ', '('])}{rng.choice(names).upper()}{rng.choice(['', 's', '-1', ' ', '.'])} und {rng.choice(names)}" for _ in range(150)] + ["", None, "nichts"]
    rows = spark.createDataFrame([(i, t, rng.choice(["", "Shop", None])) for i, t in enumerate(texts)], "i int, text string, repo string")
    one = {r.i: r.e for r in rows.select("i", recall.mentioned(F.col("text"), names, F.coalesce("repo", F.lit(""))).alias("e")).collect()}
    got = recall.mentions(rows.na.fill({"repo": ""}), spark.createDataFrame([(n,) for n in [*names, "", "team"]], "name string"), repo="repo").collect()
    assert {r.i: r.entity for r in got} == one and len(got) == len(texts)


def test_context_of_a_prompt(spark, docs_of):
    from mnemoframe.operators import recall

    index = sg.build(docs_of([make_doc("a", [turn(0, "user", "teamco nimmt die neuen preise")]), make_doc("b", [turn(0, "user", "teamco preise geheim")], sensitivity="nda")]))
    told = recall.context(index, "weißt du noch, die preise von teamco", "teamco")
    assert "2026-07-01 a: " in told and "1 more are confidential" in told and "geheim" not in told
    assert recall.context(index, "ganz etwas anderes", "") == ""


def test_nearest_by_cells_equals_all_pairs(spark, monkeypatch):
    import numpy as np

    from mnemoframe.operators import cells

    rng = np.random.default_rng(1)
    middle = rng.normal(size=(6, 16))
    points = [(f"o{i % 170}", (middle[i % 6] + rng.normal(size=16) * 0.2).tolist()) for i in range(400)]
    vectors = spark.createDataFrame([*points, ("none", None)], "doc_id string, embedding array<double>")
    asked = spark.createDataFrame([(i, (middle[i % 6] * (1 + i)).tolist()) for i in range(9)] + [(9, None)], "query int, embedding array<double>")
    monkeypatch.setattr(cells, "QUERIES", 4)
    for k in (3, 40):
        got, share = cells.nearest(cells.assign(vectors, centroids=24), asked, k)
        want = ix.dense_lists(vectors.where("embedding is not null"), asked.where("embedding is not null"), k)
        key = lambda df: sorted((r.query, r.owner, round(r.score, 5), r["rank"]) for r in df.select("query", F.col(df.columns[1]).alias("owner"), "score", "rank").collect())
        assert key(got) == key(want) and 0 < share < (0.6 if k == 3 else 1.01)
    assert cells.nearest(cells.assign(vectors.where("false")), asked, 3)[0].count() == 0


def test_growing_sessions_are_read_from_where_they_ended(spark, tmp_path):
    from mnemoframe.streaming import landing, tail

    log = tmp_path / "in/p/s1.jsonl"
    line = lambda kind, said_, n: __import__("json").dumps(said(kind, said_, sessionId="s1", timestamp=f"2026-05-01T10:0{n}:00.000Z")) + "\n"
    log.parent.mkdir(parents=True)
    log.write_text(line("user", "eins", 0) + line("assistant", "zwei", 1) + line("user", "drei mit ü", 2)[:30])
    (tmp_path / "in/p/deep").mkdir()
    (tmp_path / "in/p/deep/sub.jsonl").write_text(line("user", "unteragent", 0))

    def trigger():
        q = landing.write_documents(tail.read_sessions(spark, f"file://{tmp_path}/in", range_bytes=100), f"{tmp_path}/out", f"{tmp_path}/cp")
        q.awaitTermination(120)
        return sum(p["numInputRows"] for p in q.recentProgress)

    def turns():
        return [(t.idx, t.role, t.text) for t in tail.documents_of(spark.read.parquet(f"{tmp_path}/out")).where("conv_id = 's1'").first().turns]

    trigger()
    assert turns() == [(0, "user", "eins"), (1, "assistant", "zwei")]  # a line that isn't whole yet waits
    with log.open("w") as f:
        f.write(line("user", "eins", 0) + line("assistant", "zwei", 1) + line("user", "drei mit ü", 2) + line("assistant", "acme vier", 3))
    assert trigger() == 2  # the tail alone
    assert turns()[2:] == [(2, "user", "drei mit ü"), (3, "assistant", "acme vier")]
    got = tail.documents_of(spark.read.parquet(f"{tmp_path}/out")).collect()
    assert [(r.conv_id, r.sensitivity, str(r.ended_at)[:16]) for r in got] == [("s1", "nda", "2026-05-01 10:03")]
    assert trigger() == 0 and len(turns()) == 4
