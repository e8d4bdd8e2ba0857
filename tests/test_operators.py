from __future__ import annotations

import datetime as dt
from pathlib import Path

import pytest
from conftest import make_doc, turn

from mnemoframe import schema
from mnemoframe.operators import distill, evaluation, graph, notes, recall, tables
from mnemoframe.plans.engine import Engine

DAY = dt.date(2026, 1, 1)


def claim(topic="T", key="k", text="x", day=DAY, source="s", entity="E", kind="fakt", confidence="high", rationale=""):
    return (entity, topic, key, kind, text, day, source, confidence, rationale)


@pytest.fixture
def claims_of(spark):
    return lambda *rows: spark.createDataFrame(list(rows), schema.CLAIM)


def test_newest_wins_and_same_text_is_no_conflict(claims_of):
    rows = claims_of(claim(text="old"), claim(text="new", day=dt.date(2026, 2, 1), source="t"), claim(key="same", text="a "), claim(key="same", text="a", day=dt.date(2026, 3, 1)), claim(key="undated", day=None))
    current, old = distill.resolve(rows)
    assert {(r.key, r.text) for r in current.collect()} == {("k", "new"), ("same", "a"), ("undated", "x")}
    assert [(r.text, r.new_text) for r in old.collect()] == [("old", "new")]


def test_note_body(claims_of):
    body = distill.note_bodies(claims_of(claim(text="old"), claim(text="new", day=dt.date(2026, 2, 1), source="t", confidence="medium", rationale="so"), claim(key="z", kind="entscheidung", text="go", day=None))).first().body
    assert body == (
        "\n## Entscheidungen\n\n- **ohne Datum**: go [Q1]\n\n## Fakten\n\n- **2026-02-01**: new, weil so *(indirekt belegt)* [Q2]\n\n## Ueberholt\n\n- **2026-01-01**: old [Q1]\n  ersetzt am 2026-02-01 durch: new [Q2]\n"
        "\n## Quellen\n\n- **Q1** `corpus/s`\n- **Q2** `corpus/t`\n"
    )


def test_upsert(spark, claims_of):
    old = claims_of(claim(text="a"), claim(key="b", day=None, text="n"))
    new = claims_of(claim(text="a2"), claim(key="b", day=None, text="n2"), claim(day=dt.date(2026, 5, 5))).selectExpr("*", "cast(1 as bigint) as seq")
    got = distill.upsert(old, new, distill.CLAIM_KEYS)
    assert sorted(r.text for r in got.collect()) == ["a2", "n2", "x"]
    assert distill.upsert_counts(old, new, distill.CLAIM_KEYS).first().asDict() == {"added": 1, "replaced": 2}
    again = distill.upsert(got, new, distill.CLAIM_KEYS)
    assert sorted(map(tuple, again.collect()), key=str) == sorted(map(tuple, got.collect()), key=str)


def test_route(spark, claims_of):
    docs = spark.createDataFrame([("c", "clean"), ("n", "nda"), ("k", "copyright")], "doc_id string, sensitivity string")
    got = distill.route(claims_of(claim("A", source="c"), claim("A", source="n"), claim("B", source="n"), claim("C", source="k"), claim("D", source="gone")), docs)
    assert {(r.topic, r.source_doc_id): (r.layer, r.error) for r in got.collect()} == {
        ("A", "c"): ("clean", "mixed topic"), ("A", "n"): ("private", "mixed topic"), ("B", "n"): ("private", None), ("C", "k"): ("clean", "copyright source"), ("D", "gone"): ("clean", "source missing"),
    }


def test_moved_source_is_found_if_it_is_the_only_one(spark):
    path = lambda d, s="x": f"memory/2026/{d}--memory--{s}--abcd1234.md"
    docs = spark.createDataFrame([(path("2026-02-01"), "clean"), (path("2026-02-01", "two"), "clean"), (path("2026-02-02", "two"), "clean")], "doc_id string, sensitivity string")
    refs = spark.createDataFrame([(path("2026-01-01"),), (path("2026-01-01", "two"),)], "source_doc_id string")
    assert [r.found_doc_id for r in distill.resolved_sources(refs, docs).orderBy("source_doc_id").collect()] == [None, path("2026-02-01")]
    assert distill.provenance_errors(refs, docs).count() == 1


def test_exact_review_shadows_the_similar_one(spark):
    a, b = "m/2026/2026-01-01--m--x--id.md", "m/2026/2026-02-01--m--x--id.md"
    candidates = spark.createDataFrame([(b, "new")], "doc_id string, source_fingerprint string")
    review = lambda *rows: spark.createDataFrame([(d, f, "other", DAY, "") for d, f in rows], schema.REVIEW)
    assert distill.pending(candidates, review((a, "new"))).count() == 0
    assert distill.pending(candidates, review((a, "new"), (b, "old"))).count() == 1
    assert distill.pending(candidates, review()).count() == 1


def test_select(spark, docs_of):
    long = "Ein ganzer Satz mit Sinn. " * 100
    rows = [
        make_doc("good", [turn(0, "user", long), turn(1, "user", long), turn(2, "user", "kurz", machine=True)]), make_doc("short", [turn(0, "user", "kurz")]), make_doc("foreign", [turn(0, "user", long)], sensitivity="copyright"),
        make_doc("mirror", [turn(0, "user", long)], source="memory", project="notes"), make_doc("auto", [turn(0, "user", "<scheduled-task x>" + long)]), make_doc("code", [turn(0, "user", "\n".join("const a = f(b);" for _ in range(300)))]),
        make_doc("secret", [turn(0, "user", long)], sensitivity="nda", day=None),
    ]
    got = distill.select(docs_of(rows), today=dt.date(2026, 7, 1)).collect()
    assert [r.doc_id for r in got] == ["good", "secret"]
    assert got[0].user_chars == len(long) + 2 and got[0].score == got[0].user_chars * got[0].prose
    assert len(distill.select(docs_of(rows), limit=1).collect()) == 1 and len(distill.select(docs_of(rows), limit=0).collect()) == 2


def test_fingerprint_ignores_dates(docs_of):
    from pyspark.sql import functions as F

    from mnemoframe.functions import text

    rows = [make_doc("a", [turn(0, "user", "x", ts=dt.datetime(2026, 1, 1))]), make_doc("b", [turn(0, "user", "x", ts=dt.datetime(2027, 1, 1)), turn(1, "assistant", "y")]), make_doc("c", [turn(0, "user", "z")])]
    got = [r[0] for r in docs_of(rows).orderBy("doc_id").select(text.source_fingerprint(F.col("turns"))).collect()]
    assert got[0] == got[1] != got[2]


# ---------------------------------------------------------------- graph


def note(parent, body=""):
    return f'---\nparent: "[[{parent}]]"\n---\n{body}\n'


GOOD = {"BRAIN": "# Root\n[[notes/projects]]", "notes/projects": note("BRAIN"), "notes/shop": note("projects", "see [[projects#x|p]] `[[nowhere]]`"), "private/INDEX": note("BRAIN"), "private/deal": note("private/INDEX")}


def audit(spark, nodes):
    report, errors = graph.audit(spark.createDataFrame(list(nodes.items()), "node_id string, text string"))
    return report.first(), {(r.node_id, r.error) for r in errors.collect()}


def test_good_graph(spark):
    report, errors = audit(spark, GOOD)
    assert errors == set() and report.ok and (report.nodes, report.parent_edges, report.components) == (5, 4, 1)


def test_bad_graph(spark):
    bad = GOOD | {
        "notes/lost": "no front matter", "notes/leak": note("private/deal"), "private/leak2": note("notes/projects"), "notes/root": note("BRAIN"), "notes/a": note("notes/b"), "notes/b": note("notes/a"), "notes/link": note("projects", "[[missing]] [[open"),
        "notes/sub/shop": note("projects"), "notes/amb": note("projects", "[[shop]]"), "notes/self": note("notes/self"),
    }
    report, errors = audit(spark, bad)
    assert not report.ok
    assert {
        ("notes/lost", "exactly one parent is needed, found 0"), ("notes/leak", "clean node with a private parent"), ("private/leak2", "private node with a clean parent"), ("notes/root", "may not hang below the root"), ("notes/a", "parent cycle"), ("notes/b", "parent cycle"),
        ("notes/link", "missing target missing"), ("notes/link", "incomplete or multi-line wikilink in body line 1"), ("notes/shop, notes/sub/shop", "duplicate node name"), ("notes/amb", "ambiguous target shop: notes/shop, notes/sub/shop"), ("notes/self", "parent is the node itself"),
    } <= errors


def test_components_of_a_long_chain(spark):
    nodes = spark.createDataFrame([(f"n{i:03}",) for i in range(120)], "node_id string")
    edges = spark.createDataFrame([(f"n{i:03}", f"n{i + 1:03}") for i in range(118)], "src string, dst string")
    assert {r.component for r in graph.components(nodes, edges).collect()} == {"n000", "n119"}


# ---------------------------------------------------------------- state, measures, recall


def test_changed_files(spark):
    files = spark.createDataFrame([("same", 1, 1, 1), ("grown", 2, 1, 1), ("new", 1, 1, 1)], "path string, size bigint, mtime_ns bigint, ctime_ns bigint")
    state = spark.createDataFrame([("same", 1, 1, 1, "p"), ("grown", 1, 1, 1, "p"), ("gone", 1, 1, 1, "p")], schema.FILE_STATE)
    changed = tables.changed_files(files, state, "p")
    assert {r.path for r in changed.collect()} == {"grown", "new"}
    assert {r.path for r in tables.changed_files(files, state, "q").collect()} == {"same", "grown", "new"}
    after = tables.next_state(changed, state, "p")
    assert tables.changed_files(files, after, "p").count() == 0 and after.count() == 4


def test_measures(spark):
    from pyspark.sql import functions as F

    rows = spark.createDataFrame([(True, True), (True, False), (False, False), (False, True), (True, True)], "e boolean, p boolean")
    got = evaluation.classification(rows, F.col("e"), F.col("p")).first()
    assert (got.tp, got.fp, got.fn, got.tn, round(got.precision, 3), round(got.recall, 3)) == (2, 1, 1, 1, 0.667, 0.667)
    ranks = spark.createDataFrame([(1,), (2,), (None,)], "rank int")
    assert evaluation.retrieval(ranks).first().mrr == pytest.approx(0.5)


PROMPTS = [
    ("weißt du noch, wie wir das gemacht haben", [], True, "recall cue"), ("ja mach weiter so wie eben", [], False, "short reply"), ("kurz", [], False, "too short"), ("Reply with exactly this text here please", [], False, "automation"),
    ("wie richten wir teamco richtig ein?", ["teamco", "tea"], True, "mentions teamco"), ("wie richten wir teamcoware richtig ein?", ["teamco"], False, "no cue"),
]


@pytest.mark.parametrize(("prompt", "names", "fire", "reason"), PROMPTS)
def test_recall_decision(spark, prompt, names, fire, reason):
    from pyspark.sql import functions as F

    got = spark.createDataFrame([(prompt,)], "p string").select(recall.decide(F.col("p"), names).alias("d")).first().d
    assert (got.fire, got.reason) == (fire, reason)


def test_recall_query():
    assert recall.build_query("<b>weißt du noch, teamco preise", "teamco") == '"teamco"  ,   preise'.strip() or '"teamco"' in recall.build_query("weißt du noch teamco", "teamco")


# ---------------------------------------------------------------- notes and engine


def vault(root: Path) -> Path:
    for node, body in GOOD.items():
        notes.replace_file(root / f"{node}.md", body)
    return root


def test_remember(tmp_path):
    v = vault(tmp_path)
    first = notes.remember(v, "Neue Idee", "Text", "projects", "clean", False, today=DAY)
    again = notes.remember(v, "Neue Idee", "Mehr", "projects", "clean", False, today=dt.date(2026, 2, 2))
    body = first.path.read_text()
    assert first.created and not again.created and "Text" in body and "## Neue Idee (2026-02-02)" in body and "modified: 2026-02-02" in body
    for bad in (dict(sensitivity="nda"), dict(has_secret=True), dict(has_email=True), dict(parent="nowhere"), dict(parent="private/deal"), dict(title=" ")):
        with pytest.raises(notes.NoteError):
            notes.remember(v, **({"title": "x", "body": "y", "parent": "projects", "sensitivity": "clean", "has_secret": False} | bad))
    private = notes.remember(v, "Geheim", "Text", "private/INDEX", "nda", False, layer="private", folder="Kunde")
    assert private.path == v / "private/kunde/geheim.md" and "sensitivity: nda" in private.path.read_text()
    (v / "notes/link").symlink_to("/tmp")
    assert not notes.safe(v / "notes/link/x.md", v / "notes") and not notes.safe(v / "notes/../x.md", v / "notes")


def test_emit(spark, claims_of, tmp_path):
    v = vault(tmp_path)
    rows = claims_of(claim("Preise", text="10 Euro", entity="Teamco"), claim("Technik", text="Spark", entity="Teamco", kind="offen"))
    with pytest.raises(notes.NoteError):
        notes.emit(rows, v)
    assert not (v / "notes/teamco.md").exists()
    done = notes.emit(rows, v, entity_parents={"Teamco": "projects"}, today=DAY)
    assert [w.created for w in done] == [True] * 3 and "[[preise|Preise]]" in (v / "notes/teamco.md").read_text() and ", 1 offen" in (v / "notes/teamco.md").read_text()
    hand = v / "notes/preise.md"
    hand.write_text(note("notes/teamco", "# Preise\n\nvon Hand"))
    notes.emit(rows, v, today=DAY)
    notes.emit(rows, v, today=DAY)
    assert hand.read_text().count("10 Euro") == 1 and "von Hand" in hand.read_text()
    with pytest.raises(notes.NoteError):
        notes.emit(claims_of(claim("A", entity="x"), claim("A", entity="y")), v)


def test_engine(spark, tmp_path, claims_of):
    from test_sources import put, said

    logs = tmp_path / "logs"
    long = "Wir nehmen Postgres als Datenbank. " * 80
    put(logs / "p" / "s1.jsonl", said("user", long), said("assistant", "gut"))
    put(logs / "p" / "s2.jsonl", said("user", "Acme hat kafka bestellt", sessionId="s2"))
    e = Engine(spark, f"file://{tmp_path}/data")
    with pytest.raises(FileNotFoundError):
        e.docs()
    assert e.ingest("claude-code", f"file://{logs}", dry_run=True)["added"] == 2
    assert e.ingest("claude-code", f"file://{logs}")["nda"] == 1
    again = e.ingest("claude-code", f"file://{logs}")
    assert (again["changed"], again["seen"], again["files"]) == (0, 0, 2) and e.docs().count() == 2  # nothing has changed
    assert e.ingest("claude-code", f"file://{logs}", full=True)["replaced"] == 2 and e.docs().count() == 2
    e.reindex()
    assert e.search("postgres datenbank").count() == 1 and e.search("kafka").count() == 0 and e.search("kafka", include_nda=True, ranking="hybrid").count() == 1
    assert e.stats().first().docs == 2 and e.timeline().count() == 1
    doc = e.candidates(pending=True).first().doc_id
    with pytest.raises(distill.Rejected):
        e.add_claims(claims_of(claim(source="nowhere")))
    e.add_claims(claims_of(claim(source=doc)))
    assert e.claims().count() == 1 and e.candidates(pending=True).count() == 0
    assert e.progress().first().asDict() == {"candidates": 1, "extracted": 1, "reviewed": 1, "open": 0, "topics": 1}


def test_index_follows_documents(spark, tmp_path):
    """What is ingested or reclassified after the index was built shows, or is hidden, in the next search."""
    from test_sources import put, said

    from mnemoframe.functions.privacy import Policy

    logs, data = tmp_path / "logs", f"file://{tmp_path}/data"
    put(logs / "p" / "s1.jsonl", said("user", "wir nehmen postgres"))
    e = Engine(spark, data)
    e.ingest("claude-code", f"file://{logs}")
    found = e.search("postgres")
    assert [r.ranking for r in found.collect()] == ["fused"] and e.search("kafka").count() == 0
    assert e.search("postgres", ranking="hybrid").first().ranking == "fused"  # without vectors
    put(logs / "p" / "s2.jsonl", said("user", "danach kafka statt postgres", sessionId="s2"))
    assert e.ingest("claude-code", f"file://{logs}")["changed"] == 1
    assert e.search("kafka").count() == 1 and e.search("postgres").count() == 2
    strict = Engine(spark, data, Policy(deny_terms=("kafka",)))
    assert strict.ingest("claude-code", f"file://{logs}")["changed"] == 2  # another policy reads all files again
    assert strict.search("kafka").count() == 0 and strict.search("kafka", include_nda=True).count() == 1

    from mnemoframe.plans.registry import hashed_encoder

    strict.reindex(hashed_encoder)
    assert strict.search("postgres", ranking="hybrid", encoder=hashed_encoder).first().ranking == "hybrid"
    put(logs / "p" / "s3.jsonl", said("user", "noch eins mit postgres", sessionId="s3"))
    strict.ingest("claude-code", f"file://{logs}")
    assert strict.search("postgres", ranking="hybrid", encoder=hashed_encoder).count() == 2  # vectors of unchanged documents are kept


def test_embedding_goes_on_where_it_broke_off(spark, tmp_path):
    from test_sources import put, said

    from mnemoframe.plans.registry import hashed_encoder

    logs, broken, calls = tmp_path / "logs", tmp_path / "broken", tmp_path / "calls"
    for i in range(6):
        put(logs / "p" / f"s{i}.jsonl", said("user", f"wir nehmen postgres nummer {i} und sonst nichts anderes", sessionId=f"s{i}"))
    e = Engine(spark, f"file://{tmp_path}/data")
    e.ingest("claude-code", f"file://{logs}")

    def encoder(texts, query):
        import uuid

        if any("nummer 3" in t for t in texts) and broken.exists():
            raise OSError("no model")
        calls.mkdir(exist_ok=True)
        (calls / uuid.uuid4().hex).write_text("\n".join(t.replace("\n", " ") for t in texts))
        return hashed_encoder(texts, query)

    broken.write_text("")
    with pytest.raises(Exception, match="no model"):
        e.reindex(encoder)
    broken.unlink()
    e.reindex(encoder)
    made = [line for f in calls.iterdir() for line in f.read_text().split("\n")]
    assert len(made) == len(set(made)) == 6
    assert e.index(vectors=True).vectors.count() == 6 and e.search("postgres", ranking="hybrid", encoder=encoder).first().ranking == "hybrid"
    e.reindex(encoder)
    assert len(list(calls.iterdir())) == len(made) + 1  # the query alone


def test_incremental_ingest(spark, tmp_path):
    from test_sources import put, said

    logs, v = tmp_path / "lo gs", vault(tmp_path / "vault")
    e = Engine(spark, f"file://{tmp_path}/data")
    for i in range(3):
        put(logs / "p[1]" / f"s{i}.jsonl", said("user", f"text {i}", sessionId=f"s{i}"))
    assert e.ingest("claude-code", f"file://{logs}", limit=2)["changed"] == 2 and e.docs().count() == 2
    assert e.ingest("claude-code", f"file://{logs}", limit=2)["changed"] == 0 and e.docs().count() == 2  # unchanged ones count
    assert e.ingest("claude-code", f"file://{logs}")["changed"] == 1 and e.docs().count() == 3
    put(logs / "p[1]" / "s0.jsonl", said("user", "text 0", sessionId="s0"), said("assistant", "answer", sessionId="s0", timestamp="2026-05-01T11:00:00.000Z"))
    assert e.ingest("claude-code", f"file://{logs}", dry_run=True)["replaced"] == 1
    assert e.ingest("claude-code", f"file://{logs}")["replaced"] == 1 and sorted(len(r.turns) for r in e.docs().collect()) == [1, 1, 2]
    for path in v.rglob("*.md"):
        path.write_text(path.read_text() + "\nsome text\n")
    first = e.ingest("memory", f"file://{v}")
    assert first["changed"] == first["files"] == first["added"] and e.ingest("memory", f"file://{v}")["changed"] == 0
    before = {r.conv_id: r.doc_id for r in e.docs().where("source = 'memory'").collect()}
    (v / "notes/projects.md").unlink()
    shop = v / "notes/shop.md"
    shop.write_text(shop.read_text() + "\n# Ganz anders\n")
    e.ingest("memory", f"file://{v}")
    after = {r.conv_id: r.doc_id for r in e.docs().where("source = 'memory'").collect()}
    assert set(before) - set(after) == {"notes/projects.md"} and e.docs().where("source = 'memory'").count() == len(after)


def test_remember_reads_the_note_in(spark, tmp_path):
    v = vault(tmp_path / "vault")
    e = Engine(spark, f"file://{tmp_path}/data")
    e.remember(v, "Idee", "ein zebra im text", "projects")
    assert e.search("zebra").count() == 1
    with pytest.raises(notes.NoteError):
        e.remember(v, "Kunde", "acme hat angerufen", "projects")
    e.remember(v, "Kunde", "acme hat angerufen", "private/INDEX", private=True)
    assert e.search("angerufen").count() == 0 and e.search("angerufen", include_nda=True).count() == 1


def test_leak_gate_and_layout(spark, tmp_path, claims_of):
    v = vault(tmp_path / "vault")
    e = Engine(spark, f"file://{tmp_path}/data")
    for path in v.rglob("*.md"):
        path.write_text(path.read_text() + "\nsome text\n")
    e.ingest("memory", f"file://{v}")
    assert e.leak_gate(f"file://{v}").count() == 0
    (v / "notes/shop.md").write_text("acme was here")
    (v / "private/new.md").write_text("a key: ghp_" + "a1" * 12)
    got = {(r.subject, r.reason) for r in e.leak_gate(f"file://{v}").collect()}
    assert got == {("notes/shop.md", "clean layer holds confidential text"), ("private/new.md", "secret in the private layer"), ("private/new.md", "private note without a document")}
    doc = e.docs().where("conv_id = 'notes/projects.md'").first().doc_id
    bad = claims_of(claim("Preise", text="globex zahlt", source=doc), claim("Preise", text="fine", source=doc), claim("Preise", source="gone"))
    assert sorted(r.reason for r in distill.store_leaks(bad, e.docs(), e.policy).collect()) == ["claim without a source", "clean claim holds confidential text"]

    (v / "stray.md").write_text("x")
    (v / "empty.md").write_text("")
    (v / "memory").mkdir(exist_ok=True)
    (v / "memory/raw.md").write_text("x")
    (v / "loose").mkdir()
    (v / "loose/a.md").write_text("x")
    errors = lambda: {(r.rel, r.error) for r in graph.layout_errors(spark, f"file://{v}").collect()}
    assert {(r, w) for r, w in errors() if r.startswith(".")} == {(".obsidian/app.json", "the editor's configuration is missing")}
    notes.replace_file(v / ".obsidian/app.json", '{"userIgnoreFilters": ["memory/", "private/memory/"]}')
    assert errors() == {("stray.md", "note at the root outside the graph"), ("empty.md", "empty placeholder at the root"), ("loose/a.md", "visible note outside the graph")}
    assert graph.ignore_filters('{"userIgnoreFilters": ["memory/"]}')[1] == ["userIgnoreFilters must hold private/memory/"]
    assert graph.ignore_filters("[")[1] and graph.ignore_filters("[]")[1]


def test_published_together_or_not(spark, tmp_path):
    e = Engine(spark, f"file://{tmp_path}/data")
    one = spark.range(1)
    e._publish({"claims": e._table(one), "reviews": e._table(one)})
    whole = e._manifest()

    def broken(path):
        raise OSError("disk full")

    with pytest.raises(OSError):
        e._publish({"claims": e._table(one), "reviews": broken})
    assert e._manifest() == whole


def test_note_fields():
    text = "---\na: 1\n# kept: as it is\nlist:\n  - x\nb: '2'\n---\nbody\n---\na: 3\n"
    n = notes.Note.parse(text)
    assert n.text() == text and n.get("a") == "1" and n.get("list") is None and n.get("none") is None
    assert n.put(a="9", c="4").text() == text.replace("a: 1", "a: 9").replace("b: '2'\n", "b: '2'\nc: 4\n")
    for bare in ("no front\n", "---\nnever closed\n", ""):
        assert notes.Note.parse(bare).text() == bare
        with pytest.raises(notes.NoteError):
            notes.Note.parse(bare).put(a="1")
    with pytest.raises(notes.NoteError):
        notes.Note.parse("---\na: 1\na: 2\n---\n").get("a")


def test_memory_routing(spark, tmp_path):
    from mnemoframe.operators import sync

    files = spark.createDataFrame([("a", "shop", "fine"), ("b", "new", "fine"), ("c", "shop", "Acmeware"), ("d", "shop", "ghp_" + "a" * 24), ("e", "shop", "fine"), ("f", None, None)], "path string, project string, text string")
    got = sync.route_memory(files, spark.createDataFrame([("shop",)], "project string"), spark.createDataFrame([("e",)], "path string"))
    assert {r.path: r.layer for r in got.collect()} == {"a": "clean", "b": "private", "c": "private", "d": "refused", "e": "private", "f": "private"}
    assert len(sync.init_vault(tmp_path)) == 5 and sync.init_vault(tmp_path) == []
    report, errors = graph.audit(graph.read_nodes(spark, f"file://{tmp_path}"))
    assert report.first().ok, errors.collect()


def test_landing_stream(spark, tmp_path):
    import json

    from mnemoframe.streaming import landing

    (tmp_path / "in").mkdir()
    rows = [{"source": "codex", "conv_id": "1", "project": "p", "idx": i, "role": "user", "ts": f"2026-01-01T0{i}:00:00Z", "text": "API_KEY=" + "abc123" * 5 if i else "hi"} for i in range(3)]
    (tmp_path / "in/a.json").write_text("\n".join(map(json.dumps, rows)))
    landing.write_documents(landing.read_turns(spark, str(tmp_path / "in")), str(tmp_path / "out"), str(tmp_path / "cp")).awaitTermination(60)
    got = spark.read.parquet(str(tmp_path / "out")).orderBy("idx").collect()
    assert [r.sensitivity for r in got] == ["clean", "nda", "nda"] and "abc123" not in got[1].text
    q = landing.activity(landing.read_turns(spark, str(tmp_path / "in"))).writeStream.outputMode("complete").format("memory").queryName("activity").trigger(availableNow=True).start()
    q.awaitTermination(60)
    assert spark.sql("select sum(turns) from activity").first()[0] == 3
