from __future__ import annotations

import sys
from pathlib import Path

import duckdb
import pytest

sys.path.insert(0, str(Path(__file__).parent))
import brute

import __spark_entry__

SMALL = "/root/testdata/sf0.001"


@pytest.fixture(scope="module")
def duck():
    con = duckdb.connect()
    for t in ("documents", "pages", "labels", "benchmark"):
        con.sql(f"create view {t} as select * from '{SMALL}/{t}.parquet'")
    return con


LLM = [n for n in __spark_entry__.queries() if n.startswith("op")]


@pytest.mark.parametrize("name", LLM)
def test_query(spark, duck, name):
    got = __spark_entry__.queries()[name](spark, SMALL).toPandas()
    sql = __spark_entry__.oracle_sql().get(name)
    assert len(got)
    if sql:
        cols = sorted(got.columns)
        plain = lambda f: sorted(str([None if x is None or x != x else x for x in r]) for r in f[cols].astype(object).where(f[cols].notna(), None).values.tolist())
        want = duck.sql(sql).df()
        assert sorted(want.columns) == cols and plain(got) == plain(want)


@pytest.fixture(scope="module")
def found(spark):
    """Rows of a query by doc_id, and the documents."""
    docs = {r.doc_id: r for r in spark.read.parquet(f"{SMALL}/documents.parquet").collect()}
    return lambda name: ({r.doc_id: r for r in __spark_entry__.queries()[name](spark, SMALL).collect()}, docs)


def test_op3_against_brute_force(found):
    got, docs = found("op3_pii")
    assert set(got) == set(docs)
    for i, r in got.items():
        base = brute.base_spans(docs[i].text)
        joined = ",".join(f"{k}:{a}:{z}" for k, a, z in base)
        assert r.base_sha256 == brute.sha256(joined) and [r.n_email, r.n_ip, r.n_card, r.n_phone] == [sum(k == x for k, *_ in base) for x in ("email", "ip", "card", "phone")]
        spans = [(k, int(a), int(z)) for k, a, z in (x.split(":") for x in r.spans.split(",") if x)]
        order = {k: n for n, (k, _) in enumerate(brute.PII)}
        assert set(base) <= set(spans) and spans == sorted(set(spans), key=lambda s: (s[1], order[s[0]])) and all(0 <= a < z <= len(docs[i].text or "") for _, a, z in spans)
        assert not [s for s in spans for b in base if s not in base and s[1] < b[2] and b[1] < s[2]]


def test_op4_against_the_library(spark, found):
    from mnemoframe.llm import spm

    got, docs = found("op4_sentencepiece")
    sp = spm._library(spm.model_bytes(spark))
    for i, r in got.items():
        ids = sp.encode(docs[i].text or "")
        assert (r.n_pieces, r.ids_sha256, r.round_trip) == (len(ids), brute.sha256(",".join(map(str, ids))), sp.decode(ids) == (docs[i].text or ""))
    assert set(got) == set(docs)


def test_op5_against_brute_force(found):
    got, docs = found("op5_simhash_dedup")
    fps = [(i, brute.fingerprint(r.text)) for i, r in sorted(docs.items())]
    least = brute.components(fps)
    assert {i: (r.fingerprint, r.component_id) for i, r in got.items()} == {i: (f"{f:016x}", least[i]) for i, f in fps}


def test_op6_against_brute_force(found):
    """Counts and base score by the definition; the model's score must be a probability and beat the base where the model hasn't trained."""
    import math

    got, docs = found("op6_lm_score")
    tokens = {i: [*brute.SPACED.findall(brute.lower_ascii(r.text)), "\n"] for i, r in docs.items()}
    count: dict = {}
    for i, own in tokens.items():
        for w in own if not brute.held_out(i) else ():
            count[w] = count.get(w, 0) + 1
    total, distinct = sum(count.values()), len(count)
    for i, r in got.items():
        assert (r.held_out, r.n_tokens, r.n_known, r.train_tokens) == (brute.held_out(i), len(tokens[i]), sum(w in count for w in tokens[i]), total)
        assert math.isclose(r.base_score, sum(math.log10((count.get(w, 0) + 0.1) / (total + 0.1 * (distinct + 1))) for w in tokens[i]), rel_tol=1e-9) and r.score <= 0
    assert set(got) == set(docs)
    assert sum(r.score for r in got.values() if r.held_out) > sum(r.base_score for r in got.values() if r.held_out)


def test_op7_against_brute_force(found):
    got, docs = found("op7_line_dedup")
    order = sorted(docs.items())
    for (i, r), text in zip(order, brute.line_dedup([(i, r.text) for i, r in order]), strict=True):
        assert (got[i].text_sha256, got[i].n_chars, got[i].n_lines) == (brute.sha256(text), len(text), len(r.text.split("\n")))
        assert got[i].n_lines - got[i].n_dropped == (len(text.split("\n")) if text or got[i].n_dropped < got[i].n_lines else 0)


def test_pipeline_stages(spark):
    import corpus_pipeline as cp
    from mnemoframe.llm.common import materialize, table

    docs = table(spark, SMALL, "documents")
    rows = {}
    for name, stage in cp.STAGES:
        before = docs
        docs = materialize(stage(spark, docs, SMALL), "stage")
        if name != "sentencepiece":
            assert docs.columns == before.columns
        rows[name] = docs.collect()
    kept = {r.doc_id for r in rows["quality rules"]}
    order = sorted(rows["quality rules"], key=lambda r: r.doc_id)
    texts = {r.doc_id: r.text for r in rows["line dedup"]}
    assert [texts[r.doc_id] for r in order] == brute.line_dedup([(r.doc_id, r.text) for r in order])
    fps = [(r.doc_id, brute.fingerprint(texts[r.doc_id])) for r in order]
    assert {r.doc_id for r in rows["near-dedup"]} == set(brute.components(fps).values())
    items = [(r.item_id, r.text) for r in table(spark, SMALL, "benchmark").collect()]
    survivors = [(r.doc_id, r.text) for r in rows["near-dedup"]]
    assert {r.doc_id for r in rows["decontamination"]} == {d for d, *_, bad in brute.contamination(survivors, items) if not bad}
    assert all(r.round_trip and r.n_pieces == len(r.ids) for r in rows["sentencepiece"]) and len(rows["sentencepiece"]) == len(rows["decontamination"]) and kept


def test_stages_take_any_rows(spark):
    """Each stage by itself: nulls in any column, empty and very long texts, repeated rows, names that clash, and no rows."""
    import corpus_pipeline as cp
    from mnemoframe.llm.common import table

    base = "\n".join(" ".join(f"w{i * 12 + k}ord" for k in range(12)) + f" end{i}" for i in range(9))
    item = table(spark, SMALL, "benchmark").orderBy("item_id").first().text
    texts = [base, base, base.replace("end3", "end4"), None, "", " \n\t", "x", base + "\n" + " ".join(f"w{i}" for i in range(40_000)), f"before {item} behind", "é▁é " * 30, base.upper()]
    rows = [(i, t, "en" if i % 2 else None, None if i % 3 else "s", len(t or ""), "c", 1, "c", "c") for i, t in enumerate(texts)]
    rows += [rows[0], (None, base, None, None, None, None, None, None, None), (None, None, None, None, None, None, None, None, None)]
    names = "doc_id bigint, text string, lang string, source string, n_chars bigint, _doc string, _row int, `a b` string, _hash string"
    docs = spark.createDataFrame(rows, names).repartition(3)
    for name, stage in cp.STAGES:
        out = stage(spark, docs, SMALL)
        got = out.collect()
        assert stage(spark, docs.where("false"), SMALL).count() == 0
        if name == "sentencepiece":
            assert out.columns == [c for c in docs.columns if c != "text"] + ["ids", "n_pieces", "round_trip"] and len(got) == len(rows)
            continue
        assert out.columns == docs.columns, name
        ids = sorted((r.doc_id is None, r.doc_id or 0) for r in got)
        if name == "quality rules":
            assert all(r.text for r in got) and len(got) >= 5
        elif name == "line dedup":
            assert len(got) == len(rows) and sum(r.text is None for r in got) == 2
            kept = [r.text for r in got if r.doc_id == 0]
            assert kept == [base, base]  # a row that repeats id and text keeps what it was
        elif name == "near-dedup":
            assert [i for _, i in ids if i in (0, 1, 3, 4, 5)] == [0, 3] and len(ids) == len(set(ids))
        else:
            assert len(got) == len(rows) - 1 and 8 not in {r.doc_id for r in got}
