from __future__ import annotations

import dataclasses
import datetime as dt

import pytest
from conftest import make_doc, turn

from mnemoframe.functions import text
from mnemoframe.operators import index as ix
from mnemoframe.operators import search as s
from mnemoframe.operators import segments as sg
from mnemoframe.plans.registry import hashed_encoder

TODAY = dt.date(2026, 7, 20)


def ids(df):
    return [r.doc_id for r in df.collect()]


@pytest.fixture(scope="module")
def index(docs_of):
    rows = [
        make_doc("user", [turn(0, "user", "wir nehmen postgres als datenbank"), turn(1, "assistant", "gut")]),
        make_doc("assistant", [turn(0, "user", "welche"), turn(1, "assistant", "nimm postgres als datenbank")]),
        make_doc("old", [turn(0, "user", "wir nehmen postgres als datenbank")], day="2025-07-01"),
        make_doc("title", [turn(0, "user", "etwas anderes")], title="kubernetes migration"),
        make_doc("hidden", [turn(0, "user", "geheimes kafka thema postgres datenbank")], sensitivity="nda"),
        make_doc("none", [turn(0, "user", "redis cache")], day=None, sensitivity="copyright"),
        make_doc("meta", [turn(0, "user", "c++ und 100% [x] (y)")]),
    ]
    return sg.build(docs_of(rows).cache())


def run(index, query, **how):
    return s.search(index, query, today=TODAY, **how)


def test_role_weight_and_recency(index):
    assert ids(run(index, "postgres datenbank", ranking="substring")) == ["user", "assistant", "old"]


def test_hidden_by_default(index):
    assert "hidden" not in ids(run(index, "kafka"))
    assert "hidden" in ids(run(index, "kafka", include_nda=True))


def test_hidden_full_match_keeps_partial_fallback(index):
    found = run(index, "kafka redis", ranking="substring").collect()
    assert [(r.doc_id, r.matched_terms, r.total_terms) for r in found] == [("none", 1, 2)]


def test_phrase_must_occur(index):
    assert ids(run(index, '"postgres als"')) == ["user", "assistant", "old"] or set(ids(run(index, '"postgres als"'))) == {"user", "assistant", "old"}
    assert ids(run(index, '"als postgres"')) == []


def test_terms_are_literal(index):
    assert ids(run(index, "[x]")) == ["meta"]
    assert ids(run(index, "100% (y)")) == ["meta"]


def test_function_words_fall_back_to_partial(index):
    assert "user" in ids(run(index, "wir als xyzzy", ranking="fused"))


def test_filters(index):
    assert set(ids(run(index, "postgres", since=dt.date(2026, 1, 1)))) == {"user", "assistant"}
    assert ids(run(index, "postgres", source="codex")) == []
    assert set(ids(run(index, "postgres", project="DEM"))) == {"user", "assistant", "old"}
    assert ids(run(index, "")) == [] and ids(run(index, "postgres", limit=0)) == []


def test_title_counts(index):
    assert ids(run(index, "kubernetes")) == ["title"]
    assert run(index, "kubernetes").first().snippet == "kubernetes migration"


def test_filter_before_depth_cut(docs_of):
    rows = [make_doc(f"n{i:03}", [turn(0, "user", "seltenwort " * 5)], sensitivity="nda") for i in range(120)] + [make_doc("seen", [turn(0, "user", "seltenwort und vieles mehr davon noch dazu")])]
    assert ids(run(sg.build(docs_of(rows)), "seltenwort")) == ["seen"]


def test_hybrid(index):
    vectors = ix.update_vectors(None, index.docs, hashed_encoder).cache()
    both = dataclasses.replace(index, vectors=vectors)
    assert "user" in ids(run(both, "postgres datenbank", ranking="hybrid", encoder=hashed_encoder))
    with pytest.raises(s.VectorsUnavailable):
        run(both, "postgres", ranking="hybrid")
    calls = []

    def counting(texts, query):
        calls.append(len(texts))
        return hashed_encoder(texts, query)

    again = ix.update_vectors(vectors, index.docs, hashed_encoder)
    assert again.count() == vectors.count()


def test_full_list_ranks_do_not_need_one_task(spark):
    rows = spark.createDataFrame([(f"d{i:04}", float(i % 7)) for i in range(500)], "doc_id string, score double")
    got = {r.doc_id: r.rank for r in s._by_count(rows).collect()}
    want = {r.doc_id: r.rank for r in s.ranked(rows, __import__("pyspark").sql.functions.desc("score")).collect()}
    assert got == want


def test_query_parser():
    assert text.parse_query('"speech recognition" polyglot') == (["speech recognition", "polyglot"], ["speech recognition"])
    assert text.parse_query('unbalanced "quote') == (["unbalanced", "quote"], [])
    assert text.parse_query('""') == ([], [])
    assert text.join_query(["a b", "c"]) == '"a b" c'


def test_timeline_and_get_doc(index):
    line = s.timeline(index.docs, limit=3).collect()
    assert [r.started_day for r in line] == sorted((r.started_day for r in line), reverse=True)
    assert ids(s.timeline(index.docs, limit=50))[-1] == "none"
    doc = s.get_doc(index.docs, "user", window=20).first()
    assert doc.body.startswith("## user") and doc.next_offset == 20
    assert s.get_doc(index.docs, "hidden").count() == 0
