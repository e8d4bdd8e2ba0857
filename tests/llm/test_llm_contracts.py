"""Operators against plain Python on small tables with nulls, empties, long texts, repeats and clashing columns."""

from __future__ import annotations

import base64
import functools
import hashlib
import math
import random
import re
import sys
from pathlib import Path

import numpy as np
import pytest
from pyspark.sql import functions as F

sys.path.insert(0, str(Path(__file__).parent))
import brute

from mnemoframe.llm import boosting, decontam, gru, licenses, lines, lm, pii, quality, simhash, spm, urls, warc
from mnemoframe.llm.graphs import components

WORDS = "the of and ing tion eau der die über été ñandú x1 42 foo bar baz qux".split()


def prose(rng, n):
    return " ".join(rng.choice(WORDS) + rng.choice(["", "", ".", "s"]) for _ in range(n))


@pytest.fixture(scope="module")
def texts():
    rng = random.Random(5)
    rows = [(i, prose(rng, rng.randint(1, 120))) for i in range(40)]
    base = prose(rng, 300)
    rows += [(40, base), (41, base), (42, base.replace("foo", "FOO", 1)), (43, base + " tail"), (44, None), (45, ""), (46, " \t\n"), (47, prose(rng, 20_000)), (41, base), (None, "no id here at all"), (48, "é"), (49, "one two three")]
    return rows


@pytest.fixture(scope="module")
def docs(spark, texts):
    rows = [(i, t, "en" if i is None or i % 2 else None, f"src{(i or 0) % 2}", len(t or ""), "x", 1, "clash") for i, t in texts]
    return spark.createDataFrame(rows, "doc_id bigint, text string, lang string, source string, n_chars bigint, n_words string, fingerprint int, `a b` string")


@pytest.fixture(scope="module")
def empty(docs):
    return docs.where("false")


def key(rows):
    return sorted(rows, key=repr)


# ---------------------------------------------------------------- 1 WARC


def test_warc_round_trip(spark, tmp_path):
    rng = np.random.default_rng(0)
    big = "".join(map(chr, rng.integers(32, 127, 300_000)))
    rows = [(1, "http://a/1", "same"), (2, None, "same"), (3, "http://a/3\nx", None), (4, "u", ""), (5, "u", big), (5, "u", big), (None, "u", "same"), (6, "ü", "für \r\n\r\n \x1f\u008b")]
    pages = spark.createDataFrame(rows, "page_id bigint, url string, html string").repartition(3)
    path = f"file://{tmp_path}/w"
    warc.write_warc(pages, path)
    for size in (1 << 20, 5000, 700):
        got = [(r.record_id, r.warc_type, r.refers_to_id, r.payload_digest, None if r.payload is None else bytes(r.payload).decode(), r.payload_length) for r in warc.read_warc(spark, path, size).collect()]
        assert len(got) == len(rows)
        digest = {i: base64.b32encode(hashlib.sha1((h or "").encode()).digest()).decode() for i, _, h in rows}
        by = {r[0]: r for r in got}
        assert by["<urn:page:2>"][1:] == ("response", None, digest[2], "same", 4)
        assert by["<urn:page:1>"][1:] == ("revisit", "<urn:page:2>", digest[1], None, 4)
        assert by["<urn:page:4>"][1:] == ("response", None, digest[4], "", 0) and by["<urn:page:3>"][1:3] == ("revisit", "<urn:page:4>")
        assert by["<urn:page:5>"][4] == big and sum(r[0] == "<urn:page:5>" and r[1] == "response" for r in got) == 2
        assert by["<urn:page:>"][1] == "response" and by["<urn:page:6>"][4] == rows[-1][2]
    assert warc.round_trip(pages.where("false")).count() == 0


def test_warc_reader_takes_plain_archives(spark, tmp_path):
    import gzip

    members = [gzip.compress(f"WARC/1.0\r\nWARC-Type: resource\r\nWARC-Record-ID: <urn:{i}>\r\nContent-Length: 5\r\n\r\nhell{i}\r\n\r\n".encode()) for i in range(9)]
    junk = warc.MAGIC + b"\0not a member"
    (tmp_path / "a.warc.gz").write_bytes(junk.join(members))
    got = warc.read_warc(spark, f"file://{tmp_path}/a.warc.gz", 64).collect()
    assert sorted(bytes(r.payload).decode() for r in got) == [f"hell{i}" for i in range(9)]


def test_warc_record_that_holds_an_archive(spark, tmp_path):
    """The stored archive's members lie in the file as they are, but belong to the record that holds them, whatever the ranges."""
    import gzip

    record = lambda i, body: f"WARC/1.0\r\nWARC-Type: resource\r\nWARC-Record-ID: <urn:{i}>\r\nContent-Length: {len(body)}\r\n\r\n".encode() + body + b"\r\n\r\n"
    noise = np.random.default_rng(2).bytes(30_000)
    inner = gzip.compress(record("inner", b"x" * 40)) + noise + gzip.compress(record("inner too", noise[:9000]), 0)
    outer = [gzip.compress(record("before", b"a")), gzip.compress(record("holder", noise + inner), 0), gzip.compress(record("after", b"z"))]
    (tmp_path / "a.warc.gz").write_bytes(b"".join(outer))
    for size in (1 << 20, 40_000, 10_000, 997):
        got = warc.read_warc(spark, f"file://{tmp_path}/a.warc.gz", size).collect()
        assert sorted(r.record_id for r in got) == ["<urn:after>", "<urn:before>", "<urn:holder>"], size


def test_warc_ids_may_be_text(spark):
    pages = spark.createDataFrame([("b", "u", "same"), ("a", "u", "same"), (None, "u", "x")], "page_id string, url string, html string")
    got = {r.record_id: r.refers_to_id for r in warc.round_trip(pages).collect()}
    assert got == {"<urn:page:b>": None, "<urn:page:a>": "<urn:page:b>", "<urn:page:>": None}


def test_long_member_keeps_its_end():
    member = warc._member(1, None, b"x" * (1 << 24), "D", None, 1)
    assert member[-1] == 0 and warc.EMPTY_MEMBER[-1] == 0


# ---------------------------------------------------------------- 2 decontamination


def test_contamination(spark, docs, texts, empty):
    rng = random.Random(1)
    long = texts[47][1].split()
    items = [(1, " ".join(long[100:140])), (2, texts[40][1][:200]), (3, "one two"), (4, None), (5, "  ,,"), (None, "no id"), (2, prose(rng, 30)), (7, "three"), (8, " ".join(long[100:140]).upper())]
    table = spark.createDataFrame(items, "item_id bigint, text string")
    got = decontam.contamination(docs, table).collect()
    assert key((r.doc_id, r.n_words, r.n_hit, list(r.item_ids), r.contaminated) for r in got) == key(brute.contamination(texts, items))
    assert decontam.contamination(docs, table.where("false")).where("contaminated").count() == 0
    assert decontam.contamination(empty, table).count() == 0
    kept = decontam.drop_contaminated(docs, table)
    assert kept.columns == docs.columns and kept.count() == sum(not r.contaminated for r in got)


# ---------------------------------------------------------------- 3 PII


def test_base_spans():
    rng = random.Random(3)
    alphabet = ["a", "@", ".", "b.c", "1", "12", "255", "300", "+", " ", "-", "(", ")", "4111111111111111", "x@y.org", "1.2.3.4", "+1 (555) 123-4567", "é", "_%"]
    for _ in range(1500):
        t = "".join(rng.choice(alphabet) for _ in range(rng.randint(1, 25)))
        assert pii.base_spans(t) == brute.base_spans(t), t
    assert pii.base_spans("a" * 200_000 + "@" + "1" * 200_000) == []


def test_pii(spark, docs, empty):
    rng = random.Random(2)

    def card(valid):
        while True:
            d = "".join(rng.choice("0123456789") for _ in range(16))
            if pii.luhn(d) == valid:
                return d

    rows = [(i, f"pay by card {card(i % 3 > 0)} or mail jo{i}@firm.org from {rng.randint(1, 254)}.2.3.{rng.randint(0, 400)} call +49 170 {rng.randint(1000000, 9999999)}") for i in range(120)] + [(900, None), (901, ""), (900, None)]
    table = spark.createDataFrame(rows, "doc_id bigint, text string")
    got = pii.find_pii(table).collect()
    assert key((r.doc_id, [tuple(s) for s in r.base]) for r in got) == key((i, brute.base_spans(t)) for i, t in rows)
    assert all({tuple(s) for s in r.base} <= {tuple(s) for s in r.spans} for r in got)
    clean = {r.doc_id: r.text for r in pii.redact(table).collect()}
    assert clean[900] is None and clean[901] == "" and "@" not in clean[1] and "[email]" in clean[1]
    assert pii.find_pii(empty).count() == 0 and pii.find_pii(docs).count() == docs.count()


def test_pii_beyond_base(spark):
    rng = random.Random(12)
    n = lambda k: "".join(rng.choice("123456789") for _ in range(k))
    w = lambda: "".join(rng.choice("abcdefghij") for _ in range(rng.randint(2, 7))) + rng.choice(["", n(2)])
    rows = []
    for i in range(300):
        rows.append((i, f"please call ({n(3)}) {n(3)}-{n(4)} or +1 ({n(3)}) {n(3)}-{n(4)} about order {n(9)} of 2024-03-1{i % 9} {n(2)}"))
        rows.append((1000 + i, f"mail {w()}@{w()}.org or {w()} at {w()} dot org, we meet at noon.then and look at page.three, build {n(8)}"))
    planted = [
        (5000, "the desk has (555) 123-4567 today", "phone", "(555) 123-4567"), (5001, "reach jo at firm dot org today", "email", "jo at firm dot org"), (5002, "reach jo[at]firm.org today", "email", "jo[at]firm.org"),
        (5003, "on 2024-03-11 (555) 987-6543 there", "phone", "(555) 987-6543"), (5004, "reach jo (at) firm (dot) com", "email", "jo (at) firm (dot) com"),
    ]
    clean = [(6000, "we meet at noon.then order 123456789 on 2024-03-11 12 of build 12345678"), (6001, "look at page.three and a1234567890b")]
    table = spark.createDataFrame(rows + [p[:2] for p in planted] + clean, "doc_id bigint, text string")
    got = {r.doc_id: [(s.kind, s.start, s.end) for s in r.spans] for r in pii.find_pii(table).collect()}
    for i, t, kind, s in planted:
        assert got[i] == [(kind, t.index(s), t.index(s) + len(s))], (t, got[i])
    assert got[6000] == got[6001] == []


def planted_pii(rng):
    """(text, spans beyond the base patterns): spelt-out addresses, other groupings, and numbers of other kinds."""
    n = lambda k: "".join(rng.choice("123456789") for _ in range(k))
    w = lambda: "".join(rng.choice("abcdefghij") for _ in range(rng.randint(3, 7)))

    def card(sep):
        d = next(x for x in ("4" + n(15) for _ in iter(int, 1)) if pii.luhn(x))
        return sep.join(d[i : i + 4] for i in range(0, 16, 4))

    parts, dot = [str(rng.randint(1, 254)) for _ in range(4)], rng.choice(["[.]", " dot ", "(dot)", "[dot]"])
    found = [
        ("email", f"mail {w()}@{w()}.org", ""), ("email", "contact ", w() + rng.choice([" at ", "[at]", " (at) "]) + w() + rng.choice([" dot ", "[dot]", " (dot) "]) + rng.choice(["org", "com", "net"])),
        ("phone", "call ", f"({n(3)}) {n(3)}-{n(4)}"), ("phone", "tel ", f"{n(3)}-{n(3)}-{n(4)}"), ("phone", f"fax +1 ({n(3)}) {n(3)}-{n(4)}", ""),
        ("card", "card ", card(rng.choice([".", "/"]))), ("card", "visa " + card(" "), ""), ("ip", "host ", dot.join(parts)), ("ip", "server " + ".".join(parts), ""),
    ]
    other = [f"order {n(9)}", f"build {n(8)}", f"on 2024-03-1{rng.randint(0, 9)} {n(2)}", f"version {rng.randint(300, 999)}.{n(3)}.{n(3)}.{n(2)}", f"look at page.{w()}", f"{w()} at {w()} then", f"id {n(4)}-{n(4)}-{n(4)}-{n(3)}"]
    pieces = [*rng.sample(found, 3), *(("", x, "") for x in rng.sample(other, 3))]
    rng.shuffle(pieces)
    text, spans = "", set()
    for kind, before, span in pieces:
        text += before
        if span:
            spans.add((kind, len(text), len(text) + len(span)))
        text += span + " , "
    return text, spans


def test_pii_recall_and_precision_by_kind(spark):
    """No label says where the planted spans are: they come from checks and the words around."""
    rng = random.Random(21)
    rows = [planted_pii(rng) for _ in range(1500)]
    docs = spark.createDataFrame([(i, t) for i, (t, _) in enumerate(rows)], "doc_id bigint, text string").repartition(4)
    got = {r.doc_id: ({tuple(s) for s in r.spans} - {tuple(s) for s in r.base}) for r in pii.find_pii(docs, keep=["doc_id"]).collect()}
    for kind in pii.KINDS:
        true, added = ({(i, *s) for i, of in enumerate(those) for s in of if s[0] == kind} for those in ([s for _, s in rows], [got[i] for i in range(len(rows))]))
        assert len(true) > 200 and len(true & added) >= 0.9 * len(true), (kind, len(true), len(true & added))
        assert len(true & added) >= 0.95 * len(added), (kind, len(added - true))


def test_labels_are_not_features():
    f = lambda t, kind: pii.features(t, kind, t.index(" ") + 1, len(t))
    assert f("mail jo@firm.org", 0) == f("abcd jo@firm.zzz", 0) == f("mail jo at firm dot org", 0)
    assert f("x 4111 1111 1111 1111", 2) == f("card 4111 1111 1111 1112", 2)
    assert pii.features("12 34 56", 3, 0, 2)[pii._GOES_ON] == 1 and pii.features("12 34 56", 3, 6, 8)[pii._GOES_ON] == 0
    assert f("tel +1 (555) 123-4567", 3) == f("x 1 (555) 123-4567", 3)
    assert f("x 10.20.30.140", 1) == f("x 10.20.30.999", 1) == f("ip 10.20.30[.]140", 1)


def test_boosting_held_out():
    rng = np.random.default_rng(0)
    x = rng.normal(size=(3000, 5))
    y = ((x[:, 0] > 0) ^ (x[:, 1] > 0)).astype(int)
    model = boosting.fit(x[:2000], y[:2000])
    p = model.probability(x[2000:])
    assert ((p > 0.5) == y[2000:]).mean() > 0.9
    assert abs(p.mean() - y[2000:].mean()) < 0.1
    assert boosting.threshold(np.array([0.9, 0.8, 0.2]), np.array([1, 0, 0]), 0.9) == 0.9


def labelled(spark, forms, parts):
    """Scanned rows of a candidate each: (features, its candidates, those of label 1)."""
    rows = [(i, [(0, i % 97, 0, [float(v) for v in x], int(j < pos), 0.0)]) for i, (x, j, pos) in enumerate((x, j, pos) for x, n, pos in forms for j in range(n))]
    return spark.createDataFrame(rows, "id bigint, _cand array<struct<kind:int, a:int, z:int, x:array<float>, y:int, r:float>>").repartition(parts, "id")


def test_detector_is_fitted_on_all_candidates(spark):
    forms = [([0, 1, 5], 15_000, 14_999), ([0, 2, 5], 12_000, 30), ([3, 2, 7], 3_000, 2_995), ([3, 3, 7], 1_111, 0), ([3, 4, 7], 3, 3)]
    n, pos = sum(f[1] for f in forms), sum(f[2] for f in forms)
    some, other = (pii.train(labelled(spark, forms, parts)) for parts in (2, 7))
    assert some.trees.base == pytest.approx(np.log(pos / (n - pos)), abs=1e-12)
    assert [t.tolist() for t in some.trees.leaf] == [t.tolist() for t in other.trees.leaf] and some.limit == other.limit
    p = some.trees.probability(np.array([f[0] for f in forms], float))
    assert (p[[0, 2]] > 0.98).all() and (p[[1, 3]] < 0.02).all() and p[0] >= some.limit[0] > p[1] and p[2] >= some.limit[3] > p[3]


def test_trees_of_a_table_are_those_of_its_rows(spark):
    rng = np.random.default_rng(5)
    x = rng.integers(0, 12, size=(2500, 3)).astype(float)
    y = (rng.random(2500) < np.where((x[:, 0] > 5) ^ (x[:, 1] > 3), 0.9, 0.2)).astype(int)
    rows = spark.createDataFrame([(a, i % 3, 1, b) for i, (a, b) in enumerate(zip(x.tolist(), y.tolist(), strict=True))], "x array<float>, fold int, n bigint, pos bigint")
    trees, tally = boosting.fit_table(rows.groupBy("x", "fold").agg(F.sum("n").alias("n"), F.sum("pos").alias("pos")).repartition(5), 3, rounds=12)
    # numpy keeps every fourth row aside, so each fourth is one that the table hasn't.
    spread = np.flatnonzero(np.arange(len(y) * 4 // 3) % 4 != 3)
    tx, ty = np.zeros((spread[-1] + 1, 3)), np.zeros(spread[-1] + 1, int)
    tx[spread], ty[spread], ty[3] = x[: len(spread)], y[: len(spread)], 1
    assert len(spread) == len(y)
    plain = boosting.fit(tx, ty, rounds=12)
    np.testing.assert_allclose(trees.margin(x), plain.margin(x), atol=1e-9)
    assert tally["n"].sum() == 2500 and tally["pos"].sum() == y.sum()
    assert boosting.fit_table(rows.where("pos = 1"), 3) is None and boosting.fit_table(rows.limit(0), 3) is None


# ---------------------------------------------------------------- 4 SentencePiece


@pytest.fixture(scope="module")
def proto(spark):
    return spm.model_bytes(spark)


def test_spm_is_the_library(spark, docs, empty, proto):
    back = spm.round_trip(docs, proto, giant=300, chunk=64).collect()
    sp = spm._library(proto)
    assert len(back) == docs.count()
    assert all(list(r.ids) == sp.encode(r.text or "") and r.same for r in back)
    assert spm.round_trip(empty, proto).count() == 0


def test_lattice_is_the_library(proto):
    lat, sp, rng = spm._lattice(proto), spm._library(proto), random.Random(4)

    def coded(t, chunk):
        s = lat.prefix + t.replace(" ", spm.SPACE)
        parts = [(s[max(a - lat.longest, 0) : min(a + chunk, len(s)) + lat.longest], min(a, lat.longest), min(a, lat.longest) + min(chunk, len(s) - a)) for a in range(0, len(s), chunk)]
        ms = [lat.matrix(*p, k == 0) for k, p in enumerate(parts)]
        prefix = [ms[0]]
        for m in ms[1:]:
            prefix.append(spm.product(prefix[-1], m))
        out = [next(j for j, r in enumerate(prefix[-1]) if r)]
        for m, before in zip(reversed(ms[1:]), reversed(prefix[:-1]), strict=True):
            out.append(next(k for k in m[out[-1]] if before[k]))
        out.reverse()
        return [i for k, (p, e, x) in enumerate(zip(parts, [0, *out[:-1]], out, strict=True)) for i in lat.ids(lat.trace(*p, e, x, k == 0))]

    for _ in range(400):
        t = "".join(rng.choice(["a", "aa", "the", "ing", " ", "  ", "é", "日", "😀", "\n", "=", "1"]) for _ in range(rng.randint(1, 60)))
        assert coded(t, rng.choice([3, 7, 20, 500])) == sp.encode(t)


def test_spm_models_of_other_kinds(spark, proto):
    """Without byte fallback a run of unknown characters is one piece, behind a cut as well; what can't be split is refused before any text is read."""
    model = spm.model_pb.ModelProto.FromString(proto)
    model.trainer_spec.byte_fallback = False
    kept = [p for p in model.pieces if p.type != spm.model_pb.ModelProto.SentencePiece.BYTE]
    del model.pieces[:]
    model.pieces.extend(kept)
    plain = model.SerializeToString()
    sp = spm.sentencepiece.SentencePieceProcessor(model_proto=plain)
    rng = random.Random(6)
    rows = [(i, "".join(rng.choice(["abc", " ", "\u6f22\u5b57" * rng.randint(1, 30), "\U0001f600", "the"]) for _ in range(rng.randint(1, 40)))) for i in range(30)] + [(90, "abc \u6f22\u5b57\u6f22\u5b57 def"), (91, "\u6f22" * 200)]
    docs = spark.createDataFrame(rows, "doc_id bigint, text string")
    for r in spm.encode(docs, plain, giant=20, chunk=16).collect():
        assert list(r.ids) == sp.encode(r.text), r.text
    model.trainer_spec.model_type = spm.model_pb.TrainerSpec.UNIGRAM
    other = model.SerializeToString()
    with pytest.raises(ValueError, match="giant=None"):
        spm.encode(docs, other)
    whole = spm.sentencepiece.SentencePieceProcessor(model_proto=other)
    assert all(list(r.ids) == whole.encode(r.text) for r in spm.encode(docs, other, giant=None).collect())


# ---------------------------------------------------------------- 5 SimHash


def test_simhash(spark, docs, texts, empty):
    got = simhash.near_duplicates(docs).collect()
    want = brute.components(sorted({(i, brute.fingerprint(t)) for i, t in texts if i is not None}))
    assert {(r.doc_id, r.fingerprint & (2**64 - 1)) for r in got} == {(i, brute.fingerprint(t)) for i, t in texts}
    assert {r.doc_id: r.component_id for r in got if r.doc_id is not None} == want
    kept = simhash.keep_one(docs)
    assert kept.columns == docs.columns and kept.count() == len(set(want.values())) + 1
    assert simhash.near_duplicates(empty).count() == 0 and simhash.keep_one(empty).count() == 0


@pytest.mark.parametrize("group", [2048, 8])
def test_links_are_complete(spark, group):
    rng = random.Random(6)
    centres = [rng.getrandbits(64) for _ in range(60)]
    fps = {c for c in centres}
    for c in centres[:30]:
        for _ in range(20):
            for b in rng.sample(range(64), rng.randint(1, 4)):
                fps.add(c ^ (1 << b))
            x = c
            for b in rng.sample(range(64), 4):
                x ^= 1 << b
            fps.add(x)
    rows = [(f - (1 << 64) if f >> 63 else f,) for f in fps]
    edges = simhash.link_edges(spark.createDataFrame(rows, "fp bigint"), group=group)
    roots = {r.node: r.root for r in components(edges).collect()}
    signed = [f for (f,) in rows]
    want = brute.components([(f, f & (2**64 - 1)) for f in sorted(signed)])
    assert {f: roots.get(f, f) for f in signed} == want


def test_index_finds_all_pairs():
    rng = np.random.default_rng(1)
    code = rng.integers(0, 1 << 63, 200, dtype=np.uint64)
    code = np.concatenate([code, code[:100] ^ np.uint64(1 << 40), code[:50] ^ np.uint64((1 << 3) | (1 << 60) | (1 << 33) | 1)])
    code = code[np.lexsort((simhash._gray_rank(code),))]
    u, v = simhash.links_of(np.zeros(len(code), np.int64), code)
    far = np.bitwise_count(code[:, None] ^ code[None, :])
    assert {(min(a, b), max(a, b)) for a, b in zip(u.tolist(), v.tolist(), strict=True)} == {(i, j) for i, j in zip(*np.where(far <= 4), strict=True) if i < j}


def test_gray_order_matters():
    """Neighbours in Gray order share more, so that fewer pairs of nodes are compared than in numeric order; the links are the same."""
    for seed, bits in ((1, 42), (2, 20)):
        rng = np.random.default_rng(seed)
        code = rng.integers(0, 1 << bits, 60, dtype=np.uint64)[rng.integers(0, 60, 1500)] << np.uint64(64 - bits)
        for _ in range(3):
            code ^= np.uint64(1) << rng.integers(64 - bits, 64, 1500).astype(np.uint64)
        code, found = np.unique(code), {}
        for name, rank in (("gray", simhash._gray_rank(code)), ("numeric", code)):
            own, visited = code[np.argsort(rank, kind="stable")], []
            u, v = simhash.links_of(np.zeros(len(own), np.int64), own, 4, visited)
            found[name] = sum(visited), {tuple(sorted(p)) for p in zip(own[u].tolist(), own[v].tolist(), strict=True)}
        assert found["gray"][1] == found["numeric"][1]
        assert found["gray"][0] < 0.95 * found["numeric"][0] < 0.95 * len(code) ** 2


def test_index_nodes_hold_what_their_members_share():
    rng = np.random.default_rng(3)
    root = np.repeat([0, 1, 2], [1, 50, 7])
    code = rng.integers(0, 1 << 63, 58, dtype=np.uint64) & np.uint64(0x0F0F_FFFF_0000_00FF)
    levels = simhash.index_of(root, code)
    members = [{i} for i in range(58)]
    for level in levels[1:]:
        members = [set().union(*members[a : a + n]) for a, n in zip(level.first, level.count, strict=True)]
        assert [len({int(root[i]) for i in m}) for m in members] == [1] * len(members)
        for m, bits, mask in zip(members, level.bits.tolist(), level.mask.tolist(), strict=True):
            own = [int(code[i]) for i in m]
            same = ~(max_or(own) ^ max_and(own)) & (1 << 64) - 1
            assert mask == same and bits == own[0] & same
    assert [len(m) for m in members] == [1, 50, 7]


def max_or(xs):
    return functools.reduce(lambda a, b: a | b, xs)


def max_and(xs):
    return functools.reduce(lambda a, b: a & b, xs)


def test_components_of_a_chain(spark):
    edges = spark.createDataFrame([(i, i + 1) for i in range(200)] + [(500, 501)], "u bigint, v bigint")
    assert {r.node: r.root for r in components(edges).collect()} == {i: 0 for i in range(1, 201)} | {501: 500}


# ---------------------------------------------------------------- 6 LM


def test_lm(spark, docs, texts, empty):
    got = lm.score_texts(docs, keep=["doc_id", "text"], vocabulary=50, block_bytes=20_000).collect()
    assert len(got) == len(texts)
    count: dict = {}
    tokens = lambda t: [*brute.SPACED.findall(brute.lower_ascii(t)), "\n"]
    for i, t in texts:
        if not brute.held_out(i):
            for w in tokens(t):
                count[w] = count.get(w, 0) + 1
    total, distinct = sum(count.values()), len(count)
    for r in got:
        own = tokens(r.text)
        assert (r.held_out, r.n_tokens, r.n_known, r.train_tokens) == (brute.held_out(r.doc_id), len(own), sum(w in count for w in own), total)
        assert math.isclose(r.base_score, sum(math.log10((count.get(w, 0) + 0.1) / (total + 0.1 * (distinct + 1))) for w in own), rel_tol=1e-9)
        assert math.isfinite(r.score) and r.score <= 0
    assert lm.score_texts(empty).count() == 0
    alone = lm.score_texts(spark.createDataFrame([(i, "a b") for i in range(60) if brute.held_out(i)], "doc_id bigint, text string")).first()
    assert alone.train_tokens == 0 and alone.base_score == 0.0 and alone.n_known == 0


def test_lm_words_end_at_ascii_spaces_alone(spark):
    odd = "A\x0bb\x0cc\x1cd\x85e\xa0F\u2028g  h\t\ni\rj\x00k \u00c9"
    got = lm.score_texts(spark.createDataFrame([(i, odd) for i in range(20)], "doc_id bigint, text string")).collect()
    assert {r.n_tokens for r in got} == {len(brute.SPACED.findall(odd)) + 1} and {r.n_known for r in got} == {r.n_tokens for r in got}


def test_lm_trains_on_every_token(docs, texts):
    train = [i for i, _ in texts if not brute.held_out(i)]
    blocks = lm._blocks(docs, "text", "doc_id", [], 20_000)
    total = sum(len(brute.SPACED.findall(t or "")) + 1 for i, t in texts if not brute.held_out(i))
    model = lm.train(blocks, lm.Model(["the", "of", lm.END], [300, 300, len(train)], total, 99))
    assert model.trained == total


def test_lm_carries_the_state_through_a_text():
    n = np.array([5, 100, 1, 33, 64, 700, 32])
    start, chosen = np.concatenate([[0], np.cumsum(n)]), np.array([True, True, True, False, True, True, True])
    begin, end, fresh = lm._lanes(start, chosen)
    seen = np.zeros(start[-1], int)
    for k in range(begin.shape[1]):
        last = None
        for b, e, f in zip(begin[:, k], end[:, k], fresh[:, k], strict=True):
            if e > b:
                seen[b:e] += 1
                assert bool(f) == (b in start[:-1]) and (f or b == last)
                last = e
    assert (seen == np.repeat(chosen, n)).all()


def test_lm_scores_are_those_of_each_text_alone():
    m = lm.Model(["a", "b", lm.END], [5, 3, 2], 14, 5)
    rng = np.random.default_rng(1)
    m.params = {k: v + (rng.standard_normal(v.shape) * 0.2).astype(np.float32) for k, v in m.params.items()}
    n = np.array([40, 1, 700, 33, 64, 2])
    item, start = rng.integers(0, 4, n.sum()).astype(np.int32), np.concatenate([[0], np.cumsum(n)])
    got = lm._text_scores(m, item, start, gru.Room())
    table = gru.gate_table(m.params)
    for i, (a, z) in enumerate(zip(start[:-1], start[1:], strict=True)):
        h, last, want = np.zeros((1, gru.HIDDEN), np.float32), m.item[lm.END], 0.0
        for k in item[a:z]:
            h = gru.unroll(m.params, table, np.array([[last]]), h, gru.Room())["states"][1]
            want, last = want + float(gru.log_probability(m.params, m.bounds, h, np.array([k]), gru.Room())[0]), k
        assert math.isclose(got[i], want, rel_tol=1e-4)


def test_lm_long_texts_do_not_spoil_the_model():
    """A text far longer than the others is left alone in its lane at the end; its updates must not outweigh what all texts have taught."""
    rng = np.random.default_rng(0)
    m = lm.Model(["a", "b", "c", lm.END], [4000, 4000, 4000, 100], 12_100, 4)
    by_turns = np.array([m.item[w] for w in "abc"], np.int32)
    texts = [by_turns[(np.arange(120) + rng.integers(3)) % 3] for _ in range(100)] + [np.full(9000, m.item["a"], np.int32)]
    item, start = np.concatenate(texts), np.concatenate([[0], np.cumsum([len(t) for t in texts])])
    adam, room = gru.Adam({k: v.copy() for k, v in m.params.items()}), gru.Room()
    before = lm._text_scores(m, item[:12_000], start[:101], room).sum()
    for _ in range(3):
        assert lm._train_on(adam, m.bounds, item, start, np.ones(len(texts), bool), m.item[lm.END], room) == len(item)
    m.params = adam.p
    assert lm._text_scores(m, item[:12_000], start[:101], room).sum() > 0.8 * before


def test_gru_gradients_and_learning():
    rng = np.random.default_rng(0)
    bounds = gru.classes_of(np.arange(9.0, 0.0, -1.0), 4)
    assert bounds[:2].tolist() == [0, 1] and bounds[-1] == 9 and len(bounds) == 5
    p = {k: v.astype(np.float64) for k, v in gru.fresh(np.arange(9.0, 0.0, -1.0), bounds).items()}
    p = {k: v + rng.normal(size=v.shape) * 0.1 for k, v in p.items()}
    x, y, live, h = rng.integers(0, 9, (6, 4)), rng.integers(0, 9, (6, 4)), rng.random((6, 4)) > 0.2, rng.normal(size=(4, gru.HIDDEN)) * 0.1

    def loss(q):
        states = gru.unroll(q, gru.gate_table(q), x, h, gru.Room(np.float64))["states"]
        return -sum((gru.log_probability(q, bounds, s, i, gru.Room(np.float64)) * v).sum() for s, i, v in zip(states[1:], y, live, strict=True))

    d, _ = gru.gradients(p, bounds, x, y, live, h, gru.Room(np.float64))
    again, _ = gru.gradients(p, bounds, x, y, live, h, gru.Room(np.float64), {k: v.copy() for k, v in d.items()})
    assert all(np.allclose(again[k], 2 * d[k]) for k in d)  # added to what is there
    for k in p:
        at = {"E": (int(x[2, 1]), 3), "O": (int(y[live][0]), 2), "bo": (int(y[live][0]),)}.get(k) or tuple(rng.integers(0, n) for n in p[k].shape)
        up, down = ({a: b.copy() for a, b in p.items()} for _ in range(2))
        up[k][at] += 1e-4
        down[k][at] -= 1e-4
        assert abs((loss(up) - loss(down)) / 2e-4 - d[k][at]) < 1e-6, k


def test_lm_probabilities_sum_to_one():
    m = lm.Model(["a", "b", lm.END], [5, 3, 2], 14, 5)
    h = np.random.default_rng(0).normal(size=(1, gru.HIDDEN)).astype(np.float32)
    p = np.exp(gru.log_probability(m.params, m.bounds, np.repeat(h, 4, 0), np.arange(4), gru.Room()))
    assert abs(p.sum() - 1) < 1e-5
    # Two words of the rest with 3 and 1 tokens, and one slot for those unseen.
    assert abs(sum((c + 0.1) / (m.rest + 0.1 * (m.rest_distinct + 1)) for c in (3, 1, 0)) - 1) < 1e-9


def test_lm_beats_unigrams_on_held_out_text(spark):
    rng = random.Random(7)
    a, b = [f"a{i}" for i in range(30)], [f"b{i}" for i in range(30)]
    rows = [(i, " ".join(rng.choice(a if i % 2 else b) for _ in range(150))) for i in range(600)]
    got = lm.score_texts(spark.createDataFrame(rows, "doc_id bigint, text string")).where("held_out").agg(F.sum("score"), F.sum("base_score")).first()
    assert got[0] > got[1]


# ---------------------------------------------------------------- 7 lines


def test_line_dedup(spark, empty):
    rng = random.Random(8)
    pool = ["".join(rng.choice("abcdef ") for _ in range(rng.randint(15, 60))) for _ in range(25)] + ["short", "shorx", "", "  "]

    def edited(s):
        k, i = rng.randint(0, 3), rng.randint(0, max(len(s) - 1, 0))
        return s if k == 0 or not s else s[:i] + s[i + 1 :] if k == 1 else s[:i] + "z" + s[i:] if k == 2 else s[:i] + "y" + s[i + 1 :]

    rows = [(i, "\n".join(edited(rng.choice(pool)) for _ in range(rng.randint(0, 12)))) for i in range(60)] + [(60, None), (61, "x" * 50_000), (62, "x" * 49_999)]
    table = spark.createDataFrame([(i, t, len(t or ""), "k") for i, t in rows], "doc_id bigint, text string, n_chars bigint, line string").repartition(5)
    got = sorted(lines.dedup_lines(table, report=True).collect(), key=lambda r: r.doc_id)
    assert [r.text for r in got] == brute.line_dedup(rows)
    assert all(r.n_chars == len(r.text or "") for r in got)
    exact = lines.dedup_lines(table, max_edits=0)
    assert exact.columns == table.columns and exact.count() == len(rows)
    assert lines.dedup_lines(empty).count() == 0


def test_line_dedup_of_repeated_rows_and_null_ids(spark):
    rows = [(1, "a line that is long enough"), (1, "a line that is long enough"), (None, "a line that is long enough\nb"), (2, "b")]
    got = sorted(((r.doc_id, r.text) for r in lines.dedup_lines(spark.createDataFrame(rows, "doc_id bigint, text string")).collect()), key=repr)
    assert got == [(1, rows[0][1]), (1, rows[0][1]), (2, "b"), (None, "")]


def test_line_dedup_of_short_lines_and_text_ids(spark):
    rows = [("b", "ab\nabc\nq"), ("a", "ax\nzz\nabc"), (None, "zz\nnew\nb"), ("c", "abcd\n1\n2")]
    table = spark.createDataFrame(rows, "doc_id string, text string")
    order = sorted(rows, key=lambda r: (r[0] is None, r[0] or ""))
    for least in (0, 3, 20):
        got = {r.doc_id: r.text for r in lines.dedup_lines(table, min_fuzzy=least).collect()}
        assert [got[i] for i, _ in order] == brute.line_dedup(order, least), least


def test_within_one():
    rng = random.Random(9)
    for _ in range(3000):
        a, b = ("".join(rng.choice("ab") for _ in range(rng.randint(0, 5))) for _ in range(2))
        assert lines.within_one(a, b) == brute.near(a, b), (a, b)


# ---------------------------------------------------------------- 8 URLs


def test_urls(spark):
    rows = [
        (1, "https://www.Example.ORG/es/1?b=2&utm_source=x&a=1#f"), (2, "http://a.example.org/en/12"), (3, "http://example.com/fr/"), (4, "http://example.com/de/x"), (5, "http://notexample.org"), (6, None), (7, "no url"),
        (8, "http://bad.net/p/?ref=1"), (9, "http://BAD.net/p"), (10, "http://bad.net/q"), (8, "http://bad.net/p/?ref=1"), (11, "x://h?q://z/"), (12, ""),
    ]
    listed = spark.createDataFrame([("bad.net/p",), (None,), ("",), ("bad.net/p",)], "u string")
    got = urls.filter_urls(spark.createDataFrame(rows, "page_id bigint, url string").withColumn("host", F.lit("clash")), listed).collect()
    by = {r.page_id: (r.host, r.path, r.rule, r.verdict, r.canonical_url) for r in got}
    assert len(got) == len(rows)
    assert by[1] == ("www.example.org", "/es/1", "example.org/es/", "block", "example.org/es/1?a=1&b=2")
    assert by[2][2:4] == ("example.org/en/1", "block") and by[3][2:4] == ("com/fr/", "allow") and by[4][2:4] == ("com/de/", "block")
    assert by[5][2:4] == (None, "allow") and by[6] == by[7] == by[12] == ("", "", None, "allow", "")
    assert by[8][3] == by[9][3] == "block" and by[10][3] == "allow" and by[11][:2] == ("h", "")
    plain = spark.createDataFrame(rows, "page_id bigint, url string")
    none = urls.filter_urls(plain, listed.where("false"))
    assert none.where("listed").count() == 0 and none.count() == len(rows)
    assert urls.filter_urls(plain.where("false"), listed).count() == 0
    # Beyond the bounds, and with columns named like those inside.
    clash = plain.select("*", *[F.lit(c).alias(c) for c in ("u", "r", "possible", "hit", "block", "_block", "_h", "a b")])
    want = key((*r, "u", "hit", "a b") for r in urls.filter_urls(plain, listed).collect())
    for bounds in ({"filter_bytes": 0}, {"broadcast_urls": 0}, {"filter_bytes": 0, "broadcast_urls": 0}):
        got = urls.filter_urls(clash, listed, **bounds)
        assert key(got.select("page_id", "url", "host", "path", "canonical_url", "rule", "verdict", "listed", "u", "hit", "`a b`").collect()) == want


def test_url_filter_at_some_size(spark):
    """Very long URLs, many listed ones, one URL for a third of all rows: the filter loses none and the exact join lets no other through."""
    rows = [(i, f"http://h{i % 97}.net/p{i}" + "x" * (60_000 if i % 500 == 0 else 0)) for i in range(3000)] + [(5000 + i, "http://h1.net/p1") for i in range(1500)]
    table = spark.createDataFrame(rows, "page_id bigint, url string")
    listed = table.where("page_id % 3 = 1").select(urls.canonical(F.col("url")).alias("l"))
    bad = {r.l for r in listed.collect()}
    for bounds in ({}, {"filter_bytes": 0, "broadcast_urls": 0}):
        got = urls.filter_urls(table, listed, **bounds).collect()
        assert len(got) == len(rows) and all(r.listed == (r.canonical_url in bad) and (r.verdict == "block") == r.listed for r in got)
    names = listed.select(F.col("l").alias("u")).distinct()
    others = spark.range(20_000).select(F.concat(F.lit("other.net/"), "id").alias("u"))
    assert urls.possible(others, names, names.count()).where("possible").count() < 600  # 16 bits a URL let a few in a hundred through at most


# ---------------------------------------------------------------- 9 licences


def test_licenses(spark, docs, empty):
    rows = [
        (1, "Intro.\nReleased under the MIT License.\nMore"), (2, "Licensed under the Apache License, Version 2.0. You may not use this file except in compliance with the License. You may obtain a copy of the License at http://www.apache.org/licenses/LICENSE-2.0."),
        (3, None), (4, ""), (5, "licence to kill"), (6, "All rights reserved.\nLicensed under CC BY-NC 4.0."), (1, "Intro.\nReleased under the MIT License.\nMore"),
    ]
    got = {r.doc_id: (r.license_sentences, r.licenses, r.license, r.n_license_sentences) for r in licenses.scan_licenses(spark.createDataFrame(rows, "doc_id bigint, text string")).collect()}
    assert got[1] == ("mit.released", "MIT", "MIT", 1) and got[2] == ("apache2.notice,apache2.use,apache2.copy", "Apache-2.0", "Apache-2.0", 3)
    assert got[3] == got[4] == got[5] == ("", "", None, 0) and got[6][1:3] == ("CC-BY-NC-4.0,proprietary", "CC-BY-NC-4.0")
    assert licenses.scan_licenses(empty).count() == 0 and licenses.scan_licenses(docs).count() == docs.count()
    clash = spark.createDataFrame(rows, "doc_id bigint, text string").select("*", *[F.lit(c).alias(c) for c in ("_ids", "_seq", "_found", "ids", "seq", "found", "r", "t", "license")])
    again = licenses.scan_licenses(clash).where("doc_id = 1").first()
    assert [again[c] for c in ("_ids", "_seq", "_found", "ids", "seq", "found", "r", "t")] == ["_ids", "_seq", "_found", "ids", "seq", "found", "r", "t"] and again.license == "MIT"


APACHE = """Copyright 2020 Some Author

Licensed under the Apache License, Version 2.0 (the "License");
you may not use this file except in compliance with the License.
You may obtain a copy of the License at

    http://www.apache.org/licenses/LICENSE-2.0

Unless required by applicable law or agreed to in writing, software
distributed under the License is distributed on an "AS IS" BASIS,
WITHOUT WARRANTIES OR CONDITIONS OF ANY KIND, either express or implied.
See the License for the specific language governing permissions and
limitations under the License."""
MIT = """MIT License

Copyright (c) 2020 Some Author

Permission is hereby granted, free of charge, to any person obtaining a copy
of this software and associated documentation files (the "Software"), to deal
in the Software without restriction, including without limitation the rights
to use, copy, modify, merge, publish, distribute, sublicense, and/or sell
copies of the Software, and to permit persons to whom the Software is
furnished to do so, subject to the following conditions:

The above copyright notice and this permission notice shall be included in all
copies or substantial portions of the Software.

THE SOFTWARE IS PROVIDED "AS IS", WITHOUT WARRANTY OF ANY KIND, EXPRESS OR
IMPLIED, INCLUDING BUT NOT LIMITED TO THE WARRANTIES OF MERCHANTABILITY,
FITNESS FOR A PARTICULAR PURPOSE AND NONINFRINGEMENT. IN NO EVENT SHALL THE
AUTHORS OR COPYRIGHT HOLDERS BE LIABLE FOR ANY CLAIM, DAMAGES OR OTHER
LIABILITY, WHETHER IN AN ACTION OF CONTRACT, TORT OR OTHERWISE, ARISING FROM,
OUT OF OR IN CONNECTION WITH THE SOFTWARE OR THE USE OR OTHER DEALINGS IN THE
SOFTWARE."""
GPL = """This program is free software: you can redistribute it and/or modify
it under the terms of the GNU General Public License as published by
the Free Software Foundation, either version 3 of the License, or
(at your option) any later version.

This program is distributed in the hope that it will be useful,
but WITHOUT ANY WARRANTY; without even the implied warranty of
MERCHANTABILITY or FITNESS FOR A PARTICULAR PURPOSE.  See the
GNU General Public License for more details.

You should have received a copy of the GNU General Public License
along with this program.  If not, see <https://www.gnu.org/licenses/>."""
BSD = """Redistribution and use in source and binary forms, with or without
modification, are permitted provided that the following conditions are met:

1. Redistributions of source code must retain the above copyright notice, this
   list of conditions and the following disclaimer.

2. Redistributions in binary form must reproduce the above copyright notice,
   this list of conditions and the following disclaimer in the documentation
   and/or other materials provided with the distribution.

3. Neither the name of the copyright holder nor the names of its
   contributors may be used to endorse or promote products derived from
   this software without specific prior written permission.

THIS SOFTWARE IS PROVIDED BY THE COPYRIGHT HOLDERS AND CONTRIBUTORS "AS IS"
AND ANY EXPRESS OR IMPLIED WARRANTIES, INCLUDING, BUT NOT LIMITED TO, THE
IMPLIED WARRANTIES OF MERCHANTABILITY AND FITNESS FOR A PARTICULAR PURPOSE ARE
DISCLAIMED. IN NO EVENT SHALL THE COPYRIGHT HOLDER BE LIABLE."""
BSD2 = BSD[: BSD.index("3. Neither")] + BSD[BSD.index("THIS SOFTWARE") :]
ISC = """Permission to use, copy, modify, and/or distribute this software for any
purpose with or without fee is hereby granted, provided that the above
copyright notice and this permission notice appear in all copies.

THE SOFTWARE IS PROVIDED "AS IS" AND THE AUTHOR DISCLAIMS ALL WARRANTIES WITH
REGARD TO THIS SOFTWARE INCLUDING ALL IMPLIED WARRANTIES OF MERCHANTABILITY
AND FITNESS. IN NO EVENT SHALL THE AUTHOR BE LIABLE."""
MPL = """This Source Code Form is subject to the terms of the Mozilla Public
License, v. 2.0. If a copy of the MPL was not distributed with this
file, You can obtain one at https://mozilla.org/MPL/2.0/."""


@pytest.mark.parametrize("mark", ["", "# ", " * ", "// "])
def test_wrapped_licenses(spark, mark):
    wants = [
        (APACHE, "apache2.notice,apache2.use,apache2.copy,apache2.basis,apache2.see", "Apache-2.0"), (APACHE.replace("http:", "https:"), "apache2.notice,apache2.use,apache2.copy,apache2.basis,apache2.see", "Apache-2.0"),
        (MIT, "mit.grant,mit.include,mit.warranty,mit.liability", "MIT"), (GPL, "gpl.redistribute,gpl3.notice,gpl.hope,gpl.see,gpl.copy", "GPL-3.0,GPL"),
        (GPL.replace("version 3", "version 2"), "gpl.redistribute,gpl2.notice,gpl.hope,gpl.see,gpl.copy", "GPL-2.0,GPL"), (GPL.replace("General", "Affero General"), "agpl3.notice,gpl.hope,agpl.see", "AGPL-3.0"),
        (GPL.replace("program", "library").replace("General", "Lesser General"), "lgpl3.notice,lgpl.hope,lgpl.see", "LGPL-3.0"),
        (BSD, "bsd.redistribution,bsd.source,bsd.binary,bsd3.endorse,bsd.warranty", "BSD-3-Clause,BSD-2-Clause"), (BSD2, "bsd.redistribution,bsd.source,bsd.binary,bsd.warranty", "BSD-2-Clause"),
        (ISC, "isc.grant,isc.warranty", "ISC"), (MPL, "mpl2.notice,mpl2.copy", "MPL-2.0"), ("SPDX-License-Identifier: GPL-2.0-or-later\nint x;", "spdx.GPL-2.0-or-later", "GPL-2.0-or-later"), ("A line\nAll rights\nreserved", "rights.reserved", "proprietary"), ("A title\nReleased under the MIT\nLicense\nMore", "mit.released", "MIT"),
        ("Released under the\n\nMIT License", "", ""), ("It is released under the MIT License", "", ""), ("Released under the. MIT License.", "", ""),
    ]
    rows = [(i, "\n".join(mark + line for line in t.split("\n"))) for i, (t, _, _) in enumerate(wants)]
    rows += [(100 + i, t.replace("\n", "\r\n")) for i, t in rows]
    got = {r.doc_id: (r.license_sentences, r.licenses) for r in licenses.scan_licenses(spark.createDataFrame(rows, "doc_id bigint, text string")).collect()}
    assert got == {k + i: w[1:] for i, w in enumerate(wants) for k in (0, 100)}


HELD = """Copyright (c) 2003, {who}
All rights reserved.

Redistribution and use in source and binary forms, with or without
modification, are permitted provided that the following conditions are met:

1. Redistributions of source code must retain the above copyright notice, this
   list of conditions and the following disclaimer.
2. Redistributions in binary form must reproduce the above copyright notice,
   this list of conditions and the following disclaimer in the documentation
   and/or other materials provided with the distribution.
3. {clause}

THIS SOFTWARE IS PROVIDED BY {by} "AS IS" AND ANY EXPRESS OR IMPLIED
WARRANTIES, INCLUDING, BUT NOT LIMITED TO, THE IMPLIED WARRANTIES OF
MERCHANTABILITY AND FITNESS FOR A PARTICULAR PURPOSE ARE DISCLAIMED."""


def test_licenses_with_other_holders(spark):
    end = "may be used to endorse\n   or promote products derived from this software without specific prior written\n   permission."
    clauses = [
        f"Neither the name of the University nor the names of its contributors\n   {end}", f"Neither the name of Foo, Inc. nor the names of its\n   contributors {end}",
        f"Neither the name of the copyright holder nor the names of its contributors {end}", "The name of the author may not be used to endorse or promote products derived from\n   this software without specific prior written permission.",
    ]
    rows = [(i, HELD.format(who="X", clause=c, by=by)) for i, (c, by) in enumerate(zip(clauses, ["THE REGENTS AND CONTRIBUTORS", "FOO, INC.", "THE COPYRIGHT HOLDERS AND CONTRIBUTORS", "THE AUTHOR"], strict=True))]
    plain = {
        10: ("The book is licensed under the Creative Commons Attribution 4.0 International License.", "CC-BY-4.0"), 11: ("This project is licensed under the MIT License - see the LICENSE file for details.", "MIT"),
        12: ("Our tool is licensed under the Apache License, Version 2.0.", "Apache-2.0"), 13: ("                    GNU GENERAL PUBLIC LICENSE\n                       Version 3, 29 June 2007\n\n Copyright", "GPL-3.0"),
        14: ("                                 Apache License\n                           Version 2.0, January 2004\n                        http://www.apache.org/licenses/", "Apache-2.0"), 15: ("we talked about the mit license and what it allows", None),
        16: ("word " * 50_000 + ".\nReleased under the MIT License.\n" + "word " * 50_000, "MIT"),
    }
    rows += [(k, v[0]) for k, v in plain.items()] + [(20, HELD.format(who="X", clause="Have fun.", by="THE AUTHOR"))]
    got = {r.doc_id: (r.license, r.licenses) for r in licenses.scan_licenses(spark.createDataFrame(rows, "doc_id bigint, text string")).collect()}
    assert all(got[i][0] == "BSD-3-Clause" and "proprietary" not in got[i][1] for i in range(4)), got
    assert {k: got[k][0] for k in plain} == {k: v[1] for k, v in plain.items()} and got[20][0] == "BSD-2-Clause"


# ---------------------------------------------------------------- 10 quality


def test_quality_counts(docs, texts):
    short = [(i, t) for i, t in texts if len(t or "") < 5000]
    got = quality.with_counts(docs.where("coalesce(length(text), 0) < 5000")).collect()
    assert key((r.doc_id, r.n_words, r.word_chars, r.n_symbols, r.n_dup_lines, r.n_repeat_words) for r in got) == key((i, *brute.quality_counts(t)) for i, t in short)
    rng = random.Random(10)
    for _ in range(300):
        t = "".join(rng.choice(["a", "b", " ", "\n", "#", "\u00a0", "é", "\t", "a a b"]) for _ in range(rng.randint(0, 40)))
        assert quality.text_counts(t)[:5] == brute.quality_counts(t), repr(t)


def test_each_quality_rule_can_reject_alone(spark):
    """A text that stands out in one respect, among texts of a few short lines, falls by that rule and no other."""
    rng = random.Random(12)
    words = [f"{a}{b}" for a in ("wo", "ta", "ri", "mel", "don") for b in ("ra", "nis", "ko", "tu", "per", "lo")]
    line = lambda n: " ".join(rng.choice(words) for _ in range(n))
    rows = [(i, "\n".join(line(rng.randint(15, 30)) for _ in range(rng.randint(3, 6)))) for i in range(300)]
    own = [line(12) for _ in range(10)]
    rows += [(900, line(80) + " #" * 60 + "\n" + line(60)), (901, " ".join(w * 4 for w in line(90).split())), (902, "\n".join([*own, *[x for x in own for _ in range(2)]])), (903, line(120) + "\n" + " ".join([line(8)] * 8))]
    docs = spark.createDataFrame(rows, "doc_id bigint, text string").selectExpr("*", "'en' lang", "'s' source")
    counts = quality.with_counts(docs).cache()
    limits = quality.fences(quality.sketches(counts))
    judged = quality.judge(counts, limits).cache()
    got = {r.doc_id: r.reasons for r in judged.where("reasons <> ''").collect()}
    assert got[900].split(",")[0] == "symbol_rate" and got[901] == "word_len" and "dup_line_rate" in got[902] and "repeat_rate" in got[903], got
    assert {r.feature for r in quality.rejections(judged.where("not base_failed or true").withColumn("base_failed", F.lit(False))).collect()} == {"symbol_rate", "word_len", "dup_line_rate", "repeat_rate"}
    assert sum(k < 900 for k in got) <= 6
    top = limits.first()
    assert top.tail_dup_line_rate <= 500 and top.tail_repeat_rate <= 500


def test_quality_filter(spark, docs, empty):
    rng = random.Random(11)
    vocab = [f"w{i}x" for i in range(500)]
    rows = [(i, " ".join(rng.choice(vocab) for _ in range(120)), "en", "s" if i % 3 else None) for i in range(300)]
    rows += [(900, " ".join(w + "###" for w in rows[0][1].split()), "en", "s"), (901, "same same same " * 40, "en", "s"), (902, None, None, None), (903, "few words", "en", "s")]
    kept = {r.doc_id for r in quality.filter_quality(spark.createDataFrame(rows, "doc_id bigint, text string, lang string, source string")).collect()}
    assert kept == set(range(300))
    out = quality.filter_quality(docs)
    assert out.columns == docs.columns and quality.filter_quality(empty).count() == 0


def test_thresholds_adapt(spark):
    """What is usual in one source is out of bounds in another; small groups lean on wider ones; both ways of joining agree."""
    rng = random.Random(12)
    vocab = [f"w{i}x" for i in range(400)]
    words = lambda n: [rng.choice(vocab) for _ in range(n)]
    rows = [(i, " ".join(words(120)), "en", "prose") for i in range(400)]
    rows += [(1000 + i, " ".join(w + rng.choice(["#", "$", ""]) for w in words(120)), "en", "code") for i in range(400)]
    odd = " ".join(w + "#" for w in words(96)) + " " + " ".join(words(24))
    rows += [(2000, odd, "en", "prose"), (2001, odd, "en", "code"), (2002, odd, "en", None), (2003, " ".join(w * 8 for w in words(120)), "en", "prose"), (2004, " ".join("a b c d e f g h i j k l m n".split()[rng.randint(0, 13)] for _ in range(120)), "en", "prose")]
    docs = spark.createDataFrame(rows, "doc_id bigint, text string, lang string, source string")
    counts = quality.with_counts(docs)
    limits = quality.fences(quality.sketches(counts))
    by = {r.source: r for r in limits.collect()}
    assert by["prose"].max_symbol_rate < 700 < 800 < by["code"].max_symbol_rate and by["prose"].max_symbol_rate < by[None].max_symbol_rate
    assert by["prose"].min_word_len > 0
    got = quality.judge(counts, limits).collect()
    out = {r.doc_id: r.reasons for r in got if not r.base_failed and not r.kept}
    assert "symbol_rate" in out[2000] and 2001 not in out and "word_len" in out[2003] and "word_len" in out[2004]
    assert not [i for i in out if i < 2000]
    assert key(got) == key(quality.judge(counts, limits, broadcast=False).collect())
    kept = key(quality.filter_quality(docs).collect())
    quality.BROADCAST_GROUPS, before = 0, quality.BROADCAST_GROUPS
    try:
        assert key(quality.filter_quality(docs).collect()) == kept
    finally:
        quality.BROADCAST_GROUPS = before


def test_sketches_merge(spark):
    rows = [(i, "en", f"s{i % 4}", 100, 500 + i, i % 7, 0, 0, 5, 0) for i in range(400)]
    counts = spark.createDataFrame(rows, "doc_id bigint, lang string, source string, " + ", ".join(f"{c} bigint" for c in quality.COUNTS))
    whole = quality.sketches(counts).where("level = 0").select("feature", "bucket", "n").collect()
    merged = quality.sketches(counts).where("level = 2").groupBy("feature", "bucket").agg(F.sum("n").alias("n")).collect()
    assert sorted(map(tuple, whole)) == sorted(map(tuple, merged))
    assert [r[0] for r in spark.range(1, 200).select((F.col("id") - quality.bucket(F.col("id"))) / F.col("id")).collect()] < [1 / 32] * 200


def test_no_llm_names_elsewhere():
    root = Path(__file__).resolve().parents[2] / "mnemoframe"
    assert not [p for p in root.rglob("*.py") if "llm" not in p.parts and re.search(r"\bllm\b", p.read_text())]
