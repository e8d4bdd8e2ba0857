"""MinHash near-duplicates, blocked lexical search and collocations against plain Python."""

from __future__ import annotations

import math
import random
import re
import sys
from collections import Counter
from pathlib import Path

import numpy as np
import pytest
from pyspark.sql import functions as F

sys.path.insert(0, str(Path(__file__).parent))
import brute

from mnemoframe.llm import collocations, hashing, lexical, minhash

WORDS = "the of and ing tion eau der die über été ñandú x1 42 foo bar baz qux".split()


def prose(rng, n, words=WORDS):
    return " ".join(rng.choice(words) + rng.choice(["", "", ".", "s"]) for _ in range(n))


def edited(rng, text, share):
    return " ".join(f"e{rng.random()}" if rng.random() < share else w for w in text.split(" "))


@pytest.fixture(scope="module")
def rows():
    rng = random.Random(8)
    many = [f"w{i}" for i in range(4000)]
    out = [(i, prose(rng, rng.randint(1, 90))) for i in range(30)]
    base, other = prose(rng, 200, many), prose(rng, 200, many)
    out += [(100 + i, edited(rng, base, rng.choice([0, 0.005, 0.01, 0.03, 0.06]))) for i in range(60)]
    out += [(200 + i, edited(rng, other, 0.004)) for i in range(12)]
    out += [(300, base), (301, base.upper()), (302, f"{base} tail"), (303, None), (304, ""), (305, " \t\n"), (306, prose(rng, 20_000)), (300, base), (None, base), (None, "no id here at all"), (307, "é"), (308, "one two three"), (309, "One two\tthree")]
    return out


@pytest.fixture(scope="module")
def docs(spark, rows):
    full = [(i, t, "en" if i is None or i % 2 else None, "x", 1, 2, "clash") for i, t in rows]
    return spark.createDataFrame(full, "doc_id bigint, text string, lang string, n string, node int, row int, `a b` string")


# ---------------------------------------------------------------- 11 MinHash


def shingles(t, k=5):
    w = brute.SPACED.findall(brute.lower_ascii(t))
    return {tuple(w[i : i + k]) for i in range(max(1, len(w) - k + 1))} if w else set()


def near_components(rows, threshold=85):
    """Place in rows -> places of its component."""
    sets, root = [shingles(t) for _, t in rows], list(range(len(rows)))
    for a in range(len(rows)):
        for b in range(a):
            if sets[a] and 100 * len(sets[a] & sets[b]) >= threshold * len(sets[a] | sets[b]):
                x, y = root[a], root[b]
                root = [y if r == x else r for r in root]
    return sets, root


@pytest.mark.parametrize("group", [minhash.GROUP, 4])
def test_minhash_equals_all_pairs(docs, rows, group):
    sets, root = near_components(rows)
    ids = lambda r: [rows[i][0] for i in range(len(rows)) if root[i] == r and rows[i][0] is not None]
    want = sorted(((d, len(sets[i]), min(ids(root[i]), default=None)) for i, (d, _) in enumerate(rows)), key=repr)
    found = minhash.near_duplicates(docs, group=group)
    assert found.columns == [*docs.columns, "n_shingles", "component_id", "is_first"]
    got = found.collect()
    assert sorted(((r.doc_id, r.n_shingles, r.component_id) for r in got), key=repr) == want
    assert sum(r.is_first for r in got) == len(set(root)) and {r["a b"] for r in got} == {"clash"}


def test_minhash_no_rows_and_keep_one(docs, rows):
    assert minhash.near_duplicates(docs.where("false")).count() == 0
    kept = minhash.keep_one(docs)
    assert kept.columns == docs.columns and kept.count() == len(set(near_components(rows)[1]))


def test_minhash_estimates_similarity_and_misses_as_planned():
    rng = np.random.default_rng(3)
    plan = minhash.Plan()
    assert (1 - 0.85**plan.rows) ** plan.bands <= plan.miss / 2 < (1 - 0.85**plan.rows) ** (plan.bands - 1)
    steps = plan.cutoffs()
    assert steps[-1][1] == plan.size and all(a < b for (_, a, _), (_, b, _) in zip(steps, steps[1:], strict=False))
    shared, pairs, agree, lost = 850, 60, [], 0
    for _ in range(pairs):
        h = rng.integers(0, 1 << 63, 1000, dtype=np.uint64)
        a, b = h[: shared + 75], np.concatenate([h[:shared], h[shared + 75 :]])
        sig = minhash.signatures(np.concatenate([np.sort(a), np.sort(b)]), np.array([0, len(a), len(a) + len(b)]), plan.size)
        same = sig[0] == sig[1]
        agree.append(same.mean())
        lost += any(same[:z].sum() < least for _, z, least in steps)
    assert abs(np.mean(agree) - 0.85) < 0.02 and lost == 0
    # What is far below the threshold goes in the first batch.
    assert steps[0][2] > 0.4 * steps[0][1]


def test_minhash_buckets_compare_across_components_only():
    plan, rng = minhash.Plan(), np.random.default_rng(4)
    base = np.sort(rng.integers(0, 1 << 63, 300, dtype=np.uint64))
    sets = [np.sort(np.concatenate([base[k:], rng.integers(0, 1 << 63, k, dtype=np.uint64)])) for k in (0, 5, 10, 60, 150)]
    h, bounds = np.concatenate(sets), np.cumsum([0, *map(len, sets)])
    sig = minhash.signatures(h, bounds, plan.size)
    pairs = set()
    for band in range(plan.bands):
        b = minhash.Bucket(band, np.zeros(5, np.int64), np.arange(5), np.array([0, 0, 2, 3, 4]), np.diff(bounds), sig, [s.tobytes() for s in sets], plan)
        pairs |= {frozenset(p) for p in b.links()}
    assert frozenset((0, 1)) not in pairs and any(2 in p and p & {0, 1} for p in pairs) and all(4 not in p for p in pairs)


# ---------------------------------------------------------------- 12 lexical search

TERM = re.compile(r"[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+")


def ranked(rows, items, k=20):
    docs = [(d, Counter(TERM.findall(brute.lower_ascii(t)))) for d, t in rows]
    docs = [(d, c, sum(c.values())) for d, c in docs if c]
    total, length = len(docs), sum(n for *_, n in docs)
    df = Counter(w for _, c, _ in docs for w in c)
    out = []
    for item, t in items:
        asked = TERM.findall(brute.lower_ascii(t))
        scores = []
        for d, c, n in docs:
            m = 75 + (25 * n * total) // length
            s = sum(math.floor(1000 * math.log((2 * total + 2) / (2 * df[w] + 1))) * (1000000000 * c[w] // (1000 * c[w] + 12 * m)) for w in asked if c[w])
            if s > 0:
                scores.append((-s, d is None, d))
        out += [(item, i + 1, d, -s) for i, (s, _, d) in enumerate(sorted(scores, key=lambda x: (x[0], x[1], x[2] or 0))[:k])]
    return sorted(out, key=repr)


@pytest.mark.parametrize("how", [{}, {"frequent": 3, "block": 2, "pivots": 5}, {"frequent": 3, "block": 4, "pivots": 3, "most": 6}])
def test_lexical_search_equals_scoring_all(spark, docs, rows, how, monkeypatch):
    rng = random.Random(3)
    items = [(i, prose(rng, 12)) for i in range(12)] + [(20, None), (21, "..."), (22, "unknownword"), (23, rows[31][1]), (24, "foo foo FOO bar"), (24, "baz"), (None, "42")]
    monkeypatch.setattr(lexical, "QUERIES", 5)
    asked = spark.createDataFrame([(i, t, "z") for i, t in items], "item_id bigint, text string, rank string")
    found = lexical.search(lexical.build_index(docs.repartition(2), **how), asked).collect()
    assert sorted(((r.item_id, r["rank"], r.doc_id, r.score) for r in found), key=repr) == ranked(rows, items)


def test_lexical_search_skips_blocks(spark):
    """Two topics of words that share the frequent ones: the other topic's blocks are skipped."""
    rng = random.Random(1)
    common = [f"c{i}" for i in range(30)]
    topics = [[f"{t}{i}" for i in range(60)] for t in "ab"]
    rows = [(i, " ".join(rng.choices(topics[i % 2], k=60) + rng.choices(common, k=10 if i % 40 else 40))) for i in range(600)]
    items = [(0, " ".join(topics[0][:5] + common[:2])), (1, " ".join(topics[1][:5] + common[5:7]))]
    index = lexical.build_index(spark.createDataFrame(rows, "doc_id bigint, text string").coalesce(1), frequent=40, block=16)
    found = lexical.search(index, spark.createDataFrame(items, "item_id bigint, text string")).collect()
    assert sorted(((r.item_id, r["rank"], r.doc_id, r.score) for r in found), key=repr) == ranked(rows, items)
    assert all(0 < r.n_skipped < r.n_blocks for r in found)


def test_lexical_search_without_rows(spark, docs):
    items = spark.createDataFrame([(1, "foo")], "item_id bigint, text string")
    assert lexical.search(lexical.build_index(docs.where("false")), items).count() == 0
    assert lexical.search(lexical.build_index(docs), items.where("false")).count() == 0
    with pytest.raises(ValueError):
        lexical.build_index(docs.withColumn("doc_id", F.lit("x")))


# ---------------------------------------------------------------- 13 collocations


def phrases(rows, least, top=2000):
    count, totals = {}, Counter()
    for lang, t in rows:
        for piece in re.split(r"[.,;:!?\x0A-\x0D]", brute.lower_ascii(t)):
            w = re.findall(r"[^\x20\x09]+", piece)
            totals[lang or "und"] += len(w)
            for k in range(1, 5):
                for i in range(len(w) - k + 1):
                    p = (lang or "und", *w[i : i + k])
                    count[p] = count.get(p, 0) + 1
    cand = {p: a for p, a in count.items() if len(p) > 2 and a >= least}
    out = {}
    for (lang, *w), a in cand.items():
        if any(q[0] == lang and len(q) - 1 > len(w) and 100 * f >= 80 * a and any(list(q[i : i + len(w)]) == w for i in range(1, len(q) - len(w) + 1)) for q, f in cand.items()):
            continue
        cuts = [(2_000_000 * a // (count[lang, *w[:k]] + count[lang, *w[k:]]), k) for k in range(1, len(w))]
        score, k = min(cuts)
        out.setdefault(lang, []).append((-score, -a, " ".join(w).encode(), count[lang, *w[:k]], count[lang, *w[k:]]))
    return sorted((lang, i + 1, p.decode(), -a, le, r, totals[lang], -s) for lang, found in out.items() for i, (s, a, p, le, r) in enumerate(sorted(found)[:top]))


@pytest.fixture(scope="module")
def spoken():
    rng = random.Random(6)
    sticky = ["new york city", "in spite of", "über été", "a b c d", "x1 42"]
    text = lambda n: " ".join(rng.choice([*WORDS, *sticky]) + rng.choice(["", "", "", ".", ", ", "\t", "\n", "!"]) for _ in range(n))
    rows = [(i, text(rng.randint(1, 300)), rng.choice(["en", "de", None, "und"])) for i in range(60)]
    return [*rows, (60, text(20_000), "en"), (61, None, "en"), (62, "", None), (63, " .,;\r\n\x0b\x0c", "fr"), (63, rows[3][1], rows[3][2]), (None, rows[4][1], "de"), (64, "New  York\tCity " * 40, "fr")]


@pytest.mark.parametrize(("least", "top"), [(30, 2000), (5, 7)])
def test_collocations_equal_counting_all(spark, spoken, least, top):
    docs = spark.createDataFrame([(i, t, x, "z", 1) for i, t, x in spoken], "doc_id bigint, text string, lang string, phrase string, rank int")
    found = collocations.collocations(docs.repartition(3), min_count=least, top=top).collect()
    got = sorted((r.lang, r["rank"], r.phrase, r.a, r.l, r.r, r.n, r.score) for r in found)
    assert got == phrases([(x, t) for _, t, x in spoken], least, top)
    text = {i: t for i, t, _ in spoken}
    for r in found[:50]:  # each names an occurrence
        if r["first"].ptr in text:
            w = re.findall(r"[^\x20\x09.,;:!?\x0A-\x0D]+", brute.lower_ascii(text[r["first"].ptr]))
            assert " ".join(w[r["first"].word :][: r.phrase.count(" ") + 1]) == r.phrase


def test_collocations_tell_equal_fingerprints_apart(spark, spoken, monkeypatch):
    """With words whose hashes collide, wrong candidates pass the fingerprints and fall by their text."""
    coarse = lambda texts, table, cut=None: (lambda w: setattr(w, "value", w.value % np.uint64(3)) or w)(hashing.words_of(texts, table, cut))
    import pyarrow as pa

    batch = pa.RecordBatch.from_pydict({"lang": ["en", "en"], "ptr": [1, 2], "text": ["a b c d e f g h", "h g f e d c b a"]})
    monkeypatch.setattr(collocations, "words_of", coarse)
    x = collocations.Batch(batch)
    assert len(np.unique(x.fingerprints(1)[1])) <= 3 and len(x.codes()[0]) == 16


def test_collocations_counted_by_text_are_the_same(spark, spoken):
    docs = spark.createDataFrame([(i, t, x) for i, t, x in spoken], "doc_id bigint, text string, lang string").repartition(3)
    rows = lambda by: {(r.lang, r.phrase, r.size, r.n) for r in collocations.frequent_phrases(docs, by_text=by)[1].collect()}
    assert rows(True) == rows(False) and len(rows(True)) > 20


def test_collocations_without_rows(spark):
    assert collocations.collocations(spark.createDataFrame([], "doc_id bigint, text string, lang string")).count() == 0
    assert collocations.collocations(spark.createDataFrame([("k", None, None), ("k", "a b", "en")], "doc_id string, text string, lang string")).count() == 0
