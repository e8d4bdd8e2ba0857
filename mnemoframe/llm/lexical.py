"""Ranked lexical search with posting lists that are blocked by document similarity.

Index: tasks cut the documents into shards of bounded size, one row of a table each, with the shard's terms, its documents' vectors (an
impact for each term, from the corpus-wide statistics) and its posting lists. Terms of at least ``FREQUENT`` of a shard's documents, the
``MOST`` most frequent of them, are its frequent ones. Documents are clustered by their vectors over these (dot products with some documents as pivots); the list of a
frequent term is put in the clusters' order and cut into blocks of neighbours, each with a summary: the coordinatewise maximum of its
documents' vectors, rounded up to a byte.

Search, of a block of queries that all tasks get, shard by shard: documents in the lists of a query's other terms, which are short, are scored first.
What isn't among them holds frequent terms of the query alone, so the product of query and summary bounds the score of any other document of a
block. Blocks are taken by falling bound, and skipped once the bound is below the score of the k-th best so far, which a task carries from
shard to shard. Documents of blocks that aren't skipped are scored exactly; the k best of each task are ranked.
"""

from __future__ import annotations

import math
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from mnemoframe.llm.common import batches, materialize, new_path

TOP = 20
#: Documents and postings of a shard, but for a longer document.
DOCS, POSTINGS = 4096, 700_000
#: Documents of a shard from which on a term's list is blocked; documents in a block; pivots.
FREQUENT, BLOCK, PIVOTS = 128, 64, 64
#: Frequent terms of a shard at most, the most frequent; with POSTINGS and BLOCK this bounds its summaries. The lists of others are scored in full, as short ones are.
MOST = 2048
#: Queries that are sent to all tasks at once.
QUERIES = 256
#: A summary counts in steps of so many: the greatest impact, a million, is 245 of them.
STEP = 4096
#: Parts of a posting's impact: scale * tf over 1000 * tf + 12 * m, with m as follows from the document's length.
SCALE = 1_000_000_000
NONE = (1 << 63) - 1
#: A-Z lower-cased; what is neither a digit, a letter a-z nor beyond ASCII is a space.
TERM_BYTES = bytes(c + 32 if 65 <= c <= 90 else c if 48 <= c <= 57 or 97 <= c <= 122 or c >= 128 else 32 for c in range(256))
FORWARD = "vocab array<string>, df array<int>, ids array<bigint>, size array<int>, ends array<int>, code array<int>, tf array<int>"
INDEX = (
    "vocab array<string>, ids array<bigint>, ends array<int>, code array<int>, impact array<int>, post_ends array<int>, post array<int>, frequent array<int>, block_list array<int>, block_ends array<int>, summary binary"
)


def terms_of(text: str | None) -> list[bytes]:
    return (text or "").encode("utf-8", "surrogatepass").translate(TERM_BYTES).split()


def _row(ddl: str, values: list) -> pa.RecordBatch:
    """One row; arrays are given as numpy arrays or lists, in the DDL's order."""
    names = [c.split()[0] for c in ddl.split(", ")]
    kinds = {"array<string>": pa.string(), "array<int>": pa.int32(), "array<bigint>": pa.int64()}
    cols = []
    for v, c in zip(values, ddl.split(", "), strict=True):
        kind = c.split()[1]
        cols.append(pa.array([v], pa.binary()) if kind == "binary" else pa.ListArray.from_arrays(pa.array([0, len(v)], pa.int32()), pa.array(v, kinds[kind])))
    return pa.RecordBatch.from_arrays(cols, names=names)


def _forward(docs: DataFrame, doc_id: str, text: str) -> DataFrame:
    """Shards of documents with terms: local vocabulary, document frequencies, lengths, and by document codes and counts of its terms."""

    def run(it: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        vocab: dict[bytes, int] = {}
        ids, size, codes, tfs = [], [], [], []

        def shard() -> pa.RecordBatch:
            code = np.concatenate(codes)
            ends = np.cumsum([len(c) for c in codes])
            return _row(FORWARD, [[w.decode("utf-8", "surrogatepass") for w in vocab], np.bincount(code, minlength=len(vocab)), ids, size, ends, code, np.concatenate(tfs)])

        held = 0
        for b in batches(it, 500):
            for i, t in zip(b.column(0).to_pylist(), b.column(1), strict=True):
                words = terms_of(t.as_py())
                if not words:
                    continue
                c, n = np.unique(np.fromiter((vocab.setdefault(w, len(vocab)) for w in words), np.int32, len(words)), return_counts=True)
                ids.append(i)
                size.append(len(words))
                codes.append(c)
                tfs.append(n)
                held += len(c)
                if len(ids) >= DOCS or held >= POSTINGS:
                    yield shard()
                    vocab, held = {}, 0
                    ids, size, codes, tfs = [], [], [], []
        if ids:
            yield shard()

    return docs.select(F.col(f"`{doc_id}`").cast("bigint"), F.col(f"`{text}`")).mapInArrow(run, FORWARD)


def _spread(start: np.ndarray, end: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(places from start to end of each range, one behind the other; where each range begins among them)."""
    n = end - start
    first = np.cumsum(n) - n
    return np.repeat(start - first, n) + np.arange(int(n.sum())), first


def impacts(tf: np.ndarray, size: np.ndarray, ends: np.ndarray, n_docs: int, n_terms: int) -> np.ndarray:
    m = np.array([75 + 25 * n * n_docs // n_terms for n in size.tolist()], np.int64)
    return (SCALE * tf.astype(np.int64)) // (1000 * tf.astype(np.int64) + 12 * np.repeat(m, np.diff(ends, prepend=0)))


def clusters(vectors: np.ndarray, pivots: int) -> np.ndarray:
    """The pivot, of documents evenly spaced, with which each vector has the greatest cosine."""
    unit = vectors / np.maximum(np.linalg.norm(vectors, axis=1, keepdims=True), 1e-9)
    return (unit @ unit[np.linspace(0, len(unit) - 1, min(pivots, len(unit))).astype(int)].T).argmax(axis=1)


def _blocked(b: pa.RecordBatch, r: int, stats: tuple[int, int], frequent: int, block: int, pivots: int, most: int) -> pa.RecordBatch:
    """The index of one shard."""
    number = lambda c: b.column(c)[r].values.to_numpy()
    size, ends, code = number("size"), number("ends"), number("code")
    df, doc = number("df"), np.repeat(np.arange(len(ends)), np.diff(ends, prepend=0))
    impact = impacts(number("tf"), size, ends, *stats)
    often = np.flatnonzero(df >= frequent)
    often = np.sort(often[np.argsort(-df[often], kind="stable")[:most]])
    place = np.full(len(df), -1)
    place[often] = np.arange(len(often))
    own = place[code] >= 0
    dense = np.zeros((len(ends), len(often)), np.uint8)
    dense[doc[own], place[code[own]]] = -(-impact[own] // STEP)
    weighed = dense.astype(np.float32) * np.log((len(ends) + 1) / (df[often] + 0.5)).astype(np.float32)
    cluster = clusters(weighed, pivots) if len(often) else np.zeros(len(ends), np.int64)
    order = np.lexsort((doc, cluster[doc], code))
    post, post_ends = doc[order], np.cumsum(df)
    lists, block_ends, summary = [], [], []
    for f, c in enumerate(often.tolist()):
        a, z = post_ends[c] - df[c], post_ends[c]
        starts = np.arange(0, z - a, block)
        lists += [f] * len(starts)
        block_ends += np.minimum(a + starts + block, z).tolist()
        summary.append(np.maximum.reduceat(dense[post[a:z]], starts, axis=0))
    packed = np.concatenate(summary).tobytes() if summary else b""
    vocab, ids = b.column("vocab")[r].values, b.column("ids")[r].values
    return _row(INDEX, [vocab, ids, ends, code, impact, post_ends, post, often, lists, block_ends, packed])


@dataclass(frozen=True)
class Index:
    """shards: a row each; vocabulary: (vocab, df) by shard; n_docs with terms, n_terms with repeats."""

    shards: DataFrame
    vocabulary: DataFrame
    n_docs: int
    n_terms: int


def _written(df: DataFrame, name: str) -> DataFrame:
    """Shards are large rows: few go into a file, so that neither writers nor readers hold many."""
    path = new_path(df.sparkSession, name)
    df.write.option("compression", "zstd").option("maxRecordsPerFile", 4).parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def build_index(docs: DataFrame, doc_id: str = "doc_id", text: str = "text", frequent: int = FREQUENT, block: int = BLOCK, pivots: int = PIVOTS, most: int = MOST) -> Index:
    """All documents of ``docs`` in a written index. Ids are whole numbers. Texts are read once."""
    if docs.schema[doc_id].dataType.typeName() not in ("byte", "short", "integer", "long"):
        raise ValueError("ids are whole numbers")
    forward = _written(_forward(docs, doc_id, text), "forward")
    total = lambda c: F.aggregate(c, F.lit(0).cast("bigint"), lambda s, x: s + x)
    stats = forward.agg(F.coalesce(F.sum(F.size("ids")), F.lit(0)), F.coalesce(F.sum(total("size")), F.lit(0))).first()

    def run(it: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches(it, 1):
            for r in range(b.num_rows):
                yield _blocked(b, r, (stats[0], stats[1]), frequent, block, pivots, most)

    return Index(_written(forward.mapInArrow(run, INDEX), "index"), forward.select("vocab", "df"), stats[0], stats[1])


class Best:
    """The k best (score, id) of a query so far; of equal scores the smaller ids."""

    def __init__(self, k: int) -> None:
        self.k, self.score, self.id = k, np.zeros(0, np.int64), np.zeros(0, np.int64)

    @property
    def floor(self) -> int:
        """What a document must reach to be among the k best."""
        return int(self.score[-1]) if len(self.score) == self.k else 1

    def add(self, score: np.ndarray, ids: np.ndarray) -> None:
        good = score >= self.floor
        score, ids = np.concatenate([self.score, score[good]]), np.concatenate([self.id, ids[good]])
        order = np.lexsort((ids, -score))[: self.k]
        self.score, self.id = score[order], ids[order]


class Shard:
    def __init__(self, b: pa.RecordBatch, r: int) -> None:
        number = lambda c: b.column(c)[r].values.to_numpy(zero_copy_only=False)
        self.vocab = b.column("vocab")[r].values
        self.ids = pc.fill_null(b.column("ids")[r].values, NONE).to_numpy()
        self.ends, self.code, self.impact, self.post_ends, self.post = (number(c) for c in ("ends", "code", "impact", "post_ends", "post"))
        self.impact = self.impact.astype(np.int64)
        often, self.block_list, self.block_ends = number("frequent"), number("block_list"), number("block_ends")
        self.place = np.full(len(self.vocab), -1)
        self.place[often] = np.arange(len(often))
        self.summary = np.frombuffer(b.column("summary")[r].as_py(), np.uint8).reshape(len(self.block_ends), -1) if len(often) else np.zeros((0, 0), np.uint8)
        first = np.concatenate([[True], self.block_list[1:] != self.block_list[:-1]]) if len(self.block_list) else np.zeros(0, bool)
        begins = (self.post_ends[often - 1] * (often > 0)) if len(often) else np.zeros(0, np.int64)
        self.block_starts = np.where(first, begins[self.block_list], np.concatenate([[0], self.block_ends[:-1]])) if len(first) else np.zeros(0, np.int64)
        self.list_first = np.append(np.flatnonzero(first), len(first))
        self.weight = np.zeros(len(self.vocab), np.int64)

    def _score(self, docs: np.ndarray, best: Best) -> None:
        at, first = _spread(self.ends[docs - 1] * (docs > 0), self.ends[docs])
        best.add(np.add.reduceat(self.weight[self.code[at]] * self.impact[at], first), self.ids[docs])

    def search(self, codes: np.ndarray, weights: np.ndarray, best: Best) -> tuple[int, int]:
        """Blocks of the query's lists, and how many of them were skipped."""
        self.weight[codes] = weights
        seen = np.zeros(len(self.ids), bool)
        often = self.place[codes]
        rare = codes[often < 0]
        if len(rare):
            at, _ = _spread(self.post_ends[rare - 1] * (rare > 0), self.post_ends[rare])
            seen[self.post[at]] = True
            self._score(np.flatnonzero(seen), best)
        lists, w = often[often >= 0], weights[often >= 0]
        blocks, _ = _spread(self.list_first[lists], self.list_first[lists + 1]) if len(lists) else (np.zeros(0, np.int64), None)
        skipped = 0
        if len(blocks):
            bound = (self.summary[np.ix_(blocks, lists)].astype(np.int64) * STEP) @ w
            order = np.argsort(-bound, kind="stable")
            i, step = 0, 8
            while i < len(order):
                now = order[i : i + step]
                now = now[bound[now] >= best.floor]
                if not len(now):
                    skipped = len(order) - i
                    break
                skipped += len(order[i : i + step]) - len(now)
                at, _ = _spread(self.block_starts[blocks[now]], self.block_ends[blocks[now]])
                docs = np.unique(self.post[at])
                docs = docs[~seen[docs]]
                if len(docs):
                    seen[docs] = True
                    self._score(docs, best)
                i, step = i + step, step * 2
        self.weight[codes] = 0
        return len(blocks), skipped


def _weights(index: Index, terms: list[str]) -> dict[str, int]:
    """Weight of each term that occurs; the terms are those of one block of queries."""
    spark = index.vocabulary.sparkSession
    wanted = spark.createDataFrame([(t,) for t in terms], "term string")
    pairs = index.vocabulary.select(F.explode(F.arrays_zip("vocab", "df")).alias("x")).select(F.col("x.vocab").alias("term"), F.col("x.df").cast("bigint").alias("df"))
    found = pairs.join(F.broadcast(wanted), "term").groupBy("term").agg(F.sum("df").alias("df")).collect()
    return {r.term: math.floor(1000 * math.log((2 * index.n_docs + 2) / (2 * r.df + 1))) for r in found}


def search(index: Index, items: DataFrame, item_id: str = "item_id", text: str = "text", k: int = TOP) -> DataFrame:
    """(item_id, rank, doc_id, score, n_blocks, n_skipped): the k best documents for each row of ``items``, with a score above 0.

    Terms are runs of letters, digits and characters beyond ASCII, A-Z lower-cased; what an item repeats counts again. Equal scores go by
    ascending doc_id, a null id last. Items without terms, or of unknown ones, have no rows; items that share an id are ranked each for itself. Documents without
    terms are never found; rows that repeat a document are ranked each. Items are read in blocks of ``QUERIES``, each of which all shards see. n_blocks, n_skipped:
    blocks of the item's lists, and those left out by their bound; they depend on how documents were dealt.
    """
    spark = items.sparkSession
    asked = materialize(items.select(F.monotonically_increasing_id().alias("q"), F.col(f"`{item_id}`").alias("item_id"), F.col(f"`{text}`").alias("text")), "items")
    shape = "q bigint, doc_id bigint, score bigint, blocks bigint, skipped bigint"
    path, last = new_path(spark, "hits"), -1
    spark.createDataFrame([], shape).write.parquet(path)
    while rows := asked.where(F.col("q") > last).orderBy("q").select("q", "text").limit(QUERIES).collect():
        last = rows[-1].q
        counts: list[dict[str, int]] = []
        for r in rows:
            own: dict[str, int] = {}
            for w in terms_of(r.text):
                t = w.decode("utf-8", "surrogatepass")
                own[t] = own.get(t, 0) + 1
            counts.append(own)
        weight = _weights(index, sorted({t for c in counts for t in c}))
        terms = sorted(weight)
        number = {t: i for i, t in enumerate(terms)}
        known = [{number[t]: n * weight[t] for t, n in c.items() if t in number} for c in counts]
        queries = [(r.q, np.array(list(c), np.int64), np.array(list(c.values()), np.int64)) for r, c in zip(rows, known, strict=True) if c]

        def run(it: Iterator[pa.RecordBatch], terms: list[str] = terms, queries: list = queries) -> Iterator[pa.RecordBatch]:
            best, tally = [Best(k) for _ in queries], np.zeros((len(queries), 2), np.int64)
            for b in batches(it, 1):
                for r in range(b.num_rows):
                    shard = Shard(b, r)
                    code = pc.fill_null(pc.index_in(pa.array(terms, pa.string()), value_set=shard.vocab), -1).to_numpy(zero_copy_only=False).astype(np.int64)
                    for j, (_, of, weights) in enumerate(queries):
                        here = code[of] >= 0
                        if here.any():
                            tally[j] += shard.search(code[of][here], weights[here], best[j])
            for (q, _, _), found, (blocks, skipped) in zip(queries, best, tally, strict=True):
                n = len(found.id)
                ids = pa.array(found.id, mask=found.id == NONE)
                yield pa.RecordBatch.from_arrays([pa.array([q] * n, pa.int64()), ids, pa.array(found.score), pa.array([0] * n, pa.int64()), pa.array([0] * n, pa.int64())], names=["q", "doc_id", "score", "blocks", "skipped"])
                yield pa.RecordBatch.from_arrays([pa.array([v], pa.int64()) for v in (q, None, 0, int(blocks), int(skipped))], names=["q", "doc_id", "score", "blocks", "skipped"])

        if queries:
            index.shards.mapInArrow(run, shape).write.mode("append").parquet(path)
    hits = spark.read.schema(shape).parquet(path)
    order = Window.partitionBy("q").orderBy(F.desc("score"), F.asc_nulls_last("doc_id"))
    ranked = hits.where("score > 0").withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= k).select("q", "rank", "doc_id", "score")
    tallies = hits.where("score = 0").groupBy("q").agg(F.sum("blocks").alias("n_blocks"), F.sum("skipped").alias("n_skipped"))
    return ranked.join(tallies, "q").join(asked.select("q", "item_id"), "q").select("item_id", "rank", "doc_id", "score", "n_blocks", "n_skipped")
