"""Collocations: frequent phrases of two to four words, scored by how tightly their words hold together, per language.

Rabin-Karp fingerprints: running polynomial sums over the bytes of a batch of texts give a hash of each word, and a
polynomial over those a fingerprint of each n-gram, by language. Three passes count them, each combined in its task before it is shuffled:

1. words, by their text, which shows whether any two share a hash; 2. pairs of frequent words; 3. runs of three and four words in which every
pair is frequent (no phrase is more frequent than its parts).

What passed before is a bitmap of bounded size without false negatives, so nothing that may be frequent is left out. A row is a fingerprint with
a second one, which keeps phrases apart that share the first, its occurrences, and a pointer to one of them (a 64-bit name of its document and word).

A last pass reads the phrase of each frequent fingerprint at its pointer, once; other texts send nothing but the bitmap's few false positives.
If two words share a hash, which would deceive both fingerprints, phrases are counted by their text instead, occurrences told apart by their words.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import xxhash
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from mnemoframe.llm.common import materialize
from mnemoframe.llm.filters import PackedBitmap
from mnemoframe.llm.hashing import Words, mix, words_of

SIZES = (2, 3, 4)
MIN_COUNT = 30
#: A candidate goes if a longer one around it has at least so many hundredths of its occurrences.
INSIDE = 80
TOP = 2000
#: Score of a cut: so many times the count, over the sum of the parts' counts.
SCALE = 2_000_000
NO_LANG = "und"
#: A-Z lower-cased; a tab is a space, and the marks that end a piece are a line feed.
PIECE_BYTES = bytes(c + 32 if 65 <= c <= 90 else 10 if c in b".,;:!?\n\x0b\x0c\r" else 32 if c == 9 else c for c in range(256))
#: Bytes of text that a task hashes at once, but for a longer text; distinct fingerprints and phrases that it holds at most.
ROOM, HELD, HELD_PHRASES = 1 << 20, 200_000, 100_000
#: Parts of a language that are ranked by tasks of their own before the language is.
SALTS = 64
#: log2 of a bitmap's bits for each hash: one in three thousand others passes.
BITS = 6


def _slices(b: pa.RecordBatch, column: int) -> Iterator[pa.RecordBatch]:
    """Slices of a batch with about ROOM bytes of text, one row at least."""
    size = np.asarray(pc.fill_null(pc.binary_length(b.column(column)), 0), np.int64)
    part = (np.cumsum(size) - size) // ROOM
    edges = np.concatenate([np.flatnonzero(np.diff(part, prepend=-1)), [b.num_rows]]) if b.num_rows else [0]
    for i, j in zip(edges[:-1], edges[1:], strict=True):
        yield b.slice(i, j - i)
    pa.default_memory_pool().release_unused()


class Batch:
    """Words of some texts with their languages. Columns of the input: lang, ptr, text."""

    def __init__(self, b: pa.RecordBatch) -> None:
        langs, codes = np.unique(np.array(b.column(0).to_pylist(), dtype=object).astype(str), return_inverse=True)
        self.langs = langs.tolist()
        seed = np.array([xxhash.xxh64_intdigest(x) for x in self.langs], np.uint64)
        self.words: Words = words_of(b.column(2).to_pylist(), PIECE_BYTES, cut=10)
        w = self.words
        self.owner = np.repeat(w.text, np.diff(w.first))  # text of each word
        self.lang = codes[self.owner] if len(self.owner) else np.zeros(0, np.int64)
        self.seed = seed[self.lang] if len(self.owner) else np.zeros(0, np.uint64)
        self.ptr = np.asarray(b.column(1), np.int64)
        self.first_word = np.searchsorted(self.owner, np.arange(b.num_rows))

    def fingerprints(self, k: int) -> tuple[np.ndarray, np.ndarray]:
        """(word at which it begins, fingerprint) of each n-gram inside a piece."""
        if k == 1:
            return np.arange(len(self.seed)), mix(self.words.value ^ self.seed)
        at, h = self.words.shingles(k)
        return at, mix(h ^ self.seed[at])

    def codes(self) -> tuple[list[bytes], np.ndarray]:
        """The words, and a number for each that equal words share."""
        words, ids = self.words.raw.split(), {}
        return words, np.fromiter((ids.setdefault(w, len(ids)) for w in words), np.int64, len(words))

    def pointer(self, at: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(pointer of its text, word index in it) of some words."""
        owner = self.owner[at]
        return self.ptr[owner], at - self.first_word[owner]

    def place(self, at: np.ndarray) -> np.ndarray:
        """A name of each word's place."""
        ptr, word = self.pointer(at)
        return mix(mix(ptr.view(np.uint64)) + word.astype(np.uint64))

    def second(self, at: np.ndarray, k: int) -> np.ndarray:
        """Another fingerprint of the n-grams at some words."""
        h = self.seed[at]
        for j in range(k):
            h = (h ^ mix(self.words.value[at + j] ^ np.uint64(0xA0761D6478BD642F))) * np.uint64(0xE7037ED1A0B428DB)
        return mix(h)


def _count_words(texts: DataFrame) -> DataFrame:
    """(lang, word, n, h): occurrences and fingerprint of each word."""

    def run(it: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: dict[tuple[str, bytes], list[int]] = {}

        def out() -> pa.RecordBatch:
            keys, rows = list(held), list(held.values())
            cols = [[k[0] for k in keys], [k[1].decode("utf-8", "surrogatepass") for k in keys], [r[0] for r in rows], [r[1] for r in rows]]
            return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(cols, (pa.string(), pa.string(), pa.int64(), pa.int64()), strict=True)], names=["lang", "word", "n", "h"])

        for whole in it:
            for b in _slices(whole, 2):
                x = Batch(b)
                words, code = x.codes()
                if not words:
                    continue
                key, first, n = np.unique(x.lang * (int(code.max()) + 1) + code, return_index=True, return_counts=True)
                h = x.fingerprints(1)[1][first].view(np.int64).tolist()
                for i, c, v, lang in zip(first.tolist(), n.tolist(), h, x.lang[first].tolist(), strict=True):
                    row = held.setdefault((x.langs[lang], words[i]), [0, v])
                    row[0] += c
                if len(held) > HELD_PHRASES:
                    yield out()
                    held.clear()
        yield out()

    return texts.mapInArrow(run, "lang string, word string, n bigint, h bigint").groupBy("lang", "word").agg(F.sum("n").alias("n"), F.first("h").alias("h"))


def _passing(x: Batch, sizes: tuple[int, ...], known: PackedBitmap, part: int) -> Iterator[tuple[int, np.ndarray, np.ndarray]]:
    """(k, at, fingerprint) of the n-grams in which every run of ``part`` words passes."""
    at, h = x.fingerprints(part)
    good = np.zeros(len(x.seed) + 1, bool)
    good[at[known.passes(h)]] = True
    for k in sizes:
        at, h = x.fingerprints(k)
        whole = np.ones(len(at), bool)
        for j in range(k - part + 1):
            whole &= good[at + j]
        yield k, at[whole], h[whole]


def _count_grams(texts: DataFrame, sizes: tuple[int, ...], known: PackedBitmap, part: int) -> DataFrame:
    """(fp, second, n, place): both fingerprints of n-grams whose parts pass, their occurrences, and the least name of a place."""
    names = ["fp", "second", "n", "place"]

    def merged(rows: list[tuple[np.ndarray, ...]]) -> tuple[np.ndarray, ...]:
        fp = np.concatenate([r[0] for r in rows])
        if not len(fp):
            return rows[0]
        order = np.argsort(fp)
        fp, second = fp[order], np.concatenate([r[1] for r in rows])[order]
        # Rows of one phrase may stay apart here where another shares its fingerprint; they are added up later.
        starts = np.flatnonzero(np.concatenate([[True], (fp[1:] != fp[:-1]) | (second[1:] != second[:-1])]))
        return fp[starts], second[starts], np.add.reduceat(np.concatenate([r[2] for r in rows])[order], starts), np.minimum.reduceat(np.concatenate([r[3] for r in rows])[order], starts)

    def run(it: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        none = (np.zeros(0, np.int64),) * 4
        out = lambda rows: pa.RecordBatch.from_arrays([pa.array(r) for r in rows], names=names)
        held = [none]
        for whole in it:
            for b in _slices(whole, 2):
                x = Batch(b)
                for k, at, h in _passing(x, sizes, known, part):
                    held.append(merged([(h.view(np.int64), x.second(at, k).view(np.int64), np.ones(len(h), np.int64), x.place(at).view(np.int64))]))
                if sum(len(r[0]) for r in held) > HELD:
                    held = [merged(held)]
                    if len(held[0][0]) > HELD // 2:
                        yield out(held[0])
                        held = [none]
        yield out(merged(held))

    rows = texts.mapInArrow(run, "fp bigint, second bigint, n bigint, place bigint")
    return rows.groupBy("fp", "second").agg(F.sum("n").alias("n"), F.min("place").alias("place"))


def _phrases_at(texts: DataFrame, frequent: DataFrame) -> DataFrame:
    """(lang, phrase, size, n, first) of ``frequent`` (fp, n, place), each read where its pointer shows."""
    known = PackedBitmap(frequent.select(F.col("fp").bitwiseXOR(F.col("place")).alias("h")).distinct(), BITS)

    def run(it: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole in it:
            for b in _slices(whole, 2):
                x = Batch(b)
                words = x.words.raw.split()
                for k in SIZES:
                    at, h = x.fingerprints(k)
                    place = x.place(at)
                    hit = known.passes(h ^ place)
                    at, h, place = at[hit], h[hit], place[hit]
                    ptr, word = x.pointer(at)
                    first = pa.StructArray.from_arrays([pa.array(ptr), pa.array(word.astype(np.int32))], names=["ptr", "word"])
                    phrase = [b" ".join(words[i : i + k]).decode("utf-8", "surrogatepass") for i in at.tolist()]
                    cols = [pa.array(h.view(np.int64)), pa.array(place.view(np.int64)), pa.array([x.langs[i] for i in x.lang[at].tolist()], pa.string()), pa.array(phrase, pa.string()), pa.array([k] * len(at), pa.int32())]
                    yield pa.RecordBatch.from_arrays([*cols, first], names=["fp", "place", "lang", "phrase", "size", "first"])

    found = texts.mapInArrow(run, "fp bigint, place bigint, lang string, phrase string, size int, first struct<ptr:bigint, word:int>")
    return found.join(frequent.select("fp", "place", "n"), ["fp", "place"]).dropDuplicates(["fp", "place"]).select("lang", "phrase", "size", "n", "first")


def _count_phrases(texts: DataFrame, known: PackedBitmap) -> DataFrame:
    """(lang, phrase, size, n, first) of the phrases whose fingerprint passes, counted by their text."""

    def run(it: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: dict[tuple[str, int, bytes], list[int]] = {}

        def out() -> pa.RecordBatch:
            keys, rows = list(held), list(held.values())
            first = pa.StructArray.from_arrays([pa.array([r[1] for r in rows], pa.int64()), pa.array([r[2] for r in rows], pa.int32())], names=["ptr", "word"])
            cols = [pa.array([k[0] for k in keys], pa.string()), pa.array([k[2].decode("utf-8", "surrogatepass") for k in keys], pa.string()), pa.array([k[1] for k in keys], pa.int32()), pa.array([r[0] for r in rows], pa.int64())]
            return pa.RecordBatch.from_arrays([*cols, first], names=["lang", "phrase", "size", "n", "first"])

        for whole in it:
            for b in _slices(whole, 2):
                x = Batch(b)
                words, code = x.codes()
                for k in SIZES:
                    at, h = x.fingerprints(k)
                    hit = known.passes(h)
                    at, h = at[hit], h[hit]
                    if not len(at):
                        continue
                    order = np.argsort(h, kind="stable")
                    at, h = at[order], h[order]
                    change = np.concatenate([[True], h[1:] != h[:-1]])
                    for j in range(k):  # equal fingerprints of different words fall apart here
                        c = code[at + j]
                        change[1:] |= c[1:] != c[:-1]
                    starts = np.flatnonzero(change)
                    n, one = np.diff(np.append(starts, len(at))), at[starts]
                    ptr, word = x.pointer(one)
                    for i, c, p, q, lang in zip(one.tolist(), n.tolist(), ptr.tolist(), word.tolist(), x.lang[one].tolist(), strict=True):
                        row = held.setdefault((x.langs[lang], k, b" ".join(words[i : i + k])), [0, p, q])
                        row[0] += c
                        row[1:] = min(row[1:], [p, q])
                if len(held) > HELD_PHRASES:
                    yield out()
                    held.clear()
        yield out()

    rows = texts.mapInArrow(run, "lang string, phrase string, size int, n bigint, first struct<ptr:bigint, word:int>")
    return rows.groupBy("lang", "phrase", "size").agg(F.sum("n").alias("n"), F.min("first").alias("first"))


def frequent_phrases(docs: DataFrame, text: str = "text", lang: str = "lang", doc_id: str = "doc_id", min_count: int = MIN_COUNT, by_text: bool = False) -> tuple[DataFrame, DataFrame]:
    """Words (lang, word, n), all of them, and phrases of two to four words (lang, phrase, size, n, first) with at least ``min_count`` occurrences.

    first: (ptr, word), an occurrence, doc_id and word index; ids that aren't whole numbers are hashed, null is the last. by_text: count phrases
    by their text, as it is done where two words share a hash.
    """
    kind = docs.schema[doc_id].dataType.typeName()
    ident = F.col(f"`{doc_id}`").cast("bigint") if kind in ("byte", "short", "integer", "long") else F.when(F.col(f"`{doc_id}`").isNotNull(), F.xxhash64(F.col(f"`{doc_id}`").cast("string")))
    texts = docs.select(F.coalesce(F.col(f"`{lang}`").cast("string"), F.lit(NO_LANG)).alias("lang"), F.coalesce(ident, F.lit((1 << 63) - 1)).alias("ptr"), F.col(f"`{text}`").alias("text"))
    words = materialize(_count_words(texts), "words")
    enough = F.col("n") >= min_count
    pairs = materialize(_count_grams(texts, SIZES[:1], PackedBitmap(words.where(enough).select("h").distinct(), BITS), 1).where(enough), "pairs")
    longer = materialize(_count_grams(texts, SIZES[1:], PackedBitmap(pairs.select(F.col("fp").alias("h")).distinct(), BITS), 2).where(enough), "longer")
    frequent = pairs.unionByName(longer)
    if by_text or words.groupBy("h").agg(F.count("*").alias("k")).where("k > 1").limit(1).count():
        phrases = _count_phrases(texts, PackedBitmap(frequent.select(F.col("fp").alias("h")).distinct(), BITS)).where(enough)
    else:
        phrases = _phrases_at(texts, frequent)
    return words, materialize(phrases, "phrases")


def _parts(c: Column, start: Column | int, size: Column) -> Column:
    return F.array_join(F.slice(c, start, size), " ")


def score_phrases(words: DataFrame, phrases: DataFrame, inside: int = INSIDE) -> DataFrame:
    """Candidates that no longer one stands for: (lang, phrase, size, a, l, r, n, score, first).

    Every cut of a candidate has its score; the lowest counts, of equals the first. Products are decimals.
    """
    w = F.split("phrase", " ")
    totals = words.groupBy("lang").agg(F.sum("n").alias("total"))
    counts = words.select("lang", F.col("word").alias("part"), F.col("n").alias("c")).unionByName(phrases.select("lang", F.col("phrase").alias("part"), F.col("n").alias("c")))
    cuts = phrases.select("lang", "phrase", "size", "first", F.col("n").alias("a"), w.alias("w"), F.explode(F.sequence(F.lit(1), F.col("size") - 1)).alias("k"))
    cuts = cuts.select("lang", "phrase", "size", "first", "a", "k", _parts(F.col("w"), 1, F.col("k")).alias("left"), _parts(F.col("w"), F.col("k") + 1, F.col("size") - F.col("k")).alias("right"))
    side = lambda part, c: counts.select("lang", F.col("part").alias(part), F.col("c").alias(c))
    cuts = cuts.join(side("left", "l"), ["lang", "left"]).join(side("right", "r"), ["lang", "right"])
    score = F.expr(f"cast({SCALE} as decimal(38,0)) * cast(a as decimal(20,0)) div (cast(l as decimal(20,0)) + cast(r as decimal(20,0)))")
    lowest = cuts.withColumn("score", score).groupBy("lang", "phrase", "size", "first", "a").agg(F.min(F.struct("score", "k", "l", "r")).alias("cut"))

    around = phrases.where("size > 2").select("lang", "size", F.col("n").alias("longer"), w.alias("w"), F.explode(F.sequence(F.lit(2), F.col("size") - 1)).alias("k"))
    around = around.select("lang", "longer", "w", "k", F.explode(F.sequence(F.lit(1), F.col("size") - F.col("k") + 1)).alias("i"))
    around = around.groupBy("lang", _parts(F.col("w"), F.col("i"), F.col("k")).alias("phrase")).agg(F.max("longer").alias("longer"))
    kept = lowest.join(around, ["lang", "phrase"], "left").where(f"longer is null or cast(100 as decimal(38,0)) * longer < cast({inside} as decimal(38,0)) * a")
    rows = kept.join(F.broadcast(totals), "lang") if totals.limit(1001).count() <= 1000 else kept.join(totals, "lang")
    return rows.select("lang", "phrase", "size", "a", F.col("cut.l").alias("l"), F.col("cut.r").alias("r"), F.col("total").alias("n"), F.col("cut.score").alias("score"), "first")


def collocations(docs: DataFrame, text: str = "text", lang: str = "lang", doc_id: str = "doc_id", min_count: int = MIN_COUNT, inside: int = INSIDE, top: int = TOP) -> DataFrame:
    """(lang, rank, phrase, size, a, l, r, n, score, first): each language's best collocations.

    Texts fall into pieces at ``.,;:!?`` and line ends, and those into words at spaces and tabs. a: occurrences of the phrase, l and r:
    those of the parts at the lowest-scoring cut, n: all words of the language. Order: score, a, then the phrase's bytes; phrases differ, so there are no further ties.

    Null and empty texts have no words, a null language is ``und``, rows that repeat count each time, very long texts are read whole (a
    text at a time). An empty table has no rows. Only the three columns named are read, so others may have any names.
    """
    words, phrases = frequent_phrases(docs, text, lang, doc_id, min_count)
    best = [F.desc("score"), F.desc("a"), F.asc("phrase")]
    found = materialize(score_phrases(words, phrases, inside), "scored").withColumn("_salt", F.pmod(F.xxhash64("phrase"), F.lit(SALTS)))
    # A language may hold nearly all phrases: its parts are cut to ``top`` first, so that the last rank sorts so many rows for each part at most.
    found = found.withColumn("_r", F.row_number().over(Window.partitionBy("lang", "_salt").orderBy(*best))).where(F.col("_r") <= top)
    ranked = found.withColumn("rank", F.row_number().over(Window.partitionBy("lang").orderBy(*best))).where(F.col("rank") <= top)
    return ranked.select("lang", "rank", "phrase", "size", "a", "l", "r", "n", "score", "first")
