"""Benchmark decontamination as a prefix-filtered containment join.

A benchmark item is cut into windows of 13 consecutive words (a shorter item is one window). A window's tokens are its
5-word shingles. Tokens are ordered by how often they occur in the documents, rarest first; since a window must be
contained whole, its rarest token alone is a necessary prefix. Documents are joined with the prefixes by token, the
token's place in window and document gives the only possible start (positional bound), the window must fit before the
document's end (length bound), and the words there are compared one by one.

A bitmap of the tokens' hashes, of bounded size, keeps all other shingles from leaving the scan.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from mnemoframe.llm.common import add_columns, batches, broadcast_if_few, materialize
from mnemoframe.llm.filters import HashBitmap
from mnemoframe.llm.hashing import words_of

WINDOW = 13
SHINGLE = 5
#: A document is contaminated if at least one word in so many is hit.
SHARE = 20
#: log2 of the bitmap's bits: so many for each token, and so many at most (16 MB).
BITS_PER_TOKEN, MAX_BITS = 8, 27
#: A-Z lower-cased; what is neither a digit, a letter a-z nor beyond ASCII is a space.
WORD_BYTES = bytes(c + 32 if 65 <= c <= 90 else c if 48 <= c <= 57 or 97 <= c <= 122 or c >= 128 else 32 for c in range(256))


def _windows(items: DataFrame, item_id: str, text: str, window: int, k: int) -> DataFrame:
    """(item, words, size, tokens): tokens holds the hash of each shingle of min(k, size) words."""
    named = items.select(F.coalesce(F.col(f"`{item_id}`").cast("string"), F.lit("")).alias("item"), F.col(f"`{text}`").alias("text"))

    def cut(it: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches(it, 1000):
            rows: list[tuple] = []
            for item, t in zip(b.column(0).to_pylist(), b.column(1).to_pylist(), strict=True):
                w = words_of([t], WORD_BYTES)
                n = len(w.value)
                size = min(window, n)
                if n:
                    words = w.raw.split()
                    _, h = w.shingles(min(k, size))
                    h = h.view(np.int64)
                    rows += [(item, b" ".join(words[i : i + size]).decode("utf-8", "surrogatepass"), size, h[i : i + size - min(k, size) + 1].tolist()) for i in range(n - size + 1)]
            yield pa.RecordBatch.from_arrays([pa.array([r[j] for r in rows], kind) for j, kind in enumerate((pa.string(), pa.string(), pa.int32(), pa.list_(pa.int64())))], names=["item", "words", "size", "tokens"])

    return named.mapInArrow(cut, "item string, words string, size int, tokens array<bigint>")


class TokenFilter(HashBitmap):
    """A bitmap of token hashes, and the shingle sizes of the tokens."""

    def __init__(self, tokens: DataFrame) -> None:
        """tokens: distinct values in column token, and their shingle size in column k."""
        super().__init__(tokens.select(F.col("token").alias("h")), BITS_PER_TOKEN, MAX_BITS)
        self.sizes = sorted(r.k for r in tokens.select("k").distinct().collect())  # at most WINDOW values


def _token_counts(docs: DataFrame, text: str, known: TokenFilter) -> DataFrame:
    def count(it: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches(it, 250):
            w = words_of(b.column(0).to_pylist(), WORD_BYTES)
            found = [h[known.passes(h)] for h in (w.shingles(k)[1] for k in known.sizes)]
            token, n = np.unique(np.concatenate([*found, np.empty(0, np.uint64)]), return_counts=True)
            yield pa.RecordBatch.from_arrays([pa.array(token.view(np.int64)), pa.array(n.astype(np.int64))], names=["token", "n"])

    return docs.select(F.col(f"`{text}`")).mapInArrow(count, "token bigint, n bigint").groupBy("token").agg(F.sum("n").alias("n"))


def _matches(texts: list[str | None], known: TokenFilter, window: int) -> dict:
    """Per text: number of words, and (token, pos, before, near) of each possible token, near being the words around it."""
    w = words_of(texts, WORD_BYTES)
    found: list[list[dict]] = [[] for _ in texts]
    for k in known.sizes:
        at, h = w.shingles(k)
        hit = known.passes(h)
        at, h = at[hit], h[hit]
        owner = np.searchsorted(w.first, at, "right") - 1
        low, high = np.maximum(at - window + 1, w.first[owner]), np.minimum(at + k + window - 1, w.first[owner + 1])
        rows = zip(owner.tolist(), h.view(np.int64).tolist(), (at - w.first[owner]).tolist(), (at - low).tolist(), w.start[low].tolist(), w.end[high - 1].tolist(), strict=True)
        for o, token, pos, before, a, z in rows:
            found[o].append({"token": token, "pos": pos, "before": before, "near": b" ".join(w.raw[a:z].split()).decode("utf-8", "surrogatepass")})
    return {"_n_words": np.diff(w.first), "_matches": found}


def contamination(
    docs: DataFrame, items: DataFrame, text: str = "text", item_id: str = "item_id", item_text: str = "text",
    keep: list[str] | None = None, window: int = WINDOW, shingle: int = SHINGLE, share: int = SHARE,
) -> DataFrame:
    """``docs`` (or its columns ``keep``) with n_words, n_hit, item_ids (sorted as strings), contaminated.

    n_hit: words inside any occurrence of any window. Every input row, repeated or not, gives one row; null and empty
    texts have no words and aren't contaminated. Items without words have no window; an item with a null id counts as one
    with an empty id, and items that share an id count once. Either table may be empty. Input columns named like a new
    one are replaced.
    """
    new = ("n_words", "n_hit", "item_ids", "contaminated")
    cols = [c for c in (docs.columns if keep is None else keep) if c not in new]
    windows = materialize(_windows(items, item_id, item_text, window, shingle), "windows")
    texts = windows.groupBy("words").agg(F.first("size").alias("size"), F.first("tokens").alias("tokens"))
    tokens = texts.select("words", "size", F.least("size", F.lit(shingle)).alias("k"), F.posexplode("tokens").alias("offset", "token"))
    counts = _token_counts(docs, text, TokenFilter(tokens.select("token", "k").distinct()))
    rarest = tokens.join(counts, "token", "left").groupBy("words", "size", "k").agg(F.min(F.struct(F.coalesce("n", F.lit(0)).alias("n"), "token", "offset")).alias("t"))
    prefixes = materialize(rarest.where("t.n > 0").select("words", "size", "k", "t.token", "t.offset"), "prefixes")

    known = TokenFilter(prefixes.select("token", "k").distinct())
    named = docs.select(*[F.col(f"`{c}`").alias(f"_c{i}") for i, c in enumerate(cols)], F.monotonically_increasing_id().alias("_row"), F.col(f"`{text}`").alias("_text"))
    scanned = add_columns(
        named, "_text", "_n_words bigint, _matches array<struct<token:bigint, pos:bigint, before:int, near:string>>",
        lambda t: _matches(t, known, window), [c for c in named.columns if c != "_text"], rows=250,
    )
    scanned = materialize(scanned, "scanned")
    some = scanned.select("_row", "_n_words", F.explode("_matches").alias("m")).select("_row", "_n_words", "m.*")
    pairs = some.join(prefixes, "token").where("offset <= pos and pos - offset + size <= _n_words")
    same = F.array_join(F.slice(F.split("near", " "), F.col("before") - F.col("offset") + 1, F.col("size")), " ") == F.col("words")
    found = pairs.where(same).select("_row", "words", (F.col("pos") - F.col("offset")).alias("start"), "size")

    spans = F.array_distinct(F.flatten(F.transform(F.collect_set(F.struct("start", "size")), lambda s: F.sequence(s["start"], s["start"] + s["size"] - 1))))
    hit = found.groupBy("_row").agg(F.size(spans).cast("bigint").alias("n_hit"))
    ids = found.select("_row", "words").distinct().join(windows.select("words", "item").distinct(), "words").groupBy("_row").agg(F.array_sort(F.collect_set("item")).alias("item_ids"))
    out = scanned.drop("_matches").join(hit.join(ids, "_row"), "_row", "left")
    n_hit = F.coalesce("n_hit", F.lit(0).cast("bigint"))
    return out.select(
        *[F.col(f"_c{i}").alias(c) for i, c in enumerate(cols)], F.col("_n_words").alias("n_words"), n_hit.alias("n_hit"),
        F.coalesce("item_ids", F.array().cast("array<string>")).alias("item_ids"), ((n_hit > 0) & (share * n_hit >= F.col("_n_words"))).alias("contaminated"),
    )


def drop_contaminated(docs: DataFrame, items: DataFrame, text: str = "text", **how) -> DataFrame:
    """The rows of ``docs`` that aren't contaminated, with their own columns.

    Whether a row goes follows from its text alone, so texts are known by 128 bits of hash, and what is joined back are the hashes of those that go; while
    these are few, texts aren't shuffled. Null and empty texts stay, rows that repeat go or stay together, an empty table gives no rows.
    """
    body = F.col(f"`{text}`")
    keys = [F.xxhash64(body).alias("_h1"), F.xxhash64(F.lit(1), body).alias("_h2")]
    bad = contamination(docs.select(*keys, body.alias("_t")), items, "_t", keep=["_h1", "_h2"], **how).where("contaminated").select("_h1", "_h2").distinct()
    named = docs.select(F.struct(*[F.col(f"`{c}`") for c in docs.columns]).alias("_doc"), *keys)
    return named.join(broadcast_if_few(bad, "contaminated"), ["_h1", "_h2"], "left_anti").select("_doc.*")
