"""Line dedup within an edit bound of one character, by a deletion-neighbourhood join.

1. Every line with a word becomes a row: its place, a 128-bit hash, and hashes of what stands around each of m segments (for
   its own length, and for that of a line one longer). Equal lines meet by hash; the earliest place stays.
2. Lines within one edit of each other agree outside one segment, so they share a hash. Hashes that two different
   lines share go into a bitmap of bounded size; lines without any have no neighbour and go no further.
3. The others emit their deletion neighbourhood, inside the segments at stake, as hashed keys: the line itself, each
   variant with one character deleted, and each such variant with the place of the gap. A line that equals another's
   variant is one deletion away; lines with the same variant and the same gap are one substitution apart.
4. Equal keys are joined, the earliest place of each is the partner of the later ones, the edit distance of each such
   pair is verified on the texts, and the later line goes.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_type

from mnemoframe.llm.common import batches, broadcast_if_few, materialize
from mnemoframe.llm.filters import HashBitmap
from mnemoframe.llm.hashing import _BASE, _BASE_INV, mix, powers

#: Characters of a line to each edit that it may have: the bound is a twentieth of the line, at most one edit. What is shorter
#: meets its equals only: one edit makes another word, number or mark of it.
MIN_FUZZY = 20
SEGMENTS = 4
#: Characters hashed at once, but for a longer line.
ROOM = 1 << 19
#: Up to so many shared hashes the bitmap is all but exact; more are joined by a shuffle.
BITMAP_HASHES = 4_000_000


class Hashed:
    """Hashes of any parts of some lines, from running sums over their code points."""

    def __init__(self, lines: list[str]) -> None:
        a = np.frombuffer("".join(lines).encode("utf-32-le", "surrogatepass"), np.uint32).astype(np.uint64)
        self.n = np.fromiter(map(len, lines), np.int64, len(lines))
        self.end = np.cumsum(self.n)
        self.start = self.end - self.n
        self.sum = np.zeros(len(a) + 1, np.uint64)
        np.cumsum(mix(a + np.uint64(1)) * powers(_BASE, max(len(a), 1))[: len(a)], out=self.sum[1:])
        self.back = powers(_BASE_INV, len(a) + 2)

    def part(self, a: np.ndarray, z: np.ndarray) -> np.ndarray:
        """Hash of the characters from a to z, as a polynomial that begins at a."""
        return (self.sum[z] - self.sum[a]) * self.back[a]


def segment_keys(lines: list[str], m: int = SEGMENTS) -> np.ndarray:
    """A row of 2m hashes for each line: what stands around segment j, for its own length and as a line one longer would be cut."""
    h, out = Hashed(lines), []
    n, start, end = (v[:, None] for v in (h.n, h.start, h.end))
    for longer in (0, 1):
        size = n + longer
        cut = np.arange(m + 1) * size // m
        head = h.part(np.broadcast_to(start, (len(lines), m)), start + np.minimum(cut[:, :-1], n))
        tail = h.part(end - np.minimum(size - cut[:, 1:], n), np.broadcast_to(end, (len(lines), m)))
        out.append(mix(head * np.uint64(31) + mix(tail) + (size * 64 + np.arange(m)).astype(np.uint64)))
    return np.concatenate(out, axis=1).view(np.int64)


def variants(line: str, segments: list[int], m: int = SEGMENTS) -> tuple[np.ndarray, np.ndarray]:
    """(key, role) of the deletion neighbourhood for edits inside the given segments.

    role 0: the line itself, 1: one character deleted, 2: one character deleted and the place of the gap.
    """
    h = Hashed([line])
    n = len(line)
    places = np.zeros(n, bool)
    for s in segments:
        places[s * n // m : (s + 1) * n // m] = True
    i = np.flatnonzero(places)
    gone = h.sum[i] + h.part(i + 1, np.full(len(i), n)) * powers(_BASE, n + 2)[i]
    own = mix(h.sum[-1:] + np.uint64(n << 1))
    deleted = mix(gone + np.uint64((n - 1) << 1))
    gap = mix(gone + mix(i.astype(np.uint64) + np.uint64(77)))
    return np.concatenate([own, deleted, gap]).view(np.int64), np.repeat([0, 1, 2], [1, len(i), len(i)]).astype(np.int32)


def within_one(a: str, b: str) -> bool:
    """Edit distance at most one."""
    if len(a) > len(b):
        a, b = b, a
    if len(b) - len(a) > 1:
        return False
    n, same, step = len(a), 0, 1 << 12
    while same < n and a[same : same + step] == b[same : same + step]:
        same += step
    same = min(same, n)
    while same < n and a[same] == b[same]:
        same += 1
    return a[same + (len(a) == len(b)) :] == b[same + 1 :]


def _split(b: pa.RecordBatch) -> Iterator[tuple[list[dict], list[str]]]:
    """(places, lines) of the lines with a word, so many at once as there is room. Columns: order, text_hash, text."""
    places: list[dict] = []
    lines: list[str] = []
    held = 0
    for order, h, t in zip(*(b.column(k).to_pylist() for k in range(3)), strict=True):
        for i, line in enumerate((t or "").split("\n")):
            if line.encode("utf-8", "surrogatepass").strip():
                places.append({"order": order, "text_hash": h, "line": i})
                lines.append(line)
                held += len(line)
                if held > ROOM:
                    yield places, lines
                    places, lines, held = [], [], 0
    if lines:
        yield places, lines


def _identity(lines: list[str]) -> np.ndarray:
    """128 bits of each line, as two int64."""
    return np.frombuffer(b"".join(hashlib.md5(x.encode("utf-8", "surrogatepass"), usedforsecurity=False).digest() for x in lines), np.int64).reshape(-1, 2)


def _place(texts: DataFrame) -> tuple[str, pa.DataType]:
    """A place's type, by that of the order."""
    order = texts.schema["_order"].dataType
    return f"struct<order:{order.simpleString()}, text_hash:bigint, line:int>", pa.struct([("order", to_arrow_type(order)), ("text_hash", pa.int64()), ("line", pa.int32())])


def _lines(texts: DataFrame, m: int, least: int | None) -> DataFrame:
    place, kind = _place(texts)

    def rows(it: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches(it, 500):
            for places, lines in _split(b):
                h, keys = _identity(lines), np.empty((0, 2 * m), np.int64)
                long = np.array([least is not None and len(x) >= least for x in lines])
                if long.any():
                    keys = segment_keys([x for x, y in zip(lines, long, strict=True) if y], m)
                bounds = np.concatenate([[0], np.cumsum(long * 2 * m)]).astype(np.int32)
                yield pa.RecordBatch.from_arrays(
                    [pa.array(places, kind), pa.array(h[:, 0]), pa.array(h[:, 1]), pa.ListArray.from_arrays(pa.array(bounds), pa.array(keys.reshape(-1)))], names=["place", "h1", "h2", "keys"]
                )

    return texts.mapInArrow(rows, f"place {place}, h1 bigint, h2 bigint, keys array<bigint>")


def _near_lines(texts: DataFrame, shared: DataFrame, m: int, least: int) -> DataFrame:
    """(place, segs, text): each different line that shares a hash, at its earliest place."""
    place, kind = _place(texts)
    known = HashBitmap(shared.select(F.col("key").alias("h")))
    exact = known.count > BITMAP_HASHES

    def rows(it: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches(it, 500):
            for places, lines in _split(b):
                at = np.array([i for i, x in enumerate(lines) if len(x) >= least], np.int64)
                if not len(at):
                    continue
                keys = segment_keys([lines[i] for i in at], m)
                hit = np.zeros(keys.size, bool)
                hit[known.passes(keys.reshape(-1).view(np.uint64))] = True
                hit = hit.reshape(keys.shape)
                near = np.flatnonzero(hit.any(axis=1))
                own = [lines[at[i]] for i in near]
                if own:
                    h = _identity(own)
                    yield pa.RecordBatch.from_arrays(
                        [pa.array([places[at[i]] for i in near], kind), pa.array(h[:, 0]), pa.array(h[:, 1]), pa.array([np.flatnonzero(hit[i]).tolist() for i in near], pa.list_(pa.int32())), pa.array([keys[i][hit[i]] for i in near], pa.list_(pa.int64())), pa.array(own, pa.string())],
                        names=["place", "h1", "h2", "segs", "keys", "text"],
                    )

    found = texts.mapInArrow(rows, f"place {place}, h1 bigint, h2 bigint, segs array<int>, keys array<bigint>, text string")
    found = found.groupBy("h1", "h2").agg(F.min("place").alias("place"), F.first("segs").alias("segs"), F.first("keys").alias("keys"), F.first("text").alias("text"))
    if exact:  # the bitmap is too full to be all but exact
        found = materialize(found, "near_candidates")
        true = found.select("h1", "h2", F.explode("keys").alias("key")).join(shared, "key", "left_semi").select("h1", "h2").distinct()
        found = found.join(true, ["h1", "h2"], "left_semi")
    return materialize(found.select("place", "segs", "text"), "near_lines")


def _fuzzy_drops(near: DataFrame, m: int) -> DataFrame:
    """Places of lines that come after a line within one edit."""

    def emit(it: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches(it, 200):
            found = [variants(t, [k for k in s if k < m], m) for s, t in zip(b.column(1).to_pylist(), b.column(2).to_pylist(), strict=True)]
            own = np.repeat(np.arange(b.num_rows), [len(k) for k, _ in found])
            yield pa.RecordBatch.from_arrays([b.column(0).take(pa.array(own)), pa.array(np.concatenate([k for k, _ in found])), pa.array(np.concatenate([r for _, r in found]))], names=["id", "key", "role"])

    # Places are ranked once, so that a key's row is three numbers.
    ranked = materialize(near.select(F.xxhash64("place").alias("id"), "segs", "text", "place"), "ranked")
    order = ranked.select("id", "place")
    emitted = ranked.select("id", "segs", "text").mapInArrow(emit, "id bigint, key bigint, role int")
    sides = emitted.groupBy("key").agg(F.count_if(F.col("role") == 0).alias("a"), F.count_if(F.col("role") == 1).alias("b"), F.count_if(F.col("role") == 2).alias("c"))
    joint = sides.where("(a > 0 and b > 0) or c > 1").select("key")
    meet = emitted.join(joint, "key").join(order, "id")
    least = lambda role: F.min(F.when(F.col("role") == role, F.col("place")))
    groups = meet.groupBy("key").agg(least(0).alias("own"), least(1).alias("shorter"), least(2).alias("gap"))
    # A line is one deletion from the variants that equal it, and variants with the same gap are one substitution apart.
    partner = F.when(F.col("role") == 0, F.col("shorter")).when(F.col("role") == 1, F.col("own")).otherwise(F.col("gap"))
    pairs = meet.join(groups, "key").select("place", partner.alias("other")).where("other < place").distinct()
    both = pairs.join(near.select("place", F.col("text").alias("a")), "place").join(near.select(F.col("place").alias("other"), F.col("text").alias("b")), "other")

    def verify(it: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in it:
            good = [within_one(x, y) for x, y in zip(b.column(1).to_pylist(), b.column(2).to_pylist(), strict=True)]
            yield pa.RecordBatch.from_arrays([b.column(0).filter(pa.array(good, pa.bool_()))], names=["place"])

    return both.select("place", "a", "b").mapInArrow(verify, f"place {near.schema["place"].dataType.simpleString()}").distinct()


def dedup_lines(
    docs: DataFrame, text: str = "text", doc_id: str = "doc_id", n_chars: str = "n_chars", max_edits: int = 1, min_fuzzy: int = MIN_FUZZY, segments: int = SEGMENTS, report: bool = False
) -> DataFrame:
    """``docs`` without lines that come after an equal one, or one within an edit, anywhere in the corpus.

    Order: doc_id (whole numbers, or anything else as text; null ids last; different texts of one id by their hash), then line. Rows that repeat both id and text
    have the same places and lose the same lines. A line goes if any earlier line is within ``max_edits`` (0 or 1) edits,
    whether that one stays or not; lines under ``min_fuzzy`` characters only go for an equal one. Lines without a word
    stay. The others are joined by \\n again; a text that loses all its lines becomes empty, and a column ``n_chars``, if
    there is one, is set anew where a text changed. Null texts stay null. Every row gives one row.
    report: adds n_lines and n_dropped (replacing columns of those names).
    """
    if max_edits not in (0, 1):
        raise ValueError("max_edits is 0 or 1")
    cols = [c for c in docs.columns if not (report and c in ("n_lines", "n_dropped"))]
    whole = docs.schema[doc_id].dataType.typeName() in ("byte", "short", "integer", "long")
    order = F.coalesce(F.col(f"`{doc_id}`").cast("bigint"), F.lit((1 << 63) - 1)) if whole else F.coalesce(F.col(f"`{doc_id}`").cast("string"), F.lit("\U0010ffff"))
    named = docs.select(*[F.col(f"`{c}`").alias(f"_c{i}") for i, c in enumerate(cols)], order.alias("_order"), F.xxhash64(F.col(f"`{text}`")).alias("_hash"))
    at = f"_c{cols.index(text)}"
    texts = named.select("_order", "_hash", at)
    lines = materialize(_lines(texts, segments, min_fuzzy if max_edits else None), "lines")
    first = lines.groupBy("h1", "h2").agg(F.min("place").alias("least"), F.max("place").alias("last")).where("least <> last").select("h1", "h2", "least")
    first = materialize(first, "repeated")  # read back, it is joined by a shuffle of its own, whose large partitions can be split
    drops = lines.select("h1", "h2", "place").join(first, ["h1", "h2"]).where("place <> least").select("place")
    if max_edits:
        keys = lines.select(F.explode("keys").alias("key"), F.col("h1").alias("h"))
        shared = keys.groupBy("key").agg(F.min("h").alias("a"), F.max("h").alias("z")).where("a <> z").select("key")
        shared = materialize(shared, "shared_keys")
        # What repeats a line that goes here has gone already: it isn't the earliest of its equals.
        drops = drops.unionByName(_fuzzy_drops(_near_lines(texts, shared, segments, min_fuzzy), segments))
    gone = drops.groupBy(F.col("place.order").alias("_order"), F.col("place.text_hash").alias("_hash")).agg(F.collect_set("place.line").alias("_gone"))
    rows = named.join(broadcast_if_few(gone, "gone", "_gone") if whole else gone, ["_order", "_hash"], "left")
    parts = F.split(F.col(at), "\n", -1)
    kept = F.array_join(F.filter(parts, lambda x, i: ~F.array_contains("_gone", i)), "\n")
    new = {c: F.col(f"_c{i}") for i, c in enumerate(cols)}
    new[text] = F.when(F.col("_gone").isNull(), F.col(at)).otherwise(kept)
    if n_chars in new:
        new[n_chars] = F.when(F.col("_gone").isNull(), new[n_chars]).otherwise(F.length(kept).cast(docs.schema[n_chars].dataType))
    if report:
        new["n_lines"] = F.coalesce(F.size(parts), F.lit(0)).cast("bigint")
        new["n_dropped"] = F.coalesce(F.size("_gone"), F.lit(0)).cast("bigint")
    return rows.select(*[v.alias(k) for k, v in new.items()])
