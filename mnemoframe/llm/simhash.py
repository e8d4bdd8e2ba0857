"""SimHash near-duplicates with a Gray-order hierarchical index.

Fingerprints: 64 bits, each the majority over the XXH64 hashes of a text's 4-word shingles. Texts whose fingerprints
differ in at most 4 bits are linked, and linked texts form components.

Distribution: equal fingerprints are one node. A fingerprint is cut into six blocks; of two that differ in at most four
bits, at least two blocks agree, so each node goes to the 15 groups named by a pair of blocks and their bits, and each link
shows in one group at least. A group that is too large for a task is cut into chunks, and each two chunks meet in a task of their own.

Search: inside a task the other blocks' bits are sorted by Gray rank, which puts codes side by side that differ in few bits
anywhere, not only behind a common prefix. Each FAN neighbours get a node above them with the masked pattern that they share: the
bits, at whatever places, in which all of them agree. Nodes get nodes above them in turn, up to one for a group. Pairs of
nodes are followed from the top: on the way down only bits that the pair above didn't know are compared, their
differences are added to those so far, and a pair over the bound is dropped with all below it. What is left at the leaves
are the links, of which a task returns a spanning star for each component that it sees.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass
from itertools import combinations

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from mnemoframe.llm.common import add_columns, broadcast_if_few, materialize
from mnemoframe.llm.graphs import components

SHINGLE = 4
SEED = 42
MAX_BITS = 4
#: (first bit, bits) of each block, from the top.
BLOCKS = ((53, 11), (42, 11), (31, 11), (20, 11), (10, 10), (0, 10))
#: Fingerprints that a task searches together at most.
GROUP = 2048
#: Neighbours in Gray order that share a node of the index.
FAN = 4


def fingerprint(text: str | None, k: int = SHINGLE) -> int:
    """Signed 64 bits. Zero without words."""
    words = (text or "").encode("utf-8", "surrogatepass").lower().split()
    if not words:
        return 0
    joined = b" ".join(words)
    size = np.fromiter(map(len, words), np.int64, len(words)) + 1
    start = np.concatenate([[0], np.cumsum(size)])
    n = max(1, len(words) - k + 1)
    a, z = start[:n].tolist(), (start[min(k, len(words)) :] - 1).tolist()
    ones = np.zeros(64, np.int64)
    digest = xxhash.xxh64_intdigest
    for i in range(0, n, 1 << 16):
        h = np.array([digest(joined[x:y], SEED) for x, y in zip(a[i : i + (1 << 16)], z[i : i + (1 << 16)], strict=True)], np.uint64)
        ones += np.unpackbits(h.view(np.uint8).reshape(-1, 8), axis=1, bitorder="little").sum(axis=0, dtype=np.int32)
    return int(np.packbits(2 * ones > n, bitorder="little").view(np.int64)[0])


def with_fingerprints(docs: DataFrame, text: str = "text", keep: list[str] | None = None) -> DataFrame:
    return add_columns(docs, text, "fingerprint bigint", lambda texts: {"fingerprint": np.array([fingerprint(t) for t in texts], np.int64)}, keep)


def _keys(fp: Column) -> list[Column]:
    """The group of each pair of blocks."""
    bits = [F.shiftrightunsigned(fp, at).bitwiseAND((1 << n) - 1) for at, n in BLOCKS]
    return [F.lit(c << 22).cast("bigint").bitwiseOR(F.shiftleft(bits[i], 11)).bitwiseOR(bits[j]) for c, (i, j) in enumerate(combinations(range(len(BLOCKS)), 2))]


def _grouped(nodes: DataFrame, group: int) -> DataFrame:
    """(key, i, j, fp): what meets in a task. i, j: the chunks of a large group that meet."""
    rows = nodes.select("fp", F.explode(F.array(*_keys(F.col("fp")))).alias("key"))
    large = rows.groupBy("key").agg(F.count("*").alias("n")).where(F.col("n") > group).select("key", F.expr(f"cast(ceil(2.0D * n / {group}) as int)").alias("chunks"))
    rows = rows.join(large, "key", "left")
    small = rows.where("chunks is null").select("key", F.lit(0).alias("i"), F.lit(0).alias("j"), "fp")
    own = F.pmod(F.xxhash64("fp"), F.col("chunks")).cast("int")
    meet = rows.where("chunks is not null").withColumn("own", own).select("key", "own", F.explode(F.sequence(F.lit(0), F.col("chunks") - 1)).alias("other"), "fp")
    return small.unionByName(meet.select("key", F.least("own", "other").alias("i"), F.greatest("own", "other").alias("j"), "fp"))


def _rest(key: np.ndarray, fp: np.ndarray) -> np.ndarray:
    """The bits that the group doesn't fix, at the top of 64."""
    out = np.zeros(len(fp), np.uint64)
    for c, pair in enumerate(combinations(range(len(BLOCKS)), 2)):
        at = np.flatnonzero(key >> 22 == c)
        room = 64
        for b, (first, n) in enumerate(BLOCKS):
            if b not in pair:
                room -= n
                out[at] |= ((fp[at] >> np.uint64(first)) & np.uint64((1 << n) - 1)) << np.uint64(room)
    return out


def _gray_rank(x: np.ndarray) -> np.ndarray:
    for s in (1, 2, 4, 8, 16, 32):
        x = x ^ (x >> np.uint64(s))
    return x


def _spread(low: np.ndarray, count: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(row, value) for each value in low[row] .. low[row] + count[row] - 1."""
    row = np.repeat(np.arange(len(count)), count)
    return row, np.arange(len(row)) - np.repeat(np.cumsum(count) - count, count) + low[row]


@dataclass
class Level:
    """Nodes in order. What a node's members share: at the places of mask, bits. Its children in the level below: first, count."""

    bits: np.ndarray
    mask: np.ndarray
    first: np.ndarray
    count: np.ndarray


def index_of(root: np.ndarray, code: np.ndarray, fan: int = FAN) -> list[Level]:
    """Levels from the codes, in the order given, up to one node for each run of equal roots."""
    none = np.zeros(0, np.int64)
    levels = [Level(code, np.full(len(code), ~np.uint64(0)), none, none)]
    while True:
        starts = np.flatnonzero(np.concatenate([[True], root[1:] != root[:-1]]))
        if len(starts) == len(root):
            return levels
        size = np.diff(np.append(starts, len(root)))
        first = np.flatnonzero((np.arange(len(root)) - np.repeat(starts, size)) % fan == 0)
        below = levels[-1]
        every, some = np.bitwise_and.reduceat(below.bits, first), np.bitwise_or.reduceat(below.bits, first)
        mask = np.bitwise_and.reduceat(below.mask, first) & ~(every ^ some)
        levels.append(Level(every & mask, mask, first, np.diff(np.append(first, len(root)))))
        root = root[first]


def links_of(root: np.ndarray, code: np.ndarray, max_bits: int = MAX_BITS, visited: list[int] | None = None) -> tuple[np.ndarray, np.ndarray]:
    """Index pairs of rows of the same root (ascending) whose codes, in Gray order inside a root, differ in at most max_bits bits.

    visited: gets the number of pairs of nodes that were compared.
    """
    levels = index_of(root, code)
    top = levels[-1]
    u = v = np.arange(len(top.bits))
    acc, known = np.zeros(len(u), np.int64), top.mask
    for above, below in zip(levels[:0:-1], levels[-2::-1], strict=True):
        pair, left = _spread(above.first[u], above.count[u])
        again, right = _spread(above.first[v][pair], above.count[v][pair])
        pair, left = pair[again], left[again]
        once = left <= right  # of a node with itself each pair of children comes twice
        pair, left, right = pair[once], left[once], right[once]
        if visited is not None:
            visited.append(len(pair))
        both = below.mask[left] & below.mask[right]
        acc = acc[pair] + np.bitwise_count((below.bits[left] ^ below.bits[right]) & both & ~known[pair])
        near = acc <= max_bits
        u, v, acc, known = left[near], right[near], acc[near], both[near]
    different = u != v
    return u[different], v[different]


def _stars(n: int, u: np.ndarray, v: np.ndarray) -> np.ndarray:
    """The least index of each index's component."""
    label = np.arange(n)
    while True:
        low = np.minimum(label[u], label[v])
        new = label.copy()
        np.minimum.at(new, u, low)
        np.minimum.at(new, v, low)
        new = new[new]
        if np.array_equal(new, label):
            return label
        label = new


def _search(it: Iterator[pa.RecordBatch], max_bits: int, room: int = 4_000_000) -> Iterator[pa.RecordBatch]:
    """Rows come sorted by (key, i, j). Groups are searched together while their pairs have room."""

    def emit(key: np.ndarray, group: np.ndarray, fp: np.ndarray) -> Iterator[pa.RecordBatch]:
        size = np.diff(np.append(np.flatnonzero(np.concatenate([[True], group[1:] != group[:-1]])), len(group)))
        many = np.repeat(size > 1, size)
        key, group, fp, size = key[many], group[many], fp[many], size[size > 1]
        if not len(fp):
            return
        ends = np.cumsum(size)
        part = (np.cumsum(size * size) // room).astype(np.int64)
        for p in np.unique(part):
            mine = np.flatnonzero(part == p)
            a, z = ends[mine[0]] - size[mine[0]], ends[mine[-1]]
            code = _rest(key[a:z], fp[a:z])
            order = np.lexsort((_gray_rank(code), group[a:z]))
            u, v = links_of(group[a:z][order], code[order], max_bits)
            if len(u):
                label = _stars(z - a, u, v)
                child = np.flatnonzero(label != np.arange(z - a))
                own = fp[a:z][order].view(np.int64)
                yield pa.RecordBatch.from_arrays([pa.array(own[child]), pa.array(own[label[child]])], names=["u", "v"])

    held: list[np.ndarray] = []
    count = 0
    for b in it:
        key, i, j, fp = (b.column(k).to_numpy(zero_copy_only=False) for k in range(4))
        if not len(key):
            continue
        rows = np.stack([key, (i.astype(np.int64) << 32) | j.astype(np.int64), fp])
        rows = np.concatenate([*held, rows], axis=1)
        last = np.flatnonzero((rows[0] != rows[0, -1]) | (rows[1] != rows[1, -1]))
        cut = last[-1] + 1 if len(last) else 0
        held = [rows[:, cut:]]
        if cut:
            done = rows[:, :cut]
            change = np.concatenate([[True], (done[0, 1:] != done[0, :-1]) | (done[1, 1:] != done[1, :-1])])
            yield from emit(done[0], np.cumsum(change) + count, done[2].view(np.uint64))
            count += cut
    for rows in held:
        yield from emit(rows[0], np.zeros(rows.shape[1], np.int64), rows[2].copy().view(np.uint64))


def link_edges(nodes: DataFrame, max_bits: int = MAX_BITS, group: int = GROUP) -> DataFrame:
    """(u, v): edges that connect what is linked. nodes: distinct fingerprints in column fp."""
    if max_bits > len(BLOCKS) - 2:
        raise ValueError(f"at most {len(BLOCKS) - 2} differing bits")
    rows = _grouped(nodes, group).repartition("key", "i", "j").sortWithinPartitions("key", "i", "j")
    return rows.mapInArrow(lambda it: _search(it, max_bits), "u bigint, v bigint").distinct()


def _components(fps: DataFrame, doc_id: str, max_bits: int) -> DataFrame:
    """(fp, first): first is the (doc_id, row) of the component's smallest doc_id, null ids last, ties by row."""
    nodes = materialize(fps.groupBy(F.col("fingerprint").alias("fp")).agg(F.min(F.struct(F.col(doc_id).isNull().alias("none"), F.col(doc_id).alias("id"), F.col("_row").alias("row"))).alias("first")), "nodes")
    roots = components(link_edges(nodes.select("fp"), max_bits))
    linked = nodes.join(roots, F.col("fp") == F.col("node"), "left").select("fp", F.coalesce("root", "fp").alias("root"), "first")
    return linked.join(linked.groupBy("root").agg(F.min("first").alias("least")), "root").select(F.col("fp").alias("fingerprint"), "least")


def near_duplicates(docs: DataFrame, text: str = "text", doc_id: str = "doc_id", keep: list[str] | None = None, max_bits: int = MAX_BITS) -> DataFrame:
    """``docs`` (or its columns ``keep``, doc_id among them) with fingerprint (bigint), component_id and is_first.

    component_id is the smallest doc_id reachable over links; is_first holds for one row of each component, that with this
    id (the first of rows that repeat it). Null and empty texts have fingerprint zero and are linked like any other; a null
    id is smaller than none, and a component of null ids alone has a null component_id.
    """
    cols = [c for c in (docs.columns if keep is None else keep) if c not in ("fingerprint", "component_id", "is_first")]
    named = docs.select(*[F.col(f"`{c}`").alias(f"_c{i}") for i, c in enumerate(cols)], F.col(f"`{doc_id}`").alias("_id"), F.monotonically_increasing_id().alias("_row"), F.col(f"`{text}`").alias("_text"))
    fps = materialize(with_fingerprints(named, "_text", [c for c in named.columns if c != "_text"]), "fingerprints")
    found = fps.join(_components(fps.select("_id", "_row", "fingerprint"), "_id", max_bits), "fingerprint", "left")
    return found.select(*[F.col(f"_c{i}").alias(c) for i, c in enumerate(cols)], "fingerprint", F.col("least.id").alias("component_id"), (F.col("least.row") == F.col("_row")).alias("is_first"))


def keep_one(docs: DataFrame, text: str = "text", doc_id: str = "doc_id", max_bits: int = MAX_BITS) -> DataFrame:
    """One row of each component, with the columns of ``docs``: that with the smallest doc_id, the first of rows that repeat it.

    Rows are written with their number and fingerprint; what is joined back are the numbers of those that go, so that texts aren't shuffled while these are few.
    Null and empty texts are alike and leave one row; an empty table gives no rows.
    """
    named = docs.select(F.struct(*[F.col(f"`{c}`") for c in docs.columns]).alias("_doc"), F.col(f"`{doc_id}`").alias("_id"), F.monotonically_increasing_id().alias("_row"), F.col(f"`{text}`").alias("_text"))
    rows = materialize(with_fingerprints(named, "_text", ["_doc", "_id", "_row"]), "fingerprints")
    narrow = rows.select("_id", "_row", "fingerprint")
    least = _components(narrow, "_id", max_bits).select("fingerprint", F.col("least.row").alias("_first"))
    gone = narrow.join(least, "fingerprint").where("_row <> _first").select("_row")
    return rows.join(broadcast_if_few(gone, "gone"), "_row", "left_anti").select("_doc.*")
