"""MinHash near-duplicates, verified in sequence by a Bayesian bound and then exactly.

A text's set is that of its distinct five-word shingles. Texts with equal sets are one node. Each node has a signature of minima
under independent hashes, cut into bands; nodes that agree in a band are candidates. There are as many bands as the chosen
miss probability asks for at the threshold.

Of two candidates the signatures are compared batch by batch. With a uniform prior, after m agreements in n the similarity is distributed
as Beta(m + 1, n - m + 1); a pair goes as soon as the posterior probability that it reaches the threshold is below its share of the miss
probability. What survives is verified on the full sets.

Pairs inside a bucket aren't enumerated:

1. In each bucket the node that meets most others leads, and the others are compared with it alone. Links make components.
2. A bucket of nodes that are all in one component is done. In the others, tasks compare nodes of different components, each pair in
   the first band that it shares, and report links that join two components. Large buckets are cut into chunks of bounded size, of which each two meet in a task.

So each candidate pair is either compared or inside one component already, and no link between components is lost.
"""

from __future__ import annotations

import math
from collections.abc import Iterator
from dataclasses import dataclass
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from mnemoframe.llm.common import batches, materialize
from mnemoframe.llm.filters import PackedBitmap
from mnemoframe.llm.graphs import components
from mnemoframe.llm.hashing import Words, mix, words_of

SHINGLE = 5
#: Hundredths of similarity at which two sets are linked.
THRESHOLD = 85
#: Probability that a pair at the threshold is missed, half of it by the bands and half by the comparison of signatures.
MISS = 1e-6
#: Minima in a band.
ROWS = 6
#: Batches in which signatures are compared.
STEPS = 6
#: Nodes, and bytes of their sets, that a task compares at once.
GROUP, GROUP_BYTES = 1024, 64 << 20
#: A-Z lower-cased, white space a space.
WORD_BYTES = bytes(c + 32 if 65 <= c <= 90 else 32 if 9 <= c <= 13 else c for c in range(256))


@dataclass(frozen=True)
class Plan:
    """Numbers that follow from threshold, rows of a band and miss probability."""

    threshold: int = THRESHOLD
    rows: int = ROWS
    miss: float = MISS

    @property
    def bands(self) -> int:
        return max(1, math.ceil(math.log(self.miss / 2) / math.log1p(-((self.threshold / 100) ** self.rows))))

    @property
    def size(self) -> int:
        return self.bands * self.rows

    def cutoffs(self) -> list[tuple[int, int, int]]:
        """(first, end, least): minima of each batch, and the least number of agreements so far with which a pair goes on."""
        t, step = self.threshold / 100, -(-self.size // STEPS)
        out = []
        for end in sorted({*range(step, self.size, step), self.size}):
            # P(similarity >= t | m of n) is the chance of at most m successes in n + 1 trials of probability t.
            below, m = (1 - t) ** (end + 1), 0
            while below < self.miss / 2 / STEPS:
                m += 1
                below += math.comb(end + 1, m) * t**m * (1 - t) ** (end + 1 - m)
            out.append((out[-1][1] if out else 0, end, m))
        return out


@lru_cache(maxsize=4)
def _hashes(n: int) -> np.ndarray:
    return np.random.default_rng(11).integers(1, 1 << 63, (2, n), dtype=np.uint64) | np.uint64(1)


def shingle_sets(w: Words, k: int = SHINGLE) -> tuple[np.ndarray, np.ndarray]:
    """(hashes, bounds): the sorted distinct shingles of each text, one behind the other; text i has hashes[bounds[i]:bounds[i + 1]].

    A text of fewer words, but not none, has one shingle of all of them.
    """
    count = np.diff(w.first)
    at, h = w.shingles(k)
    for size in range(1, k):
        if (count == size).any():
            a, x = w.shingles(size)
            own = count[np.searchsorted(w.first, a, "right") - 1] == size
            at, h = np.concatenate([at, a[own]]), np.concatenate([h, x[own]])
    order = np.argsort(at, kind="stable")
    at, h = at[order], h[order]
    bounds = np.searchsorted(at, w.first)
    for a, z in zip(bounds[:-1].tolist(), bounds[1:].tolist(), strict=True):
        h[a:z].sort()
    new = np.ones(len(h), bool)
    new[1:] = h[1:] != h[:-1]
    starts = bounds[:-1][bounds[:-1] < bounds[1:]]
    new[starts] = True
    return h[new], np.concatenate([[0], np.cumsum(new)])[bounds]


def signatures(h: np.ndarray, bounds: np.ndarray, n: int, room: int = 1 << 15) -> np.ndarray:
    """(texts, n) minima as uint32; texts without shingles have zeros."""
    xor, odd = _hashes(n)
    out = np.zeros((len(bounds) - 1, n), np.uint32)
    full = np.flatnonzero(bounds[:-1] < bounds[1:])
    starts = bounds[full]
    part = starts // room
    for i, j in zip(*(lambda e: (e[:-1], e[1:]))(np.append(np.flatnonzero(np.diff(part, prepend=-1)), len(full))), strict=True):
        a, z = starts[i], bounds[full[j - 1] + 1]
        mine, own = h[a:z], starts[i:j] - a
        for s in range(n):
            out[full[i:j], s] = np.minimum.reduceat((mine ^ xor[s]) * odd[s], own) >> np.uint64(32)
    return out


def band_keys(sig: np.ndarray, rows: int) -> np.ndarray:
    """(texts, bands) as int64."""
    x = sig.reshape(len(sig), -1, rows).astype(np.uint64)
    h = np.broadcast_to(np.arange(x.shape[1], dtype=np.uint64), x.shape[:2]).copy()
    for j in range(rows):
        h = mix(h * np.uint64(0x9E3779B97F4A7C15) + x[:, :, j])
    return h.view(np.int64)


def _signed(named: DataFrame, plan: Plan, k: int, keep: list[str]) -> DataFrame:
    """``keep`` with n_shingles, two hashes of the set, signature and band keys (none without words). The text is the last column."""
    added = T.StructType.fromDDL("n bigint, h1 bigint, h2 bigint, sig binary, keys array<bigint>")

    def run(it: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches(it, 250):
            h, bounds = shingle_sets(words_of(b.column(len(keep)).to_pylist(), WORD_BYTES), k)
            n = np.diff(bounds)
            sums = [np.concatenate([[np.uint64(0)], np.cumsum(mix(h ^ np.uint64(c)))]) for c in (0x2545F4914F6CDD1D, 0x14057B7EF767814F)]
            h1, h2 = ((s[bounds[1:]] - s[bounds[:-1]]).view(np.int64) for s in sums)
            sig = signatures(h, bounds, plan.size)
            keys = band_keys(sig, plan.rows)
            ends = np.concatenate([[0], np.cumsum(np.where(n > 0, plan.bands, 0))]).astype(np.int32)
            yield pa.RecordBatch.from_arrays(
                [*b.columns[: len(keep)], pa.array(n), pa.array(h1), pa.array(h2), pa.array([s.tobytes() for s in sig], pa.binary()), pa.ListArray.from_arrays(pa.array(ends), pa.array(keys[n > 0].reshape(-1)))],
                names=[*keep, "n", "h1", "h2", "sig", "keys"],
            )

    return named.mapInArrow(run, T.StructType([*named.select(*keep).schema, *added]))


def _sets(texts: DataFrame, wanted: DataFrame, k: int) -> DataFrame:
    """(node, set): the set, as bytes, of each node in ``wanted`` (node, id, hash). texts: id, hash of the text, text."""
    known = PackedBitmap(wanted.select(F.col("hash").alias("h")).distinct())

    def run(it: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches(it, 500):
            own = b.take(pa.array(np.sort(known.passes(np.asarray(b.column(1)).view(np.uint64)))))
            h, bounds = shingle_sets(words_of(own.column(2).to_pylist(), WORD_BYTES), k)
            yield pa.RecordBatch.from_arrays([own.column(0), own.column(1), pa.array([h[a:z].tobytes() for a, z in zip(bounds[:-1], bounds[1:], strict=True)], pa.binary())], names=["id", "hash", "set"])

    kind = texts.schema["id"].dataType.simpleString()
    found = texts.mapInArrow(run, f"id {kind}, hash bigint, set binary")
    on = F.col("w.id").eqNullSafe(F.col("f.id")) & (F.col("w.hash") == F.col("f.hash"))
    return found.alias("f").join(wanted.alias("w"), on).select("w.node", "f.set").dropDuplicates(["node"])


def _survivors(pairs: DataFrame, plan: Plan) -> DataFrame:
    """(u, v) of the pairs (u, v, su, sv: signatures) that no batch rules out."""
    steps = plan.cutoffs()

    def run(it: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches(it, 4096):
            x, y = (np.frombuffer(b"".join(b.column(c).to_pylist()), np.uint32).reshape(-1, plan.size) for c in (2, 3))
            at, same = np.arange(b.num_rows), np.zeros(b.num_rows, np.int64)
            for a, z, least in steps:
                same = same + (x[at, a:z] == y[at, a:z]).sum(axis=1)
                on = same >= least
                at, same = at[on], same[on]
            rows = pa.array(at)
            yield pa.RecordBatch.from_arrays([b.column(0).take(rows), b.column(1).take(rows)], names=["u", "v"])

    return pairs.mapInArrow(run, "u bigint, v bigint")


def common(a: np.ndarray, b: np.ndarray) -> int:
    """Size of the intersection of two sorted sets."""
    both = np.concatenate([a, b])
    both.sort(kind="stable")
    return int(np.count_nonzero(both[1:] == both[:-1]))


def linked(a: np.ndarray, b: np.ndarray, threshold: int) -> bool:
    n = common(a, b)
    return 100 * n >= threshold * (len(a) + len(b) - n)


def _verified(pairs: DataFrame, threshold: int) -> DataFrame:
    """(u, v) of the pairs (u, v, su, sv: sets) that are linked."""

    def run(it: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches(it, 512):
            good = [linked(np.frombuffer(x.as_py(), np.uint64), np.frombuffer(y.as_py(), np.uint64), threshold) for x, y in zip(b.column(2), b.column(3), strict=True)]
            yield pa.RecordBatch.from_arrays([b.column(c).filter(pa.array(good, pa.bool_())) for c in (0, 1)], names=["u", "v"])

    return pairs.mapInArrow(run, "u bigint, v bigint")


class Bucket:
    """Nodes of one bucket, or of two chunks of it, and what is linked across their components."""

    def __init__(self, band: int, chunk: np.ndarray, node: np.ndarray, root: np.ndarray, n: np.ndarray, sig: np.ndarray, sets: list[bytes], plan: Plan) -> None:
        self.band, self.chunk, self.node, self.n, self.sig, self.sets, self.plan = band, chunk, node, n, sig, sets, plan
        self.label = np.unique(root, return_inverse=True)[1]
        self.steps = plan.cutoffs()

    def _near(self, a: int, at: np.ndarray) -> np.ndarray:
        """Those of the nodes ``at`` that may be linked with a and whose first band in common is this one, most agreements first."""
        t = self.plan.threshold
        at = at[(100 * np.minimum(self.n[at], self.n[a]) >= t * np.maximum(self.n[at], self.n[a]))]
        same = np.zeros(len(at), np.int64)
        for i, j, least in self.steps:
            same = same + (self.sig[at, i:j] == self.sig[a, i:j]).sum(axis=1)
            on = same >= least
            at, same = at[on], same[on]
        if not len(at):
            return at
        bands = (self.sig[at] == self.sig[a]).reshape(len(at), -1, self.plan.rows).all(axis=2)
        own = bands.argmax(axis=1) == self.band
        return at[own][np.argsort(-same[own], kind="stable")]

    def links(self) -> list[tuple[int, int]]:
        """Links that join components, as pairs of places. A component joined by one isn't compared with the other again."""
        out = []
        sizes = np.bincount(self.label)
        last = int(sizes.argmax())  # the largest component's nodes needn't take turns: all others do
        rank = np.where(self.label == last, 1, 0)
        apart = self.chunk.min() != self.chunk.max()
        turns = np.flatnonzero(rank == 0)
        place = np.full(len(rank), len(rank))
        place[turns] = np.arange(len(turns))
        for a in turns.tolist():
            at = np.flatnonzero((self.label != self.label[a]) & (place > place[a]))
            if apart:
                at = at[self.chunk[at] != self.chunk[a]]
            mine = np.frombuffer(self.sets[a], np.uint64)
            for b in self._near(a, at).tolist():
                if self.label[a] != self.label[b] and linked(mine, np.frombuffer(self.sets[b], np.uint64), self.plan.threshold):
                    out.append((a, b))
                    self.label[self.label == self.label[a]] = self.label[b]
        return out


def _across(it: Iterator[pa.RecordBatch], plan: Plan) -> Iterator[pa.RecordBatch]:
    """Rows come sorted by (key, i, j): key, i, j, own, band, node, root, n, sig, set."""

    def search(rows: pa.Table) -> pa.RecordBatch:
        number = lambda c: rows.column(c).to_numpy()
        sig = np.frombuffer(b"".join(rows.column("sig").to_pylist()), np.uint32).reshape(-1, plan.size)
        bucket = Bucket(int(rows.column("band")[0].as_py()), number("own"), number("node"), number("root"), number("n"), sig, rows.column("set").to_pylist(), plan)
        found = bucket.links()
        return pa.RecordBatch.from_arrays([pa.array([int(bucket.node[p[s]]) for p in found], pa.int64()) for s in (0, 1)], names=["u", "v"])

    held: list[pa.RecordBatch] = []
    last = None
    for b in it:
        key = np.stack([np.asarray(b.column(c), np.int64) for c in range(3)])
        edges = np.flatnonzero(np.concatenate([[True], (key[:, 1:] != key[:, :-1]).any(axis=0)])) if b.num_rows else np.zeros(0, np.int64)
        for a, z in zip(edges.tolist(), [*edges[1:].tolist(), b.num_rows], strict=True):
            now = tuple(key[:, a].tolist())
            if now != last and held:
                yield search(pa.Table.from_batches(held))
                held = []
            last = now
            held.append(b.slice(a, z - a))
    if held:
        yield search(pa.Table.from_batches(held))


def _links(signed: DataFrame, classes: DataFrame, texts: DataFrame, plan: Plan, k: int, group: int) -> DataFrame:
    """(u, v): links that make the components of the nodes. signed: id, row, hash, n, h1, h2, sig, keys; classes: node."""
    nodes = materialize(signed.join(classes.select("node"), F.col("row") == F.col("node"), "left_semi").select(F.col("row").alias("node"), "n", "keys"), "nodes")
    rows = nodes.select("node", "n", F.posexplode("keys").alias("band", "key"))
    shared = materialize(rows.groupBy("key").agg(F.count("*").alias("nodes"), F.sum("n").alias("shingles")).where("nodes > 1"), "buckets")
    meet = materialize(rows.join(shared, "key").select("key", F.col("band").cast("tinyint").alias("band"), "node", "n", "nodes"), "meet")
    degree = meet.groupBy("node").agg(F.sum("nodes").alias("degree"))
    wanted = materialize(signed.join(degree, F.col("row") == F.col("node")).select("node", "degree", "n", "id", "hash", "sig"), "candidates")
    sets = materialize(_sets(texts, wanted.select("node", "id", "hash"), k), "sets")
    small, large = F.least("n", "n2"), F.greatest("n", "n2")

    leads = meet.join(wanted.select("node", "degree"), "node").groupBy("key").agg(F.max(F.struct("degree", (-F.col("node")).alias("least"), "n")).alias("lead"))
    stars = meet.join(materialize(leads.select("key", (-F.col("lead.least")).alias("u"), F.col("lead.n").alias("n2")), "leads"), "key").where(F.col("node") != F.col("u"))
    stars = materialize(stars.where(100 * small >= plan.threshold * large).select("u", F.col("node").alias("v")).distinct(), "stars")
    side = lambda of, end, c: of.select(F.col("node").alias(end), F.col(c).alias(f"s{end}"))
    both = lambda pairs, of, c: pairs.join(side(of, "u", c), "u").join(side(of, "v", c), "v").select("u", "v", "su", "sv")
    likely = materialize(_survivors(both(stars, wanted, "sig"), plan), "likely")
    first = materialize(_verified(both(likely, sets, "set"), plan.threshold), "star_links")

    roots = components(first, "star_components")
    labelled = materialize(meet.join(roots, "node", "left").select("key", "band", "node", "n", F.coalesce("root", "node").alias("root")), "labelled")
    # Two nodes of a bucket have met; of three or more in several components, those beside the leader haven't.
    mixed = labelled.groupBy("key").agg(F.count("*").alias("nodes"), F.sum("n").alias("shingles"), F.min("root").alias("a"), F.max("root").alias("z")).where("a <> z and nodes > 2")
    many = (F.col("nodes") > group) | (8 * F.col("shingles") > GROUP_BYTES)
    parts = F.greatest(F.ceil(F.lit(2.0) * F.col("nodes") / group), F.ceil(F.lit(16.0) * F.col("shingles") / GROUP_BYTES))
    mixed = materialize(mixed.select("key", F.when(many, parts).otherwise(1).cast("int").alias("chunks")), "mixed")
    own = F.pmod(F.xxhash64("node"), F.col("chunks")).cast("int")
    apart = labelled.join(mixed, "key").withColumn("own", own).select("key", "band", "node", "root", "own", F.explode(F.sequence(F.lit(0), F.col("chunks") - 1)).alias("other"))
    apart = apart.select("key", F.least("own", "other").alias("i"), F.greatest("own", "other").alias("j"), "own", "band", "node", "root")
    full = apart.join(wanted.select("node", "n", "sig"), "node").join(sets, "node").select("key", "i", "j", "own", "band", "node", "root", "n", "sig", "set")
    second = full.repartition("key", "i", "j").sortWithinPartitions("key", "i", "j").mapInArrow(lambda it: _across(it, plan), "u bigint, v bigint")
    return first.unionByName(materialize(second.distinct(), "links"))


def near_duplicates(
    docs: DataFrame, text: str = "text", doc_id: str = "doc_id", keep: list[str] | None = None, threshold: int = THRESHOLD, shingle: int = SHINGLE, miss: float = MISS, rows: int = ROWS, group: int = GROUP
) -> DataFrame:
    """``docs`` (or its columns ``keep``) with n_shingles, component_id and is_first; input columns of these names are replaced.

    Linked: 100 * shared shingles >= threshold * all shingles of both. component_id: the smallest doc_id reachable over links, itself included;
    is_first holds for one row of each component, that with this id (the first of rows that repeat it).

    Words are split at white space, A-Z lower-cased. A text of fewer words than a shingle is one shingle; null and empty texts have none, are linked
    with nothing and are a component each. Rows that repeat are one node, and every row gives one row. A null id is larger than all others, so a
    component of null ids alone has a null component_id. Very long texts have large sets; of a bucket, a task holds GROUP_BYTES of them, or two. An empty table gives no rows.
    """
    plan = Plan(threshold, rows, miss)
    cols = [c for c in (docs.columns if keep is None else keep) if c not in ("n_shingles", "component_id", "is_first")]
    body, ident = F.col(f"`{text}`"), F.col(f"`{doc_id}`")
    named = docs.select(*[F.col(f"`{c}`").alias(f"_c{i}") for i, c in enumerate(cols)], ident.alias("id"), F.monotonically_increasing_id().alias("row"), F.xxhash64(body).alias("hash"), body.alias("text"))
    signed = materialize(_signed(named, plan, shingle, named.columns[:-1]), "signed")
    order = F.struct(F.col("id").isNull().alias("none"), "id", "row")
    classes = materialize(signed.where("n > 0").groupBy("h1", "h2").agg(F.min(order).alias("first")).withColumn("node", F.col("first.row")), "classes")
    roots = components(_links(signed.select("id", "row", "hash", "n", "h1", "h2", "sig", "keys"), classes, docs.select(ident.alias("id"), F.xxhash64(body).alias("hash"), body.alias("text")), plan, shingle, group))
    rooted = classes.join(roots, "node", "left").select("h1", "h2", "first", F.coalesce("root", "node").alias("root"))
    least = rooted.join(materialize(rooted.groupBy("root").agg(F.min("first").alias("least")), "least"), "root").select("h1", "h2", "least")
    found = signed.select(*[f"_c{i}" for i in range(len(cols))], "id", "row", "n", "h1", "h2").join(materialize(least, "found"), ["h1", "h2"], "left")
    return found.select(
        *[F.col(f"_c{i}").alias(c) for i, c in enumerate(cols)], F.col("n").alias("n_shingles"), F.when(F.col("n") > 0, F.col("least.id")).otherwise(F.col("id")).alias("component_id"),
        F.when(F.col("n") > 0, F.col("least.row") == F.col("row")).otherwise(True).alias("is_first"),
    )


def keep_one(docs: DataFrame, text: str = "text", doc_id: str = "doc_id", **how: object) -> DataFrame:
    """One row of each component, with the columns of ``docs``."""
    named = docs.select(F.struct(*[F.col(f"`{c}`") for c in docs.columns]).alias("_doc"), F.col(f"`{doc_id}`").alias("_i"), F.col(f"`{text}`").alias("_t"))
    return near_duplicates(named, "_t", "_i", ["_doc"], **how).where("is_first").select("_doc.*")
