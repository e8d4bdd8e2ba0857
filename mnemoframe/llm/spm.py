"""SentencePiece encoding and decoding, with a max-plus parallel scan for giant documents.

Ordinary texts go through the library, a batch at a time. A giant text is cut into chunks that Spark deals out, and the
pieces over all chunks are those that the library gives for the whole.

The model at hand is a BPE model, whose encoding isn't the best-scoring path of a lattice of pieces, so piece scores can't
be the weights. But a sequence of pieces is the BPE encoding exactly if each two neighbours are the encoding of what they
spell together. With weight 0 for such neighbours and minus infinity for others, the encoding is the only path of weight 0 in
a lattice whose nodes are pieces at places, and the scan is the one for max-plus matrices:

1. At a cut, the states are the pieces that can cover the character before it. Each chunk yields the matrix of best weights
   from the states at its left cut to those at its right cut. As weights are 0 or minus infinity, a row is the set of left states with weight 0.
2. Matrices combine associatively: inside blocks of chunks first, then over the blocks of a text.
3. The products give each chunk's entry state, from which it is traced back on its own.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import lru_cache

import pandas as pd
import pyarrow as pa
import sentencepiece
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from sentencepiece import sentencepiece_model_pb2 as model_pb

from mnemoframe.llm.common import DEFAULT_PIECES, add_columns, batches, materialize, n_partitions

#: Texts of at least so many characters are giant.
GIANT = 65_536
CHUNK = 16_384
#: Chunks whose matrices one task multiplies.
BLOCK = 256
SPACE = "▁"

State = tuple[int, str]  #: (end, piece): a piece that covers the character before a cut; end is relative to the cut


def check_model(model: model_pb.ModelProto) -> None:
    """That the scan can encode with the model, whatever the texts."""
    spec, norm, piece = model.trainer_spec, model.normalizer_spec, model_pb.ModelProto.SentencePiece
    if spec.model_type != model_pb.TrainerSpec.BPE or norm.precompiled_charsmap or norm.remove_extra_whitespaces or not norm.escape_whitespaces or spec.treat_whitespace_as_suffix:
        raise ValueError("splitting texts needs a BPE model without normalisation; giant=None leaves all texts whole")
    if any(p.type in (piece.USER_DEFINED, piece.UNUSED) for p in model.pieces):
        raise ValueError("splitting texts needs a model without user-defined and unused pieces; giant=None leaves all texts whole")


class BpeLattice:
    """What the lattice needs of a BPE model."""

    def __init__(self, proto: bytes) -> None:
        model = model_pb.ModelProto()
        model.ParseFromString(proto)
        spec, norm = model.trainer_spec, model.normalizer_spec
        check_model(model)
        self.prefix = SPACE if norm.add_dummy_prefix else ""
        self.score = {p.piece: p.score for p in model.pieces if p.type == model_pb.ModelProto.SentencePiece.NORMAL}
        self.id = {p.piece: i for i, p in enumerate(model.pieces)}
        self.byte = [self.id.get(f"<0x{b:02X}>") for b in range(256)] if spec.byte_fallback else None
        self.unknown = next(i for i, p in enumerate(model.pieces) if p.type == model_pb.ModelProto.SentencePiece.UNKNOWN)
        self.longest = max(map(len, self.score))
        self.inner_space = any(SPACE in p.lstrip(SPACE) for p in self.score)
        self.whole = {p for p in self.score if len(p) == 1 or self.merged(p) == [p]}
        self.lengths: dict[str, list[int]] = {}
        for p in self.whole:
            self.lengths.setdefault(p[0], []).append(len(p))
        self.lengths = {c: sorted(set(n)) for c, n in self.lengths.items()}
        self.pairs: dict[tuple[str, str], bool] = {}

    def merged(self, text: str) -> list[str]:
        """BPE of a short text: again and again the leftmost of the best-scoring neighbours becomes one."""
        parts = list(text)
        while len(parts) > 1:
            best = max(((s, -i) for i in range(len(parts) - 1) if (s := self.score.get(parts[i] + parts[i + 1])) is not None), default=None)
            if best is None:
                break
            i = -best[1]
            parts[i : i + 2] = [parts[i] + parts[i + 1]]
        return parts

    def follows(self, left: str, right: str) -> bool:
        """Whether the two pieces are the encoding of what they spell together."""
        if right[0] == SPACE and left[-1] != SPACE and not self.inner_space:
            return True
        known = self.pairs.get((left, right))
        if known is None:
            if len(self.pairs) > 200_000:
                self.pairs.clear()
            known = self.pairs[left, right] = self.merged(left + right) == [left, right]
        return known

    def at(self, text: str, i: int) -> list[str]:
        """Pieces that begin at i; a character that is no piece stands for itself."""
        c = text[i]
        return [p for n in self.lengths.get(c, ()) if len(p := text[i : i + n]) == n and p in self.whole] or [c]

    def states(self, text: str, cut: int) -> list[State]:
        """In an order that depends on the text around the cut alone."""
        return sorted((i + len(p) - cut, p) for i in range(max(0, cut - self.longest), cut) for p in self.at(text, i) if i + len(p) >= cut)

    def ids(self, pieces: list[str]) -> list[int]:
        out: list[int] = []
        for p in pieces:
            i = self.id.get(p) if p in self.score else None
            if i is not None:
                out.append(i)
            elif self.byte:
                out += [self.byte[b] for b in p.encode("utf-8", "surrogatepass")]
            elif out[-1:] != [self.unknown]:  # a run of unknown characters is one piece
                out.append(self.unknown)
        return out

    def forward(self, text: str, low: int, high: int, entry: list[State] | None) -> tuple[dict[int, dict[str, int]], dict[tuple[int, str], str | None]]:
        """Nodes by end, with the set (as bits) of entry states that reach them, over pieces that begin in [low, high).

        entry None: the text's beginning. The second result has a node's left neighbour.
        """
        nodes: dict[int, dict[str, int]] = {}
        back: dict[tuple[int, str], str | None] = {}
        for k, (end, piece) in enumerate(entry or [(0, "")]):
            nodes.setdefault(low + end, {})[piece] = 1 << k
        for i in range(low, high):
            here = nodes.get(i)
            if not here:
                continue
            for p in self.at(text, i):
                bits = 0
                for left, b in here.items():
                    if not left or self.follows(left, p):
                        bits |= b
                        back[i + len(p), p] = left
                if bits:
                    end = nodes.setdefault(i + len(p), {})
                    end[p] = end.get(p, 0) | bits
        return nodes, back

    def matrix(self, text: str, low: int, high: int, first: bool) -> list[list[int]]:
        """For each state at the right cut, the left states from which it is reached with weight 0."""
        nodes, _ = self.forward(text, low, high, None if first else self.states(text, low))
        bits = [nodes.get(high + end, {}).get(p, 0) if high + end - len(p) >= low else 0 for end, p in self.states(text, high)]
        if not first:  # a piece that covers the whole chunk is a state at both cuts
            for j, (end, p) in enumerate(self.states(text, high)):
                for k, (e, q) in enumerate(self.states(text, low)):
                    if q == p and low + e == high + end and high + end - len(p) < low:
                        bits[j] |= 1 << k
        return [[k for k in range(b.bit_length()) if b >> k & 1] for b in bits]

    def trace(self, text: str, low: int, high: int, entry: int, leave: int, first: bool) -> list[str]:
        """The pieces that begin in [low, high), from the entry state to the state in which the chunk is left."""
        nodes, back = self.forward(text, low, high, None if first else [self.states(text, low)[entry]])
        end, piece = self.states(text, high)[leave]
        at, out = high + end, []
        while piece and at - len(piece) >= low:
            out.append(piece)
            at, piece = at - len(piece), back[at, piece]
        return out[::-1]


def product(a: list[list[int]], b: list[list[int]]) -> list[list[int]]:
    """Max-plus product of chunk a and the chunk b behind it."""
    return [sorted({k for m in row for k in a[m]}) for row in b]


@lru_cache(maxsize=2)
def _library(proto: bytes) -> sentencepiece.SentencePieceProcessor:
    return sentencepiece.SentencePieceProcessor(model_proto=proto)


@lru_cache(maxsize=2)
def _lattice(proto: bytes) -> BpeLattice:
    return BpeLattice(proto)


def model_bytes(spark: SparkSession, path: str = DEFAULT_PIECES) -> bytes:
    """A vocabulary file, from any file system."""
    return bytes(spark.read.format("binaryFile").load(path).first().content)


def _chunks(giants: DataFrame, prefix: str, margin: int, chunk: int) -> DataFrame:
    """(row, chunk, part, low, high, last): part is the chunk, from low to high, with a margin on both sides."""
    text = giants.select("_row", F.concat(F.lit(prefix), F.translate("_text", " ", SPACE)).alias("t"))
    cut = text.withColumn("n", F.length("t")).select("*", F.explode(F.expr(f"sequence(0, n - 1, {chunk})")).alias("a"))
    begin = F.greatest(F.col("a") - margin, F.lit(0))
    end = F.least(F.col("a") + chunk, F.col("n"))
    return cut.select(
        F.col("_row").alias("row"), F.expr(f"a div {chunk}").cast("int").alias("chunk"), F.substring("t", begin + 1, end - begin + margin).alias("part"),
        (F.col("a") - begin).alias("low"), (end - begin).alias("high"), (end == F.col("n")).alias("last"),
    )


def _giant_ids(giants: DataFrame, proto: bytes, chunk: int) -> DataFrame:
    """(_row, ids) of giant texts in (_row, _text)."""
    lattice = _lattice(proto)
    chunks = materialize(_chunks(giants, lattice.prefix, lattice.longest, chunk), "chunks")
    n = max(1, min(chunks.count(), n_partitions(giants.sparkSession)))
    dealt = chunks.repartition(n, "row", "chunk")

    def matrices(it: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        lat = _lattice(proto)
        for b in batches(it, 64):
            c = {k: v.to_pylist() for k, v in zip(b.schema.names, b.columns, strict=True)}
            found = [lat.matrix(t, low, high, k == 0) for k, t, low, high in zip(c["chunk"], c["part"], c["low"], c["high"], strict=True)]
            yield pa.RecordBatch.from_arrays([b.column(0), b.column(1), pa.array([k // BLOCK for k in c["chunk"]], pa.int32()), pa.array(found, pa.list_(pa.list_(pa.int32())))], names=["row", "chunk", "block", "matrix"])

    local = materialize(dealt.mapInArrow(matrices, "row bigint, chunk int, block int, matrix array<array<int>>"), "matrices")
    rows = lambda m: [[int(k) for k in r] for r in m]

    def whole(key: tuple, g: pd.DataFrame) -> pd.DataFrame:
        ms = [rows(m) for m in g.sort_values("chunk")["matrix"]]
        total = ms[0]
        for m in ms[1:]:
            total = product(total, m)
        return pd.DataFrame({"row": [key[0]], "block": [key[1]], "matrix": [total]})

    def leaving(states: list[list[list[int]]]) -> list[int]:
        """The state in which each of the matrices is left, going back from the end, where one state is reached."""
        prefix = [states[0]]
        for m in states[1:]:
            prefix.append(product(prefix[-1], m))
        now = next((j for j, r in enumerate(prefix[-1]) if r), None)
        if now is None:
            raise ValueError("no path of weight 0 through a text: it isn't one that the model encodes piece by piece")
        out = [now]
        for m, before in zip(reversed(states[1:]), reversed(prefix[:-1]), strict=True):
            now = next(k for k in m[now] if before[k])
            out.append(now)
        return out[::-1]

    def block_ends(key: tuple, g: pd.DataFrame) -> pd.DataFrame:
        g = g.sort_values("block")
        out = leaving([rows(m) for m in g["matrix"]])
        return pd.DataFrame({"row": key[0], "block": g["block"], "entry": [0, *out[:-1]], "leave": out})

    def chunk_ends(key: tuple, g: pd.DataFrame) -> pd.DataFrame:
        """Inside a block whose entry and end are known."""
        g = g.sort_values("chunk")
        ms = [rows(m) for m in g["matrix"]]
        entry, leave = int(g["entry"].iloc[0]), int(g["leave"].iloc[0])
        reach = [[entry in r for r in ms[0]]]
        for m in ms[1:]:
            reach.append([any(reach[-1][k] for k in r) for r in m])
        out = [leave]
        for m, before in zip(reversed(ms[1:]), reversed(reach[:-1]), strict=True):
            out.append(next(k for k in m[out[-1]] if before[k]))
        out.reverse()
        return pd.DataFrame({"row": key[0], "chunk": g["chunk"], "entry": [entry, *out[:-1]], "leave": out})

    blocks = local.groupBy("row", "block").applyInPandas(whole, "row bigint, block int, matrix array<array<int>>")
    ends = blocks.groupBy("row").applyInPandas(block_ends, "row bigint, block int, entry int, leave int")
    known = local.join(ends, ["row", "block"]).groupBy("row", "block").applyInPandas(chunk_ends, "row bigint, chunk int, entry int, leave int")

    def trace(it: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        lat = _lattice(proto)
        for b in batches(it, 64):
            c = {k: v.to_pylist() for k, v in zip(b.schema.names, b.columns, strict=True)}
            found = [lat.ids(lat.trace(*x, k == 0)) for k, *x in zip(c["chunk"], c["part"], c["low"], c["high"], c["entry"], c["leave"], strict=True)]
            yield pa.RecordBatch.from_arrays([pa.array(c["row"], pa.int64()), pa.array(c["chunk"], pa.int32()), pa.array(found, pa.list_(pa.int32()))], names=["row", "chunk", "ids"])

    traced = dealt.join(known, ["row", "chunk"]).select("row", "chunk", "part", "low", "high", "entry", "leave").mapInArrow(trace, "row bigint, chunk int, ids array<int>")
    whole_ids = F.flatten(F.transform(F.array_sort(F.collect_list(F.struct("chunk", "ids"))), lambda x: x["ids"]))
    out = traced.groupBy(F.col("row").alias("_row")).agg(whole_ids.alias("_ids"))
    if not lattice.byte:  # runs of unknown characters may go on behind a cut
        u = F.lit(lattice.unknown)
        out = out.withColumn("_ids", F.filter("_ids", lambda x, i: (x != u) | (i == 0) | (F.get("_ids", i - 1) != u)))
    return out


def _coded(docs: DataFrame, proto: bytes, text: str, giant: int | None, chunk: int, back: bool) -> tuple[DataFrame, list[str]]:
    """``docs`` with numbered columns, _ids and, if ``back`` is asked for, _decoded; and the numbered columns' names."""
    if giant is not None:
        check_model(model_pb.ModelProto.FromString(proto))
    named = docs.select(*[F.col(f"`{c}`").alias(f"_c{i}") for i, c in enumerate(docs.columns)], F.col(f"`{text}`").alias("_text"))
    own = [c for c in named.columns if c != "_text"]
    big = F.lit(False) if giant is None else F.coalesce(F.length("_text") >= giant, F.lit(False))

    def plain(texts: list[str | None]) -> dict:
        ids = _library(proto).encode([t or "" for t in texts], num_threads=1)
        return {"_ids": ids} | ({"_decoded": _library(proto).decode(ids)} if back else {})

    small = add_columns(named.where(~big), "_text", "_ids array<int>" + ", _decoded string" * back, plain, own, rows=500)
    if giant is None:
        return small, own
    giants = materialize(named.where(big).withColumn("_row", F.monotonically_increasing_id()), "giants")
    if not giants.take(1):
        return small, own
    coded = giants.join(_giant_ids(giants.select("_row", "_text"), proto, chunk), "_row").select(*own, "_ids")
    return small.unionByName(decode(coded, proto, "_ids", "_decoded") if back else coded), own


def encode(docs: DataFrame, proto: bytes, text: str = "text", ids: str = "ids", giant: int | None = GIANT, chunk: int = CHUNK) -> DataFrame:
    """``docs`` with the piece ids of ``text``, as the library gives them; null and empty texts have none.

    Texts of ``giant`` characters or more are split; a model that this can't be done with is an error before any text is read, unless giant is None.
    Every row, repeated or not, gives one row; an input column named ``ids`` is replaced.
    """
    coded, own = _coded(docs, proto, text, giant, chunk, back=False)
    return coded.select(*[F.col(n).alias(c) for n, c in zip(own, docs.columns, strict=True) if c != ids], F.col("_ids").alias(ids))


def decode(coded: DataFrame, proto: bytes, ids: str = "ids", text: str = "decoded") -> DataFrame:
    """``coded`` with the text that the ids spell; null ids spell an empty text. An input column named ``text`` is replaced."""
    return add_columns(coded, ids, f"`{text}` string", lambda rows: {text: _library(proto).decode([r or [] for r in rows])}, rows=500)


def round_trip(docs: DataFrame, proto: bytes, text: str = "text", giant: int | None = GIANT, chunk: int = CHUNK) -> DataFrame:
    """``docs`` with ids, decoded and same (the decoded text is the text), replacing columns of these names.

    A text that has U+2581 itself comes back with spaces there. Ordinary texts are encoded and decoded in one pass.
    """
    coded, own = _coded(docs, proto, text, giant, chunk, back=True)
    at = own[docs.columns.index(text)]
    kept = [F.col(n).alias(c) for n, c in zip(own, docs.columns, strict=True) if c not in ("ids", "decoded", "same")]
    return coded.select(*kept, F.col("_ids").alias("ids"), F.col("_decoded").alias("decoded"), (F.col("_decoded") == F.coalesce(F.col(at), F.lit(""))).alias("same"))


def digest(ids: Column) -> Column:
    return F.sha2(F.array_join(ids.cast("array<string>"), ","), 256)
