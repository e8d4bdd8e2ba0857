"""WARC archives: a writer on Spark's own sink and a splittable reader.

Writer: each record is a gzip member, and members are written through Spark's text sink, so that its commit protocol
holds on any file system. The sink ends each row with the byte 0, which is the last byte of a member whose content is
shorter than 16 MB; longer ones get an empty member behind them. So a part file is plain concatenated members.

Reader: files are cut into byte ranges, one task row each. A task looks for the gzip magic in its range, decodes what
follows each candidate as far as the WARC version line to tell true members from chance bytes, and owns the records whose
member starts inside its range; it reads on behind the range's end to finish the last one. A range may begin inside a record that holds
an archive itself; what is found there lies inside the span of a record that began before, and goes. Equal payloads are
stored once: later ones are revisit records that name the record they repeat.
"""

from __future__ import annotations

import base64
import hashlib
import zlib
from collections.abc import Iterator

import pyarrow as pa
from pyarrow import fs
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from mnemoframe.llm.common import batches, materialize, new_path

MAGIC = b"\x1f\x8b\x08"
EMPTY_MEMBER = zlib.compressobj(1, zlib.DEFLATED, 31).flush()
#: Bytes that a reading task asks for at once, and that it decodes of a candidate at first.
BLOCK, PROBE = 1 << 20, 512
RECORD = "file string, start bigint, end bigint, warc_type string, record_id string, refers_to_id string, target_uri string, payload_digest string, payload_length bigint, payload binary"
#: Groups of equal payloads up to which they are broadcast (some 10 MB); more are joined by a shuffle.
BROADCAST_ROWS = 100_000
BASE32 = "ABCDEFGHIJKLMNOPQRSTUVWXYZ234567"


def sha1_base32(payload: Column) -> Column:
    """Upper-case base32 of the SHA-1 of a binary column: eight groups of 20 bits, four characters each."""
    hexed = F.sha1(payload)
    part = lambda i: F.translate(F.lpad(F.conv(F.substring(hexed, 5 * i + 1, 5), 16, 32), 4, "0"), "0123456789ABCDEFGHIJKLMNOPQRSTUV", BASE32)
    return F.concat(*[part(i) for i in range(8)])


def plan_records(pages: DataFrame, page_id: str = "page_id", url: str = "url", html: str = "html", least_bytes: int = 0) -> DataFrame:
    """(id, uri, payload, digest, refers_to): of rows with equal payloads of at least ``least_bytes`` bytes, that with the largest id is the response.

    A null payload is empty, as is an empty table's result. Rows that share the largest id are all responses, as are rows without an id.
    Ids may be whole numbers or anything else, which is ordered as text.
    """
    whole = pages.schema[page_id].dataType.typeName() in ("byte", "short", "integer", "long")
    rows = pages.select(F.col(f"`{page_id}`").cast("bigint" if whole else "string").alias("id"), F.col(f"`{url}`").cast("string").alias("uri"), F.encode(F.coalesce(F.col(f"`{html}`"), F.lit("")), "UTF-8").alias("payload"))
    rows = rows.withColumn("digest", sha1_base32(F.col("payload")))
    # The groups of repeats alone are joined back: most payloads have none. While there are few, they are broadcast, so that payloads stay where they are.
    winners = rows.where(F.length("payload") >= least_bytes).groupBy("digest").agg(F.max("id").alias("first"), F.count("*").alias("n")).where("n > 1 and first is not null").select("digest", "first")
    winners = materialize(winners, "repeats")
    if winners.count() <= BROADCAST_ROWS:
        winners = F.broadcast(winners)
    refers = F.when((F.length("payload") >= least_bytes) & (F.col("first") != F.col("id")), F.col("first"))
    return rows.join(winners, "digest", "left").select("id", "uri", "payload", "digest", refers.alias("refers_to"))


def _member(page_id: int | str | None, uri: str | None, payload: bytes, digest: str, refers_to: int | str | None, level: int) -> bytes:
    http = f"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: {len(payload)}\r\n\r\n".encode()
    block = http + (payload if refers_to is None else b"")
    head = [
        "WARC/1.1", f"WARC-Type: {'response' if refers_to is None else 'revisit'}", f"WARC-Record-ID: <urn:page:{'' if page_id is None else page_id}>",
        "WARC-Date: 1970-01-01T00:00:00Z", f"WARC-Payload-Digest: sha1:{digest}", "Content-Type: application/http; msgtype=response", f"Content-Length: {len(block)}",
    ]
    if uri is not None and not any(c in uri for c in "\r\n"):
        head.append(f"WARC-Target-URI: {uri}")
    if refers_to is not None:
        head += [f"WARC-Refers-To: <urn:page:{refers_to}>", "WARC-Profile: http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"]
    c = zlib.compressobj(level, zlib.DEFLATED, 31)
    out = c.compress("\r\n".join(head).encode("utf-8", "surrogatepass") + b"\r\n\r\n" + block + b"\r\n\r\n") + c.flush()
    return out if out[-1] == 0 else out + EMPTY_MEMBER


def write_warc(pages: DataFrame, path: str, level: int = 6, **columns) -> None:
    """Write an archive folder of .txt-named part files, each a sequence of gzip members; an empty table gives a folder without records. ``columns``: see plan_records."""

    def members(it: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches(it, 200):
            # The sink adds the closing zero.
            yield pa.RecordBatch.from_arrays([pa.array([_member(*r, level)[:-1] for r in zip(*(c.to_pylist() for c in b.columns), strict=True)], pa.binary())], names=["value"])

    rows = plan_records(pages, **columns).mapInArrow(members, "value binary")
    rows.select(F.col("value").cast("string").alias("value")).write.option("lineSep", "\0").option("compression", "none").text(path)


def _record(raw: bytes) -> dict | None:
    head, _, rest = raw.partition(b"\r\n\r\n")
    lines = head.decode("utf-8", "surrogatepass").split("\r\n")
    if not lines[0].startswith("WARC/"):
        return None
    field = {k.strip().lower(): v.strip() for k, _, v in (x.partition(":") for x in lines[1:])}
    block = rest[: int(field.get("content-length", 0))]
    http, _, payload = block.partition(b"\r\n\r\n") if field.get("content-type", "").startswith("application/http") else (b"", b"", block)
    length = next((int(x.split(b":")[1]) for x in http.split(b"\r\n") if x.lower().startswith(b"content-length:")), len(payload))
    kind = field.get("warc-type")
    revisit = kind == "revisit"
    return {
        "warc_type": kind, "record_id": field.get("warc-record-id"), "refers_to_id": field.get("warc-refers-to"), "target_uri": field.get("warc-target-uri"),
        "payload_digest": field.get("warc-payload-digest", "").removeprefix("sha1:") if revisit else base64.b32encode(hashlib.sha1(payload).digest()).decode(),
        "payload_length": length if revisit else len(payload), "payload": None if revisit else payload,
    }


class _Window:
    """Bytes of an open file from any offset, fetched in blocks."""

    def __init__(self, f, size: int) -> None:
        self.f, self.size, self.at, self.data = f, size, 0, b""

    def get(self, start: int, n: int) -> bytes:
        if start < self.at or start + n > self.at + len(self.data):
            self.f.seek(start)
            self.at, self.data = start, self.f.read(min(max(n, BLOCK), self.size - start))
        return self.data[start - self.at : start - self.at + n]


def _decode(w: _Window, start: int) -> tuple[bytes, int] | None:
    """(content, end) of the member at ``start``; None if the bytes there aren't a member that holds a WARC record."""
    d = zlib.decompressobj(31)
    try:
        got = d.decompress(w.get(start, PROBE))
        if got and not b"WARC/".startswith(got[:5]):
            return None
        out, at = [got], start + PROBE
        while not d.eof and at < w.size:
            out.append(d.decompress(w.get(at, 1 << 16)))
            at += 1 << 16
    except zlib.error:
        return None
    raw = b"".join(out)
    return (raw, min(at, w.size) - len(d.unused_data)) if d.eof and raw.startswith(b"WARC/") else None


def _read_range(f, size: int, start: int, end: int) -> Iterator[dict]:
    w, at = _Window(f, size), start
    while at < end:
        piece = w.get(at, min(1 << 16, size - at))
        hit = piece.find(MAGIC)
        if hit < 0 or at + hit >= end:
            if at + len(piece) >= min(end + 2, size):
                return
            at += max(1, len(piece) - 2)
            continue
        at += hit
        found = _decode(w, at)
        if found is None or (record := _record(found[0])) is None:
            at += 1
            continue
        yield record | {"start": at, "end": found[1]}
        at = found[1]


def inside_others(found: DataFrame, range_bytes: int) -> DataFrame:
    """(file, start) of records that start inside the span of another one.

    Inside a range that can't be, so each range's last record alone matters, where it goes on into ranges behind: some rows a range.
    """
    over = found.select("file", "start", "end").withColumn("r", F.expr(f"start div {range_bytes}L")).where(F.expr(f"end > (r + 1) * {range_bytes}L"))
    covered = over.select("file", F.explode(F.expr(f"sequence(r + 1, (end - 1) div {range_bytes}L)")).alias("r"), F.col("end").alias("until"))
    covered = covered.groupBy("file", "r").agg(F.max("until").alias("until"))
    starts = found.select("file", "start", F.expr(f"start div {range_bytes}L").alias("r"))
    return starts.join(covered, ["file", "r"]).where("start < until").select("file", "start")


def read_warc(spark: SparkSession, path: str, range_bytes: int = 16 << 20, payloads: bool = True) -> DataFrame:
    """The records of all files under ``path``, which may be any gzip-per-record WARC files: the columns of RECORD.

    payloads: False leaves that column null once length and digest are taken from it.
    A revisit has no payload; its length is that of its HTTP header. An empty folder gives no rows; bytes that aren't
    members are skipped. One row of input is one range, so tasks follow the archive's size, not its number of files. The rows
    are the same whatever ``range_bytes``. What the tasks find is written to the shared folder once.
    """
    files = spark.read.format("binaryFile").option("recursiveFileLookup", "true").load(path).select("path", "length")
    steps = F.explode(F.expr(f"sequence(0L, length - 1, {range_bytes}L)")).alias("start")
    ranges = files.where("length > 0").select("path", "length", steps).selectExpr("path", "length", "start", f"least(start + {range_bytes}L, length) as end")
    ranges = ranges.repartition(max(1, min(ranges.count(), 100_000)), F.xxhash64("path", "start"))
    names = [c.split()[0] for c in RECORD.split(", ")]
    kinds = {"start": pa.int64(), "end": pa.int64(), "payload_length": pa.int64(), "payload": pa.binary()}

    def read(it: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in it:
            for file, size, start, end in zip(*(c.to_pylist() for c in b.columns), strict=True):
                store, where = fs.FileSystem.from_uri(file if "://" in file else file.replace("file:/", "file:///", 1))
                with store.open_input_file(where) as f:
                    rows: list[dict] = []
                    held = 0
                    for r in _read_range(f, size, start, end):
                        rows.append(r | {"file": file} | ({} if payloads else {"payload": None}))
                        held += len(rows[-1]["payload"] or b"")
                        if held > 8 << 20 or len(rows) >= 1000:
                            yield pa.RecordBatch.from_pydict({n: pa.array([x[n] for x in rows], kinds.get(n, pa.string())) for n in names})
                            rows, held = [], 0
                    if rows:
                        yield pa.RecordBatch.from_pydict({n: pa.array([x[n] for x in rows], kinds.get(n, pa.string())) for n in names})

    found = materialize(ranges.mapInArrow(read, RECORD), "records")
    inner = materialize(inside_others(found, range_bytes), "inner_records")
    n = inner.count()
    if not n:
        return found
    return found.join(F.broadcast(inner) if n <= BROADCAST_ROWS else inner, ["file", "start"], "left_anti").select(*names)


def round_trip(pages: DataFrame, payloads: bool = True, **columns) -> DataFrame:
    """Write ``pages`` to an archive in the shared folder and read it back."""
    path = new_path(pages.sparkSession, "warc")
    write_warc(pages, path, **columns)
    return read_warc(pages.sparkSession, path, payloads=payloads)
