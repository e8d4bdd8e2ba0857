"""Session logs that grow, as a stream: each trigger reads what whole lines have been appended since the one before.

Offsets are bytes of each file behind its last whole line, so a line that is still being written waits for its end. Logs only grow; a file that
shrinks is read no further.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

from pyarrow import fs
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.datasource import DataSource, DataSourceStreamReader, InputPartition

from mnemoframe.functions import privacy, text
from mnemoframe.sources.sessions import CLAUDE_LINE, claude_text, project_slug, stem

LINES = "file string, pos bigint, line string"
#: Bytes of a range that a task reads, and of a step when the last line end is looked for.
RANGE, STEP = 64 << 20, 1 << 16


@dataclass
class Range(InputPartition):
    """Lines of a file that begin from start on and before end."""

    file: str
    start: int
    end: int


class TailReader(DataSourceStreamReader):
    def __init__(self, root: str, size: int) -> None:
        self.root, self.size, self.known = root, size, {}

    def _store(self) -> tuple[fs.FileSystem, str]:
        return fs.FileSystem.from_uri(self.root)

    def initialOffset(self) -> dict:
        return {}

    def latestOffset(self) -> dict:
        """Of each file ``root/<project>/<session>.jsonl`` the byte behind its last line end; files that are as long as before aren't opened."""
        store, base = self._store()
        now = {}
        for info in store.get_file_info(fs.FileSelector(base, recursive=True, allow_not_found=True)):
            if info.type != fs.FileType.File or not info.path.endswith(".jsonl") or info.path.removeprefix(base.rstrip("/")).count("/") != 2:
                continue
            size, end = self.known.get(info.path, (-1, 0))
            if info.size != size:
                end = max(end, self._last_line_end(store, info.path, info.size, end))
                self.known[info.path] = (info.size, end)
            now[info.path] = end
        return now

    @staticmethod
    def _last_line_end(store: fs.FileSystem, path: str, size: int, least: int) -> int:
        with store.open_input_file(path) as f:
            z = size
            while z > least:
                a = max(least, z - STEP)
                found = f.read_at(z - a, a).rfind(b"\n")
                if found >= 0:
                    return a + found + 1
                z = a
        return least

    def partitions(self, start: dict, end: dict) -> list[Range]:
        return [Range(f, a, min(a + self.size, z)) for f, z in sorted(end.items()) for a in range(start.get(f, 0), z, self.size)] or [Range("", 0, 0)]

    def read(self, part: Range) -> Iterator[tuple]:
        if not part.file:
            return
        store, _ = self._store()
        with store.open_input_file(part.file) as f:
            at, rest = part.start, b""
            if at:  # a line that began before belongs to the range before
                f.seek(at - 1)
                while (c := f.read(STEP)) and b"\n" not in c:
                    at += len(c)
                at += c.find(b"\n")
                rest = c[c.find(b"\n") + 1 :]
            while at < part.end:
                if b"\n" not in rest:
                    more = f.read(STEP)
                    if not more:
                        return
                    rest += more
                    continue
                line, _, rest = rest.partition(b"\n")
                yield part.file, at, line.decode("utf-8", "replace")
                at += len(line) + 1

    def commit(self, end: dict) -> None:
        pass


class SessionTail(DataSource):
    """Options: path, the folder as a URI that driver and tasks reach; rangebytes, bytes of a range."""

    @classmethod
    def name(cls) -> str:
        return "session_tail"

    def schema(self) -> str:
        return LINES

    def streamReader(self, schema: object) -> TailReader:
        return TailReader(self.options["path"], int(self.options.get("rangebytes", RANGE)))


def read_sessions(spark: SparkSession, root: str, range_bytes: int = RANGE) -> DataFrame:
    """The stream of turn rows (source, conv_id, project, idx, role, ts, text) that have been appended to sessions below ``root``; idx is the line's place in bytes."""
    spark.dataSource.register(SessionTail)
    lines = spark.readStream.format("session_tail").option("rangebytes", range_bytes).load(root)
    rows = lines.withColumn("o", F.from_json("line", CLAUDE_LINE)).where("o.type in ('user', 'assistant') and not coalesce(o.isMeta, false) and not coalesce(o.isSidechain, false)")
    said = claude_text(F.col("o.message.content"))
    body = F.when(F.col("o.type") == "user", text.strip_noise(said)).otherwise(text.strip(said))
    conv = F.coalesce(F.nullif("o.sessionId", F.lit("")), stem(F.col("file")))
    turns = rows.select(F.lit("claude-code").alias("source"), conv.alias("conv_id"), project_slug(F.col("file"), "").alias("project"), F.col("pos").alias("idx"), F.col("o.type").alias("role"), F.try_to_timestamp("o.timestamp").alias("ts"), body.alias("text"))
    return turns.where("text <> ''")


def documents_of(landed: DataFrame) -> DataFrame:
    """Documents (source, conv_id, project, sensitivity, started_at, ended_at, turns) of turn rows as ``landing.write_documents`` leaves them: confidential if any turn is."""
    turn = F.struct("idx", "role", "ts", "text")
    level = F.when(F.max((F.col("sensitivity") == privacy.NDA).cast("int")) == 1, F.lit(privacy.NDA)).otherwise(F.lit(privacy.CLEAN))
    turns = F.transform(F.array_sort(F.collect_set(turn)), lambda t, i: t.withField("idx", i))
    return landed.groupBy("source", "conv_id", "project").agg(level.alias("sensitivity"), F.min("ts").alias("started_at"), F.max("ts").alias("ended_at"), turns.alias("turns"))
