"""Readers by the name of their source."""

from __future__ import annotations

from collections.abc import Callable, Sequence

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from mnemoframe.functions.privacy import Policy
from mnemoframe.sources import archives, notes, sessions
from mnemoframe.sources.assemble import bare_path, literal_path

READERS: dict[str, Callable[..., DataFrame]] = {
    "claude-code": sessions.read_claude_code,
    "codex": sessions.read_codex,
    "chatgpt": archives.read_chatgpt,
    "gemini": archives.read_gemini,
    "claude-web": archives.read_claude_web,
    "memory": notes.read_notes,
    "course": notes.read_courses,
}

#: Where each source's files are below its root: (folder, or none for the root itself; pattern of the file name; levels between, any number if None).
PLACES: dict[str, tuple[tuple[str, ...], str, int | None]] = {
    "claude-code": (("",), r"\.jsonl$", 1),
    "codex": (("",), r"^rollout-.*\.jsonl$", None),
    "chatgpt": (("chatgpt",), r"^conversations-.*\.json$", 0),
    "gemini": (("gemini",), r"activity.*\.json$", 0),
    "claude-web": (("claude",), r"^conversations\.json$", 0),
    "memory": (("notes", "memory", "private"), r"\.md$", None),
    "course": (("courses",), r"\.md$", None),
}


def files(spark: SparkSession, source: str, root: str) -> DataFrame:
    """(path, rel, size, mtime_ns, ctime_ns) of a source's files; rel is the path below the root. Contents aren't read.

    Hadoop's file systems know no change time of the inode, so ctime_ns is the time of modification.
    """
    folders, pattern, depth = PLACES[source]
    path = spark._jvm.org.apache.hadoop.fs.Path  # noqa: SLF001  the public Hadoop file system is behind it
    fs = path(root).getFileSystem(spark._jsc.hadoopConfiguration())  # noqa: SLF001
    there = [f for f in (f"{root.rstrip('/')}/{x}".rstrip("/") for x in folders) if fs.exists(path(f))]
    if not there:
        return spark.createDataFrame([], "path string, rel string, size bigint, mtime_ns bigint, ctime_ns bigint")
    rows = spark.read.format("binaryFile").option("recursiveFileLookup", "true").load(there).select("path", F.col("length").alias("size"), (F.unix_micros("modificationTime") * 1000).alias("mtime_ns"))
    base = F.lit(bare_path(root).rstrip("/") + "/")
    rel = F.substring_index(F.concat(F.lit("\u0001"), F.replace(F.regexp_replace("path", "^[A-Za-z0-9]+:(//[^/]*)?", ""), base, F.lit("\u0001"))), "\u0001", -1)
    parts = F.split("rel", "/")
    rows = rows.withColumn("rel", rel).where(F.element_at(parts, -1).rlike(pattern))
    if depth is not None:
        rows = rows.where(F.size(parts) == depth + (2 if folders[0] else 1))
    return rows.select("path", "rel", "size", "mtime_ns", F.col("mtime_ns").alias("ctime_ns"))


def read(spark: SparkSession, source: str, root: str, policy: Policy, only: Sequence[str] | None = None, **options: object) -> DataFrame:
    """Documents of one source under ``root``; of the files ``only``, if they are given."""
    if source not in READERS:
        raise ValueError(f"no reader for {source!r}; there are {', '.join(READERS)}")
    return READERS[source](spark, root, policy, only=None if only is None else [literal_path(p) for p in only], **options)
