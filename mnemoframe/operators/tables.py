"""Written tables: lineage cuts, versions, and incremental state."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import DataFrame, Observation, SparkSession
from pyspark.sql import functions as F


def shared_dir(spark: SparkSession) -> str:
    """spark.checkpoint.dir, which all executors share; a folder of our own where it is unset and all executors are in this process."""
    root = spark.conf.get("spark.checkpoint.dir", None)
    if not root:
        if not spark.conf.get("spark.master", "").startswith("local"):
            raise RuntimeError("set spark.checkpoint.dir to a folder that all executors share")
        root = "file://" + tempfile.mkdtemp(prefix="spark-shared-")
        spark.conf.set("spark.checkpoint.dir", root)
    return root


def new_path(spark: SparkSession) -> str:
    return f"{shared_dir(spark).rstrip('/')}/mnemoframe/{uuid.uuid4().hex}"


def cut_lineage(df: DataFrame) -> DataFrame:
    """``df`` written to the shared folder and read back."""
    path = new_path(df.sparkSession)
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def drop_table(spark: SparkSession, df: DataFrame) -> None:
    """Deletes what ``cut_lineage`` wrote; ``df`` can't be read any more."""
    conf, path = spark._jsc.hadoopConfiguration(), spark._jvm.org.apache.hadoop.fs.Path  # noqa: SLF001  the public Hadoop file system is behind it
    for p in {f.rpartition("/")[0] for f in df.inputFiles()}:
        path(p).getFileSystem(conf).delete(path(p), True)


def changed_files(files: DataFrame, state: DataFrame, policy_version: str) -> DataFrame:
    """Files to be read: new ones, those whose size or times differ, and all where the policy has changed."""
    same = state.where(F.col("policy_version") == policy_version).select("path", "size", "mtime_ns", "ctime_ns")
    return files.join(same, ["path", "size", "mtime_ns", "ctime_ns"], "left_anti")


def corpus_signature(files: DataFrame) -> DataFrame:
    """(files, bytes, mtime_ns): one row that changes with any file that comes, goes or is written."""
    return files.agg(F.count("*").alias("files"), F.coalesce(F.sum("size"), F.lit(0).cast("bigint")).alias("bytes"), F.coalesce(F.sum(F.col("mtime_ns").cast("decimal(38,0)")), F.lit(0).cast("decimal(38,0)")).alias("mtime_ns"))


def next_state(files: DataFrame, state: DataFrame, policy_version: str) -> DataFrame:
    """The state after ``files`` have been read: one row a path."""
    kept = state.join(files.select("path"), "path", "left_anti")
    return kept.unionByName(files.select("path", "size", "mtime_ns", "ctime_ns").withColumn("policy_version", F.lit(policy_version)))


#: Sources whose documents mirror a file each.
DERIVED = ("memory", "course")


def stale(docs: DataFrame, expected: DataFrame, sources: tuple[str, ...] = DERIVED) -> DataFrame:
    """Derived documents whose file is gone. Sources that only ever grow are never stale."""
    return docs.where(F.col("source").isin(*sources)).join(expected.select("doc_id"), "doc_id", "left_anti")


#: What a run counts of the documents that it has read.
COUNTS = ("seen", "empty", "clean", "copyright", "nda", "added", "replaced")


def merge(old: DataFrame, new: DataFrame, run: int, mirrored: bool = False, gone: DataFrame | None = None) -> tuple[DataFrame, Observation]:
    """(documents after a run, what the run counts), both from one pass: the counts are there once the documents have been written.

    old: documents with ``run``, the number of the run that wrote each; new: documents of this run. Of a document the longer state stays, of equals the new
    one, which was classified last; with ``mirrored`` (a document is a file) always the new one. Stored documents in ``gone`` (doc_id) go. A document that
    comes out as it was keeps its run.
    """
    cols = new.columns
    kept = old if gone is None else old.join(gone.select("doc_id").distinct(), "doc_id", "left_anti")
    rows = kept.select(*cols, "run").withColumn("_new", F.lit(0)).unionByName(new.withColumns({"run": F.lit(run).cast("bigint"), "_new": F.lit(1)}))
    rows = rows.withColumn("_hash", F.xxhash64(*[F.to_json(c) if c == "turns" else F.col(c) for c in cols]))
    order = F.col("_new") if mirrored else F.struct(F.col("ended_at"), F.size("turns"), F.col("_new"))
    one = lambda c: F.max(F.when(F.col("_new") == 1, c))
    found = rows.groupBy("doc_id").agg(
        F.max_by(F.struct(*cols, "run"), order).alias("d"), (F.min("_new") == 0).alias("_old"), (F.max("_new") == 1).alias("_read"), one(F.col("sensitivity")).alias("_level"), one(F.size("turns")).alias("_size"),
        F.min("run").alias("_first"), (F.min("_hash") == F.max("_hash")).alias("_same"),
    )
    level = lambda name: F.count_if(F.col("_level") == name).alias(name)
    counted = Observation()
    found = found.observe(
        counted, F.count_if("_read").alias("seen"), F.count_if(F.col("_size") == 0).alias("empty"), level("clean"), level("copyright"), level("nda"),
        F.count_if(F.col("_read") & ~F.col("_old")).alias("added"), F.count_if(F.col("_read") & F.col("_old")).alias("replaced"),
    )
    run_of = F.when(F.col("_same"), F.col("_first")).otherwise(F.col("d.run"))
    return found.select(*[F.col(f"d.{c}").alias(c) for c in cols], run_of.alias("run")), counted
