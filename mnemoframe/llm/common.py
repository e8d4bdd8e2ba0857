"""Helpers shared by the training-data operators."""

from __future__ import annotations

import tempfile
import uuid
from collections.abc import Callable, Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.pandas.types import to_arrow_type

#: The vocabulary file that the SentencePiece stage uses unless told otherwise.
DEFAULT_PIECES = "file:///opt/tokenizers/piece_bpe_32k.model"


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def shared_dir(spark: SparkSession) -> str:
    """The folder that all executors share: spark.checkpoint.dir, or one of our own where that is unset and all executors are in this process (tests)."""
    root = spark.conf.get("spark.checkpoint.dir", None)
    if not root:
        if not spark.conf.get("spark.master", "").startswith("local"):
            raise RuntimeError("set spark.checkpoint.dir to a folder that all executors share")
        root = "file://" + tempfile.mkdtemp(prefix="spark-shared-")
        spark.conf.set("spark.checkpoint.dir", root)
    return root


def new_path(spark: SparkSession, name: str) -> str:
    return f"{shared_dir(spark).rstrip('/')}/mnemoframe/{uuid.uuid4().hex}/{name}"


def materialize(df: DataFrame, name: str, codec: str = "zstd") -> DataFrame:
    """Write ``df`` to a new table in the shared folder and read it back; this cuts lineage and survives lost executors."""
    spark = df.sparkSession
    path = new_path(spark, name)
    df.write.option("compression", codec).parquet(path)
    return spark.read.schema(df.schema).parquet(path)


#: Rows, and elements of their arrays, up to which a table of numbers is broadcast (some 30 MB).
FEW_ROWS, FEW_ELEMENTS = 500_000, 4_000_000


def broadcast_if_few(df: DataFrame, name: str, elements: str | None = None) -> DataFrame:
    """``df``, whose columns are numbers, written and read back, and marked for broadcasting if it is known to be small; ``elements``: an array column of numbers."""
    df = materialize(df, name)
    rows, inside = df.agg(F.count("*"), F.coalesce(F.sum(F.size(elements)) if elements else F.lit(0), F.lit(0))).first()
    return F.broadcast(df) if rows <= FEW_ROWS and inside <= FEW_ELEMENTS else df


def n_partitions(spark: SparkSession) -> int:
    return int(spark.conf.get("spark.sql.shuffle.partitions"))


def hex64(c: Column) -> Column:
    """A 64-bit value as 16 lowercase hex digits."""
    return F.lower(F.lpad(F.hex(c), 16, "0"))


def batches(it: Iterator, rows: int) -> Iterator:
    """Slices of record batches of at most ``rows`` rows, so that a task's memory doesn't follow the batch size.

    Arrow's pool gives back what a batch has used, as workers live on and share their executor's memory.
    """
    for b in it:
        for i in range(0, b.num_rows, rows):
            yield b.slice(i, rows)
        del b
        pa.default_memory_pool().release_unused()


def add_columns(df: DataFrame, text: str, added: str, find: Callable[[list], dict], keep: list[str] | None = None, rows: int = 2000) -> DataFrame:
    """``df`` (or its columns ``keep``) with the columns of the DDL string ``added``, which ``find`` makes from a list of texts.

    The other columns pass through as Arrow arrays, untouched. An input column named like a new one is replaced.
    """
    new = T.StructType.fromDDL(added)
    cols = [c for c in (df.columns if keep is None else keep) if c not in new.names]
    kinds = [to_arrow_type(f.dataType) for f in new]
    at = cols.index(text) if text in cols else len(cols)  # a text that is kept is sent once

    def run(it: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches(it, rows):
            found = find(b.column(at).to_pylist())
            yield pa.RecordBatch.from_arrays([*b.columns[: len(cols)], *[pa.array(found[f.name], k) for f, k in zip(new, kinds, strict=True)]], names=[*cols, *new.names])

    kept = df.select(*[F.col(f"`{c}`") for c in cols])
    sent = kept if at < len(cols) else df.select(*[F.col(f"`{c}`") for c in cols], F.col(f"`{text}`").alias("_text_"))
    return sent.mapInArrow(run, T.StructType([*kept.schema, *new]))
