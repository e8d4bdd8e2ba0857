"""A corpus pipeline: quality rules, line dedup, near-dedup, decontamination, then SentencePiece encoding and decoding.

Each stage takes (spark, docs, sf_dir) and returns a DataFrame; run() writes what a stage returns to Parquet in the shared
folder and gives it to the next one. All stages but the last return the columns of their input.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from mnemoframe.llm import decontam, lines, quality, simhash, spm
from mnemoframe.llm.common import materialize, table


def quality_rules(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that fail the base rule or their language's and source's thresholds go.

    Null and empty texts have no words and fail; null languages and sources are groups of their own. Rows are judged each for itself, so repeated ones share
    their fate and nothing ties. Very long texts are counted whole, columns of any other names pass through, an empty table gives no rows.
    """
    return quality.filter_quality(docs)


def line_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Lines that repeat an earlier one, or are an edit away from it, go; documents stay, with n_chars set anew.

    Earlier: by doc_id (null last), of different texts of one id by their hash, then by line. Rows that repeat id and text lose the same lines. Null texts stay null, empty
    ones empty; very long texts are cut into lines like any other; an empty table gives no rows.
    """
    return lines.dedup_lines(docs)


def near_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each component stays, that with the smallest doc_id; of rows that repeat it the first, and null ids are the last.

    Null and empty texts are alike, so one of them stays. Very long texts have one fingerprint like any other; an empty table gives no rows.
    """
    return simhash.keep_one(docs)


def decontamination(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents with at least a twentieth of their words inside benchmark windows go.

    Null and empty texts have no words and stay; equal texts go or stay together, whatever their ids. Very long texts are scanned whole. Without documents or items
    nothing goes.
    """
    return decontam.drop_contaminated(docs, table(spark, sf_dir, "benchmark"))


def sentencepiece(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Piece ids of each text, and whether they decode to it; the text's column gives way to ids, n_pieces and round_trip, and so do columns of these names.

    Null and empty texts have no pieces. Very long texts are split, with the ids that they have whole. Every row gives one row; an empty table none.
    """
    back = spm.round_trip(docs, spm.model_bytes(spark))
    return back.select(*[F.col(f"`{c}`") for c in docs.columns if c not in ("text", "ids", "n_pieces", "round_trip")], "ids", F.size("ids").cast("bigint").alias("n_pieces"), F.col("same").alias("round_trip"))


STAGES = [("quality rules", quality_rules), ("line dedup", line_dedup), ("near-dedup", near_dedup), ("decontamination", decontamination), ("sentencepiece", sentencepiece)]

#: The last stage's ids can't be had in SQL.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    for name, stage in STAGES:
        docs = materialize(stage(spark, docs, sf_dir), name.replace(" ", "_"))
    return docs
