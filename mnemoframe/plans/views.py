"""The given tables in the shapes that the operators take."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from mnemoframe.operators import index as ix


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def text_docs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """documents as documents of one user turn."""
    return ix.from_documents(table(spark, sf_dir, "documents").select("doc_id", "text", "source"))


def talk_turns(spark: SparkSession, sf_dir: str) -> DataFrame:
    """conversations as turn rows; system turns aren't part of a conversation."""
    rows = table(spark, sf_dir, "conversations").where("role in ('user', 'assistant')")
    return rows.select(F.col("conv_id").cast("string").alias("doc_id"), F.col("turn").cast("int").alias("idx"), "role", F.lit(None).cast("timestamp").alias("ts"), "text", F.lit(False).alias("machine_summary"))


def talk_docs(spark: SparkSession, sf_dir: str) -> DataFrame:
    turns = talk_turns(spark, sf_dir).groupBy("doc_id").agg(F.array_sort(F.collect_list(F.struct("idx", "role", "ts", "text", "machine_summary"))).alias("turns"))
    none = F.lit(None)
    return turns.select(
        "doc_id", F.lit("chatgpt").alias("source"), F.col("doc_id").alias("conv_id"), F.lit("").alias("title"), F.lit("chatgpt").alias("project"), none.cast("timestamp").alias("started_at"), none.cast("date").alias("started_day"),
        none.cast("timestamp").alias("ended_at"), F.lit("clean").alias("sensitivity"), F.lit("").alias("cwd"), F.lit("").alias("git_branch"), "turns",
    )


def event_docs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """events as dated documents; errors are confidential."""
    turn = F.struct(F.lit(0).alias("idx"), F.lit("user").alias("role"), F.col("ts").cast("timestamp").alias("ts"), F.col("props").alias("text"), F.lit(False).alias("machine_summary"))
    level = F.when(F.col("event_type") == "error", F.lit("nda")).otherwise(F.lit("clean"))
    return table(spark, sf_dir, "events").select(
        F.col("event_id").cast("string").alias("doc_id"), F.col("event_type").alias("source"), F.col("event_id").cast("string").alias("conv_id"), F.lit("").alias("title"), F.concat(F.lit("user-"), F.col("user_id")).alias("project"),
        F.col("ts").cast("timestamp").alias("started_at"), F.to_date("ts").alias("started_day"), F.col("ts").cast("timestamp").alias("ended_at"), level.alias("sensitivity"), F.lit("").alias("cwd"), F.lit("").alias("git_branch"), F.array(turn).alias("turns"),
    )


def order_claims(spark: SparkSession, sf_dir: str) -> DataFrame:
    """orders as claims: a customer's statement by priority; the status is what it says."""
    kind = F.when(F.col("o_orderstatus") == "O", F.lit("offen")).otherwise(F.lit("fakt"))
    return table(spark, sf_dir, "orders").select(
        F.lit("orders").alias("entity"), F.concat(F.lit("customer "), F.col("o_custkey")).alias("topic"), F.col("o_orderpriority").alias("key"), kind.alias("kind"), F.col("o_orderstatus").alias("text"), F.to_date("o_orderdate").alias("stated_on"),
        F.lpad(F.col("o_orderkey").cast("string"), 12, "0").alias("source_doc_id"), F.lit("medium").alias("confidence"), F.lit("").alias("rationale"),
    )


def labelled_docs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(doc_id, source, sensitivity): toxic documents are confidential, those of low quality foreign, the rest clean."""
    docs = table(spark, sf_dir, "documents").select("doc_id", "source", "lang", "text").join(table(spark, sf_dir, "labels"), "doc_id", "left")
    level = F.when(F.col("toxic") == 1, F.lit("nda")).when(F.col("quality") == 0, F.lit("copyright")).otherwise(F.lit("clean"))
    return docs.select(F.col("doc_id").cast("string").alias("doc_id"), "source", "lang", level.alias("sensitivity"), F.substring(F.sha2("text", 256), 1, 16).alias("source_fingerprint"), "quality", "toxic")


def place_edges(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(child, parent): customers and suppliers below their nation, nations below their region."""
    name = lambda kind, c: F.concat(F.lit(kind), F.col(c))
    rows = table(spark, sf_dir, "nation").select(name("n", "n_nationkey").alias("child"), name("r", "n_regionkey").alias("parent"))
    rows = rows.unionByName(table(spark, sf_dir, "customer").select(name("c", "c_custkey").alias("child"), name("n", "c_nationkey").alias("parent")))
    return rows.unionByName(table(spark, sf_dir, "supplier").select(name("s", "s_suppkey").alias("child"), name("n", "s_nationkey").alias("parent")))
