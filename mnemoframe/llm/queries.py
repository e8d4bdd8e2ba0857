"""The queries opN_<name>: each operator over its whole table, digested to the columns agreed for it."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from mnemoframe.llm import collocations, decontam, lexical, licenses, lines, lm, minhash, pii, quality, simhash, spm, urls, warc
from mnemoframe.llm.common import hex64, materialize, table


def op1_warc(spark: SparkSession, sf_dir: str) -> DataFrame:
    read = warc.round_trip(table(spark, sf_dir, "pages"), payloads=False)
    number = lambda c: F.regexp_extract(c, "([0-9-]+)>$", 1).try_cast("bigint")
    return read.select(
        number("record_id").alias("page_id"), F.col("payload_length").alias("payload_bytes"), "payload_digest", F.col("warc_type").alias("record_type"), number("refers_to_id").alias("refers_to")
    )


def op2_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = decontam.contamination(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"), keep=["doc_id"])
    return found.select(
        "doc_id", "n_words", "n_hit", F.size("item_ids").cast("bigint").alias("n_items"), F.sha2(F.array_join("item_ids", ","), 256).alias("items_sha256"), "contaminated"
    )


def op3_pii(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = pii.find_pii(table(spark, sf_dir, "documents"), keep=["doc_id"])
    joined = lambda c: F.array_join(F.transform(c, lambda s: F.concat_ws(":", s["kind"], s["start"], s["end"])), ",")
    kinds = F.col("base.kind")
    counts = [(F.size("base") - F.size(F.array_remove(kinds, k))).cast("bigint").alias(f"n_{k}") for k in pii.KINDS]
    return found.select("doc_id", *counts, F.sha2(joined("base"), 256).alias("base_sha256"), joined("spans").alias("spans"))


def op4_sentencepiece(spark: SparkSession, sf_dir: str) -> DataFrame:
    back = spm.round_trip(table(spark, sf_dir, "documents").select("doc_id", "text"), spm.model_bytes(spark))
    return back.select("doc_id", F.size("ids").cast("bigint").alias("n_pieces"), spm.digest(F.col("ids")).alias("ids_sha256"), F.col("same").alias("round_trip"))


def op5_simhash_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = simhash.near_duplicates(table(spark, sf_dir, "documents"), keep=["doc_id"])
    return found.select("doc_id", hex64(F.col("fingerprint")).alias("fingerprint"), "component_id")


def op6_lm_score(spark: SparkSession, sf_dir: str) -> DataFrame:
    return lm.score_texts(table(spark, sf_dir, "documents").select("doc_id", "text"), keep=["doc_id"])


def op7_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = lines.dedup_lines(table(spark, sf_dir, "documents").select("doc_id", "text", "n_chars"), report=True)
    return found.select("doc_id", "n_lines", "n_dropped", "n_chars", F.sha2(F.encode("text", "UTF-8"), 256).alias("text_sha256"))


def op8_url_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The list: canonical URLs of the pages made from documents that are labelled toxic."""
    pages = table(spark, sf_dir, "pages").select("page_id", "url")
    number = F.regexp_extract("url", r"^[^?#]*/([0-9]{1,18})(?:[./?#]|$)", 1).try_cast("bigint")
    toxic = table(spark, sf_dir, "labels").where("toxic = 1").select(F.col("doc_id").alias("_doc"))
    listed = pages.select(number.alias("_doc"), urls.canonical(F.col("url")).alias("listed_url")).join(toxic, "_doc", "left_semi").select("listed_url")
    return urls.filter_urls(pages, listed).select("page_id", "host", "path", "rule", "verdict", "canonical_url", "listed")


def op9_license_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    return licenses.scan_licenses(docs).drop("text")


def op10_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "lang", "source", "text")
    counts = materialize(quality.with_counts(docs, keep=["doc_id", "lang", "source"]), "quality")
    limits, few = quality.few_groups(quality.fences(quality.sketches(counts)))
    return quality.judge(counts, limits, broadcast=few).select("doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "kept", "reasons")


def op11_minhash_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = minhash.near_duplicates(table(spark, sf_dir, "documents"), keep=["doc_id"])
    return found.select("doc_id", "n_shingles", "component_id", F.col("doc_id").eqNullSafe(F.col("component_id")).alias("kept"))


def op12_lexical_search(spark: SparkSession, sf_dir: str) -> DataFrame:
    index = lexical.build_index(table(spark, sf_dir, "documents"))
    return lexical.search(index, table(spark, sf_dir, "benchmark")).select("item_id", "rank", "doc_id", "score")


def op13_collocations(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = collocations.collocations(table(spark, sf_dir, "documents").select("doc_id", "text", "lang"))
    return found.select("lang", "rank", "phrase", "a", "l", "r", "n", "score")


QUERIES = {f.__name__: f for f in (op1_warc, op2_decontamination, op3_pii, op4_sentencepiece, op5_simhash_dedup, op6_lm_score, op7_line_dedup, op8_url_filter, op9_license_scan, op10_quality_rules, op11_minhash_dedup, op12_lexical_search, op13_collocations)}
