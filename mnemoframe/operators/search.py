"""Ranked search over an index: substring, BM25 and dense lists, fused by reciprocal rank."""

from __future__ import annotations

from dataclasses import dataclass
from datetime import date

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from mnemoframe.functions import privacy, text
from mnemoframe.operators import index as ix
from mnemoframe.operators import segments as sg
from mnemoframe.operators.tables import cut_lineage

#: Weights of a hit by where it stands, the depth of a list and the constant of reciprocal ranks.
USER, SUMMARY, ASSISTANT, TITLE = 2.0, 1.5, 1.0, 2.0
DEPTH, RRF_K, DENSE_WEIGHT = 100, 60, 0.5
RANKINGS = ("fused", "hybrid", "substring")


class VectorsUnavailable(RuntimeError):
    """Hybrid ranking was asked for without an encoder for the query."""


@dataclass(frozen=True)
class Query:
    terms: tuple[str, ...]
    required: tuple[str, ...]

    @classmethod
    def parse(cls, query: str) -> Query:
        terms, quoted = text.parse_query(query)
        return cls(tuple(terms), tuple(quoted))


def role_weight(turn: Column) -> Column:
    return F.when(turn["role"] != "user", F.lit(ASSISTANT)).when(turn["machine_summary"], F.lit(SUMMARY)).otherwise(F.lit(USER))


def weighted_hits(title: Column, turns: Column, pattern: str) -> Column:
    """Sum over title and turns of matches times the weight of the place."""
    count = lambda c: text.count_matches(c, pattern).cast("double")
    return F.lit(TITLE) * count(F.coalesce(title, F.lit(""))) + F.aggregate(turns, F.lit(0.0), lambda s, t: s + role_weight(t) * count(t["text"]))


def has_all(folded: Column, terms: tuple[str, ...]) -> Column:
    out = F.lit(True)
    for t in terms:
        out = out & F.contains(folded, F.lit(t.lower()))
    return out


def matched(folded: Column, terms: tuple[str, ...]) -> Column:
    """How many of the terms occur; a term that is asked for twice counts twice."""
    out = F.lit(0)
    for t in terms:
        out = out + F.contains(folded, F.lit(t.lower())).cast("int")
    return out


def best_turn(turns: Column, pattern: str) -> Column:
    """Text of the turn that a snippet is cut from: the last matching turn in the person's own words, else the first match."""
    hits = F.filter(turns, lambda t: t["text"].rlike(pattern))
    own = F.filter(hits, lambda t: (t["role"] == "user") & ~t["machine_summary"])
    return F.coalesce(F.try_element_at(own, F.lit(-1))["text"], F.try_element_at(hits, F.lit(1))["text"])


def ranked(rows: DataFrame, *order: Column) -> DataFrame:
    """``rows`` with their rank from 1; ties go by doc_id. The lists that are ranked are cut or filtered before."""
    return rows.withColumn("rank", F.row_number().over(Window.orderBy(*order, F.col("doc_id"))))


def top(rows: DataFrame, n: int, *order: Column) -> DataFrame:
    return rows.orderBy(*order, F.col("doc_id")).limit(n)


def _by_count(rows: DataFrame) -> DataFrame:
    """Ranks of a list of any length without one task for all of it: range partitions by (score, doc_id), a count of each, and the rank inside."""
    # Written once: the ranges are sampled, and another run could draw them otherwise.
    parts = cut_lineage(rows.repartitionByRange(F.desc("score"), F.col("doc_id")).withColumn("_part", F.spark_partition_id()))
    sizes = parts.groupBy("_part").agg(F.count("*").alias("_n"))
    before = sizes.withColumn("_before", F.coalesce(F.sum("_n").over(Window.orderBy("_part").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)))
    inside = F.row_number().over(Window.partitionBy("_part").orderBy(F.desc("score"), F.col("doc_id")))
    return parts.withColumn("_in", inside).join(F.broadcast(before.select("_part", "_before")), "_part").withColumn("rank", (F.col("_before") + F.col("_in")).cast("int")).drop("_part", "_in", "_before")


def rrf(lists: list[tuple[DataFrame, float]], k: int = RRF_K) -> DataFrame:
    """(doc_id, score): sum over lists (doc_id, rank from 1) of weight / (k + rank)."""
    parts = [rows.select("doc_id", (F.lit(w) / (F.lit(k) + F.col("rank"))).alias("part")) for rows, w in lists]
    out = parts[0]
    for p in parts[1:]:
        out = out.unionByName(p)
    return out.groupBy("doc_id").agg(F.sum("part").alias("score"))


def search(
    index: sg.Index, query: str, limit: int = 10, include_nda: bool = False, since: date | None = None, source: str | None = None, project: str | None = None,
    today: date | None = None, ranking: str = "fused", encoder: ix.Encoder | None = None,
) -> DataFrame:
    """(doc_id, score, matched_terms, total_terms, snippet, source, title, started_day, sensitivity), best first.

    substring: documents with all terms by weighted hits and recency; if none is visible, those with some.
    fused: reciprocal ranks of that list and of BM25's first 100; documents with all terms first.
    hybrid: reciprocal ranks of the fused list's first 100 and, at half weight, the dense list's; without vectors as fused.

    Trigrams name the documents that may hold the terms, and only these are read; partial matches are looked for when a ranking needs them.
    """
    if ranking not in RANKINGS:
        raise ValueError(f"ranking is one of {', '.join(RANKINGS)}")
    q = Query.parse(query)
    spark = index.docs.sparkSession
    shape = "doc_id string, score double, matched_terms int, total_terms int, snippet string, source string, title string, started_day date, sensitivity string"
    if not q.terms or limit <= 0:
        return spark.createDataFrame([], shape)
    pattern, n = text.alternation(q.terms), len(q.terms)
    shown = privacy.visible(index.docs, include_nda, source, project, since)
    place = ["doc_id", *sg.PLACE]

    def with_matches(rows: DataFrame, *keep: str) -> DataFrame:
        """``rows`` with matched_terms, read from their texts."""
        rows = text.once(rows, folded=sg.whole(F.col("title"), F.col("turns")))
        return rows.select(*keep, matched(F.col("folded"), q.terms).alias("matched_terms"))

    def hits(every: bool) -> DataFrame:
        """Visible documents with all terms, or with any: what the query asks of a text is read from it once, into a table of ids and numbers."""
        rows = with_matches(sg.read_at(shown, sg.candidates(index, q.terms, every)), *place, "title", "turns", "started_day")
        rows = rows.where(F.col("matched_terms") == n if every else F.col("matched_terms") > 0)
        score = weighted_hits(F.col("title"), F.col("turns"), pattern) * text.recency(F.col("started_day"), F.lit(today or date.today()))
        return cut_lineage(rows.select(*place, "matched_terms", score.alias("score")).where("score > 0"))

    full = hits(True)
    by_matches = [F.desc("matched_terms"), F.desc("score")]
    if ranking == "substring":
        best = full if full.take(1) or n == 1 else hits(False)
        return _present(top(best, limit, *by_matches), shown, q, pattern, n).orderBy(*by_matches, "doc_id")

    terms = spark.createDataFrame([(query,)], "q string").select(F.explode(F.array_distinct(text.tokenize(F.col("q")))).alias("term"))
    allowed = shown
    if q.required:
        quoted = text.once(sg.read_at(shown, sg.candidates(index, q.required)), folded=sg.whole(F.col("title"), F.col("turns")))
        allowed = cut_lineage(quoted.where(has_all(F.col("folded"), q.required)).select(*place))

    def told(found: DataFrame) -> DataFrame:
        """At most DEPTH documents (place, rank) with their matches."""
        found = cut_lineage(found.select(*place, "rank"))
        return with_matches(sg.read_at(shown, sg.masks_of(found)), "doc_id").join(F.broadcast(found), "doc_id").select(*place, "rank", "matched_terms")

    lexical = told(ranked(sg.top_bm25(index, terms, DEPTH, allowed)[0], F.desc("score")))
    lists = cut_lineage(_by_count(full).select(*place, "rank", "matched_terms").unionByName(lexical))
    if not lists.take(1) and n > 1:  # function words, short terms: the partial matches stand in
        lists = ranked(top(hits(False), max(limit, DEPTH), *by_matches), *by_matches).select(*place, "rank", "matched_terms")
    of = lambda rows: rows.select(*place, "matched_terms").distinct()
    fused = rrf([(lists, 1.0)]).join(of(lists), "doc_id")
    order = [F.desc(F.col("matched_terms") == n), F.desc("score")]
    if ranking == "fused" or index.vectors is None:
        return _present(top(fused, limit, *order), shown, q, pattern, n).orderBy(*order, "doc_id")

    if encoder is None:
        raise VectorsUnavailable("hybrid ranking needs an encoder for the query")
    vector = [float(x) for x in encoder([query], True)[0]]
    dense = top(ix.dense_scores(index.vectors, vector).join(allowed.select(*place), "doc_id"), DEPTH, F.desc("score"))
    dense = told(ranked(dense, F.desc("score")))
    first = ranked(top(fused, DEPTH, *order), *order).select(*place, "rank", "matched_terms")
    both = rrf([(first, 1.0), (dense, DENSE_WEIGHT)]).join(of(first.unionByName(dense)), "doc_id")
    return _present(top(both, limit, F.desc("score")), shown, q, pattern, n).orderBy(F.desc("score"), "doc_id")


def _present(found: DataFrame, docs: DataFrame, q: Query, pattern: str, n: int) -> DataFrame:
    """A few hits with what is shown of them."""
    found = cut_lineage(found.select("doc_id", *sg.PLACE, "score", "matched_terms"))  # at most ``limit`` rows
    rows = sg.read_at(docs, sg.masks_of(found)).drop(*sg.PLACE).join(F.broadcast(found), "doc_id")
    cut = text.snippets(best_turn(F.col("turns"), pattern), q.terms)
    shown = F.when(cut == "", F.col("title")).otherwise(cut)
    return rows.select("doc_id", "score", "matched_terms", F.lit(n).alias("total_terms"), shown.alias("snippet"), "source", "title", "started_day", "sensitivity")


def timeline(docs: DataFrame, limit: int = 15, **filters: object) -> DataFrame:
    """Visible documents by day, latest first, those without a day last."""
    seen = privacy.visible(docs, **filters)
    return seen.orderBy(F.col("started_day").desc_nulls_last(), "doc_id").limit(limit).select("doc_id", "source", "project", "title", "started_day", "sensitivity", F.size("turns").alias("n_turns"))


def get_doc(docs: DataFrame, doc_id: str, offset: int = 0, include_nda: bool = False, window: int = 8000) -> DataFrame:
    """(doc_id, body, n_chars, next_offset): a window of a visible document's text; no row if there is none of this id."""
    body = F.array_join(F.transform("turns", lambda t: F.concat(F.lit("## "), t["role"], F.lit("\n\n"), t["text"], F.lit("\n"))), "\n")
    rows = privacy.visible(docs, include_nda).where(F.col("doc_id") == doc_id).select("doc_id", body.alias("whole"))
    end = F.lit(offset + window)
    return rows.select("doc_id", F.substring("whole", offset + 1, window).alias("body"), F.length("whole").alias("n_chars"), F.when(F.length("whole") > end, end).alias("next_offset"))


def stats(docs: DataFrame) -> DataFrame:
    """(source, docs, clean, copyright, nda)."""
    count = lambda level: F.count_if(F.col("sensitivity") == level).alias(level)
    return docs.groupBy("source").agg(F.count("*").alias("docs"), count("clean"), count("copyright"), count("nda"))
