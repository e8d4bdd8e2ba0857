"""Index tables: postings, document lengths, document frequencies, chunks and vectors."""

from __future__ import annotations

from collections.abc import Callable, Iterator, Sequence

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from mnemoframe.functions import text
from mnemoframe.operators.tables import new_path

#: Of the shares that make up a document's BM25 weight.
K1, B = 1.2, 0.75
Encoder = Callable[[Sequence[str], bool], np.ndarray]  #: (texts, are they queries) -> unit vectors


def search_text(turns: Column) -> Column:
    return F.array_join(F.transform(turns, lambda t: t["text"]), " ")


def from_documents(docs: DataFrame, source: str = "source") -> DataFrame:
    """Plain texts (doc_id, text, source) as documents of one user turn."""
    turn = F.struct(F.lit(0).alias("idx"), F.lit("user").alias("role"), F.lit(None).cast("timestamp").alias("ts"), F.col("text"), F.lit(False).alias("machine_summary"))
    none = F.lit(None)
    return docs.select(
        F.col("doc_id").cast("string").alias("doc_id"), F.col(source).alias("source"), F.col("doc_id").cast("string").alias("conv_id"), F.lit("").alias("title"), F.col(source).alias("project"),
        none.cast("timestamp").alias("started_at"), none.cast("date").alias("started_day"), none.cast("timestamp").alias("ended_at"), F.lit("clean").alias("sensitivity"), F.lit("").alias("cwd"), F.lit("").alias("git_branch"), F.array(turn).alias("turns"),
    )


def postings(docs: DataFrame, doc_id: str = "doc_id", title: Column | None = None, body: Column | None = None) -> DataFrame:
    """(term, doc_id, tf); the title's words count double. Words become rows before they are filtered, in compiled code, and are counted inside each task before they are shuffled."""
    raw = text.raw_words(F.col("text") if body is None else body)
    if title is not None:
        raw = F.concat(*[text.raw_words(title)] * text.TITLE_REPEAT, raw)
    words = docs.select(F.col(doc_id).alias("doc_id"), F.explode(raw).alias("term")).where(text.is_term(F.col("term")))
    return words.groupBy("term", "doc_id").agg(F.count("*").alias("tf"))


def doc_lengths(docs: DataFrame, doc_id: str = "doc_id", title: Column | None = None, body: Column | None = None) -> DataFrame:
    """(doc_id, dl): tokens of each document, none included."""
    title = F.lit("") if title is None else title
    body = F.col("text") if body is None else body
    return docs.select(F.col(doc_id).alias("doc_id"), F.size(text.doc_tokens(title, body)).cast("bigint").alias("dl"))


def lengths_of(docs: DataFrame, post: DataFrame, doc_id: str = "doc_id") -> DataFrame:
    """``doc_lengths`` from written postings, so that texts aren't cut into words again."""
    sums = post.groupBy("doc_id").agg(F.sum("tf").alias("dl"))
    return docs.select(F.col(doc_id).alias("doc_id")).join(sums, "doc_id", "left").select("doc_id", F.coalesce("dl", F.lit(0).cast("bigint")).alias("dl"))


def term_df(post: DataFrame) -> DataFrame:
    return post.groupBy("term").agg(F.count("*").alias("df"))


def corpus_stats(lengths: DataFrame) -> DataFrame:
    """(n, avgdl), one row; avgdl is 1 where there is nothing to average."""
    avg = F.avg("dl")
    return lengths.agg(F.count("*").alias("n"), F.when(avg > 0, avg).otherwise(F.lit(1.0)).alias("avgdl"))


def bm25(post: DataFrame, lengths: DataFrame, terms: DataFrame, by: Sequence[str] = (), k1: float = K1, b: float = B) -> DataFrame:
    """(by.., doc_id, score): BM25 of each query's distinct terms over the whole corpus.

    terms: (by.., term). Statistics are those of all documents: filter what comes out, never what goes in. ``post`` and
    ``lengths`` are read several times, so they should be written tables.
    """
    keys = [*by]
    wanted = terms.select(*keys, "term").distinct()
    hits = post.join(wanted, "term")
    df = post.join(wanted.select("term").distinct(), "term", "left_semi").groupBy("term").agg(F.count("*").alias("df"))
    n, avgdl, tf, dl = F.col("n"), F.col("avgdl"), F.col("tf").cast("double"), F.col("dl")
    idf = F.log(F.lit(1.0) + (n - F.col("df") + F.lit(0.5)) / (F.col("df") + F.lit(0.5)))
    weight = tf * F.lit(k1 + 1) / (tf + F.lit(k1) * (F.lit(1 - b) + F.lit(b) * dl / avgdl))
    scored = hits.join(df, "term").join(lengths, "doc_id").crossJoin(F.broadcast(corpus_stats(lengths)))  # one row of statistics
    return scored.groupBy(*keys, "doc_id").agg(F.sum(idf * weight).alias("score"))


def chunk_rows(docs: DataFrame) -> DataFrame:
    """(doc_id, chunk_no, chunk, content_key) for embedding; the key changes with title or turns, not with other metadata."""
    head = F.concat(F.col("title"), F.lit(" | "), F.coalesce(F.date_format("started_day", "yyyy-MM-dd"), F.lit("")), F.lit(" | "), F.col("source"), F.lit("\n"))
    whole = search_text(F.col("turns"))
    return docs.select("doc_id", text.content_key(F.col("title"), whole).alias("content_key"), F.posexplode(text.chunks(head, F.col("turns"), whole)).alias("chunk_no", "chunk"))


def encode(chunks: DataFrame, encoder: Encoder, batch: int = 256) -> DataFrame:
    """``chunks`` with an embedding for each, in batches inside each task."""

    def run(it: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in it:
            for i in range(0, len(b), batch):
                part = b.iloc[i : i + batch]
                yield part.assign(embedding=[v.tolist() for v in np.asarray(encoder(part["chunk"].tolist(), False), np.float32)])

    return chunks.mapInPandas(run, "doc_id string, content_key string, chunk_no int, chunk string, embedding array<float>")


def unchanged_vectors(old: DataFrame, docs: DataFrame) -> DataFrame:
    """Vectors of documents whose title and turns are as they were."""
    now = docs.select("doc_id", text.content_key(F.col("title"), search_text(F.col("turns"))).alias("content_key"))
    return old.join(now, ["doc_id", "content_key"], "left_semi")


VECTOR_COLUMNS = ["doc_id", "content_key", "chunk_no", "chunk", "embedding"]


def missing_vectors(old: DataFrame | None, docs: DataFrame, encoder: Encoder) -> DataFrame:
    """Vectors of those of ``docs`` whose content key isn't in ``old``."""
    now = chunk_rows(docs).select(*VECTOR_COLUMNS[:-1])
    if old is not None:
        now = now.join(old.select("doc_id", "content_key").distinct(), ["doc_id", "content_key"], "left_anti")
    return encode(now.select(*VECTOR_COLUMNS[:-1]), encoder).select(*VECTOR_COLUMNS)


def update_vectors(old: DataFrame | None, docs: DataFrame, encoder: Encoder) -> DataFrame:
    """Vectors for ``docs``: rows whose document has the same content key are taken from ``old``, only the others are encoded."""
    new = missing_vectors(old, docs, encoder)
    return new if old is None else unchanged_vectors(old, docs).select(*VECTOR_COLUMNS).unionByName(new)


def dot(a: Column, b: Column) -> Column:
    """Dot product in doubles, in the order of the elements."""
    return F.aggregate(F.zip_with(a, b, lambda x, y: x.cast("double") * y.cast("double")), F.lit(0.0), lambda s, x: s + x)


def dense_scores(vectors: DataFrame, query: Sequence[float], owner: str = "doc_id", vector: str = "embedding") -> DataFrame:
    """(owner, score): the best chunk of each owner; the query is a literal, so nothing is joined, and maxima are combined before the shuffle."""
    q = F.array(*[F.lit(float(x)) for x in query])
    return vectors.groupBy(F.col(owner)).agg(F.max(dot(F.col(vector), q)).alias("score"))


#: Query vectors that are sent to all tasks at once (8 kB each at 1,024 dimensions), and scores that a task computes at once.
QUERIES, CELLS = 512, 2_000_000


def dense_lists(vectors: DataFrame, queries: DataFrame, k: int | None = None, owner: str = "doc_id", vector: str = "embedding") -> DataFrame:
    """(query, owner, score, rank): for each query (query, embedding) the owners' best dot products, the k largest or all; ties by owner.

    Queries go through the vectors in blocks of bounded size. A task keeps the best of each owner, and of those its k first, so what is
    shuffled follows queries and k (or the number of owners), not the product of both tables. Scores have six decimals.
    """
    kinds = {f.name: f.dataType.simpleString() for f in (*queries.schema, *vectors.schema)}
    shape = f"query {kinds['query']}, owner {kinds[owner]}, score double"
    spark, path = vectors.sparkSession, new_path(vectors.sparkSession)
    rest, rows = queries, queries.orderBy("query").limit(QUERIES).toPandas()
    while len(rows):
        names, matrix = rows["query"].to_numpy(), np.stack(rows["embedding"].to_numpy()).astype(np.float64)

        def best(it: Iterator[pd.DataFrame], names: np.ndarray = names, matrix: np.ndarray = matrix) -> Iterator[pd.DataFrame]:
            held, floor = None, np.full(len(names), -np.inf)
            for b in it:
                for i in range(0, len(b), max(1, CELLS // len(names))):
                    part = b.iloc[i : i + max(1, CELLS // len(names))]
                    score = np.round(np.stack(part["v"].to_numpy()).astype(np.float64) @ matrix.T, 6)
                    row, q = np.nonzero(score >= floor)  # what k owners have surpassed already can't be among the first
                    new = pd.DataFrame({"q": q, "owner": part["o"].to_numpy()[row], "score": score[row, q]})
                    held = (new if held is None else pd.concat([held, new])).groupby(["q", "owner"], as_index=False)["score"].max()
                    if k is not None:
                        held = held.sort_values(["q", "score", "owner"], ascending=[True, False, True]).groupby("q").head(k)
                        full = held.groupby("q")["score"].agg(["size", "min"])
                        full = full[full["size"] >= k]
                        floor[full.index] = full["min"]
            if held is not None:
                yield pd.DataFrame({"query": names[held["q"]], "owner": held["owner"], "score": held["score"]})

        vectors.select(F.col(owner).alias("o"), F.col(vector).alias("v")).mapInPandas(best, shape).write.mode("append").parquet(path)
        rest = rest.where(F.col("query") > F.lit(names[-1].item() if hasattr(names[-1], "item") else names[-1]))
        rows = rest.orderBy("query").limit(QUERIES).toPandas()
    if rest is queries:
        return spark.createDataFrame([], f"{shape}, rank int")
    whole = spark.read.schema(shape).parquet(path).groupBy("query", "owner").agg(F.max("score").alias("score"))
    ranked = whole.withColumn("rank", F.row_number().over(Window.partitionBy("query").orderBy(F.desc("score"), "owner")))
    return ranked if k is None else ranked.where(F.col("rank") <= k)
