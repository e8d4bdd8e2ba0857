"""Exact nearest vectors with pruning: vectors in cells around centroids, cells skipped by a bound on any dot product inside."""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from mnemoframe.operators.index import CELLS as ROOM
from mnemoframe.operators.index import QUERIES
from mnemoframe.operators.tables import cut_lineage, new_path

#: Centroids, which are as many of the vectors; the driver gets these and a radius and count of each cell.
CENTROIDS = 256
#: Scores are rounded to so many decimals.
DECIMALS = 6


@dataclass(frozen=True)
class Cells:
    """rows: (cell, o, v), in the order of their cells. A vector lies within its cell's radius of the centroid."""

    rows: DataFrame
    centroids: np.ndarray
    radius: np.ndarray
    count: np.ndarray


def assign(vectors: DataFrame, owner: str = "doc_id", vector: str = "embedding", centroids: int = CENTROIDS) -> Cells:
    """Every vector to its nearest centroid. Null vectors are left out. Centroids are the vectors with the least hashes of their owners; any choice gives the same lists."""
    rows = vectors.where(F.col(vector).isNotNull()).select(F.col(owner).alias("o"), F.col(vector).alias("v"))
    chosen = rows.orderBy(F.xxhash64("o"), "o").limit(centroids).select("v").toPandas()["v"]
    c = np.stack(chosen.to_numpy()).astype(np.float64) if len(chosen) else np.zeros((0, 1))

    def near(it: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in it:
            for i in range(0, len(b), max(1, ROOM // len(c))):
                part = b.iloc[i : i + max(1, ROOM // len(c))]
                v = np.stack(part["v"].to_numpy()).astype(np.float64)
                cell = ((c * c).sum(axis=1) - 2 * v @ c.T).argmin(axis=1)
                yield part.assign(cell=cell.astype(np.int32), far=np.linalg.norm(v - c[cell], axis=1))[["cell", "far", "o", "v"]]

    kinds = rows.schema
    dealt = cut_lineage(rows.mapInPandas(near, f"cell int, far double, o {kinds['o'].dataType.simpleString()}, v {kinds['v'].dataType.simpleString()}"))
    path = new_path(rows.sparkSession)
    dealt.repartitionByRange("cell", F.xxhash64("o")).sortWithinPartitions("cell").write.parquet(path)
    stored = rows.sparkSession.read.schema(dealt.schema).parquet(path)
    radius, count = np.zeros(len(c)), np.zeros(len(c), np.int64)
    for r in stored.groupBy("cell").agg(F.max("far").alias("far"), F.count("*").alias("n")).collect():
        radius[r.cell], count[r.cell] = r.far, r.n
    return Cells(stored.select("cell", "o", "v"), c, radius, count)


def nearest(cells: Cells, queries: DataFrame, k: int) -> tuple[DataFrame, float]:
    """(query, owner, score, rank): each query's k owners with the greatest dot products, ties by owner, as ``index.dense_lists`` gives them; and the share of pairs that were compared.

    For v in a cell, q·v is at most q·c + |q| times the radius. The cells of a query's highest bounds are read until they hold vectors enough; the k-th
    owner there rules out all cells whose bound is below. queries: (query, embedding), taken in blocks of bounded size.
    """
    kinds = {f.name: f.dataType.simpleString() for f in (*queries.schema, *cells.rows.schema)}
    spark, path = cells.rows.sparkSession, new_path(cells.rows.sparkSession)
    shape = f"query {kinds['query']}, owner {kinds['o']}, score double"
    numbered = cut_lineage(queries.where("embedding is not null").select(F.monotonically_increasing_id().alias("_q"), "query", "embedding"))
    spark.createDataFrame([], shape).write.parquet(path)
    best = Window.partitionBy("query").orderBy(F.desc("score"), "owner")
    last, compared, all_ = -1, 0, 0

    while len(block := numbered.where(F.col("_q") > last).orderBy("_q").limit(QUERIES).toPandas()) and len(cells.centroids):
        last = int(block["_q"].iloc[-1])
        names, q = block["query"].to_numpy(), np.stack(block["embedding"].to_numpy()).astype(np.float64)
        bound = q @ cells.centroids.T + np.linalg.norm(q, axis=1)[:, None] * cells.radius + 2 * 10.0**-DECIMALS

        def read(asked: np.ndarray, names: np.ndarray = names, q: np.ndarray = q) -> DataFrame:
            """The best of the cells that each query asks for: asked[query, cell]."""
            wanted = {int(c): np.flatnonzero(asked[:, c]) for c in np.flatnonzero(asked.any(axis=0))}

            def score(it: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
                held, parts, size = None, [], 0

                def top(rows: list[pd.DataFrame]) -> pd.DataFrame:
                    whole = pd.concat(rows).groupby(["q", "owner"], as_index=False)["score"].max()
                    return whole.sort_values(["q", "score", "owner"], ascending=[True, False, True]).groupby("q").head(k)

                for b in it:
                    for c, part in b.groupby("cell"):
                        mine = wanted[int(c)]
                        s = np.round(np.stack(part["v"].to_numpy()).astype(np.float64) @ q[mine].T, DECIMALS)
                        parts.append(pd.DataFrame({"q": np.tile(mine, len(part)), "owner": np.repeat(part["o"].to_numpy(), len(mine)), "score": s.reshape(-1)}))
                        size += s.size
                        if size > ROOM:
                            held = top(parts if held is None else [held, *parts])
                            parts, size = [], 0
                if parts or held is not None:
                    held = top(parts if held is None else [held, *parts])
                    yield pd.DataFrame({"query": names[held["q"]], "owner": held["owner"], "score": held["score"]})

            return cells.rows.where(F.col("cell").isin(sorted(wanted))).mapInPandas(score, shape)

        order = np.argsort(-bound, axis=1, kind="stable")
        before = np.cumsum(cells.count[order], axis=1) - cells.count[order]
        first = np.zeros(bound.shape, bool)
        np.put_along_axis(first, order, before < 2 * k, axis=1)
        found = cut_lineage(read(first).groupBy("query", "owner").agg(F.max("score").alias("score")))
        floors = found.withColumn("_r", F.row_number().over(best)).where(F.col("_r") == k).select("query", "score").collect()  # a row a query
        floor = {r.query: r.score for r in floors}
        rest = (bound >= np.array([floor.get(n.item() if hasattr(n, "item") else n, -np.inf) for n in names])[:, None]) & ~first
        found.write.mode("append").parquet(path)
        if rest.any():
            read(rest).write.mode("append").parquet(path)
        compared += int(((first | rest) * cells.count).sum())
        all_ += int(cells.count.sum()) * len(block)
    rows = spark.read.schema(shape).parquet(path).groupBy("query", "owner").agg(F.max("score").alias("score"))
    return rows.withColumn("rank", F.row_number().over(best)).where(F.col("rank") <= k), compared / max(all_, 1)
