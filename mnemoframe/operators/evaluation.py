"""Measures of classification, retrieval and answers."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def classification(rows: DataFrame, expected: Column, predicted: Column) -> DataFrame:
    """(tp, fp, fn, tn, precision, recall), one row; a share of nothing is null."""
    n = lambda c, name: F.count_if(c).alias(name)
    out = rows.agg(n(expected & predicted, "tp"), n(~expected & predicted, "fp"), n(expected & ~predicted, "fn"), n(~expected & ~predicted, "tn"))
    return out.withColumns({"precision": F.try_divide("tp", F.col("tp") + F.col("fp")), "recall": F.try_divide("tp", F.col("tp") + F.col("fn"))})


def retrieval(ranks: DataFrame, by: str | None = None) -> DataFrame:
    """(questions, hit1, hit3, hit10, mrr) from (rank), null where nothing right was found; per category where ``by`` names one."""
    share = lambda k: F.avg(F.when(F.col("rank") <= k, 1.0).otherwise(0.0))
    groups = ranks.groupBy(*([by] if by else []))
    return groups.agg(F.count("*").alias("questions"), share(1).alias("hit1"), share(3).alias("hit3"), share(10).alias("hit10"), F.avg(F.coalesce(F.try_divide(F.lit(1.0), F.col("rank")), F.lit(0.0))).alias("mrr"))


def run_averages(results: DataFrame) -> DataFrame:
    """Per condition: answers, correct ones, and means of cost, tokens and seconds over the runs that have them."""
    tokens = F.col("input_tokens") + F.col("output_tokens")
    return results.groupBy("condition").agg(F.count("*").alias("answers"), F.count_if("correct").alias("correct"), F.avg("cost_usd").alias("cost_usd"), F.avg(tokens).alias("tokens"), F.avg("seconds").alias("seconds"))
