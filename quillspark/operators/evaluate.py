"""Retrieval quality over cases with acceptable documents."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F


def case_ranks(hits: DataFrame, cases: DataFrame, expected: DataFrame, k: int = 5) -> DataFrame:
    """(case_id, hit_rank): the rank of the first acceptable document, counting each document once; null beyond k.

    hits: (case_id, doc_id, rank); cases: (case_id); expected: (case_id, doc_id), a row for each acceptable document.
    """
    docs = hits.groupBy("case_id", "doc_id").agg(F.min("rank").alias("rank"))
    docs = docs.withColumn("doc_rank", F.row_number().over(W.partitionBy("case_id").orderBy("rank"))).where(F.col("doc_rank") <= k)
    good = docs.join(expected.select("case_id", "doc_id").distinct(), ["case_id", "doc_id"])
    return cases.select("case_id").join(good.groupBy("case_id").agg(F.min("doc_rank").alias("hit_rank")), "case_id", "left")


def summary(ranks: DataFrame) -> DataFrame:
    """One row: n_cases, recall, mrr."""
    hit = F.col("hit_rank").isNotNull().cast("double")
    return ranks.agg(F.count("*").alias("n_cases"), F.round(F.avg(hit), 6).alias("recall"), F.round(F.avg(F.coalesce(1 / F.col("hit_rank"), F.lit(0.0))), 6).alias("mrr"))
