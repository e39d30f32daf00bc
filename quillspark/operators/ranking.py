"""Ranks, caps and fusion of ranked lists."""

from __future__ import annotations

from collections.abc import Iterator, Sequence
from functools import reduce

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_type

#: Fixed values of fusion.
CANDIDATES, ROUTED, RRF_K = 60, 20, 10
VERIFIED_BOOST, SUPERSEDED_PENALTY, MOST_PER_DOC = 1.06, 0.6, 3


def top_by(df: DataFrame, k: int, partition: list[str], *order: Column, rank: str = "rank") -> DataFrame:
    """The first k rows of each partition, with their rank from 1."""
    ranked = df.withColumn(rank, F.row_number().over(W.partitionBy(*partition).orderBy(*order)))
    return ranked.where(F.col(rank) <= k)


def _matrix(vectors: pa.Array) -> np.ndarray:
    """Vectors of one length as unit rows in double precision; a zero one stays zero."""
    if not len(vectors):
        return np.empty((0, 0))
    rows = np.asarray(pc.list_flatten(vectors).to_numpy(zero_copy_only=False), dtype=np.float64).reshape(len(vectors), -1)
    return rows / np.maximum(np.sqrt((rows * rows).sum(axis=1, keepdims=True)), 1e-12)


def _nearest_in_batches(sent, k: int, kinds: tuple[pa.DataType, pa.DataType]):
    schema = pa.schema([("query_id", kinds[0]), ("row_id", kinds[1]), ("score", pa.float64())])

    def near(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        ids, queries = sent.value
        for batch in batches:
            batch = batch.filter(pc.is_valid(batch.column("vec")))
            if not len(batch) or not len(ids):
                continue
            rows = _matrix(batch.column("vec"))
            for start in range(0, len(ids), 512):
                scores = np.round(rows @ queries[start : start + 512].T, 9)
                # all that reach the k-th best score of a query, ties with it included
                least = np.partition(scores, -k, axis=0)[-k] if len(rows) > k else np.full(scores.shape[1], -np.inf)
                r, q = np.nonzero(scores >= least)
                yield pa.RecordBatch.from_arrays([ids.take(pa.array(q + start)), batch.column("row_id").take(pa.array(r)), pa.array(scores[r, q])], schema=schema)

    return near


def cosine(queries: DataFrame, vectors: DataFrame, k: int = CANDIDATES, block: int = 10_000) -> DataFrame:
    """(query_id, row_id, score, rank): the k rows of largest cosine for each query.

    queries: (query_id, vec), a stated set that is sent to the tasks in blocks of so many, each block in a pass of its own;
    vectors: (row_id, vec), all of one length. Filter vectors before. Batches are matrix products, and only their best
    rows for each query are shuffled. Ties go to the smaller row_id, of scores rounded to nine places.
    """
    spark = queries.sparkSession
    asked = queries.select("query_id", "vec").where("vec is not null")
    blocks = max(1, -(-asked.count() // block))
    number = F.pmod(F.xxhash64("query_id"), F.lit(blocks))
    rows = vectors.select("row_id", "vec")
    schema = f"query_id {queries.schema['query_id'].dataType.simpleString()}, row_id {vectors.schema['row_id'].dataType.simpleString()}, score double"
    found = []
    for i in range(blocks):
        part = asked.where(number == i).toArrow().combine_chunks()
        ids, vecs = (c.chunk(0) if c.num_chunks else pa.array([], c.type) for c in (part.column("query_id"), part.column("vec")))
        kinds = ids.type, to_arrow_type(vectors.schema["row_id"].dataType)
        found.append(rows.mapInArrow(_nearest_in_batches(spark.sparkContext.broadcast((ids, _matrix(vecs))), k, kinds), schema))
    return top_by(reduce(DataFrame.unionByName, found), k, ["query_id"], F.desc("score"), F.asc("row_id"))


def rrf(arms: dict[str, tuple[DataFrame, float]], k: int = RRF_K) -> DataFrame:
    """(query_id, row_id, score, arms, first_arm, arm_rank) from ranked lists (query_id, row_id, rank) by arm, with weights.

    Lists are stacked and summed in one aggregation rather than joined. first_arm and arm_rank order ties: the first
    list that holds a row, in the order of arms, and its rank there.
    """
    stacked = [df.select("query_id", "row_id", F.lit(i).alias("arm_no"), "rank") for i, (df, _) in enumerate(arms.values())]
    return fused(reduce(DataFrame.unionByName, stacked), list(arms), [w for _, w in arms.values()], k)


def fused(stacked: DataFrame, names: Sequence[str], weights: Sequence[float], k: int = RRF_K) -> DataFrame:
    """The same from one table (query_id, row_id, arm_no, rank), arm_no being a place in names and weights."""
    of = lambda values: F.get(F.array(*(F.lit(v) for v in values)), F.col("arm_no"))
    rows = stacked.select("query_id", "row_id", "arm_no", "rank", of(names).alias("arm"), (of(float(w) for w in weights) / (k + F.col("rank"))).alias("part"))
    found = rows.groupBy("query_id", "row_id").agg(F.round(F.sum("part"), 9).alias("score"), F.array_join(F.sort_array(F.collect_set("arm")), "+").alias("arms"), F.min(F.struct("arm_no", "rank")).alias("first"))
    return found.select("query_id", "row_id", "score", "arms", F.col("first.arm_no").alias("first_arm"), F.col("first.rank").alias("arm_rank"))


def boosted(score: Column, verified: Column, superseded: Column) -> Column:
    """Ties lean to documents with verified claims; superseded ones fall back."""
    up = F.when(F.coalesce(verified, F.lit(0)) > 0, VERIFIED_BOOST).otherwise(1.0)
    down = F.when(F.coalesce(superseded, F.lit(False)), SUPERSEDED_PENALTY).otherwise(1.0)
    return score * up * down


def cap_per_doc(hits: DataFrame, k: int, most: int = MOST_PER_DOC) -> DataFrame:
    """The first k hits of each query, at most so many of one document, in score order (query_id, doc_id, score, first_arm, arm_rank)."""
    order = (F.desc(F.round("score", 9)), F.asc("first_arm"), F.asc("arm_rank"), F.asc("row_id"))
    return top_by(top_by(hits, most, ["query_id", "doc_id"], *order, rank="in_doc"), k, ["query_id"], *order)


def within_budget(rows: DataFrame, partition: list[str], order: Column, text: str, budget: int) -> DataFrame:
    """Rows while the texts before them leave room, the last one cut to what is left."""
    before = F.coalesce(F.sum(F.length(text)).over(W.partitionBy(*partition).orderBy(order).rowsBetween(W.unboundedPreceding, -1)), F.lit(0))
    room = rows.withColumn("before", before).where(F.col("before") < budget)
    return room.withColumn(text, F.expr(f"left({text}, int({budget} - before))")).drop("before")


def outline_runs(rows: DataFrame, partition: list[str], order: str, value: str) -> DataFrame:
    """(partition, value, first, last, n): runs of rows with one value, in order."""
    w = W.partitionBy(*partition).orderBy(order)
    new = F.when(F.lag(value).over(w).eqNullSafe(F.col(value)), 0).otherwise(1)
    runs = rows.withColumn("new", new).withColumn("run", F.sum("new").over(w))
    return runs.groupBy(*partition, "run", value).agg(F.min(order).alias("first"), F.max(order).alias("last"), F.count("*").alias("n")).drop("run")


def neighbours(rows: DataFrame, wanted: DataFrame, keys: list[str], index: str, reach: int = 1) -> DataFrame:
    """Rows whose index is within reach of a wanted row's, by an equi-join on the indexes there can be."""
    near = wanted.select(*keys, F.explode(F.sequence(F.col(index) - reach, F.col(index) + reach)).alias(index)).distinct()
    return rows.join(near, [*keys, index], "left_semi")
