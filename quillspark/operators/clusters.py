"""Exact cosine top-k over vectors stored by cluster: whole clusters are left out by the angle to their centre."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_type

from . import ranking
from .ranking import _matrix

#: Clusters at most, queries of a pass, vectors that choose the centres for each, and slack for rounding.
MOST, QUERIES, SAMPLED, SLACK = 4096, 2000, 16, 1e-8
#: The cluster of zero vectors, whose cosine is 0 to all.
ZERO = -1


def _centres(vectors: DataFrame, clusters: int) -> np.ndarray:
    """Unit centres: the vectors of smallest hash, moved once to the mean of the vectors of a sample that are nearest to each."""
    some = vectors.where("vec is not null").orderBy(F.xxhash64("row_id"), "row_id").limit(clusters * SAMPLED).select("vec").toArrow().combine_chunks()
    if not some.num_rows:
        return np.empty((0, 0))
    rows = _matrix(some.column("vec").chunk(0))
    rows = rows[np.abs(rows).sum(axis=1) > 0]
    centres = rows[:clusters]
    nearest = (rows @ centres.T).argmax(axis=1) if len(centres) else np.empty(0, np.int64)
    sums = np.zeros_like(centres)
    np.add.at(sums, nearest, rows)
    norms = np.linalg.norm(sums, axis=1, keepdims=True)
    return np.where(norms > 1e-9, sums / np.maximum(norms, 1e-9), centres)


def write_clusters(vectors: DataFrame, path: str, clusters: int | None = None) -> None:
    """Store vectors (row_id, vec and any others, all vectors of one length) by their nearest centre, and the centres with their reach.

    There are as many clusters as the root of the vectors, MOST at most; centres come from a sample of SAMPLED vectors
    for each, all vectors are stored. A centre's reach is its smallest cosine to a vector of its cluster. Null vectors
    are left out.
    """
    spark = vectors.sparkSession
    n = clusters or max(1, min(MOST, round(vectors.count() ** 0.5)))
    sent = spark.sparkContext.broadcast(_centres(vectors, n))

    def place(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            batch = batch.filter(pc.is_valid(batch.column("vec")))
            if not len(batch):
                continue
            scores = _matrix(batch.column("vec")) @ sent.value.T if len(sent.value) else np.zeros((len(batch), 1))
            best = scores.argmax(axis=1)
            zero = ~np.abs(_matrix(batch.column("vec"))).any(axis=1)
            yield batch.append_column("to_centre", pa.array(scores[np.arange(len(best)), best])).append_column("cluster", pa.array(np.where(zero, ZERO, best).astype(np.int32)))

    columns = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in vectors.schema)
    placed = vectors.mapInArrow(place, f"{columns}, to_centre double, cluster int")
    placed.hint("rebalance", F.col("cluster")).sortWithinPartitions("cluster").write.mode("overwrite").partitionBy("cluster").parquet(f"{path}/vectors")
    reach = spark.read.schema("to_centre double, cluster int").parquet(f"{path}/vectors").groupBy("cluster").agg(F.min("to_centre").alias("reach"), F.count("*").alias("n"))
    centres = spark.createDataFrame([(i, c.tolist()) for i, c in enumerate(sent.value)], "cluster int, centre array<double>")
    reach.join(centres, "cluster", "left").coalesce(1).write.mode("overwrite").parquet(f"{path}/centres")  # MOST rows


def _score(sent, k: int, kinds: tuple[pa.DataType, pa.DataType]):
    schema = pa.schema([("query_id", kinds[0]), ("row_id", kinds[1]), ("score", pa.float64())])

    def score(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        ids, queries, wanted, place = sent.value
        for batch in batches:
            of = batch.column("cluster").to_numpy()
            for cluster in np.unique(of).tolist():
                asking = np.flatnonzero(wanted[:, place[cluster]])
                own = np.flatnonzero(of == cluster)
                if not len(asking):
                    continue
                scores = np.round(_matrix(batch.column("vec").take(pa.array(own))) @ queries[asking].T, 9)
                least = np.partition(scores, -k, axis=0)[-k] if len(own) > k else np.full(len(asking), -np.inf)
                r, q = np.nonzero(scores >= least)
                yield pa.RecordBatch.from_arrays([ids.take(pa.array(asking[q])), batch.column("row_id").take(pa.array(own[r])), pa.array(scores[r, q])], schema=schema)

    return score


def top_k(spark: SparkSession, path: str, queries: DataFrame, k: int = ranking.CANDIDATES, where: Column | None = None) -> tuple[DataFrame, DataFrame]:
    """The k rows of largest cosine for each query, and what it took: (query_id, row_id, score, rank) and (query_id, n_clusters, n_read).

    queries: (query_id, vec), a stated set that goes to the tasks in blocks; where: a condition on stored columns. The
    rows are those of ranking.cosine over the vectors that where holds for.

    A query looks first into the clusters nearest to it that hold 2 * k vectors. No vector of a cluster is nearer to it
    than the angle to the centre less the cluster's reach, so clusters that cannot come up to the k-th best cosine found
    are not read. Where the condition leaves fewer than k there, all are. Only bounds and the k-th cosines of a block of
    queries are on the driver.
    """
    heads = spark.read.schema("cluster int, reach double, n long, centre array<double>").parquet(f"{path}/centres").orderBy("cluster").collect()  # MOST at most
    stored = spark.read.parquet(f"{path}/vectors") if heads else None
    asked = queries.select("query_id", "vec").where("vec is not null")
    blocks = max(1, -(-asked.count() // QUERIES))
    schema = f"query_id {queries.schema['query_id'].dataType.simpleString()}, row_id {stored.schema['row_id'].dataType.simpleString() if stored is not None else 'string'}, score double"
    none = spark.createDataFrame([], schema)
    found, read = none, []
    place = {h["cluster"]: i for i, h in enumerate(heads)}
    sizes = np.array([h["n"] for h in heads])
    for block in range(blocks):
        part = asked.where(F.pmod(F.xxhash64("query_id"), F.lit(blocks)) == block).toArrow().combine_chunks()
        if not part.num_rows or not heads:
            continue
        ids, rows = part.column("query_id").chunk(0), _matrix(part.column("vec").chunk(0))
        kinds = ids.type, to_arrow_type(stored.schema["row_id"].dataType)
        near = np.stack([rows @ np.array(h["centre"]) if h["centre"] else np.zeros(len(rows)) for h in heads], axis=1)
        reach = np.array([1.0 if h["cluster"] == ZERO else h["reach"] for h in heads])
        least_angle = np.maximum(0.0, np.arccos(np.clip(near, -1, 1)) - np.arccos(np.clip(reach, -1, 1)))
        bound = np.cos(least_angle)
        bound[~np.abs(rows).any(axis=1)] = 1.0  # a zero query has cosine 0 to all
        order = np.argsort(-near, axis=1, kind="stable")
        before = np.cumsum(sizes[order], axis=1) - sizes[order]
        first = np.zeros(near.shape, bool)
        np.put_along_axis(first, order, before < 2 * k, axis=1)

        def scored(wanted: np.ndarray, ids=ids, rows=rows, kinds=kinds) -> DataFrame:
            own = stored.where(F.col("cluster").isin([h["cluster"] for h, any_ in zip(heads, wanted.any(axis=0)) if any_]))
            own = own if where is None else own.where(where)
            sent = spark.sparkContext.broadcast((ids, rows, wanted, place))
            return own.select("row_id", "vec", "cluster").mapInArrow(_score(sent, k, kinds), schema)

        best = ranking.top_by(scored(first), k, ["query_id"], F.desc("score"), F.asc("row_id"))
        reached = {r["query_id"]: r["reached"] for r in best.groupBy("query_id").agg(F.when(F.count("*") == k, F.min("score")).alias("reached")).collect()}
        floor = np.array([-np.inf if (x := reached.get(q)) is None else x for q in ids.to_pylist()])
        needed = bound >= floor[:, None] - SLACK
        found = found.unionByName(scored(needed))
        read += [(q, len(heads), int(a)) for q, a in zip(ids.to_pylist(), (needed | first).sum(axis=1))]
    hits = ranking.top_by(found, k, ["query_id"], F.desc("score"), F.asc("row_id"))
    kind = queries.schema["query_id"].dataType.simpleString()
    return hits, spark.createDataFrame(read, f"query_id {kind}, n_clusters int, n_read int")
