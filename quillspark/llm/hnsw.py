"""Approximate nearest neighbours: one navigable small-world graph per shard, shard results merged."""

from __future__ import annotations

import heapq

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from .common import saved

INDEX = "shard int, d int, levels binary, keys binary, vectors binary, neighbours binary, entry int"


def usable(vector: Column) -> Column:
    """Not null, not zero, and no component null or not finite."""
    bad = F.exists(vector, lambda x: x.isNull() | F.isnan(x) | (F.abs(x) == float("inf")))
    return vector.isNotNull() & F.coalesce(~bad, F.lit(False)) & F.exists(vector, lambda x: x != 0)


class Graph:
    """Flat arrays: vectors[n, d], levels[n], neighbours[n, top + 1, 2 m] with -1 where there is none."""

    def __init__(self, vectors: np.ndarray, levels: np.ndarray, neighbours: np.ndarray, entry: int):
        self.vectors, self.levels, self.neighbours, self.entry = vectors, levels, neighbours, entry
        self.seen = np.zeros(len(vectors), dtype=np.int64)
        self.turn = 0

    def layer(self, query: np.ndarray, starts: list[tuple[float, int]], level: int, width: int) -> list[tuple[float, int]]:
        """The width nearest found in a level, best first, from starts (squared distance, node)."""
        self.turn += 1
        self.seen[[i for _, i in starts]] = self.turn
        ahead = list(starts)
        heapq.heapify(ahead)
        best = [(-d, i) for d, i in starts]
        heapq.heapify(best)
        while ahead:
            d, i = heapq.heappop(ahead)
            if len(best) >= width and d > -best[0][0]:
                break
            near = self.neighbours[i, level]
            near = near[near >= 0]
            near = near[self.seen[near] != self.turn]
            if not len(near):
                continue
            self.seen[near] = self.turn
            gap = self.vectors[near] - query
            far = np.einsum("ij,ij->i", gap, gap)
            if len(best) >= width:
                close = far < -best[0][0]
                near, far = near[close], far[close]
            for x, j in zip(far.tolist(), near.tolist()):
                if len(best) < width:
                    heapq.heappush(best, (-x, j))
                    heapq.heappush(ahead, (x, j))
                elif x < -best[0][0]:
                    heapq.heapreplace(best, (-x, j))
                    heapq.heappush(ahead, (x, j))
        return sorted((-d, i) for d, i in best)

    def descend(self, query: np.ndarray, level: int) -> list[tuple[float, int]]:
        gap = self.vectors[self.entry] - query
        at = [(float(gap @ gap), self.entry)]
        for upper in range(int(self.levels[self.entry]), level, -1):
            at = self.layer(query, at, upper, 1)
        return at

    def search(self, query: np.ndarray, k: int, width: int) -> list[int]:
        return [i for _, i in self.layer(query, self.descend(query, 0), 0, max(width, k))[:k]]

    def _spread(self, found: list[tuple[float, int]], m: int) -> list[int]:
        """Up to m nodes, nearest first, that are nearer to the origin than to one another; then the nearest others."""
        ids = np.array([i for _, i in found])
        v = self.vectors[ids]
        square = np.einsum("ij,ij->i", v, v)
        apart = square[:, None] + square[None, :] - 2 * (v @ v.T)
        chosen: list[int] = []
        for x, (d, _) in enumerate(found):
            if len(chosen) == m:
                break
            if not chosen or apart[x, chosen].min() > d:
                chosen.append(x)
        taken = set(chosen)
        chosen += [x for x in range(len(found)) if x not in taken][: m - len(chosen)]
        return ids[chosen].tolist()

    @classmethod
    def build(cls, vectors: np.ndarray, m: int, width: int, seed: int) -> Graph:
        n = len(vectors)
        levels = np.minimum((-np.log(np.random.default_rng(seed).random(n) + 1e-12) / np.log(m)).astype(np.int32), 6)
        graph = cls(vectors, levels, np.full((n, int(levels.max()) + 1, 2 * m), -1, dtype=np.int32), 0)
        counts = np.zeros(graph.neighbours.shape[:2], dtype=np.int32)
        for i in range(1, n):
            own = int(levels[i])
            top = int(levels[graph.entry])
            at = graph.descend(vectors[i], own)
            for level in range(min(own, top), -1, -1):
                at = graph.layer(vectors[i], at, level, width)
                near = graph._spread(at, m)
                graph.neighbours[i, level, : len(near)] = near
                counts[i, level] = len(near)
                room = 2 * m if level == 0 else m
                for j in near:
                    c = counts[j, level]
                    if c < room:
                        graph.neighbours[j, level, c] = i
                        counts[j, level] = c + 1
                        continue
                    old = np.append(graph.neighbours[j, level, :c], i)
                    gap = vectors[old] - vectors[j]
                    far = np.einsum("ij,ij->i", gap, gap)
                    order = np.argsort(far)
                    kept = graph._spread([(float(far[x]), int(old[x])) for x in order], room)
                    graph.neighbours[j, level, :room] = kept
            if own > top:
                graph.entry = i
        return graph


def _build(m: int, width: int):
    def build(table: pa.Table) -> pa.Table:
        keys = table.column("key").to_numpy()
        vectors = np.stack([np.frombuffer(x, np.float32) for x in table.column("vector").to_pylist()])
        shard = table.column("shard")[0].as_py()
        graph = Graph.build(vectors, m, width, shard)
        row = {"shard": shard, "d": vectors.shape[1], "levels": graph.levels.tobytes(), "keys": keys.tobytes(), "vectors": vectors.tobytes(), "neighbours": graph.neighbours.tobytes(), "entry": graph.entry}
        kinds = {"shard": pa.int32(), "d": pa.int32(), "entry": pa.int32()}
        return pa.table({k: pa.array([v], kinds.get(k, pa.binary())) for k, v in row.items()})

    return build


def _search(m: int, k: int, width: int):
    schema = pa.schema([("query_id", pa.int64()), ("key", pa.int64()), ("score", pa.float64())])

    def search(index: pa.Table, queries: pa.Table) -> pa.Table:
        rows: list[list] = [[], [], []]
        if index.num_rows and queries.num_rows:
            row = index.slice(0, 1).to_pylist()[0]
            keys, levels = np.frombuffer(row["keys"], np.int64), np.frombuffer(row["levels"], np.int32)
            vectors = np.frombuffer(row["vectors"], np.float32).reshape(len(keys), -1)
            graph = Graph(vectors, levels, np.frombuffer(row["neighbours"], np.int32).reshape(len(keys), -1, 2 * m), row["entry"])
            for query_id, raw in zip(queries.column("query_id").to_pylist(), queries.column("vector").to_pylist()):
                query = np.frombuffer(raw, np.float32)
                found = graph.search(query, k, width)
                gap = vectors[found].astype(np.float64) - query.astype(np.float64)
                rows[0] += [query_id] * len(found)
                rows[1] += keys[found].tolist()
                rows[2] += np.sqrt((gap * gap).sum(axis=1)).tolist()
        return pa.table([pa.array(c, f.type) for c, f in zip(rows, schema)], schema=schema)

    return search


def _packed(vector: Column) -> Column:
    pack = F.arrow_udf(lambda x: pa.array([np.asarray(v, np.float32).tobytes() for v in x.to_pylist()], pa.binary()), "binary")
    return pack(vector.cast("array<float>"))


def nearest(
    embeddings: DataFrame, queries: Column, k: int = 10, shard_rows: int = 4096, most_rows: int = 131_072, m: int = 16, build_width: int = 80, width: int = 160, query_block: int = 100_000
) -> DataFrame:
    """The k nearest rows found of each query row, by Euclidean distance: query_id, rank, vec_id, score.

    embeddings needs vec_id and embedding; extra columns are ignored. queries is a condition that picks the query
    rows. Rows with the query's vec_id are its own and no candidates. Order is by distance in double precision, then
    smaller vec_id; fewer rows than k give them all.

    Equal vectors are one node with its k + 1 smallest ids, so copies neither crowd the graphs nor hide each other.
    Nodes are dealt to shards by their hash: of shard_rows while there are fewer than four to a core, then of more, up to
    most_rows, since every query searches every shard; each shard's graph is built over all its nodes and
    saved as flat arrays, all queries search all shards, in blocks, and the shards' best are merged. Null, zero and
    non-finite vectors take no part, as candidate or query; vectors of another length
    have graphs of their own and are compared with none but each other. Repeated rows of one id count once. An empty table gives an empty result.
    """
    own = embeddings.select(F.col("vec_id").cast("long").alias("vec_id"), F.col("embedding").cast("array<float>").alias("embedding"), queries.alias("is_query"))
    own = own.where(usable(F.col("embedding")) & F.col("vec_id").isNotNull())
    keyed = own.select("vec_id", "is_query", F.xxhash64("embedding").alias("key"), "embedding")
    ids = keyed.select("key", "vec_id").distinct()
    ids = ids.withColumn("n", F.row_number().over(W.partitionBy("key").orderBy("vec_id"))).where(F.col("n") <= k + 1)
    ids = saved(ids.groupBy("key").agg(F.collect_list("vec_id").alias("ids")), "ids")
    nodes = keyed.groupBy("key").agg(F.first("embedding").alias("embedding")).select("key", F.size("embedding").alias("d"), _packed(F.col("embedding")).alias("vector"))
    nodes = saved(nodes, "nodes")
    count = nodes.count()
    cores = embeddings.sparkSession.sparkContext.defaultParallelism
    shards = max(1, -(-count // most_rows), min(-(-count // shard_rows), 4 * cores))
    dealt = nodes.withColumn("shard", F.pmod(F.xxhash64("key"), F.lit(shards)).cast("int"))
    index = saved(dealt.groupBy("shard", "d").applyInArrow(_build(m, build_width), INDEX), "index")
    asked = keyed.where("is_query").select(F.col("vec_id").alias("query_id"), F.size("embedding").alias("d"), _packed(F.col("embedding")).alias("vector")).distinct()
    asked = saved(asked, "queries")
    blocks = max(1, -(-asked.count() // query_block))
    asked = asked.select(F.explode(F.sequence(F.lit(0), F.lit(shards - 1))).alias("shard"), F.pmod(F.xxhash64("query_id"), F.lit(blocks)).cast("int").alias("block"), "d", "query_id", "vector")
    graphs = index.withColumn("block", F.explode(F.sequence(F.lit(0), F.lit(blocks - 1))))
    found = graphs.groupBy("shard", "d", "block").cogroup(asked.groupBy("shard", "d", "block")).applyInArrow(_search(m, k + 1, width), "query_id long, key long, score double")
    best = found.withColumn("n", F.row_number().over(W.partitionBy("query_id").orderBy("score", "key"))).where(F.col("n") <= k + 1)
    rows = best.join(ids, "key").select("query_id", "score", F.explode("ids").alias("vec_id")).where("vec_id <> query_id")
    ranked = rows.withColumn("rank", F.row_number().over(W.partitionBy("query_id").orderBy("score", "vec_id"))).where(F.col("rank") <= k)
    return ranked.select("query_id", "rank", "vec_id", "score")
