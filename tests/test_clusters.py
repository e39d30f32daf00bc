"""Cosine top-k from clusters: the rows of scoring all, with filters, ties and zero vectors, and clusters left unread."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from quillspark.operators import clusters, ranking


@pytest.fixture(scope="module")
def vectors(spark):
    rng = np.random.default_rng(6)
    centres = rng.standard_normal((12, 16))
    v = centres[rng.integers(0, 12, 900)] + 0.15 * rng.standard_normal((900, 16))
    v[10:20] = v[3]
    v[20:23] = 0
    rows = [(f"r{i}", x.astype(np.float32).tolist(), i % 5) for i, x in enumerate(v)] + [("none", None, 1)]
    return spark.createDataFrame(rows, "row_id string, vec array<float>, kind int").repartition(4)


@pytest.fixture(scope="module")
def stored(vectors, tmp_path_factory):
    path = str(tmp_path_factory.mktemp("clusters"))
    clusters.write_clusters(vectors, path, 12)
    return path


def rows(df):
    return sorted((r["query_id"], r["rank"], r["row_id"], r["score"]) for r in df.collect())


@pytest.mark.parametrize("k,where,size", [(5, None, 2000), (60, "kind = 2", 7), (400, "kind = 1", 2000)])
def test_same_rows(spark, vectors, stored, monkeypatch, k, where, size):
    monkeypatch.setattr(clusters, "QUERIES", size)
    asked = vectors.where("try_cast(substring(row_id, 2) as int) % 40 = 0 or row_id in ('r3', 'r21', 'none')").select(F.col("row_id").alias("query_id"), "vec")
    hits, read = clusters.top_k(spark, stored, asked, k, F.expr(where) if where else None)
    assert rows(hits) == rows(ranking.cosine(asked, vectors.where(where) if where else vectors, k))
    share = read.where("query_id <> 'r21'").agg(F.avg(F.col("n_read") / F.col("n_clusters"))).first()[0]
    assert share < 0.5 if k == 5 else share <= 1


def test_only_folders_of_near_clusters_are_read(spark, vectors, stored):
    hits, _ = clusters.top_k(spark, stored, vectors.where("row_id = 'r40'").select(F.col("row_id").alias("query_id"), "vec"), 3)
    assert "PartitionFilters: [isnotnull(cluster" in hits._jdf.queryExecution().toString() or "PartitionFilters: [cluster" in hits._jdf.queryExecution().toString()
    assert rows(hits)[0][2] == "r40"


def test_nothing_stored(spark, vectors, tmp_path):
    clusters.write_clusters(vectors.where("row_id = 'none'"), str(tmp_path))
    hits, read = clusters.top_k(spark, str(tmp_path), vectors.limit(2).select(F.col("row_id").alias("query_id"), "vec"), 3)
    assert hits.count() == 0 and read.count() == 0
