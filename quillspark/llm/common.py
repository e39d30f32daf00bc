"""What several operators share: saved tables, bounded slices of texts, word hashes, components."""

from __future__ import annotations

import contextlib
import ctypes
import tempfile
import uuid
from collections.abc import Callable, Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: White space of ASCII, as a class of a regular expression.
SPACES = r"[\x20\x09-\x0D]"
ASCII_UPPER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ"
_own_dir: str | None = None


def shared_dir(spark: SparkSession) -> str:
    """The folder of spark.checkpoint.dir; where that is unset the warehouse, or a temporary one on a single machine, as in tests."""
    global _own_dir
    configured = spark.conf.get("spark.checkpoint.dir", None)
    if configured:
        return configured.rstrip("/")
    if not spark.sparkContext.master.startswith("local"):
        return spark.conf.get("spark.sql.warehouse.dir").rstrip("/")
    if _own_dir is None:
        _own_dir = tempfile.mkdtemp(prefix="spark-")
    return _own_dir


def saved(df: DataFrame, name: str, compression: str = "snappy") -> DataFrame:
    """Write df as Parquet to the shared folder and read it back, which cuts its lineage."""
    spark = df.sparkSession
    path = f"{shared_dir(spark)}/{spark.sparkContext.applicationId}/{name}-{uuid.uuid4().hex}"
    df.write.option("compression", compression).parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def broadcast_if_small(df: DataFrame, most: int = 1_000_000) -> DataFrame:
    """df, a saved table of a few numbers a row, marked for broadcast if it has no more than most rows; else joined in a shuffle."""
    return F.broadcast(df) if df.count() <= most else df.hint("merge")


def words_between(text: Column, gaps: str) -> Column:
    """The words of a text between runs of the characters of a class. Splitting is several times faster than extracting."""
    return F.array_remove(F.split(F.coalesce(text.cast("string"), F.lit("")), f"{gaps}+"), "")


def let(value: Column, use: Callable[[Column], Column]) -> Column:
    """use(value) with value computed once, wherever it stands in use."""
    return F.get(F.transform(F.array(value), use), F.lit(0))


def release() -> None:
    """Give freed memory back to the system: Spark keeps Python workers, and what they hold, for later stages."""
    pa.default_memory_pool().release_unused()
    with contextlib.suppress(AttributeError, OSError):  # other C libraries trim by themselves
        ctypes.CDLL(None).malloc_trim(0)


_held: dict[str, object] = {}


def held(name: str, make: Callable[[], object]) -> object:
    """One large object that a Python worker keeps for its next tasks; asking for another one drops it."""
    if name not in _held:
        _held.clear()
        release()
        _held[name] = make()
    return _held[name]


def text_slices(batches: Iterator[pa.RecordBatch], column: str, max_bytes: int = 2 << 20) -> Iterator[pa.RecordBatch]:
    """Cut batches so that a slice holds max_bytes of the column, or one row that is longer."""
    for batch in batches:
        sizes = pc.fill_null(pc.binary_length(batch.column(column)), 0).to_numpy(zero_copy_only=False)
        ends = np.cumsum(sizes)
        start = 0
        while start < len(sizes):
            limit = (ends[start - 1] if start else 0) + max_bytes
            stop = max(start + 1, int(np.searchsorted(ends, limit, side="right")))
            yield batch.take(pa.array(np.arange(start, stop)))  # a copy: some kernels go wrong on views with an offset
            start = stop
        release()


def split_words(texts: pa.Array) -> tuple[pa.Array, np.ndarray]:
    """Words between ASCII white space, flat, and each text's bounds in them (one more than texts). Null: none."""
    lists = pc.ascii_split_whitespace(pc.fill_null(texts.cast(pa.large_string()), ""))
    flat, parent = pc.list_flatten(lists), pc.list_parent_indices(lists)
    keep = pc.greater(pc.binary_length(flat), 0)
    flat, parent = flat.filter(keep), parent.filter(keep).to_numpy()
    bounds = np.zeros(len(texts) + 1, dtype=np.int64)
    np.cumsum(np.bincount(parent, minlength=len(texts)), out=bounds[1:])
    return flat, bounds


def hash_words(words: pa.Array) -> np.ndarray:
    """A 64-bit hash of each word, computed once for each distinct word."""
    if not len(words):
        return np.empty(0, dtype=np.uint64)
    coded = words.dictionary_encode()
    values = coded.dictionary.to_numpy(zero_copy_only=False).astype(object)
    return pd.util.hash_array(values, categorize=False)[coded.indices.to_numpy()]


def mix64(x: np.ndarray, salt: int = 0) -> np.ndarray:
    """A permutation of 64-bit numbers (the public MurmurHash3 finalizer); salt picks another one."""
    x = x ^ np.uint64(salt)
    x = (x ^ (x >> np.uint64(33))) * np.uint64(0xFF51AFD7ED558CCD)
    x = (x ^ (x >> np.uint64(33))) * np.uint64(0xC4CEB9FE1A85EC53)
    return x ^ (x >> np.uint64(33))


def components(links: DataFrame) -> DataFrame:
    """Connected components of links (a long, b long): node, component (its smallest node).

    Labels go to neighbours and then to the label of the label, so chains shorten by half in each round;
    the loop ends when no label changes. Only a count comes to the driver.
    """
    both = links.select(F.col("a").alias("node"), F.col("b").alias("near")).union(links.select("b", "a"))
    edges = saved(both.where("node <> near").distinct(), "edges")
    labels = edges.groupBy("node").agg(F.min("near").alias("near")).select("node", F.least("node", "near").alias("component"))
    labels = saved(labels, "labels")
    while True:
        heard = (
            edges.join(labels.withColumnRenamed("node", "near"), "near")
            .groupBy("node")
            .agg(F.min("component").alias("heard"))
        )
        lower = labels.join(heard, "node").select("node", "component", F.least("component", "heard").alias("low"))
        beyond = labels.select(F.col("node").alias("low"), F.col("component").alias("jump"))
        moved = lower.join(beyond, "low", "left").select(
            "node", F.least("low", "jump").alias("component"), (F.least("low", "jump") < F.col("component")).alias("moved")
        )
        moved = saved(moved, "labels")
        labels = moved.select("node", "component")
        if moved.where("moved").isEmpty():
            return labels
