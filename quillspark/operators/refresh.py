"""Incremental refresh: what changed, and rewriting only the partitions that did."""

from __future__ import annotations

from collections.abc import Iterator, Sequence
from contextlib import contextmanager

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F


def plan(old: DataFrame, new: DataFrame, key: str, state: list[str]) -> DataFrame:
    """(key, status): added, removed, changed or unchanged; state columns are compared null-safe."""
    before = old.select(key, *(F.col(c).alias(f"old_{c}") for c in state), F.lit(True).alias("was"))
    after = new.select(key, *(F.col(c).alias(f"new_{c}") for c in state), F.lit(True).alias("is"))
    same = F.lit(True)
    for c in state:
        same = same & F.col(f"old_{c}").eqNullSafe(F.col(f"new_{c}"))
    status = F.when(F.col("was").isNull(), "added").when(F.col("is").isNull(), "removed").when(same, "unchanged").otherwise("changed")
    return before.join(after, key, "full_outer").select(key, status.alias("status"))


def document_state(body: Column, *metadata: Column) -> Column:
    """One hash of body and metadata, so that a change of either counts."""
    return F.sha2(F.concat_ws("\x1f", F.coalesce(body, F.lit("")), *(F.coalesce(m.cast("string"), F.lit("\x00")) for m in metadata)), 256)


def pending(chunks: DataFrame, embeddings: DataFrame) -> DataFrame:
    """Chunks that are embedded at some time and have no vector yet."""
    return chunks.where(~F.coalesce(F.col("generated"), F.lit(False))).join(embeddings, "chunk_id", "left_anti")


def latest(rows: DataFrame, key: str, order: Column) -> DataFrame:
    """The last write of each key."""
    return rows.withColumn("_n", F.row_number().over(W.partitionBy(key).orderBy(order.desc()))).where("_n = 1").drop("_n")


def orphans(written: DataFrame, planned: DataFrame, key: str) -> DataFrame:
    return written.select(key).join(planned.select(key), key, "left_anti")


def bucket(key: str, buckets: int) -> Column:
    return F.pmod(F.xxhash64(key), F.lit(buckets)).cast("int")


#: A setting of Spark 4.1; others ignore it.
SWEEP = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"


@contextmanager
def swept(spark: SparkSession) -> Iterator[None]:
    """Shuffle files of what is written within go as soon as it is written; else they stay until the driver collects its garbage."""
    before = spark.conf.get(SWEEP, None)
    spark.conf.set(SWEEP, "true")
    try:
        yield
    finally:
        spark.conf.unset(SWEEP) if before is None else spark.conf.set(SWEEP, before)


def write_parquet(df: DataFrame, path: str, by: str | Sequence[str] | None = None) -> None:
    """A table of an index or of work in hand, in place of what is there: packed by zstd, and without shuffle files that outlive the write."""
    writer = df.write.mode("overwrite").option("compression", "zstd")
    with swept(df.sparkSession):
        (writer.partitionBy(by) if by else writer).parquet(path)


def _folder(spark: SparkSession, path: str):
    at = spark._jvm.org.apache.hadoop.fs.Path(path)
    return at.getFileSystem(spark._jsc.hadoopConfiguration()), at


def exists(spark: SparkSession, path: str) -> bool:
    fs, at = _folder(spark, path)
    return fs.exists(at)


def delete(spark: SparkSession, path: str) -> None:
    fs, at = _folder(spark, path)
    fs.delete(at, True)


def names(spark: SparkSession, path: str) -> list[str]:
    fs, at = _folder(spark, path)
    return [s.getPath().getName() for s in fs.listStatus(at)]


def read_text(spark: SparkSession, path: str) -> str:
    """A small file, as the driver reads it."""
    fs, at = _folder(spark, path)
    stream = fs.open(at)
    try:
        return bytes(stream.readAllBytes()).decode()
    finally:
        stream.close()


def write_text(spark: SparkSession, path: str, text: str) -> None:
    """A small file that is there whole or not at all; one of that name must not be there yet."""
    fs, at = _folder(spark, path)
    if fs.exists(at):
        raise FileExistsError(path)
    _, aside = _folder(spark, f"{path}.new")
    stream = fs.create(aside, True)
    stream.write(bytearray(text.encode()))
    stream.close()
    if not fs.rename(aside, at):
        raise FileExistsError(path)


def folders(spark: SparkSession, path: str) -> list[str]:
    fs, at = _folder(spark, path)
    return [s.getPath().getName() for s in fs.listStatus(at) if s.isDirectory()]


def upsert(rows: DataFrame, removed: DataFrame | None, path: str, key: str, buckets: int = 64) -> None:
    """Replace rows by key, and delete removed keys, in a Parquet table by bucket; untouched buckets are not written.

    What a bucket is to hold is staged whole before it takes the place of the old rows. Buckets of which nothing is left
    go first: a run that is cut short leaves old rows of changed keys, which the next one replaces, but no removed ones
    that it would miss.
    """
    spark = rows.sparkSession
    gone = rows.select(key) if removed is None else rows.select(key).unionByName(removed.select(key))
    touched = gone.select(bucket(key, buckets).alias("bucket")).distinct()
    new = rows.withColumn("bucket", bucket(key, buckets))
    if exists(spark, path):
        kept = spark.read.parquet(path).join(touched, "bucket", "left_semi").join(gone.distinct(), key, "left_anti")
        new = new.unionByName(kept.select(*new.columns))
    staged = f"{path.rstrip('/')}__staged"
    new.repartition("bucket").write.mode("overwrite").partitionBy("bucket").parquet(staged)
    whole = spark.read.schema(new.schema).parquet(staged)
    for r in touched.join(whole.select("bucket").distinct(), "bucket", "left_anti").collect():  # as many as buckets at most
        delete(spark, f"{path.rstrip('/')}/bucket={r['bucket']}")
    whole.write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy("bucket").parquet(path)
    if not any(name.startswith("bucket=") for name in folders(spark, path)):  # an empty table keeps its columns
        whole.drop("bucket").limit(0).write.mode("overwrite").parquet(f"{path.rstrip('/')}/bucket=-1")
    delete(spark, staged)


def read_meta(spark: SparkSession, path: str) -> dict[str, str]:
    """Settings of an index, a few rows of key and value; empty if there are none yet."""
    if not exists(spark, path):
        return {}
    return {r["key"]: r["value"] for r in spark.read.schema("key string, value string").parquet(path).collect()}


def write_meta(spark: SparkSession, path: str, values: dict[str, str]) -> None:
    """Set some settings and keep the others; the last write of a key wins."""
    merged = read_meta(spark, path) | values  # read whole before it is written over
    spark.createDataFrame(sorted(merged.items()), "key string, value string").coalesce(1).write.mode("overwrite").parquet(path)


def is_stale(meta: dict[str, str], stamp: str, version: str) -> bool:
    """Whether an index was made from another catalog, or by another version of the chunker."""
    return meta.get("catalog_stamp") != stamp or meta.get("chunk_version") != version


def drop_set(table: DataFrame, source_set: str) -> DataFrame:
    """A table without one source set; tables partitioned by it lose just that folder when they are rewritten."""
    return table.where(~F.col("source_set").eqNullSafe(F.lit(source_set)))
