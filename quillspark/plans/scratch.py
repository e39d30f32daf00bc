"""A folder that all executors share, for tables that a query writes."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession

from ..operators import refresh

_own: list[str] = []


def scratch(spark: SparkSession, name: str) -> str:
    """A new folder below spark.checkpoint.dir; where that is unset, the warehouse, or on one machine a temporary folder."""
    base = spark.conf.get("spark.checkpoint.dir", None)
    if not base and not spark.sparkContext.master.startswith("local"):
        base = spark.conf.get("spark.sql.warehouse.dir")
    if not base:
        if not _own:
            _own.append(tempfile.mkdtemp(prefix="spark-"))
        base = _own[0]
    return f"{base.rstrip('/')}/{spark.sparkContext.applicationId}/{name}-{uuid.uuid4().hex}"


def kept(df: DataFrame, name: str) -> DataFrame:
    """df written to a new folder and read again, for what is used more than once."""
    path = scratch(df.sparkSession, name)
    refresh.write_parquet(df, path)
    return df.sparkSession.read.schema(df.schema).parquet(path)
