"""Many small texts in few files: containers of bytes, and a table of where each text lies in them."""

from __future__ import annotations

import uuid
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .heads import opened

#: Bytes of a container, about; a longer text has one of its own.
CONTAINER = 128 << 20
OFFSETS = "dest string, container string, start long, length long"


def write_packed(texts: DataFrame, root: str, container: int = CONTAINER) -> None:
    """Write (dest, text) below root: containers of texts one after the other, and the table offsets of (dest, container, start, length).

    A task fills containers in turn, so there are as many open files as tasks, whatever the number of texts. The table
    is written after them and names what counts: a task that ran twice leaves a container that nothing names. A null
    text is empty.
    """

    def write(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        system, base = opened(root)
        system.create_dir(f"{base}/containers", recursive=True)
        name, out, at = "", None, 0
        try:
            for batch in batches:
                rows: list[tuple[str | None, str, int, int]] = []
                for dest, text in zip(batch.column("dest").to_pylist(), batch.column("text").to_pylist()):
                    raw = (text or "").encode()
                    if out is None or at and at + len(raw) > container:
                        if out is not None:
                            out.close()
                        name, at = f"{uuid.uuid4().hex}.bin", 0
                        out = system.open_output_stream(f"{base}/containers/{name}")
                    out.write(raw)
                    rows.append((dest, name, at, len(raw)))
                    at += len(raw)
                kinds = (pa.string(), pa.string(), pa.int64(), pa.int64())
                yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*rows) if rows else ((),) * 4, kinds)], names=["dest", "container", "start", "length"])
        finally:
            if out is not None:
                out.close()

    texts.select("dest", F.col("text").cast("string").alias("text")).mapInArrow(write, OFFSETS).write.mode("overwrite").parquet(f"{root.rstrip('/')}/offsets")


def offsets(spark: SparkSession, root: str) -> DataFrame:
    """(dest, container, start, length) of all texts; what is there is known from this table alone."""
    return spark.read.schema(OFFSETS).parquet(f"{root.rstrip('/')}/offsets")


def read_packed(spark: SparkSession, root: str, wanted: DataFrame | None = None) -> DataFrame:
    """(dest, text) of all texts, or of wanted (dest): only their ranges are read, in the order in which they lie."""

    def read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        system, base = opened(root)
        name, held = "", None
        try:
            for batch in batches:
                texts = []
                for container, start, length in zip(*(batch.column(c).to_pylist() for c in ("container", "start", "length"))):
                    if container != name:
                        if held is not None:
                            held.close()
                        name, held = container, system.open_input_file(f"{base}/containers/{container}")
                    texts.append(held.read_at(length, start).decode("utf-8", "replace"))
                yield pa.RecordBatch.from_arrays([batch.column("dest"), pa.array(texts, pa.string())], names=["dest", "text"])
        finally:
            if held is not None:
                held.close()

    found = offsets(spark, root)
    if wanted is not None:
        found = found.join(wanted.select("dest").distinct(), "dest", "left_semi").repartition("container").sortWithinPartitions("container", "start")
    return found.mapInArrow(read, "dest string, text string")
