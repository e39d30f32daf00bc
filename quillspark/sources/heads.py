"""A data source of the first bytes of files: each is opened for its range alone, whatever its length."""

from __future__ import annotations

import fnmatch
from collections.abc import Iterable, Iterator
from itertools import islice

import pyarrow as pa
import pyarrow.fs as pafs
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.datasource import DataSource, DataSourceReader, InputPartition

#: Files of a partition.
FILES = 2000
SCHEMA = "path string, size long, mtime long, head string"
#: Levels of folders that are dealt over tasks to be listed; what lies deeper is listed where its folder is read.
LEVELS = 3


def opened(root: str) -> tuple[pafs.FileSystem, str]:
    """The file system of a path or URI, and the path in it. ValueError for one that only the cluster's own readers know."""
    if "://" not in root and not root.startswith("file:"):
        return pafs.LocalFileSystem(), root.rstrip("/")
    try:
        system, path = pafs.FileSystem.from_uri(f"file://{root[5:]}" if root.startswith("file:") and not root.startswith("file://") else root)
    except (pa.ArrowInvalid, OSError) as why:
        raise ValueError(str(why)) from why
    return system, path.rstrip("/")


def listed(system: pafs.FileSystem, folder: str, glob: str, deep: bool) -> Iterator[tuple[str, int, int, bool]]:
    """(path, size, mtime, whether a folder) of files in a folder whose names match, below it too if deep, else of its folders."""
    for f in system.get_file_info(pafs.FileSelector(folder, recursive=deep)):
        is_folder = f.type == pafs.FileType.Directory
        if is_folder and not deep or f.type == pafs.FileType.File and fnmatch.fnmatchcase(f.base_name, glob):
            yield f.path, 0 if is_folder else f.size, 0 if is_folder else f.mtime_ns // 10**9, is_folder


class Files(InputPartition):
    """Some files of one folder tree: (path, size, mtime) each."""

    def __init__(self, files: list[tuple[str, int, int]]):
        self.files = files


class HeadReader(DataSourceReader):
    def __init__(self, options: dict[str, str]):
        self.root, self.glob, self.bytes = options["path"], options.get("glob", "*"), int(options.get("bytes", "8192"))
        self.files = int(options.get("files", FILES))

    def partitions(self) -> list[Files]:
        """Names, sizes and times of the files that match; their contents are not touched."""
        system, root = opened(self.root)
        found = sorted((path, size, mtime) for path, size, mtime, _ in listed(system, root, self.glob, True))
        return [Files(found[i : i + self.files]) for i in range(0, len(found), self.files)] or [Files([])]

    def read(self, partition: Files) -> Iterator[pa.RecordBatch]:
        yield from read_heads(self.root, partition.files, self.bytes, True)


def read_heads(at: str, files: Iterable[tuple[str, int, int]], most: int, gone: bool = False) -> Iterator[pa.RecordBatch]:
    """Rows of files. One that can't be read ends the job, and so does one that is gone since it was listed; with gone such a file is a row without size and time."""
    system, root = opened(at)
    rows: list[tuple[str, int | None, int | None, str]] = []
    for path, size, mtime in files:
        try:
            with system.open_input_file(path) as f:
                head = f.read_at(min(most, size), 0)
        except FileNotFoundError:
            if not gone:
                raise
            size, mtime, head = None, None, b""
        rows.append((path[len(root) + 1 :], size, mtime, head.decode("utf-8", "replace")))
        if len(rows) == 500:
            yield _batch(rows)
            rows = []
    yield _batch(rows)


def _batch(rows: list[tuple[str, int | None, int | None, str]]) -> pa.RecordBatch:
    kinds = (pa.string(), pa.int64(), pa.int64(), pa.string())
    columns = zip(*rows) if rows else ((), (), (), ())
    return pa.RecordBatch.from_arrays([pa.array(list(c), k) for c, k in zip(columns, kinds)], names=["path", "size", "mtime", "head"])


class HeadSource(DataSource):
    """path, size, mtime and the first bytes as text of the files below option path; options glob, bytes, files (of a partition).

    A file that is gone since it was listed has neither size nor time; one that can't be read ends the job.
    """

    @classmethod
    def name(cls) -> str:
        return "file_heads"

    def schema(self) -> str:
        return SCHEMA

    def reader(self, schema) -> HeadReader:  # noqa: ANN001
        return HeadReader(self.options)


def register(spark: SparkSession) -> None:
    spark.dataSource.register(HeadSource)


def scan(spark: SparkSession, root: str, glob: str, most: int) -> DataFrame:
    """The rows of the data source for trees of many files: folders are opened in tasks, level by level, and what they hold is dealt over tasks by name, so the driver holds no list."""
    tasks = int(spark.conf.get("spark.sql.shuffle.partitions"))
    _, base = opened(root)
    columns = ("path", "size", "mtime", "folder")

    def each(batches: Iterator[pa.RecordBatch], deep: bool) -> Iterator[tuple[str, int, int, bool]]:
        system, _ = opened(root)
        for batch in batches:
            for path, size, mtime, folder in zip(*(batch.column(c).to_pylist() for c in columns)):
                if folder:
                    yield from listed(system, path, glob, deep)
                else:
                    yield path, size, mtime, False

    def level(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        found = each(batches, False)
        while rows := list(islice(found, 10_000)):
            yield pa.RecordBatch.from_arrays([pa.array(list(c), k) for c, k in zip(zip(*rows), (pa.string(), pa.int64(), pa.int64(), pa.bool_()))], names=list(columns))

    def read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        return read_heads(root, (row[:3] for row in each(batches, True)), most)

    kinds = "path string, size long, mtime long, folder boolean"
    found = spark.createDataFrame([(base, 0, 0, True)], kinds)
    for _ in range(LEVELS):
        found = found.mapInArrow(level, kinds).repartition(tasks, "path")
    return found.mapInArrow(read, SCHEMA)


def write_files(files: DataFrame, root: str) -> int:
    """Write (path, content) of files (path string, content binary) below root, one file each, and return how many; a task that runs again writes the same."""

    def write(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        system, base = opened(root)
        there: set[str] = set()
        for batch in batches:
            for path, content in zip(batch.column("path").to_pylist(), batch.column("content").to_pylist()):
                at = f"{base}/{path}"
                if (folder := at.rsplit("/", 1)[0]) not in there:
                    system.create_dir(folder, recursive=True)
                    there = there if len(there) < 100_000 else set()
                    there.add(folder)
                with system.open_output_stream(at) as f:
                    f.write(content or b"")
            yield pa.RecordBatch.from_pydict({"n": [len(batch)]})

    return files.select("path", F.col("content").cast("binary").alias("content")).mapInArrow(write, "n long").agg(F.sum("n")).first()[0] or 0
