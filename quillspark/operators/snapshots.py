"""Tables that are replaced by key and seen as a whole: immutable segments, rows that are gone, and one manifest that names them."""

from __future__ import annotations

import copy
import json
import uuid
from collections.abc import Callable, Mapping, Sequence
from dataclasses import dataclass, field

from pyspark.sql import DataFrame, Observation, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

from . import refresh

#: Segments of one size class that are merged, keys that are sent to every task, and manifests whose files are kept for readers.
FANOUT, MOST_SENT, KEPT = 4, 200_000, 3


@dataclass(frozen=True)
class Spec:
    """key: the column by which rows are replaced; bucket: the one whose hash is the folder; sort: order in a file.

    owner: the key as an expression over a row, where it is no column. follows: a table whose replaced keys count for
    this one too. sums: expressions that are summed over living rows, kept current by what comes and goes.
    """

    key: str
    bucket: str
    sort: tuple[str, ...] = ()
    owner: str | None = None
    follows: str | None = None
    sums: Mapping[str, str] = field(default_factory=dict)


def tier(rows: int) -> int:
    """The size class of a segment: a factor of FANOUT each."""
    return max(rows, 1).bit_length() // 2


def crowded(sizes: Sequence[int], fanout: int = FANOUT) -> list[int]:
    """Places of the smallest segments of one size class, if there are fanout or more of them; they are merged into one of the next."""
    by_tier: dict[int, list[int]] = {}
    for i, n in enumerate(sizes):
        by_tier.setdefault(tier(n), []).append(i)
    return next((by_tier[t] for t in sorted(by_tier) if len(by_tier[t]) >= fanout), [])


class Tables:
    """Some tables below one folder. Readers open the newest manifest and see what it names, all of it or nothing.

    A manifest is a small JSON file; a change writes its segments beside those in use and then one manifest, by a
    rename. Whatever stops it before that leaves the former state. There is one writer at a time: a second one that
    started from the same state finds the name of its manifest taken, and fails.
    """

    def __init__(self, spark: SparkSession, root: str, specs: Mapping[str, Spec], buckets: int = 64):
        self.spark, self.root, self.specs, self.buckets = spark, root.rstrip("/"), specs, buckets

    def _versions(self) -> list[int]:
        at = f"{self.root}/manifests"
        names = refresh.names(self.spark, at) if refresh.exists(self.spark, at) else []
        return sorted(int(n[:-5]) for n in names if n.endswith(".json"))

    def _load(self, version: int) -> dict:
        return json.loads(refresh.read_text(self.spark, f"{self.root}/manifests/{version:012d}.json"))

    def manifest(self) -> dict:
        """version, meta (text by name) and tables: schema, segments, deleted, sums of each."""
        versions = self._versions()
        return self._load(versions[-1]) if versions else {"version": 0, "meta": {}, "tables": {}}

    def exists(self, table: str, state: dict | None = None) -> bool:
        return table in (state or self.manifest())["tables"]

    def sums(self, table: str, state: dict | None = None) -> dict[str, int]:
        """Of living rows: rows, and what the table's spec sums."""
        names = ["rows", *self.specs[table].sums]
        return {n: 0 for n in names} | (state or self.manifest())["tables"].get(table, {}).get("sums", {})

    def _read(self, table: str, entries: list[dict], schema: StructType, base: str) -> DataFrame:
        if not entries:
            return self.spark.createDataFrame([], schema).withColumn("bucket", F.lit(0))
        return self.spark.read.schema(schema).option("basePath", f"{self.root}/{base}").parquet(*(f"{self.root}/{e['path']}" for e in entries)).drop("s")

    def live(self, table: str, state: dict | None = None, segments: list[dict] | None = None, narrow: Callable[[DataFrame], DataFrame] = lambda rows: rows) -> DataFrame:
        """Living rows, with the columns segment and bucket: those whose key was not replaced after their segment.

        Few keys that are gone are sent to every task; many meet, in a shuffle, only segments older than the newest of them.
        narrow leaves rows out where they are read, before any of them moves; what it returns may have the key as key_ and lie by it.
        """
        state = state or self.manifest()
        spec, held = self.specs[table], state["tables"][table]
        segments = held["segments"] if segments is None else segments
        schema = StructType.fromJson(held["schema"])
        deleted = state["tables"][spec.follows or table]["deleted"]
        newest = max((d["at"] for d in deleted), default=0)
        old = [s for s in segments if s["at"] < newest]
        if not old:
            return narrow(self._read(table, segments, schema, table)).drop("key_")
        deleted = [d for d in deleted if d["at"] > min(s["at"] for s in old)]
        gone = self._gone(spec.follows or table, deleted).groupBy("key").agg(F.max("at").alias("gone_at")).withColumnRenamed("key", "key_")

        def left(rows: DataFrame, gone: DataFrame) -> DataFrame:
            rows = rows if "key_" in rows.columns else rows.withColumn("key_", F.expr(spec.owner or f"`{spec.key}`").cast("string"))
            return rows.join(gone, "key_", "left").where("gone_at is null or gone_at <= segment").drop("key_", "gone_at")

        if sum(d["rows"] for d in deleted) <= MOST_SENT:  # one scan, and no row moves
            return left(narrow(self._read(table, segments, schema, table)), F.broadcast(gone))
        fresh = [s for s in segments if s["at"] >= newest]
        own = left(narrow(self._read(table, old, schema, table)), gone.hint("shuffle_hash"))  # keys are few beside the rows, which needn't be sorted
        return narrow(self._read(table, fresh, schema, table)).drop("key_").unionByName(own) if fresh else own

    def _gone(self, table: str, entries: list[dict]) -> DataFrame:
        return self._read(table, entries, StructType.fromDDL("key string, at long"), f"{table}_deleted").select("key", "at")

    def begin(self) -> Change:
        return Change(self)

    def vacuum(self, keep: int = KEPT) -> None:
        """Delete what only manifests before the last keep of them name; their readers should be done."""
        versions = self._versions()
        named = {e["path"] for v in versions[-keep:] for t in self._load(v)["tables"].values() for e in [*t["segments"], *t["deleted"]]}
        for v in versions[:-keep]:
            refresh.delete(self.spark, f"{self.root}/manifests/{v:012d}.json")
        for table in (x for t in self.specs for x in (t, f"{t}_deleted")):
            if refresh.exists(self.spark, f"{self.root}/{table}"):
                for name in refresh.folders(self.spark, f"{self.root}/{table}"):
                    if f"{table}/{name}" not in named:
                        refresh.delete(self.spark, f"{self.root}/{table}/{name}")


class Change:
    """A new state in the making; nothing of it is seen before publish."""

    def __init__(self, tables: Tables):
        self.tables, self.spark = tables, tables.spark
        self.state = copy.deepcopy(tables.manifest())
        self.version = self.state["version"] = self.state["version"] + 1

    def _write(self, df: DataFrame, folder: str, key: str, sort: Sequence[str], sums: Mapping[str, str], without: Sequence[str] = (), dealt: bool = False) -> dict | None:
        """Rows by a hash of key, in files no larger than a partition is to be: Spark splits a large bucket among tasks and puts small ones together.

        Columns of without are summed and not written. With dealt each task writes its own rows of every bucket, and nothing is shuffled.
        """
        path = f"{folder}/s={self.version}-{uuid.uuid4().hex[:8]}"
        seen = Observation()
        rows = df.withColumn("bucket", refresh.bucket(key, self.tables.buckets))
        rows = rows if dealt else rows.hint("rebalance", F.col("bucket"))
        rows = rows.sortWithinPartitions("bucket", *sort).observe(seen, F.count(F.lit(1)).alias("rows"), *(F.sum(F.expr(e)).alias(n) for n, e in sums.items()))
        refresh.write_parquet(rows.drop(*without), f"{self.tables.root}/{path}", "bucket")
        counted = {"rows": 0} | {n: v or 0 for n, v in seen.get.items()}
        return {"path": path, "at": self.version, **counted} if counted["rows"] else None

    def live(self, table: str) -> DataFrame:
        return self.tables.live(table, self.state)

    def exists(self, table: str) -> bool:
        return self.tables.exists(table, self.state)

    def _held(self, table: str) -> dict:
        return self.state["tables"].setdefault(table, {"schema": StructType([]).jsonValue(), "segments": [], "deleted": [], "sums": {}})

    def _count(self, table: str, sign: int, counted: Mapping[str, int]) -> None:
        sums = self._held(table)["sums"]
        for name in ("rows", *self.tables.specs[table].sums):
            sums[name] = sums.get(name, 0) + sign * int(counted.get(name) or 0)

    def added(self, table: str) -> DataFrame:
        """What this change has added to a table, as it was written."""
        return self.tables.live(table, self.state, [s for s in self._held(table)["segments"] if s["at"] == self.version])

    def add(self, table: str, rows: DataFrame, dealt: bool = False) -> int:
        """Add rows as one segment, and return how many; delete their keys first if they stand for older rows. dealt: they lie in tasks that write a file for each bucket."""
        spec, held = self.tables.specs[table], self._held(table)
        rows = rows.withColumn("segment", F.lit(self.version).cast("long"))
        known = {f["name"] for f in held["schema"]["fields"]}
        held["schema"]["fields"] += [f for f in rows.drop("bucket").schema.jsonValue()["fields"] if f["name"] not in known]
        written = self._write(rows, table, spec.bucket, spec.sort, spec.sums, (), dealt)
        if written:
            held["segments"].append({k: written[k] for k in ("path", "at", "rows")})
            self._count(table, 1, written)
        return written["rows"] if written else 0

    def delete(self, table: str, keys: DataFrame) -> None:
        """Take the living rows of keys (the table's key) away, from what follows the table too; of a key without rows nothing changes."""
        if not self.exists(table) or not self._held(table)["segments"]:
            return
        spec = self.tables.specs[table]
        keys = keys.select(F.col(spec.key).cast("string").alias("key")).where("key is not null").distinct()
        own = self.live(table).withColumn("key", F.col(spec.key).cast("string")).join(keys, "key", "left_semi")
        # a key's rows are summed where it is written, so living rows are read once
        sums = {"rows_": F.count(F.lit(1)), **{n: F.sum(F.expr(e)) for n, e in spec.sums.items()}}
        gone = own.groupBy("key").agg(F.lit(self.version).cast("long").alias("at"), *(c.alias(n) for n, c in sums.items()))
        written = self._write(gone, f"{table}_deleted", "key", ("key",), {n: f"`{n}`" for n in sums}, list(sums))
        if written:
            self._held(table)["deleted"].append({k: written[k] for k in ("path", "at", "rows")})
            self._count(table, -1, written | {"rows": written["rows_"]})

    def clear(self, table: str) -> None:
        self.state["tables"].pop(table, None)

    def _merge(self, table: str, places: Sequence[int]) -> None:
        spec, held = self.tables.specs[table], self._held(table)
        own = [held["segments"][i] for i in places]
        merged = self.tables.live(table, self.state, own).drop("bucket").withColumn("segment", F.lit(self.version).cast("long"))
        written = self._write(merged, table, spec.bucket, spec.sort, {})
        held["segments"] = [s for i, s in enumerate(held["segments"]) if i not in set(places)] + ([{k: written[k] for k in ("path", "at", "rows")}] if written else [])

    def settle(self, whole: bool = False) -> None:
        """Merge segments of one size class where there are many, and all of a table, or of every one if whole, when half of its rows are gone.

        A row is so rewritten once for each size class that it rises through, and as many segments stay as there are
        classes, times FANOUT. Keys that are gone and met by no older segment any more are forgotten.
        """
        for table, held in self.state["tables"].items():
            base = self.tables.specs[table].follows or table
            gone = sum(d["rows"] for d in self._held(base)["deleted"])
            if len(held["segments"]) > 1 and whole or gone and (whole or 2 * gone >= sum(s["rows"] for s in self._held(base)["segments"])):
                self._merge(table, range(len(held["segments"])))
            while places := crowded([s["rows"] for s in held["segments"]]):
                self._merge(table, places)
        for table, held in self.state["tables"].items():
            followers = [t for t in self.state["tables"] if table in (t, self.tables.specs[t].follows)]
            oldest = min((s["at"] for t in followers for s in self._held(t)["segments"]), default=self.version)
            held["deleted"] = [d for d in held["deleted"] if d["at"] > oldest]
            while places := crowded([d["rows"] for d in held["deleted"]]):
                own = [held["deleted"][i] for i in places]
                last = self.tables._gone(table, own).groupBy("key").agg(F.max("at").alias("at"))
                written = self._write(last, f"{table}_deleted", "key", ("key",), {}) | {"at": max(d["at"] for d in own)}
                held["deleted"] = [d for i, d in enumerate(held["deleted"]) if i not in set(places)] + [written]

    def publish(self, meta: Mapping[str, str] | None = None) -> None:
        """Make this the state that readers see."""
        self.state["meta"] = self.state["meta"] | dict(meta or {})
        refresh.write_text(self.spark, f"{self.tables.root}/manifests/{self.version:012d}.json", json.dumps(self.state))
        self.tables.vacuum()
