"""Tables by segments and one manifest: what readers see, what a stop leaves, how many segments and how large files there are."""

import math
import random
from collections import Counter

import pytest

from quillspark.api import Engine
from quillspark.operators import refresh, snapshots
from quillspark.operators.snapshots import Change, Spec, Tables, crowded

SPECS = {"rows": Spec("k", "k", ("k",), sums={"length": "length"}), "words": Spec("row_id", "w", ("w",), owner="substring_index(row_id, '#', 1)", follows="rows")}


def test_few_segments_after_many_changes():
    """Merged by size, a thousand changes of any size leave a logarithm of segments, and a row is rewritten as often."""
    rng = random.Random(1)
    sizes, rewritten, total = [], 0, 0
    for _ in range(1000):
        sizes.append(rng.choice([1, 1, 5, 40, 300]))
        total += sizes[-1]
        while places := crowded(sizes):
            merged = sum(sizes[i] for i in places)
            rewritten += merged
            sizes = [n for i, n in enumerate(sizes) if i not in set(places)] + [merged]
        assert len(sizes) <= snapshots.FANOUT * (1 + math.log(total, 4))
    assert rewritten <= total * (1 + math.log(total, 4))


def test_random_changes(spark, tmp_path):
    rng = random.Random(2)
    tables, want = Tables(spark, str(tmp_path), SPECS, 4), {}
    for turn in range(6):
        change = tables.begin()
        gone = [k for k in want if rng.random() < 0.3] + ["never"]
        new = {k: rng.randint(1, 9) for k in [*gone[:2], *(f"k{turn}-{i}" for i in range(rng.randint(0, 4)))]}
        change.delete("rows", spark.createDataFrame([(k,) for k in {*gone, *new}], "k string"))
        change.add("rows", spark.createDataFrame(list(new.items()), "k string, length int"))
        change.add("words", spark.createDataFrame([(f"{k}#{i}", f"w{i}", turn) for k, n in new.items() for i in range(n)], "row_id string, w string, turn int"))
        change.settle(whole=turn == 4)
        before = sorted(map(tuple, tables.live("rows").select("k", "length").collect())) if turn else []
        assert before == sorted(want.items()), "nothing is seen before it is published"
        change.publish({"turn": str(turn)})
        want = {k: v for k, v in want.items() if k not in gone} | new
        assert sorted(map(tuple, tables.live("rows").select("k", "length").collect())) == sorted(want.items())
        assert Counter(r["row_id"] for r in tables.live("words").collect()) == Counter(f"{k}#{i}" for k, n in want.items() for i in range(n))
        assert tables.sums("rows") == {"rows": len(want), "length": sum(want.values())}
        assert tables.manifest()["meta"]["turn"] == str(turn)
    assert len(tables._versions()) == snapshots.KEPT
    named = {e["path"].split("/")[1] for v in tables._versions() for e in tables._load(v)["tables"]["rows"]["segments"]}
    assert set(refresh.folders(spark, f"{tmp_path}/rows")) == named, "files that no kept manifest names are gone"


def test_keys_beyond_a_broadcast(spark, tmp_path, monkeypatch):
    monkeypatch.setattr(snapshots, "MOST_SENT", 0)
    tables = Tables(spark, str(tmp_path), SPECS, 2)
    for rows in ([("a", 1), ("b", 2), ("c", 3)], [("b", 5)], [("d", 1)]):
        change = tables.begin()
        new = spark.createDataFrame(rows, "k string, length int")
        change.delete("rows", new.select("k"))
        change.add("rows", new)
        change.publish()
    assert sorted(map(tuple, tables.live("rows").select("k", "length").collect())) == [("a", 1), ("b", 5), ("c", 3), ("d", 1)]


def test_two_writers(spark, tmp_path):
    tables = Tables(spark, str(tmp_path), SPECS, 2)
    one, two = tables.begin(), tables.begin()
    for change in (one, two):
        change.add("rows", spark.createDataFrame([("a", 1)], "k string, length int"))
    one.publish()
    with pytest.raises(FileExistsError):
        two.publish()
    assert tables.live("rows").count() == 1


def test_a_large_bucket_is_split(spark, tmp_path):
    """One word holds all rows, so all are of one bucket: several tasks write it, none much more than a partition is to have."""
    old = spark.conf.get("spark.sql.adaptive.advisoryPartitionSizeInBytes")
    spark.conf.set("spark.sql.adaptive.advisoryPartitionSizeInBytes", "200k")
    try:
        tables = Tables(spark, str(tmp_path), SPECS, 4)
        change = tables.begin()
        change.add("words", spark.range(0, 200_000, 1, 8).selectExpr("concat(md5(cast(id as string)), '#0') as row_id", "'the' as w"))
        change.publish()
    finally:
        spark.conf.set("spark.sql.adaptive.advisoryPartitionSizeInBytes", old)
    (folder,) = {p.parent for p in (tmp_path / "words").rglob("*.parquet")}
    rows = [spark.read.parquet(str(p)).count() for p in folder.glob("*.parquet")]
    assert sum(rows) == 200_000 and len(rows) >= 6 and max(rows) < 60_000


def _docs(spark, rows):
    return spark.createDataFrame(rows, "doc_id string, title string, body string")


ONE = [("a", "A", "red dragon of old"), ("b", "B", "blue sky\n\n## Part\n\nover the dragon hall"), ("c", "C", "a green field")]
TWO = [("a", "A", "red dragon of old and new"), ("b", "B", "blue sky at night"), ("d", "D", "a dragon field")]


def _seen(engine):
    hits = [(r["chunk_id"], round(r["score"], 9), r["rank"], r["text"]) for r in engine.search("dragon field", 9).collect()]
    postings = sorted((r["row_id"], r["field"], r["term"], tuple(r["positions"])) for r in engine.chunks.postings().collect())
    return sorted(hits), postings, engine.stats().collect(), sorted(r["chunk_id"] for r in engine.table("vectors").collect())


def test_a_refresh_that_stops_changes_nothing(spark, tmp_path, monkeypatch):
    """Stopped at every third of its writes, a refresh leaves rows, scores, statistics and vectors as they were; the next one does it all."""
    embed = lambda texts: [[float(len(t)), 1.0] for t in texts]
    engine = Engine(spark, str(tmp_path), embed=embed, model="m", buckets=2)
    engine.build(_docs(spark, ONE))
    before, manifest = _seen(engine), engine.tables.manifest()
    write, stop, done = Change._write, [-2], [0]

    def stopping(self, df, *args):
        done[0] += 1
        written = write(self, df, *args)
        if done[0] == stop[0]:
            raise KeyboardInterrupt
        return written

    monkeypatch.setattr(Change, "_write", stopping)
    while True:
        stop[0], done[0] = stop[0] + 3, 0
        try:
            engine.refresh(_docs(spark, TWO))
        except KeyboardInterrupt:
            reader = Engine(spark, str(tmp_path), buckets=2)
            assert reader.tables.manifest() == manifest and {r["doc_id"]: r["body"] for r in reader.table("documents").collect()} == {r[0]: r[2] for r in ONE}
            assert stop[0] != 4 or _seen(reader) == before
            continue
        break
    assert stop[0] >= 7
    monkeypatch.undo()
    fresh = Engine(spark, str(tmp_path / "fresh"), embed=embed, model="m", buckets=2)
    fresh.build(_docs(spark, TWO))
    assert _seen(engine) == _seen(fresh)


def test_a_reader_without_a_model_leaves_vectors(spark, tmp_path):
    engine = Engine(spark, str(tmp_path), embed=lambda texts: [[1.0] for _ in texts], model="m", buckets=2)
    engine.build(_docs(spark, ONE))
    n = engine.table("vectors").count()
    other = Engine(spark, str(tmp_path), buckets=2)
    assert other.refresh(_docs(spark, ONE))["embedded"] == 0 and engine.table("vectors").count() == n
    other.refresh(_docs(spark, TWO))
    assert engine.tables.manifest()["meta"]["model"] == "m" and engine.pending().count() == 3
    assert Counter(r["mark"] for r in engine.check(_docs(spark, ONE), "s").collect()) == Counter("MMADEEES")
    assert engine.refresh(_docs(spark, TWO))["embedded"] == 3 and engine.check(_docs(spark, TWO)).count() == 0
