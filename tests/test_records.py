"""Records and scripts: first and later refreshes, counts of postings, and what is deleted."""

from pyspark.sql import functions as F

from quillspark.api import Engine
from quillspark.operators import lexical, refresh, snapshots
from quillspark.plans import queries

RECORDS = "path string, editor_id string, name_en string, record_type string, source_set string, game string, size long, mtime long"
SCRIPTS = "path string, name string, text string, source_set string, game string, size long, mtime long"


def _records(spark, rows):
    return spark.createDataFrame([(p, f"Iron{p}", name, "Weapon", "a", "g", 1, t) for p, name, t in rows], RECORDS)


def _engine(spark, tmp_path):
    engine = Engine(spark, f"{tmp_path}/e", buckets=2)
    none = spark.createDataFrame([], SCRIPTS)
    return engine, lambda rows: engine.refresh_records(_records(spark, rows), none)["records"]


def test_first_refresh_compares_nothing(spark, tmp_path):
    engine, put = _engine(spark, tmp_path)
    assert put([("p1", "red sword red", 1), ("p2", "bow", 1), (None, "lost", 1)]) == {"added": 2, "changed": 0, "removed": 0, "unchanged": 0}
    assert not refresh.exists(spark, f"{tmp_path}/e/work/records_plan")
    # a row without a path is no change either
    assert put([("p1", "red sword red", 1), ("p2", "bow", 1), (None, "lost", 1)]) == {"added": 0, "changed": 0, "removed": 0, "unchanged": 2}
    assert put([("p1", "blue sword", 2)]) == {"added": 0, "changed": 1, "removed": 1, "unchanged": 0}
    assert [r["path"] for r in engine.records.rows().collect()] == ["p1"]


def test_sums_follow_deleted_rows(spark, tmp_path):
    engine, put = _engine(spark, tmp_path)
    put([("p1", "red sword red", 1), ("p2", "bow", 1), ("p3", None, 1)])
    put([("p1", "blue", 2), ("p3", None, 1)])
    rows = engine.records.rows()
    assert engine.tables.sums("records") == rows.agg(F.count("*").alias("rows"), F.sum("length").alias("length")).first().asDict()
    assert all(set(d) == {"path", "at", "rows"} for d in engine.tables.manifest()["tables"]["records"]["deleted"])


def test_counts_move_no_positions(spark, tmp_path, monkeypatch):
    monkeypatch.setattr(snapshots, "MOST_SENT", 0)
    engine, put = _engine(spark, tmp_path)
    put([(f"p{i}", "red sword red", 1) for i in range(9)])
    put([("p0", "red blue red", 2), *((f"p{i}", "red sword red", 1) for i in range(2, 9))])
    found = lexical.totals(engine.records.sizes())
    assert sorted(found.collect()) == sorted(lexical.counts(engine.records.postings()).collect())
    assert {r["term"]: (r["df"], r["cf"]) for r in found.collect()}["red"] == (8, 16)
    plan = found._jdf.queryExecution().executedPlan().toString()
    assert "ShuffledHashJoin" in plan and "SortMergeJoin" not in plan
    assert not [line for line in plan.splitlines() if "Join" in line and "positions" in line]


def test_one_file_is_dealt(spark, tmp_path):
    spark.range(100).select(F.col("id").alias("k")).coalesce(1).write.parquet(f"{tmp_path}/t.parquet")
    found = queries.dealt(spark, str(tmp_path), "t", "k")
    assert "Exchange hashpartitioning(k" in found._jdf.queryExecution().executedPlan().toString() and found.count() == 100
