import json
import time

import pytest
from pyspark.sql import functions as F

from quillspark.api import Engine
from quillspark.operators import lexical, refresh, snapshots
from quillspark.operators.filters import Filters
from quillspark.sources import files


def test_engine(spark, tmp_path):
    rows = [
        ("g/one", "One", "# One\n\nThe iron dragon sleeps.\n\n## Hall\n\nA dragon hall of kings.", "skyrim", "g", "guide", None, None, ["a"], False, False, 2),
        ("g/two", "Two", "## Kings\n\nKings and dragons.", "both", "g", "guide", None, None, [], False, True, 0),
        ("x/gen", "Gen", "| IronSword | 00012EB7 |", "enderal", "x", "index", None, None, [], True, False, 0),
    ]
    schema = "doc_id string, title string, body string, game string, section string, kind string, project string, mod string, tags array<string>, generated boolean, superseded boolean, verified int"
    engine = Engine(spark, str(tmp_path), encode=lambda q: [1.0, 0.0])
    vectors = spark.createDataFrame([("g/one#0", [1.0, 0.1]), ("g/one#1", [0.0, 1.0])], "chunk_id string, vec array<float>")
    engine.build(spark.createDataFrame(rows, schema), vectors)
    hits = engine.search("dragon kings", k=5).orderBy("rank").collect()
    assert {h["doc_id"] for h in hits} == {"g/one"} and "semantic" in hits[0]["arms"]
    assert "g/two" in {h["doc_id"] for h in engine.search("kings", filters=Filters(include_superseded=True)).collect()}
    assert [h["doc_id"] for h in engine.search("IronSword 00012EB7").where("doc_id = 'x/gen'").collect()] == ["x/gen"]
    assert "dragon" in engine.render(engine.search("dragon"))
    assert engine.hit_json(engine.search("dragon")).count() >= 1
    assert engine.fetch("g/one#0").count() >= 1 and engine.fetch("g/one", most=10).first()["text"] is None
    assert engine.fetch("g/one").first()["text"] == rows[0][2] and engine.fetch("none").count() == 0
    one = json.loads(engine.hit_json(engine.search("dragon hall")).first()["json"])
    assert one["doc_id"] == "g/one" and "generated" not in one and "superseded_by" not in one and one["chunk"].endswith("of 2") and one["text"] in rows[0][2]
    engine.dump_chunks(str(tmp_path / "dump"))
    assert spark.read.json(str(tmp_path / "dump")).where("document.title = 'One'").count() == 2
    assert [r["doc_id"] for r in engine.list_docs(Filters(section="g")).collect()] == ["g/one", "g/two"]


def _docs(spark, rows):
    return spark.createDataFrame(rows, "doc_id string, title string, body string, tags array<string>, links_out array<string>")


def test_refresh_follows_documents(spark, tmp_path):
    """After any changes the index is that of a new build, and only what changed is embedded."""
    one = [("a", "A", "red dragon of old", ["t"], ["b", "x"]), ("b", "B", "blue sky\n\n## Part\n\nover the hall", None, None), ("c", "C", "a green field", None, None)]
    two = [("a", "A", "red dragon of old", ["u"], ["b", "x"]), ("b", "B", "blue sky at night", None, None), ("d", "D", "a dragon field", None, None)]

    def embed(texts):
        return [[float(len(t)), 1.0] for t in texts]

    engine = Engine(spark, str(tmp_path / "i"), encode=lambda q: [1.0, 0.0], embed=embed, model="m", buckets=4)
    assert engine.build(_docs(spark, one)) == {"added": 3, "changed": 0, "removed": 0, "unchanged": 0, "embedded": engine.chunks.rows().count()}
    assert engine.refresh(_docs(spark, one)) == {"added": 0, "changed": 0, "removed": 0, "unchanged": 3, "embedded": 0}
    assert engine.refresh(_docs(spark, two)) == {"added": 1, "changed": 2, "removed": 1, "unchanged": 0, "embedded": 3}
    fresh = Engine(spark, str(tmp_path / "f"), buckets=4)
    fresh.build(_docs(spark, two))
    key = lambda e: {(r["row_id"], r["field"], r["term"], tuple(r["positions"]), r["length"]) for r in e.chunks.postings().collect()}
    assert key(engine) == key(fresh)
    assert engine.chunks.stats().collect() == fresh.chunks.stats().collect() and engine.stats().drop("n_vectors").collect() == fresh.stats().drop("n_vectors").collect()
    assert {r["doc_id"] for r in engine.table("vectors").collect()} == {"a", "b", "d"} and engine.pending().count() == 0
    engine.compact()
    assert key(engine) == key(fresh) and engine.refresh(_docs(spark, two))["unchanged"] == 3
    assert [(r["linked"], r["title"]) for r in engine.links(engine.table("documents").select("doc_id")).orderBy("n").collect()] == [("b", "B"), ("x", None)]
    assert engine.stats().first()["n_docs"] == 3
    other = Engine(spark, str(tmp_path / "i"), embed=embed, model="n", buckets=4)
    assert other.refresh(_docs(spark, two))["embedded"] == 3, "vectors of another model go"
    assert other.refresh(_docs(spark, two).limit(0))["removed"] == 3 and other.chunks.postings().count() == 0 and other.stats().first()["n_docs"] == 0


def test_search_reads_the_folders_of_its_terms(spark, tmp_path):
    engine = Engine(spark, str(tmp_path), encode=lambda q: [1.0], buckets=32)
    engine.build(_docs(spark, [(str(i), f"T{i}", f"word{i} and other{i} things", None, None) for i in range(30)]))
    plan = engine.chunks.postings(["word7"])._jdf.queryExecution().toString()
    assert "PartitionFilters: [bucket" in plan.replace("isnotnull(bucket#", "bucket#") or "PartitionFilters: [isnotnull(bucket" in plan
    assert "In(term" in plan or "EqualTo(term,word7)" in plan
    assert [h["doc_id"] for h in engine.search("word7").collect()] == ["7"], "no vectors: keywords alone"
    flagless = engine.search("word8").first()
    assert flagless["n_chunks"] == 1 and '"chunk":"1 of 1"' in engine.hit_json(engine.search("word8")).first()["json"]


def test_records_follow_their_files(spark, tmp_path):
    base = tmp_path / "base"
    for path, text in {"Weapons/IronSword - 00012EB7_Base.esm.yaml": "FormKey: 1\nName: Iron Sword\n", "Food/Apple - 00012EB9_Base.esm/RecordData.yaml": "Name: Red Apple\n", "Food/GroupRecordData.yaml": "x", "notes.txt": "y"}.items():
        (base / path).parent.mkdir(parents=True, exist_ok=True)
        (base / path).write_text(text)
    (tmp_path / "src").mkdir()
    (tmp_path / "src/DoThing.PSC").write_text("Scriptname DoThing\niron forge")
    manifest = tmp_path / "sets.json"
    entries = [{"name": "base", "root": str(base), "game": "one", "kind": "records"}, {"name": "src", "root": str(tmp_path / "src"), "game": "one", "kind": "scripts"}, {"name": "gone", "root": str(tmp_path / "no"), "game": "x", "kind": "records"}]
    manifest.write_text(json.dumps({"sets": entries, "skipped": [{"path": "p", "canonical": "base", "reason": "same"}]}))
    engine = Engine(spark, str(tmp_path / "i"), buckets=4)
    first = engine.scan_sets(str(manifest))
    assert first["records"]["added"] == 2 and first["scripts"]["added"] == 1
    assert engine.scan_sets(str(manifest))["records"] == {"added": 0, "changed": 0, "removed": 0, "unchanged": 2}
    assert [r["arm"] for r in engine.lookup("iron").orderBy("rank").collect()] == [1, 2]
    assert engine.read("00012EB7").first()["label"] == "IronSword"
    (base / "Weapons/IronSword - 00012EB7_Base.esm.yaml").unlink()
    assert engine.scan_sets(str(manifest))["records"]["removed"] == 1 and [r["arm"] for r in engine.lookup("iron").collect()] == [2]
    engine.drop_set("src")
    assert engine.lookup("iron").count() == 0 and engine.record_stats().first()["n_records"] == 1
    assert files.read_source_sets(spark, str(manifest))[1][0]["reason"] == "same"
    manifest.write_text(json.dumps({"sets": entries[2:]}))
    with pytest.raises(ValueError, match="no source set"):
        files.read_source_sets(spark, str(manifest))


def test_stream(spark, tmp_path):
    from quillspark.streaming.refresh import refresh_stream

    schema = "doc_id int, body string, ts int, deleted boolean"
    source = str(tmp_path / "in")
    stream = lambda: refresh_stream(spark.readStream.schema(schema).json(source), str(tmp_path / "t"), str(tmp_path / "c"), buckets=4)
    spark.createDataFrame([(1, "a", 1, False), (1, "b", 2, False), (2, "c", 1, False)], schema).write.json(source)
    stream().awaitTermination()
    spark.createDataFrame([(2, None, 3, True), (3, "d", 3, False)], schema).write.mode("append").json(source)
    stream().awaitTermination()
    assert {r["doc_id"]: r["body"] for r in spark.read.parquet(str(tmp_path / "t")).collect()} == {1: "b", 3: "d"}


def test_many_queries_at_once(spark, tmp_path):
    """Each query's hits are those of a search of its own, with the filters of each; cases are scored in one call."""
    rows = [
        (f"{'x' if i % 3 else 'g/sub'}/d{i}", f"T{i}", f"word{i % 4} and red dragons here {'hall ' * (i % 5)}\n\n## IronSword00{i}\n\nmore word{i % 3} IronSword", ["skyrim", "both", "enderal"][i % 3], "x" if i % 3 else "g/sub", "guide", "p" if i % 2 else None, None, ["a"] if i % 2 else [], i % 7 == 0, i % 5 == 0, i % 4)
        for i in range(24)
    ]
    schema = "doc_id string, title string, body string, game string, section string, kind string, project string, mod string, tags array<string>, generated boolean, superseded boolean, verified int"
    engine = Engine(spark, str(tmp_path), encode=lambda q: [float(len(q)), 1.0], embed=lambda texts: [[float(len(t) % 7), 1.0] for t in texts], buckets=4)
    engine.build(spark.createDataFrame(rows, schema))
    asked = [
        ("a", "red dragons", {}), ("b", "IronSword00", {}), ("c", "word1 hall", {"game": "skyrim", "generated": "include"}), ("d", "word2", {"section": "g", "include_superseded": "true", "tag": "a"}),
        ("e", "dragons", {"text": "T1", "kind": "guide", "project": "p"}), ("f", "nothing of it", {"doc_id": "none", "mod": ""}), ("g", "IronSword", {"generated": "only"}), ("h", "", None),
    ]
    found = engine.search_many(spark.createDataFrame(asked, "query_id string, q string, filters map<string,string>"), 4).collect()
    key = lambda r: (r["rank"], r["chunk_id"], round(r["score"], 9), r["arms"], r["n_chunks"])
    for query_id, q, given in asked[::2] + asked[1:2]:
        own = Filters(**{k: v == "true" if k == "include_superseded" else v for k, v in (given or {}).items()})
        alone = sorted(map(key, engine.search(q, 4, own).collect()))
        assert sorted(key(r) for r in found if r["query_id"] == query_id) == alone and (alone or query_id in "fh")
    cases = tmp_path / "cases.jsonl"
    cases.write_text("\n".join(json.dumps(c) for c in [{"q": "IronSword0011", "expect": ["x/d11", "nowhere"]}, {"q": "red dragons", "expect": ["gone"], "filters": {"game": "skyrim"}}]) + "\n\n")
    ranks, summary = engine.evaluate(str(cases), 5)
    assert {r["q"]: r["hit_rank"] for r in ranks.collect()} == {"IronSword0011": 1, "red dragons": None} and summary.first().asDict() == {"n_cases": 2, "recall": 0.5, "mrr": 0.5}
    notes = engine.notes("IronSword0011", "new stamp")
    assert len(notes) == 2 and "older than the catalog" in notes[1] and engine.notes("red dragons", "") == []
    text = engine.render(engine.search("red dragons"), notes=notes)
    assert "chunk 1 of" in text and text.endswith(f"({notes[0]})\n\n({notes[1]})")


def test_stream_of_an_index(spark, tmp_path):
    """Late, repeated and replayed changes do nothing; what is left is the index of the last writes."""
    from quillspark.streaming.refresh import index_stream

    schema = "doc_id int, title string, body string, ts long, deleted boolean"
    source = str(tmp_path / "in")
    engine = Engine(spark, str(tmp_path / "i"), buckets=2)
    batches = [
        [(1, "A", "red dragon", 1, False), (1, "A", "blue dragon", 2, False), (2, "B", "old hall", 1, False), (3, "C", "green", 1, False)],
        [(1, "A", "late words", 1, False), (2, None, None, 3, True), (4, "D", "dragon field", 4, False), (None, "x", "no id", 9, False)],
        [(2, "B", "late hall", 2, False), (3, "C", "green hill", 5, None), (4, "D", "dragon field", 4, False)],
    ]
    for rows in batches:
        spark.createDataFrame(rows, schema).coalesce(1).write.mode("append").json(source)
        index_stream(spark.readStream.schema(schema).json(source), engine, str(tmp_path / "c")).awaitTermination()
    version = engine.tables.manifest()["version"]
    assert engine.apply(spark.createDataFrame(batches[0], schema), 0) == 0 and engine.tables.manifest()["version"] == version, "a replayed batch"
    assert {r["doc_id"]: r["body"] for r in engine.table("documents").collect()} == {"1": "blue dragon", "3": "green hill", "4": "dragon field"}
    fresh = Engine(spark, str(tmp_path / "f"), buckets=2)
    fresh.build(spark.createDataFrame([("1", "A", "blue dragon"), ("3", "C", "green hill"), ("4", "D", "dragon field")], "doc_id string, title string, body string"))
    key = lambda e: {(r["row_id"], r["field"], r["term"], tuple(r["positions"])) for r in e.chunks.postings().collect()}
    assert key(engine) == key(fresh) and engine.chunks.stats().collect() == fresh.chunks.stats().collect()
    assert engine.apply(spark.createDataFrame([(2, "B", "new hall", 6, False)], schema)) == 1 and engine.search("hall").first()["doc_id"] == "2"


def test_many_are_fetched_in_one_plan(spark, tmp_path):
    """What fetch gives for each, also of documents that changed, and of one that is asked twice; the plan doesn't grow with what is asked."""
    engine = Engine(spark, str(tmp_path), buckets=4)
    docs = lambda word: spark.createDataFrame([(f"d{i}", f"D{i}", f"# D{i}\n\n" + f"{word} {i} " * (i * 300 + 1) + "\n\n## Two\n\nend " * (i % 3) * 40) for i in range(8)], "doc_id string, title string, body string")
    engine.build(docs("old"))
    engine.refresh(docs("new").where("doc_id <> 'd7'"))
    asked = [("d0", None), ("d5", None), ("d5", 1), ("d7", None), ("d3", 50), ("d5", None)]
    many = engine.fetch_many(spark.createDataFrame(asked, "doc_id string, chunk int"), most=900)
    shape = lambda rows: sorted(map(tuple, rows), key=str)
    assert shape(many.collect()) == shape((d, c, *r) for d, c in asked for r in engine.fetch(d, c, most=900).collect())
    assert {r["doc_id"] for r in many.collect()} == {"d0", "d5"} and any(r["text"] is None for r in many.collect())
    plan = lambda n: engine.fetch_many(spark.createDataFrame(asked[:n], "doc_id string, chunk int"))._jdf.queryExecution().optimizedPlan().toString().count("Relation")
    assert plan(1) == plan(6)


def test_documents_stored_alone_are_indexed_by_the_next_refresh(spark, tmp_path):
    """Plan and links need documents alone; a refresh then indexes unchanged ones too, as one that builds does."""
    docs = spark.createDataFrame([(f"d{i}", f"D{i}", f"word{i} same", [f"d{i + 1}"]) for i in range(4)] + [(None, "none", "x", [])], "doc_id string, title string, body string, links_out array<string>")
    new = docs.where("doc_id is null or doc_id <> 'd0'").withColumn("body", F.when(F.col("doc_id") == "d1", "other").otherwise(F.col("body"))).where("doc_id is not null")
    one, two = Engine(spark, f"{tmp_path}/one", buckets=2), Engine(spark, f"{tmp_path}/two", buckets=2)
    assert one.store(docs) == 4 and not one.tables.exists("chunks_postings")
    assert {(r["doc_id"], r["status"]) for r in one.plan(new).collect()} == {("d0", "removed"), ("d1", "changed"), ("d2", "unchanged"), ("d3", "unchanged")}
    assert {(r["doc_id"], r["linked"], r["title"]) for r in one.links(docs.select("doc_id")).collect()} == {("d0", "d1", "D1"), ("d1", "d2", "D2"), ("d2", "d3", "D3"), ("d3", "d4", None)}
    assert one.refresh(new) == {"added": 0, "changed": 1, "removed": 1, "unchanged": 2, "embedded": 0}
    two.build(new)
    key = lambda e: sorted((r["row_id"], r["term"], tuple(r["positions"])) for r in e.chunks.postings().collect())
    assert key(one) == key(two) and one.stats().first() == two.stats().first()


def test_a_build_moves_no_chunks_and_no_postings(spark, tmp_path, monkeypatch):
    """Documents are dealt once; chunks and postings are written where they are made, and texts are not stored beside their breadcrumb again."""
    plans, write = {}, refresh.write_parquet

    def seen(df, path, by=None):
        plans.setdefault(path.split("/")[-2], []).append(df._jdf.queryExecution().optimizedPlan().toString())
        write(df, path, by)

    monkeypatch.setattr(refresh, "write_parquet", seen)
    engine = Engine(spark, str(tmp_path), embed=lambda texts: [[float(len(t))] for t in texts], buckets=2)
    engine.build(_docs(spark, [(f"d{i}", f"D{i}", f"word{i} and things", None, None) for i in range(9)]))
    assert len(plans["chunks"]) == len(plans["chunks_postings"]) == 1
    assert not any(node in plans[name][0] for name in ("chunks", "chunks_postings") for node in ("Rebalance", "Join", "Repartition true")), plans
    assert "embed_text" not in engine.chunks.rows().columns and {len("D1\n\nword1 and things")} == {int(r["vec"][0]) for r in engine.table("vectors").collect()}


def test_shuffle_files_go_with_the_write(spark, tmp_path):
    blocks = lambda: spark._jvm.org.apache.spark.SparkEnv.get().blockManager().diskBlockManager().getAllBlocks().mkString(" ").count("shuffle_")
    before, setting = blocks(), spark.conf.get(refresh.SWEEP, None)
    refresh.write_parquet(spark.range(1000).repartition(7), f"{tmp_path}/t")
    for _ in range(50):
        if blocks() <= before:
            break
        time.sleep(0.1)
    assert blocks() <= before and spark.conf.get(refresh.SWEEP, None) == setting and spark.read.parquet(f"{tmp_path}/t").count() == 1000


def test_hits_move_once_to_meet_keys_that_are_gone(spark, tmp_path, monkeypatch):
    """With too many keys to be sent to every task, hits and not postings meet them, where hits lie already; what is found is as in a new index."""
    monkeypatch.setattr(snapshots, "MOST_SENT", 0)
    docs = lambda word, n: _docs(spark, [(f"d{i}", f"D{i}", f"{word} red dragon {i} hall" if i < n else f"old red dragon {i} hall", None, None) for i in range(12)])
    embed = lambda texts: [[float(len(t)), 1.0] for t in texts]
    engine, fresh = (Engine(spark, f"{tmp_path}/{name}", embed=embed, buckets=2) for name in ("i", "f"))
    engine.build(docs("old", 0))
    assert engine.refresh(docs("newer", 3))["embedded"] == 3
    fresh.build(docs("newer", 3))
    asked = spark.createDataFrame([(0, "red dragon"), (1, "old dragon.3"), (2, "newer hall")], "query_id int, q string")
    key = lambda df: sorted((r["query_id"], r["chunk_id"], r["rank"], round(r["score"], 9), r["text"]) for r in df.collect())
    assert key(engine.search_many(asked, 9)) == key(fresh.search_many(asked, 9))
    vectors = lambda e: sorted((r["chunk_id"], tuple(r["vec"])) for r in e.table("vectors").collect())
    assert vectors(engine) == vectors(fresh)
    hits = engine.chunks.hits(lexical.query_phrases(asked, "query_id", F.col("q")), {"breadcrumb": 2.0, "text": 1.0})
    exchanges = [line for line in hits._jdf.queryExecution().executedPlan().toString().splitlines() if "Exchange hashpartitioning" in line]
    assert len([line for line in exchanges if "regexp_replace(row_id" in line]) == 2 and not [line for line in exchanges if "phrase" in line and "row_id" in line], exchanges
