"""Texts in containers: what is written is read again, alone or all, by ranges; what is gone is known from the offsets."""

from quillspark.operators import sync
from quillspark.sources import heads, packed


def test_packed(spark, tmp_path):
    texts = {f"a/b{i}.md": f"text {i} é日本\n" * (i % 7) for i in range(200)} | {"": "no name", "c/long.md": "x" * 50_000, "odd name'#%.md": "\r\n﻿"}
    rows = spark.createDataFrame([*texts.items(), ("null.md", None)], "dest string, text string").repartition(3)
    root = str(tmp_path / "p")
    packed.write_packed(rows, root, container=2000)
    want = texts | {"null.md": ""}
    assert {r["dest"]: r["text"] for r in packed.read_packed(spark, root).collect()} == want
    table = packed.offsets(spark, root).collect()
    sizes = {p.name: p.stat().st_size for p in (tmp_path / "p/containers").iterdir()}
    assert len(table) == len(want) and 5 < len(sizes) < 60 and all(n <= 2000 or n == 50_000 for n in sizes.values())
    assert {r["container"] for r in table} == set(sizes) and sum(r["length"] for r in table) == sum(sizes.values())
    some = spark.createDataFrame([("a/b5.md",), ("a/b6.md",), ("gone.md",), ("c/long.md",)], "dest string")
    assert {r["dest"]: r["text"] for r in packed.read_packed(spark, root, some).collect()} == {d: want[d] for d in ("a/b5.md", "a/b6.md", "c/long.md")}
    assert {r["dest"] for r in sync.corpus_orphans(spark, root, rows.where("dest <> 'a/b7.md' and dest <> 'null.md'")).collect()} == {"a/b7.md", "null.md"}
    packed.write_packed(rows.where("dest = 'c/long.md'"), root)
    assert [r["dest"] for r in packed.read_packed(spark, root).collect()] == ["c/long.md"], "older containers are named no more"
    packed.write_packed(rows.limit(0), root)
    assert packed.read_packed(spark, root).count() == 0


def test_one_text_reads_its_range(spark, tmp_path, monkeypatch):
    root = str(tmp_path)
    packed.write_packed(spark.createDataFrame([(f"d{i}", "x" * 1000) for i in range(50)], "dest string, text string").coalesce(1), root)
    (container,) = (tmp_path / "containers").iterdir()
    raw = bytearray(container.read_bytes())
    at = packed.offsets(spark, root).where("dest = 'd7'").first()["start"]
    raw[:at], raw[at + 1000 :] = b"\xff" * at, b"\xff" * (len(raw) - at - 1000)
    container.write_bytes(raw)  # all other bytes are spoilt
    assert packed.read_packed(spark, root, spark.createDataFrame([("d7",)], "dest string")).first()["text"] == "x" * 1000


def test_files_by_name(spark, tmp_path):
    rows = spark.createDataFrame([("a/b.md", "one\n"), ("c.md", None)], "dest string, text string")
    sync.write_corpus(rows, str(tmp_path / "f"), as_files=True)
    assert (tmp_path / "f/a/b.md").read_text() == "one\n" and (tmp_path / "f/c.md").read_bytes() == b""
    assert heads.opened(f"file://{tmp_path}")[1] == str(tmp_path)
