"""Heads of files by ranges: bounds, bytes that are no UTF-8, and the way through Spark's own reader."""

import pytest
from pyspark.sql import functions as F

from quillspark.sources import files, heads


@pytest.fixture
def tree(tmp_path):
    made = {
        "Weapons/Iron - 00012EB7_Base.esm.yaml": b"Name: Iron\n" + b"x" * 8180 + "é".encode() * 9, "Weapons/Bad - 00012EB8_Base.esm.yaml": b"Name: B\xffd \xc3\n\xe6\x97", "Food/Tea - 00012EB9_Base.esm/RecordData.yaml": b"",
        "Food/GroupRecordData.yaml": b"Name: no", "Food/a b%20c#d - 00012EBA_Base.esm.yaml": b"Name: Odd\n", "src/Do.PSC": b"Scriptname Do\xff" + "é".encode() * 5000, "src/x.txt": b"no",
    }
    for path, content in made.items():
        (tmp_path / path).parent.mkdir(parents=True, exist_ok=True)
        (tmp_path / path).write_bytes(content)
    return tmp_path, made


def test_heads(spark, tree):
    root, made = tree
    want = {(p, len(c), c[:8192].decode("utf-8", "replace")) for p, c in made.items() if p.endswith(".yaml")}
    for at in (str(root), f"file://{root}", f"file:{root}", f"{root}/"):
        assert {(r["path"], r["size"], r["head"]) for r in files.scan_tree(spark, at, "*.yaml", 8192).collect()} == want
    assert {(r["path"], r["size"], r["head"]) for r in spark.read.format("file_heads").option("bytes", 3).option("files", 1).load(str(root)).collect()} == {(p, len(c), c[:3].decode("utf-8", "replace")) for p, c in made.items()}


def test_a_store_without_ranges(spark, tree, monkeypatch):
    """Read whole and cut, the rows are the same but for empty files."""
    root, _ = tree
    by_range = sorted(map(tuple, files.scan_tree(spark, str(root), "*.yaml", 8192).where("size > 0").collect()))

    def unknown(_):
        raise ValueError("no such store")

    monkeypatch.setattr(heads, "opened", unknown)
    assert sorted(map(tuple, files.scan_tree(spark, str(root), "*.yaml", 8192).collect())) == by_range
    with pytest.raises(ValueError):
        monkeypatch.undo() or heads.opened("viewfs://store/x")


def test_no_more_than_the_head_is_read(tree, monkeypatch):
    """The reader asks for one range of a file, however long it is, and a file that is gone has an empty head."""
    root, _ = tree
    (root / "long.yaml").write_bytes(b"y" * 5_000_000)
    reader = heads.HeadReader({"path": str(root), "glob": "*.yaml", "bytes": "8192"})
    (part,) = reader.partitions()
    asked = []

    class Counted:
        def __init__(self, f):
            self.f = f

        def __enter__(self):
            return self

        def __exit__(self, *_):
            self.f.close()

        def read_at(self, n, at):
            asked.append((n, at))
            return self.f.read_at(n, at)

    class System:
        def open_input_file(self, path):
            return Counted(heads.pafs.LocalFileSystem().open_input_file(path))

    monkeypatch.setattr(heads, "opened", lambda root: (System(), root.rstrip("/")))
    (root / "Food/GroupRecordData.yaml").unlink()
    rows = {r["path"]: r["head"] for batch in reader.read(part) for r in batch.to_pylist()}
    assert len(asked) == 5 and all(n <= 8192 and at == 0 for n, at in asked)
    assert rows["long.yaml"] == "y" * 8192 and rows["Food/GroupRecordData.yaml"] == ""


def test_a_file_that_cannot_be_read_is_no_empty_head(tree, monkeypatch):
    """A scan ends at it; the data source by itself ends too, but tells a file that is gone from an empty one by its size."""
    root, _ = tree
    reader = heads.HeadReader({"path": str(root), "glob": "*.yaml", "bytes": "8192"})
    (part,) = reader.partitions()
    (root / "Food/GroupRecordData.yaml").unlink()
    with pytest.raises(FileNotFoundError):
        list(heads.read_heads(str(root), part.files, 8192))
    sizes = {r["path"]: (r["size"], r["mtime"] is None) for batch in reader.read(part) for r in batch.to_pylist()}
    assert sizes["Food/GroupRecordData.yaml"] == (None, True) and sizes["Food/Tea - 00012EB9_Base.esm/RecordData.yaml"] == (0, False)

    class System:
        def open_input_file(self, path):
            raise PermissionError(path)

    monkeypatch.setattr(heads, "opened", lambda root: (System(), root.rstrip("/")))
    for read in (lambda: reader.read(part), lambda: heads.read_heads(str(root), part.files, 8192)):
        with pytest.raises(PermissionError):
            list(read())


def test_records_and_scripts(spark, tree):
    root, made = tree
    found = {r["editor_id"]: r["name_en"] for r in files.read_records(spark, str(root), "s", "g").collect()}
    assert found == {"Iron": "Iron", "Bad": "B�d �", "Tea": "", "a b%20c#d": "Odd"}
    (script,) = files.read_scripts(spark, str(root), "s", "g").collect()
    assert (script["name"], script["text"], script["path"]) == ("Do", made["src/Do.PSC"].decode("utf-8", "replace"), "src/Do.PSC")


def test_write_files(spark, tmp_path):
    rows = spark.createDataFrame([("a/b.txt", bytearray(b"x\xff")), ("c.txt", None)], "path string, content binary")
    assert heads.write_files(rows, str(tmp_path / "out")) == 2
    assert (tmp_path / "out/a/b.txt").read_bytes() == b"x\xff" and (tmp_path / "out/c.txt").read_bytes() == b""
    (tmp_path / "none").mkdir()
    assert files.scan_tree(spark, str(tmp_path / "none"), "*.yaml", 10).count() == 0
    assert files.scan_tree(spark, str(tmp_path / "out"), "*.txt", 10).where(F.col("head") == "x�").count() == 1


def test_tasks_list_folders_at_any_depth(spark, tmp_path):
    """Files at the root, on each level and below those that are dealt are found once each, and the driver lists none of them."""
    made = {"/".join(["d"] * n + [f"{n}-{i}.yaml"]): b"Name: %d" % n for n in range(7) for i in range(3)}
    for path, content in made.items():
        (tmp_path / path).parent.mkdir(parents=True, exist_ok=True)
        (tmp_path / path).write_bytes(content)
    (tmp_path / "empty.yaml").mkdir()  # a folder by that name is no file
    found = files.scan_tree(spark, str(tmp_path), "*.yaml", 5)
    assert "file_heads" not in found._jdf.queryExecution().optimizedPlan().toString()  # whose partitions are lists of the driver
    assert sorted((r["path"], r["size"], r["head"]) for r in found.collect()) == sorted((p, 7, "Name:") for p in made)
