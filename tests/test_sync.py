import pytest

from quillspark.operators import sync
from quillspark.sources import files

MANIFEST = {
    "global_exclude": ["**/draft.md"],
    "mappings": [
        {"source": "r", "from": "docs/one.md", "to": "top", "title": "Set title", "kind": "guide", "tags": ["t"], "overrides": {"docs/one.md": {"project": None, "tags": ["o"]}}},
        {"source": "r", "from": "docs/**", "to": "all", "include_txt": True, "project": "p"},
        {"source": "q", "from": "**/skills/*/SKILL.md", "to": "skills", "rename": "{parent}.md"},
    ],
}
TEXTS = [
    ("r", "docs/one.md", "# One\n\n[two](sub/two.md#x) [gone](no.md) [verified]\n"),
    ("r", "docs/sub/two.md", "# Same | name\n\n> **Superseded** by x\n\n[one](../one.md)"),
    ("r", "docs/notes.txt", "# raw [x](one.md)\nend\n"),
    ("r", "docs/draft.md", "# no"),
    ("r", "other/three.md", "# unclaimed"),
    ("q", "a/skills/do/SKILL.md", '---\nname: "do-it"\ndescription: "d"\nmodel: big\nextra: 1\n---\n\n# Same | name\n'),
]


def test_documents(spark, tmp_path):
    texts = spark.createDataFrame(TEXTS, "source string, path string, text string")
    repos = spark.createDataFrame([("r", "g", "rp", "main"), ("q", "both", None, "main")], "source string, game string, project string, branch string")
    docs = sync.documents(texts, MANIFEST, repos).cache()
    got = {r["id"]: r.asDict() for r in docs.collect()}
    assert set(got) == {"top/one", "all/sub/two", "all/notes.txt", "skills/do"}
    one, two, notes, skill = (got[k] for k in ("top/one", "all/sub/two", "all/notes.txt", "skills/do"))
    assert (one["title"], one["kind"], one["project"], one["tags"], one["game"]) == ("Set title", "guide", None, ["t", "o", "source:r"], "g")
    assert "[two](../all/sub/two.md#x)" in one["body"] and one["links_out"] == ["all/sub/two"] and one["confidence"]["verified"] == 1
    assert [tuple(u) for u in one["unresolved"]] == [("no.md", "missing")]
    assert two["superseded"] and two["project"] == "p" and "(../../top/one.md)" in two["body"]
    assert notes["title"] == "notes.txt" and notes["body"].startswith("# notes.txt\n\n```text\n# raw [x](one.md)\nend\n```")
    assert skill["skill_name"] == "do-it" and skill["agent_meta"] == {"model": "big"} and skill["source_frontmatter"] == {"extra": "1"}
    assert skill["unique_title"] == "Same | name (skills)" and one["unique_title"] is None
    text = {r["dest"]: r["text"] for r in sync.render(docs, "2024-01-01T00:00:00Z").collect()}["top/one.md"]
    assert text.startswith('---\nid: "top/one"\ntitle: "Set title"\n') and '"unverified":0' in text and "\nproject: null\n" in text and text.endswith("[verified]\n")
    back = files.with_header(spark.createDataFrame([(text,)], "text string")).select(files.header_value("title").alias("t"), "body").first()
    assert back["t"] == "Set title" and back["body"] == one["body"]
    before = sync.catalog(docs).join(docs.select("id", "content_sha256"), "id")
    assert {r["status"] for r in sync.classify(docs, before).collect()} == {"unchanged"}
    assert {r["section"]: r["n_docs"] for r in sync.section_counts(docs).collect()} == {"top": 1, "all/sub": 1, "all": 1, "skills": 1}
    lines = [r["line"] for r in sync.report(docs).orderBy("part", "section", "key").collect()]
    assert "| [one](top/one.md) | Set title | guide | g | r | 3 |  |" in lines and any("Same \\| name" in x and x.endswith("| S |") for x in lines) and "| top/one | no.md | missing |" in lines
    path = str(tmp_path / "catalog")
    assert sync.write_catalog(docs, path, "t1") and not sync.write_catalog(docs, path, "t2") and sync.write_catalog(docs.where("id <> 'top/one'"), path, "t3")
    sync.write_corpus(sync.render(docs, "t"), str(tmp_path / "corpus"))
    assert {r["path"]: r["text"] for r in sync.read_corpus(spark, str(tmp_path / "corpus")).collect()} == {r["dest"]: r["text"] for r in sync.render(docs, "t").collect()}
    assert sync.headers(sync.read_corpus(spark, str(tmp_path / "corpus"))).where("map_contains_key(header, 'content_sha256')").count() == 4
    rows = files.mapping_rows(spark, [*MANIFEST["mappings"], {"source": "q", "from": "none/*.md"}])
    assert [r["pos"] for r in sync.unmatched(files.route(texts.select("source", "path"), rows), rows).collect()] == [3]
    with pytest.raises(ValueError, match="unknown sources: zz"):
        sync.documents(texts, {"mappings": [{"source": "zz", "from": "*"}]}, repos)
    with pytest.raises(ValueError, match="one destination"):
        sync.documents(texts, {"mappings": [{"source": "r", "from": "**/*.md", "to": "x", "rename": "{parent}.md"}]}, repos)
    assert sync.unresolved(docs).count() == 1


def test_corpus(spark):
    catalogued = spark.createDataFrame([("d/a", "A", "d", "g", "k", "docs/a.md"), ("d/b", "B", "d", "g", "k", "docs/gone.md")], "id string, title string, section string, game string, kind string, path string")
    texts = spark.createDataFrame([("docs/a.md", '---\ntitle: "New"\n---\n\nbody a')], "path string, text string")
    own = spark.createDataFrame([("curated/x.md", "just text")], "path string, text string")
    got = {r["doc_id"]: (r["title"], r["body"], r["game"]) for r in sync.corpus(catalogued, texts, own).collect()}
    assert got == {"d/a": ("New", "body a", "g"), "curated/x": ("curated/x", "just text", "both")}
    assert [r["id"] for r in sync.missing_files(catalogued, texts).collect()] == ["d/b"]
    bare = {r["doc_id"]: r["title"] for r in sync.corpus(None, texts, own).collect()}
    assert bare == {"docs/a": "New", "curated/x": "curated/x"}


def test_documents_are_made_once_where_tables_are_kept(spark):
    """No table that is kept makes an earlier one again: after each, neither texts are parsed nor links extracted anew."""
    texts = spark.createDataFrame(TEXTS, "source string, path string, text string")
    repos = spark.createDataFrame([("r", "g", "rp", "main"), ("q", "both", None, "main")], "source string, game string, project string, branch string")
    names = []

    def keep(df, name):
        names.append(name)
        return spark.createDataFrame(df.collect(), df.schema)

    got = sync.documents(texts, MANIFEST, repos, keep=keep)
    assert names == ["routed", "targets", "links", "documents"]
    assert "PythonUDF" not in got._jdf.queryExecution().optimizedPlan().toString()
    order = lambda df: sorted(map(repr, df.collect()))
    assert order(got) == order(sync.documents(texts, MANIFEST, repos))
