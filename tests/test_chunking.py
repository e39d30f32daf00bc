import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from quillspark.operators import chunking as C


def paths(body):
    return [p.path for p in C.sections(body)]


def test_headings_make_paths():
    body = "# Top\nx\n## A\ny\n### A1\nz\n## B\nw\n#### deep\nstill B\n```\n## not one\n```\nend"
    assert paths(body) == [[], ["A"], ["A", "A1"], ["B"]]
    assert "\n".join(C.sections(body)[-1].lines).endswith("```\nend")


def test_third_level_without_second_nests_under_the_first_such():
    assert paths("### one\na\n### two\nb") == [["one"], ["one", "two"]]


def test_small_neighbours_merge_to_their_common_path():
    body = "## A\nshort\n### A1\nalso\n### A2\nmore\n## B\nother"
    got = [(p.path, len(p.lines)) for p in C.merged(C.sections(body))]
    assert got == [(["A"], 6), (["B"], 2)]


def test_large_table_repeats_its_head():
    rows = [f"| {i} | {'x' * 60} |" for i in range(80)]
    parts = list(C.chunks_of("t", "\n".join(["| n | v |", "|---|---|", *rows])))
    assert len(parts) > 1
    assert all(t.startswith("| n | v |\n|---|---|\n") and len(t) <= C.TARGET for _, _, t in parts)
    assert [r for _, _, t in parts for r in t.split("\n")[2:]] == rows


def test_large_fence_stays_whole():
    fence = "\n".join(["```", *["code " * 10] * 100, "```"])
    texts = [t for _, _, t in C.chunks_of("t", f"## H\n\nbefore\n\n{fence}\n\nafter")]
    assert sum(fence in t for t in texts) == 1


def test_long_lines_without_blanks_are_cut_between_lines():
    lines = [f"- item {i} {'y' * 50}" for i in range(100)]
    texts = [t for _, _, t in C.chunks_of("t", "\n".join(lines))]
    assert [x for t in texts for x in t.split("\n")] == lines
    assert all(len(t) <= C.TARGET for t in texts)


@pytest.mark.parametrize("body", ["", "  \n \n", "\n"])
def test_blank_bodies_have_no_chunk(body):
    assert list(C.chunks_of("t", body)) == []


@settings(max_examples=60, deadline=None)
@given(st.lists(st.sampled_from(["", "# a", "## b", "### c", "text " * 30, "word", "- point " * 20, "> quote"]), max_size=120))
def test_no_line_is_lost(lines):
    body = "\n".join(lines)
    kept = [x for _, _, t in C.chunks_of("t", body) for x in t.split("\n") if x.strip()]
    assert kept == [x for x in lines if x.strip()]


def test_chunk_rows(spark):
    docs = spark.createDataFrame([("d", "Title", "## A\n\nbody"), ("e", None, None), ("f", "F", " ")], "doc_id string, title string, body string")
    found = [r.asDict() for r in C.chunk(docs).collect()]
    assert [(r["chunk_id"], r["breadcrumb"], r["text"], r["n_tokens"]) for r in found] == [("d#0", "Title › A", "## A\n\nbody", 2)]
