import re
import sqlite3

import pytest
import pyarrow as pa
from pyspark.sql import functions as F

from quillspark.functions import text as T
from quillspark.operators import evaluate, lexical, lookup, ranking

ROWS = [
    (1, "Dragon armour", "The dragon sleeps in the Étion hall, dragon of old."),
    (2, "Hall of kings", "Kings walk the hall; no dragon here."),
    (3, "Potions", "A red potion and a blue potion."),
    (4, "Red dragon", "red red red dragon"),
    (5, "Empty", ""),
    (6, "Files", "Skyrim.esm holds the records; see Update.esm too"),
    (7, "Kings", "king of kings hall"),
    (8, "Decomposed", "E\u0301tion dragon a.a a"),
]


@pytest.mark.parametrize("query", ["dragon hall", "red dragon red", "Skyrim.esm records", "kings", "etion potion", "nothing", "a.a.a dragon.a", "of.kings kings.hall hall"])
def test_bm25_equals_fts5(spark, query):
    con = sqlite3.connect(":memory:")
    con.execute("CREATE VIRTUAL TABLE t USING fts5(head, body, tokenize='unicode61 remove_diacritics 2')")
    con.executemany("INSERT INTO t(rowid, head, body) VALUES (?, ?, ?)", ROWS)
    terms = re.findall(r"[A-Za-z0-9_][A-Za-z0-9_.\-']*", query)
    match = " OR ".join(f'"{t}"' for t in terms)
    want = {r[0]: -r[1] for r in con.execute("SELECT rowid, bm25(t, 2.0, 1.0) FROM t WHERE t MATCH ?", (match,))}
    rows = spark.createDataFrame(ROWS, "id long, head string, body string")
    fields = {"head": F.col("head"), "body": F.col("body")}
    asked = spark.createDataFrame([(0, query)], "query_id int, q string")
    phrases, stats = lexical.query_phrases(asked, "query_id", F.col("q")), lexical.corpus_stats(lexical.row_lengths(rows, "id", fields))
    for postings in (lexical.build_postings(rows, "id", fields), lexical.postings_of(rows, "id", fields, phrases)):
        got = {r["row_id"]: r["score"] for r in lexical.bm25(postings, stats, phrases, {"head": 2.0, "body": 1.0}).collect()}
        assert got.keys() == want.keys()
        assert all(abs(got[k] - want[k]) < 1e-9 for k in want)


def test_postings_of_a_long_text_take_no_square_of_memory(spark):
    text = " ".join(f"w{i}" for i in range(30_000))
    rows = spark.createDataFrame([(1, text)], "id long, body string")
    found = lexical.build_postings(rows, "id", {"body": F.col("body")})
    assert found.agg(F.count("*"), F.sum(F.get("positions", F.lit(0)))).first()[:] == (30_000, sum(range(30_000)))


def test_postings_hold_all_positions(spark):
    rows = spark.createDataFrame(ROWS, "id long, head string, body string")
    got = {(r["row_id"], r["field"], r["term"]): r["positions"] for r in lexical.build_postings(rows, "id", {"body": F.col("body")}).collect()}
    tokens = {r["id"]: r["t"] for r in rows.select("id", T.tokens(F.col("body")).alias("t")).collect()}
    assert got == {(i, "body", w): [n for n, x in enumerate(t) if x == w] for i, t in tokens.items() for w in t}
    assert tokens[8][0] == "etion"


def test_cosine_in_blocks(spark):
    """Blocks of queries and batches of rows give what all pairs give, ties and zero vectors included."""
    import numpy as np

    rng = np.random.default_rng(1)
    v = rng.integers(-2, 3, (300, 4)).astype(float)
    rows = spark.createDataFrame([(i, x.tolist()) for i, x in enumerate(v)] + [(300, None)], "row_id long, vec array<double>").repartition(5)
    asked = rows.where("row_id < 40").select(F.col("row_id").alias("query_id"), "vec")
    unit = v / np.maximum(np.linalg.norm(v, axis=1, keepdims=True), 1e-12)
    scores = np.round(unit[:40] @ unit.T, 9)
    want = {(q, int(i), n + 1) for q in range(40) for n, i in enumerate(np.lexsort((np.arange(300), -scores[q]))[:7])}
    for block in (10_000, 7):
        assert {(r["query_id"], r["row_id"], r["rank"]) for r in ranking.cosine(asked, rows, 7, block).collect()} == want
    assert ranking.cosine(asked.limit(0), rows, 7).count() == 0 and ranking.cosine(asked, rows.limit(0), 7).count() == 0


def one(spark, column, value):
    return spark.createDataFrame([(value,)], "x string").select(column(F.col("x")).alias("y")).first()["y"]


def test_query_terms(spark):
    assert one(spark, T.query_terms, "what does Skyrim.esm do about a Étion-9 x 7") == ["Skyrim.esm", "Etion-9", "7"]
    assert one(spark, T.query_terms, "what is it") == ["what", "is", "it"]
    assert one(spark, lambda c: T.query_terms(c, folded=False), "Étion") == ["tion"]
    assert len(one(spark, T.query_terms, "word " * 100)) == 64
    assert one(spark, T.query_terms, None) == []


@pytest.mark.parametrize("name, words", [("AkaviriKatana", "Akaviri Katana"), ("XMLFile", "XML File"), ("_NNE_Boss", "NNE Boss"), ("a-b_c", "a b c"), (None, "")])
def test_split_identifier(spark, name, words):
    assert one(spark, T.split_identifier, name) == words


@pytest.mark.parametrize("text, shaped", [("0x1A2B", True), ("0001A2B3", True), ("01A2B3", False), ("Skyrim.esm file", True), ("DragonHelmAA", True), ("_NNE_Boss", True), ("plain words", False), (None, False)])
def test_record_shape(spark, text, shaped):
    assert one(spark, T.is_record_shaped, text) is shaped


def test_lookup_puts_exact_hits_first(spark):
    schema = "path string, editor_id string, form_id string, plugin string, form_key string, record_type string, game string, source_set string, name_en string"
    records = spark.createDataFrame(
        [("a", "IronSword", "00012EB7", "Base.esm", "00012EB7:Base.esm", "Weapons", "skyrim", "s", "Iron Sword"), ("b", "IronSwordOld", "00012EB8", "Base.esm", "00012EB8:Base.esm", "Weapons", "both", "s", "Old Iron Sword"), ("c", "Apple", "00012EB9", "Mod.esp", "00012EB9:Mod.esp", "Food", "enderal", "s", "Apple")], schema
    )
    scripts = spark.createDataFrame([("z", "IronScript", "skyrim", "s", "iron script text")], "path string, name string, game string, source_set string, text string")
    find = lambda q, **k: [r["path"] for r in lookup.find(records, scripts, q, **k).orderBy("rank").collect()]
    assert find("ironsword") == ["a"]
    assert find("00012eb8") == ["b"]
    assert find("00012eb9:mod.esp")[0] == "c"
    assert find("IronSword iron")[-1] == "z"
    assert find("sword", game="skyrim") and "c" not in find("apple sword", game="skyrim")
    assert find("IronSword", record_type="Food") == []
    assert find("IronSword", record_type="Food", strict=True) == ["a"]
    stats = {r["game"]: (r["n_records"], r["n_scripts"]) for r in lookup.stats(records, scripts).collect()}
    assert stats == {"skyrim": (1, 1), "both": (1, 0), "enderal": (1, 0)}


def test_fusion_and_cap(spark):
    ranked = lambda ids: spark.createDataFrame([(0, i, n + 1) for n, i in enumerate(ids)], "query_id int, row_id string, rank int")
    fused = ranking.rrf({"a": (ranked("xyz"), 1.0), "b": (ranked("zw"), 1.0)})
    got = {r["row_id"]: (r["score"], r["arms"]) for r in fused.collect()}
    assert got["z"] == (round(1 / 13 + 1 / 11, 9), "a+b") and got["w"] == (round(1 / 12, 9), "b")
    hits = fused.withColumn("doc_id", F.when(F.col("row_id") == "w", "d2").otherwise("d1"))
    assert [r["row_id"] for r in ranking.cap_per_doc(hits, 3, most=2).orderBy("rank").collect()] == ["z", "x", "w"]


def test_evaluation(spark):
    hits = spark.createDataFrame([(1, "a", 1), (1, "b", 2), (2, "c", 1), (2, "c", 2), (2, "d", 3), (3, "x", 1)], "case_id int, doc_id string, rank int")
    expected = spark.createDataFrame([(1, "a"), (2, "d"), (2, "q"), (3, "y"), (4, "z")], "case_id int, doc_id string")
    got = evaluate.summary(evaluate.case_ranks(hits, expected.select("case_id").distinct(), expected)).first()
    assert (got["n_cases"], got["recall"], got["mrr"]) == (4, 0.5, round((1 + 0.5) / 4, 6))


def test_tokens_of_ascii_are_those_of_the_general_rule(spark):
    odd = [None, "", " ", "...", "Plain words_here, 1.5 x-y\n\tEND", "\x00a\x1fb\x7fC", "a" * 50, "Straße École 3", "ΣΊΣΥΦΟΣ İx", "x́y", "日本 ok", "p q"]
    rows = spark.createDataFrame([(i, t) for i, t in enumerate(odd)], "id int, t string")
    general = F.array_remove(F.split(F.coalesce(T.fold(F.col("t")), F.lit("")), T.BETWEEN), "")
    got = rows.select("id", T.tokens(F.col("t")).alias("a"), general.alias("b")).orderBy("id").collect()
    assert [r["a"] for r in got] == [r["b"] for r in got]
    assert got[4]["a"] == ["plain", "words", "here", "1", "5", "x", "y", "end"] and got[0]["a"] == []


def test_postings_come_sorted_by_term_for_many_rows(spark):
    """A writer that sorts by term finds runs that span rows; rows that pass the bound are cut apart and lose nothing."""
    rows = spark.createDataFrame([(i, f"w{i % 7} common w{i % 3}") for i in range(100)], "id long, body string").coalesce(1)
    found = [(r["term"], r["row_id"]) for r in lexical.build_postings(rows, "id", {"body": F.col("body")}).collect()]
    assert found == sorted(found) and len(found) == sum(len({f"w{i % 7}", "common", f"w{i % 3}"}) for i in range(100))
    batch = pa.RecordBatch.from_arrays([pa.array(["a", "b", "c"]), pa.array([["x", "y", "x"], [], ["y"] * 9], pa.list_(pa.string()))], names=["row_id", "f_t"])
    before, lexical.TOKENS = lexical.TOKENS, 2
    try:
        cut = [r for part in lexical._inverted(["t"])(iter([batch])) for r in part.to_pylist()]
    finally:
        lexical.TOKENS = before
    assert [(r["row_id"], r["length"], r["term"], r["positions"]) for r in cut] == [("a", 3, "x", [0, 2]), ("a", 3, "y", [1]), ("c", 9, "y", list(range(9)))]


def test_hits_are_made_once_where_they_are_kept(spark):
    rows = spark.createDataFrame([(i, f"one two w{i % 5}") for i in range(50)], "id long, body string")
    fields, asked = {"body": F.col("body")}, spark.createDataFrame([(0, "w1 two.w3 one")], "query_id int, q string")
    phrases, stats = lexical.query_phrases(asked, "query_id", F.col("q")), lexical.corpus_stats(lexical.row_lengths(rows, "id", fields))
    kept = []
    keep = lambda df: kept.append(df) or spark.createDataFrame(df.collect(), df.schema)
    score = lambda *more: sorted((r["row_id"], round(r["score"], 9)) for r in lexical.bm25(lexical.postings_of(rows, "id", fields, phrases), stats, phrases, {"body": 1.0}, *more).collect())
    assert score(keep) == score() and len(kept) == 1


def test_rows_with_a_term_are_counted_without_their_ids(spark):
    """A term in two fields of a row counts once; the plan has no aggregation by row."""
    rows = spark.createDataFrame([(1, "a b", "b a b"), (2, "", "a"), (3, None, "c c"), (4, "c", None), (5, "", "")], "id int, title string, body string")
    found = lexical.counts(lexical.build_postings(rows, "id", {"title": F.col("title"), "body": F.col("body")}))
    assert {(r["term"], r["df"], r["cf"], r["places"]) for r in found.collect()} == {("a", 2, 3, 0 + 1 + 0), ("b", 1, 3, 1 + 0 + 2), ("c", 2, 3, 0 + 1 + 0)}
    assert "row_id" not in str(found._jdf.queryExecution().optimizedPlan()).split("MapInArrow")[0]


def test_pairs_of_query_and_row_stay_in_their_task(spark):
    rows = spark.createDataFrame([(i, f"red word{i % 3} dragon") for i in range(30)], "id int, body string")
    asked = spark.createDataFrame([(q, f"red word{q % 3} red") for q in range(9)], "id int, q string")
    phrases, fields = lexical.query_phrases(asked, "id", F.col("q")), {"body": F.col("body")}
    scores = lexical.bm25(lexical.build_postings(rows, "id", fields), lexical.corpus_stats(lexical.row_lengths(rows, "id", fields)), phrases, {"body": 1.0})
    exchanges = [line for line in scores._jdf.queryExecution().executedPlan().toString().splitlines() if "Exchange hashpartitioning" in line]
    assert not [line for line in exchanges if "query_id" in line and "row_id" in line] and [line for line in exchanges if "hashpartitioning(row_id" in line]
    assert scores.columns == ["query_id", "row_id", "score"] and scores.count() == 9 * 30
