"""Registered queries over the given tables: each applies operators of this package to whole tables."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession

from pyspark.sql import functions as F

from ..functions import records as R
from ..functions import text as T
from ..functions import vectors as V
from ..operators import catalog, chunking, clusters, evaluate, impacts, lexical, lookup, ranking, refresh
from ..operators.filters import Filters
from ..sources import files
from .scratch import kept, scratch

Query = Callable[[SparkSession, str], DataFrame]
QUERIES: dict[str, Query] = {}

#: Mappings of sources of documents to folders; the first that fits a path claims it.
MAPPINGS = [
    {"source": "corpus", "from": "en/src1*/*.md", "to": "english/teens", "exclude": ["**/*7.md"]},
    {"source": "corpus", "from": "en/**", "to": "english/all"},
    {"source": "corpus", "from": "*/src[0-4]/*.md", "to": "low", "rename": "{parent}-{stem}.md"},
    {"source": "corpus", "from": "**/*.md", "to": "rest"},
]


def query(f: Query) -> Query:
    QUERIES[f.__name__] = f
    return f


def table(spark: SparkSession, sf: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf}/{name}.parquet")


def texts(spark: SparkSession, sf: str) -> DataFrame:
    """Documents, dealt over all cores where there are fewer files than cores; many files are read as they are."""
    docs = table(spark, sf, "documents")
    cores = spark.sparkContext.defaultParallelism
    return docs.repartition(cores) if len(docs.inputFiles()) < cores else docs


def dealt(spark: SparkSession, sf: str, name: str, key: str) -> DataFrame:
    """A table, dealt by its key before anything is made of its rows where it has fewer files than there are cores; Spark sizes the parts."""
    rows = table(spark, sf, name)
    return rows.repartition(key) if len(rows.inputFiles()) < spark.sparkContext.defaultParallelism else rows


def catalogued(spark: SparkSession, sf: str) -> DataFrame:
    """Documents with metadata: language as scope, source as section, labels as verified and superseded."""
    labels = table(spark, sf, "labels").groupBy("doc_id").agg(F.max("quality").alias("quality"), F.max("toxic").alias("toxic"))
    docs = table(spark, sf, "documents").join(labels, "doc_id", "left")
    return docs.select(
        "doc_id", "text", F.col("lang").alias("game"), F.concat(F.lit("corpus/"), "source").alias("section"), F.concat(F.lit("Document "), "doc_id").alias("title"), F.array("source", "lang").alias("tags"),
        F.coalesce("quality", F.lit(0)).alias("verified"), (F.coalesce("toxic", F.lit(0)) == 1).alias("superseded"), (F.pmod("doc_id", F.lit(10)) == 0).alias("generated"), "n_chars",
    )


def _asked(spark: SparkSession, sf: str) -> DataFrame:
    """The query set of the searches: items whose id is divisible by 20."""
    return table(spark, sf, "benchmark").where("item_id % 20 = 0")


def _phrases(items: DataFrame) -> DataFrame:
    return lexical.query_phrases(items, "item_id", F.col("text"))


def _bm25(docs: DataFrame, phrases: DataFrame, fields: dict, weights: dict[str, float]) -> DataFrame:
    stats = lexical.corpus_stats(lexical.row_lengths(docs, "doc_id", fields))
    return lexical.bm25(lexical.postings_of(docs, "doc_id", fields, phrases), stats, phrases, weights, lambda found: kept(found, "hits"))


def _shown(scores: DataFrame, k: int) -> DataFrame:
    best = ranking.top_by(scores, k, ["query_id"], F.desc(F.round("score", 9)), F.asc("row_id"))
    return best.select("query_id", F.col("row_id").alias("doc_id"), F.round("score", 6).alias("score"), F.col("rank").cast("long").alias("rank"))


@query
def bm25_topk(spark: SparkSession, sf: str) -> DataFrame:
    return _shown(_bm25(texts(spark, sf), _phrases(_asked(spark, sf)), {"text": F.col("text")}, {"text": 1.0}), 10)


@query
def bm25_batch(spark: SparkSession, sf: str) -> DataFrame:
    return _shown(_bm25(texts(spark, sf), _phrases(table(spark, sf, "benchmark")), {"text": F.col("text")}, {"text": 1.0}), 10)


@query
def bm25_blocks(spark: SparkSession, sf: str) -> DataFrame:
    """The ten best documents for the query set, from blocks by impact of which those that cannot matter are not read."""
    docs, fields, weights, path = texts(spark, sf), {"text": F.col("text")}, {"text": 1.0}, scratch(spark, "blocks")
    stats = kept(lexical.corpus_stats(lexical.row_lengths(docs, "doc_id", fields)), "stats")
    impacts.write_blocks(lexical.build_postings(docs, "doc_id", fields), stats, weights, path, 16)
    phrases = _phrases(_asked(spark, sf))
    best, _ = impacts.top_k(spark, path, stats, phrases, 10, lexical.postings_of(docs, "doc_id", fields, phrases.where(F.size("phrase") > 1)), weights, 16, lambda found: kept(found, "heads"))
    return best.select("query_id", F.col("row_id").alias("doc_id"), F.round("score", 6).alias("score"), F.col("rank").cast("long").alias("rank"))


@query
def bm25_two_field(spark: SparkSession, sf: str) -> DataFrame:
    docs = texts(spark, sf).withColumn("breadcrumb", F.concat_ws(" ", F.lit("the corpus"), "source", "lang"))
    asked = spark.range(1).select(F.lit(0).cast("long").alias("item_id"), F.lit("src3 fr threthe leaux corpus").alias("text"))
    return _shown(_bm25(docs, lexical.query_phrases(asked, "item_id", F.col("text")), {"breadcrumb": F.col("breadcrumb"), "text": F.col("text")}, {"breadcrumb": 2.0, "text": 1.0}), 20)


@query
def bm25_phrase(spark: SparkSession, sf: str) -> DataFrame:
    asked = spark.range(1).select(F.lit(0).cast("long").alias("item_id"), F.lit("mit.license apache.license.version released").alias("text"))
    return _shown(_bm25(texts(spark, sf), lexical.query_phrases(asked, "item_id", F.col("text")), {"text": F.col("text")}, {"text": 1.0}), 50)


@query
def term_stats(spark: SparkSession, sf: str) -> DataFrame:
    return lexical.term_stats(texts(spark, sf), "doc_id", {"text": F.col("text")})


@query
def corpus_stats(spark: SparkSession, sf: str) -> DataFrame:
    found = lexical.corpus_stats(lexical.row_lengths(texts(spark, sf), "doc_id", {"text": F.col("text")}))
    return found.select("n_rows", F.round("avg_length", 6).alias("avg_length"))


@query
def stopword_query_terms(spark: SparkSession, sf: str) -> DataFrame:
    return table(spark, sf, "benchmark").select("item_id", F.array_join(T.query_terms(F.col("text")), " ").alias("terms"))


def _vectors(spark: SparkSession, sf: str) -> DataFrame:
    return table(spark, sf, "embeddings").select(F.col("vec_id").alias("row_id"), F.col("embedding").alias("vec"), "label")


def _near(spark: SparkSession, sf: str, k: int, rows: DataFrame | None = None) -> DataFrame:
    asked = _vectors(spark, sf).where("row_id % 20 = 0").select(F.col("row_id").alias("query_id"), "vec")
    return ranking.cosine(asked, _vectors(spark, sf) if rows is None else rows, k)


@query
def cosine_topk(spark: SparkSession, sf: str) -> DataFrame:
    return _near(spark, sf, 10).select("query_id", F.col("row_id").alias("vec_id"), F.round("score", 6).alias("score"), F.col("rank").cast("long").alias("rank"))


@query
def cosine_filtered(spark: SparkSession, sf: str) -> DataFrame:
    rows = _vectors(spark, sf).where("label in (1, 3, 5)")
    return _near(spark, sf, 10, rows).select("query_id", F.col("row_id").alias("vec_id"), F.round("score", 6).alias("score"), F.col("rank").cast("long").alias("rank"))


@query
def cosine_clusters(spark: SparkSession, sf: str) -> DataFrame:
    """The same from vectors stored by cluster, of which those out of reach are not read."""
    path = scratch(spark, "clusters")
    clusters.write_clusters(_vectors(spark, sf), path)
    asked = _vectors(spark, sf).where("row_id % 20 = 0").select(F.col("row_id").alias("query_id"), "vec")
    hits, _ = clusters.top_k(spark, path, asked, 10, F.col("label").isin(1, 3, 5))
    return hits.select("query_id", F.col("row_id").alias("vec_id"), F.round("score", 6).alias("score"), F.col("rank").cast("long").alias("rank"))


@query
def l2_normalise(spark: SparkSession, sf: str) -> DataFrame:
    unit = table(spark, sf, "embeddings").withColumn("unit", V.l2_normalise(F.transform("embedding", lambda x: x * 3)))
    return unit.select("vec_id", F.round(F.element_at("unit", 1), 6).alias("first"), F.round(V.norm(F.col("unit")), 6).alias("norm"))


def _scores(spark: SparkSession, sf: str) -> DataFrame:
    """Keyword scores of the query set; statistics are those of all documents, so one table serves all filters."""
    return _bm25(texts(spark, sf), _phrases(_asked(spark, sf)), {"text": F.col("text")}, {"text": 1.0})


def _keyword_arm(scores: DataFrame, docs: DataFrame, k: int) -> DataFrame:
    allowed = docs.select(F.col("doc_id").alias("row_id"))
    return ranking.top_by(scores.join(allowed, "row_id", "left_semi"), k, ["query_id"], F.desc(F.round("score", 9)), F.asc("row_id"))


def _arms(spark: SparkSession, sf: str, scores: DataFrame, docs: DataFrame, k: int = ranking.CANDIDATES) -> dict[str, tuple[DataFrame, float]]:
    """Keyword and vector ranks of allowed documents; an item's vector is that of its id, and vectors stand for the documents of their id."""
    allowed = docs.select(F.col("doc_id").alias("row_id"))
    asked = _asked(spark, sf).select(F.col("item_id").alias("row_id")).join(_vectors(spark, sf), "row_id").select(F.col("row_id").alias("query_id"), "vec")
    near = ranking.cosine(asked, _vectors(spark, sf).join(allowed, "row_id", "left_semi"), k)
    return {"lexical": (_keyword_arm(scores, docs, k), 1.0), "semantic": (near, 1.0)}


def _fused(spark: SparkSession, sf: str, arms: dict[str, tuple[DataFrame, float]], k: int) -> DataFrame:
    docs = catalogued(spark, sf).select(F.col("doc_id").alias("row_id"), F.col("section").alias("doc_id"), "verified", "superseded")
    hits = ranking.rrf(arms).join(docs, "row_id").withColumn("score", ranking.boosted(F.col("score"), F.col("verified"), F.col("superseded")))
    best = ranking.cap_per_doc(hits, k)
    return best.select("query_id", F.col("row_id").alias("doc_id"), F.col("doc_id").alias("section"), F.round("score", 6).alias("score"), "arms", F.col("rank").cast("long").alias("rank"))


@query
def rrf_fuse(spark: SparkSession, sf: str) -> DataFrame:
    fused = ranking.rrf(_arms(spark, sf, _scores(spark, sf), table(spark, sf, "documents")))
    return fused.select("query_id", F.col("row_id").alias("doc_id"), F.round("score", 6).alias("score"), "arms")


@query
def hybrid_search(spark: SparkSession, sf: str) -> DataFrame:
    docs = catalogued(spark, sf).where(Filters(game="fr", generated="exclude").predicate("en"))
    return _fused(spark, sf, _arms(spark, sf, _scores(spark, sf), docs), 10)


@query
def hybrid_routed(spark: SparkSession, sf: str) -> DataFrame:
    docs, scores = catalogued(spark, sf), _scores(spark, sf)
    arms = _arms(spark, sf, scores, docs.where(Filters(include_superseded=True).predicate()))
    routed = _keyword_arm(scores, docs.where(Filters(generated="only", include_superseded=True).predicate()), ranking.ROUTED)
    return _fused(spark, sf, arms | {"records": (routed, 1.0)}, 20)


@query
def per_doc_cap(spark: SparkSession, sf: str) -> DataFrame:
    labels = _vectors(spark, sf).select("row_id", F.col("label").alias("doc_id"))
    hits = _near(spark, sf, ranking.CANDIDATES).join(labels, "row_id").withColumn("first_arm", F.lit(0)).withColumn("arm_rank", F.col("rank")).drop("rank")
    return ranking.cap_per_doc(hits, 10).select("query_id", F.col("row_id").alias("vec_id"), F.col("doc_id").alias("label"), F.col("rank").cast("long").alias("rank"))


@query
def dedupe_first(spark: SparkSession, sf: str) -> DataFrame:
    return ranking.top_by(_vectors(spark, sf), 1, ["label"], F.asc("row_id")).select("label", F.col("row_id").alias("vec_id"))


@query
def filter_scope_sentinel(spark: SparkSession, sf: str) -> DataFrame:
    return catalogued(spark, sf).where(Filters(game="de", generated="include", include_superseded=True).predicate()).select("doc_id", "game")


@query
def filter_section_prefix(spark: SparkSession, sf: str) -> DataFrame:
    return catalogued(spark, sf).where(Filters(section="corpus", generated="include", include_superseded=True).predicate()).select("doc_id", "section")


@query
def filter_tag(spark: SparkSession, sf: str) -> DataFrame:
    return catalogued(spark, sf).where(Filters(tag="src3", generated="include", include_superseded=True).predicate()).select("doc_id", F.array_join("tags", ",").alias("tags"))


@query
def filter_flags(spark: SparkSession, sf: str) -> DataFrame:
    docs = catalogued(spark, sf)
    modes = [docs.where(Filters(generated=g, include_superseded=s).predicate()).groupBy().agg(F.count("*").alias("n")).select(F.lit(g).alias("generated"), F.lit(s).alias("superseded"), "n") for g in ("exclude", "include", "only") for s in (False, True)]
    found = modes[0]
    for mode in modes[1:]:
        found = found.unionByName(mode)
    return found


@query
def list_docs(spark: SparkSession, sf: str) -> DataFrame:
    docs = catalogued(spark, sf).where(Filters(game="es", generated="include", include_superseded=True).predicate("none"))
    return docs.select("section", "doc_id", "title").orderBy("section", "doc_id").limit(50)


@query
def substring_catalog(spark: SparkSession, sf: str) -> DataFrame:
    return catalogued(spark, sf).where(Filters(text="DOCUMENT 1", generated="include", include_superseded=True).predicate()).select("doc_id", "title")


@query
def index_stats(spark: SparkSession, sf: str) -> DataFrame:
    return catalogued(spark, sf).agg(
        F.count("*").alias("n_docs"), F.count_if("generated").alias("n_generated"), F.count_if("superseded").alias("n_superseded"), F.count_if(F.col("verified") > 0).alias("n_verified"),
        F.countDistinct("section").alias("n_sections"), F.sum("n_chars").alias("n_chars"),
    )


@query
def counts_union_all(spark: SparkSession, sf: str) -> DataFrame:
    counts = [table(spark, sf, t).groupBy(F.lit(t).alias("source_set"), F.col(c).cast("string").alias("game")).agg(F.count("*").alias("n")) for t, c in (("documents", "lang"), ("events", "event_type"), ("part", "p_brand"))]
    return counts[0].unionByName(counts[1]).unionByName(counts[2])


@query
def count_distinct_types(spark: SparkSession, sf: str) -> DataFrame:
    return table(spark, sf, "part").groupBy("p_brand").agg(F.countDistinct("p_type").alias("n_types"), F.count("*").alias("n"), F.count_if(F.col("p_size") > 25).alias("n_large"))


def _states(spark: SparkSession, sf: str) -> tuple[DataFrame, DataFrame]:
    docs = table(spark, sf, "documents").select("doc_id", "text")
    new_text = F.when(F.pmod("doc_id", F.lit(11)) == 0, F.concat("text", F.lit("!"))).otherwise(F.col("text"))
    old = docs.where(F.pmod("doc_id", F.lit(7)) != 0).select("doc_id", T.body_hash(F.col("text")).alias("hash"))
    new = docs.where(F.pmod("doc_id", F.lit(5)) != 0).select("doc_id", T.body_hash(new_text).alias("hash"))
    return old, new


@query
def refresh_plan(spark: SparkSession, sf: str) -> DataFrame:
    old, new = _states(spark, sf)
    return refresh.plan(old, new, "doc_id", ["hash"])


@query
def pending_vectors(spark: SparkSession, sf: str) -> DataFrame:
    chunks = catalogued(spark, sf).select(F.col("doc_id").alias("chunk_id"), "generated")
    return refresh.pending(chunks, table(spark, sf, "embeddings").select(F.col("vec_id").alias("chunk_id"))).select("chunk_id")


@query
def orphans(spark: SparkSession, sf: str) -> DataFrame:
    old, new = _states(spark, sf)
    return refresh.orphans(old, new, "doc_id")


@query
def file_state_diff(spark: SparkSession, sf: str) -> DataFrame:
    orders = table(spark, sf, "orders").select(F.col("o_orderkey").alias("path"), F.col("o_totalprice").alias("size"), F.unix_timestamp("o_orderdate").alias("mtime"))
    later = orders.where("path % 13 <> 0").withColumn("size", F.when(F.pmod("path", F.lit(17)) == 0, F.col("size") + 1).otherwise(F.col("size")))
    return refresh.plan(orders.where("path % 3 <> 0"), later, "path", ["size", "mtime"]).groupBy("status").agg(F.count("*").alias("n"))


def _paths(spark: SparkSession, sf: str) -> DataFrame:
    name = F.concat(F.col("lang"), F.lit("/"), F.col("source"), F.lit("/"), F.col("doc_id"), F.when(F.pmod("doc_id", F.lit(9)) == 0, ".txt").otherwise(".md"))
    return table(spark, sf, "documents").select(F.lit("corpus").alias("source"), name.alias("path"))


@query
def first_mapping_wins(spark: SparkSession, sf: str) -> DataFrame:
    return files.route(_paths(spark, sf), files.mapping_rows(spark, MAPPINGS)).groupBy("pos").agg(F.count("*").alias("n"))


@query
def glob_route(spark: SparkSession, sf: str) -> DataFrame:
    return files.route(_paths(spark, sf), files.mapping_rows(spark, MAPPINGS)).select("path", "dest")


@query
def title_collisions(spark: SparkSession, sf: str) -> DataFrame:
    docs = table(spark, sf, "documents").select("doc_id", F.element_at(F.split("text", "\n"), 1).alias("title"), F.col("source").alias("section"))
    return catalog.unique_titles(docs).where("unique_title is not null").select("doc_id", "unique_title")


@query
def duplicate_copies(spark: SparkSession, sf: str) -> DataFrame:
    return catalog.duplicate_copies(table(spark, sf, "documents").select("doc_id", T.body_hash(F.col("text")).alias("content_sha256")))


@query
def marker_counts(spark: SparkSession, sf: str) -> DataFrame:
    body = F.replace(F.replace("text", F.lit(". "), F.lit(". [verified] ")), F.lit(", "), F.lit(", [upstream: x] "))
    counts = catalog.confidence_of(body)
    return table(spark, sf, "documents").select("doc_id", *(F.element_at(counts, t).cast("long").alias(t) for t in ("verified", "upstream", "author")))


@query
def identifier_split(spark: SparkSession, sf: str) -> DataFrame:
    made = F.concat(F.initcap(F.element_at(F.split("p_name", " "), 1)), F.initcap(F.element_at(F.split("p_name", " "), -1)), F.lit("XMLFile_"), F.col("p_partkey"), F.lit("-v2Beta"))
    return table(spark, sf, "part").select("p_partkey", T.split_identifier(made).alias("words"))


@query
def record_shape(spark: SparkSession, sf: str) -> DataFrame:
    forms = F.element_at(F.array(F.lpad(F.hex("p_partkey"), 8, "0"), F.concat(F.lit("0x"), F.lpad(F.hex("p_partkey"), 6, "0")), F.lpad(F.hex("p_partkey"), 6, "0"), F.concat(F.col("p_brand"), F.lit(".esp")), F.initcap("p_name"), F.regexp_replace("p_name", " ", "_"), F.col("p_name")), (F.pmod("p_partkey", F.lit(7)) + 1).cast("int"))
    return table(spark, sf, "part").select("p_partkey", forms.alias("q")).withColumn("shaped", T.is_record_shaped(F.col("q")))


def _records(spark: SparkSession, sf: str, parts: DataFrame | None = None) -> DataFrame:
    editor = F.concat(F.regexp_replace(F.initcap("p_name"), " ", ""), F.lit("_"), F.col("p_partkey"))
    form = F.lpad(F.hex("p_partkey"), 6, "0")
    plugin = F.concat(F.regexp_replace("p_brand", "#", ""), F.lit(".esp"))
    return (table(spark, sf, "part") if parts is None else parts).select(
        F.col("p_partkey").alias("path"), editor.alias("editor_id"), form.alias("form_id"), plugin.alias("plugin"), F.concat_ws(":", form, plugin).alias("form_key"),
        F.col("p_type").alias("record_type"), F.lit("both").alias("game"), F.lit("part").alias("source_set"), F.col("p_name").alias("name_en"),
    )


@query
def exact_key_lookup(spark: SparkSession, sf: str) -> DataFrame:
    asked = _records(spark, sf).where("path % 10 = 0").select(F.col("path").alias("asked"), F.lower("form_key").alias("q"))
    # the key is what joins; the predicate of the operator then holds for the pair
    found = asked.join(_records(spark, sf), F.upper("q") == F.upper("form_key")).where(lookup.exact_key(F.col("q")))
    return found.select("asked", "path", "editor_id")


@query
def lookup_ranked(spark: SparkSession, sf: str) -> DataFrame:
    scripts = table(spark, sf, "supplier").select((-F.col("s_suppkey")).alias("path"), F.col("s_name").alias("name"), F.lit("both").alias("game"), F.lit("supplier").alias("source_set"), F.col("s_name").alias("text"))
    first = _records(spark, sf).where("path = 42").select("name_en").first()["name_en"]
    return lookup.find(_records(spark, sf), scripts, first, 30).select("path", "arm", "label", F.round("score", 6).alias("score"), F.col("rank").cast("long").alias("rank"))


@query
def neighbour_window(spark: SparkSession, sf: str) -> DataFrame:
    rows = table(spark, sf, "conversations")
    wanted = rows.where("role = 'user' and length(text) > 300").select("conv_id", "turn")
    return ranking.neighbours(rows, wanted, ["conv_id"], "turn").select("conv_id", "turn", "role")


@query
def outline_runs(spark: SparkSession, sf: str) -> DataFrame:
    rows = table(spark, sf, "conversations").withColumn("long", F.length("text") > 200)
    return ranking.outline_runs(rows, ["conv_id"], "turn", "long").select("conv_id", "long", "first", "last", "n")


@query
def budget_truncate(spark: SparkSession, sf: str) -> DataFrame:
    rows = table(spark, sf, "conversations")
    return ranking.within_budget(rows, ["conv_id"], F.asc("turn"), "text", 600).select("conv_id", "turn", F.length("text").cast("long").alias("shown"))


@query
def token_estimate(spark: SparkSession, sf: str) -> DataFrame:
    return table(spark, sf, "documents").select("doc_id", T.token_estimate(F.col("text")).cast("long").alias("n_tokens"))


@query
def body_hash(spark: SparkSession, sf: str) -> DataFrame:
    return table(spark, sf, "documents").select("doc_id", T.body_hash(F.col("text")).alias("sha256"))


@query
def truncate_text(spark: SparkSession, sf: str) -> DataFrame:
    return table(spark, sf, "documents").select("doc_id", T.body_hash(T.truncated(F.col("text"), 300)).alias("head_sha256"))


@query
def line_pack(spark: SparkSession, sf: str) -> DataFrame:
    return table(spark, sf, "documents").where(F.length("text") > chunking.MOST).select("doc_id", chunking.line_parts(F.col("text")).cast("long").alias("parts"))


def _links(spark: SparkSession, sf: str) -> DataFrame:
    hrefs = F.regexp_extract_all("html", F.lit('href="([^"]*)"'), 1)
    return table(spark, sf, "pages").select("page_id", F.posexplode(hrefs).alias("n", "href"))


@query
def link_extract(spark: SparkSession, sf: str) -> DataFrame:
    return _links(spark, sf).select("page_id", F.col("n").cast("long").alias("n"), "href")


@query
def link_neighbours(spark: SparkSession, sf: str) -> DataFrame:
    per_target = _links(spark, sf).select("page_id", "href").distinct()
    return per_target.groupBy("href").agg(F.count("*").alias("n_pages"), F.min("page_id").alias("first_page"))


@query
def eval_recall_mrr(spark: SparkSession, sf: str) -> DataFrame:
    items = table(spark, sf, "benchmark")
    scores = _bm25(texts(spark, sf), _phrases(table(spark, sf, "benchmark")), {"text": F.col("text")}, {"text": 1.0})
    hits = ranking.top_by(scores, 10, ["query_id"], F.desc(F.round("score", 9)), F.asc("row_id")).select(F.col("query_id").alias("case_id"), F.col("row_id").alias("doc_id"), "rank")
    # acceptable: documents of the residue class of the case
    good = hits.where(F.pmod("doc_id", F.lit(20)) == F.pmod("case_id", F.lit(20))).select("case_id", "doc_id")
    return evaluate.summary(evaluate.case_ranks(hits, items.select(F.col("item_id").alias("case_id")), good))


@query
def markdown_chunk(spark: SparkSession, sf: str) -> DataFrame:
    """Conversations as documents with a heading for each turn, a table of turns and a fence, split into chunks."""
    turns = table(spark, sf, "conversations")
    part = F.concat(F.when(F.col("turn") % 3 == 0, "## ").otherwise("### "), "role", F.lit(" "), F.col("turn").cast("string"), F.lit("\n\n"), "text", F.lit("\n\n```\n# "), "role", F.lit("\n```\n"))
    row = F.concat(F.lit("| "), F.col("turn").cast("string"), F.lit(" | "), "role", F.lit(" |"))
    ordered = lambda c: F.transform(F.sort_array(F.collect_list(F.struct("turn", c.alias("x")))), lambda s: s["x"])
    docs = turns.groupBy("conv_id").agg(ordered(part).alias("parts"), ordered(row).alias("rows"))
    body = F.concat(F.lit("# Conversation\n\n| turn | role |\n|---|---|\n"), F.array_join("rows", "\n"), F.lit("\n\n"), F.array_join("parts", "\n"))
    chunks = chunking.chunk(docs.select(F.col("conv_id").cast("string").alias("doc_id"), F.lit("Conversation").alias("title"), body.alias("body")))
    return chunks.select("chunk_id", "doc_id", "chunk_index", "breadcrumb", "text", "n_tokens")


@query
def frontmatter_parse(spark: SparkSession, sf: str) -> DataFrame:
    raw = F.concat(F.lit('---\nlang: "'), "lang", F.lit('"\nsource: '), "source", F.lit("\nn_chars: "), F.col("n_chars").cast("string"), F.lit("\n---\n\n"), "text")
    parsed = files.with_header(table(spark, sf, "documents").select("doc_id", raw.alias("text")))
    return parsed.select("doc_id", *(files.header_value(k).alias(k) for k in ("lang", "source", "n_chars")), T.body_hash(F.col("body")).alias("body_sha256"))


def _record_text(localised: str) -> Column:
    return F.concat(F.lit("FormKey: 1\nName:\n  TargetLanguage: English\n  Values:\n  - Language: German\n    String: "), F.reverse(localised), F.lit("\n  - Language: English\n    String: '"), F.col(localised), F.lit("'\nKeywords:\n- one"))


@query
def extract_name(spark: SparkSession, sf: str) -> DataFrame:
    text = F.when(F.pmod("p_partkey", F.lit(2)) == 0, _record_text("p_name")).otherwise(F.concat(F.lit("A: 1\nFULL:  \""), "p_name", F.lit("\"\nB: 2")))
    return table(spark, sf, "part").select("p_partkey", R.display_name(text).alias("name"))


@query
def trim_locales(spark: SparkSession, sf: str) -> DataFrame:
    return table(spark, sf, "part").select("p_partkey", R.without_locales(_record_text("p_name")).alias("text"))
