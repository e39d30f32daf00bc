"""An engine over saved tables: search, fetch, list_docs, lookup and read, each a DataFrame or the text made from one."""

from __future__ import annotations

import uuid
from collections.abc import Callable, Sequence
from dataclasses import replace
from functools import reduce

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, FloatType, StructField, StructType

from .functions import records as R
from .functions import text as T
from .operators import chunking, evaluate, index, lexical, lookup, ranking, refresh
from .operators.filters import Filters, clamped, given_predicate, given_value
from .operators.index import Stored
from .operators.snapshots import Change, Spec, Tables
from .sources import files

#: Limits of the tools.
BUDGET, MOST_HITS, MOST_DOCS, MOST_RECORDS = 14_000, 20, 500, 100
WEIGHTS = {"breadcrumb": 2.0, "text": 1.0}
#: Tables that are made from documents.
INDEXED = ("documents", "chunks", "chunks_postings", "vectors", "clock")


def chunk_fields() -> dict[str, Column]:
    return {name: F.col(name) for name in WEIGHTS}


#: Columns of documents that may be left out, and their types.
OPTIONAL = {
    "game": "string", "section": "string", "kind": "string", "project": "string", "mod": "string", "tags": "array<string>", "generated": "boolean", "superseded": "boolean", "superseded_by": "string",
    "verified": "int", "source_repo": "string", "source_path": "string", "path": "string", "confidence": "map<string,int>", "links_out": "array<string>",
}


class Engine:
    """Documents, chunks, postings, vectors, records and scripts as tables below one folder.

    encode gives a query's vector; embed gives those of a batch of passages inside tasks; model names both, so that
    vectors of another model are made anew.
    """

    def __init__(
        self, spark: SparkSession, root: str, encode: Callable[[str], Sequence[float]] | None = None, embed: Callable[[list[str]], Sequence[Sequence[float]]] | None = None, model: str = "", buckets: int = 64
    ):
        self.spark, self.root, self.encode, self.embed, self.model, self.buckets = spark, root.rstrip("/"), encode, embed, model, buckets
        flags = {"generated": "cast(coalesce(generated, false) as long)", "superseded": "cast(coalesce(superseded, false) as long)", "verified": "cast(coalesce(verified, 0) > 0 as long)"}
        specs = {
            "documents": Spec("doc_id", "doc_id", ("doc_id",), sums=flags), **index.specs("chunks", "doc_id", "regexp_replace(row_id, '#[0-9]+$', '')"), "vectors": Spec("chunk_id", "doc_id", ("chunk_id",)), "clock": Spec("doc_id", "doc_id", ("doc_id",)),
            **index.specs("records", "path"), **index.specs("scripts", "path"),
        }
        self.tables = Tables(spark, self.root, specs, buckets)
        self.chunks = Stored(self.tables, "chunks", "chunk_id", "doc_id", chunk_fields())
        self.records = Stored(self.tables, "records", "path", "path", lookup.record_fields())
        self.scripts = Stored(self.tables, "scripts", "path", "path", lookup.script_fields())

    def table(self, name: str, state: dict | None = None) -> DataFrame:
        return self.tables.live(name, state)

    def _kept(self, df: DataFrame, name: str) -> DataFrame:
        """df as a table of work in hand, which no reader looks at."""
        path = f"{self.root}/work/{name}"
        refresh.write_parquet(df, path)
        return self.spark.read.schema(df.schema).parquet(path)

    def build(self, documents: DataFrame, vectors: DataFrame | None = None) -> dict[str, int]:
        """Index documents anew, without anything that was there: (doc_id, title, body) and columns of OPTIONAL; vectors: (chunk_id, vec)."""
        return self.refresh(documents, vectors, anew=True)

    def store(self, documents: DataFrame) -> int:
        """Store documents anew, without chunks and postings, and return how many: enough for plan, links and list_docs. The next refresh indexes them, whatever their status."""
        change = self.tables.begin()
        for name in INDEXED:
            change.clear(name)
        change.state["meta"] = {}
        change.add("documents", self._prepared(documents).where("doc_id is not null"))
        change.publish()
        return self.tables.sums("documents", change.state)["rows"]

    def _prepared(self, documents: DataFrame) -> DataFrame:
        """Documents with all columns, and state: a hash of body, metadata and the version of the chunker."""
        rows = documents.withColumn("doc_id", F.col("doc_id").cast("string"))
        for name, kind in OPTIONAL.items():
            if name not in rows.columns:
                rows = rows.withColumn(name, F.lit(None).cast(kind))
        return rows.withColumn("state", refresh.document_state(F.col("body"), F.lit(chunking.VERSION), *(F.to_json(F.struct(c)) for c in sorted(rows.columns) if c not in ("doc_id", "body"))))

    def plan(self, documents: DataFrame, state: dict | None = None) -> DataFrame:
        """(doc_id, status) of documents against what is indexed."""
        new = self._prepared(documents).select("doc_id", "state")
        state = state or self.tables.manifest()
        return refresh.plan(self.table("documents", state).select("doc_id", "state") if self.tables.exists("documents", state) else new.limit(0), new, "doc_id", ["state"])

    def check(self, documents: DataFrame, stamp: str = "") -> DataFrame:
        """What a refresh would do, without doing it: (mark, item), A, M and D with a document, E with a chunk that is to be embedded, S if the catalog's stamp moved."""
        state = self.tables.manifest()
        plan = self.plan(documents, state).where("status <> 'unchanged'")
        mark = F.when(F.col("status") == "added", "A").when(F.col("status") == "changed", "M").otherwise("D")
        found = plan.select(mark.alias("mark"), F.col("doc_id").alias("item"))
        if self.embed is not None and self.tables.exists("chunks", state):
            found = found.unionByName(self.pending(state).select(F.lit("E").alias("mark"), F.col("chunk_id").alias("item")))
        if state["meta"].get("catalog_stamp", "") != stamp:
            found = found.unionByName(self.spark.createDataFrame([("S", stamp)], "mark string, item string"))
        return found

    def refresh(self, documents: DataFrame, vectors: DataFrame | None = None, stamp: str = "", anew: bool = False) -> dict[str, int]:
        """Bring the index to documents, and return how many were added, changed, removed and left, and chunks embedded.

        Only documents that were added or changed are chunked and indexed; those and removed ones lose their chunks,
        postings and vectors. Chunks without vectors are embedded then, but for generated ones. All of it becomes
        visible at once: a run that is cut short leaves the index as it was. Statistics follow from what comes and goes.
        """
        change = self.tables.begin()
        if anew:
            for name in INDEXED:
                change.clear(name)
            change.state["meta"] = {}
        counts = {"added": 0, "changed": 0, "removed": 0, "unchanged": 0}
        if not change.exists("documents"):  # nothing to compare with: documents go in as they are read
            counts["added"] = self._put(change, self._prepared(documents).where("doc_id is not null"), None)
        else:
            plan = self._kept(self.plan(documents, change.state), "plan")
            counts |= {r["status"]: r["n"] for r in plan.groupBy("status").agg(F.count("*").alias("n")).collect()}
            if stored_alone := not change.exists("chunks"):
                change.clear("documents")
            if counts["added"] + counts["changed"] + counts["removed"] or stored_alone:
                new = plan.where("status <> 'removed'" if stored_alone else "status in ('added', 'changed')")
                touched = self._prepared(documents).join(new.select("doc_id"), "doc_id", "left_semi")
                self._put(change, touched, plan.where("status in ('changed', 'removed')").select("doc_id"))
        counts["embedded"] = self._embed(change, vectors)
        meta = {"catalog_stamp": stamp, "chunk_version": chunking.VERSION}
        if self.embed is not None or vectors is not None and self.model:
            meta["model"] = self.model
        change.settle()
        change.publish(meta)
        return counts

    def _put(self, change: Change, touched: DataFrame, gone: DataFrame | None) -> int:
        """Index prepared documents, and return how many, after what is gone (doc_id), if anything is, has lost its chunks, postings and vectors.

        Documents are made once: chunks come from what was written of them, in the bucket of their document, so they don't move.
        """
        if gone is not None:
            if change.exists("vectors"):
                change.delete("vectors", change.live("vectors").join(gone, "doc_id", "left_semi").select("chunk_id"))
            change.delete("documents", gone)
        n = change.add("documents", touched)
        cut = chunking.chunk(change.added("documents"), ("game", "generated", "superseded")).drop("embed_text")
        self.chunks.replace(change, cut, gone, True)
        return n

    def apply(self, changes: DataFrame, batch: int | None = None) -> int:
        """Bring changes (columns of documents, ts, deleted) into the index, and return how many count.

        Of a document the last write by ts counts, whenever it comes: times are kept with the index, of deleted
        documents too, so a late change does nothing, and neither does one that comes again. Of equal times in one batch
        a deletion counts, then the smaller body. A batch of a number that was applied, or of a smaller one, is passed.
        """
        change = self.tables.begin()
        if batch is not None and int(change.state["meta"].get("stream_batch", "-1")) >= batch:
            return 0
        order = W.partitionBy("doc_id").orderBy(F.desc("ts"), F.desc("deleted"), "body")
        last = changes.withColumn("doc_id", F.col("doc_id").cast("string")).where("doc_id is not null and ts is not null")
        last = last.withColumn("deleted", F.coalesce("deleted", F.lit(False))).withColumn("n_", F.row_number().over(order)).where("n_ = 1").drop("n_")
        if change.exists("clock"):
            known = change.live("clock").select("doc_id", F.col("ts").alias("known_"))
            last = last.join(known, "doc_id", "left").where("known_ is null or ts > known_").drop("known_")
        last = self._kept(last, "changes")
        n = last.count()
        if n:
            self._put(change, self._prepared(last.where("not deleted").drop("ts", "deleted")), last.select("doc_id"))
            change.delete("clock", last.select("doc_id"))
            change.add("clock", last.select("doc_id", "ts", "deleted"))
            self._embed(change, None)
        meta = {"chunk_version": chunking.VERSION} | ({"stream_batch": str(batch)} if batch is not None else {}) | ({"model": self.model} if self.embed is not None else {})
        change.settle()
        change.publish(meta)
        return n

    def _embed(self, change: Change, vectors: DataFrame | None) -> int:
        """Add given vectors, and make those of chunks that lack them in batches inside tasks. One that embeds with another model drops all; one that doesn't embed leaves them."""
        if self.embed is not None and change.state["meta"].get("model", self.model) != self.model:
            change.clear("vectors")
        doc_id = F.regexp_replace("chunk_id", "#[0-9]+$", "").alias("doc_id")
        if vectors is not None:
            self._put_vectors(change, vectors.select("chunk_id", doc_id, F.col("vec").cast("array<float>").alias("vec")))
        if self.embed is None:
            return 0
        pending = self.pending(change.state)
        if change.exists("vectors"):  # texts don't move to find those that lack a vector, and are read in their segments alone
            lacking = self._kept(pending.select("chunk_id", "segment"), "pending")
            there = {r["segment"] for r in lacking.select("segment").distinct().collect()}
            held = [s for s in change.state["tables"]["chunks"]["segments"] if s["at"] in there]
            pending = self.tables.live("chunks", change.state, held).withColumn("embed_text", chunking.embed_text()).join(lacking.select("chunk_id"), "chunk_id", "left_semi")
        n = pending.count()
        if n:
            embed = self.embed
            udf = F.arrow_udf(lambda texts: pa.array([[float(x) for x in v] for v in embed(texts.to_pylist())], pa.list_(pa.float32())), "array<float>")
            self._put_vectors(change, pending.select("chunk_id", doc_id, udf("embed_text").alias("vec")))
        return n

    def _put_vectors(self, change: Change, new: DataFrame) -> None:
        """Vectors in place of older ones of their chunks."""
        new = self._kept(new, "new_vectors")
        change.delete("vectors", new.select("chunk_id"))
        change.add("vectors", new)

    def pending(self, state: dict | None = None) -> DataFrame:
        """Chunks that are to have a vector and have none yet."""
        state = state or self.tables.manifest()
        rows = self.chunks.rows(state).withColumn("embed_text", chunking.embed_text())
        if not self.tables.exists("vectors", state):
            return rows.where(~F.coalesce("generated", F.lit(False)))
        return refresh.pending(rows, self.table("vectors", state).select("chunk_id"))

    def compact(self) -> None:
        """One segment for each table, without what is gone."""
        change = self.tables.begin()
        change.settle(whole=True)
        change.publish()

    def stats(self) -> DataFrame:
        """One row: documents, generated, superseded and verified ones, sections, chunks, vectors, tokens. But for sections these are kept with the index and not counted."""
        state = self.tables.manifest()
        docs, chunks = self.tables.sums("documents", state), self.tables.sums("chunks", state)
        long = lambda n: F.lit(n).cast("long")
        return self.table("documents", state).agg(
            long(docs["rows"]).alias("n_docs"), long(docs["generated"]).alias("n_generated"), long(docs["superseded"]).alias("n_superseded"), long(docs["verified"]).alias("n_verified"), F.countDistinct("section").alias("n_sections"),
            long(chunks["rows"]).alias("n_chunks"), long(chunks["length"]).alias("n_tokens"), long(self.tables.sums("vectors", state)["rows"]).alias("n_vectors"),
        )

    def _semantic_arm(self, asked: DataFrame, allowed: DataFrame, per_query: bool, state: dict) -> DataFrame | None:
        """None, and with it keyword search alone, without an encoder or vectors. Queries of one set of filters share a pass over the vectors."""
        if self.encode is None or not self.tables.exists("vectors", state):
            return None
        encode = self.encode
        groups: dict[tuple[tuple[str, str], ...], list[tuple]] = {}
        for r in asked.select("query_id", "q", *(["filters"] if per_query else [])).collect():  # a stated set
            groups.setdefault(tuple(sorted((r["filters"] or {}).items())) if per_query else (), []).append((r["query_id"], [float(x) for x in encode(r["q"] or "")]))
        chunk_docs = self.chunks.rows(state).select("chunk_id", "doc_id")
        found = []
        for given, rows in groups.items():
            own = allowed.where(given_predicate(F.create_map(*(F.lit(x) for pair in given for x in pair)).cast("map<string,string>"))) if per_query else allowed
            vectors = self.table("vectors", state).join(chunk_docs.join(own.select("doc_id"), "doc_id", "left_semi").select("chunk_id"), "chunk_id", "left_semi").withColumnRenamed("chunk_id", "row_id")
            queries = self.spark.createDataFrame(rows, StructType([asked.schema["query_id"], StructField("vec", ArrayType(FloatType()))]))
            found.append(ranking.cosine(queries, vectors))
        return reduce(DataFrame.unionByName, found) if found else None

    def search_many(self, queries: DataFrame, k: int = 5, filters: Filters = Filters()) -> DataFrame:
        """The k best chunks of each query, in one plan: keyword and vector ranks fused, boosts, at most three chunks of a document.

        queries: (query_id, q) and, where queries differ in them, filters, a map of the fields of Filters as text, which
        hold beside those given for all. Null and empty values of it are no condition.
        """
        k = clamped(k, 1, MOST_HITS)
        state = self.tables.manifest()
        per_query = "filters" in queries.columns
        asked = queries.select("query_id", "q", *(["filters"] if per_query else []))
        phrases = lexical.query_phrases(asked, "query_id", F.col("q"))
        # sorted, as equal phrases that follow each other take little room, here and where hits move to their documents
        found = self._kept(self.chunks.hits(phrases, WEIGHTS, state).sortWithinPartitions("phrase", "row_id"), f"found-{uuid.uuid4().hex}")
        scores = lexical.scored(found, self.chunks.stats(state), phrases, F.regexp_replace("row_id", "#[0-9]+$", "")).withColumnRenamed("owner", "doc_id")
        chunks, docs = self.chunks.rows(state), self.table("documents", state)
        n_asked = asked.count()
        shaped = asked.select("query_id", T.is_record_shaped(F.col("q")).alias("shaped"), *(["filters"] if per_query else []))
        sent = F.broadcast(shaped) if n_asked <= lexical.MOST_SENT else shaped
        # what holds for all queries narrows the documents; what differs is looked at where query and document meet
        wide = docs.where(replace(filters, generated="include", include_superseded=filters.include_superseded or per_query).predicate())
        flag = F.coalesce("generated", F.lit(False))
        if per_query:
            words, records = given_predicate(F.col("filters")), given_predicate(F.col("filters"), generated="only") & (given_value(F.col("filters"), "generated", "exclude") == "exclude")
        else:
            words, records = {"exclude": ~flag, "only": flag}.get(filters.generated, F.lit(True)), flag & F.lit(filters.generated == "exclude")
        most = {"lexical": ranking.CANDIDATES, "semantic": ranking.CANDIDATES, "records": ranking.ROUTED}
        # scores lie by document already, so only documents move, and scores needn't be sorted to meet them
        met = scores.join(wide.select("doc_id", "title", "game", "section", "kind", "project", "mod", "tags", "generated", "superseded").hint("shuffle_hash"), "doc_id").join(sent, "query_id")
        arms = F.array_compact(F.array(F.when(words, 0), F.when(records & F.col("shaped"), 2)))
        own = met.select("query_id", "row_id", "score", F.explode(arms).alias("arm_no"))
        ranked = own.withColumn("rank", F.row_number().over(W.partitionBy("query_id", "arm_no").orderBy(F.desc(F.round("score", 9)), F.asc("row_id"))))
        ranked = ranked.where(F.col("rank") <= F.when(F.col("arm_no") == 0, most["lexical"]).otherwise(most["records"])).where(F.col("rank") <= max(most.values())).select("query_id", "row_id", "arm_no", "rank")
        if (near := self._semantic_arm(asked, wide if per_query else wide.where(words), per_query, state)) is not None:
            ranked = ranked.unionByName(near.select("query_id", "row_id", F.lit(1).alias("arm_no"), "rank"))
        hits = ranking.fused(ranked, list(most), [1.0] * len(most)).withColumnRenamed("row_id", "chunk_id")
        hits = F.broadcast(hits) if n_asked * sum(most.values()) <= lexical.MOST_SENT else hits  # else texts of all chunks may move
        hits = hits.join(chunks.select("chunk_id", "doc_id", "chunk_index", "n_chunks", "heading_path", "breadcrumb", "text"), "chunk_id")
        hits = hits.join(docs.select("doc_id", "title", "section", "game", "kind", "generated", "superseded", "superseded_by", "verified", "source_repo", "source_path", "path", "confidence"), "doc_id")
        hits = hits.withColumn("score", ranking.boosted(F.col("score"), F.col("verified"), F.col("superseded"))).withColumn("row_id", F.col("chunk_id"))
        return ranking.cap_per_doc(hits, k).drop("row_id", "in_doc").withColumn("n_chunks", F.col("n_chunks").cast("long"))

    def search(self, query: str, k: int = 5, filters: Filters = Filters()) -> DataFrame:
        """The k best chunks of one query."""
        return self.search_many(self.spark.createDataFrame([(0, query)], "query_id int, q string"), k, filters).drop("query_id")

    def evaluate(self, cases: DataFrame | str, k: int = 5) -> tuple[DataFrame, DataFrame]:
        """Retrieval quality over cases (q, expect, filters), or a file of them, all searched in one plan.

        Returns (case_id, q, hit_rank) of each case, hit_rank null for a miss, and one row of n_cases, recall, mrr. Cases
        are numbered by question; filters are those of Filters, as text.
        """
        rows = files.read_cases(self.spark, cases) if isinstance(cases, str) else cases.select("q", "expect", "filters")
        rows = rows.withColumn("case_id", F.row_number().over(W.orderBy("q", F.to_json(F.struct("expect", "filters")))).cast("long"))
        rows = self._kept(rows, "cases")
        hits = self.search_many(rows.select(F.col("case_id").alias("query_id"), "q", "filters"), k)
        expected = rows.select("case_id", F.explode("expect").alias("doc_id"))
        ranks = evaluate.case_ranks(hits.select(F.col("query_id").alias("case_id"), "doc_id", "rank"), rows, expected, k).join(rows.select("case_id", "q"), "case_id")
        return ranks.select("case_id", "q", "hit_rank"), evaluate.summary(ranks)

    def notes(self, query: str, stamp: str | None = None) -> list[str]:
        """What a reader of hits should know: generated documents were searched too, keywords alone were, the index is older than the catalog."""
        meta = self.tables.manifest()["meta"]
        routed = self.spark.createDataFrame([(query,)], "q string").select(T.is_record_shaped(F.col("q")).alias("is")).first()["is"]
        found = ["The query names a record, so generated documents were searched as well."] if routed else []
        if self.encode is None or not self.tables.exists("vectors"):
            found.append("Keyword search only, without vectors.")
        if stamp is not None and refresh.is_stale(meta, stamp, chunking.VERSION):
            found.append("The index is older than the catalog: refresh it.")
        return found

    def render(self, hits: DataFrame, budget: int = BUDGET, notes: Sequence[str] = ()) -> str:
        """Hits of one query as text within the budget, with their flags, and notes; they are as few as a search returns."""
        shown = ranking.within_budget(hits.withColumn("all", F.lit(0)), ["all"], F.asc("rank"), "text", budget)
        parts = []
        for h in shown.orderBy("rank").collect():
            flags = [name for name in ("generated", "superseded") if h[name]] + (["verified"] if (h["verified"] or 0) > 0 else [])
            parts.append(f"[{h['rank']}] {h['breadcrumb']} ({h['chunk_id']}; chunk {h['chunk_index'] + 1} of {h['n_chunks']}; {h['arms']}{'; ' + ', '.join(flags) if flags else ''})\n{h['text']}")
        return "\n\n".join([*parts, *(f"({note})" for note in notes)])

    def hit_json(self, hits: DataFrame) -> DataFrame:
        """(rank, json) of each hit; generated only where it is true, superseded_by only where the document is superseded."""
        source = F.when(F.col("source_repo") != "", F.concat_ws(":", "source_repo", "source_path"))
        always = F.struct(
            "chunk_id", "doc_id", "title", "breadcrumb", "section", "game", "kind", F.round("score", 5).alias("score"), F.col("arms").alias("matched_by"), source.alias("source"), "path",
            F.coalesce("confidence", F.create_map().cast("map<string,int>")).alias("confidence"), F.concat_ws(" of ", F.col("chunk_index") + 1, "n_chunks").alias("chunk"),
        )
        generated = F.when(F.col("generated"), ', "generated": true').otherwise("")
        quoted = lambda c: F.coalesce(F.regexp_extract(F.to_json(F.struct(F.col(c).alias("v")), {"ignoreNullFields": "false"}), r"(?s)^\{\"v\":(.*)\}$", 1), F.lit("null"))
        superseded = F.when(F.col("superseded"), F.concat(F.lit(', "superseded_by": '), quoted("superseded_by"))).otherwise("")
        start = F.regexp_replace(F.to_json(always, {"ignoreNullFields": "false"}), r"\}$", "")
        return hits.select("rank", F.concat(start, generated, superseded, F.lit(', "text": '), quoted("text"), F.lit("}")).alias("json"))

    def dump_chunks(self, path: str) -> None:
        """All chunks as JSON lines, each with its document's metadata."""
        docs = self.table("documents")
        meta = F.struct(*(c for c in docs.columns if c not in ("doc_id", "body", "state", "bucket", "segment"))).alias("document")
        self.chunks.rows().drop("game", "generated", "superseded", "embed_text", "length", "segment", "bucket").join(docs.select("doc_id", meta), "doc_id").write.mode("overwrite").json(path)

    def fetch(self, doc_id: str, chunk: int | None = None, most: int = BUDGET) -> DataFrame:
        """A document's body, the chunks next to one of its own, or its outline if it is longer than most characters.

        doc_id may be doc#n. Returns (first, last, heading, text); text is null in an outline.
        """
        if "#" in doc_id and doc_id.rsplit("#", 1)[1].isdigit():
            doc_id, number = doc_id.rsplit("#", 1)
            chunk = int(number) if chunk is None else chunk
        asked = self.spark.createDataFrame([(doc_id, chunk)], "doc_id string, chunk int")
        return self.fetch_many(asked, most).select("first", "last", "heading", "text").orderBy("first")

    def fetch_many(self, asked: DataFrame, most: int = BUDGET) -> DataFrame:
        """What fetch returns for each row of asked (doc_id, chunk; null for the whole document), in one plan: (doc_id, chunk, first, last, heading, text)."""
        state = self.tables.manifest()
        asked = asked.select(F.col("doc_id").cast("string").alias("doc_id"), F.col("chunk").cast("int").alias("chunk"))
        sent = F.broadcast if asked.count() <= lexical.MOST_SENT else lambda df: df
        keys = sent(asked.select("doc_id", refresh.bucket("doc_id", self.buckets).alias("bucket")).distinct())
        found = {t: self.tables.live(t, state, narrow=lambda rows: rows.join(keys, ["bucket", "doc_id"], "left_semi")) for t in ("chunks", "documents")}
        heading = F.when(F.size("heading_path") > 0, F.array_join("heading_path", chunking.CRUMB)).otherwise("(opening)").alias("heading")
        near = found["chunks"].join(sent(asked.where("chunk is not null")), "doc_id").where("chunk_index between chunk - 1 and chunk + 1")
        whole, long = sent(asked.where("chunk is null")), F.coalesce(F.length("body"), F.lit(0)) > most
        docs = found["documents"].join(whole, "doc_id")
        last = found["chunks"].groupBy("doc_id").agg(F.max("chunk_index").alias("last"))
        bodies = docs.where(~long).join(last, "doc_id", "left").select("doc_id", "chunk", F.lit(0).alias("first"), "last", F.col("title").alias("heading"), F.col("body").alias("text"))
        runs = ranking.outline_runs(found["chunks"].select("doc_id", "chunk_index", heading), ["doc_id"], "chunk_index", "heading")
        outlines = runs.join(docs.where(long).select("doc_id", "chunk"), "doc_id").select("doc_id", "chunk", "first", "last", "heading", F.lit(None).cast("string").alias("text"))
        return near.select("doc_id", "chunk", F.col("chunk_index").alias("first"), F.col("chunk_index").alias("last"), heading, "text").unionByName(bodies).unionByName(outlines)

    def links(self, doc_ids: DataFrame) -> DataFrame:
        """(doc_id, n, linked, title): the documents that each of doc_ids (doc_id) links to, in order; title is null for one that is gone."""
        docs = self.table("documents")
        out = docs.join(doc_ids, "doc_id", "left_semi").select("doc_id", F.posexplode("links_out").alias("n", "linked"))
        return out.join(docs.select(F.col("doc_id").alias("linked"), "title"), "linked", "left").select("doc_id", "n", "linked", "title")

    def list_docs(self, filters: Filters = Filters(), limit: int = 100) -> DataFrame:
        """Documents by section and id; generated and superseded ones are listed too."""
        wide = replace(filters, generated="include" if filters.generated == "exclude" else filters.generated, include_superseded=True)
        return self.table("documents").where(wide.predicate()).select("section", "doc_id", "title", "kind", "game").orderBy("section", "doc_id").limit(clamped(limit, 1, MOST_DOCS))

    def refresh_records(self, records: DataFrame | None = None, scripts: DataFrame | None = None) -> dict[str, dict[str, int]]:
        """Bring records and scripts, told apart by path, to the given tables; what has another size or time is indexed anew.

        Counts of added, changed, removed and unchanged by table. Sets that are not in a given table go. Rows without a path are left out.
        """
        out, change = {}, self.tables.begin()
        for name, store, new in (("records", self.records, records), ("scripts", self.scripts, scripts)):
            if new is None:
                continue
            new = new.where("path is not null")
            out[name] = {"added": 0, "changed": 0, "removed": 0, "unchanged": 0}
            if not change.exists(name):  # nothing to compare with: rows go in as they are read
                store.replace(change, new, None)
                out[name]["added"] = self.tables.sums(name, change.state)["rows"]
                continue
            old = store.rows(change.state)
            plan = self._kept(refresh.plan(old.select("path", "size", "mtime"), new.select("path", "size", "mtime"), "path", ["size", "mtime"]), f"{name}_plan")
            out[name] |= {r["status"]: r["n"] for r in plan.groupBy("status").agg(F.count("*").alias("n")).collect()}
            if sum(out[name].values()) > out[name]["unchanged"]:
                touched = new.join(plan.where("status in ('added', 'changed')").select("path"), "path", "left_semi")
                store.replace(change, touched, plan.where("status in ('changed', 'removed')").select("path"))
        change.settle()
        change.publish()
        return out

    def scan_sets(self, manifest: str) -> dict[str, dict[str, int]]:
        """refresh_records from the trees that a manifest of source sets names."""
        sets, _ = files.read_source_sets(self.spark, manifest)
        trees = {"records": files.read_records, "scripts": files.read_scripts}
        named = lambda s, rows: rows.withColumn("path", F.concat(F.lit(f"{s['name']}/"), "path"))  # noqa: E731  a path is of one set
        found = {kind: [named(s, trees[kind](self.spark, s["root"], s["name"], s["game"])) for s in sets if s["kind"] == kind] for kind in trees}
        return self.refresh_records(*(reduce(DataFrame.unionByName, own) if own else None for own in found.values()))

    def drop_set(self, source_set: str) -> None:
        """Delete a source set from records and scripts."""
        change = self.tables.begin()
        for name in ("records", "scripts"):
            if change.exists(name):
                change.delete(name, change.live(name).where(F.col("source_set") == source_set).select("path"))
        change.settle()
        change.publish()

    def lookup(self, query: str, limit: int = 20, **filters) -> DataFrame:
        """Exact hits, then records, then scripts, from the stored index."""
        asked = self.spark.createDataFrame([(0, query)], "query_id int, q string")
        phrases = lexical.query_phrases(asked, "query_id", F.col("q"))
        has_scripts = self.scripts.exists()
        return lookup.find(
            self.records.rows(), self.scripts.rows() if has_scripts else None, query, clamped(limit, 1, MOST_RECORDS),
            record_index=self.records.index(phrases), script_index=self.scripts.index(phrases) if has_scripts else None, **filters,
        )

    def record_stats(self) -> DataFrame:
        """(source_set, game, n_records, n_scripts, n_types, n_named) of every set."""
        return lookup.stats(self.records.rows(), self.scripts.rows())

    def read(self, query: str, full: bool = False, most: int = BUDGET, **filters) -> DataFrame:
        """The first hit's text and up to three alternates: (rank, path, label, text); other languages left out unless full."""
        hits = self.lookup(query, 4, **filters)
        of = lambda rows: rows.select("path", F.col("text") if "text" in rows.columns else F.lit(None).cast("string").alias("text"))
        bodies = of(self.records.rows())
        if self.scripts.exists():
            bodies = bodies.unionByName(of(self.scripts.rows()))
        text = F.col("text") if full else R.without_locales(F.col("text"))
        first = F.col("rank") == 1
        return hits.join(bodies, "path", "left").select("rank", "path", "label", F.when(first, T.truncated(text, most)).alias("text")).orderBy("rank")
