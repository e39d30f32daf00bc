"""From routed files to a corpus: metadata, rewritten links, rendered texts, catalog and report."""

from __future__ import annotations

import json
from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import text as T
from ..sources import files as S
from ..sources import heads, packed
from . import catalog as C
from . import refresh

#: Header keys in the order they are written; the others follow where they are present.
HEADER = (
    "id", "title", "slug", "section", "game", "kind", "project", "mod", "tags", "source_repo", "source_path", "source_branch", "source_commit", "source_dirty",
    "generated", "generator", "superseded", "superseded_by", "phase", "confidence", "lines", "content_sha256", "synced_at", "sync_version",
)
OPTIONAL = ("unique_title", "skill_name", "agent_name", "description", "agent_meta", "source_frontmatter")
SYNC_VERSION = 1


def _plain(values: dict) -> dict[str, str | None]:
    """Scalars of a manifest entry as text, so that a key with null stays a key."""
    text = lambda v: v if v is None or isinstance(v, str) else json.dumps(v)
    return {k: text(v) for k, v in values.items() if not isinstance(v, (list, dict))}


def manifest_rows(spark: SparkSession, manifest: dict) -> tuple[DataFrame, DataFrame]:
    """Values of mappings (pos, mapped, mapped_tags, mapped_title) and of overrides (pos, path, own, own_tags)."""
    mappings = manifest["mappings"]
    mapped = [(i, _plain(m), m.get("tags", []), None if any(c in m["from"] for c in "*?[") else m.get("title")) for i, m in enumerate(mappings)]
    own = [(i, path, _plain(o), o.get("tags", [])) for i, m in enumerate(mappings) for path, o in (m.get("overrides") or {}).items()]
    return (
        spark.createDataFrame(mapped, "pos int, mapped map<string,string>, mapped_tags array<string>, mapped_title string"),
        spark.createDataFrame(own, "pos int, path string, own map<string,string>, own_tags array<string>"),
    )


def documents(texts: DataFrame, manifest: dict, repos: DataFrame, provenance: DataFrame | None = None, keep: Callable[[DataFrame, str], DataFrame] = lambda df, name: df) -> DataFrame:
    """One row for each claimed file: all header columns, dest, body, links_out, unresolved (target, reason).

    texts: (source, path, text); repos: (source, game, project, branch); provenance: (source, path, commit, dirty), what
    version control says of files. Manifest and repos are parameters of the job and go to every task.
    Plain text files are wrapped in a fence under their name and not searched for flags or links. A value comes from the
    file's override, else its mapping, else what the file or its source says; a null that is set counts.
    A mapping of an unknown source, and two files with one destination, are errors. Texts, links and documents are each
    used several times; keep(table, name) may store them, else they are made anew for each use.
    """
    spark = texts.sparkSession
    known = {r["source"] for r in repos.select("source").collect()}  # a few, like the mappings
    if unknown := sorted({m["source"] for m in manifest["mappings"]} - known):
        raise ValueError(f"mappings of unknown sources: {', '.join(unknown)}")
    routed = S.route(texts.select("source", "path"), S.mapping_rows(spark, manifest["mappings"], manifest.get("global_exclude")))
    if clash := S.collisions(routed).limit(5).collect():
        raise ValueError("files with one destination: " + "; ".join(f"{r['dest']}: {', '.join(r['paths'])}" for r in clash))
    mapped, own = manifest_rows(spark, manifest)
    rows = texts.join(routed, ["source", "path"]).join(F.broadcast(mapped), "pos").join(F.broadcast(own), ["pos", "path"], "left").join(F.broadcast(repos), "source")
    is_txt = F.lower("path").endswith(".txt")
    name = F.substring_index("path", "/", -1)
    wrapped = F.concat(F.lit("# "), name, F.lit("\n\n```text\n"), F.regexp_replace("text", "\n$", ""), F.lit("\n```"))
    rows = S.with_header(rows.withColumn("text", F.when(is_txt, wrapped).otherwise(F.col("text"))))
    rows = rows.withColumn("body", F.when(is_txt, F.col("text")).otherwise(F.regexp_replace("body", r"^(?:[ \t]*\n)+", ""))).withColumn("doc_id", F.regexp_replace("dest", r"\.md$", ""))
    rows = keep(rows.drop("text"), "routed")
    links = keep(C.extract_links(rows.where(~is_txt).select("doc_id", "source", "path", "body")), "targets")
    found = keep(C.resolve_links(links, rows.select("doc_id", "source", "game", "path"), texts.select("source", "path")), "links")
    dests = rows.select(F.col("doc_id").alias("resolved"), F.col("dest").alias("target_dest"))
    rows = C.rewrite_links(rows, found.join(dests, "resolved"))
    missing = found.where("reason is not null").groupBy("doc_id").agg(F.sort_array(F.collect_list(F.struct("n", F.col("raw").alias("target"), "reason"))).alias("missing"))
    rows = rows.join(missing, "doc_id", "left")
    if provenance is not None:
        rows = rows.join(provenance, ["source", "path"], "left")
    else:
        rows = rows.withColumn("commit", F.lit(None).cast("string")).withColumn("dirty", F.lit(False))

    rows, lines = rows.withColumn("lines_", F.split("body", "\n")), F.col("lines_")  # split once
    flagged = lambda x, none: F.when(is_txt, none).otherwise(x)
    generated = C.generated_of(lines)
    slug = F.substring_index("doc_id", "/", -1)
    pick = lambda key, kind, default: C.picked(key, kind, default, F.col("own"), F.col("mapped"))
    set_title = lambda m: F.nullif(F.try_element_at(m, F.lit("title")), F.lit(""))
    title = F.coalesce(set_title(F.col("own")), F.nullif(F.col("mapped_title"), F.lit("")), F.when(is_txt, name).otherwise(C.title_of(lines)), slug)
    body = F.concat(F.regexp_replace("body", "\n+$", ""), F.lit("\n"))
    is_skill = F.col("path").contains("/skills/")
    header = lambda key: S.header_value(key)
    rest = F.map_filter("header", lambda k, _: ~k.isin("name", "description", "tools", "model"))
    agent = F.map_filter("header", lambda k, _: k.isin("tools", "model"))
    done = rows.withColumn("final", body).select(
        F.col("doc_id").alias("id"), title.alias("title"), slug.alias("slug"), F.when(F.col("doc_id").contains("/"), F.regexp_replace("doc_id", "/[^/]*$", "")).otherwise("").alias("section"),
        pick("game", "string", F.col("game")).alias("game"), pick("kind", "string", F.lit("reference")).alias("kind"), pick("project", "string", F.col("project")).alias("project"), pick("mod", "string", F.lit(None).cast("string")).alias("mod"),
        C.tags_of(F.col("mapped_tags"), F.col("own_tags"), F.col("source")).alias("tags"), F.col("source").alias("source_repo"), F.col("path").alias("source_path"), F.col("branch").alias("source_branch"),
        F.col("commit").alias("source_commit"), F.coalesce("dirty", F.lit(False)).alias("source_dirty"),
        F.coalesce(pick("generated", "boolean", flagged(generated["generated"], F.lit(False))), F.lit(False)).alias("generated"), pick("generator", "string", flagged(generated["generator"], F.lit(None))).alias("generator"),
        F.coalesce(pick("superseded", "boolean", flagged(C.superseded_of(lines), F.lit(False))), F.lit(False)).alias("superseded"), pick("superseded_by", "string", F.lit(None).cast("string")).alias("superseded_by"),
        flagged(C.phase_of(lines), F.lit(None)).alias("phase"), C.confidence_of(F.col("final")).alias("confidence"), (F.length("final") - F.length(F.replace("final", F.lit("\n"), F.lit("")))).alias("lines"), T.body_hash(F.col("final")).alias("content_sha256"),
        F.when(is_skill, header("name")).alias("skill_name"), F.when(~is_skill, header("name")).alias("agent_name"), header("description").alias("description"),
        F.when(F.size(agent) > 0, agent).alias("agent_meta"), F.when(F.size(rest) > 0, rest).alias("source_frontmatter"), "dest", F.col("final").alias("body"), "links_out",
        F.coalesce(F.transform("missing", lambda x: F.struct(x["target"].alias("target"), x["reason"].alias("reason"))), F.array().cast("array<struct<target:string,reason:string>>")).alias("unresolved"),
    )
    return C.unique_titles(keep(done, "documents"))


def _json(value: Column) -> Column:
    """A value as JSON; null as null."""
    whole = F.to_json(F.struct(value.alias("v")), {"ignoreNullFields": "false"})
    return F.regexp_replace(whole, r'^\{"v":|\}$', "")


def render(docs: DataFrame, synced_at: str) -> DataFrame:
    """(dest, text): header lines in fixed order with JSON values, then the body."""
    known = docs.withColumn("synced_at", F.lit(synced_at)).withColumn("sync_version", F.lit(SYNC_VERSION))
    by_key = F.create_map(*(x for t in sorted(C.CONFIDENCE) for x in (F.lit(t), F.element_at("confidence", t))))
    value = lambda k: _json(by_key if k == "confidence" else F.col(k))
    fixed = [F.concat(F.lit(f"{k}: "), value(k)) for k in HEADER]
    present = [F.when(F.col(k).isNotNull(), F.concat(F.lit(f"{k}: "), value(k))) for k in OPTIONAL]
    return known.select("dest", F.concat_ws("\n", F.lit("---"), *fixed, *present, F.lit("---"), F.lit(""), F.col("body")).alias("text"))


def catalog(docs: DataFrame) -> DataFrame:
    """(id, json, stamp) of each document; stamp is a hash of all but times, so a file whose stamps are equal can stay."""
    entry = F.to_json(F.struct(*(c for c in docs.columns if c not in ("body", "dest")), F.col("dest").alias("path")), {"ignoreNullFields": "false"})
    return docs.select("id", entry.alias("json"), F.sha2(entry, 256).alias("stamp"))


def write_catalog(docs: DataFrame, path: str, now: str) -> bool:
    """Write the catalog (id, json, stamp, generated_at) unless what is there differs by its time alone; whether it was written."""
    spark, new = docs.sparkSession, catalog(docs)
    if refresh.exists(spark, path):
        old = spark.read.parquet(path).select("id", "stamp")
        if refresh.plan(old, new.select("id", "stamp"), "id", ["stamp"]).where("status <> 'unchanged'").isEmpty():
            return False
    new.withColumn("generated_at", F.lit(now)).write.mode("overwrite").parquet(path)
    return True


def write_corpus(rendered: DataFrame, path: str, as_files: bool = False) -> None:
    """Write (dest, text), packed into containers; or as_files, each text as the file that dest names."""
    texts = rendered.select("dest", "text")
    if as_files:
        heads.write_files(texts.select(F.col("dest").alias("path"), F.col("text").cast("binary").alias("content")), path)
    else:
        packed.write_packed(texts, path)


def read_corpus(spark: SparkSession, path: str, wanted: DataFrame | None = None) -> DataFrame:
    """(path, text) of a packed corpus, or of wanted (path) alone, normalised as the chunker reads it: no byte-order mark, line ends as \\n."""
    found = packed.read_packed(spark, path, None if wanted is None else wanted.select(F.col("path").alias("dest")))
    return found.select(F.col("dest").alias("path"), S.normalised(F.col("text")).alias("text"))


def corpus_orphans(spark: SparkSession, path: str, planned: DataFrame) -> DataFrame:
    """(dest): texts of a packed corpus that planned (dest) lacks, by the table of offsets."""
    return refresh.orphans(packed.offsets(spark, path), planned, "dest")


def headers(corpus_texts: DataFrame) -> DataFrame:
    """(path, header) of (path, text): what was written before, by the headers alone."""
    return S.with_header(corpus_texts).select("path", "header")


def unmatched(routed: DataFrame, mappings: DataFrame) -> DataFrame:
    """(pos, source, pattern): mappings that claim no file."""
    return mappings.select("pos", "source", "pattern").join(routed.select("pos").distinct(), "pos", "left_anti")


def classify(docs: DataFrame, written: DataFrame) -> DataFrame:
    """(id, status) against what was written before (id, content_sha256, stamp)."""
    state = catalog(docs).join(docs.select("id", "content_sha256"), "id").select("id", "content_sha256", "stamp")
    return refresh.plan(written.select("id", "content_sha256", "stamp"), state, "id", ["content_sha256", "stamp"])


def report(docs: DataFrame, copies: DataFrame | None = None) -> DataFrame:
    """(part, section, key, line): the lines of the index report, to be read in this order.

    Parts: 1 a table for each section, with flags G, S and D; 2 unresolved links; 3 titles that several documents share;
    4 copies, from catalog.check_copies. Each line is a row, so no section is gathered.
    """
    bars = lambda c: F.replace(c, F.lit("|"), F.lit("\\|"))
    cells = lambda *c: F.concat(F.lit("| "), F.concat_ws(" | ", *(F.coalesce(x.cast("string"), F.lit("")) for x in c)), F.lit(" |"))
    flags = F.concat(F.when(F.col("generated"), "G").otherwise(""), F.when(F.col("superseded"), "S").otherwise(""), F.when(F.col("source_dirty"), "D").otherwise(""))
    link = F.concat(F.lit("["), F.col("slug"), F.lit("]("), F.col("dest"), F.lit(")"))
    rows = docs.select(F.lit(1).alias("part"), "section", F.col("id").alias("key"), cells(link, bars(F.col("title")), F.col("kind"), F.col("game"), F.col("source_repo"), F.col("lines"), flags).alias("line"))
    none = F.lit("").alias("section")
    links = unresolved(docs).select(F.lit(2).alias("part"), none, F.concat_ws(" ", "id", "target").alias("key"), cells(F.col("id"), F.col("target"), F.col("reason")).alias("line"))
    shared = docs.where("unique_title is not null").select(F.lit(3).alias("part"), none, F.concat_ws(" ", "title", "id").alias("key"), cells(bars(F.col("title")), F.col("id")).alias("line"))
    lines = rows.unionByName(links).unionByName(shared)
    if copies is not None:
        yes = lambda c: F.when(c, "yes").otherwise("no")
        own = copies.select(F.lit(4).alias("part"), none, F.concat_ws(" ", "canonical", "copy").alias("key"), cells(F.col("canonical"), F.col("copy"), yes(F.col("status") == "same"), yes(F.col("expect_divergent"))).alias("line"))
        lines = lines.unionByName(own)
    return lines


def section_counts(docs: DataFrame) -> DataFrame:
    """(section, n_docs)."""
    return docs.groupBy("section").agg(F.count("*").alias("n_docs"))


def unresolved(docs: DataFrame) -> DataFrame:
    return docs.select("id", F.explode("unresolved").alias("u")).select("id", "u.target", "u.reason")


def missing_files(catalogued: DataFrame, texts: DataFrame) -> DataFrame:
    """Catalog entries (id, path) whose file is not there."""
    return catalogued.select("id", "path").join(texts.select("path"), "path", "left_anti")


def corpus(catalogued: DataFrame | None, texts: DataFrame, own: DataFrame) -> DataFrame:
    """(doc_id, title, body, section, game, kind, path, content_sha256) to index.

    catalogued: documents without body, by path; texts, own: (path, text). Catalog entries count whose file is there
    (missing_files lists the others), and own documents with their defaults. What a header says overrides the catalog;
    the body's hash is made anew. Without a catalog the headers of texts stand for it.
    """
    slug = F.regexp_replace(F.substring_index("path", "/", -1), r"\.md$", "")
    none = F.lit(None).cast("string")

    def listed(read: DataFrame, doc_id: Column, title: Column, section: Column, game: Column, kind: Column) -> DataFrame:
        return read.select(doc_id.alias("doc_id"), title.alias("title"), "body", section.alias("section"), game.alias("game"), kind.alias("kind"), "path", T.body_hash(F.col("body")).alias("content_sha256"))

    def of_headers(read: DataFrame, folder: str, kind: Column, game: Column, section: Column) -> DataFrame:
        doc_id = F.coalesce(S.header_value("id"), F.concat(F.lit(folder), slug) if folder else F.regexp_replace("path", r"\.md$", ""))
        return listed(read, doc_id, F.coalesce(S.header_value("title"), doc_id), F.coalesce(S.header_value("section"), section), F.coalesce(S.header_value("game"), game), F.coalesce(S.header_value("kind"), kind))

    read = S.with_header(texts).select("path", "header", "body")
    if catalogued is None:
        found = of_headers(read, "", none, none, none)
    else:
        over = lambda k: F.coalesce(S.header_value(k), F.col(k)) if k in catalogued.columns else S.header_value(k)
        found = listed(catalogued.join(read, "path"), F.col("id"), F.coalesce(over("unique_title"), over("title")), over("section"), over("game"), over("kind"))
    return found.unionByName(of_headers(S.with_header(own), "curated/", F.lit("curated"), F.lit("both"), F.lit("curated")))
