"""Metadata of documents, links among them, copies and title collisions."""

from __future__ import annotations

import re

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from ..functions.text import let

#: Tags of claims.
CONFIDENCE = ("verified", "community", "unverified", "upstream", "author")
#: Marks of generated and superseded documents and of phases, in the first lines of a file.
GENERATED_COMMENT, GENERATED_QUOTE = r"(?i)^<!--\s*GENERATED\b", r"(?i)^>\s*(\*\*)?(auto-)?generated(\*\*)?\s+by\b"
GENERATOR = r"(?i)\bby\s+`?([^`\s]+)`?"
SUPERSEDED = "^>\\s*(⚠️\\s*)?\\*\\*(Replaced by|Superseded)\\b"
PHASE = r"\*\*Phase (\d+), document (\d+)\.\*\*"


def title_of(lines: Column) -> Column:
    """The first line that is neither blank nor a comment, if it is a level-1 heading: without backticks, spaces collapsed."""
    return let(F.get(F.filter(lines, lambda x: (F.trim(x) != "") & ~F.trim(x).startswith("<!--")), F.lit(0)), _title)


def _title(first: Column) -> Column:
    heading = F.regexp_extract(first, r"^#\s+(.+?)\s*$", 1)
    return F.when(heading != "", F.trim(F.regexp_replace(F.replace(heading, F.lit("`"), F.lit("")), r"\s+", " ")))


def generated_of(lines: Column) -> Column:
    """struct(generated, generator) from the first six lines: a comment on the first, or a quote on any."""
    return let(F.slice(lines, 1, 6), _generated)


def _generated(head: Column) -> Column:
    places = F.filter(F.sequence(F.lit(0), F.greatest(F.size(head) - 1, F.lit(0))), lambda i: ((i == 0) & F.get(head, i).rlike(GENERATED_COMMENT)) | F.get(head, i).rlike(GENERATED_QUOTE))
    return let(F.get(places, F.lit(0)), lambda at: _generator(head, at))


def _generator(head: Column, at: Column) -> Column:
    near = F.concat_ws(" ", F.get(head, at), F.get(head, at + 1))
    name = F.regexp_replace(F.regexp_extract(near, GENERATOR, 1), "[.,;:]+$", "")
    return F.struct(at.isNotNull().alias("generated"), F.when(at.isNotNull() & (name != ""), name).alias("generator"))


def superseded_of(lines: Column) -> Column:
    return F.exists(F.slice(lines, 1, 15), lambda x: x.rlike(SUPERSEDED))


def phase_of(lines: Column) -> Column:
    first = F.get(F.filter(F.slice(lines, 1, 8), lambda x: x.rlike(PHASE)), F.lit(0))
    return F.when(first.isNotNull(), F.format_string("Phase %s, document %s", F.regexp_extract(first, PHASE, 1), F.regexp_extract(first, PHASE, 2)))


def confidence_of(body: Column, tags: tuple[str, ...] = CONFIDENCE) -> Column:
    """Map from tag to how often the body has it after an opening bracket."""
    return F.create_map(*(x for t in tags for x in (F.lit(t), F.regexp_count(body, F.lit(rf"\[{t}\b")))))


def unique_titles(docs: DataFrame) -> DataFrame:
    """docs (doc_id, title, section) and unique_title: of documents that share a title, the title with its section.

    Titles are counted apart and joined, so that a title of many documents is no single task's work. Null titles are not shared.
    """
    shared = title_collisions(docs).select("title", F.lit(True).alias("_shared"))
    with_section = F.when(F.col("section") != "", F.concat("title", F.lit(" ("), "section", F.lit(")"))).otherwise(F.col("title"))
    return docs.join(shared, "title", "left").withColumn("unique_title", F.when(F.col("_shared"), with_section)).select(*docs.columns, "unique_title")


def title_collisions(docs: DataFrame) -> DataFrame:
    return docs.where("title is not null").groupBy("title").agg(F.count("*").alias("n")).where("n > 1")


def duplicate_copies(docs: DataFrame, hash_column: str = "content_sha256") -> DataFrame:
    """(hash, canonical, n): contents that stand more than once; canonical is the smallest doc_id."""
    return docs.groupBy(hash_column).agg(F.min("doc_id").alias("canonical"), F.count("*").alias("n")).where("n > 1")


def check_copies(docs: DataFrame, pairs: DataFrame) -> DataFrame:
    """pairs (canonical, copy, expect_divergent) and status: same, diverged, expected, missing."""
    hashes = lambda name: docs.select(F.col("doc_id").alias(name), F.col("content_sha256").alias(f"{name}_hash"))
    found = pairs.join(hashes("canonical"), "canonical", "left").join(hashes("copy"), "copy", "left")
    same = F.col("canonical_hash") == F.col("copy_hash")
    status = F.when(F.col("copy_hash").isNull() | F.col("canonical_hash").isNull(), "missing").when(same, "same").when(F.col("expect_divergent"), "expected").otherwise("diverged")
    return found.select("canonical", "copy", "expect_divergent", status.alias("status"))


def picked(key: str, kind: str, default: Column, override: Column, mapping: Column) -> Column:
    """A value by precedence: override, mapping, default; a key that is there with a null counts. override, mapping: maps."""
    has = lambda m: F.coalesce(F.map_contains_key(m, F.lit(key)), F.lit(False))
    at = lambda m: F.try_element_at(m, F.lit(key)).cast(kind)
    return F.when(has(override), at(override)).when(has(mapping), at(mapping)).otherwise(default)


def tags_of(mapping_tags: Column, override_tags: Column, source: Column) -> Column:
    """Tags in order and the tag of the source, which is not repeated."""
    none = F.array().cast("array<string>")
    tags = F.concat(F.coalesce(mapping_tags, none), F.coalesce(override_tags, none))
    own = F.concat(F.lit("source:"), source)
    return F.when(F.array_contains(tags, own), tags).otherwise(F.concat(tags, F.array(own)))


#: Links, link definitions, code spans, fences, and targets that are not relative.
_LINK = re.compile(r"(!?\[[^\]]*\]\()(<?)([^)\s>]+)(>?)((?:\s+\"[^\"]*\")?\))")
_DEFINITION = re.compile(r"^(\s{0,3}\[[^\]]+\]:\s*)(\S+)(.*)$")
_SPAN = re.compile(r"(`+)(.+?)\1")
_FENCE = re.compile(r"^\s{0,3}(```|~~~)")
_ABSOLUTE = re.compile(r"^(?:[a-zA-Z][a-zA-Z0-9+.-]*:|//|#)")


def _spots(lines: list[str]):
    """(line number, start, stop) of each relative link target outside fences and code spans."""
    mark = None
    for n, line in enumerate(lines):
        if fence := _FENCE.match(line):
            mark = None if fence[1] == mark else (mark or fence[1])
        elif mark is None:
            definition = _DEFINITION.match(line)
            spans = [] if definition else [s.span() for s in _SPAN.finditer(line)]
            for found, group in [(definition, 2)] if definition else [(m, 3) for m in _LINK.finditer(line)]:
                bracket = found.start(group) - 1
                if not _ABSOLUTE.match(found[group]) and not any(a <= bracket < b for a, b in spans):
                    yield n, *found.span(group)


def extract_links(docs: DataFrame) -> DataFrame:
    """(doc_id, source, path, n, raw, target, fragment) of each relative link in docs (doc_id, source, path, body), in order."""
    raw = F.arrow_udf(lambda bodies: pa.array([[x[a:b] for lines in [(t or "").split("\n")] for n, a, b in _spots(lines) for x in [lines[n]]] for t in bodies.to_pylist()], pa.list_(pa.string())), "array<string>")
    found = docs.select("doc_id", "source", "path", F.posexplode(raw("body")).alias("n", "raw"))
    target = F.substring_index("raw", "#", 1)
    return found.withColumn("target", target).withColumn("fragment", F.expr("substring(raw, length(target) + 1)")).where("target <> ''")


def normal_path(path: Column) -> Column:
    """A path without . and .. where that is possible; one that leaves the root starts with ../."""
    start = F.array().cast("array<string>")
    climbs = lambda out: (F.size(out) == 0) | (F.element_at(F.concat(F.array(F.lit("..")), out), -1) == "..")
    step = lambda out, x: F.when(x.isin("", "."), out).when((x == "..") & ~climbs(out), F.slice(out, 1, F.greatest(F.size(out) - 1, F.lit(0)))).otherwise(F.concat(out, F.array(x)))
    return F.array_join(F.aggregate(F.split(path, "/"), start, step), "/")


def _tried(wanted: DataFrame, docs: DataFrame) -> DataFrame:
    """wanted (source, game, to, ...) and hit, the document that a path stands for there; null without one.

    A path has one best document for each source and game, source, game, and over all: each is a table with one row for
    a key, so a path that all sources have (a README) meets a link once, and no row of wanted becomes more. Where many
    links go to one path, Spark splits their side of the join.
    """
    there = docs.select(F.col("path").alias("to"), "source", "game", F.col("doc_id").alias("hit"))
    choices = [("source", "game"), ("source",), ("game",), ()]
    for i, by in enumerate(choices):
        wanted = wanted.join(there.groupBy("to", *by).agg(F.min("hit").alias(f"hit{i}")), ["to", *by], "left")
    return wanted.withColumn("hit", F.coalesce(*(f"hit{i}" for i in range(len(choices))))).drop(*(f"hit{i}" for i in range(len(choices))))


def resolve_links(links: DataFrame, docs: DataFrame, files: DataFrame | None = None) -> DataFrame:
    """links and resolved (a doc_id) or reason: missing, directory or excluded.

    docs: (doc_id, source, game, path). A target is looked up in its own source, then in any, of the same game first;
    a folder stands for its README. files (source, path) are those on disk; a target among them alone is excluded.
    """
    joined = normal_path(F.concat(F.regexp_replace("path", "[^/]*$", ""), F.col("target")))
    own = links.join(docs.select("source", "game").distinct(), "source", "left").withColumn("joined", joined)
    wanted = own.withColumn("try", F.explode(F.array(F.struct(F.lit(0).alias("as"), F.col("joined").alias("to")), F.struct(F.lit(1).alias("as"), F.concat_ws("/", "joined", F.lit("README.md")).alias("to")))))
    best = _tried(wanted.select("doc_id", "n", "source", "game", F.col("try.as").alias("as"), F.col("try.to").alias("to")), docs)
    best = best.where("hit is not null").groupBy("doc_id", "n").agg(F.min(F.struct("as", "hit")).alias("best")).select("doc_id", "n", F.col("best.hit").alias("resolved"))
    found = own.join(best, ["doc_id", "n"], "left")
    outside = F.col("joined").startswith("../") | (F.col("joined") == "..")
    resolved = F.when(~outside, F.col("resolved"))
    folder, exact = F.col("target").endswith("/"), F.lit(False)
    if files is not None:
        parents = files.select("source", F.explode(F.transform(F.sequence(F.lit(1), F.size(F.split("path", "/"))), lambda i: F.array_join(F.slice(F.split("path", "/"), 1, i), "/"))).alias("joined"), "path")
        known = parents.groupBy("source", "joined").agg(F.max(F.col("joined") == F.col("path")).alias("is_file"))
        found = found.join(known, ["source", "joined"], "left")
        folder, exact = folder | ~F.coalesce("is_file", F.lit(True)), F.coalesce("is_file", F.lit(False))
    reason = F.when(resolved.isNotNull(), F.lit(None)).when(outside, "missing").when(folder, "directory").when(exact, "excluded").otherwise("missing")
    return found.select(*links.columns, resolved.alias("resolved"), reason.alias("reason"))


def _relative(target: str, base: str) -> str:
    a, b = target.split("/"), [x for x in base.split("/")[:-1] if x]
    same = next((i for i, (x, y) in enumerate(zip(a, b)) if x != y), min(len(a) - 1, len(b)))
    return "/".join([".."] * (len(b) - same) + a[same:])


def rewrite_links(docs: DataFrame, resolved: DataFrame) -> DataFrame:
    """docs (doc_id, body, dest) with body pointing at destinations, and links_out: linked doc_ids in order, once each.

    resolved: (doc_id, n, raw, fragment, resolved, dest of the target), from resolve_links. Only links of one document
    come together.
    """
    per_doc = resolved.where("resolved is not null").groupBy("doc_id").agg(F.sort_array(F.collect_list(F.struct("n", "raw", "resolved", "target_dest", "fragment"))).alias("links"))

    def rewrite(bodies: pa.Array, dests: pa.Array, links: pa.Array) -> pa.Array:
        out = []
        for body, dest, own in zip(bodies.to_pylist(), dests.to_pylist(), links.to_pylist()):
            to = {x["raw"]: _relative(x["target_dest"], dest or "") + (x["fragment"] or "") for x in own or []}
            lines = (body or "").split("\n")
            for n, a, b in reversed(list(_spots(lines))):
                if lines[n][a:b] in to:
                    lines[n] = lines[n][:a] + to[lines[n][a:b]] + lines[n][b:]
            out.append(None if body is None else "\n".join(lines))
        return pa.array(out, pa.string())

    udf = F.arrow_udf(rewrite, "string")
    joined = docs.join(per_doc, "doc_id", "left")
    out = F.array_distinct(F.coalesce(F.transform("links", lambda x: x["resolved"]), F.array().cast("array<string>")))
    return joined.withColumn("body", udf("body", "dest", "links")).withColumn("links_out", out).drop("links")
