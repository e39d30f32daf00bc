"""Scans: manifests, routed text files, record and script trees, headers."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from ..functions import records as R
from ..functions import text as T
from . import heads

BOM = "﻿"


def read_manifest(spark: SparkSession, path: str) -> dict:
    """The routing manifest; byte-order marks are dropped, sources and mappings must be there, entries without source go."""
    import json

    raw = spark.read.text(path, wholetext=True).first()[0]
    found = json.loads(raw.lstrip(BOM))
    missing = {"sources", "mappings"} - set(found)
    if missing:
        raise ValueError(f"manifest lacks {', '.join(sorted(missing))}")
    found = {"output_dir": "docs", "global_exclude": [], "duplicates": []} | found
    found["mappings"] = [m for m in found["mappings"] if "source" in m]
    return found


def read_source_sets(spark: SparkSession, path: str) -> tuple[list[dict], list[dict]]:
    """Source sets whose folder is there (name, root, game, kind, plugin, note), and the sets that the manifest says are skipped.

    None on disk is an error; a missing folder is reported and left out.
    """
    import json
    import logging

    found = json.loads(spark.read.text(path, wholetext=True).first()[0].lstrip(BOM))
    sets = []
    for entry in found.get("sets", []):
        folder = spark._jvm.org.apache.hadoop.fs.Path(entry["root"])
        if folder.getFileSystem(spark._jsc.hadoopConfiguration()).exists(folder):
            sets.append({k: entry.get(k) for k in ("name", "root", "game", "kind", "plugin", "note")})
        else:
            logging.getLogger(__name__).warning("source set %s is missing: %s", entry["name"], entry["root"])
    if not sets:
        raise ValueError("no source set is there")
    return sets, found.get("skipped", [])


def normalised(text: Column) -> Column:
    """Without a byte-order mark, and with line ends as \\n."""
    return F.replace(F.regexp_replace(text, f"^{BOM}", ""), F.lit("\r\n"), F.lit("\n"))


def read_texts(spark: SparkSession, root: str) -> DataFrame:
    """(path, text) of all files below root, path relative to it; without byte-order marks, line ends as \\n."""
    base = root.rstrip("/") + "/"
    rows = spark.read.option("recursiveFileLookup", True).text(root, wholetext=True).select(F.col("_metadata.file_path").alias("file"), F.col("value").alias("text"))
    return rows.select(F.url_decode(F.substring_index("file", base, -1)).alias("path"), normalised(F.col("text")).alias("text"))


def read_cases(spark: SparkSession, path: str) -> DataFrame:
    """Evaluation cases, one JSON object for each line: q, expect, filters; blank lines are skipped."""
    return spark.read.schema("q string, expect array<string>, filters map<string,string>").json(path).where("q is not null")


def mapping_rows(spark: SparkSession, mappings: list[dict], global_exclude: list[str] | None = None) -> DataFrame:
    """(pos, source, pattern, target, rename, include_txt, is_glob, prefix, regex, exclude): the position is the priority."""
    rows = [
        (i, m["source"], m["from"], m.get("to", ""), m.get("rename"), bool(m.get("include_txt")), any(c in m["from"] for c in "*?["), T.literal_prefix(m["from"]), T.glob_regex(m["from"]),
         "|".join(T.name_regex(p) for p in [*(global_exclude or []), *m.get("exclude", [])]) or None)
        for i, m in enumerate(mappings)
    ]
    return spark.createDataFrame(rows, "pos int, source string, pattern string, target string, rename string, include_txt boolean, is_glob boolean, prefix string, regex string, exclude string")


def route(files: DataFrame, mappings: DataFrame) -> DataFrame:
    """(source, path, pos, dest): each file claimed by the first mapping that matches and doesn't exclude it.

    files: (source, path). The manifest is a parameter of the job, so it goes to every task. Only .md files are routed,
    and .txt where the mapping asks for them. {name}, {stem} and {parent} of a rename are filled in; {parent} drops the
    folders below the pattern's literal prefix.
    """
    is_txt = F.lower("path").endswith(".txt")
    kind = F.lower("path").endswith(".md") | (is_txt & F.col("include_txt"))
    excluded = F.coalesce(F.rlike(F.col("path"), F.col("exclude")), F.lit(False))
    met = files.join(F.broadcast(mappings), "source").where(F.rlike(F.col("path"), F.col("regex"))).where(kind & ~excluded)
    claimed = met.withColumn("n", F.row_number().over(W.partitionBy("source", "path").orderBy("pos"))).where("n = 1")
    below = F.when(F.col("is_glob"), F.expr("substring(path, if(prefix = '', 1, length(prefix) + 2))")).otherwise(F.substring_index("path", "/", -1))
    name = F.substring_index("path", "/", -1)
    stem = F.regexp_replace(name, r"\.[^.]*$", "")
    parent = F.element_at(F.split(F.concat(F.lit("/"), F.col("path")), "/"), -2)
    renamed = F.replace(F.replace(F.replace(F.col("rename"), F.lit("{name}"), name), F.lit("{stem}"), stem), F.lit("{parent}"), parent)
    final = F.coalesce(renamed, name)
    final = F.when(is_txt & ~final.endswith(".md"), F.concat(final, F.lit(".md"))).otherwise(final)
    folder = F.when(F.col("rename").contains("{parent}"), "").otherwise(F.regexp_replace(below, "[^/]*$", ""))
    dest = F.regexp_replace(F.concat(F.col("target"), F.lit("/"), folder, final), "/+", "/")
    return claimed.select("source", "path", "pos", F.regexp_replace(dest, "^/", "").alias("dest"))


def collisions(routed: DataFrame) -> DataFrame:
    """(dest, paths): destinations that more than one file has; routing is wrong unless this is empty."""
    found = routed.groupBy("dest").agg(F.sort_array(F.collect_list(F.concat_ws(":", "source", "path"))).alias("paths"))
    return found.where(F.size("paths") > 1)


def header_end(lines: Column) -> Column:
    """The place of the line that closes the header, from 1; null without a header."""
    opened = F.trim(F.element_at(lines, 1)) == "---"
    return F.when(opened, F.array_min(F.filter(F.sequence(F.lit(2), F.greatest(F.size(lines), F.lit(2))), lambda i: F.trim(F.get(lines, i - 1)) == "---")))


def with_header(rows: DataFrame, text: str = "text") -> DataFrame:
    """rows and header (map from key to JSON value, or raw text), body (without leading line ends).

    Without an opening and a closing --- the header is empty and the body is the whole text.
    """
    found = T.let(F.split(text, "\n"), lambda lines: T.let(header_end(lines), lambda end: _parsed(F.col(text), lines, end)))
    return rows.withColumn("parsed_", found).withColumns({"header": F.col("parsed_.header"), "body": F.col("parsed_.body")}).drop("parsed_")


def _parsed(text: Column, lines: Column, end: Column) -> Column:
    """struct(header, body) of a text's lines and the place where its header ends."""
    key_value = F.filter(F.slice(lines, 2, F.greatest(F.coalesce(end, F.lit(2)) - 2, F.lit(0))), lambda x: x.rlike(r"^[A-Za-z_][A-Za-z0-9_-]*:"))
    pairs = F.transform(key_value, lambda x: F.struct(F.regexp_extract(x, r"^([^:]*):\s*(.*)$", 1).alias("k"), F.regexp_extract(x, r"^([^:]*):\s*(.*)$", 2).alias("v")))
    later = lambda pairs, i: F.slice(pairs, i + 2, F.greatest(F.size(pairs), F.lit(1)))
    latest = T.let(pairs, lambda pairs: F.map_from_entries(F.filter(pairs, lambda p, i: ~F.exists(later(pairs, i), lambda q: q["k"] == p["k"]))))
    header = F.when(end.isNull(), F.create_map().cast("map<string,string>")).otherwise(latest)
    rest = F.array_join(F.slice(lines, F.coalesce(end, F.lit(0)) + 1, F.greatest(F.size(lines), F.lit(1))), "\n")
    body = F.when(end.isNull(), text).otherwise(F.regexp_replace(rest, "^\n+", ""))
    return F.struct(header.alias("header"), body.alias("body"))


def header_value(key: str) -> Column:
    """A header value as text: JSON strings without quotes, null for JSON null."""
    raw = F.try_element_at("header", F.lit(key))
    return F.when(raw == "null", F.lit(None).cast("string")).when(raw.rlike(r'^".*"\s*$'), F.get_json_object(F.concat(F.lit('{"v":'), raw, F.lit("}")), "$.v")).otherwise(raw)


def record_identity(path: Column) -> Column:
    """Identity of a record file from its name, or from its folder's for RecordData.yaml; null for other files.

    struct of editor_id, form_id (upper case), plugin, record_type (the first folder).
    """
    name = F.substring_index(path, "/", -1)
    folder = F.element_at(F.split(F.concat(F.lit("//"), path), "/"), -2)
    ident = F.when(name == "RecordData.yaml", folder).otherwise(F.regexp_replace(name, r"\.yaml$", ""))
    pattern = r"^(?:(.*) - )?([0-9A-Fa-f]{6,8})_(.+)$"
    part = lambda i: F.regexp_extract(ident, pattern, i)
    kind = F.when(path.contains("/"), F.substring_index(path, "/", 1)).otherwise("")
    known = name.endswith(".yaml") & (name != "GroupRecordData.yaml") & ident.rlike(pattern)
    return F.when(known, F.struct(F.trim(part(1)).alias("editor_id"), F.upper(part(2)).alias("form_id"), part(3).alias("plugin"), kind.alias("record_type")))


def as_text(content: Column) -> Column:
    """Bytes as text; what is no UTF-8, such as a character that is cut, is replaced."""
    return F.make_valid_utf8(content.cast("string"))


def scan_tree(spark: SparkSession, root: str, name_glob: str, head_bytes: int | None = None) -> DataFrame:
    """(path, size, mtime[, head]) of the files below root that match; without head the contents are not read.

    Heads are read by ranges, so of a long file no more than head_bytes move. A store that only Spark's own readers can
    open has no ranges: its files are read whole and cut, and empty ones, which those readers leave out, are missing.
    """
    if head_bytes:
        try:
            heads.opened(root)
        except ValueError:
            pass
        else:
            heads.register(spark)
            return heads.scan(spark, root, name_glob, head_bytes)
    base = root.rstrip("/") + "/"
    found = spark.read.format("binaryFile").option("recursiveFileLookup", True).option("pathGlobFilter", name_glob).load(root)
    columns = [F.substring_index("path", base, -1).alias("path"), F.col("length").alias("size"), F.unix_timestamp("modificationTime").alias("mtime")]
    if head_bytes:
        columns.append(as_text(F.substring("content", 1, head_bytes)).alias("head"))
    return found.select(*columns)


def read_records(spark: SparkSession, root: str, source_set: str, game: str, head_bytes: int = 8192) -> DataFrame:
    """Records below root: identity from names, English display name from the first bytes of each file."""
    files = scan_tree(spark, root, "*.yaml", head_bytes).withColumn("id", record_identity(F.col("path"))).where("id is not null")
    plugin_key = F.concat_ws(":", "id.form_id", "id.plugin")
    return files.select("id.editor_id", "id.form_id", "id.plugin", plugin_key.alias("form_key"), "id.record_type", F.lit(game).alias("game"), F.lit(source_set).alias("source_set"), R.display_name(F.col("head")).alias("name_en"), "path", "size", "mtime")


def read_scripts(spark: SparkSession, root: str, source_set: str, game: str) -> DataFrame:
    """Script files below root, with their whole text; bytes that are no UTF-8 are replaced."""
    found = scan_tree(spark, root, "*.[pP][sS][cC]", (1 << 31) - 1)
    name = F.regexp_replace(F.substring_index("path", "/", -1), r"\.[^.]*$", "")
    return found.select(name.alias("name"), F.lit(game).alias("game"), F.lit(source_set).alias("source_set"), "path", "size", "mtime", F.col("head").alias("text"))
