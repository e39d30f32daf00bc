"""Lookup of records: exact keys first, then BM25 over records, then over scripts."""

from __future__ import annotations

from typing import NamedTuple

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from ..functions import text as T
from . import lexical
from .filters import EVERY_SCOPE

#: Weights of fields, and the score of an exact hit.
RECORD_WEIGHTS = {"editor_id": 4.0, "editor_id_split": 3.0, "name_en": 3.0, "record_type": 1.0}
SCRIPT_WEIGHTS = {"name": 5.0, "name_split": 4.0, "text": 1.0}
EXACT = 100.0


class Index(NamedTuple):
    """Postings that a query can hit, and the statistics of the whole index."""

    postings: DataFrame
    stats: DataFrame


def record_fields() -> dict[str, Column]:
    return {"editor_id": F.col("editor_id"), "editor_id_split": T.split_identifier(F.col("editor_id")), "name_en": F.col("name_en"), "record_type": F.col("record_type")}


def script_fields() -> dict[str, Column]:
    return {"name": F.col("name"), "name_split": T.split_identifier(F.col("name")), "text": F.col("text")}


def exact_key(query: Column) -> Column:
    """Whether a record is what the query names: form id of 6 to 8 hex digits, form key with a colon, or editor id; case aside."""
    q = F.trim(query)
    bare = F.regexp_replace(q, "(?i)^0x", "")
    by_form = bare.rlike("^[0-9A-Fa-f]{6,8}$") & (F.upper("form_id") == F.upper(bare))
    by_key = q.contains(":") & (F.upper("form_key") == F.upper(q))
    by_editor = q.rlike("^[A-Za-z_][A-Za-z0-9_]*$") & (F.upper("editor_id") == F.upper(q))
    return F.coalesce(by_form, F.lit(False)) | F.coalesce(by_key, F.lit(False)) | F.coalesce(by_editor, F.lit(False))


def scanned(rows: DataFrame, fields: dict[str, Column], phrases: DataFrame) -> Index:
    """The index of a table that has none: one pass for its statistics, one for the tokens of the phrases."""
    return Index(lexical.postings_of(rows, "path", fields, phrases), lexical.corpus_stats(lexical.row_lengths(rows, "path", fields)))


def find(
    records: DataFrame, scripts: DataFrame | None, query: str, limit: int = 20, game: str | None = None, record_type: str | None = None, plugin: str | None = None, kind: str = "any", strict: bool = False,
    record_index: Index | None = None, script_index: Index | None = None,
) -> DataFrame:
    """(path, arm, label, score, rank): exact hits, then records, then scripts, each path once, limit in all.

    strict lets the exact arm ignore kind, record type and plugin, as lookups by key are often meant. Statistics are
    those of all records or scripts; filters act on the hits. Without a stored index the tables are scanned.
    """
    spark = records.sparkSession
    asked = spark.createDataFrame([(0, query)], "query_id int, q string")
    phrases = lexical.query_phrases(asked, "query_id", F.col("q"))
    scope = F.col("game").isin(game, EVERY_SCOPE) if game else F.lit(True)
    narrow = (F.col("record_type") == record_type if record_type else F.lit(True)) & (F.lower("plugin") == plugin.lower() if plugin else F.lit(True))
    arms: list[DataFrame] = []
    hits = lambda df, arm, label: df.select("path", F.lit(arm).alias("arm"), F.col(label).alias("label"), "score")
    if strict or kind in ("any", "record"):
        exact = records.where(exact_key(F.lit(query)) & scope & (F.lit(True) if strict else narrow))
        arms.append(hits(exact.withColumn("score", F.lit(EXACT)), 0, "editor_id"))
    if kind in ("any", "record"):
        index = record_index or scanned(records, record_fields(), phrases)
        scored = lexical.bm25(index.postings, index.stats, phrases, RECORD_WEIGHTS)
        arms.append(hits(records.where(scope & narrow).join(scored.withColumnRenamed("row_id", "path"), "path"), 1, "editor_id"))
    if scripts is not None and kind in ("any", "script") and not record_type and not plugin:
        index = script_index or scanned(scripts, script_fields(), phrases)
        scored = lexical.bm25(index.postings, index.stats, phrases, SCRIPT_WEIGHTS)
        arms.append(hits(scripts.where(scope).join(scored.withColumnRenamed("row_id", "path"), "path"), 2, "name"))
    found = arms[0]
    for arm in arms[1:]:
        found = found.unionByName(arm)
    order = (F.asc("arm"), F.desc(F.round("score", 9)), F.asc("path"))
    once = found.withColumn("n", F.row_number().over(W.partitionBy("path").orderBy("arm"))).where("n = 1").drop("n")
    first = once.orderBy(*order).limit(limit)
    return first.withColumn("rank", F.row_number().over(W.orderBy(*order)))


def stats(records: DataFrame, scripts: DataFrame) -> DataFrame:
    """(source_set, game, n_records, n_scripts, n_types, n_named) of every set."""
    r = records.select("source_set", "game", F.lit(1).alias("r"), F.lit(0).alias("s"), "record_type", (F.col("name_en") != "").alias("named"))
    s = scripts.select("source_set", "game", F.lit(0).alias("r"), F.lit(1).alias("s"), F.lit(None).cast("string").alias("record_type"), F.lit(False).alias("named"))
    return r.unionByName(s).groupBy("source_set", "game").agg(F.sum("r").alias("n_records"), F.sum("s").alias("n_scripts"), F.countDistinct("record_type").alias("n_types"), F.count_if("named").alias("n_named"))
