"""Line dedup by a log-template tree: recurring line templates are dropped from documents."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import broadcast_if_small, saved

VARIABLE = "<*>"
#: A token with a digit, in a text whose tokens stand between single spaces and line ends.
_WITH_DIGIT = r"(?<![^ \n])[^ \n0-9]*+[0-9][^ \n]*"


def _text() -> Column:
    return F.coalesce(F.col("text").cast("string"), F.lit(""))


def _lines(docs: DataFrame, depth: int) -> DataFrame:
    """(text_key, at, n, leaf, line_key, line) of each line with words; at: its place, n: its token count, line: its tokens.

    Tokens with a digit are variable fields. The leaf of a line is its place in the tree: token count, then the
    first tokens. Texts are told apart by a hash, so exact copies are one text. A text is normalised as a whole, before
    it is cut into lines.
    """
    text = _text()
    gaps = text.contains("  ")
    for other in "\t\x0b\x0c\r":
        gaps = gaps | text.contains(other)
    spaced = F.when(gaps, F.regexp_replace(text, r"[\x20\x09\x0B-\x0D]+", " ")).otherwise(text)
    masked = F.when(text.rlike("[0-9]"), F.regexp_replace(spaced, _WITH_DIGIT, VARIABLE)).otherwise(spaced)
    lines = docs.select(F.xxhash64(text).alias("text_key"), F.posexplode(F.split(masked, "\n")).alias("at", "line"))
    lines = lines.select("text_key", "at", F.trim("line").alias("line")).where("line <> ''")
    lines = lines.withColumn("n", F.length("line") - F.length(F.replace("line", F.lit(" "), F.lit(""))) + 1)
    leaf = F.xxhash64("n", F.substring_index("line", " ", depth))
    return lines.select("text_key", "at", "n", leaf.alias("leaf"), F.xxhash64("line").alias("line_key"), "line")


def _templates(lines: DataFrame, spots: DataFrame, depth: int, similarity: float, min_texts: int) -> DataFrame:
    """(line_key, template): the templates that a line of a busy leaf fits. spots: distinct (text_key, leaf, line_key, n)."""
    counts = saved(spots.groupBy("leaf", "line_key", "n").agg(F.count("*").alias("texts")), "counts")
    busy = counts.groupBy("leaf").agg(F.sum("texts").alias("total")).where(F.col("total") >= min_texts)
    wanted = saved(counts.join(busy, "leaf"), "wanted")
    keys = broadcast_if_small(wanted.select("line_key"))
    bodies = lines.select("line_key", "line").join(keys, "line_key", "left_semi").distinct()
    # the leading tokens are those of the leaf, and need no counts
    tokens = F.split("line", " ")
    tails = bodies.select("line_key", F.transform(F.slice(tokens, depth + 1, F.greatest(F.size(tokens) - depth, F.lit(0))), lambda t: F.xxhash64(t)).alias("tail"))
    fields = saved(wanted.join(tails, "line_key").select("leaf", "line_key", "n", "texts", "total", F.posexplode("tail").alias("i", "token")), "fields")
    held = fields.groupBy("leaf", "i", "token", "total").agg(F.sum("texts").alias("held"))
    held = held.select("leaf", "i", "token", (F.col("held") >= min_texts).alias("frequent"), (2 * F.col("held") > F.col("total")).alias("major")).where("frequent OR major")
    spot = F.when(F.col("frequent"), F.xxhash64("i", "token")), F.when(F.col("frequent"), F.xxhash64("token", "i"))
    kept = fields.join(held, ["leaf", "i", "token"]).groupBy("line_key").agg(
        F.count_if("frequent").alias("of_frequent"), F.count_if("major").alias("of_major"), F.bit_xor(spot[0]).alias("one"), F.bit_xor(spot[1]).alias("two")
    )
    every = wanted.select("leaf", "line_key", "n").join(kept, "line_key", "left")
    fits = lambda hits: F.least("n", F.lit(depth)) + F.coalesce(hits, F.lit(0)) >= similarity * F.col("n")
    of_frequent = F.when(fits("of_frequent"), F.xxhash64("leaf", F.lit(1), "one", "two"))
    of_major = F.when(fits("of_major"), F.xxhash64("leaf", F.lit(0)))
    return every.select("line_key", F.explode(F.array_compact(F.array(of_frequent, of_major))).alias("template"))


def recurring_lines(docs: DataFrame, depth: int = 3, similarity: float = 0.8, min_texts: int = 5) -> DataFrame:
    """(text_key, at, n): the lines that fit a template which recurs in min_texts different texts or more.

    A leaf holds many templates. In one kind, the tokens that stand at their position in min_texts of the leaf's lines
    stay and the others are variable fields: lines that recur word for word are always such a template, whatever else
    their leaf holds. Beside these, the leaf's tokens that more than half of its lines share are a template too. A line
    fits a template if similarity of its positions, or more, hold tokens of the template.
    """
    lines = saved(_lines(docs, depth), "lines", compression="zstd")
    spots = lines.select("text_key", "leaf", "line_key", "n").distinct()
    templates = saved(_templates(lines, spots, depth, similarity, min_texts), "templates")
    held_by = templates.join(lines.select("text_key", "line_key"), "line_key").select("template", "text_key").distinct()
    often = held_by.groupBy("template").agg(F.count("*").alias("texts")).where(F.col("texts") >= min_texts)
    recurring = saved(templates.join(often, "template", "left_semi").select("line_key").distinct(), "recurring")
    return lines.select("text_key", "at", "n", "line_key").join(broadcast_if_small(recurring), "line_key", "left_semi").drop("line_key")


def _cut(docs: DataFrame, depth: int, similarity: float, min_texts: int) -> DataFrame:
    """(row, text, n_lines, n_dropped) of each row of docs."""
    recurring = recurring_lines(docs, depth, similarity, min_texts)
    # copies of a text bring its lines several times
    spots = recurring.groupBy("text_key").agg(F.collect_set("at").alias("cut"))
    cuts = saved(spots, "cuts")
    own = docs.select(F.struct(*(F.col(f"`{c}`") for c in docs.columns)).alias("row"), F.xxhash64(_text()).alias("text_key"))
    joined = own.join(cuts.hint("merge"), "text_key", "left").withColumn("t", F.col("row.text").cast("string"))
    left = F.filter(F.split("t", "\n"), lambda line, i: ~F.array_contains("cut", i))
    cleaned = F.when(F.col("cut").isNull(), F.col("t")).otherwise(F.array_join(left, "\n"))
    n_lines = F.coalesce(F.length("t") - F.length(F.replace("t", F.lit("\n"), F.lit(""))) + 1, F.lit(0)).cast("long")
    n_dropped = F.when(F.col("cut").isNull(), 0).otherwise(F.size("cut")).cast("long")
    return joined.select("row", cleaned.alias("text"), n_lines.alias("n_lines"), n_dropped.alias("n_dropped"))


def drop_recurring_lines(docs: DataFrame, depth: int = 3, similarity: float = 0.8, min_texts: int = 5) -> DataFrame:
    """docs with recurring lines cut from text, and the columns n_lines and n_dropped.

    docs needs text; other columns stay as they are, but for older ones named n_lines or n_dropped. Recurring lines go
    wherever they stand, so a text of nothing else becomes empty. Blank lines always stay. Null stays
    null and has no lines; an empty text has one line. Exact copies count as one text and are treated alike, and
    repeated rows stay repeated. An empty table gives an empty result.
    """
    kept = [F.col("text") if c == "text" else F.col("row").getField(c).alias(c) for c in docs.columns if c not in ("n_lines", "n_dropped")]
    return _cut(docs, depth, similarity, min_texts).select(*kept, "n_lines", "n_dropped")


def without_recurring_lines(docs: DataFrame, depth: int = 3, similarity: float = 0.8, min_texts: int = 5) -> DataFrame:
    """As drop_recurring_lines, with the columns of docs alone, whatever they are called."""
    kept = [F.col("text") if c == "text" else F.col("row").getField(c).alias(c) for c in docs.columns]
    return _cut(docs, depth, similarity, min_texts).select(*kept)
