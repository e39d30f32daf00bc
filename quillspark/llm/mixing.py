"""Mixing sources to target weights by hash thresholds found in histograms."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from .common import SPACES, saved, words_between

#: Bits of the hash and of a histogram level; three levels resolve a threshold to one hash value.
LEVELS, LEVEL_BITS = 3, 16


def _size() -> Column:
    return F.size(words_between(F.col("text"), SPACES)).cast("long")


def _hash() -> Column:
    """48 bits of a digest of id and text, the same in every run."""
    whole = F.concat_ws("|", F.coalesce(F.col("doc_id").cast("string"), F.lit("")), F.coalesce(F.col("text").cast("string"), F.lit("")))
    return F.conv(F.substring(F.md5(whole), 1, LEVELS * LEVEL_BITS // 4), 16, 10).cast("long")


def targets(sizes: DataFrame, weights: Sequence[int], max_epochs: int) -> DataFrame:
    """source, source_size, target of (source, source_size).

    Targets are min(max_epochs * size, level * weight), with the level at which they sum to all sizes. In the order
    of max_epochs * size / weight, a source is capped if that is below the level left by those before it.
    """
    by_name = W.orderBy(F.col("source").asc_nulls_last())
    weight = F.element_at(F.array(*(F.lit(w) for w in weights)), (F.pmod(F.row_number().over(by_name) - 1, F.lit(len(weights))) + 1).cast("int"))
    ranked = sizes.withColumn("weight", weight.cast("long")).withColumn("most", max_epochs * F.col("source_size"))
    ratio = F.col("most").cast("double") / F.col("weight")
    order = W.orderBy(ratio, F.col("source").asc_nulls_last())
    before = F.coalesce(F.sum("most").over(order.rowsBetween(W.unboundedPreceding, -1)), F.lit(0))
    on = F.sum("weight").over(order.rowsBetween(0, W.unboundedFollowing))
    everything = F.sum("source_size").over(W.orderBy(F.lit(1)).rowsBetween(W.unboundedPreceding, W.unboundedFollowing))
    left = ranked.withColumn("level", (everything - before).cast("double") / on).withColumn("ratio", ratio)
    first = F.when(F.col("ratio") > F.col("level"), F.struct("ratio", F.col("source").isNull(), "source", "level"))
    final = F.min(first).over(W.orderBy(F.lit(1)).rowsBetween(W.unboundedPreceding, W.unboundedFollowing))["level"]
    open_ = F.col("ratio") > F.col("final")
    target = F.when(open_, F.col("final") * F.col("weight")).otherwise(F.col("most").cast("double"))
    return left.withColumn("final", final).select("source", "source_size", target.alias("target"))


def _thresholds(rows: DataFrame, wanted: DataFrame) -> DataFrame:
    """source, source_size, target, whole, threshold: a document is taken whole times, once more if its hash is below threshold."""
    whole = F.when(F.col("source_size") > 0, F.floor(F.col("target") / F.col("source_size"))).otherwise(0).cast("long")
    state = wanted.withColumn("whole", whole).withColumn("rest", F.col("target") - F.col("whole") * F.col("source_size")).withColumn("threshold", F.lit(0).cast("long"))
    state = saved(state, "targets")
    for level in range(1, LEVELS + 1):
        shift = LEVEL_BITS * (LEVELS - level)
        known = state.select(F.col("source").alias("own"), F.col("rest"), F.col("threshold").alias("from"))
        inside = rows.join(known, F.col("source").eqNullSafe(F.col("own")))
        inside = inside.where(F.shiftright("h", shift + LEVEL_BITS) == F.shiftright("from", shift + LEVEL_BITS)) if level > 1 else inside
        sums = inside.groupBy("source", "rest", F.shiftright("h", shift).alias("bucket")).agg(F.sum("size").alias("words"))
        upto = W.partitionBy("source").orderBy("bucket").rowsBetween(W.unboundedPreceding, 0)
        over = sums.withColumn("sum", F.sum("words").over(upto)).where(F.col("sum") > F.col("rest"))
        edge = over.groupBy("source").agg(F.min(F.struct("bucket", (F.col("rest") - F.col("sum") + F.col("words")).alias("rest"), "words")).alias("edge"))
        edge = edge.select(F.col("source").alias("own"), "edge")
        # the last bucket is one hash: it is taken if that is nearer to the target than to leave it
        more = F.when((F.lit(level) == LEVELS) & (F.col("edge.words") < 2 * F.col("edge.rest")), 1).otherwise(0)
        state = state.join(edge, F.col("source").eqNullSafe(F.col("own")), "left").select(
            "source", "source_size", "target", "whole", F.coalesce("edge.rest", "rest").alias("rest"), F.coalesce(F.shiftleft("edge.bucket", shift) + more, "threshold").alias("threshold")
        )
        state = saved(state, "thresholds")
    return state


def _state(docs: DataFrame, weights: Sequence[int], max_epochs: int) -> tuple[DataFrame, DataFrame]:
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("source").cast("string").alias("source"), _size().alias("size"), _hash().alias("h"))
    rows = saved(rows, "sizes")
    sizes = rows.groupBy("source").agg(F.sum("size").alias("source_size"))
    return rows, _thresholds(rows, targets(sizes, weights, max_epochs))


def _joined(rows: DataFrame, state: DataFrame) -> DataFrame:
    """rows (source, h) with their source's state; sources by the hundred thousand are joined by a shuffle."""
    own = state.select(F.col("source").alias("own"), "source_size", "target", "whole", "threshold")
    own = F.broadcast(own) if own.count() <= 10_000 else own
    times = F.col("whole") + F.when(F.col("h") < F.col("threshold"), 1).otherwise(0)
    return rows.join(own, F.col("source").eqNullSafe(F.col("own"))).withColumn("times", times.cast("long"))


def mix_sources(docs: DataFrame, weights: Sequence[int] = (5, 2, 1), max_epochs: int = 3) -> DataFrame:
    """How often the mix takes each row of docs: doc_id, size, source_size, target, taken (size times repeats).

    docs needs doc_id, text and source; extra columns are ignored. Sources by code point, null last, weigh weights in
    turn and share the words of all; no source passes max_epochs times its own words. A source takes each document
    the whole part of target / size times, and once more those with the smallest hashes up to where their words are
    nearest to the rest.

    Null and empty texts have size 0 and take nothing. Repeated rows share a hash and are taken alike. A source
    without words has target 0. An empty table gives an empty result. Reruns take the same documents.
    """
    rows, state = _state(docs, weights, max_epochs)
    return _joined(rows, state).select("doc_id", "size", "source_size", "target", (F.col("size") * F.col("times")).alias("taken"))


def take_mix(docs: DataFrame, weights: Sequence[int] = (5, 2, 1), max_epochs: int = 3) -> DataFrame:
    """The rows of docs as often as the mix takes them, with their own columns; rows without words stay once."""
    _, state = _state(docs, weights, max_epochs)
    row = F.struct(*(F.col(f"`{c}`") for c in docs.columns)).alias("row")
    rows = docs.select(row, F.col("source").cast("string").alias("source"), _size().alias("size"), _hash().alias("h"))
    times = F.when(F.col("size") == 0, 1).otherwise(F.col("times"))
    taken = _joined(rows, state).withColumn("times", times).where("times > 0")
    return taken.select("row", F.explode(F.sequence(F.lit(1).cast("long"), "times")).alias("turn")).select("row.*")


#: The same rows in DuckDB.
ORACLE = r"""
WITH rows AS (
  SELECT doc_id, source, len(regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+'))::BIGINT AS size,
    ('0x' || substr(md5(coalesce(doc_id::VARCHAR, '') || '|' || coalesce(text, '')), 1, 12))::BIGINT AS h FROM documents),
sizes AS (SELECT source, sum(size)::BIGINT AS source_size FROM rows GROUP BY source),
weighed AS (
  SELECT *, [5, 2, 1][((row_number() OVER (ORDER BY source COLLATE "binary" NULLS LAST) - 1) % 3 + 1)::BIGINT]::BIGINT AS weight, 3 * source_size AS most FROM sizes),
levels AS (
  SELECT *, most::DOUBLE / weight AS ratio,
    ((sum(source_size) OVER () - coalesce(sum(most) OVER (ORDER BY most::DOUBLE / weight, source NULLS LAST ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0)))::DOUBLE
      / (sum(weight) OVER (ORDER BY most::DOUBLE / weight, source NULLS LAST ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING))::DOUBLE AS level FROM weighed),
first AS (SELECT level FROM levels WHERE ratio > level ORDER BY ratio, source NULLS LAST LIMIT 1),
final AS (
  SELECT source, source_size, CASE WHEN ratio > (SELECT level FROM first) THEN (SELECT level FROM first) * weight ELSE most::DOUBLE END AS target FROM levels),
ranked AS (
  SELECT doc_id, size, source_size, target, CASE WHEN source_size > 0 THEN floor(target / source_size) ELSE 0 END AS whole,
    target - CASE WHEN source_size > 0 THEN floor(target / source_size) ELSE 0 END * source_size AS rest,
    sum(size) OVER (PARTITION BY rows.source ORDER BY h RANGE BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW) AS upto, sum(size) OVER (PARTITION BY rows.source, h) AS own
  FROM rows JOIN final ON rows.source IS NOT DISTINCT FROM final.source)
SELECT doc_id, size, source_size, target, (size * (whole + CASE WHEN upto <= rest OR upto - own <= rest AND own < 2 * (rest - upto + own) THEN 1 ELSE 0 END))::BIGINT AS taken FROM ranked
"""
