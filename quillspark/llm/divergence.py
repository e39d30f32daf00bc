"""Source divergence audit: sorted arrays of (term, count) of two sources at a time, merged by galloping."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from .common import saved, text_slices

#: Shares are in parts of so many, counts are raised by so much, terms of fewer documents of a language are left out.
SCALE, PRIOR, LEAST_DOCS = 10**9, 2, 10
#: Kept terms of a block (what a task holds of a source), and sources whose arrays a task holds from each side.
BLOCK_TERMS, CHUNK = 50_000, 16

#: Bytes of terms: letters of ASCII, and all bytes of other characters.
_TERM = np.array([chr(b).isalpha() and b < 128 or b >= 128 for b in range(256)])


def _terms(texts: pa.Array) -> tuple[pa.Array, np.ndarray]:
    """Lower-cased terms of all texts, flat, and the text of each. Null: none."""
    texts = pc.fill_null(texts.cast(pa.large_string()), "")
    ends = np.cumsum(pc.binary_length(texts).to_numpy(zero_copy_only=False), dtype=np.int64)
    raw = np.frombuffer(b"".join(pc.cast(texts, pa.large_binary()).to_pylist()), np.uint8)
    inside = _TERM[raw]
    first = inside.copy()
    starts = np.concatenate([[0], ends[:-1]])
    first[1:] &= ~inside[:-1]
    edge = starts[starts < len(raw)]  # a term ends with its text
    first[edge] = inside[edge]
    begins = np.flatnonzero(first)
    letters = raw[inside]
    letters = np.where((letters >= 65) & (letters <= 90), letters + 32, letters).astype(np.uint8)
    kept_before = np.cumsum(inside) - inside
    offsets = np.append(kept_before[begins], len(letters)).astype(np.int64)
    terms = pa.Array.from_buffers(pa.large_string(), len(begins), [None, pa.py_buffer(offsets), pa.py_buffer(letters)])
    return terms, np.searchsorted(ends, begins, side="right")


COUNTS = "lang string, source string, term string, n long, docs long"


def _count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Occurrences and documents of each term by language and source, of one slice of texts at a time."""
    for part in text_slices(batches, "text", 4 << 20):
        terms, text = _terms(part.column("text"))
        if not len(terms):
            continue
        coded = terms.dictionary_encode()
        groups = pa.StructArray.from_arrays([part.column("lang"), part.column("source")], ["lang", "source"])
        names = list(dict.fromkeys(zip(*(c.to_pylist() for c in groups.flatten()))))
        number = {name: i for i, name in enumerate(names)}
        group = np.array([number[name] for name in zip(*(c.to_pylist() for c in groups.flatten()))], dtype=np.int64)
        kinds = len(coded.dictionary)
        in_text, times = np.unique(text * kinds + coded.indices.to_numpy(), return_counts=True)
        keys, where = np.unique(group[in_text // kinds] * kinds + in_text % kinds, return_inverse=True)
        of = keys // kinds
        yield pa.RecordBatch.from_arrays(
            [
                pa.array([names[i][0] for i in of.tolist()], pa.string()), pa.array([names[i][1] for i in of.tolist()], pa.string()), coded.dictionary.take(pa.array(keys % kinds)).cast(pa.string()),
                pa.array(np.bincount(where, times).astype(np.int64)), pa.array(np.bincount(where)),
            ], names=["lang", "source", "term", "n", "docs"],
        )


def _share(n: str, total: str) -> Column:
    """1 + floor(SCALE * (n + PRIOR) / total), three digits of base 1000 one after the other, so that nothing passes 64 bits."""
    rest, share = f"({n} + {PRIOR})", "1"
    for digit in (10**6, 10**3, 1):
        share += f" + ({rest} * 1000L div {total}) * {digit}L"
        rest = f"({rest} * 1000L % {total})"
    return F.expr(share)


def _shares(n: np.ndarray, total: int) -> np.ndarray:
    """The same of many counts."""
    rest, share = n.astype(np.int64) + PRIOR, np.ones(len(n), np.int64)
    for digit in (10**6, 10**3, 1):
        rest = rest * 1000
        share += rest // total * digit
        rest %= total
    return share


def _price(p: np.ndarray, q: np.ndarray) -> np.ndarray:
    return (p - q) ** 2 // (p + q)


def gallop(a: np.ndarray, b: np.ndarray, stride: int = 64) -> tuple[np.ndarray, np.ndarray]:
    """Places in a and in b, both sorted and each without repeats, of what they share.

    The shorter one goes in strides. For each the place in the longer one is found by steps that double from where the
    last stride ended, so a long stretch without a partner is passed in a few steps; within them all of it is searched.
    """
    if len(a) > len(b):
        y, x = gallop(b, a, stride)
        return x, y
    in_a, in_b, at = [np.empty(0, np.int64)], [np.empty(0, np.int64)], 0
    for i in range(0, len(a), stride):
        own = a[i : i + stride]
        step = stride
        while at + step < len(b) and b[at + step] < own[-1]:
            step *= 2
        place = at + np.searchsorted(b[at : at + step + 1], own)
        met = np.flatnonzero(b[np.minimum(place, len(b) - 1)] == own)
        in_a.append(i + met)
        in_b.append(place[met])
        at = int(place[-1])
        if at == len(b):
            break
    return np.concatenate(in_a), np.concatenate(in_b)


def divergence(a: tuple[np.ndarray, np.ndarray], b: tuple[np.ndarray, np.ndarray], total_a: int, total_b: int, terms: int) -> int:
    """Sum of (p - q)^2 / (p + q), each rounded down, over all terms of a block; a and b: sorted ids of terms, counts."""
    (ids_a, n_a), (ids_b, n_b) = a, b
    p, q = _shares(n_a, total_a), _shares(n_b, total_b)
    none_a, none_b = (int(_shares(np.zeros(1), t)[0]) for t in (total_a, total_b))
    x, y = gallop(ids_a, ids_b)
    only_a, only_b = np.ones(len(p), bool), np.ones(len(q), bool)
    only_a[x] = only_b[y] = False
    absent = terms - len(p) - len(q) + len(x)
    value = int(_price(p[x], q[y]).sum()) + int(_price(p[only_a], np.int64(none_b)).sum()) + int(_price(q[only_b], np.int64(none_a)).sum())
    return value + absent * ((none_a - none_b) ** 2 // (none_a + none_b))


PRICED = pa.schema([("lang", pa.string()), ("a", pa.int64()), ("b", pa.int64()), ("value", pa.int64())])


def _merge(left: pa.Table, right: pa.Table) -> pa.Table:
    """The pairs of a source of the left chunk and a later one of the right chunk, over one block of terms."""
    rows: list[list] = [[], [], [], []]
    held = []
    for side in (left, right):
        sources = []
        for r in side.select(["number", "total", "terms", "ids", "counts"]).to_pylist():
            arrays = tuple(np.frombuffer(r[c] or b"", k) for c, k in (("ids", np.int32), ("counts", np.int64)))
            sources.append((r["number"], r["total"], r["terms"], arrays))
        held.append(sources)
    for i, total_a, terms, a in held[0]:
        for j, total_b, _, b in held[1]:
            if i < j:
                for column, value in zip(rows, (left.column("lang")[0].as_py(), i, j, divergence(a, b, total_a, total_b, terms) if terms else 0)):
                    column.append(value)
    return pa.table([pa.array(c, f.type) for c, f in zip(rows, PRICED)], schema=PRICED)


def _arrays(table: pa.Table) -> pa.Table:
    """One row of sorted ids and their counts for a source and block."""
    order = pc.sort_indices(table.column("id"))
    raw = lambda c, k: table.column(c).take(order).to_numpy().astype(k).tobytes()
    first = {c: [table.column(c)[0].as_py()] for c in ("lang", "number", "block")}
    return pa.table({"lang": pa.array(first["lang"], pa.string()), "number": pa.array(first["number"], pa.int64()), "block": pa.array(first["block"], pa.int32()), "ids": pa.array([raw("id", np.int32)]), "counts": pa.array([raw("n", np.int64)])})


def audit(docs: DataFrame, top: int = 10, least_docs: int = LEAST_DOCS) -> DataFrame:
    """How the sources of each language differ in their terms: lang, source, part, item, value, rank.

    docs needs text, lang and source; extra columns are ignored. Terms are runs of ASCII letters, lower-cased, and of
    characters beyond ASCII; a language keeps those in least_docs of its documents or more, V in number. A kept term with n
    occurrences in a source, or in the whole language, has the share p = 1 + floor(10^9 * (n + 2) / (N + 2 * V)), N
    being all occurrences of kept terms there; two shares p, q differ by floor((p - q)^2 / (p + q)). Part pair: for a
    source and each other one of its language the sum over all kept terms. Part term: the terms with which a source is
    above its language, the top ones. rank goes by value, then by item.

    Null texts, languages and sources count as empty ones. A source without terms is compared like any other; without
    kept terms all values are 0. Repeated rows are documents of their own. An empty table gives an empty result. All
    arithmetic is exact while counts and N + 2 * V are below 9 * 10^15.

    Terms are counted in slices before they move. Kept terms get places in blocks of about BLOCK_TERMS by their hash; a
    source has one sorted array for each block, so a task holds CHUNK arrays from each side, however long the texts of
    a source are. The rows returned grow with the pairs of sources, as they are what is asked for.
    """
    empty = lambda c: F.coalesce(F.col(c).cast("string"), F.lit("")).alias(c)
    own = docs.select(empty("text"), empty("lang"), empty("source"))
    counted = own.mapInArrow(_count, COUNTS).groupBy("lang", "source", "term").agg(F.sum("n").alias("n"), F.sum("docs").alias("docs"))
    counted = saved(counted, "counts")
    kept = counted.groupBy("lang", "term").agg(F.sum("n").alias("of_lang"), F.sum("docs").alias("docs")).where(F.col("docs") >= least_docs).drop("docs")
    kept = saved(kept, "kept")
    langs = kept.groupBy("lang").agg(F.count("*").alias("v"), F.sum("of_lang").alias("n"))
    most = langs.agg(F.max("v").alias("v")).first()["v"] or 0
    blocks = max(1, -(-most // BLOCK_TERMS))
    kept = kept.withColumn("block", F.pmod(F.xxhash64("term"), F.lit(blocks)).cast("int"))
    kept = saved(kept.withColumn("id", F.row_number().over(W.partitionBy("lang", "block").orderBy("term"))), "terms")
    held = saved(counted.join(kept, ["lang", "term"]).select("lang", "source", "term", "n", "of_lang", "block", "id"), "held")
    totals = held.groupBy("lang", "source").agg(F.sum("n").alias("n"))
    number = F.row_number().over(W.partitionBy("lang").orderBy("source")).cast("long")
    groups = own.groupBy("lang", "source").agg(F.lit(0)).join(totals, ["lang", "source"], "left").join(langs.select("lang", "v", F.col("n").alias("of_lang")), "lang", "left")
    v = F.coalesce("v", F.lit(0).cast("long"))
    groups = groups.select("lang", "source", number.alias("number"), (F.coalesce("n", F.lit(0).cast("long")) + PRIOR * v).alias("total"), (F.coalesce("of_lang", F.lit(0).cast("long")) + PRIOR * v).alias("lang_total"))
    groups = saved(groups, "groups")
    return _pairs(held, kept, groups, blocks).unionByName(_tops(held, groups, top))


def _pairs(held: DataFrame, kept: DataFrame, groups: DataFrame, blocks: int) -> DataFrame:
    arrays = held.join(groups.select("lang", "source", "number"), ["lang", "source"]).groupBy("lang", "number", "block").applyInArrow(_arrays, "lang string, number long, block int, ids binary, counts binary")
    sizes = kept.groupBy("lang", "block").agg(F.count("*").alias("terms"))
    every = groups.select("lang", "number", "total", F.explode(F.sequence(F.lit(0), F.lit(blocks - 1))).alias("block"))
    every = every.join(sizes, ["lang", "block"], "left").join(arrays, ["lang", "number", "block"], "left")
    chunk = F.floor((F.col("number") - 1) / CHUNK).cast("int")
    last = groups.groupBy("lang").agg(F.floor((F.max("number") - 1) / CHUNK).cast("int").alias("last"))
    every = saved(every.join(last, "lang").withColumn("chunk", chunk), "arrays")
    columns = ["lang", "block", "number", "total", "terms", "ids", "counts"]
    left = every.select(*(F.col(c).alias(c) for c in columns), F.col("chunk").alias("i"), F.explode(F.sequence("chunk", "last")).alias("j"))
    right = every.select(*columns, F.explode(F.sequence(F.lit(0), "chunk")).alias("i"), F.col("chunk").alias("j"))
    key = ["lang", "block", "i", "j"]
    priced = left.groupBy(*key).cogroup(right.groupBy(*key)).applyInArrow(_merge, "lang string, a long, b long, value long")
    summed = priced.groupBy("lang", "a", "b").agg(F.sum("value").alias("value"))
    both = summed.select("lang", "value", F.explode(F.array(F.struct(F.col("a").alias("one"), F.col("b").alias("other")), F.struct(F.col("b").alias("one"), F.col("a").alias("other")))).alias("p")).select("lang", "value", "p.*")
    named = lambda as_number, as_name: groups.select("lang", F.col("number").alias(as_number), F.col("source").alias(as_name))
    rows = both.join(named("one", "source"), ["lang", "one"]).join(named("other", "item"), ["lang", "other"])
    return rows.select("lang", "source", F.lit("pair").alias("part"), "item", "value", F.row_number().over(W.partitionBy("lang", "source").orderBy(F.desc("value"), "item")).alias("rank"))


def _tops(held: DataFrame, groups: DataFrame, top: int) -> DataFrame:
    rows = held.join(groups, ["lang", "source"]).select("lang", "source", "term", _share("n", "total").alias("p"), _share("of_lang", "lang_total").alias("q")).where("p > q")
    priced = rows.select("lang", "source", F.lit("term").alias("part"), F.col("term").alias("item"), F.expr("((p - q) * (p - q)) div (p + q)").alias("value"))
    return priced.withColumn("rank", F.row_number().over(W.partitionBy("lang", "source").orderBy(F.desc("value"), "item"))).where(F.col("rank") <= top).select("lang", "source", "part", "item", "value", "rank")


#: The rows of op11 in DuckDB.
ORACLE = r"""
WITH d AS (SELECT row_number() OVER () AS id, coalesce(text, '') AS text, coalesce(lang, '') AS lang, coalesce(source, '') AS source FROM documents),
words AS (SELECT id, lang, source, unnest(regexp_extract_all(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x40\x5B-\x60\x7B-\x7F]+')) AS term FROM d),
kept AS (SELECT lang, term, count(*) AS of_lang FROM words GROUP BY ALL HAVING count(DISTINCT id) >= 10),
langs AS (SELECT lang, count(*) AS v, sum(of_lang) AS n FROM kept GROUP BY lang),
counts AS (SELECT lang, source, term, count(*) AS n FROM words SEMI JOIN kept USING (lang, term) GROUP BY ALL),
groups AS (SELECT DISTINCT lang, source FROM d),
totals AS (SELECT lang, source, coalesce(sum(c.n), 0) + 2 * coalesce(any_value(v), 0) AS total FROM groups LEFT JOIN counts c USING (lang, source) LEFT JOIN langs USING (lang) GROUP BY ALL),
shares AS (
  SELECT t.lang, t.source, k.term, coalesce(c.n, 0) AS n, 1 + (1000000000::HUGEINT * (coalesce(c.n, 0) + 2)) // total AS p, 1 + (1000000000::HUGEINT * (of_lang + 2)) // (l.n + 2 * v) AS q
  FROM totals t JOIN kept k USING (lang) JOIN langs l USING (lang) LEFT JOIN counts c ON c.lang = t.lang AND c.source = t.source AND c.term = k.term),
sums AS (SELECT a.lang, a.source, b.source AS item, sum(((a.p - b.p) * (a.p - b.p)) // (a.p + b.p)) AS value FROM shares a JOIN shares b ON a.lang = b.lang AND a.term = b.term AND a.source <> b.source GROUP BY ALL),
rows AS (
  SELECT x.lang, x.source, 'pair' AS part, y.source AS item, coalesce(value, 0)::BIGINT AS value
  FROM groups x JOIN groups y ON x.lang = y.lang AND x.source <> y.source LEFT JOIN sums s ON s.lang = x.lang AND s.source = x.source AND s.item = y.source
  UNION ALL SELECT lang, source, 'term', term, (((p - q) * (p - q)) // (p + q))::BIGINT FROM shares WHERE n > 0 AND p > q)
SELECT *, (row_number() OVER (PARTITION BY lang, source, part ORDER BY value DESC, item))::INTEGER AS rank FROM rows QUALIFY part = 'pair' OR rank <= 10
"""
