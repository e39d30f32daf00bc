"""Quality classifier: perplexity under an interpolated modified Kneser-Ney model of trusted text."""

from __future__ import annotations

import functools
import math
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
import pyarrow.compute as pc
import zstandard
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import broadcast_if_small, held, release, saved, text_slices

#: Grams are of ORDER code units of UTF-16, as they are: four of 16 bits fill a long.
BITS, ORDER = 16, 4
UNITS = 1 << BITS
#: A private-use code point that stands for a space after a word that repeats the word before it.
REPEAT = 0xF8F0
#: Bytes of text of which grams are made at once.
SLICE = 1 << 19


@functools.cache
def _spaces() -> np.ndarray:
    return np.array([chr(i).isspace() for i in range(UNITS)])


@functools.cache
def _weights() -> np.ndarray:
    return np.random.default_rng(7).integers(1, 1 << 62, UNITS, dtype=np.int64)


def grams(texts: list[str]) -> tuple[np.ndarray, np.ndarray]:
    """For each code unit of the texts the gram that ends with it, and each text's bounds (one more than texts).

    A space after a word that equals the word before it becomes a symbol of its own, so that the model sees repetition.
    Before a text stand ORDER - 1 zeros.
    """
    raw = [t.encode("utf-16-le", "surrogatepass") for t in texts]
    lengths = np.array([len(r) // 2 for r in raw], dtype=np.int64)
    bounds = np.concatenate([[0], np.cumsum(lengths)]).astype(np.int64)
    units = np.frombuffer(b"".join(raw), np.uint16)
    gaps = np.flatnonzero(_spaces()[units])
    if len(gaps) > 1:
        sums = np.concatenate([[0], np.cumsum(_weights()[units])])
        of = np.searchsorted(bounds, gaps, side="right") - 1
        words = sums[gaps] - sums[np.maximum(bounds[of], np.concatenate([[0], gaps[:-1] + 1]))]
        same = np.flatnonzero((words[1:] == words[:-1]) & (words[1:] != 0) & (of[1:] == of[:-1])) + 1
        units = units.copy()
        units[gaps[same]] = REPEAT
    place = np.arange(len(units)) + (ORDER - 1) * np.repeat(np.arange(1, len(texts) + 1), lengths)
    padded = np.zeros(len(units) + (ORDER - 1) * len(texts), dtype=np.uint64)
    padded[place] = units
    ids = padded[place]
    for back in range(1, ORDER):
        ids |= padded[place - back] << np.uint64(BITS * back)
    return ids.view(np.int64), bounds


def _count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(fold, gram, n) of each slice of (fold, text)."""
    held("", lambda: None)
    for part in text_slices(batches, "text", SLICE):
        ids, bounds = grams(pc.fill_null(part.column("text"), "").to_pylist())
        fold = np.repeat(part.column("fold").to_numpy(zero_copy_only=False).astype(bool), np.diff(bounds))
        for f in (0, 1):
            codes, values = pd.factorize(ids[fold] if f else ids[~fold])
            yield pa.RecordBatch.from_arrays([pa.array(np.full(len(values), f, np.int32)), pa.array(values, pa.int64()), pa.array(np.bincount(codes, minlength=len(values)), pa.int64())], names=["fold", "gram", "n"])


def _context(gram: str = "gram") -> Column:
    return F.shiftrightunsigned(gram, BITS)


def _suffix(order: int, gram: str = "gram") -> Column:
    """The last order units of a gram."""
    return F.col(gram).bitwiseAND(F.lit((1 << (BITS * order)) - 1))


def train(texts: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(fold, order, gram, alpha) and (fold, order, context, gamma) from texts (fold, text), one model for each fold.

    alpha is a gram's discounted share in its context, gamma what the context leaves to the order below. Lower orders
    count continuations: in how many contexts a gram goes on a longer one. All counts are tables dealt by gram or
    context; what comes to the driver are the 4 counts of counts of each order and fold, for the discounts.
    """
    counts = saved(texts.select("fold", "text").mapInArrow(_count, "fold int, gram long, n long").groupBy("fold", "gram").agg(F.sum("n").alias("n")), "counts")
    tables, own = [counts.withColumn("order", F.lit(ORDER))], counts
    for order in range(ORDER - 1, 0, -1):
        own = own.groupBy("fold", _suffix(order).alias("gram")).agg(F.count("*").alias("n"))
        tables.append(own.withColumn("order", F.lit(order)))
    every = saved(functools.reduce(DataFrame.unionByName, tables), "grams")
    seen = {(r["order"], r["fold"], r["n"]): r["k"] for r in every.where("n <= 4").groupBy("order", "fold", "n").agg(F.count("*").alias("k")).collect()}
    discounts = []
    for order in range(1, ORDER + 1):
        for fold in (0, 1):
            discounts += [x for i, d in enumerate(discounts_of([seen.get((order, fold, n), 0) for n in range(1, 5)]), 1) for x in (F.lit(f"{order} {fold} {i}"), F.lit(d))]
    less = F.element_at(F.create_map(*discounts), F.concat_ws(" ", "order", "fold", F.least("n", F.lit(3))))
    keyed = every.withColumn("context", F.when(F.col("order") > 1, _context()).otherwise(0)).withColumn("less", less)
    contexts = saved(keyed.groupBy("fold", "order", "context").agg(F.sum("n").alias("total"), F.sum("less").alias("lost")), "contexts")
    alphas = keyed.join(contexts, ["fold", "order", "context"]).select("fold", "order", "gram", ((F.col("n") - F.col("less")) / F.col("total")).alias("alpha"))
    return saved(alphas, "alphas"), contexts.select("fold", "order", "context", (F.col("lost") / F.col("total")).alias("gamma"))


def discounts_of(seen: list[int]) -> list[float]:
    """The three discounts of modified Kneser-Ney from how many grams have counts 1 to 4; some is always left to the order below."""
    y = seen[0] / max(1, seen[0] + 2 * seen[1])
    return [min(float(i), max(0.01, i - (i + 1) * y * seen[i] / seen[i - 1])) if seen[i - 1] else 0.5 * i for i in (1, 2, 3)]


def probabilities(wanted: DataFrame, alphas: DataFrame, gammas: DataFrame) -> DataFrame:
    """(fold, gram, p) of distinct wanted (fold, gram): joins with the tables of each order, from the lowest up."""
    p = None
    for order in range(1, ORDER + 1):
        own = wanted.select("fold", _suffix(order).alias("gram")).distinct() if order < ORDER else wanted
        own = own.withColumn("context", _context() if order > 1 else F.lit(0).cast("long"))
        own = own.join(alphas.where(F.col("order") == order).select("fold", "gram", "alpha"), ["fold", "gram"], "left")
        own = own.join(gammas.where(F.col("order") == order).select("fold", "context", "gamma"), ["fold", "context"], "left")
        if p is None:
            below = F.lit(1.0 / UNITS)
        else:
            own = own.withColumn("suffix", _suffix(order - 1)).join(p.select("fold", F.col("gram").alias("suffix"), F.col("p").alias("below")), ["fold", "suffix"])
            below = F.col("below")
        p = own.select("fold", "gram", (F.coalesce("alpha", F.lit(0.0)) + F.coalesce("gamma", F.lit(1.0)) * below).alias("p"))
        p = saved(p, "p") if order < ORDER else p
    return p


def _first_copies(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(block, key, text) of each text that the task meets for the first time, compressed."""
    held("", lambda: None)
    seen: set[int] = set()
    pack = zstandard.ZstdCompressor(level=3)
    for part in text_slices(batches, "text"):
        keys = part.column("key").to_pylist()
        new = [i for i, k in enumerate(keys) if k not in seen and not seen.add(k)]
        part = part.take(pa.array(new, pa.int64()))
        texts = [pack.compress(t.encode("utf-8", "surrogatepass")) for t in pc.fill_null(part.column("text"), "").to_pylist()]
        yield pa.RecordBatch.from_arrays([part.column("block"), part.column("key"), pa.array(texts, pa.binary())], names=["block", "key", "text"])


def _slices(table: pa.Table, most: int = SLICE) -> Iterator[tuple[list[int], list[str]]]:
    """Keys and texts of a block, so many bytes at a time; a text that several tasks have met stands once."""
    unpack = zstandard.ZstdDecompressor()
    keys, texts, size, seen = [], [], 0, set()
    for key, raw in zip(table.column("key"), table.column("text")):
        if (k := key.as_py()) in seen:
            continue
        seen.add(k)
        data = unpack.decompress(raw.as_py())
        keys.append(k)
        texts.append(data.decode("utf-8", "surrogatepass"))
        size += len(data)
        if size >= most:
            yield keys, texts
            keys, texts, size = [], [], 0
    if keys:
        yield keys, texts


def _wanted(table: pa.Table) -> pa.Table:
    """The distinct grams of a block: (block, gram)."""
    found = np.empty(0, dtype=np.int64)
    for _, texts in _slices(table):
        found = pd.unique(np.concatenate([found, pd.unique(grams(texts)[0])]))
    release()
    block = table.column("block")[0].as_py()
    return pa.table({"block": pa.array(np.full(len(found), block, np.int32)), "gram": pa.array(found, pa.int64())})


def _scored(table: pa.Table, known: pa.Table) -> pa.Table:
    """(key, nll, n) of the texts of a block, from its grams' minus log probabilities."""
    order = np.argsort(known.column("gram").to_numpy())
    of, nlp = known.column("gram").to_numpy()[order], known.column("nlp").to_numpy()[order]
    out: list[list] = [[], [], []]
    for keys, texts in _slices(table):
        ids, bounds = grams(texts)
        codes, values = pd.factorize(ids)
        each = nlp[np.searchsorted(of, values)][codes] if len(values) else np.empty(0)
        sums = np.concatenate([[0.0], np.cumsum(each, dtype=np.float64)])
        for column, more in zip(out, (keys, sums[bounds[1:]] - sums[bounds[:-1]], np.diff(bounds))):
            column.extend(more)
    release()
    return pa.table({"key": pa.array(out[0], pa.int64()), "nll": pa.array(out[1], pa.float64()), "n": pa.array(out[2], pa.int64())})


def _text() -> Column:
    return F.coalesce(F.col("text").cast("string"), F.lit(""))


def _key() -> Column:
    return F.xxhash64(_text())


def _fold() -> Column:
    """Texts fall into two folds by their hash, copies into one; a text is scored by the model of the other fold."""
    return F.pmod(_key(), F.lit(2)).cast("int")


def text_nll(docs: DataFrame, trusted: DataFrame, block_bytes: int = 16 << 20) -> DataFrame | None:
    """(key, nll, n) of each distinct text of docs: the sum of minus log probabilities of its n code units.

    trusted: distinct doc_ids whose texts train two models, one for each fold of all texts; None if there are none.

    Texts are dealt once, into blocks of about block_bytes, compressed and copies dropped before the shuffle. The
    distinct grams of a block are joined with the sharded tables of the model, and their probabilities come back to the
    block, where its texts are summed; both sides read the same shuffle. So nothing of the model is gathered in one
    place, whatever its size, and no row is made for a gram of a document.
    """
    size = docs.agg(F.sum(F.octet_length(_text())).alias("bytes")).first()["bytes"] or 0
    own = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    good = own.join(broadcast_if_small(trusted), "doc_id", "left_semi").where(F.length("text") > 0)
    # a model is named by the fold that it scores, the one that its texts are not in
    alphas, gammas = train(good.select((1 - _fold()).alias("fold"), "text"))
    folds = {r["fold"] for r in gammas.where("order = 1").select("fold").distinct().collect()}
    if not folds:
        return None
    blocks = max(1, -(-size // (2 * block_bytes)))
    block = 2 * F.pmod(F.xxhash64(_text(), F.lit(1)), F.lit(blocks)) + _fold()
    keyed = docs.select(block.cast("int").alias("block"), _key().alias("key"), F.col("text").cast("string").alias("text"))
    texts = keyed.mapInArrow(_first_copies, "block int, key long, text binary")
    here = texts.groupBy("block").applyInArrow(_wanted, "block int, gram long")
    # a fold whose other fold has no trusted text is scored by the model that there is
    here = saved(here.withColumn("fold", F.pmod("block", F.lit(2)) if len(folds) == 2 else F.lit(min(folds))), "blocks")
    p = probabilities(here.select("fold", "gram").distinct(), alphas, gammas)
    known = here.join(p, ["fold", "gram"]).select("block", "gram", (-F.log("p")).cast("float").alias("nlp"))
    return texts.groupBy("block").cogroup(known.groupBy("block")).applyInArrow(_scored, "key long, nll double, n long")


def _mean_nll(mean: Column, prior: int) -> Column:
    """The mean of a document's units with prior more of the language's mean, as short texts vary widely."""
    return (F.col("nll") + prior * mean) / (F.col("n") + prior)


def _judged(docs: DataFrame, labels: DataFrame, quantile: float, slack: float, prior: int) -> DataFrame | None:
    """One row per row of docs: doc_id, lang, key, perplexity, threshold, kept; None without trusted text."""
    trusted = labels.where("quality = 1").select(F.col("doc_id").cast("long").alias("doc_id")).where("doc_id is not null").distinct()
    trusted = saved(trusted, "trusted")
    nll = text_nll(docs, trusted)
    if nll is None:
        return None
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("lang").cast("string").alias("lang"), _key().alias("key"))
    scored = saved(rows.join(saved(nll, "nll").hint("merge"), "key"), "scored")
    known = scored.join(broadcast_if_small(trusted), "doc_id", "left_semi").where("n > 0")
    means = known.groupBy("lang").agg((F.sum("nll") / F.sum("n")).alias("mean"))
    of_lang = means.select(F.col("lang").alias("own_lang"), "mean")
    shrunk = known.join(of_lang, F.col("lang").eqNullSafe(F.col("own_lang"))).select("lang", "mean", _mean_nll(F.col("mean"), prior).alias("x"))
    most = (F.percentile_approx("x", quantile, 100_000) + math.log(slack)).alias("most")
    by_lang = saved(shrunk.groupBy("lang").agg(F.first("mean").alias("mean"), most), "thresholds")
    overall = shrunk.agg(F.avg("mean").alias("mean"), most).first()
    own = broadcast_if_small(by_lang.select(F.col("lang").alias("own_lang"), F.col("mean").alias("own_mean"), F.col("most").alias("own_most")), 10_000)
    joined = scored.join(own, F.col("lang").eqNullSafe(F.col("own_lang")), "left")
    mean, most = F.coalesce("own_mean", F.lit(overall["mean"])), F.coalesce("own_most", F.lit(overall["most"]))
    x = _mean_nll(mean, prior)
    return joined.select("doc_id", "lang", "key", F.exp(x).alias("perplexity"), F.exp(most).alias("threshold"), (x <= most).alias("kept"))


def score_quality(docs: DataFrame, labels: DataFrame, quantile: float = 0.999, slack: float = 1.2, prior: int = 60) -> DataFrame:
    """One row per row of docs: doc_id, lang, perplexity, threshold, kept.

    docs needs doc_id, lang and text; labels needs doc_id and quality. Trusted are all documents with a label of
    quality 1; they train models of grams of four UTF-16 code units and give each language its threshold: slack times
    the quantile of the perplexities of its trusted documents. Texts are scored by the model of the fold that they are
    not in. A language without trusted documents, null included, uses the threshold of all.

    Null and empty texts have the language's mean perplexity and are kept. Repeated rows give repeated results, a
    null doc_id is never trusted, and repeated labels count once. Without any trusted text all rows are kept and
    perplexity and threshold are null. Extra columns are ignored.
    """
    found = _judged(docs, labels, quantile, slack, prior)
    if found is None:
        null = F.lit(None).cast("double")
        return docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("lang").cast("string").alias("lang"), null.alias("perplexity"), null.alias("threshold"), F.lit(True).alias("kept"))
    return found.drop("key")


def keep_good(docs: DataFrame, labels: DataFrame, quantile: float = 0.999, slack: float = 1.2, prior: int = 60) -> DataFrame:
    """The rows of docs that score_quality keeps, with their own columns, whatever they are called."""
    found = _judged(docs, labels, quantile, slack, prior)
    if found is None:
        return docs
    # the verdict hangs on text and language, so copies share it
    verdict = F.xxhash64(F.col("lang").cast("string"), _key()).alias("verdict")
    bad = saved(found.where("not kept").select(F.xxhash64("lang", "key").alias("verdict")).distinct(), "rejected")
    own = docs.select(F.struct(*(F.col(f"`{c}`") for c in docs.columns)).alias("row"), verdict)
    kept = own.join(broadcast_if_small(bad), "verdict", "left_anti")
    return kept.select(*(F.col("row").getField(c).alias(c) for c in docs.columns))
