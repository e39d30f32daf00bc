"""Substring dedup by content-defined chunks: a gear rolling hash cuts, digests find repeats."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from .common import saved, text_slices

#: A cut falls where the low bits of the gear hash are 0: every 2 ** CUT_BITS bytes on average, by the 16 bytes before it.
CUT_BITS, LEAST, MOST = 5, 16, 256
#: Bytes before and after a run of repeats in which it can grow; no chunk is longer than MOST, so more would hold further repeats.
BEFORE, AFTER = 384, MOST
#: Longer strings of letters and digits are no words, and may be cut inside.
LONGEST_WORD = 32
_GEAR = np.random.default_rng(11).integers(0, 1 << 16, 256, dtype=np.uint16)


def cuts(data: np.ndarray) -> list[int]:
    """Ends of the chunks of bytes: gear-hash cuts at least LEAST apart, and forced ones after MOST bytes."""
    h = _GEAR[data]
    for step in (1, 2, 4, 8):  # h[i] becomes the sum of gear[b[i - j]] << j over the last 16 bytes
        older = np.zeros_like(h)
        older[step:] = h[:-step] << np.uint16(step)
        h = h + older
    # the top bits depend on all 16 bytes
    spots = np.flatnonzero(h >> np.uint16(16 - CUT_BITS) == 0) + 1
    out, last = [], 0
    for spot in spots.tolist():
        while spot - last > MOST:
            last += MOST
            out.append(last)
        if spot - last >= LEAST:
            out.append(spot)
            last = spot
    while len(data) - last > MOST:
        last += MOST
        out.append(last)
    if last < len(data):
        out.append(len(data))
    return out


def _chunks(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    schema = pa.schema([("doc", pa.int64()), ("order", pa.int64()), ("at", pa.int32()), ("size", pa.int32()), ("digest", pa.int64()), ("more", pa.int32())])
    for part in text_slices(batches, "text"):
        docs, orders, ats, sizes, digests = [], [], [], [], []
        for doc, order, text in zip(*(part.column(c).to_pylist() for c in ("doc", "order", "text"))):
            raw = (text or "").encode("utf-8", "surrogatepass")
            start = 0
            for end in cuts(np.frombuffer(raw, np.uint8)):
                ats.append(start)
                sizes.append(end - start)
                digests.append(xxhash.xxh3_128_intdigest(raw[start:end]))
                start = end
            new = len(ats) - len(docs)
            docs += [doc] * new
            orders += [order] * new
        # 96 bits are told apart, enough for 10 ** 12 chunks
        halves = [(d >> 64) - (1 << 63) for d in digests], [(d & 0xFFFFFFFF) - (1 << 31) for d in digests]
        yield pa.RecordBatch.from_arrays([pa.array(c, type=f.type) for c, f in zip((docs, orders, ats, sizes, *halves), schema)], schema=schema)


def _alike(a: bytes, b: bytes) -> int:
    """The length of the longest common prefix."""
    low, high = 0, min(len(a), len(b))
    while low < high:
        middle = (low + high + 1) // 2
        if a[:middle] == b[:middle]:
            low = middle
        else:
            high = middle - 1
    return low


def _in_word(raw: bytes, at: int) -> bool:
    """Is a place between two letters or digits of ASCII?"""
    return 0 < at < len(raw) and raw[at - 1 : at + 1].isalnum()


def _whole_words(raw: bytes, start: int, stop: int, own_start: int, own_stop: int) -> tuple[int, int]:
    """A grown run without parts of words and white space at its ends, but not less than what it has grown from."""
    first, last = start, stop
    while first < own_start and _in_word(raw, first):
        first += 1
    while last > own_stop and _in_word(raw, last):
        last -= 1
    first, last = start if first - start > LONGEST_WORD else first, stop if stop - last > LONGEST_WORD else last
    while first < own_start and raw[first : first + 1].isspace():
        first += 1
    while last > own_stop and raw[last - 1 : last].isspace():
        last -= 1
    return first, last


def _grown(raw: bytes, runs: list[dict], least_bytes: int) -> list[tuple[int, int]]:
    """Disjoint spans to cut: whole runs, and runs that have least_bytes in common with one first occurrence once they are extended."""
    spans, of_source = [], {}
    for r in sorted(runs, key=lambda r: (r["start"], r["stop"])):
        if r["before"] is None:
            spans.append((r["start"], r["stop"]))
            continue
        start = r["start"] - _alike(raw[max(0, r["start"] - BEFORE) : r["start"]][::-1], r["before"][::-1])
        stop = r["stop"] + _alike(raw[r["stop"] : r["stop"] + AFTER], r["after"])
        grown = of_source.setdefault((r["source"], r["shift"]), [])
        if grown and start <= grown[-1][1]:
            older = grown.pop()
            grown.append((older[0], max(stop, older[1]), older[2], r["stop"]))
        else:
            grown.append((start, stop, r["start"], r["stop"]))
    for grown in of_source.values():
        spans += [_whole_words(raw, *g) for g in grown if g[1] - g[0] >= least_bytes]
    out: list[tuple[int, int]] = []
    for start, stop in sorted(spans):
        if out and start <= out[-1][1]:
            out[-1] = out[-1][0], max(stop, out[-1][1])
        else:
            out.append((start, stop))
    return out


def _cut_spans(least_bytes: int):
    kind = pa.list_(pa.struct([("start", pa.int32()), ("stop", pa.int32())]))

    def cut(texts: pa.Array, runs: pa.Array) -> pa.Array:
        """Texts without the runs of bytes, once these are extended; a run grows no further than to whole characters inside it."""
        out, spans = [], []
        for text, run in zip(texts, runs):
            text, run = text.as_py(), run.as_py()
            if text is None or not run:
                out.append(text)
                spans.append([])
                continue
            raw, kept, own, last = text.encode("utf-8", "surrogatepass"), [], [], 0
            for start, stop in _grown(raw, run, least_bytes):
                while start < stop and raw[start] & 0xC0 == 0x80:
                    start += 1
                while stop > start and stop < len(raw) and raw[stop] & 0xC0 == 0x80:
                    stop -= 1
                kept.append(raw[last:start])
                own.append({"start": start, "stop": stop})
                last = stop
            out.append(b"".join([*kept, raw[last:]]).decode("utf-8", "replace"))
            spans.append(own)
        return pa.StructArray.from_arrays([pa.array(out, pa.string()), pa.array(spans, kind)], ["text", "spans"])

    return cut


def drop_repeats(docs: DataFrame, least_bytes: int = 160) -> DataFrame:
    """One row per row of docs: doc_id, text without its repeats, n_bytes, dropped_bytes, spans (start, stop in bytes).

    docs needs doc_id and text; other columns are ignored. Of equal chunks the first stays, by doc_id, then place; the
    others are repeats. Since cuts follow the content, a passage is cut alike wherever it stands, but for the chunks at
    its ends, which hold what surrounds it: so a run of repeats is extended byte by byte against its first occurrence.
    Runs that are least_bytes long or more go, with what they grow by up to whole words.

    Null texts stay null, empty ones empty. Repeated rows (equal id and text) are one document, and treated alike; null
    ids come last. A text of one character repeated is cut every MOST bytes and loses what repeats inside it.
    """
    own = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    own = own.withColumn("doc", F.xxhash64("doc_id", "text")).withColumn("order", F.coalesce("doc_id", F.lit((1 << 63) - 1)))
    chunks = saved(own.select("doc", "order", "text").mapInArrow(_chunks, "doc long, order long, at int, size int, digest long, more int"), "chunks")
    place = F.struct("order", "doc", "at")
    firsts = chunks.groupBy("digest", "more").agg(F.min(place).alias("first"), F.max(place).alias("last")).where("first <> last").select("digest", "more", "first")
    source, shift = F.col("first.doc").alias("source"), (F.col("at") - F.col("first.at")).alias("shift")
    repeats = chunks.join(firsts, ["digest", "more"]).where(place != F.col("first")).select("doc", "at", "size", source, shift).distinct()
    in_place = W.partitionBy("doc").orderBy("at")
    before = lambda c: F.lag(c).over(in_place)
    broken = F.when(before(F.col("at") + F.col("size")) == F.col("at"), 0).otherwise(1)
    other = F.when((F.col("broken") == 0) & (before("source") == F.col("source")) & (before("shift") == F.col("shift")), 0).otherwise(1)
    numbered = repeats.withColumn("broken", broken).withColumn("other", other)
    numbered = numbered.withColumn("run", F.sum("broken").over(in_place)).withColumn("part", F.sum("other").over(in_place))
    ends = F.min("at").alias("start"), F.max(F.col("at") + F.col("size")).alias("stop")
    parts = saved(numbered.groupBy("doc", "run", "part").agg(*ends, F.first("source").alias("source"), F.first("shift").alias("shift")), "parts")
    # texts are dealt by doc once, for both joins
    ends = F.min("start").alias("start"), F.max("stop").alias("stop")
    none = F.lit(None).cast("binary")
    whole = parts.groupBy("doc", "run").agg(*ends).where(F.col("stop") - F.col("start") >= least_bytes)
    whole = whole.select("doc", "start", "stop", F.lit(0).cast("long").alias("source"), F.lit(0).alias("shift"), none.alias("before"), none.alias("after"))
    there = F.col("start") - F.col("shift")
    room = F.least(F.lit(BEFORE), there, F.col("start"))
    raw = F.col("text").cast("binary")
    first_texts = own.select(F.col("doc").alias("source"), "text", "doc_id")
    grown = parts.join(first_texts.hint("merge"), "source").select(
        "doc", "start", "stop", "source", "shift", F.substring(raw, there - room + 1, room).alias("before"),
        F.substring(raw, F.col("stop") - F.col("shift") + 1, F.lit(AFTER)).alias("after"),
    )
    runs = whole.unionByName(grown).groupBy("doc").agg(F.collect_set(F.struct("start", "stop", "source", "shift", "before", "after")).alias("runs"))
    cut_spans = F.arrow_udf(_cut_spans(least_bytes), "struct<text: string, spans: array<struct<start: int, stop: int>>>")
    cut = own.join(runs.hint("merge"), "doc", "left").withColumn("cut", cut_spans("text", "runs"))
    n_bytes = F.coalesce(F.octet_length("text"), F.lit(0)).cast("long")
    left = F.coalesce(F.octet_length("cut.text"), F.lit(0)).cast("long")
    return cut.select("doc_id", F.col("cut.text").alias("text"), n_bytes.alias("n_bytes"), (n_bytes - left).alias("dropped_bytes"), F.col("cut.spans").alias("spans"))
