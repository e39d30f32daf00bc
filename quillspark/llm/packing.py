"""Best-two-fit packing of tokenized documents into sequences of a fixed capacity."""

from __future__ import annotations

import itertools
import os
import re
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from .common import hash_words, held, saved, split_words, text_slices

#: Texts on which a tokenizer must give the same ids by parts as in one piece.
SAMPLE = ("Two words. And, more.", "don't stop-go 12.5,3 a.b,c x.", "\u00e9\u00d6 \u65e5\u672c\u8a9e. ok\u3002end", "  \t mixed\r\nCASE ", "a<b|c>d", "(x) [y] {z} #1 $2 50% a_b", "http://x.y/z?q=1&r=2", "")
#: Words whose ids a worker process remembers (about 40 bytes each) before it starts over.
REMEMBERED = 1 << 20


class KnownWords:
    """A tokenizer, and token ids of words by a 64-bit hash of the word, as flat arrays sorted by hash."""

    def __init__(self, path: str):
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_file(path)
        self.forget()
        ids = lambda text: self.tokenizer.encode(text, add_special_tokens=False).ids
        for text in SAMPLE:
            parts = re.sub(r"([A-Za-z])([.,])", r"\1 \2", text.lower()).split()
            if ids(text) != [i for word in parts for i in ids(word)]:
                raise ValueError(f"{path}: this tokenizer joins what stands apart in {text!r}")

    def forget(self) -> None:
        self.keys, self.starts, self.lengths = np.empty(0, np.uint64), np.empty(0, np.int64), np.empty(0, np.int32)
        self.ids = np.empty(0, np.uint32)

    def add(self, keys: np.ndarray, lists: list[list[int]]) -> None:
        lengths = np.fromiter(map(len, lists), np.int32, len(lists))
        starts = np.cumsum(lengths, dtype=np.int64) - lengths + len(self.ids)
        order = np.argsort(keys)
        at = np.searchsorted(self.keys, keys[order])
        self.keys = np.insert(self.keys, at, keys[order])
        self.starts, self.lengths = np.insert(self.starts, at, starts[order]), np.insert(self.lengths, at, lengths[order])
        self.ids = np.concatenate([self.ids, np.fromiter(itertools.chain.from_iterable(lists), np.uint32, int(lengths.sum()))])

    def find(self, keys: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Places of keys, and which of them are known."""
        at = np.searchsorted(self.keys, keys)
        at[at == len(self.keys)] = 0
        return at, self.keys[at] == keys if len(self.keys) else np.zeros(len(keys), bool)


def encode(texts: pa.Array, path: str) -> tuple[np.ndarray, np.ndarray]:
    """Token ids of all texts, flat, and each text's bounds in them (one more than texts).

    For tokenizers that lower case, drop white space and part letters from other signs, as this one: no token crosses a
    space or stands on both sides of a letter and a stop, so words parted there are encoded once each and remembered.
    """
    texts = pc.fill_null(texts.cast(pa.large_string()), "")
    if not pc.any(pc.match_substring(texts, "<|")).as_py():  # else a special token could come about
        texts = pc.ascii_lower(texts)
    words, bounds = split_words(pc.replace_substring_regex(texts, "([A-Za-z])([.,])", r"\1 \2"))
    if not len(words):
        return np.empty(0, np.uint32), bounds
    coded = words.dictionary_encode()
    hashes = hash_words(coded.dictionary)
    known = held(path, lambda: KnownWords(path))
    at, found = known.find(hashes)
    if not found.all():
        if len(known.keys) > REMEMBERED:
            known.forget()
            found = np.zeros(len(hashes), bool)
        new = coded.dictionary.filter(pa.array(~found)).to_pylist()
        # encodings are large objects, so only some are there at once
        parts = (known.tokenizer.encode_batch_fast(new[i : i + (1 << 14)], add_special_tokens=False) for i in range(0, len(new), 1 << 14))
        known.add(hashes[~found], [e.ids for part in parts for e in part])
        at, _ = known.find(hashes)
    which = coded.indices.to_numpy()
    starts, each = known.starts[at][which], known.lengths[at][which].astype(np.int64)
    ends = np.cumsum(each)
    gather = np.repeat(starts - ends + each, each) + np.arange(int(ends[-1]))
    return known.ids[gather], np.concatenate([[0], ends])[bounds]


def _cut(path: str, capacity: int, with_ids: bool):
    fields = [("doc_id", pa.int64()), ("piece", pa.int32()), ("start", pa.int64()), ("length", pa.int64()), ("ids_crc32", pa.int64())]
    schema = pa.schema(fields + [("ids", pa.list_(pa.int32()))] * with_ids)

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part in text_slices(batches, "text"):
            flat, bounds = encode(part.column("text"), path)
            rows: list[list] = [[] for _ in schema]
            for doc, start, stop in zip(part.column("doc_id").to_pylist(), bounds[:-1].tolist(), bounds[1:].tolist()):
                ids = np.append(flat[start:stop], np.uint32(0)).astype("<u4")
                for piece, at in enumerate(range(0, len(ids), capacity)):
                    own = ids[at : at + capacity]
                    for column, value in zip(rows, (doc, piece, at, len(own), zlib.crc32(own.tobytes()), own.astype(np.int32))):
                        column.append(value)
            yield pa.RecordBatch.from_arrays([pa.array(c, type=f.type) for c, f in zip(rows, schema)], schema=schema)

    return cut


def plan_bins(counts: dict[int, int], capacity: int) -> list[tuple[list[int], int]]:
    """Bins (lengths, how many such bins) that hold all documents, from the number of documents of each length.

    A bin starts with the longest length left and takes the longest that fits again and again. Then its smallest
    document is replaced by two unpacked ones, if two fit the gap so made more tightly. As many bins as the counts
    allow are made alike at once, so the work depends on the number of lengths alone.
    """
    left = np.zeros(capacity + 1, dtype=np.int64)
    for length, n in counts.items():
        left[length] = n
    # below[i]: the longest length of at most i that is left
    bins: list[tuple[list[int], int]] = []
    lengths = np.arange(capacity + 1)

    def longest() -> np.ndarray:
        return np.maximum.accumulate(np.where(left > 0, lengths, 0))

    below = longest()
    while below[capacity]:
        own = [int(below[capacity])]
        left[own[0]] -= 1
        gap = capacity - own[0]
        below = longest()
        while below[gap]:
            best = int(below[gap])
            n = min(int(left[best]), gap // best)
            own += [best] * n
            left[best] -= n
            gap -= n * best
            below = longest()
        if gap and len(own) > 1:
            small = own[-1]
            room = gap + small
            firsts = np.flatnonzero(left[: room + 1] > 0)
            firsts = firsts[firsts > 0]
            if len(firsts):
                seconds = below[room - firsts]
                # two of one length need two documents of it
                same = (seconds == firsts) & (left[firsts] < 2)
                seconds = np.where(same, below[np.minimum(room - firsts, np.maximum(firsts - 1, 0))], seconds)
                total = np.where(seconds > 0, firsts + seconds, 0)
                at = int(total.argmax())
                if total[at] > small:
                    own[-1:] = sorted((int(firsts[at]), int(seconds[at])), reverse=True)
                    left[small] += 1
                    left[firsts[at]] -= 1
                    left[seconds[at]] -= 1
        values, times = np.unique(own, return_counts=True)
        more = int((left[values] // times).min())
        left[values] -= more * times
        bins.append((own, 1 + more))
        below = longest()
    return bins


def _slots(bins: list[tuple[list[int], int]]) -> tuple[np.ndarray, ...]:
    """Sorted by length and rank: key (length << 40 | first rank), first sequence, offset, of each slot of each kind of bin."""
    keys, sequences, offsets = [], [], []
    used: dict[int, int] = {}
    base = 0
    for own, n in bins:
        at = 0
        for length in own:
            keys.append(length << 40 | used.get(length, 0))
            used[length] = used.get(length, 0) + n
            sequences.append(base)
            offsets.append(at)
            at += length
        base += n
    order = np.argsort(np.array(keys, dtype=np.int64))
    return tuple(np.array(x, dtype=np.int64)[order] for x in (keys, sequences, offsets))


def pack_documents(docs: DataFrame, tokenizer_path: str, capacity: int = 2048, with_ids: bool = False) -> DataFrame:
    """Pieces of all documents and their places in as few sequences of at most capacity tokens as best-two-fit needs.

    docs needs doc_id and text; extra columns are ignored. A document is its text's token ids, then id 0; only longer
    ones are cut, into pieces of capacity and a rest. Returns doc_id, piece, start, length, ids_crc32, sequence_id,
    offset, and with_ids the ids themselves. Sequences hold no gaps, from offset 0.

    Null and empty texts are the single id 0. Repeated rows are packed as often as they stand, a null doc_id stays
    null. An empty table gives an empty result. What comes to the driver is a count for each length.
    """
    spark = docs.sparkSession
    texts = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    columns = "doc_id long, piece int, start long, length long, ids_crc32 long" + ", ids array<int>" * with_ids
    pieces = saved(texts.mapInArrow(_cut(tokenizer_path, capacity, with_ids), columns), "pieces")
    buckets = max(1, pieces.count() // 50_000)
    keyed = pieces.withColumn("bucket", F.pmod(F.xxhash64("doc_id", "piece", "ids_crc32"), F.lit(buckets)))
    counted = saved(keyed.groupBy("length", "bucket").agg(F.count("*").alias("n")), "lengths")
    counts = {r["length"]: r["n"] for r in counted.groupBy("length").agg(F.sum("n").alias("n")).collect()}
    slots = spark.sparkContext.broadcast(_slots(plan_bins(counts, capacity)))

    before = F.coalesce(F.sum("n").over(W.partitionBy("length").orderBy("bucket").rowsBetween(W.unboundedPreceding, -1)), F.lit(0))
    firsts = counted.select("length", "bucket", before.alias("first"))
    within = W.partitionBy("length", "bucket").orderBy("doc_id", "piece", "ids_crc32")
    ranked = keyed.withColumn("own", F.row_number().over(within) - 1).join(firsts, ["length", "bucket"])
    ranked = ranked.withColumn("rank", F.col("first") + F.col("own"))

    @F.arrow_udf("sequence_id long, offset long")
    def place(length: pa.Array, rank: pa.Array) -> pa.Array:
        keys, sequences, offsets = slots.value
        own = length.to_numpy(zero_copy_only=False).astype(np.int64) << 40 | rank.to_numpy(zero_copy_only=False).astype(np.int64)
        at = np.searchsorted(keys, own, side="right") - 1
        return pa.StructArray.from_arrays([pa.array(sequences[at] + own - keys[at]), pa.array(offsets[at])], ["sequence_id", "offset"])

    placed = ranked.withColumn("place", place("length", "rank"))
    return placed.select("doc_id", "piece", "start", "length", "ids_crc32", *(["ids"] if with_ids else []), "place.sequence_id", "place.offset")
