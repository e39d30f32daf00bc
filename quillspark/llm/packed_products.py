"""Hard negatives by exact inner products of integers, several candidates to a word (Kronecker substitution)."""

from __future__ import annotations

from operator import mul

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from .common import saved

#: Bits that a double holds exactly, and a bound on scores below which 64-bit sums cannot overflow.
WORD_BITS, SAFE = 53, 1 << 60
#: Anchors of a block, and anchors and candidates whose scores a task holds at once.
ANCHORS, TILE_ANCHORS, TILE_ROWS = 2048, 256, 8192
LONG = (-(1 << 63), (1 << 63) - 1)


def scaled(x: np.ndarray) -> np.ndarray:
    """floor(256 * x) of finite numbers: whole doubles, or Python integers where 256 * x is beyond doubles."""
    with np.errstate(over="ignore"):
        v = np.floor(256.0 * x.astype(np.float64))
    if np.isfinite(v).all():
        return v
    return np.array([[256 * int(y) if abs(y) > 1e300 else int(np.floor(256 * y)) for y in row] for row in x.astype(np.float64).tolist()], dtype=object)


def _whole(v: np.ndarray) -> list[list[int]]:
    return [[int(x) for x in row] for row in v.tolist()]


def _in_words(a: np.ndarray, c: np.ndarray, low_a: int, low_c: int, bits: int) -> np.ndarray:
    """Products of biased components: as many candidates to a word as 53 bits hold, and one matrix product for all words."""
    fields = WORD_BITS // bits
    a, c = a - low_a, c - low_c
    n, d = c.shape
    padded = np.zeros((-(-n // fields), fields, d))
    padded.reshape(-1, d)[:n] = c
    words = np.einsum("gfd,f->gd", padded, np.exp2(bits * np.arange(fields)))
    total = (a @ words.T).astype(np.int64)
    split = (total[:, :, None] >> (bits * np.arange(fields))) & ((1 << bits) - 1)
    return split.reshape(len(a), -1)[:, :n] + low_c * a.sum(axis=1).astype(np.int64)[:, None] + low_a * c.sum(axis=1).astype(np.int64)[None, :] + d * low_a * low_c


def _in_integers(a: list[list[int]], c: list[list[int]], low_a: int, low_c: int, bits: int) -> tuple[np.ndarray, np.ndarray]:
    """The same where a score can pass 60 bits: one integer of any width for each component of all candidates."""
    size, d = -(-bits // 8), len(c[0])
    wide = [int.from_bytes(b"".join((row[k] - low_c).to_bytes(size, "little") for row in c), "little") for k in range(d)]
    sums = [sum(row) - d * low_c for row in c]
    scores, fits = np.zeros((len(a), len(c)), np.int64), np.zeros((len(a), len(c)), bool)
    for i, row in enumerate(a):
        own = [x - low_a for x in row]
        raw = sum(map(mul, own, wide)).to_bytes(size * len(c), "little")
        base = low_c * sum(own) + d * low_a * low_c
        for j, more in enumerate(sums):
            score = int.from_bytes(raw[size * j : size * (j + 1)], "little") + base + low_a * more
            if LONG[0] <= score <= LONG[1]:
                scores[i, j], fits[i, j] = score, True
    return scores, fits


def _magnitudes(v: np.ndarray) -> np.ndarray:
    """A class for each row by the size of its largest component, so that a large one widens the fields of its like alone."""
    top = [max((abs(int(x)) for x in row), default=0).bit_length() for row in v.tolist()] if v.dtype == object else np.frexp(np.abs(v).max(axis=1, initial=0))[1]
    return np.maximum(np.asarray(top), 10) // 10


def products(a: np.ndarray, c: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Inner products of all rows of a with all of c, whole numbers, and which of them fit 64 bits.

    Components are biased by the least one, so that none is negative, and a field is as wide as the largest sum that can
    come about in it: no field runs over into the next, and what comes out is exact.
    """
    scores, fits = np.zeros((len(a), len(c)), np.int64), np.ones((len(a), len(c)), bool)
    if not a.size or not c.size:
        return scores, fits
    of_a, of_c = _magnitudes(a), _magnitudes(c)
    for x in np.unique(of_a):
        for y in np.unique(of_c):
            rows, columns = np.flatnonzero(of_a == x), np.flatnonzero(of_c == y)
            own, near = a[rows], c[columns]
            low_a, low_c, high_a, high_c = int(own.min()), int(near.min()), int(own.max()), int(near.max())
            d = a.shape[1]
            bits = (d * max(1, high_a - low_a) * max(1, high_c - low_c)).bit_length()
            at = np.ix_(rows, columns)
            if bits <= WORD_BITS and d * max(abs(low_a), abs(high_a)) * max(abs(low_c), abs(high_c)) < SAFE >> 4:
                scores[at] = _in_words(own.astype(np.float64), near.astype(np.float64), low_a, low_c, bits)
            else:
                scores[at], fits[at] = _in_integers(_whole(own), _whole(near), low_a, low_c, bits)
    return scores, fits


def _vectors(column: pa.ChunkedArray, kind: np.dtype) -> np.ndarray:
    return scaled(np.stack([np.frombuffer(x, kind) for x in column.to_pylist()]))


def _best(groups: tuple[np.ndarray, ...], scores: np.ndarray, ids: np.ndarray, k: int) -> np.ndarray:
    """Places of the k best of each group, by score, then smaller id."""
    order = np.lexsort((ids, -scores, *groups[::-1]))
    new = np.zeros(len(order), bool)
    new[:1] = True
    for g in groups:
        new[1:] |= g[order][1:] != g[order][:-1]
    first = np.maximum.accumulate(np.where(new, np.arange(len(order)), 0))
    return order[np.arange(len(order)) - first < k]


FOUND = pa.schema([("anchor_id", pa.int64()), ("positive", pa.int32()), ("vec_id", pa.int64()), ("score", pa.int64())])


def _score(k: int, kind: np.dtype, low: int, high: int):
    """The k best rows of a block for each anchor: of its own label, or with limits given, of other labels in each positive's range."""

    def score(anchors: pa.Table, rows: pa.Table) -> pa.Table:
        found: list[list[np.ndarray]] = [[] for _ in FOUND]
        if anchors.num_rows and rows.num_rows:
            a, c = _vectors(anchors.column("vector"), kind), _vectors(rows.column("vector"), kind)
            ids, labels = rows.column("vec_id").to_numpy(), rows.column("label").to_numpy()
            own_ids, own_labels = anchors.column("vec_id").to_numpy(), anchors.column("label").to_numpy()
            limits = None
            if "limits" in anchors.column_names:
                lists = anchors.column("limits").to_pylist()
                limits = np.full((len(lists), 2, max(map(len, lists))), 0, np.int64)
                limits[:, 0] = 1  # a range that holds nothing
                for i, own in enumerate(lists):
                    for j, p in enumerate(own):  # a score s with low * p <= 100 * s <= high * p
                        limits[i, :, j] = -(-low * p // 100), high * p // 100
                limits[:, 0] = np.where(limits[:, 0] > limits[:, 1], LONG[1], limits[:, 0])
                limits[:, 1] = np.where(limits[:, 0] == LONG[1], LONG[0], limits[:, 1])
            for i in range(0, len(a), TILE_ANCHORS):
                tile: list[list[np.ndarray]] = [[] for _ in FOUND]
                mine = slice(i, i + TILE_ANCHORS)
                for j in range(0, len(c), TILE_ROWS):
                    theirs = slice(j, j + TILE_ROWS)
                    scores, fits = products(a[mine], c[theirs])
                    alike = own_labels[mine][:, None] == labels[theirs][None, :]
                    if limits is None:
                        r, s = np.nonzero(fits & alike & (own_ids[mine][:, None] != ids[theirs][None, :]))
                        picked = [(np.zeros(len(r), np.int64), r, s)]
                    else:
                        least, most = limits[mine, 0].min(axis=1), limits[mine, 1].max(axis=1)
                        r, s = np.nonzero(fits & ~alike & (scores >= least[:, None]) & (scores <= most[:, None]))
                        near = [(scores[r, s] >= limits[mine, 0, p][r]) & (scores[r, s] <= limits[mine, 1, p][r]) for p in range(limits.shape[2])]
                        picked = [(np.full(int(x.sum()), p, np.int64), r[x], s[x]) for p, x in enumerate(near)]
                    for p, r, s in picked:
                        best = _best((r,), scores[r, s], ids[theirs][s], k)
                        for column, values in zip(tile, (own_ids[mine][r[best]], p[best], ids[theirs][s[best]], scores[r[best], s[best]])):
                            column.append(values)
                anchor, p, vec_id, value = (np.concatenate(x) for x in tile)
                best = _best((anchor, p), value, vec_id, k)
                for column, values in zip(found, (anchor, p, vec_id, value)):
                    column.append(values[best])
        return pa.table([pa.array(np.concatenate(x) if x else [], f.type) for x, f in zip(found, FOUND)], schema=FOUND)

    return score


def _meet(anchors: DataFrame, rows: DataFrame, side: int, score) -> DataFrame:
    """score over all pairs of a block of anchors and a block of rows with one (d, part); parts are cut into blocks by their size."""
    sizes = rows.groupBy("d", "part").agg(F.ceil(F.count("*") / side).cast("int").alias("of_rows")).join(
        anchors.groupBy("d", "part").agg(F.ceil(F.count("*") / ANCHORS).cast("int").alias("of_anchors")), ["d", "part"]
    )
    sizes = saved(sizes, "sizes")
    dealt = lambda n: F.pmod(F.xxhash64("vec_id"), F.col(n)).cast("int")
    every = lambda n: F.explode(F.sequence(F.lit(0), F.col(n) - 1))
    left = anchors.join(sizes, ["d", "part"]).withColumn("i", dealt("of_anchors")).withColumn("j", every("of_rows"))
    right = rows.join(sizes, ["d", "part"]).withColumn("j", dealt("of_rows")).withColumn("i", every("of_anchors"))
    key, gone = ["d", "part", "i", "j"], ("of_rows", "of_anchors")
    left = left.drop(*gone)
    left = left.select(*(F.col(c).alias(c) for c in left.columns))  # columns of its own, as both sides are of one table
    return left.groupBy(*key).cogroup(right.drop(*gone).groupBy(*key)).applyInArrow(score, "anchor_id long, positive int, vec_id long, score long")


def _packed(vector: Column, kind: np.dtype) -> Column:
    """Each vector as bytes."""

    @F.arrow_udf("binary")
    def pack(x: pa.Array) -> pa.Array:
        raw = pc.list_flatten(x).to_numpy(zero_copy_only=False).astype(kind).tobytes()
        ends = np.concatenate([[0], np.cumsum(pc.list_value_length(x).to_numpy(zero_copy_only=False).astype(np.int64))]) * kind.itemsize
        return pa.array([raw[a:b] for a, b in zip(ends[:-1].tolist(), ends[1:].tolist())], pa.binary())

    return pack(vector)


def hard_negatives(
    embeddings: DataFrame, label: Column, anchors: Column, n_positives: int = 5, n_negatives: int = 3, low: int = 50, high: int = 95
) -> DataFrame:
    """Rows of other labels that score nearly as high as an anchor's positives: anchor_id, positive_id, rank, negative_id, positive_score, negative_score.

    embeddings needs vec_id, embedding and what label and anchors read; extra columns are ignored. A component x counts
    as floor(256 * x), a score is the exact integer inner product, higher ones come first, ties by smaller vec_id. The
    positives of an anchor are the first n_positives other rows of its label; for each of them come the first
    n_negatives rows of other labels with low * positive_score <= 100 * negative_score <= high * positive_score.

    Rows with a null vec_id, label or vector, or with a component that is null or not finite, take no part; zero vectors
    do. Vectors of different lengths don't meet. Rows that repeat a vec_id count once, as the one of smallest label,
    then bytes. A score of more than 64 bits can't be returned, and such a pair counts as none. An empty table, anchors
    without others of their label and positives without negatives give no rows.

    Anchors are a stated set, which meets the rows in blocks: for positives among the rows whose label has its hash,
    which are cut into blocks where they are many, for negatives among all. A task holds one block of each and a tile
    of scores; of each block only the best rows move. The larger the table, the larger the blocks of rows, up to 65,536.
    """
    double = "double" in embeddings.schema["embedding"].dataType.simpleString()
    kind = np.dtype(np.float64 if double else np.float32)
    vector = F.col("embedding").cast("array<double>" if double else "array<float>")
    bad = F.exists(vector, lambda x: x.isNull() | F.isnan(x) | (F.abs(x) == float("inf")))
    own = embeddings.select(F.col("vec_id").cast("long").alias("vec_id"), label.cast("long").alias("label"), vector.alias("v"), F.coalesce(anchors, F.lit(False)).alias("is_anchor"), F.coalesce(bad, F.lit(True)).alias("bad"))
    own = own.where("vec_id IS NOT NULL AND label IS NOT NULL AND NOT bad").select("vec_id", F.struct("label", _packed(F.col("v"), kind).alias("vector"), "is_anchor").alias("row"))
    rows = own.groupBy("vec_id").agg(F.min("row").alias("row")).select("vec_id", "row.*")
    rows = saved(rows.withColumn("d", (F.octet_length("vector") / kind.itemsize).cast("int")), "rows")
    n = rows.count()
    side = int(min(65_536, max(1024, 32 * n**0.5)))
    by_label = rows.withColumn("part", F.pmod(F.xxhash64("label"), F.lit(max(1, n // side))).cast("int"))
    asked = by_label.where("is_anchor")
    near = _meet(asked.drop("is_anchor"), by_label.drop("is_anchor"), side, _score(n_positives, kind, low, high))
    order = lambda *by: W.partitionBy(*by).orderBy(F.desc("score"), "vec_id")
    positives = near.withColumn("n", F.row_number().over(order("anchor_id"))).where(F.col("n") <= n_positives)
    positives = saved(positives.select("anchor_id", (F.col("n") - 1).cast("int").alias("positive"), F.col("vec_id").alias("positive_id"), F.col("score").alias("positive_score")), "positives")
    limits = positives.groupBy(F.col("anchor_id").alias("vec_id")).agg(F.transform(F.sort_array(F.collect_list(F.struct("positive", "positive_score"))), lambda p: p["positive_score"]).alias("limits"))
    whole = rows.drop("is_anchor").withColumn("part", F.lit(0))
    asked = rows.where("is_anchor").drop("is_anchor").withColumn("part", F.lit(0)).join(limits, "vec_id")
    far = _meet(asked, whole, side, _score(n_negatives, kind, low, high))
    best = far.withColumn("rank", F.row_number().over(order("anchor_id", "positive"))).where(F.col("rank") <= n_negatives)
    return best.join(positives, ["anchor_id", "positive"]).select("anchor_id", "positive_id", "rank", F.col("vec_id").alias("negative_id"), "positive_score", F.col("score").alias("negative_score"))


#: The rows of op12 in DuckDB.
ORACLE = """
WITH rows AS (
  SELECT vec_id, CASE WHEN vec_id % 7 = 0 THEN (label + 1) % 10 ELSE label END AS label, list_transform(embedding, lambda x: floor(256 * x::DOUBLE)) AS v FROM embeddings
  WHERE vec_id IS NOT NULL AND label IS NOT NULL AND embedding IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0),
scored AS (
  SELECT a.vec_id AS anchor_id, a.label = r.label AS alike, r.vec_id, list_dot_product(a.v, r.v)::BIGINT AS score
  FROM rows a JOIN rows r ON a.vec_id <> r.vec_id AND len(a.v) = len(r.v) WHERE a.vec_id % 50 = 0),
positives AS (
  SELECT anchor_id, vec_id AS positive_id, score AS positive_score FROM scored WHERE alike QUALIFY row_number() OVER (PARTITION BY anchor_id ORDER BY score DESC, vec_id) <= 5)
SELECT p.anchor_id, positive_id, (row_number() OVER (PARTITION BY p.anchor_id, positive_id ORDER BY score DESC, vec_id))::INTEGER AS rank, vec_id AS negative_id, positive_score, score AS negative_score
FROM positives p JOIN scored s ON s.anchor_id = p.anchor_id AND NOT alike AND 50 * positive_score <= 100 * score AND 100 * score <= 95 * positive_score
QUALIFY rank <= 3
"""
