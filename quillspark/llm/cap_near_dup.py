"""Embedding near-dedup by spherical-cap filters of structured random product codes."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import components, held, saved
from .hnsw import usable

#: Share of pairs at the least cosine that may have no common filter, and pairs drawn to find the level of the filters for it.
MISSED, PROBES = 0.0005, 8192
#: Codes, each turned another way. Several with a higher level make fewer and smaller filters than one does.
CODES = 4
#: Vectors that share a first codeword in a label, about, and the least and largest size of both lists of codewords.
GROUP, SIDES, MOST_FIRST, MOST_SECOND = 65_536, 32, 4096, 65_536
#: Vectors and codewords are rounded to this fraction, so that scores are exact sums, alike in every task.
STEP = 2.0**-20
#: Rows of a product that a task holds.
TILE = 2048


def _unit(x: np.ndarray) -> np.ndarray:
    return x / np.maximum(np.linalg.norm(x, axis=1, keepdims=True), 1e-12)


def _front(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Places at which no other one is larger in both a and b."""
    order = np.lexsort((-b, -a))
    top = np.maximum.accumulate(b[order])
    return order[np.concatenate([[True], b[order][1:] > top[:-1]])]


class ProductCodes:
    """Filters (code, i, j): the caps around c_i + d_j, unit codewords c for one half of a code's turned components, d for the other.

    A vector is in a filter if its two scores sum to the level or more; so only the sums of two short lists are looked
    at. The level is such that pairs of cosine least have a filter in common but for a share of MISSED, as measured on
    random pairs. Turns make that independent of the data.
    """

    def __init__(self, dimensions: int, first: int, second: int, least: float = 0.93):
        rng = np.random.default_rng([dimensions, first, second])
        half = max(1, dimensions // 2)
        rest = max(1, dimensions - half)
        self.first, self.second, self.codes = first, second, []
        for _ in range(CODES):
            turn = np.linalg.qr(rng.standard_normal((max(dimensions, half + rest), half + rest)))[0][:dimensions]
            c, d = _unit(rng.standard_normal((first, half))), _unit(rng.standard_normal((second, rest)))
            self.codes.append(tuple(np.round(m / STEP) * STEP for m in (turn[:, :half] @ c.T, turn[:, half:] @ d.T)))
        self.level = float(np.quantile(self._shared(rng, dimensions, least), MISSED))

    def _shared(self, rng: np.random.Generator, dimensions: int, least: float) -> np.ndarray:
        """Of random pairs of cosine least, the highest level at which both are in one filter.

        Only codewords that no other one beats for both vectors of the pair can be in that filter, and these are few.
        """
        out = []
        for _ in range(0, PROBES, 256):
            x, z = _unit(rng.standard_normal((256, dimensions))), rng.standard_normal((256, dimensions))
            z = _unit(z - (z * x).sum(axis=1, keepdims=True) * x)
            y = _unit(least * x + np.sqrt(max(0.0, 1 - least * least)) * z)
            best = np.full(256, -np.inf)
            for code in self.codes:
                for n, (x1, x2, y1, y2) in enumerate(zip(x @ code[0], x @ code[1], y @ code[0], y @ code[1])):
                    i, j = _front(x1, y1), _front(x2, y2)
                    best[n] = max(best[n], np.minimum(x1[i][:, None] + x2[j], y1[i][:, None] + y2[j]).max())
            out.append(best)
        return np.concatenate(out)

    @staticmethod
    def rounded(v: np.ndarray) -> np.ndarray:
        """Unit vectors in steps: products with codewords are then whole numbers of steps squared, below 2^53, in any order of summing."""
        return np.round(v / STEP) * STEP

    def firsts(self, v: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(vector, group): the groups code * first + i in which vectors have a filter."""
        rows, groups = [], []
        for k, (c, d) in enumerate(self.codes):
            n, i = np.nonzero(v @ c + (v @ d).max(axis=1, keepdims=True) >= self.level)
            rows.append(n)
            groups.append(k * self.first + i)
        return np.concatenate(rows), np.concatenate(groups)

    def seconds(self, v: np.ndarray, group: int) -> tuple[np.ndarray, np.ndarray]:
        """(j, vector), sorted: the filters of a group that each vector is in."""
        c, d = self.codes[group // self.first]
        one = v @ c[:, group % self.first]
        met = [np.nonzero(one[at : at + 256, None] + v[at : at + 256] @ d >= self.level) for at in range(0, len(v), 256)]
        n = np.concatenate([x + 256 * k for k, (x, _) in enumerate(met)]) if met else np.empty(0, np.int64)
        j = np.concatenate([x for _, x in met]) if met else np.empty(0, np.int64)
        order = np.lexsort((n, j))
        return j[order], n[order]

    def decode(self, v: np.ndarray, before: int | None = None) -> list[np.ndarray]:
        """Of each vector the sorted filters group * second + j that it is in, all or those before a group."""
        found: list[list[np.ndarray]] = [[] for _ in v]
        rows, groups = self.firsts(v)
        scores = [v @ d for _, d in self.codes]
        for n, g in zip(rows.tolist(), groups.tolist()):
            if before is None or g <= before:
                k = g // self.first
                j = np.flatnonzero(v[n] @ self.codes[k][0][:, g % self.first] + scores[k][n] >= self.level)
                found[n].append(g * self.second + j)
        return [np.sort(np.concatenate(own)) if own else np.empty(0, np.int64) for own in found]


def _codes(dimensions: int, first: int, second: int, least: float) -> ProductCodes:
    known = held(f"codes-{least}", dict)
    kind = dimensions, first, second
    return known.get(kind) or known.setdefault(kind, ProductCodes(*kind, least))


GROUPS = "label long, d int, first int, second int, group long, class long, members long, vector binary"


def _join_groups(least: float, kind_of: np.dtype):
    schema = pa.schema([("label", pa.int64()), ("d", pa.int32()), ("first", pa.int32()), ("second", pa.int32()), ("group", pa.int64()), ("class", pa.int64()), ("members", pa.int64()), ("vector", pa.binary())])

    def join(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole in batches:
            for at in range(0, len(whole), 256):
                part = whole.slice(at, 256).to_pylist()
                kinds: dict[tuple[int, int, int], list[int]] = {}
                for n, r in enumerate(part):
                    kinds.setdefault((len(r["vector"]) // kind_of.itemsize, r["first"], r["second"]), []).append(n)
                for kind, rows in kinds.items():
                    v = np.stack([np.frombuffer(part[n]["vector"], kind_of) for n in rows]).astype(np.float64)
                    codes = _codes(*kind, least)
                    vectors, groups = codes.firsts(codes.rounded(_unit(v)))
                    own = [part[rows[n]] for n in vectors.tolist()]
                    columns = [[r["label"] for r in own], *([x] * len(own) for x in kind), groups, [r["class"] for r in own], [r["members"] for r in own], [r["vector"] for r in own]]
                    yield pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(columns, schema)], schema=schema)

    return join


def _verify(least: float, kind_of: np.dtype):
    """Links between the classes of two blocks of a group, each in its pair's first common filter: counts by class, and a forest of edges."""
    schema = pa.schema([("a", pa.int64()), ("b", pa.int64()), ("links", pa.int64())])

    def verify(table: pa.Table) -> pa.Table:
        d, first, second, group, i, j = (table.column(c)[0].as_py() for c in ("d", "first", "second", "group", "i", "j"))
        codes = _codes(d, first, second, least)
        ids, members, own = (table.column(c).to_numpy() for c in ("class", "members", "own"))
        v = _unit(np.stack([np.frombuffer(x, kind_of) for x in table.column("vector").to_pylist()]).astype(np.float64))
        coarse = codes.rounded(v)
        links, top = np.zeros(len(ids), np.int64), list(range(len(ids)))
        lists: dict[int, np.ndarray] = {}
        a, b = [], []

        def find_top(n: int) -> int:
            while top[n] != n:
                top[n] = n = top[top[n]]
            return n

        names, places = codes.seconds(coarse, group)
        bounds = np.flatnonzero(np.diff(names)) + 1
        for own_j, inside in zip(names[np.append(0, bounds)] if len(names) else [], np.split(places, bounds)):
            for at in range(0, len(inside), TILE):
                rows = inside[at : at + TILE]
                for to in range(at, len(inside), TILE):
                    columns = inside[to : to + TILE]
                    link = v[rows] @ v[columns].T >= least
                    link &= rows[:, None] < columns[None, :]
                    if i != j:
                        link &= own[rows][:, None] != own[columns][None, :]
                    x, y = np.nonzero(link)
                    if not len(x):
                        continue
                    near = np.unique(np.concatenate([rows[x], columns[y]]))
                    new = [n for n in near.tolist() if n not in lists]
                    if new:
                        lists.update(zip(new, codes.decode(coarse[new], group)))
                    # an earlier filter that both are in has them already
                    before = [lists[n][: np.searchsorted(lists[n], group * second + own_j)] for n in near.tolist()]
                    kinds, place = np.unique(np.concatenate(before), return_inverse=True)
                    has = np.zeros((len(near), max(1, len(kinds))), dtype=np.float32)
                    has[np.repeat(np.arange(len(near)), [len(f) for f in before]), place] = 1
                    x, y = rows[x], columns[y]
                    fresh = (has @ has.T == 0)[np.searchsorted(near, x), np.searchsorted(near, y)]
                    x, y = x[fresh], y[fresh]
                    np.add.at(links, x, members[y])
                    np.add.at(links, y, members[x])
                    for p, q in zip(x.tolist(), y.tolist()):
                        p, q = find_top(p), find_top(q)
                        if p != q:
                            top[q] = p
                            a.append(ids[p])
                            b.append(ids[q])
        some = np.flatnonzero(links)
        return pa.table([pa.array([*a, *ids[some]], pa.int64()), pa.array([*b, *ids[some]], pa.int64()), pa.array([*[0] * len(a), *links[some]], pa.int64())], schema=schema)

    return verify


def near_vectors(embeddings: DataFrame, least: float = 0.93, block: int = GROUP) -> DataFrame:
    """One row per row of embeddings: vec_id, n_links, component_id, kept.

    embeddings needs vec_id, embedding and label; extra columns are ignored. Vectors of equal label that is not null
    link when their cosine is least or more in double precision, among the pairs that have a filter in common; pairs of
    that cosine do so with a probability of 0.9995, nearer ones with a higher one. n_links counts the other vectors
    linked directly, component_id is the smallest vec_id reachable and kept marks the row whose own id that is.

    Null, zero and non-finite vectors and those without a label link with nothing. Equal vectors of a label form one
    class, so copies are counted, not paired; repeated rows are copies. Vectors of different lengths don't link. An
    empty table gives an empty result.

    A vector goes once to each first codeword under which it has filters; the filters themselves are found again there,
    so no lists of them move. Labels have the more filters the more classes they have. Where more than block vectors
    share a first codeword, they are compared in pairs of blocks, still by filter.
    """
    single = embeddings.schema["embedding"].dataType.simpleString() == "array<float>"
    kind_of = np.dtype(np.float32 if single else np.float64)
    own = embeddings.select(F.col("vec_id").cast("long").alias("vec_id"), F.col("embedding").cast("array<float>" if single else "array<double>").alias("embedding"), F.col("label").cast("long").alias("label"))
    takes_part = usable(F.col("embedding")) & F.col("label").isNotNull()
    pack = F.arrow_udf(lambda x: pa.array([None if e is None else np.asarray(e, kind_of).tobytes() for e in x.to_pylist()], pa.binary()), "binary")
    x_type = "float" if single else "double"
    keyed = saved(own.select("vec_id", "label", pack(F.when(takes_part, F.transform("embedding", lambda x: F.when(x == 0, F.lit(0.0).cast(x_type)).otherwise(x)))).alias("vector")), "vectors")  # -0.0 is 0.0
    classes = keyed.where("vector is not null").groupBy("label", "vector").agg(F.count("*").alias("members"), F.min("vec_id").alias("first_id"))
    classes = saved(classes.withColumn("class", F.monotonically_increasing_id()), "classes")
    power = lambda x, most: F.pow(F.lit(2), F.ceil(F.log2(F.greatest(F.lit(SIDES), F.least(F.lit(most), x))))).cast("int")
    sides = classes.groupBy("label").agg(F.count("*").alias("n")).withColumn("first", power(F.col("n") * CODES / GROUP, MOST_FIRST))
    sides = sides.withColumn("second", power(F.col("n") / F.col("first"), MOST_SECOND)).select("label", "first", "second")
    joined = classes.join(sides, "label").mapInArrow(_join_groups(least, kind_of), GROUPS)  # made twice rather than written: the sizes take no vectors along
    key = ["label", "d", "group"]
    sizes = joined.groupBy(*key).agg(F.ceil(F.count("*") / block).cast("int").alias("blocks"), F.count("*").alias("n")).where("n > 1").drop("n")
    dealt = joined.join(sizes, key).withColumn("own", F.pmod(F.xxhash64("class"), F.col("blocks")).cast("int"))
    pairs = F.transform(F.sequence(F.lit(0), F.col("blocks") - 1), lambda i: F.struct(F.least(i, F.col("own")).alias("i"), F.greatest(i, F.col("own")).alias("j")))
    tasks = dealt.withColumn("pair", F.explode(pairs)).select(*key, "first", "second", "pair.i", "pair.j", "own", "class", "members", "vector")
    found = saved(tasks.groupBy(*key, "i", "j").applyInArrow(_verify(least, kind_of), "a long, b long, links long"), "found")
    groups = components(found.where("a <> b").select("a", "b")).withColumnRenamed("node", "class")
    counts = found.where("a = b").groupBy(F.col("a").alias("class")).agg(F.sum("links").alias("links"))
    placed = classes.select("label", "vector", "class", "members", "first_id").join(groups, "class", "left").join(counts, "class", "left")
    placed = placed.select("label", "vector", "first_id", (F.col("members") - 1 + F.coalesce("links", F.lit(0))).alias("n_links"), F.coalesce("component", "class").alias("component"))
    heads = placed.groupBy("component").agg(F.min("first_id").alias("component_id"))
    of_class = placed.join(heads, "component").select("label", "vector", "n_links", "component_id")
    linked = keyed.where("vector is not null").join(of_class, ["label", "vector"]).select("vec_id", "n_links", "component_id")
    alone = keyed.where("vector is null").select("vec_id", F.lit(0).cast("long").alias("n_links"), F.col("vec_id").alias("component_id"))
    return linked.unionByName(alone).withColumn("kept", F.coalesce(F.col("vec_id") == F.col("component_id"), F.lit(False)))
