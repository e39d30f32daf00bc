"""N-gram Jaccard self-join by prefix filters under several global token orders."""

from __future__ import annotations

import math
from collections.abc import Iterator
from functools import reduce
from operator import and_

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import broadcast_if_small, components, hash_words, held, mix64, saved, split_words, text_slices

#: Shingles counted as frequent; it sets the token orders and the size of what is broadcast (16 bytes each), never the links.
MAX_FREQUENT = 1 << 17
#: Shingles that more texts than MANY share are dealt to SALTS tasks each; that follows from counts, and changes no link.
MANY, SALTS = 20_000, 64
#: A prefix token lists the pairs of so many classes at most; more are grouped.
FEW = 16
#: Salts of the token orders; every order puts frequent shingles last and permutes the others.
ORDERS = (0, 0x9E3779B97F4A7C15, 0xD1B54A32D192ED03)
_B = np.uint64(0x9E3779B97F4A7C55)


def shingle_sets(texts: pa.Array, k: int) -> list[np.ndarray]:
    """Each text's sorted distinct k-word shingle hashes; of fewer words, the whole sequence is one; of none, empty."""
    words, bounds = split_words(pc.ascii_lower(texts))
    h = hash_words(words)
    rolled = np.zeros(max(0, len(h) - k + 1), dtype=np.uint64)
    for i in range(k):
        rolled = rolled * _B + h[i : i + len(rolled)]
    rolled = mix64(rolled)
    out = []
    for start, stop in zip(bounds[:-1].tolist(), bounds[1:].tolist()):
        if stop - start >= k:
            out.append(np.unique(rolled[start : stop - k + 1]))
        elif stop > start:
            short = np.array([stop - start], dtype=np.uint64)
            for i in range(start, stop):
                short = short * _B + h[i : i + 1]
            out.append(mix64(short, 1))
        else:
            out.append(np.empty(0, dtype=np.uint64))
    return out


def _class_of(tokens: np.ndarray) -> int:
    """A 63-bit digest of a sorted set; texts with equal sets share it."""
    return xxhash.xxh3_64_intdigest(tokens.tobytes()) >> 1


def _extra(size):
    """How many tokens beyond one the prefixes of similar sets share: a quarter of small sets, a twentieth more of large ones."""
    return np.minimum(size // 4, 20 + size // 20)


def _prefix(tokens: np.ndarray, frequent: tuple[np.ndarray, np.ndarray, np.ndarray], percent: int, salt: int) -> np.ndarray:
    """The first n - ceil(t n) + 1 + extra(n) tokens in the order of the salt: frequent ones last, the others permuted.

    Of two sets with t of their union in common, the prefixes share 1 + extra(the smaller size) tokens at least.
    """
    if not len(tokens):
        return tokens
    length = len(tokens) + 1 + int(_extra(len(tokens))) - -(-percent * len(tokens) // 100)
    values, ranks, _ = frequent
    common = np.zeros(len(tokens), dtype=bool)
    if len(values):
        place = np.searchsorted(values, tokens)
        place[place == len(values)] = 0
        common = values[place] == tokens
    rare = tokens[~common]
    if salt:
        rare = rare[np.argsort(mix64(rare, salt))]
    if len(rare) >= length:
        return rare[:length]
    late = tokens[common]
    late = late[np.lexsort((mix64(late, salt), ranks[place[common]]))] if len(late) else late
    return np.concatenate([rare, late[: length - len(rare)]])


def _rows(schema: pa.Schema, *columns) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array(c, type=f.type) for c, f in zip(columns, schema)], schema=schema)


def _scan(k: int):
    """Per text: kind 0, doc_id, row_key, size, class. Per shingle that three or more texts of a task share: kind 1, shingle, its count."""
    schema = pa.schema([("kind", pa.int32()), ("doc_id", pa.int64()), ("row_key", pa.int64()), ("size", pa.int64()), ("class", pa.int64())])

    def scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held("", lambda: None)
        seen: set[int] = set()
        pool: list[np.ndarray] = []
        pooled = 0

        def shared() -> pa.RecordBatch:
            values, counts = np.unique(np.concatenate(pool), return_counts=True)
            keep = counts >= 3
            n = int(keep.sum())
            return _rows(schema, np.ones(n, np.int32), values[keep].view(np.int64), np.zeros(n, np.int64), counts[keep], np.zeros(n, np.int64))

        for part in text_slices(batches, "text"):
            sets = shingle_sets(part.column("text"), k)
            classes = [_class_of(s) for s in sets]
            yield pa.RecordBatch.from_arrays(
                [pa.array(np.zeros(len(sets), np.int32)), part.column("doc_id").cast(pa.int64()), part.column("row_key").cast(pa.int64()), pa.array([len(s) for s in sets], pa.int64()), pa.array(classes, pa.int64())],
                schema=schema,
            )
            for s, c in zip(sets, classes):
                if c not in seen:
                    seen.add(c)
                    pool.append(s)
                    pooled += len(s)
            if pooled > 2_000_000:
                yield shared()
                pool, pooled = [], 0
        if pool:
            yield shared()

    return scan


def _prefix_schema(hot: np.ndarray) -> pa.Schema:
    """Prefix tokens by class and size, with salts if there are hot tokens."""
    return pa.schema([("token", pa.int64()), ("class", pa.int64()), ("size", pa.int32()), *([("salt", pa.int32())] if len(hot) else [])])


def _salts(tokens: np.ndarray, classes: np.ndarray, hot: np.ndarray) -> np.ndarray:
    """From 1 for tokens among the sorted hot ones, by class; 0 for others."""
    place = np.searchsorted(hot, tokens)
    place[place == len(hot)] = 0
    return np.where(hot[place] == tokens, 1 + classes % SALTS, 0).astype(np.int32)


def _emit_prefixes(k: int, percent: int, frequent):
    """The prefix tokens of each class under the first order, once for each task that meets the class."""

    def emit(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        hot = frequent.value[2]
        seen: set[int] = set()
        for part in text_slices(batches, "text"):
            tokens, classes, sizes = [np.empty(0, np.uint64)], [], []
            for s in shingle_sets(part.column("text"), k):
                c = _class_of(s)
                if len(s) and c not in seen:
                    seen.add(c)
                    tokens.append(_prefix(s, frequent.value, percent, ORDERS[0]))
                    classes.append(c)
                    sizes.append(len(s))
            every = np.concatenate(tokens)
            repeats = [len(t) for t in tokens[1:]]
            of = np.repeat(np.array(classes, np.int64), repeats)
            salts = [_salts(every, of, hot)] if len(hot) else []
            yield _rows(_prefix_schema(hot), every.view(np.int64), of, np.repeat(np.array(sizes, np.int32), repeats), *salts)

    return emit


def _emit_again(percent: int, frequent, salt: int):
    """The prefix tokens of saved sets under another order."""

    def emit(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        hot = frequent.value[2]
        for part in text_slices(batches, "tokens"):
            found = [_prefix(np.frombuffer(t, np.uint64), frequent.value, percent, salt) for t in part.column("tokens").to_pylist()]
            repeats = [len(t) for t in found]
            every, of = np.concatenate([np.empty(0, np.uint64), *found]), np.repeat(part.column("class").to_numpy(), repeats)
            salts = [_salts(every, of, hot)] if len(hot) else []
            yield _rows(_prefix_schema(hot), every.view(np.int64), of, np.repeat(part.column("size").to_numpy().astype(np.int32), repeats), *salts)

    return emit


def _emit_sets(k: int):
    schema = pa.schema([("class", pa.int64()), ("size", pa.int64()), ("tokens", pa.binary())])

    def emit(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part in text_slices(batches, "text"):
            sets = shingle_sets(part.column("text"), k)
            yield _rows(schema, [_class_of(s) for s in sets], [len(s) for s in sets], [s.tobytes() for s in sets])

    return emit


def _links_in_blocks(percent: int):
    """Exact links among the classes of two blocks of a group; of those, a forest that joins what the links join."""
    schema = pa.schema([("a", pa.int64()), ("b", pa.int64())])

    def find(table: pa.Table) -> pa.Table:
        ids = table.column("class").to_numpy()
        sets = [np.frombuffer(t, np.uint64) for t in table.column("tokens").to_pylist()]
        sizes = np.array([len(s) for s in sets], dtype=np.int64)
        tokens, column = np.unique(np.concatenate(sets), return_inverse=True)
        row = np.repeat(np.arange(len(sets)), sizes)
        shared = np.bincount(column)[column] > 1
        column, row = np.unique(column[shared], return_inverse=True)[1], row[shared]
        order = np.argsort(column, kind="stable")
        column, row = column[order], row[order]
        both = np.zeros((len(sets), len(sets)), dtype=np.float32)
        for start in range(0, int(column[-1]) + 1 if len(column) else 0, 8192):
            lo, hi = np.searchsorted(column, (start, start + 8192))
            dense = np.zeros((len(sets), 8192), dtype=np.float32)
            dense[row[lo:hi], column[lo:hi] - start] = 1
            both += dense @ dense.T  # counts below 2 ** 24 are exact
        both = both.astype(np.int64)
        x, y = np.nonzero(np.triu(100 * both >= percent * (sizes[:, None] + sizes[None, :] - both), 1))
        top = list(range(len(sets)))

        def find_top(i: int) -> int:
            while top[i] != i:
                top[i] = i = top[top[i]]
            return i

        forest = []
        for i, j in zip(x.tolist(), y.tolist()):
            i, j = find_top(i), find_top(j)
            if i != j:
                top[j] = i
                forest.append((ids[i], ids[j]))
        return pa.Table.from_batches([_rows(schema, [p[0] for p in forest], [p[1] for p in forest])])

    return find


def _bucket(percent: int) -> Column:
    """Similar sets have sizes in one bucket or in neighbouring ones."""
    return F.col("size") if percent >= 100 else F.floor(F.log("size") / math.log(100 / percent) + 1e-9).cast("int")


def _least_shared(size: Column) -> Column:
    """How many prefix tokens a set of this size shares with a similar one that is not smaller."""
    return 1 + F.least(F.floor(size / 4), 20 + F.floor(size / 20))


def _candidates(prefixes: DataFrame, percent: int) -> tuple[DataFrame, DataFrame]:
    """Of one token order: (a, b), pairs of classes that may be similar; and (class, group), classes of crowded tokens.

    prefixes: (token, class, size), and salt if there are tokens of very many classes. A pair is a candidate if it shares
    the needed number of prefix tokens. Where a token has few classes, its pairs of fitting sizes are listed and
    counted. Crowded tokens, of more than FEW classes or salted, list no pairs; a pair may have as many of them in
    common as either class has. Classes whose crowded tokens alone could be enough fall into groups instead: of each
    crowded token and bucket of sizes they are connected to the smallest one, and these of neighbouring buckets to each
    other. So every similar pair is listed, or within one group. Crowded tokens are summed where they are read.
    """
    salted = "salt" in prefixes.columns
    key = ["token", "salt"] if salted else ["token"]
    hot = F.col("salt") > 0 if salted else F.lit(False)
    dealt = prefixes.repartition(*key)
    listed = dealt.groupBy(*key).agg(F.min("class").alias("low"), F.max("class").alias("high"), F.max("size").alias("most"), F.count("*").alias("n"))
    listed = listed.where(((F.col("low") < F.col("high")) | hot) & (F.col("most") > 0))  # all columns, so that both sides read one exchange
    crowded = (F.col("n") > FEW) | hot
    left = saved(dealt.join(listed.select(*key, "n").hint("shuffle_hash"), key), "met")
    sets = F.collect_set(F.struct("class", "size"))
    few = left.where(~crowded).groupBy(*key).agg(sets.alias("sets"))
    fit = lambda x, y: (x["class"] < y["class"]) & (100 * F.least(x["size"], y["size"]) >= percent * F.greatest(x["size"], y["size"]))
    pair = lambda x, y: F.struct(x["class"].alias("a"), y["class"].alias("b"), F.least(x["size"], y["size"]).alias("size"))
    pairs = F.flatten(F.transform("sets", lambda x: F.transform(F.filter("sets", lambda y: fit(x, y)), lambda y: pair(x, y))))
    counted = few.select(F.explode(pairs).alias("p")).groupBy("p.a", "p.b", "p.size").agg(F.count("*").alias("shared"))
    counted = saved(counted.withColumn("lacks", _least_shared(F.col("size")) - F.col("shared")), "counted")

    many = left.where(crowded).select("token", "class", "size")
    has = saved(many.groupBy("class", "size").agg(F.countDistinct("token").alias("has")), "has")
    of = lambda side: broadcast_if_small(has).select(F.col("class").alias(side), F.col("has").alias(f"{side}_has"))
    helped = counted.where("lacks > 0").join(of("a"), "a").join(of("b"), "b").where(F.least("a_has", "b_has") >= F.col("lacks"))
    found = counted.where("lacks <= 0").select("a", "b").unionByName(helped.select("a", "b"))

    enough = has.where(F.col("has") >= _least_shared(F.floor(percent * F.col("size") / 100))).select("class")
    banded = many.join(broadcast_if_small(saved(enough, "enough")), "class", "left_semi").withColumn("bucket", _bucket(percent))
    heads = banded.groupBy("token", "bucket").agg(F.min("class").alias("head"))
    of_head = banded.join(heads, ["token", "bucket"]).select(F.col("head").alias("a"), F.col("class").alias("b"))
    below = heads.select("token", (F.col("bucket") + 1).alias("bucket"), F.col("head").alias("a"))
    edges = of_head.unionByName(heads.join(below, ["token", "bucket"]).select("a", F.col("head").alias("b")))
    groups = components(edges.where("a <> b").distinct()).select(F.col("node").alias("class"), F.col("component").alias("group"))
    return saved(found, "pairs"), groups


def _intersected(found: list[tuple[DataFrame, DataFrame]]) -> DataFrame:
    """(class, group): classes connected by pairs that every order has as a candidate, listed or within one of its groups."""
    labels = None
    for i, (_, groups) in enumerate(found):
        own = groups.withColumnRenamed("group", f"g{i}")
        labels = own if labels is None else labels.join(own, "class", "full_outer")
    labels = saved(labels, "labels")
    names = [f"g{i}" for i in range(len(found))]
    marked = reduce(DataFrame.unionByName, (pairs.withColumn("order", F.lit(1 << i)) for i, (pairs, _) in enumerate(found)))
    marked = marked.groupBy("a", "b").agg(F.bit_or("order").alias("orders"))
    of = lambda side: labels.select(F.col("class").alias(side), *(F.col(n).alias(f"{side}_{n}") for n in names))
    beside = marked.join(of("a"), "a", "left").join(of("b"), "b", "left")
    passes = reduce(and_, ((F.col("orders").bitwiseAND(F.lit(1 << i)) > 0) | F.coalesce(F.col(f"a_{n}") == F.col(f"b_{n}"), F.lit(False)) for i, n in enumerate(names)))
    in_all = labels.dropna().select("class", F.xxhash64(*names).alias("group"))
    heads = in_all.groupBy("group").agg(F.min("class").alias("a"))
    stars = in_all.join(heads, "group").select("a", F.col("class").alias("b")).where("a <> b")
    edges = beside.where(passes).select("a", "b").unionByName(stars)
    return components(edges).select(F.col("node").alias("class"), F.col("component").alias("group"))


def _linked_to_pivot(percent: int):
    """Of sets beside their group's pivot (class, tokens, pivot, pivot_tokens) those that link with it, as edges."""
    schema = pa.schema([("a", pa.int64()), ("b", pa.int64())])

    def find(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part in text_slices(batches, "pivot_tokens"):
            sets = [[np.frombuffer(t, np.uint64) for t in part.column(c).to_pylist()] for c in ("tokens", "pivot_tokens")]
            both = np.array([len(np.intersect1d(x, y, assume_unique=True)) for x, y in zip(*sets)], dtype=np.int64)
            every = np.array([len(x) + len(y) for x, y in zip(*sets)], dtype=np.int64) - both
            near = 100 * both >= percent * every
            yield _rows(schema, part.column("pivot").to_numpy()[near], part.column("class").to_numpy()[near])

    return find


def _verified(sets: DataFrame, groups: DataFrame, rows: DataFrame, percent: int, block: int, block_bytes: int) -> DataFrame:
    """(a, b): exact links of classes that join what all links of the groups join.

    sets: (class, size, tokens); groups: (class, group); rows: (class, rows). In a group of more than one block, all
    classes are first compared with a pivot, the class with most copies. Those that link with it are settled: they are
    in one component already and needn't be compared with each other, only with the rest. So a large group of copies of
    one text is compared once; else pairs of blocks, bounded in sets and in bytes, are.
    """
    placed = groups.join(sets.select("class", "size"), "class")
    room = F.ceil(F.greatest(F.count("*") / block, 8 * F.sum("size") / block_bytes)).cast("int")
    large = saved(placed.groupBy("group").agg(room.alias("blocks")).where("blocks > 1").select("group"), "large")
    of_large = placed.join(large, "group").join(rows, "class")
    pivots = saved(of_large.groupBy("group").agg(F.max(F.struct("rows", "class"))["class"].alias("pivot")), "pivots")
    bodies = sets.select(F.col("class").alias("pivot"), F.col("tokens").alias("pivot_tokens")).join(broadcast_if_small(pivots), "pivot")
    with_pivot = broadcast_if_small(saved(of_large.select("class", "group").join(pivots, "group").where("class <> pivot"), "beside"))
    beside = sets.select("class", "tokens").join(with_pivot, "class").join(bodies.select("group", "pivot_tokens"), "group")
    first = saved(beside.select("class", "tokens", "pivot", "pivot_tokens").mapInArrow(_linked_to_pivot(percent), "a long, b long"), "first")
    settled = first.select(F.col("b").alias("class")).union(first.select("a")).distinct().withColumn("settled", F.lit(True))
    placed = placed.join(settled, "class", "left").withColumn("settled", F.coalesce("settled", F.lit(False)))
    blocks = placed.groupBy("group", "settled").agg(room.alias("blocks")).groupBy("group").agg(
        F.coalesce(F.max(F.when(~F.col("settled"), F.col("blocks"))), F.lit(0)).alias("open"), F.coalesce(F.max(F.when(F.col("settled"), F.col("blocks"))), F.lit(0)).alias("done")
    )
    dealt = placed.join(blocks.where("open > 0"), "group")
    number = lambda n: F.pmod(F.xxhash64("class"), F.greatest(F.col(n), F.lit(1))).cast("int")
    dealt = dealt.withColumn("own", F.when(F.col("settled"), F.col("open") + number("done")).otherwise(number("open")))
    others = F.when(F.col("settled"), F.col("open")).otherwise(F.col("open") + F.col("done"))
    pairs = F.transform(F.sequence(F.lit(0), others - 1), lambda i: F.struct(F.least(i, F.col("own")).alias("i"), F.greatest(i, F.col("own")).alias("j")))
    where = broadcast_if_small(saved(dealt.select("class", "group", pairs.alias("pairs")), "pairs"))
    tasks = sets.select("class", "tokens").join(where, "class").withColumn("pair", F.explode("pairs")).select("group", "pair.i", "pair.j", "class", "tokens")
    return first.unionByName(saved(tasks.groupBy("group", "i", "j").applyInArrow(_links_in_blocks(percent), "a long, b long"), "links"))


def _members(docs: DataFrame, k: int, percent: int, max_frequent: int, block: int, block_bytes: int, many: int) -> DataFrame:
    """(doc_id, row_key, size, component_id) of each row of docs; row_key is a hash of doc_id and text."""
    spark = docs.sparkSession
    texts = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    keyed = texts.withColumn("row_key", F.xxhash64("doc_id", "text"))
    scanned = saved(keyed.mapInArrow(_scan(k), "kind int, doc_id long, row_key long, size long, class long"), "scan")
    classes = scanned.where("kind = 0").drop("kind")
    counted = scanned.where("kind = 1").groupBy(F.col("doc_id").alias("token")).agg(F.sum("size").alias("n"))
    top = counted.orderBy(F.desc("n"), "token").limit(max_frequent).toPandas().sort_values("n", kind="stable")
    values = top["token"].to_numpy(np.int64).view(np.uint64)
    by_value = np.argsort(values)
    hot = np.sort(values[top["n"].to_numpy() > many])
    frequent = spark.sparkContext.broadcast((values[by_value], np.arange(len(values))[by_value], hot))

    columns = "token long, class long, size int" + (", salt int" if len(hot) else "")
    firsts = classes.where("size > 0").groupBy("class").agg(F.min("row_key").alias("row_key"))
    first = _candidates(texts.mapInArrow(_emit_prefixes(k, percent, frequent), columns), percent)
    pairs, crowded = first
    chosen = pairs.select(F.col("a").alias("class")).union(pairs.select("b")).union(crowded.select("class")).distinct()
    wanted = broadcast_if_small(saved(firsts.join(chosen, "class").select("row_key"), "wanted"))
    texts_of = keyed.select("row_key", "text").join(wanted, "row_key", "left_semi").dropDuplicates(["row_key"]).select("text")
    sets = saved(texts_of.mapInArrow(_emit_sets(k), "class long, size long, tokens binary"), "sets")
    groups = saved(_intersected([first, *(_candidates(sets.mapInArrow(_emit_again(percent, frequent, salt), columns), percent) for salt in ORDERS[1:])]), "groups")
    links = _verified(sets, groups, classes.groupBy("class").agg(F.count("*").alias("rows")), percent, block, block_bytes)
    joined = components(links)

    placed = classes.join(joined.withColumnRenamed("node", "class"), "class", "left")
    placed = placed.select("doc_id", "row_key", "size", F.coalesce("component", "class").alias("component"))
    linked = placed.where("size > 0")
    heads = linked.groupBy("component").agg(F.min("doc_id").alias("component_id"))
    alone = placed.where("size = 0").select("doc_id", "row_key", "size", F.col("doc_id").alias("component_id"))
    return linked.join(heads, "component").select("doc_id", "row_key", "size", "component_id").unionByName(alone)


def jaccard_components(docs: DataFrame, k: int = 5, percent: int = 75, max_frequent: int = MAX_FREQUENT, block: int = 512, block_bytes: int = 24 << 20, many: int = MANY) -> DataFrame:
    """Groups of documents linked by a Jaccard similarity of their k-word shingle sets of percent or more.

    docs needs doc_id and text; other columns are ignored. Returns one row per row of docs: doc_id, n_shingles
    (size of the set) and component_id, the smallest doc_id reachable by links.

    Null, empty or blank texts have no shingles and link with nothing, copies of each other included; texts of
    fewer than k words are one shingle. Repeated rows give repeated results. A row whose doc_id is null takes part,
    and its component_id is null only where no other member has an id. An empty table gives an empty result.

    How: texts with equal sets form one class, so copies are never paired. Pairs of classes that share enough tokens of
    their prefixes are candidates of a token order; what tokens of many classes bring together is kept as groups rather
    than as pairs, which near copies would make by their square. The candidates of all orders are intersected, and what
    is left is verified exactly, in tasks that return no more links than they have classes.
    """
    found = _members(docs, k, percent, max_frequent, block, block_bytes, many)
    return found.select("doc_id", F.col("size").alias("n_shingles"), "component_id")


def keep_first(docs: DataFrame, k: int = 5, percent: int = 75) -> DataFrame:
    """docs, with their columns whatever they are called, without the members of a near-duplicate group other than the one with the smallest doc_id.

    Rows are told apart by doc_id and text, so of two texts with one doc_id each has the fate of its own group. Rows
    without shingles and rows with a null doc_id stay; of repeated rows of the smallest doc_id all stay.
    """
    found = _members(docs, k, percent, MAX_FREQUENT, 512, 12 << 20, MANY)
    drop = saved(found.where("size > 0 AND doc_id <> component_id").select("row_key").distinct(), "drop")
    row_key = F.when(F.col("doc_id").isNotNull(), F.xxhash64(F.col("doc_id").cast("long"), F.col("text").cast("string")))
    own = docs.select(F.struct(*(F.col(f"`{c}`") for c in docs.columns)).alias("row"), row_key.alias("row_key"))
    kept = own.join(broadcast_if_small(drop), "row_key", "left_anti")
    return kept.select(*(F.col("row").getField(c).alias(c) for c in docs.columns))
