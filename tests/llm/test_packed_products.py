"""Hard negatives by packed products against plain integers and the SQL statement."""

import math
import random
from pathlib import Path

import duckdb
import numpy as np
import pytest
from pyspark.sql import functions as F

from quillspark.llm import packed_products
from quillspark.llm.packed_products import hard_negatives, products
from quillspark.llm.queries import QUERIES

SCHEMA = "vec_id long, embedding array<double>, label long, `d` string, `row` string, `part` string, `positive` string"


@pytest.mark.parametrize("low,high", [(-5, 5), (0, 1), (-300, 300), (7, 7), (-(2**24), 2**24), (2**40, 2**40 + 3), (-(2**31), 2**31), (-(2**70), 2**70)])
@pytest.mark.parametrize("d", [0, 1, 7, 64])
def test_products(low, high, d):
    rng = random.Random(d)
    kind = object if high > 2**52 else np.float64
    a, c = (np.array([[rng.randint(low, high) for _ in range(d)] for _ in range(n)], dtype=kind).reshape(n, d) for n in (5, 19))
    scores, fits = products(a, c)
    for i, x in enumerate(a.tolist()):
        for j, y in enumerate(c.tolist()):
            exact = sum(int(p) * int(q) for p, q in zip(x, y))
            assert fits[i, j] == (-(2**63) <= exact < 2**63) and (not fits[i, j] or scores[i, j] == exact)


def test_mixed_sizes():
    rng = np.random.default_rng(1)
    v = np.floor(rng.standard_normal((60, 16)) * np.repeat([1.0, 100.0, 1e6, 1e12, 0.0, 1e5], 10)[:, None])
    scores, fits = products(v[::3], v)
    for i, x in enumerate(v[::3].tolist()):
        for j, y in enumerate(v.tolist()):
            exact = sum(int(p) * int(q) for p, q in zip(x, y))
            assert fits[i, j] == (-(2**63) <= exact < 2**63) and (not fits[i, j] or scores[i, j] == exact)


def test_scaled():
    x = np.array([[0.1, -0.1, 1e307, -1e308], [0.0, -1e-9, 3.5, 1e16]])
    assert packed_products.scaled(x).tolist() == [[25, -26, 256 * int(1e307), -256 * int(1e308)], [0, -1, 896, 256 * 10**16]]
    assert packed_products.scaled(x[:, :2].astype(np.float32)).tolist() == [[math.floor(256 * float(np.float32(0.1))), math.floor(256 * float(np.float32(-0.1)))], [0, -1]]


def plain(rows, every=5, n_positives=5, n_negatives=3):
    once = {}
    for vec_id, v, label, *_ in rows:
        if vec_id is None or v is None or label is None or any(x is None or not math.isfinite(x) for x in v):
            continue
        once[vec_id] = min(once.get(vec_id, (math.inf, b"")), (label, np.array(v).tobytes()))
    ints = {i: (label, [math.floor(256 * x) if abs(x) < 1e300 else 256 * int(x) for x in np.frombuffer(raw).tolist()]) for i, (label, raw) in once.items()}
    out = []
    for a, (label, v) in ints.items():
        if a % every:
            continue
        scored = [(-sum(p * q for p, q in zip(v, w)), i, own == label) for i, (own, w) in ints.items() if i != a and len(w) == len(v)]
        scored = sorted(x for x in scored if -(2**63) <= -x[0] < 2**63)
        for p, i, _ in [x for x in scored if x[2]][:n_positives]:
            near = [(s, j) for s, j, alike in scored if not alike and 50 * -p <= 100 * -s <= 95 * -p][:n_negatives]
            out += [(a, i, n, j, -p, -s) for n, (s, j) in enumerate(near, 1)]
    return sorted(out)


def make(seed, n=260, labels=4):
    rng = random.Random(seed)
    centres = [[rng.gauss(0, 1) for _ in range(6)] for _ in range(5)]
    rows = [(i, [c + rng.gauss(0, 0.4) for c in rng.choice(centres)], 0 if rng.random() < 0.4 else rng.randrange(labels)) for i in range(n)]
    rows += [(n + i, rows[i % 7][1], i % 3) for i in range(40)]  # copies and ties
    rows += [(400, None, 1), (405, [1.0, None, 0.0, 0.0, 0.0, 0.0], 1), (410, [math.nan] * 6, 1), (415, [math.inf] * 6, 2), (420, [0.0] * 6, 1), (425, [1.0] * 6, None), (430, [], 1), (435, [], 2), (440, [1.0, 2.0], 1), (445, [1.0, 1.9], 1), (450, [1.0, 1.2], 2)]
    rows += [(455, [1e12] * 6, 0), (460, [1.1e12] * 6, 0), (461, [0.7e12] * 6, 1), (465, [1e17] * 6, 0), (466, [1e308] * 6, 0), (5, rows[5][1], rows[5][2]), (10, rows[11][1], 3), (None, rows[0][1], 0)]
    return [(*r, "x", "y", "z", "w") for r in rows]


@pytest.mark.parametrize("side", [None, 16])
def test_against_plain(spark, monkeypatch, side):
    """Blocks and tiles of any size give the same rows; every case of a null, a tie, a copy or a large number is among them."""
    rows = make(3)
    if side:
        monkeypatch.setattr(packed_products, "ANCHORS", 10)
        meet = packed_products._meet
        monkeypatch.setattr(packed_products, "_meet", lambda a, r, _, score: meet(a, r, side, score))
    df = spark.createDataFrame(rows, SCHEMA).repartition(3)
    found = hard_negatives(df, F.col("label"), F.col("vec_id") % 5 == 0)
    assert found.columns == ["anchor_id", "positive_id", "rank", "negative_id", "positive_score", "negative_score"]
    want = plain(rows)
    assert sorted(map(tuple, found.collect())) == want and len(want) > 300 and any(r[4] > 2**53 for r in want)


def test_other_limits(spark):
    rows = make(4, 90)
    df = spark.createDataFrame(rows, SCHEMA)
    assert sorted(map(tuple, hard_negatives(df, F.col("label"), F.col("vec_id") % 5 == 0, 2, 1).collect())) == plain(rows, 5, 2, 1)


def test_empty(spark):
    none = spark.createDataFrame([], SCHEMA)
    assert hard_negatives(none, F.col("label"), F.col("vec_id") % 5 == 0).count() == 0
    one = spark.createDataFrame([(0, [1.0], 1, "", "", "", "")], SCHEMA)
    assert hard_negatives(one, F.col("label"), F.col("vec_id") % 5 == 0).count() == 0


@pytest.mark.skipif(not Path("/root/testdata/sf0.001").exists(), reason="no test tables")
def test_statement(spark):
    sf = "/root/testdata/sf0.001"
    con = duckdb.connect()
    con.sql(f"CREATE VIEW embeddings AS SELECT * FROM '{sf}/embeddings.parquet'")
    assert sorted(map(tuple, QUERIES["op12_hard_negatives"](spark, sf).collect())) == sorted(con.sql(packed_products.ORACLE).fetchall())
