"""The divergence audit against plain Python and the SQL statement."""

import random
import re
from collections import Counter, defaultdict
from pathlib import Path

import duckdb
import numpy as np
import pytest

from quillspark.llm import divergence
from quillspark.llm.divergence import audit, gallop
from quillspark.llm.queries import QUERIES

SCHEMA = "doc_id long, text string, lang string, source string, `term` string, n string, `value` string, number string"


@pytest.mark.parametrize("stride", [1, 3, 64])
def test_gallop(stride):
    rng = np.random.default_rng(0)
    for sizes in [(0, 5), (5, 0), (1, 1000), (40, 40), (300, 5000), (5000, 300), (2, 2)]:
        for most in (10, 6000, 10**6):
            a, b = (np.unique(rng.integers(0, most, n)).astype(np.int32) for n in sizes)
            x, y = gallop(a, b, stride)
            assert (a[x] == b[y]).all() and a[x].tolist() == np.intersect1d(a, b).tolist()


def plain(rows, top=10, least=10):
    lower = str.maketrans({chr(c): chr(c + 32) for c in range(65, 91)})
    docs, n, groups = defaultdict(Counter), defaultdict(Counter), defaultdict(set)
    for r in rows:
        text, lang, source = (x or "" for x in r[1:4])
        groups[lang].add(source)
        words = re.findall(r"[^\x00-\x40\x5B-\x60\x7B-\x7F]+", text.translate(lower))
        n[lang, source].update(words)
        docs[lang].update(set(words))
    out = []
    for lang, sources in groups.items():
        kept = [t for t, c in docs[lang].items() if c >= least]
        total = lambda c: sum(c[t] for t in kept) + 2 * len(kept)
        share = lambda c: {t: 1 + 10**9 * (c[t] + 2) // total(c) for t in kept}
        every = share(sum((n[lang, s] for s in sources), Counter()))
        shares = {s: share(n[lang, s]) for s in sources}
        price = lambda p, q: (p - q) ** 2 // (p + q)
        for s in sources:
            pairs = sorted((-sum(price(shares[s][t], shares[o][t]) for t in kept), o.encode()) for o in sources if o != s)
            terms = sorted((-price(shares[s][t], every[t]), t.encode()) for t in kept if n[lang, s][t] and shares[s][t] > every[t])[:top]
            out += [(lang, s, part, i.decode(), -v, r) for part, own in (("pair", pairs), ("term", terms)) for r, (v, i) in enumerate(own, 1)]
    return sorted(out)


def make(seed=1):
    rng = random.Random(seed)
    words = ["aa", "Ab", "ba", "É", "é", "日本", "zz", "q", "İx", "naïve", "the", "THE", "x_y", "don't", "a1b"]
    rows = []
    for i in range(300):
        lang, source = rng.choice(["en", "fr", None, "xx"]), rng.choice(["hot", "hot", "hot", None, "", *(f"s{k}" for k in range(20))])
        text = rng.choice([None, "", "123 !", None]) if rng.random() < 0.1 else " ".join(rng.choice(words[: rng.randint(2, 15)]) for _ in range(rng.randint(1, 30)))
        rows.append((i, text if lang != "xx" or i % 9 == 0 else "solo" + "abc"[i % 3] * (i % 5), lang, source))
    rows += [(400, "long " * 60_000 + "aa", "en", "s1"), (401, None, "no", "a"), (402, "", "no", "b"), (403, "only words here", "one", "o"), rows[0], rows[0]]
    return [(*r, "x", "y", "z", "w") for r in rows]


@pytest.mark.parametrize("block,chunk", [(divergence.BLOCK_TERMS, divergence.CHUNK), (4, 3), (1, 1)])
def test_against_plain(spark, monkeypatch, block, chunk):
    monkeypatch.setattr(divergence, "BLOCK_TERMS", block)
    monkeypatch.setattr(divergence, "CHUNK", chunk)
    rows = make()
    found = audit(spark.createDataFrame(rows, SCHEMA).repartition(4))
    assert found.columns == ["lang", "source", "part", "item", "value", "rank"]
    want = plain(rows)
    assert sorted(map(tuple, found.collect())) == want and len(want) > 1000


def test_other_settings_and_empty(spark):
    rows = make(2)[:80]
    df = spark.createDataFrame(rows, SCHEMA)
    assert sorted(map(tuple, audit(df, 3, 2).collect())) == plain(rows, 3, 2)
    assert audit(df.limit(0)).count() == 0
    assert sorted(map(tuple, audit(df.where("lang = 'xx'"), least_docs=10**6).where("value <> 0").collect())) == []


def test_large_counts():
    """Shares are exact where a billion times a count is far beyond 64 bits."""
    n = np.array([0, 5, 10**14, 4 * 10**15], np.int64)
    total = 5 * 10**15
    assert divergence._shares(n, total).tolist() == [1 + 10**9 * (int(x) + 2) // total for x in n]


def test_large_counts_as_columns(spark):
    n, total = 4 * 10**15 + 7, 5 * 10**15 + 3
    df = spark.createDataFrame([(n, total)], "n long, total long")
    assert df.select(divergence._share("n", "total").alias("p")).first()["p"] == 1 + 10**9 * (n + 2) // total


@pytest.mark.skipif(not Path("/root/testdata/sf0.001").exists(), reason="no test tables")
def test_statement(spark):
    sf = "/root/testdata/sf0.001"
    con = duckdb.connect()
    con.sql(f"CREATE VIEW documents AS SELECT * FROM '{sf}/documents.parquet'")
    found = sorted(map(tuple, QUERIES["op11_source_divergence"](spark, sf).collect()))
    assert found == sorted(con.sql(divergence.ORACLE).fetchall()) and len(found) > 500
