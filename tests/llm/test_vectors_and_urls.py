import math
from collections import Counter
from urllib.parse import quote

import numpy as np
import pytest
from pyspark.sql import functions as F

from quillspark.llm import cap_near_dup, hnsw, url_filter

SCHEMA = "vec_id long, embedding array<float>, label int, `key` string, `class` string"


def vectors(n=900, d=24):
    rng = np.random.default_rng(2)
    v = rng.standard_normal((n, d))
    v[600:700] = v[:100] + 0.12 * rng.standard_normal((100, d))
    v[700:740] = v[5]
    v[740:800] = v[7] + 0.1 * rng.standard_normal((60, d))
    rows = [(i, x.astype(np.float32).tolist(), [None, 1, 2][min(2, i % 7)] if i % 7 < 2 else 2, "k", "c") for i, x in enumerate(v)]
    rows += [(2000, None, 1, "k", "c"), (2001, [0.0] * d, 1, "k", "c"), (2002, [float("nan")] + [1.0] * (d - 1), 1, "k", "c"), (2003, [None] + [1.0] * (d - 1), 1, "k", "c"), (2004, [float("inf")] * d, 1, "k", "c"), (2005, [1.0, 2.0], 2, "k", "c"), (2006, [], 2, "k", "c")]
    rows.append(rows[10])
    return rows


def good(e):
    return bool(e) and all(x is not None and math.isfinite(x) for x in e) and any(e)


def test_nearest(spark):
    rows = vectors()
    got = hnsw.nearest(spark.createDataFrame(rows, SCHEMA).repartition(4), F.col("vec_id") % 20 == 0, shard_rows=200).collect()
    by = {}
    for r in got:
        by.setdefault(r["query_id"], {})[r["rank"]] = (r["score"], r["vec_id"])
    usable = {r[0]: np.array(r[1], np.float64) for r in rows if good(r[1])}
    assert set(by) == {i for i in usable if i % 20 == 0}
    hit = total = 0
    for q, found in by.items():
        same = [(float(np.sqrt(((v - usable[q]) ** 2).sum())), i) for i, v in usable.items() if i != q and len(v) == len(usable[q])]
        want = sorted(same)[:10]
        assert sorted(found) == list(range(1, len(found) + 1)) and [found[r] for r in sorted(found)] == sorted(found.values())
        for s, i in found.values():
            assert abs(s - np.sqrt(((usable[i] - usable[q]) ** 2).sum())) < 1e-9
        hit += len({i for _, i in want} & {i for _, i in found.values()})
        total += len(want)
    assert hit >= 0.9 * total
    assert hnsw.nearest(spark.createDataFrame([], SCHEMA), F.col("vec_id") % 20 == 0).count() == 0


def test_near_vectors(spark):
    rows = vectors()
    got = Counter((r["vec_id"], r["n_links"], r["component_id"], r["kept"]) for r in cap_near_dup.near_vectors(spark.createDataFrame(rows, SCHEMA).repartition(4), block=200).collect())
    ok = [i for i, r in enumerate(rows) if good(r[1]) and r[2] is not None]
    top = {i: i for i in range(len(rows))}
    links = Counter()

    def find(i):
        while top[i] != i:
            i = top[i]
        return i

    for x, i in enumerate(ok):
        for j in ok[:x]:
            a, b = (np.array(rows[k][1], np.float64) for k in (i, j))
            if len(a) == len(b) and rows[i][2] == rows[j][2] and a @ b / np.sqrt(a @ a) / np.sqrt(b @ b) >= 0.93:
                links[i] += 1
                links[j] += 1
                top[find(i)] = find(j)
    least = {}
    for i in range(len(rows)):
        least[find(i)] = min(least.get(find(i), 1 << 60), rows[i][0])
    want = Counter((rows[i][0], links[i], least[find(i)], rows[i][0] == least[find(i)]) for i in range(len(rows)))
    assert sum((want - got).values()) <= 0.01 * len(rows)
    assert cap_near_dup.near_vectors(spark.createDataFrame([], SCHEMA)).count() == 0


@pytest.mark.parametrize("sides", [(32, 32), (32, 256), (64, 2048)])
def test_pairs_share_filters_at_every_size(sides):
    """At the least cosine, for random vectors and for such that have the first half of the components alone; groups, filters of a group and whole lists agree."""
    rng = np.random.default_rng(17)
    codes = cap_near_dup.ProductCodes(64, *sides)
    for wide in (64, 32):
        x, z = rng.standard_normal((2, 1000, 64)) * (np.arange(64) < wide)
        x /= np.linalg.norm(x, axis=1, keepdims=True)
        z -= (z * x).sum(axis=1, keepdims=True) * x
        y = 0.93 * x + np.sqrt(1 - 0.93**2) * z / np.linalg.norm(z, axis=1, keepdims=True)
        x, y = codes.rounded(x), codes.rounded(y)
        lists = codes.decode(x)
        shared = sum(len(np.intersect1d(a, b, assume_unique=True)) > 0 for a, b in zip(lists, codes.decode(y)))
        assert shared >= 996
    rows, groups = codes.firsts(x)
    assert {(n, g) for n, own in enumerate(lists) for g in set((own // codes.second).tolist())} == set(zip(rows.tolist(), groups.tolist()))
    for g in (0, codes.first + 3, 3 * codes.first):
        j, n = codes.seconds(x, g)
        assert sorted(zip(n.tolist(), j.tolist())) == [(i, f - g * codes.second) for i, own in enumerate(lists) for f in own.tolist() if f // codes.second == g]
        assert [own.tolist() for own in codes.decode(x[:50], g)] == [own[own < (g + 1) * codes.second].tolist() for own in lists[:50]]


def _all_links(rows):
    """n_links and component_id of vectors of one label, by all pairs."""
    v = np.array([r[1] for r in rows], np.float64)
    v /= np.linalg.norm(v, axis=1, keepdims=True)
    link = v @ v.T >= 0.93
    np.fill_diagonal(link, False)
    least = np.arange(len(rows))
    while True:
        lower = np.minimum(least, np.where(link, least[None, :], len(rows)).min(axis=1))
        if (lower == least).all():
            return {r[0]: (int(n), int(c)) for r, n, c in zip(rows, link.sum(axis=1), least)}
        least = lower


@pytest.mark.parametrize("block", [cap_near_dup.GROUP, 150])
def test_links_near_the_threshold(spark, block, monkeypatch):
    """Pairs just above it, and a label of one direction with noise, most of which link: whole blocks and small ones agree with all pairs."""
    monkeypatch.setattr(cap_near_dup, "TILE", 200)
    rng = np.random.default_rng(4)
    x, z = rng.standard_normal((2, 500, 64))
    x /= np.linalg.norm(x, axis=1, keepdims=True)
    z -= (z * x).sum(axis=1, keepdims=True) * x
    y = 0.935 * x + np.sqrt(1 - 0.935**2) * z / np.linalg.norm(z, axis=1, keepdims=True)
    apart = [(i, v.astype(np.float32).tolist(), 1) for i, v in enumerate(np.concatenate([x, y]))]
    close = [(i, v.astype(np.float32).tolist(), 2) for i, v in enumerate(x[0] + 0.033 * rng.standard_normal((700, 64)))]
    want = _all_links(close)
    assert 0 < sum(n for n, _ in want.values()) < 0.9 * 700 * 700
    rows = apart + [(10_000 + i, v, n) for i, v, n in close]
    found = cap_near_dup.near_vectors(spark.createDataFrame(rows, "vec_id long, embedding array<float>, label int").repartition(4), block=block).collect()
    first, second = ([r for r in found if (r["vec_id"] >= 10_000) == is_close] for is_close in (False, True))
    assert all(r["n_links"] <= 1 and (r["n_links"] == 0 or r["component_id"] == r["vec_id"] % 500) for r in first)
    assert sum(r["n_links"] for r in first) >= 996
    got = {r["vec_id"] - 10_000: (r["n_links"], r["component_id"] - 10_000) for r in second}
    assert all(got[i][0] <= n and got[i][1] == c for i, (n, c) in want.items())
    assert sum(n for n, _ in got.values()) >= 0.999 * sum(n for n, _ in want.values())


def host_path(url):
    if url is None or "://" not in url:
        return "", ""
    rest = url.split("://", 1)[1]
    end = min((i for i in map(rest.find, "/?#") if i >= 0), default=len(rest))
    path = rest[end:]
    stop = min((i for i in map(path.find, "?#") if i >= 0), default=len(path))
    return rest[:end].translate({c: c + 32 for c in range(65, 91)}), path[:stop]


def test_urls(spark):
    rows = [(i, f"http{'s' * (i % 2)}://{h}.example.{t}/{p}/{i}") for i, (h, t, p) in enumerate((h, t, p) for h in ("good", "blog.fine", "spam-x") for t in ("com", "net", "org") for p in ("en", "de", "es", "fr"))]
    rows += [(100, None), (101, ""), (102, "no-scheme/com/en/"), (103, "HTTP://A.B.COM"), (104, "x://Com/en/?q"), (105, "http://example.com/en/7#a"), (106, "http://notexample.com/en/7"), (107, "ftp://u@h:1/en//x://y"), (108, "http://é.net/de/日本" + quote("x y")), (109, "http://example.net/de/8/" + "z" * 3000), (109, "http://example.net/de/8/" + "z" * 3000), (None, "http://x.org/es/"), (110, "a\nb://c.com/en/\n")]
    found = [r.asDict() for r in url_filter.filter_urls(spark.createDataFrame([(*r, "clash") for r in rows], "page_id long, url string, decided string")).collect()]
    got = Counter((r["page_id"], r["host"], r["path"], r["rule"]) for r in found)
    want = Counter()
    for page, url in rows:
        host, path = host_path(url)
        fits = [rule for _, rule in url_filter.RULES for h, _, p in [rule.partition("/")] if (host == h or host.endswith("." + h)) and path.startswith("/" + p)]
        want[(page, host, path, max(fits, key=len, default=None))] += 1
    assert got == want
    decided = {rule: verdict for verdict, rule in url_filter.RULES}
    assert all(r["verdict"] == decided[r["rule"]] if r["rule"] else r["verdict"] in ("allow", "block") for r in found)
    assert url_filter.filter_urls(spark.createDataFrame([], "page_id long, url string")).count() == 0
    assert all(r["verdict"] == "allow" for r in url_filter.filter_urls(spark.createDataFrame([(1, "http://a.fr/x"), (2, None)], "page_id long, url string")).collect())


def test_model_tells_kinds_apart(spark):
    rows = [(i, f"http://w{i}.example.com/en/cheap-pills-{i}") for i in range(60)] + [(100 + i, f"http://w{i}.example.net/de/garten-buch-{i}") for i in range(60)]
    rows += [(1000 + i, f"http://w{i}.example.fr/xx/cheap-pills-{i}") for i in range(20)] + [(2000 + i, f"http://w{i}.example.fr/xx/garten-buch-{i}") for i in range(20)]
    found = url_filter.filter_urls(spark.createDataFrame(rows, "page_id long, url string")).where("rule is null").collect()
    right = sum((r["verdict"] == "block") == (r["page_id"] < 2000) for r in found)
    assert len(found) == 40 and right >= 36
