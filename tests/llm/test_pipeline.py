"""The pipeline, stage by stage and as a whole, against plain Python."""

import math
import random
import re
import zlib
from collections import Counter, defaultdict

import duckdb
import pytest
from pyspark.sql import functions as F
from test_documents import shingles
from test_quality import model, ngrams, units

import corpus_pipeline
from quillspark.llm import kn_quality, mixing

SCHEMA = "doc_id long, text string, lang string, source string, n_chars long, `cut` string, `key` string, `a.b` string"


def make(seed=11):
    rng = random.Random(seed)
    words = [a + b for a in ("re", "th", "an", "on", "is", "la", "mo", "ku") for b in ("n", "st", "er", "or", "ing", "al", "ed", "um", "ix", "os")]
    say = lambda n: " ".join(rng.choice(words) for _ in range(n))
    common = [say(9) + ".", say(4), f"page 7 of {say(6)}"]
    texts = ["\n".join([say(rng.randint(5, 30)) for _ in range(rng.randint(1, 4))] + rng.sample(common, rng.randint(0, 2))) for _ in range(70)]
    texts += [t.replace(" ", " x", 1) for t in texts[:9]] + texts[9:14] + [f"{c * 30} ### $$$ *** {c}{c} !!! ||| " * 6 for c in "QZ9|"] + ["one", None, "", " \n "]
    texts += ["page 9 of" + common[2][9:], " ".join(rng.sample(words, 40)) * 20]
    rows = [(i, t) for i, t in enumerate(texts)] + [(3, texts[3]), (None, texts[5]), (12, texts[60])]
    sources = ["b", "a", None, "hot", "hot"]
    return [(d, t, ("en", "en", "fr", None)[n % 4], sources[n % 5], len(t or ""), "x", "y", "z") for n, (d, t) in enumerate(rows)]


def good(rows, labels, folds):
    """Rows whose smoothed mean of minus log probabilities is within their language's limit."""
    prior, trusted = 60, {d for d, q, _ in labels if q == 1 and d is not None}
    ok = lambda r: r[0] in trusted and bool(r[1])
    models = [model([r[1] for r in rows if ok(r) and folds[r[1] or ""] != f]) for f in (0, 1)]
    of = {t: (-sum(math.log(models[f](g)) for g in ngrams(t)), len(units(t))) for t, f in folds.items()}
    known = defaultdict(list)
    for r in rows:
        if ok(r):
            known[r[2]].append(of[r[1]])
    means = {k: sum(x for x, _ in v) / sum(n for _, n in v) for k, v in known.items()}
    smooth = {k: [(x + prior * means[k]) / (n + prior) for x, n in v] for k, v in known.items()}
    limit = lambda xs: sorted(xs)[math.ceil(0.999 * len(xs)) - 1] + math.log(1.2)
    everything = [(means[k], x) for k, v in smooth.items() for x in v]
    mean_of_all, limit_of_all = sum(m for m, _ in everything) / len(everything), limit([x for _, x in everything])
    kept = []
    for r in rows:
        nll, n = of[r[1] or ""]
        mean, most = (means[r[2]], limit(smooth[r[2]])) if r[2] in means else (mean_of_all, limit_of_all)
        if (nll + prior * mean) / (n + prior) <= most:
            kept.append(r)
    return kept


def tokens(line):
    return tuple("<*>" if re.search("[0-9]", w) else w for w in re.findall(r"[^\x20\x09-\x0D]+", line))


def without_lines(rows):
    """Lines that fit a template of five texts go."""
    holders = defaultdict(set)
    for t in {r[1] or "" for r in rows}:
        for line in t.split("\n"):
            if w := tokens(line):
                holders[w].add(t)
    leaves = defaultdict(list)
    for w in holders:
        leaves[len(w), w[:3]].append(w)
    fits, by_template = defaultdict(set), defaultdict(set)
    for leaf, own in leaves.items():
        total = sum(len(holders[w]) for w in own)
        at = Counter()
        for w in own:
            for i, x in enumerate(w):
                at[i, x] += len(holders[w])
        if total < 5:
            continue
        for w in own:
            often = tuple(x if at[i, x] >= 5 else None for i, x in enumerate(w))
            most = sum(2 * at[i, x] > total for i, x in enumerate(w))
            for template, hits in (((leaf, often), sum(x is not None for x in often)), ((leaf, None), most)):
                if hits >= 0.8 * len(w):
                    fits[w].add(template)
                    by_template[template] |= holders[w]
    goes = {w for w, own in fits.items() if any(len(by_template[x]) >= 5 for x in own)}
    out = []
    for r in rows:
        text = r[1]
        if text is not None:
            text = "\n".join(x for x in text.split("\n") if tokens(x) not in goes)
        out.append((r[0], text, *r[2:4], None if text is None else len(text), *r[5:]))
    return out


def first_of_groups(rows):
    sets = [shingles(r[1]) for r in rows]
    top = list(range(len(rows)))

    def find(i):
        while top[i] != i:
            i = top[i]
        return i

    for i in range(len(rows)):
        for j in range(i):
            both = len(sets[i] & sets[j])
            if both and 100 * both >= 75 * len(sets[i] | sets[j]):
                top[find(i)] = find(j)
    least = defaultdict(lambda: math.inf)
    for i, r in enumerate(rows):
        if r[0] is not None:
            least[find(i)] = min(least[find(i)], r[0])
    return [r for i, r in enumerate(rows) if not sets[i] or r[0] is None or r[0] == least[find(i)]]


def mixed(rows):
    con = duckdb.connect()
    con.execute("CREATE TABLE documents (doc_id BIGINT, text VARCHAR, source VARCHAR)")
    con.executemany("INSERT INTO documents VALUES (?, ?, ?)", [(r[0], r[1], r[3]) for r in rows])
    sql = mixing.ORACLE.replace("SELECT doc_id, source, len(", "SELECT doc_id, text, source, len(").replace("SELECT doc_id, size, source_size, target, CASE", "SELECT text, rows.source AS own_source, doc_id, size, source_size, target, CASE").replace("SELECT doc_id, size, source_size, target, (size", "SELECT doc_id, text, own_source, size, (size")
    times = {(d, t, s): taken // size if size else 1 for d, t, s, size, taken in con.sql(sql).fetchall()}
    return [r for r in rows for _ in range(times[r[0], r[1], r[3]])]


def pieces(rows, capacity=2048):
    import public_tokenizers
    from tokenizers import Tokenizer

    tokenizer = Tokenizer.from_file(public_tokenizers.path("word_bpe_49k.json"))
    out = Counter()
    for r in rows:
        ids = tokenizer.encode(r[1] or "", add_special_tokens=False).ids + [0]
        for piece, at in enumerate(range(0, len(ids), capacity)):
            own = ids[at : at + capacity]
            out[r[0], piece, at, len(own), zlib.crc32(b"".join(x.to_bytes(4, "little") for x in own))] += 1
    return out


@pytest.mark.filterwarnings("ignore")
def test_stages_and_whole(spark, tmp_path):
    rows = make()
    labels = [(i, int(i % 6 != 0), 0) for i in range(60)] + [(4, 1, 0), (None, 1, 0)]
    sf = str(tmp_path)
    spark.createDataFrame(rows, SCHEMA).repartition(3).write.parquet(f"{sf}/documents.parquet")
    spark.createDataFrame(labels, "doc_id long, quality int, toxic int").write.parquet(f"{sf}/labels.parquet")
    docs = spark.read.parquet(f"{sf}/documents.parquet")
    folds = {r["t"]: r["f"] for r in docs.select(F.coalesce("text", F.lit("")).alias("t"), kn_quality._fold().alias("f")).distinct().collect()}
    plain = [lambda x: good(x, labels, folds), without_lines, first_of_groups, mixed]
    assert len(plain) == len(corpus_pipeline.STAGES) - 1
    want, kept = rows, docs
    for (name, stage), by_hand in zip(corpus_pipeline.STAGES, plain):
        kept = stage(spark, kept, sf)
        before, want = want, by_hand(want)
        assert kept.columns == docs.columns, name
        assert Counter(tuple(r) for r in kept.collect()) == Counter(want), name
        assert want != before, name
    packed = corpus_pipeline.run(spark, sf).collect()
    assert Counter((r["doc_id"], r["piece"], r["start"], r["length"], r["ids_crc32"]) for r in packed) == pieces(want)
    by = defaultdict(list)
    for r in packed:
        by[r["sequence_id"]].append((r["offset"], r["length"]))
    for own in by.values():
        assert [at for at, _ in sorted(own)] == [sum(n for _, n in sorted(own)[:i]) for i in range(len(own))] and sum(n for _, n in own) <= 2048
    assert len(by) <= -(-sum(r["length"] for r in packed) // 2048) + 1
