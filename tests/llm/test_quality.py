"""The Kneser-Ney model against plain Python, and the classifier on labels that it was not fitted on."""

import math
import random
from collections import Counter, defaultdict

import pytest
from pyspark.sql import functions as F

from quillspark.llm import kn_quality


def units(text):
    """Code units of a text; a space after a word that repeats the word before it is a symbol of its own."""
    out, word, before = [], "", None
    for c in text:
        if c.isspace():
            out.append(kn_quality.REPEAT if word and word == before else ord(c))
            word, before = "", word
        else:
            word += c
            raw = c.encode("utf-16-le")
            out += [int.from_bytes(raw[i : i + 2], "little") for i in range(0, len(raw), 2)]
    return out


def ngrams(text, n=4):
    padded = [0] * (n - 1) + units(text)
    return [tuple(padded[i : i + n]) for i in range(len(padded) - n + 1)]


def model(texts):
    """p(gram) by the textbook: counts of the longest grams, continuation counts below, three discounts for each order."""
    counts = {4: Counter(g for t in texts for g in ngrams(t))}
    for order in (3, 2, 1):
        counts[order] = Counter(g[1:] for g in counts[order + 1])
    less, total, kinds = {}, defaultdict(Counter), defaultdict(Counter)
    for order, own in counts.items():
        n = Counter(own.values())
        y = n[1] / max(1, n[1] + 2 * n[2])
        less[order] = [0.0] + [min(float(i), max(0.01, i - (i + 1) * y * n[i + 1] / n[i])) if n[i] else 0.5 * i for i in (1, 2, 3)]
        for g, c in own.items():
            total[order][g[:-1]] += c
            kinds[order][g[:-1]] += less[order][min(c, 3)]

    def p(gram):
        order = len(gram)
        below = p(gram[1:]) if order > 1 else 1 / 65536
        c, t = counts[order][gram], total[order][gram[:-1]]
        return ((c - less[order][min(c, 3)]) + kinds[order][gram[:-1]] * below) / t if t else below

    return p


TEXTS = ["the cat sat on the mat", "a dog ran, and ran ran!\nthe end", "", "THE 99", "Üñï 日本語 日本語 😀", "x", "the cat sat on the mat", "a " * 40, "plain words that stand in no other text", "кот и кот кот", "z" * 30]


def test_nll_is_that_of_plain_python(spark):
    docs = spark.createDataFrame([*enumerate(TEXTS), (20, None), (21, "kept out")], "doc_id long, text string").repartition(3)
    keys = {r["doc_id"]: (r["key"], r["fold"]) for r in docs.select("doc_id", kn_quality._key().alias("key"), kn_quality._fold().alias("fold")).collect()}
    trusted = spark.createDataFrame([(i,) for i in range(len(TEXTS))], "doc_id long")
    assert {f for _, f in keys.values()} == {0, 1}
    for size in (1 << 20, 16):  # one block of each fold, or nearly one for each text
        found = {r["key"]: (r["nll"], r["n"]) for r in kn_quality.text_nll(docs, trusted, size).collect()}
        assert len(found) == len({k for k, _ in keys.values()})
        for fold in (0, 1):
            p = model([t for i, t in enumerate(TEXTS) if t and keys[i][1] != fold])
            for i, text in [*enumerate(TEXTS), (20, ""), (21, "kept out")]:
                if keys[i][1] == fold:
                    want = -sum(math.log(p(g)) for g in ngrams(text))
                    assert found[keys[i][0]] == (pytest.approx(want, rel=1e-5, abs=1e-6), len(units(text)))


def test_model_sums_to_one(spark):
    texts = spark.createDataFrame([(0, t) for t in TEXTS], "fold int, text string")
    alphas, gammas = kn_quality.train(texts)
    share = alphas.withColumn("context", F.when(F.col("order") > 1, kn_quality._context()).otherwise(0)).groupBy("fold", "order", "context").agg(F.sum("alpha").alias("a"))
    sums = share.join(gammas, ["fold", "order", "context"]).select((F.col("a") + F.col("gamma")).alias("s")).collect()
    assert sums and all(r["s"] == pytest.approx(1) for r in sums)


def test_labels_held_out(spark):
    """Fitted on the labels of half of the documents: those of the other half are told apart."""
    sf = "/root/testdata/sf0.01"
    docs, labels = (spark.read.parquet(f"{sf}/{t}.parquet") for t in ("documents", "labels"))
    half = F.pmod(F.xxhash64("doc_id"), F.lit(2)) == 0
    found = kn_quality.score_quality(docs, labels.where(half)).join(labels.where(~half), "doc_id")
    counts = {(r["quality"], r["kept"]): r["n"] for r in found.groupBy("quality", "kept").agg(F.count("*").alias("n")).collect()}
    assert counts[0, False] >= 0.9 * (counts[0, False] + counts.get((0, True), 0)), counts
    assert counts[1, True] >= 0.99 * (counts[1, True] + counts.get((1, False), 0)), counts


def test_rejected_rows_go_and_no_others(spark):
    rng = random.Random(3)
    word = lambda: rng.choice(["ren", "tha", "mol", "ist", "ver", "and"]) + rng.choice(["ing", "er", "al", "ed"])
    rows = [(i, " ".join(word() for _ in range(60)) + ".", "en", 1, 2, 3) for i in range(60)]
    rows += [(100 + i, "$$$ ZZQX|||%% ###KKJH@@@!! " * (4 + i % 2), "en", 1, 2, 3) for i in range(300)] + [(None, rows[0][1], None, 1, 2, 3), (7, None, "en", 1, 2, 3), (8, "", "xx", 1, 2, 3)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string, `key` int, `a.b` int, `row` int").repartition(4)
    labels = spark.createDataFrame([(i, 1, 0) for i in range(50)] + [(3, 1, 0), (None, 1, 0), (100, 0, 1)], "doc_id long, quality int, toxic int")
    kept = kn_quality.keep_good(docs, labels)
    assert kept.columns == docs.columns
    assert Counter(r["doc_id"] for r in kept.collect()) == Counter(r[0] for r in rows if r[0] is None or r[0] < 100)
    # without trusted text in one of the folds, the other's model stands for both
    one = docs.where(kn_quality._fold() == 0).select("doc_id").where("doc_id < 50").withColumn("quality", F.lit(1))
    assert kn_quality.score_quality(docs, one).where("perplexity is null").isEmpty()
