"""Operators on documents against plain Python, with nulls, copies, long texts and clashing columns."""

import random
import re
import zlib
from collections import Counter, defaultdict

import duckdb
import pytest
from pyspark.sql import functions as F

from quillspark.llm import jaccard_join, kn_quality, license_scan, line_templates, mixing, packing, substring_dedup


def collected(df):
    return [r.asDict() for r in df.collect()]


def shingles(text, k=5):
    w = (text or "").encode().lower().split()
    return {tuple(w[i : i + k]) for i in range(len(w) - k + 1)} if len(w) >= k else ({tuple(w)} if w else set())


def linked(rows):
    sets = [shingles(r["text"]) for r in rows]
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
    ids = defaultdict(list)
    for i, r in enumerate(rows):
        ids[find(i)].append(r["doc_id"])
    least = {k: min((x for x in v if x is not None), default=None) for k, v in ids.items()}
    return Counter((r["doc_id"], len(sets[i]), least[find(i)] if sets[i] else r["doc_id"]) for i, r in enumerate(rows))


def test_jaccard(docs, no_docs):
    got = Counter((r["doc_id"], r["n_shingles"], r["component_id"]) for r in collected(jaccard_join.jaccard_components(docs, block=4)))
    assert got == linked(collected(docs))
    assert jaccard_join.jaccard_components(no_docs).count() == 0
    kept = jaccard_join.keep_first(docs)
    assert kept.columns == docs.columns
    want = Counter(d for d, n, c in linked(collected(docs)).elements() if d is None or n == 0 or d == c)
    assert Counter(r["doc_id"] for r in collected(kept)) == want


def test_first_of_a_group_by_rows(spark):
    """Two texts with one doc_id have the fates of their own groups, under any names of columns."""
    one, other = " ".join(f"w{i}" for i in range(40)), " ".join(f"v{i}" for i in range(40))
    rows = [(1, one, 1, 2), (5, one, 1, 2), (5, other, 1, 2), (None, one, 1, 2), (6, None, 1, 2), (7, other + " more", 1, 2), (1, one, 1, 2)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, `row_key` int, `a.b` int")
    kept = jaccard_join.keep_first(docs)
    assert kept.columns == docs.columns
    assert Counter(tuple(r) for r in kept.collect()) == Counter([rows[0], rows[2], rows[3], rows[4], rows[6]])


def test_jaccard_near_the_threshold(spark):
    """Sets of every overlap around three quarters, in one crowded group."""
    base = [f"w{i}" for i in range(104)]
    texts = [" ".join(base[: 104 - n] + [f"x{n}y{i}" for i in range(n)]) for n in range(0, 40)]
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    for many in (20_000, 3):  # without and with salted shingles
        got = Counter((r["doc_id"], r["n_shingles"], r["component_id"]) for r in collected(jaccard_join.jaccard_components(docs, block=3, many=many)))
        assert got == linked(collected(docs))


def test_quality(spark, docs, no_docs):
    labels = spark.createDataFrame([(i, int(i % 5 != 0), 0) for i in range(40)] + [(3, 1, 0), (None, 1, 0), (999, 1, 0)], "doc_id long, quality int, toxic int")
    junk = spark.createDataFrame([(500 + i, f"{c * 40} ### $$$ *** {c}{c} !!!" * 5, "en") for i, c in enumerate("QZ9|")], "doc_id long, text string, lang string")
    both = docs.select("doc_id", "text", "lang").unionByName(junk)
    found = {r["doc_id"]: r for r in collected(kn_quality.score_quality(both, labels))}
    assert all(not found[500 + i]["kept"] for i in range(4))
    assert all(found[i]["kept"] for i in range(75)) and found[75]["kept"] and found[76]["kept"]
    assert all(r["perplexity"] is not None for r in found.values())
    kept = kn_quality.keep_good(docs, labels)
    assert kept.columns == docs.columns and kept.where("doc_id < 75").count() == 76
    assert kn_quality.score_quality(no_docs, labels).count() == 0
    assert all(r["kept"] and r["perplexity"] is None for r in collected(kn_quality.score_quality(docs, labels.limit(0))))


def test_licenses(spark):
    rows = [
        (1, "Released under the MIT License. And the apache LICENSE, again mit-license"), (2, None), (3, ""), (4, "gnu General  Public\nLicense" + " word" * 9000 + " mit license"), (5, "mit. license license mit"),
        (6, "Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files"), (6, "no licence"), (None, "Licensed under CC BY-NC 4.0."), (7, "mit\u212Aé license"),
    ]
    got = [(r["doc_id"], r["n_words"], r["n_base"], r["first_word"], r["last_word"], r["base_labels"], r["labels"], r["score"]) for r in collected(license_scan.scan_licenses(spark.createDataFrame(rows, "doc_id long, text string")))]
    want = []
    for doc_id, text in rows:
        t = (text or "").translate({c: c + 32 for c in range(65, 91)})
        w = re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", t)
        hits = [(i, label) for phrase, label in license_scan.BASE for n in [len(phrase.split())] for i in range(len(w)) if w[i : i + n] == phrase.split()]
        want.append((doc_id, len(w), len(hits), min((i for i, _ in hits), default=None), max((i for i, _ in hits), default=None), ",".join(sorted({x for _, x in hits}))))
    assert Counter(g[:6] for g in got) == Counter(want)
    labels = {g[0]: g[6] for g in got if g[0] != 6}
    assert labels[1] == "apache,mit" and labels[None] == "cc-by-nc" and labels[3] == ""
    assert sorted(g[6] for g in got if g[0] == 6) == ["", "mit"]
    assert all(0 <= g[7] <= 1 for g in got)


def test_several_notices_in_a_text(spark):
    """Every alignment with a whole key is found, whatever other rare words a text holds."""
    bodies = [t for _, t, _ in license_scan.TEMPLATES]
    rare = "any charge fee hereby software redistribution mozilla forms binary conditions published foundation gnu "
    texts = [f"{bodies[9]} {bodies[6]}", f"{bodies[9]} {bodies[2]}", " and ".join(bodies), *(rare * 3 + b for b in bodies), *(f"{b} {b}" for b in bodies), "apache license", "version 2 mit license mit license", "cc by nc cc by sa"]
    docs = spark.createDataFrame([*enumerate(texts), *((100 + i, "charge fee hereby software any word") for i in range(9))], "doc_id long, text string")
    found = {r["doc_id"]: r for r in collected(license_scan.scan_licenses(docs))}
    for doc_id, text in enumerate(texts):
        w, want = text.split(), Counter()
        for label, body, key in license_scan.TEMPLATES:
            body, key = body.split(), key.split()
            at = next(i for i in range(len(body)) if body[i : i + len(key)] == key)
            for start in range(-at, len(w) - at):
                same = sum(0 <= start + j < len(w) and w[start + j] == x for j, x in enumerate(body))
                if w[start + at : start + at + len(key)] == key and same >= 0.6 * len(body):
                    want[label, start, round(same / len(body), 9)] += 1
        assert Counter((n["label"], n["start"], round(n["score"], 9)) for n in found[doc_id]["notices"]) == want
        assert {label for label, _, _ in want} <= set(found[doc_id]["labels"].split(","))
    assert found[2]["labels"] == ",".join(sorted({label for label, _, _ in license_scan.TEMPLATES}))


def test_packing(spark, docs, no_docs):
    import public_tokenizers
    from tokenizers import Tokenizer

    path = public_tokenizers.path("word_bpe_49k.json")
    rows = collected(packing.pack_documents(docs, path, capacity=256, with_ids=True))
    tokenizer = Tokenizer.from_file(path)
    want = Counter()
    for r in collected(docs):
        ids = tokenizer.encode(r["text"] or "", add_special_tokens=False).ids + [0]
        for piece, at in enumerate(range(0, len(ids), 256)):
            own = ids[at : at + 256]
            want[(r["doc_id"], piece, at, len(own), zlib.crc32(b"".join(x.to_bytes(4, "little") for x in own)))] += 1
    assert Counter((r["doc_id"], r["piece"], r["start"], r["length"], r["ids_crc32"]) for r in rows) == want
    by = defaultdict(list)
    for r in rows:
        assert len(r["ids"]) == r["length"]
        by[r["sequence_id"]].append((r["offset"], r["length"]))
    for parts in by.values():
        end = 0
        for at, n in sorted(parts):
            assert at == end
            end += n
        assert end <= 256
    assert len(by) <= -(-sum(r["length"] for r in rows) // 256) + 2
    assert packing.pack_documents(no_docs, path).count() == 0


@pytest.mark.parametrize("counts", [{7: 1}, {6: 3, 5: 3, 4: 3}, {10: 5, 1: 2, 3: 9}, {i: i % 4 + 1 for i in range(1, 11)}, {5: 1000}])
def test_bins_hold_all(counts):
    bins = packing.plan_bins(counts, 10)
    held = Counter()
    for own, n in bins:
        assert sum(own) <= 10
        for length in own:
            held[length] += n
    assert held == Counter(counts)


def test_two_fit_replaces_the_smallest():
    """6 + 3 leaves a gap of 1; in place of 3, 2 + 2 fit the gap of 4 whole."""
    assert packing.plan_bins({6: 1, 3: 1, 2: 2}, 10)[0][0] == [6, 2, 2]


def test_mixing(spark, docs, no_docs):
    rows = collected(mixing.mix_sources(docs))
    con = duckdb.connect()
    frame = docs.select("doc_id", "text", "source").toPandas()  # noqa: F841
    con.execute("CREATE TABLE documents AS SELECT doc_id::BIGINT AS doc_id, text, source FROM frame")
    key = lambda r: repr([None if v is None or v != v else round(float(v), 6) for v in (r[c] for c in ("doc_id", "size", "source_size", "target", "taken"))])
    assert sorted(map(key, rows)) == sorted(map(key, con.sql(mixing.ORACLE).df().to_dict("records")))
    assert all(r["taken"] <= 3 * r["size"] for r in rows)
    sizes = defaultdict(int)
    for r in collected(docs):
        sizes[r["source"]] += len(re.findall(r"[^\x20\x09-\x0D]+", r["text"] or ""))
    assert {r["source_size"] for r in rows} == set(sizes.values())
    taken = mixing.take_mix(docs)
    assert taken.columns == docs.columns
    words_taken = sum(len(re.findall(r"[^\x20\x09-\x0D]+", r["text"] or "")) for r in collected(taken))
    assert words_taken == sum(r["taken"] for r in rows)
    assert mixing.mix_sources(no_docs).count() == 0


def test_targets_fill_up_from_capped_sources(spark):
    sizes = spark.createDataFrame([("a", 10), ("b", 1000), ("c", 500), (None, 0)], "source string, source_size long")
    got = {r["source"]: r["target"] for r in collected(mixing.targets(sizes, (5, 2, 1), 3))}
    assert got["a"] == 30 and got[None] == 0
    assert got["b"] == pytest.approx(1480 * 2 / 3) and got["c"] == pytest.approx(1480 / 3)


def test_line_templates(spark, docs, no_docs):
    rows = [(i, f"body {'abcdefghij'[i]} text that is only here {'xyzuvwrstq'[i]} and longer\nPage {i} of 99 printed on 2020-01-0{i} by the press\nunique {'klmnopabcd'[i]} tail with more words") for i in range(8)]
    rows += [(20 + i, "same first line here\nsame second line here too") for i in range(9)] + [(30, None), (31, ""), (32, " Page  3 of\t99 printed on 2020-01-03 by the press")]
    found = {r["doc_id"]: r for r in collected(line_templates.drop_recurring_lines(spark.createDataFrame(rows, "doc_id long, text string")))}
    assert all("Page" not in found[i]["text"] and found[i]["n_dropped"] == 1 and found[i]["text"].count("\n") == 1 for i in range(8))
    assert all(found[20 + i]["n_dropped"] == 0 for i in range(9)), "copies are no boilerplate"
    assert found[30]["text"] is None and found[31]["text"] == "" and found[32]["text"] == "" and found[32]["n_dropped"] == 1
    more = line_templates.drop_recurring_lines(docs)
    assert more.columns == [*docs.columns, "n_lines", "n_dropped"] and more.count() == docs.count()
    assert line_templates.drop_recurring_lines(no_docs).count() == 0


def test_templates_of_one_leaf(spark):
    """Two lines of one leaf that recur, one among many lines that don't, fields that vary, and short and long texts."""
    word = lambda i: "".join(chr(97 + int(c)) for c in str(i))
    one, two = "all rights reserved by alpha beta gamma delta", "all rights reserved in many other lands today"
    texts = [f"{line}\nown {word(i)}" for line in (one, two) for i in range(8)] + [f"{one}\n{one}", one, "x" * 90_000 + f"\n{two}"]
    texts += [f"all rights reserved {' '.join(word(7 * i + j) for j in range(5))}" for i in range(100, 200)]
    texts += [f"seen by the keeper {word(i)} of this old house near town" for i in range(300, 309)]
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string").repartition(3)
    found = {r["doc_id"]: r for r in collected(line_templates.drop_recurring_lines(docs))}
    for i, text in enumerate(texts):
        kept = [line for line in text.split("\n") if line not in (one, two) and not line.startswith("seen by")]
        assert found[i]["text"] == "\n".join(kept) and found[i]["n_dropped"] == text.count("\n") + 1 - len(kept)


def test_lines_of_clashing_columns(spark):
    docs = spark.createDataFrame([(i, f"same line in all\nown {'abcdef'[i]}", 1, 2, 3) for i in range(6)], "`text_key` long, text string, n_lines int, `n_dropped` int, `a.b` int")
    found = line_templates.without_recurring_lines(docs)
    assert found.columns == docs.columns
    assert {(r["text"], r["n_lines"], r["n_dropped"], r["a.b"]) for r in collected(found)} == {(f"own {c}", 1, 2, 3) for c in "abcdef"}


def test_substrings(spark, docs, no_docs):
    rng = random.Random(9)

    def words(rng, n):
        return " ".join(rng.choice("renthan") + rng.choice(["ster", "ing", "al", "ed", "um", "ix"]) + rng.choice("abcdefg") for _ in range(n))

    passage = words(rng, 70)
    rows = [(i, words(rng, 60) + " " + passage + " " + words(rng, 50)) for i in range(6)] + [(10 + i, words(rng, 150)) for i in range(6)] + [(20, None), (21, ""), (2, "short")]
    found = {(r["doc_id"], r["n_bytes"]): r for r in collected(substring_dedup.drop_repeats(spark.createDataFrame(rows, "doc_id long, text string")))}
    for doc_id, text in rows:
        r = found[(doc_id, len((text or "").encode()))]
        if 0 < doc_id < 6 and text != "short":
            assert r["dropped_bytes"] > 0.6 * len(passage), "inserted text before it doesn't hide a passage"
            left = text.encode()
            for s in reversed(r["spans"]):
                assert passage.encode().find(left[s["start"] : s["stop"]]) >= 0
                left = left[: s["start"]] + left[s["stop"] :]
            assert r["text"] == left.decode()
        else:
            assert r["text"] == text and r["dropped_bytes"] == 0
    assert substring_dedup.drop_repeats(docs).count() == docs.count()
    assert substring_dedup.drop_repeats(no_docs).count() == 0


def repeats_of(rows, least=160):
    """Spans to cut by plain Python: runs of repeated chunks, and runs that grow to least bytes beside one first occurrence."""
    import numpy as np

    raw = {d: (t or "").encode() for d, t in rows}
    parts, places = {}, defaultdict(list)
    for d in sorted(raw):
        ends = substring_dedup.cuts(np.frombuffer(raw[d], np.uint8))
        parts[d] = list(zip([0, *ends], ends))
        for a, b in parts[d]:
            places[raw[d][a:b]].append((d, a))
    out = {}
    for d, own in parts.items():
        runs, joined = [], []
        for a, b in own:
            source, at = places[raw[d][a:b]][0]
            if len(places[raw[d][a:b]]) < 2 or (source, at) == (d, a):
                continue
            touches = bool(joined) and joined[-1][1] == a
            joined = [*joined[:-1], (joined[-1][0], b)] if touches else [*joined, (a, b)]
            same = touches and runs and runs[-1][1] == a and runs[-1][2:] == (source, a - at)
            runs = [*runs[:-1], (runs[-1][0], b, source, a - at)] if same else [*runs, (a, b, source, a - at)]
        spans = [(a, b) for a, b in joined if b - a >= least]
        grown = defaultdict(list)
        for a, b, source, shift in runs:
            x, y, other = a, b, raw[source]
            while a - x < substring_dedup.BEFORE and x > 0 and x - shift > 0 and raw[d][x - 1] == other[x - 1 - shift]:
                x -= 1
            while y - b < substring_dedup.AFTER and y < len(raw[d]) and y - shift < len(other) and raw[d][y] == other[y - shift]:
                y += 1
            near = grown[source, shift]
            if near and x <= near[-1][1]:
                near[-1] = (near[-1][0], max(y, near[-1][1]), near[-1][2], b)
            else:
                near.append((x, y, a, b))
        inside = lambda i: 0 < i < len(raw[d]) and raw[d][i - 1 : i + 1].isalnum()
        for x, y, a, b in [g for near in grown.values() for g in near if g[1] - g[0] >= least]:
            first, last = x, y
            while first < a and inside(first):
                first += 1
            while last > b and inside(last):
                last -= 1
            first, last = x if first - x > substring_dedup.LONGEST_WORD else first, y if y - last > substring_dedup.LONGEST_WORD else last
            while first < a and raw[d][first : first + 1].isspace():
                first += 1
            while last > b and raw[d][last - 1 : last].isspace():
                last -= 1
            spans.append((first, last))
        cut = set().union(*(range(a, b) for a, b in spans))
        out[d] = bytes(c for i, c in enumerate(raw[d]) if i not in cut).decode()
    return out


def test_substrings_as_by_plain_python(spark):
    rng = random.Random(31)
    vocabulary = ["".join(rng.choice("abcdefghijklmnopqrstuvwxyz") for _ in range(rng.randint(1, 9))) for _ in range(800)]
    words = lambda n: " ".join(rng.choice(vocabulary) for _ in range(n))
    shared = [words(n) for n in (20, 30, 45, 60, 90, 400)]
    rows = [(i, " ".join(words(rng.randint(0, 40)) + "\n" + rng.choice(shared) for _ in range(rng.randint(1, 4))) + words(5)) for i in range(80)]
    rows += [(100, rows[3][1]), (101, rows[3][1]), (102, rows[4][1][50:]), (103, "same " * 3000), (104, ""), (105, None), (106, "a"), (107, shared[5] * 3)]
    found = {r["doc_id"]: r["text"] or "" for r in collected(substring_dedup.drop_repeats(spark.createDataFrame(rows, "doc_id long, text string").repartition(3)))}
    want = repeats_of(rows)
    assert {d: t for d, t in found.items() if t != want[d]} == {}


def test_passages_of_51_words_are_cut_whole(spark):
    """Each passage stands in two texts among other words; all but few are found, and those to the last word."""
    rng = random.Random(23)
    vocabulary = ["".join(rng.choice("abcdefghijklmnopqrstuvwxyz") for _ in range(rng.randint(2, 8))) for _ in range(4000)]
    words = lambda n: " ".join(rng.choice(vocabulary) for _ in range(n))
    passages = [words(51) for _ in range(400)]
    texts = [f"{words(40)} {p} {words(40)}" for p in passages + passages]
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string").repartition(4)
    found = {r["doc_id"]: r for r in collected(substring_dedup.drop_repeats(docs))}
    assert all(found[i]["dropped_bytes"] == 0 for i in range(400))
    whole = [found[400 + i]["text"].count(" ") == 80 and p not in found[400 + i]["text"] for i, p in enumerate(passages)]
    hit = sum(found[400 + i]["dropped_bytes"] > 0 for i in range(400))
    assert hit >= 396 and sum(whole) >= 0.97 * hit, (hit, sum(whole))
    for i, text in enumerate(texts):
        for s in found[i]["spans"]:
            assert text[s["start"] : s["stop"]] in texts[i - 400]


def test_cuts_shift_with_the_content():
    import numpy as np

    data = np.random.default_rng(3).integers(97, 123, 5000, dtype=np.uint8)
    before = set(substring_dedup.cuts(data))
    after = {c - 7 for c in substring_dedup.cuts(np.concatenate([data[:7], data]))}
    assert len(before & after) > 0.9 * len(before)
    sizes = np.diff([0, *sorted(before)])
    assert sizes.max() <= substring_dedup.MOST


def test_pipeline(spark):
    import corpus_pipeline

    assert [len(s) for s in corpus_pipeline.STAGES] == [2] * 5
    sf = "/root/testdata/sf0.001"
    docs = spark.read.parquet(f"{sf}/documents.parquet")
    kept = docs
    for name, stage in corpus_pipeline.STAGES[:-1]:
        kept = stage(spark, kept, sf)
        assert kept.columns == docs.columns, name
    packed = corpus_pipeline.run(spark, sf)
    assert packed.groupBy("sequence_id").agg(F.sum("length").alias("n")).where("n > 2048").isEmpty()
    assert packed.select("doc_id").distinct().count() > 50
