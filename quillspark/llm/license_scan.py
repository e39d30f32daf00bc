"""Licence scan by a positional index of rare words: align templates by relative position, then verify key phrases."""

from __future__ import annotations

import math
from collections.abc import Sequence
from functools import reduce
from operator import and_

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import ASCII_UPPER, let, words_between

#: Phrases and their labels, as the task states them.
BASE: tuple[tuple[str, str], ...] = (("mit license", "mit"), ("apache license", "apache"), ("general public license", "gpl"))
#: Label, notice and its mandatory key phrase (part of the notice), from well-known public licence notices.
TEMPLATES: tuple[tuple[str, str, str], ...] = (
    ("mit", "released under the mit license", "mit license"),
    ("mit", "permission is hereby granted free of charge to any person obtaining a copy of this software and associated documentation files", "hereby granted free of charge"),
    ("apache", "licensed under the apache license version 2 0", "apache license"),
    ("gpl", "licensed under the gnu general public license version 3", "general public license"),
    ("gpl", "redistribute it and or modify it under the terms of the gnu general public license as published by the free software foundation", "general public license"),
    ("bsd", "redistribution and use in source and binary forms with or without modification are permitted provided that the following conditions are met", "redistribution and use in source"),
    ("cc-by-nc", "licensed under cc by nc 4 0", "cc by nc"),
    ("cc-by-sa", "licensed under cc by sa 4 0", "cc by sa"),
    ("mpl", "subject to the terms of the mozilla public license v 2 0", "mozilla public license"),
    ("isc", "permission to use copy modify and or distribute this software for any purpose with or without fee is hereby granted", "distribute this software for any purpose"),
    ("lgpl", "redistribute it and or modify it under the terms of the gnu lesser general public license as published by the free software foundation", "lesser general public license"),
    ("agpl", "redistribute it and or modify it under the terms of the gnu affero general public license as published by the free software foundation", "affero general public license"),
    ("epl", "this program and the accompanying materials are made available under the terms of the eclipse public license", "eclipse public license"),
    ("unlicense", "this is free and unencumbered software released into the public domain", "free and unencumbered software"),
    ("zlib", "this software is provided as is without any express or implied warranty in no event will the authors be held liable for any damages arising from the use of this software", "authors be held liable"),
    ("boost", "permission is hereby granted free of charge to any person or organization obtaining a copy of the software and accompanying documentation covered by this license", "person or organization obtaining a copy"),
    ("cc0", "to the extent possible under law the author has waived all copyright and related or neighboring rights to this work", "waived all copyright"),
)
GAPS = r"[\x00-\x2F\x3A-\x60\x7B-\x7F]"


def words_of(text: Column) -> Column:
    return words_between(F.translate(text.cast("string"), ASCII_UPPER, ASCII_UPPER.lower()), GAPS)


def _literal(words: Sequence[str]) -> Column:
    return F.array(*(F.lit(w) for w in words))


def _starts(words: Column, phrase: Sequence[str], anchor: str) -> Column:
    """Where the phrase's words stand consecutively: places of its rarest word whose neighbours match by relative position."""
    at = phrase.index(anchor)
    places = F.filter(F.sequence(F.lit(0), F.size(words) - 1), lambda i: F.get(words, i) == anchor)
    stands = lambda i: reduce(and_, (F.coalesce(F.get(words, i + k) == w, F.lit(False)) for k, w in enumerate(phrase)))
    return F.filter(F.transform(places, lambda i: i - at), lambda i: (i >= 0) & stands(i))


def _idf(words: DataFrame, vocabulary: list[str]) -> dict[str, float]:
    """IDF of the templates' words over all documents; what comes to the driver is a row for each of these words."""
    found = words.select(F.explode(F.array_intersect("words", _literal(vocabulary))).alias("word")).groupBy("word").agg(F.count("*").alias("df"))
    df = {r["word"]: r["df"] for r in found.collect()}
    return {w: -math.log(1 + df.get(w, 0)) for w in vocabulary}


def scan_licenses(
    docs: DataFrame, base: Sequence[tuple[str, str]] = BASE, templates: Sequence[tuple[str, str, str]] = TEMPLATES, least: float = 0.6
) -> DataFrame:
    """Licence phrases and notices of each row of docs.

    docs needs doc_id and text; extra columns are ignored. Returns doc_id, n_words, n_base (all places of base
    phrases), first_word and last_word (their smallest and largest start, else null), base_labels, labels (with those
    of templates), score (the best alignment's share of template words, 0 to 1) and notices (label, start, score of
    each aligned template).

    The index holds where the rarest word, by IDF over all documents, of each template's key phrase stands in the
    template. Every place of such a word in a document gives an alignment, which counts if least of the template's words
    stand at their relative positions and its key phrase is whole; as a whole key holds its rarest word, none is missed,
    whatever else the document holds. Documents without the rarest word of any phrase hold none and are not
    looked at further. Null and empty texts have no words. Repeated rows give repeated results.
    """
    phrases = [(p.split(), label) for p, label in base]
    notices = [(label, t.split(), k.split()) for label, t, k in templates]
    vocabulary = sorted({w for p, _ in phrases for w in p} | {w for _, t, _ in notices for w in t})
    words = docs.select(F.col("doc_id").cast("long").alias("doc_id"), words_of(F.col("text")).alias("words"))
    idf = _idf(words, vocabulary)
    rarest = lambda phrase: max(phrase, key=lambda w: (idf[w], w))
    anchors = sorted({rarest(p) for p, _ in phrases} | {rarest(k) for _, _, k in notices})

    w = F.col("words")

    def labelled(phrase: list[str], label: str) -> Column:
        return F.transform(_starts(w, phrase, rarest(phrase)), lambda i: F.struct(i.cast("long").alias("start"), F.lit(label).alias("label")))

    starts = F.flatten(F.array(*(labelled(p, label) for p, label in phrases)))

    key_starts = [next(i for i in range(len(n)) if n[i : i + len(k)] == k) for _, n, k in notices]
    postings: dict[str, list[tuple[int, int]]] = {}
    for t, (_, _, k) in enumerate(notices):
        postings.setdefault(rarest(k), []).append((t, key_starts[t] + k.index(rarest(k))))
    pairs = F.create_map(*(x for word, own in postings.items() for x in (F.lit(word), F.array(*(F.struct(F.lit(t).alias("t"), F.lit(at).alias("at")) for t, at in own)))))
    bodies = F.array(*(_literal(notice) for _, notice, _ in notices))
    keys = F.array(*(_literal(key) for _, _, key in notices))
    key_at = F.array(*(F.lit(i) for i in key_starts))
    labels = F.array(*(F.lit(label) for label, _, _ in notices))

    hits = let(_literal(sorted(postings)), lambda rare: F.filter(F.sequence(F.lit(0), F.size(w) - 1), lambda i: F.array_contains(rare, F.get(w, i))))
    # an alignment as one number, so that distinct ones are found by hashing: template, then start, which may be negative
    numbers = F.transform(hits, lambda i: F.transform(F.element_at(pairs, F.get(w, i)), lambda p: p["t"].cast("long") * F.lit(1 << 40) + (i - p["at"] + (1 << 20))))
    aligned = F.transform(
        F.array_distinct(F.flatten(numbers)),
        lambda x: F.struct(F.floor(x / F.lit(1 << 40)).cast("int").alias("t"), (F.pmod(x, F.lit(1 << 40)) - (1 << 20)).cast("int").alias("start")),
    )

    def scored(p: Column) -> Column:
        body = F.element_at(bodies, p["t"] + 1)
        same = F.filter(F.sequence(F.lit(0), F.size(body) - 1), lambda j: (p["start"] + j >= 0) & F.coalesce(F.get(w, p["start"] + j) == F.get(body, j), F.lit(False)))
        key = F.element_at(keys, p["t"] + 1)
        begin = p["start"] + F.element_at(key_at, p["t"] + 1)
        whole = F.forall(F.sequence(F.lit(0), F.size(key) - 1), lambda j: (begin + j >= 0) & F.coalesce(F.get(w, begin + j) == F.get(key, j), F.lit(False)))
        score = F.size(same) / F.size(body)
        return F.struct(F.element_at(labels, p["t"] + 1).alias("label"), p["start"].cast("long").alias("start"), score.alias("score"), whole.alias("whole"))

    flagged = words.withColumn("maybe", F.arrays_overlap(w, _literal(anchors)))
    empty_base, empty_notice = F.array().cast("array<struct<start:bigint,label:string>>"), F.array().cast("array<struct<label:string,start:bigint,score:double,whole:boolean>>")
    found = flagged.withColumn("base", F.when(F.col("maybe"), starts).otherwise(empty_base))
    found = found.withColumn("notices", F.when(F.col("maybe"), F.filter(F.transform(aligned, scored), lambda x: x["whole"] & (x["score"] >= least))).otherwise(empty_notice))
    of_base = F.transform("base", lambda x: x["label"])
    of_all = F.concat(of_base, F.transform("notices", lambda x: x["label"]))
    joined = lambda x: F.array_join(F.sort_array(F.array_distinct(x)), ",")
    return found.select(
        "doc_id",
        F.size(w).cast("long").alias("n_words"),
        F.size("base").cast("long").alias("n_base"),
        F.array_min(F.transform("base", lambda x: x["start"])).alias("first_word"),
        F.array_max(F.transform("base", lambda x: x["start"])).alias("last_word"),
        joined(of_base).alias("base_labels"),
        joined(of_all).alias("labels"),
        F.coalesce(F.array_max(F.transform("notices", lambda x: x["score"])), F.lit(0.0)).alias("score"),
        F.transform("notices", lambda x: F.struct(x["label"].alias("label"), x["start"].alias("start"), x["score"].alias("score"))).alias("notices"),
    )
