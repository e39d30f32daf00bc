"""Byte-level BPE by prefixes against merging by rank, and against the tokenizer library."""

import base64
import hashlib
import random
from collections import Counter

import public_tokenizers
import pytest
import tiktoken

from quillspark.llm import byte_bpe
from quillspark.llm.byte_bpe import Pieces, Prefixes, Vocabulary

PATH, PATTERN = public_tokenizers.path("byte_bpe_50k.tiktoken"), public_tokenizers.PATTERN
PARTS = ["a", "b", "'", "s", "'re", " ", "  ", "\n", "\t", "é", "日本", "1", "23", "the", " and", "!", " ", "\x1c", "re", "ll", "'l", "😀", "\x85", "ﬀ", "²", "ing", "aaaa"]


@pytest.fixture(scope="module", params=["byte_bpe_50k.tiktoken", "byte_bpe_multi_50k.tiktoken"])
def vocabulary(request):
    return Vocabulary.read(public_tokenizers.path(request.param))


@pytest.fixture(scope="module")
def library():
    with open(PATH, "rb") as lines:
        ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, lines)}
    return tiktoken.Encoding("own", pat_str=PATTERN, mergeable_ranks=ranks, special_tokens={})


def noise(rng, n):
    return "".join(rng.choice(PARTS) for _ in range(n))


def test_neighbours(vocabulary):
    """Two tokens stand side by side just when merging their bytes gives them back."""
    rng = random.Random(1)
    ids, pairs = list(vocabulary.tokens), list(vocabulary.halves.values())
    for i in range(6000):
        a, b = rng.choice(pairs) if i % 2 else (rng.choice(ids), rng.choice(ids))
        assert vocabulary.apart(a, b) == (vocabulary.merged(vocabulary.tokens[a] + vocabulary.tokens[b]) == [vocabulary.tokens[a], vocabulary.tokens[b]])


def test_each_prefix(vocabulary):
    """The last token of every prefix, and with it the encoding of every prefix, is that of merging it alone."""
    rng = random.Random(2)
    for _ in range(60):
        data = (noise(rng, 12) + rng.choice(["", "aaaaaaaaaaaaa", "ababababa"])).encode()[:60] + bytes(rng.choices(range(256), k=5))
        last = byte_bpe.array("i")
        vocabulary.fill(data, last, 0)
        for n in range(len(data) + 1):
            assert [vocabulary.tokens[i] for i in vocabulary.ids(last, n)] == vocabulary.merged(data[:n])


def test_texts_appends_edits(library):
    rng = random.Random(3)
    pieces = Pieces(Vocabulary.read(PATH), PATTERN)
    for _ in range(400):
        text = noise(rng, rng.randint(0, 60))
        assert sum(pieces.encode(text), []) == library.encode_ordinary(text)
        assert [p for found in pieces.split(text, 0, 5) for p in found] == pieces.rule.findall(text), "windows do not show"
        kept = Prefixes(pieces, text)
        for _ in range(4):
            a = rng.randint(0, len(kept.text))
            b = rng.randint(a, min(len(kept.text), a + 5))
            text = kept.text[:a] + (new := noise(rng, rng.choice([0, 1, 2, 20]))) + kept.text[b:]
            kept.replace(a, b, new)
            assert (kept.text, kept.ids()) == (text, library.encode_ordinary(text))
        kept.append("'re")
        assert kept.ids() == library.encode_ordinary(kept.text)


def test_long_piece(library):
    pieces = Pieces(Vocabulary.read(PATH), PATTERN)
    text = "".join(random.Random(4).choices("abcdefgh", k=200_000))
    assert sum(pieces.encode(text), []) == library.encode_ordinary(text)
    kept = Prefixes(pieces, text)
    filled, fill = [], Vocabulary._fill
    pieces.vocabulary._fill = lambda data, last, done, stop: (filled.append(stop - done), fill(pieces.vocabulary, data, last, done, stop))
    kept.replace(100_000, 100_001, "zq")
    assert kept.ids() == library.encode_ordinary(kept.text) and sum(filled) < 5000, "an edit reaches its neighbourhood alone"


def test_bad_vocabulary():
    single = {bytes([i]): i for i in range(256)}
    with pytest.raises(ValueError, match="lower rank"):
        Vocabulary({**single, b"abc": 256})
    with pytest.raises(ValueError, match="bytes are no token"):
        Vocabulary({b"a": 0})


def test_documents(spark, docs, no_docs, library):
    sha = lambda x: hashlib.sha256(x).hexdigest()
    want = Counter()
    for r in docs.select("doc_id", "text").collect():
        ids = library.encode_ordinary(r["text"] or "")
        want[r["doc_id"], len(ids), sha(" ".join(map(str, ids)).encode()), sha((r["text"] or "").encode())] += 1
    found = byte_bpe.encode_documents(docs, PATH, PATTERN)
    assert found.columns == ["doc_id", "n_tokens", "ids_sha256", "decoded_sha256"]
    assert Counter(map(tuple, found.collect())) == want
    assert byte_bpe.encode_documents(no_docs, PATH, PATTERN).count() == 0
    encoded = byte_bpe.encode_documents(docs, PATH, PATTERN, with_ids=True)
    assert Counter(map(tuple, byte_bpe.decode_documents(encoded, PATH).collect())) == Counter((r["doc_id"], r["text"] or "") for r in docs.collect())


def test_updates(spark, docs, library):
    stored = byte_bpe.encode_prefixes(docs, PATH, PATTERN)
    changes = [(i, "new words' " + "é" * i if i % 3 else None) for i in range(10)] + [(20, "a"), (80, "very short now"), (82, "Ünïcödé ß 日本語 " * 5 + "x" + "Ünïcödé ß 日本語 " * 4), (500, "unknown"), (None, "no id"), (20, "z")]
    changed = spark.createDataFrame(changes, "doc_id long, text string")
    want = Counter()
    for r in docs.select("doc_id").where("doc_id < 10 or doc_id in (20, 80, 82)").collect():
        text = dict(changes)[r["doc_id"]] or ""
        want[r["doc_id"], text, tuple(library.encode_ordinary(text))] += 1
    updated = byte_bpe.update_prefixes(stored, changed, PATH, PATTERN)
    assert Counter((r["doc_id"], r["text"], tuple(r["ids"])) for r in updated.collect()) == want
    again = byte_bpe.update_prefixes(updated.drop("ids"), spark.createDataFrame([(80, "very short now, and then")], "doc_id long, text string"), PATH, PATTERN)
    assert again.first()["ids"] == library.encode_ordinary("very short now, and then")
