"""Byte-level BPE by prefixes: each byte prefix of a text has one valid last token, which appends and edits leave alone."""

from __future__ import annotations

import base64
import hashlib
from array import array
from bisect import bisect_right
from collections.abc import Iterable, Iterator
from itertools import chain

import ahocorasick
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import held, text_slices

NEVER = 1 << 40
#: Characters that are split at once, pieces that a worker remembers, and the longest of them in bytes.
WINDOW, REMEMBERED, SHORT = 1 << 18, 1 << 19, 64
#: A piece ends where it does because of so many characters after it at most (the rest of a contraction, or a space and what follows it).
AHEAD = 2


class Vocabulary:
    """Tokens and their ranks, and whether two tokens can stand side by side in an encoding.

    Byte-pair encoding merges the neighbours of lowest rank first. Two tokens stand side by side if their merged bytes
    come apart into just those two; a row of tokens is the encoding of its bytes if all its neighbours do. So the
    encoding of a prefix that ends with token t is that of the prefix before t, and t; and one t only fits.
    """

    def __init__(self, ranks: dict[bytes, int]):
        self.ranks = ranks
        self.tokens: dict[int, bytes] = {i: t for t, i in ranks.items()}
        self.names: dict[int, bytes] = {i: str(i).encode() for i in self.tokens}
        self.longest = max(map(len, ranks), default=1)
        self.ends = ahocorasick.Automaton()
        for t, i in ranks.items():
            self.ends.add_word(t.decode("latin-1"), (i, len(t)))  # a character for each byte
        self.ends.make_automaton()
        #: when a token comes about in merging, and the two that it is merged from
        self.born: dict[int, int] = {}
        self.halves: dict[int, tuple[int, int]] = {}
        for t, i in ranks.items():
            if len(t) == 1:
                self.born[i] = -1
                continue
            parts = self.merged(t, 2)
            if len(parts) != 2 or max(ranks[p] if len(p) > 1 else -1 for p in parts) >= i:
                raise ValueError(f"token {i} does not come about by merging tokens of lower rank")
            self.born[i], self.halves[i] = i, (ranks[parts[0]], ranks[parts[1]])
        if len([t for t in ranks if len(t) == 1]) != 256:
            raise ValueError("some bytes are no token")
        self.known: dict[int, bool] = {}

    @classmethod
    def read(cls, path: str) -> Vocabulary:
        with open(path, "rb") as lines:
            return cls({base64.b64decode(a): int(b) for a, b in map(bytes.split, lines)})

    def merged(self, data: bytes, least: int = 1) -> list[bytes]:
        """data by merging alone, lowest rank first and the leftmost of equals, until least parts are left."""
        parts = [data[i : i + 1] for i in range(len(data))]
        while len(parts) > least:
            rank, i = min((self.ranks.get(parts[i] + parts[i + 1], NEVER), i) for i in range(len(parts) - 1))
            if rank == NEVER:
                break
            parts[i : i + 2] = [parts[i] + parts[i + 1]]
        return parts

    def apart(self, a: int, b: int) -> bool:
        """Whether the bytes of a and b are encoded as a and b.

        Looks at the neighbours across the seam from the last ones back to single bytes: they must not merge with each
        other before one of them merges away from the seam. Of equal ranks the left one goes first.
        """
        key = a << 20 | b
        if (found := self.known.get(key)) is not None:
            return found
        x, y, x_gone, y_gone = a, b, NEVER, NEVER
        apart = True
        while True:
            rank = self.ranks.get(self.tokens[x] + self.tokens[y], NEVER)
            if rank < x_gone and rank <= y_gone and rank != NEVER:
                apart = False
                break
            if x not in self.halves and y not in self.halves:
                break
            if self.born[x] > self.born[y]:  # the later of the two is taken back
                x, x_gone = self.halves[x][1], x
            else:
                y, y_gone = self.halves[y][0], y
        if len(self.known) > 4 * REMEMBERED:
            self.known.clear()
        self.known[key] = apart
        return apart

    def _fill(self, data: bytes, last: array | list[int], done: int, stop: int) -> None:
        """last[done:stop], where it is -1 yet: an automaton finds the tokens that end at each byte, and the one that fits the prefix before it stays."""
        start = max(0, done - self.longest + 1)
        known, apart = self.known, self.apart
        for end, (t, size) in self.ends.iter(data[start:stop].decode("latin-1")):
            end += start
            if last[end] < 0:
                before = end - size
                if before < 0:
                    last[end] = t
                    continue
                seam = last[before] << 20 | t
                if known[seam] if seam in known else apart(last[before], t):
                    last[end] = t

    def fill(self, data: bytes, last: array, done: int, old: tuple[array, int] | None = None) -> None:
        """last[i], the last token of the first i + 1 bytes of data, from done on; before that it is right already.

        old: a former array whose end is for the same bytes as data from byte old[1] on. Where so many prefixes as the
        longest token has bytes agree with it, all that follow do, and are copied.
        """
        n = len(data)
        last.extend([-1] * (n - len(last)))
        while done < n:
            stop = n if old is None else min(n, max(done, old[1]) + self.longest)
            self._fill(data, last, done, stop)
            if old is not None and stop - self.longest >= old[1] and stop < n:
                there = len(old[0]) - n + stop
                if last[stop - self.longest : stop] == old[0][there - self.longest : there]:
                    last[stop:] = old[0][there:]
                    return
            done = stop

    def ids(self, last: array | list[int], n: int | None = None) -> list[int]:
        """The encoding of the first n bytes, from the last token of each prefix."""
        at, out = len(last) if n is None else n, []
        while at:
            out.append(last[at - 1])
            at -= len(self.tokens[last[at - 1]])
        return out[::-1]

    def encode(self, data: bytes) -> tuple[int, ...]:
        if (own := self.ranks.get(data)) is not None:  # a token is the last one of its own bytes
            return (own,)
        last = [-1] * len(data) if len(data) <= SHORT else array("i", b"\xff" * 4 * len(data))
        self._fill(data, last, 0, len(data))
        return tuple(self.ids(last))

    def decode(self, ids: Iterable[int]) -> bytes:
        return b"".join(map(self.tokens.__getitem__, ids))


class Pieces(dict):
    """Token ids of pieces, made when they are first asked for; short ones are remembered."""

    def __init__(self, vocabulary: Vocabulary, pattern: str):
        import regex

        super().__init__()
        self.vocabulary, self.rule = vocabulary, regex.compile(pattern)

    def __missing__(self, piece: str) -> tuple[int, ...]:
        data = piece.encode()
        ids = self.vocabulary.encode(data)
        if len(data) <= SHORT:
            if len(self) >= REMEMBERED:
                self.clear()
            self[piece] = ids
        return ids

    def split(self, text: str, start: int = 0, window: int = WINDOW) -> Iterator[list[str]]:
        """The pieces of text from start, a piece's start, in lists of a window of characters or one longer piece."""
        while start < len(text):
            stop = start + window
            while True:
                found = self.rule.findall(text, start, stop)
                ends = start + sum(map(len, found))
                if stop >= len(text):
                    break
                while found and ends > stop - AHEAD:  # what follows might lengthen these
                    ends -= len(found.pop())
                if found:
                    break
                stop += 2 * (stop - start)
            yield found
            start = ends

    def encode(self, text: str) -> Iterator[list[int]]:
        """Ids of text, list by list."""
        for found in self.split(text):
            yield list(chain.from_iterable(map(self.__getitem__, found)))


class Prefixes:
    """An encoded text that can be appended to and edited: pieces, where they start, and the last token of each byte prefix of each."""

    def __init__(self, pieces: Pieces, text: str = ""):
        self.pieces, self.text, self.starts, self.parts, self.last = pieces, "", [], [], []
        self.replace(0, 0, text)

    def ids(self) -> list[int]:
        return list(chain.from_iterable(map(self.pieces.vocabulary.ids, self.last)))

    def append(self, text: str) -> None:
        self.replace(len(self.text), len(self.text), text)

    def replace(self, start: int, stop: int, new: str) -> None:
        """Put new in place of text[start:stop]; pieces away from it stay, and so do prefixes before it and what agrees after it."""
        shift = len(new) - (stop - start)
        text = self.text[:start] + new + self.text[stop:]
        first = max(0, bisect_right(self.starts, max(0, start - AHEAD)) - 1)
        at = self.starts[first] if first < len(self.starts) else 0
        known = {s: i for i, s in enumerate(self.starts[first:], first)}
        starts, parts, last, then = [], [], [], len(self.starts)
        for piece in chain.from_iterable(self.pieces.split(text, at, 1 << 12)):
            i = known.get(at - shift)
            if at >= start + len(new) and i is not None:
                then = i
                break
            starts.append(at)
            parts.append(piece.encode())
            last.append(self._from_old(parts[-1], known.get(at)))
            at += len(piece)
        for mine, own in ((self.starts, starts), (self.parts, parts), (self.last, last)):
            mine[first:then] = own
        for i in range(first + len(starts), len(self.starts)):
            self.starts[i] += shift
        self.text = text

    def _from_old(self, data: bytes, i: int | None) -> array:
        """Last tokens of a piece, from those of the old piece at its place as far as the two agree at both ends."""
        own = array("i")
        if i is None:
            self.pieces.vocabulary.fill(data, own, 0)
            return own
        old, had = self.last[i], self.parts[i]
        most = min(len(had), len(data))
        front = _agree(data, had, most)
        back = _agree(data[::-1], had[::-1], most - front)
        own.extend(old[:front])
        self.pieces.vocabulary.fill(data, own, front, (old, len(data) - back))
        return own


def _agree(a: bytes, b: bytes, most: int) -> int:
    """Length of the common start of a and b, most at most, by halving."""
    low, high = 0, most
    while low < high:
        mid = (low + high + 1) // 2
        low, high = (mid, high) if a[low:mid] == b[low:mid] else (low, mid - 1)
    return low


def _pieces(path: str, pattern: str) -> Pieces:
    return held(f"{path} {pattern}", lambda: Pieces(Vocabulary.read(path), pattern))


def _doc_id(docs: DataFrame):
    return F.col("doc_id").cast("long").alias("doc_id")


def encode_documents(docs: DataFrame, path: str, pattern: str, with_ids: bool = False) -> DataFrame:
    """doc_id, n_tokens, ids_sha256, decoded_sha256, and with_ids ids (array) of each row of docs.

    docs needs doc_id and text; extra columns are ignored. path is a file of base64 tokens and ranks, pattern the rule
    by which a text is cut into pieces; each is encoded by the last tokens of its prefixes, without special tokens. The
    ids are decoded again, and the digests are those of their decimals between single spaces and of the decoded bytes.

    Null and empty texts have no tokens and the digests of nothing. A null doc_id stays null, repeated rows stay
    repeated, an empty table gives an empty result. A text is split window by window and digested on the way, so that
    of a very long one only its ids are held, and only with_ids. Nothing is shuffled.
    """
    fields = [("doc_id", pa.int64()), ("n_tokens", pa.int64()), ("ids_sha256", pa.string()), ("decoded_sha256", pa.string())]
    schema = pa.schema(fields + [("ids", pa.list_(pa.int32()))] * with_ids)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        pieces = _pieces(path, pattern)
        names, decode = pieces.vocabulary.names.__getitem__, pieces.vocabulary.decode
        for part in text_slices(batches, "text"):
            rows: list[list] = [[] for _ in schema]
            for doc, text in zip(part.column("doc_id").to_pylist(), part.column("text").to_pylist()):
                n, of_ids, of_bytes, kept = 0, hashlib.sha256(), hashlib.sha256(), array("i")
                for ids in pieces.encode(text or ""):
                    of_ids.update(b" " * (n > 0) + b" ".join(map(names, ids)))
                    of_bytes.update(decode(ids))
                    n += len(ids)
                    if with_ids:
                        kept.extend(ids)
                for column, value in zip(rows, (doc, n, of_ids.hexdigest(), of_bytes.hexdigest(), kept)):
                    column.append(value)
            yield pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(rows, schema)], schema=schema)

    columns = "doc_id long, n_tokens long, ids_sha256 string, decoded_sha256 string" + ", ids array<int>" * with_ids
    return docs.select(_doc_id(docs), F.col("text").cast("string").alias("text")).mapInArrow(run, columns)


def decode_documents(encoded: DataFrame, path: str) -> DataFrame:
    """doc_id, text of (doc_id, ids): null ids give null, bytes that are no UTF-8 are replaced as in any text; an id without token fails."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        vocabulary = held(path, lambda: Vocabulary.read(path))
        for part in batches:
            texts = [None if ids is None else vocabulary.decode(ids).decode(errors="replace") for ids in part.column("ids").to_pylist()]
            yield pa.RecordBatch.from_arrays([part.column("doc_id").cast(pa.int64()), pa.array(texts, pa.string())], names=["doc_id", "text"])

    return encoded.select(_doc_id(encoded), "ids").mapInArrow(run, "doc_id long, text string")


def encode_prefixes(docs: DataFrame, path: str, pattern: str) -> DataFrame:
    """doc_id, text, starts, last of each row of docs: what update_prefixes needs to follow an edit (four bytes for each byte and each piece)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        pieces = _pieces(path, pattern)
        for part in text_slices(batches, "text"):
            yield _stored([(d, Prefixes(pieces, t or "")) for d, t in zip(part.column("doc_id").to_pylist(), part.column("text").to_pylist())])

    return docs.select(_doc_id(docs), F.col("text").cast("string").alias("text")).mapInArrow(run, STORED)


STORED = "doc_id long, text string, starts binary, last binary"


def _stored(rows: list[tuple[int | None, Prefixes]]) -> pa.RecordBatch:
    columns = {
        "doc_id": pa.array([d for d, _ in rows], pa.int64()), "text": pa.array([p.text for _, p in rows], pa.string()),
        "starts": pa.array([array("i", p.starts).tobytes() for _, p in rows], pa.binary()), "last": pa.array([b"".join(x.tobytes() for x in p.last) for _, p in rows], pa.binary()),
    }
    return pa.RecordBatch.from_pydict(columns)


def update_prefixes(stored: DataFrame, changed: DataFrame, path: str, pattern: str) -> DataFrame:
    """stored, as encode_prefixes gives it, with the texts of changed (doc_id, text) in place of the old ones, and ids.

    Only rows whose doc_id is in changed are returned, one for each of stored (a null doc_id meets none); a null text
    is empty. Old and new text are compared from both ends; what lies between is encoded again, with as much of the
    neighbourhood as it reaches. Where changed holds a doc_id twice, the greater text counts.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        pieces = _pieces(path, pattern)
        for part in text_slices(batches, "text"):
            rows = []
            for doc, text, starts, last, new in zip(*(part.column(c).to_pylist() for c in ("doc_id", "text", "starts", "last", "new"))):
                old = Prefixes(pieces)
                old.text, old.starts = text, array("i", starts).tolist()
                old.parts = [text[a:b].encode() for a, b in zip(old.starts, [*old.starts[1:], len(text)])]
                every, at = array("i", last), 0
                for data in old.parts:
                    old.last.append(every[at : at + len(data)])
                    at += len(data)
                new, a = new or "", text.encode("utf-32-le")
                b = new.encode("utf-32-le")
                most = min(len(text), len(new))
                front = _agree(a, b, 4 * most) // 4
                back = _agree(a[::-1], b[::-1], 4 * (most - front)) // 4
                old.replace(front, len(text) - back, new[front : len(new) - back])
                rows.append((doc, old))
            batch = _stored(rows)
            yield batch.append_column("ids", pa.array([p.ids() for _, p in rows], pa.list_(pa.int32())))

    news = changed.groupBy(_doc_id(changed)).agg(F.max("text").alias("new"))
    return stored.join(news, "doc_id").select("doc_id", "text", "starts", "last", "new").mapInArrow(run, f"{STORED}, ids array<int>")
