"""Splitting documents along headings, fences and tables: a table function from one document to its chunks."""

from __future__ import annotations

import re
from collections.abc import Iterator
from dataclasses import dataclass, field

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import text as T

#: Sizes in characters, and what joins a breadcrumb.
TARGET, MOST, LEAST = 1800, 3000, 400
CRUMB = " › "
#: A new number has all documents chunked again.
VERSION = "1"
FENCE = re.compile(r"\s{0,3}(```|~~~)")
HEADING = re.compile(r"\s{0,3}(#{1,6})\s+(.+?)\s*#*\s*$")
ROW = re.compile(r"\s{0,3}\|")
RULE = re.compile(r"\s{0,3}\|[\s:|-]+\|?\s*$")


@dataclass
class Piece:
    """Lines that stay together, and how many characters they join to."""

    path: list[str] = field(default_factory=list)
    lines: list[str] = field(default_factory=list)
    size: int = -1
    kind: str = "prose"

    def add(self, line: str) -> Piece:
        self.lines.append(line)
        self.size += len(line) + 1
        return self


def tagged(lines: list[str]) -> Iterator[tuple[str, str, bool]]:
    """(line, kind, whether a block starts here); kinds: fence, table, blank, prose."""
    mark, before = "", ""
    for line in lines:
        found = FENCE.match(line)
        if mark:
            yield line, "fence", False
            if found and line.strip().startswith(mark):
                mark, before = "", "closed"
            continue
        if found:
            mark = found[1]
            yield line, "fence", True
            before = "fence"
            continue
        kind = "table" if ROW.match(line) else "prose" if line.strip() else "blank"
        yield line, kind, before in ("", "closed", "blank", "fence") or (kind == "table") != (before == "table")
        before = kind


def sections(body: str) -> list[Piece]:
    """Parts that start at headings of level 1 to 3 outside fences, with the path of headings above; blank parts are left out."""
    out = [Piece()]
    for line, kind, _ in tagged(body.split("\n")):
        found = None if kind == "fence" else HEADING.match(line)
        if found and len(found[1]) <= 3:
            above = out[-1].path
            out.append(Piece([[], [found[2].strip()], above[:1] + [found[2].strip()]][len(found[1]) - 1]))
        out[-1].add(line)
    return [p for p in out if any(line.strip() for line in p.lines)]


def merged(parts: list[Piece]) -> list[Piece]:
    """Neighbours under one second-level heading join if one of them is small and both together are not large."""
    out: list[Piece] = []
    for part in parts:
        last = out[-1] if out else None
        if last and last.path and part.path[:1] == last.path[:1] and min(last.size, part.size) < LEAST and last.size + part.size + 1 <= TARGET:
            shared = next((i for i, (a, b) in enumerate(zip(last.path, part.path)) if a != b), min(len(last.path), len(part.path)))
            out[-1] = Piece(last.path[:shared], last.lines + part.lines, last.size + part.size + 1)
        else:
            out.append(part)
    return out


def blocks(lines: list[str]) -> Iterator[Piece]:
    """Fences and runs of table rows whole, prose up to and with its blank line; what is too long is cut between lines."""
    found: list[Piece] = []
    for line, kind, starts in tagged(lines):
        if starts or not found:
            found.append(Piece(kind=kind))
        found[-1].add(line)
    for block in found:
        if block.size <= MOST or block.kind == "fence":
            yield block
        elif len(block.lines) >= 3 and RULE.match(block.lines[1]):
            yield from cut(block.lines[2:], block.lines[:2])
        else:
            yield from cut(block.lines, [])


def cut(lines: list[str], head: list[str]) -> Iterator[Piece]:
    """Parts of about TARGET characters, each with the head before it."""
    fresh = lambda: Piece(lines=list(head), size=sum(map(len, head)) + len(head) - 1)
    part = fresh()
    for line in lines:
        if len(part.lines) > len(head) and part.size + len(line) + 1 > TARGET:
            yield part
            part = fresh()
        part.add(line)
    yield part


def packed(lines: list[str]) -> Iterator[str]:
    """One text if it is not too long, else blocks gathered up to TARGET characters."""
    whole = "\n".join(lines).strip("\n")
    if len(whole) <= MOST:
        yield whole
        return
    held = Piece()
    for block in blocks(lines):
        if held.lines and held.size + block.size + 1 > TARGET:
            yield "\n".join(held.lines).strip("\n")
            held = Piece()
        held = Piece(lines=held.lines + block.lines, size=held.size + block.size + 1)
    yield "\n".join(held.lines).strip("\n")


def chunks_of(title: str, body: str) -> Iterator[tuple[list[str], str, str]]:
    """(heading_path, breadcrumb, text) of each chunk of a document."""
    found = False
    for part in merged(sections(body)):
        for text in packed(part.lines):
            if text.strip():
                found = True
                yield part.path, CRUMB.join([title, *part.path]), text
    if not found and body.strip():
        yield [], title, body.strip()


COLUMNS = "doc_id string, chunk_index int, n_chunks int, heading_path array<string>, breadcrumb string, text string"


def _chunk(batches: Iterator[pa.RecordBatch], along: tuple[str, ...] = ()) -> Iterator[pa.RecordBatch]:
    schema = pa.schema([("doc_id", pa.string()), ("chunk_index", pa.int32()), ("n_chunks", pa.int32()), ("heading_path", pa.list_(pa.string())), ("breadcrumb", pa.string()), ("text", pa.string())])
    for batch in batches:
        for at in range(0, len(batch), 500):
            cut = [(doc["doc_id"], list(chunks_of(doc["title"] or doc["doc_id"] or "", doc["body"] or ""))) for doc in batch.slice(at, 500).to_pylist()]
            rows = [
                {"doc_id": doc_id, "chunk_index": i, "n_chunks": len(own), "heading_path": path, "breadcrumb": crumb, "text": text}
                for doc_id, own in cut
                for i, (path, crumb, text) in enumerate(own)
            ]
            which = pa.array([k for k, (_, own) in enumerate(cut) for _ in own], pa.int64())
            made = pa.RecordBatch.from_pylist(rows, schema=schema)
            for name in along:
                made = made.append_column(name, batch.column(name).slice(at, 500).take(which))
            yield made


def embed_text() -> Column:
    """What of a chunk is embedded; it follows from the chunk, so it need not be stored."""
    return F.concat_ws("\n\n", "breadcrumb", "text").alias("embed_text")


def chunk(documents: DataFrame, along: tuple[str, ...] = ()) -> DataFrame:
    """Chunks of documents (doc_id, title, body): chunk_id, doc_id, chunk_index, n_chunks (of the document), heading_path, breadcrumb, text, n_tokens, embed_text.

    A fence is never cut, a long table is cut between rows with its head repeated, other long blocks between lines. A
    blank body has no chunk. Documents are independent, so there is no shuffle. along: columns of a document that its
    chunks have too.
    """
    rows = documents.select(F.col("doc_id").cast("string").alias("doc_id"), F.col("title").cast("string").alias("title"), F.col("body").cast("string").alias("body"), *along)
    kinds = "".join(f", {name} {rows.schema[name].dataType.simpleString()}" for name in along)
    cut_rows = rows.mapInArrow(lambda batches: _chunk(batches, along), COLUMNS + kinds)
    return cut_rows.select(
        F.concat_ws("#", "doc_id", "chunk_index").alias("chunk_id"), "doc_id", "chunk_index", "n_chunks", "heading_path", "breadcrumb", "text",
        T.token_estimate(F.col("text")).alias("n_tokens"), embed_text(), *along,
    )


def line_parts(body, target: int = TARGET):
    """Number of parts of a text cut between lines, as a fold inside the JVM: a part takes lines while it stays within target."""
    start = F.struct(F.lit(0).alias("parts"), F.lit(-1).alias("size"))
    add = lambda s, n: F.struct(
        F.when((s["size"] < 0) | (s["size"] + n + 1 > target), s["parts"] + 1).otherwise(s["parts"]).alias("parts"),
        F.when((s["size"] < 0) | (s["size"] + n + 1 > target), n).otherwise(s["size"] + n + 1).alias("size"),
    )
    return F.aggregate(F.transform(F.split(body, "\n"), F.length), start, add, lambda s: s["parts"])


def audit(chunks: DataFrame) -> DataFrame:
    """One row: n_chunks, n_docs, oversize, unbalanced fences, mean chunks for a document, longest chunk."""
    fences = F.size(F.filter(F.split("text", "\n"), lambda x: x.rlike(r"^\s{0,3}(```|~~~)")))
    return chunks.agg(
        F.count("*").alias("n_chunks"), F.countDistinct("doc_id").alias("n_docs"), F.count_if(F.length("text") > MOST).alias("oversize"),
        F.count_if(fences % 2 == 1).alias("unbalanced"), F.round(F.count("*") / F.countDistinct("doc_id"), 6).alias("per_doc"), F.max(F.length("text")).cast("long").alias("longest"),
    )


def longest(chunks: DataFrame, n: int = 8) -> DataFrame:
    """The n largest chunks: (chunk_id, n_chars)."""
    size = F.length("text").cast("long").alias("n_chars")
    return chunks.select("chunk_id", size).orderBy(F.desc("n_chars"), "chunk_id").limit(n)
