"""Column functions over text: folding, tokens, query terms, identifiers, sizes, hashes."""

from __future__ import annotations

import re
import unicodedata
from collections.abc import Callable

from pyspark.sql import Column
from pyspark.sql import functions as F

#: Words that a query drops unless it has no others.
STOPWORDS = frozenset(
    """
    a about all an and any are as at be been but by can could did do does doing done for
    from get give giving had has have how i if in into is it its just like make me my no not
    of off on one only or other our out over should so som some such than that the their
    them then there these they this those to up use used using very was way we were what
    when where which while who why will with would you your
    """.split()
)
#: What counts as a term of a query, and how many terms a query has at most.
QUERY_TERM = r"[A-Za-z0-9_][A-Za-z0-9_.\-']*"
MOST_TERMS = 64
#: Where an identifier falls into words, and the forms of a query that names a record.
IDENTIFIER_GAP = r"(?<=[a-z0-9])(?=[A-Z])|(?<=[A-Z])(?=[A-Z][a-z])|[_\-]+"
FORM_ID = r"\b(?:0x[0-9A-Fa-f]{4,8}|[0-9A-Fa-f]{8})\b"
PLUGIN_FILE = r"(?i)(?U)[\w\-' ]+\.(?:esp|esm|esl)\b"
EDITOR_ID = r"(?U)\b[A-Za-z][A-Za-z0-9]*[a-z][A-Z][A-Za-z0-9]*\b|\b\w*_[A-Za-z]\w*\b"
#: Tokens of the index are letters, digits and private-use characters; this is what stands between them.
BETWEEN = r"[^\p{L}\p{N}\p{Co}]+"
#: The same in lower-case ASCII.
BETWEEN_ASCII = "[^a-z0-9]+"


def _latin_bases() -> tuple[str, str]:
    """Latin letters with marks, and the ASCII letters they are built on."""
    pairs = [(chr(i), unicodedata.normalize("NFD", chr(i))) for i in (*range(0xC0, 0x250), *range(0x1E00, 0x1F00))]
    marked = [(c, d[0]) for c, d in pairs if len(d) > 1 and d[0].isascii()]
    return "".join(c for c, _ in marked), "".join(d for _, d in marked)


#: Combining marks of decomposed letters stand last, without a counterpart, and so are left out.
_MARKED, _BASES = _latin_bases()
_MARKED += "".join(map(chr, range(0x300, 0x370)))


def let(value: Column, use: Callable[[Column], Column]) -> Column:
    """use(value) with value computed once for a row, wherever it stands in use, inside other lambdas too."""
    return F.get(F.transform(F.array(value), use), F.lit(0))


def without_marks(text: Column) -> Column:
    return F.translate(text, _MARKED, _BASES)


def fold(text: Column) -> Column:
    """Lower case without the marks of Latin letters, all inside the JVM."""
    return F.lower(without_marks(text))


def tokens(text: Column) -> Column:
    """Index tokens in order; null text has none. Splitting is several times faster than extracting matches.

    In a text of one byte a character nothing is folded but case, and its letters and digits are few: same tokens, sooner.
    """
    plain = F.octet_length(text) == F.length(text)
    parts = F.when(plain, F.split(F.lower(text), BETWEEN_ASCII)).otherwise(F.split(F.coalesce(fold(text), F.lit("")), BETWEEN))
    return F.array_remove(parts, "")


def query_terms(text: Column, folded: bool = True, most: int = MOST_TERMS) -> Column:
    """Terms of a query, in order, repeats kept: no single letters, no stopwords unless there is nothing else.

    Terms are ASCII; folded takes accents off first, else an accented letter ends a term.
    """
    source = without_marks(text) if folded else text
    found = F.coalesce(F.regexp_extract_all(source, F.lit(QUERY_TERM), 0), F.array().cast("array<string>"))
    long_enough = F.filter(found, lambda t: (F.length(t) > 1) | t.rlike("^[0-9]$"))
    telling = F.filter(long_enough, lambda t: ~F.lower(t).isin(*sorted(STOPWORDS)))
    return F.slice(F.when(F.size(telling) > 0, telling).otherwise(long_enough), 1, most)


def split_identifier(text: Column) -> Column:
    """CamelCase, ACRONYMWord, snake_case and kebab-case as words."""
    spaced = F.regexp_replace(F.coalesce(text, F.lit("")), IDENTIFIER_GAP, " ")
    return F.trim(F.regexp_replace(spaced, " +", " "))


def is_record_shaped(text: Column) -> Column:
    """Whether a query names a record: a form id, a plugin file, CamelCase or an identifier with underscores."""
    return F.coalesce(text.rlike(FORM_ID) | text.rlike(PLUGIN_FILE) | text.rlike(EDITOR_ID), F.lit(False))


def token_estimate(text: Column) -> Column:
    """About four characters a token, at least one; halves round to even."""
    return F.greatest(F.lit(1), F.bround(F.length(text) / 4)).cast("int")


def body_hash(text: Column) -> Column:
    return F.sha2(text, 256)


def truncated(text: Column, most: int) -> Column:
    return F.when(F.length(text) > most, F.substring(text, 1, most)).otherwise(text)


def _pattern_regex(pattern: str, star: str, one: str) -> str:
    out = ""
    for piece in re.findall(r"\*\*/|\*+|\?|\[!?\]?[^\]]*\]|.", pattern, re.S):
        if piece == "**/":
            out += "(?:.*/)?"
        elif piece[0] == "*":
            out += ".*" if len(piece) > 1 else star
        elif piece == "?":
            out += one
        elif piece[0] == "[" and len(piece) > 1:
            out += "[" + ("^" + piece[2:] if piece[1] == "!" else piece[1:]).replace("\\", "\\\\")
        else:
            out += re.escape(piece)
    return f"^(?s:{out})$"


def glob_regex(pattern: str) -> str:
    """A path pattern as a Java regex: * and ? stay inside a folder, ** crosses them, **/ may be empty, [...] is a class."""
    return _pattern_regex(pattern, "[^/]*", "[^/]")


def name_regex(pattern: str) -> str:
    """An exclusion pattern as a Java regex: as glob_regex, but * and ? cross folders too."""
    return _pattern_regex(pattern, ".*", ".")


def literal_prefix(pattern: str) -> str:
    """The folders of a pattern before its first wildcard."""
    parts = pattern.split("/")
    wild = next((i for i, p in enumerate(parts) if re.search(r"[*?\[]", p)), len(parts))
    return "/".join(parts[:wild])
