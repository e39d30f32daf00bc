"""Column functions over record files: display name, quotes, localised entries."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from .text import let


def unquoted(value: Column) -> Column:
    """Trimmed, without one pair of equal quotes around it."""
    trimmed = F.trim(value)
    return F.regexp_replace(trimmed, r"""^(?s)(['"])(.*)\1$""", "$2")


def display_name(text: Column, window: int = 119) -> Column:
    """The English name of a record: after the first Name: or FULL: key, on the line or in the block below it.

    The block ends at the first line that starts in its first column, or after window lines; the value is the String:
    within three lines of - Language: English. Empty if there is none.
    """
    # what stands before the key is not split; the last of the lines is what follows the window, whole
    return let(F.split(_from_key(text), "\n", window + 2), lambda lines: _named(lines, window))


def _from_key(text: Column) -> Column:
    """The text from its first Name: or FULL: line on; empty without one."""
    return F.coalesce(F.regexp_extract(text, r"(?dms)^(?:Name|FULL):.*", 0), F.lit(""))


def _named(lines: Column, window: int) -> Column:
    """The value of the key in the first line. What lambdas look at is made before them, or they would make it for each element."""
    inline = F.trim(F.regexp_extract(F.element_at(lines, 1), r"^(?:Name|FULL):\s*(.*)$", 1))

    def localised(below: Column) -> Column:
        first_out = F.array_min(F.filter(F.sequence(F.lit(1), F.greatest(F.size(below), F.lit(1))), lambda i: F.coalesce(F.get(below, i - 1), F.lit("")).rlike(r"^\S")))
        block = F.slice(below, 1, F.coalesce(first_out - 1, F.size(below)))
        return let(block, lambda block: of_block(below, block))

    def of_block(below: Column, block: Column) -> Column:
        english = F.filter(F.sequence(F.lit(1), F.greatest(F.size(block), F.lit(1))), lambda i: F.coalesce(F.get(block, i - 1), F.lit("")).rlike(r"^\s*- Language:\s*English\s*$"))
        after = F.flatten(F.transform(english, lambda i: F.slice(below, i + 1, 3)))
        values = F.filter(after, lambda x: x.rlike(r"^\s*String:"))
        return let(values, lambda values: F.when(F.size(values) > 0, unquoted(F.regexp_extract(F.get(values, F.lit(0)), r"^\s*String:\s*(.*)$", 1))).otherwise(""))

    on_line = lambda inline: (inline != "") & ~inline.isin("|", ">", "|-", ">-")
    found = let(inline, lambda inline: F.when(on_line(inline), unquoted(inline)).otherwise(let(F.slice(lines, 2, window), localised)))
    return F.when(F.element_at(lines, 1) == "", "").otherwise(found)


#: An entry in another language than English: its line, then blank lines, lines that are indented deeper, and String: lines.
FOREIGN_ENTRY = r"(?m)^([ \t]*)- Language:[ \t]*(?!English[ \t]*$)\S+[ \t]*\n(?:[ \t]*\n|\1[ \t]+.*\n|[ \t]*String:.*\n)*+"


def without_locales(text: Column) -> Column:
    """The text without entries in other languages than English, and a last line that counts them.

    An entry goes from its - Language: line until a line with text that is indented no deeper and is no String:.
    """
    lines = F.concat(text, F.lit("\n"))
    dropped = F.regexp_count(lines, F.lit(FOREIGN_ENTRY))
    left = F.regexp_replace(F.regexp_replace(lines, FOREIGN_ENTRY, ""), r"\n\z", "")
    return F.when(dropped > 0, F.concat(left, F.format_string("\n# (%d non-English localisations omitted)", dropped))).otherwise(text)
