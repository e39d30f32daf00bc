"""Search filters as a conjunction of predicates that reach the scan."""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass
from functools import reduce
from operator import and_

from pyspark.sql import Column
from pyspark.sql import functions as F

EVERY_SCOPE = "both"


@dataclass(frozen=True)
class Filters:
    """None means no condition; generated: exclude, include or only."""

    game: str | None = None
    section: str | None = None
    kind: str | None = None
    project: str | None = None
    mod: str | None = None
    tag: str | None = None
    doc_id: str | None = None
    text: str | None = None
    generated: str = "exclude"
    include_superseded: bool = False

    def predicate(self, every_scope: str = EVERY_SCOPE) -> Column:
        found: list[Column] = []
        if self.game:
            found.append(F.col("game").isin(self.game, every_scope))
        if self.section:
            found.append((F.col("section") == self.section) | F.col("section").startswith(f"{self.section}/"))
        for name in ("kind", "project", "mod"):
            if value := getattr(self, name):
                found.append(F.col(name) == value)
        if self.tag:
            found.append(F.array_contains("tags", self.tag))
        if self.doc_id:
            found.append(F.col("doc_id") == self.doc_id)
        if self.text:
            found.append(F.lower("doc_id").contains(self.text.lower()) | F.lower("title").contains(self.text.lower()))
        if self.generated != "include":
            generated = F.coalesce(F.col("generated"), F.lit(False))  # a flag that is not set is no
            found.append(generated if self.generated == "only" else ~generated)
        if not self.include_superseded:
            found.append(~F.coalesce(F.col("superseded"), F.lit(False)))
        return reduce(and_, found, F.lit(True))


def given_value(given: Column, name: str, otherwise: str | None = None) -> Column:
    """A field of filters that are given as a map of texts; null, or otherwise, if it is not there or empty."""
    found = F.nullif(F.try_element_at(given, F.lit(name)), F.lit(""))
    return found if otherwise is None else F.coalesce(found, F.lit(otherwise))


def given_predicate(given: Column, every_scope: str = EVERY_SCOPE, generated: str | None = None) -> Column:
    """The conditions of Filters where they are a column, a map from field to text; generated stands in for that field."""
    met: list[Column] = []

    def when(name: str, holds: Callable[[Column], Column]) -> None:
        value = given_value(given, name)
        met.append(value.isNull() | F.coalesce(holds(value), F.lit(False)))

    when("game", lambda v: (F.col("game") == v) | (F.col("game") == every_scope))
    when("section", lambda v: (F.col("section") == v) | F.startswith(F.col("section"), F.concat(v, F.lit("/"))))
    for name in ("kind", "project", "mod", "doc_id"):
        when(name, lambda v, name=name: F.col(name) == v)
    when("tag", lambda v: F.array_contains("tags", v))
    when("text", lambda v: F.contains(F.lower("doc_id"), F.lower(v)) | F.contains(F.lower("title"), F.lower(v)))
    flag = lambda name: F.coalesce(F.col(name), F.lit(False))
    kind = F.lit(generated) if generated else given_value(given, "generated", "exclude")
    met.append(F.when(kind == "include", True).when(kind == "only", flag("generated")).otherwise(~flag("generated")))
    met.append((F.lower(given_value(given, "include_superseded", "false")) == "true") | ~flag("superseded"))
    return reduce(and_, met)


def clamped(value: int, low: int, high: int) -> int:
    return max(low, min(high, value))
