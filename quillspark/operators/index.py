"""A stored inverted index that follows its rows: postings by a hash of the term, in segments of one state of the tables."""

from __future__ import annotations

from collections.abc import Callable, Mapping

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import text as T
from . import lexical, refresh
from .lookup import Index
from .snapshots import Change, Spec, Tables

#: Tokens of a task that writes postings: files are not too small, and the sort of so many fits a task's memory.
TOKENS = 1 << 21


def specs(name: str, owner: str, owner_of_row: str | None = None) -> dict[str, Spec]:
    """The tables of an index: its rows, replaced by their owner, and postings, which go with them. owner_of_row: an owner from a row_id."""
    return {name: Spec(owner, owner, (owner,), sums={"length": "length"}), f"{name}_postings": Spec("row_id", "term", ("term",), owner=owner_of_row or "row_id", follows=name)}


class Stored:
    """Rows of a table (with length: tokens) and their postings, as tables that change together.

    A change adds a segment of what is new and names the owners that are gone; older rows and postings of theirs are
    left out where they are read, until segments are merged. Postings lie in folders by a hash of the term, sorted by
    term, so a query opens the folders of its terms alone.
    """

    def __init__(self, tables: Tables, name: str, key: str, owner: str, fields: Mapping[str, Column]):
        self.tables, self.spark, self.name, self.key, self.owner, self.fields = tables, tables.spark, name, key, owner, fields

    def rows(self, state: dict | None = None) -> DataFrame:
        return self.tables.live(self.name, state)

    def exists(self) -> bool:
        return self.tables.exists(self.name)

    def replace(self, change: Change, rows: DataFrame, gone: DataFrame | None, dealt: bool = False) -> None:
        """Put rows in place of those of gone (owner), or without gone in place of their own owners' rows; only these are indexed.

        Postings are made from rows as they were written, and each task writes those of some TOKENS tokens by itself:
        they are much more than the rows, and are not shuffled. dealt: rows lie in few tasks for each bucket already.
        """
        total = sum((F.size(T.tokens(c)) for c in self.fields.values()), F.lit(0)).cast("long")
        change.delete(self.name, rows.select(self.owner) if gone is None else gone)
        before = self.tables.sums(self.name, change.state)["length"]
        change.add(self.name, rows.withColumn("length", total), dealt)
        tokens = self.tables.sums(self.name, change.state)["length"] - before
        new = change.added(self.name).coalesce(1 + tokens // TOKENS)
        change.add(f"{self.name}_postings", lexical.build_postings(new, self.key, self.fields), True)

    def _terms(self, terms: DataFrame) -> DataFrame:
        """(term, bucket) for a join that opens the folders of these terms alone, as Spark finds them when it runs."""
        return terms.where("term > ''").select("term", refresh.bucket("term", self.tables.buckets).alias("bucket"))

    def postings(self, terms: list[str] | None = None, state: dict | None = None) -> DataFrame:
        """Postings of living rows; with terms only theirs, which reads the folders of their buckets alone."""
        found = self.tables.live(f"{self.name}_postings", state)
        if terms is not None:
            asked = self.spark.createDataFrame([(t,) for t in terms], "term string").select(refresh.bucket("term", self.tables.buckets).alias("bucket")).distinct()
            found = found.where(F.col("bucket").isin([r["bucket"] for r in asked.collect()]) & F.col("term").isin(terms))
        return found.select("row_id", "length", "field", "term", "positions", "first")

    def sizes(self, state: dict | None = None) -> DataFrame:
        """What lexical.totals needs of the postings of living rows; lists of positions end where they are read."""
        return self.tables.live(f"{self.name}_postings", state, narrow=lexical.sized).select("term", "first", "n", "places")

    def stats(self, state: dict | None = None) -> DataFrame:
        """One row: n_rows, avg_length, as the manifest has them."""
        sums = self.tables.sums(self.name, state)
        return self.spark.createDataFrame([(sums["rows"], sums["length"] / sums["rows"] if sums["rows"] else None)], "n_rows long, avg_length double")

    def _asked(self, phrases: DataFrame) -> Callable[[DataFrame], DataFrame]:
        """Leaves postings that the phrases don't ask for out where they are read: a join with their terms, which are sent to every task while they are few, prunes the folders."""
        few = phrases.count() <= lexical.MOST_SENT
        terms = self._terms(phrases.select(F.explode("phrase").alias("term")).distinct())
        return lambda rows: rows.join(F.broadcast(terms) if few else terms, ["bucket", "term"], "left_semi")

    def hits(self, phrases: DataFrame, weights: Mapping[str, float], state: dict | None = None) -> DataFrame:
        """lexical.hits of living rows. Hits move once, to their owners, and meet there the keys that are gone."""
        asked, owner = self._asked(phrases), F.expr(self.tables.specs[f"{self.name}_postings"].owner).cast("string")
        found = self.tables.live(f"{self.name}_postings", state, narrow=lambda rows: lexical.hits(asked(rows), phrases, weights, ["segment"], owner))
        return found.select("phrase", "row_id", "length", "f")

    def index(self, phrases: DataFrame, state: dict | None = None) -> Index:
        """The index as the phrases see it."""
        found = self.tables.live(f"{self.name}_postings", state, narrow=self._asked(phrases))
        return Index(found.select("row_id", "length", "field", "term", "positions"), self.stats(state))
