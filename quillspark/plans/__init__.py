"""Registered queries, and the same in DuckDB SQL."""

from . import corpus, corpus_oracles, oracles, queries

assert corpus  # its queries register themselves with those of queries
QUERIES = queries.QUERIES
ORACLES = oracles.ORACLES | corpus_oracles.ORACLES
