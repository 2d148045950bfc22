"""Queries by name, each with SQL that an independent engine can run for the same rows."""

from quern.suite import engine, mutations, relational, search

QUERIES = relational.QUERIES | search.QUERIES | mutations.QUERIES | engine.QUERIES
ORACLES = relational.ORACLES | search.ORACLES | mutations.ORACLES | engine.ORACLES

__all__ = ["ORACLES", "QUERIES"]
