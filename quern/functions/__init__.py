"""Scalar functions, as Column expressions and as SQL functions that Catalyst inlines."""

from quern.functions.registry import register_functions
from quern.functions.text import bm25_tokens, contains_all, fts_tokens
from quern.functions.vector import l2_distance

__all__ = ["bm25_tokens", "contains_all", "fts_tokens", "l2_distance", "register_functions"]
