"""The two tokenizers and the conjunctive match, all in built-in expressions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

_OTHER = r"[^\p{IsAlphabetic}\p{N}]"
_SIGN = r"[^\p{IsAlphabetic}\p{N}\s]+"


def fts_tokens(text: Column) -> Column:
    """Lower case, split at whatever is not a letter or number: `foo-bar` is foo, bar."""
    return F.filter(F.split(F.lower(text), _OTHER + "+"), lambda x: x != "")


def bm25_tokens(text: Column) -> Column:
    """Lower case, split at white space, signs deleted: `foo-bar` is foobar."""
    # signs go from the whole text at once, as white space stays where it is
    return F.filter(F.split(F.regexp_replace(F.lower(text), _SIGN, ""), r"\s+"), lambda x: x != "")


def contains_all(text: Column, query: Column) -> Column:
    """Whether text holds every token of query; false for a null text and for a query without tokens."""
    wanted, low = F.array_distinct(fts_tokens(query)), F.lower(text)
    # a token is a piece of the text, so most texts are told apart before they are cut
    return F.coalesce((F.size(wanted) > 0) & F.forall(wanted, lambda t: F.contains(low, t)) & (F.size(F.array_except(wanted, fts_tokens(text))) == 0), F.lit(False))
