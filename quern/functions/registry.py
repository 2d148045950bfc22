"""The engine's SQL functions, as texts that the dialect writes out where they are called.

Written out, a function may stand anywhere in a query, ORDER BY included, and costs what its
expression costs. The session's temporary functions of the same names serve plain Spark SQL.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import SparkSession

_OTHER = r"[^\\p{{IsAlphabetic}}\\p{{N}}]"
_SIGN = r"[^\\p{{IsAlphabetic}}\\p{{N}}\\s]+"
_FTS = f"filter(split(lower({{0}}), '{_OTHER}+'), x -> x <> '')"
_FTS_OF_1 = _FTS.replace("{0}", "{1}")

#: Name: (parameters with types, result, body).
FUNCTIONS: dict[str, tuple[str, str, str]] = {
    "vector_distance": (
        "a ARRAY<DOUBLE>, b ARRAY<DOUBLE>",
        "DOUBLE",
        "(CASE WHEN size({0}) = size({1}) THEN sqrt(aggregate(zip_with(CAST({0} AS ARRAY<DOUBLE>), CAST({1} AS ARRAY<DOUBLE>), (x, y) -> (x - y) * (x - y)), 0D, (s, x) -> s + x)) "
        "WHEN {0} IS NOT NULL AND {1} IS NOT NULL THEN CAST(raise_error('vectors differ in dimension') AS DOUBLE) END)",
    ),
    "fts_tokens": ("t STRING", "ARRAY<STRING>", _FTS),
    "bm25_tokens": ("t STRING", "ARRAY<STRING>", rf"filter(split(regexp_replace(lower({{0}}), '{_SIGN}', ''), '\\s+'), x -> x <> '')"),
    "fts_match": ("t STRING, q STRING", "BOOLEAN", f"coalesce(size({_FTS_OF_1}) > 0 AND forall({_FTS_OF_1}, x -> contains(lower({{0}}), x)) AND size(array_except({_FTS_OF_1}, {_FTS})) = 0, false)"),
}


def written_out(name: str, args: Sequence[str]) -> str:
    """The SQL text of a call."""
    parameters, _, body = FUNCTIONS[name]
    wanted = parameters.count(",") + 1
    if len(args) != wanted:
        raise ValueError(f"{name} takes {wanted} arguments")
    return body.format(*args)


def register_functions(spark: SparkSession) -> None:
    """Create the session's temporary functions vector_distance, fts_tokens, bm25_tokens and fts_match."""
    for name, (parameters, result, body) in FUNCTIONS.items():
        names = [p.split()[0] for p in parameters.split(", ")]
        spark.sql(f"CREATE OR REPLACE TEMPORARY FUNCTION {name}({parameters}) RETURNS {result} RETURN {body.format(*names)}")
