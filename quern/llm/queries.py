"""The operators' queries over the whole tables, and SQL that gives the same rows where SQL can."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from quern.llm import bk_simhash, block_naming, cross_parsing, html_lstm, licenses, line_frequency, mixing, packing, sharding, token_blocks
from quern.llm.common import table

#: Parameters of the queries, which the SQL shares.
MAX_DOCS, MIN_KEPT = 10, 0.1
SHARD_BYTES = 1 << 20
WEIGHTS, BUDGET_SHARE = {"src0": 0.5, "src1": 2.0, "src2": 2.0, "src3": 1.5}, 0.9
CAPACITY, GROUP_DOCS = 4096, 8192


def op1_token_blocks(spark: SparkSession, sf_dir: str) -> DataFrame:
    return token_blocks.encode(table(spark, sf_dir, "documents"))


def op2_license_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    return licenses.scan(table(spark, sf_dir, "documents"))


def op3_line_frequency(spark: SparkSession, sf_dir: str) -> DataFrame:
    return line_frequency.clean(table(spark, sf_dir, "documents"), max_docs=MAX_DOCS, min_kept=MIN_KEPT)


def op4_min_slack_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return packing.pack(table(spark, sf_dir, "documents"), CAPACITY, GROUP_DOCS)


def op5_html_blocks(spark: SparkSession, sf_dir: str) -> DataFrame:
    return html_lstm.label(table(spark, sf_dir, "pages"))


def op6_extendible_shards(spark: SparkSession, sf_dir: str) -> DataFrame:
    return sharding.assign(table(spark, sf_dir, "documents"), SHARD_BYTES)


def op7_exact_copies(spark: SparkSession, sf_dir: str) -> DataFrame:
    return block_naming.copies(table(spark, sf_dir, "documents"))


def op8_weighted_mix(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mixing.plan(table(spark, sf_dir, "documents"), WEIGHTS, budget_share=BUDGET_SHARE)


def op9_cross_parsing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return cross_parsing.scores(table(spark, sf_dir, "documents"))


def op10_near_copies(spark: SparkSession, sf_dir: str) -> DataFrame:
    return bk_simhash.near_copies(table(spark, sf_dir, "documents"))


def _quoted(s: str) -> str:
    return "'" + s.replace("'", "''") + "'"


def license_sql() -> str:
    values = ", ".join(f"({_quoted(name)}, {_quoted(text)})" for name, text in licenses.KNOWN)
    plain = "sha256(trim(replace({}, chr(10), ' ')))"
    return f"""
WITH known AS (SELECT digest, min(license) AS license FROM (SELECT {plain.format(licenses.canonical_sql('text'))} AS digest, license FROM (VALUES {values}) AS k(license, text)) GROUP BY digest),
forms AS (SELECT doc_id, {licenses.canonical_sql('text')} AS form FROM documents),
units AS (
  SELECT doc_id, 0 AS line, form AS unit FROM forms WHERE form <> ''
  UNION ALL
  SELECT doc_id, CAST(generate_subscripts(string_split(form, chr(10)), 1) AS INTEGER), unnest(string_split(form, chr(10))) FROM forms WHERE form <> ''),
digests AS (SELECT doc_id, line, {plain.format('unit')} AS digest FROM units)
SELECT doc_id, CASE WHEN line = 0 THEN 'text' ELSE 'line' END AS scope, line, license, digest FROM digests JOIN known USING (digest)"""


def line_frequency_sql(max_docs: int = MAX_DOCS, min_kept: float = MIN_KEPT, keep_first: bool = True) -> str:
    first = "f.first = l.text" if keep_first else "false"
    return f"""
WITH parts AS (
  SELECT *, generate_subscripts(string_split(text, chr(10)), 1) AS nth, unnest(string_split(text, chr(10))) AS line FROM documents WHERE text IS NOT NULL),
lines AS (SELECT *, coalesce('=' || source, '') AS host, nullif(lower(trim(regexp_replace(line, '[\\t\\r ]+', ' ', 'g'))), '') AS norm, length(trim(line, ' ' || chr(9) || chr(13))) AS size FROM parts),
frequent AS (SELECT host, norm, arg_min(text, doc_id) AS first FROM lines WHERE norm IS NOT NULL GROUP BY host, norm HAVING count(DISTINCT text) > {max_docs}),
kept AS (SELECT l.*, f.first IS NULL OR {first} AS stays FROM lines l LEFT JOIN frequent f ON l.host = f.host AND l.norm = f.norm)
SELECT doc_id, string_agg(line, chr(10) ORDER BY nth) FILTER (WHERE stays) AS text, any_value(lang) AS lang, any_value(source) AS source, any_value(n_chars) AS n_chars
FROM kept GROUP BY doc_id
HAVING coalesce(sum(size) FILTER (WHERE stays), 0) > 0 AND sum(size) FILTER (WHERE stays) >= sum(size) * {min_kept!r}"""


def sharding_sql(limit_bytes: int = SHARD_BYTES) -> str:
    return f"""
WITH d AS (SELECT row_number() OVER () AS r, doc_id, CAST('0x' || md5('shard:' || coalesce(CAST(doc_id AS VARCHAR), chr(0) || 'null') || ':' || coalesce(md5(text), chr(0) || 'null'))[1:15] AS BIGINT) AS h, coalesce(strlen(text), 0) AS b FROM documents),
levels AS (SELECT d.*, l, h >> (60 - l) AS p FROM d, (SELECT CAST(range AS INTEGER) AS l FROM range(0, 61))),
fits AS (SELECT l, p, CAST(sum(b) AS BIGINT) AS s FROM levels GROUP BY l, p HAVING sum(b) <= {limit_bytes} OR min(h) = max(h)),
leaf AS (SELECT r, any_value(doc_id) AS doc_id, any_value(h) AS h, any_value(b) AS b, min(l) AS depth, arg_min(s, l) AS s FROM levels JOIN fits USING (l, p) GROUP BY r)
SELECT doc_id, lpad(bin(h), 60, '0')[1:depth] AS shard, depth, CAST(b AS BIGINT) AS n_bytes, s AS shard_bytes FROM leaf"""


COPIES_SQL = """
SELECT doc_id, keep_id, copies FROM (
  SELECT doc_id, first(doc_id) OVER same AS keep_id, count(*) OVER (PARTITION BY text) AS copies, row_number() OVER same AS nth
  FROM documents WHERE text IS NOT NULL WINDOW same AS (PARTITION BY text ORDER BY doc_id NULLS LAST)) WHERE nth > 1"""


def mixing_sql(weights: dict[str, float] = WEIGHTS, share: float = BUDGET_SHARE, columns: str = "doc_id, source, n_tokens, source_tokens, finish, mix_tokens, key, queue") -> str:
    cases = " ".join(f"WHEN {_quoted(k)} THEN {float(v)!r}::DOUBLE" for k, v in sorted(weights.items()))
    return f"""
WITH d AS (
  SELECT doc_id, source, coalesce(source, '') AS queue, coalesce(len(regexp_extract_all(text, '[^ \\t\\n\\x0B\\f\\r]+')), 0) AS n_tokens,
    md5('mix:' || coalesce(CAST(doc_id AS VARCHAR), chr(0) || 'null')) || md5(coalesce(text, '')) AS key FROM documents),
w AS (SELECT *, CASE queue {cases} ELSE 1.0::DOUBLE END AS weight FROM d),
q AS (SELECT *, CAST(sum(n_tokens) OVER (PARTITION BY queue ORDER BY key RANGE UNBOUNDED PRECEDING) AS BIGINT) AS source_tokens FROM w WHERE weight > 0),
f AS (SELECT *, source_tokens::DOUBLE / weight AS finish FROM q),
m AS (SELECT *, CAST(sum(n_tokens) OVER (ORDER BY finish, queue, key RANGE UNBOUNDED PRECEDING) AS BIGINT) AS mix_tokens FROM f)
SELECT {columns} FROM m WHERE mix_tokens <= CAST(floor((SELECT sum(n_tokens) FROM q) * {share!r}::DOUBLE) AS BIGINT)"""


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    f.__name__: f
    for f in (op1_token_blocks, op2_license_scan, op3_line_frequency, op4_min_slack_packing, op5_html_blocks, op6_extendible_shards, op7_exact_copies, op8_weighted_mix, op9_cross_parsing, op10_near_copies)
}

ORACLES: dict[str, str] = {
    "op2_license_scan": license_sql(),
    "op3_line_frequency": line_frequency_sql(),
    "op6_extendible_shards": sharding_sql(),
    "op7_exact_copies": COPIES_SQL,
    "op8_weighted_mix": mixing_sql(),
}
