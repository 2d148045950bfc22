"""A stored full-text index: postings in Parquet, sorted by token, so that a search reads a few row groups and no text.

A segment is a folder with three tables, each with the number of the data file that a row came
from, so that a file that is gone is passed over without writing the segment anew:

    match   (token, doc, file)            fts_tokens, once a document: conjunctive search
    rank    (token, doc, file, tf, dl)    bm25_tokens with their count and the document's length
    stats   (file, docs, tokens)          what the mean length is taken from

A task writes the postings of the rows that it read, sorted by (token, doc), and nothing is
shuffled: each text is cut once a table, a token that every document holds is spread as the rows
are, and a search takes of each file the pages of its tokens, by the column index. A search takes segments as (path, files that are alive or None for all).
"""

from __future__ import annotations

from collections.abc import Mapping, Sequence
from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from quern.functions.text import bm25_tokens, fts_tokens

Segment = tuple[str, Sequence[int] | None]


def _counted(tokens: Column) -> Column:
    """The distinct tokens in order, each with its count and the number of all: (token, tf, dl). Each array is bound once, as a lambda's variable."""

    def runs(held: Column) -> Column:
        starts = F.array_compact(F.transform(held, lambda x, i: F.when((i == 0) | (F.get(held, i - 1) != x), i)))
        size = F.size(held)
        each = lambda s: F.transform(s, lambda at, k: F.struct(F.get(held, at).alias("token"), (F.coalesce(F.get(s, k + 1), size) - at).alias("tf"), size.alias("dl")))
        return F.flatten(F.transform(F.array(starts), each))

    return F.flatten(F.transform(F.array(F.sort_array(tokens)), runs))


def build(rows: DataFrame, doc: str, text: str, path: str, file: str | None = None) -> None:
    """Write a segment over rows; a null text is a document without tokens."""
    number = F.col(file) if file else F.lit(0)
    light = rows.select(F.col(doc).alias("doc"), number.cast("int").alias("file"), F.col(text).alias("text"))
    match = light.select(F.explode(F.array_distinct(fts_tokens(F.col("text")))).alias("token"), "doc", "file")
    match.sortWithinPartitions("token", "doc").write.parquet(f"{path}/match")
    rank = light.select("doc", "file", F.explode(_counted(bm25_tokens(F.col("text")))).alias("x")).select("x.token", "doc", "file", "x.tf", "x.dl")
    rank.sortWithinPartitions("token", "doc").write.parquet(f"{path}/rank")
    held = rows.sparkSession.read.schema("file int, tf int").parquet(f"{path}/rank").groupBy("file").agg(F.sum("tf").alias("tokens"))
    stats = light.groupBy("file").agg(F.count(F.lit(1)).alias("docs")).join(held, "file", "left")
    stats.select("file", "docs", F.coalesce("tokens", F.lit(0)).cast("long").alias("tokens")).coalesce(1).write.parquet(f"{path}/stats")


def _read(spark: SparkSession, segments: Sequence[Segment], name: str, tokens: Sequence[str] | None = None) -> DataFrame:
    parts = []
    for path, alive in segments:
        part = spark.read.parquet(f"{path}/{name}")
        # reaches the scan, where the row groups of other tokens are passed over
        part = part if tokens is None else part.filter(F.col("token").isin(list(tokens)))
        parts.append(part if alive is None else part.filter(F.col("file").isin(list(alive))))
    return reduce(DataFrame.unionByName, parts)


def matching(spark: SparkSession, segments: Sequence[Segment], tokens: Sequence[str]) -> DataFrame:
    """(doc) of the documents that hold every token; none where there is no token."""
    wanted = sorted(set(tokens))
    found = _read(spark, segments, "match", wanted)
    if len(wanted) == 1:
        return found.select("doc")
    return found.groupBy("doc").agg(F.count(F.lit(1)).alias("held")).filter((F.col("held") == len(wanted)) & F.lit(bool(wanted))).select("doc")


def bm25(spark: SparkSession, segments: Sequence[Segment], terms: Mapping[str, int], k: int = 10, k1: float = 1.2, b: float = 0.75) -> DataFrame:
    """(doc_id, score) of the k best documents, as search.bm25_search gives them."""
    found = _read(spark, segments, "rank", sorted(terms))
    stats = _read(spark, segments, "stats").agg(F.sum("docs").alias("n"), (F.sum("tokens") / F.sum("docs")).alias("avgdl"))
    times = F.lit(0)
    for t, m in sorted(terms.items()):
        times = F.when(F.col("token") == t, F.lit(m)).otherwise(times)
    df = found.groupBy("token").agg(F.count(F.lit(1)).alias("df"))
    # one row for each of the query's terms, and one of statistics
    scored = found.join(F.broadcast(df), "token").crossJoin(F.broadcast(stats))
    idf = F.log((F.col("n") - F.col("df") + 0.5) / (F.col("df") + 0.5) + 1)
    part = times * idf * (F.col("tf") * (k1 + 1)) / (F.col("tf") + k1 * (F.lit(1 - b) + b * F.col("dl") / F.col("avgdl")))
    return scored.groupBy(F.col("doc").alias("doc_id")).agg(F.round(F.sum(part), 6).alias("score")).orderBy(F.desc("score"), "doc_id").limit(k)
