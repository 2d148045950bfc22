"""Full-text, vector and hybrid search as lazy DataFrame plans.

A search scans its table and keeps k rows a task (TakeOrderedAndProject); the corpus is never
shuffled. Ranks are given only to the rows that a limit has left.
"""

from __future__ import annotations

from collections import Counter
from collections.abc import Sequence
from functools import reduce
from operator import add

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from quern.functions.text import bm25_tokens, contains_all, fts_tokens
from quern.functions.vector import l2_distance

#: The constant of reciprocal rank fusion.
RRF = 60


def fts_match(docs: DataFrame, text: str, query: str) -> DataFrame:
    """Rows whose text holds every token of the query."""
    return docs.filter(contains_all(F.col(text), F.lit(query)))


def postings(docs: DataFrame, doc_id: str, text: str) -> DataFrame:
    """(token, doc_id, tf): the inverted index of a text column."""
    tokens = docs.select(F.col(doc_id).alias("doc_id"), F.explode(fts_tokens(F.col(text))).alias("token"))
    return tokens.groupBy("token", "doc_id").agg(F.count(F.lit(1)).alias("tf"))


def match_postings(index: DataFrame, query_tokens: Sequence[str]) -> DataFrame:
    """(doc_id) of the documents that hold every token, by intersecting posting lists."""
    wanted = sorted(set(query_tokens))
    held = index.filter(F.col("token").isin(wanted)).groupBy("doc_id").agg(F.count_distinct("token").alias("held"))
    return held.filter(F.col("held") == len(wanted)).select("doc_id") if wanted else index.filter(F.lit(False)).select("doc_id")


def query_terms(docs: DataFrame, query: str) -> Counter:
    """The query's tokens with their multiplicity, cut by the same expression as texts."""
    return Counter(docs.sparkSession.range(1).select(bm25_tokens(F.lit(query)).alias("t")).first()["t"])


def bm25_search(docs: DataFrame, doc_id: str, text: str, query: str, k: int = 10, k1: float = 1.2, b: float = 0.75) -> DataFrame:
    """(doc_id, score) of the k best documents: any term counts, a repeated one repeatedly; ties by id.

    The counts of the query's terms are plain columns, so the corpus statistics are one global
    aggregation of a few numbers, joined as a single row.
    """
    terms = sorted(query_terms(docs, query).items())
    if not terms:
        return docs.select(F.col(doc_id).alias("doc_id"), F.lit(0.0).alias("score")).limit(0)
    tokens = docs.select(F.col(doc_id).alias("doc_id"), F.coalesce(bm25_tokens(F.col(text)), F.array().cast("array<string>")).alias("tokens"))
    # all counts are one expression, so that the filter below, when pushed down, holds the tokens once and not once a term
    counts = F.transform(F.lit([t for t, _ in terms]), lambda t: F.size(F.filter("tokens", lambda x: x == t)))
    counted = tokens.select("doc_id", F.struct(F.size("tokens").alias("dl"), counts.alias("tf")).alias("c"))
    stats = counted.agg(F.count(F.lit(1)).alias("n"), F.avg("c.dl").alias("avgdl"), *[F.count_if(F.col("c.tf")[i] > 0).alias(f"df{i}") for i in range(len(terms))])
    norm = F.lit(k1) * (F.lit(1 - b) + F.lit(b) * F.col("c.dl") / F.col("avgdl"))
    parts = []
    for i, (_, times) in enumerate(terms):
        tf, df = F.col("c.tf")[i], F.col(f"df{i}")
        idf = F.log((F.col("n") - df + 0.5) / (df + 0.5) + 1)
        parts.append(F.when(tf > 0, F.lit(float(times)) * idf * (tf * (k1 + 1)) / (tf + norm)).otherwise(0.0))
    scored = counted.filter(F.exists("c.tf", lambda x: x > 0)).crossJoin(F.broadcast(stats)).select("doc_id", F.round(reduce(add, parts), 6).alias("score"))
    return scored.orderBy(F.desc("score"), "doc_id").limit(k)


def vector_search(vectors: DataFrame, vec_id: str, embedding: str, query: Sequence[float], k: int = 10) -> DataFrame:
    """(vec_id, distance) of the k nearest vectors, exact; ties by id."""
    near = vectors.select(F.col(vec_id).alias("vec_id"), F.round(l2_distance(F.col(embedding), query), 6).alias("distance"))
    return near.filter(F.col("distance").isNotNull()).orderBy("distance", "vec_id").limit(k)


def vector_range(vectors: DataFrame, embedding: str, query: Sequence[float], radius: float) -> DataFrame:
    """Rows nearer than radius."""
    return vectors.filter(l2_distance(F.col(embedding), query) < radius)


def fuse(ranked: Sequence[DataFrame], k: int, constant: int = RRF) -> DataFrame:
    """(id, score) by reciprocal rank fusion of (id, rank) lists with ranks from 1; ties by id."""
    union = reduce(DataFrame.unionByName, ranked)
    fused = union.groupBy("id").agg(F.round(F.sum(F.lit(1.0) / (F.lit(constant) + F.col("rank"))), 6).alias("score"))
    return fused.orderBy(F.desc("score"), "id").limit(k)


def hybrid_search(docs: DataFrame, vectors: DataFrame, text_query: str, vector_query: Sequence[float], k: int = 10, doc_id: str = "doc_id", text: str = "text", vec_id: str = "vec_id", embedding: str = "embedding") -> DataFrame:
    """(id, score): the 2k best by BM25 and the 2k nearest vectors, fused by reciprocal rank."""
    return fuse_ranked(bm25_search(docs, doc_id, text, text_query, 2 * k), vector_search(vectors, vec_id, embedding, vector_query, 2 * k), k)


def fuse_ranked(by_text: DataFrame, by_vector: DataFrame, k: int) -> DataFrame:
    """(id, score): results (doc_id, score) and (vec_id, distance) of limited searches fused by reciprocal rank."""
    # the windows see as many rows as the searches' limits leave
    texts = by_text.select(F.col("doc_id").alias("id"), F.row_number().over(Window.orderBy(F.desc("score"), "doc_id")).alias("rank"))
    near = by_vector.select(F.col("vec_id").alias("id"), F.row_number().over(Window.orderBy("distance", "vec_id")).alias("rank"))
    return fuse([texts, near], k)
