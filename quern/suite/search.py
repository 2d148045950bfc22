"""Full-text, vector and hybrid search."""

from __future__ import annotations

from pyspark.sql import functions as F

from quern.functions import bm25_tokens, fts_tokens, l2_distance
from quern.operators import search
from quern.suite.common import register
from quern.suite.relational import run_sql

QUERIES: dict = {}
ORACLES: dict[str, str] = {}
query = register(QUERIES, ORACLES)

TERMS, K = "ther onst", 10
#: A constant query vector, written out wherever it is needed.
VECTOR = [round(((k * 37) % 64 - 32) / 128, 6) for k in range(64)]
_V = f"{VECTOR}::DOUBLE[]"
_TOKENS_A = "list_filter(regexp_split_to_array(lower({}), '[^\\p{{L}}\\p{{N}}]+'), lambda x: x <> '')"
_TOKENS_B = "list_filter(list_transform(regexp_split_to_array(lower({}), '\\s+'), lambda x: regexp_replace(x, '[^\\p{{L}}\\p{{N}}]', '', 'g')), lambda x: x <> '')"
_DISTANCE = f"round(list_distance(embedding::DOUBLE[], {_V}), 6)"


def _bm25(terms: str, k: int, key: str = "doc_id") -> str:
    values = ", ".join(f"('{t}')" for t in terms.split())
    return f"""
    (WITH d AS (SELECT doc_id, {_TOKENS_B.format("text")} AS tokens FROM documents),
    s AS (SELECT count(*) AS n, avg(coalesce(len(tokens), 0)) AS avgdl FROM d),
    q AS (SELECT term, count(*) AS times FROM (VALUES {values}) AS v(term) GROUP BY term),
    tf AS (SELECT doc_id, term, times, len(tokens) AS dl, len(list_filter(tokens, lambda x: x = term)) AS tf FROM d, q),
    df AS (SELECT term, count(*) AS df FROM tf WHERE tf > 0 GROUP BY term)
    SELECT doc_id AS {key}, round(sum(times * ln((n - df + 0.5) / (df + 0.5) + 1) * tf * 2.2 / (tf + 1.2 * (0.25 + 0.75 * dl / avgdl))), 6) AS score
    FROM tf JOIN df USING (term), s WHERE tf > 0 GROUP BY doc_id ORDER BY score DESC, doc_id LIMIT {k})"""


@query(f"SELECT doc_id, {_TOKENS_A.format('text')} AS tokens FROM documents")
def fts_tokenize(t):
    return t.documents.select("doc_id", fts_tokens(F.col("text")).alias("tokens"))


@query(f"SELECT doc_id, {_TOKENS_B.format('text')} AS tokens FROM documents")
def bm25_tokenize(t):
    return t.documents.select("doc_id", bm25_tokens(F.col("text")).alias("tokens"))


@query(f"SELECT doc_id, source FROM documents WHERE list_has_all({_TOKENS_A.format('text')}, ['the', 'ther', 'onst'])")
def fts_match_and(t):
    return search.fts_match(t.documents, "text", "the ther onst").select("doc_id", "source")


@query(f"SELECT doc_id FROM documents WHERE list_has_all({_TOKENS_A.format('text')}, ['released', 'under', 'the', 'mit', 'license'])")
def fts_match_phrase_case(t):
    return run_sql(t, "SELECT doc_id FROM documents WHERE MATCH(text) AGAINST ('Released, under the MIT-License!')")


@query(f"SELECT token, doc_id, count(*) AS tf FROM (SELECT doc_id, unnest({_TOKENS_A.format('text')}) AS token FROM documents) GROUP BY token, doc_id")
def fts_index_postings(t):
    return search.postings(t.documents, "doc_id", "text")


@query(f"SELECT doc_id FROM documents WHERE list_has_all({_TOKENS_A.format('text')}, ['ther', 'onst'])")
def fts_postings_intersect(t):
    return search.match_postings(search.postings(t.documents, "doc_id", "text"), ["ther", "onst"])


@query(f"SELECT * FROM {_bm25(TERMS, K)}")
def bm25_topk(t):
    return search.bm25_search(t.documents, "doc_id", "text", TERMS, K)


@query(f"SELECT * FROM {_bm25('ther onst ther', K)}")
def bm25_repeated_terms(t):
    return search.bm25_search(t.documents, "doc_id", "text", "Ther onst, THER", K)


@query(f"SELECT vec_id, {_DISTANCE} AS distance FROM embeddings")
def vector_distance(t):
    return t.embeddings.select("vec_id", F.round(l2_distance(F.col("embedding"), VECTOR), 6).alias("distance"))


@query("SELECT vec_id, round(list_distance(embedding[1:3]::DOUBLE[], [0.1, 0.2, 0.3]::DOUBLE[]), 6) AS distance FROM embeddings")
def vector_distance_literal(t):
    return run_sql(t, "SELECT vec_id, round(VECTOR_DISTANCE(slice(embedding, 1, 3), [0.1, 0.2, 0.3]), 6) AS distance FROM embeddings")


@query(f"SELECT vec_id, label FROM embeddings WHERE list_distance(embedding::DOUBLE[], {_V}) < 1.65")
def vector_range(t):
    return search.vector_range(t.embeddings, "embedding", VECTOR, 1.65).select("vec_id", "label")


@query(f"SELECT vec_id, {_DISTANCE} AS distance FROM embeddings ORDER BY distance, vec_id LIMIT {K}")
def vector_topk(t):
    return search.vector_search(t.embeddings, "vec_id", "embedding", VECTOR, K)


@query(f"SELECT vec_id, label FROM embeddings ORDER BY {_DISTANCE}, vec_id LIMIT 5")
def vector_topk_operator(t):
    return run_sql(t, f"SELECT vec_id, label FROM embeddings ORDER BY embedding <-> {VECTOR}, vec_id LIMIT 5")


@query(f"SELECT vec_id, {_DISTANCE} AS distance FROM embeddings WHERE label = 3 ORDER BY distance, vec_id LIMIT {K}")
def filtered_knn(t):
    return search.vector_search(t.embeddings.filter(F.col("label") == 3), "vec_id", "embedding", VECTOR, K)


@query(f"""SELECT id, round(sum(1.0::DOUBLE / (60 + rank)), 6) AS score FROM (
    SELECT id, row_number() OVER (ORDER BY score DESC, id) AS rank FROM {_bm25(TERMS, 2 * K, 'id')}
    UNION ALL SELECT vec_id, row_number() OVER (ORDER BY distance, vec_id) FROM (SELECT vec_id, {_DISTANCE} AS distance FROM embeddings ORDER BY distance, vec_id LIMIT {2 * K}))
    GROUP BY id ORDER BY score DESC, id LIMIT {K}""")
def hybrid_rrf(t):
    return search.hybrid_search(t.documents, t.embeddings, TERMS, VECTOR, K)


@query(f"SELECT doc_id, label FROM documents JOIN embeddings ON doc_id = vec_id WHERE list_has_all({_TOKENS_A.format('text')}, ['the', 'of']) AND list_distance(embedding::DOUBLE[], {_V}) < 1.75")
def hybrid_filter(t):
    return run_sql(t, f"SELECT doc_id, label FROM documents JOIN embeddings ON doc_id = vec_id WHERE MATCH(text) AGAINST ('The of') AND VECTOR_DISTANCE(embedding, {VECTOR}) < 1.75")
