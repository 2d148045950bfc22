"""Operators over small DataFrames: nulls, empties, ties."""

import math

import pytest
from pyspark.sql import functions as F

from quern.functions import bm25_tokens, fts_tokens, l2_distance
from quern.operators import changes, search


def test_tokenizers_differ(spark):
    row = spark.createDataFrame([("Foo-bar, BAZ_1 été!",)], "t string").select(fts_tokens(F.col("t")), bm25_tokens(F.col("t"))).first()
    assert row[0] == ["foo", "bar", "baz", "1", "été"] and row[1] == ["foobar", "baz1", "été"]


def test_bm25_by_hand(spark):
    docs = spark.createDataFrame([(1, "a b a"), (2, "b c"), (3, None), (4, ""), (5, "b c")], "doc_id long, text string")
    got = {r["doc_id"]: r["score"] for r in search.bm25_search(docs, "doc_id", "text", "A c c", 9).collect()}
    idf = lambda df: math.log((5 - df + 0.5) / (df + 0.5) + 1)
    part = lambda tf, dl: tf * 2.2 / (tf + 1.2 * (0.25 + 0.75 * dl / (7 / 5)))
    assert got == {1: round(idf(1) * part(2, 3), 6), 2: round(2 * idf(2) * part(1, 2), 6), 5: round(2 * idf(2) * part(1, 2), 6)}
    assert [r["doc_id"] for r in search.bm25_search(docs, "doc_id", "text", "c", 1).collect()] == [2]
    assert search.bm25_search(docs, "doc_id", "text", " ?! ", 5).count() == 0


def test_distance(spark):
    df = spark.createDataFrame([([0.0, 3.0],), (None,)], "v array<float>")
    assert [r[0] for r in df.select(l2_distance(F.col("v"), [4.0, 0.0])).collect()] == [5.0, None]
    with pytest.raises(Exception, match="dimension"):
        df.select(l2_distance(F.col("v"), [1.0])).collect()


def test_vector_search_ties_by_id(spark):
    df = spark.createDataFrame([(3, [1.0]), (1, [-1.0]), (2, None)], "vec_id long, embedding array<double>")
    assert [tuple(r) for r in search.vector_search(df, "vec_id", "embedding", [0], 5).collect()] == [(1, 1.0), (3, 1.0)]


def test_fusion_takes_the_union(spark):
    docs = spark.createDataFrame([(1, "x"), (2, "x x")], "doc_id long, text string")
    vectors = spark.createDataFrame([(2, [0.0]), (9, [1.0])], "vec_id long, embedding array<double>")
    got = [tuple(r) for r in search.hybrid_search(docs, vectors, "x", [0.0], 5).collect()]
    assert got[0][0] == 2 and {g[0] for g in got} == {1, 2, 9}


def test_postings(spark):
    docs = spark.createDataFrame([(1, "a b a"), (2, "b"), (3, None)], "doc_id long, text string")
    index = search.postings(docs, "doc_id", "text")
    assert {tuple(r) for r in index.collect()} == {("a", 1, 2), ("b", 1, 1), ("b", 2, 1)}
    assert [r[0] for r in search.match_postings(index, ["b", "a", "a"]).collect()] == [1]
    assert search.match_postings(index, []).count() == 0


def test_changes(spark):
    df = spark.createDataFrame([(1, "a"), (2, None), (None, "c")], "id long, v string")
    assert sorted(map(str, (tuple(r) for r in changes.update(df, {"v": "concat(v, id)", "id": F.col("id") + 1}, "id = 1").collect()))) == ["(2, 'a1')", "(2, None)", "(None, 'c')"]
    assert changes.delete(df, "v = 'a'").count() == 2 and changes.delete(df).count() == 0
    new = spark.createDataFrame([(2, "z"), (None, "n")], "id long, v string")
    assert sorted(map(str, (tuple(r) for r in changes.upsert(df, new).collect()))) == ["(1, 'a')", "(2, 'z')", "(None, 'n')"]
