"""Stored indexes: what they give, what they read, and how they follow changes."""

import numpy as np
import pytest
from test_plans import plan

from quern.operators import fts_index, ivf, joins, search
from quern.plans import Engine

DOCS = [(1, "Foo-bar, baz baz"), (2, "baz"), (3, None), (4, ""), (5, "foo bar foobar"), (6, "BAZ foo qux")]


@pytest.fixture(scope="module")
def segment(spark, tmp_path_factory):
    path = str(tmp_path_factory.mktemp("fts") / "segment")
    fts_index.build(spark.createDataFrame(DOCS, "doc_id long, text string"), "doc_id", "text", path)
    return path


@pytest.mark.parametrize("query", ["foo bar", "baz", "FOO", "none", "", "foobar qux"])
def test_index_finds_what_a_scan_finds(spark, segment, query):
    docs = spark.createDataFrame(DOCS, "doc_id long, text string")
    wanted = sorted(r["doc_id"] for r in search.fts_match(docs, "text", query).collect())
    assert sorted(r["doc"] for r in fts_index.matching(spark, [(segment, None)], query.lower().split()).collect()) == wanted


def test_indexed_bm25_matches_a_scan(spark, segment):
    docs = spark.createDataFrame(DOCS, "doc_id long, text string")
    for query in ("baz foo", "baz baz", "foobar", "none"):
        got, wanted = (sorted(tuple(r) for r in df.collect()) for df in (fts_index.bm25(spark, [(segment, None)], search.query_terms(docs, query)), search.bm25_search(docs, "doc_id", "text", query)))
        assert got == wanted


def test_searches_by_index_read_no_text(spark, tmp_path):
    e = Engine(spark, str(tmp_path))
    e.sql("CREATE TABLE t (id INT, body TEXT, place VECTOR(2)); CREATE INDEX a ON t (body) USING FTS; CREATE INDEX b ON t (place) USING HNSW")
    e.sql("INSERT INTO t VALUES (1, 'red fish', [0, 1]), (2, 'blue fish', [1, 0]), (3, 'red bird', [1, 1])")
    for df in (e.bm25_search("t", "body", "fish"), e.sql("SELECT id FROM t WHERE MATCH(body) AGAINST ('red') AND id < 3"), e.vector_search("t", "place", [0.0, 1.0], 2)):
        assert "body" not in plan(df)
    assert "PushedFilters: [In(token, [fish])]" in plan(e.bm25_search("t", "body", "fish")) or "EqualTo(token,fish)" in plan(e.bm25_search("t", "body", "fish"))
    assert [tuple(r) for r in e.vector_search("t", "place", [0.0, 1.0], 2).collect()] == [(1, 0.0), (3, 1.0)]
    assert e.metrics()["index_searches"] == 6


def test_index_follows_changes(spark, tmp_path):
    e = Engine(spark, str(tmp_path))
    e.sql("CREATE TABLE t (id INT, body TEXT); INSERT INTO t VALUES (1, 'red fish'), (2, 'blue fish'), (NULL, 'red sun'); CREATE INDEX a ON t (body) USING FTS")
    ask = lambda sql, *p: sorted((r[0] for r in e.sql(sql, p).collect()), key=str)
    same = lambda q: ask("SELECT id FROM t WHERE MATCH(body) AGAINST ($1)", q) == ask("SELECT id FROM t WHERE fts_match(body, $1)", q)
    assert ask("SELECT id FROM t WHERE MATCH(body) AGAINST ('red')") == [1, None]
    e.sql("UPDATE t SET body = 'green fish' WHERE id = 1; INSERT INTO t VALUES (2, 'red whale'), (4, 'red fish'); DELETE FROM t WHERE id IS NULL")
    assert ask("SELECT x.id FROM t AS x WHERE MATCH(x.body) AGAINST ('red')") == [2, 4] and all(map(same, ("fish", "red", "red fish", "sun", "")))
    assert ask("SELECT id FROM t WHERE NOT MATCH(body) AGAINST ('red') OR id = 4") == [1, 4]
    assert ask("SELECT a.id FROM t a JOIN t b ON a.id = b.id WHERE MATCH(b.body) AGAINST ('green') AND MATCH(a.body) AGAINST ('fish')") == [1]
    scanned = [tuple(r) for r in search.bm25_search(e.table("t"), "id", "body", "red fish", 5).collect()]
    assert [tuple(r) for r in e.bm25_search("t", "body", "red fish", 5).collect()] == scanned
    e.sql("BEGIN; DELETE FROM t; ROLLBACK")
    e.compact("t")
    assert ask("SELECT id FROM t WHERE MATCH(body) AGAINST ('red')") == [2, 4] and e.checkpoint() > 0
    assert ask("SELECT id FROM t WHERE MATCH(body) AGAINST ('red')") == [2, 4]


@pytest.mark.parametrize("clustered", [True, False])
def test_vector_index_recall(spark, tmp_path, clustered):
    r = np.random.default_rng(0)
    x = r.standard_normal((3000, 16))
    if clustered:
        x = r.standard_normal((40, 16))[r.integers(0, 40, 3000)] * 3 + x * 0.3
    rows = spark.createDataFrame([(k, v.tolist()) for k, v in enumerate(x)] + [(9999, None)], "id long, v array<double>")
    ivf.build(rows, "id", "v", f"{tmp_path}/ivf")
    segments, hits = [(f"{tmp_path}/ivf", None)], 0
    queries = x[::300] + r.standard_normal((10, 16)) * 0.05
    for q in queries:
        exact = set(np.argsort(((x - q) ** 2).sum(1))[:10].tolist())
        hits += len(exact & {r["vec_id"] for r in ivf.search(spark, segments, q.tolist()).collect()})
    assert hits >= 0.9 * 10 * len(queries)
    assert spark.read.parquet(f"{tmp_path}/ivf/centres").first()["probed"] < (0.2 if clustered else 0.9)


def test_vector_index_checks_dimensions(spark, tmp_path):
    rows = spark.createDataFrame([(1, [1.0, 2.0]), (2, [1.0])], "id long, v array<double>")
    with pytest.raises(Exception, match="dimension"):
        ivf.build(rows, "id", "v", f"{tmp_path}/a")
    ivf.build(rows.filter("id = 1"), "id", "v", f"{tmp_path}/b")
    with pytest.raises(ValueError, match="dimension"):
        ivf.search(spark, [(f"{tmp_path}/b", None)], [1.0])
    ivf.build(rows.filter("id > 2"), "id", "v", f"{tmp_path}/c")
    assert ivf.search(spark, [(f"{tmp_path}/c", None)], [1.0]).count() == 0


def test_asof_join_by_brute_force(spark):
    from datetime import datetime, timedelta

    r = np.random.default_rng(1)
    at = lambda: datetime(2024, 1, 1) + timedelta(hours=int(r.integers(0, 200)))
    left = [(int(k), at(), n) for n, k in enumerate(r.integers(0, 4, 80))] + [(1, None, 900), (None, at(), 901)]
    right = [(int(k), at(), n) for n, k in enumerate(r.integers(0, 3, 60))] + [(1, None, 902)]
    got = joins.asof_join(spark.createDataFrame(left, "k int, t timestamp, a int"), spark.createDataFrame(right, "k int, t timestamp, b int"), ["k"], "t")
    best = lambda k, t: max(((u, b) for j, u, b in right if j == k and u and t and u <= t), default=(None, None))[1]
    assert sorted((x["a"], x["b"]) for x in got.collect()) == sorted((a, best(k, t)) for k, t, a in left)


def test_index_keeps_the_counts_of_rows_that_share_an_id(spark, tmp_path):
    """Postings are a row's own, as in the scan, and lie where the row was read: nothing is shuffled."""
    rows = spark.createDataFrame([(1, "b a b"), (1, "b c b"), (2, None), (3, ""), (4, "b")], "doc_id long, text string").repartition(5).cache()
    fts_index.build(rows, "doc_id", "text", f"{tmp_path}/s")
    rank = spark.read.parquet(f"{tmp_path}/s/rank")
    assert sorted(tuple(r) for r in rank.select("token", "doc", "tf", "dl").collect()) == [("a", 1, 1, 3), ("b", 1, 2, 3), ("b", 1, 2, 3), ("b", 4, 1, 1), ("c", 1, 1, 3)]
    assert [(r["docs"], r["tokens"]) for r in spark.read.parquet(f"{tmp_path}/s/stats").collect()] == [(5, 7)]
    got, wanted = (sorted(r["score"] for r in df.collect()) for df in (fts_index.bm25(spark, [(f"{tmp_path}/s", None)], {"b": 1}), search.bm25_search(rows, "doc_id", "text", "b")))
    assert len(got) == 2 and sum(got) == pytest.approx(sum(wanted), abs=1e-5)


def test_files_that_changes_replace_are_not_indexed(spark, tmp_path):
    e = Engine(spark, str(tmp_path))
    e.sql("CREATE TABLE t (id INT, body TEXT); CREATE INDEX a ON t (body) USING FTS; INSERT INTO t VALUES (1, 'red fish'), (2, 'blue fish')")
    e.sql("UPDATE t SET body = 'red bird' WHERE id = 2")
    e.sql("DELETE FROM t WHERE id = 1")
    assert e.metrics()["index_segments"] == 0
    for _ in range(2):
        assert [r[0] for r in e.sql("SELECT id FROM t WHERE MATCH(body) AGAINST ('red')").collect()] == [2]
        assert e.metrics()["index_segments"] == 1
    # another engine reads the segment that the search has committed
    other = Engine(spark, str(tmp_path))
    assert [r[0] for r in other.bm25_search("t", "body", "bird").collect()] == [2] and other.metrics()["index_segments"] == 0
    e.sql("BEGIN; INSERT INTO t VALUES (3, 'red sun')")
    assert sorted(r[0] for r in e.sql("SELECT id FROM t WHERE MATCH(body) AGAINST ('red')").collect()) == [2, 3]
    e.sql("ROLLBACK")
    assert [r[0] for r in e.sql("SELECT id FROM t WHERE MATCH(body) AGAINST ('red')").collect()] == [2]
