"""The engine's statements through files and commits, and searches by stored indexes."""

from __future__ import annotations

from pyspark.sql import functions as F

from quern.operators import fts_index, ivf, search
from quern.plans import Engine
from quern.sources import json_rows, shared_folder
from quern.suite.common import Tables, register
from quern.suite.relational import show
from quern.suite.search import _DISTANCE, _TOKENS_A, K, TERMS, VECTOR, _bm25

QUERIES: dict = {}
ORACLES: dict[str, str] = {}
query = register(QUERIES, ORACLES)

_built: dict[tuple, str] = {}


def stored(t: Tables, kind: str) -> str:
    """The folder of a folder's stored index, which the first query of a session builds."""
    key = (t.spark.sparkContext.applicationId, t._folder, kind)
    if key not in _built:
        path = shared_folder(t.spark, kind)
        if kind == "fts":
            fts_index.build(t.documents, "doc_id", "text", path)
        else:
            ivf.build(t.embeddings, "vec_id", "embedding", path)
        _built[key] = path
    return _built[key]


def engine(t: Tables, *views: str) -> Engine:
    """An engine over a new folder, with some of the folder's tables as views."""
    show(t, views)
    return Engine(t.spark, shared_folder(t.spark, "engine"))


_NATIONS = "CREATE TABLE places (k INT, name TEXT, r INT); INSERT INTO places SELECT n_nationkey, n_name, n_regionkey FROM nation"


@query(f"SELECT doc_id FROM documents WHERE list_has_all({_TOKENS_A.format('text')}, ['ther', 'onst'])")
def fts_indexed_match(t):
    return fts_index.matching(t.spark, [(stored(t, "fts"), None)], ["ther", "onst"]).withColumnRenamed("doc", "doc_id")


@query(f"SELECT * FROM {_bm25(TERMS, K)}")
def bm25_indexed_topk(t):
    return fts_index.bm25(t.spark, [(stored(t, "fts"), None)], search.query_terms(t.documents, TERMS), K)


@query(f"SELECT vec_id, {_DISTANCE} AS distance FROM embeddings ORDER BY distance, vec_id LIMIT {K}")
def vector_indexed_topk(t):
    """All cells are probed, so that the rows are the exact ones; tests measure recall at the share that a search probes."""
    return ivf.search(t.spark, [(stored(t, "ivf"), None)], VECTOR, K, probed=1.0)


@query("""SELECT n_nationkey AS k, CASE WHEN n_regionkey = 1 THEN n_name || '!' ELSE n_name END AS name, CAST(CASE WHEN n_regionkey = 1 THEN 11 ELSE n_regionkey END AS BIGINT) AS r FROM nation WHERE n_nationkey % 5 <> 0 AND n_nationkey <> 2
    UNION ALL VALUES (2, 'two', -1), (100, 'hundred', 7)""")
def engine_changes(t):
    e = engine(t, "nation")
    e.sql(_NATIONS)
    e.sql("UPDATE places SET name = concat(name, '!'), r = r + 10 WHERE r = $1", [1])
    e.sql("DELETE FROM places WHERE k % 5 = 0")
    e.sql("INSERT INTO places VALUES (2, 'two', -1), (100, 'hundred', 7)")
    return e.table("places")


@query("SELECT n_nationkey AS k, n_name AS name, CAST(CASE WHEN n_nationkey < 3 THEN -1 ELSE n_regionkey END AS BIGINT) AS r FROM nation")
def engine_transaction(t):
    e = engine(t, "nation")
    e.sql(_NATIONS)
    e.sql("BEGIN; DELETE FROM places; ROLLBACK")
    e.sql("BEGIN; UPDATE places SET r = -1 WHERE k < 3; COMMIT")
    return e.table("places")


@query("""SELECT n_nationkey AS k, CASE n_nationkey WHEN 4 THEN 'mine' WHEN 5 THEN 'theirs' WHEN 6 THEN 'last' ELSE n_name END AS name, CAST(n_regionkey AS BIGINT) AS r FROM nation WHERE n_nationkey <> 7
    UNION ALL VALUES (200, 'a', 0), (201, 'b', 0)""")
def engine_concurrent_commits(t):
    """Two transactions on one table: what both changed is as the later commit has it, all else of both stays."""
    e = engine(t, "nation")
    e.sql(_NATIONS)
    other = Engine(t.spark, e.store.root)
    e.sql("BEGIN; UPDATE places SET name = 'mine' WHERE k = 4; UPDATE places SET name = 'last' WHERE k = 6; DELETE FROM places WHERE k = 7; INSERT INTO places VALUES (200, 'a', 0)")
    other.sql("UPDATE places SET name = 'theirs' WHERE k IN (5, 6, 7)")
    other.sql("INSERT INTO places VALUES (201, 'b', 0)")
    e.sql("COMMIT")
    return e.table("places")


@query("SELECT 'k' AS Field, 'INT' AS Type, 'PRI' AS \"Key\", '' AS \"Index\" UNION ALL VALUES ('name', 'TEXT', '', 'FTS'), ('r', 'INT', '', 'BTREE')")
def engine_describe(t):
    e = engine(t)
    e.sql("CREATE TABLE places (k INT, name TEXT, r INT); CREATE INDEX a ON places (name) USING FTS; CREATE INDEX b ON places (r)")
    return e.sql("DESCRIBE places")


@query("SELECT 'other' AS \"Table\" UNION ALL VALUES ('places')")
def engine_tables(t):
    e = engine(t)
    e.sql("CREATE TABLE places (k INT); CREATE TABLE gone (k INT); CREATE TABLE IF NOT EXISTS other (k INT); DROP TABLE gone; DROP TABLE IF EXISTS gone")
    return e.sql("SHOW TABLES")


@query("SELECT true AS planned, true AS timed")
def engine_explain(t):
    e = engine(t, "nation")
    plans = [e.sql(s + " SELECT count(*) FROM nation WHERE n_regionkey = 1").first()[0] for s in ("EXPLAIN", "EXPLAIN ANALYZE")]
    return t.spark.createDataFrame([("Physical Plan" in plans[0] and "PushedFilters" in plans[0], plans[1].startswith("Execution time"))], "planned boolean, timed boolean")


@query("SELECT n_nationkey AS k, upper(n_name) AS loud FROM nation WHERE n_regionkey = 2 AND n_nationkey <> 8")
def engine_view(t):
    e = engine(t, "nation")
    e.sql(_NATIONS)
    e.sql("CREATE VIEW loud AS SELECT k, upper(name) AS loud, r FROM places WHERE r = 2")
    e.sql("DELETE FROM places WHERE k = 8")
    return e.sql("SELECT k, loud FROM loud")


@query(f"""SELECT doc_id FROM documents WHERE list_has_all({_TOKENS_A.format('text')}, ['ther', 'onst']) AND source <> 'src1' AND doc_id % 7 <> 0
    UNION ALL SELECT doc_id FROM documents WHERE doc_id % 7 = 0 AND source <> 'src1' AND doc_id % 14 = 0""")
def engine_indexed_match(t):
    """MATCH by the stored index, after changes of rows that it holds."""
    e = engine(t, "documents")
    e.sql("CREATE TABLE notes (doc_id INT, body TEXT, source TEXT); CREATE INDEX words ON notes (body) USING FTS; INSERT INTO notes SELECT doc_id, text, source FROM documents")
    e.sql("UPDATE notes SET body = CASE WHEN doc_id % 14 = 0 THEN 'Onst, ther!' ELSE 'other' END WHERE doc_id % 7 = 0")
    e.sql("DELETE FROM notes WHERE source = 'src1'")
    return e.sql("SELECT doc_id FROM notes n WHERE MATCH(body) AGAINST ($1) AND source IS NOT NULL", ["Ther onst"])


@query("""SELECT '{"r_regionkey":' || r_regionkey || ',"r_name":"' || r_name || '","none":null}' AS row FROM region""")
def json_sink(t):
    return json_rows(t.region.select("r_regionkey", "r_name", F.lit(None).cast("string").alias("none")))
