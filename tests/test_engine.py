"""The engine end to end: statements, transactions, search."""

import pytest

from quern.plans import Engine, UnsupportedStatement

NOTES = """INSERT INTO notes VALUES (1, 'Harbour plans', [1, 0, 0]), (2, 'Copper mining', [0, 1, 0]),
    (3, 'Harbour works in copper', [0.6, 0.8, 0]), (4, 'Baked apples', [0, 0, 1])"""


@pytest.fixture
def engine(spark, tmp_path):
    return Engine(spark, str(tmp_path))


@pytest.fixture
def ask(engine):
    return lambda sql, *params: [tuple(r) for r in engine.sql(sql, params).collect()]


def test_goods(ask):
    ask("CREATE TABLE goods (no INT, label TEXT, cost INT); CREATE INDEX by_cost ON goods (cost)")
    ask("INSERT INTO goods VALUES (1, 'Plum', 10), (2, 'Fig', 20), (3, 'Lime', 30), (4, 'Pear', 20), (5, 'Kiwi', 10)")
    assert ask("SELECT COUNT(*) FROM goods") == [(5,)]
    assert ask("SELECT label FROM goods ORDER BY no LIMIT 2 OFFSET 1") == [("Fig",), ("Lime",)]
    ask("UPDATE goods SET cost = cost + 5 WHERE label = 'Plum'")
    assert ask("SELECT cost FROM goods WHERE label = 'Plum'") == [(15,)]
    assert ask("SELECT label FROM goods WHERE cost = 10") == [("Kiwi",)]
    ask("DELETE FROM goods WHERE cost = 20")
    assert ask("SELECT COUNT(*) FROM goods") == [(3,)]
    ask("INSERT INTO goods VALUES (6, 'Plum', 20), (7, 'Fig', 30)")
    assert ask("SELECT label, SUM(cost) AS s, COUNT(*) AS n FROM goods GROUP BY label ORDER BY label") == [("Fig", 30, 1), ("Kiwi", 10, 1), ("Lime", 30, 1), ("Plum", 35, 2)]
    assert ask("SELECT label, COUNT(*) FROM goods GROUP BY label HAVING COUNT(*) > 1") == [("Plum", 2)]
    assert ask("SELECT label, cost * 2 AS twice, cost + 5 AS more FROM goods WHERE no = 1") == [("Plum", 30, 20)]
    assert ask("DESCRIBE goods") == [("no", "INT", "PRI", ""), ("label", "TEXT", "", ""), ("cost", "INT", "", "BTREE")]
    assert ask("SHOW TABLES") == [("goods",)]


def test_joins(ask):
    ask("CREATE TABLE l (id INT, v TEXT); CREATE TABLE r (id INT, l_id INT, w TEXT)")
    ask("INSERT INTO l VALUES (1, 'A'), (2, 'B'); INSERT INTO r VALUES (100, 1, 'X'), (200, 1, 'Y'), (300, 3, 'Z')")
    assert sorted(ask("SELECT l.id, v, w FROM l JOIN r ON l.id = l_id")) == [(1, "A", "X"), (1, "A", "Y")]
    assert (2, "B", None) in ask("SELECT l.id, v, w FROM l LEFT JOIN r ON l.id = l_id")


def test_full_text(ask):
    ask("CREATE TABLE posts (no INT, head TEXT, body TEXT)")
    rows = ["Tin is a soft metal, used for coating", "Zinc is used for roofs and paint", "Lead is heavy", "Tin and zinc are both old"]
    ask("INSERT INTO posts VALUES " + ", ".join(f"({k}, 't', '{r}')" for k, r in enumerate(rows, 1)))
    match = lambda q: sorted(r[0] for r in ask("SELECT no FROM posts WHERE MATCH(body) AGAINST ($1)", q))
    assert match("Tin") == [1, 4]
    ask("CREATE INDEX words ON posts (body) USING FTS")
    assert [match(q) for q in ("COATING", "Zinc", "tin zinc", "", "Ti")] == [[1], [2, 4], [4], [], []]
    ask("UPDATE posts SET body = 'Zinc and tin' WHERE no = 2")
    assert match("Tin") == [1, 2, 4]
    ask("DELETE FROM posts WHERE no = 4")
    assert match("Tin") == [1, 2]
    assert ask("SELECT count(*) FROM posts WHERE NOT MATCH(body) AGAINST ('')") == [(3,)]


def test_vectors_and_hybrid(engine, ask):
    ask("CREATE TABLE notes (no INT, body TEXT, place VECTOR(3)); CREATE INDEX v ON notes (place) USING HNSW")
    ask(NOTES)
    assert ask("SELECT no FROM notes WHERE MATCH(body) AGAINST ('harbour') AND VECTOR_DISTANCE(place, [0, 1, 0]) < 1.0") == [(3,)]
    assert ask("SELECT no FROM notes ORDER BY place <-> [0.2, 0.1, 0.9] LIMIT 1") == [(4,)]
    assert ask("SELECT no FROM notes ORDER BY place <-> $1 LIMIT 2", [0.0, 1.0, 0.0]) == [(2,), (3,)]
    assert [r["vec_id"] for r in engine.vector_search("notes", "place", [0, 1, 0], 2).collect()] == [2, 3]
    assert [r["doc_id"] for r in engine.bm25_search("notes", "body", "copper harbour", 1).collect()] == [3]
    assert [r["id"] for r in engine.hybrid_search("notes", "body", "place", "copper", [0, 1, 0], 2).collect()] == [2, 3]
    with pytest.raises(Exception, match="dimension"):
        ask("SELECT no FROM notes WHERE place <-> [1] < 2")


def test_upsert_null_keys_and_repeats(ask):
    ask("CREATE TABLE t (id INT, v TEXT); INSERT INTO t VALUES (1, 'a'), (NULL, 'b'), (1, 'c')")
    assert sorted(ask("SELECT * FROM t"), key=str) == [(1, "c"), (None, "b")]
    ask("INSERT INTO t (v, id) VALUES ('d', NULL), ('e', 2)")
    assert sorted(ask("SELECT * FROM t"), key=str) == [(1, "c"), (2, "e"), (None, "d")]
    ask("INSERT INTO t SELECT id + 10, v FROM t WHERE id IS NOT NULL")
    assert ask("SELECT count(*) FROM t") == [(5,)]


def test_transactions(spark, engine, ask, tmp_path):
    ask("CREATE TABLE t (id INT, v INT); INSERT INTO t VALUES (1, 1), (2, 2)")
    ask("BEGIN")
    ask("DELETE FROM t WHERE id = 1")
    assert ask("SELECT count(*) FROM t") == [(1,)]
    assert Engine(spark, str(tmp_path)).table("t").count() == 2
    ask("ROLLBACK")
    assert ask("SELECT count(*) FROM t") == [(2,)]
    ask("BEGIN; UPDATE t SET v = v + id, id = id * 10; COMMIT")
    assert sorted(ask("SELECT id, v FROM t")) == [(10, 2), (20, 4)]
    with pytest.raises(ValueError):
        ask("INSERT INTO t VALUES (3, 3); INSERT INTO t VALUES (4)")
    assert ask("SELECT count(*) FROM t") == [(2,)]
    assert sorted(tuple(r) for r in Engine(spark, str(tmp_path)).sql("SELECT id, v FROM t").collect()) == [(10, 2), (20, 4)]


def test_concurrent_commits_keep_both_ones_rows(spark, engine, tmp_path):
    engine.sql("CREATE TABLE t (id INT, v TEXT); INSERT INTO t VALUES (1, 'a')")
    other = Engine(spark, str(tmp_path))
    engine.sql("BEGIN; INSERT INTO t VALUES (2, 'mine')")
    other.sql("INSERT INTO t VALUES (3, 'theirs')")
    engine.sql("COMMIT")
    rows = lambda: sorted(tuple(r) for r in engine.table("t").collect())
    assert rows() == [(1, "a"), (2, "mine"), (3, "theirs")]
    # of one key the last commit wins, and rows that stand in the same file stay the others'
    engine.compact("t")
    engine.sql("BEGIN; UPDATE t SET v = 'x' WHERE id = 1; DELETE FROM t WHERE id = 2")
    other.sql("UPDATE t SET v = 'y' WHERE id IN (1, 2, 3); INSERT INTO t VALUES (4, 'new')")
    engine.sql("COMMIT")
    assert rows() == [(1, "x"), (3, "y"), (4, "new")]
    assert engine.metrics()["redone"] == 2
    # a table that the other one has dropped is there again
    engine.sql("BEGIN; INSERT INTO t VALUES (5, 'five')")
    other.sql("DROP TABLE t")
    engine.sql("COMMIT")
    assert rows() == [(1, "x"), (3, "y"), (4, "new"), (5, "five")]


def test_views_and_cache(engine, ask):
    ask("CREATE TABLE t (id INT, v TEXT); INSERT INTO t VALUES (1, 'a'), (2, 'b')")
    ask("CREATE VIEW big AS SELECT id AS big, v FROM t WHERE id > 1")
    assert ask("SELECT big FROM big") == [(2,)]
    ask("CACHE TABLE t; INSERT INTO t VALUES (3, 'c')")
    assert ask("SELECT big FROM big ORDER BY big") == [(2,), (3,)]
    ask("UNCACHE TABLE t; DROP VIEW big")
    assert ask("SHOW TABLES") == [("t",)]
    with pytest.raises(ValueError):
        ask("CREATE VIEW t AS SELECT 1")


def test_functions_of_python(engine, ask):
    engine.register("shout", lambda x: x.upper() + "!")
    assert ask("SELECT shout('a')") == [("A!",)]


def test_untouched_files_stay(engine):
    engine.sql("CREATE TABLE t (id INT, v INT)")
    for k in range(3):
        engine.sql("INSERT INTO t VALUES ($1, $1)", [k])
    before = set(engine._meta("t")["files"])
    engine.sql("UPDATE t SET v = 9 WHERE id = 1")
    assert len(before & set(engine._meta("t")["files"])) == 2
    engine.compact("t")
    assert engine.store.vacuum() > 0 and sorted(tuple(r) for r in engine.table("t").collect()) == [(0, 0), (1, 9), (2, 2)]


def test_explain_prepare_and_errors(engine, ask):
    ask("CREATE TABLE t (id INT, props TEXT); INSERT INTO t VALUES (1, '{\"k\": {\"a b\": 5}}')")
    assert "Physical Plan" in ask("EXPLAIN SELECT * FROM t WHERE id = 1")[0][0]
    assert ask("EXPLAIN ANALYZE SELECT * FROM t")[0][0].startswith("Execution time")
    assert engine.prepare("SELECT props -> 'k' ->> 'a b' FROM t WHERE id = $1").execute(1).first()[0] == "5"
    assert ask("SELECT props ->> 'none' FROM t") == [(None,)]
    for bad in ("ALTER TABLE t ADD x INT", "MERGE INTO t"):
        with pytest.raises(UnsupportedStatement):
            ask(bad)
    with pytest.raises(ValueError, match=r"\$2"):
        ask("SELECT $2", 1)
    with pytest.raises(KeyError):
        ask("DROP TABLE none")
    ask("DROP TABLE IF EXISTS none, t")
    assert ask("SHOW TABLES") == []
    assert engine.metrics()["errors"] == 4
