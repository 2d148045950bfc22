"""Data changes: what a table holds afterwards."""

from __future__ import annotations

from pyspark.sql import functions as F

from quern.operators import changes
from quern.suite.common import register

QUERIES: dict = {}
ORACLES: dict[str, str] = {}
query = register(QUERIES, ORACLES)


@query("""SELECT n_nationkey, n_name, n_regionkey FROM nation WHERE n_nationkey NOT IN (SELECT r_regionkey * 10 FROM region)
    UNION ALL SELECT r_regionkey * 10, upper(r_name), r_regionkey FROM region""")
def dml_upsert(t):
    rows = t.region.select((F.col("r_regionkey") * 10).alias("n_nationkey"), F.upper("r_name").alias("n_name"), F.col("r_regionkey").alias("n_regionkey"))
    return changes.upsert(t.nation, rows)


@query("""SELECT c_custkey, c_name, c_nationkey, CASE WHEN c_mktsegment = 'BUILDING' THEN c_acctbal + 100 ELSE c_acctbal END AS c_acctbal,
    CASE WHEN c_mktsegment = 'BUILDING' THEN c_name ELSE c_mktsegment END AS c_mktsegment FROM customer""")
def dml_update(t):
    return changes.update(t.customer, {"c_acctbal": "c_acctbal + 100", "c_mktsegment": "c_name"}, "c_mktsegment = 'BUILDING'")


@query("SELECT o_orderkey, o_custkey, o_totalprice FROM orders WHERE NOT coalesce(nullif(o_orderstatus, 'P') = 'F' AND o_totalprice > 100000, false)")
def dml_delete(t):
    return changes.delete(t.orders, "nullif(o_orderstatus, 'P') = 'F' AND o_totalprice > 100000").select("o_orderkey", "o_custkey", "o_totalprice")
