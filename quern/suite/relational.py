"""Scans, filters, projections, joins, aggregates, sorts, windows and set operations."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from quern.operators.joins import asof_join
from quern.plans.dialect import rewrite, tokens
from quern.sources import register_folder
from quern.sources.tables import TABLES
from quern.suite.common import Tables, register

QUERIES: dict = {}
ORACLES: dict[str, str] = {}
query = register(QUERIES, ORACLES)
c = F.col


def money(x) -> F.Column:
    return F.round(x, 2)


def show(t: Tables, names) -> None:
    """Some of the folder's tables as temporary views."""
    register_folder(t.spark, t._folder, tuple(n for n in TABLES if n in names))


def run_sql(t: Tables, sql: str, *params: object) -> DataFrame:
    """A query in the engine's dialect over the folder's tables."""
    show(t, {x.text for x in tokens(sql) if x.kind == "word"})
    return t.spark.sql(rewrite(sql), args={f"p{k + 1}": v for k, v in enumerate(params)} or None)


# scans and projections


@query("SELECT * FROM nation")
def scan_full(t):
    return t.nation


@query("SELECT p_partkey AS id, p_name AS name FROM part")
def project_alias(t):
    return t.part.select(c("p_partkey").alias("id"), c("p_name").alias("name"))


@query("SELECT p_partkey, round(p_retailprice * 2, 2) AS double_price, p_size + 5 AS size_plus_5, p_size - 1 AS size_less_1 FROM part")
def project_arith(t):
    return t.part.select("p_partkey", money(c("p_retailprice") * 2).alias("double_price"), (c("p_size") + 5).alias("size_plus_5"), (c("p_size") - 1).alias("size_less_1"))


@query("SELECT n.* FROM nation n JOIN region r ON n.n_regionkey = r.r_regionkey WHERE r.r_regionkey > 1")
def project_qualified_star(t):
    return t.nation.alias("n").join(t.region.filter(c("r_regionkey") > 1).alias("r"), c("n_regionkey") == c("r_regionkey")).select("n.*")


@query("SELECT 1 AS one, 'x' AS name")
def select_without_from(t):
    return t.spark.sql("SELECT 1 AS one, 'x' AS name")


@query("SELECT o_orderkey, o_custkey, o_orderstatus, o_totalprice FROM orders WHERE o_orderkey = 4242")
def pk_point_lookup(t):
    return t.orders.filter(c("o_orderkey") == 4242).select("o_orderkey", "o_custkey", "o_orderstatus", "o_totalprice")


@query("SELECT o_orderkey, o_custkey, o_totalprice FROM orders WHERE o_custkey = 77")
def index_eq_lookup(t):
    return t.orders.filter(c("o_custkey") == 77).select("o_orderkey", "o_custkey", "o_totalprice")


@query("SELECT c_custkey, c_name FROM customer WHERE c_custkey = 123 OR c_mktsegment = 'MACHINERY' AND c_acctbal > 9000.5")
def prepared_param_lookup(t):
    return run_sql(t, "SELECT c_custkey, c_name FROM customer WHERE c_custkey = $1 OR c_mktsegment = $2 AND c_acctbal > $3", 123, "MACHINERY", 9000.5)


# filters


@query("SELECT p_partkey, p_brand FROM part WHERE p_type = 'ECONOMY' AND p_brand <> 'Brand#2'")
def filter_eq_ne(t):
    return t.part.filter((c("p_type") == "ECONOMY") & (c("p_brand") != "Brand#2")).select("p_partkey", "p_brand")


@query("SELECT l_orderkey, l_linenumber, l_quantity FROM lineitem WHERE l_quantity >= 10 AND l_quantity < 12 AND l_discount <= 0.02 AND l_tax > 0.06")
def filter_range(t):
    f = (c("l_quantity") >= 10) & (c("l_quantity") < 12) & (c("l_discount") <= 0.02) & (c("l_tax") > 0.06)
    return t.lineitem.filter(f).select("l_orderkey", "l_linenumber", "l_quantity")


@query("SELECT l_orderkey, l_linenumber FROM lineitem WHERE l_returnflag = 'R' AND l_linestatus = 'F' AND l_quantity > 45 AND l_suppkey < 20")
def filter_conjunction(t):
    return t.lineitem.filter("l_returnflag = 'R' AND l_linestatus = 'F' AND l_quantity > 45 AND l_suppkey < 20").select("l_orderkey", "l_linenumber")


@query("""SELECT p_partkey FROM part WHERE (p_name LIKE 'red%' OR p_size IN (1, 2, 3)) AND NOT p_type = 'ECONOMY' AND p_retailprice BETWEEN 900 AND 1500
    AND p_brand IS NOT NULL AND EXISTS (SELECT 1 FROM lineitem WHERE l_partkey = p_partkey AND l_quantity > 49)""")
def filter_superset(t):
    f = (c("p_name").like("red%") | c("p_size").isin(1, 2, 3)) & ~(c("p_type") == "ECONOMY") & c("p_retailprice").between(900, 1500) & c("p_brand").isNotNull()
    return t.part.filter(f).join(t.lineitem.filter(c("l_quantity") > 49), c("l_partkey") == c("p_partkey"), "left_semi").select("p_partkey")


# joins


@query("SELECT o_orderkey, c_name FROM orders JOIN customer ON o_custkey = c_custkey")
def join_inner_hash(t):
    return t.orders.join(t.customer, c("o_custkey") == c("c_custkey")).select("o_orderkey", "c_name")


@query("SELECT o_orderkey, c_name, o_totalprice FROM orders JOIN customer ON o_custkey = c_custkey WHERE o_totalprice > 450000 AND c_mktsegment = 'BUILDING'")
def join_inner_filter(t):
    return t.orders.join(t.customer, c("o_custkey") == c("c_custkey")).filter((c("o_totalprice") > 450000) & (c("c_mktsegment") == "BUILDING")).select("o_orderkey", "c_name", "o_totalprice")


@query("SELECT c_custkey, o_orderkey FROM customer LEFT JOIN orders ON c_custkey = o_custkey AND o_totalprice > 400000")
def join_left(t):
    return t.customer.join(t.orders.filter(c("o_totalprice") > 400000), c("c_custkey") == c("o_custkey"), "left").select("c_custkey", "o_orderkey")


@query("SELECT o_orderkey, c_custkey FROM orders RIGHT JOIN customer ON c_custkey = o_custkey AND o_orderstatus = 'P' AND o_totalprice < 20000")
def join_right(t):
    return t.orders.filter((c("o_orderstatus") == "P") & (c("o_totalprice") < 20000)).join(t.customer, c("c_custkey") == c("o_custkey"), "right").select("o_orderkey", "c_custkey")


@query("""SELECT c.c_custkey, s.s_suppkey FROM (SELECT * FROM customer WHERE c_acctbal > 9800) c
    FULL JOIN (SELECT * FROM supplier WHERE s_acctbal > 5000) s ON c.c_nationkey = s.s_nationkey""")
def join_full(t):
    return t.customer.filter(c("c_acctbal") > 9800).join(t.supplier.filter(c("s_acctbal") > 5000), c("c_nationkey") == c("s_nationkey"), "full").select("c_custkey", "s_suppkey")


@query("SELECT n_name, r_name FROM nation JOIN region ON n_regionkey < r_regionkey")
def join_theta_nl(t):
    return t.nation.join(t.region, c("n_regionkey") < c("r_regionkey")).select("n_name", "r_name")


@query("SELECT n_name, r_name FROM nation LEFT JOIN region ON n_regionkey > r_regionkey + 2")
def join_left_theta(t):
    return t.nation.join(t.region, c("n_regionkey") > c("r_regionkey") + 2, "left").select("n_name", "r_name")


@query("SELECT n_nationkey, r_regionkey FROM nation CROSS JOIN region")
def join_cross(t):
    return t.nation.crossJoin(t.region).select("n_nationkey", "r_regionkey")


@query("SELECT n_name, s_name FROM nation, supplier WHERE n_nationkey = s_nationkey AND s_acctbal > 0")
def join_comma(t):
    return run_sql(t, "SELECT n_name, s_name FROM nation, supplier WHERE n_nationkey = s_nationkey AND s_acctbal > 0")


@query("SELECT k, n_name, s_name FROM (SELECT n_nationkey AS k, n_name FROM nation) a JOIN (SELECT s_nationkey AS k, s_name FROM supplier) b USING (k)")
def join_using(t):
    return t.nation.select(c("n_nationkey").alias("k"), "n_name").join(t.supplier.select(c("s_nationkey").alias("k"), "s_name"), "k")


@query("SELECT c_custkey FROM customer WHERE EXISTS (SELECT 1 FROM orders WHERE o_custkey = c_custkey AND o_totalprice > 480000)")
def join_semi(t):
    return t.customer.join(t.orders.filter(c("o_totalprice") > 480000), c("o_custkey") == c("c_custkey"), "left_semi").select("c_custkey")


@query("SELECT c_custkey FROM customer WHERE NOT EXISTS (SELECT 1 FROM orders WHERE o_custkey = c_custkey AND o_totalprice > 300000)")
def join_anti(t):
    return t.customer.join(t.orders.filter(c("o_totalprice") > 300000), c("o_custkey") == c("c_custkey"), "left_anti").select("c_custkey")


@query("""SELECT p.event_id, p.user_id, c.clicked FROM (SELECT * FROM events WHERE event_type = 'purchase') p
    ASOF LEFT JOIN (SELECT user_id, ts, max(event_id) AS clicked FROM events WHERE event_type = 'click' GROUP BY user_id, ts) c ON p.user_id = c.user_id AND p.ts >= c.ts""")
def join_asof(t):
    bought = t.events.filter(c("event_type") == "purchase").select("event_id", "user_id", "ts")
    clicks = t.events.filter(c("event_type") == "click").select("user_id", "ts", c("event_id").alias("clicked"))
    return asof_join(bought, clicks, ["user_id"], "ts").select("event_id", "user_id", "clicked")


@query("SELECT a.l_orderkey, a.l_linenumber, b.l_partkey FROM lineitem a JOIN lineitem b ON a.l_orderkey = b.l_orderkey AND a.l_linenumber = b.l_linenumber AND a.l_quantity > 49")
def join_multi_key(t):
    a = t.lineitem.filter(c("l_quantity") > 49).select("l_orderkey", "l_linenumber")
    return a.join(t.lineitem.select("l_orderkey", "l_linenumber", "l_partkey"), ["l_orderkey", "l_linenumber"])


@query("""SELECT r_name, count(*) AS n, round(sum(l_extendedprice * (1 - l_discount)), 2) AS revenue FROM lineitem JOIN orders ON l_orderkey = o_orderkey JOIN customer ON o_custkey = c_custkey
    JOIN nation ON c_nationkey = n_nationkey JOIN region ON n_regionkey = r_regionkey GROUP BY r_name""")
def join_multiway(t):
    joined = t.lineitem.join(t.orders, c("l_orderkey") == c("o_orderkey")).join(t.customer, c("o_custkey") == c("c_custkey"))
    joined = joined.join(t.nation, c("c_nationkey") == c("n_nationkey")).join(t.region, c("n_regionkey") == c("r_regionkey"))
    return joined.groupBy("r_name").agg(F.count(F.lit(1)).alias("n"), money(F.sum(c("l_extendedprice") * (1 - c("l_discount")))).alias("revenue"))


@query("SELECT a.n_name AS first, b.n_name AS second FROM nation a JOIN nation b ON a.n_regionkey = b.n_regionkey AND a.n_nationkey < b.n_nationkey")
def join_self(t):
    a, b = t.nation.alias("a"), t.nation.alias("b")
    return a.join(b, (c("a.n_regionkey") == c("b.n_regionkey")) & (c("a.n_nationkey") < c("b.n_nationkey"))).select(c("a.n_name").alias("first"), c("b.n_name").alias("second"))


@query("""SELECT a.k, b.s_suppkey FROM (SELECT nullif(n_nationkey, 3) AS k FROM nation) a JOIN (SELECT nullif(s_nationkey, 3) AS k, s_suppkey FROM supplier) b ON a.k IS NOT DISTINCT FROM b.k""")
def join_null_safe(t):
    a = t.nation.select(F.nullif(c("n_nationkey"), F.lit(3)).alias("k")).alias("a")
    b = t.supplier.select(F.nullif(c("s_nationkey"), F.lit(3)).alias("k"), "s_suppkey").alias("b")
    return a.join(b, c("a.k").eqNullSafe(c("b.k"))).select("a.k", "s_suppkey")


# aggregates


@query("""SELECT o_orderstatus, o_orderpriority, count(*) AS n, round(sum(o_totalprice), 2) AS total FROM orders WHERE o_totalprice > 1000
    GROUP BY o_orderstatus, o_orderpriority HAVING count(*) > 5 ORDER BY o_orderstatus, o_orderpriority""")
def agg_group_by(t):
    grouped = t.orders.filter(c("o_totalprice") > 1000).groupBy("o_orderstatus", "o_orderpriority").agg(F.count(F.lit(1)).alias("n"), money(F.sum("o_totalprice")).alias("total"))
    return grouped.filter(c("n") > 5).orderBy("o_orderstatus", "o_orderpriority")


@query("SELECT o_orderpriority, count(*) AS n, count(nullif(o_orderstatus, 'P')) AS n_not_p FROM orders GROUP BY o_orderpriority")
def agg_count(t):
    return t.orders.groupBy("o_orderpriority").agg(F.count(F.lit(1)).alias("n"), F.count(F.nullif(c("o_orderstatus"), F.lit("P"))).alias("n_not_p"))


@query("""SELECT l_returnflag, CAST(sum(l_linenumber) AS BIGINT) AS lines, round(sum(l_quantity), 2) AS quantity, CAST(coalesce(sum(CASE WHEN l_linenumber > 99 THEN 1 END), 0) AS BIGINT) AS none
    FROM lineitem GROUP BY l_returnflag""")
def agg_sum(t):
    none = F.coalesce(F.sum(F.when(c("l_linenumber") > 99, 1)), F.lit(0)).cast("long")
    return t.lineitem.groupBy("l_returnflag").agg(F.sum("l_linenumber").alias("lines"), money(F.sum("l_quantity")).alias("quantity"), none.alias("none"))


@query("SELECT l_linestatus, round(avg(l_quantity), 6) AS quantity, round(avg(l_discount), 6) AS discount FROM lineitem GROUP BY l_linestatus")
def agg_avg(t):
    return t.lineitem.groupBy("l_linestatus").agg(F.round(F.avg("l_quantity"), 6).alias("quantity"), F.round(F.avg("l_discount"), 6).alias("discount"))


@query("SELECT p_brand, min(p_name) AS first_name, max(p_name) AS last_name, min(p_retailprice) AS low, max(p_retailprice) AS high FROM part GROUP BY p_brand")
def agg_min_max(t):
    return t.part.groupBy("p_brand").agg(F.min("p_name").alias("first_name"), F.max("p_name").alias("last_name"), F.min("p_retailprice").alias("low"), F.max("p_retailprice").alias("high"))


@query("SELECT o_custkey, count(*) AS n FROM orders GROUP BY o_custkey HAVING count(*) > 15 AND max(o_totalprice) > 400000")
def agg_having(t):
    grouped = t.orders.groupBy("o_custkey").agg(F.count(F.lit(1)).alias("n"), F.max("o_totalprice").alias("top"))
    return grouped.filter((c("n") > 15) & (c("top") > 400000)).select("o_custkey", "n")


@query("SELECT l_returnflag, round(sum(l_extendedprice) / count(*), 4) AS mean_price, -max(l_linenumber) AS minus_lines, round((sum(l_tax) + 1) * 2, 4) AS taxed FROM lineitem GROUP BY l_returnflag")
def agg_expr(t):
    return t.lineitem.groupBy("l_returnflag").agg(
        F.round(F.sum("l_extendedprice") / F.count(F.lit(1)), 4).alias("mean_price"), (-F.max("l_linenumber")).alias("minus_lines"), F.round((F.sum("l_tax") + 1) * 2, 4).alias("taxed")
    )


@query("SELECT o_totalprice > 250000 AS high, o_orderstatus || '!' AS status, count(*) AS n FROM orders GROUP BY 1, 2")
def agg_key_expr(t):
    return t.orders.groupBy((c("o_totalprice") > 250000).alias("high"), F.concat("o_orderstatus", F.lit("!")).alias("status")).agg(F.count(F.lit(1)).alias("n"))


@query("SELECT count(*) AS n FROM lineitem WHERE l_returnflag = 'A'")
def count_star(t):
    return t.lineitem.filter(c("l_returnflag") == "A").agg(F.count(F.lit(1)).alias("n"))


@query("SELECT round(sum(o_totalprice), 2) AS total, round(avg(o_totalprice), 4) AS mean, min(o_totalprice) AS low, max(o_totalprice) AS high, count(*) AS n FROM orders")
def agg_global(t):
    return t.orders.agg(
        money(F.sum("o_totalprice")).alias("total"), F.round(F.avg("o_totalprice"), 4).alias("mean"), F.min("o_totalprice").alias("low"), F.max("o_totalprice").alias("high"), F.count(F.lit(1)).alias("n")
    )


@query("SELECT o_orderpriority, count(DISTINCT o_custkey) AS customers FROM orders GROUP BY o_orderpriority")
def agg_count_distinct(t):
    return t.orders.groupBy("o_orderpriority").agg(F.count_distinct("o_custkey").alias("customers"))


@query("SELECT o_orderstatus, count(*) FILTER (WHERE o_totalprice > 400000) AS high, round(sum(o_totalprice) FILTER (WHERE o_custkey < 100), 2) AS early FROM orders GROUP BY o_orderstatus")
def agg_filter(t):
    return t.orders.groupBy("o_orderstatus").agg(F.count_if(c("o_totalprice") > 400000).alias("high"), money(F.sum(F.when(c("o_custkey") < 100, c("o_totalprice")))).alias("early"))


@query("""SELECT o_orderstatus, o_orderpriority, count(*) AS n, CAST(grouping(o_orderstatus) AS BIGINT) AS level FROM orders
    GROUP BY GROUPING SETS ((o_orderstatus, o_orderpriority), (o_orderpriority), ())""")
def agg_grouping_sets(t):
    sets = [[c("o_orderstatus"), c("o_orderpriority")], [c("o_orderpriority")], []]
    return t.orders.groupingSets(sets, "o_orderstatus", "o_orderpriority").agg(F.count(F.lit(1)).alias("n"), F.grouping("o_orderstatus").cast("long").alias("level"))


@query("SELECT o_orderstatus, o_custkey % 3 AS third, count(*) AS n FROM orders GROUP BY ALL")
def agg_group_by_all(t):
    return run_sql(t, "SELECT o_orderstatus, o_custkey % 3 AS third, count(*) AS n FROM orders GROUP BY ALL")


@query("SELECT DISTINCT p_brand, p_type FROM part")
def distinct_rows(t):
    return t.part.select("p_brand", "p_type").distinct()


@query("SELECT l_returnflag, l_linestatus, count(*) AS n, grouping(l_linestatus) AS level, 'rollup' AS kind FROM lineitem GROUP BY ROLLUP (l_returnflag, l_linestatus) UNION ALL SELECT l_returnflag, l_linestatus, count(*), grouping(l_linestatus), 'cube' FROM lineitem GROUP BY CUBE (l_returnflag, l_linestatus)")
def agg_rollup_cube(t):
    agg = (F.count(F.lit(1)).alias("n"), F.grouping("l_linestatus").cast("long").alias("level"))
    rolled = t.lineitem.rollup("l_returnflag", "l_linestatus").agg(*agg).withColumn("kind", F.lit("rollup"))
    return rolled.unionByName(t.lineitem.cube("l_returnflag", "l_linestatus").agg(*agg).withColumn("kind", F.lit("cube")))


# sorts, limits, windows, set operations


@query("SELECT p_partkey, p_brand, p_size FROM part ORDER BY p_brand, p_size DESC, p_partkey")
def sort_multi_key(t):
    return t.part.select("p_partkey", "p_brand", "p_size").orderBy("p_brand", F.desc("p_size"), "p_partkey")


@query("SELECT p_partkey AS id, p_retailprice * p_size AS worth FROM part ORDER BY worth DESC, id LIMIT 25")
def sort_alias(t):
    return t.part.select(c("p_partkey").alias("id"), (c("p_retailprice") * c("p_size")).alias("worth")).orderBy(F.desc("worth"), "id").limit(25)


@query("SELECT * FROM (SELECT o_orderkey, nullif(o_orderstatus, 'O') AS status FROM orders ORDER BY status DESC NULLS FIRST, o_orderkey LIMIT 20) UNION ALL SELECT * FROM (SELECT o_orderkey, nullif(o_orderstatus, 'F') AS status FROM orders ORDER BY status ASC NULLS LAST, o_orderkey LIMIT 20)")
def sort_nulls(t):
    first = t.orders.select("o_orderkey", F.nullif(c("o_orderstatus"), F.lit("O")).alias("status")).orderBy(F.desc_nulls_first("status"), "o_orderkey").limit(20)
    last = t.orders.select("o_orderkey", F.nullif(c("o_orderstatus"), F.lit("F")).alias("status")).orderBy(F.asc_nulls_last("status"), "o_orderkey").limit(20)
    return first.unionByName(last)


@query("SELECT p_partkey, p_name FROM part ORDER BY p_partkey LIMIT 10 OFFSET 15")
def limit_offset(t):
    return t.part.select("p_partkey", "p_name").orderBy("p_partkey").offset(15).limit(10)


@query("SELECT o_orderkey, o_totalprice FROM orders ORDER BY o_totalprice DESC, o_orderkey LIMIT 10")
def topk(t):
    return t.orders.select("o_orderkey", "o_totalprice").orderBy(F.desc("o_totalprice"), "o_orderkey").limit(10)


@query("SELECT o_custkey, o_orderkey, nth FROM (SELECT o_custkey, o_orderkey, row_number() OVER (PARTITION BY o_custkey ORDER BY o_totalprice DESC, o_orderkey) AS nth FROM orders) WHERE nth <= 3")
def window_rank(t):
    w = Window.partitionBy("o_custkey").orderBy(F.desc("o_totalprice"), "o_orderkey")
    return t.orders.select("o_custkey", "o_orderkey", F.row_number().over(w).alias("nth")).filter(c("nth") <= 3)


_W = "PARTITION BY o_custkey ORDER BY o_orderdate, o_orderkey"


@query(f"""SELECT o_orderkey, lag(o_orderkey) OVER ({_W}) AS before, lead(o_orderkey, 2, -1) OVER ({_W}) AS after, ntile(3) OVER ({_W}) AS third, rank() OVER (PARTITION BY o_custkey ORDER BY o_orderstatus) AS place,
    dense_rank() OVER (PARTITION BY o_custkey ORDER BY o_orderstatus) AS dense, first_value(o_orderkey) OVER ({_W}) AS first FROM orders""")
def window_lag_lead(t):
    w, by_status = Window.partitionBy("o_custkey").orderBy("o_orderdate", "o_orderkey"), Window.partitionBy("o_custkey").orderBy("o_orderstatus")
    return t.orders.select(
        "o_orderkey", F.lag("o_orderkey").over(w).alias("before"), F.lead("o_orderkey", 2, -1).over(w).alias("after"), F.ntile(3).over(w).cast("long").alias("third"),
        F.rank().over(by_status).cast("long").alias("place"), F.dense_rank().over(by_status).cast("long").alias("dense"), F.first("o_orderkey").over(w).alias("first"),
    )


@query(f"""SELECT o_orderkey, CAST(sum(o_custkey) OVER ({_W} ROWS BETWEEN 2 PRECEDING AND CURRENT ROW) AS BIGINT) AS last_three, count(*) OVER ({_W} ROWS BETWEEN UNBOUNDED PRECEDING AND 1 FOLLOWING) AS upto,
    max(o_totalprice) OVER (PARTITION BY o_custkey ORDER BY o_orderkey RANGE BETWEEN 1000 PRECEDING AND 1000 FOLLOWING) AS near FROM orders""")
def window_frames(t):
    w = Window.partitionBy("o_custkey").orderBy("o_orderdate", "o_orderkey")
    near = Window.partitionBy("o_custkey").orderBy("o_orderkey").rangeBetween(-1000, 1000)
    return t.orders.select(
        "o_orderkey", F.sum("o_custkey").over(w.rowsBetween(-2, 0)).alias("last_three"), F.count(F.lit(1)).over(w.rowsBetween(Window.unboundedPreceding, 1)).alias("upto"), F.max("o_totalprice").over(near).alias("near")
    )


@query("""(SELECT c_nationkey AS k, 'u' AS kind FROM customer UNION SELECT s_nationkey, 'u' FROM supplier) UNION ALL (SELECT c_nationkey, 'i' FROM customer WHERE c_acctbal > 9000 INTERSECT SELECT s_nationkey, 'i' FROM supplier)
    UNION ALL (SELECT n_nationkey, 'e' FROM nation EXCEPT SELECT s_nationkey, 'e' FROM supplier WHERE s_acctbal > 8000)""")
def setop_union(t):
    cust, supp = t.customer, t.supplier
    either = cust.select(c("c_nationkey").alias("k")).union(supp.select("s_nationkey")).distinct().withColumn("kind", F.lit("u"))
    both = cust.filter(c("c_acctbal") > 9000).select(c("c_nationkey").alias("k")).intersect(supp.select("s_nationkey")).withColumn("kind", F.lit("i"))
    without = t.nation.select(c("n_nationkey").alias("k")).subtract(supp.filter(c("s_acctbal") > 8000).select("s_nationkey")).withColumn("kind", F.lit("e"))
    return either.unionByName(both).unionByName(without)


CTE = """WITH totals AS (SELECT o_custkey, round(sum(o_totalprice), 2) AS total FROM orders GROUP BY o_custkey)
SELECT c_name, total FROM customer JOIN totals ON c_custkey = o_custkey WHERE total > (SELECT avg(total) * 1.5 FROM totals) AND c_nationkey IN (SELECT n_nationkey FROM nation WHERE n_regionkey = 1)"""


@query(CTE)
def cte_subquery(t):
    return run_sql(t, CTE)


# scalar expressions


@query("SELECT l_orderkey, l_linenumber, (l_partkey - 1000) // l_linenumber AS quotient FROM lineitem WHERE l_suppkey = 5")
def int_division(t):
    return t.lineitem.filter(c("l_suppkey") == 5).select("l_orderkey", "l_linenumber", F.expr("(l_partkey - 1000) div l_linenumber").alias("quotient"))


@query("SELECT l_orderkey, l_linenumber, (l_partkey - 1000) % 7 AS rest FROM lineitem WHERE l_suppkey = 6")
def modulo(t):
    return t.lineitem.filter(c("l_suppkey") == 6).select("l_orderkey", "l_linenumber", ((c("l_partkey") - 1000) % 7).alias("rest"))


@query("""SELECT p_partkey, CAST(p_size AS VARCHAR) AS size_text, CASE WHEN p_size > 25 THEN 'big' WHEN p_size > 10 THEN 'middle' ELSE 'small' END AS kind, coalesce(nullif(p_type, 'ECONOMY'), 'plain') AS type,
    upper(substring(p_name, 1, 3)) AS head, length(p_name) AS letters, abs(p_size - 25) AS off, CAST(floor(p_retailprice) AS BIGINT) AS whole FROM part""")
def scalar_superset(t):
    kind = F.when(c("p_size") > 25, "big").when(c("p_size") > 10, "middle").otherwise("small")
    return t.part.select(
        "p_partkey", c("p_size").cast("string").alias("size_text"), kind.alias("kind"), F.coalesce(F.nullif(c("p_type"), F.lit("ECONOMY")), F.lit("plain")).alias("type"),
        F.upper(F.substring("p_name", 1, 3)).alias("head"), F.length("p_name").cast("long").alias("letters"), F.abs(c("p_size") - 25).alias("off"), F.floor("p_retailprice").cast("long").alias("whole"),
    )


@query("SELECT event_id, CAST(props -> '$.k' AS VARCHAR) AS k FROM events WHERE CAST(props ->> '$.k' AS INTEGER) > 50")
def json_arrow(t):
    return run_sql(t, "SELECT event_id, props -> 'k' AS k FROM events WHERE CAST(props -> 'k' AS INT) > 50")


@query("SELECT event_id, props ->> '$.k' AS k, props ->> '$.missing' AS missing FROM events")
def json_long_arrow(t):
    return run_sql(t, "SELECT event_id, props ->> 'k' AS k, props ->> 'missing' AS missing FROM events")


@query("SELECT event_id, CAST(props ->> '$.k' AS INTEGER) + 1 AS more FROM events WHERE json_type(props, '$.k') IN ('UBIGINT', 'BIGINT') AND CAST(props ->> '$.k' AS INTEGER) % 2 = 0")
def json_variant(t):
    k = F.try_variant_get(F.parse_json("props"), "$.k", "int")
    return t.events.filter(k % 2 == 0).select("event_id", (k + 1).alias("more"))


@query("SELECT event_type, count(*) AS n, round(sum(value), 4) AS total, strftime(date_trunc('hour', ts), '%Y-%m-%d %H:%M') AS hour FROM events GROUP BY event_type, date_trunc('hour', ts)")
def event_hours(t):
    from quern.streaming import event_windows

    return event_windows(t.events).select("event_type", "n", "total", F.date_format("start", "yyyy-MM-dd HH:mm").alias("hour"))
