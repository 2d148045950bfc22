"""Helpers that the training-data operators share."""

from __future__ import annotations

import os
import tempfile

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def _ensure_checkpoint_dir(spark: SparkSession) -> None:
    """Use the folder that the cluster names in spark.checkpoint.dir; make one only for a local master."""
    sc = spark.sparkContext
    if sc.getCheckpointDir() is not None:
        return
    named = spark.conf.get("spark.checkpoint.dir", None)
    if named:
        sc.setCheckpointDir(named)
    elif sc.master.startswith("local[") or sc.master == "local":
        sc.setCheckpointDir(os.path.join(tempfile.gettempdir(), "quern-checkpoints"))
    else:
        raise RuntimeError("set spark.checkpoint.dir to a folder that all executors share")


def cut(df: DataFrame) -> DataFrame:
    """Write df to the shared checkpoint folder and return it without its lineage.

    The copy outlives lost executors, unlike a local checkpoint.
    """
    _ensure_checkpoint_dir(df.sparkSession)
    return df.checkpoint(eager=True)


#: Bytes of an Arrow batch of whole texts.
BATCH_BYTES = 4 << 20


def bounded_batches(spark: SparkSession) -> None:
    """Limit the session's Arrow batches by bytes, as texts differ in length by orders of magnitude; a lower limit stays."""
    name = "spark.sql.execution.arrow.maxBytesPerBatch"
    now = str(spark.conf.get(name)).lower().rstrip("b")
    if not now.isdigit() or int(now) > BATCH_BYTES:
        spark.conf.set(name, BATCH_BYTES)


def word_count(text: Column) -> Column:
    """Number of words (runs without white space); 0 for a null text."""
    return F.coalesce(F.regexp_count(text, F.lit(r"\S+")).cast("long"), F.lit(0).cast("long"))


def md5_key(seed: str, *cols: Column) -> Column:
    """A pseudo-random key as 32 hex digits, equal in any engine that has MD5."""
    parts = [F.lit(seed)]
    for c in cols:
        parts += [F.lit(":"), F.coalesce(c.cast("string"), F.lit("\u0000null"))]
    return F.md5(F.concat(*parts))


def private(name: str) -> str:
    """Name of a working column, unlikely to clash with an input's own."""
    return f"__quern_{name}"


def digest(text: str) -> Column:
    """Hash of a text by which rows that repeat a doc_id are told apart."""
    return F.xxhash64(F.col(text))


#: Bytes of a table up to which it is broadcast; beyond, the join shuffles.
BROADCAST_BYTES = 64 << 20


def fits(df: DataFrame, limit: int = BROADCAST_BYTES) -> bool:
    """Whether df's values, which should be cut, have so few bytes that it may be broadcast."""
    held = F.lit(0).cast("long")
    for f in df.schema.fields:
        held += F.coalesce(F.octet_length(F.col(f"`{f.name}`").cast("string")), F.lit(0)) if f.dataType.typeName() in ("string", "binary") else F.lit(16)
    return (df.agg(F.sum(held)).first()[0] or 0) <= limit


def drop_copies(docs: DataFrame, found: DataFrame, doc_id: str, text: str) -> DataFrame:
    """docs without the documents of found, (id, digest, nth, rows), that aren't first in their group (nth > 1).

    Of a first document that several equal rows hold, one row stays.
    """
    found = cut(found.filter((F.col("nth") > 1) | (F.col("rows") > 1)).select("id", "digest", "nth", "rows"))
    drop, twice = found.filter(F.col("nth") > 1), found.filter((F.col("nth") == 1) & (F.col("rows") > 1))
    drop = F.broadcast(drop) if fits(drop) else drop
    hashed = private("digest")
    left = docs.withColumn(hashed, digest(text)).alias("d")

    def match(other: str) -> Column:
        return F.col(f"d.`{doc_id}`").eqNullSafe(F.col(f"{other}.id")) & (F.col(f"d.{hashed}") == F.col(f"{other}.digest")) & F.col(f"d.`{text}`").isNotNull()

    left = left.join(drop.alias("x"), match("x"), "left_anti")
    if not twice.isEmpty():
        left = left.alias("d")
        twice = F.broadcast(twice) if fits(twice) else twice
        # combines on the map side, so that no task sees all the rows that are one
        once = left.join(twice.alias("y"), match("y"), "left_semi").dropDuplicates([doc_id, hashed])
        left = left.join(twice.alias("y"), match("y"), "left_anti").unionByName(once)
    return left.select(*[F.col(f"`{c}`") for c in docs.columns])


#: Groups larger than this share of all rows are joined by broadcast, so there are at most as many of them.
HOT_SHARE, HOT_ROWS = 4096, 10_000


def hot_limit(total: int) -> int:
    """Rows of a group from which on it is hot: a part in HOT_SHARE of them all, so that no more than HOT_SHARE groups are."""
    return max(HOT_ROWS, total // HOT_SHARE)


def join_groups(rows: DataFrame, groups: DataFrame, on: list[str], size: str, limit: int) -> DataFrame:
    """rows joined to their groups by columns without nulls; size is the column of groups that counts their rows.

    Groups above limit, of which there are few by hot_limit(), are broadcast, so that none of
    them gathers in a task; rows and groups are read twice and should be cut.
    """
    hot = groups.filter(F.col(size) > limit)
    if hot.isEmpty():
        return rows.join(groups, on)
    large = F.broadcast(hot.select(*on))
    return rows.join(F.broadcast(hot), on).unionByName(rows.join(large, on, "left_anti").join(groups.filter(F.col(size) <= limit), on))


def repeated(df: DataFrame, times: Column) -> DataFrame:
    """Each row as often as times says, in steps that no array outgrows."""
    step, at = 1 << 16, private("at")
    many = df.withColumn(private("times"), times).filter(F.col(private("times")) > 0)
    many = many.withColumn(at, F.explode(F.sequence(F.lit(0).cast("long"), (F.col(private("times")) - 1).cast("long"), F.lit(step).cast("long"))))
    last = F.least(F.col(private("times")) - F.col(at), F.lit(step))
    return many.select(*df.columns, F.explode(F.sequence(F.lit(1).cast("long"), last.cast("long"))).alias(private("i"))).drop(private("i"))


def components(edges: DataFrame) -> DataFrame:
    """(node, component) of every node in edges (a, b): component is the smallest node that it is connected with.

    Alternating large and small stars (Kiveris et al., Connected Components in MapReduce and
    Beyond): each round is a few aggregations and joins over the edges, and the rounds grow
    with the logarithm of the longest chain.
    """
    now, before = cut(edges.filter("a <> b").select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).distinct()), None
    while True:
        both = now.unionByName(now.select(F.col("b").alias("a"), F.col("a").alias("b")))
        low = both.groupBy("a").agg(F.least(F.min("b"), F.col("a")).alias("low"))
        large = both.join(low, "a").filter(F.col("b") > F.col("a")).select(F.col("b").alias("a"), F.col("low").alias("b")).distinct()
        low = large.groupBy("a").agg(F.min("b").alias("low"))
        small = large.join(low, "a").select(F.explode(F.array(F.struct("a", F.col("low").alias("b")), F.struct(F.col("b").alias("a"), F.col("low").alias("b")))).alias("e"))
        now = cut(small.select("e.a", "e.b").filter("a <> b").distinct())
        state = now.agg(F.count(F.lit(1)), F.sum(F.xxhash64("a", "b").cast("decimal(20,0)"))).first()
        if state == before:
            break
        before = state
    return now.select(F.col("a").alias("node"), F.col("b").alias("component")).unionByName(now.select(F.col("b").alias("node"), F.col("b").alias("component")).distinct())
