"""Exact dedup by deterministic block naming (after Karp, Miller and Rosenberg).

Every text is cut into blocks of a fixed number of characters. Equal blocks get one integer
name: blocks are spread over buckets, sorted within each, and a block's name is its bucket
and its rank among the bucket's distinct blocks. Then adjacent names are paired and the pairs
named in the same way, halving the number of names, until each document has one. Names come
from comparing contents, not from digests, so two texts share an identity exactly where they
are equal. What is left to do after level 0 is integers only, and only of the texts longer
than one block.

Equal blocks need one name, but nothing that is equal in a large share of all rows is gathered:
blocks above hot_limit() rows, at most 4,096 of them by that limit, are named from their distinct
values, and the names broadcast (64 MB at the very most, as a block has 4,096 characters). The
same limit divides the groups when each row is told its first document.

Defined results: a null text has no identity and is nobody's copy; empty texts are equal to
each other. The document kept of a group is that of the smallest doc_id (null ids last).
Repeated rows, equal in doc_id and text, are copies too. An empty table gives no rows. Extra
columns play no part.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from quern.llm.common import cut, digest, drop_copies, hot_limit, join_groups, private, repeated

_ID, _DIGEST, _I, _N, _BLOCK, _NAME, _A, _B, _ROWS, _HASH, _N_ROWS = map(private, ("id", "digest", "i", "n", "block", "name", "a", "b", "rows", "hash", "n_rows"))
_KEY = [_ID, _DIGEST]

#: Characters in a block. A text of up to so many is named in one step.
BLOCK = 4096
#: A bucket's number takes the upper 22 bits of a name, the rank within the bucket the lower 41.
BUCKETS, RANK_BITS = 1 << 22, 41


def _ranked(df: DataFrame, by: list[str]) -> DataFrame:
    """df with an integer for each distinct value of by: collision-free, and the same however rows are spread."""
    bucket = F.pmod(F.xxhash64(*by), F.lit(BUCKETS))
    rank = F.dense_rank().over(Window.partitionBy(bucket).orderBy(*by))
    return df.withColumn(_NAME, F.shiftleft(bucket, RANK_BITS) + rank)


def _named(df: DataFrame, by: list[str], limit: int | None = None) -> DataFrame:
    """df with a column of names; values of by above limit rows have negative names, by their rank among such."""
    counts = df.groupBy(F.xxhash64(*by).alias(_HASH)).agg(F.count(F.lit(1)).alias(_N_ROWS))
    if limit is None:
        counts = cut(counts)
        limit = hot_limit(counts.agg(F.sum(_N_ROWS)).first()[0] or 0)
    hot = cut(counts.filter(F.col(_N_ROWS) > limit).select(_HASH))
    if hot.isEmpty():
        return _ranked(df, by)
    keyed = df.withColumn(_HASH, F.xxhash64(*by))
    often = keyed.join(F.broadcast(hot), _HASH, "left_semi")
    # there are as many distinct values as hot hashes, but for collisions, so one task ranks them
    names = often.select(_HASH, *by).distinct().withColumn(_NAME, -F.row_number().over(Window.orderBy(_HASH, *by)).cast("long"))
    same = [F.col(f"o.{c}").eqNullSafe(F.col(f"n.{c}")) for c in by]
    often = often.alias("o").join(F.broadcast(cut(names)).alias("n"), [F.col(f"o.{_HASH}") == F.col(f"n.{_HASH}"), *same]).select(*[f"o.{c}" for c in df.columns], f"n.{_NAME}")
    return _ranked(keyed.join(F.broadcast(hot), _HASH, "left_anti").drop(_HASH), by).unionByName(often)


def identities(docs: DataFrame, doc_id: str = "doc_id", text: str = "text", block: int = BLOCK, limit: int | None = None) -> DataFrame:
    """(id, digest, level, name, rows): the identity (level, name) of every text that isn't null.

    digest only tells apart rows that repeat a doc_id; rows counts those that repeat both.
    """
    whole = docs.filter(F.col(text).isNotNull()).select(
        F.col(doc_id).alias(_ID), digest(text).alias(_DIGEST), F.col(text).alias(_BLOCK), F.greatest(F.lit(1), F.ceil(F.length(text) / block)).cast("int").alias(_N)
    )
    # a text of one block is not touched by substring, so most rows cost nothing here
    parts = F.when(F.col(_N) == 1, F.array(F.col(_BLOCK))).otherwise(
        F.transform(F.sequence(F.lit(0), F.col(_N) - 1), lambda i: F.substring(F.col(_BLOCK), i * block + 1, F.lit(block)))
    )
    blocks = whole.select(*_KEY, _N, F.posexplode(parts).alias(_I, _BLOCK))
    now = cut(_named(blocks, [_BLOCK], limit).select(*_KEY, _N, _I, _NAME, F.lit(1).cast("long").alias(_ROWS)))
    longest = now.agg(F.max(_N)).first()[0] or 0
    done, level = now.filter(F.col(_N) == 1), 0
    done = done.select(*_KEY, F.lit(0).alias("level"), _NAME, _ROWS)
    while (1 << level) < longest:
        level += 1
        pairs = cut(
            now.filter(F.col(_N) > (1 << (level - 1)))
            .groupBy(*_KEY, _N, F.shiftright(_I, 1).alias(_I))
            .agg(
                F.max(F.when(F.col(_I) % 2 == 0, F.col(_NAME))).alias(_A),
                F.max(F.when(F.col(_I) % 2 == 1, F.col(_NAME))).alias(_B),
                # rows that repeat doc_id and text fall together at level 1: each has one even block of a pair
                F.sum(F.when(F.col(_I) % 2 == 0, F.col(_ROWS))).alias(_ROWS),
            )
        )
        now = cut(_named(pairs, [_A, _B], limit).select(*_KEY, _N, _I, _NAME, _ROWS))
        done = done.unionByName(now.filter(F.col(_N) <= (1 << level)).select(*_KEY, F.lit(level).alias("level"), _NAME, _ROWS))
    # rows of one block that repeat doc_id and text fall together here
    return done.groupBy(*_KEY, "level", _NAME).agg(F.sum(_ROWS).alias("rows")).withColumnsRenamed({_ID: "id", _DIGEST: "digest", _NAME: "name"})


def _grouped(docs: DataFrame, doc_id: str, text: str, block: int, limit: int | None) -> DataFrame:
    """(id, digest, rows, keep_id, nth, copies) of the documents in groups of more than one row; nth is 1 for the document kept."""
    named = cut(identities(docs, doc_id, text, block, limit))
    first = F.struct(F.col("id").isNull().alias("none"), "id", "digest")
    groups = cut(named.groupBy("level", "name").agg(F.min(first).alias("first"), F.sum("rows").alias("copies"), F.count(F.lit(1)).alias("held")).filter("copies > 1"))
    if limit is None:
        limit = hot_limit(named.count())
    kept = F.col("id").eqNullSafe(F.col("first.id")) & (F.col("digest") == F.col("first.digest"))
    return join_groups(named, groups, ["level", "name"], "held", limit).select("id", "digest", "rows", F.col("first.id").alias("keep_id"), F.when(kept, 1).otherwise(2).alias("nth"), "copies")


def copies(docs: DataFrame, doc_id: str = "doc_id", text: str = "text", block: int = BLOCK, limit: int | None = None) -> DataFrame:
    """(doc_id, keep_id, copies): each row that equals an earlier document, and the document kept.

    copies is the number of rows in the group. A row that repeats a kept row has doc_id = keep_id.
    limit: rows of a hot block or group, hot_limit() unless given.
    """
    found = _grouped(docs, doc_id, text, block, limit)
    return repeated(found.select(F.col("id").alias("doc_id"), "keep_id", "copies", "rows", "nth"), F.col("rows") - F.when(F.col("nth") == 1, 1).otherwise(0)).select("doc_id", "keep_id", "copies")


def dedup(docs: DataFrame, doc_id: str = "doc_id", text: str = "text", block: int = BLOCK, limit: int | None = None) -> DataFrame:
    """docs without copies: of each group of equal texts one row stays. Rows with a null text stay."""
    return drop_copies(docs, _grouped(docs, doc_id, text, block, limit), doc_id, text)
