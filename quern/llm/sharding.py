"""Sharding: extendible hashing.

A directory is indexed by the first bits of a document's hash. It starts as one bucket; a
bucket whose documents' bytes exceed the limit splits on the next bit, and only that bucket,
until every shard fits. So a shard is named by a bit string, and the depth differs by shard.

The directory is found from sums over cells (hash prefixes a few bits deeper than shards will
be), never from rows on the driver: a cell's shard is the shallowest prefix that fits. Cells
that are still too large are split further on their own rows.

The hash is that of the doc_id and the text, so that rows of one id, or without an id, are parted
where their texts differ, and copies where their ids do.

Defined results: a null or empty text has 0 bytes and still gets a shard; a null doc_id hashes
as a value of its own. Rows that repeat both doc_id and text hash alike and can't be parted: a
shard that consists of one hash may exceed the limit, as may one document. An empty table gives
no rows, and write_shards an empty folder. Extra columns play no part.
"""

from __future__ import annotations

import math
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from quern.llm.common import cut, md5_key, private

_H, _B, _CELL, _D, _P, _SUM, _LO, _HI = map(private, ("hash", "bytes", "cell", "d", "p", "sum", "lo", "hi"))
#: Hash bits, how much deeper than an average shard the cells lie, and how many cells are broadcast at most.
BITS, SLACK, BROADCAST_CELLS = 60, 5, 200_000


def _hash(doc_id: str, text: str) -> Column:
    return F.conv(F.substring(md5_key("shard", F.col(doc_id), F.md5(text)), 1, BITS // 4), 16, 10).cast("long")


def _prefix(depth: int | Column) -> Column:
    return F.shiftright(_H, BITS - depth) if isinstance(depth, int) else F.expr(f"shiftright({_H}, {BITS} - {_D})")


def _leaves(cells: DataFrame, above: int, depth: int, limit: int) -> DataFrame:
    """(cell, d, sum) of the cells at this depth that lie in a prefix of above..depth bits that fits."""
    levels = cells.withColumn(_D, F.explode(F.sequence(F.lit(above), F.lit(depth)))).withColumn(_P, F.expr(f"shiftright({_CELL}, {depth} - {_D})"))
    sums = levels.groupBy(_D, _P).agg(F.sum(_B).alias(_SUM), F.min(_LO).alias(_LO), F.max(_HI).alias(_HI))
    fits = sums.filter((F.col(_SUM) <= limit) | (F.col(_LO) == F.col(_HI)) | (F.col(_D) == BITS))
    return levels.select(_CELL, _D, _P).join(fits, [_D, _P]).groupBy(_CELL).agg(F.min(F.struct(_D, _SUM)).alias("leaf")).select(_CELL, f"leaf.{_D}", f"leaf.{_SUM}")


def _directory(rows: DataFrame, limit: int) -> list[tuple[int, DataFrame]]:
    """[(depth of cells, leaves)]: a row's shard is that of its cell in the first of them that has the cell."""
    total = rows.agg(F.sum(_B)).first()[0] or 0
    open_rows, above, out = rows, 0, []
    depth = min(BITS, max(0, math.ceil(math.log2(total / limit))) + SLACK if total > limit else 0)
    while True:
        cells = cut(open_rows.groupBy(_prefix(depth).alias(_CELL)).agg(F.sum(_B).alias(_B), F.min(_H).alias(_LO), F.max(_H).alias(_HI)))
        leaves = cut(_leaves(cells, above, depth, limit))
        held = leaves.count()
        out.append((depth, F.broadcast(leaves) if held <= BROADCAST_CELLS else leaves))
        if held == cells.count():
            return out
        open_rows = cut(open_rows.withColumn(_CELL, _prefix(depth)).join(out[-1][1], _CELL, "left_anti").drop(_CELL))
        above, depth = depth + 1, min(BITS, depth + SLACK + 3)


def _sharded(rows: DataFrame, directory: list[tuple[int, DataFrame]]) -> DataFrame:
    """rows, which have a hash, with their shard's depth and size, and its bit string as column _P."""
    parts = []
    for depth, leaves in directory:
        keyed = rows.withColumn(_CELL, _prefix(depth))
        parts.append(keyed.join(leaves, _CELL))
        rows = keyed.join(leaves, _CELL, "left_anti").drop(_CELL)
    bits = F.substring(F.lpad(F.bin(F.col(_H)), BITS, "0"), F.lit(1), F.col(_D))
    return reduce(DataFrame.unionByName, parts).withColumn(_P, bits)


def _light(docs: DataFrame, doc_id: str, text: str) -> DataFrame:
    return cut(docs.select(F.col(doc_id).alias("doc_id"), _hash(doc_id, text).alias(_H), F.coalesce(F.octet_length(text), F.lit(0)).cast("long").alias(_B)))


def assign(docs: DataFrame, limit_bytes: int = 64 << 20, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """(doc_id, shard, depth, n_bytes, shard_bytes) of every row; shard is the bit string of the shard's prefix."""
    rows = _light(docs, doc_id, text)
    out = _sharded(rows, _directory(rows, limit_bytes))
    return out.select("doc_id", F.col(_P).alias("shard"), F.col(_D).cast("int").alias("depth"), F.col(_B).alias("n_bytes"), F.col(_SUM).alias("shard_bytes"))


def write_shards(docs: DataFrame, path: str, limit_bytes: int = 64 << 20, doc_id: str = "doc_id", text: str = "text", column: str = "shard") -> str:
    """Write docs as one folder a shard, with one shuffle of the texts; the name of the folders' column.

    That is `column`, with underscores added while docs has a column of this name, in any case.
    """
    while column.lower() in {c.lower() for c in docs.columns}:
        column += "_"
    found = _sharded(docs.withColumn(_H, _hash(doc_id, text)), _directory(_light(docs, doc_id, text), limit_bytes))
    found.select(*[F.col(f"`{c}`") for c in docs.columns], F.concat(F.lit("b"), _P).alias(column)).repartition(column).write.mode("overwrite").partitionBy(column).parquet(path)
    return column
