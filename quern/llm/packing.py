"""Best-fit packing: minimum bin slack.

Documents are put together into training sequences of a fixed number of tokens (words). One
bin at a time, dynamic programming over the available lengths, with the reachable sums as the
bits of an integer, finds the fullest combination that fits, which is then removed.

Documents are spread over groups of about group_docs by the hash of their id and length; each group packs
by itself, so the number of groups grows with the corpus and the work of one doesn't. A text
longer than a bin is cut: its full pieces are bins of their own, its rest is packed.

Defined results: a document without words (null or blank text) takes no room: it is returned
with bin_id and pos null. Equal lengths go in the order of doc_id (nulls first); repeated rows
are documents of their own. Ties between combinations go to the one of the longer documents.
doc_id keeps its type, whatever it is. An empty table gives no rows. Extra columns play no part.
"""

from __future__ import annotations

from collections import defaultdict
from collections.abc import Hashable, Iterable

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quern.llm.common import cut, md5_key, private, word_count

_G = private("group")
#: Groups that one task packs, where there are many.
TASK_GROUPS = 64
#: A bin's number within its group takes the lower bits of bin_id.
GROUP_SHIFT = 32


def fullest(lengths: Iterable[tuple[int, int]], capacity: int) -> list[int]:
    """Lengths, from (length, count) pairs in descending order, of the largest sum up to capacity.

    Stops early only when the bin is full, so no fuller combination exists.
    """
    full, reach, items, before = (1 << (capacity + 1)) - 1, 1, [], []
    for length, count in lengths:
        for _ in range(min(count, capacity // length)):
            now = (reach | (reach << length)) & full
            if now == reach:
                break
            before.append(reach)
            items.append(length)
            reach = now
            if reach >> capacity:
                break
        if reach >> capacity:
            break
    left, chosen = reach.bit_length() - 1, []
    for i in range(len(items) - 1, -1, -1):
        if not left:
            break
        if not (before[i] >> left) & 1:
            chosen.append(items[i])
            left -= items[i]
    return chosen


def pack_lengths(rows: list[tuple[Hashable, int]], capacity: int) -> list[tuple[int | None, int | None, Hashable, int, int, int]]:
    """(bin, pos, doc_id, start, n_tokens, bin_tokens) of each piece of the documents (doc_id, n_tokens)."""
    out, bins, free = [], 0, defaultdict(list)
    for doc, n in sorted(rows, key=lambda r: (r[0] is not None, 0 if r[0] is None else r[0], r[1])):
        if n == 0:
            out.append((None, None, doc, 0, 0, 0))
            continue
        for start in range(0, n - capacity + 1, capacity):
            out.append((bins, 0, doc, start, capacity, capacity))
            bins += 1
        if n % capacity:
            free[n % capacity].append((doc, n - n % capacity))
    for waiting in free.values():
        waiting.reverse()
    order = sorted(free, reverse=True)
    while order:
        chosen = fullest(((n, len(free[n])) for n in order), capacity)
        total = sum(chosen)
        for pos, n in enumerate(sorted(chosen, reverse=True)):
            doc, start = free[n].pop()
            out.append((bins, pos, doc, start, n, total))
        if any(not free[n] for n in chosen):
            order = [n for n in order if free[n]]
        bins += 1
    return out


def pack(docs: DataFrame, capacity: int = 4096, group_docs: int = 8192, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """(bin_id, pos, doc_id, start, n_tokens, bin_tokens): where each piece of each document goes. start counts words."""
    light = cut(docs.select(F.col(doc_id).alias("doc_id"), word_count(F.col(text)).alias("n_tokens")))
    groups = max(1, -(-light.count() // group_docs))
    spread = F.pmod(F.conv(F.substring(md5_key("pack", F.col("doc_id"), F.col("n_tokens")), 1, 12), 16, 10).cast("long"), F.lit(groups))
    # as many partitions as asked for, as packing takes time and not room: by size they would be made few
    tasks = max(min(groups, 4 * docs.sparkSession.sparkContext.defaultParallelism), -(-groups // TASK_GROUPS))
    schema = pa.schema([("bin_id", pa.int64()), ("pos", pa.int32()), ("start", pa.int64()), ("n_tokens", pa.int64()), ("bin_tokens", pa.int64())])

    def one(key: tuple, rows: pa.Table) -> pa.Table:
        ids = rows.column("doc_id")
        packed = pack_lengths(list(zip(ids.to_pylist(), rows.column("n_tokens").to_pylist())), capacity)
        bins, pos, found, *rest = (list(c) for c in zip(*packed))
        low = key[0].as_py() << GROUP_SHIFT
        table = pa.table([pa.array(c, k) for c, k in zip([[None if b is None else low + b for b in bins], pos, *rest], schema.types)], schema=schema)
        return table.add_column(2, "doc_id", pa.array(found, ids.type))

    kind = light.schema["doc_id"].dataType.simpleString()
    return light.withColumn(_G, spread).repartition(tasks, _G).groupBy(_G).applyInArrow(one, f"bin_id bigint, pos int, doc_id {kind}, start bigint, n_tokens bigint, bin_tokens bigint")
