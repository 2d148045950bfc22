"""Mixing sources to target weights: weighted fair queueing.

The documents of each source are shuffled; a document's virtual finish time is the number of
tokens (words) of its source up to and with it, divided by the source's weight. All documents
sorted by finish time are the mix: any prefix of it holds the sources in the ratio of their
weights, as long as they last. The mix is cut at a total budget of tokens.

Running sums are taken in two steps (within a slice, then over the slices' sums), so that a
source that holds most of the corpus is spread over as many tasks as any other load.

Defined results: documents with no words take part with 0 tokens; a null text has no words. A
null source is a source of its own. Rows that agree in doc_id and text stand at the same place
and stay or go together. A document that would pass the budget ends the mix. Weights that are
not positive drop the source. An empty table gives no rows. Extra columns play no part in plan()
and pass through mix().
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from quern.llm.common import cut, fits, md5_key, private, word_count

_SRC, _TOK, _KEY, _SLICE, _BEFORE, _W, _FIN = map(private, ("src", "tok", "key", "slice", "before", "w", "fin"))
#: Slices of a source's shuffled order (by three hex digits of the key), and of the finish times: equal ones, and so many for each doubling.
HEX, BINS, OCTAVE = 3, 1 << 18, 8192


def _source(source: str) -> Column:
    return F.coalesce(F.col(source).cast("string"), F.lit(""))


def _place(doc_id: str, text: str, seed: str) -> Column:
    return F.concat(md5_key(seed, F.col(doc_id)), F.md5(F.coalesce(F.col(text), F.lit(""))))


def _weights(weights: dict[str, float], default: float) -> Column:
    w = F.lit(float(default))
    for name, value in sorted(weights.items()):
        w = F.when(F.col(_SRC) == name, F.lit(float(value))).otherwise(w)
    return w


def _sliced_sum(df: DataFrame, by: list[str], slice_: str, order: list[str], amount: str, out: str) -> DataFrame:
    """out: the running sum of amount in the order of (slice_, *order), within each value of by; rows equal in order share the sum."""
    sums = df.groupBy(*by, slice_).agg(F.sum(amount).alias(_BEFORE))
    before = F.sum(_BEFORE).over((Window.partitionBy(*by) if by else Window.partitionBy(F.lit(0))).orderBy(slice_).rowsBetween(Window.unboundedPreceding, -1))
    sums = sums.select(*by, slice_, F.coalesce(before, F.lit(0)).alias(_BEFORE))
    within = F.sum(amount).over(Window.partitionBy(*by, slice_).orderBy(*order).rangeBetween(Window.unboundedPreceding, Window.currentRow))
    return df.withColumn(out, within).join(sums, [*by, slice_]).withColumn(out, F.col(out) + F.col(_BEFORE)).drop(_BEFORE)


def _finish(docs: DataFrame, weights: dict, default: float, seed: str, doc_id: str, source: str, text: str) -> DataFrame:
    light = docs.select(
        F.col(doc_id).alias("doc_id"), F.col(source).alias("source"), _source(source).alias(_SRC), word_count(F.col(text)).alias(_TOK), _place(doc_id, text, seed).alias(_KEY)
    ).withColumn(_SLICE, F.substring(_KEY, 1, HEX))
    light = light.withColumn(_W, _weights(weights, default)).filter(F.col(_W) > 0)
    summed = _sliced_sum(light, [_SRC], _SLICE, [_KEY], _TOK, "source_tokens")
    return summed.withColumn("finish", F.col("source_tokens").cast("double") / F.col(_W))


def _bin(finish: Column, top: float | None) -> Column:
    """A number that rises with the finish time. Equal bins part what is spread evenly, and those of logarithms what a source of tiny weight presses together near zero."""
    even = F.floor(finish * F.lit(BINS / top if top else 0.0)).cast("long")
    log = F.floor((F.log2(F.greatest(finish, F.lit(2.0**-60))) + 64) * OCTAVE).cast("long")
    return F.shiftleft(even, 24) + F.least(log, F.lit((1 << 24) - 1))


def plan(
    docs: DataFrame,
    weights: dict[str, float] | None = None,
    budget: int | None = None,
    budget_share: float | None = None,
    default_weight: float = 1.0,
    seed: str = "mix",
    doc_id: str = "doc_id",
    source: str = "source",
    text: str = "text",
) -> DataFrame:
    """(doc_id, source, n_tokens, source_tokens, finish, mix_tokens, key), sorted by finish time and cut at the budget.

    budget: tokens in all; or budget_share of all the tokens that there are. mix_tokens is the
    running total of the mix.
    """
    timed = cut(_finish(docs, weights or {}, default_weight, seed, doc_id, source, text))
    top, total = timed.agg(F.max("finish"), F.sum(_TOK)).first()
    limit = budget if budget is not None else int((total or 0) * (1.0 if budget_share is None else budget_share))
    timed = timed.withColumn(_FIN, _bin(F.col("finish"), top))
    mixed = _sliced_sum(timed, [], _FIN, ["finish", _SRC, _KEY], _TOK, "mix_tokens").filter(F.col("mix_tokens") <= limit)
    return mixed.select("doc_id", "source", F.col(_TOK).alias("n_tokens"), "source_tokens", "finish", "mix_tokens", F.col(_KEY).alias("key"), F.col(_SRC).alias("queue")).orderBy("finish", "queue", "key")


def mix(docs: DataFrame, doc_id: str = "doc_id", source: str = "source", text: str = "text", seed: str = "mix", **options) -> DataFrame:
    """The rows of docs that the mix holds, with all their columns.

    As each source's documents enter in the order of their keys, one last key a source tells
    which stay: no text is shuffled. The order of the mix is in plan()'s finish times.
    """
    last = plan(docs, doc_id=doc_id, source=source, text=text, seed=seed, **options).groupBy("queue").agg(F.max("key").alias(private("last")))
    marked = docs.withColumns({_SRC: _source(source), _KEY: _place(doc_id, text, seed)})
    ends = cut(last).withColumnRenamed("queue", _SRC)
    ends = F.broadcast(ends) if fits(ends) else ends
    return marked.join(ends, _SRC).filter(F.col(_KEY) <= F.col(private("last"))).select(*[F.col(f"`{c}`") for c in docs.columns])
