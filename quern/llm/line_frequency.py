"""Quality rules: cross-document line frequency.

Lines are normalised (trimmed, lower case, runs of white space as one space) and hashed
together with their host; for every host the distinct documents that hold a line are counted;
a line above the limit is removed from all documents of the host, but for the first one unless
keep_first is off; a document of which too little is left is rejected.

Only hashes are shuffled, never texts: lines above the limit are few, so their sorted hashes
are broadcast (up to BROADCAST_LINES, some 32 MB) and looked up by binary search; beyond that
they are joined by shuffle.

Defined results: rows with a null or blank text, or whose removal leaves only blanks, are
rejected; blanks are spaces, tabs and line ends. A null host is a host of its own. Copies of one
text count as one document, so that exact duplication alone never makes a text's lines
boilerplate. The first document is the one of the smallest (doc_id, text digest), nulls last, so
that what a host repeats is not lost from it altogether; copies of the first document count as
first too. Blank lines stay. Other columns pass through unchanged, whatever their names; repeated
rows are treated alike. An empty table gives no rows.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from quern.llm.common import bounded_batches, cut, digest, private

_KEYS, _DOC, _HASH, _N, _FIRST, _ID, _DROP = map(private, ("keys", "doc", "hash", "n", "first", "id", "drop"))

#: Lines above the limit up to which they are broadcast; beyond, they are joined by shuffle.
BROADCAST_LINES = 2_000_000

_BLANK = " \t\r"


def _normal(line: Column) -> Column:
    return F.lower(F.trim(F.regexp_replace(line, r"[\t\r ]+", " ")))


def _keys(host: str, text: str) -> Column:
    """For each line its hash, null for a blank one; the host's name, or that it is null, is part of it."""
    named = F.coalesce(F.concat(F.lit("="), F.col(host).cast("string")), F.lit(""))
    lines = F.transform(F.split(F.coalesce(F.col(text), F.lit("")), "\n"), _normal)
    return F.transform(lines, lambda x: F.when(x != "", F.xxhash64(named, x)))


def _held(docs: DataFrame, host: str, text: str, doc_id: str) -> DataFrame:
    """(id, doc, hash): the lines of every document, once each."""
    some = docs.filter(F.col(text).isNotNull())
    return some.select(F.col(doc_id).alias(_ID), digest(text).alias(_DOC), F.explode(F.array_distinct(F.array_compact(_keys(host, text)))).alias(_HASH))


def frequent_lines(docs: DataFrame, host: str = "source", text: str = "text", doc_id: str = "doc_id", max_docs: int = 10) -> DataFrame:
    """(hash, n, first): the lines that more than max_docs distinct documents of a host hold, and the digest of the first.

    One shuffle of 24 bytes a line, which combines on the map side, so a line that every
    document holds doesn't gather anywhere until its documents are told apart.
    """
    one = _held(docs, host, text, doc_id).groupBy(_HASH, _DOC).agg(F.min(F.struct(F.col(_ID).isNull(), _ID, _DOC)).alias(_FIRST))
    return one.groupBy(_HASH).agg(F.count(F.lit(1)).alias(_N), F.min(_FIRST)[_DOC].alias(_FIRST)).filter(F.col(_N) > max_docs)


def _strip(text: str, drop: list[bool], min_kept: float) -> str | None:
    """text without the lines to drop; None where too little is left."""
    lines = text.split("\n")
    kept = [line for line, away in zip(lines, drop) if not away]
    left, total = (sum(len(line.strip(_BLANK)) for line in some) for some in (kept, lines))
    return "\n".join(kept) if left and left >= total * min_kept else None


def _stripped(texts: pa.Array, keys: pa.Array, hits: np.ndarray, min_kept: float) -> pa.Array:
    """texts without their lines that hits marks among all the lines' keys; null for rejected documents."""
    offsets = keys.offsets.to_numpy() - keys.offsets[0].as_py()
    marked = np.add.reduceat(np.append(hits, False), offsets[:-1], dtype=np.int64) if len(texts) else []
    out = []
    for k, text in enumerate(texts.to_pylist()):
        if text is None or not text.strip(_BLANK + "\n"):
            out.append(None)
        elif marked[k] and offsets[k] < offsets[k + 1]:
            out.append(_strip(text, hits[offsets[k] : offsets[k + 1]].tolist(), min_kept))
        else:
            out.append(text)
    return pa.array(out, pa.string())


def _flat(keys: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """All keys one after the other, and which are null."""
    flat = keys.flatten()
    return flat.fill_null(0).to_numpy(zero_copy_only=False), flat.is_null().to_numpy(zero_copy_only=False)


def clean(
    docs: DataFrame,
    host: str = "source",
    text: str = "text",
    doc_id: str = "doc_id",
    max_docs: int = 10,
    min_kept: float = 0.1,
    keep_first: bool = True,
    broadcast_lines: int = BROADCAST_LINES,
) -> DataFrame:
    """docs with frequent lines removed from text and depleted documents rejected.

    A document is depleted where fewer than min_kept of its non-blank lines' characters stay.
    """
    bounded_batches(docs.sparkSession)
    frequent = cut(frequent_lines(docs, host, text, doc_id, max_docs).select(_HASH, _FIRST))
    marked = docs.withColumns({_KEYS: _keys(host, text), _DOC: digest(text)})
    if frequent.count() <= broadcast_lines:
        found = frequent.toArrow()
        hashes, firsts = (found.column(c).to_numpy() for c in (_HASH, _FIRST))
        order = np.argsort(hashes)
        shared = docs.sparkSession.sparkContext.broadcast((hashes[order], firsts[order]))

        @F.arrow_udf("string")
        def strip(texts: pa.Array, keys: pa.Array, own: pa.Array) -> pa.Array:
            known, first = shared.value
            flat, null = _flat(keys)
            hits = np.zeros(len(flat), bool)
            if len(known):
                at = np.minimum(np.searchsorted(known, flat), len(known) - 1)
                sizes = np.diff(keys.offsets.to_numpy())
                hits = (known[at] == flat) & ~null
                if keep_first:
                    hits &= first[at] != np.repeat(own.to_numpy(zero_copy_only=False), sizes)
            return _stripped(texts, keys, hits, min_kept)

        new = strip.asNondeterministic()(F.col(text), F.col(_KEYS), F.col(_DOC))
    else:
        hits = _held(docs, host, text, doc_id).join(frequent, _HASH).filter((F.col(_FIRST) != F.col(_DOC)) | F.lit(not keep_first)).groupBy(_ID, _DOC).agg(F.collect_set(_HASH).alias(_DROP))
        a, b = marked.alias("a"), hits.alias("b")
        marked = a.join(b, F.col(f"a.`{doc_id}`").eqNullSafe(F.col(f"b.{_ID}")) & (F.col(f"a.{_DOC}") == F.col(f"b.{_DOC}")), "left").select("a.*", f"b.{_DROP}")

        @F.arrow_udf("string")
        def strip_joined(texts: pa.Array, keys: pa.Array, drop: pa.Array) -> pa.Array:
            flat, null = _flat(keys)
            offsets, hits = keys.offsets.to_numpy() - keys.offsets[0].as_py(), np.zeros(len(flat), bool)
            for k, some in enumerate(drop.to_pylist()):
                if some:
                    hits[offsets[k] : offsets[k + 1]] = np.isin(flat[offsets[k] : offsets[k + 1]], some) & ~null[offsets[k] : offsets[k + 1]]
            return _stripped(texts, keys, hits, min_kept)

        new = strip_joined.asNondeterministic()(F.col(text), F.col(_KEYS), F.col(_DROP))
    # not called deterministic, else the filter would have every text stripped twice
    fresh = private("new")
    return marked.withColumn(fresh, new).filter(F.col(fresh).isNotNull()).withColumn(text, F.col(fresh)).select(*[F.col(f"`{c}`") for c in docs.columns])
