"""Bins against brute force."""

from itertools import combinations

from hypothesis import given, settings
from hypothesis import strategies as st

from quern.llm import packing


@settings(max_examples=200, deadline=None)
@given(st.lists(st.integers(1, 40), min_size=1, max_size=9), st.integers(1, 60))
def test_each_bin_is_the_fullest(lengths, capacity):
    counts = sorted({n: lengths.count(n) for n in lengths if n <= capacity}.items(), reverse=True)
    small = [n for n in lengths if n <= capacity]
    best = max((sum(c) for k in range(len(small) + 1) for c in combinations(small, k) if sum(c) <= capacity), default=0)
    chosen = packing.fullest(counts, capacity)
    assert sum(chosen) == best and all(chosen.count(n) <= lengths.count(n) for n in chosen)


@settings(max_examples=100, deadline=None)
@given(st.lists(st.integers(0, 200), max_size=40), st.integers(1, 50))
def test_every_piece_is_placed_once(lengths, capacity):
    rows = packing.pack_lengths(list(enumerate(lengths)), capacity)
    for doc, n in enumerate(lengths):
        pieces = sorted((r[3], r[4]) for r in rows if r[2] == doc)
        assert sum(p[1] for p in pieces) == n and all(a[0] + a[1] == b[0] for a, b in zip(pieces, pieces[1:]))
    bins = {}
    for r in rows:
        if r[0] is not None:
            bins.setdefault(r[0], []).append(r)
    for some in bins.values():
        assert sum(r[4] for r in some) == some[0][5] <= capacity and sorted(r[1] for r in some) == list(range(len(some)))


def brute(rows, capacity):
    """The same bins by trying all sums with a set, one bin at a time."""
    free = sorted((n % capacity for _, n in rows if n % capacity), reverse=True)
    totals = [capacity] * sum(n // capacity for _, n in rows)
    while free:
        reach = {0: ()}
        for i, n in enumerate(free):
            for total, used in list(reach.items()):
                if total + n <= capacity and total + n not in reach:
                    reach[total + n] = (*used, i)
        best = max(reach)
        totals.append(best)
        free = [n for i, n in enumerate(free) if i not in reach[best]]
    return sorted(totals)


def test_documents_match_brute_force(documents, texts):
    for capacity in (512, 4096):
        packed = packing.pack(documents, capacity).collect()
        totals = sorted({r["bin_id"]: r["bin_tokens"] for r in packed if r["bin_id"] is not None}.values())
        assert totals == brute([(d, len(t.split())) for d, t, _ in texts], capacity)
    assert len({r["bin_id"] >> packing.GROUP_SHIFT for r in packing.pack(documents, 4096, group_docs=20).collect()}) > 5


def test_ids_keep_their_type(spark):
    df = spark.createDataFrame([("b", "x y"), ("a", "x"), (None, "x y z"), ("a", "x"), ("c", None)], "doc_id string, text string")
    rows = packing.pack(df, 4).collect()
    assert sorted((r["doc_id"] or "", r["n_tokens"]) for r in rows) == [("", 3), ("a", 1), ("a", 1), ("b", 2), ("c", 0)]
    assert sorted({r["bin_id"]: r["bin_tokens"] for r in rows if r["bin_id"] is not None}.values()) == [3, 4]
