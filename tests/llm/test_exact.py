"""Block naming at block sizes that take several levels."""

import random

import pytest

from quern.llm import block_naming


@pytest.mark.parametrize(("block", "limit"), [(1, None), (3, 0), (3, 20), (64, 1)])
def test_small_blocks_match_brute_force(spark, block, limit):
    r = random.Random(block)
    texts = ["".join(r.choice("ab") for _ in range(r.randrange(9))) for _ in range(120)] + ["a" * 200, "a" * 200, "a" * 201, "a" * 199 + "b"]
    rows = list(enumerate(texts))
    got = {(x["doc_id"], x["keep_id"], x["copies"]) for x in block_naming.copies(spark.createDataFrame(rows, "doc_id long, text string"), block=block, limit=limit).collect()}
    assert got == {(k, texts.index(t), texts.count(t)) for k, t in rows if texts.index(t) != k}


@pytest.mark.parametrize("blocks", [2, 3, 5])
def test_repeated_rows_of_long_texts_are_copies(spark, blocks):
    text = "".join(chr(97 + i % 23) for i in range(4096 * blocks - 7))
    rows = [(1, text)] * 3 + [(2, text)] * 2 + [(3, text + "!")] * 2 + [(None, text + "?")] * 3 + [(4, "short")] * 2
    df = spark.createDataFrame(rows, "doc_id long, text string")
    got = sorted(((x["doc_id"], x["keep_id"], x["copies"]) for x in block_naming.copies(df).collect()), key=repr)
    assert got == sorted([(1, 1, 5)] * 2 + [(2, 1, 5)] * 2 + [(3, 3, 2), (4, 4, 2)] + [(None, None, 3)] * 2, key=repr)
    assert sorted((x["doc_id"] for x in block_naming.dedup(df).collect()), key=repr) == [1, 3, 4, None]


def test_a_hot_group_has_the_same_rows(spark):
    """Half of all rows are one text, a third one row, with and without what treats such groups apart."""
    rows = [(k, "hot " * 2000) for k in range(60)] + [(None, "same row")] * 40 + [(k, f"own {k}") for k in range(100, 120)]
    df = spark.createDataFrame(rows, "doc_id long, text string")
    apart, plain = (sorted((tuple(r) for r in block_naming.copies(df, limit=n).collect()), key=repr) for n in (5, None))
    assert apart == plain == sorted([(k, 0, 60) for k in range(1, 60)] + [(None, None, 40)] * 39, key=repr)
    assert sorted((x["doc_id"] for x in block_naming.dedup(df, limit=5).collect()), key=repr) == sorted([0, None, *range(100, 120)], key=repr)
