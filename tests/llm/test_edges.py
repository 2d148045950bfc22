"""Every operator over the cases that must not break it, with their defined results."""

import pytest
from conftest import plain

from quern.llm import bk_simhash, block_naming, cross_parsing, html_lstm, licenses, line_frequency, mixing, packing, sharding, token_blocks

pages = lambda df: df.withColumnRenamed("doc_id", "page_id").withColumnRenamed("text", "html")

OPERATORS = {
    "token_blocks": lambda df: token_blocks.encode(df),
    "licenses": lambda df: licenses.scan(df),
    "line_frequency": lambda df: line_frequency.clean(df, max_docs=1),
    "line_frequency_joined": lambda df: line_frequency.clean(df, max_docs=1, broadcast_lines=-1),
    "packing": lambda df: packing.pack(df, 64),
    "html_lstm": lambda df: html_lstm.label(pages(df), sample_pages=4),
    "sharding": lambda df: sharding.assign(df, 1000),
    "block_naming": lambda df: block_naming.copies(df),
    "block_naming_dedup": lambda df: block_naming.dedup(df),
    "mixing": lambda df: mixing.plan(df, {"s1": 2.0}, budget_share=0.5),
    "mixing_mix": lambda df: mixing.mix(df, weights={"s1": 2.0}, budget_share=0.5),
    "cross_parsing": lambda df: cross_parsing.scores(df),
    "cross_parsing_hot": lambda df: cross_parsing.scores(df, hot=2, batch_bytes=1000),
    "bk_simhash": lambda df: bk_simhash.near_copies(df),
    "bk_simhash_dedup": lambda df: bk_simhash.dedup(df),
}


@pytest.mark.parametrize("name", OPERATORS)
def test_empty_table(empty, name):
    assert OPERATORS[name](empty).count() == 0


@pytest.mark.parametrize("name", OPERATORS)
def test_clashing_columns_change_nothing(edges, clashing, name):
    got, wanted = OPERATORS[name](clashing), OPERATORS[name](edges)
    if wanted.columns == edges.columns:
        assert got.columns == clashing.columns
        assert {r["copies"] for r in got.select("copies").collect()} <= {"extra"}
        got = got.select(wanted.columns)
    assert plain(got) == plain(wanted)


def test_tokens(edges):
    rows = token_blocks.encode(edges).collect()
    assert len(rows) == edges.count()
    assert all((r["n_tokens"], r["n_blocks"], r["block_starts"], r["payload"]) == (None,) * 4 for r in rows if r["doc_id"] == 3)
    assert all((r["n_tokens"], r["n_blocks"], r["block_starts"], bytes(r["payload"])) == (0, 0, [], b"") for r in rows if r["doc_id"] in (4, 5))


def test_lines(edges):
    kept = [(r["doc_id"], r["text"]) for r in line_frequency.clean(edges, max_docs=1).collect()]
    ids = [k for k, _ in kept]
    # null, empty and blank texts go; equal texts count once, so their lines are no boilerplate
    assert not {3, 4, 5, 6} & set(ids) and ids.count(1) == 2 and ids.count(2) == 1 and ids.count(None) == 2
    # all lines but the last of document 9 are in 7 too, which is the first
    assert 7 in ids and 8 in ids and 9 not in ids


def test_exact(edges):
    got = plain(block_naming.copies(edges))
    assert got == sorted([(1, 1, 5), (2, 1, 5), (None, 1, 5), (None, 1, 5), (5, 4, 2), (8, 7, 2)], key=repr)
    kept = [r["doc_id"] for r in block_naming.dedup(edges).collect()]
    assert sorted(k for k in kept if k is not None) == [1, 3, 3, 4, 6, 7, 9, 10, 11, 12, 13] and kept.count(None) == 1


def test_near(edges):
    got = plain(bk_simhash.near_copies(edges))
    assert got == sorted([(1, 1, 5), (2, 1, 5), (None, 1, 5), (None, 1, 5), (8, 7, 3), (9, 7, 3)], key=repr)
    kept = [r["doc_id"] for r in bk_simhash.dedup(edges).collect()]
    assert sorted(k for k in kept if k is not None) == [1, 3, 3, 4, 5, 6, 7, 10, 11, 12, 13] and kept.count(None) == 1


def test_mix_keeps_equal_rows_together(edges):
    kept = [r["doc_id"] for r in mixing.mix(edges, budget_share=1.0).collect()]
    assert len(kept) == edges.count()
    assert mixing.mix(edges, budget=0).filter("length(trim(text)) > 6").count() == 0
    assert mixing.mix(edges, weights={"s1": -1.0}, budget_share=1.0).filter("source = 's1'").count() == 0


def test_shards(edges):
    rows = sharding.assign(edges, 1000).collect()
    assert len(rows) == edges.count()
    assert len({r["shard"] for r in rows if r["doc_id"] == 1}) == 1
    assert all(r["n_bytes"] == 0 for r in rows if r["doc_id"] in (3, 4, 5))


def test_scores(edges):
    rows = cross_parsing.scores(edges).collect()
    assert len(rows) == edges.count()
    assert all(r["n_symbols"] == 0 and r["score"] is None for r in rows if r["doc_id"] in (3, 4, 5, 6))


def test_sorted_packing(edges):
    rows = packing.pack(edges, 64).collect()
    assert all(r["bin_id"] is None and r["pos"] is None for r in rows if r["n_tokens"] == 0)
    assert sum(r["n_tokens"] for r in rows if r["doc_id"] == 7) == len(__import__("conftest").LONG.split())
