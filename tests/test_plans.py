"""Physical plans: what must be pushed down, and what must not appear."""

import io
from contextlib import redirect_stdout

import pytest

from quern import suite


def plan(df):
    out = io.StringIO()
    with redirect_stdout(out):
        df.explain("formatted")
    return out.getvalue()


@pytest.mark.parametrize("name", ["topk", "vector_topk", "bm25_topk", "bm25_indexed_topk", "vector_topk_operator", "sort_alias", "filtered_knn"])
def test_limits_keep_k_rows_a_task(spark, sf, name):
    assert "TakeOrderedAndProject" in plan(suite.QUERIES[name](spark, sf))


@pytest.mark.parametrize("name", ["join_inner_hash", "join_comma", "join_multiway", "join_multi_key", "join_null_safe", "dml_upsert"])
def test_equal_joins_are_no_products(spark, sf, name):
    text = plan(suite.QUERIES[name](spark, sf))
    assert "CartesianProduct" not in text and "NestedLoop" not in text


def test_filters_and_columns_reach_the_scan(spark, sf):
    text = plan(suite.QUERIES["pk_point_lookup"](spark, sf))
    assert "EqualTo(o_orderkey,4242)" in text and "ReadSchema: struct<o_orderkey:bigint,o_custkey:bigint,o_orderstatus:string,o_totalprice:double>" in text


def test_hot_paths_stay_in_the_jvm(spark, sf):
    for name, query in suite.QUERIES.items():
        text = plan(query(spark, sf))
        assert not any(x in text for x in ("EvalPython", "InArrow", "InPandas", "PythonUDF")), name


def test_search_shuffles_no_corpus(spark, sf):
    assert "Exchange hashpartitioning" not in plan(suite.QUERIES["bm25_topk"](spark, sf))


def test_stored_postings_are_pruned_and_texts_not_read(spark, sf):
    for name in ("fts_indexed_match", "bm25_indexed_topk"):
        text = plan(suite.QUERIES[name](spark, sf))
        assert "In(token, [onst,ther])" in text or "In(token, [ther,onst])" in text, name
        assert "documents.parquet" not in text and "lower(" not in text, name
