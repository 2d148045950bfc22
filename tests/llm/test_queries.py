"""The operators' queries against their SQL, and the SQL at other parameters."""

import pytest
from comparison import duck_rows, rows_of
from pyspark.sql import functions as F

from quern.llm import license_texts, licenses, line_frequency, mixing, queries, sharding


@pytest.mark.parametrize("name", sorted(queries.ORACLES))
def test_query_matches_sql(spark, duck, sf, name):
    assert rows_of(queries.QUERIES[name](spark, sf)) == duck_rows(duck, queries.ORACLES[name])


@pytest.mark.parametrize("limit", [1, 3, 5])
@pytest.mark.parametrize("broadcast", [0, 10**6])
def test_low_line_limits(documents, duck, limit, broadcast):
    got = rows_of(line_frequency.clean(documents, max_docs=limit, min_kept=0.9, broadcast_lines=broadcast))
    assert got == duck_rows(duck, queries.line_frequency_sql(limit, 0.9))
    assert len(got[1]) < documents.count() or limit > 1


@pytest.mark.parametrize("broadcast", [0, 10**6])
def test_lines_go_from_the_first_document_too(documents, duck, broadcast):
    got = rows_of(line_frequency.clean(documents, max_docs=1, min_kept=0.1, keep_first=False, broadcast_lines=broadcast))
    assert got == duck_rows(duck, queries.line_frequency_sql(1, 0.1, False))
    at = got[0].index("text")
    assert sum(len(r[at]) for r in got[1]) < sum(len(r[at]) for r in rows_of(line_frequency.clean(documents, max_docs=1, min_kept=0.1))[1])


def test_a_source_of_tiny_weight(documents, duck):
    weights = {"src0": 1e-7, "src1": 3.0}
    timed = mixing.plan(documents, weights, budget_share=1.0)
    assert rows_of(timed) == duck_rows(duck, queries.mixing_sql(weights, 1.0))
    top = timed.agg(F.max("finish")).first()[0]
    rest = timed.filter("source <> 'src0'").select(mixing._bin(F.col("finish"), top).alias("b"), "finish")
    assert rest.select("b").distinct().count() > rest.count() / 3


@pytest.mark.parametrize("limit", [3_000, 50_000])
def test_small_shards(documents, duck, limit):
    got = sharding.assign(documents, limit)
    assert rows_of(got) == duck_rows(duck, queries.sharding_sql(limit))
    assert got.select("shard").distinct().count() > 5


@pytest.mark.parametrize("share", [0.0, 0.3, 1.0])
def test_other_mixes(documents, duck, share):
    weights = {"src0": 5.0, "src1": 0.25, "src2": 0.0}
    assert rows_of(mixing.plan(documents, weights, budget_share=share)) == duck_rows(duck, queries.mixing_sql(weights, share))
    kept = duck_rows(duck, queries.mixing_sql(weights, share, "doc_id"))[1]
    assert rows_of(mixing.mix(documents, weights=weights, budget_share=share).select("doc_id"))[1] == kept


def test_licence_texts_are_found_in_other_dress(spark, duck):
    whole = dict(licenses.KNOWN)["ISC"]
    rows = [(1, whole.upper().replace(",", " ;")), (2, "x\nCopyright (c) 2020 A. Nother\nreleased under the MIT licence!\n"), (3, whole[:-10]), (4, None), (5, ""), (6, "All rights reserved. Not."), (2, "SPDX-License-Identifier: MIT"), (7, "© 2021 me\n" + whole)]
    df = spark.createDataFrame(rows, "doc_id long, text string")
    got = sorted((r["doc_id"], r["scope"], r["license"]) for r in licenses.scan(df).collect())
    # a text of one line is found as a text and as a line
    assert (1, "text", "ISC") in got and (2, "line", "MIT") in got and (7, "text", "ISC") in got
    assert {g[0] for g in got} == {1, 2, 7}


def test_full_licence_texts_and_spdx_lines_are_found(spark):
    full, mit = license_texts.texts(), dict(licenses.STATED[4:5])["MIT"]
    bare = mit.split("\n", 1)[1]
    rows = [(name, text) for name, text in full.items()]
    rows += [("MIT", bare), ("MIT", "The MIT License (MIT)\n" + bare), ("MIT", "MIT License\n\nCopyright (c) 2020 me\nAll rights reserved.\n" + bare.split("holder", 1)[1])]
    rows += [("GPL-2.0", full["GPL-2.0"].split("How to Apply These Terms")[0]), ("Apache-2.0", full["Apache-2.0"].split("APPENDIX:")[0])]
    rows += [(i, f"// SPDX-License-Identifier: {i}") for i in ("GPL-2.0", "MPL-2.0", "ISC", "LGPL-2.1-or-later", "AGPL-3.0-only")]
    df = spark.createDataFrame([(k, text) for k, (_, text) in enumerate(rows)], "doc_id long, text string")
    got = {r["doc_id"]: r["license"] for r in licenses.scan(df).filter("scope = 'text'").collect()}
    assert got == {k: name for k, (name, _) in enumerate(rows)}


def test_a_digest_names_one_licence(spark):
    rows = spark.createDataFrame(licenses.KNOWN, "license string, text string").select(licenses._digest(licenses.canonical(F.col("text"))).alias("digest"), "license")
    assert rows.groupBy("digest").agg(F.countDistinct("license").alias("n")).filter("n > 1").count() == 0
