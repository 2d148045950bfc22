"""Shards on disk."""

from quern.llm import sharding


def test_write_shards(spark, documents, tmp_path):
    assert sharding.write_shards(documents, f"{tmp_path}/out", 50_000) == "shard"
    written = spark.read.parquet(f"{tmp_path}/out")
    held = {r["shard"]: r["b"] for r in written.selectExpr("shard", "octet_length(text) b").groupBy("shard").sum("b").withColumnRenamed("sum(b)", "b").collect()}
    assert written.count() == documents.count()
    sizes = {r["shard"]: r["b"] for r in sharding.assign(documents, 50_000).groupBy("shard").agg({"n_bytes": "sum"}).withColumnRenamed("sum(n_bytes)", "b").collect()}
    assert all(b <= 50_000 for b in sizes.values()) and len(sizes) > 5
    assert held == {f"b{k}": b for k, b in sizes.items()}


def test_write_shards_of_tables_with_a_column_shard(spark, clashing, empty, tmp_path):
    assert sharding.write_shards(clashing, f"{tmp_path}/out", 1000) == "shard_"
    written = spark.read.parquet(f"{tmp_path}/out")
    assert sorted(written.columns) == sorted([*clashing.columns, "shard_"]) and written.count() == clashing.count()
    sharding.write_shards(empty, f"{tmp_path}/none", 1000)


def test_rows_without_an_id_are_parted_by_their_texts(spark):
    df = spark.createDataFrame([(None, f"text {k}") for k in range(200)] + [(7, f"other {k}") for k in range(200)], "doc_id long, text string")
    rows = sharding.assign(df, 100).collect()
    assert len(rows) == 400 and all(r["shard_bytes"] <= 100 for r in rows)


def test_only_oversized_buckets_split(documents):
    leaves = {r["shard"] for r in sharding.assign(documents, 50_000).select("shard").distinct().collect()}
    assert len({len(s) for s in leaves}) > 1
    # no shard is the beginning of another
    assert not any(a != b and b.startswith(a) for a in leaves for b in leaves)
