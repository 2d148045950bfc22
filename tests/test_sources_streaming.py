"""File formats, and the same windows over a batch and a stream."""

import shutil

from comparison import rows_of

from quern.sources import read_table, read_tables, write_table
from quern.streaming import event_windows, read_events


def test_formats_round_trip(spark, sf, tmp_path):
    nation, region = read_tables(spark, sf, "nation", "region")
    schema = "n_nationkey int, n_name string, n_regionkey int"
    for kind in ("parquet", "orc", "json", "csv"):
        write_table(nation, f"{tmp_path}/nation.{kind}", kind)
        assert rows_of(read_table(spark, str(tmp_path), "nation", kind, schema)) == rows_of(nation)
    write_table(nation, f"{tmp_path}/parts.parquet", partition_by=("n_regionkey",))
    assert read_table(spark, str(tmp_path), "parts").filter("n_regionkey = 1").count() == nation.filter("n_regionkey = 1").count()
    assert region.count() == 5


def test_stream_equals_batch(spark, sf, tmp_path):
    (tmp_path / "in").mkdir()
    shutil.copy(f"{sf}/events.parquet", tmp_path / "in" / "events-1.parquet")
    q = event_windows(read_events(spark, str(tmp_path / "in"))).writeStream.outputMode("complete").format("memory").queryName("hours").option("checkpointLocation", str(tmp_path / "c")).start()
    q.processAllAvailable()
    q.stop()
    assert rows_of(spark.table("hours")) == rows_of(event_windows(read_table(spark, sf, "events")))
