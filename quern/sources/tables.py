"""Tables in files: Parquet first, with CSV, JSON and ORC beside it."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

TABLES = ("region", "nation", "customer", "supplier", "part", "orders", "lineitem", "events", "documents", "embeddings", "pages", "benchmark", "labels", "conversations")


def read_table(spark: SparkSession, folder: str, name: str, kind: str = "parquet", schema: str | None = None, **options) -> DataFrame:
    """The table in folder/name.kind. Filters and column choices made on it reach the scan."""
    reader = spark.read.options(**options)
    if schema:
        reader = reader.schema(schema)
    return reader.format(kind).load(f"{folder}/{name}.{kind}")


def read_tables(spark: SparkSession, folder: str, *names: str) -> list[DataFrame]:
    return [read_table(spark, folder, n) for n in names]


def register_folder(spark: SparkSession, folder: str, names: tuple[str, ...] = TABLES) -> None:
    """A temporary view for each of the folder's tables."""
    for n in names:
        read_table(spark, folder, n).createOrReplaceTempView(n)


def write_table(df: DataFrame, path: str, kind: str = "parquet", partition_by: tuple[str, ...] = (), mode: str = "errorifexists", **options) -> None:
    writer = df.write.mode(mode).options(**options).format(kind)
    if partition_by:
        writer = writer.partitionBy(*partition_by)
    writer.save(path)


def json_rows(df: DataFrame, name: str = "row") -> DataFrame:
    """Each row as one JSON object, with nulls written out."""
    return df.select(F.to_json(F.struct(*[F.col(f"`{c}`") for c in df.columns]), {"ignoreNullFields": "false"}).alias(name))


def shared_folder(spark: SparkSession, kind: str) -> str:
    """A new folder that all executors share: under spark.checkpoint.dir, or a temporary one on a local master."""
    named = spark.conf.get("spark.checkpoint.dir", None)
    if not named:
        master = spark.conf.get("spark.master", "")
        if master != "local" and not master.startswith("local["):
            raise RuntimeError("set spark.checkpoint.dir to a folder that all executors share")
        named = tempfile.gettempdir()
    return f"{named.rstrip('/')}/quern-{kind}-{uuid.uuid4().hex}"
