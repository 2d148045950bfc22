"""A training-corpus pipeline: quality rules, exact dedup, near dedup, mixing, packing.

Each stage takes (spark, docs, sf_dir) and returns a DataFrame, which is written as Parquet and
read again as the next one's docs. All but the last return the columns of documents, and other
columns that docs has. An empty table gives no rows at any stage. Texts of any length are read
whole. The stages' folders are deleted once the last stage has read what it needs.
"""

from __future__ import annotations

import os
import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession

from quern.llm import bk_simhash, block_naming, line_frequency, mixing, packing
from quern.llm.queries import BUDGET_SHARE, CAPACITY, GROUP_DOCS, MAX_DOCS, MIN_KEPT, WEIGHTS


def quality_rules(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Lines that a source repeats go, and documents that consist of them.

    Rows with a null or blank text go; rows without a source are a source of their own.
    """
    return line_frequency.clean(docs, max_docs=MAX_DOCS, min_kept=MIN_KEPT)


def exact_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of equal texts stays, that of the smallest doc_id (nulls last); null texts stay."""
    return block_naming.dedup(docs)


def near_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near copies stays, that of the smallest doc_id (nulls last); texts without a word stay."""
    return bk_simhash.dedup(docs)


def mix_sources(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The documents that the weighted mix of the sources holds within its budget; rows equal in doc_id and text stay or go together."""
    return mixing.mix(docs, weights=WEIGHTS, budget_share=BUDGET_SHARE)


def pack_sequences(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Where each piece of each document goes in the training sequences; documents without a word are in none (bin_id null)."""
    return packing.pack(docs, CAPACITY, GROUP_DOCS)


STAGES = [
    ("quality_rules", quality_rules),
    ("exact_dedup", exact_dedup),
    ("near_dedup", near_dedup),
    ("mix_sources", mix_sources),
    ("pack_sequences", pack_sequences),
]

#: Fingerprints and bitset packing have no SQL form; tests compare the rows with a brute-force version.
ORACLE_SQL = None


def _folder(spark: SparkSession) -> str:
    """A new folder that all executors share: under spark.checkpoint.dir, or a temporary one on a local master."""
    named = spark.conf.get("spark.checkpoint.dir", None)
    if not named:
        master = spark.sparkContext.master
        if master != "local" and not master.startswith("local["):
            raise RuntimeError("set spark.checkpoint.dir to a folder that all executors share")
        named = os.path.join(tempfile.gettempdir(), "quern-pipeline")
    return f"{named.rstrip('/')}/pipeline-{uuid.uuid4().hex}"


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages applied to documents."""
    folder, docs = _folder(spark), spark.read.parquet(f"{sf_dir}/documents.parquet")
    try:
        for name, stage in STAGES[:-1]:
            stage(spark, docs, sf_dir).write.parquet(f"{folder}/{name}")
            docs = spark.read.parquet(f"{folder}/{name}")
        # packing keeps ids and lengths in a checkpoint of its own
        return STAGES[-1][1](spark, docs, sf_dir)
    finally:
        path = spark._jvm.org.apache.hadoop.fs.Path(folder)
        path.getFileSystem(spark._jsparkSession.sessionState().newHadoopConf()).delete(path, True)
