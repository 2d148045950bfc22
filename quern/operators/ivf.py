"""A stored vector index: inverted lists of the cells of a coarse quantiser.

Centres are fitted by k-means on a bounded sample (`SAMPLE` vectors, those of the smallest hash),
at most `CELLS` of them. Every vector is put into the cell of its nearest centre, and rows are
written in the order of cells, so that a search reads the row groups of the cells nearest to the
query and ranks them exactly. Recall rises with the number of cells probed and is 1 where all are.
How many that takes is a matter of the data, so it is measured when the index is built: a search
probes the share of cells by which vectors of the sample found `RECALL` of their nearest ones in it.
"""

from __future__ import annotations

import math
from collections.abc import Sequence
from functools import reduce

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quern.functions.vector import l2_distance

#: Vectors that centres are fitted on, centres at most, and the recall asked of a search.
SAMPLE, CELLS, RECALL = 20_000, 4096, 0.97
Segment = tuple[str, Sequence[int] | None]


def kmeans(x: np.ndarray, cells: int, rounds: int = 10, seed: int = 0) -> np.ndarray:
    """Centres of x by Lloyd's rounds from random rows; an empty cell keeps its centre."""
    centres = x[np.random.default_rng(seed).choice(len(x), cells, replace=False)].copy()
    for _ in range(rounds):
        near = nearest_cell(x, centres)
        sums, counts = np.zeros_like(centres), np.bincount(near, minlength=cells)
        np.add.at(sums, near, x)
        centres = np.where(counts[:, None] > 0, sums / np.maximum(counts, 1)[:, None], centres)
    return centres


def nearest_cell(x: np.ndarray, centres: np.ndarray) -> np.ndarray:
    out, norms = np.empty(len(x), np.int32), (centres**2).sum(1)
    for at in range(0, len(x), 4096):
        out[at : at + 4096] = (norms - 2 * x[at : at + 4096] @ centres.T).argmin(1)
    return out


def probes(x: np.ndarray, centres: np.ndarray, k: int = 10, recall: float = RECALL, queries: int = 200) -> float:
    """The share of the cells that finds so much of the k nearest vectors in x, on average over some vectors of x."""
    cell, needed = nearest_cell(x, centres), []
    for q in x[:queries]:
        near = np.argsort(((x - q) ** 2).sum(1), kind="stable")[:k]
        place = np.empty(len(centres), np.int64)
        place[np.argsort(((centres - q) ** 2).sum(1), kind="stable")] = np.arange(len(centres))
        needed += place[cell[near]].tolist()
    return float(min(1.0, (np.quantile(needed, recall) + 1) / len(centres))) if needed else 1.0


def build(rows: DataFrame, doc: str, embedding: str, path: str, file: str | None = None) -> None:
    """Write a segment over rows; null vectors are in none. All vectors need the dimension of the first of the sample."""
    number = F.col(file) if file else F.lit(0)
    light = rows.select(F.col(doc).alias("doc"), number.cast("int").alias("file"), F.col(embedding).cast("array<double>").alias("embedding")).filter(F.col("embedding").isNotNull())
    n = light.count()
    sample = np.array([r[0] for r in light.orderBy(F.xxhash64("embedding")).limit(SAMPLE).select("embedding").collect()], dtype=object)
    if n:
        dim = len(sample[0])
        if any(len(v) != dim for v in sample):
            raise ValueError("vectors differ in dimension")
        x = np.array(sample.tolist(), np.float64).reshape(len(sample), dim)
        centres = kmeans(x, max(1, min(CELLS, len(x), round(n**0.5))))
        share = probes(x, centres)
    else:
        dim, centres, share = 0, np.zeros((0, 0)), 1.0

    @F.pandas_udf("int")
    def cell(vectors: pd.Series) -> pd.Series:
        if any(len(v) != dim for v in vectors):
            raise ValueError("vectors differ in dimension")
        return pd.Series(nearest_cell(np.array(vectors.tolist(), np.float64).reshape(len(vectors), dim), centres))

    celled = light.withColumn("cell", cell("embedding")) if n else light.withColumn("cell", F.lit(0))
    celled.repartitionByRange("cell", "doc").sortWithinPartitions("cell").write.parquet(f"{path}/lists")
    spark = rows.sparkSession
    spark.createDataFrame([(k, c.tolist(), share) for k, c in enumerate(centres)], "cell int, centre array<double>, probed double").coalesce(1).write.parquet(f"{path}/centres")


def search(spark: SparkSession, segments: Sequence[Segment], query: Sequence[float], k: int = 10, probed: float | None = None) -> DataFrame:
    """(vec_id, distance) of the k nearest vectors of the share of cells probed, or of the share measured; ties by id."""
    parts = []
    for path, alive in segments:
        centres = spark.read.parquet(f"{path}/centres").orderBy("cell").collect()  # CELLS rows at most
        part = spark.read.parquet(f"{path}/lists")
        if centres:
            if len(centres[0]["centre"]) != len(query):
                raise ValueError("vectors differ in dimension")
            far = ((np.array([c["centre"] for c in centres]) - np.array(query, np.float64)) ** 2).sum(1)
            share = centres[0]["probed"] if probed is None else probed
            wanted = np.argsort(far, kind="stable")[: max(8, math.ceil(len(far) * share))]
            if len(wanted) < len(far):
                part = part.filter(F.col("cell").isin([int(c) for c in wanted]))
        parts.append((part if alive is None else part.filter(F.col("file").isin(list(alive)))).select("doc", "embedding"))
    near = reduce(DataFrame.unionByName, parts).select(F.col("doc").alias("vec_id"), F.round(l2_distance(F.col("embedding"), query), 6).alias("distance"))
    return near.orderBy("distance", "vec_id").limit(k)
