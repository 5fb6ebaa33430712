"""Connected components of an edge table."""

from __future__ import annotations

import uuid

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import Scratch

#: Up to so many edges (16 bytes each) are joined up in the driver; more take rounds of stars.
IN_DRIVER = 1_000_000


def forest(u: np.ndarray, v: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The distinct ids of edges (u, v) and the smallest id each reaches."""
    ids, flat = np.unique(np.concatenate([u, v]), return_inverse=True)
    a, b = flat[: len(u)], flat[len(u) :]
    root = np.arange(ids.size)
    while True:
        low = np.minimum(root[a], root[b])
        new = root.copy()
        np.minimum.at(new, root[a], low)
        np.minimum.at(new, root[b], low)
        while not np.array_equal(new, nxt := new[new]):
            new = nxt
        if np.array_equal(new, root):
            return ids, ids[root]
        root = new


def components(edges: DataFrame, held: Scratch, in_driver: int = IN_DRIVER) -> DataFrame:
    """(id, component_id) for every id in ``edges`` (u long, v long): the smallest id it reaches.

    Beyond ``in_driver`` edges, large and small stars alternate until nothing changes: the
    minimum of a node's neighbours is a partially aggregated ``min``, so a node with a third
    of all edges is no single task's work. Null ids and loops are left out.
    """
    spark, name = edges.sparkSession, f"edges-{uuid.uuid4().hex[:8]}"
    edges = held.write(edges.where("u <> v").select(F.least("u", "v").alias("v"), F.greatest("u", "v").alias("u")).distinct(), f"{name}-0")
    if edges.count() <= in_driver:
        got = edges.toArrow()
        held.drop(f"{name}-0")
        ids, root = forest(got["u"].to_numpy(), got["v"].to_numpy())
        return spark.createDataFrame(pa.table({"id": pa.array(ids, pa.int64()), "component_id": pa.array(root, pa.int64())}))
    mark, k = None, 0
    while True:
        both = edges.select("u", "v").unionByName(edges.select(F.col("v").alias("u"), F.col("u").alias("v")))
        low = both.groupBy("u").agg(F.least(F.min("v"), F.first("u")).alias("m"))
        large = both.where("v > u").join(low, "u").select(F.col("v").alias("u"), F.col("m").alias("v")).where("u <> v").distinct()
        k += 1
        large = held.write(large, f"{name}-{k}")
        low = large.groupBy("u").agg(F.min("v").alias("m"))
        small = large.join(low, "u").select(F.col("v").alias("u"), F.col("m").alias("v")).unionByName(low.select("u", F.col("m").alias("v"))).where("u <> v").distinct()
        k += 1
        edges = held.write(small, f"{name}-{k}")
        held.drop(f"{name}-{k - 1}", f"{name}-{k - 2}")
        now = edges.agg(F.count("*"), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)"))).first()
        if now == mark:
            return edges.select(F.col("u").alias("id"), F.col("v").alias("component_id")).unionByName(edges.select(F.col("v").alias("id"), F.col("v").alias("component_id")).distinct())
        mark = now
