"""Connected components of a link table.

Up to ONE_TASK links (16 bytes each) are joined by union and find in one task, whose size that bounds: rounds of shuffles would cost
far more. Beyond, alternating star contractions: every round is two equi-joins with partial aggregation, so a node with very many links
costs no more than its links, and each round ends in a checkpoint in the shared folder.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import checkpoint

ONE_TASK = 1_000_000


def _united(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(node, component) of links (u, v); the component is its smallest node."""
    parts = [(b.column(0).to_numpy(zero_copy_only=False), b.column(1).to_numpy(zero_copy_only=False)) for b in batches]
    if not parts:
        return
    u, v = (np.concatenate(x) for x in zip(*parts, strict=True))
    nodes, at = np.unique(np.r_[u, v], return_inverse=True)
    root = list(range(len(nodes)))

    def find(i: int) -> int:
        while root[i] != i:
            root[i] = root[root[i]]
            i = root[i]
        return i

    for a, b in zip(at[: len(u)].tolist(), at[len(u) :].tolist(), strict=True):
        a, b = find(a), find(b)
        if a != b:
            root[max(a, b)] = min(a, b)
    whole = nodes[np.array([find(i) for i in range(len(nodes))], np.int64)]
    yield pa.RecordBatch.from_arrays([pa.array(nodes), pa.array(whole)], ["node", "component"])


def connected_components(links: DataFrame, a: str = "a", b: str = "b") -> DataFrame:
    """(node, component) of every node with a link; component is the smallest node reachable.

    Links with a null end and loops are ignored; repeated links and either direction count once. An empty table gives an empty one.
    """
    whole = links.where(F.col(a).isNotNull() & F.col(b).isNotNull())
    edges = whole.select(F.greatest(a, b).cast("long").alias("u"), F.least(a, b).cast("long").alias("v")).where("u > v").distinct()
    edges = checkpoint(edges)
    if edges.limit(ONE_TASK + 1).count() <= ONE_TASK:
        return edges.coalesce(1).mapInArrow(_united, "node long, component long")
    before = None
    while True:
        both = edges.union(edges.select("v", "u")).toDF("x", "y")
        least = both.groupBy("x").agg(F.min("y").alias("m")).select("x", F.least("x", "m").alias("m"))
        large = both.join(least, "x").where("y > x").select(F.col("y").alias("u"), F.col("m").alias("v")).distinct()
        low = large.groupBy("u").agg(F.min("v").alias("m"))
        small = large.join(low, "u").where("v > m").select(F.col("v").alias("u"), F.col("m").alias("v"))
        edges = checkpoint(small.union(low.toDF("u", "v")).distinct())
        now = edges.agg(F.count("*"), F.sum(F.xxhash64("u", "v").cast("decimal(20,0)"))).first()
        if now == before:
            break
        before = now
    return edges.select(F.col("u").alias("node"), F.col("v").alias("component")).union(edges.select(F.col("v").alias("node"), F.col("v").alias("component")).distinct())
