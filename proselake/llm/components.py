"""Connected components by contraction: every round hooks each node to its smallest neighbour and merges whole trees.

Long chains shrink first inside range partitions, where edges between near ids meet. Each other step is an aggregate with
map-side combining or an equi-join that adaptive execution can split, so that one huge component or one star centre doesn't
end up in one task.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from proselake.llm.common import cut, local_components


def _local_stars(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """The edges of a partition as stars around the smallest node of each local component."""
    got = [b for b in batches if b.num_rows]
    if not got:
        return
    t = pa.Table.from_batches(got)
    nodes, back = np.unique(np.concatenate([t["u"].to_numpy(), t["v"].to_numpy()]), return_inverse=True)
    label = local_components(len(nodes), back[: t.num_rows], back[t.num_rows :])
    moved = label != np.arange(len(nodes))
    yield from pa.table([pa.array(nodes[moved]), pa.array(nodes[label[moved]])], names=["u", "v"]).to_batches(max_chunksize=1 << 16)


def _compressed(hook: DataFrame) -> DataFrame:
    """Parents replaced by roots: the distance to the root halves in each step."""
    while True:
        up = hook.select(F.col("node").alias("parent"), F.col("parent").alias("grand"))
        hook = cut(hook.join(up, "parent").select("node", F.col("grand").alias("parent"), (F.col("grand") != F.col("parent")).alias("moved")))
        if hook.where("moved").isEmpty():
            return hook.select("node", "parent")
        hook = hook.select("node", "parent")


def connected_components(edges: DataFrame, src: str = "src", dst: str = "dst") -> DataFrame:
    """(node, component) of every node that has an edge; component is the smallest node reachable.

    Nulls are no nodes: edges with one are ignored. Loops and repeated edges change nothing. No edges: an empty result.
    """
    e = edges.where(F.col(src).isNotNull() & F.col(dst).isNotNull() & (F.col(src) != F.col(dst)))
    e = e.select(F.greatest(src, dst).alias("u"), F.least(src, dst).alias("v"))
    e = cut(e.repartitionByRange("u", "v").mapInArrow(_local_stars, "u long, v long"))
    labels = None
    while not e.isEmpty():
        both = e.select(F.col("u").alias("node"), F.col("v").alias("to")).union(e.select(F.col("v"), F.col("u")))
        hook = cut(both.groupBy("node").agg(F.min("to").alias("to")).select("node", F.least("node", "to").alias("parent")))
        hook = _compressed(hook)
        if labels is None:
            labels = hook.select("node", F.col("parent").alias("component"))
        else:
            up = hook.select(F.col("node").alias("component"), "parent")
            labels = labels.join(up, "component", "left").select("node", F.coalesce("parent", "component").alias("component"))
            labels = cut(labels)
        e = (
            e.join(hook.select(F.col("node").alias("u"), F.col("parent").alias("pu")), "u")
            .join(hook.select(F.col("node").alias("v"), F.col("parent").alias("pv")), "v")
            .where("pu != pv")
            .select(F.greatest("pu", "pv").alias("u"), F.least("pu", "pv").alias("v"))
            .distinct()
        )
        e = cut(e)
    if labels is None:
        return e.select(F.col("u").alias("node"), F.col("v").alias("component"))
    return labels
