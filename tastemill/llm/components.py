"""Connected components of an edge table; nothing is collected.

Up to `most_edges` edges (16 MB) one task joins them; more go through alternating large and small stars."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tastemill.llm._common import Scratch


def components(edges: DataFrame, scratch: Scratch, most_edges: int = 1_000_000, files: int | None = None) -> DataFrame:
    """edges (u, v), longs: (node, component), the component being its smallest node. Nodes without edges are absent.

    Every round writes its edges to the shared folder and removes those of the round before; rounds go on until one
    changes nothing. Minima are aggregated on the map side; the joins with them read two written tables, so the
    partition of a node with very many edges is split at run time."""
    now = _canonical(edges, scratch, files)
    if now.count() <= most_edges:
        return now.coalesce(1).mapInArrow(_joined, "node long, component long")
    mark, before = _mark(now), None
    while mark != before:
        large = _large_star(now, scratch)
        scratch.drop(now)
        now = _small_star(large, scratch)
        scratch.drop(large)
        mark, before = _mark(now), mark
    roots = now.select(F.col("v").alias("node")).distinct()
    return now.select(F.col("u").alias("node"), F.col("v").alias("component")).unionByName(roots.withColumn("component", F.col("node")))


def _joined(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Every node takes the smallest label of itself and its neighbours, and that label's own, until none changes."""
    parts = [(b.column("u").to_numpy(), b.column("v").to_numpy()) for b in batches]
    if not parts:
        return
    nodes, ends = np.unique(np.concatenate([x for p in parts for x in p]), return_inverse=True)
    # u and v of each part lie one after the other
    sizes = np.repeat([len(p[0]) for p in parts], 2)
    cut = np.split(ends, np.cumsum(sizes)[:-1])
    u, v = np.concatenate(cut[::2]), np.concatenate(cut[1::2])
    label = np.arange(len(nodes))
    while True:
        least = np.minimum(label[u], label[v])
        after = label.copy()
        for end in (label[u], label[v]):  # the roots are joined, so that whole trees move at once
            np.minimum.at(after, end, least)
        after = after[after]
        while not np.array_equal(after, after[after]):
            after = after[after]
        if np.array_equal(after, label):
            break
        label = after
    for at in range(0, len(nodes), 100_000):
        yield pa.RecordBatch.from_arrays([pa.array(nodes[at : at + 100_000]), pa.array(nodes[label[at : at + 100_000]])], ["node", "component"])


def _canonical(edges: DataFrame, scratch: Scratch, files: int | None = None) -> DataFrame:
    """Each edge once, from its larger to its smaller node."""
    pairs = edges.where("u <> v").select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v"))
    return scratch.written(pairs.distinct(), "edges", files=files)


def _mark(edges: DataFrame) -> tuple:
    row = edges.agg(F.count(F.lit(1)).alias("n"), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)")).alias("h")).first()
    return row["n"], row["h"]


def _large_star(edges: DataFrame, scratch: Scratch) -> DataFrame:
    """Every larger neighbour of a node is tied to the node's smallest neighbour (or itself)."""
    both = edges.unionByName(edges.select(F.col("v").alias("u"), F.col("u").alias("v")))
    least = scratch.written(both.groupBy("u").agg(F.least(F.min("v"), F.col("u")).alias("m")), "stars")
    # edges are (larger, smaller): the larger end is the neighbour
    tied = edges.join(least, edges["v"] == least["u"]).select(edges["u"], F.col("m").alias("v"))
    return _canonical(tied, scratch)


def _small_star(edges: DataFrame, scratch: Scratch) -> DataFrame:
    """A node and its smaller neighbours are tied to the smallest of them."""
    least = scratch.written(edges.groupBy("u").agg(F.min("v").alias("m")), "stars")
    others = edges.join(least, "u").where("v <> m").select(F.col("v").alias("u"), F.col("m").alias("v"))
    return _canonical(others.unionByName(least.select("u", F.col("m").alias("v"))), scratch)
