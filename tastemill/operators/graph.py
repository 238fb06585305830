"""The user-item graph of positives: degrees, propagation, and a map from latents to content vectors."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tastemill.functions.vectors import vector_sum
from tastemill.operators.holdout import holdout_pairs
from tastemill.sources.shared import new_path


def degrees(ix: DataFrame) -> DataFrame:
    """side, id, degree over distinct positive edges."""
    e = holdout_pairs(ix)
    u = e.groupBy(F.col("user_id").alias("id")).agg(F.count(F.lit(1)).alias("degree")).select(F.lit("user").alias("side"), "id", "degree")
    i = e.groupBy(F.col("item_id").alias("id")).agg(F.count(F.lit(1)).alias("degree")).select(F.lit("item").alias("side"), "id", "degree")
    return u.unionByName(i)


def _written(df: DataFrame) -> DataFrame:
    path = new_path(df.sparkSession, "graph")
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def propagate(edges: DataFrame, source: DataFrame, to: str, frm: str, dim: int) -> DataFrame:
    """One layer: to's vector is the sum of its neighbours' divided by the root of both degrees."""
    d_to = edges.groupBy(to).agg(F.count(F.lit(1)).alias("d_to"))
    d_from = edges.groupBy(frm).agg(F.count(F.lit(1)).alias("d_from"))
    rows = edges.join(source.select(frm, "embedding"), frm).join(d_from, frm).join(d_to, to)
    w = F.lit(1.0) / F.sqrt(F.col("d_to") * F.col("d_from"))
    return rows.groupBy(to).agg(vector_sum(F.col("embedding"), dim, w).alias("embedding"))


def light_gcn(ix: DataFrame, items: DataFrame, dim: int, layers: int = 2, keep=None) -> DataFrame:
    """user vectors: the mean of the layers' propagated ones (users have no vector of their own at layer 0).

    keep cuts lineage between layers: a written table in the shared folder, unless another way is given."""
    keep = keep or _written
    edges, item = keep(holdout_pairs(ix)), items
    total = None
    for _ in range(layers):
        user = keep(propagate(edges, item, "user_id", "item_id", dim))
        item = keep(propagate(edges, user, "item_id", "user_id", dim))
        total = user if total is None else total.unionByName(user)
    return total.groupBy("user_id").agg(vector_sum(F.col("embedding"), dim, F.lit(1.0 / layers)).alias("embedding"))


def seeded_latents(ids: DataFrame, key: str, dim: int, epochs: int, seed: int = 42) -> DataFrame:
    """The stub model: small normal latents, decayed once per epoch."""
    shrink = 0.999 ** max(1, epochs)
    draws = [F.randn(seed + j) * 0.1 * shrink for j in range(dim)]
    return ids.select(key).distinct().orderBy(key).select(key, F.array(*draws).alias("latent"))


def fit_map(latents: DataFrame, items: DataFrame, ridge: float = 1e-3) -> np.ndarray:
    """Ridge regression from latents to content vectors on all items. It takes the place of the reference's MLP.

    Tasks sum x'x and x'y of their rows; what is added up and collected is dim * (dim + dim) numbers, whatever the number of items."""
    rows = latents.join(items.select("item_id", "embedding"), "item_id").select("latent", "embedding")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = None
        for b in (b for b in batches if b.num_rows):
            x, y = (np.stack(b.column(c).to_numpy(zero_copy_only=False)) for c in ("latent", "embedding"))
            part = x.T @ np.hstack([x, y])
            total = part if total is None else total + part
        if total is not None:
            yield pa.RecordBatch.from_arrays([pa.array(np.arange(len(total))), pa.array(total.tolist(), pa.list_(pa.float64()))], ["row", "sums"])

    sums = rows.mapInArrow(run, "row long, sums array<double>").select("row", F.posexplode("sums")).groupBy("row", "pos").agg(F.sum("col").alias("sum"))
    cells = sums.orderBy("row", "pos").collect()
    if not cells:
        raise ValueError("no item has a latent and a content vector")
    dim = cells[-1]["row"] + 1
    both = np.array([c["sum"] for c in cells]).reshape(dim, -1)
    return np.linalg.solve(both[:, :dim] + ridge * np.eye(dim), both[:, dim:])


def apply_map(latents: DataFrame, key: str, matrix: np.ndarray) -> DataFrame:
    d = matrix.shape[1]
    cells = [F.aggregate(F.zip_with("latent", F.array(*[F.lit(float(v)) for v in matrix[:, j]]), lambda a, b: a * b), F.lit(0.0), lambda s, v: s + v) for j in range(d)]
    return latents.select(key, F.array(*cells).alias("embedding"))
