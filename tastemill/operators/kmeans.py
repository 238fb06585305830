"""Online interest centres: each positive moves the nearest centre, and all centres drift towards zero.

The fold depends on the order within a user, not between users. Partitions are dealt by user and sorted by
(user, order); one pass streams over them, moves the users of a batch side by side, and holds the centres of a
batch's users, however many rows a user has."""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tastemill.functions.feedback import is_positive
from tastemill.operators.retrieval import best_of, top_k

RATE = 0.15  # fixed value of the model


def first_centers(user: int, k: int, dim: int, seed: int) -> np.ndarray:
    """Small numbers from hashes, uniform in -0.1 to 0.1."""
    draw = lambda c, j: int(hashlib.md5(f"{seed}:{user}:{c}:{j}".encode()).hexdigest()[:8], 16)
    return np.array([[(draw(c, j) / 4294967296.0 - 0.5) * 0.2 for j in range(dim)] for c in range(k)])


def moved(centers: np.ndarray, v: np.ndarray, drift: float, rate: float = RATE) -> np.ndarray:
    """Centres (..., k, dim) of one or many users after one value (..., dim) of each."""
    distance = np.linalg.norm(centers - v[..., None, :], axis=-1)
    nearest = np.arange(centers.shape[-2]) == np.argmin(distance, axis=-1)[..., None]
    return np.where(nearest[..., None], (1 - rate) * centers + rate * v[..., None, :], centers) * (1 - drift)


def fit_centers(ix: DataFrame, items: DataFrame, k: int = 4, dim: int = 64, drift: float = 0.05, seed: int = 42, state: DataFrame | None = None) -> DataFrame:
    """user_id, centers (array of arrays). With a state of that form, users in it continue from their centres."""
    rows = ix.where(is_positive()).where("user_id is not null").select("user_id", "ord", "item_id")
    rows = rows.join(items.select("item_id", "embedding"), "item_id").select("user_id", F.lit(1).alias("kind"), "ord", "embedding", F.lit(None).cast("array<array<double>>").alias("centers"))
    if state is not None:  # a user's old centres come first
        rows = rows.unionByName(state.select("user_id", F.lit(0).alias("kind"), F.lit(0).cast("long").alias("ord"), F.lit(None).cast("array<double>").alias("embedding"), "centers"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        user, centers = None, None  # of the last user, whose rows may go on in the next batch
        for b in (b for b in batches if b.num_rows):
            ids, kind = b.column("user_id").to_numpy(), b.column("kind").to_numpy()
            first = np.flatnonzero(np.concatenate([np.ones(1, bool), ids[1:] != ids[:-1]]))
            owners = ids[first].tolist()
            if user is not None and user != owners[0]:
                yield _centers_batch([(user, centers)])
                user = None
            state = []
            for u, at in zip(owners, first.tolist()):
                old = b.column("centers")[at].as_py() if kind[at] == 0 else None
                state.append(centers if u == user else np.array(old) if old else first_centers(u, k, dim, seed))
            values = b.column("embedding").filter(pa.array(kind == 1))
            state = _folded(np.stack(state), np.append(first, b.num_rows), np.cumsum(kind == 1), np.stack(values.to_numpy(zero_copy_only=False))[:, :dim] if len(values) else None, drift)
            user, centers = owners[-1], state[-1]
            yield _centers_batch(list(zip(owners[:-1], state[:-1])))
        if user is not None:
            yield _centers_batch([(user, centers)])

    dealt = rows.repartition("user_id").sortWithinPartitions("user_id", "kind", "ord")
    return dealt.mapInArrow(run, "user_id long, centers array<array<double>>")


def _folded(state: np.ndarray, edges: np.ndarray, so_far: np.ndarray, values: np.ndarray | None, drift: float) -> np.ndarray:
    """The users' centres after their rows. Step t moves all users who have a t-th value at once; each user's values keep their order."""
    if values is None:
        return state
    so_far = np.concatenate([[0], so_far])
    begin, count = so_far[edges[:-1]], np.diff(so_far[edges])
    order = np.argsort(-count, kind="stable")
    for t in range(count.max()):
        own = order[: np.searchsorted(-count[order], -t)]  # those with more than t
        state[own] = moved(state[own], values[begin[own] + t], drift)
    return state


def _centers_batch(out: list) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array([u for u, _ in out], pa.int64()), pa.array([np.asarray(c).tolist() for _, c in out], pa.list_(pa.list_(pa.float64())))], ["user_id", "centers"])


def mean_center(centers: DataFrame, dim: int) -> DataFrame:
    """The exported user vector: the mean of the centres."""
    mean = lambda j: F.aggregate("centers", F.lit(0.0), lambda s, c: s + c[j]) / F.size("centers")
    return centers.select("user_id", F.array(*[mean(j) for j in range(dim)]).alias("embedding"))


def recommend(centers: DataFrame, items: DataFrame, k: int) -> DataFrame:
    """Top k of each item's best score over the user's centres: each centre's top k, then the maximum."""
    each = centers.select("user_id", F.posexplode("centers").alias("c", "embedding"))
    near = top_k(each, items, k, keys=("user_id", "c"))
    return best_of(near.groupBy("user_id", "item_id").agg(F.max("score").alias("score")), k)
