"""Seeded synthetic users, items and interactions in the legacy schema."""

from __future__ import annotations

from collections.abc import Iterator
from functools import reduce

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

POOL = 50  # of the nearest items an interaction picks one; fixed value
NOISE = 0.15
CELLS = 1 << 20  # affinities that are looked at together


def _gauss(dim: int, seed: int):
    return F.array(*[F.randn(seed + j) for j in range(dim)])


def _uniform(seed: int):
    """0 to 1 by the hash of the interaction's values, so it does not depend on where a row lies."""
    return F.shiftrightunsigned(F.xxhash64(F.lit(seed), "user_id", "item_id", "affinity"), 11) / F.lit(2.0**53)


def mixed(x: np.ndarray) -> np.ndarray:
    """A hash of unsigned 64-bit numbers (the finaliser of splitmix64)."""
    x = (x + np.uint64(0x9E3779B97F4A7C15)).astype(np.uint64)
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


def row_keys(seed: int, user: np.ndarray, row: np.ndarray) -> np.ndarray:
    return mixed(mixed(np.full(len(user), seed, np.uint64)) ^ mixed(mixed(user.astype(np.uint64)) ^ row.astype(np.uint64)))


def noise(keys: np.ndarray, items: np.ndarray) -> np.ndarray:
    """A standard normal number for each row's key and item, by their hash alone."""
    h = mixed(keys[:, None] ^ mixed(items.astype(np.uint64))[None, :])
    unit = lambda x: (x >> np.uint64(11)).astype(np.float64) / 2.0**53
    return np.sqrt(-2 * np.log1p(-unit(h))) * np.cos(2 * np.pi * unit(mixed(h)))


def _picks_of_block(users: DataFrame, shared, per_user: int, seed: int, whole: bool) -> DataFrame:
    """user_id, i, pick, item_id, affinity: of each row the POOL best of these items, or the picked one if these are all."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        ids, m = shared.value
        few, step = min(POOL, len(ids)), max(1, CELLS // len(ids))
        for b in batches:
            v = np.stack(b.column("embedding").to_numpy(zero_copy_only=False))
            user, row = np.repeat(b.column("user_id").to_numpy(), per_user), np.tile(np.arange(1, per_user + 1), len(v))
            for at in range(0, len(user), step):
                u, i = user[at : at + step], row[at : at + step]
                keys = row_keys(seed, u, i)
                x = v[np.arange(at, at + len(u)) // per_user] @ m.T + NOISE * noise(keys, ids)
                near = np.argpartition(-x, few - 1, axis=1)[:, :few]
                near = np.take_along_axis(near, np.argsort(-np.take_along_axis(x, near, 1), axis=1), 1)
                pick = (mixed(~keys) % np.uint64(POOL)).astype(np.int64)
                if whole:
                    near = np.take_along_axis(near, pick[:, None], 1)
                n = near.shape[1]
                columns = [np.repeat(u, n), np.repeat(i, n), np.repeat(pick, n), ids[near].ravel(), np.take_along_axis(x, near, 1).ravel()]
                yield pa.RecordBatch.from_arrays([pa.array(c) for c in columns], ["user_id", "i", "pick", "item_id", "affinity"])

    return users.select("user_id", "embedding").mapInArrow(run, "user_id long, i long, pick long, item_id long, affinity double")


def noisy_picks(users: DataFrame, items: DataFrame, per_user: int, seed: int, block_bytes: int = 256 << 20) -> DataFrame:
    """user_id, item_id, affinity: per_user rows a user. Each has noise of its own on all items and picks from its own POOL best.

    Items travel as broadcast blocks; with several, the rows' POOL best of each are merged by a window. No user-item pair is a row."""
    spark = users.sparkSession
    n, dim = items.count(), items.select(F.max(F.size("embedding"))).first()[0]
    blocks, parts = max(1, -(-n * dim * 8 // block_bytes)), []
    for k in range(blocks):
        t = (items if blocks == 1 else items.where(F.pmod(F.xxhash64("item_id"), F.lit(blocks)) == k)).toArrow().sort_by("item_id")
        if t.num_rows:
            shared = spark.sparkContext.broadcast((t["item_id"].to_numpy(), np.stack(t["embedding"].to_numpy())))
            parts.append(_picks_of_block(users, shared, per_user, seed, blocks == 1))
    found = reduce(DataFrame.unionByName, parts)
    if blocks > 1:
        place = F.row_number().over(Window.partitionBy("user_id", "i").orderBy(F.desc("affinity"), "item_id")) - 1
        found = found.withColumn("place", place).where(F.col("place") == F.col("pick"))
    return found.select("user_id", "item_id", "affinity")


def affinity_score(affinity: Column) -> Column:
    """0 to 3, by where the affinity, cut to -1 to 1, lies between three bounds."""
    a = F.least(F.greatest(affinity, F.lit(-1.0)), F.lit(1.0))
    return F.when(a < -0.2, 0).when(a < 0.2, 1).when(a < 0.55, 2).otherwise(3)


def generate(spark: SparkSession, n_users: int = 5000, n_items: int = 2000, dim: int = 32, per_user: int = 25, seed: int = 42) -> dict[str, DataFrame]:
    """users, items and interactions. Affinity is cosine with noise for each interaction and item; each interaction picks from its own pool.

    Randomness is by hash seeds: the same distributions as a generator with one stream, not the same numbers."""
    if n_items < POOL:
        raise ValueError(f"at least {POOL} items are needed")
    from tastemill.functions.vectors import normalized

    users = spark.range(n_users, numPartitions=8).select(F.col("id").alias("user_id"), normalized(_gauss(dim, seed)).alias("embedding"))
    items = spark.range(n_items, numPartitions=8).select(F.col("id").alias("item_id"), normalized(_gauss(dim, seed + dim)).alias("embedding"))
    drawn = noisy_picks(users, items, per_user, seed)
    score = affinity_score(F.col("affinity"))
    kind = F.when(score >= 2, "positive").when(score == 1, "neutral").otherwise("negative")
    rows = drawn.select(
        "user_id", "item_id", score.cast("tinyint").alias("score"),
        (F.lit(1_700_000_000) + F.floor(_uniform(seed + 2) * 14 * 86400)).cast("long").alias("timestamp"), kind.alias("event_type"),
        (score + F.sqrt(-2 * F.log1p(-_uniform(seed + 3))) * F.cos(_uniform(seed + 4) * 6.283185307179586) * 0.05).cast("float").alias("event_value"),
    )
    return {"users": users.select("user_id"), "items": items, "interactions": rows}


def write(spark: SparkSession, folder: str, **options) -> None:
    for name, df in generate(spark, **options).items():
        df.write.mode("overwrite").option("compression", "zstd").parquet(f"{folder}/{name}.parquet")
