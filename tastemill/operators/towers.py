"""User and item vectors from metadata alone: scalar features tiled to the vector's width."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tastemill.functions.vectors import checked, tiled


def user_tower(users: DataFrame, dim: int, epochs: int = 1) -> DataFrame:
    decay = F.lit(0.999 ** max(1, epochs))
    features = [F.col(c).cast("double") for c in ("age", "gender", "geo", "train_interactions_rank")]
    return users.select("user_id", F.transform(tiled(features, dim), lambda x: x * decay).alias("embedding"))


def item_tower(items: DataFrame, embeddings: DataFrame, dim: int, epochs: int = 1) -> DataFrame:
    """Half metadata, half content where an item has a content vector."""
    decay = F.lit(0.999 ** max(1, epochs))
    features = [F.col(c).cast("double") for c in ("author_id", "duration", "train_interactions_rank")]
    joined = items.join(embeddings.select("item_id", F.col("embedding").alias("content")), "item_id", "left")
    meta = tiled(features, dim)
    mixed = F.when(F.col("content").isNotNull(), F.zip_with(meta, checked(F.col("content"), dim), lambda a, b: F.lit(0.5) * a + F.lit(0.5) * b)).otherwise(meta)
    return joined.select("item_id", F.transform(mixed, lambda x: x * decay).alias("embedding"))
