"""User vectors as exponential averages over batches, in closed form.

With batches 1..m in which the user has a valid interaction, x_m = a^m x_0 + (1 - a) sum a^(m-i) b_i: the fold
over batches is a weighted sum, so it needs no order of execution, and a later run continues from a state by
one more affine map. b_i is the weighted mean of the batch's item vectors (weights by score, divided by the
sum of absolute weights, 1 if that is 0)."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from tastemill.functions.feedback import score_of, score_weight
from tastemill.functions.vectors import vector_sum


def batch_profiles(ix: DataFrame, items: DataFrame, dim: int, batch_size: int = 250_000, weights: dict[int, float] | None = None) -> DataFrame:
    """user_id, batch, embedding, for ix with ord. Interactions without a vector are left out."""
    valued = ix.where("user_id is not null").withColumn("batch", F.expr(f"ord div {batch_size}")).withColumn("w", score_weight(score_of(ix.columns), weights))
    joined = valued.select("user_id", "item_id", "batch", "w").join(items.select("item_id", "embedding"), "item_id")
    sums = joined.groupBy("user_id", "batch").agg(vector_sum(F.col("embedding"), dim, F.col("w")).alias("v"), F.sum(F.abs("w")).alias("total"))
    total = F.when(F.col("total") == 0, 1.0).otherwise(F.col("total"))
    return sums.select("user_id", "batch", F.transform("v", lambda x: x / total).alias("embedding"))


def fold(profiles: DataFrame, dim: int, alpha: float = 0.95) -> DataFrame:
    """user_id, batches (m), embedding, from a zero vector."""
    back = Window.partitionBy("user_id").orderBy(F.desc("batch"))
    aged = profiles.withColumn("f", F.lit(1 - alpha) * F.pow(F.lit(alpha), F.row_number().over(back) - 1))
    return aged.groupBy("user_id").agg(F.count(F.lit(1)).alias("batches"), vector_sum(F.col("embedding"), dim, F.col("f")).alias("embedding"))


def update(state: DataFrame, new: DataFrame, alpha: float = 0.95) -> DataFrame:
    """A state (user_id, embedding) continued by the fold of new batches. Users of either side stay."""
    grown = new.select("user_id", F.col("batches").alias("m"), F.col("embedding").alias("new"))
    both = state.select("user_id", F.col("embedding").alias("old")).join(grown, "user_id", "full_outer")
    keep = F.pow(F.lit(alpha), F.col("m"))
    value = F.when(F.col("new").isNull(), F.col("old")).when(F.col("old").isNull(), F.col("new")).otherwise(F.zip_with("old", "new", lambda a, b: keep * a + b))
    return both.select("user_id", value.alias("embedding"))


def ema_vectors(ix: DataFrame, items: DataFrame, dim: int, alpha: float = 0.95, batch_size: int = 250_000, weights: dict[int, float] | None = None) -> DataFrame:
    return fold(batch_profiles(ix, items, dim, batch_size, weights), dim, alpha).select("user_id", "embedding")
