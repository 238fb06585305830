"""Ranking metrics of recommendations (user_id, rank, item_id) against truth pairs (user_id, item_id)."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F


def hits(recs: DataFrame, truth: DataFrame, k: int) -> DataFrame:
    """user_id, rank, item_id, hit (0 or 1) of the first k of each user."""
    marked = truth.select("user_id", "item_id", F.lit(1).alias("t"))
    return recs.where(F.col("rank") <= k).join(marked, ["user_id", "item_id"], "left").select("user_id", "rank", "item_id", F.coalesce("t", F.lit(0)).cast("long").alias("hit"))


def user_metrics(recs: DataFrame, truth: DataFrame, k: int) -> DataFrame:
    """precision, recall, map and ndcg of every user with truth; a user without recommendations has 0 in all."""
    found = hits(recs, truth, k)
    so_far = Window.partitionBy("user_id").orderBy("rank").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    ranked = found.withColumn("cum", F.sum("hit").over(so_far)).withColumn("place", F.row_number().over(Window.partitionBy("user_id").orderBy("rank")))
    sums = ranked.groupBy("user_id").agg(
        F.count(F.lit(1)).alias("n_pred"),
        F.sum("hit").alias("n_hit"),
        F.sum(F.col("hit") * F.col("cum") / F.col("place")).alias("ap"),
        F.sum(F.col("hit") / F.log2(F.col("place") + F.lit(1.0))).alias("dcg"),
    )
    sizes = truth.groupBy("user_id").agg(F.count(F.lit(1)).alias("n_true"))
    ideal = F.aggregate(F.sequence(F.lit(1), F.least(F.lit(k), F.col("n_true")).cast("int")), F.lit(0.0), lambda s, i: s + F.lit(1.0) / F.log2(i + F.lit(1.0)))
    j = sizes.join(sums, "user_id", "left")
    zero = lambda c: F.coalesce(c, F.lit(0.0))
    return j.select(
        "user_id",
        zero(F.col("n_hit") / F.col("n_pred")).alias("precision"),
        zero(F.col("n_hit") / F.col("n_true")).alias("recall"),
        zero(F.col("ap") / F.least(F.lit(k), F.col("n_true"))).alias("map"),
        zero(F.col("dcg") / ideal).alias("ndcg"),
    )


def coverage(recs: DataFrame, items: DataFrame, k: int) -> DataFrame:
    """Different recommended items over the number of item rows."""
    seen = recs.where(F.col("rank") <= k).agg(F.countDistinct("item_id").alias("c"))
    return seen.join(items.agg(F.count(F.lit(1)).alias("n"))).select((F.col("c") / F.greatest("n", F.lit(1))).alias("coverage"))


def interaction_share(recs: DataFrame, ix: DataFrame, k: int) -> DataFrame:
    """The share of recommended rows whose user has any interaction with the item, positive or not."""
    had = ix.select("user_id", "item_id").where("user_id is not null and item_id is not null").distinct()
    return hits(recs, had, k).agg(F.coalesce(F.avg("hit"), F.lit(0.0)).alias("share"))


def evaluate(recs: DataFrame, truth: DataFrame, items: DataFrame, k: int) -> DataFrame:
    """One row: five metrics, the mean over all users with truth, and their number; zeros without any."""
    m = user_metrics(recs, truth, k).agg(*[F.coalesce(F.avg(x), F.lit(0.0)).alias(x) for x in ("precision", "recall", "map", "ndcg")], F.count(F.lit(1)).alias("n_eval_users"))
    of_users = recs.join(truth.select("user_id").distinct(), "user_id", "left_semi")
    return m.join(coverage(of_users, items, k)).select("precision", "recall", "map", "ndcg", "coverage", "n_eval_users")
