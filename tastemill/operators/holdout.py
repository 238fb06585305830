"""Truth sets for evaluation: the positive items of each user in a held-out slice."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from tastemill.functions.feedback import feedback_score, is_positive


def holdout_pairs(ix: DataFrame) -> DataFrame:
    """Distinct (user_id, item_id) of positives; rows without ids are left out."""
    rows = ix.where(is_positive()).where("user_id is not null and item_id is not null")
    return rows.select("user_id", "item_id").distinct()


def holdout_sets(ix: DataFrame) -> DataFrame:
    """Sorted distinct positive items of each user, as an array."""
    return ix.where(is_positive()).groupBy("user_id").agg(F.array_sort(F.collect_set("item_id")).alias("items"))


def merged_holdout(*slices: DataFrame) -> DataFrame:
    """Distinct positive pairs of several slices, whatever further columns each has."""
    flags = ("like", "share", "bookmark", "click_on_author", "open_comments")
    return holdout_pairs(reduce(DataFrame.unionByName, [x.select("user_id", "item_id", "timespent", *flags) for x in slices]))


def holdout_stats(ix: DataFrame) -> DataFrame:
    """Over all interactions: rows, users, users with several rows, and unique items per user."""
    per = ix.groupBy("user_id").agg(F.count(F.lit(1)).alias("n"), F.countDistinct("item_id").alias("items"))
    return per.agg(
        F.sum("n").alias("rows"), F.count(F.lit(1)).alias("users"), F.count_if(F.col("n") > 1).alias("multi_row_users"),
        F.min("items").alias("min"), F.max("items").alias("max"), F.avg("items").alias("mean"), F.expr("percentile(items, 0.5)").alias("median"),
    )


def last_positive(ix: DataFrame, least_score: int = 2) -> DataFrame:
    """The other policy: each user's latest item with a high score. A max of structs: partial sums, no sorting of users."""
    rows = ix.withColumn("score", feedback_score()).where(F.col("score") >= least_score)
    return rows.groupBy("user_id").agg(F.max_by("item_id", F.struct("ts", "ord")).alias("item_id"))


def capped_users(pairs: DataFrame, most: int) -> DataFrame:
    """The first users in ascending id."""
    return pairs.select("user_id").distinct().orderBy("user_id").limit(most)


def user_sequences(ix: DataFrame) -> DataFrame:
    """Items of each user in order of time, for sequence models."""
    seq = F.array_sort(F.collect_list(F.struct("ord", "item_id")))
    return ix.groupBy("user_id").agg(F.transform(seq, lambda x: x["item_id"]).alias("items"))


def sample(pairs: DataFrame, users: int = 3, items: int = 8) -> DataFrame:
    """user_id, n_items, items: the first users in ascending id with the first of their sorted items."""
    own = pairs.join(F.broadcast(capped_users(pairs, users)), "user_id", "left_semi")  # so many users
    sets = own.groupBy("user_id").agg(F.array_sort(F.collect_set("item_id")).alias("items"))
    return sets.select("user_id", F.size("items").cast("long").alias("n_items"), F.slice("items", 1, items).alias("items"))
