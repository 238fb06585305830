"""Popularity and random baselines."""

from __future__ import annotations

import math

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from tastemill.functions.feedback import score_of
from tastemill.sources.tables import numbered

LISTED = 10_000  # items that travel as one row


def by_score(ix: DataFrame, least: int = 2) -> DataFrame:
    """Items by number of rows whose score is high; `first` is where the item occurs first, for ties."""
    rows = ix.withColumn("s", score_of(ix.columns)).where(F.col("s") >= least)
    first = F.min("week") if "week" in ix.columns else F.lit(0)
    return rows.groupBy("item_id").agg(F.count(F.lit(1)).alias("n"), first.alias("first"))


def by_impressions(ix: DataFrame) -> DataFrame:
    return ix.groupBy("item_id").agg(F.count(F.lit(1)).alias("n"))


def by_rank(items: DataFrame) -> DataFrame:
    """Items by their rank column, then id."""
    return items.select(F.col("train_interactions_rank").alias("rank"), "item_id").orderBy("rank", "item_id")


def top_items(counts: DataFrame, k: int) -> DataFrame:
    """rank, item_id, score of the k most frequent: earlier first occurrence and smaller id win ties. The score falls evenly from 1 to 0.1."""
    order = [F.desc("n"), *(["first"] if "first" in counts.columns else []), "item_id"]
    best = counts.orderBy(*order).limit(max(k, 0))  # k rows from here on
    n = F.count(F.lit(1)).over(Window.partitionBy())
    ranked = best.withColumn("rank", F.row_number().over(Window.orderBy(*order)).cast("long"))
    step = F.when(n > 1, F.lit(0.9) * (F.col("rank") - 1) / (n - 1)).otherwise(F.lit(0.0))
    return ranked.select("rank", "item_id", (F.lit(1.0) - step).alias("score"))


def for_every_user(users: DataFrame, best: DataFrame) -> DataFrame:
    """The same k rows for each user: the list of k travels as one constant row."""
    one = best.agg(F.array_sort(F.collect_list(F.struct("rank", "item_id", "score"))).alias("best"))
    rows = users.select("user_id").join(F.broadcast(one)).select("user_id", F.explode("best").alias("b"))
    return rows.select("user_id", "b.rank", "b.item_id", "b.score")


def popular_for_users(users: DataFrame, counts: DataFrame, k: int) -> DataFrame:
    """What for_every_user and top_items give together, for any k: beyond a short list the places are numbered by groups and ranges,
    and the ranked items stay rows, so neither a task nor the driver holds them all."""
    if k <= LISTED:
        return for_every_user(users, top_items(counts, k))
    tie = [F.col("first")] if "first" in counts.columns else []
    places = numbered(counts, F.struct(F.col("n").isNull(), -F.col("n"), *tie), "item_id", "rank")
    n = F.least(F.col("total"), F.lit(k))
    step = F.when(n > 1, F.lit(0.9) * (F.col("rank") - 1) / (n - 1)).otherwise(F.lit(0.0))
    ranked = places.where(F.col("rank") <= k).join(F.broadcast(counts.agg(F.count(F.lit(1)).alias("total")))).select("rank", "item_id", (F.lit(1.0) - step).alias("score"))
    return users.select("user_id").crossJoin(ranked)


def numbered_items(items: DataFrame) -> DataFrame:
    """item_id and its number from 0 in ascending id."""
    return numbered(items.select("item_id"), F.lit(0), "item_id", "place").select("item_id", (F.col("place") - 1).alias("number"))


def draw_number(user: str, draw: str, n: int, seed: int | str):
    return F.conv(F.substring(F.md5(F.concat_ws(":", F.lit(str(seed)), F.col(user), F.col(draw))), 1, 8), 16, 10).cast("long") % n


def first_draws(users: DataFrame, n: int, draws: int, seed: int) -> DataFrame:
    """user_id, number, draw: the different numbers below n that so many hash draws give a user, and where each came first."""
    drawn = users.select("user_id", F.explode(F.sequence(F.lit(0), F.lit(draws - 1))).alias("draw")).withColumn("number", draw_number("user_id", "draw", n, seed))
    return drawn.groupBy("user_id", "number").agg(F.min("draw").cast("long").alias("draw"))


def shuffled_numbers(users: DataFrame, n: int, seed: int) -> DataFrame:
    """users (user_id, size): user_id, number, position of at least min(size, n) different numbers below n, in an order of each user's own.

    The order is a Feistel permutation of a grid of a * b >= n cells; fewer than b of its positions fall outside and are passed over."""
    b = math.isqrt(n - 1) + 1
    a = -(-n // b)
    last = F.least(F.col("size") + (a * b - n), F.lit(a * b)) - 1
    cells = users.select("user_id", F.explode(F.sequence(F.lit(0).cast("long"), last.cast("long"))).alias("position"))
    cells = cells.withColumns({"x": F.expr(f"position div {b}"), "y": F.col("position") % b})
    for turn in range(3):
        for to, frm, size in (("x", "y", a), ("y", "x", b)):
            cells = cells.withColumn(to, (F.col(to) + draw_number("user_id", frm, size, f"{seed}:{turn}{to}")) % size)
    return cells.select("user_id", (F.col("x") * b + F.col("y")).alias("number"), "position").where(F.col("number") < n)


def random_items(users: DataFrame, items: DataFrame, k: int, seed: int = 42, draws: int = 8) -> DataFrame:
    """min(k, n) different ones of n items for each user: hash-seeded draws, repeated ones left out; the order of drawing is the rank.

    Users whose draws * k draws do not hold enough different items go on in a random order of all items."""
    numbers = numbered_items(items)
    n = numbers.count()
    few = min(k, n)
    if few <= 0:
        return users.select("user_id", F.lit(0).cast("long").alias("rank"), F.lit(0).cast("long").alias("item_id"), F.lit(0.0).alias("score")).limit(0)
    first = first_draws(users, n, draws * k, seed)
    short = first.groupBy("user_id").agg(F.count(F.lit(1)).alias("found")).where(F.col("found") < few).select("user_id", F.lit(few).cast("long").alias("size"))
    more = shuffled_numbers(short, n, seed).select("user_id", "number", (F.col("position") + draws * k).alias("draw"))
    found = first.unionByName(more).groupBy("user_id", "number").agg(F.min("draw").alias("draw"))
    rank = F.row_number().over(Window.partitionBy("user_id").orderBy("draw"))
    ranked = found.withColumn("rank", rank.cast("long")).where(F.col("rank") <= k)
    return ranked.join(numbers, "number").select("user_id", "rank", "item_id", F.lit(1.0 / few).alias("score"))


def negatives(users: DataFrame, items: DataFrame, seen: DataFrame, k: int, seed: int = 42, draws: int = 8) -> DataFrame:
    """min(k, unseen) different random items for each user, none of them seen by the user.

    Seen items are left out before the cut to k. Users whose draws * k draws do not hold enough unseen items go on in a random
    order of all items: its first seen + k places hold k unseen ones, or all there are. So the rows made are at most draws * k
    and, for users who are short, seen + k and the root of the number of items."""
    numbers = numbered_items(items)
    n = numbers.count()
    if n == 0 or k <= 0:
        return users.select("user_id", F.lit(0).cast("long").alias("item_id")).limit(0)
    known = seen.select("user_id", "item_id").where("user_id is not null").distinct().join(numbers, "item_id").select("user_id", "number")
    fresh = first_draws(users, n, draws * k, seed).join(known, ["user_id", "number"], "left_anti")
    tally = lambda df, own, old, new: df.select("user_id", F.lit(own).alias("own"), F.lit(old).alias("old"), F.lit(new).alias("new"))
    counts = tally(users, 1, 0, 0).unionByName(tally(known, 0, 1, 0)).unionByName(tally(fresh, 0, 0, 1)).groupBy("user_id").agg(F.max("own").alias("own"), F.sum("old").alias("old"), F.sum("new").alias("new"))
    short = counts.where((F.col("own") == 1) & (F.col("new") < F.least(F.lit(k), n - F.col("old")))).select("user_id", (F.col("old") + k).alias("size"))
    more = shuffled_numbers(short, n, seed).select("user_id", "number", (F.col("position") + draws * k).alias("draw")).join(known, ["user_id", "number"], "left_anti")
    unseen = fresh.unionByName(more).groupBy("user_id", "number").agg(F.min("draw").alias("draw"))
    rank = F.row_number().over(Window.partitionBy("user_id").orderBy("draw"))
    return unseen.withColumn("rank", rank).where(F.col("rank") <= k).join(numbers, "number").select("user_id", "item_id")


def item_subset(items: DataFrame, size: int | None, seed: int = 42) -> DataFrame | None:
    """One seeded subset without replacement for all users of a request; None (all items) if no smaller size is asked."""
    if not size or size <= 0 or size >= items.count():
        return None
    key = F.md5(F.concat_ws(":", F.lit(str(seed)), F.col("item_id")))
    return items.select("item_id").orderBy(key, "item_id").limit(size)
