"""The registered queries: each composes operators over the derived tables, whole."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tastemill.functions import feedback, filters, vectors
from tastemill.operators import ema, graph, holdout, kmeans, metrics, popularity, profile, retrieval, towers
from tastemill.plans import cores, synthetic
from tastemill.sources import tables as T

K, SEED, BATCH, DIM = 20, 42, 1000, T.DIM


def _round(df: DataFrame, *columns: str) -> DataFrame:
    return df.withColumns({c: F.round(c, 6) for c in columns})


def positive_filter(s, d):
    return T.interactions(s, d).where(feedback.is_positive()).select("ord", "user_id", "item_id")


def feedback_score(s, d):
    return T.interactions(s, d).select("ord", feedback.feedback_score().cast("long").alias("score"))


def signal_class(s, d):
    return T.interactions(s, d).groupBy(feedback.signal_class().alias("signal")).agg(F.count(F.lit(1)).alias("n"))


def event_class(s, d):
    score = T.interactions(s, d).select(feedback.feedback_score().cast("long").alias("score"))
    return score.groupBy("score").agg(F.count(F.lit(1)).alias("n")).select("score", feedback.event_class(F.col("score")).alias("event_class"), "n")


def holdout_pairs(s, d):
    return holdout.holdout_pairs(T.holdout(s, d))


def holdout_sets(s, d):
    return holdout.holdout_sets(T.holdout(s, d)).select(
        "user_id", F.size("items").cast("long").alias("n_items"), F.array_min("items").alias("first_item"), F.array_max("items").alias("last_item")
    )


def holdout_stats(s, d):
    return _round(holdout.holdout_stats(T.holdout(s, d)), "mean", "median")


def holdout_last_positive(s, d):
    return holdout.last_positive(T.train(s, d))


def distinct_users(s, d):
    return T.interactions(s, d).select("user_id").distinct()


def eval_user_cap(s, d):
    return holdout.capped_users(holdout.holdout_pairs(T.holdout(s, d)), 50)


def popular_by_rank(s, d):
    return popularity.by_rank(T.items(s, d))


def popular_by_score(s, d):
    return popularity.by_score(T.train(s, d)).select("item_id", "n")


def popular_by_impressions(s, d):
    return popularity.by_impressions(T.interactions_big(s, d))


def _popular(s, d):
    return popularity.top_items(popularity.by_score(T.train(s, d)), K)


def _popular_for_holdout(s, d):
    return popularity.for_every_user(holdout.holdout_pairs(T.holdout(s, d)).select("user_id").distinct(), _popular(s, d))


def recommend_popular(s, d):
    return _round(popularity.for_every_user(T.users(s, d), _popular(s, d)), "score")


def recommend_random(s, d):
    return _round(popularity.random_items(T.table(s, d, "customer").select(F.col("c_custkey").alias("user_id")), T.items(s, d), K, SEED), "score")


def hits_at_k(s, d):
    return metrics.hits(_popular_for_holdout(s, d), holdout.holdout_pairs(T.holdout(s, d)), K)


def _popular_metrics(s, d):
    return metrics.user_metrics(_popular_for_holdout(s, d), holdout.holdout_pairs(T.holdout(s, d)), K)


def precision_recall_at_k(s, d):
    return _round(_popular_metrics(s, d).select("user_id", "precision", "recall"), "precision", "recall")


def map_at_k(s, d):
    return _popular_metrics(s, d).select("user_id", F.round("map", 6).alias("value"))


def ndcg_at_k(s, d):
    return _popular_metrics(s, d).select("user_id", F.round("ndcg", 6).alias("value"))


def coverage_at_k(s, d):
    return _round(metrics.coverage(_popular_for_holdout(s, d), T.table(s, d, "part"), K), "coverage")


METRICS = ("precision", "recall", "map", "ndcg", "coverage")


def evaluate_popular(s, d):
    out = metrics.evaluate(_popular_for_holdout(s, d), holdout.holdout_pairs(T.holdout(s, d)), T.table(s, d, "part"), K)
    return _round(out, *METRICS)


def vector_norms(s, d):
    return T.item_embeddings(s, d).select("item_id", F.round(vectors.norm(F.col("embedding")), 6).alias("norm"))


def cosine_pairs(s, d):
    """Each vector and the one with the next id."""
    e = T.item_embeddings(s, d)
    b = e.select((F.col("item_id") - 1).alias("a"), F.col("item_id").alias("b"), F.col("embedding").alias("v"))
    return e.withColumnRenamed("item_id", "a").join(b, "a").select("a", "b", F.round(vectors.cosine(F.col("embedding"), F.col("v")), 6).alias("cosine"))


def embedding_duplicates(s, d):
    return profile.embedding_duplicates(T.table(s, d, "embeddings"), "vec_id")


def interactions_with_embedding(s, d):
    ids = T.item_embeddings(s, d).select("item_id", F.lit(1).alias("m"))
    j = T.interactions_big(s, d).select("item_id").join(ids, "item_id", "left")
    return j.agg(F.count("m").alias("n_matched"), (F.count(F.lit(1)) - F.count("m")).alias("n_unmatched"))


def _subset(s, d, items):
    return popularity.item_subset(items, 200, SEED)


def item_subset(s, d):
    parts = T.table(s, d, "part").select(F.col("p_partkey").alias("item_id"))
    chosen = popularity.item_subset(parts, 200, SEED)
    return parts if chosen is None else chosen


def _retrieve(mode):
    def run(s, d):
        items = T.item_embeddings(s, d)
        subset = _subset(s, d, items) if mode.endswith("_subset") else None
        return _round(retrieval.retrieve(mode, items.withColumnRenamed("item_id", "user_id"), items, K, subset), "score")

    run.__doc__ = f"Top-k of every vector among all (or a subset of) vectors, mode {mode}."
    return run


def user_batch_profile(s, d):
    return vectors.long_form(ema.batch_profiles(T.train(s, d), T.item_embeddings(s, d), DIM, BATCH), ["user_id", "batch"])


def _ema(s, d):
    return ema.ema_vectors(T.train(s, d), T.item_embeddings(s, d), DIM, batch_size=BATCH)


def ema_user_embedding(s, d):
    return vectors.long_form(_ema(s, d), ["user_id"])


def ema_incremental(s, d):
    new = ema.fold(ema.batch_profiles(T.holdout(s, d), T.item_embeddings(s, d), DIM, BATCH), DIM)
    return vectors.long_form(ema.update(_ema(s, d), new), ["user_id"])


def _recommend_ema(s, d):
    return retrieval.top_k(_ema(s, d), T.item_embeddings(s, d), K)


def recommend_ema(s, d):
    return _round(_recommend_ema(s, d), "score")


def evaluate_ema(s, d):
    return _round(metrics.evaluate(_recommend_ema(s, d), holdout.holdout_pairs(T.holdout(s, d)), T.item_embeddings(s, d), K), *METRICS)


def user_tower(s, d):
    return vectors.long_form(towers.user_tower(T.users(s, d), DIM), ["user_id"])


def _item_tower(s, d):
    return towers.item_tower(T.items(s, d), T.item_embeddings(s, d), DIM)


def item_tower(s, d):
    return vectors.long_form(_item_tower(s, d), ["item_id"])


def recommend_two_tower(s, d):
    return _round(retrieval.top_k(towers.user_tower(T.users(s, d), DIM), _item_tower(s, d), K), "score")


def _centers(s, d):
    return kmeans.fit_centers(T.train(s, d), T.item_embeddings(s, d), 4, DIM, 0.05, SEED)


def kmeans_centers(s, d):
    rows = _centers(s, d).select("user_id", F.posexplode("centers").alias("center", "embedding"))
    return vectors.long_form(rows.withColumn("center", F.col("center").cast("long")), ["user_id", "center"])


def kmeans_export_mean(s, d):
    return vectors.long_form(kmeans.mean_center(_centers(s, d), DIM), ["user_id"])


def recommend_kmeans(s, d):
    return _round(kmeans.recommend(_centers(s, d), T.item_embeddings(s, d), K), "score")


def lightgcn_degree(s, d):
    return graph.degrees(T.train(s, d))


def lightgcn_propagate(s, d):
    return vectors.long_form(graph.propagate(holdout.holdout_pairs(T.train(s, d)), T.item_embeddings(s, d), "user_id", "item_id", DIM), ["user_id"])


def negative_candidates(s, d):
    tr = T.train(s, d)
    items = tr.select("item_id").distinct()
    return popularity.negatives(tr.select("user_id").distinct(), items, tr, K, SEED)


def user_sequences(s, d):
    q = holdout.user_sequences(T.train(s, d))
    return q.select("user_id", F.size("items").cast("long").alias("n"), F.get("items", F.lit(0)).alias("first_item"), F.element_at("items", -1).alias("last_item"), F.md5(F.array_join(F.col("items").cast("array<string>"), ",")).alias("seq_md5"))


def rows_per_user(s, d):
    return profile.rows_per_user(T.interactions_big(s, d))


def user_distribution(s, d):
    return _round(profile.distribution(rows_per_user(s, d)), "p25", "median", "mean", "p75")


def per_week_avg_distribution(s, d):
    return _round(profile.average_of_weeks(T.interactions(s, d), 5), *profile.STATS)


def user_quantiles(s, d):
    return _round(profile.user_quantiles(T.interactions_big(s, d)), "interactions", "positives", "positive_ratio")


def weekly_profile(s, d):
    return _round(profile.weekly_profile(T.interactions(s, d)), "positive_rate")


def profile_rollup(s, d):
    return _round(profile.profile_rollup(T.interactions(s, d)), "positive_rate")


def null_profile(s, d):
    ix = T.interactions(s, d).withColumn("timespent", F.nullif("timespent", F.lit(0)))
    return _round(profile.null_profile(ix, ["user_id", "item_id", "timespent", "like"]), "null_fraction")


def count_distinct_items(s, d):
    return profile.count_distinct_items(T.interactions(s, d), T.item_embeddings(s, d))


def approx_users_items(s, d):
    return profile.approximate_distinct(T.interactions_big(s, d), ["user_id", "item_id"]).toDF("users", "items")


def _filtered(rules, joined):
    return lambda s, d: profile.rows_per_user(filters.apply_filters(T.interactions(s, d), rules, joined))


dsl_filter_or = _filtered(filters.PRESET, "or")
dsl_filter_and = _filtered([["timespent", ">", 20], ["like", "==", 0], ["user_id", "is_not_null", None]], "and")
dsl_not_equal = _filtered([["item_id", "!=", 7], ["like", "!=", 1]], "and")
dsl_not_in = _filtered([["item_id", "not_in", [1, 2, 3]]], "and")


def synthetic_interactions(s, d):
    return synthetic.generate(s, n_users=200, n_items=100, dim=32, per_user=20, seed=SEED)["interactions"]


def interaction_share(s, d):
    return _round(metrics.interaction_share(_popular_for_holdout(s, d), T.holdout(s, d), K), "share")


def holdout_sample(s, d):
    return holdout.sample(holdout.holdout_pairs(T.holdout(s, d))).withColumn("items", F.array_join(F.col("items").cast("array<string>"), ","))


def holdout_merged(s, d):
    """Positive pairs of the last training week and the held-out one, read as two slices."""
    return holdout.merged_holdout(T.interactions(s, d).where(F.col("week") == 3), T.holdout(s, d))


def files_profile(s, d):
    rates = ("positive_rate_min", "positive_rate_median", "positive_rate_max")
    return _round(profile.over_files(profile.per_file(T.interactions(s, d), "week")), *rates)


def embedding_nan_fraction(s, d):
    """With every seventh element of every fifth vector made NaN."""
    odd = F.transform("embedding", lambda x, i: F.when((F.col("item_id") % 5 == 0) & (i % 7 == 0), F.lit(float("nan"))).otherwise(x))
    return _round(profile.nan_fraction(T.item_embeddings(s, d).withColumn("embedding", odd)), "nan_fraction")


def affinity_scores(s, d):
    return cosine_pairs(s, d).select("a", "b", synthetic.affinity_score(F.col("cosine") * 3).cast("long").alias("score"))


def batches_of_files(s, d):
    """The event table as two files, one after the other: batches restart with the second one."""
    path = f"{d}/events.parquet"
    rows = T.in_file_order(s, [path, path], BATCH)
    stride = (1 << 40) // BATCH * BATCH
    place = F.expr(f"ord div {stride}").alias("file"), F.expr(f"(ord % {stride}) div {BATCH}").alias("batch")
    return rows.groupBy(*place).agg(F.count(F.lit(1)).alias("n"))


def core_popular(s, d):
    """The core on items with ranks, asked for more items than there are."""
    items = T.items(s, d)
    core = cores.build_core("popular").fit(cores.Dataset(T.users(s, d), items, T.train(s, d)))
    more = T.table(s, d, "part").count() + 1
    rows = core.recommend(holdout.capped_users(holdout.holdout_pairs(T.holdout(s, d)), 3), more)
    return _round(rows, "score")


RETRIEVALS = {f"retrieve_{m}": _retrieve(m) for m in retrieval.MODES}
PLAIN = (
    positive_filter, feedback_score, signal_class, event_class, holdout_pairs, holdout_sets, holdout_stats, holdout_last_positive, distinct_users, eval_user_cap,
    popular_by_rank, popular_by_score, popular_by_impressions, recommend_popular, recommend_random, hits_at_k, precision_recall_at_k, map_at_k, ndcg_at_k,
    coverage_at_k, evaluate_popular, vector_norms, cosine_pairs, embedding_duplicates, interactions_with_embedding, item_subset, user_batch_profile,
    ema_user_embedding, ema_incremental, recommend_ema, evaluate_ema, user_tower, item_tower, recommend_two_tower, kmeans_centers, kmeans_export_mean,
    recommend_kmeans, lightgcn_degree, lightgcn_propagate, negative_candidates, user_sequences, rows_per_user, user_distribution, per_week_avg_distribution,
    user_quantiles, weekly_profile, profile_rollup, null_profile, count_distinct_items, approx_users_items, synthetic_interactions,
    interaction_share, holdout_sample, holdout_merged, files_profile, embedding_nan_fraction, affinity_scores, batches_of_files, core_popular,
)
QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {f.__name__: f for f in PLAIN} | RETRIEVALS | {"dsl_filter_or": dsl_filter_or, "dsl_filter_and": dsl_filter_and, "dsl_not_in": dsl_not_in, "dsl_not_equal": dsl_not_equal}
