"""Profiling of interaction logs: nulls, weekly rates, per-user distributions, distinct counts exact and sketched."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tastemill.functions.feedback import positive_flag


def null_profile(df: DataFrame, columns: list[str]) -> DataFrame:
    """column_name, null_fraction; one pass for all columns."""
    row = df.agg(F.count(F.lit(1)).alias("n"), *[F.count_if(F.col(c).isNull()).alias(c) for c in columns])
    n = F.greatest("n", F.lit(1))
    pairs = F.array(*[F.struct(F.lit(c).alias("column_name"), (F.col(c) / n).alias("null_fraction")) for c in columns])
    return row.select(F.inline(pairs))


def weekly_profile(ix: DataFrame) -> DataFrame:
    return ix.groupBy(F.col("week").cast("long").alias("week")).agg(
        F.count(F.lit(1)).alias("rows"), F.count_if(positive_flag()).alias("positives"), (F.count_if(positive_flag()) / F.count(F.lit(1))).alias("positive_rate"),
        F.countDistinct("user_id").alias("users"), F.countDistinct("item_id").alias("items"),
    )


def profile_rollup(ix: DataFrame) -> DataFrame:
    """Each week and, with a null week, all."""
    rows = ix.select(F.col("week").cast("long").alias("week"), positive_flag().alias("p"))
    return rows.rollup("week").agg(F.count(F.lit(1)).alias("rows"), F.count_if("p").alias("positives"), (F.count_if("p") / F.count(F.lit(1))).alias("positive_rate"))


def rows_per_user(df: DataFrame) -> DataFrame:
    return df.groupBy("user_id").agg(F.count(F.lit(1)).alias("n"))


def distribution(counts: DataFrame, by: list[str] | None = None) -> DataFrame:
    """users, rows, min, p25, median, mean, p75, max of n, percentiles linearly interpolated; zeros without users."""
    p = lambda q: F.coalesce(F.expr(f"percentile(n, {q})"), F.lit(0.0))
    zero = lambda c: F.coalesce(c, F.lit(0)).cast("long")
    return counts.groupBy(*(by or [])).agg(
        F.count("n").alias("users"), zero(F.sum("n")).alias("rows"), zero(F.min("n")).alias("min"), p(0.25).alias("p25"), p(0.5).alias("median"),
        F.coalesce(F.avg("n"), F.lit(0.0)).alias("mean"), p(0.75).alias("p75"), zero(F.max("n")).alias("max"),
    )


STATS = ("users", "rows", "min", "p25", "median", "mean", "p75", "max")


def average_of_weeks(ix: DataFrame, weeks: int) -> DataFrame:
    """The mean over weeks of each week's statistics; weeks without rows count with zeros."""
    per = distribution(ix.groupBy("week", "user_id").agg(F.count(F.lit(1)).alias("n")), ["week"])
    return per.agg(*[(F.coalesce(F.sum(c), F.lit(0)) / F.lit(float(weeks))).alias(c) for c in STATS])


def user_quantiles(df: DataFrame, quantiles: tuple[float, ...] = (0.01, 0.05, 0.25, 0.5, 0.75, 0.95, 0.99)) -> DataFrame:
    """q, interactions, positives, positive_ratio: quantiles over users."""
    per = df.groupBy("user_id").agg(F.count(F.lit(1)).alias("n"), F.count_if(positive_or_flag(df)).alias("p"))
    per = per.withColumn("r", F.col("p") / F.col("n"))
    q = ", ".join(map(str, quantiles))
    row = per.agg(*[F.expr(f"percentile({c}, array({q}))").alias(c) for c in ("n", "p", "r")])
    zipped = F.arrays_zip(F.array(*[F.lit(float(x)) for x in quantiles]).alias("q"), "n", "p", "r")
    return row.select(F.inline(zipped)).toDF("q", "interactions", "positives", "positive_ratio")


def positive_or_flag(df: DataFrame):
    """Positives of tables that have only some of the columns; without a time spent, those whose score is high."""
    have = [F.coalesce(F.col(f), F.lit(False)) for f in ("like", "share", "bookmark", "click_on_author", "open_comments") if f in df.columns]
    known = F.col("timespent") > 30 if "timespent" in df.columns else F.col("score") >= 2 if "score" in df.columns else F.lit(False)
    out = F.coalesce(known, F.lit(False))
    for f in have:
        out = out | f
    return out


def count_distinct_items(ix: DataFrame, embeddings: DataFrame) -> DataFrame:
    """In the log a null counts as one more value; among the vectors it does not."""
    a = ix.agg((F.countDistinct("item_id") + F.coalesce(F.max(F.when(F.col("item_id").isNull(), 1)), F.lit(0))).alias("in_interactions"))
    return a.join(embeddings.agg(F.countDistinct("item_id").alias("in_embeddings")))


def embedding_duplicates(df: DataFrame, key: str) -> DataFrame:
    return df.agg(F.count(F.lit(1)).alias("rows"), F.countDistinct(key).alias("unique_ids"), (F.count(F.lit(1)) - F.countDistinct(key)).alias("duplicates"))


def nan_fraction(df: DataFrame, column: str = "embedding") -> DataFrame:
    """Share of NaN elements of all vectors."""
    nan, n = F.size(F.filter(column, lambda x: F.isnan(x))), F.size(column)
    sums = df.where(F.col(column).isNotNull()).agg(F.sum(nan).alias("nan"), F.sum(n).alias("n"))
    return sums.select(F.coalesce(F.col("nan") / F.nullif("n", F.lit(0)), F.lit(0.0)).alias("nan_fraction"))


def per_file(ix: DataFrame, file: str) -> DataFrame:
    """file, rows, positives, positive_rate of each value of a column that names the file."""
    rows = ix.select(F.col(file).alias("file"), positive_or_flag(ix).alias("p"))
    return rows.groupBy("file").agg(F.count(F.lit(1)).alias("rows"), F.count_if("p").alias("positives"), (F.count_if("p") / F.count(F.lit(1))).alias("positive_rate"))


def over_files(files: DataFrame) -> DataFrame:
    """files, total rows and positives, and minimum, median and maximum of the files' rows and rates; zeros without files."""
    zero = lambda c: F.coalesce(c, F.lit(0.0))
    spread = [zero(f(c)).alias(f"{c}_{n}") for c in ("rows", "positive_rate") for n, f in (("min", F.min), ("median", F.median), ("max", F.max))]
    whole = [F.coalesce(F.sum(c), F.lit(0)).alias(c) for c in ("rows", "positives")]
    return files.agg(F.count(F.lit(1)).alias("files"), *whole, *spread)


def report(ix: DataFrame, file: str, items: DataFrame | None = None) -> dict:
    """The whole profile as plain values: files, users, distinct counts, nulls, and, with items, their duplicates and NaNs."""
    files = per_file(ix, file).orderBy("file").collect()  # one row a file
    plain = [c for c in ix.columns if c != file]
    out = {
        "files": [r.asDict() for r in files],
        "totals": over_files(per_file(ix, file)).first().asDict(),
        "rows_per_user": distribution(rows_per_user(ix.where("user_id is not null"))).first().asDict(),
        "user_quantiles": [r.asDict() for r in user_quantiles(ix.where("user_id is not null")).collect()],
        "approximate_distinct": approximate_distinct(ix, ["user_id", "item_id"]).first().asDict(),
        "null_fractions": {r["column_name"]: r["null_fraction"] for r in null_profile(ix, plain).collect()},
    }
    if items is not None:
        out["items"] = embedding_duplicates(items, "item_id").first().asDict()
        if "embedding" in items.columns:
            out["items"] |= nan_fraction(items).first().asDict() | count_distinct_items(ix, items.where("embedding is not null")).first().asDict()
    return out


def approximate_distinct(df: DataFrame, columns: list[str], precision: int = 14) -> DataFrame:
    """HyperLogLog sketches, mergeable over files and days."""
    return df.agg(*[F.hll_sketch_estimate(F.hll_sketch_agg(c, F.lit(precision))).alias(c) for c in columns])
