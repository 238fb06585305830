"""Feedback flags to scores, weights and classes, as columns.

Flags that are null count as false. The thresholds are fixed values of the data model."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column
from pyspark.sql import functions as F

POSITIVE_FLAGS = ("like", "share", "bookmark", "click_on_author", "open_comments")
ENGAGEMENT_FLAGS = ("share", "bookmark", "click_on_author", "open_comments")
SCORE_WEIGHTS = {0: -0.05, 1: 1.0, 2: 2.0, 3: 3.0}


def is_positive(seconds: int = 30) -> Column:
    """For filters: a plain OR chain, which reaches the Parquet reader. A null result drops the row, as false does."""
    return reduce(lambda a, b: a | b, [F.col(f) for f in POSITIVE_FLAGS]) | (F.col("timespent") > seconds)


def positive_flag(seconds: int = 30) -> Column:
    """For output: never null."""
    return F.coalesce(is_positive(seconds), F.lit(False))


def feedback_score() -> Column:
    """0 to 2 from the time spent, at least 1 with engagement, 2 with a like, 0 with a dislike whatever else."""
    by_time = F.least(F.greatest(F.floor(F.coalesce("timespent", F.lit(0)) / 40), F.lit(0)), F.lit(2)).cast("int")
    engaged = reduce(lambda a, b: a | b, [F.coalesce(F.col(f), F.lit(False)) for f in ENGAGEMENT_FLAGS])
    raised = F.when(F.coalesce("like", F.lit(False)), 2).when(engaged, F.greatest(by_time, F.lit(1))).otherwise(by_time)
    return F.when(F.coalesce("dislike", F.lit(False)), 0).otherwise(raised).cast("int")


def score_of(columns: list[str]) -> Column:
    """The table's own score if it has one (legacy tables), else the score of its flags."""
    return F.col("score").cast("int") if "score" in columns else feedback_score()


def score_weight(score: Column, weights: dict[int, float] | None = None) -> Column:
    """Weight of a score; scores are cut to the table's range, gaps weigh 0, negative keys are ignored."""
    table = {int(k): float(v) for k, v in (weights or SCORE_WEIGHTS).items() if int(k) >= 0}
    dense = [table.get(i, 0.0) for i in range(max(table, default=0) + 1)]
    at = F.least(F.greatest(score, F.lit(0)), F.lit(len(dense) - 1))
    return F.element_at(F.array(*[F.lit(w) for w in dense]), at + 1)


def signal_class() -> Column:
    """strong_negative (dislike) before positive before weak_negative (no time spent) before neutral."""
    return F.when(F.coalesce("dislike", F.lit(False)), "strong_negative").when(positive_flag(), "positive").when(F.col("timespent") < 1, "weak_negative").otherwise("neutral")


def event_class(score: Column) -> Column:
    return F.when(score >= 2, "positive").when(score == 1, "neutral").otherwise("negative")
