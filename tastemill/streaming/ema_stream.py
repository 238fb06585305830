"""User vectors kept up to date from a stream of interaction files.

Each micro-batch is folded by itself and joined to the state as one more affine map. States are versioned by
batch id: batch n reads the newest version below n and writes version n, so a batch that runs again after a
failure overwrites its own version and counts once. The newest three versions stay."""

from __future__ import annotations

import logging
import re

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql.streaming import StreamingQuery, StreamingQueryListener

from tastemill.operators import ema, kmeans


def _versions(spark: SparkSession, folder: str) -> list[int]:
    jvm = spark.sparkContext._jvm
    path = jvm.org.apache.hadoop.fs.Path(folder)
    files = path.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())
    if not files.exists(path):
        return []
    names = [s.getPath().getName() for s in files.listStatus(path) if files.exists(jvm.org.apache.hadoop.fs.Path(s.getPath(), "_SUCCESS"))]
    return sorted(int(m[1]) for n in names if (m := re.fullmatch(r"version=(\d+)", n)))


def latest(spark: SparkSession, folder: str, below: int | None = None) -> DataFrame | None:
    own = [v for v in _versions(spark, folder) if below is None or v < below]
    return spark.read.parquet(f"{folder}/version={own[-1]}") if own else None


class Progress(StreamingQueryListener):
    """Logs each batch's rows and rate. `spark.streams.addListener(Progress())`."""

    def __init__(self, say=logging.getLogger("tastemill.streaming").info):
        self.say = say

    def onQueryStarted(self, event) -> None:
        self.say("stream %s began", event.id)

    def onQueryProgress(self, event) -> None:
        p = event.progress
        self.say("stream %s, batch %s: %s rows, %.1f a second", p.id, p.batchId, p.numInputRows, p.processedRowsPerSecond)

    def onQueryIdle(self, event) -> None:
        pass

    def onQueryTerminated(self, event) -> None:
        self.say("stream %s ended%s", event.id, f": {event.exception}" if event.exception else "")


def _drop_before(spark: SparkSession, folder: str, version: int) -> None:
    path = spark.sparkContext._jvm.org.apache.hadoop.fs.Path
    files = path(folder).getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())
    for old in _versions(spark, folder):
        if old < version:
            files.delete(path(f"{folder}/version={old}"), True)


def _run(stream: DataFrame, step, folder: str, checkpoint: str, kept: int = 3) -> StreamingQuery:
    def batch(df: DataFrame, n: int) -> None:
        state = step(df, latest(df.sparkSession, folder, n))
        state.write.mode("overwrite").parquet(f"{folder}/version={n}")
        _drop_before(df.sparkSession, folder, n - kept + 1)

    return stream.writeStream.foreachBatch(batch).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()


def stream_ema(stream: DataFrame, items: DataFrame, folder: str, checkpoint: str, dim: int, alpha: float = 0.95, batch_size: int = 250_000) -> StreamingQuery:
    """State: user_id, embedding."""

    def step(df: DataFrame, old: DataFrame | None) -> DataFrame:
        new = ema.fold(ema.batch_profiles(df, items, dim, batch_size), dim, alpha)
        return new.select("user_id", "embedding") if old is None else ema.update(old, new, alpha)

    return _run(stream, step, folder, checkpoint)


def stream_kmeans(stream: DataFrame, items: DataFrame, folder: str, checkpoint: str, k: int = 4, dim: int = 64, drift: float = 0.05, seed: int = 42) -> StreamingQuery:
    """State: user_id, centers."""
    return _run(stream, lambda df, old: kmeans.fit_centers(df, items, k, dim, drift, seed, old), folder, checkpoint)


def interaction_stream(spark: SparkSession, folder: str, schema, files_per_batch: int = 1) -> DataFrame:
    """A stream of Parquet files, the oldest first."""
    return spark.readStream.schema(schema).option("maxFilesPerTrigger", files_per_batch).parquet(folder)
