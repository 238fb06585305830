"""What the operators of this subpackage have in common: written intermediate tables, caches, word rules."""

from __future__ import annotations

import ctypes
import os
import uuid
from collections.abc import Callable, Iterator
from contextlib import contextmanager
from pathlib import Path

import pyarrow as pa
import pyarrow.parquet
from pyarrow import fs
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_schema
from pyspark.sql.types import StructType

from tastemill.sources.shared import new_path

#: A word is a maximal run of characters other than ASCII white space. Fixed by the contracts.
WORD = r"[^\x20\x09-\x0D]+"
UPPER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ"
LOWER = "abcdefghijklmnopqrstuvwxyz"
ROW_GROUP = 4 << 20  # bytes that a Python worker writes at a time


def written(df: DataFrame, name: str, files: int | None = None) -> DataFrame:
    """df as a Parquet table in the shared folder, of at most so many files: cuts the lineage, survives the loss of any executor."""
    df = df if files is None else df.coalesce(files)
    path = new_path(df.sparkSession, name)
    df.write.option("compression", "zstd").parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


@contextmanager
def setting(spark: SparkSession, name: str, value: str | int) -> Iterator[None]:
    """A setting of the session for what runs inside; then it is put back."""
    before = spark.conf.get(name, None)
    spark.conf.set(name, value)
    try:
        yield
    finally:
        spark.conf.unset(name) if before is None else spark.conf.set(name, before)


def arrow_rows(spark: SparkSession, rows: int = 250):
    """Python stages that run inside get Arrow batches of so many rows: whole texts in batches of Spark's own
    10,000 rows take hundreds of megabytes on both sides."""
    return setting(spark, "spark.sql.execution.arrow.maxRecordsPerBatch", rows)


def shuffles_removed(spark: SparkSession):
    """The shuffle files of a query that runs inside go when it ends, not when the driver happens to collect its garbage."""
    return setting(spark, "spark.sql.classic.shuffleDependency.fileCleanup.enabled", "true")


class Scratch:
    """A folder in the shared one for the inner tables of one call, which removes them when they are done with."""

    def __init__(self, spark: SparkSession, name: str):
        self.spark, self.path, self.paths = spark, new_path(spark, name), {}

    def written(self, df: DataFrame, name: str, level: int = 3, files: int | None = None) -> DataFrame:
        """Like the function of that name. level: of compression; files: at most so many, for what is known to be small."""
        df = df if files is None else df.coalesce(files)
        path = f"{self.path}/{name}-{uuid.uuid4().hex}"
        df.write.option("compression", "zstd").option("parquet.compression.codec.zstd.level", level).parquet(path)
        out = self.spark.read.schema(df.schema).parquet(path)
        self.paths[id(out)] = out, path
        return out

    def written_by(self, df: DataFrame, run: Callable, schema: str, name: str, level: int = 3) -> DataFrame:
        """df.mapInArrow(run, schema) as a table, each of whose files a task's Python worker writes by itself.

        A file is written under a hidden name and then renamed to that of its partition, so a task that runs again
        leaves one file. Where Arrow does not know the file system, Spark writes."""
        path = f"{self.path}/{name}-{uuid.uuid4().hex}"
        try:
            fs.FileSystem.from_uri(path)
        except (pa.ArrowInvalid, pa.ArrowNotImplementedError, ImportError, OSError):
            return self.written(df.mapInArrow(run, schema), name, level)
        kind = StructType.fromDDL(schema)
        arrow = to_arrow_schema(kind)

        def store(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            files, root = fs.FileSystem.from_uri(path)
            files.create_dir(root, recursive=True)
            hidden, rows = f"{root}/.{uuid.uuid4().hex}", 0
            with pyarrow.parquet.ParquetWriter(hidden, arrow, filesystem=files, compression="zstd", compression_level=level, use_dictionary=False) as out:
                waiting, size = [], 0
                for b in run(batches):
                    waiting.append(b)
                    size += b.nbytes
                    rows += b.num_rows
                    if size >= ROW_GROUP:
                        out.write_table(pa.Table.from_batches(waiting).cast(arrow))
                        waiting, size = [], 0
                if waiting:
                    out.write_table(pa.Table.from_batches(waiting).cast(arrow))
            files.move(hidden, f"{root}/part-{TaskContext.get().partitionId():07d}.parquet")
            waiting = b = None
            give_back()
            yield pa.RecordBatch.from_arrays([pa.array([rows], pa.int64())], ["rows"])

        if not df.mapInArrow(store, "rows long").agg(F.sum("rows")).first()[0]:
            return self.written(small_table(self.spark, [], schema), name)
        out = self.spark.read.schema(kind).parquet(path)
        self.paths[id(out)] = out, path
        return out

    def drop(self, df: DataFrame) -> None:
        """Removes a table that `written` returned."""
        self._delete(self.paths.pop(id(df))[1])

    def remove(self) -> None:
        self._delete(self.path)
        self.paths.clear()

    def _delete(self, path: str) -> None:
        found = self.spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
        found.getFileSystem(self.spark.sparkContext._jsc.hadoopConfiguration()).delete(found, True)


_held: dict[str, Callable[[], None]] = {}
_libc = ctypes.CDLL(None)


def holds(name: str, clear: Callable[[], None] = lambda: None) -> None:
    """Says, in a Python worker, that a stage of this name begins, and how to clear what it keeps for its next tasks.

    Workers serve one stage after the other; what stages of other names have kept goes."""
    others = [k for k in _held if k != name]
    for other in others:
        _held.pop(other)()
    if others:
        give_back()
    _held[name] = clear


def give_back() -> None:
    """Returns to the system the memory that this Python worker has freed but not given back; it waits for its next task with the rest."""
    pa.default_memory_pool().release_unused()
    if hasattr(_libc, "malloc_trim"):
        _libc.malloc_trim(0)


class Cache(dict):
    """What `learn` returned for the latest `most` different texts or more, twice as many at most.

    When it is full, it becomes the older half; what is asked for again moves up, so frequent texts stay.
    Texts longer than `longest` are learnt anew each time."""

    def __init__(self, learn: Callable, most: int, longest: int = 256):
        super().__init__()
        self.learn, self.most, self.longest, self.older = learn, most, longest, {}

    def __missing__(self, text: str):
        found = self.older.get(text)
        if found is None:
            found = self.learn(text)
            if len(text) > self.longest:
                return found
        if len(self) >= self.most:
            self.older = dict(self)
            self.clear()
        self[text] = found
        return found


def small_table(spark: SparkSession, rows: list[tuple], schema: str) -> DataFrame:
    """Rows of the driver as a table. By way of Arrow: rows alone go through Python workers of their own kind, which each
    executor then keeps beside those of the operators."""
    kind = StructType.fromDDL(schema)
    arrow = to_arrow_schema(kind)
    columns = zip(*rows) if rows else [()] * len(arrow)
    return spark.createDataFrame(pa.Table.from_arrays([pa.array(c, f.type) for c, f in zip(columns, arrow)], schema=arrow), kind)


def ensure_importable(spark: SparkSession) -> None:
    """Python workers on this machine find the package even if the driver found it by sys.path alone."""
    root = str(Path(__file__).resolve().parents[2])
    env = spark.sparkContext.environment
    have = env.get("PYTHONPATH", "")
    if root not in have.split(os.pathsep):
        env["PYTHONPATH"] = os.pathsep.join(x for x in (root, have) if x)


def ascii_lower(c: Column) -> Column:
    """A-Z to a-z, every other character as it is."""
    return F.translate(c, UPPER, LOWER)


def word_count(text: Column) -> Column:
    """Words of a text; 0 for null."""
    return F.coalesce(F.regexp_count(text, F.lit(WORD)), F.lit(0)).cast("long")


def pow2_at_least(n: float) -> int:
    return 1 << max(0, int(-(-n // 1)) - 1).bit_length()


def hex_key(c: Column, digits: int = 15) -> Column:
    """The first hexadecimal digits of an MD5 as a long: a key that DuckDB can reproduce."""
    return F.conv(F.substring(F.md5(c), 1, digits), 16, 10).cast("long")
