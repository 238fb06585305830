"""Reading and checking the data model's tables, and deriving it from the star schema and event stream."""

from __future__ import annotations

from dataclasses import dataclass
from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

REQUIRED = {"users": {"user_id"}, "items": {"item_id"}, "legacy": {"user_id", "item_id", "score"}, "interactions": {"user_id", "item_id"}}
DIM = 64
TRAIN_WEEKS, HOLDOUT_WEEK = (0, 3), 4


@dataclass(frozen=True)
class DatasetPaths:
    users: str
    items: str
    interactions: tuple[str, ...]
    embeddings: str | None = None


#: Where the tables lie below a data root. Fixed values of the layout.
USERS, ITEMS, EMBEDDINGS = "metadata/users_metadata.parquet", "metadata/items_metadata.parquet", "metadata/item_embeddings.npz"
TRAIN, VALIDATION = "subsamples/ur0.1/train", "subsamples/ur0.1/validation"
WEEKS, SMALL_WEEKS = 25, 6


def week_layout(root: str, train: int = WEEKS, small: bool = False) -> tuple[list[str], str]:
    """Training files week_00 on and the validation file; the small sample has the first six weeks, the last held out inside them."""
    name = lambda folder, k: f"{root}/{folder}/week_{k:02d}.parquet"
    weeks = [name(TRAIN, k) for k in range(SMALL_WEEKS if small else train)]
    return weeks, weeks[-1] if small else name(VALIDATION, train)


def default_paths(root: str, command: str, small: bool = False) -> DatasetPaths:
    """The files that a command reads: training weeks, or for evaluation the held-out one."""
    weeks, held_out = week_layout(root, small=small)
    return DatasetPaths(f"{root}/{USERS}", f"{root}/{ITEMS}", (held_out,) if command == "evaluate" else tuple(weeks), f"{root}/{EMBEDDINGS}")


def discover(spark: SparkSession, root: str, pattern: str = "week_*.parquet") -> DataFrame:
    """All matching files below root, with week from the file's name and row_index for order."""
    df = spark.read.option("recursiveFileLookup", "true").option("pathGlobFilter", pattern).parquet(root)
    week = F.regexp_extract(F.col("_metadata.file_name"), r"week_(\d+)", 1)
    return df.select("*", F.when(week != "", week).cast("int").alias("week"), F.col("_metadata.row_index").alias("row_index"))


def split_files(spark: SparkSession, root: str, first: int | None = None) -> list[str]:
    """Parquet files of root/train, then of root/validation, each by name; the first so many."""
    jvm, out = spark.sparkContext._jvm, []
    for split in ("train", "validation"):
        path = jvm.org.apache.hadoop.fs.Path(f"{root}/{split}/*.parquet")
        found = path.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).globStatus(path)
        out += sorted(s.getPath().toString() for s in found or ())
    return out[:first]


def in_file_order(spark: SparkSession, paths: list[str], batch_size: int) -> DataFrame:
    """The rows of all paths with ord: files in the order given (those of one folder by name), rows by their place.

    A file's numbers begin at a multiple of batch_size, so batches of ord restart with each file, however it is split."""
    parts = [spark.read.parquet(p).select("*", F.lit(k).alias("given"), F.col("_metadata.file_path").alias("file_path"), F.col("_metadata.row_index").alias("row_index")) for k, p in enumerate(paths)]
    rows = reduce(DataFrame.unionByName, parts)
    files = rows.select("given", "file_path").distinct()  # one row a file
    numbered = files.select("given", "file_path", (F.row_number().over(Window.orderBy("given", "file_path")) - 1).cast("long").alias("file_number"))
    stride = (1 << 40) // batch_size * batch_size
    placed = rows.join(F.broadcast(numbered), ["given", "file_path"]).withColumn("ord", F.col("file_number") * stride + F.col("row_index"))
    return placed.drop("given", "file_path", "file_number", "row_index")


def with_columns_only(spark: SparkSession, paths: list[str], needed: set[str]) -> tuple[list[str], list[str]]:
    """The paths whose tables have the needed columns, and those that are skipped."""
    have = {p: needed <= set(spark.read.parquet(p).columns) for p in paths}
    return [p for p in paths if have[p]], [p for p in paths if not have[p]]


def numbered(df: DataFrame, by: Column, id_col: str, name: str, per_range: int = 10_000) -> DataFrame:
    """df with its place, from 1, in ascending (by, id): groups of equal `by` and ranges of ids are counted, the counts
    summed up, and each group and range numbered by itself. What one task sums up is a row for each of these."""
    keyed = df.withColumns({"by_": by, "range_": F.expr(f"`{id_col}` div {per_range}")})
    counts = keyed.groupBy("by_", "range_").agg(F.count(F.lit(1)).alias("in_range_"))
    before = Window.orderBy("by_", "range_").rowsBetween(Window.unboundedPreceding, -1)
    starts = counts.select("by_", "range_", F.coalesce(F.sum("in_range_").over(before), F.lit(0)).alias("start_"))
    inside = F.row_number().over(Window.partitionBy("by_", "range_").orderBy(id_col))
    starts = starts.withColumnsRenamed({"by_": "own_by_", "range_": "own_range_"})
    placed = keyed.withColumn("inside_", inside).join(starts, F.col("by_").eqNullSafe(F.col("own_by_")) & F.col("range_").eqNullSafe(F.col("own_range_")))
    return placed.withColumn(name, (F.col("start_") + F.col("inside_")).cast("long")).drop("by_", "range_", "own_by_", "own_range_", "inside_", "start_")


def with_long_ids(df: DataFrame) -> DataFrame:
    """uint32 and uint64 ids arrive as bigint and decimal: both to bigint."""
    return df.withColumns({c: F.col(c).cast("long") for c in ("user_id", "item_id", "author_id") if c in df.columns})


def dialect(columns: list[str]) -> str:
    """legacy (has a score) or interactions; an error if neither fits. Names count, types do not."""
    have = set(columns)
    for kind in ("legacy", "interactions"):
        if REQUIRED[kind] <= have:
            return kind
    raise ValueError(f"interactions need {sorted(REQUIRED['interactions'])}; there are {sorted(have)}")


def load_dataset(spark: SparkSession, paths: DatasetPaths, batch_size: int = 250_000) -> dict[str, DataFrame]:
    """users, items, interactions (with ord), checked before any job runs."""
    out = {"users": spark.read.parquet(paths.users), "items": spark.read.parquet(paths.items), "interactions": spark.read.parquet(*paths.interactions)}
    for name in ("users", "items"):
        if missing := REQUIRED[name] - set(out[name].columns):
            raise ValueError(f"{name} lack {sorted(missing)}")
    if not paths.embeddings and "embedding" not in out["items"].columns:
        raise ValueError("items need an embedding column, or an embeddings archive must be given")
    dialect(out["interactions"].columns)
    if "ord" not in out["interactions"].columns:
        out["interactions"] = in_file_order(spark, list(paths.interactions), batch_size)
    return {k: with_long_ids(v) for k, v in out.items()}


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def interactions(spark: SparkSession, sf_dir: str) -> DataFrame:
    e, t = F.col("event_id"), F.col("event_type")
    return table(spark, sf_dir, "events").select(
        e.alias("ord"),
        "user_id",
        F.get_json_object("props", "$.k").cast("long").alias("item_id"),
        "ts",
        F.least(F.floor("value"), F.lit(255)).cast("int").alias("timespent"),
        (t == "purchase").alias("like"),
        (t == "error").alias("dislike"),
        ((t == "signup") & (e % 5 == 0)).alias("share"),
        ((t == "view") & (e % 7 == 0)).alias("bookmark"),
        ((t == "click") & (e % 3 == 0)).alias("click_on_author"),
        ((t == "click") & (e % 4 == 1)).alias("open_comments"),
        F.floor(F.datediff("ts", F.lit("2024-01-01").cast("date")) / 7).cast("int").alias("week"),
    )


def train(spark: SparkSession, sf_dir: str) -> DataFrame:
    return interactions(spark, sf_dir).where(F.col("week").between(*TRAIN_WEEKS))


def holdout(spark: SparkSession, sf_dir: str) -> DataFrame:
    return interactions(spark, sf_dir).where(F.col("week") == HOLDOUT_WEEK)


def interactions_big(spark: SparkSession, sf_dir: str) -> DataFrame:
    lines = table(spark, sf_dir, "lineitem").select("l_orderkey", "l_partkey", "l_quantity", "l_returnflag")
    orders = table(spark, sf_dir, "orders").select("o_orderkey", "o_custkey")
    return lines.join(orders, F.col("l_orderkey") == F.col("o_orderkey")).select(
        F.col("o_custkey").alias("user_id"),
        F.col("l_partkey").alias("item_id"),
        F.col("l_quantity").alias("timespent"),
        (F.col("l_returnflag") == "A").alias("like"),
        ((F.col("l_returnflag") == "R") & (F.col("l_quantity") < 5)).alias("dislike"),
    )


def items(spark: SparkSession, sf_dir: str) -> DataFrame:
    counts = interactions_big(spark, sf_dir).groupBy("item_id").count()
    parts = table(spark, sf_dir, "part").select(F.col("p_partkey").alias("item_id"), F.expr("substr(p_brand, 7)").cast("long").alias("author_id"), F.col("p_size").alias("duration"))
    ranked = parts.join(counts, "item_id", "left").withColumn("count", F.coalesce("count", F.lit(0)))
    return numbered(ranked, -F.col("count"), "item_id", "train_interactions_rank").drop("count")


def users(spark: SparkSession, sf_dir: str) -> DataFrame:
    counts = table(spark, sf_dir, "orders").groupBy(F.col("o_custkey").alias("user_id")).count()
    own = table(spark, sf_dir, "customer").select(
        F.col("c_custkey").alias("user_id"), (F.lit(18) + F.col("c_custkey") % 60).alias("age"), (F.col("c_custkey") % 2).alias("gender"), F.col("c_nationkey").cast("long").alias("geo")
    )
    ranked = own.join(counts, "user_id", "left").withColumn("count", F.coalesce("count", F.lit(0)))
    return numbered(ranked, -F.col("count"), "user_id", "train_interactions_rank").drop("count")


def item_embeddings(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One vector an item: of repeated ids one stays."""
    df = table(spark, sf_dir, "embeddings")
    return df.select(F.col("vec_id").alias("item_id"), F.col("embedding").cast("array<double>").alias("embedding")).dropDuplicates(["item_id"])
