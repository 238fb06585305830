"""Cosine top-k by block matrix products, exact or by coarse cells.

Items lie in blocks of at most `block_bytes`, in ascending id: one block is broadcast; more are written to the
shared folder, and a task reads one after the other past the users that it holds. Inside a block the product is
made in tiles, whose best k are merged into the users' best so far. So no user-item pair is ever a row, users are
read once, and a task holds one block, one tile of scores and k numbers for each user that it holds.

Users that a task holds are grouped by direction. A unit item's score differs by at most a group's radius from its
score with the group's centre, so a tile's products with the centres tell which items can be among anyone's best k;
only these meet the users. Where a group is wide, or scores lie close, that is all of them."""

from __future__ import annotations

from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import pyarrow.dataset
from pyarrow import fs
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tastemill.sources.shared import new_path, remove

MODES = ("bruteforce_full", "bruteforce_subset", "ann_full", "ann_subset")
TILE_USERS, TILE_ITEMS = 512, 8192
HELD_USERS = 32_768  # users past whom the blocks are read once
LEAST_GROUP, NEAR = 32, 0.02  # groups of users are split down to this size, or this radius
DIGITS = 9  # scores are ranked at so many


def supports_mode(mode: str) -> bool:
    return mode in MODES


def unit_rows(m: np.ndarray) -> np.ndarray:
    length = np.linalg.norm(m, axis=1, keepdims=True)
    return m / np.where(length == 0, 1, length)


def matrix(column: pa.ChunkedArray | pa.Array) -> np.ndarray:
    """Rows of a column of lists of one length."""
    whole = column.combine_chunks() if isinstance(column, pa.ChunkedArray) else column
    whole = pa.concat_arrays(whole.chunks) if isinstance(whole, pa.ChunkedArray) else whole
    size = pc.unique(pc.list_value_length(whole))
    if len(size) != 1 or size[0].as_py() is None:
        raise ValueError(f"vectors of one length are needed, not {size.to_pylist()[:5]}")
    return whole.flatten().to_numpy(zero_copy_only=False).astype(np.float64).reshape(len(whole), size[0].as_py())


def groups(v: np.ndarray) -> Iterator[tuple[np.ndarray, np.ndarray, float]]:
    """Places, centre and radius of groups of at most TILE_USERS rows that lie near each other: halves along the widest element."""
    waiting = [np.arange(len(v))]
    while waiting:
        at = waiting.pop()
        low, high = v[at].min(axis=0), v[at].max(axis=0)
        centre = (low + high) / 2
        radius = np.linalg.norm(v[at] - centre, axis=1).max()
        if len(at) > TILE_USERS or len(at) > LEAST_GROUP and radius > NEAR:
            at = at[np.argpartition(v[at, np.argmax(high - low)], len(at) // 2)]
            waiting += [at[: len(at) // 2], at[len(at) // 2 :]]
        else:
            yield at, centre, radius


class Best:
    """The k best items of each of some users so far. An item's place in ascending id breaks ties of rounded scores."""

    def __init__(self, users: int, k: int):
        self.k = k
        self.code, self.item, self.score = (np.zeros((users, 0), t) for t in (np.int64, np.int64, np.float64))

    def add(self, score: np.ndarray, place: np.ndarray, ids: np.ndarray) -> None:
        """Scores of all users and the items of these places."""
        code = (np.rint(score * 10**DIGITS).astype(np.int64) << 32) - place  # places are below 2 ** 32
        few = min(self.k, len(ids))
        at = np.argpartition(code, len(ids) - few, axis=1)[:, len(ids) - few :]
        take = lambda x: np.take_along_axis(x, at, 1)
        code = np.hstack([self.code, take(code)])
        order = np.argsort(-code, axis=1)[:, : self.k]
        self.code = np.take_along_axis(code, order, 1)
        self.item = np.take_along_axis(np.hstack([self.item, ids[at]]), order, 1)
        self.score = np.take_along_axis(np.hstack([self.score, take(score)]), order, 1)

    def may_enter(self, near: np.ndarray, radius: float) -> np.ndarray:
        """Which items can be among the best of any of the users, whose scores differ from `near` by at most the radius.

        Users who have fewer than k have k at least as good as the k-th best of `near` less the radius, if so many come."""
        if self.score.shape[1] == self.k:
            least = self.score[:, -1].min()
        elif len(near) > self.k:
            least = np.partition(near, len(near) - self.k)[len(near) - self.k] - radius
        else:
            return np.arange(len(near))
        return np.flatnonzero(~(near + radius < least - 10 ** (1 - DIGITS)))  # what is not a number stays


@lru_cache(1)
def _block(path: str, k: int) -> tuple[np.ndarray, np.ndarray]:
    files, root = fs.FileSystem.from_uri(path)
    t = pa.dataset.dataset(f"{root}/block={k}", filesystem=files, format="parquet").to_table(columns=["item_id", "embedding"])
    order = pc.sort_indices(t["item_id"]).to_numpy()
    return t["item_id"].to_numpy()[order], unit_rows(matrix(t["embedding"])[order])


def top_k(users: DataFrame, items: DataFrame, k: int, block_bytes: int = 64 << 20, keys: tuple[str, ...] = ("user_id",)) -> DataFrame:
    """users (keys, embedding), items (item_id, embedding): keys, rank, item_id, score.

    Scores are ranked at nine digits, then by item id, so rounding can't flip ties. A zero vector scores 0. Of items
    with equal ids each counts."""
    spark = users.sparkSession
    kinds = ", ".join(f"`{c}` {users.schema[c].dataType.simpleString()}" for c in keys)
    schema = f"{kinds}, rank long, item_id long, score double"
    own = new_path(spark, "item-vectors")  # the items' plan runs once
    items.where("embedding is not null").select(F.col("item_id").cast("long").alias("item_id"), "embedding").write.parquet(own)
    unit = spark.read.schema(f"item_id long, embedding {items.schema['embedding'].dataType.simpleString()}").parquet(own)
    n, dim = unit.agg(F.count(F.lit(1)), F.max(F.size("embedding"))).first()
    if k <= 0 or n == 0:
        remove(spark, own)
        return spark.createDataFrame([], schema)
    blocks = -(-n * dim * 8 // block_bytes)
    if blocks == 1:  # its size is known before it is collected
        t = unit.toArrow().sort_by("item_id")
        shared = spark.sparkContext.broadcast((t["item_id"].to_numpy(), unit_rows(matrix(t["embedding"]))))
        starts, block = [0], lambda _: shared.value
    else:
        path = new_path(spark, "item-blocks")
        dealt = unit.repartitionByRange(blocks, "item_id").withColumn("block", F.spark_partition_id())
        dealt.write.partitionBy("block").parquet(path)
        sizes = {r["block"]: r["count"] for r in spark.read.parquet(path).groupBy("block").count().collect()}
        order = sorted(sizes)
        starts, block = [sum(sizes[x] for x in order[:i]) for i in range(len(order))], lambda i: _block(path, order[i])
    remove(spark, own)

    def ranked(held: list[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        rows = pa.Table.from_batches(held).combine_chunks()
        v = unit_rows(matrix(rows["embedding"]))
        parts = [(at, Best(len(at), k), centre, radius) for at, centre, radius in groups(v)]
        for i, start in enumerate(starts):
            ids, m = block(i)
            for x in range(0, len(ids), TILE_ITEMS):
                tile, own = m[x : x + TILE_ITEMS], ids[x : x + TILE_ITEMS]
                for p in range(0, len(parts), TILE_USERS):
                    near = np.stack([centre for _, _, centre, _ in parts[p : p + TILE_USERS]]) @ tile.T
                    for (at, best, _, radius), scores in zip(parts[p : p + TILE_USERS], near):
                        few = best.may_enter(scores, radius)
                        if len(few):
                            best.add(v[at] @ tile[few].T, start + x + few, own[few])
        found = [np.concatenate([(best.item, best.score)[c] for _, best, _, _ in parts]) for c in (0, 1)]
        order = np.argsort(np.concatenate([at for at, _, _, _ in parts]))
        item, score = found[0][order], found[1][order]
        for at in range(0, len(v), TILE_USERS):
            some = item[at : at + TILE_USERS]
            own = rows.slice(at, len(some)).select(list(keys)).take(pa.array(np.repeat(np.arange(len(some)), some.shape[1]))).combine_chunks()
            rank = np.tile(np.arange(1, some.shape[1] + 1), len(some))
            columns = [own[c].combine_chunks() if own[c].num_chunks != 1 else own[c].chunk(0) for c in keys]
            yield pa.RecordBatch.from_arrays([*columns, pa.array(rank), pa.array(some.ravel()), pa.array(score[at : at + TILE_USERS].ravel())], [*keys, "rank", "item_id", "score"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, size = [], 0
        for b in batches:
            held.append(b)
            size += b.num_rows
            if size >= (HELD_USERS if len(starts) > 1 else 1):
                yield from ranked(held)
                held, size = [], 0
        if size:
            yield from ranked(held)

    return users.where("embedding is not null").select(*keys, "embedding").mapInArrow(run, schema)


def coarse_cells(items: DataFrame, cells: int, sample: int = 50_000, steps: int = 8, seed: int = 42) -> np.ndarray:
    """Centres of cells of unit vectors, fitted by spherical k-means on at most `sample` items, those of the smallest hashes."""
    rows = items.where("embedding is not null").orderBy(F.xxhash64("item_id", F.lit(seed)), "item_id").limit(sample).select("embedding").toArrow()
    m = unit_rows(np.stack(rows["embedding"].to_numpy()).astype(np.float64))
    centres = m[:: max(1, len(m) // cells)][:cells]
    for _ in range(steps):
        near = np.argmax(m @ centres.T, axis=1)
        total = np.zeros_like(centres)
        np.add.at(total, near, m)
        centres = np.where(np.bincount(near, minlength=len(centres))[:, None] > 0, unit_rows(total), centres)
    return centres


def _nearest_cells(df: DataFrame, keep: list[str], centres: np.ndarray, n: int) -> DataFrame:
    """keep, embedding and cell: each row once for each of its n nearest cells."""
    shared = df.sparkSession.sparkContext.broadcast(centres)  # cells * dim numbers

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in (b.slice(at, 4096) for b in batches for at in range(0, b.num_rows, 4096)):
            v = unit_rows(np.stack(b.column("embedding").to_numpy(zero_copy_only=False)).astype(np.float64))
            near = np.argsort(-(v @ shared.value.T), axis=1, kind="stable")[:, :n]
            rows = b.take(pa.array(np.repeat(np.arange(len(v)), near.shape[1])))
            yield pa.RecordBatch.from_arrays([*rows.columns, pa.array(near.ravel().astype(np.int32))], [*keep, "embedding", "cell"])

    kinds = ", ".join(f"`{c}` {df.schema[c].dataType.simpleString()}" for c in [*keep, "embedding"])
    return df.where("embedding is not null").select(*keep, "embedding").mapInArrow(run, f"{kinds}, cell int")


def top_k_by_cells(users: DataFrame, items: DataFrame, k: int, nprobe: int, cells: int | None = None, per_part: int = 2048) -> DataFrame:
    """Like top_k, but a user is compared with the items of its nprobe nearest cells only, so some of the best may be missed.

    Every item lies in one cell. A cell's users and items meet in parts of about `per_part` items, so a cell that
    holds a third of all items is split; what leaves a part is k rows a user. With as many probes as cells the result is exact."""
    spark = users.sparkSession
    n = items.where("embedding is not null").count()
    cells = cells or max(1, round(n**0.5))
    if k <= 0 or n == 0:
        return top_k(users, items, k)
    centres = coarse_cells(items, cells)
    dealt = _nearest_cells(items, ["item_id"], centres, 1)
    parts = dealt.groupBy("cell").agg(F.ceil(F.count(F.lit(1)) / per_part).cast("int").alias("parts"))  # one row a cell
    parts = spark.createDataFrame(parts.collect(), "cell int, parts int")
    left = dealt.join(F.broadcast(parts), "cell").select("cell", F.pmod(F.xxhash64("item_id"), F.col("parts")).cast("int").alias("part"), F.lit(0).alias("kind"), F.col("item_id").alias("id"), F.col("embedding").cast("array<double>").alias("embedding"))
    asked = _nearest_cells(users, ["user_id"], centres, nprobe).join(F.broadcast(parts), "cell")
    right = asked.select("cell", F.explode(F.sequence(F.lit(0), F.col("parts") - 1)).alias("part"), F.lit(1).alias("kind"), F.col("user_id").alias("id"), F.col("embedding").cast("array<double>").alias("embedding"))
    # users of a hot cell are dealt over salts; its items go to each
    salts = right.groupBy("cell").agg(F.ceil(F.countDistinct("id") / F.lit(HELD_USERS)).cast("int").alias("salts"))
    salts = F.broadcast(spark.createDataFrame(salts.collect(), "cell int, salts int"))
    right = right.join(salts, "cell").withColumn("salt", F.pmod(F.xxhash64("id", F.lit(1)), F.col("salts")).cast("int"))
    left = left.join(salts, "cell").withColumn("salt", F.explode(F.sequence(F.lit(0), F.col("salts") - 1)))

    def meet(t: pa.Table) -> pa.Table:
        kind, ids = t["kind"].to_numpy(), t["id"].to_numpy()
        v = unit_rows(np.stack(t["embedding"].to_numpy()))
        own = np.flatnonzero(kind == 0)
        own = own[np.argsort(ids[own], kind="stable")]
        asks = np.flatnonzero(kind == 1)
        out = []
        for at in range(0, len(asks), TILE_USERS) if len(own) else ():
            who = asks[at : at + TILE_USERS]
            best = Best(len(who), k)
            for x in range(0, len(own), TILE_ITEMS):
                best.add(v[who] @ v[own[x : x + TILE_ITEMS]].T, np.arange(x, min(x + TILE_ITEMS, len(own))), ids[own[x : x + TILE_ITEMS]])
            out.append((np.repeat(ids[who], best.item.shape[1]), best.item.ravel(), best.score.ravel()))
        columns = [np.concatenate(x) for x in zip(*out)] if out else [np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(0)]
        return pa.table(dict(zip(("user_id", "item_id", "score"), map(pa.array, columns))))

    near = left.unionByName(right).groupBy("cell", "part", "salt").applyInArrow(meet, "user_id long, item_id long, score double")
    return best_of(near, k)


def best_of(found: DataFrame, k: int, keys: tuple[str, ...] = ("user_id",)) -> DataFrame:
    """The k best rows of each of the keys, ranked as top_k does. What comes in is k rows of each part."""
    from pyspark.sql import Window

    order = Window.partitionBy(*keys).orderBy(F.desc(F.round("score", DIGITS)), "item_id")
    return found.withColumn("rank", F.row_number().over(order).cast("long")).where(F.col("rank") <= k).select(*keys, "rank", "item_id", "score")


def retrieve(mode: str, users: DataFrame, items: DataFrame, k: int, subset: DataFrame | None = None, nprobe: int | None = None) -> DataFrame:
    """Exact in all four modes, but that `ann_full` with nprobe looks at so many coarse cells only.

    The subset modes need a subset; None means all items."""
    if not supports_mode(mode):
        raise ValueError(f"unknown retrieval mode {mode!r}; known: {', '.join(MODES)}")
    if mode.endswith("_subset") and subset is not None:
        items = items.join(F.broadcast(subset.select("item_id")), "item_id", "left_semi")
    if mode == "ann_full" and nprobe:
        return top_k_by_cells(users, items, k, nprobe)
    return top_k(users, items, k)
