"""N-gram Jaccard join: which documents share enough word n-grams, and the components they form.

Exact, by a blocked sparse matrix product of the document by n-gram incidence, of which only the diagonal blocks
that can hold a link are computed:

1. A document's row is its set of n-grams (64-bit hashes). Equal rows are one class. Linked rows of sizes a and b
   share need(a) = ceil(t a) columns at least, and need(b).
2. Rows that cannot link leave (`shared_prefixes`). Of the first size - need + k columns by hash, k being `extra`
   per cent of the size, linked rows have k of the smaller in common; so a row of whose prefix fewer columns occur in
   another class has no partner. The columns go packed through one exchange; a column that a task sees twice is
   counted there and sent once, so one that a third of all rows have is sent once a task.
3. Of the rows left, all columns are counted. Fewer than need shared columns: no partner. Of the others the rarest
   size - need + 1 columns, those of no other row first, hold a column of every partner (`candidate_edges`). Passages
   and common n-grams are not rare, so they tie rows together only where a row has hardly anything else.
4. Rows that share such a column, directly or through others, are a cluster: a diagonal block. All other entries of
   the product are below the bound.
5. In a cluster the product of incidence blocks is accumulated column block by column block; tiles whose
   sizes exclude a link are skipped, and pairs below the bound are discarded. A block returns a spanning
   forest of its links, never its pairs.
6. A cluster above `block_rows` is cut into chunks: first each chunk by itself; then one pivot of each large
   component found against all chunks; then only the rows outside the cluster's largest component against the
   others. So a large group of near copies, most of which join at once, costs in proportion to its size. Where
   the rows of a large cluster do not link, all its chunks meet: exact, and the price is named here.
7. The links' connected components are found by stars (components.py).

Bounds: nothing is broadcast but after a count of its rows; otherwise the join is shuffled. A task holds one block or
one bucket of columns. Inner tables are removed when the result's own two are written. Classes and n-grams are told
apart by 64-bit hashes.

Defined cases: null or wordless text: an empty set, linked with nothing, its component is its own id. Fewer words
than n: the whole sequence is the one n-gram. Repeated rows and ids are handled row by row; a component's name is
its smallest id that is not null. An empty table gives an empty result; other columns are not read."""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from tastemill.llm._common import Scratch, arrow_rows, ensure_importable, holds, written
from tastemill.llm.components import components
from tastemill.llm.ppm import blocks, lower_binary

TILE = 256
COLUMNS = 4096
NARROW, WIDE = 200_000, 2_000  # rows of a file: ids and numbers, sets
CHUNK_COLUMNS = 250_000  # of a prefix table, that are sorted together
CHUNK_ROWS = 65_535  # so a row's number in its chunk has 16 bits
SEVERAL = 65_535  # stands for the row where a chunk has several


def _mix(h: np.ndarray) -> np.ndarray:
    h = (h ^ (h >> np.uint64(29))) * np.uint64(0xBF58476D1CE4E5B9)
    return h ^ (h >> np.uint64(32))


def multiplier(j: int) -> np.uint64:
    """Odd, for the j-th word of an n-gram."""
    return np.uint64((0x9E3779B97F4A7C15 * (2 * j + 1)) % (1 << 64))


def need(size, percent: int):
    """How many columns a row of this size has in common with any partner."""
    return -(-size * percent // 100)


def shingle_sets(texts: list[bytes], n: int) -> list[np.ndarray]:
    """Sorted distinct n-gram hashes of lower-cased texts, as signed 64-bit numbers."""
    words: list[list[np.ndarray]] = [[] for _ in texts]
    for block in blocks(texts):
        at, h = block.words()
        cut = np.searchsorted(at, block.last)
        begin = 0
        for doc, end in zip(block.docs.tolist(), cut.tolist()):
            words[doc].append(h[begin:end])
            begin = end
    out = []
    for parts in words:
        w = parts[0] if len(parts) == 1 else np.concatenate(parts)
        if not len(w):
            out.append(np.zeros(0, np.int64))
            continue
        k = min(n, len(w))
        total = np.full(len(w) - k + 1, np.uint64(k))  # the number of words counts
        for j in range(k):
            total = total + _mix(w[j : len(w) - k + 1 + j] * multiplier(j))
        out.append(np.unique(_mix(total).view(np.int64)))
    return out


def _batches(batches: Iterator[pa.RecordBatch], n: int) -> Iterator[tuple[pa.RecordBatch, list[np.ndarray]]]:
    for b in batches:
        for at in range(0, b.num_rows, 500):
            part = b.slice(at, 500)
            yield part, shingle_sets(part.column("text").to_pylist(), n)


def class_of(s: np.ndarray) -> int:
    return int.from_bytes(hashlib.blake2b(s.tobytes(), digest_size=8).digest(), "little", signed=True)


def prefix_rows(rows: DataFrame, n: int, percent: int, extra: int, scratch: Scratch) -> DataFrame:
    """doc_id, text_hash, cls (of the set), size, least (shared columns of the prefix), prefix (by hash, eight bytes each)."""
    kind = rows.schema["doc_id"].dataType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        holds("ngrams")
        for part, sets in _batches(batches, n):
            size = np.array([len(s) for s in sets], np.int64)
            least = need(size, percent)
            stop = size - least + np.maximum(1, size * extra // 100)
            shared = np.maximum(1, least * extra // 100)  # a partner may be as small as least
            prefix = [s[:k].tobytes() for s, k in zip(sets, stop.tolist())]
            cls = pa.array([class_of(s) if len(s) else None for s in sets], pa.int64())
            yield pa.RecordBatch.from_arrays([part.column("doc_id"), part.column("text_hash"), cls, pa.array(size), pa.array(shared), pa.array(prefix, pa.binary())], ["doc_id", "text_hash", "cls", "size", "least", "prefix"])

    return scratch.written_by(rows, run, f"doc_id {kind}, text_hash long, cls long, size long, least long, prefix binary", "prefixes")


def shared_prefixes(rows: DataFrame, columns: int, bucket_columns: int) -> DataFrame:
    """cls of the rows (cls, least, prefix; one of each class) of whose prefix `least` columns or more occur in other prefixes.

    A chunk of rows is sorted by column. Columns that the chunk has several times are counted there; each of its
    columns goes to the column's bucket once, with the row's number in the chunk or the mark that there are several."""
    ensure_importable(rows.sparkSession)
    bits = max(0, (-(-columns // bucket_columns) - 1).bit_length())
    empty = b""

    def deal(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, sizes, cls, least, chunk = [], [], [], [], TaskContext.get().partitionId() << 24

        def flush() -> pa.RecordBatch:
            h = _mix(np.frombuffer(b"".join(held), np.uint64))  # the prefixes are of the smallest hashes
            row = np.repeat(np.arange(len(sizes), dtype=np.uint16), sizes)
            order = np.argsort(h, kind="stable")
            h, row = h[order], row[order]
            first = np.flatnonzero(np.concatenate([np.ones(1, bool), h[1:] != h[:-1]]))
            times = np.diff(np.append(first, len(h)))
            count = np.bincount(row[np.repeat(times > 1, times)], minlength=len(sizes))
            h, row = h[first], np.where(times > 1, np.uint16(SEVERAL), row[first])
            bucket = (h >> np.uint64(64 - bits)).astype(np.int64) if bits else np.zeros(len(h), np.int64)
            low = ((h << np.uint64(bits)) >> np.uint64(32)).astype(np.uint32)
            at = np.searchsorted(bucket, np.arange((1 << bits) + 1))
            own = np.flatnonzero(np.diff(at))
            # the chunk's own rows go the same way, with a number below 0, spread like the buckets
            return pa.RecordBatch.from_arrays(
                [
                    pa.array([*own.tolist(), -1 - chunk % 65_521], pa.int64()), pa.array([chunk] * (len(own) + 1), pa.int64()),
                    pa.array([*[low[at[b] : at[b + 1]].tobytes() for b in own], np.array(least, np.int64).tobytes()], pa.binary()),
                    pa.array([*[row[at[b] : at[b + 1]].tobytes() for b in own], count.astype(np.int64).tobytes()], pa.binary()),
                    pa.array([*[empty] * len(own), np.array(cls, np.int64).tobytes()], pa.binary()),
                ],
                ["bucket", "chunk", "columns", "rows", "cls"],
            )

        total = 0
        for b in batches:
            for c, k, x in zip(b.column("cls").to_pylist(), b.column("least").to_pylist(), b.column("prefix").to_pylist()):
                held.append(x)
                sizes.append(len(x) // 8)
                cls.append(c)
                least.append(k)
                total += len(x) // 8
                if total >= CHUNK_COLUMNS or len(sizes) == CHUNK_ROWS:
                    yield flush()
                    held, sizes, cls, least, total, chunk = [], [], [], [], 0, chunk + 1
        if sizes:
            yield flush()

    def meet(t: pa.Table) -> pa.Table:
        """For each chunk that has columns in the bucket: its rows whose columns other chunks have too, and how many of each."""
        if t["bucket"][0].as_py() < 0:
            return t.select(["chunk", "columns", "rows", "cls"])
        chunk, columns, rows_ = (t[c].to_pylist() for c in ("chunk", "columns", "rows"))
        column, row = np.frombuffer(b"".join(columns), np.uint32), np.frombuffer(b"".join(rows_), np.uint16)
        place = np.repeat(np.arange(len(chunk)), [len(x) // 4 for x in columns])
        order = np.argsort(column, kind="stable")
        column, row, place = column[order], row[order], place[order]
        same = column[1:] == column[:-1]
        met = (np.concatenate([[False], same]) | np.concatenate([same, [False]])) & (row != SEVERAL)  # the others are counted already
        pairs, n = np.unique((place[met] << 16) | row[met], return_counts=True)
        edges = np.searchsorted(pairs >> 16, np.arange(len(chunk) + 1))
        own = np.flatnonzero(np.diff(edges))
        part = lambda x, kind: pa.array([x[edges[k] : edges[k + 1]].astype(kind).tobytes() for k in own], pa.binary())
        return pa.table({"chunk": pa.array(np.array(chunk, np.int64)[own]), "columns": part(n, np.int64), "rows": part(pairs & 65_535, np.uint16), "cls": pa.array([empty] * len(own), pa.binary())})

    def decide(t: pa.Table) -> pa.Table:
        """A chunk's classes with enough shared columns: those of its own rows' sums and of all buckets."""
        numbers, rows_, cls = (t[c].to_pylist() for c in ("columns", "rows", "cls"))
        home = max(range(len(cls)), key=lambda k: len(cls[k]))
        total, least = np.frombuffer(rows_[home], np.int64).copy(), np.frombuffer(numbers[home], np.int64)
        for k in range(len(cls)):
            if k != home:
                np.add.at(total, np.frombuffer(rows_[k], np.uint16), np.frombuffer(numbers[k], np.int64))
        return pa.table({"cls": pa.array(np.frombuffer(cls[home], np.int64)[total >= least])})

    dealt = rows.select("cls", "least", "prefix").mapInArrow(deal, "bucket long, chunk long, columns binary, rows binary, cls binary")
    told = dealt.groupBy("bucket").applyInArrow(meet, "chunk long, columns binary, rows binary, cls binary")
    return told.groupBy("chunk").applyInArrow(decide, "cls long")


def candidate_edges(sets: DataFrame, percent: int, few: int, scratch: Scratch) -> DataFrame:
    """(u, v): classes that share one of their rarest columns, each tied to the column's smallest class.

    sets: (cls, size, grams), one row of each class."""
    incidence = sets.select("cls", "size", F.explode("grams").alias("h"))
    often = scratch.written(incidence.groupBy("h").agg(F.count(F.lit(1)).alias("n")).where("n > 1"), "shared-columns", files=few)
    shared = incidence.join(_small(often), "h")
    own = Window.partitionBy("cls")
    shared = shared.select("cls", "h", F.ceil(F.col("size") * percent / 100).alias("need"), F.count(F.lit(1)).over(own).alias("r"), F.row_number().over(own.orderBy("n", "h")).alias("place"))
    found = scratch.written(shared.where("place <= r - need + 1").select("cls", "h"), "rare-columns", files=few)
    heads = scratch.written(found.groupBy("h").agg(F.min("cls").alias("v")), "column-heads", files=few)
    return found.join(heads, "h").where("cls <> v").select(F.col("cls").alias("u"), "v")


def links_in(sets: list[np.ndarray], label: np.ndarray, left: np.ndarray, percent: int) -> list[tuple[int, int]]:
    """A spanning forest of the links between rows of different label of which one is left; indices.

    The product of the rows' incidence with itself, tile by tile and column block by column block."""
    size = np.array([len(s) for s in sets], np.int64)
    order = np.argsort(size, kind="stable")
    rows = np.repeat(np.arange(len(sets)), size[order])
    _, column, count = np.unique(np.concatenate([sets[i] for i in order]), return_inverse=True, return_counts=True)
    common = count > 1
    renumbered = np.cumsum(common) - 1
    keep = common[column]
    rows, column = rows[keep], renumbered[column[keep]]
    width, size, label, left = int(common.sum()), size[order], label[order], left[order]
    starts = np.searchsorted(rows, np.arange(len(sets) + 1))
    parent = np.arange(len(sets))
    heads: dict[int, int] = {}
    for i, x in enumerate(label.tolist()):  # rows of one label are joined already
        parent[i] = heads.setdefault(x, i)
    forest = []

    def root(i: int) -> int:
        while parent[i] != i:
            parent[i] = parent[parent[i]]
            i = parent[i]
        return i

    def dense(lo: int, hi: int, c: int) -> np.ndarray:
        out = np.zeros((hi - lo, min(COLUMNS, width - c)), np.float32)
        r, k = rows[starts[lo] : starts[hi]], column[starts[lo] : starts[hi]]
        own = (k >= c) & (k < c + COLUMNS)
        out[r[own] - lo, k[own] - c] = 1
        return out

    tiles = [(lo, min(lo + TILE, len(sets))) for lo in range(0, len(sets), TILE)]
    for a, (lo, hi) in enumerate(tiles):
        others = [(x, y) for x, y in tiles[a:] if 100 * size[hi - 1] >= percent * size[x]]  # the size bound of a tile
        others = [(x, y) for x, y in others if left[lo:hi].any() or left[x:y].any()]
        if not others or not width:
            continue
        overlap = [np.zeros((hi - lo, y - x), np.float32) for x, y in others]
        for c in range(0, width, COLUMNS):
            mine = dense(lo, hi, c)
            for o, (x, y) in zip(overlap, others):
                o += mine @ dense(x, y, c).T
        for o, (x, y) in zip(overlap, others):
            both = size[lo:hi, None] + size[None, x:y]
            i, j = np.nonzero((100 + percent) * o.astype(np.int64) >= percent * both)
            i, j = i + lo, j + x
            good = (i < j) & (left[i] | left[j])
            for p, q in zip(i[good].tolist(), j[good].tolist()):
                rp, rq = root(p), root(q)
                if rp != rq:
                    parent[rp] = rq
                    forest.append((int(order[p]), int(order[q])))
    return forest


def block_links(members: DataFrame, grams: DataFrame, percent: int, scratch: Scratch) -> DataFrame:
    """members: (block, cluster, cls, label, is_left), grams: (cls, grams). Links (u, v), of each block and cluster a spanning forest."""
    ensure_importable(members.sparkSession)

    def run(t: pa.Table) -> pa.Table:
        cluster, cls = t["cluster"].to_numpy(), t["cls"].to_numpy()
        label, left = t["label"].to_numpy(), t["is_left"].to_numpy(zero_copy_only=False)
        lists = t["grams"].combine_chunks()
        flat, ends = lists.values.to_numpy(), lists.offsets.to_numpy()
        order = np.argsort(cluster, kind="stable")
        u, v = [], []
        for own in np.split(order, np.flatnonzero(np.diff(cluster[order])) + 1):
            if len(own) > 1:
                for i, j in links_in([flat[ends[k] : ends[k + 1]] for k in own], label[own], left[own], percent):
                    u.append(cls[own[i]])
                    v.append(cls[own[j]])
        return pa.table({"u": pa.array(u, pa.int64()), "v": pa.array(v, pa.int64())})

    members = scratch.written(members.select("block", "cluster", "cls", "label", "is_left"), "blocks")
    return grams.select("cls", "grams").join(_small(members), "cls").groupBy("block").applyInArrow(run, "u long, v long")


def _small(df: DataFrame, most_rows: int = 300_000) -> DataFrame:
    """df, narrow rows, to be broadcast if a count shows that it has few; else left to a shuffled join."""
    return F.broadcast(df) if df.count() <= most_rows else df


def near_components(docs: DataFrame, n: int = 4, percent: int = 85, extra: int = 10, block_rows: int = 1000, block_bytes: int = 8 << 20, bucket_columns: int = 250_000, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row per row of docs: doc_id, text_hash, n_shingles, component_id."""
    spark = docs.sparkSession
    ensure_importable(spark)
    scratch = Scratch(spark, "ngram-join")
    with arrow_rows(spark):
        text = lower_binary(F.col(text_col))
        rows = docs.select(F.col(id_col).alias("doc_id"), F.xxhash64(F.coalesce(F.col(text_col), F.lit(""))).alias("text_hash"), text.alias("text"))
        wide = prefix_rows(rows, n, percent, extra, scratch)
        all_rows, columns = wide.agg(F.count(F.lit(1)), F.coalesce(F.sum(F.octet_length("prefix")), F.lit(0)) / 8).first()
        files = 1 + all_rows // NARROW  # of narrow tables
        each = written(wide.select("doc_id", "text_hash", "cls", "size"), "ngram-rows", files)
        classes = scratch.written(each.where("size > 0").groupBy("cls").agg(F.min("doc_id").alias("first_id"), F.count(F.lit(1)).alias("copies")), "ngram-classes", files=files)
        sets, few = _sets_left(rows, wide, classes, n, percent, int(columns), bucket_columns, files, scratch)
        edges = candidate_edges(sets, percent, few, scratch)
        clusters = scratch.written(components(edges, scratch, files=few), "clusters", files=few).select(F.col("node").alias("cls"), F.col("component").alias("cluster"))
        links = _cluster_links(sets, clusters, percent, block_rows, block_bytes, few, scratch)
        found = scratch.written(components(links, scratch, files=few), "components", files=few)
        named = found.join(classes.select(F.col("cls").alias("node"), "first_id"), "node")
        names = scratch.written(named.groupBy("component").agg(F.min("first_id").alias("component_id")), "component-names", files=few)
        of_class = found.join(names, "component").select(F.col("node").alias("cls"), "component_id")
        labels = written(classes.join(of_class, "cls", "left").select("cls", F.coalesce("component_id", "first_id").alias("component_id")), "class-components", files)
    scratch.remove()
    # two written tables: the partition of a class with very many copies is split at run time
    full = each.where("size > 0").join(labels, "cls").select("doc_id", "text_hash", F.col("size").alias("n_shingles"), "component_id")
    return full.unionByName(each.where("size = 0").select("doc_id", "text_hash", F.col("size").alias("n_shingles"), F.col("doc_id").alias("component_id")))


def _sets_left(rows: DataFrame, wide: DataFrame, classes: DataFrame, n: int, percent: int, columns: int, bucket_columns: int, files: int, scratch: Scratch) -> tuple[DataFrame, int]:
    """cls, size, grams of the classes whose prefixes leave a link possible, one row of each; how many files suit tables of them."""
    own = wide.where("size > 0").select("cls", "least", "prefix")
    copied = _small(classes.where("copies > 1").select("cls"))
    # one row of each class; of all rows only those of classes that have copies are shuffled
    once = scratch.written(own.join(copied, "cls", "left_semi").dropDuplicates(["cls"]), "copied-classes", files=files)
    once = own.join(copied, "cls", "left_anti").unionByName(once)
    left = scratch.written(shared_prefixes(once, columns, bucket_columns), "rows-left", files=files)
    few = 1 + left.count() // WIDE
    wanted = scratch.written(classes.join(_small(left), "cls", "left_semi").select("cls", "first_id"), "wanted", files=files)
    scratch.drop(wide)

    def sets(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for _, found in _batches(batches, n):
            found = [s for s in found if len(s)]
            ends = np.concatenate([[0], np.cumsum([len(s) for s in found])]).astype(np.int32)
            lists = pa.ListArray.from_arrays(pa.array(ends), pa.array(np.concatenate(found) if found else np.zeros(0, np.int64)))
            yield pa.RecordBatch.from_arrays([pa.array([class_of(s) for s in found], pa.int64()), pa.array([len(s) for s in found], pa.int64()), lists], ["cls", "size", "grams"])

    # the whole set is made again for these alone; an id that occurs with other texts is sorted out by the class
    ids = wanted.select(F.col("first_id").alias("doc_id")).distinct()
    again = rows.join(_small(ids), rows["doc_id"].eqNullSafe(ids["doc_id"]), "left_semi").select("text")
    made = again.mapInArrow(sets, "cls long, size long, grams array<long>").join(_small(wanted.select("cls")), "cls", "left_semi")
    made = scratch.written(made, "sets")
    twice = scratch.written(made.groupBy("cls").agg(F.count(F.lit(1)).alias("copies")).where("copies > 1").select("cls"), "sets-twice", files=few)
    if twice.isEmpty():
        return made, few
    twice = _small(twice)  # rows of one id and equal sets
    return scratch.written(made.join(twice, "cls", "left_anti").unionByName(made.join(twice, "cls", "left_semi").dropDuplicates(["cls"])), "sets"), few


def _cluster_links(sets: DataFrame, clusters: DataFrame, percent: int, block_rows: int, block_bytes: int, few: int, scratch: Scratch) -> DataFrame:
    """All links inside candidate clusters, by spanning forests."""
    members = scratch.written(clusters.join(sets.select("cls", (F.col("size") * 8).alias("bytes")), "cls"), "cluster-members", files=few)
    sizes = members.groupBy("cluster").agg(F.count(F.lit(1)).alias("rows"), F.sum("bytes").alias("all_bytes"))
    sizes = scratch.written(sizes.withColumn("parts", F.greatest(F.ceil(F.col("rows") / block_rows), F.ceil(F.col("all_bytes") / block_bytes)).cast("long")), "cluster-sizes", files=few)
    sized = members.select("cluster", "cls").join(_small(sizes), "cluster")
    total = sizes.agg(F.sum("all_bytes"), F.sum("rows"), F.max("parts")).first()
    groups = max(1, -(-(total[0] or 0) // block_bytes), -(-(total[1] or 0) // block_rows))
    chunk = F.pmod(F.xxhash64("cls"), F.col("parts"))
    small_block = F.concat(F.lit("s"), F.pmod(F.xxhash64("cluster"), F.lit(groups)))
    own = F.when(F.col("parts") == 1, small_block).otherwise(F.concat_ws("-", F.lit("c"), "cluster", chunk))
    alone = sized.select(own.alias("block"), "cluster", "cls", F.col("cls").alias("label"), F.lit(True).alias("is_left"))
    links = scratch.written(block_links(alone, sets, percent, scratch), "links")
    if (total[2] or 0) <= 1:
        return links
    large = scratch.written(sized.where("parts > 1").withColumn("chunk", chunk), "large-clusters", files=few)
    links = links.unionByName(_pivot_links(large, sets, links, percent, block_rows, few, scratch))
    links = scratch.written(links, "links")
    return links.unionByName(_outside_links(large, sets, links, percent, block_rows, few, scratch))


def _labelled(large: DataFrame, links: DataFrame, few: int, scratch: Scratch) -> DataFrame:
    """large with the component of each row so far."""
    label = scratch.written(components(links, scratch, files=few), "labels", files=few).select(F.col("node").alias("cls"), F.col("component").alias("label"))
    return scratch.written(large.join(_small(label), "cls", "left").withColumn("label", F.coalesce("label", "cls")), "labelled", files=few)


def _pivot_links(large: DataFrame, grams: DataFrame, links: DataFrame, percent: int, block_rows: int, few: int, scratch: Scratch) -> DataFrame:
    """One row of each component with half a block or more, against every chunk of its cluster."""
    now = _labelled(large, links, few, scratch)
    count = now.groupBy("cluster", "label").agg(F.count(F.lit(1)).alias("n"), F.min("cls").alias("cls")).where(F.col("n") >= block_rows // 2)
    pivots = now.join(_small(count.select("cls")), "cls", "left_semi")
    pivots = pivots.select("cluster", "cls", "label", "parts", F.col("chunk").alias("home")).withColumn("chunk", F.explode(F.expr("sequence(0L, parts - 1)"))).where("chunk <> home")
    block = F.concat_ws("-", F.lit("p"), "cluster", "chunk")
    columns = ["cluster", "cls", "label"]
    chunks = now.select(block.alias("block"), *columns, F.lit(False).alias("is_left"))
    return block_links(chunks.unionByName(pivots.select(block.alias("block"), *columns, F.lit(True).alias("is_left"))), grams, percent, scratch)


def _outside_links(large: DataFrame, grams: DataFrame, links: DataFrame, percent: int, block_rows: int, few: int, scratch: Scratch) -> DataFrame:
    """Rows outside their cluster's largest component, in groups, against all other groups and that component's chunks."""
    now = _labelled(large, links, few, scratch)
    count = now.groupBy("cluster", "label").agg(F.count(F.lit(1)).alias("n"))
    main = scratch.written(count.groupBy("cluster").agg(F.max(F.struct("n", "label")).alias("m"), F.sum("n").alias("all")), "main-components", files=few)
    main = main.select("cluster", F.col("m.label").alias("main"), F.ceil((F.col("all") - F.col("m.n")) / block_rows).alias("groups")).where("groups > 0")
    now = now.join(_small(main), "cluster")
    outside = now.where("label <> main").withColumn("g", F.pmod(F.xxhash64("cls", F.lit(1)), F.col("groups")))
    inside = now.where("label = main")
    columns = ["cluster", "cls", "label"]
    # group i of the outside is left in blocks (i, chunk of the inside) and (i, group j >= i)
    one = inside.withColumn("i", F.explode(F.expr("sequence(0L, groups - 1)"))).select(F.concat_ws("-", F.lit("i"), "cluster", "i", "chunk").alias("block"), *columns, F.lit(False).alias("is_left"))
    two = outside.withColumn("chunk", F.explode(F.expr("sequence(0L, parts - 1)"))).select(F.concat_ws("-", F.lit("i"), "cluster", "g", "chunk").alias("block"), *columns, F.lit(True).alias("is_left"))
    three = outside.withColumn("j", F.explode(F.expr("sequence(0L, groups - 1)"))).select(F.concat_ws("-", F.lit("o"), "cluster", F.least("g", "j"), F.greatest("g", "j")).alias("block"), *columns, F.lit(True).alias("is_left"))
    return block_links(one.unionByName(two).unionByName(three), grams, percent, scratch)


def drop_near_duplicates(docs: DataFrame, n: int = 5, percent: int = 80, **options) -> DataFrame:
    """The rows of docs of which no other row of their component has a smaller id; docs' columns.

    Rows equal in id and text stay or go together."""
    names = docs.columns
    placed = near_components(docs, n, percent, **options)
    gone = placed.where("component_id is not null and not (doc_id <=> component_id)").select(F.col("doc_id").alias("gone_id"), F.col("text_hash").alias("gone_hash"))
    gone = written(gone.distinct(), "near-duplicates")
    h = F.xxhash64(F.coalesce(docs["text"], F.lit("")))
    return docs.join(_small(gone), docs["doc_id"].eqNullSafe(gone["gone_id"]) & (h == gone["gone_hash"]), "left_anti").select(*names)
