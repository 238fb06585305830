"""Scoring documents by prediction by partial matching over bytes.

The model is a context trie of order 5: for every context of up to five bytes, how often each byte, or the
end of the text, followed. Escapes are estimated by the number of different symbols a context has seen
(n symbols, q different: a seen symbol has count / (n + q), the escape q / (n + q)); after an escape
the symbols of the longer context are excluded from the shorter one. Below the empty context the symbols
never seen share what is left evenly.

Texts are put into batches of about `batch_bytes`. One pass over them finds each batch's different (context, symbol)
keys and words, with their counts in training texts, and keeps them packed (sorted, differences, compressed: about
a byte a key). All else works on these:

* Building: the batches' counts are summed by key, shorter contexts follow by cutting keys, and the sums that exclusion
  needs by one join of each node with its parent. Nothing is dropped or sampled, so the model grows with the corpus.
* The trie is written in slices. All contexts of a position end in the same bytes, so a slice has whole subtrees of
  suffixes; a suffix whose subtree has more than `slice_nodes` nodes is split by its next byte, and again (a suffix of
  full order has at most 257 nodes). A slice therefore has at most twice `slice_nodes` nodes, beside the
  split suffixes' own contexts, which every slice has.
* Scoring: a batch's keys go to their slices, where a task loads the slice once for some three million keys, and the
  scores come back to the batch. So what moves grows with the corpus, and the model never travels to the text.
  The chain of escapes runs only where the full context has not seen the symbol.

The base score is that of a unigram word model with add-one smoothing, in the same way: slices by word hash (62
bits), which return the words' counts.

Defined cases: a null text is the empty text: only its end is scored. Very long texts are read in windows with
their context carried over. Without training rows every symbol has probability 1/257. Repeated rows are scored
row by row, null ids too (their fold is that of the empty id); an empty table gives an empty result."""

from __future__ import annotations

import heapq
import re
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
import pyarrow.dataset
import pyarrow.ipc
from pyarrow import fs
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tastemill.llm._common import Scratch, arrow_rows, ensure_importable, holds, written

ORDER = 5
SYMBOL_BITS = 9  # a byte, or 256 for the end
END = 256
BLOCK = 1 << 18  # bytes that are looked at together
MERGED = 1_000_000  # new keys after which a task's counts are summed
END_WORD = 1  # no word has this number
SPACES = np.zeros(256, bool)
SPACES[[32, 9, 10, 11, 12, 13]] = True
CUT = re.compile(rb"[\x20\x09-\x0D]")
BASE = np.uint64(0x9E3779B97F4A7C15)
BASE_INVERSE = np.uint64(pow(0x9E3779B97F4A7C15, -1, 1 << 64))


class Block:
    """Some segments in one buffer: before each its ORDER bytes of context, after it one byte for the end."""

    def __init__(self, segments: list[tuple[int, bytes, bytes, bool]]):
        self.docs = np.array([s[0] for s in segments], np.int64)
        sizes = np.array([len(s[2]) for s in segments], np.int64)
        ends = np.cumsum(sizes + ORDER + 1)
        self.starts = ends - sizes - 1
        self.last = ends - 1  # where the end stands
        final = np.array([s[3] for s in segments], bool)
        self.bytes = np.frombuffer(b"".join(x for _, before, data, _ in segments for x in (before, data, b"\n")), np.uint8)
        self.outside = np.zeros(len(self.bytes), bool)
        for j in range(1, ORDER + 1):
            self.outside[self.starts - j] = True
        self.scored = ~self.outside
        self.scored[self.last[~final]] = False
        self.final = final

    def keys(self) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Positions, contexts (the latest byte lowest) and symbols."""
        b = self.bytes.astype(np.int64)
        pair = (b[:-1] << 8) | b[1:]
        context = (((pair[:-4] << 16) | pair[2:-2]) << 8) | b[4:-1]  # of position ORDER and on
        at = np.flatnonzero(self.scored[ORDER:])
        symbols = b[ORDER:].copy()
        symbols[self.last[self.final] - ORDER] = END
        return at + ORDER, context[at], symbols[at]

    def words(self) -> tuple[np.ndarray, np.ndarray]:
        """Positions of word starts and hashes of the words."""
        space = SPACES[self.bytes] | self.outside
        space[self.last] = True
        edge = np.diff(space.view(np.int8), prepend=np.int8(1))
        begin, end = np.flatnonzero(edge == -1), np.flatnonzero(edge == 1)
        end = end[end > (begin[0] if len(begin) else len(space))][: len(begin)]
        power, inverse = powers(pow2(len(self.bytes) + 1))
        total = np.concatenate([np.zeros(1, np.uint64), np.cumsum((self.bytes.astype(np.uint64) + np.uint64(1)) * power[: len(self.bytes)])])
        h = (total[end] - total[begin]) * inverse[begin]
        h ^= h >> np.uint64(31)
        return begin, h * np.uint64(0xC2B2AE3D27D4EB4F)

    def all_words(self) -> tuple[np.ndarray, np.ndarray]:
        """Positions and numbers (62 bits) of words and of the texts' ends."""
        at, h = self.words()
        ends = self.last[self.final]
        return np.concatenate([at, ends]), np.concatenate([(h >> np.uint64(2)).astype(np.int64) | 2, np.full(len(ends), END_WORD)])


def pow2(n: int) -> int:
    return 1 << max(0, n - 1).bit_length()


@lru_cache(2)
def powers(n: int) -> tuple[np.ndarray, np.ndarray]:
    return tuple(np.cumprod(np.concatenate([np.ones(1, np.uint64), np.full(n - 1, x)])) for x in (BASE, BASE_INVERSE))


def blocks(texts: list[bytes]) -> Iterator[Block]:
    """Blocks of about BLOCK bytes over lower-cased texts; longer texts in windows that end after white space."""
    waiting, size = [], 0
    for k, t in enumerate(texts):
        at, before = 0, bytes(ORDER)
        while True:
            stop = len(t)
            if stop - at > BLOCK and (m := CUT.search(t, at + BLOCK - 1)):
                stop = m.end()
            data = t[at:stop]
            waiting.append((k, before, data, stop == len(t)))
            size += len(data) + ORDER + 1
            if size >= BLOCK:
                yield Block(waiting)
                waiting, size = [], 0
            if stop == len(t):
                break
            before, at = (before + data[-ORDER:])[-ORDER:], stop
    if waiting:
        yield Block(waiting)


def summed(parts: list[tuple[np.ndarray, np.ndarray]]) -> tuple[np.ndarray, np.ndarray]:
    keys, counts = (np.concatenate(x) for x in zip(*parts))
    order = np.argsort(keys, kind="stable")
    keys, counts = keys[order], counts[order]
    first = np.flatnonzero(np.concatenate([np.ones(1, bool), keys[1:] != keys[:-1]]))
    return keys[first], np.add.reduceat(counts, first)


def counted(keys: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    keys = np.sort(keys)
    first = np.flatnonzero(np.concatenate([np.ones(1, bool), keys[1:] != keys[:-1]]))
    return keys[first], np.diff(np.append(first, len(keys)))


def packed(x: np.ndarray) -> bytes:
    """int64 numbers, best sorted ones: differences, by byte planes, compressed."""
    planes = np.diff(x, prepend=np.int64(0)).view(np.uint8).reshape(-1, 8).T
    return pa.Codec("zstd").compress(planes.tobytes(), asbytes=True)


def unpacked(data: bytes, n: int) -> np.ndarray:
    planes = np.frombuffer(pa.Codec("zstd").decompress(data, 8 * n, asbytes=True), np.uint8).reshape(8, n)
    return np.cumsum(np.ascontiguousarray(planes.T).view(np.int64).ravel())


def batches_of(rows: DataFrame, batch_bytes: int, scratch: Scratch) -> DataFrame:
    """batch, kind, n, data, counts. kind 0: a batch's n keys of full order, and how often training texts have
    them; kind 1: its words likewise; kind 2: some of its rows, as a compressed Arrow batch."""
    ensure_importable(rows.sparkSession)

    def run(found: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        holds("batches")
        number, size, parts, fresh = TaskContext.get().partitionId() << 24, 0, ([], []), [0, 0]

        def row(kind: int, n: int, data: bytes, counts: bytes | None) -> pa.RecordBatch:
            return pa.RecordBatch.from_arrays([pa.array([number], pa.int64()), pa.array([kind], pa.int32()), pa.array([n], pa.int64()), pa.array([data], pa.binary()), pa.array([counts], pa.binary())], ["batch", "kind", "n", "data", "counts"])

        def add(kind: int, keys: np.ndarray, train: np.ndarray) -> None:
            if len(keys):
                parts[kind].append(counted((keys << 1) | train))
                fresh[kind] += len(parts[kind][-1][0])
            if fresh[kind] > MERGED:
                parts[kind][:], fresh[kind] = [summed(parts[kind])], 0

        def close() -> Iterator[pa.RecordBatch]:
            for kind in (0, 1):
                if parts[kind]:
                    keys, n = summed(parts[kind])
                    first = np.flatnonzero(np.concatenate([np.ones(1, bool), keys[1:] >> 1 != keys[:-1] >> 1]))
                    yield row(kind, len(first), packed(keys[first] >> 1), packed(np.add.reduceat(n * (keys & 1), first)))
                parts[kind].clear()
                fresh[kind] = 0

        for b in (b.slice(at, 500) for b in found for at in range(0, b.num_rows, 500)):
            texts, train = b.column("text").to_pylist(), ~b.column("held_out").to_numpy(zero_copy_only=False)
            sink = pa.BufferOutputStream()
            with pa.ipc.new_stream(sink, b.schema, options=pa.ipc.IpcWriteOptions(compression="zstd")) as out:
                out.write_batch(b)
            yield row(2, b.num_rows, sink.getvalue().to_pybytes(), None)
            for block in blocks(texts):
                at, context, symbol = block.keys()
                own = train[block.docs].astype(np.int64)
                add(0, (context << SYMBOL_BITS) | symbol, own[np.searchsorted(block.starts, at, "right") - 1])
                at, words = block.all_words()
                add(1, words, own[np.searchsorted(block.starts, at, "right") - 1])
            size += sum(map(len, texts))
            if size >= batch_bytes:
                yield from close()
                number, size = number + 1, 0
        yield from close()

    return scratch.written_by(rows, run, "batch long, kind int, n long, data binary, counts binary", "batches")


def corpus_counts(batches: DataFrame) -> DataFrame:
    """(kind, key, n) of all training rows: kind 0 nodes of full order, kind 1 words."""

    def run(found: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in found:
            for kind, size, data, counts in zip(*(b.column(c).to_pylist() for c in ("kind", "n", "data", "counts"))):
                keys, n = unpacked(data, size), unpacked(counts, size)
                keys, n = keys[n > 0], n[n > 0]
                for at in range(0, len(keys), 100_000):
                    k = keys[at : at + 100_000]
                    yield pa.RecordBatch.from_arrays([pa.array(np.full(len(k), kind, np.int32)), pa.array(k), pa.array(n[at : at + 100_000])], ["kind", "key", "n"])

    rows = batches.where("kind < 2").select("kind", "n", "data", "counts").mapInArrow(run, "kind int, key long, n long")
    return rows.groupBy("kind", "key").agg(F.sum("n").alias("n"))


def _mask(bytes_: int) -> int:
    return (1 << (8 * bytes_)) - 1


def _slices(nodes: DataFrame, slice_nodes: int) -> tuple[int, list[tuple[int, dict[int, int]]]]:
    """Into how many slices the trie is cut, and for each length of suffixes the slice of those that are not split."""
    leaves, split, total = [], None, 0
    for depth in range(1, ORDER + 1):
        own = nodes.where(F.col("k") >= depth)
        if split is not None:
            above = nodes.sparkSession.createDataFrame([(x,) for x in split], "above long")
            own = own.join(F.broadcast(above), F.expr(f"ctx & {_mask(depth - 1)}") == F.col("above"))  # at most total / slice_nodes rows
        sizes = own.groupBy(F.expr(f"ctx & {_mask(depth)}").alias("suffix")).count().collect()  # 256 for each that is split
        split = [r["suffix"] for r in sizes if r["count"] > slice_nodes and depth < ORDER]
        leaves += [(r["count"], depth, r["suffix"]) for r in sizes if r["count"] <= slice_nodes or depth == ORDER]
        if not split:
            break
    total = sum(x[0] for x in leaves)
    loads = [(0, k) for k in range(max(1, -(-total // slice_nodes)))]
    of: dict[int, dict[int, int]] = {}
    for count, depth, suffix in sorted(leaves, reverse=True):  # to the slice that has the least so far
        load, k = heapq.heappop(loads)
        of.setdefault(depth, {})[suffix] = k
        heapq.heappush(loads, (load + count, k))
    return len(loads), sorted(of.items())


def _placed(df: DataFrame, leaves: list[tuple[int, dict[int, int]]]) -> DataFrame:
    """df (k, ctx) with the slice: that of the suffix that is not split, or -1 for all."""
    found = []
    for depth, of in leaves:
        table = df.sparkSession.createDataFrame(sorted(of.items()), f"suffix{depth} long, slice{depth} int")
        df = df.join(F.broadcast(table), (F.col("k") >= depth) & (F.expr(f"ctx & {_mask(depth)}") == F.col(f"suffix{depth}")), "left")
        found.append(F.col(f"slice{depth}"))
    return df.withColumn("slice", F.coalesce(*found, F.lit(-1)))


def build_model(batches: DataFrame, scratch: Scratch, slice_nodes: int = 1_000_000) -> dict:
    """Sums all training counts and writes the slices. What it returns fits in a closure: paths, totals and leaves."""
    counts = scratch.written(corpus_counts(batches), "ppm-counts")
    top = counts.where("kind = 0").select("key", "n")
    mask = "(shiftleft(1L, 8 * k) - 1)"
    cut = top.withColumn("k", F.explode(F.expr(f"sequence(0, {ORDER})")))
    cut = cut.select("k", F.expr(f"(((key >> {SYMBOL_BITS}) & {mask}) << {SYMBOL_BITS}) | (key & {(1 << SYMBOL_BITS) - 1})").alias("key"), "n")
    nodes = scratch.written(cut.groupBy("k", "key").agg(F.sum("n").alias("n")), "ppm-nodes").withColumn("ctx", F.expr(f"key >> {SYMBOL_BITS}"))
    contexts = scratch.written(nodes.groupBy("k", "ctx").agg(F.sum("n").alias("total"), F.count(F.lit(1)).alias("kinds")), "ppm-contexts")
    above = nodes.select((F.col("k") + 1).alias("k"), F.col("key").alias("up"), F.col("n").alias("up_n"))
    to_parent = F.expr(f"((ctx & (shiftleft(1L, 8 * (k - 1)) - 1)) << {SYMBOL_BITS}) | (key & {(1 << SYMBOL_BITS) - 1})")
    shared = nodes.where("k > 0").withColumn("up", to_parent).join(above, ["k", "up"]).groupBy("k", "ctx").agg(F.sum("up_n").alias("excluded"))
    parents = contexts.select((F.col("k") + 1).alias("k"), F.col("ctx").alias("up_ctx"), F.col("total").alias("up_total"), F.col("kinds").alias("up_kinds"))
    full = contexts.join(shared, ["k", "ctx"], "left").withColumn("up_ctx", F.expr("ctx & (shiftleft(1L, 8 * greatest(k - 1, 0)) - 1)")).join(parents, ["k", "up_ctx"], "left")
    slices, leaves = _slices(nodes, slice_nodes)
    place = F.expr("shiftleft(cast(k as bigint), 50)")
    path = f"{scratch.path}/model"
    totals = contexts.select("k", "ctx", "total", "kinds")
    out = _placed(nodes.join(totals, ["k", "ctx"]), leaves).select("slice", (place + F.col("key")).alias("id"), F.log10(F.col("n") / (F.col("total") + F.col("kinds"))).cast("float").alias("a"), F.col("n").cast("float").alias("b"))
    out.repartition(slices + 1, "slice").write.partitionBy("slice").parquet(f"{path}/nodes")
    more = _placed(full, leaves).select(
        "slice", (place + F.col("ctx")).alias("id"), F.log10(F.col("kinds") / (F.col("total") + F.col("kinds"))).alias("a"),
        (F.col("up_total") - F.col("excluded") + F.col("up_kinds") - F.col("kinds")).cast("double").alias("b"), (F.col("up_kinds") - F.col("kinds")).cast("double").alias("c"), F.col("kinds").cast("double").alias("d"),
    )
    more.repartition(slices + 1, "slice").write.partitionBy("slice").parquet(f"{path}/contexts")
    words = counts.where("kind = 1")
    row = words.agg(F.count(F.lit(1)).alias("v"), F.sum("n").alias("n")).first()
    word_slices = max(1, -(-row["v"] // slice_nodes))
    spread = words.select(F.pmod("key", F.lit(word_slices)).cast("int").alias("slice"), F.col("key").alias("id"), F.col("n").alias("a"))
    spread.repartition(word_slices, "slice").write.partitionBy("slice").parquet(f"{path}/words")
    for table in (counts, contexts):
        scratch.drop(table)
    of = [(depth, np.array(sorted(x), np.int64), np.array([x[k] for k in sorted(x)], np.int32)) for depth, x in leaves]
    return {"path": path, "slices": slices, "leaves": of, "word_slices": word_slices, "distinct": row["v"], "tokens": row["n"] or 0}


def slice_of(model: dict, kind: int, keys: np.ndarray) -> np.ndarray:
    if kind == 1:
        return keys % model["word_slices"]
    context, out = keys >> SYMBOL_BITS, np.zeros(len(keys), np.int32)  # a suffix that is new has its shorter contexts in every slice
    for depth, suffix, own in model["leaves"]:
        at = context & _mask(depth)
        place = np.minimum(np.searchsorted(suffix, at), len(suffix) - 1)
        out = np.where(suffix[place] == at, own[place], out)
    return out


class Table:
    """id -> values, by open addressing; lookups of whole arrays."""

    def __init__(self, ids: np.ndarray, *values: np.ndarray):
        self.bits = max(4, int(len(ids) * 1.6).bit_length())
        self.ids = np.full(1 << self.bits, -1, np.int64)
        at = self.home(ids)
        rows = np.full(1 << self.bits, 0, np.int32)
        left = np.arange(len(ids))
        while len(left):
            free = self.ids[at[left]] == -1
            self.ids[at[left[free]]] = ids[left[free]]  # of several, one stays
            settled = self.ids[at[left]] == ids[left]
            rows[at[left[settled]]] = left[settled]
            left = left[~settled]
            at[left] = (at[left] + 1) & (len(self.ids) - 1)
        self.values = [v[rows] for v in values] if len(ids) else [np.zeros(len(self.ids), v.dtype) for v in values]

    def home(self, ids: np.ndarray) -> np.ndarray:
        return ((ids.view(np.uint64) * np.uint64(0x9E3779B97F4A7C15)) >> np.uint64(64 - self.bits)).astype(np.int64)

    def find(self, ids: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Slots, and whether the id is there."""
        at = self.home(ids)
        got = self.ids[at]
        there = got == ids
        left = np.flatnonzero(~there & (got != -1))
        while len(left):
            at[left] = (at[left] + 1) & (len(self.ids) - 1)
            got = self.ids[at[left]]
            same = got == ids[left]
            there[left[same]] = True
            left = left[~same & (got != -1)]
        return at, there


def _read(path: str, columns: list[str], slices: list[int]) -> list[np.ndarray]:
    files, root = fs.FileSystem.from_uri(path)
    parts: list[list[np.ndarray]] = [[] for _ in columns]
    for s in slices:
        folder = f"{root}/slice={s}"
        if files.get_file_info(folder).type == fs.FileType.Directory:
            t = pa.dataset.dataset(folder, filesystem=files, format="parquet").to_table(columns=columns)
            for p, c in zip(parts, columns):
                p.append(t[c].to_numpy())
    out = [np.concatenate(p) if p else np.zeros(0, np.int64 if c == "id" else np.float64) for p, c in zip(parts, columns)]
    del parts
    pa.default_memory_pool().release_unused()
    return out


@lru_cache(1)
def trie_slice(path: str, k: int) -> tuple[Table, Table]:
    nodes = Table(*_read(f"{path}/nodes", ["id", "a", "b"], [-1, k]))
    ids, a, b, c, d = _read(f"{path}/contexts", ["id", "a", "b", "c", "d"], [-1, k])
    return nodes, Table(ids, a, np.nan_to_num(b), np.nan_to_num(c), d)


@lru_cache(1)
def word_slice(path: str, k: int) -> Table:
    return Table(*_read(f"{path}/words", ["id", "a"], [k]))


def symbol_scores(nodes: Table, contexts: Table, context: np.ndarray, symbol: np.ndarray) -> np.ndarray:
    """log10 of each symbol's probability after its context."""
    place = lambda k: np.int64(k) << 50
    at, there = nodes.find(place(ORDER) + ((context << SYMBOL_BITS) | symbol))
    out = np.where(there, nodes.values[0][at], 0).astype(np.float64)
    left = np.flatnonzero(~there)
    begun = np.zeros(len(left), bool)  # has a context been seen?
    room, fresh = np.ones(len(left)), np.zeros(len(left))  # of the context below after exclusion: all, and symbols not excluded
    unseen = np.full(len(left), END + 1.0)
    for k in range(ORDER, -1, -1):
        if not len(left):
            break
        c = context[left] & ((np.int64(1) << (8 * k)) - 1)
        node, seen = nodes.find(place(k) + ((c << SYMBOL_BITS) | symbol[left]))
        here, known = contexts.find(place(k) + c)
        first = known & ~begun
        later = begun & (fresh > 0)
        hit = seen & (first | later)
        gain = np.zeros(len(left))
        gain[first & seen] = nodes.values[0][node[first & seen]]
        gain[first & ~seen] = contexts.values[0][here[first & ~seen]]
        gain[later & seen] = np.log10(nodes.values[1][node[later & seen]] / room[later & seen])
        gain[later & ~seen] = np.log10(fresh[later & ~seen] / room[later & ~seen])
        out[left] += gain
        room = np.where(known, contexts.values[1][here], room)
        fresh = np.where(known, contexts.values[2][here], fresh)
        if k == 0:
            unseen = np.where(known, END + 1 - contexts.values[3][here], END + 1.0)
        begun |= known
        go = ~hit
        left, begun, room, fresh, unseen = left[go], begun[go], room[go], fresh[go], unseen[go]
    out[left] -= np.log10(np.maximum(unseen, 1))
    return out


def key_scores(batches: DataFrame, model: dict, group_keys: int = 3_000_000) -> DataFrame:
    """batch, kind (3 and 4, to kinds 0 and 1), n (the slice), data: log10 of each key's probability, each word's count."""
    rows = batches.where("kind < 2")
    groups = {r["kind"]: max(1, -(-r["keys"] // (group_keys * model[("slices", "word_slices")[r["kind"]]]))) for r in rows.groupBy("kind").agg(F.sum("n").alias("keys")).collect()}  # two rows

    def ask(found: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in found:
            for batch, kind, n, data in zip(*(b.column(c).to_pylist() for c in ("batch", "kind", "n", "data"))):
                keys = unpacked(data, n)
                which = slice_of(model, kind, keys)
                own = np.unique(which)
                parts = [keys[which == s] for s in own]
                fixed = lambda x: pa.array([x] * len(own), pa.int64())
                group = (batch * 0x9E3779B1 >> 8) % groups[kind]
                yield pa.RecordBatch.from_arrays([fixed(kind), fixed(group), pa.array(own, pa.int64()), fixed(batch), pa.array([len(x) for x in parts], pa.int64()), pa.array(map(packed, parts), pa.binary())], ["kind", "part", "slice", "batch", "n", "data"])

    def tell(t: pa.Table) -> pa.Table:
        kind, s = t["kind"][0].as_py(), t["slice"][0].as_py()
        holds(*(("words-slice", word_slice.cache_clear) if kind else ("trie-slice", trie_slice.cache_clear)))
        out = []
        for n, data in zip(t["n"].to_pylist(), t["data"].to_pylist()):
            keys = unpacked(data, n)
            if kind == 0:
                nodes, contexts = trie_slice(model["path"], s)
                got = [symbol_scores(nodes, contexts, k >> SYMBOL_BITS, k & ((1 << SYMBOL_BITS) - 1)) for k in np.split(keys, range(BLOCK, n, BLOCK))]
                out.append(packed(np.concatenate(got).view(np.int64)))
            else:
                table = word_slice(model["path"], s)
                at, there = table.find(keys)
                out.append(packed(np.where(there, table.values[0][at], 0)))
        return pa.table({"batch": t["batch"], "kind": pa.array([kind + 3] * len(out), pa.int32()), "n": t["slice"], "data": pa.array(out, pa.binary())})

    asked = rows.select("batch", "kind", "n", "data").mapInArrow(ask, "kind long, part long, slice long, batch long, n long, data binary")
    return asked.groupBy("kind", "slice", "part").applyInArrow(tell, "batch long, kind int, n long, data binary")


def score(batches: DataFrame, model: dict, kind: str) -> DataFrame:
    """doc_id (of type kind), held_out, n_tokens, n_known, train_tokens, base_score, score: each batch's rows by its keys' scores."""

    def finish(t: pa.Table) -> pa.Table:
        holds("finish")
        rows = {k: [] for k in range(5)}
        for k, n, data in zip(t["kind"].to_pylist(), t["n"].to_pylist(), t["data"].to_pylist()):
            rows[k].append((n, data))
        tables = []
        for k in (0, 1):
            keys = np.concatenate([unpacked(data, n) for n, data in rows[k]]) if rows[k] else np.zeros(0, np.int64)
            value, which = np.zeros(len(keys), np.int64), slice_of(model, k, keys)
            for s, data in rows[k + 3]:
                own = which == s
                value[own] = unpacked(data, int(own.sum()))
            tables.append(Table(keys, value if k else value.view(np.float64)))
        parts = [pa.ipc.open_stream(data).read_all() for _, data in rows[2]]
        got = [score_texts(model, *tables, p["text"].to_pylist()) for p in parts]
        whole = pa.concat_tables([p.select(["doc_id", "held_out"]) for p in parts])
        for name in ("n_tokens", "n_known", "train_tokens", "base_score", "score"):
            whole = whole.append_column(name, pa.array(np.concatenate([g[name] for g in got])))
        return whole

    both = batches.select("batch", "kind", "n", "data").unionByName(key_scores(batches, model))
    return both.groupBy("batch").applyInArrow(finish, f"doc_id {kind}, held_out boolean, n_tokens long, n_known long, train_tokens long, base_score double, score double")


def score_texts(model: dict, trie: Table, words: Table, texts: list[bytes]) -> dict[str, np.ndarray]:
    """Of lower-cased texts, all of whose keys the tables have."""
    n = len(texts)
    out = {"n_tokens": np.zeros(n, np.int64), "n_known": np.zeros(n, np.int64), "base_score": np.zeros(n), "score": np.zeros(n), "train_tokens": np.full(n, model["tokens"])}
    for block in blocks(texts):
        at, context, symbol = block.keys()
        place = lambda x, y: np.bincount(np.searchsorted(block.starts, x, "right") - 1, y, minlength=len(block.docs))
        np.add.at(out["score"], block.docs, place(at, trie.values[0][trie.find((context << SYMBOL_BITS) | symbol)[0]]))
        at, h = block.all_words()
        c = words.values[0][words.find(h)[0]]
        np.add.at(out["base_score"], block.docs, place(at, np.log10(c + 1)))
        for name, each in (("n_known", c > 0), ("n_tokens", np.ones(len(at)))):
            np.add.at(out[name], block.docs, place(at, each).astype(np.int64))
    out["base_score"] -= out["n_tokens"] * np.log10(model["tokens"] + model["distinct"] + 1)
    return out


def lower_binary(text):
    from tastemill.llm._common import ascii_lower

    return ascii_lower(F.coalesce(text, F.lit(""))).cast("binary")


def score_documents(docs: DataFrame, held_out, batch_bytes: int = 16 << 20, **options) -> DataFrame:
    """One row per row of docs; learns from the rows that are not held out."""
    scratch = Scratch(docs.sparkSession, "ppm")
    rows = docs.select("doc_id", held_out.alias("held_out"), lower_binary(F.col("text")).alias("text"))
    with arrow_rows(docs.sparkSession):
        batches = batches_of(rows, batch_bytes, scratch)
        model = build_model(batches, scratch, **options)
        out = written(score(batches, model, rows.schema["doc_id"].dataType.simpleString()), "ppm-scores")
    scratch.remove()
    return out
