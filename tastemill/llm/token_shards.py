"""Token sequences in training order, as binary shards of fixed stride.

Every text is tokenised (end id appended) and cut into sequences of at most `length` ids. Sequences are
numbered 0 to n - 1 by the hash of their document's id and ids, so the order follows from the rows and not from how
they are dealt to tasks. A keyed Feistel network over pairs (n is covered by a square of side ceil(sqrt n),
rounds add modulo the side) permutes the numbers; where its value is n or more it is applied again
(cycle-walking), so the result is a permutation of 0 to n - 1: the global slot. It needs no state and can be inverted.

Slots are cut into ranges of `per_shard`; each range is one file, written by the one partition that its sequences,
compressed, are dealt to. A record has a fixed stride of `length` ids, padded with the end id, so slot s lies at
byte (s % per_shard) * stride of shard s // per_shard: sequential reads, and resuming at any slot, need no index.
The shards are written in WAVES passes over the stored documents, each of which deals the sequences of its own shards, so
that no more than that part of the ids is on its way at a time.
A task holds one shard at a time. A file is written under a temporary name and then renamed, over a file of that name
if there is one; its bytes follow from the rows and the key alone, so a task that runs again writes the same file.

Defined cases: a null text is the empty text and gives one sequence, the end id. Repeated rows are written each;
rows equal in id and text have the same ids, so it does not matter which of them is numbered first. An empty table
gives an empty result and no files. Other columns are not read."""

from __future__ import annotations

import json
import os
import re
import sys
import uuid
import zlib
from array import array
from collections.abc import Callable, Iterator
from functools import lru_cache, partial, reduce

import numpy as np
import pyarrow as pa
import pyarrow.dataset
from pyarrow import fs
from pyspark import TaskContext
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from tastemill.llm._common import Cache, Scratch, arrow_rows, ensure_importable, holds, pow2_at_least, shuffles_removed, written
from tastemill.llm.bpe import LATIN, LATIN_END, SPLIT, core_of, ranks_of
from tastemill.llm.packing import MARKS
from tastemill.llm.token_counts import SPACE, byte_letters
from tastemill.sources.shared import new_path

ROUNDS = 6
CACHED = 700_000  # words
LEVEL = 3  # of compression of whole documents, and on the way to the shards
WAVES = 2
DEALT = 32 << 20  # bytes of ids that a task deals to the shards at a time
PLAIN = SPLIT + r"| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s"  # byte-level BPE's pieces, where no white space follows another
OTHER = re.compile(f"[^ \n!-~{LATIN}]")  # characters of texts that are not cut by PLAIN


def _mixed(x: np.ndarray, key: int) -> np.ndarray:
    x = x.astype(np.uint64) + np.uint64(key % (1 << 64))
    for m in (0xBF58476D1CE4E5B9, 0x94D049BB133111EB):
        x = (x ^ (x >> np.uint64(29))) * np.uint64(m)
    return x ^ (x >> np.uint64(32))


def round_keys(key: str) -> list[int]:
    import hashlib

    return [int.from_bytes(hashlib.sha256(f"{key}:{r}".encode()).digest()[:8], "little") for r in range(ROUNDS)]


def feistel(x: np.ndarray, n: int, key: str) -> np.ndarray:
    """The permutation of 0 to n - 1, of an array."""
    side = max(1, int(np.ceil(np.sqrt(n))))
    side += side * side < n
    keys, out = round_keys(key), np.asarray(x, np.int64).copy()
    left = np.arange(len(out))
    while len(left):
        a, b = out[left] // side, out[left] % side
        for k in keys:
            a, b = b, (a + (_mixed(b, k) % np.uint64(side)).astype(np.int64)) % side
        out[left] = a * side + b
        left = left[out[left] >= n]
    return out


def unfeistel(y: np.ndarray, n: int, key: str) -> np.ndarray:
    side = max(1, int(np.ceil(np.sqrt(n))))
    side += side * side < n
    keys, out = round_keys(key)[::-1], np.asarray(y, np.int64).copy()
    left = np.arange(len(out))
    while len(left):
        a, b = out[left] // side, out[left] % side
        for k in keys:
            a, b = (b - (_mixed(a, k) % np.uint64(side)).astype(np.int64)) % side, a
        out[left] = a * side + b
        left = left[out[left] >= n]
    return out


def merger(tokenizer) -> Callable[[str], list[int]]:
    """Ids of one piece of text by the tokenizer's own library."""
    table = {b: c for b, c in byte_letters().items() if chr(b) != c}
    return lambda text: [t.id for t in tokenizer.model.tokenize(text.encode().decode("latin-1").translate(table))]


class ChunkEncoder:
    """Texts to ids as little-endian bytes of the given width: in one call, or by way of chunks that are remembered.

    A text of Latin letters, numbers and marks whose words stand after one blank or one line feed is cut by PLAIN as the
    tokenizer cuts it, and all its pieces are merged in one call, without remembering any. For others: no token of
    byte-level BPE crosses from a chunk (white space and what follows it) to the next one, so the chunks' ids joined are
    the text's. Where words stand after one blank or one line feed, no pattern is needed to find them."""

    def __init__(self, path: str, width: int):
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        from tokenizers import Tokenizer

        self.tokenizer, self.kind = Tokenizer.from_file(path), {2: "H", 4: "I"}[width]
        if array(self.kind).itemsize != width or sys.byteorder != "little":
            raise RuntimeError("little-endian arrays of the wanted width are needed")
        with open(path, encoding="utf-8") as f:
            spec = json.load(f)
        cut = spec.get("pre_tokenizer") or {}
        as_cut = spec.get("normalizer") is None and [cut.get(k) for k in ("type", "add_prefix_space", "use_regex")] == ["ByteLevel", False, True]
        ranks = None if spec["model"].get("end_of_word_suffix") else ranks_of(spec)
        self.merged = core_of(ranks, PLAIN) if ranks else None
        self.at_once = as_cut and ranks is not None and max(ranks.values()) < 1 << 8 * width
        self.merge = (lambda piece: memoryview(self.merged(piece)).cast("B").cast("I").tolist()) if ranks else merger(self.tokenizer)
        self.chunk_re = re.compile(f"[{SPACE}]*[^{SPACE}]+|[{SPACE}]+")
        self.special = [t.content for t in self.tokenizer.get_added_tokens_decoder().values()]
        self.marks, self.words, self.chunks = (Cache(learn, CACHED) for learn in (self._whole, self._word, self._whole))
        self.line_feed = self._whole("\n")
        for w in (" the", "the", " \u00fcber", " ni\u00f1o,", "a b\nc d", "x!!.\ny"):
            if self._by_words(w) != self._whole(w):
                raise ValueError("the tokenizer does not cut words as this encoder expects")

    def _whole(self, text: str) -> bytes:
        return array(self.kind, self.tokenizer.encode(text, add_special_tokens=False).ids).tobytes()

    def _word(self, w: str) -> bytes:
        """A word after a blank, or marked as after a line feed ("\\n") or as the text's first ("\\0").

        Latin letters and then marks are one piece or two, so the merges alone give their ids; other words go
        through all of the tokenizer."""
        if w.isascii() and w.isalpha():
            return array(self.kind, self.merge(" " + w)).tobytes()
        before, blank = b"", " "
        if w[:1] in ("\n", "\0"):
            before, blank, w = self.line_feed if w[0] == "\n" else b"", "", w[1:]
        stem = w.rstrip(MARKS)
        if not stem.isalpha() or not stem.isascii() and max(stem) >= LATIN_END:
            return before + self._whole(blank + w)
        ids = before + array(self.kind, self.merge(blank + stem)).tobytes()
        return ids + self.marks[w[len(stem) :]] if len(stem) < len(w) else ids

    def _by_words(self, text: str) -> bytes:
        return b"".join(map(self.words.__getitem__, ("\0" + text.replace("\n", " \n")).split(" ")))

    def _plain(self, t: str) -> bool:
        """Is all its white space single blanks and line feeds between words?"""
        if "  " in t or "\n\n" in t or "\n " in t or " \n" in t or t[:1] in " \n" or t[-1] in " \n":
            return False
        return t.replace("\n", "").isprintable()

    def encode(self, text: str) -> bytes:
        if any(s in text for s in self.special):
            return self._whole(text)
        if not self._plain(text):
            return b"".join(map(self.chunks.__getitem__, self.chunk_re.findall(text)))
        return self._merged(text) if self.at_once and not OTHER.search(text) else self._by_words(text)

    def _merged(self, text: str) -> bytes:
        ids = self.merged(text)
        return bytes(ids) if self.kind == "I" else np.frombuffer(ids, np.uint32).astype(np.uint16).tobytes()


@lru_cache(2)
def encoder_of(path: str, width: int) -> ChunkEncoder:
    return ChunkEncoder(path, width)


def token_documents(df: DataFrame, tokenizer: str, end_id: int, width: int, id_col: str, text_col: str, scratch: Scratch) -> DataFrame:
    """doc_id, crc (of all ids), size (bytes) and ids (the end id last), task, place: where the row came in the scan."""
    ensure_importable(df.sparkSession)
    kind = df.schema[id_col].dataType.simpleString()
    end = int(end_id).to_bytes(width, "little")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        holds("chunks", encoder_of.cache_clear)
        encoder, task, place = encoder_of(tokenizer, width), TaskContext.get().partitionId(), 0
        for b in batches:
            ids = [encoder.encode(x or "") + end for x in b.column("text").to_pylist()]
            n = len(ids)
            columns = [b.column("id"), pa.array(map(zlib.crc32, ids), pa.int64()), pa.array(map(len, ids), pa.int64()), pa.array(ids, pa.binary()), pa.array(np.full(n, task, np.int32)), pa.array(np.arange(place, place + n))]
            yield pa.RecordBatch.from_arrays(columns, ["doc_id", "crc", "size", "ids", "task", "place"])
            place += n

    texts = df.select(F.col(id_col).alias("id"), F.col(text_col).alias("text"))
    return scratch.written_by(texts, run, f"doc_id {kind}, crc long, size long, ids binary, task int, place long", "documents", LEVEL)


def first_numbers(documents: DataFrame, stride: int, to: str) -> int:
    """Numbers all sequences by (hash of id and ids, id) of their documents. Returns how many there are.

    The first number of each document is written under `to`, a folder for each task of the scan, in the order of its
    rows: what reads the documents again takes them from there, and no ids move for the numbering. Documents are
    counted by range of the hash; the ranges are summed up (at most 16,384 rows) and then numbered each by itself."""
    n = F.ceil(F.col("size") / F.lit(stride)).cast("long")
    rows = documents.select("doc_id", "crc", "task", "place", n.alias("n"), F.xxhash64("doc_id", "crc").alias("h"))
    ranges = min(16384, pow2_at_least(max(1, documents.count()) / 512))
    rows = rows.withColumn("range", F.pmod("h", F.lit(ranges)))
    sums = rows.groupBy("range").agg(F.sum("n").alias("in_range"))
    before = lambda w: w.rowsBetween(Window.unboundedPreceding, -1)
    starts = sums.select("range", F.coalesce(F.sum("in_range").over(before(Window.orderBy("range"))), F.lit(0)).alias("range_start"))
    inside = F.coalesce(F.sum("n").over(before(Window.partitionBy("range").orderBy("h", "doc_id", "crc"))), F.lit(0))
    numbered = rows.withColumn("inside", inside).join(F.broadcast(starts), "range").select("task", "place", (F.col("range_start") + F.col("inside")).alias("first"))
    numbered.repartition("task").sortWithinPartitions("task", "place").write.partitionBy("task").parquet(to)
    return rows.agg(F.sum("n")).first()[0] or 0


def write_shards(df: DataFrame, tokenizer: str, key: str, length: int = 256, end_id: int = 50256, width: int = 2, per_shard: int = 16384, to: str | None = None, id_col: str = "doc_id", text_col: str = "text", most_partitions: int = 20_000) -> DataFrame:
    """Writes the shards under `to` (a folder that all executors reach; by default a new one in the shared folder).

    One row per sequence: doc_id, piece, n_tokens, slot, shard, byte_offset, ids_crc32, and the shard's file."""
    spark = df.sparkSession
    to = to or new_path(spark, "shards")
    scratch = Scratch(spark, "token-shards")
    stride, pad = length * width, int(end_id).to_bytes(width, "little")
    with arrow_rows(spark), shuffles_removed(spark):
        documents = token_documents(df, tokenizer, end_id, width, id_col, text_col, scratch)
        firsts = f"{scratch.path}/first-numbers"
        total = first_numbers(documents, stride, firsts)
        kind = documents.schema["doc_id"].dataType.simpleString()
        shards = max(1, -(-total // per_shard))
        together = -(-shards // most_partitions)  # shards that one partition writes one after the other
        per_part = per_shard * together

        def place(batches: Iterator[pa.RecordBatch], low: int, high: int) -> Iterator[pa.RecordBatch]:
            """The sequences of partitions low to high - 1."""
            holds("shards")
            held, size, task, first = [], 0, None, np.zeros(0, np.int64)

            def deal() -> Iterator[pa.RecordBatch]:
                """What goes to each shard, its ids compressed."""
                number = np.concatenate([np.arange(f, f + -(-len(x) // stride)) for _, x, f in held])
                piece = np.concatenate([np.arange(-(-len(x) // stride), dtype=np.int32) for _, x, _ in held])
                row = np.repeat(np.arange(len(held)), [-(-len(x) // stride) for _, x, _ in held])
                slot = feistel(number, total, key)
                mine = np.flatnonzero((slot >= low * per_part) & (slot < high * per_part))
                order = mine[np.argsort(slot[mine], kind="stable")]
                ids = pa.array([d for d, _, _ in held], b.schema.field("doc_id").type)
                for own in np.split(order, np.flatnonzero(np.diff(slot[order] // per_shard)) + 1) if len(order) else ():
                    parts = [held[r][1][p * stride : (p + 1) * stride] for r, p in zip(row[own].tolist(), piece[own].tolist())]
                    sizes = np.array([len(x) // width for x in parts], np.int32)
                    crc = np.array([zlib.crc32(x) for x in parts], np.uint32)
                    doc_ids = pa.ListArray.from_arrays(pa.array([0, len(own)], pa.int32()), ids.take(pa.array(row[own])))
                    columns = [pa.array([x], pa.binary()) for x in (piece[own].tobytes(), sizes.tobytes(), slot[own].tobytes(), crc.tobytes(), pa.Codec("zstd", compression_level=LEVEL).compress(b"".join(parts), asbytes=True))]
                    yield pa.RecordBatch.from_arrays([pa.array([int(slot[own[0]] // per_shard)], pa.int64()), doc_ids, *columns], ["shard", "doc_ids", "pieces", "sizes", "slots", "crcs", "ids"])

            for b in batches:
                for d, x, t, p in zip(*(b.column(c).to_pylist() for c in ("doc_id", "ids", "task", "place"))):
                    if t != task:
                        task, first = t, read_firsts(firsts, t)
                    held.append((d, x, int(first[p])))
                    size += len(x)
                    if size >= DEALT:
                        yield from deal()
                        held, size = [], 0
            if held:
                yield from deal()

        def write(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            files, root = fs.FileSystem.from_uri(to)
            shard, held = -1, []

            def close() -> pa.RecordBatch:
                piece, sizes, slot, crc = (np.frombuffer(b"".join(x[k] for x in held), t) for k, t in ((1, np.int32), (2, np.int32), (3, np.int64), (4, np.uint32)))
                flat = [pa.Codec("zstd").decompress(x[5], int(np.frombuffer(x[2], np.int32).sum()) * width, asbytes=True) for x in held]
                ends = [np.cumsum(np.frombuffer(x[2], np.int32)) * width for x in held]
                rows = [data[e - n * width : e] for data, end, x in zip(flat, ends, held) for e, n in zip(end.tolist(), np.frombuffer(x[2], np.int32).tolist())]
                order = np.argsort(slot)
                name, temporary = f"{root}/shard-{shard:08d}.bin", f"{root}/.{uuid.uuid4().hex}.tmp"
                files.create_dir(root, recursive=True)
                with files.open_output_stream(temporary) as out:
                    out.write(b"".join([rows[r] + pad * (length - len(rows[r]) // width) for r in order.tolist()]))
                files.move(temporary, name)  # in place of what a lost task wrote: the same bytes
                n = len(order)
                doc_id = pa.concat_arrays([x[0] for x in held]).take(pa.array(order))
                columns = [piece[order], sizes[order], slot[order], np.full(n, shard), slot[order] % per_shard * stride, crc[order].astype(np.int64)]
                return pa.RecordBatch.from_arrays([doc_id, *map(pa.array, columns), pa.array([f"shard-{shard:08d}.bin"] * n)], ["doc_id", "piece", "n_tokens", "slot", "shard", "byte_offset", "ids_crc32", "file"])

            for b in batches:
                rest = list(zip(*(b.column(c).to_pylist() for c in ("pieces", "sizes", "slots", "crcs", "ids"))))
                for k, s in enumerate(b.column("shard").to_pylist()):
                    if s != shard and held:
                        yield close()
                        held = []
                    shard = s
                    held.append((b.column("doc_ids").slice(k, 1).flatten(), *rest[k]))
            if held:
                yield close()

        parts = -(-shards // together)
        cuts = [parts * w // WAVES for w in range(WAVES + 1)]
        indexes = []
        for low, high in [x for x in zip(cuts, cuts[1:]) if x[0] < x[1]]:
            dealt = documents.select("doc_id", "ids", "task", "place").mapInArrow(partial(place, low=low, high=high), f"shard long, doc_ids array<{kind}>, pieces binary, sizes binary, slots binary, crcs binary, ids binary")
            ranged = dealt.repartitionById(high - low, F.floor(F.col("shard") / together).cast("int") - low).sortWithinPartitions("shard")
            rows = ranged.mapInArrow(write, f"doc_id {kind}, piece int, n_tokens int, slot long, shard long, byte_offset long, ids_crc32 long, file string")
            indexes.append(written(rows.withColumn("file", F.concat(F.lit(f"{to}/"), F.col("file"))), "shard-index"))  # the files exist when this returns
        index = reduce(DataFrame.unionByName, indexes)
    scratch.remove()
    return index


def read_firsts(folder: str, task: int) -> np.ndarray:
    files, root = fs.FileSystem.from_uri(folder)
    return pa.dataset.dataset(f"{root}/task={task}", filesystem=files, format="parquet").to_table(columns=["first"])["first"].to_numpy()


def read_slots(to: str, first: int, count: int, length: int = 256, width: int = 2, per_shard: int = 16384) -> Iterator[np.ndarray]:
    """Records of slots first, first + 1, ...: a sequential read that can start anywhere."""
    files, root = fs.FileSystem.from_uri(to)
    stride, slot = length * width, first
    while slot < first + count:
        with files.open_input_file(f"{root}/shard-{slot // per_shard:08d}.bin") as f:
            f.seek(slot % per_shard * stride)
            n = min(first + count - slot, per_shard - slot % per_shard)
            data = f.read(n * stride)
        yield from np.frombuffer(data, f"<u{width}").reshape(-1, length)
        slot += n
