"""Packing documents into sequences by minimum bin slack over the whole corpus.

Lengths are at most the sequence length, so the corpus is known by its histogram of lengths, with at most
`capacity` entries whatever its size. The plan is made from it: the longest remaining length opens a
sequence; a subset-sum dynamic programme, with bitsets of reachable sums, over the available lengths
finds the fullest feasible combination with it, which is removed as often as the histogram still has
it. Each step leaves some length too rare for its combination, so there are at most
capacity * (1 + ln capacity) steps, however many documents there are.

Then every piece gets its place without being gathered: pieces of one length are numbered by a
distributed running count (hash ranges, counts of ranges, numbers inside a range), and the number tells
the combination, its repetition and the place in it. A length that a third of all pieces have is
spread over all ranges.

Tokens: `WordEncoder` cuts a text of Latin letters, numbers and marks as the tokenizer does and has all its words merged in
one call, without remembering any. For other texts it asks the tokenizer once for every distinct white-space-delimited word;
that is exact for tokenizers that drop white space, and a text with control characters that Python and the tokenizer
do not both take for white space is encoded whole.

Defined cases: a null text is the empty text and gives one piece, the end id alone. Longer documents are cut
into pieces of `capacity`, the last may be shorter. Repeated rows are packed each. An empty table gives an
empty result. Other columns are not read."""

from __future__ import annotations

import json
import os
import re
import string
import sys
import zlib
from array import array
from collections.abc import Iterator
from functools import lru_cache

import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from tastemill.llm._common import Cache, Scratch, arrow_rows, ensure_importable, holds, pow2_at_least, small_table
from tastemill.llm.bpe import END, LATIN, LATIN_END, LETTERS, NUMBERS, SPLIT, core_of, ranks_of
from tastemill.llm.token_counts import byte_letters

CACHE_WORDS = 180_000
CACHE_TAILS = 10_000
MARKS = "".join(c for c in string.punctuation if c != "'")  # neither letters nor numbers, and no part of a contraction
ODD_SPACE = "\x1c\x1d\x1e\x1f"  # white space to Python alone
BLANKS = " \t\n\r"
#: What a tokenizer file says that lowers case and cuts words as PIECE does.
NORMALIZERS = [{"type": "NFC"}, {"type": "Replace", "pattern": {"Regex": r"\s+"}, "content": " "}, {"type": "Lowercase"}]
SPLITS = [
    {"type": "Split", "pattern": {"Regex": SPLIT + r"|[\p{L}]+|[\p{N}]|[^\s\p{L}\p{N}]+"}, "behavior": "Removed", "invert": True},
    {"type": "ByteLevel", "add_prefix_space": False, "trim_offsets": True, "use_regex": False},
]
PIECE = re.compile(f"{SPLIT}|[{LETTERS}]+|[{NUMBERS}]|[^{BLANKS}{LETTERS}{NUMBERS}]+")
OTHER = re.compile(f"[^{BLANKS}!-~{LATIN}]")  # characters of texts that are not cut by PIECE


class WordEncoder:
    """Texts to ids as little-endian unsigned 32-bit bytes, by way of words that are remembered."""

    def __init__(self, path: str):
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_file(path)
        self.tokenizer.no_truncation()
        self.tokenizer.no_padding()
        self.model = self.tokenizer.model
        self.letters = {b: c for b, c in byte_letters().items() if b >= 128 or chr(b) != c}
        if array("I").itemsize != 4 or sys.byteorder != "little":
            raise RuntimeError("unsigned 32-bit little-endian arrays are needed")
        self.words, self.tails = Cache(self.word, CACHE_WORDS), Cache(self.whole, CACHE_TAILS)
        self.special = [t.content for t in self.tokenizer.get_added_tokens_decoder().values()]
        with open(path, encoding="utf-8") as f:
            spec = json.load(f)
        as_cut = [(spec.get(k) or {}).get(v) for k, v in (("normalizer", "normalizers"), ("pre_tokenizer", "pretokenizers"))] == [NORMALIZERS, SPLITS]
        ranks = ranks_of(spec) if as_cut and spec["model"].get("end_of_word_suffix") else None
        self.merged = core_of(ranks, f"[^{END}]+{END}") if ranks else None
        for w in ("a", "the", "ueber", "\u00fcber", "\u0153uvre", "stra\u00dfe", "ni\u00f1o"):
            if self.words[w] != self.whole(w.upper() if w.isascii() else w):
                raise ValueError("the tokenizer does not lower case and cut words as this encoder expects")

    def whole(self, text: str) -> bytes:
        return array("I", self.tokenizer.encode(text, add_special_tokens=False).ids).tobytes()

    def word(self, w: str) -> bytes:
        """Words of Latin letters and then marks are learnt by their lower-case letters,
        as the tokenizer lowers case and cuts between letters and marks: its merges run on the bytes' letters. Other
        words go through all of the tokenizer. The constructor checks on samples that both ways agree."""
        stem = w.rstrip(MARKS)
        if stem.isalpha() and (stem.isascii() or max(stem) < LATIN_END and "\u0130" not in stem):
            low = stem.lower()
            letters = low if low.isascii() else low.encode().decode("latin-1").translate(self.letters)
            ids = array("I", [t.id for t in self.model.tokenize(letters)]).tobytes()
            return ids + self.tails[w[len(stem) :]] if len(stem) < len(w) else ids
        return self.whole(w)

    def at_once(self, text: str) -> bytes | None:
        """The ids of a text that PIECE cuts as the tokenizer does; None for others."""
        if not self.merged or OTHER.search(text) or any(s in text for s in self.special):
            return None
        pieces = PIECE.findall(text.lower())
        pieces.append("")  # the last piece ends like the others
        return bytes(self.merged(END.join(pieces)))

    def text(self, t: str) -> bytes:
        if (ids := self.at_once(t)) is not None:
            return ids
        return self.whole(t) if any(c in t for c in ODD_SPACE) else b"".join(map(self.words.__getitem__, t.split()))

    def encode(self, texts: list[str]) -> list[bytes]:
        return list(map(self.text, texts))


@lru_cache(2)
def encoder_of(path: str) -> WordEncoder:
    return WordEncoder(path)


def token_pieces(df: DataFrame, tokenizer: str, capacity: int = 2048, end_id: int = 0, id_col: str = "doc_id", text_col: str = "text", keep_ids: bool = False) -> DataFrame:
    """A written table with one row per piece: doc_id, piece, start, length, ids_crc32 and, if wanted, ids (little-endian u32 bytes)."""
    ensure_importable(df.sparkSession)
    kind = df.schema[id_col].dataType
    end, width = int(end_id).to_bytes(4, "little"), 4 * capacity
    schema = f"doc_id {kind.simpleString()}, piece int, start long, length long, ids_crc32 long" + ", ids binary" * keep_ids

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        holds("words", encoder_of.cache_clear)
        encoder = encoder_of(tokenizer)
        for b in batches:
            for at in range(0, b.num_rows, 256):
                part = b.slice(at, 256)
                coded = encoder.encode([x or "" for x in part.column("text").to_pylist()])
                rows, piece, start, length, crc, ids = [], [], [], [], [], []
                for k, data in enumerate(coded):
                    data += end
                    for p, lo in enumerate(range(0, len(data), width)):
                        cut = data[lo : lo + width]
                        rows.append(k)
                        piece.append(p)
                        start.append(lo // 4)
                        length.append(len(cut) // 4)
                        crc.append(zlib.crc32(cut))
                        if keep_ids:
                            ids.append(cut)
                out = [part.column("id").take(pa.array(rows, pa.int32())), pa.array(piece, pa.int32()), pa.array(start, pa.int64()), pa.array(length, pa.int64()), pa.array(crc, pa.int64())]
                names = ["doc_id", "piece", "start", "length", "ids_crc32"] + ["ids"] * keep_ids
                yield pa.RecordBatch.from_arrays(out + [pa.array(ids, pa.binary())] * keep_ids, names)

    texts = df.select(F.col(id_col).alias("id"), F.col(text_col).alias("text"))
    with arrow_rows(df.sparkSession):
        return Scratch(df.sparkSession, "packing").written_by(texts, run, schema, "pieces")


def fullest(counts: dict[int, int], room: int) -> list[int]:
    """Lengths, longest first, with the largest sum of at most room; at most counts[length] of each."""
    full = (1 << (room + 1)) - 1
    reach, layers = 1, []
    for length in sorted((x for x in counts if x <= room and counts[x] > 0), reverse=True):
        left = min(counts[length], room // length)
        before, times = reach, 1
        while left > 0:  # 1, 2, 4, ... and the rest: any number up to the count
            times = min(times, left)
            reach |= (reach << (length * times)) & full
            left -= times
            times *= 2
        layers.append((length, before))
        if reach >> room & 1:
            break
    at, chosen = reach.bit_length() - 1, []
    for length, before in reversed(layers):
        while not before >> at & 1:
            chosen.append(length)
            at -= length
    return sorted(chosen, reverse=True)


def packing_plan(histogram: dict[int, int], capacity: int) -> list[tuple[tuple[int, ...], int]]:
    """(lengths of a sequence, number of such sequences)."""
    counts, plan = {k: v for k, v in histogram.items() if v > 0}, []
    while counts:
        first = max(counts)
        counts[first] -= 1
        combination = (first, *fullest(counts, capacity - first))
        counts[first] += 1
        uses = {x: combination.count(x) for x in combination}
        times = min(counts[x] // n for x, n in uses.items())
        plan.append((combination, times))
        for x, n in uses.items():
            counts[x] -= n * times
            if not counts[x]:
                del counts[x]
    return plan


def plan_rows(plan: list[tuple[tuple[int, ...], int]]) -> list[tuple[int, int, int, int, int, int]]:
    """(length, first number, end number, first sequence, pieces of that length in a sequence, offset of the first)."""
    taken: dict[int, int] = {}
    rows, sequence = [], 0
    for combination, times in plan:
        offset = 0
        for x in dict.fromkeys(combination):
            n = combination.count(x)
            begin = taken.get(x, 0)
            taken[x] = begin + n * times
            rows.append((x, begin, taken[x], sequence, n, offset))
            offset += n * x
        sequence += times
    return rows


def pack(pieces: DataFrame, capacity: int = 2048) -> DataFrame:
    """pieces (with doc_id, piece, length, ids_crc32; read three times) and sequence_id, offset."""
    spark = pieces.sparkSession
    lengths = pieces.groupBy("length").count().collect()  # at most `capacity` rows
    rows = plan_rows(packing_plan({r["length"]: r["count"] for r in lengths}, capacity))
    plan = F.broadcast(small_table(spark, rows, "len long, begin long, end long, first_sequence long, n long, first_offset long"))
    total = sum(r["count"] for r in lengths)
    ranges = min(16384, pow2_at_least(max(1, total) / 512))
    dealt = pieces.withColumn("range", F.pmod(F.xxhash64("doc_id", "piece", "ids_crc32"), F.lit(ranges)))
    counts = dealt.groupBy("length", "range").agg(F.count(F.lit(1)).alias("in_range"))
    before = Window.partitionBy("length").orderBy("range").rowsBetween(Window.unboundedPreceding, -1)
    starts = counts.select("length", "range", F.coalesce(F.sum("in_range").over(before), F.lit(0)).alias("range_start"))
    inside = Window.partitionBy("length", "range").orderBy("doc_id", "piece", "ids_crc32")
    numbered = dealt.withColumn("inside", F.row_number().over(inside) - 1).join(starts, ["length", "range"])
    numbered = numbered.withColumn("number", F.col("range_start") + F.col("inside"))
    placed = numbered.join(plan, (F.col("length") == F.col("len")) & (F.col("number") >= F.col("begin")) & (F.col("number") < F.col("end")))
    at = F.col("number") - F.col("begin")
    return placed.select(
        *pieces.columns,
        (F.col("first_sequence") + F.expr("(number - begin) div n")).alias("sequence_id"),
        (F.col("first_offset") + (at % F.col("n")) * F.col("length")).alias("offset"),
    )


def pack_documents(df: DataFrame, tokenizer: str, capacity: int = 2048, **options) -> DataFrame:
    """Tokenises once into a written table, then packs."""
    return pack(token_pieces(df, tokenizer, capacity, **options), capacity)
