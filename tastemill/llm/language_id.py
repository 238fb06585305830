"""Language identification by bit-sliced Bloom filters over byte n-grams.

Training counts the 4-byte n-grams of every language over all training rows. A language contains an
n-gram whose share of the language's n-grams is at least `min_share`, and at least `contrast` times the share
that any other language gives it (so a stray foreign passage does not enter a filter). All filters lie
in one array: slot s holds a bit mask with one bit per language; an n-gram sets its language's bit in
`HASHES` slots. One lookup, the AND of those slots, returns all languages containing the n-gram. Per document
and language the set bits are counted and corrected for the filter's false positives (its share of
set bits to the power HASHES); the largest count decides.

Bounds: at most 1 / min_share n-grams per language enter the filters, whatever the size of the corpus, so the table
that reaches the driver has at most languages / min_share rows, and the array that is broadcast 16 slots a row (`slots`
at least). The counting itself covers all training rows. min_share = contrast = 0 leaves no n-gram out; the
table then has as many rows as there are different n-grams of a language.

Defined cases: a text that is null or has no letter gets `und` and score 0; without training rows every text
does. Ties go to the first language in code point order. Very long texts are read in windows, wholly. Texts
with letters but less than 4 bytes are padded with blanks. Repeated rows and null ids are judged row by row; an empty
table gives an empty result; other columns are not read by the prediction."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tastemill.llm._common import Scratch, ensure_importable, give_back, holds, pow2_at_least, small_table

HASHES = 3
WINDOW = 1 << 20  # bytes that are looked up at once
#: ASCII other than letters becomes a blank; letters of other scripts stay as their bytes.
BLANKED = bytes(b if b >= 128 or chr(b).isalpha() else 32 for b in range(256))
#: Odd multipliers that spread n-grams over slots; any would do.
MULTIPLIERS = (0x9E3779B97F4A7C15, 0xC2B2AE3D27D4EB4F, 0x165667B19E3779F9)


def prepared(text: str) -> bytes:
    return b" " + text.lower().encode("utf-8", "surrogatepass").translate(BLANKED) + b"  "


def grams(data: bytes) -> np.ndarray:
    """All 4-byte n-grams of data as unsigned 32-bit numbers."""
    b = np.frombuffer(data, np.uint8).astype(np.uint32)
    pair = (b[:-1] << np.uint32(8)) | b[1:]
    return (pair[:-2] << np.uint32(16)) | pair[2:]


def slots_of(g: np.ndarray, slots: int) -> list[np.ndarray]:
    g = g.astype(np.uint64) + np.uint64(1)
    shift = np.uint64(64 - (slots.bit_length() - 1))
    return [((g * np.uint64(m)) >> shift).astype(np.int64) for m in MULTIPLIERS[:HASHES]]


def count_grams(train: DataFrame) -> DataFrame:
    """(lang, gram, n) of (text, lang) rows. Each task sums its own counts first."""
    ensure_importable(train.sparkSession)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        holds("grams")
        found: dict[str, tuple[np.ndarray, np.ndarray]] = {}

        def add(lang: str, parts: list[bytes]) -> None:
            g, n = np.unique(grams(b"".join(parts)), return_counts=True)
            if lang in found:
                g, at = np.unique(np.concatenate([found[lang][0], g]), return_inverse=True)
                n = np.bincount(at, np.concatenate([found[lang][1], n])).astype(np.int64)
            found[lang] = (g, n.astype(np.int64))

        waiting: dict[str, list[bytes]] = {}
        size: dict[str, int] = {}
        for b in batches:
            for text, lang in zip(b.column("text"), b.column("lang").to_pylist()):
                data = prepared(text.as_py())
                waiting.setdefault(lang, []).append(data)
                size[lang] = size.get(lang, 0) + len(data)
                if size[lang] >= 4 * WINDOW:
                    add(lang, waiting.pop(lang))
                    size[lang] = 0
        for lang, parts in waiting.items():
            add(lang, parts)
        for lang, (g, n) in found.items():
            for at in range(0, len(g), 100_000):
                k = len(g[at : at + 100_000])
                yield pa.RecordBatch.from_arrays([pa.array([lang] * k, pa.string()), pa.array(g[at : at + k].astype(np.int64)), pa.array(n[at : at + k])], ["lang", "gram", "n"])

    rows = train.select("text", "lang").where("text is not null and lang is not null")
    return rows.mapInArrow(run, "lang string, gram long, n long").groupBy("lang", "gram").agg(F.sum("n").alias("n"))


class Filters:
    """The bit-sliced array: masks[slot, word] has bit l % 64 of word l // 64 set for language l."""

    def __init__(self, languages: list[str], slots: int):
        self.languages = languages
        self.masks = np.zeros((slots, max(1, -(-len(languages) // 64))), np.uint64)
        self.false = np.zeros(len(languages))

    def add(self, g: np.ndarray, lang: np.ndarray) -> None:
        bit = np.left_shift(np.uint64(1), (lang % 64).astype(np.uint64))
        for s in slots_of(g, len(self.masks)):
            np.bitwise_or.at(self.masks, (s, lang // 64), bit)

    def close(self) -> None:
        """Rates of false positives: the share of slots that have the bit, for each hash."""
        for k in range(len(self.languages)):
            self.false[k] = ((self.masks[:, k // 64] >> np.uint64(k % 64)) & np.uint64(1)).mean() ** HASHES

    def hits(self, data: bytes) -> tuple[int, np.ndarray]:
        """n-grams with a letter, and how many of them each language contains (false positives included)."""
        total, out = 0, np.zeros(len(self.languages), np.int64)
        for at in range(0, max(1, len(data) - 3), WINDOW):
            g = grams(data[at : at + WINDOW + 3])
            g = g[g != 0x20202020]
            if not len(g):
                continue
            total += len(g)
            a, b, c = slots_of(g, len(self.masks))
            if len(self.languages) <= 12:
                m = self.masks[:, 0]
                seen = np.bincount((m[a] & m[b] & m[c]).astype(np.int64), minlength=1 << len(self.languages))
                which = np.arange(len(seen))
                out += [int(seen[(which >> k) & 1 == 1].sum()) for k in range(len(self.languages))]
            else:
                bits = np.unpackbits((self.masks[a] & self.masks[b] & self.masks[c]).view(np.uint8), axis=1, bitorder="little")
                out += bits.sum(axis=0, dtype=np.int64)[: len(self.languages)]
        return total, out

    def decide(self, text: str | None) -> tuple[str, float]:
        """Language and the corrected share of the text's n-grams that its filter contains."""
        if not text or not self.languages or not any(map(str.isalpha, text)):
            return "und", 0.0
        total, hits = self.hits(prepared(text))
        if not total:
            return "und", 0.0
        real = (hits - total * self.false) / np.maximum(1 - self.false, 1e-9)
        best = int(np.argmax(real))
        return self.languages[best], float(min(1.0, max(0.0, real[best] / total)))


def train_filters(train: DataFrame, slots: int = 1 << 21, min_share: float = 1e-5, contrast: float = 0.2) -> Filters:
    """train: (text, lang). Nulls in either are left out. slots: at least so many (a power of two)."""
    scratch = Scratch(train.sparkSession, "language-id")
    counts = scratch.written(count_grams(train), "gram-counts")
    totals = {r["lang"]: r["total"] for r in counts.groupBy("lang").agg(F.sum("n").alias("total")).collect()}  # one row a language
    if not totals:
        scratch.remove()
        return Filters([], slots)
    total = F.broadcast(small_table(train.sparkSession, list(totals.items()), "lang string, total long"))
    shares = counts.join(total, "lang").select("gram", "lang", (F.col("n") / F.col("total")).alias("share")).where(F.col("share") >= min_share)
    own = shares.groupBy("gram").agg(F.max("share").alias("most"), F.collect_list(F.struct("lang", "share")).alias("each"))  # at most one entry a language
    kept = own.select("gram", F.explode("each").alias("e"), "most").where(F.col("e.share") >= contrast * F.col("most")).select("gram", "e.lang")
    rows = kept.toArrow()  # at most languages / min_share
    scratch.remove()
    filters = Filters(sorted(totals), max(slots, pow2_at_least(16 * rows.num_rows)))
    code = {k: i for i, k in enumerate(filters.languages)}
    filters.add(rows["gram"].to_numpy(), np.array([code[x] for x in rows["lang"].to_pylist()], np.int64))
    filters.close()
    return filters


def predict(df: DataFrame, filters: Filters, text_col: str = "text", **outputs: str) -> DataFrame:
    """df with two more columns: the language and the score. outputs: other names for lang_pred and score."""
    ensure_importable(df.sparkSession)
    lang, score = outputs.get("lang_pred", "lang_pred"), outputs.get("score", "score")
    shared = df.sparkSession.sparkContext.broadcast(filters)  # `slots` masks
    names = df.columns

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        holds("filters")
        f = shared.value
        for b in (b for b in batches if b.num_rows):
            row = b.column("row")
            said = [f.decide(x.as_py()) for x in row.field(place)]
            yield pa.RecordBatch.from_arrays([row, pa.array([s[0] for s in said], pa.string()), pa.array([s[1] for s in said], pa.float64())], ["row", "l", "s"])
            del b, row
        give_back()

    kept = F.struct(*[F.col(n).alias(f"c{k}") for k, n in enumerate(names)])
    kind = df.select(kept.alias("row")).schema["row"].dataType.simpleString()
    place = [n.lower() for n in names].index(text_col.lower())  # the text goes over once, in its row
    out = df.select(kept.alias("row")).mapInArrow(run, f"row {kind}, l string, s double")
    return out.select(*[F.col(f"row.c{k}").alias(n) for k, n in enumerate(names)], F.col("l").alias(lang), F.col("s").alias(score))


def training_fold(doc_id: Column, folds: int) -> Column:
    """crc32 of the id as text, modulo folds. A null id counts as the empty text."""
    return (F.crc32(F.coalesce(doc_id.cast("string"), F.lit("")).cast("binary")) % folds).cast("int")


def identify(docs: DataFrame, held_out: Column, **options) -> DataFrame:
    """doc_id, held_out, lang_pred, score of every row; learns from text and lang of the rows that are not held out."""
    filters = train_filters(docs.where(~held_out).select("text", "lang"), **options)
    return predict(docs.select("doc_id", held_out.alias("held_out"), "text"), filters).drop("text")


def keep_identified(docs: DataFrame, min_score: float = 0.3, **options) -> DataFrame:
    """The rows of docs whose language the filters recognise: learns from all labelled rows, rejects `und` and
    texts of which the best language's filter contains less than `min_score`."""
    filters = train_filters(docs.select("text", "lang"), **options)
    names = {n.lower() for n in docs.columns}
    lang, score = ("lang_pred", "score")
    while lang in names or score in names:
        lang, score = lang + "_", score + "_"
    said = predict(docs, filters, lang_pred=lang, score=score)
    return said.where((F.col(lang) != "und") & (F.col(score) >= min_score)).select(*docs.columns)
