"""Exact deduplication by two passes over a Bloom filter, in DataFrame functions only.

Pass one hashes every text to 64 bits and counts, for two bit positions of each hash, how many rows
set the bit. Bits set twice or more form the filter: a table of 4 KB bitmaps, one per segment of the
hash space. Pass two probes it with every row. A row with a bit that no other row has set is unique
and passes straight through; only the others (all true repeats, and a few per cent of false alarms)
shuffle and are grouped by the SHA-256 of the text.

The filter has 16 bits a row and about 1.4 % false alarms at every size. Up to `max_filter_bytes` (some 30 million
rows) it is broadcast; beyond that its bitmaps and the rows meet in a join by segment: narrow rows of ids and hashes
in mark_exact_duplicates, whole rows in drop_exact_duplicates. A hot text's segment is split at run time.

Defined cases: a null text counts as the empty text, so null and empty rows are one group. Of equal
texts the row with the largest id stays, null ids last; of rows equal in id and text exactly one
stays. An empty table gives an empty result. Other columns pass through untouched, whatever their names:
inner columns have names that no column of the input has."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tastemill.llm._common import pow2_at_least, written

SEGMENT_BITS = 32768  # of bitmap_construct_agg: a bitmap has 4 KB


def _segment(h: Column, segments: int) -> Column:
    return h.bitwiseAND(F.lit(segments - 1).cast("long"))


def _positions(h: Column) -> list[Column]:
    """Two bit positions of a hash, from bits that the segment does not use."""
    return [F.shiftrightunsigned(h, 49), F.shiftrightunsigned(h, 34).bitwiseAND(F.lit(SEGMENT_BITS - 1))]


def repeat_filter(hashes: DataFrame, rows: int, bits_per_row: int = 16) -> tuple[DataFrame, int]:
    """(segment, bitmap) of the bits that two or more rows set, and the number of segments.

    hashes: one long column `h`. The counts are summed on the map side first, so a hash that a third of
    all rows have reaches the shuffle once a task."""
    segments = pow2_at_least(rows * bits_per_row / SEGMENT_BITS)
    h = F.col("h")
    slot = F.explode(F.array(*[F.shiftleft(_segment(h, segments), 15).bitwiseOR(p) for p in _positions(h)]))
    bits = hashes.select(slot.alias("slot")).groupBy("slot").agg(F.count(F.lit(1)).alias("n")).where("n > 1")
    maps = bits.groupBy(F.shiftrightunsigned("slot", 15).alias("seg")).agg(
        F.expr(f"bitmap_construct_agg(slot & {SEGMENT_BITS - 1})").alias("bitmap")
    )
    return written(maps, "repeat-filter"), segments


def _bit(bitmap: Column, p: Column) -> Column:
    byte = F.conv(F.hex(F.substring(bitmap, (F.shiftright(p, 3) + 1).cast("int"), F.lit(1))), 16, 10).cast("int")
    return F.getbit(byte, p.bitwiseAND(F.lit(7)).cast("int")) == 1


def probe(df: DataFrame, h: Column, filter_: DataFrame, segments: int, flag: str, max_filter_bytes: int = 64 << 20) -> DataFrame:
    """df and a boolean column `flag`: may the row's hash occur in another row? No shuffle of df while the filter can be broadcast."""
    seg, bitmap = f"{flag}_seg", f"{flag}_map"
    maps = filter_.select(F.col("seg").alias(seg), F.col("bitmap").alias(bitmap))
    maps = F.broadcast(maps) if segments * SEGMENT_BITS // 8 <= max_filter_bytes else maps
    hit = F.col(bitmap).isNotNull()
    for p in _positions(h):
        hit = hit & _bit(F.col(bitmap), p)
    return df.join(maps, _segment(h, segments) == F.col(seg), "left").withColumn(flag, F.coalesce(hit, F.lit(False))).drop(seg, bitmap)


def mark_exact_duplicates(df: DataFrame, id_col: str = "doc_id", text_col: str = "text", normalise=lambda c: c, bits_per_row: int = 16, max_filter_bytes: int = 64 << 20) -> DataFrame:
    """One row per row of df: doc_id, keep_id, group_size, kept, text_sha256.

    normalise: a function of columns that is applied to the text before comparison (none by default)."""
    text = F.coalesce(normalise(F.col(text_col)), F.lit(""))
    rows = written(
        df.select(
            F.col(id_col).alias("doc_id"),
            F.xxhash64(text).alias("h"),
            F.sha2(text.cast("binary"), 256).alias("text_sha256"),
            F.monotonically_increasing_id().alias("row"),
        ),
        "dedup-hashes",
    )
    filter_, segments = repeat_filter(rows.select("h"), rows.count(), bits_per_row)
    probed = probe(rows, F.col("h"), filter_, segments, "maybe", max_filter_bytes)
    single = probed.where(~F.col("maybe")).select(
        "doc_id", F.col("doc_id").alias("keep_id"), F.lit(1).cast("long").alias("group_size"), F.lit(True).alias("kept"), "text_sha256"
    )
    flagged = probed.where("maybe").select("doc_id", "row", "text_sha256", F.substring("text_sha256", 1, 4).alias("lead"))
    groups = flagged.groupBy(F.col("text_sha256").alias("sha")).agg(
        F.max(F.struct("doc_id", "row")).alias("best"), F.count(F.lit(1)).alias("group_size"), F.first("lead").alias("lead_")
    )
    # Two join keys where the groups are dealt by one: both sides are dealt anew for the join, and the
    # partition of a hot text, which only the left side has, can be split at run time.
    joined = flagged.join(groups, (F.col("text_sha256") == F.col("sha")) & (F.col("lead") == F.col("lead_")))
    return single.unionByName(
        joined.select(
            "doc_id", F.col("best.doc_id").alias("keep_id"), "group_size", (F.col("best.row") == F.col("row")).alias("kept"), "text_sha256"
        )
    )


def drop_exact_duplicates(df: DataFrame, id_col: str = "doc_id", text_col: str = "text", normalise=lambda c: c, bits_per_row: int = 16, max_filter_bytes: int = 64 << 20) -> DataFrame:
    """The rows of df that stay, with df's columns. Rows that the filter clears do not shuffle."""
    names = df.columns
    h, sha, maybe = (_free(names, x) for x in ("dedup_h", "dedup_sha", "dedup_maybe"))
    text = F.coalesce(normalise(F.col(text_col)), F.lit(""))
    hashes = written(df.select(F.xxhash64(text).alias("h")), "dedup-hashes")
    filter_, segments = repeat_filter(hashes, hashes.count(), bits_per_row)
    probed = probe(df.withColumn(h, F.xxhash64(text)), F.col(h), filter_, segments, maybe, max_filter_bytes)
    flagged = probed.where(F.col(maybe)).withColumn(sha, F.sha2(text.cast("binary"), 256))
    best = flagged.groupBy(F.col(sha).alias("best_sha")).agg(F.max(id_col).alias("best_id"))
    # The id is among the keys, so a hot group of copies is dealt over all partitions.
    stay = flagged.join(best, (F.col(sha) == F.col("best_sha")) & F.col(id_col).eqNullSafe(F.col("best_id")), "left_semi")
    return probed.where(~F.col(maybe)).select(*names).unionByName(stay.dropDuplicates([sha, id_col]).select(*names))


def _free(names: list[str], name: str) -> str:
    taken = {n.lower() for n in names}
    while name in taken:
        name += "_"
    return name
