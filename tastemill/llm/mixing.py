"""Mixing sources to target weights, in DataFrame functions only.

Every document gets a hash-random key. The key space is cut into equal ranges, so (source, range)
is a range partition of each source in key order. One aggregation gives the size of every range; a
running sum over the ranges of a source is the distributed prefix sum. It shows in which range the
source's budget ends; only the rows of that one range are sorted, which gives the exact cut. Then
each document's share follows from its own key and its source's cut: whole epochs, one more if its
key is below the cut, and the rest of the budget at the cut itself. No document moves.

Targets: the sources in code point order, null last, weigh 5, 2, 1, repeating; they share `share` times
all sizes; no target is above `cap` times its source's size, the excess is shared anew by weight. That
is water filling: target = min(cap * size, level * weight) with the one level that spends the budget.

Ranges: about one to 256 documents, at most 65,536, so the running sum of one source is over at most
65,536 rows and the range of the cut has a 65,536th of the source. A source with a third of all rows is
spread over all ranges.

Defined cases: a null text has size 0 and is never taken; a null source is a source of its own. A null id
has the key of the empty text. Rows equal in id and size that lie at the cut share the rest evenly,
rounded down. An empty table gives an empty result. Other columns are not read and are kept, whatever their names; in
`mix_plan` one that has the name of an added column gives way to it."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tastemill.llm._common import Scratch, hex_key, pow2_at_least, word_count, written

KEY_BITS = 60


def source_targets(totals: DataFrame, weights: tuple[int, ...] = (5, 2, 1), share: float = 1.5, cap: float = 2.0) -> DataFrame:
    """totals: (source, source_size). Adds target. One row a source; windows over the whole small table."""
    by_name = Window.orderBy(F.col("source").isNull(), "source")
    place = (F.row_number().over(by_name) - 1) % len(weights) + 1
    weighed = totals.withColumn("weight", F.element_at(F.array(*map(F.lit, weights)), place).cast("double"))
    weighed = weighed.withColumn("most", F.col("source_size") * F.lit(float(cap)))
    by_level = Window.orderBy(F.col("most") / F.col("weight"), F.col("source").isNull(), "source")
    before = by_level.rowsBetween(Window.unboundedPreceding, -1)
    onward = by_level.rowsBetween(0, Window.unboundedFollowing)
    everything = Window.partitionBy()
    filled = weighed.withColumn(
        "level",
        (F.sum("source_size").over(everything) * F.lit(float(share)) - F.coalesce(F.sum("most").over(before), F.lit(0.0))) / F.sum("weight").over(onward),
    )
    # the first source, in this order, that its level does not fill gives the level of all
    holds = F.min(F.when(F.col("most") >= F.col("level") * F.col("weight"), F.struct(F.col("most") / F.col("weight"), F.col("source").isNull(), F.coalesce("source", F.lit("")), "level"))).over(everything)["level"]
    return filled.withColumn("final", holds).select(
        "source", "source_size", F.coalesce(F.least("most", F.col("final") * F.col("weight")), F.col("most")).alias("target")
    )


def _named(source: Column) -> Column:
    """A join key that null has too."""
    return F.coalesce(F.concat(F.lit("="), source), F.lit("null"))


def _keyed(sized: DataFrame, seed: str) -> DataFrame:
    return sized.withColumn("src", _named(F.col("source"))).withColumn("key", document_key(F.col("doc_id"), seed))


def mix_plan(sized: DataFrame, seed: str = "mix", **options) -> DataFrame:
    """sized: (doc_id, source, size), a written table. One row a document: with source_size, target, epochs, part, taken."""
    return mix_shares(sized, mix_cuts(sized, seed, **options), seed)


def mix_cuts(sized: DataFrame, seed: str = "mix", max_broadcast_sources: int = 100_000, **targets) -> DataFrame:
    """One row a source: its size, target, whole epochs, and the document, by (key, doc_id, size), where the rest ends."""
    sized = sized.select("doc_id", "source", "size")
    scratch = Scratch(sized.sparkSession, "mix")
    rows = sized.count()
    ranges = min(65536, pow2_at_least(max(1, rows) / 256))
    keyed = _keyed(sized, seed)
    keyed = keyed.withColumn("range", F.shiftright("key", KEY_BITS - (ranges.bit_length() - 1)))
    sums = scratch.written(keyed.groupBy("source", "src", "range").agg(F.sum("size").alias("range_size")), "mix-ranges")
    totals = sums.groupBy("source", "src").agg(F.sum("range_size").alias("source_size"))
    aimed = source_targets(totals.select("source", "source_size"), **targets).withColumn("src", _named(F.col("source"))).drop("source")
    budget = F.floor("target").cast("long")
    epochs = F.when(F.col("source_size") > 0, F.expr("floor(target) div source_size")).otherwise(0).cast("long")
    aimed = scratch.written(aimed.withColumn("epochs", epochs).withColumn("rest", budget - F.col("epochs") * F.col("source_size")), "mix-targets")
    running = Window.partitionBy("src").orderBy("range").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    ends = sums.withColumn("range_end", F.sum("range_size").over(running)).join(aimed.select("src", "rest"), "src")
    ends = ends.where("rest > 0 and range_end > rest and range_end - range_size <= rest").select(
        "src", "range", (F.col("range_end") - F.col("range_size")).alias("range_start"), "rest"
    )
    few = aimed.count() <= max_broadcast_sources
    small = F.broadcast if few else lambda df: df
    # the rows of the range where a source's budget ends, one range a source; equal rows count as one of m
    last = keyed.join(small(ends), ["src", "range"]).groupBy("src", "key", "doc_id", "size", "range_start", "rest").agg(F.count(F.lit(1)).alias("m"))
    place = F.struct("key", "doc_id", "size")
    order = Window.partitionBy("src").orderBy(place).rowsBetween(Window.unboundedPreceding, Window.currentRow)
    last = last.withColumn("end", F.col("range_start") + F.sum(F.col("size") * F.col("m")).over(order))
    left = F.col("rest") - (F.col("end") - F.col("size") * F.col("m"))
    cuts = last.where((F.col("end") > F.col("rest")) & (left >= 0)).select("src", place.alias("cut"), F.expr("(rest - (end - size * m)) div m").alias("cut_part"))
    plan = written(aimed.join(small(cuts), "src", "left"), "mix-cuts")
    scratch.remove()
    return plan


def mix_shares(sized: DataFrame, plan: DataFrame, seed: str = "mix", max_broadcast_sources: int = 100_000) -> DataFrame:
    """sized with each document's share of the mix. No document moves while the sources are few enough to broadcast."""
    place = F.struct("key", "doc_id", "size")
    part = (
        F.when(F.col("rest") == 0, 0)
        .when(F.col("cut").isNull(), 0)
        .when(place < F.col("cut"), F.col("size"))
        .when(place == F.col("cut"), F.col("cut_part"))
        .otherwise(0)
        .cast("long")
    )
    few = plan.count() <= max_broadcast_sources
    added = ("source_size", "target", "epochs", "part", "taken")
    others = [n for n in sized.columns if n.lower() not in ("doc_id", "source", "size", *added)]
    kept = F.struct(F.lit(0), *[F.col(n).alias(f"in_{n}") for n in others]).alias("others")  # no clash with the plan's columns
    keyed = _keyed(sized.select("doc_id", "source", "size", kept), seed)
    chosen = keyed.join(F.broadcast(plan) if few else plan, "src").withColumn("part", part).withColumn("taken", F.col("epochs") * F.col("size") + F.col("part"))
    return chosen.select("doc_id", "source", "size", *[F.col(f"others.in_{n}").alias(n) for n in others], *added)


def document_key(doc_id: Column, seed: str) -> Column:
    return hex_key(F.concat(F.lit(f"{seed}:"), F.coalesce(doc_id.cast("string"), F.lit(""))))


def document_sizes(docs: DataFrame) -> DataFrame:
    return written(docs.select("doc_id", "source", word_count(F.col("text")).alias("size")), "mix-sizes")


def apply_mix(docs: DataFrame, seed: str = "mix", **options) -> DataFrame:
    """The mixed corpus, with the columns of docs: a document that the mix takes k times whole has k rows.

    The document on a source's cut adds one row with its first words, as many as the budget still has;
    its n_chars, if there is such a column, follows."""
    names = docs.columns
    inner = {n: f"in_{n}" for n in names}  # no clash with the plan's columns
    plan = mix_cuts(document_sizes(docs), seed, **options)
    sized = docs.select(F.col("doc_id"), F.col("source"), word_count(F.col("text")).alias("size"), F.struct(*[F.col(n).alias(inner[n]) for n in names]).alias("row"))
    planned = mix_shares(sized, plan, seed)
    whole = F.expr("array_repeat(-1L, if(size > 0, cast(epochs + if(part = size, 1, 0) as int), 0))")
    cut = F.when((F.col("part") > 0) & (F.col("part") < F.col("size")), F.array(F.col("part"))).otherwise(F.expr("array()").cast("array<bigint>"))
    copies = planned.select("row", F.explode(F.concat(whole, cut)).alias("words"))
    out = copies.select("words", *[F.col(f"row.{inner[n]}").alias(n) for n in names])
    # one document a source is cut: its words are taken by a pattern with the count in it
    head = F.when(F.col("words") < 0, F.col("text")).otherwise(first_words(F.col("text"), F.col("words")))
    out = out.withColumn("text", head)
    if "n_chars" in names:
        out = out.withColumn("n_chars", F.when(F.col("words") < 0, F.col("n_chars")).otherwise(F.length("text")).cast(dict(docs.dtypes)["n_chars"]))
    return out.select(*names)


def first_words(text: Column, n: Column) -> Column:
    """The text up to the end of its n-th word, white space between words as it is."""
    pieces = F.regexp_extract_all(text, F.lit(r"([\x20\x09-\x0D]*[^\x20\x09-\x0D]+)"), 1)
    return F.array_join(F.slice(pieces, F.lit(1), n.cast("int")), "")
