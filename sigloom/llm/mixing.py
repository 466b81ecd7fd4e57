"""Mixing sources to target weights along a time-varying curriculum.

Each source has a demand density over training progress, piecewise linear
between breakpoints. Its integral, scaled to the source's target, is the
cumulative token demand; a document copy that starts at token u of its
source's stream is placed where that demand reaches u, by inverting the
integral in closed form. Range-sorting the copies by that position gives the
training order.

A source's stream is its documents in seeded hash order, repeated while tokens
are owed, whole documents only. The running token count inside a source is a
two-level prefix sum (hash blocks, then rows of a block), so a source with a
third of all rows is spread over its blocks.

Edge cases: null text has no words and is never taken; null is a source of its
own, last in order; rows that repeat count each; an empty table gives an empty
result. Columns `size`, `source_size`, `target`, `copies`, `copy`, `position`,
`taken` of the input are replaced.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from sigloom.llm import store

SEED = 7411
WEIGHTS = (3, 1, 2)
SHARE = 1.5
CAP = 2.0
#: Hash blocks of one source.
BLOCKS = 1024
#: Documents above this part of their source come first in its stream, at most 1 / LONG of them,
#: so that the end of the stream falls among documents that are small against the target.
LONG = 0.005
#: (progress, densities of the sources in turn): the first sources fade, the last ones rise.
SCHEDULE = ((0.0, (1.6, 1.0, 0.4)), (0.5, (1.0, 1.2, 0.8)), (1.0, (0.4, 1.0, 1.6)))
WORDS = r"[^\x20\x09-\x0D]+"


def word_count(text: Column) -> Column:
    return F.coalesce(F.regexp_count(text, F.lit(WORDS)), F.lit(0)).cast("long")


def source_targets(sized: DataFrame, weights=WEIGHTS, share: float = SHARE, cap: float = CAP) -> DataFrame:
    """Per source: source_size, rank, target. Targets share `share` of all sizes by weight, none above `cap` sizes.

    Sources saturate in order of cap over weight, so resharing the excess until none is above is one
    sorted pass: a source is at its cap when its fair part of what the earlier ones left exceeds the cap.
    One row for each source is sorted in one task.
    """
    totals = sized.groupBy("source").agg(F.sum("size").alias("source_size"))
    by_name = Window.orderBy(F.col("source").asc_nulls_last())
    totals = totals.withColumn("rank", F.row_number().over(by_name) - 1)
    totals = totals.withColumn("weight", F.element_at(F.array(*[F.lit(float(w)) for w in weights]), (F.col("rank") % len(weights)).cast("int") + 1))
    totals = totals.withColumn("limit", F.col("source_size") * F.lit(float(cap)))
    everything = Window.partitionBy()
    by_ratio = Window.orderBy(F.col("limit") / F.col("weight"), "rank")
    totals = totals.withColumn("budget", F.sum("source_size").over(everything) * F.lit(float(share)))
    before = F.coalesce(F.sum("limit").over(by_ratio.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0.0))
    left = F.sum("weight").over(by_ratio.rowsBetween(0, Window.unboundedFollowing))
    totals = totals.withColumn("full", F.col("limit") <= F.col("weight") * (F.col("budget") - before) / left)
    spent = F.sum(F.when(F.col("full"), F.col("limit")).otherwise(0.0)).over(everything)
    open_weight = F.sum(F.when(F.col("full"), 0.0).otherwise(F.col("weight"))).over(everything)
    target = F.when(F.col("full"), F.col("limit")).otherwise(F.col("weight") * (F.col("budget") - spent) / F.nullif(open_weight, F.lit(0.0)))
    return totals.select("source", "source_size", "rank", target.alias("target"))


def invert_demand(part: Column, rank: Column, schedule=SCHEDULE) -> Column:
    """Progress at which the fraction `part` of a source's demand is met."""
    out = F.lit(1.0)
    classes = len(schedule[0][1])
    for c in range(classes):
        pieces, area = [], 0.0
        for (t0, w0), (t1, w1) in zip(schedule, schedule[1:]):
            pieces.append((t0, t1 - t0, w0[c], w1[c], area))
            area += (t1 - t0) * (w0[c] + w1[c]) / 2
        of_class = F.lit(1.0)
        for t0, width, w0, w1, start in reversed(pieces):
            rest = part * area - start
            root = F.sqrt(F.greatest(F.lit(w0 * w0) + rest * (2 * (w1 - w0) / width), F.lit(0.0)))
            here = F.lit(t0) + F.least(F.lit(width), 2 * rest / F.greatest(F.lit(w0) + root, F.lit(1e-12)))
            of_class = F.when(part * area <= start + width * (w0 + w1) / 2, here).otherwise(of_class)
        out = F.when(rank % classes == c, of_class).otherwise(out)
    return F.least(F.lit(1.0), F.greatest(F.lit(0.0), out))


def plan_mix(docs: DataFrame, seed: int = SEED, weights=WEIGHTS, share: float = SHARE, cap: float = CAP) -> DataFrame:
    """Every document with size, source_size, target, rank, `copies` it gives and `before`, the words of its source ahead of it.

    Needs doc_id and source, and the words of a text either as `text` or, without one, as `size`; other columns travel along.
    """
    sized = docs.withColumn("size", word_count(F.col("text"))) if "text" in docs.columns else docs
    salt = [F.col(c) for c in ("text", "_text_hash") if c in docs.columns]
    sized = sized.withColumn("_h", F.xxhash64(F.lit(seed), F.col("doc_id"), *salt)).withColumn("_block", F.shiftrightunsigned("_h", 64 - int(math.log2(BLOCKS))).cast("int"))
    targets = source_targets(sized.select("source", "size"), weights, share, cap).withColumnRenamed("source", "_s")
    sized = sized.drop("source_size", "target", "rank", "copies", "before")
    sized = sized.join(targets, sized["source"].eqNullSafe(targets["_s"])).drop("_s")
    sized = sized.withColumn("_block", F.when(F.col("size") > F.col("source_size") * LONG, -1).otherwise(F.col("_block")))
    blocks = sized.groupBy(F.col("source").alias("_s"), F.col("_block").alias("_b")).agg(F.sum("size").alias("_sum"))
    ahead = Window.partitionBy("_s").orderBy("_b").rowsBetween(Window.unboundedPreceding, -1)
    blocks = blocks.withColumn("_ahead", F.coalesce(F.sum("_sum").over(ahead), F.lit(0))).drop("_sum")
    inside = Window.partitionBy("source", "_block").orderBy("_h", "doc_id", "size").rowsBetween(Window.unboundedPreceding, -1)
    ranked = sized.withColumn("_inside", F.coalesce(F.sum("size").over(inside), F.lit(0)))
    joined = ranked.join(blocks, ranked["source"].eqNullSafe(blocks["_s"]) & (ranked["_block"] == blocks["_b"]))
    before = F.col("_ahead") + F.col("_inside")
    whole = F.floor(F.col("target") / F.nullif(F.col("source_size"), F.lit(0)))
    rest = F.col("target") - whole * F.col("source_size")
    copies = F.when(F.col("size") == 0, 0).otherwise(F.coalesce(whole + F.when(before + F.col("size") / 2 <= rest, 1).otherwise(0), F.lit(0)))
    return joined.withColumn("before", before).withColumn("copies", copies.cast("int")).drop("_h", "_block", "_b", "_s", "_ahead", "_inside")


def positions(planned: DataFrame, schedule=SCHEDULE) -> DataFrame:
    """A row for each copy taken, with its `position` in training progress (0 to 1)."""
    each = planned.filter("copies > 0").withColumn("copy", F.explode(F.sequence(F.lit(0), F.col("copies") - 1)))
    part = (F.col("before") + F.col("copy") * F.col("source_size") + F.col("size") / 2) / F.col("target")
    return each.withColumn("position", invert_demand(F.least(part, F.lit(1.0)), F.col("rank"), schedule))


def training_order(planned: DataFrame, schedule=SCHEDULE) -> DataFrame:
    """The copies range-sorted by position."""
    placed = positions(planned, schedule)
    return placed.repartitionByRange("position", "doc_id").sortWithinPartitions("position", "doc_id")


def mix_documents(docs: DataFrame) -> DataFrame:
    """docs, each row as often as the mix takes it, in training order.

    The plan is made on ids and sizes; texts are moved once to meet it and once into order. Rows that repeat are
    planned as one document of their joint size.
    """
    keyed = docs.select(F.struct(*[F.col(f"`{c}`") for c in docs.columns]).alias("_rec"), "doc_id", "source", F.xxhash64("text").alias("_text_hash"), word_count(F.col("text")).alias("_words"))
    slim = keyed.groupBy("doc_id", "source", "_text_hash").agg(F.sum("_words").alias("size"))
    placed = positions(plan_mix(slim)).select(F.col("doc_id").alias("_id"), F.col("source").alias("_source"), F.col("_text_hash").alias("_hash"), "position")
    met = keyed.drop("_words").join(placed.hint("shuffle_merge"), keyed["doc_id"].eqNullSafe(F.col("_id")) & keyed["source"].eqNullSafe(F.col("_source")) & (keyed["_text_hash"] == F.col("_hash")))
    return met.repartitionByRange("position", "doc_id").sortWithinPartitions("position", "doc_id").select("_rec.*")


def digest(docs: DataFrame) -> DataFrame:
    """The contract's columns. `taken` sums the copies of a document that stand in the written training order, planned as in mix_documents()."""
    rows = store.written(docs.select("doc_id", "source", F.xxhash64("text").alias("_text_hash"), word_count(F.col("text")).alias("size")), "mix-sizes")
    slim = rows.groupBy("doc_id", "source", "_text_hash").agg(F.sum("size").alias("size"))
    order = store.written(training_order(plan_mix(slim)).select("doc_id", "source", "_text_hash", "position"), "training-order")
    counted = order.filter("position BETWEEN 0 AND 1").groupBy(F.col("doc_id").alias("_id"), F.col("source").alias("_source"), F.col("_text_hash").alias("_hash")).agg(F.count("*").cast("int").alias("_n"))
    met = rows.join(counted.hint("shuffle_merge"), rows["doc_id"].eqNullSafe(F.col("_id")) & rows["source"].eqNullSafe(F.col("_source")) & (rows["_text_hash"] == F.col("_hash")), "left")
    targets = source_targets(rows.select("source", "size")).withColumnRenamed("source", "_s")
    copies = F.coalesce("_n", F.lit(0))
    return met.join(targets, met["source"].eqNullSafe(targets["_s"])).select("doc_id", "size", "source_size", "target", (copies * F.col("size")).cast("long").alias("taken"), copies.alias("copies"))
