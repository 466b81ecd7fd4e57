"""Blocks of a table in ascending id order, each followed by the first row of the next block.

Block limits come from quantiles of the id column alone, so the texts are moved
once. An id that several quantiles fall on (nulls, say) is spread over as many
blocks, by ranges of the tie-breaking hash. A row that opens a block is also
dealt, as a guest, to the block before it (and the first row of all to the last
block), so a task that streams a block sees every row's successor.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: Text bytes of a block aimed at, and the most blocks; a larger input has larger blocks, which are streamed.
BLOCK_BYTES = 16 << 20
MOST_BLOCKS = 1 << 16
#: Limits are searched in two steps, in runs of this many.
RUN = 256
LOWEST = -(1 << 63)


def counted(limits: list[int], key: Column, test) -> Column:
    """How many of the ascending limits pass test(limit, key), where those that do come first."""
    runs = [limits[i : i + RUN] for i in range(0, len(limits), RUN)]
    run = F.size(F.filter(F.lit([r[0] for r in runs[1:]]), lambda x: test(x, key))) if len(runs) > 1 else F.lit(0)
    inside = F.element_at(F.array(*[F.lit(r) for r in runs]), run + 1) if len(runs) > 1 else F.lit(runs[0])
    return run * RUN + F.size(F.filter(inside, lambda x: test(x, key)))


def block_of(limits: list[int], key: Column, tie: Column) -> Column:
    """The block of a row: the limits below its key, and for a key that is a limit itself the part of the ties that its own lies in."""
    below = counted(limits, key, lambda x, k: x < k)
    equal = counted(limits, key, lambda x, k: x <= k) - below
    part = F.floor((tie / 2.0**64 + 0.5) * equal)
    return (below + F.when(equal > 0, F.least(equal, part + 1)).otherwise(0)).cast("int")


def in_blocks(df: DataFrame, order_id: str, tie: str, guests: bool = True, block_bytes: int | None = None) -> tuple[DataFrame, int]:
    """df with `_block` and `_guest`, dealt by block and sorted in it by (_guest, id, tie); and the number of blocks.

    Null ids come first.
    """
    texts = [F.coalesce(F.octet_length(F.col(f"`{c}`")), F.lit(0)) for c, kind in df.dtypes if kind in ("string", "binary")]
    total = df.agg(F.sum(reduce(lambda a, b: a + b, texts, F.lit(0)).cast("long"))).first()[0] or 0
    wanted = max(1, min(MOST_BLOCKS, total // (block_bytes or BLOCK_BYTES)))
    key = F.coalesce(F.col(order_id).cast("long"), F.lit(LOWEST))
    ids = df.select(key.alias("_key"))
    limits: list[int] = []
    if wanted > 1:
        limits = sorted(int(x) for x in ids.approxQuantile("_key", [i / wanted for i in range(1, wanted)], 0.2 / wanted))
    block = block_of(limits, F.col("_key"), F.col(tie)) if limits else F.lit(0)
    dealt = df.withColumn("_key", key).withColumn("_block", block)
    count = len(limits) + 1
    if not guests:
        return dealt.withColumn("_guest", F.lit(0)).repartitionById(count, F.col("_block")).sortWithinPartitions("_block", "_key", tie), count
    # One row for each block, at most MOST_BLOCKS.
    opens = {r["_block"]: r.first for r in dealt.groupBy("_block").agg(F.min(F.struct("_key", tie)).alias("first")).collect()}
    filled = sorted(opens)
    before = {b: filled[i - 1] for i, b in enumerate(filled)}
    key_opens, tie_opens = (F.element_at(F.lit([opens[b][n] if b in opens else 0 for b in range(count)]), F.col("_block") + 1) for n in (0, 1))
    previous = F.element_at(F.lit([before.get(b, b) for b in range(count)]), F.col("_block") + 1)
    own = F.struct(F.col("_block").alias("b"), F.lit(0).alias("g"))
    places = F.when((F.col("_key") == key_opens) & (F.col(tie) == tie_opens), F.array(own, F.struct(previous.cast("int").alias("b"), F.lit(1).alias("g")))).otherwise(F.array(own))
    dealt = dealt.withColumn("_place", F.explode(places)).withColumn("_block", F.col("_place.b")).withColumn("_guest", F.col("_place.g")).drop("_place")
    return dealt.repartitionById(count, F.col("_block")).sortWithinPartitions("_block", "_guest", "_key", tie), count
