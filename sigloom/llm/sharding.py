"""Sharding by a two-pass external shuffle, in DataFrame functions only.

Pass 1 scatters whole records uniformly over memory-sized buckets by a seeded
hash. Pass 2 takes one bucket at a time, puts it in a canonical order, applies
a seeded Fisher-Yates shuffle (``shuffle``) and numbers it. The buckets in turn
form one permutation of the corpus, which is cut into shards of equal row
counts, so no record is moved a third time.

A row that occurs more than COPIES times is sent once with its count, combined on
the map side, and made again in runs of COPIES, each copy with a hash of its own.

Edge cases: null text counts as no bytes; a null id is an ordinary value; rows
that repeat are separate records; where a column cannot be hashed (maps), copies
of a row stay in one bucket; an empty table gives an empty result. Extra columns
travel along; names this operator uses itself (`_rec`, `_pos`, `_bucket`, `_h`,
`_first`) may also be columns of the input.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from sigloom.llm import store

SHARDS = 24
SEED = 20240117
#: Text bytes aimed at in one bucket.
BUCKET_BYTES = 16 << 20
#: Buckets are runs of hash bins, this many for each 64 GB of input, so one pass sizes both.
BINS = 4096
#: Copies of a row that are dealt like any others.
COPIES = 1024
#: Rows of a table that may be broadcast: 16 bytes each.
SMALL = 1_000_000


def hashable(field: T.StructField) -> bool:
    return "map<" not in field.dataType.simpleString() and "variant" not in field.dataType.simpleString()


def record_hash(df: DataFrame, seed: int) -> Column:
    """Seeded hash of every column that Spark can hash (maps and variants cannot)."""
    return F.xxhash64(F.lit(seed), *[F.col(f"`{f.name}`") for f in df.schema.fields if hashable(f)])


def text_bytes(column: str) -> Column:
    return F.coalesce(F.octet_length(F.col(column)), F.lit(0)).cast("long")


def small_or_merged(df: DataFrame, rows: int) -> DataFrame:
    """For a join: broadcast if it has few rows, else by one plan at every size."""
    return F.broadcast(df) if rows <= SMALL else df.hint("shuffle_merge")


def copies_apart(hashed: DataFrame, copies: int = COPIES) -> DataFrame:
    """(_rec, _h, _bytes) with hashes of their own for the copies of rows that occur often."""
    many = store.written(hashed.groupBy("_h").agg(F.count("*").alias("_n")).filter(F.col("_n") > copies), "repeated-rows")
    count = many.count()
    if not count:
        return hashed
    one = hashed.join(small_or_merged(many, count), "_h").groupBy("_h", "_n", "_bytes").agg(F.first("_rec").alias("_rec"))
    runs = one.withColumn("_run", F.explode(F.sequence(F.lit(0).cast("long"), F.expr(f"(_n - 1) div {copies}")))).repartition("_h", "_run")
    first = F.col("_run") * copies
    each = runs.withColumn("_copy", F.explode(F.sequence(first, F.least(first + copies, F.col("_n")) - 1)))
    rest = hashed.join(small_or_merged(many.select("_h"), count), "_h", "left_anti").select("_rec", "_h", "_bytes")
    return rest.unionByName(each.select("_rec", F.xxhash64("_h", "_copy").alias("_h"), "_bytes"))


def external_shuffle(docs: DataFrame, seed: int = SEED, text: str = "text", bucket_bytes: int = BUCKET_BYTES, copies: int = COPIES) -> tuple[DataFrame, int]:
    """All records under `_rec` with their place `_at` (from 0) in a seeded permutation, and the number of records."""
    estimate = int(str(docs._jdf.queryExecution().optimizedPlan().stats().sizeInBytes()))
    bins = BINS * max(1, min(1 << 12, estimate >> 36))
    hashed = docs.select(F.struct(*[F.col(f"`{c}`") for c in docs.columns]).alias("_rec"), record_hash(docs, seed).alias("_h"), text_bytes(f"`{text}`").alias("_bytes"))
    if all(map(hashable, docs.schema.fields)):
        hashed = copies_apart(hashed, copies)
    hashed = hashed.withColumn("_bin", F.pmod("_h", F.lit(bins)))
    # Pass 0: sizes alone, a row for each bin; the driver sees their sums.
    sizes = store.written(hashed.groupBy("_bin").agg(F.count("*").alias("n"), F.sum("_bytes").alias("bytes")), "bin-sizes")
    total = sizes.agg(F.sum("n").alias("n"), F.sum("bytes").alias("bytes")).first()
    rows = total.n or 0
    buckets = max(1, min(bins, math.ceil((total.bytes or 0) / bucket_bytes)))
    bucket = F.expr(f"_bin * {buckets} div {bins}").alias("_bucket")
    # A row for each bucket in one task: 16 bytes for 16 MB of input, so 100 MB at 100 TB.
    before = Window.orderBy("_bucket").rowsBetween(Window.unboundedPreceding, -1)
    starts = sizes.groupBy(bucket).agg(F.sum("n").alias("n")).select("_bucket", F.coalesce(F.sum("n").over(before), F.lit(0)).alias("_first"))
    # Pass 1: scatter. Pass 2: canonical order, Fisher-Yates, numbering.
    scattered = hashed.select(bucket, "_h", "_rec").repartition(buckets, "_bucket").sortWithinPartitions("_bucket", "_h")
    shuffled = scattered.groupBy("_bucket").agg(F.collect_list("_rec").alias("_all")).select("_bucket", F.posexplode(F.shuffle("_all", F.lit(seed))).alias("_pos", "_rec"))
    return shuffled.join(small_or_merged(starts, buckets), "_bucket").select((F.col("_first") + F.col("_pos")).alias("_at"), "_rec"), rows


def shard_documents(docs: DataFrame, shards: int = SHARDS, seed: int = SEED, text: str = "text", bucket_bytes: int = BUCKET_BYTES, copies: int = COPIES) -> DataFrame:
    """Every record with its `shard` and gapless `slot`; shard sizes differ by one row at most."""
    placed, rows = external_shuffle(docs, seed, text, bucket_bytes, copies)
    rows = max(rows, 1)
    shard = F.expr(f"_at * {shards} div {rows}")
    keep = [F.col(f"_rec.`{c}`").alias(c) for c in docs.columns if c not in ("shard", "slot")]
    first = F.expr(f"(shard * {rows} + {shards - 1}) div {shards}")
    return placed.withColumn("shard", shard.cast("int")).withColumn("slot", (F.col("_at") - first).cast("long")).select(*keep, "shard", "slot")


def write_shards(sharded: DataFrame, path: str) -> None:
    """One folder for each shard; its files hold the records in slot order."""
    sharded.repartitionByRange("shard", "slot").sortWithinPartitions("shard", "slot").write.mode("overwrite").partitionBy("shard").parquet(path)


def digest(sharded: DataFrame) -> DataFrame:
    """The contract's columns, from the operator's records."""
    return sharded.select(
        "doc_id",
        (text_bytes("text") + 8).alias("size"),
        F.coalesce(F.crc32(F.col("text").cast("binary")), F.lit(0).cast("long")).alias("text_crc32"),
        F.lit("rows").alias("law"),
        "shard",
        "slot",
        F.lit(None).cast("int").alias("grown_shard"),
    )
