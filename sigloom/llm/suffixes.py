"""Suffix-array deduplication of exact repeats by a difference cover, block by block.

Every byte covered by a LENGTH-byte string that also starts earlier (in an
earlier document, or earlier in the same one) is removed. The texts are laid end
to end in order of id, so "earlier" is the order of places in one long text.

A full suffix array would move each suffix of the corpus. Two suffixes matter
here only if they tie for LENGTH bytes, and a difference cover tells in advance
which can:

1. Cover sample. The places whose offset in their document, modulo PERIOD, is in
   COVER. For any two places there is a shift below PERIOD that takes both into
   the sample, so two equal LENGTH-byte strings hold equal GRAM-byte strings at
   sampled places of the same shift. The sample's suffixes are sorted to GRAM
   bytes, bucket by bucket, which ranks them: alone, or tied with another.
2. Blocks. A suffix with no tied sample within PERIOD places is settled by these
   ranks and goes into no bucket. The others are taken one block of suffix
   buckets at a time; a block's buckets are sorted to LENGTH bytes, each in one
   task, and the first of each tie is told from the later ones. Shuffle files of
   a block are gone before the next begins, so disk and memory hold one block.

Strings are sorted by hashes of their bytes, not by the bytes: 48 bits for the
sample, where a collision only sends more suffixes to the buckets, and 96 bits
for whole strings, where two different ones among 10**13 collide with
probability 10**-3. A chunk of texts (CHUNK bytes) sends each string once, its
later copies being settled inside, and gets a bit back for each: no task gets
more of a frequent string than one copy a chunk.

Edge cases: null text is empty; texts shorter than LENGTH keep all bytes; null
ids come first; rows with equal ids are documents of their own, in order of
their texts' hash, so the later of two equal rows is removed whole; ids of any
type that can be ordered are kept as they are; extra columns are ignored; an
empty table gives an empty result.
"""

from __future__ import annotations

import hashlib
import math
from collections.abc import Iterator
from functools import reduce

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from sigloom.llm import store, words

LENGTH = 100
PERIOD = 57
#: Fixed value: a perfect difference set; each difference modulo 57 arises once.
COVER = np.array((0, 1, 3, 13, 32, 36, 43, 52))
GRAM = LENGTH - PERIOD + 1
#: Text bytes of a chunk, of a task that makes chunks, and hashed at once.
CHUNK, PART, SLAB = 2 << 20, 32 << 20, 1 << 16
#: Strings of one bucket, about.
BUCKET = 1 << 20
#: Blocks of suffix buckets, taken in turn; a power of two.
BLOCKS = 4
MOST_TASKS = 1 << 17
GRAM_BITS = 48

_U = np.uint64
#: Odd multipliers of the two families of hashes.
_BASES = (0x9E3779B97F4A7C15, 0xD6E8FEB86659FD93)
_powers: dict[tuple[int, bool], np.ndarray] = {}
_LETTERS = (words._BYTE, words.mixed(words._BYTE + _U(17)))


def powers(family: int, inverse: bool, n: int) -> np.ndarray:
    """base**i or base**-i mod 2**64 for i < n."""
    known = _powers.get((family, inverse))
    if known is None or len(known) < n:
        base = pow(_BASES[family], -1, 1 << 64) if inverse else _BASES[family]
        with np.errstate(over="ignore"):
            known = _powers[family, inverse] = np.concatenate((np.ones(1, np.uint64), np.cumprod(np.full(max(n, SLAB + LENGTH + 1), base, np.uint64))))
    return known[:n]


def hashed(body: np.ndarray, places: np.ndarray, length: int, family: int = 0) -> np.ndarray:
    """64-bit hashes of the `length` bytes at each of the ascending places."""
    out = np.empty(len(places), np.uint64)
    at = 0
    while at < len(places):
        low = int(places[at])
        stop = int(places.searchsorted(low + SLAB))
        buf = body[low : int(places[stop - 1]) + length]
        sums = np.zeros(len(buf) + 1, np.uint64)
        np.cumsum(_LETTERS[family][buf] * powers(family, False, len(buf)), out=sums[1:])
        here = places[at:stop] - low
        out[at:stop] = words.mixed((sums[here + length] - sums[here]) * powers(family, True, len(buf))[here])
        at = stop
    return out


def cover_places(sizes: np.ndarray) -> np.ndarray:
    """Sampled places of texts laid end to end, ascending: those whose GRAM bytes lie in a LENGTH-byte string of one text."""
    ends = np.cumsum(sizes)
    periods = np.where(sizes >= LENGTH, -(-(sizes - GRAM + 1) // PERIOD), 0)
    which = np.repeat(np.arange(len(sizes)), periods)
    nth = np.arange(periods.sum()) - np.repeat(np.cumsum(periods) - periods, periods)
    places = ((ends - sizes)[which] + nth * PERIOD)[:, None] + COVER
    return places[places <= (ends[which] - GRAM)[:, None]]


def candidate_runs(sizes: np.ndarray, tied: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """First and last places of the suffixes with a tied sample within PERIOD places."""
    ends = np.cumsum(sizes)
    text = ends.searchsorted(tied, "right")
    first = np.maximum(tied - (PERIOD - 1), (ends - sizes)[text])
    last = np.minimum(tied, ends[text] - LENGTH)
    first, last = first[first <= last], last[first <= last]
    if not len(first):
        return first, last
    opens = np.concatenate(([True], first[1:] > last[:-1] + 1))
    return first[opens], last[np.append(np.flatnonzero(opens)[1:], len(last)) - 1]


def expanded(first: np.ndarray, last: np.ndarray) -> np.ndarray:
    """All places of the runs."""
    size = last - first + 1
    return np.arange(size.sum()) - np.repeat(np.cumsum(size) - size - first, size)


def packed(values: np.ndarray, width: int) -> bytes:
    """Ascending integers as differences, byte plane by byte plane; high planes are nearly all zero and compress."""
    steps = np.diff(values, prepend=_U(0)).astype("<u8")
    return np.ascontiguousarray(steps.view(np.uint8).reshape(-1, 8)[:, :width].T).tobytes()


def unpacked(raw: bytes, width: int) -> np.ndarray:
    planes = np.frombuffer(raw, np.uint8).reshape(width, -1)
    steps = np.zeros((planes.shape[1], 8), np.uint8)
    steps[:, :width] = planes.T
    return np.cumsum(steps.reshape(-1).view("<u8"), dtype=np.uint64)


def bits(flags: np.ndarray) -> bytes:
    return np.packbits(flags).tobytes()


def unbits(raw: bytes, n: int) -> np.ndarray:
    return np.unpackbits(np.frombuffer(raw, np.uint8), count=n).astype(bool)


def buckets_of(keys: np.ndarray, shift: int) -> tuple[np.ndarray, np.ndarray]:
    """Of ascending keys: the buckets that have some (the key's high bits), and where each begins (one entry more)."""
    bucket = (keys >> _U(shift)).astype(np.int64) if shift < 64 else np.zeros(len(keys), np.int64)
    begin = np.flatnonzero(np.concatenate(([True], bucket[1:] != bucket[:-1]))[: len(bucket)])
    return bucket[begin], np.append(begin, len(keys))


def batch_of(schema: str, columns) -> pa.RecordBatch:
    kinds = {"bigint": pa.int64(), "int": pa.int32(), "binary": pa.binary()}
    fields = [f.split() for f in schema.split(", ")]
    return pa.RecordBatch.from_arrays([pa.array(c, kinds[k]) for c, (_, k) in zip(columns, fields)], [n for n, _ in fields])


def lay_out(docs: DataFrame) -> tuple[DataFrame, int]:
    """Chunks (chunk, ids, sizes, body) of the texts in order of id, and the number of bytes. Chunk numbers ascend with the order."""
    kind = dict(docs.dtypes)["doc_id"]
    rows = docs.select("doc_id", F.coalesce("text", F.lit("")).cast("binary").alias("text")).withColumn("h", F.xxhash64("text"))
    total = docs.agg(F.sum(F.octet_length("text"))).first()[0] or 0
    parts = max(1, math.ceil(total / PART))
    order = [F.col("doc_id").asc_nulls_first(), F.col("h")]
    rows = (rows.repartitionByRange(parts, *order) if parts > 1 else rows.coalesce(1)).sortWithinPartitions(*order, "text")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        number, ids, texts, held = TaskContext.get().partitionId() << 32, [], [], 0

        def chunk() -> pa.RecordBatch:
            of_texts = pa.ListArray.from_arrays(pa.array([0, len(texts)], pa.int32()), pa.concat_arrays(ids))
            columns = [pa.array([number], pa.int64()), of_texts, pa.array([[len(t) for t in texts]], pa.list_(pa.int64())), pa.array([b"".join(texts)], pa.binary())]
            return pa.RecordBatch.from_arrays(columns, ["chunk", "ids", "sizes", "body"])

        for batch in batches:
            found = batch.column(1).to_pylist()
            at = 0
            for i, text in enumerate(found):
                if texts and held + len(text) > CHUNK:
                    ids.append(batch.column(0).slice(at, i - at))
                    at = i
                    yield chunk()
                    number, ids, texts, held = number + 1, [], [], 0
                texts.append(text)
                held += len(text)
            ids.append(batch.column(0).slice(at))
        if texts:
            yield chunk()

    return store.written(rows.select("doc_id", "text").mapInArrow(run, f"chunk bigint, ids array<{kind}>, sizes array<bigint>, body binary"), "chunks"), total


class Chunk:
    """A row of the chunk table."""

    def __init__(self, sizes, body):
        self.sizes = sizes.values.to_numpy(zero_copy_only=False) if hasattr(sizes, "values") else np.array(sizes, np.int64)
        self.body = np.frombuffer(body.as_buffer(), np.uint8) if hasattr(body, "as_buffer") else np.frombuffer(body, np.uint8)

    def sample(self) -> tuple[np.ndarray, np.ndarray]:
        """Sampled places and the keys of their GRAM bytes."""
        places = cover_places(self.sizes)
        return places, hashed(self.body, places, GRAM) >> _U(64 - GRAM_BITS)

    def strings(self, first: np.ndarray, last: np.ndarray, block: int = 0, blocks: int = 1) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
        """The block's suffixes among the runs, in order of their LENGTH bytes: places, whether each opens a tie, and both hashes."""
        places = expanded(first, last)
        key = hashed(self.body, places, LENGTH)
        if blocks > 1:
            own = key >> _U(64 - int(math.log2(blocks))) == block
            places, key = places[own], key[own]
        other = hashed(self.body, places, LENGTH, 1) >> _U(32)
        order = np.argsort(key, kind="stable")
        places, key, other = places[order], key[order], other[order]
        opens = np.concatenate(([True], (key[1:] != key[:-1]) | (other[1:] != other[:-1])))[: len(key)]
        return places, opens, key, other


GRAMS = "bucket bigint, chunk bigint, n int, keys binary, many binary"
STRINGS = "bucket bigint, chunk bigint, n int, keys binary, others binary"
RANKS = "chunk bigint, bucket bigint, n int, bits binary"


def sample_grams(chunks: DataFrame, shift: int) -> DataFrame:
    """GRAMS: for each chunk and bucket, the distinct keys of its sampled places, and which it has several times."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for number, sizes, body in zip(batch.column(0).to_pylist(), batch.column(1), batch.column(2)):
                keys = np.sort(Chunk(sizes, body).sample()[1])
                opens = np.flatnonzero(np.concatenate(([True], keys[1:] != keys[:-1]))[: len(keys)])
                many, keys = np.diff(np.append(opens, len(keys))) > 1, keys[opens]
                bucket, at = buckets_of(keys, shift)
                cuts = list(zip(at[:-1].tolist(), at[1:].tolist()))
                yield batch_of(GRAMS, [bucket, np.full(len(bucket), number), np.diff(at), [packed(keys[a:b], 6) for a, b in cuts], [bits(many[a:b]) for a, b in cuts]])

    return chunks.select("chunk", "sizes", "body").mapInArrow(run, GRAMS)


def one_bucket_at_a_time(batches: Iterator[pa.RecordBatch], settle) -> Iterator[pa.RecordBatch]:
    """settle(chunk numbers, sizes, first binary, second binary) of each bucket's rows, as RANKS."""
    held: list[tuple] = []
    for batch in batches:
        for row in zip(*(c.to_pylist() for c in batch.columns)):
            if held and row[0] != held[-1][0]:
                yield ranks_of(held, settle)
                held = []
            held.append(row)
    if held:
        yield ranks_of(held, settle)


def ranks_of(held: list[tuple], settle) -> pa.RecordBatch:
    bucket, chunk, n, first, second = zip(*held)
    flags, at = settle(n, first, second), np.concatenate(([0], np.cumsum(n)))
    return batch_of(RANKS, [chunk, bucket, n, [bits(flags[a:b]) for a, b in zip(at[:-1].tolist(), at[1:].tolist())]])


def tied_grams(n, keys, many) -> np.ndarray:
    """Which grams of a bucket are at several places."""
    key = np.concatenate([unpacked(k, 6) for k in keys])
    order = np.argsort(key, kind="stable")
    same = key[order][1:] == key[order][:-1]
    tied = np.concatenate([unbits(m, k) for m, k in zip(many, n)])
    tied[order[1:][same]] = True
    tied[order[:-1][same]] = True
    return tied


def later_strings(n, keys, others) -> np.ndarray:
    """Which strings of a bucket an earlier chunk has too; the chunks come in order."""
    key = np.concatenate([unpacked(k, 8) for k in keys])
    other = np.concatenate([np.frombuffer(o, "<u4") for o in others])
    order = np.argsort(key, kind="stable")
    same = key[order][1:] == key[order][:-1]
    alike = other[order][1:] == other[order][:-1]
    if (same & ~alike).any():
        order = np.lexsort((other, key))
        same = key[order][1:] == key[order][:-1]
        alike = other[order][1:] == other[order][:-1]
    later = np.zeros(len(key), bool)
    later[order[1:][same & alike]] = True
    return later


def ranked(rows: DataFrame, parts: int, settle) -> DataFrame:
    """RANKS of the rows, bucket by bucket."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        yield from one_bucket_at_a_time(batches, settle)

    return rows.repartitionById(parts, F.pmod("bucket", F.lit(parts)).cast("int")).sortWithinPartitions("bucket", "chunk").mapInArrow(run, RANKS)


def with_ranks(chunks: DataFrame, ranks: DataFrame) -> DataFrame:
    """chunks with `ranks`, those of all their buckets in order. Both grow with the corpus, so the join has one plan at every size."""
    each = ranks.groupBy("chunk").agg(F.array_sort(F.collect_list(F.struct("bucket", "n", "bits"))).alias("ranks"))
    return chunks.join(each.hint("shuffle_merge"), "chunk", "left")


def flags_of(ranks: list[dict] | None) -> np.ndarray:
    return np.concatenate([np.zeros(0, bool)] + [unbits(r["bits"], r["n"]) for r in ranks or []])


def with_candidates(chunks: DataFrame, ranks: DataFrame, kind: str) -> DataFrame:
    """chunks with `first` and `last`, the runs of suffixes that the ranks of the cover sample leave open."""
    schema = f"chunk bigint, ids array<{kind}>, sizes array<bigint>, body binary, first binary, last binary, open bigint"

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            first, last, count = [], [], []
            for sizes, body, ranks in zip(batch.column(2), batch.column(3), batch.column(4)):
                chunk = Chunk(sizes, body)
                places, keys = chunk.sample()
                distinct = np.unique(keys)
                tied = places[flags_of(ranks.as_py())[distinct.searchsorted(keys)]] if len(places) else places
                a, b = candidate_runs(chunk.sizes, tied)
                first.append(a.astype("<i8").tobytes())
                last.append(b.astype("<i8").tobytes())
                count.append(int((b - a + 1).sum()))
            yield pa.RecordBatch.from_arrays([*batch.columns[:4], pa.array(first, pa.binary()), pa.array(last, pa.binary()), pa.array(count, pa.int64())], ["chunk", "ids", "sizes", "body", "first", "last", "open"])

    return with_ranks(chunks, ranks).select("chunk", "ids", "sizes", "body", "ranks").mapInArrow(run, schema)


def runs_of(first, last) -> tuple[np.ndarray, np.ndarray]:
    return np.frombuffer(first.as_buffer(), "<i8"), np.frombuffer(last.as_buffer(), "<i8")


def block_strings(chunks: DataFrame, block: int, blocks: int, shift: int) -> DataFrame:
    """STRINGS: for each chunk and bucket of the block, its distinct open strings."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for number, sizes, body, first, last in zip(batch.column(0).to_pylist(), *(batch.column(i) for i in range(1, 5))):
                _, opens, key, other = Chunk(sizes, body).strings(*runs_of(first, last), block, blocks)
                key, other = key[opens], other[opens].astype("<u4")
                bucket, at = buckets_of(key, shift)
                cuts = list(zip(at[:-1].tolist(), at[1:].tolist()))
                yield batch_of(STRINGS, [bucket, np.full(len(bucket), number), np.diff(at), [packed(key[a:b], 8) for a, b in cuts], [other[a:b].tobytes() for a, b in cuts]])

    return chunks.select("chunk", "sizes", "body", "first", "last").mapInArrow(run, STRINGS)


def cut_texts(marked: DataFrame, ranks: DataFrame, kind: str, kept: bool) -> DataFrame:
    """(doc_id, n_bytes, n_removed, n_spans, kept_sha256, kept) of every document."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for ids, sizes, body, first, last, found in zip(*batch.columns):
                chunk = Chunk(sizes, body)
                # In order of their keys, so block after block as the ranks are.
                places, opens, _, _ = chunk.strings(*runs_of(first, last))
                later = ~opens
                later[opens] = flags_of(found.as_py())
                yield removed(chunk, ids.values, np.sort(places[later]), kept)

    schema = f"doc_id {kind}, n_bytes bigint, n_removed bigint, n_spans bigint, kept_sha256 string, kept binary"
    return with_ranks(marked, ranks).select("ids", "sizes", "body", "first", "last", "ranks").mapInArrow(run, schema)


def removed(chunk: Chunk, ids: pa.Array, later: np.ndarray, kept: bool) -> pa.RecordBatch:
    """The result's rows of a chunk whose strings at the places `later` also start earlier."""
    ends = np.cumsum(chunk.sizes)
    text = ends.searchsorted(later, "right")
    opens = np.flatnonzero(np.concatenate(([True], (later[1:] > later[:-1] + LENGTH) | (text[1:] != text[:-1])))[: len(later)])
    begin, end = later[opens], later[np.append(opens[1:], len(later))[: len(opens)] - 1] + LENGTH
    spans = np.bincount(text[opens], minlength=len(ends))
    gone = np.bincount(text[opens], end - begin, minlength=len(ends)).astype(np.int64)
    raw, at, digests, left = chunk.body.tobytes(), 0, [], []
    for start, stop, n in zip((ends - chunk.sizes).tolist(), ends.tolist(), spans.tolist()):
        pieces = []
        for a, b in zip(begin[at : at + n].tolist(), end[at : at + n].tolist()):
            pieces.append(raw[start:a])
            start = b
        at += n
        rest = b"".join([*pieces, raw[start:stop]])
        digests.append(hashlib.sha256(rest).hexdigest())
        left.append(rest if n and kept else None)
    return pa.RecordBatch.from_arrays([ids, pa.array(chunk.sizes), pa.array(gone), pa.array(spans.astype(np.int64)), pa.array(digests, pa.string()), pa.array(left, pa.binary())], ["doc_id", "n_bytes", "n_removed", "n_spans", "kept_sha256", "kept"])


def bits_for(strings: float, bucket: int) -> int:
    """Buckets are keys with the same high bits; so many bits make buckets of `bucket` strings or fewer."""
    return max(0, math.ceil(math.log2(max(1.0, strings / bucket))))


def tasks_for(strings: float, bucket: int) -> int:
    """A task for each bucket, up to MOST_TASKS; beyond, a task takes several in turn."""
    return min(MOST_TASKS, 1 << bits_for(strings, bucket))


def deduplicate(docs: DataFrame, kept: bool = True, blocks: int = BLOCKS, bucket: int = BUCKET) -> DataFrame:
    """(doc_id, n_bytes, n_removed, n_spans, kept_sha256, kept) of every document; `kept` holds the remaining bytes where some were removed."""
    kind = dict(docs.dtypes)["doc_id"]
    chunks, total = lay_out(docs)
    grams = store.written(ranked(sample_grams(chunks, GRAM_BITS - bits_for(total * len(COVER) / PERIOD, bucket)), tasks_for(total * len(COVER) / PERIOD, bucket), tied_grams), "cover-ranks")
    marked = store.written(with_candidates(chunks, grams, kind), "open-suffixes")
    store.dropped(chunks, grams)
    each = (marked.agg(F.sum("open")).first()[0] or 0) / blocks
    shift = 64 - int(math.log2(blocks)) - bits_for(each, bucket)
    done = [store.written(ranked(block_strings(marked, b, blocks, shift), tasks_for(each, bucket), later_strings), "block-ranks") for b in range(blocks)]
    return cut_texts(marked, reduce(DataFrame.unionByName, done), kind, kept)
