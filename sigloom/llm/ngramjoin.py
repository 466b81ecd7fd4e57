"""N-gram Jaccard join with Bayesian candidate pruning.

Texts with the same set of word shingles form one class, compared once.
MinHash bands propose candidates. Their MinHash values are compared a slice at
a time, and a pair is dropped as soon as the posterior probability that it
reaches the threshold falls below TOLERANCE: with a uniform prior and m of n
values equal, that is P(Bin(n + 1, t) <= m). What survives is joined into
groups, and every pair of a group is verified on the exact shingle sets.

Large buckets and groups are dealt in blocks of about BLOCK members, or of
SHINGLES shingles if that is less, every two blocks meeting in one task, so no
task holds more than two blocks and no pair leaves its task: a task returns link
counts and a spanning forest. The result has one row for each document, never the
pairs of a group. A member of a group of b blocks is moved b times; groups of up
to BLOCK members, once.

A pair at the threshold is missed by all bands with probability 3e-6, and by
the pruning with less than TOLERANCE a slice; both shrink fast above it.

Edge cases: null text is empty; texts without words are of one class only with
equal texts; null ids sort first; ids of any type that can be ordered are kept
as they are; rows that repeat are copies of each other; extra columns are ignored; an empty table gives an empty result.
"""

from __future__ import annotations

import base64
import hashlib
import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from sigloom.llm import components, store, words

THRESHOLD = 0.8
BANDS, ROWS = 32, 5
HASHES = BANDS * ROWS
TOLERANCE = 1e-4
SLICE = 32
BLOCK, SHINGLES = 1024, 1 << 21
#: Pairs, and cells of a membership matrix, that a task handles at once.
PAIRS, CELLS = 1 << 18, 1 << 24

with np.errstate(over="ignore"):
    _A = words.mixed(np.arange(101, 101 + HASHES, dtype=np.uint64)).astype(np.uint32) | np.uint32(1)
    _B = words.mixed(np.arange(9001, 9001 + HASHES, dtype=np.uint64)).astype(np.uint32)


def least_matches(threshold: float = THRESHOLD, tolerance: float = TOLERANCE) -> dict[int, int]:
    """By number of values compared, the fewest equal ones with which a pair goes on.

    One byte of each value is compared, so equality has probability j + (1 - j) / 256.
    """
    t, out = threshold + (1 - threshold) / 256, {}
    for n in range(SLICE, HASHES + 1, SLICE):
        below = 0.0
        for m in range(n + 1):
            below += math.comb(n + 1, m) * t**m * (1 - t) ** (n + 1 - m)
            if below >= tolerance:
                out[n] = m
                break
    return out


def minhashes(hashes: np.ndarray, at: np.ndarray) -> np.ndarray:
    """MinHash values of each text's shingles, HASHES columns; texts without shingles are not asked for."""
    base = (hashes >> np.uint64(32)).astype(np.uint32)
    out = np.empty((len(at) - 1, HASHES), np.uint32)
    for i in range(HASHES):
        out[:, i] = np.minimum.reduceat(base * _A[i] + _B[i], at[:-1])
    return out


def band_hashes(values: np.ndarray) -> np.ndarray:
    """64-bit hashes of the bands, the band's number included."""
    total = np.zeros((len(values), BANDS), np.uint64)
    split = values.reshape(-1, BANDS, ROWS).astype(np.uint64)
    for r in range(ROWS):
        total = words.mixed(total + split[:, :, r] + np.uint64(r + 1))
    return words.mixed(total + np.arange(BANDS, dtype=np.uint64))


def class_name(shingles: np.ndarray, text: str) -> str:
    raw = shingles.tobytes() if len(shingles) else b"text:" + text.encode("utf-8", "replace")
    return base64.b64encode(hashlib.blake2b(raw, digest_size=15).digest()).decode()


def signatures(docs: DataFrame) -> DataFrame:
    """(doc_id, h, class, n, signature, bands) of every document."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            ids, at = batch.column(0), 0
            for part in words.chunks([t or "" for t in batch.column(1).to_pylist()]):
                hashes, begins = words.shingle_hashes(part)
                sets = [np.unique(hashes[begins[i] : begins[i + 1]]) for i in range(len(part))]
                full = np.flatnonzero(np.diff(begins))
                signature, bands = [b""] * len(part), [[]] * len(part)
                if len(full):
                    values = minhashes(hashes, np.append(begins[full], begins[-1]))
                    keys = band_hashes(values).view(np.int64)
                    for row, i in enumerate(full):
                        signature[i], bands[i] = (values[row] & np.uint32(255)).astype(np.uint8).tobytes(), keys[row].tolist()
                yield pa.RecordBatch.from_arrays(
                    [ids.slice(at, len(part)), batch.column(2).slice(at, len(part)), pa.array([class_name(s, t) for s, t in zip(sets, part)]), pa.array([len(s) for s in sets], pa.int32()), pa.array(signature, pa.binary()), pa.array(bands, pa.list_(pa.int64()))],
                    ["doc_id", "h", "class", "n", "signature", "bands"],
                )
                at += len(part)

    rows = docs.select("doc_id", "text", F.xxhash64("text").alias("h"))
    return rows.mapInArrow(run, f"doc_id {dict(docs.dtypes)['doc_id']}, h bigint, class string, n int, signature binary, bands array<bigint>")


def in_pairs_of_blocks(rows: DataFrame, key: str, blocks: Column, member: Column) -> DataFrame:
    """rows, each once for every two blocks of its group that it has a part in, with `_lo`, `_hi` and its own `_b`; dealt and sorted by them."""
    rows = rows.withColumn("_nb", F.greatest(blocks.cast("int"), F.lit(1))).withColumn("_b", F.pmod(F.xxhash64(F.lit(3), member), F.col("_nb")).cast("int"))
    rows = rows.withColumn("_o", F.explode(F.sequence(F.lit(0), F.col("_nb") - 1)))
    rows = rows.withColumn("_lo", F.least("_b", "_o")).withColumn("_hi", F.greatest("_b", "_o")).drop("_o")
    return rows.repartition(key, "_lo", "_hi").sortWithinPartitions(key, "_lo", "_hi")


def groups(batches: Iterator[pa.RecordBatch], columns: int) -> Iterator[dict]:
    """Runs of rows that agree in the first `columns` columns, as columns of lists."""
    held: dict[str, list] = {}
    now = None
    for batch in batches:
        data = {n: batch.column(i).to_pylist() for i, n in enumerate(batch.schema.names)}
        keys = list(zip(*(data[n] for n in batch.schema.names[:columns])))
        start = 0
        for i in range(1, len(keys) + 1):
            if i < len(keys) and keys[i] == keys[start]:
                continue
            if now != keys[start]:
                if held:
                    yield held
                held, now = {n: [] for n in data}, keys[start]
            for n in data:
                held[n] += data[n][start:i]
            start = i
    if held:
        yield held


def pairs_of(own: np.ndarray, lo: int, hi: int) -> tuple[np.ndarray, np.ndarray]:
    """Index pairs that two blocks are to compare: all of a block with itself, or across the two."""
    if lo == hi:
        return np.triu_indices(len(own), 1)
    a, b = np.flatnonzero(own == lo), np.flatnonzero(own == hi)
    return np.repeat(a, len(b)), np.tile(b, len(a))


def forest(n: int, a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """The least member reachable from each of n, along the links (a, b)."""
    label = np.arange(n)
    while len(a):
        least = np.minimum(label[a], label[b])
        before = label.copy()
        np.minimum.at(label, a, least)
        np.minimum.at(label, b, least)
        label = label[label]
        if (label == before).all():
            break
    return label


def survivors(signature: np.ndarray, a: np.ndarray, b: np.ndarray, least: dict[int, int]) -> np.ndarray:
    """Which pairs the slices leave."""
    alive, equal = np.arange(len(a)), np.zeros(len(a), np.int32)
    for n, m in least.items():
        part = slice(n - SLICE, n)
        equal[alive] += (signature[a[alive], part] == signature[b[alive], part]).sum(1, dtype=np.int32)
        alive = alive[equal[alive] >= m]
        if not len(alive):
            break
    return alive


def candidates(classes: DataFrame, threshold: float, tolerance: float, block: int) -> DataFrame:
    """Forest edges (a, b) between classes that the pruning leaves."""
    least = least_matches(threshold, tolerance)
    banded = classes.select("class", F.explode("bands").alias("bucket"))
    # Written, so that the members of a large bucket come by an exchange of their own, which AQE splits.
    shared = store.written(banded.groupBy("bucket").agg(F.count("*").alias("members")).filter("members > 1"), "buckets")
    # All of these grow with the corpus, so the joins have one plan at every size.
    members = banded.join(shared.hint("shuffle_merge"), "bucket")
    rows = members.join(classes.select("class", "signature", F.transform("bands", lambda x: F.shiftright(x, 32).cast("int")).alias("short")).hint("shuffle_merge"), "class")
    rows = in_pairs_of_blocks(rows, "bucket", F.ceil(F.col("members") / block), F.col("class"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        names: list[str] = []
        sig: list[bytes] = []
        short: list[list[int]] = []
        left: list[np.ndarray] = []
        right: list[np.ndarray] = []
        bucket: list[np.ndarray] = []
        waiting = 0

        def settle() -> pa.RecordBatch:
            signature = np.frombuffer(b"".join(sig), np.uint8).reshape(-1, HASHES)
            bands = np.array(short, np.int32)
            a, b, of = np.concatenate(left), np.concatenate(right), np.concatenate(bucket)
            edges_a, edges_b = [], []
            for at in range(0, len(a), PAIRS):
                x, y, z = a[at : at + PAIRS], b[at : at + PAIRS], of[at : at + PAIRS]
                # A pair is judged in the first bucket that it shares.
                first = np.argmax(bands[x] == bands[y], axis=1)
                own = bands[x, first] == z
                x, y = x[own], y[own]
                kept = survivors(signature, x, y, least)
                edges_a.append(x[kept])
                edges_b.append(y[kept])
            label = forest(len(names), np.concatenate(edges_a), np.concatenate(edges_b))
            linked = np.flatnonzero(label != np.arange(len(names)))
            return pa.RecordBatch.from_arrays([pa.array([names[i] for i in linked], pa.string()), pa.array([names[i] for i in label[linked]], pa.string())], ["a", "b"])

        for group in groups(batches, 3):
            own = np.array(group["_b"])
            x, y = pairs_of(own, group["_lo"][0], group["_hi"][0])
            if len(x):
                left.append(x + len(names))
                right.append(y + len(names))
                bucket.append(np.full(len(x), group["bucket"][0] >> 32, np.int32))
                waiting += len(x)
                names += group["class"]
                sig += group["signature"]
                short += group["short"]
            if waiting >= PAIRS:
                yield settle()
                names, sig, short, left, right, bucket, waiting = [], [], [], [], [], [], 0
        if waiting:
            yield settle()

    return rows.select("bucket", "_lo", "_hi", "_b", "class", "signature", "short").mapInArrow(run, "a string, b string")


def likeness(sets: list[np.ndarray]) -> np.ndarray:
    """Exact Jaccard likeness of all pairs of sorted sets."""
    size = np.array([len(s) for s in sets])
    member = np.repeat(np.arange(len(sets)), size)
    order = np.argsort(np.concatenate(sets), kind="stable")
    value = np.concatenate(sets)[order]
    change = np.concatenate(([True], value[1:] != value[:-1]))
    column = np.cumsum(change) - 1
    often = np.bincount(column) > 1
    place = np.cumsum(often) - 1
    keep = often[column]
    rows, columns = member[order][keep], place[column[keep]]
    common = np.zeros((len(sets), len(sets)), np.float32)
    if not often.any():
        return common
    step = max(1, CELLS // len(sets))
    total = int(often.sum())
    for at in range(0, total, step):
        inside = slice(*np.searchsorted(columns, (at, min(total, at + step))))
        matrix = np.zeros((len(sets), min(step, total - at)), np.float32)
        matrix[rows[inside], columns[inside] - at] = 1
        common += matrix @ matrix.T
    return common / (size[:, None] + size[None, :] - common)


def join(docs: DataFrame, threshold: float = THRESHOLD, tolerance: float = TOLERANCE, block: int = BLOCK) -> DataFrame:
    """One row for each document: doc_id, class_id, n_links, text_links, n_copies, keep.

    class_id is the least id of the documents joined by links of `threshold` or more. n_links counts the other
    documents that this one is linked to, copies included; text_links the different shingle sets among them.
    `keep` marks one document of each class; `h` is xxhash64 of the text.
    """
    signed = store.written(signatures(docs), "signatures")
    classes = signed.groupBy("class").agg(F.count("*").alias("copies"), F.min(F.struct("doc_id", "h")).alias("first"), F.first("n").alias("n"), F.first("signature").alias("signature"), F.first("bands").alias("bands"))
    classes = store.written(classes, "classes")
    grouped = components.components(candidates(classes, threshold, tolerance, block))
    grouped = store.written(grouped.join(classes.select(F.col("class").alias("node"), "copies", "first", "n").hint("shuffle_merge"), "node"), "groups")
    sizes = store.written(grouped.groupBy("root").agg(F.count("*").alias("members"), F.sum("n").alias("weight")), "group-sizes")

    def shingle(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for at in range(0, batch.num_rows, 512):
                part = batch.slice(at, 512)
                sets = words.shingle_sets([t or "" for t in part.column(0).to_pylist()])
                yield pa.RecordBatch.from_arrays([pa.array([s.tobytes() for s in sets], pa.binary()), *part.columns[1:]], ["shingles", *part.schema.names[1:]])

    texts = docs.select(F.col("doc_id").alias("_id"), F.xxhash64("text").alias("_h"), "text")
    met = texts.join(grouped.drop("n").hint("shuffle_merge"), texts["_id"].eqNullSafe(F.col("first.doc_id")) & (texts["_h"] == F.col("first.h")))
    # Rows that repeat give one set; they lie in one partition already.
    met = met.dropDuplicates(["_id", "_h", "node"])
    met = met.select("text", "node", "root", "copies").mapInArrow(shingle, "shingles binary, node string, root string, copies bigint")
    blocks = F.greatest(F.ceil(F.col("members") / block), F.ceil(F.col("weight") / SHINGLES))
    rows = in_pairs_of_blocks(met.join(sizes.hint("shuffle_merge"), "root"), "root", blocks, F.col("node"))

    def verify(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        out: tuple[list, ...] = ([], [], [], [], [])
        for group in groups(batches, 3):
            names, copies, own = group["node"], np.array(group["copies"]), np.array(group["_b"])
            near = likeness([np.frombuffer(s, np.uint64) for s in group["shingles"]]) >= threshold - 1e-6
            np.fill_diagonal(near, False)
            if group["_lo"][0] != group["_hi"][0]:
                near &= own[:, None] != own[None, :]
            label = forest(len(names), *np.nonzero(near))
            for column, values in zip(out, (names, [names[i] for i in label], near.sum(1).tolist(), (near @ copies).tolist(), [n == 1 for n in group["_nb"]])):
                column += values
            if len(out[0]) > 5000:
                yield pa.RecordBatch.from_arrays([pa.array(c) for c in out], FOUND)
                out = ([], [], [], [], [])
        if out[0]:
            yield pa.RecordBatch.from_arrays([pa.array(c) for c in out], FOUND)

    rows = rows.select("root", "_lo", "_hi", "_b", "_nb", "node", "copies", "shingles")
    found = store.written(rows.mapInArrow(verify, "node string, label string, text_links bigint, links bigint, whole boolean"), "verified")
    counted = found.groupBy("node").agg(F.sum("text_links").alias("text_links"), F.sum("links").alias("links"))
    settled = found.filter("whole").select("node", F.col("label").alias("root"))
    edges = found.filter("NOT whole AND node <> label").select(F.col("node").alias("a"), F.col("label").alias("b"))
    if not edges.isEmpty():
        settled = settled.union(components.components(edges))
    linked = counted.join(settled.hint("shuffle_merge"), "node", "left").select(F.col("node").alias("class"), F.coalesce("root", "node").alias("root"), "text_links", "links")
    named = classes.select("class", "copies", "first").join(linked.hint("shuffle_merge"), "class", "left").withColumn("root", F.coalesce("root", "class"))
    named = store.written(named, "classes-in-groups")
    store.dropped(classes, grouped, sizes, found)
    least = store.written(named.groupBy("root").agg(F.min("first").alias("least")), "group-firsts")
    named = named.join(least.hint("shuffle_merge"), "root").select("class", "copies", "least", F.coalesce("text_links", F.lit(0)).alias("text_links"), F.coalesce("links", F.lit(0)).alias("links"))
    return signed.select("doc_id", "h", "class").join(named.hint("shuffle_merge"), "class").select(
        "doc_id",
        F.col("least.doc_id").alias("class_id"),
        (F.col("links") + F.col("copies") - 1).cast("long").alias("n_links"),
        F.col("text_links").cast("long").alias("text_links"),
        F.col("copies").cast("long").alias("n_copies"),
        (F.struct("doc_id", "h") == F.col("least")).alias("keep"),
        "h",
    )


FOUND = ["node", "label", "text_links", "links", "whole"]


def keep_one(docs: DataFrame, threshold: float = THRESHOLD) -> DataFrame:
    """One document of each class, with all its columns."""
    kept = join(docs, threshold).filter("keep").select(F.col("doc_id").alias("_id"), F.col("h").alias("_h")).distinct()
    rows = docs.select(F.struct(*[F.col(f"`{c}`") for c in docs.columns]).alias("_rec"), F.col("doc_id").alias("_doc"), F.xxhash64("text").alias("_hash"))
    rows = rows.join(kept.hint("shuffle_merge"), F.col("_doc").eqNullSafe(F.col("_id")) & (F.col("_hash") == F.col("_h")), "left_semi")
    return rows.dropDuplicates(["_doc", "_hash"]).select("_rec.*")
