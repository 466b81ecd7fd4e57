"""Document fingerprints: bottom-k sketches of word-shingle hashes.

A sketch holds the K smallest distinct hashes (48 bits) of a text's shingles of
five words. Sketches of parts merge into the sketch of the whole, and two
sketches estimate resemblance, containment and distinct shingle counts; a text
with fewer than K shingles is held exactly.

Edge cases: null text is empty; texts without words have an empty sketch, and
two such resemble each other fully; rows that repeat give repeated rows, each
next to the other in order; ids must be integers; extra columns are ignored; an empty table gives an
empty result.
"""

from __future__ import annotations

import base64
import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from sigloom.llm import ordered, words

K = 128
BITS = 48


def sketch_hashes(hashes: np.ndarray, k: int = K) -> np.ndarray:
    """The k smallest distinct values, sorted, of 64-bit shingle hashes cut to 48 bits."""
    short = hashes >> np.uint64(64 - BITS)
    take = 4 * k
    while take < len(short):
        found = np.unique(np.partition(short, take)[:take])
        if len(found) >= k:
            return found[:k]
        take *= 4
    return np.unique(short)[:k]


def sketches(texts: list[str], k: int = K) -> list[np.ndarray]:
    out: list[np.ndarray] = []
    for part in words.chunks(texts):
        hashes, at = words.shingle_hashes(part)
        out += [sketch_hashes(hashes[at[i] : at[i + 1]], k) for i in range(len(part))]
    return out


def encode(sketch: np.ndarray) -> str:
    """Text form: 8 characters for each value."""
    return base64.b64encode(np.ascontiguousarray(sketch.astype(">u8").view(np.uint8).reshape(-1, 8)[:, 2:]).tobytes()).decode() if len(sketch) else ""


def decode(text: str) -> np.ndarray:
    raw = np.frombuffer(base64.b64decode(text), np.uint8).reshape(-1, 6)
    return np.concatenate((np.zeros((len(raw), 2), np.uint8), raw), axis=1).reshape(-1).view(">u8").astype(np.uint64)


def merge(a: np.ndarray, b: np.ndarray, k: int = K) -> np.ndarray:
    return np.union1d(a, b)[:k]


def resemblance(a: np.ndarray, b: np.ndarray, k: int = K) -> float:
    """Estimated Jaccard likeness: the share of the union's sketch that both hold."""
    if not len(a) or not len(b):
        return float(len(a) == len(b))
    union = merge(a, b, k)
    return float(np.isin(union, np.intersect1d(a, b, True), True).mean())


def distinct(a: np.ndarray, k: int = K) -> float:
    """Estimated number of distinct shingles."""
    return float(len(a)) if len(a) < k else (k - 1) * 2.0**BITS / (float(a[-1]) + 1)


def containment(a: np.ndarray, b: np.ndarray, k: int = K) -> float:
    """Estimated share of a's shingles that b has too."""
    if not len(a):
        return 1.0
    return min(1.0, resemblance(a, b, k) * distinct(merge(a, b, k), k) / distinct(a, k))


def fingerprint(docs: DataFrame, text: str = "text", k: int = K) -> DataFrame:
    """docs with `fingerprint` and `n_shingles`, its estimated number of distinct shingles."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            found = sketches([t or "" for t in batch.column(text).to_pylist()], k)
            yield batch.append_column("fingerprint", pa.array([encode(s) for s in found], pa.string())).append_column("n_shingles", pa.array([distinct(s, k) for s in found], pa.float64()))

    docs = docs.drop("fingerprint", "n_shingles")
    schema = T.StructType([*docs.schema.fields, T.StructField("fingerprint", T.StringType()), T.StructField("n_shingles", T.DoubleType())])
    return docs.mapInArrow(run, schema)


def merged(fingerprints: DataFrame, key: str, k: int = K) -> DataFrame:
    """One sketch for each value of `key`: partitions merge their own first, so a hot key costs a sketch per partition."""
    kind = dict(fingerprints.dtypes)[key]

    def partial(batches):
        held: dict = {}
        for batch in batches:
            for value, text in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
                sketch = decode(text or "")
                held[value] = merge(held[value], sketch, k) if value in held else sketch
        arrow = pa.array(list(held), batch.schema.field(0).type) if held else None
        if held:
            yield pa.RecordBatch.from_arrays([arrow, pa.array([encode(s) for s in held.values()], pa.string())], ["key", "fingerprint"])

    schema = f"key {kind}, fingerprint string"
    rows = fingerprints.select(F.col(key).alias("key"), "fingerprint").mapInArrow(partial, schema)
    return rows.repartition("key").mapInArrow(partial, schema).withColumnRenamed("key", key)


SCHEMA = "doc_id bigint, n_chars bigint, edited_sha256 string, fingerprint string, edited_fingerprint string, near_edited double, near_next double, n_shingles double, edited_in_text double"


def neighbours(docs: DataFrame, k: int = K) -> DataFrame:
    """Fingerprints of each text, of the text whose second half the next document's start replaces, and their likeness."""
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.coalesce("text", F.lit("")).alias("text"))
    rows, _ = ordered.in_blocks(rows.withColumn("_tie", F.xxhash64("text")), "doc_id", "_tie")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held = None  # the row that waits for its successor: (block, id, text, sketch)
        for batch in batches:
            block, guest = batch.column(2).to_pylist(), batch.column(3).to_pylist()
            ids, texts = batch.column(0).to_pylist(), batch.column(1).to_pylist()
            at = 0
            for part in words.chunks(texts):
                found = sketches(part, k)
                pairs = []
                for i, (text, sketch) in enumerate(zip(part, found), at):
                    now = (block[i], ids[i], text, sketch)
                    if held and held[0] == block[i]:
                        pairs.append((held, now))
                    held = None if guest[i] else now
                at += len(part)
                if pairs:
                    yield compare(pairs)

    def compare(pairs) -> pa.RecordBatch:
        edited = []
        for (_, _, text, _), (_, _, after, _) in pairs:
            half = len(text) // 2
            edited.append(text[: len(text) - half] + after[:half])
        out = []
        for (a, b), e, s in zip(pairs, edited, sketches(edited, k)):
            out.append((a[1], len(a[2]), hashlib.sha256(e.encode()).hexdigest(), encode(a[3]), encode(s), resemblance(a[3], s, k), resemblance(a[3], b[3], k), distinct(a[3], k), containment(a[3], s, k)))
        types = [pa.int64(), pa.int64(), pa.string(), pa.string(), pa.string(), pa.float64(), pa.float64(), pa.float64(), pa.float64()]
        return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*out), types)], [c.split()[0] for c in SCHEMA.split(", ")])

    return rows.select("doc_id", "text", "_block", "_guest").mapInArrow(run, SCHEMA)
