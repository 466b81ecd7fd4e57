"""Benchmark decontamination by q-gram lemma filtering and banded alignment.

Texts and items are lower-cased with white space made single. Items are cut
into overlapping windows. A window of m bytes within e edits of a stretch of a
text shares at least m - q + 1 - q e of its q-grams with it, all near one
diagonal (text place minus window place). So shared q-grams are counted in
overlapping diagonal bands, bands below the bound are dropped, and the rest
are aligned inside their band, which decides.

The benchmark is the query set. It is taken in blocks of BLOCK_BYTES, and each
block goes to all tasks; every text is scanned whole. The corpus is read once:
a task takes each batch of texts through the blocks in turn, holding one index.
An excerpt of an item is sure to be found from WINDOW + STEP - 1 bytes on.

Edge cases: null and empty texts and items hold nothing and are never found;
items below Q bytes after normalisation are found where they stand exactly, as
whole words; equal items are each reported; an item met at several places is
reported once, with its longest stretch; rows that repeat are each reported; ids
keep their types; extra columns are ignored; empty tables give an empty result.
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_type

from sigloom.llm import words

#: Bytes of a q-gram; eight make one machine word, so grams are compared exactly.
Q = 8
#: Edits allowed, as a share of a window's bytes.
EDITS = 0.10
#: Window length and step, in bytes.
WINDOW, STEP = 128, 64
#: Item bytes that are sent to the tasks at once.
BLOCK_BYTES = 2 << 20
#: Shared grams expanded at once, and candidates aligned at once.
EXPANDED, ALIGNED = 1 << 21, 256
_BITS = 22
_MULTIPLIER = np.uint64(0x9E3779B97F4A7C15)


def normal(text: str | None) -> bytes:
    return " ".join((text or "").lower().split()).encode("utf-8", "replace")


def grams(buf: np.ndarray) -> np.ndarray:
    """The Q bytes at each place, as one integer."""
    n = len(buf) - Q + 1
    return np.ndarray((max(0, n),), "<u8", buf.tobytes(), strides=(1,)) if n > 0 else np.zeros(0, np.uint64)


@dataclass
class Index:
    """Windows of a block of items, and the places of their grams."""

    item: np.ndarray
    pieces: list[bytes]
    edits: np.ndarray
    bound: np.ndarray
    gram: np.ndarray
    begin: np.ndarray
    window: np.ndarray
    place: np.ndarray
    seen: np.ndarray
    short: list[tuple[int, re.Pattern]]

    @staticmethod
    def build(items: list[str | None]) -> Index:
        owner, pieces, short = [], [], []
        for number, text in enumerate(items):
            raw = normal(text)
            if len(raw) < Q:
                if raw:
                    short.append((number, re.compile(rb"(?<![0-9a-z\x80-\xff])%b(?![0-9a-z\x80-\xff])" % re.escape(raw))))
                continue
            starts = range(0, max(1, len(raw) - WINDOW + 1), STEP) if len(raw) > WINDOW else [0]
            cuts = dict.fromkeys(raw[s : s + WINDOW] for s in [*starts, max(0, len(raw) - WINDOW)])
            pieces += cuts
            owner += [number] * len(cuts)
        size = np.array([len(p) for p in pieces], int)
        edits = np.minimum((size * EDITS).astype(int), np.maximum(0, (size - Q) // Q))
        each = [grams(np.frombuffer(p, np.uint8)) for p in pieces]
        window = np.repeat(np.arange(len(pieces), dtype=np.int32), [len(g) for g in each])
        place = np.concatenate([np.zeros(0, np.int16), *(np.arange(len(g), dtype=np.int16) for g in each)])
        all_grams = np.concatenate([np.zeros(0, np.uint64), *each])
        order = np.argsort(all_grams, kind="stable")
        gram, begin = np.unique(all_grams[order], return_index=True)
        seen = np.zeros(1 << _BITS, bool)
        seen[gram * _MULTIPLIER >> np.uint64(64 - _BITS)] = True
        return Index(np.array(owner, int), pieces, edits, size - Q + 1 - Q * edits, gram, np.append(begin, len(order)), window[order], place[order], seen, short)


def bands(index: Index, buf: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(window, band) with enough shared grams. Band b of a window holds the diagonals from b (e + 1) to (b + 2) (e + 1) - 1."""
    found = grams(buf)
    if not len(index.gram):
        return np.zeros(0, int), np.zeros(0, int)
    hits = np.flatnonzero(index.seen[found * _MULTIPLIER >> np.uint64(64 - _BITS)])
    at = np.searchsorted(index.gram, found[hits])
    real = (at < len(index.gram)) & (index.gram[np.minimum(at, len(index.gram) - 1)] == found[hits])
    hits, at = hits[real], at[real]
    many = index.begin[at + 1] - index.begin[at]
    keys, counts = [], []
    step = np.searchsorted(np.cumsum(many), np.arange(EXPANDED, int(many.sum()) + EXPANDED, EXPANDED)) + 1 if len(many) else []
    first = 0
    for last in step:
        h, a, m = hits[first:last], at[first:last], many[first:last]
        first = last
        if not len(h):
            continue
        which = np.arange(m.sum()) - np.repeat(np.cumsum(m) - m, m) + np.repeat(index.begin[a], m)
        window = index.window[which].astype(np.int64)
        # Diagonals from -WINDOW on; shifted so that bands are not negative.
        band = (np.repeat(h, m) - index.place[which] + WINDOW) // (index.edits[window] + 1)
        key, n = np.unique((window << 40) + band, return_counts=True)
        keys.append(key)
        counts.append(n)
    if not keys:
        return np.zeros(0, int), np.zeros(0, int)
    key = np.concatenate(keys)
    key, back = np.unique(key, return_inverse=True)
    count = np.bincount(back, np.concatenate(counts)).astype(int)
    # A band is two steps wide: a step's grams and those of the next.
    wide = np.sort(np.concatenate((key, key - 1)), kind="stable")
    wide = wide[np.append(True, wide[1:] != wide[:-1])]
    wide = wide[wide >= 0]
    total = np.zeros(len(wide), int)
    for shift in (0, 1):
        place = np.minimum(np.searchsorted(key, wide + shift), len(key) - 1)
        total += np.where(key[place] == wide + shift, count[place], 0)
    window = wide >> 40
    enough = (window < len(index.bound)) & (total >= index.bound[np.minimum(window, len(index.bound) - 1)])
    return window[enough], wide[enough] & ((1 << 40) - 1)


def align(pieces: list[bytes], stretches: list[bytes], width: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Edits, begin and end of each piece's best place in its stretch, over the diagonals 0 to width - 1.

    A stretch has len(piece) + width bytes. Costs and begins share one integer: cost * 4096 + begin.
    """
    longest = max(map(len, pieces))
    p = np.zeros((len(pieces), longest), np.uint8)
    t = np.zeros((len(pieces), longest + width), np.uint8)
    for i, (a, b) in enumerate(zip(pieces, stretches)):
        p[i, : len(a)] = np.frombuffer(a, np.uint8)
        t[i, : len(b)] = np.frombuffer(b, np.uint8)
    lengths, unit = np.array([len(a) for a in pieces]), 4096
    ramp = np.arange(width) * unit
    row = np.tile(np.arange(width), (len(pieces), 1))
    out = np.zeros((len(pieces), width), row.dtype)
    for i in range(longest):
        new = row + unit * (p[:, i : i + 1] != t[:, i : i + width])
        new[:, :-1] = np.minimum(new[:, :-1], row[:, 1:] + unit)
        row = np.minimum.accumulate(new - ramp, axis=1) + ramp
        done = lengths == i + 1
        out[done] = row[done]
    best = out.argmin(1)
    value = out[np.arange(len(pieces)), best]
    return value // unit, value % unit, best + lengths


def leaks(index: Index, texts: list[bytes]) -> list[tuple[int, int, int, int, int]]:
    """(text, item, edits, begin, end) of the items found in each text: the longest stretch that its windows cover without a gap, the fewest edits there."""
    ends = np.cumsum([len(t) + 1 for t in texts])
    joined = b"\n".join(texts) + b"\n"
    window, band = bands(index, np.frombuffer(joined, np.uint8))
    found: dict[tuple[int, int], list[tuple[int, int, int]]] = {}
    for item, pattern in index.short:
        for m in pattern.finditer(joined):
            doc = int(np.searchsorted(ends, m.start(), "right"))
            start = 0 if doc == 0 else int(ends[doc - 1])
            found.setdefault((doc, item), []).append((m.start() - start, m.end() - start, 0))
    order = np.argsort(index.edits[window], kind="stable")
    window, band = window[order], band[order]
    for at in range(0, len(window), ALIGNED):
        w, b = window[at : at + ALIGNED], band[at : at + ALIGNED]
        jobs = []
        for k, (piece, e) in enumerate(zip(w, index.edits[w])):
            low = int(b[k]) * (int(e) + 1) - WINDOW
            reach = low + 2 * (int(e) + 1) + len(index.pieces[piece])
            # A band may touch the ends of several texts.
            for doc in range(int(np.searchsorted(ends, max(low, 0), "right")), min(len(texts) - 1, int(np.searchsorted(ends, reach, "right"))) + 1):
                start = 0 if doc == 0 else int(ends[doc - 1])
                jobs.append((int(piece), doc, low - int(e), start, int(ends[doc]) - 1, int(e)))
        if not jobs:
            continue
        width = max(4 * j[5] + 2 for j in jobs)
        pieces, stretches = [], []
        for piece, _, low, start, end, _ in jobs:
            size = len(index.pieces[piece]) + width
            head = max(0, start - low)
            pieces.append(index.pieces[piece])
            # Bytes of other texts are blank: byte 0 is in no window.
            stretches.append(b"\0" * min(size, head) + joined[low + head : max(low + head, min(low + size, end))])
        edits, begins, stops = align(pieces, stretches, width)
        for job, cost, begin, stop in zip(jobs, edits.tolist(), begins.tolist(), stops.tolist()):
            piece, doc, low, start, _, most = job
            if cost <= most:
                found.setdefault((doc, int(index.item[piece])), []).append((low + begin - start, low + stop - start, cost))
    return [(doc, item, *longest(spots)) for (doc, item), spots in sorted(found.items())]


def longest(spots: list[tuple[int, int, int]]) -> tuple[int, int, int]:
    """(edits, begin, end) of the longest stretch, the first such, that spots (begin, end, edits) cover without a gap."""
    best = now = None
    for begin, end, edits in sorted(spots):
        if now is None or begin > now[2]:
            now = [edits, begin, end]
        else:
            now = [min(now[0], edits), now[1], max(now[2], end)]
        if best is None or now[2] - now[1] > best[2] - best[1]:
            best = now
    return tuple(best)


def blocks(benchmark: DataFrame) -> list:
    """The items in blocks of about BLOCK_BYTES, each as a broadcast of (ids, texts). The benchmark passes the driver block by block."""
    out, ids, texts, held = [], [], [], 0
    context = benchmark.sparkSession.sparkContext
    for row in benchmark.select("item_id", "text").orderBy("item_id", "text").toLocalIterator():
        ids.append(row.item_id)
        texts.append(row.text)
        held += len(row.text or "")
        if held >= BLOCK_BYTES:
            out.append(context.broadcast((ids, texts)))
            ids, texts, held = [], [], 0
    return [*out, context.broadcast((ids, texts))] if ids else out


_OPEN: dict[int, tuple[list, Index]] = {}


def opened(shipped) -> tuple[list, Index]:
    """Ids and index of a block. A worker holds those of one block, and of its broadcasts none."""
    if shipped not in _OPEN:
        _OPEN.clear()
        ids, texts = shipped.value
        shipped._value = None
        _OPEN[shipped] = ids, Index.build(texts)
    return _OPEN[shipped]


def find_leaks(docs: DataFrame, benchmark: DataFrame) -> DataFrame:
    """(doc_id, item_id, edits, begin, end, h): a row for each item that a document holds; places in normalised UTF-8 bytes, h xxhash64 of the text."""
    shipped = blocks(benchmark)
    item_kind, doc_kind = dict(benchmark.dtypes)["item_id"], dict(docs.dtypes)["doc_id"]
    item_type = to_arrow_type(benchmark.schema["item_id"].dataType)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            parts = list(words.chunks([t or "" for t in batch.column(1).to_pylist()]))
            for block in shipped:
                ids, index = opened(block)
                at = 0
                for part in parts:
                    found = leaks(index, [normal(t) for t in part])
                    if found:
                        doc, item, edits, begin, end = zip(*found)
                        rows = pa.array([at + d for d in doc])
                        columns = [batch.column(0).take(rows), pa.array([ids[i] for i in item], item_type), pa.array(edits, pa.int32()), pa.array(begin, pa.int64()), pa.array(end, pa.int64()), batch.column(2).take(rows)]
                        yield pa.RecordBatch.from_arrays(columns, ["doc_id", "item_id", "edits", "begin", "end", "h"])
                    at += len(part)

    return docs.select("doc_id", "text", F.xxhash64("text").alias("h")).mapInArrow(run, f"doc_id {doc_kind}, item_id {item_kind}, edits int, begin bigint, end bigint, h bigint")


def keep_clean(docs: DataFrame, benchmark: DataFrame) -> DataFrame:
    """The documents that hold no item, with all their columns."""
    shipped, column = blocks(benchmark), docs.columns.index("text")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            keep = np.ones(batch.num_rows, bool)
            parts = list(words.chunks([t or "" for t in batch.column(column).to_pylist()]))
            for block in shipped:
                at = 0
                for part in parts:
                    keep[[at + x[0] for x in leaks(opened(block)[1], [normal(t) for t in part])]] = False
                    at += len(part)
            yield batch.filter(pa.array(keep))

    return docs.mapInArrow(run, docs.schema)
