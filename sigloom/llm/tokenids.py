"""Token ids of a corpus in a binary table with Elias-Fano document boundaries.

The file format is a Parquet table of segments. A segment holds consecutive
documents in ascending id order: `ids`, all their token ids end to end as
little-endian unsigned integers of `width` bytes, and `bounds`, the
Elias-Fano code of the n_docs + 1 offsets between them (see eliasfano.Reader,
whose select returns a document's offset without unpacking). `first` is the
number of ids before the segment in its block, and blocks follow each other
(ordered.in_blocks), so a global offset is one sum away.

Byte-level BPE splits a text by a pattern and encodes each piece alone, and no
piece reaches over a space that does not begin it. So a text is cut before its
spaces and a worker keeps the ids of the words it has met; only a new word is
split by the pattern. A text with a space inside or at the end of a longer run of
white space is split as a whole. Where a text holds an added token, or the
tokenizer is of another kind, the library encodes the text as a whole.

Edge cases: null text is empty and has the end id alone; null ids come first;
rows with equal ids are separate documents, ordered by their text; ids must be integers; extra
columns are not stored; an empty table gives an empty one.
"""

from __future__ import annotations

import json
import re
import struct
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from sigloom.llm import eliasfano, ordered, store

END_ID = 2
#: Ids in a segment, about.
SEGMENT_IDS = 1 << 20
#: Words, and pieces without a space, whose ids a worker keeps, and characters of the longest it keeps; it starts afresh beyond.
KEPT_PIECES, KEPT_LENGTH = 1_390_000, 48
#: Fixed value: the splitting pattern of byte-level BPE, in the dialect of `re`.
PIECES = re.compile(r"'s|'t|'re|'ve|'m|'ll|'d| ?[^\W\d_]+| ?(?:(?=\d)\w)+| ?(?:[^\s\w]|_)+|\s+(?!\S)|\s+")
#: A space that a cut before it would part from white space it shares a piece with.
LOOSE = re.compile(r"\s (?:\s|\Z)")


def byte_letters() -> dict[int, str]:
    """The letter that byte-level BPE writes for each byte: printable Latin-1 as it is, the others from 256 on."""
    printable = {*range(33, 127), *range(161, 173), *range(174, 256)}
    others = iter(range(256, 512))
    return {b: chr(b if b in printable else next(others)) for b in range(256)}


class Encoder:
    """Ids of texts, as bytes of `width` a piece, equal to what Tokenizer.encode gives."""

    def __init__(self, definition: str):
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_str(definition)
        spec = json.loads(definition)
        split = spec.get("pre_tokenizer") or {}
        self.by_piece = spec["model"]["type"] == "BPE" and not spec.get("normalizer") and split.get("type") == "ByteLevel" and split.get("use_regex", True) and not split.get("add_prefix_space")
        added = [t["content"] for t in spec.get("added_tokens", [])]
        self.added = re.compile("|".join(map(re.escape, added))) if added else None
        self.width = 2 if self.tokenizer.get_vocab_size() <= 1 << 16 else 4
        self.letters = byte_letters()
        self.space, self.tokenize = self.letters[32], self.tokenizer.model.tokenize
        #: Ids of words together with the space before them, and of pieces that do not begin with a space.
        self.words: dict[str, bytes] = {}
        self.pieces: dict[str, bytes] = {}

    def pack(self, ids: list[int]) -> bytes:
        return struct.pack(f"<{len(ids)}{'H' if self.width == 2 else 'I'}", *ids)

    def piece(self, text: str) -> bytes:
        kept, key = (self.words, text[1:]) if text[0] == " " else (self.pieces, text)
        ids = kept.get(key)
        if ids is None:
            ids = self.merged(text.encode().decode("latin-1").translate(self.letters))
            keep(kept, key, ids)
        return ids

    def merged(self, letters: str) -> bytes:
        return self.pack([t.id for t in self.tokenize(letters)])

    def word(self, text: str) -> bytes:
        """Of a word and the space before it. One of ASCII letters, which stand for themselves, is one piece."""
        ids = self.merged(self.space + text) if text.isascii() and text.isalpha() else self.split(" " + text)
        keep(self.words, text, ids)
        return ids

    def split(self, text: str) -> bytes:
        if not self.splits_alike(text):
            return self.whole(text)
        return b"".join([self.piece(p) for p in PIECES.findall(text)])

    def whole(self, text: str) -> bytes:
        return self.pack(self.tokenizer.encode(text, add_special_tokens=False).ids)

    def encode(self, text: str) -> bytes:
        if not self.by_piece or self.added and self.added.search(text):
            return self.whole(text)
        if LOOSE.search(text):
            return self.split(text)
        first, *words = text.split(" ")
        get, word = self.words.get, self.word
        return self.split(first) + b"".join([get(w) or word(w) for w in words])

    @staticmethod
    def splits_alike(text: str) -> bool:
        """Whether `re` and the library agree on the classes of all characters: \\w lacks no letter and adds no mark below U+0300."""
        return not ODD.search(text) and (text.isascii() or max(text) < "\u0300")


#: Characters below U+0300 that the two dialects class differently (number forms and C0 separators).
ODD = re.compile("[\x1c-\x1f\x85²³¹¼-¾]")


def keep(kept: dict[str, bytes], key: str, ids: bytes) -> None:
    if len(key) <= KEPT_LENGTH:
        if len(kept) >= KEPT_PIECES:
            kept.clear()
        kept[key] = ids


_ENCODERS: dict[int, Encoder] = {}


def encoder(definition: str) -> Encoder:
    """One for each worker and definition, so that the pieces it keeps outlive a task."""
    key = zlib.crc32(definition.encode())
    if key not in _ENCODERS:
        _ENCODERS[key] = Encoder(definition)
    return _ENCODERS[key]


SEGMENTS = "block int, part int, first bigint, n_docs int, n_ids bigint, width int, doc_ids array<bigint>, bounds binary, ids binary"


def write_ids(docs: DataFrame, tokenizer: str, end_id: int = END_ID) -> DataFrame:
    """The segment table, written to the shared folder and read again. `tokenizer` is the path of its JSON file on the driver."""
    with open(tokenizer, encoding="utf-8") as f:
        definition = docs.sparkSession.sparkContext.broadcast(f.read())
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.coalesce("text", F.lit("")).alias("text"))
    rows, _ = ordered.in_blocks(rows.withColumn("_tie", F.xxhash64("text")), "doc_id", "_tie", guests=False)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        use = encoder(definition.value)
        end = use.pack([end_id])
        block, part, first = None, 0, 0
        ids: list[bytes] = []
        docs_in: list[int | None] = []
        held = 0

        def segment() -> pa.RecordBatch:
            bounds = np.concatenate(([0], np.cumsum([len(x) // use.width for x in ids])))
            values = [block, part, first, len(ids), int(bounds[-1]), use.width, docs_in, eliasfano.encode(bounds), b"".join(ids)]
            types = [pa.int32(), pa.int32(), pa.int64(), pa.int32(), pa.int64(), pa.int32(), pa.list_(pa.int64()), pa.binary(), pa.binary()]
            return pa.RecordBatch.from_arrays([pa.array([v], t) for v, t in zip(values, types)], NAMES)

        for batch in batches:
            for doc_id, text, of in zip(*(batch.column(i).to_pylist() for i in range(3))):
                if ids and (of != block or held >= SEGMENT_IDS):
                    yield segment()
                    part, first = part + 1, first + held
                    ids, docs_in, held = [], [], 0
                if of != block:
                    block, part, first = of, 0, 0
                ids.append(use.encode(text) + end)
                docs_in.append(doc_id)
                held += len(ids[-1]) // use.width
        if ids:
            yield segment()

    return store.written(rows.select("doc_id", "text", "_block").mapInArrow(run, SEGMENTS), "token-ids")


NAMES = [c.split()[0] for c in SEGMENTS.split(", ")]
READ = "doc_id bigint, start bigint, n_tokens bigint, ids_crc32 bigint"


def read_ids(segments: DataFrame) -> DataFrame:
    """(doc_id, start, n_tokens, ids_crc32) of every document, from the segments alone."""
    # At most ordered.MOST_BLOCKS rows.
    totals = {r.block: r.n for r in segments.groupBy("block").agg(F.sum("n_ids").alias("n")).collect()}
    before, total = {}, 0
    for b in sorted(totals):
        before[b] = total
        total += totals[b]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for s in batch.to_pylist():
                bounds = eliasfano.Reader(s["bounds"]).all()
                ids = np.frombuffer(s["ids"], f"<u{s['width']}").astype("<u4")
                raw = memoryview(ids).cast("B")
                crcs = [zlib.crc32(raw[4 * a : 4 * b]) for a, b in zip(bounds[:-1].tolist(), bounds[1:].tolist())]
                start = bounds[:-1] + (before[s["block"]] + s["first"])
                yield pa.RecordBatch.from_arrays([pa.array(s["doc_ids"], pa.int64()), pa.array(start), pa.array(np.diff(bounds)), pa.array(crcs, pa.int64())], ["doc_id", "start", "n_tokens", "ids_crc32"])

    return segments.select("block", "first", "width", "doc_ids", "bounds", "ids").mapInArrow(run, READ)
