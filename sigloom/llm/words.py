"""Words and word shingles of batches of texts, hashed in numpy.

A word is a run of letters and digits of the lower-cased text: ASCII letters
and digits and every byte of a longer UTF-8 character. Hashes are 64 bits wide.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa

#: Words in a shingle.
WIDTH = 5
#: Text bytes hashed at once; numpy's temporaries take about 60 times as much.
CHUNK = 1 << 20

_U = np.uint64


def mixed(x: np.ndarray) -> np.ndarray:
    """A bijective 64-bit mix, so that close values give unrelated ones."""
    x = (x ^ (x >> _U(30))) * _U(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> _U(27))) * _U(0x94D049BB133111EB)
    return x ^ (x >> _U(31))


_WORD = np.zeros(256, bool)
for _r in (range(48, 58), range(65, 91), range(97, 123), range(128, 256)):
    _WORD[list(_r)] = True
_BYTE = mixed(np.arange(1, 257, dtype=np.uint64) * _U(0x9E3779B97F4A7C15))
_STEP = 4096
with np.errstate(over="ignore"):
    _POWER = np.cumprod(np.full(_STEP, 0x9E3779B97F4A7C15, dtype=np.uint64)) | _U(1)
    _PLACE = mixed(np.arange(11, 11 + WIDTH, dtype=np.uint64)) | _U(1)


def hashes_of(buf: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Hashes of all words of lower-cased UTF-8 bytes, and where each begins and ends."""
    is_word = _WORD[buf]
    edge = np.flatnonzero(np.diff(np.concatenate(([False], is_word, [False])).view(np.int8)))
    starts, stops = edge[::2], edge[1::2]
    if not len(starts):
        return np.zeros(0, np.uint64), starts, stops
    lens = stops - starts
    first = np.cumsum(lens) - lens
    place = (np.arange(lens.sum()) - np.repeat(first, lens)) & (_STEP - 1)
    return mixed(np.add.reduceat(_BYTE[buf[is_word]] * _POWER[place], first) + lens.astype(np.uint64)), starts, stops


def word_hashes(texts: list[str]) -> tuple[np.ndarray, np.ndarray]:
    """Hashes of all words, and where each text's words begin (one entry more than texts)."""
    raw = [t.lower().encode("utf-8", "replace") for t in texts]
    ends = np.cumsum([len(r) + 1 for r in raw])
    hashes, starts, _ = hashes_of(np.frombuffer(b"\n".join(raw) + b"\n", np.uint8))
    if not len(hashes):
        return hashes, np.zeros(len(texts) + 1, np.int64)
    return hashes, np.concatenate(([0], np.searchsorted(starts, ends)))


def shingle_hashes(texts: list[str]) -> tuple[np.ndarray, np.ndarray]:
    """Hashes of all shingles, repeats included, and where each text's begin.

    A text of fewer than WIDTH words has one shingle of all of them; one without words has none.
    """
    words, at = word_hashes(texts)
    n = np.diff(at)
    if not len(words):
        return words, np.zeros(len(texts) + 1, np.int64)
    padded = np.concatenate((words, np.zeros(WIDTH - 1, np.uint64)))
    total = sum(padded[i : i + len(words)] * _PLACE[i] for i in range(WIDTH))
    valid = np.ones(len(words), bool)
    for back in range(1, WIDTH):
        ends = at[1:][n >= back] - back
        valid[ends] = False
    for d in np.flatnonzero((n > 0) & (n < WIDTH)):
        total[at[d]] = (words[at[d] : at[d] + n[d]] * _PLACE[: n[d]]).sum(keepdims=True)[0] ^ _U(n[d])
        valid[at[d]] = True
    return mixed(total[valid]), np.concatenate(([0], np.cumsum(np.where(n >= WIDTH, n - WIDTH + 1, np.minimum(n, 1)))))


def shingle_sets(texts: list[str]) -> list[np.ndarray]:
    """The sorted distinct shingle hashes of each text."""
    out: list[np.ndarray] = []
    for part in chunks(texts):
        hashes, at = shingle_hashes(part)
        out += [np.unique(hashes[at[i] : at[i + 1]]) for i in range(len(part))]
    return out


def slices(batches: Iterator[pa.RecordBatch], rows: int = 1000) -> Iterator[pa.RecordBatch]:
    """The batches in smaller ones, so that what is made of one stays small."""
    for batch in batches:
        for at in range(0, batch.num_rows, rows):
            yield batch.slice(at, rows)


def chunks(texts: list[str], size: int = CHUNK) -> Iterator[list[str]]:
    """Runs of texts of about `size` characters; a longer text is a run of its own."""
    part, held = [], 0
    for t in texts:
        if part and held + len(t) > size:
            yield part
            part, held = [], 0
        part.append(t)
        held += len(t)
    if part:
        yield part
