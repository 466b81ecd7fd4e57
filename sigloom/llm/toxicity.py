"""Toxicity by class-conditional Kneser-Ney models of the letters of words.

Each word of a text is scored by two letter models, one of toxic and one of
ordinary documents. Their highest order counts, per class, the documents that
hold a word with that letter sequence; below it both back off to the same
Kneser-Ney continuation counts, so a sequence that neither class has seen says
nothing, and one seen in a single document next to nothing (its whole count is
discounted). A text is judged by length-normalised log-likelihood differences:
per word of the whole text, of its best WINDOW words, and of its most telling
words, which a logistic scale turns into a score. The scale also knows log(n) of
a text of n words, since the best of more windows is larger by chance alone
(without it 75, with it 84 of the 97 toxic texts held out at sf0.1 are found).

All counts come from all labelled rows of folds 1 to 4 but the held-back sample
of about FIT_ROWS rows (a quarter of them if that is less, by hash of the id)
that the scale is fitted on. Each letter sequence has counts of its own, so the
model grows with the number of distinct sequences: no two share an entry, and
none is left out. Sequences are found by their 64-bit hashes; training fails
should two of them have the same. Every worker holds the model, 36 to 42 bytes
for each distinct sequence of the given tables (5.9 MB at sf0.1). Fold 0 is held
out. Words are runs of ASCII letters and digits and of all other characters
beyond ASCII, lower-cased.

Edge cases: null and empty texts, and texts without words, get the score of
a text without any evidence; unlabelled rows and null labels teach nothing; a
document with several labels counts as toxic if one says so; without labels of
both classes every score is the share of toxic rows (0 where there are none);
rows that repeat are scored each; extra columns are ignored.
"""

from __future__ import annotations

import math
import re
import uuid
import zlib
from collections import Counter
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from sigloom.llm import store, words
from sigloom.llm.words import chunks, slices

ORDER = 6
#: Entries of a table that are packed at once.
SLOTS = 1 << 21
FIT_ROWS = 20_000
WINDOW = 8
TELLING = 8
WORD = re.compile("[0-9a-z\x80-\U0010ffff]+")
#: Absolute discounts of document counts 1, 2 and more.
DISCOUNTS = (1.0, 1.6, 2.2)
SHARED_DISCOUNT = 0.75
#: Share of a letter that no table knows.
FLOOR = 1 / 300
#: Words, and letter sequences, whose differences a worker keeps.
KEPT, GRAMS = 500_000, 120_000
#: Words that a task counts before it passes them on.
COUNTED = 200_000
#: Characters scored at once.
CHUNK = 1 << 18
RIDGE = 0.3


def fold(doc_id: Column) -> Column:
    return (F.crc32(F.coalesce(doc_id.cast("string"), F.lit("")).cast("binary")) % 5).cast("int")


def labelled(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """(doc_id, text, toxic, fold) of the documents that have a label, of the folds that may be learned from."""
    known = labels.filter("doc_id IS NOT NULL AND toxic IS NOT NULL").groupBy("doc_id").agg(F.max("toxic").cast("int").alias("toxic"))
    rows = docs.select("doc_id", F.coalesce("text", F.lit("")).alias("text"), fold(F.col("doc_id")).alias("fold")).filter("fold <> 0")
    # Labels grow with the corpus, so the join has one plan at every size.
    return rows.join(known.filter(fold(F.col("doc_id")) != 0).hint("shuffle_merge"), "doc_id")


def word_documents(rows: DataFrame) -> DataFrame:
    """(word, toxic, ordinary): documents of each class that hold the word."""

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held = (Counter(), Counter())

        def flush() -> Iterator[pa.RecordBatch]:
            seen = list(set(held[0]) | set(held[1]))
            for at in range(0, len(seen), 50_000):
                part = seen[at : at + 50_000]
                yield pa.RecordBatch.from_arrays([pa.array(part), pa.array([held[1][w] for w in part], pa.int64()), pa.array([held[0][w] for w in part], pa.int64())], ["word", "toxic", "ordinary"])
            held[0].clear()
            held[1].clear()

        for batch in slices(batches):
            for text, toxic in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
                held[toxic > 0].update(set(WORD.findall(text.lower())))
            if len(held[0]) + len(held[1]) > COUNTED:
                yield from flush()
        yield from flush()

    return rows.select("text", "toxic").mapInArrow(count, "word string, toxic bigint, ordinary bigint").groupBy("word").agg(F.sum("toxic").alias("toxic"), F.sum("ordinary").alias("ordinary"))


def discount(n: Column) -> Column:
    return F.when(n == 0, 0.0).when(n == 1, DISCOUNTS[0]).when(n == 2, DISCOUNTS[1]).otherwise(DISCOUNTS[2])


def tables(words: DataFrame) -> dict[str, np.ndarray]:
    """Model tables from the word counts: columns in order of the sequence's hash, `.key`. A row of each distinct sequence reaches the driver."""
    padded = words.select(F.concat(F.lit("^"), "word", F.lit("$")).alias("p"), "toxic", "ordinary")
    gram = F.transform(F.sequence(F.lit(2), F.char_length("p")), lambda i: F.substring("p", F.greatest(i - (ORDER - 1), F.lit(1)), F.least(i, F.lit(ORDER))))
    top = padded.select(F.explode(gram).alias("g"), "toxic", "ordinary").groupBy("g").agg(F.sum("toxic").alias("t"), F.sum("ordinary").alias("o"))
    top = store.written(top, "toxicity-grams")
    context = F.expr("left(g, char_length(g) - 1)")
    ends = top.select(F.explode(F.transform(F.sequence(F.lit(1), F.char_length("g")), lambda k: F.substr("g", k))).alias("g")).distinct()
    shared = ends.filter("char_length(g) > 1").groupBy(F.expr("substring(g, 2)").alias("g")).agg(F.count("*").alias("n"))
    pieces = {
        "top": top,
        "context": top.groupBy(context.alias("g")).agg(F.sum("t").alias("nt"), F.sum("o").alias("no"), F.sum(discount(F.col("t"))).alias("dt"), F.sum(discount(F.col("o"))).alias("do")),
        "shared": shared,
        "shared_context": shared.groupBy(context.alias("g")).agg(F.sum("n").alias("n"), F.count("*").alias("kinds")),
    }
    out = {}
    for name, piece in pieces.items():
        found = piece.withColumn("g", F.xxhash64("g")).toArrow()
        keys = found.column("g").to_numpy().view(np.uint64)
        order = np.argsort(keys)
        out[f"{name}.key"] = keys = keys[order]
        if (keys[1:] == keys[:-1]).any():
            raise ValueError(f"two letter sequences of {name} have one hash")
        for c in found.column_names[1:]:
            out[f"{name}.{c}"] = found.column(c).to_numpy()[order].astype(np.float32)
    return out


class Model:
    """Scores of words and texts; the scale may be set later."""

    def __init__(self, found: dict[str, np.ndarray], prior: float):
        self.tables, self.prior = found, prior
        self.scale: tuple[np.ndarray, np.ndarray, np.ndarray] | None = None
        self.shipped = None
        self.clear()

    def clear(self) -> None:
        self.grams: dict[str, float] = {}
        self.lower: dict[str, float] = {}
        self.known = np.zeros(0, np.uint64)
        self.worth = np.zeros(0)

    def ship(self, docs: DataFrame):
        """Broadcast once; the scale, set later, goes with the tasks. The tables have an entry for each distinct sequence."""
        if self.shipped is None:
            self.shipped = docs.sparkSession.sparkContext.broadcast(Packed.of(self))
        return self.shipped

    def find(self, table: str, gram: str) -> int | None:
        """The entry of a sequence in a table."""
        keys, key = self.tables[f"{table}.key"], key_of(gram)
        at = int(keys.searchsorted(np.uint64(key)))
        return at if at < len(keys) and int(keys[at]) == key else None

    def shared(self, gram: str) -> float:
        """Continuation probability of a sequence's last letter, the same for both classes."""
        if not gram:
            return FLOOR
        if gram not in self.lower:
            if len(self.lower) > GRAMS:
                self.lower.clear()
            below, t = self.shared(gram[1:]), self.tables
            at = self.find("shared_context", gram[:-1])
            if at is not None:
                here = self.find("shared", gram)
                seen = 0.0 if here is None else float(t["shared.n"][here])
                below = (max(seen - SHARED_DISCOUNT, 0.0) + SHARED_DISCOUNT * float(t["shared_context.kinds"][at]) * below) / float(t["shared_context.n"][at])
            self.lower[gram] = below
        return self.lower[gram]

    def gram(self, gram: str) -> float:
        """Log-likelihood difference of a sequence's last letter."""
        known = self.grams.get(gram)
        if known is None:
            if len(self.grams) > GRAMS:
                self.grams.clear()
            known, t, at = 0.0, self.tables, self.find("context", gram[:-1])
            # After a context that neither class has seen, both back off to the same share.
            if at is not None:
                below, here = self.shared(gram[1:]), self.find("top", gram)
                logs = []
                for c in "to":
                    n, k = float(t[f"context.n{c}"][at]), 0.0 if here is None else float(t[f"top.{c}"][here])
                    cut = DISCOUNTS[min(int(k), 3) - 1] if k else 0.0
                    logs.append(math.log((max(k - cut, 0.0) + max(float(t[f"context.d{c}"][at]), 1e-3) * below) / n if n else below))
                known = logs[0] - logs[1]
            self.grams[gram] = known
        return known

    def word(self, word: str) -> float:
        """Log-likelihood difference of a word's letters."""
        p, total = f"^{word}$", 0.0
        for i in range(2, len(p) + 1):
            gram = p[i - ORDER if i > ORDER else 0 : i]
            part = self.grams.get(gram)
            total += self.gram(gram) if part is None else part
        return total

    def word_scores(self, texts: list[str]) -> tuple[np.ndarray, np.ndarray]:
        """Differences of all words, and where each text's begin (one entry more than texts)."""
        hashes, at, starts, stops, raw = located_words(texts)
        place = self.known.searchsorted(hashes)
        new = np.ones(len(hashes), bool)
        inside = place < len(self.known)
        new[inside] = self.known[place[inside]] != hashes[inside]
        if new.any():
            if len(self.known) > KEPT:
                self.known, self.worth, new = np.zeros(0, np.uint64), np.zeros(0), np.ones(len(hashes), bool)
            missing, first = np.unique(hashes[new], return_index=True)
            where = np.flatnonzero(new)[first]
            found = np.array([self.word(raw[a:b].decode("utf-8", "replace")) for a, b in zip(starts[where].tolist(), stops[where].tolist())])
            order = np.argsort(known := np.concatenate((self.known, missing)), kind="stable")
            self.known, self.worth = known[order], np.concatenate((self.worth, found))[order]
            place = self.known.searchsorted(hashes)
        return self.worth[place], at

    def features(self, texts: list[str]) -> np.ndarray:
        """Differences per word of each whole text, its best window, its most telling words, and the log of their number; 0 without words."""
        out = np.zeros((len(texts), 6))
        row = 0
        for part in chunks(texts, CHUNK):
            each, at = self.word_scores(part)
            run = np.concatenate(([0.0], np.cumsum(each)))
            for first, last in zip(at[:-1].tolist(), at[1:].tolist()):
                if n := last - first:
                    w = min(n, WINDOW)
                    windows = run[first + w : last + 1] - run[first : last + 1 - w]
                    best = each[first:last] if n <= TELLING else np.partition(each[first:last], n - TELLING)[n - TELLING :]
                    best = np.sort(np.maximum(best, 0))[::-1]
                    out[row] = (run[last] - run[first]) / n, windows.max() / WINDOW, best[0], best[:3].sum() / 3, best.sum() / TELLING, math.log(n)
                row += 1
        return out

    def fit(self, features: np.ndarray, toxic: np.ndarray) -> None:
        if not 0 < toxic.sum() < len(toxic):
            return
        mean, spread = features.mean(0), features.std(0) + 1e-9
        x = np.c_[(features - mean) / spread, np.ones(len(features))]
        weights, hold = np.zeros(x.shape[1]), RIDGE * np.r_[np.ones(x.shape[1] - 1), 0.0]
        for _ in range(50):
            p = 1 / (1 + np.exp(-np.clip(x @ weights, -30, 30)))
            step = np.linalg.solve((x * (p * (1 - p))[:, None]).T @ x + np.diag(hold + 1e-9), x.T @ (toxic - p) - hold * weights)
            weights += np.clip(step, -5, 5)
            if abs(step).max() < 1e-8:
                break
        self.scale = mean, spread, weights

    def scores(self, texts: list[str], scale=None) -> np.ndarray:
        scale = scale or self.scale
        if scale is None:
            return np.full(len(texts), float(self.prior))
        mean, spread, weights = scale
        x = (self.features(texts) - mean) / spread
        return 1 / (1 + np.exp(-np.clip(x @ weights[:-1] + weights[-1], -30, 30)))


def located_words(texts: list[str]) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray, bytes]:
    """Hashes of all words, where each text's begin, and the bytes that each word takes of the joined texts."""
    raw = [t.lower().encode("utf-8", "replace") for t in texts]
    joined = b"\n".join(raw) + b"\n"
    hashes, starts, stops = words.hashes_of(np.frombuffer(joined, np.uint8))
    at = np.concatenate(([0], starts.searchsorted(np.cumsum([len(r) + 1 for r in raw])))).astype(np.int64)
    return hashes, at, starts, stops, joined


class Packed:
    """A model as it is shipped: its tables, compressed SLOTS entries at a time."""

    def __init__(self, key: str, tables: dict[str, tuple[np.dtype, list[bytes]]], prior: float):
        self.key, self.tables, self.prior = key, tables, prior

    @staticmethod
    def of(model: Model) -> Packed:
        packed = {name: (table.dtype, [zlib.compress(table[at : at + SLOTS].tobytes(), 1) for at in range(0, len(table), SLOTS)]) for name, table in model.tables.items()}
        return Packed(uuid.uuid4().hex, packed, model.prior)

    def open(self) -> Model:
        """The model, of which a worker holds one: opening another lets go of it and of the words it has met."""
        if self.key not in _OPEN:
            _OPEN.clear()
            found = {name: np.concatenate([np.zeros(0, dtype)] + [np.frombuffer(zlib.decompress(part), dtype) for part in parts]) for name, (dtype, parts) in self.tables.items()}
            _OPEN[self.key] = Model(found, self.prior)
        return _OPEN[self.key]


_OPEN: dict[str, Model] = {}


def key_of(gram: str) -> int:
    """F.xxhash64(), outside Spark."""
    return xxhash.xxh64_intdigest(gram.encode(), 42)


def held_back(rows: int, fit_rows: int) -> Column:
    """Whether a labelled row is of the sample for the scale: about fit_rows of them, a quarter at most, the same on every run."""
    share = int(1_000_000 * min(0.25, fit_rows / max(rows, 1)))
    return F.pmod(F.xxhash64(F.lit(4), F.col("doc_id")), F.lit(1_000_000)) < share


def train(docs: DataFrame, labels: DataFrame, fit_rows: int = FIT_ROWS) -> Model:
    rows = labelled(docs, labels)
    sizes = labelled(docs.withColumn("text", F.lit("")), labels).agg(F.count("*").alias("n"), F.sum("toxic").alias("toxic")).first()
    total, toxic = sizes.n, sizes.toxic or 0
    back = held_back(total, fit_rows)
    model = Model(tables(word_documents(rows.filter(~back))), toxic / total if total else 0.0)
    if 0 < toxic < total:
        shipped = model.ship(docs)

        def measure(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            model = shipped.value.open()
            for batch in slices(batches):
                yield pa.RecordBatch.from_arrays([pa.array(list(model.features(batch.column(0).to_pylist())), pa.list_(pa.float64())), batch.column(1)], ["x", "toxic"])

        found = rows.filter(back).select("text", "toxic").mapInArrow(measure, "x array<double>, toxic int").toArrow()
        if len(found):
            model.fit(np.array(found.column("x").to_pylist()), found.column("toxic").to_numpy().astype(float))
    return model


def score(docs: DataFrame, model: Model) -> DataFrame:
    """(doc_id, held_out, score, predicted) of every document."""
    shipped, scale = model.ship(docs), model.scale

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        opened = shipped.value.open()
        for batch in slices(batches):
            scores = opened.scores([t or "" for t in batch.column(2).to_pylist()], scale)
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(scores), pa.array((scores >= 0.5).astype(np.int32))], ["doc_id", "held_out", "score", "predicted"])

    rows = docs.select("doc_id", (fold(F.col("doc_id")) == 0).alias("held_out"), "text")
    return rows.mapInArrow(run, f"doc_id {dict(docs.dtypes)['doc_id']}, held_out boolean, score double, predicted int")


def keep_civil(docs: DataFrame, model: Model) -> DataFrame:
    """The documents that are not predicted toxic, with all their columns."""
    shipped, scale = model.ship(docs), model.scale
    at = docs.columns.index("text")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        opened = shipped.value.open()
        for batch in slices(batches):
            yield batch.filter(pa.array(opened.scores([t or "" for t in batch.column(at).to_pylist()], scale) < 0.5, pa.bool_()))

    return docs.mapInArrow(run, docs.schema)
