"""Quality classifier: supervised subword embeddings, trained by numpy stochastic gradient descent."""

from __future__ import annotations

import math
from collections.abc import Iterator
from dataclasses import dataclass, field
from itertools import chain

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import DoubleType, StructField, StructType

from tessera.llm.portions import by_length, give_back, slices

FEATURES = 1 << 16
#: Zero vectors that every average includes, so that a few features alone decide nothing.
PAD = 40
#: Character n-grams of these lengths.
LOW, HIGH = 3, 5
FACTOR, MIX = np.uint64(0x100000001B3), np.uint64(0x9E3779B97F4A7C15)
#: Up to so many different words are kept with their scores by a worker, then the store starts anew; letters of words
#: taken at a time.
KEPT, LETTERS = 150_000, 200_000
#: Features of the labelled documents that the driver holds at most, four bytes each (ten in texts that hold one more than
#: 65,535 times).
ROOM = 30_000_000


def features(words: list[str]) -> tuple[np.ndarray, np.ndarray]:
    """Hashed features of words of one length, a row each: the word with marks at both ends, and the character n-grams
    of it; and the words' hashes. All n-grams of all words are hashed together."""
    letters = np.frombuffer(
        "".join(f"<{w}>" for w in words).encode("utf-32-le", "surrogatepass"), np.uint32
    ).reshape(len(words), -1).astype(np.uint64)
    whole = np.zeros((len(words), 1), np.uint64)
    for column in letters.T:
        whole[:, 0] = whole[:, 0] * FACTOR + column
    found, grams = [whole], letters
    for n in range(2, HIGH + 1):
        grams = grams[:, :-1] * FACTOR + letters[:, n - 1 :]
        if n >= LOW:
            found.append(grams)
    return _places(np.concatenate(found, axis=1)), whole[:, 0]


def _places(hashes: np.ndarray) -> np.ndarray:
    return (hashes * MIX >> np.uint64(48)).astype(np.int32)


def bigrams(hashes: np.ndarray, document: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Hashed features of the word bigrams of documents that lie one after the other, and whose they are. A bigram is
    hashed by the difference of its words' hashes: another order is another feature, and a word twice in a row is the
    same one whatever the word."""
    inside = np.flatnonzero(document[1:] == document[:-1])
    return _places(hashes[inside] - hashes[inside + 1]), document[inside]


@dataclass
class Words:
    """What is known of words: a place for each, and by place the sum of its features' weights, their number and the
    word's hash. Without weights the features themselves are kept instead of their sum."""

    weight: np.ndarray | None = None
    place: dict[str, int] = field(default_factory=dict)
    rows: list[np.ndarray] = field(default_factory=list)
    adds: np.ndarray = field(default_factory=lambda: np.zeros(0))
    counts: np.ndarray = field(default_factory=lambda: np.zeros(0, np.int64))
    hashes: np.ndarray = field(default_factory=lambda: np.zeros(0, np.uint64))

    def read(self, texts: list[str | None]) -> tuple[np.ndarray, np.ndarray]:
        """The places of all words of the texts, one after the other, and the text that each belongs to."""
        parts = [(t or "").split() for t in texts]
        if len(self.place) > KEPT:
            self.__init__(self.weight)
        adds, counts, hashes = [self.adds], [self.counts], [self.hashes]
        for group in by_length({w for ws in parts for w in ws if w not in self.place}, LETTERS):
            ids, own = features(group)
            self.place.update(zip(group, range(len(self.place), len(self.place) + len(group)), strict=True))
            if self.weight is None:
                self.rows.extend(ids)
            adds.append(self.weight[ids].sum(axis=1, dtype=np.float64) if self.weight is not None else np.zeros(len(group)))
            counts.append(np.full(len(group), ids.shape[1]))
            hashes.append(own)
        self.adds, self.counts, self.hashes = np.concatenate(adds), np.concatenate(counts), np.concatenate(hashes)
        sizes = np.array([len(ws) for ws in parts], np.int64)
        return np.fromiter(
            map(self.place.__getitem__, chain.from_iterable(parts)), np.int64, int(sizes.sum())
        ), np.repeat(np.arange(len(parts)), sizes)


def bag(text: str | None, words: Words) -> tuple[np.ndarray, np.ndarray]:
    """Feature ids and how often each occurs over the whole text; ``words`` has no weights."""
    at, document = words.read([text])
    total = np.bincount(bigrams(words.hashes[at], document)[0], minlength=FEATURES)
    known, times = np.unique(at, return_counts=True)
    for i, n in zip(known.tolist(), times.tolist(), strict=True):
        np.add.at(total, words.rows[i], n)
    ids = np.flatnonzero(total)
    found = total[ids]
    return ids.astype(np.uint16), found.astype(np.uint16 if found.max(initial=0) < 1 << 16 else np.uint64)


@dataclass(frozen=True)
class Model:
    """For two labels: what each feature adds to the difference of the logits, and the difference without features."""

    weight: np.ndarray
    bias: float

    def score(self, texts: list[str | None], words: Words | None = None) -> list[float]:
        """Scores of texts; ``words`` holds what words have been found to add, and must be of this model's weights."""
        words = words or Words(self.weight)
        at, document = words.read(texts)
        pairs, whose = bigrams(words.hashes[at], document)
        # sums in the order of each text's own words, so that equal texts score alike in any company
        total = np.bincount(document, words.adds[at], len(texts)) + np.bincount(whose, self.weight[pairs].astype(np.float64), len(texts))
        n = PAD + np.bincount(document, words.counts[at], len(texts)) + np.bincount(whose, minlength=len(texts))
        return [1.0 / (1.0 + math.exp(min(700.0, -x - self.bias))) for x in (total / n).tolist()]


def train(bags: list[tuple[np.ndarray, np.ndarray]], labels: list[int], dim: int = 8, epochs: int = 8, rate: float = 0.5, seed: int = 3) -> Model:
    """Feature vectors averaged per document, a softmax over two labels, one document per step.

    The bias is the labels' share and is not trained: what a text without features scores. With no documents, or of one label only, the features stay at zero and the score is the label's smoothed share.
    """
    rng = np.random.default_rng(seed)
    prior = np.log((np.array([labels.count(0), labels.count(1)]) + 1.0) / (len(labels) + 2.0))
    if len(set(labels)) < 2:
        return Model(np.zeros(FEATURES, np.float32), float(prior[1] - prior[0]))
    vectors = rng.uniform(-1 / dim, 1 / dim, (FEATURES, dim)).astype(np.float32)
    out, bias = np.zeros((2, dim), np.float32), prior.astype(np.float32)
    steps, done = epochs * len(bags), 0
    for _ in range(epochs):
        for i in rng.permutation(len(bags)).tolist():
            step = rate * (1 - done / steps)
            done += 1
            ids, counts = bags[i]
            share = (counts / (counts.sum(dtype=np.float64) + PAD)).astype(np.float32)
            mean = share @ vectors[ids] if len(ids) else np.zeros(dim, np.float32)
            logits = out @ mean + bias
            p = np.exp(logits - logits.max())
            p /= p.sum()
            p[labels[i]] -= 1
            back = p @ out
            out -= step * np.outer(p, mean)
            if len(ids):
                # the gradient of a mean shrinks with its features: scaled back as sparse features need larger steps
                vectors[ids] -= (step * min(50.0, len(ids) ** 0.5) * share)[:, None] * back
    return Model(vectors @ (out[1] - out[0]), float(bias[1] - bias[0]))


def held_out(doc_id: Column) -> Column:
    """Rows that no label is learnt from: crc32 of the id as text leaves 1 divided by 3. A null id counts as held out."""
    return F.coalesce(F.crc32(doc_id.cast("string").cast("binary")) % 3 == 1, F.lit(True))


def fit(docs: DataFrame, labels: DataFrame, most: int = 4000, id_col: str = "doc_id", text_col: str = "text", label_col: str = "quality") -> Model:
    """Learn from at most ``most`` labelled documents that are not held out, of those that are there the ones whose ids
    hash lowest, and of these from as many as have ROOM features in all.

    Whole texts, however long, are turned into counted features on the executors; only these come to the driver. Null
    labels and labels other than 0 and 1 are left out; of rows with one id and different labels or texts each counts.
    Equal hashes go by id, then label, then features, so a rerun learns the same.
    """
    known = labels.select(
        F.col(id_col).cast("long").alias("k"), F.col(label_col).cast("int").alias("y")
    ).where("k is not null and y in (0, 1)").where(~held_out(F.col("k")))
    ids = docs.select(F.col(id_col).cast("long").alias("k"))
    # the sample has at most ``most`` rows of two numbers, which bounds what is broadcast
    sample = known.join(ids, "k", "left_semi").orderBy(F.xxhash64("k"), "k", "y").limit(most)
    texts = docs.select(F.col(id_col).cast("long").alias("k"), F.col(text_col).cast("string").alias("text")).join(F.broadcast(sample), "k")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        words = Words()
        for b in slices(batches, 2):
            bags = [bag(t, words) for t in b.column(2).to_pylist()]
            yield pa.RecordBatch.from_arrays(
                [
                    b.column(0), b.column(1), pa.array([i.tobytes() for i, _ in bags], pa.binary()),
                    pa.array([c.tobytes() for _, c in bags], pa.binary())
                ],
                ["k", "y", "ids", "counts"]
            )

    rows = texts.select("k", "y", "text").mapInArrow(run, "k long, y int, ids binary, counts binary").orderBy(
        F.xxhash64("k"), "k", "y", F.xxhash64("ids", "counts")
    ).limit(most)
    bags, marks, room = [], [], ROOM
    for r in rows.toLocalIterator():
        room -= len(r.ids) // 2
        if room < 0 and bags:
            break
        bags.append((np.frombuffer(r.ids, np.uint16), np.frombuffer(r.counts, np.uint16 if len(r.counts) == len(r.ids) else np.uint64)))
        marks.append(r.y)
    model = train(bags, marks)
    del bags, rows
    give_back()
    return model


def score(rows: DataFrame, model: Model, text_col: str, name: str) -> DataFrame:
    """The rows with a score from 0 to 1 added as column ``name``: how likely label 1 is, from the whole text alone.

    Equal texts score alike, texts of any length are read whole; null and empty texts score as the labels' share.
    """
    at = rows.columns.index(text_col)
    shared = rows.sparkSession.sparkContext.broadcast(model)
    schema = StructType([*rows.schema.fields, StructField(name, DoubleType())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        words = Words(shared.value.weight)
        for b in slices(batches, at):
            found = shared.value.score(b.column(at).to_pylist(), words)
            yield pa.RecordBatch.from_arrays([*b.columns, pa.array(found, pa.float64())], names=[*b.schema.names, name])

    return rows.mapInArrow(run, schema)


def accepted(docs: DataFrame, model: Model, text_col: str = "text") -> DataFrame:
    """The documents that the model does not reject (score of 0.5 or more), with all their columns as they are."""
    names = docs.columns
    numbered = docs.toDF(*(f"c{i}" for i in range(len(names))))
    return score(numbered, model, f"c{names.index(text_col)}", "score").where("score >= 0.5").drop("score").toDF(*names)


def judged(docs: DataFrame, model: Model, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row ``(doc_id, held_out, score, predicted)`` per document; repeated rows stay, an empty table gives none,
    other columns are not read."""
    rows = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).cast("string").alias("text"))
    out = score(rows, model, "text", "score").withColumn("held_out", held_out(F.col("doc_id")))
    return out.select(F.col("doc_id").alias(id_col), "held_out", "score", F.when(F.col("score") >= 0.5, 1).otherwise(0).alias("predicted"))
