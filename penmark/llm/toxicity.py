"""Toxicity by multiple-instance learning: sentence scores, joined by noisy-or, learned from document labels.

A sentence is a bag of words and word beginnings. Its score is a logistic function of the
weights it holds, and a document is toxic if any sentence is: ``1 - prod(1 - p)``. Only
document labels are used to learn, yet the sentences' own scores say which one offends.

The model is fitted on at most ``2 * PER_CLASS`` labelled documents (the lowest hashes of
``doc_id`` in each class, weighted back to the classes' sizes; the lowest text where rows share
an id) and holds at most
``FEATURES`` weights; every document is scored, whole.

Defined results: a null, empty or wordless text scores 0; a document labelled twice takes
the higher label, and null labels are ignored; repeated rows score alike; without labels
of both classes nothing is learned and every score is 0; other columns are never read.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame, functions as F

from penmark.llm.common import NOT_ALNUM, U64, lowest_hashes, mix, texts_in, word_hashes
from penmark.session import staged

PER_CLASS = 4000
FEATURES = 1024
MIN_DOCS = 5  # toxic documents of the sample that a feature must occur in
PREFIXES = (4, 5, 6, 8)  # word beginnings, in bytes
THRESHOLD = 0.7
_ENDS = np.zeros(256, bool)
_ENDS[[33, 46, 63]] = True


def features(text: str | None) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Feature hashes, the sentence of each, and the sentences' byte bounds ``[n + 1]``.

    A sentence ends at a line break, or at ``. ! ?`` before the next word.
    """
    words, start, end, data = word_hashes(text, spans=True, gaps=NOT_ALNUM)
    if not len(words):
        return words, np.zeros(0, np.int64), np.zeros(1, np.int64)
    stops = np.concatenate(([0], np.cumsum(_ENDS[data] | (data == 10))))
    sentence = np.unique(stops[start], return_inverse=True)[1]
    parts, owners = [words], [sentence]
    for n in PREFIXES:
        longer = np.flatnonzero(end - start > n)
        here, key = start[longer], np.full(len(longer), n, U64)
        for i in range(n):
            key = key * U64(0x100000001B3) ^ data[here + i].astype(U64)
        parts.append(mix(key))
        owners.append(sentence[longer])
    first = np.concatenate(([0], np.flatnonzero(np.diff(sentence)) + 1))
    bounds = np.concatenate((start[first], [len(data)]))
    return np.concatenate(parts), np.concatenate(owners), bounds


def held_out(doc_id: Column) -> Column:
    """Rows that learning never sees: crc32 of the id as text is 1 modulo 3."""
    return F.coalesce(F.crc32(doc_id.cast("string").cast("binary")) % 3 == 1, F.lit(False))


def training_sample(docs: DataFrame, labels: DataFrame, per_class: int = PER_CLASS) -> tuple[DataFrame, dict[int, int]]:
    """``(toxic, text)`` of a bounded sample, and how many documents each label has."""
    known = labels.where(~held_out(F.col("doc_id")) & F.col("doc_id").isNotNull() & F.col("toxic").isNotNull())
    known = staged(known.groupBy("doc_id").agg(F.max("toxic").cast("int").alias("toxic")))
    sizes = {row["toxic"]: row["n"] for row in known.groupBy("toxic").agg(F.count(F.lit(1)).alias("n")).collect()}
    # Two labels, so two samples.
    chosen = [lowest_hashes(known.where(F.col("toxic") == label), "doc_id", sizes.get(label, 0), per_class) for label in (0, 1)]
    chosen = staged(chosen[0].union(chosen[1]))
    # Of texts that share an id, the lowest is learned from.
    rows = docs.select("doc_id", "text").join(chosen, "doc_id").groupBy("doc_id").agg(F.min("toxic").alias("toxic"), F.min("text").alias("text"))
    return staged(rows.select("toxic", "text")), sizes


def _select(sample: DataFrame, count: int) -> np.ndarray:
    """Hashes of the features that tell the labels apart best, by their chi-square over documents."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part, texts in texts_in(batches):
            for i in range(0, len(texts), 128):
                found = [np.unique(features(text)[0]) for text in texts[i : i + 128]]
                toxic = np.repeat(part.column("toxic").to_numpy()[i : i + 128], [len(f) for f in found])
                keys, place = np.unique(np.concatenate(found), return_inverse=True)
                n, pos = np.bincount(place, minlength=len(keys)), np.bincount(place, toxic, minlength=len(keys))
                columns = [pa.array(keys.view(np.int64)), pa.array(n.astype(np.int64)), pa.array(pos.astype(np.int64))]
                yield pa.RecordBatch.from_arrays(columns, ["f", "n", "pos"])

    total = sample.agg(F.sum("toxic"), F.count(F.lit(1))).first()
    pos, docs = float(total[0] or 0), float(total[1])
    counted = sample.mapInArrow(run, "f long, n long, pos long").groupBy("f").agg(F.sum("n").alias("n"), F.sum("pos").alias("pos"))
    counted = counted.where((F.col("pos") >= MIN_DOCS) & (F.col("pos") * docs > F.col("n") * pos))
    n, p = F.col("n"), F.col("pos")
    chi = docs * F.pow(p * (docs - pos) - (n - p) * pos, 2.0) / (n * (docs - n + 1.0) * pos * (docs - pos))
    best = counted.orderBy(chi.desc(), "f").limit(count).collect()  # bounded by ``count``
    return np.sort(np.array([row["f"] for row in best], np.int64).view(U64))


class Model:
    """Sorted feature hashes, their weights, and a sentence's bias."""

    def __init__(self, keys: np.ndarray, weights: np.ndarray, bias: float):
        self.keys, self.weights, self.bias = keys, weights, bias
        self.seen = np.zeros(1 << 16, bool)  # a quick test that leaves few hashes to look up
        self.seen[(keys >> U64(48)).astype(np.int64)] = True

    def find(self, hashes: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Places of known features among the hashes, and their numbers."""
        at = np.flatnonzero(self.seen[(hashes >> U64(48)).astype(np.int64)])
        n = np.searchsorted(self.keys, hashes[at])
        n[n == len(self.keys)] = 0
        hit = self.keys[n] == hashes[at] if len(self.keys) else np.zeros(len(at), bool)
        return at[hit], n[hit]

    def sentences(self, text: str | None) -> tuple[np.ndarray, np.ndarray]:
        """The score of each sentence, and the sentences' byte bounds."""
        hashes, sentence, bounds = features(text)
        at, n = self.find(hashes)
        total = np.full(len(bounds) - 1, self.bias)
        # Each feature counts once in a sentence.
        both = np.unique(sentence[at] * np.int64(max(1, len(self.keys))) + n)
        np.add.at(total, both // max(1, len(self.keys)), self.weights[both % max(1, len(self.keys))])
        return 1 / (1 + np.exp(-total)), bounds

    def score(self, text: str | None) -> float:
        p, _ = self.sentences(text)
        return float(-np.expm1(np.log1p(-np.minimum(p, 1 - 1e-12)).sum()))


def fit(docs: DataFrame, labels: DataFrame, per_class: int = PER_CLASS, count: int = FEATURES, rounds: int = 300) -> Model:
    """Learn the weights by gradient steps on the noisy-or likelihood of the sample's labels."""
    sample, sizes = training_sample(docs, labels, per_class)
    if not (sizes.get(0) and sizes.get(1)):
        return Model(np.zeros(0, U64), np.zeros(0), -40.0)
    keys = _select(sample, count)
    blank = Model(keys, np.zeros(len(keys)), 0.0)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part, texts in texts_in(batches):
            rows = []
            for toxic, text in zip(part.column("toxic").to_pylist(), texts):
                hashes, sentence, bounds = features(text)
                at, n = blank.find(hashes)
                pairs = np.unique(np.stack([sentence[at], n]), axis=1)
                rows.append((toxic, len(bounds) - 1, pairs[0].tolist(), pairs[1].tolist()))
            yield pa.RecordBatch.from_pandas(pd.DataFrame(rows, columns=["toxic", "n", "s", "f"]), schema=schema)

    schema = pa.schema([("toxic", pa.int32()), ("n", pa.int64()), ("s", pa.list_(pa.int64())), ("f", pa.list_(pa.int64()))])
    # At most two samples of ``per_class`` rows, and of those only the chosen features.
    rows = sample.mapInArrow(run, "toxic int, n long, s array<long>, f array<long>").collect()
    rows.sort(key=lambda r: (r["toxic"], r["n"], r["s"], r["f"]))
    y = np.array([r["toxic"] for r in rows], float)
    drawn = {label: max(1.0, float((y == label).sum())) for label in (0, 1)}
    weight = np.where(y == 1, sizes[1] / drawn[1], sizes[0] / drawn[0])
    weight /= weight.mean()
    owner, term, bag, plain = [], [], [], []
    for i, r in enumerate(rows):
        held, place = np.unique(np.array(r["s"], np.int64), return_inverse=True)
        owner.append(place + len(bag))
        term.append(np.array(r["f"], np.int64))
        bag += [i] * len(held)
        plain.append(r["n"] - len(held))
    owner, term = np.concatenate(owner), np.concatenate(term)
    bag, plain = np.array(bag, np.int64), np.array(plain, float)
    w, b = np.zeros(len(keys)), -6.0
    moments = np.zeros((2, len(keys) + 1))
    for step in range(1, rounds + 1):
        z = b + np.bincount(owner, w[term], minlength=len(bag))
        p, p0 = 1 / (1 + np.exp(-z)), 1 / (1 + np.exp(-b))
        clean = np.bincount(bag, np.log1p(-np.minimum(p, 1 - 1e-9)), minlength=len(y)) + plain * np.log1p(-p0)
        doc = np.clip(-np.expm1(clean), 1e-9, 1 - 1e-9)
        # d loss / d z of a sentence is p times this factor of its document.
        factor = weight * np.where(y == 1, -(1 - doc) / doc, 1.0) / len(y)
        dz = factor[bag] * p
        grad = np.append(np.bincount(term, dz[owner], minlength=len(w)) + 1e-5 * w, dz.sum() + (factor * plain).sum() * p0)
        moments[0] = 0.9 * moments[0] + 0.1 * grad
        moments[1] = 0.999 * moments[1] + 0.001 * grad**2
        move = 0.1 * (moments[0] / (1 - 0.9**step)) / (np.sqrt(moments[1] / (1 - 0.999**step)) + 1e-8)
        w, b = np.maximum(w - move[:-1], 0.0), min(b - move[-1], -4.0)
    return Model(keys, w, b)


def scored(docs: DataFrame, model: Model) -> DataFrame:
    """All columns of ``docs`` and ``score`` (in place of a column of that name)."""
    shared = docs.sparkSession.sparkContext.broadcast(model)  # at most ``FEATURES`` weights
    kept = docs.drop("score")
    names = kept.columns

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part, texts in texts_in(batches):
            scores = pa.array([shared.value.score(text) for text in texts], pa.float64())
            yield pa.RecordBatch.from_arrays([*part.columns, scores], [*names, "score"])

    schema = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in kept.schema.fields)
    return kept.mapInArrow(run, f"{schema}, score double")


def offending_sentences(docs: DataFrame, model: Model, threshold: float = 0.5) -> DataFrame:
    """``doc_id, sentence, score, text`` of each sentence that scores ``threshold`` or more."""
    shared = docs.sparkSession.sparkContext.broadcast(model)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part, texts in texts_in(batches):
            rows = []
            for doc_id, text in zip(part.column("doc_id").to_pylist(), texts):
                p, bounds = shared.value.sentences(text)
                raw = (text or "").encode("utf-8", "surrogatepass")
                for k in np.flatnonzero(p >= threshold).tolist():
                    rows.append((doc_id, k, float(p[k]), raw[bounds[k] : bounds[k + 1]].decode("utf-8", "replace").strip()))
            columns = list(zip(*rows)) if rows else [[], [], [], []]
            kinds = [pa.int64(), pa.int64(), pa.float64(), pa.string()]
            yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(columns, kinds)], ["doc_id", "sentence", "score", "text"])

    return docs.select(F.col("doc_id").cast("long"), "text").mapInArrow(run, "doc_id long, sentence long, score double, text string")
