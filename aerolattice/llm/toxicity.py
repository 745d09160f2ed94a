"""Toxicity by multiple-instance learning: a document is toxic if one of its sentences is.

A sentence's score is a logistic function of its words; the document's is the noisy-or of its sentences. The words'
weights are learned from document labels alone, and the same sentence scores then say where the offence is.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from aerolattice.llm.bytetext import LOWER, NOT_ALNUM, columns, flat, mix, prefix_hashes, slices, span_hashes, words
from aerolattice.llm.labelled import fold, labelled_sample
from aerolattice.runtime import pinned

#: Labelled documents that the weights are learned from, at most.
TRAIN_DOCS = 6_000
#: A feature needs this many of them to get a weight.
MIN_DOCS = 6
#: Besides whole words, longer words count by their first bytes, since offence is inflected.
PREFIXES = (4, 5)
ROUNDS, RATE, LASSO = 250, 0.1, 5e-5
OFFENDING = 0.5


@dataclass
class Bag:
    """Features of a slice of texts: hash and sentence of each; document of each sentence, and the bytes it spans."""

    hashes: np.ndarray
    sentence: np.ndarray
    sentence_doc: np.ndarray
    start: np.ndarray
    end: np.ndarray


def sentences(data: np.ndarray, places: np.ndarray) -> Bag:
    """Sentences end at a line break, at . ! ? before white space, and with the text; those without words are left out."""
    low = LOWER[data]
    starts, ends, at = words(low, places, NOT_ALNUM)
    prefix = prefix_hashes(low)
    hashes = span_hashes(prefix, starts, ends)
    stop = (data == 46) | (data == 33) | (data == 63)
    blank_next = np.zeros(len(data), bool)
    blank_next[:-1] = (data[1:] == 32) | (data[1:] == 10)
    breaks = np.cumsum((stop & blank_next) | (data == 10))
    doc = np.repeat(np.arange(len(at) - 1), np.diff(at))
    key = breaks[starts] if len(starts) else starts
    first = np.flatnonzero(np.r_[True, (key[1:] != key[:-1]) | (doc[1:] != doc[:-1])]) if len(starts) else starts
    number = np.zeros(len(starts), np.int64)
    number[first] = 1
    last = np.append(first[1:], len(starts)) - 1 if len(starts) else first
    sentence = np.cumsum(number) - 1
    features, owners = [hashes], [sentence]
    for size in PREFIXES:
        longer = np.flatnonzero(ends - starts > size)
        features.append(mix(span_hashes(prefix, starts[longer], starts[longer] + size) + np.uint64(size)))
        owners.append(sentence[longer])
    return Bag(np.concatenate(features), np.concatenate(owners), doc[first], starts[first], ends[last])


@dataclass
class NoisyOr:
    """Sorted hashes of the words that carry weight, their weights, and the weight every sentence starts with."""

    hashes: np.ndarray
    weights: np.ndarray
    bias: float

    def logits(self, bag: Bag) -> np.ndarray:
        at = np.searchsorted(self.hashes, bag.hashes)
        at[at == len(self.hashes)] = 0
        known = np.flatnonzero(self.hashes[at] == bag.hashes)
        once = np.unique(bag.sentence[known] * len(self.hashes) + at[known])  # a repeated word counts once a sentence
        sentence, feature = np.divmod(once, len(self.hashes))
        return self.bias + np.bincount(sentence, self.weights[feature], minlength=len(bag.sentence_doc))


def softplus(z: np.ndarray) -> np.ndarray:
    return np.logaddexp(0, z)


def train(known: np.ndarray, rows: list[tuple[bytes, bytes, int, int]]) -> NoisyOr:
    """Weights that make the noisy-or of each document's sentences fit its label; lasso keeps most of them at zero.

    `known` are the sorted hashes of the features; a row has a document's features by their place among them, the number of
    each one's sentence, how many sentences there are, and the label.
    """
    if not len(known):
        return NoisyOr(np.zeros(1, np.uint64), np.zeros(1), -4.0)
    sizes = np.array([r[2] for r in rows])
    before = np.cumsum(sizes) - sizes
    column = np.concatenate([np.frombuffer(r[0], "<i4") for r in rows])
    row = np.concatenate([np.frombuffer(r[1], "<i4") + np.int32(at) for r, at in zip(rows, before, strict=True)])
    sentence_doc = np.repeat(np.arange(len(rows)), sizes)
    label, docs = np.array([r[3] for r in rows]), len(rows)
    weight, bias = np.zeros(len(known)), np.array([-6.0])
    m1, m2 = np.zeros(len(known) + 1), np.zeros(len(known) + 1)
    for step in range(1, ROUNDS + 1):
        z = bias + np.bincount(row, weight[column], minlength=len(sentence_doc))
        total = np.maximum(np.bincount(sentence_doc, softplus(z), minlength=docs), 1e-9)
        pull = np.where(label > 0, -1 / np.expm1(np.minimum(total, 50)), 1.0) / docs
        slope = pull[sentence_doc] / (1 + np.exp(-np.clip(z, -50, 50)))
        grad = np.append(np.bincount(column, slope[row], minlength=len(known)), slope.sum())
        m1, m2 = 0.9 * m1 + 0.1 * grad, 0.99 * m2 + 0.01 * grad**2
        move = RATE * (m1 / (1 - 0.9**step)) / (np.sqrt(m2 / (1 - 0.99**step)) + 1e-6)
        bias = bias - move[-1:]
        weight = weight - move[:-1]
        weight = np.sign(weight) * np.maximum(np.abs(weight) - RATE * LASSO / (np.sqrt(m2[:-1] / (1 - 0.99**step)) + 1e-6), 0)
    keep = weight != 0
    if not keep.any():
        keep[:1] = True
    return NoisyOr(known[keep], weight[keep], float(bias[0]))


def _bags(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        data, places = flat(batch.column(0))
        out = []
        for first, end, part, at in slices(data, places):
            bag = sentences(part, at)
            order = np.argsort(bag.sentence, kind="stable")
            hashes, sentence = bag.hashes[order], bag.sentence[order]
            low = np.searchsorted(bag.sentence_doc, np.arange(end - first + 1))
            edge = np.searchsorted(sentence, low)
            for i in range(end - first):
                mine = slice(edge[i], edge[i + 1])
                out.append((hashes[mine].tobytes(), (sentence[mine] - low[i]).astype("<i4").tobytes()))
        yield pa.record_batch(
            [pa.array([w for w, _ in out], pa.binary()), pa.array([s for _, s in out], pa.binary()), batch.column(1)],
            names=["words", "sentences", "label"],
        )


def _spread(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """How many documents have each feature."""
    for batch in batches:
        own = [np.unique(np.frombuffer(x, np.uint64)) for x in batch.column(0).to_pylist()]
        found, count = np.unique(np.concatenate([np.zeros(0, np.uint64), *own]), return_counts=True)
        yield pa.record_batch([pa.array(found.astype(np.int64)), pa.array(count)], names=["feature", "docs"])


def _placed(known: np.ndarray):
    def place(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            columns_, owners, sizes = [], [], []
            for words_, numbers in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                hashes, own = np.frombuffer(words_, np.uint64), np.frombuffer(numbers, "<i4").astype(np.int64)
                at = np.searchsorted(known, hashes)
                at[at == len(known)] = 0
                use = known[at] == hashes
                sentence, feature = np.divmod(np.unique(own[use] * len(known) + at[use]), len(known))
                columns_.append(feature.astype("<i4").tobytes())
                owners.append(sentence.astype("<i4").tobytes())
                sizes.append(int(own.max(initial=-1)) + 1)
            out = [pa.array(columns_, pa.binary()), pa.array(owners, pa.binary()), pa.array(sizes, pa.int32()), batch.column(2)]
            yield pa.record_batch(out, names=["features", "sentences", "size", "label"])

    return place


def _learned(known: np.ndarray):
    def learn(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        model = train(known, sorted(tuple(r.values()) for batch in batches for r in batch.to_pylist()))
        out = [[model.hashes.tobytes()], [model.weights.tobytes()], [model.bias]]
        yield pa.record_batch([pa.array(x, t) for x, t in zip(out, (pa.binary(), pa.binary(), pa.float64()), strict=True)], names=["hashes", "weights", "bias"])

    return learn


def fit(docs: DataFrame, labels: DataFrame, label: str = "toxic", folds: int = 4, held: int = 2, most: int = TRAIN_DOCS) -> NoisyOr:
    """Learn from at most `most` labelled documents outside the held-out fold, in one task.

    The frequent features and the weights that are not zero reach the driver, the documents' features do not.
    """
    sample = labelled_sample(docs, labels, label, folds, held, most).select("text", F.col("label").cast("int"))
    bags = pinned(sample.mapInArrow(_bags, "words binary, sentences binary, label int"))
    counted = bags.select("words").mapInArrow(_spread, "feature bigint, docs bigint").groupBy("feature").agg(F.sum("docs").alias("docs"))
    frequent = counted.where(F.col("docs") >= MIN_DOCS).select("feature").toArrow()["feature"].to_numpy()
    known = np.sort(frequent.astype(np.uint64))
    if not len(known):
        return train(known, [])
    placed = bags.mapInArrow(_placed(known), "features binary, sentences binary, size int, label int")
    hashes, weights, bias = placed.repartition(1).mapInArrow(_learned(known), "hashes binary, weights binary, bias double").first()
    return NoisyOr(np.frombuffer(hashes, np.uint64), np.frombuffer(weights), bias)


def _scorer(model: NoisyOr):
    kind = pa.list_(pa.struct([("start", pa.int32()), ("end", pa.int32()), ("score", pa.float64())]))

    def score(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            data, places = flat(batch.column(1))
            scores, spans = [], []
            for first, end, part, at in slices(data, places):
                bag = sentences(part, at)
                z = model.logits(bag)
                scores.append(-np.expm1(-np.bincount(bag.sentence_doc, softplus(z), minlength=end - first)))
                here: list[list[dict]] = [[] for _ in range(end - first)]
                for i in np.flatnonzero(z > np.log(OFFENDING / (1 - OFFENDING))):
                    doc = bag.sentence_doc[i]
                    low = at[doc]
                    here[doc].append({"start": int(bag.start[i] - low), "end": int(bag.end[i] - low), "score": float(1 / (1 + np.exp(-z[i])))})
                spans += here
            found = pa.array(np.concatenate(scores) if scores else np.zeros(0))
            yield pa.record_batch([batch.column(0), found, pa.array(spans, kind)], names=["doc_id", "score", "offending"])

    return score


def score(docs: DataFrame, model: NoisyOr, id_column: str = "doc_id", text: str = "text") -> DataFrame:
    """doc_id, score, offending: the noisy-or of a text's sentences, and the UTF-8 spans of sentences over OFFENDING.

    A text without words, an empty or a null one scores 0 and has no spans; rows that repeat score alike; a null id stays
    null. Other columns are not read.
    """
    rows = columns(docs, id_column, text).select(F.col(id_column).cast("bigint"), F.col(text).cast("string"))
    return rows.mapInArrow(_scorer(model), "doc_id bigint, score double, offending array<struct<start:int,end:int,score:double>>")


def toxicity(docs: DataFrame, labels: DataFrame, threshold: float = 0.3, folds: int = 4, held: int = 2) -> DataFrame:
    """doc_id, held_out, score, predicted, offending for every document; without labels every score is near 0."""
    found = score(docs, fit(docs, labels, "toxic", folds, held))
    return found.select(
        "doc_id",
        (fold("doc_id", folds) == held).alias("held_out"),
        "score",
        (F.col("score") >= threshold).cast("int").alias("predicted"),
        "offending",
    )
