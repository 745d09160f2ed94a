"""Quality by attention-based multiple-instance learning.

A document is a bag of passages. Each passage is encoded from how it is written (byte classes and their successions,
repeats, word lengths), a learned gate says how much each passage counts, and the weighted passage representation is
scored. Encoder, gate and score are learned together from document labels.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from aerolattice.llm.bytetext import BLANK, LOWER, columns, flat, mix, prefix_hashes, slices, span_hashes, words
from aerolattice.llm.labelled import fold, labelled_sample

#: Labelled documents that the model is fitted on, at most.
TRAIN_DOCS = 8_000
PASSAGE_WORDS = 64
HIDDEN, GATE = 32, 16
EPOCHS, BATCH, RATE, DECAY = 16, 128, 3e-3, 1e-4

#: Byte classes: lower case, capital, digit, blank, line break, stop, ! or ?, bar, other ASCII sign, control, multi-byte.
CLASSES = 11
CLASS = np.full(256, 8, np.int64)
CLASS[97:123], CLASS[65:91], CLASS[48:58] = 0, 1, 2
CLASS[[32, 9, 11, 12, 13]], CLASS[10] = 3, 4
CLASS[[44, 46, 58, 59]], CLASS[[33, 63]], CLASS[124] = 5, 6, 7
CLASS[:9] = CLASS[14:32] = CLASS[127] = 9
CLASS[128:] = 10

FEATURES = CLASSES + CLASSES * CLASSES + 7


def passages(data: np.ndarray, places: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Features of each passage, its document, and the bytes it spans; a text without words is one passage."""
    low = LOWER[data]
    starts, ends, at = words(low, places, BLANK)
    count = np.diff(at)
    parts = np.maximum(1, -(-count // PASSAGE_WORDS))
    first = np.concatenate([[0], np.cumsum(parts)])
    doc = np.repeat(np.arange(len(count)), parts)
    number = np.arange(first[-1]) - first[doc]
    word = np.minimum(at[doc] + number * PASSAGE_WORDS, max(0, len(starts) - 1))
    begin = np.where(number == 0, places[doc], starts[word] if len(starts) else 0)
    end = np.append(begin[1:], places[-1])
    end[first[1:] - 1] = places[1:]
    n = len(doc)
    owner = np.repeat(np.arange(n), end - begin)
    kind = CLASS[data]
    single = np.bincount(owner * CLASSES + kind, minlength=n * CLASSES).reshape(n, -1)
    same = owner[1:] == owner[:-1] if len(owner) else owner
    pair = (owner[1:] * CLASSES + kind[1:]) * CLASSES + kind[:-1]
    double = np.bincount(pair[same], minlength=n * CLASSES * CLASSES).reshape(n, -1)
    size = np.maximum(1, end - begin)[:, None]
    hashes = span_hashes(prefix_hashes(low), starts, ends)
    word_owner = first[:-1][np.repeat(np.arange(len(count)), count)] + (np.arange(len(starts)) - np.repeat(at[:-1], count)) // PASSAGE_WORDS
    held = np.maximum(1, np.bincount(word_owner, minlength=n))
    apart = np.unique(mix(hashes + word_owner.astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15)), return_index=True)[1]
    different = np.bincount(word_owner[apart], minlength=n)
    twice = np.flatnonzero((hashes[1:] == hashes[:-1]) & (word_owner[1:] == word_owner[:-1])) + 1 if len(hashes) else apart
    repeats = np.bincount(word_owner[twice], minlength=n)
    length = (ends - starts).astype(float)
    mean = np.bincount(word_owner, length, minlength=n) / held
    spread = np.sqrt(np.maximum(0, np.bincount(word_owner, length**2, minlength=n) / held - mean**2))
    more = [different / held, repeats / held, mean / 8, spread / 8, np.log(held) / 4, number == 0, np.log1p(parts[doc])]
    return np.hstack([single / size, double / size, np.stack(more, 1)]).astype(np.float32), doc, begin, end


@dataclass
class GatedAttention:
    """Parameters by name; `mean` and `scale` put the features of the fitted sample on one footing."""

    p: dict[str, np.ndarray]

    @staticmethod
    def start(mean: np.ndarray, scale: np.ndarray) -> GatedAttention:
        draw = np.random.RandomState(17)

        def matrix(a: int, b: int) -> np.ndarray:
            return (draw.standard_normal((a, b)) / np.sqrt(a)).astype(np.float32)

        shapes = {"encode": (FEATURES, HIDDEN), "tanh": (HIDDEN, GATE), "gate": (HIDDEN, GATE), "pick": (GATE, 1), "out": (HIDDEN, 1)}
        p = {name: matrix(*shape) for name, shape in shapes.items()}
        return GatedAttention(p | {"shift": np.zeros(HIDDEN, np.float32), "bias": np.zeros(1, np.float32), "mean": mean, "scale": scale})

    def forward(self, x: np.ndarray, doc: np.ndarray) -> dict[str, np.ndarray]:
        """Every document has one passage at least, and passages lie in order of their documents."""
        p = self.p
        first = np.flatnonzero(np.r_[True, doc[1:] != doc[:-1]])
        x = np.clip((x - p["mean"]) / p["scale"], -6, 6)
        h = np.tanh(x @ p["encode"] + p["shift"])
        t = np.tanh(h @ p["tanh"])
        g = 1 / (1 + np.exp(-(h @ p["gate"])))
        e = (t * g @ p["pick"])[:, 0]
        e = np.exp(e - np.maximum.reduceat(e, first)[doc])
        a = e / np.add.reduceat(e, first)[doc]
        z = np.add.reduceat(a[:, None] * h, first)
        y = 1 / (1 + np.exp(-((z @ p["out"])[:, 0] + p["bias"][0])))
        return {"x": x, "h": h, "t": t, "g": g, "a": a, "z": z, "y": y, "first": first}

    def gradients(self, x: np.ndarray, doc: np.ndarray, label: np.ndarray) -> dict[str, np.ndarray]:
        p, f = self.p, self.forward(x, doc)
        h, t, g, a = f["h"], f["t"], f["g"], f["a"]
        dy = ((f["y"] - label) / len(label)).astype(np.float32)
        dz = dy[:, None] @ p["out"].T
        da = (dz[doc] * h).sum(1)
        de = a * (da - np.add.reduceat(a * da, f["first"])[doc])
        dv = de[:, None] @ p["pick"].T
        dt, dg = dv * g * (1 - t * t), dv * t * g * (1 - g)
        dh = (a[:, None] * dz[doc] + dt @ p["tanh"].T + dg @ p["gate"].T) * (1 - h * h)
        grads = {"encode": f["x"].T @ dh, "shift": dh.sum(0), "tanh": h.T @ dt, "gate": h.T @ dg}
        return grads | {"pick": (t * g).T @ de[:, None], "out": f["z"].T @ dy[:, None], "bias": dy.sum(keepdims=True)}


def train(bags: list[np.ndarray], label: np.ndarray) -> GatedAttention:
    """Fit by Adam over shuffled batches of documents; the same bags in the same order give the same model."""
    if not bags:
        return GatedAttention.start(np.zeros(FEATURES, np.float32), np.ones(FEATURES, np.float32))
    rows = np.concatenate(bags)
    model = GatedAttention.start(rows.mean(0), np.maximum(rows.std(0), 1e-3))
    share = float(np.clip(label.mean(), 0.01, 0.99))
    model.p["bias"][:] = np.log(share / (1 - share))
    moments = {k: (np.zeros_like(v), np.zeros_like(v)) for k, v in model.p.items() if k not in ("mean", "scale")}
    draw, step = np.random.RandomState(5), 0
    for epoch in range(EPOCHS):
        order = draw.permutation(len(bags))
        for at in range(0, len(order), BATCH):
            batch = order[at : at + BATCH]
            doc = np.repeat(np.arange(len(batch)), [len(bags[i]) for i in batch])
            grads = model.gradients(np.concatenate([bags[i] for i in batch]), doc, label[batch])
            step += 1
            rate = RATE * (1 - epoch / EPOCHS)
            for name, (m, v) in moments.items():
                grad = grads[name] + DECAY * model.p[name]
                m[:] = 0.9 * m + 0.1 * grad
                v[:] = 0.999 * v + 0.001 * grad**2
                model.p[name] -= rate * (m / (1 - 0.9**step)) / (np.sqrt(v / (1 - 0.999**step)) + 1e-8)
    return model


def _encode(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        data, places = flat(batch.column(0))
        out = []
        for first, end, part, at in slices(data, places):
            x, doc, _, _ = passages(part, at)
            edge = np.searchsorted(doc, np.arange(end - first + 1))
            out += [x[edge[i] : edge[i + 1]].astype(np.float16).tobytes() for i in range(end - first)]
        yield pa.record_batch([pa.array(out, pa.binary()), batch.column(1)], names=["bag", "label"])


def fit(docs: DataFrame, labels: DataFrame, label: str = "quality", folds: int = 5, held: int = 0, most: int = TRAIN_DOCS) -> GatedAttention:
    """Learn from at most `most` labelled documents outside the held-out fold; only their features reach the driver."""
    sample = labelled_sample(docs, labels, label, folds, held, most).select("text", F.col("label").cast("int"))
    rows = sorted((bytes(r[0]), r[1]) for r in sample.mapInArrow(_encode, "bag binary, label int").collect())
    bags = [np.frombuffer(r[0], np.float16).astype(np.float32).reshape(-1, FEATURES) for r in rows]
    return train(bags, np.array([r[1] for r in rows], np.float32))


def _scorer(model: GatedAttention):
    def score(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            data, places = flat(batch.column(1))
            scores, spans, counts = [], [], []
            for _, _, part, at in slices(data, places):
                x, doc, begin, end = passages(part, at)
                f = model.forward(x, doc)
                scores.append(f["y"].astype(float))
                top = np.lexsort((-f["a"], doc))[f["first"]]
                spans.append(np.stack([begin[top] - at[:-1], end[top] - at[:-1]], 1))
                counts.append(np.diff(np.append(f["first"], len(doc))))
            both = np.concatenate(spans) if spans else np.zeros((0, 2), int)
            out = [np.concatenate(scores) if scores else np.zeros(0), np.concatenate(counts) if counts else np.zeros(0, int), *both.T]
            names = ["doc_id", "score", "n_passages", "top_start", "top_end"]
            yield pa.record_batch([batch.column(0), *[pa.array(np.ascontiguousarray(c)) for c in out]], names=names)

    return score


def score(docs: DataFrame, model: GatedAttention, id_column: str = "doc_id", text: str = "text") -> DataFrame:
    """doc_id, score, n_passages, and the UTF-8 span of the passage that weighs most.

    Every passage of a text is encoded. A text without words, an empty or a null one is one passage without content and
    gets the score that the model has learned for such; rows that repeat score alike. Other columns are not read.
    """
    rows = columns(docs, id_column, text).select(F.col(id_column).cast("bigint"), F.col(text).cast("string"))
    return rows.mapInArrow(_scorer(model), "doc_id bigint, score double, n_passages bigint, top_start bigint, top_end bigint")


def quality(docs: DataFrame, labels: DataFrame, threshold: float = 0.3, folds: int = 5, held: int = 0) -> DataFrame:
    """doc_id, held_out, score, predicted and the passage that weighs most, for every document."""
    found = score(docs, fit(docs, labels, "quality", folds, held))
    return found.select(
        "doc_id",
        (fold("doc_id", folds) == held).alias("held_out"),
        "score",
        (F.col("score") >= threshold).cast("int").alias("predicted"),
        "n_passages",
        "top_start",
        "top_end",
    )
