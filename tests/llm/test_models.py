"""Learned operators: held-out accuracy, exact counts, gradients, proper probabilities, messy and empty rows."""

import math
import os
import random
import re
import uuid
import zlib
from collections import Counter

import numpy as np
import pytest
from llm.conftest import WORDS, messy_rows

from aerolattice.llm import gru, lm_scoring, quality, toxicity

PLAIN = [(i, t or "") for i, t, *_ in messy_rows()]


def area_under_curve(score, label):
    order = np.argsort(score, kind="stable")
    rank = np.empty(len(score))
    rank[order] = np.arange(len(score))
    good = label == 1
    return (rank[good].mean() - (good.sum() - 1) / 2) / (~good).sum()


def corpus(seed, n, bad, spoil):
    """Texts of some sentences; a share `bad` of them is spoilt."""
    draw = random.Random(seed)
    rows, labels = [], []
    for i in range(n):
        lines = [" ".join(draw.choice(WORDS) + draw.choice(["", "s", "ed"]) for _ in range(draw.randrange(4, 12))).capitalize() + "." for _ in range(draw.randrange(1, 12))]
        wrong = draw.random() < bad
        if wrong:
            lines = spoil(draw, lines)
        rows.append((i, " ".join(lines)))
        labels.append((i, int(wrong)))
    return rows, labels


def insult(draw, lines):
    at = draw.randrange(len(lines))
    words = lines[at][:-1].split()
    words.insert(draw.randrange(len(words) + 1), draw.choice(["blorgh", "snarfing", "snarfed", "vexxum"]))
    return [*lines[:at], " ".join(words) + ".", *lines[at + 1 :]]


def shout(draw, lines):
    at = draw.randrange(len(lines))
    return [*lines[:at], " ".join(w.upper() + "!!" for w in lines[at].split() * 6), *lines[at + 1 :]]


def judged(spark, run, name, rows, labels, folds, held):
    docs = spark.createDataFrame(rows, "doc_id bigint, text string").repartition(3)
    marks = spark.createDataFrame(labels, f"doc_id bigint, {name} int")
    found = {r.doc_id: r for r in run(docs, marks).collect()}
    truth = dict(labels)
    assert all(r.held_out == (zlib.crc32(str(i).encode()) % folds == held) for i, r in found.items())
    out = [i for i, r in found.items() if r.held_out]
    score = np.array([found[i].score for i in out])
    assert ((score >= 0) & (score <= 1)).all()
    assert all(found[i].predicted == int(found[i].score >= 0.3) for i in found)
    return area_under_curve(score, np.array([truth[i] for i in out])), found


def test_toxicity_is_learned_and_located(spark):
    rows, labels = corpus(1, 900, 0.3, insult)
    area, found = judged(spark, toxicity.toxicity, "toxic", rows, labels, 4, 2)
    assert area > 0.97
    hit = [r for r in found.values() if r.offending and dict(labels)[r.doc_id]]
    assert len(hit) > 150
    for r in hit:
        text = dict(rows)[r.doc_id].encode()
        assert any(re.search(rb"blorgh|snarf|vexxum", text[s.start : s.end]) for s in r.offending)


def test_toxicity_weights_are_not_learned_in_the_driver(spark, monkeypatch):
    driver, train = os.getpid(), toxicity.train

    def elsewhere(*given):
        assert os.getpid() != driver
        return train(*given)

    rows, labels = corpus(3, 300, 0.3, insult)
    monkeypatch.setattr(toxicity, "train", elsewhere)
    area, _ = judged(spark, toxicity.toxicity, "toxic", rows, labels, 4, 2)
    assert area > 0.9


def test_quality_is_learned(spark):
    rows, labels = corpus(2, 600, 0.3, shout)
    labels = [(i, 1 - x) for i, x in labels]
    area, _ = judged(spark, quality.quality, "quality", rows, labels, 5, 0)
    assert area > 0.97


@pytest.mark.parametrize("run, name", [(toxicity.toxicity, "toxic"), (quality.quality, "quality")])
def test_messy_labels_and_rows(spark, messy, clashing, empty, run, name):
    marks = spark.createDataFrame([(i, i % 2) for i in range(21)] + [(3, None), (None, 1), (4, 1)], f"doc_id bigint, {name} int")
    found = Counter(tuple(r)[:4] for r in run(messy, marks).collect())
    assert found == Counter(tuple(r)[:4] for r in run(clashing, marks).collect())
    assert Counter(k[0] for k in found.elements()) == Counter(i for i, _ in PLAIN)
    assert run(empty, marks).count() == 0
    none = marks.where("doc_id > 99")
    assert run(messy, none).count() == len(PLAIN)


def test_attention_gradients():
    draw = np.random.RandomState(0)
    model = quality.GatedAttention.start(np.zeros(quality.FEATURES, np.float32), np.ones(quality.FEATURES, np.float32))
    model.p = {k: v.astype(np.float64) for k, v in model.p.items()}
    x, doc, label = draw.standard_normal((7, quality.FEATURES)), np.array([0, 0, 1, 2, 2, 2, 3]), np.array([1, 0, 0, 1.0])

    def loss():
        y = model.forward(x, doc)["y"]
        return -(label * np.log(y) + (1 - label) * np.log(1 - y)).mean()

    grads = model.gradients(x, doc, label)
    for name, grad in grads.items():
        for _ in range(3):
            at = tuple(draw.randint(0, s) for s in grad.shape)
            keep = model.p[name][at]
            model.p[name][at] = keep + 1e-5
            high = loss()
            model.p[name][at] = keep - 1e-5
            low = loss()
            model.p[name][at] = keep
            assert grad[at] == pytest.approx((high - low) / 2e-5, rel=1e-3, abs=1e-6)


def test_recurrent_gradients():
    draw = np.random.RandomState(0)
    p = {k: v.astype(np.float64) for k, v in gru.start(np.ones(gru.VOCABULARY)).items()}
    before, target = draw.randint(0, gru.VOCABULARY, (2, 5, 3))
    live = np.ones((5, 3), bool)
    live[3:, 1] = False
    state = draw.standard_normal((3, gru.HIDDEN))
    for k in p:
        p[k] = p[k] + 0.3 * draw.standard_normal(p[k].shape)

    def loss():
        states, _, _ = gru.forward(p, before, state, False)
        return -gru.log_probability(p, states.astype(np.float64)[live], target[live]).sum() / live.sum()

    states, _, steps = gru.forward(p, before, state, True)
    grads, total = gru.gradients(p, states, steps, target, live)
    assert total / live.sum() == pytest.approx(loss(), rel=1e-5)
    spots = {"input": before[1, 0], "word": target[0, 0] // gru.PER_CLASS}
    for name, grad in grads.items():
        for _ in range(4):
            at = tuple(draw.randint(0, s) for s in grad.shape)
            if name in spots:
                at = (spots[name], *at[1:])
            keep = p[name][at]
            p[name][at] = keep + 1e-3
            high = loss()
            p[name][at] = keep - 1e-3
            low = loss()
            p[name][at] = keep
            assert grad[at] == pytest.approx((high - low) / 2e-3, rel=2e-2, abs=2e-5)


def test_state_is_carried_across_windows():
    draw = np.random.RandomState(2)
    p = gru.start(np.ones(gru.VOCABULARY))
    texts = [draw.randint(0, gru.VOCABULARY, n) for n in (1, 2, 200, 31, 32, 33, 64, 5, 0)]
    places = np.concatenate([[0], np.cumsum([len(x) for x in texts])])
    found = gru.score(p, np.concatenate(texts), places, most=4)
    for x, score in zip(texts, found, strict=True):
        states, _, _ = gru.forward(p, np.concatenate([[0], x[:-1]])[: len(x), None].astype(int), np.zeros((1, gru.HIDDEN), np.float32), False)
        assert score == pytest.approx(gru.log_probability(p, states[:, 0], x).sum() if len(x) else 0, abs=1e-2)


def test_word_probabilities_sum_to_one():
    p = gru.start(np.arange(gru.VOCABULARY, dtype=float))
    states = np.random.RandomState(1).standard_normal((3, gru.HIDDEN)).astype(np.float32)
    every = np.arange(gru.VOCABULARY)
    for s in states:
        logs = gru.log_probability(p, np.repeat(s[None], len(every), 0), every)
        assert np.exp(logs).sum() == pytest.approx(1, abs=1e-3)


def test_training_learns_a_succession():
    words = [np.array([2 + (k + j) % 5 for j in range(60)] + [0]) for k in range(100)]
    places = np.concatenate([[0], np.cumsum([len(x) for x in words])])
    p = gru.start(np.bincount(np.concatenate(words), minlength=gru.VOCABULARY).astype(float))
    before = gru.score(p, np.concatenate(words), places).sum()
    for _ in range(12):
        p, tokens, _ = gru.train(p, words)
    assert tokens == sum(map(len, words))
    assert gru.score(p, np.concatenate(words), places).sum() > 0.5 * before


def test_no_text_of_a_task_goes_on_alone(monkeypatch):
    draw = np.random.RandomState(4)
    texts = [draw.randint(0, gru.VOCABULARY, n) for n in (2000, *[40] * 200, 0, 1)]
    p = gru.start(np.ones(gru.VOCABULARY))
    for k in p:
        p[k] = p[k] + 0.3 * draw.standard_normal(p[k].shape).astype(np.float32)
    sizes, forward = [], gru.forward

    def noted(p, words, *more):
        sizes.append(words.size)
        return forward(p, words, *more)

    monkeypatch.setattr(gru, "forward", noted)
    _, tokens, loss = gru.train(p, texts, rate=0.0)
    assert tokens == 10001 and len(sizes) <= 64 and sum(sizes) < 1.1 * tokens
    places = np.concatenate([[0], np.cumsum([len(x) for x in texts])])
    alone = [-gru.score(p, x, np.array([0, len(x)])).sum() for x in texts]
    assert -gru.score(p, np.concatenate(texts), places) == pytest.approx(alone, rel=1e-4)
    assert loss == pytest.approx(sum(alone), rel=1e-4)


def test_rows_are_summed_by_word():
    draw = np.random.RandomState(5)
    words = np.concatenate([np.full(70, 1), np.full(gru.ABREAST, 3), np.full(gru.ABREAST + 1, 9), draw.randint(0, 40, 300), [2000]])
    words = draw.permutation(words)
    values, out = draw.standard_normal((len(words), 96)), np.zeros((gru.VOCABULARY, 96))
    gru._sum_by_word(out, words, values)
    want = np.zeros_like(out)
    np.add.at(want, words, values)
    assert out == pytest.approx(want)


def test_model_tells_two_thousand_words_apart():
    words = np.arange(2048)
    p = gru.start(np.ones(gru.VOCABULARY))
    p, tokens, _ = gru.train(p, [words])
    states, _, _ = gru.forward(p, words[None], np.zeros((2048, gru.HIDDEN), np.float32), False)
    assert tokens == 2048 and len(np.unique(states[0], axis=0)) == 2048 and gru.HIDDEN >= 32


FOLD = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def test_every_training_document_takes_gradient_steps(spark, tmp_path, monkeypatch):
    trained = lm_scoring._trained

    def noted(p):
        def train(batches):
            batches = list(batches)
            (tmp_path / uuid.uuid4().hex).write_text(str(sum(batch.num_rows for batch in batches)))
            yield from trained(p)(iter(batches))

        return train

    monkeypatch.setattr(lm_scoring, "_trained", noted)
    docs = spark.range(300).selectExpr("id AS doc_id", "concat('word', id % 7, ' and word', id % 5) AS text")
    held_out = lm_scoring.score_documents(docs).where("held_out").count()
    assert sum(int(x.read_text()) for x in tmp_path.iterdir()) == 300 - held_out > 0


def test_base_scores(messy, clashing, empty):
    tokens = [(i, [*re.findall(r"[^\x20\x09-\x0D]+", t.translate(FOLD)), None]) for i, t in PLAIN]

    def held(i):
        return zlib.crc32(("" if i is None else str(i)).encode()) % 7 == 2

    counts = Counter(w for i, ws in tokens if not held(i) for w in ws)
    n, v = sum(counts.values()), len(counts)
    want = sorted((str(i), held(i), len(ws), sum(counts[w] > 0 for w in ws), n) for i, ws in tokens)
    rows = lm_scoring.score_documents(messy).collect()
    assert sorted((str(r[0]), *r[1:5]) for r in rows) == want
    base = sorted(sum(math.log10((counts[w] + 1) / (n + v + 1)) for w in ws) for _, ws in tokens)
    assert sorted(r.base_score for r in rows) == pytest.approx(base, rel=1e-9)
    assert all(r.score < 0 for r in rows)
    again = lm_scoring.score_documents(clashing).collect()
    assert sorted(r.base_score for r in again) == pytest.approx(base, rel=1e-9)
    assert lm_scoring.score_documents(empty).count() == 0


def test_spelling_is_a_distribution():
    draw = np.random.RandomState(0)
    speller = lm_scoring.Speller(draw.randint(0, 3, lm_scoring.CONTEXTS * lm_scoring.SYMBOLS))
    assert np.exp(speller.logs.reshape(lm_scoring.CONTEXTS, -1).astype(float)).sum(1) == pytest.approx(np.ones(lm_scoring.CONTEXTS), abs=1e-4)
    word = np.frombuffer(b"abcabc", np.uint8)
    one = speller.score(word, np.array([0]), np.array([3]))
    assert speller.score(word, np.array([3]), np.array([6])) == pytest.approx(one)
