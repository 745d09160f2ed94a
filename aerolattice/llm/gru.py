"""Gated recurrent language model in numpy: truncated backpropagation, class-factored softmax, state across windows.

Texts stand side by side in lanes, one after the other, so that every step of a window is full. Within a step arrays are
features x lanes, so that each gate is one block; what does not depend on the step before is done for a whole window at once.
"""

from __future__ import annotations

import heapq
from dataclasses import dataclass

import numpy as np

#: Words of a class; the vocabulary is `CLASSES` such classes in order of frequency.
PER_CLASS = 64
CLASSES = 32
VOCABULARY = CLASSES * PER_CLASS
HIDDEN = 32
#: Steps between truncations. The state is carried on; gradients are not.
WINDOW = 32
#: Lanes at most, and windows that a task has at least before its texts are dealt to more lanes.
BATCH = 128
LEAST_WINDOWS = 32
RATE = 7e-3

SHAPES = {
    "input": (VOCABULARY, 3 * HIDDEN),
    "again": (HIDDEN, 3 * HIDDEN),
    "class": (HIDDEN, CLASSES),
    "class_bias": (CLASSES,),
    "word": (CLASSES, HIDDEN, PER_CLASS),
    "word_bias": (CLASSES, PER_CLASS),
}

Parameters = dict[str, np.ndarray]


def start(frequency: np.ndarray) -> Parameters:
    """A model that predicts the given word frequencies whatever came before."""
    draw = np.random.RandomState(3)
    p = {k: (draw.standard_normal(s) * (0.3 if k == "again" else 0.1)).astype(np.float32) for k, s in SHAPES.items()}
    mass = (frequency + 0.5).reshape(CLASSES, PER_CLASS)
    p["class_bias"] = np.log(mass.sum(1) / mass.sum()).astype(np.float32)
    p["word_bias"] = np.log(mass / mass.sum(1, keepdims=True)).astype(np.float32)
    return p


def flatten(p: Parameters) -> np.ndarray:
    return np.concatenate([p[k].ravel() for k in SHAPES])


def unflatten(x: np.ndarray) -> Parameters:
    return {k: v.astype(np.float32) for k, v in _views(x).items()}


def _views(x: np.ndarray) -> Parameters:
    out, at = {}, 0
    for name, shape in SHAPES.items():
        size = int(np.prod(shape))
        out[name] = x[at : at + size].reshape(shape)
        at += size
    return out


@dataclass
class Steps:
    """What backpropagation needs of a window: arrays of steps x features x lanes, the words, and where texts begin."""

    words: np.ndarray
    first: np.ndarray | None
    before: np.ndarray
    gates: np.ndarray
    fresh: np.ndarray
    again: np.ndarray


def _turned(x: np.ndarray) -> np.ndarray:
    """Lanes x features of each step as features x lanes, or the other way round."""
    return np.ascontiguousarray(x.transpose(0, 2, 1))


def forward(
    p: Parameters, words: np.ndarray, state: np.ndarray, keep: bool, first: np.ndarray | None = None
) -> tuple[np.ndarray, np.ndarray, Steps | None]:
    """States after each of the window's previous words (steps x texts x HIDDEN), and the last one.

    Where `first` (steps x texts) holds, a text begins and the state before it is zero.
    """
    size, lanes = words.shape
    kind = p["again"].dtype
    given = _turned(p["input"][words])
    np.negative(given[:, : 2 * HIDDEN], out=given[:, : 2 * HIDDEN])  # a gate is 1 / (1 + exp(-x))
    turn = np.hstack([-p["again"][:, : 2 * HIDDEN], p["again"][:, 2 * HIDDEN :]]).T.copy()
    states = np.empty((size + 1, HIDDEN, lanes), kind)
    states[0] = state.T
    again = np.empty((size if keep else 1, 3 * HIDDEN, lanes), kind)
    gates = np.empty((size if keep else 1, 2 * HIDDEN, lanes), kind)
    fresh = np.empty((size if keep else 1, HIDDEN, lanes), kind)
    starts = first.any(1) if first is not None else np.zeros(size, bool)
    before = states[:-1].copy() if keep and starts.any() else states[:-1]
    with np.errstate(over="ignore"):
        for t in range(size):
            k = t if keep else 0
            now, own, new, recent = gates[k], again[k], fresh[k], states[t]
            if starts[t]:
                recent = recent * ~first[t]
            if before.base is not states:
                before[t] = recent
            np.matmul(turn, recent, out=own)
            np.add(given[t, : 2 * HIDDEN], own[: 2 * HIDDEN], out=now)
            np.exp(now, out=now)
            np.add(now, 1, out=now)
            np.reciprocal(now, out=now)
            np.multiply(now[:HIDDEN], own[2 * HIDDEN :], out=new)
            np.add(new, given[t, 2 * HIDDEN :], out=new)
            np.tanh(new, out=new)
            state = states[t + 1]
            np.subtract(recent, new, out=state)
            np.multiply(state, now[HIDDEN:], out=state)
            np.add(state, new, out=state)
    steps = Steps(words, first if starts.any() else None, before, gates, fresh, again[:, 2 * HIDDEN :]) if keep else None
    return _turned(states[1:]), states[-1].T.copy(), steps


def _exponentials(logits: np.ndarray, at: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Of each row's softmax the numerators, in place of the logits, their sum, and the log-probability at a place."""
    if logits.size and max(logits.max(), -logits.min()) > 80:
        logits -= logits.max(1, keepdims=True)
    chosen = logits[np.arange(len(logits)), at]
    np.exp(logits, out=logits)
    total = logits @ np.ones(logits.shape[1], logits.dtype)
    return logits, total, chosen - np.log(total)


def _softmaxes(p: Parameters, states: np.ndarray, target: np.ndarray):
    """Exponentials of the classes and of the words in the target's class; the rows of each class stand together.

    First come the order of the rows, the states in it, the targets' classes and places in them, and the bounds of the classes.
    """
    classes = target // PER_CLASS
    order = np.argsort(classes.astype(np.uint8), kind="stable")
    classes, inside, flat = classes[order], target[order] % PER_CLASS, states[order]
    edge = np.searchsorted(classes, np.arange(CLASSES + 1))
    by_class = flat @ p["class"]
    by_class += p["class_bias"]
    by_word = np.empty((len(flat), PER_CLASS), by_class.dtype)
    for c in np.flatnonzero(edge[1:] > edge[:-1]):
        mine = by_word[edge[c] : edge[c + 1]]
        np.matmul(flat[edge[c] : edge[c + 1]], p["word"][c], out=mine)
        mine += p["word_bias"][c]
    return order, flat, classes, inside, edge, _exponentials(by_class, classes), _exponentials(by_word, inside)


def log_probability(p: Parameters, states: np.ndarray, target: np.ndarray) -> np.ndarray:
    """Natural log of P(class of the word) * P(word in its class) at each state."""
    order, *_, (_, _, of_class), (_, _, of_word) = _softmaxes(p, states, target)
    out = np.empty(len(target), of_word.dtype)
    out[order] = of_class + of_word
    return out


#: Rows of a word that are added side by side with those of others; the rest are summed word by word.
ABREAST = 12


def _sum_by_word(out: np.ndarray, words: np.ndarray, values: np.ndarray) -> None:
    """Put the sums of the rows of `values` by their word into the rows of `out` that the words name."""
    order = np.argsort(words, kind="stable")
    words = words[order]
    edge = np.flatnonzero(np.r_[True, words[1:] != words[:-1]])
    sizes = np.diff(np.append(edge, len(words)))
    often = np.argsort(-sizes, kind="stable")
    edge, sizes = edge[often], sizes[often]
    total = values[order[edge]]
    for k in range(1, min(ABREAST, int(sizes.max(initial=0)))):
        more = int(np.searchsorted(-sizes, -k, "left"))  # so many words have more than k rows
        total[:more] += values[order[edge[:more] + k]]
    ones = np.ones(len(words), values.dtype)
    for i in range(int(np.searchsorted(-sizes, -ABREAST, "left"))):
        total[i] += ones[ABREAST : sizes[i]] @ values[order[edge[i] + ABREAST : edge[i] + sizes[i]]]
    out[words[edge]] = total


def gradients(
    p: Parameters, states: np.ndarray, steps: Steps, target: np.ndarray, live: np.ndarray, into: Parameters | None = None
) -> tuple[Parameters, float]:
    """Gradients of the mean negative log-likelihood of the live tokens of a window, and the sum of their losses.

    They are written over `into` if it is given.
    """
    grads = into or {k: np.empty_like(v) for k, v in p.items()}
    at = np.flatnonzero(live)
    count = max(1, len(at))
    order, flat, classes, inside, edge, of_class, of_word = _softmaxes(p, states.reshape(-1, HIDDEN)[at], target.ravel()[at])
    loss = -float(of_class[2].sum() + of_word[2].sum())
    rows, ones = np.arange(len(at)), np.ones(len(at), flat.dtype)
    (by_class, total, _), (by_word, size, _) = of_class, of_word
    for wrong, whole, place in ((by_class, total, classes), (by_word, size, inside)):
        wrong *= (1 / (whole * count))[:, None]
        wrong[rows, place] -= 1 / count
    np.matmul(flat.T, by_class, out=grads["class"])
    np.matmul(ones, by_class, out=grads["class_bias"])
    back = by_class @ p["class"].T
    for c in range(CLASSES):
        mine = slice(edge[c], edge[c + 1])
        np.matmul(flat[mine].T, by_word[mine], out=grads["word"][c])
        np.matmul(ones[mine], by_word[mine], out=grads["word_bias"][c])
        back[mine] += by_word[mine] @ p["word"][c].T
    outer = np.zeros(states.shape, back.dtype)
    outer.reshape(-1, HIDDEN)[at[order]] = back
    outer = _turned(outer)

    size, _, lanes = outer.shape
    reset, update, fresh = steps.gates[:, :HIDDEN], steps.gates[:, HIDDEN:], steps.fresh
    to_fresh = (1 - update) * (1 - fresh * fresh)
    shares = np.empty((size, 3, HIDDEN, lanes), outer.dtype)  # of the state's gradient, for reset, update and what is repeated
    np.multiply(to_fresh, reset, out=shares[:, 2])
    np.multiply(shares[:, 2], steps.again * (1 - reset), out=shares[:, 0])
    np.multiply(steps.before - fresh, update * (1 - update), out=shares[:, 1])
    carried, part = np.zeros((HIDDEN, lanes), outer.dtype), np.empty((HIDDEN, lanes), outer.dtype)
    for t in reversed(range(size)):
        d, turned = outer[t], shares[t]
        d += carried
        turned *= d
        np.matmul(p["again"], turned.reshape(3 * HIDDEN, lanes), out=carried)
        np.multiply(d, update[t], out=part)
        carried += part
        if steps.first is not None:
            carried *= ~steps.first[t]
    d_again = shares.reshape(size, 3 * HIDDEN, lanes)
    np.matmul(steps.before, d_again.transpose(0, 2, 1)).sum(0, out=grads["again"])
    np.multiply(outer, to_fresh, out=shares[:, 2])
    grads["input"][:] = 0
    _sum_by_word(grads["input"], steps.words.ravel(), _turned(d_again).reshape(-1, 3 * HIDDEN))
    return grads, loss


class Lanes:
    """Texts dealt out to at most `most` lanes, the longest first, each lane in an order of its own.

    A lane is as long as the longest text, so that none goes on alone when all others are through, and as LEAST_WINDOWS.
    """

    def __init__(self, words: np.ndarray, places: np.ndarray, most: int):
        sizes = np.diff(places)
        whole = np.flatnonzero(sizes)
        longest = max(int(sizes.max(initial=1)), LEAST_WINDOWS * WINDOW)
        dealt = [(0, i, []) for i in range(min(most, len(whole), -(-int(sizes.sum()) // longest)))]
        for i in whole[np.argsort(-sizes[whole], kind="stable")].tolist():
            size, at, mine = dealt[0]
            mine.append(i)
            heapq.heapreplace(dealt, (size + int(sizes[i]), at, mine))
        draw = np.random.RandomState(len(whole))
        dealt.sort(key=lambda x: (-x[0], x[1]))
        self.words, self.sizes = words, np.array([x[0] for x in dealt], np.int64)
        self.spot = np.zeros((len(dealt), int(self.sizes.max(initial=0))), np.int64)
        self.first = np.zeros(self.spot.shape, bool)
        for (size, _, mine), spot, first in zip(dealt, self.spot, self.first, strict=True):
            mine = np.array(mine)[draw.permutation(len(mine))]
            spot[:size] = np.concatenate([np.arange(places[i], places[i + 1]) for i in mine])
            first[np.cumsum(sizes[mine]) - sizes[mine]] = True

    def windows(self):
        """Of each window, steps x lanes: previous words, words, places of the words, where texts begin and which steps exist."""
        for t in range(0, self.spot.shape[1], WINDOW):
            active = int((self.sizes > t).sum())
            spot, first = (np.ascontiguousarray(x[:active, t : t + WINDOW].T) for x in (self.spot, self.first))
            live = np.arange(t, t + len(spot))[:, None] < self.sizes[:active]
            before = self.words[spot - 1]
            before[first] = 0
            yield before, self.words[spot], spot, first, live


def train(p: Parameters, texts: list[np.ndarray], rate: float = RATE) -> tuple[Parameters, int, float]:
    """One pass over the texts: new parameters, tokens seen, loss. All texts take part, whole, with their state carried on."""
    now = flatten(p).astype(np.float32)
    p = _views(now)
    slope, momentum, square = np.zeros_like(now), np.zeros_like(now), np.zeros_like(now)
    into = _views(slope)
    lanes = Lanes(np.concatenate([np.zeros(0, np.uint16), *texts]), np.cumsum([0, *map(len, texts)]), BATCH)
    state, step, total = np.zeros((len(lanes.sizes), HIDDEN), np.float32), 0, 0.0
    for before, goal, _, first, live in lanes.windows():
        states, state, steps = forward(p, before, state[: len(first[0])], True, first)
        _, loss = gradients(p, states, steps, goal, live, into)
        step, total = step + 1, total + loss
        clip = min(1.0, 5 / (float(np.sqrt(slope @ slope)) + 1e-9))
        slope *= 0.1 * clip
        momentum *= 0.9
        momentum += slope
        square *= 0.99
        slope *= slope  # 0.1 squared is the 0.01 of the mean square
        square += slope
        np.sqrt(square, out=slope)
        slope *= (1 - 0.99**step) ** -0.5
        slope += 1e-6
        np.divide(momentum, slope, out=slope)
        slope *= rate / (1 - 0.9**step)
        now -= slope
    return {k: v.copy() for k, v in p.items()}, int(lanes.sizes.sum()), total


def score(p: Parameters, words: np.ndarray, places: np.ndarray, most: int = 256) -> np.ndarray:
    """Natural log-likelihood of each whole text."""
    lanes = Lanes(words, places, most)
    found = np.zeros(len(words), np.float32)
    state = np.zeros((len(lanes.sizes), HIDDEN), np.float32)
    for before, target, spot, first, live in lanes.windows():
        states, state, _ = forward(p, before, state[: len(first[0])], False, first)
        if live.all():
            found[spot.ravel()] = log_probability(p, states.reshape(-1, HIDDEN), target.ravel())
        else:
            found[spot[live]] = log_probability(p, states[live], target[live])
    sizes = np.diff(places)
    return np.bincount(np.repeat(np.arange(len(sizes)), sizes), found, minlength=len(sizes))
