"""A linear-chain conditional random field with two states (plain 0, marked 1) in numpy.

State 1 has an emission score, the sum of its features' weights; state 0 scores nothing. The chain runs through a whole
text. To work on many words at a time it is cut into segments: each segment's two-by-two transfer matrix is made side by
side with all others, the matrices are multiplied along the text, and forward-backward then runs inside all segments with
the messages that come in from both sides, so the cuts change nothing.
"""

from __future__ import annotations

import numpy as np

SEGMENT = 64


class Segments:
    """Where the words of a batch of texts lie: segment by segment, a step handling all segments' words of one position."""

    def __init__(self, bounds: np.ndarray, size: int = SEGMENT) -> None:
        counts = np.diff(bounds)
        parts = -(-counts // size)
        text = np.repeat(np.arange(len(counts)), parts)
        number = np.arange(len(text)) - np.repeat(np.cumsum(parts) - parts, parts)
        start = bounds[:-1][text] + number * size
        length = np.minimum(size, bounds[1:][text] - start)
        steps = np.arange(int(length.max(initial=0)))[:, None]
        self.inside = steps < length
        self.at = np.where(self.inside, start + steps, 0)
        self.first = number == 0
        #: Segments by their number within the text: those of one number are multiplied side by side.
        self.rounds = [np.flatnonzero(number == k) for k in range(int(number.max(initial=-1)) + 1)]


def _times(pairs: np.ndarray, matrix: np.ndarray, psi: np.ndarray) -> np.ndarray:
    """Row vectors (2, n) through one word: the transition, then the emission of state 1."""
    return np.stack([pairs[0] * matrix[0, 0] + pairs[1] * matrix[1, 0], (pairs[0] * matrix[0, 1] + pairs[1] * matrix[1, 1]) * psi])


def _messages(psi: np.ndarray, s: Segments, begin: np.ndarray, matrix: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """What comes into each segment from its left and from its right, each up to a factor."""
    n = len(s.first)
    left, right = np.ones((2, n)), np.ones((2, n))
    if len(s.rounds) < 2:
        left[:] = begin[:, None]
        return left, right
    rows, scale = np.zeros((2, 2, n)), np.zeros((2, n))
    rows[0, 0], rows[1, 1] = 1.0, 1.0
    for t in range(len(psi)):
        for e in (0, 1):
            new = _times(rows[e], matrix, psi[t])
            total = new.sum(axis=0)
            here = s.inside[t]
            rows[e] = np.where(here, new / total, rows[e])
            scale[e] += np.where(here, np.log(total), 0.0)
    scale -= scale.max(axis=0)
    rows *= np.exp(scale)[:, None]
    # A text's first word has the begin scores for its transition, so its first segment's matrix is not used from the left.
    head = s.rounds[0]
    left[:, head] = begin[:, None]
    start = np.zeros((2, n))
    here = s.inside[0] & s.first
    row = np.stack([np.full(n, begin[0]), begin[1] * psi[0]])
    for t in range(1, len(psi)):
        new = _times(row, matrix, psi[t])
        row = np.where(s.inside[t], new / new.sum(axis=0), row)
    start[:, here] = row[:, here]
    out = start
    for k in s.rounds[1:]:
        left[:, k] = out[:, k - 1] / out[:, k - 1].sum(axis=0)
        out[:, k] = rows[0][:, k] * left[0, k] + rows[1][:, k] * left[1, k]
    for k in reversed(s.rounds[1:]):
        back = np.stack([rows[0, 0, k] * right[0, k] + rows[0, 1, k] * right[1, k], rows[1, 0, k] * right[0, k] + rows[1, 1, k] * right[1, k]])
        right[:, k - 1] = back / back.sum(axis=0)
    return left, right


def marginals(emission: np.ndarray, s: Segments, initial: float, transition: np.ndarray, counts: bool = False) -> tuple[np.ndarray, np.ndarray]:
    """Probability of state 1 at each word of ``s``, (position, segment), and if asked the expected counts of the four transitions."""
    steps, n = s.inside.shape
    out, expected = np.zeros((steps, n)), np.zeros((2, 2))
    if not n:
        return out, expected
    psi = np.exp(np.clip(np.where(s.inside, emission[s.at], 0.0), -30, 30))
    m, begin = np.exp(transition), np.array([1.0, np.exp(initial)])
    left, right = _messages(psi, s, begin, m)
    forward = np.zeros((steps, 2, n))
    a = np.where(s.first, np.stack([left[0], left[1] * psi[0]]), _times(left, m, psi[0]))
    forward[0] = a / a.sum(axis=0)
    for t in range(1, steps):
        a = _times(forward[t - 1], m, psi[t])
        forward[t] = a / a.sum(axis=0)
    b = right
    for t in range(steps - 1, -1, -1):
        here = s.inside[t]
        f = forward[t] * b
        out[t] = np.where(here, f[1] / f.sum(axis=0), 0)
        c1 = psi[t] * b[1]
        if counts:
            before, linked = (forward[t - 1], here) if t else (left, here & ~s.first)
            parts = np.array([before[0] * m[0, 0] * b[0], before[0] * m[0, 1] * c1, before[1] * m[1, 0] * b[0], before[1] * m[1, 1] * c1])
            expected += (parts / parts.sum(axis=0) * linked).sum(axis=1).reshape(2, 2)
        back = np.stack([m[0, 0] * b[0] + m[0, 1] * c1, m[1, 0] * b[0] + m[1, 1] * c1])
        b = np.where(here, back / back.sum(axis=0), b)
    return out, expected


def fit(features: np.ndarray, labels: np.ndarray, bounds: np.ndarray, n_features: int, rounds: int = 60, rate: float = 0.3, penalty: float = 1e-3) -> tuple[np.ndarray, float, np.ndarray]:
    """Weights, initial score and transitions that maximise the conditional likelihood of the labelled words (Adam).

    ``features`` is (word, slot) with -1 for none; ``labels`` 0 or 1 a word; ``bounds`` as the texts' word bounds.
    """
    s = Segments(bounds)
    # In the texts' order, the word before each word that is not the first of its text.
    follows = np.ones(len(labels), bool)
    follows[bounds[:-1][np.diff(bounds) > 0]] = False
    after = np.flatnonzero(follows)
    pairs = np.bincount(2 * labels[after - 1] + labels[after], minlength=4).reshape(2, 2)
    heads = labels[~follows]
    # weights, bias, initial, transitions
    x = np.zeros(n_features + 1 + 1 + 4)
    x[n_features] = -2.0
    first, second = np.zeros_like(x), np.zeros_like(x)
    used = features >= 0
    which, word = features[used], np.nonzero(used)[0].astype(np.int32)
    total = max(1, len(labels))
    prob = np.zeros(len(labels))
    for k in range(1, rounds + 1):
        score = np.bincount(word, weights=x[which], minlength=len(labels)) + x[n_features]
        found, expected = marginals(score, s, x[n_features + 1], x[n_features + 2 :].reshape(2, 2), counts=True)
        prob[s.at[s.inside]] = found[s.inside]
        gap = labels - prob
        grad = np.zeros_like(x)
        grad[:n_features] = np.bincount(which, weights=gap[word], minlength=n_features)
        grad[n_features] = gap.sum()
        grad[n_features + 1] = (heads - prob[~follows]).sum()
        grad[n_features + 2 :] = (pairs - expected).reshape(-1)
        grad = grad / total * 1000 - penalty * x
        first = 0.9 * first + 0.1 * grad
        second = 0.99 * second + 0.01 * grad * grad
        x += rate * (first / (1 - 0.9**k)) / (np.sqrt(second / (1 - 0.99**k)) + 1e-8)
    return x[: n_features + 1], float(x[n_features + 1]), x[n_features + 2 :].reshape(2, 2)
