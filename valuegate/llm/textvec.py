"""Vectorised text helpers: words and their hashes by numpy over whole batches of texts, without a Python loop over words."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np

#: Characters worked on at a time inside a task. Longer texts are cut at white space by the callers that can.
BATCH_CHARS = 400_000

_ODD = np.uint64(0x9E3779B97F4A7C15)
_BASE = 0xD1342543DE82EF95
_INVERSE = pow(_BASE, -1, 1 << 64)


def mix(x: np.ndarray) -> np.ndarray:
    """A bijective 64-bit mixer (splitmix64's finaliser)."""
    x = x.astype(np.uint64, copy=True)
    x ^= x >> np.uint64(30)
    x *= np.uint64(0xBF58476D1CE4E5B9)
    x ^= x >> np.uint64(27)
    x *= np.uint64(0x94D049BB133111EB)
    x ^= x >> np.uint64(31)
    return x


class _Powers:
    """Powers of the hash's base and of its inverse modulo 2**64, grown as needed."""

    def __init__(self) -> None:
        self.up = self.down = np.ones(1, np.uint64)

    def get(self, n: int) -> tuple[np.ndarray, np.ndarray]:
        if len(self.up) < n:
            size = max(n, 2 * len(self.up))
            with np.errstate(over="ignore"):
                for name, base in (("up", _BASE), ("down", _INVERSE)):
                    steps = np.full(size, base, np.uint64)
                    steps[0] = 1
                    setattr(self, name, np.multiply.accumulate(steps))
        return self.up[:n], self.down[:n]


_powers = _Powers()
_BYTE = mix(np.arange(1, 257, dtype=np.uint64) * _ODD)


def prefix_sums(values: np.ndarray) -> np.ndarray:
    """Polynomial prefix sums; ``span_hash`` gives from them the hash of any span of ``values``."""
    up, _ = _powers.get(len(values) + 1)
    out = np.zeros(len(values) + 1, np.uint64)
    np.cumsum(values * up[: len(values)], out=out[1:])
    return out


def span_hash(sums: np.ndarray, start: np.ndarray, end: np.ndarray) -> np.ndarray:
    """Hashes of the spans [start, end) that depend on their content alone."""
    _, down = _powers.get(len(sums))
    return mix((sums[end] - sums[start]) * down[start] + (end - start).astype(np.uint64) * _ODD)


def word_spans(is_word: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Starts and ends of the maximal runs of true."""
    edge = np.diff(np.concatenate(([0], is_word.view(np.int8), [0])))
    return np.flatnonzero(edge == 1), np.flatnonzero(edge == -1)


#: Separators of plain words: space and the controls from tab to carriage return.
_WHITE = np.zeros(256, bool)
_WHITE[[0x20, *range(0x09, 0x0E)]] = True
#: Separators of folded words: every ASCII character but letters and digits.
_FOLD_BREAK = np.zeros(256, bool)
_FOLD_BREAK[:128] = [not chr(b).isalnum() for b in range(128)]


class Words:
    """The words of a batch of texts: ``starts``/``ends`` in the joined bytes, ``hashes``, and ``bounds[i]:bounds[i+1]`` of text i.

    Plain words are runs of anything but space, tab, newline, vertical tab, form feed and carriage return, unchanged.
    Folded words are runs of lower-cased ASCII letters, digits and non-ASCII characters. A null text is empty.
    """

    def __init__(self, texts: list[str | None], folded: bool = False) -> None:
        raw = [(t.replace("İ", "i").lower() if folded else t).encode() if t else b"" for t in texts]  # folding keeps the number of characters
        self.bytes = np.frombuffer(b"\n".join(raw) + b"\n", np.uint8)
        self.starts, self.ends = word_spans(~(_FOLD_BREAK if folded else _WHITE)[self.bytes])
        self.sums = prefix_sums(_BYTE[self.bytes])
        self.hashes = span_hash(self.sums, self.starts, self.ends)
        offsets = np.concatenate(([0], np.cumsum([len(r) + 1 for r in raw])))
        self.bounds = np.searchsorted(self.starts, offsets)


def batches(texts: list[str | None], limit: int = BATCH_CHARS) -> Iterator[tuple[int, int]]:
    """Ranges of texts with about ``limit`` characters each; one longer text makes a range of its own."""
    first, held = 0, 0
    for i, t in enumerate(texts):
        n = len(t) if t else 0
        if held and held + n > limit:
            yield first, i
            first, held = i, 0
        held += n + 1
    if first < len(texts):
        yield first, len(texts)


def grams(hashes: np.ndarray, bounds: np.ndarray, n: int) -> tuple[np.ndarray, np.ndarray]:
    """Hashes of the n-word windows of all texts, and the bounds of each text's windows.

    A text of 1 to n-1 words has one window, of all its words; a text without words has none.
    """
    counts = np.diff(bounds)
    made = np.where(counts >= n, counts - n + 1, np.minimum(counts, 1))
    out = np.concatenate(([0], np.cumsum(made)))
    text = np.repeat(np.arange(len(counts)), made)
    start = bounds[:-1][text] + np.arange(out[-1]) - out[:-1][text]
    end = np.minimum(start + n, bounds[1:][text])
    return span_hash(prefix_sums(hashes), start, end), out
