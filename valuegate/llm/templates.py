"""Texts as templates: numbers, names and units become typed placeholders, and what stood there is kept as slot values."""

from __future__ import annotations

import numpy as np

from valuegate.llm.textvec import Words, mix, prefix_sums, span_hash

#: Words that are units when a number stands before them.
UNITS = (
    "mm cm m km in inch inches ft foot feet yd yard yards mile miles mg g kg gram grams kilogram kilograms oz ounce ounces lb lbs pound pounds ton tons "
    "ml cl l liter liters litre litres gallon gallons s sec second seconds min minute minutes h hr hour hours day days week weeks month months year years "
    "mph kmh hz khz mhz ghz w kw v volt volts amp amps j kj cal kcal degree degrees percent cent cents dollar dollars euro euros usd eur gbp kb mb gb tb"
).split()
NUMBER, NAME, UNIT = 1, 2, 3
_MARK = mix(np.arange(4, dtype=np.uint64) + np.uint64(0xABCDEF))
_DIGIT = np.zeros(256, bool)
_DIGIT[48:58] = True
_STOP = np.zeros(256, bool)
_STOP[[ord(c) for c in ".!?:;\n\r"]] = True


class Templates:
    """Template tokens of a batch of texts.

    ``tokens`` are hashes, a placeholder's is that of its type; ``kinds`` are 0 for plain words; ``values`` hash what a
    placeholder stands for, 0 for plain words; ``bounds[i]:bounds[i+1]`` are the tokens of text i; ``words`` has the place of
    each token's first word within its text.

    A number is a run of words that begin with a digit; a unit is a unit word after a number; a name is a run of
    capitalised words that do not begin a sentence. Everything else is its folded word. Without ``names`` the case of
    the texts makes no difference: names are words like others. ``words`` may be handed over if they are known.
    """

    def __init__(self, texts: list[str | None], names: bool = True, words: Words | None = None) -> None:
        words = words or Words(texts, folded=True)
        n = len(words.starts)
        kinds = np.zeros(n, np.int64)
        unit_hashes = Words([" ".join(UNITS)], folded=True).hashes
        text = np.repeat(np.arange(len(texts)), np.diff(words.bounds))
        first = np.ones(n, bool)
        first[1:] = text[1:] != text[:-1]
        kinds[_DIGIT[words.bytes[words.starts]]] = NUMBER
        if names:
            # Folding keeps the number of characters but not of bytes, so capitals and stops are looked up by character.
            raw = np.frombuffer(("\n".join((t or "").replace("İ", "I") for t in texts) + "\n").encode("utf-32-le"), np.uint32)
            folded = np.frombuffer(words.bytes.tobytes().decode().encode("utf-32-le"), np.uint32)
            place = np.cumsum((words.bytes & 0xC0) != 0x80) - 1
            starts, ends = place[words.starts], place[words.ends]
            stops = np.concatenate(([0], np.cumsum(_STOP[np.minimum(raw, 255)])))
            before = np.concatenate(([0], ends[:-1]))
            opens = first | (stops[starts] > stops[before])
            kinds[(raw[starts] != folded[starts]) & ~opens] = NAME
        after = np.zeros(n, bool)
        after[1:] = (kinds[:-1] == NUMBER) & ~first[1:]
        kinds[after & (kinds == 0) & np.isin(words.hashes, unit_hashes)] = UNIT
        # Runs of one placeholder are one token.
        lead = np.ones(n, bool)
        lead[1:] = (kinds[1:] == 0) | (kinds[1:] != kinds[:-1]) | first[1:]
        at = np.flatnonzero(lead)
        ends = np.append(at[1:], n)
        self.kinds = kinds[at]
        self.tokens = np.where(self.kinds > 0, _MARK[self.kinds], words.hashes[at])
        self.values = np.where(self.kinds > 0, span_hash(prefix_sums(words.hashes), at, ends), 0)
        self.bounds = np.searchsorted(at, words.bounds)
        self.words = at - words.bounds[:-1][text[at]] if n else at
        self.text = text[at] if n else at


def windows(t: Templates, size: int) -> tuple[np.ndarray, np.ndarray]:
    """First tokens and hashes of the windows of ``size`` tokens that lie within a text."""
    n = len(t.tokens)
    start = np.arange(max(0, n - size + 1))
    start = start[t.text[start] == t.text[start + size - 1]] if len(start) else start
    return start, mix(span_hash(prefix_sums(t.tokens), start, start + size) + mix(np.full(1, size, np.uint64)))


