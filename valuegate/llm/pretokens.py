"""Cutting of whole texts into the pre-tokens of a lower-casing word BPE vocabulary, by numpy over batches of texts.

The rule of the vocabulary file (see ``supported``): NFC, white space collapsed, lower case per character; then English
contractions, runs of letters, single digits and runs of other signs are the units that byte-pair merging never crosses.
"""

from __future__ import annotations

import functools
import json
import sys
import unicodedata
from collections.abc import Iterator

import numpy as np

from valuegate.llm.textvec import BATCH_CHARS

SPACE, LETTER, DIGIT, OTHER = 0, 1, 2, 3
#: The split pattern that this module reproduces.
PATTERN = r"'s|'t|'re|'ve|'m|'ll|'d|[\p{L}]+|[\p{N}]|[^\s\p{L}\p{N}]+"
CONTRACTIONS = ("s", "t", "re", "ve", "m", "ll", "d")
#: Code points with Unicode's White_Space property.
WHITE = [*range(0x09, 0x0E), 0x20, 0x85, 0xA0, 0x1680, *range(0x2000, 0x200B), 0x2028, 0x2029, 0x202F, 0x205F, 0x3000]


@functools.cache
def _classes() -> np.ndarray:
    kinds = {"L": LETTER, "N": DIGIT}
    out = np.fromiter((kinds.get(unicodedata.category(chr(c))[0], OTHER) for c in range(sys.maxunicode + 1)), np.uint8, sys.maxunicode + 1)
    out[WHITE] = SPACE
    return out


@functools.cache
def _unassigned() -> np.ndarray:
    """Code points that this Python's Unicode tables do not know, while the library's newer ones may call them letters."""
    return np.fromiter((unicodedata.category(chr(c)) == "Cn" for c in range(sys.maxunicode + 1)), bool, sys.maxunicode + 1)


def unknown(text: str) -> bool:
    """Whether the text holds a character whose class only the library can tell."""
    return not text.isascii() and bool(_unassigned()[np.frombuffer(text.encode("utf-32-le"), np.uint32)].any())


def supported(path: str) -> bool:
    """Whether the vocabulary file states the rule that this module reproduces."""
    with open(path, encoding="utf-8") as f:
        spec = json.load(f)
    kinds = [n["type"] for n in (spec.get("normalizer") or {}).get("normalizers", ())]
    cuts = (spec.get("pre_tokenizer") or {}).get("pretokenizers", [{}])
    model = spec["model"]
    return (
        kinds == ["NFC", "Replace", "Lowercase"]
        and cuts[0].get("pattern") == {"Regex": PATTERN}
        and cuts[0].get("invert") is True
        and model["type"] == "BPE"
        and bool(model.get("end_of_word_suffix"))
        and not model.get("dropout")
        and not model.get("ignore_merges")
    )


def normalised(text: str) -> str:
    """NFC and lower case character by character, so that a final sigma gets no form of its own."""
    if text.isascii():
        return text.lower()
    return unicodedata.normalize("NFC", text).replace("Σ", "σ").lower()


def pieces(texts: list[str], limit: int = BATCH_CHARS) -> Iterator[tuple[list[int], list[str]]]:
    """Batches of (index of text, piece). A text over ``limit`` is cut before white space, which no pre-token crosses."""
    owners: list[int] = []
    parts: list[str] = []
    held = 0
    for i, text in enumerate(texts):
        at = 0
        while True:
            end = len(text)
            if end - at > limit:
                end = at + limit
                while end < len(text) and ord(text[end]) not in _WHITE_SET:
                    end += 1
            if held and held + end - at > limit:
                yield owners, parts
                owners, parts, held = [], [], 0
            owners.append(i)
            parts.append(text[at:end])
            held += end - at + 1
            at = end
            if at >= len(text):
                break
    if owners:
        yield owners, parts


_WHITE_SET = frozenset(WHITE)


class Pretokens:
    """``starts``/``ends`` of the pre-tokens in ``points``, the code points of the normalised texts joined by newlines; ``text_of`` has each one's text."""

    def __init__(self, texts: list[str]) -> None:
        normal = [normalised(t) for t in texts]
        self.joined = "\n".join(normal)
        self.points = np.frombuffer(self.joined.encode("utf-32-le"), np.uint32)
        kinds = _classes()[self.points]
        begins = np.empty(len(kinds), bool)
        if len(kinds):
            begins[0] = True
            np.not_equal(kinds[1:], kinds[:-1], out=begins[1:])
            begins |= kinds == DIGIT
            self._contract(kinds, begins)
            begins &= kinds != SPACE
        # A unit ends where the next one or white space begins.
        self.starts = np.flatnonzero(begins)
        stops = np.flatnonzero(begins | (kinds == SPACE))
        after = np.searchsorted(stops, self.starts, side="right")
        self.ends = np.append(stops, len(kinds))[after]
        offsets = np.cumsum([0] + [len(t) + 1 for t in normal])
        self.text_of = np.searchsorted(offsets, self.starts, side="right") - 1

    def _contract(self, kinds: np.ndarray, begins: np.ndarray) -> None:
        """An apostrophe that is a run of its own takes the letters of a contraction; the letters after them start anew."""
        points, n = self.points, len(kinds)
        mark = np.flatnonzero((points[:-1] == ord("'")) & begins[:-1] & (kinds[1:] == LETTER))
        for form in CONTRACTIONS:
            size = len(form)
            here = mark[mark + size < n]
            hit = np.ones(len(here), bool)
            for k, letter in enumerate(form, 1):
                hit &= points[here + k] == ord(letter)
            here = here[hit]
            begins[here + 1] = False
            after = here + 1 + size
            after = after[after < n]
            begins[after] = True  # white space is cleared by the caller
            mark = np.setdiff1d(mark, here, assume_unique=True)
