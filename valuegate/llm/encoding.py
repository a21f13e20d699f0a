"""Whole texts to token ids: the tokenizers library encodes each distinct pre-token, numpy puts the documents together."""

from __future__ import annotations

import functools
import re
from collections.abc import Iterator

import numpy as np

from valuegate.llm.pretokens import Pretokens, pieces, supported, unknown
from valuegate.llm.textvec import prefix_sums, span_hash

#: Distinct pre-tokens that a worker remembers; beyond it the memory starts anew, so its size is bounded.
REMEMBERED = 500_000
_SPREAD = np.uint64(0x9E3779B97F4A7C15)


class Encoder:
    def __init__(self, path: str, remembered: int = REMEMBERED) -> None:
        from tokenizers import Tokenizer

        self.library = Tokenizer.from_file(path)
        self.limit = remembered
        self.fast = supported(path)
        added = [t.content for t in self.library.get_added_tokens_decoder().values()]
        self.special = re.compile("|".join(map(re.escape, added)) or r"(?!)")
        suffix = self.library.model.end_of_word_suffix or ""
        vocab = self.library.get_vocab()
        self.closes = np.zeros(max(vocab.values()) + 1, bool)
        self.closes[[i for t, i in vocab.items() if suffix and t.endswith(suffix)]] = True
        self._forget()

    def _forget(self) -> None:
        self.keys = np.zeros(0, np.uint64)
        self.first = np.zeros(1, np.int64)  # of each known pre-token's ids, and the end of all
        self.size = np.zeros(0, np.int64)
        self.ids = np.zeros(0, np.int32)

    def _learn(self, words: list[str], keys: np.ndarray) -> None:
        """Encode pre-tokens not met before; spaces keep them apart, and each ends with a word-closing token."""
        lines = [" ".join(words[i : i + 1000]) for i in range(0, len(words), 1000)]
        ids = np.concatenate([np.array(e.ids, np.int32) for e in self.library.encode_batch_fast(lines, add_special_tokens=False)])
        ends = np.flatnonzero(self.closes[ids]) + 1
        if len(ends) != len(words) or ends[-1] != len(ids):
            raise ValueError("the vocabulary does not close every pre-token with one token")
        starts = np.concatenate(([0], ends[:-1])) + len(self.ids)
        if len(self.keys) + len(keys) > self.limit and len(self.keys):
            self._forget()
            return self._learn(words, keys)
        self.ids = np.concatenate((self.ids, ids))
        at = np.searchsorted(self.keys, keys)
        self.keys = np.insert(self.keys, at, keys)
        self.first = np.insert(self.first[: len(self.keys) - len(keys)], at, starts)
        self.size = np.insert(self.size, at, np.diff(np.concatenate(([0], ends))))
        return None

    def _find(self, keys: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        at = np.minimum(np.searchsorted(self.keys, keys), max(len(self.keys) - 1, 0))
        return at, (self.keys[at] == keys) if len(self.keys) else np.zeros(len(keys), bool)

    def _encode_plain(self, texts: list[str]) -> Iterator[tuple[list[int], np.ndarray, np.ndarray]]:
        """For batches of pieces: their texts' indices, all ids, and the number of ids of each piece."""
        for owners, parts in pieces(texts):
            pre = Pretokens(parts)
            hashes = span_hash(prefix_sums((pre.points.astype(np.uint64) + np.uint64(1)) * _SPREAD), pre.starts, pre.ends)
            distinct, example, where = np.unique(hashes, return_index=True, return_inverse=True)
            at, known = self._find(distinct)
            if not known.all():
                new = np.flatnonzero(~known)
                before = len(self.keys)
                s, e = pre.starts[example[new]].tolist(), pre.ends[example[new]].tolist()
                self._learn([pre.joined[a:b] for a, b in zip(s, e, strict=True)], distinct[new])
                if len(self.keys) != before + len(new):  # the memory was emptied
                    _, known = self._find(distinct)
                    new = np.flatnonzero(~known)
                    s, e = pre.starts[example[new]].tolist(), pre.ends[example[new]].tolist()
                    if len(new):
                        self._learn([pre.joined[a:b] for a, b in zip(s, e, strict=True)], distinct[new])
                at, _ = self._find(distinct)
            if not len(where):
                yield owners, np.zeros(0, np.int32), np.zeros(len(parts), np.int64)
                continue
            size = self.size[at][where]
            total = np.cumsum(size)
            take = np.repeat(self.first[at][where] - (total - size), size) + np.arange(total[-1])
            per_piece = np.bincount(pre.text_of, weights=size, minlength=len(parts)).astype(np.int64)
            yield owners, self.ids[take], per_piece

    def encode(self, texts: list[str | None]) -> Iterator[tuple[int, np.ndarray]]:
        """(index, ids) of every text in order, as the library encodes the whole text without special tokens added.

        A null text is empty. Texts that hold an added token's own string, or a character that Python's tables do not
        know, go to the library as they are.
        """
        texts = [t or "" for t in texts]
        whole = [not self.fast or self.special.search(t) is not None or unknown(t) for t in texts]
        plain = [i for i, w in enumerate(whole) if not w]
        done = self._joined(plain, self._encode_plain([texts[i] for i in plain]))
        for i, text in enumerate(texts):
            if whole[i]:
                yield i, np.array(self.library.encode(text, add_special_tokens=False).ids, np.int32)
            else:
                yield i, next(done)[1]

    @staticmethod
    def _joined(index: list[int], made: Iterator[tuple[list[int], np.ndarray, np.ndarray]]) -> Iterator[tuple[int, np.ndarray]]:
        """Puts the pieces of each text together."""
        held: list[np.ndarray] = []
        current = 0
        for owners, ids, sizes in made:
            ends = np.cumsum(sizes)
            for owner, end, size in zip(owners, ends.tolist(), sizes.tolist(), strict=True):
                if owner != current:
                    yield index[current], np.concatenate(held)
                    held, current = [], owner
                held.append(ids[end - size : end])
        if held:
            yield index[current], np.concatenate(held)


@functools.lru_cache(2)
def encoder(path: str) -> Encoder:
    """One encoder a worker process and vocabulary."""
    import os

    os.environ["TOKENIZERS_PARALLELISM"] = "false"  # Spark runs the tasks side by side
    return Encoder(path)
