"""A byte-pair vocabulary compiled to a deterministic transducer whose transitions carry emitted-token counts.

Reading a pre-token byte by byte, the encoding of every prefix ends in one definite token, and a token may follow another
only if merging their symbols gives back just those two. A state therefore needs, for each suffix of what was read that
some token begins with, the last token before that suffix and how many tokens fewer stand there. A transition's output
is the change of the token count. States are made when first met (subset construction on demand) and kept in one table.
The byte that ends a pre-token is a symbol of its own and leads back to the start state.
"""

from __future__ import annotations

import functools
import json

import numpy as np

from valuegate.llm.pretokens import Pretokens

#: Symbols: byte b inside a pre-token is b, as its last byte 256 + b.
LAST = 256
SPAN = 512
MAX_STATES = 150_000


def _byte_names() -> list[str]:
    """The printable character that byte-level vocabularies write for each byte."""
    plain = [b for b in range(256) if 33 <= b <= 126 or 161 <= b <= 172 or 174 <= b]
    names = dict(zip(plain, map(chr, plain), strict=True))
    for n, b in enumerate(b for b in range(256) if b not in names):
        names[b] = chr(256 + n)
    return [names[b] for b in range(256)]


class Transducer:
    def __init__(self, path: str, max_states: int = MAX_STATES) -> None:
        with open(path, encoding="utf-8") as f:
            model = json.load(f)["model"]
        vocab, suffix = model["vocab"], model["end_of_word_suffix"]
        names = _byte_names()
        # Tokens are renumbered by rank: the 512 symbols first, then one per merge.
        number = {name: b for b, name in enumerate(names)} | {name + suffix: LAST + b for b, name in enumerate(names)}
        self.left, self.right = list(range(SPAN)), list(range(SPAN))
        self.text: list[tuple[int, ...]] = [(s,) for s in range(SPAN)]
        self.merged: dict[tuple[int, int], int] = {}
        for pair in model["merges"]:
            a, b = pair if isinstance(pair, list) else pair.split(" ")
            pair_ids = number[a], number[b]
            self.merged[pair_ids] = number[a + b] = len(self.text)
            self.left.append(pair_ids[0])
            self.right.append(pair_ids[1])
            self.text.append(self.text[pair_ids[0]] + self.text[pair_ids[1]])
        assert all(n in vocab for n in number), "the vocabulary lacks symbols of its own merges"
        self.token = {t: i for i, t in enumerate(self.text)}
        self.begins = {t[:k] for t in self.text for k in range(1, len(t))}
        self.max_states = max_states
        self.follows = functools.lru_cache(1 << 20)(self._follows)
        self.reset()

    def reset(self) -> None:
        self.columns = np.full(SPAN, -1, np.int64)
        # Column 0 is no symbol: it keeps the start state and changes nothing.
        self.symbols: list[int] = [-1]
        self.table = np.full((1024, 64), -1, np.int32)
        self.table[0, 0] = 128
        self.states = [((), ((0, -1, 0),))]
        self.known = {self.states[0]: 0}

    def _follows(self, a: int, b: int) -> bool:
        """Whether merging the symbols of tokens a and b, lowest rank first, ends with exactly a and b.

        The last merges on both sides of the seam are undone, highest rank first; the pair fails if some merge across
        the seam would have come before the merge that is undone.
        """
        bound = len(self.text)
        while True:
            across = self.merged.get((a, b))
            if across is not None and across < bound:
                return False
            if a < SPAN and b < SPAN:
                return True
            if a > b:  # an equal rank merges from the left, so b is undone first
                bound, a = a, self.right[a]
            else:
                bound, b = b + 1, self.left[b]

    def _step(self, state: int, symbol: int) -> int:
        """The packed transition: next state * 256 + change of count + 128."""
        read, entries = self.states[state]
        for size, last, behind in entries:
            token = self.token.get((*read[len(read) - size :], symbol))
            if token is not None and (last < 0 or self.follows(last, token)):
                break
        else:
            raise ValueError("the vocabulary has no token for a symbol")
        change = behind + 1
        if symbol >= LAST:
            return change + 128
        grown = [(size + 1, last, behind - change) for size, last, behind in entries if (*read[len(read) - size :], symbol) in self.begins]
        longest = grown[0][0] if grown else 0
        made = ((*read, symbol)[len(read) + 1 - longest :], (*grown, (0, token, 0)))
        number = self.known.get(made)
        if number is None:
            number = self.known[made] = len(self.states)
            self.states.append(made)
        return number * 256 + change + 128

    def _columns(self, symbols: np.ndarray) -> np.ndarray:
        new = np.unique(symbols)
        for s in new[self.columns[new] < 0]:
            self.columns[s] = len(self.symbols)
            self.symbols.append(int(s))
        if len(self.symbols) > self.table.shape[1]:
            wider = np.full((self.table.shape[0], min(SPAN, max(2 * self.table.shape[1], len(self.symbols)))), -1, np.int32)
            wider[:, : self.table.shape[1]] = self.table
            self.table = wider
        return self.columns[symbols]

    def advance(self, states: np.ndarray, columns: np.ndarray) -> np.ndarray:
        """Packed transitions of many lanes at once; those not compiled yet are added to the table."""
        width = self.table.shape[1]
        packed = self.table.reshape(-1)[states * width + columns]
        if packed.min(initial=0) < 0:
            todo = np.flatnonzero(packed < 0)
            keys, where = np.unique(states[todo] * SPAN + columns[todo], return_inverse=True)
            found = np.empty(len(keys), np.int32)
            for i, key in enumerate(keys.tolist()):
                state, column = divmod(key, SPAN)
                found[i] = self._step(state, self.symbols[column])
                if len(self.states) > self.table.shape[0]:
                    self.table = np.vstack([self.table, np.full_like(self.table, -1)])
                self.table[state, column] = found[i]
            packed[todo] = found[where]
        return packed

    def changes(self, symbols: np.ndarray, chunk: int = 256) -> np.ndarray:
        """The change of the token count at each symbol of a stream that begins at the start state and ends with a last byte.

        The stream is cut into chunks that run side by side. A chunk with a last-byte symbol has a constant state map,
        known from what follows that symbol; ``_ends`` composes the maps of all chunks, and each chunk's head, up to its
        first last-byte symbol, then runs from the state that the chunks before it lead to.
        """
        if len(self.states) > self.max_states:
            self.reset()
        n = len(symbols)
        if not n:
            return np.zeros(0, np.int8)
        lanes = -(-n // chunk)
        columns = np.zeros(lanes * chunk, np.int64)
        columns[:n] = self._columns(symbols)
        columns = columns.reshape(lanes, chunk).T.copy()
        ends = np.zeros(lanes * chunk, bool)
        ends[:n] = symbols >= LAST
        ends = ends.reshape(lanes, chunk)
        constant = ends.any(axis=1)
        head = np.where(constant, ends.argmax(axis=1) + 1, chunk)
        rest = np.where(np.arange(chunk)[:, None] < head, 0, columns)
        out = np.zeros((chunk, lanes), np.int8)
        final = np.zeros(lanes, np.int64)
        for k in range(chunk):
            packed = self.advance(final, rest[k])
            out[k] = (packed & 255) - 128
            final = (packed >> 8).astype(np.int64)
        state = np.concatenate(([0], self._ends(columns, constant, final)[:-1]))
        for k in range(int(head.max())):
            going = np.flatnonzero(head > k)
            packed = self.advance(state[going], columns[k, going])
            out[k, going] = (packed & 255) - 128
            state[going] = packed >> 8
        return out.T.reshape(-1)[:n]

    def _run(self, columns: np.ndarray, lane: np.ndarray, state: np.ndarray) -> np.ndarray:
        for row in columns:
            state = (self.advance(state, row[lane]) >> 8).astype(np.int64)
        return state

    def _ends(self, columns: np.ndarray, constant: np.ndarray, final: np.ndarray) -> np.ndarray:
        """The state after each chunk, by a parallel prefix scan over the chunks' state maps.

        A chunk inside one long pre-token has no constant map. Its map is made for the entry states that matter: the
        start state, and the state that its predecessor ends in, or would end in if it began at the start state. The
        composed maps double their span in each round. Should a map lack the state that turns up, the chunk runs again.
        """
        open_ = np.flatnonzero(~constant)
        if not len(open_):
            return final
        keys, values = np.zeros((2, len(final), 2), np.int64)
        values[open_, 0] = self._run(columns, open_, np.zeros(len(open_), np.int64))
        before = np.where(constant, final, values[:, 0])
        keys[open_, 1] = np.where(open_ > 0, before[open_ - 1], 0)
        values[open_, 1] = self._run(columns, open_, keys[open_, 1])

        def after(lane: np.ndarray, state: np.ndarray) -> np.ndarray:
            return np.where(state < 0, -1, np.where(keys[lane, 0] == state, values[lane, 0], np.where(keys[lane, 1] == state, values[lane, 1], -1)))

        known, end = constant.copy(), np.where(constant, final, -1)
        if not known[0]:
            known[0], end[0] = True, values[0, 0]
        span = 1
        while not known.all():
            lane = np.flatnonzero(~known)
            low = lane - span
            fixed = known[low]
            found = after(lane[fixed], end[low[fixed]])
            up, down = lane[~fixed], low[~fixed]
            made = np.stack([after(up, values[down, e]) for e in (0, 1)], axis=1)
            keys[up], values[up] = keys[down], made
            end[lane[fixed]], known[lane[fixed]] = found, True
            span *= 2
        while (end < 0).any():
            lane = np.flatnonzero(end < 0)
            lane = lane[end[lane - 1] >= 0]
            end[lane] = self._run(columns, lane, end[lane - 1])
        return end

    def counts(self, pre: Pretokens, n_texts: int) -> np.ndarray:
        """Tokens of each of the texts that ``pre`` was made of."""
        symbols, unit_ends = byte_symbols(pre)
        total = np.concatenate(([0], np.cumsum(self.changes(symbols), dtype=np.int64)))
        per_unit = np.diff(total[np.concatenate(([0], unit_ends))])
        return np.bincount(pre.text_of, weights=per_unit, minlength=n_texts).astype(np.int64)


def byte_symbols(pre: Pretokens) -> tuple[np.ndarray, np.ndarray]:
    """The symbols of all pre-tokens in order, white space left out, and the end of each pre-token among them."""
    raw = np.frombuffer(pre.joined.encode(), np.uint8)
    at = np.concatenate(([0], np.cumsum(1 + (pre.points > 0x7F).view(np.int8) + (pre.points > 0x7FF) + (pre.points > 0xFFFF))))
    starts, ends = at[pre.starts], at[pre.ends]
    inside = np.zeros(len(raw) + 1, np.int8)
    # Units may touch, so openings and closings are summed.
    np.add.at(inside, starts, 1)
    np.add.at(inside, ends, -1)
    keep = np.cumsum(inside[:-1], dtype=np.int8) > 0
    symbols = raw.astype(np.int64)
    symbols[ends - 1] += LAST
    return symbols[keep], np.cumsum(ends - starts)


@functools.lru_cache(2)
def compiled(path: str) -> Transducer:
    """One transducer a worker process and vocabulary; it grows with the batches that the process meets."""
    return Transducer(path)
