"""Suffix automata of token passages with weighted occurrence counts, and matching statistics against them."""

from __future__ import annotations


class SuffixAutomaton:
    """The automaton of several passages of integers; a passage of weight w counts as w occurrences of all that it holds."""

    def __init__(self, passages: list[list[int]], weights: list[int]) -> None:
        follow: list[dict[int, int]] = [{}]
        link, length, count = [-1], [0], [0]
        last = 0
        mark = -1  # separators, each used once, so that no match runs over two passages
        for tokens, weight in zip(passages, weights, strict=True):
            for token in (*tokens, None):
                if token is None:
                    token, weight = mark, 0
                    mark -= 1
                new = len(follow)
                follow.append({})
                length.append(length[last] + 1)
                link.append(0)
                count.append(weight)
                at = last
                while at >= 0 and token not in follow[at]:
                    follow[at][token] = new
                    at = link[at]
                if at >= 0:
                    to = follow[at][token]
                    if length[to] == length[at] + 1:
                        link[new] = to
                    else:
                        copy = len(follow)
                        follow.append(follow[to].copy())
                        length.append(length[at] + 1)
                        link.append(link[to])
                        count.append(0)
                        while at >= 0 and follow[at].get(token) == to:
                            follow[at][token] = copy
                            at = link[at]
                        link[to] = link[new] = copy
                last = new
        for state in sorted(range(1, len(follow)), key=length.__getitem__, reverse=True):
            count[link[state]] += count[state]
        self.follow, self.link, self.length, self.count = follow, link, length, count

    def repeated(self, tokens: list[int], size: int, least: int = 2) -> int:
        """Bit i is set if the ``size`` tokens from token i on occur ``least`` times or more, by the matching statistics of the passage."""
        follow, link, length, count = self.follow, self.link, self.length, self.count
        state = matched = found = 0
        for i, token in enumerate(tokens):
            while state and token not in follow[state]:
                state = link[state]
                matched = length[state]
            to = follow[state].get(token)
            if to is None:
                matched = 0
                continue
            state, matched = to, matched + 1
            # The state of the last ``size`` tokens: the shortest one that still holds them.
            while length[link[state]] >= size:
                state = link[state]
                matched = length[state]
            if matched >= size and count[state] >= least:
                found |= 1 << (i + 1 - size)
        return found
