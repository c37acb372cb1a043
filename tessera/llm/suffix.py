"""A suffix automaton over words, with occurrence counts, and matching statistics of documents against it."""

from __future__ import annotations

from collections.abc import Hashable, Iterable, Sequence


class SuffixAutomaton:
    """All factors of some word sequences; each sequence stands for a number of copies of itself."""

    def __init__(self, sequences: Iterable[tuple[Sequence[Hashable], int]]):
        self.next: list[dict] = [{}]
        self.link: list[int] = [-1]
        self.length: list[int] = [0]
        self.count: list[int] = [0]
        for words, copies in sequences:
            state = 0
            for w in words:
                state = self._extend(state, w)
                self.count[state] += copies
        self._sum_counts()

    def _new(self, length: int, moves: dict, link: int) -> int:
        self.next.append(moves), self.length.append(length), self.link.append(link), self.count.append(0)
        return len(self.next) - 1

    def _split(self, p: int, q: int, w: Hashable) -> int:
        """A copy of state q for its factors of at most length[p] + 1 words."""
        length = self.length[p] + 1
        if self.length[q] == length:
            return q
        copy = self._new(length, dict(self.next[q]), self.link[q])
        self.link[q] = copy
        while p >= 0 and self.next[p].get(w) == q:
            self.next[p][w] = copy
            p = self.link[p]
        return copy

    def _extend(self, last: int, w: Hashable) -> int:
        have = self.next[last].get(w)
        if have is not None:
            return self._split(last, have, w)
        made, p = self._new(self.length[last] + 1, {}, 0), last
        while p >= 0 and w not in self.next[p]:
            self.next[p][w] = made
            p = self.link[p]
        if p >= 0:
            self.link[made] = self._split(p, self.next[p][w], w)
        return made

    def _sum_counts(self) -> None:
        for s in sorted(range(1, len(self.length)), key=self.length.__getitem__, reverse=True):
            self.count[self.link[s]] += self.count[s]
        self.count[0] = 0

    def matching_statistics(self, words: Sequence[Hashable], copies: int = 1) -> list[int]:
        """At each word, the length of the longest factor ending there that occurs at least ``copies`` times."""
        nxt, link, length, count = self.next, self.link, self.length, self.count
        out, state, have = [], 0, 0
        for w in words:
            while state and w not in nxt[state]:
                state = link[state]
                have = length[state]
            if w in nxt[state]:
                state, have = nxt[state][w], have + 1
            s, n = state, have
            while s > 0 and count[s] < copies:
                s = link[s]
                n = length[s]
            out.append(n if s > 0 else 0)
        return out
