"""Generalised suffix automaton over integer symbols."""

from __future__ import annotations

from collections.abc import Iterator, Sequence


class SuffixAutomaton:
    """All substrings of the added sequences, each state with the least owner of its substrings."""

    def __init__(self) -> None:
        self.next: list[dict[int, int]] = [{}]
        self.link = [-1]
        self.length = [0]
        self.least: list[float] = [float("inf")]

    def _new(self, length: int, link: int, moves: dict[int, int]) -> int:
        self.next.append(moves)
        self.link.append(link)
        self.length.append(length)
        self.least.append(float("inf"))
        return len(self.length) - 1

    def _split(self, state: int, symbol: int) -> int:
        """The state of the longest string of ``state`` followed by ``symbol``, which has a move."""
        target = self.next[state][symbol]
        length = self.length[state] + 1
        if self.length[target] == length:
            return target
        clone = self._new(length, self.link[target], dict(self.next[target]))
        self.least[clone] = self.least[target]
        self.link[target] = clone
        while state >= 0 and self.next[state].get(symbol) == target:
            self.next[state][symbol] = clone
            state = self.link[state]
        return clone

    def add(self, sequence: Sequence[int], owner: int) -> None:
        """Adds a sequence."""
        last = 0
        for symbol in sequence:
            if symbol in self.next[last]:
                last = self._split(last, symbol)
            else:
                new = self._new(self.length[last] + 1, 0, {})
                state = last
                while state >= 0 and symbol not in self.next[state]:
                    self.next[state][symbol] = new
                    state = self.link[state]
                if state >= 0:
                    self.link[new] = self._split(state, symbol)
                last = new
            self.least[last] = min(self.least[last], owner)

    def finish(self) -> None:
        """Hands the least owners down to all suffixes; call it once, after the last sequence."""
        for state in sorted(range(1, len(self.length)), key=self.length.__getitem__, reverse=True):
            up = self.link[state]
            self.least[up] = min(self.least[up], self.least[state])

    def matches(self, sequence: Sequence[int], size: int) -> Iterator[tuple[int, float]]:
        """(end, least owner) of each of the sequence's substrings of ``size`` symbols that occurs.

        Matching statistics, read only as far as ``size``: the state is that of the longest
        suffix read so far that occurs.
        """
        state = length = 0
        for end, symbol in enumerate(sequence, 1):
            while state and symbol not in self.next[state]:
                state = self.link[state]
                length = self.length[state]
            if symbol in self.next[state]:
                state = self.next[state][symbol]
                length += 1
            if length >= size:
                while self.length[self.link[state]] >= size:
                    state = self.link[state]
                length = min(length, self.length[state])
                yield end, self.least[state]
