"""A suffix automaton over the word sequences of several texts."""

from __future__ import annotations

from collections.abc import Iterable


class SuffixAutomaton:
    """Every run of words of the texts is a path from state 0.

    ``items`` of a state are the ids of the texts that hold the runs of the state; they are kept for states with
    runs of at least ``least`` words. Its size is linear in the words of the texts.
    """

    def __init__(self, texts: Iterable[tuple[int, list[str]]], least: int):
        self.next: list[dict[str, int]] = [{}]
        self.link = [-1]
        self.length = [0]
        self.least = least
        held: list[set[int]] = [set()]
        for item, words in texts:
            last = 0
            for word in words:
                last = self._extend(last, word, held)
                held[last].add(item)
        for state in sorted(range(1, len(self.next)), key=self.length.__getitem__, reverse=True):
            if self.length[self.link[state]] >= least:
                held[self.link[state]] |= held[state]
        self.items = [tuple(sorted(x)) if n >= least else () for x, n in zip(held, self.length)]

    def _new(self, length: int, link: int, after: dict[str, int], held: list[set[int]]) -> int:
        self.next.append(after)
        self.link.append(link)
        self.length.append(length)
        held.append(set())
        return len(self.next) - 1

    def _split(self, state: int, word: str, target: int, held: list[set[int]]) -> int:
        """The state of the longest run through ``state`` and ``word``, split off its target where that holds longer ones."""
        if self.length[target] == self.length[state] + 1:
            return target
        clone = self._new(self.length[state] + 1, self.link[target], dict(self.next[target]), held)
        while state >= 0 and self.next[state].get(word) == target:
            self.next[state][word] = clone
            state = self.link[state]
        self.link[target] = clone
        return clone

    def _extend(self, last: int, word: str, held: list[set[int]]) -> int:
        if (target := self.next[last].get(word)) is not None:
            return self._split(last, word, target, held)
        state = self._new(self.length[last] + 1, 0, {}, held)
        at = last
        while at >= 0 and word not in self.next[at]:
            self.next[at][word] = state
            at = self.link[at]
        if at >= 0:
            self.link[state] = self._split(at, word, self.next[at][word], held)
        return state

    def matches(self, words: list[str]) -> tuple[dict[int, int], list[tuple[int, int]]]:
        """Per item its longest run in ``words``, and the spans [from, to) of words that runs of ``least`` cover."""
        following, link, length, least = self.next, self.link, self.length, self.least
        best: dict[int, int] = {}
        spans: list[tuple[int, int]] = []
        state = run = 0
        for at, word in enumerate(words):
            to = following[state].get(word)
            if to is None:
                while state and to is None:
                    state = link[state]
                    to = following[state].get(word)
                if to is None:
                    run = 0
                    continue
                run = length[state]
            state, run = to, run + 1
            if run < least:
                continue
            if spans and spans[-1][1] >= at + 1 - run:
                spans[-1] = (min(spans[-1][0], at + 1 - run), at + 1)
            else:
                spans.append((at + 1 - run, at + 1))
            held, n = state, run
            while n >= least:
                for item in self.items[held]:
                    if best.get(item, 0) < n:
                        best[item] = n
                held = link[held]
                n = min(n, length[held])
        return best, spans
