"""Minimal acyclic automata of sorted words whose paths number the words (a minimal perfect hash)."""

from __future__ import annotations

from collections.abc import Iterable, Iterator


class WordGraph:
    """The words given, in order; ``number`` of a word is its place in that order.

    Built one word at a time: what the next word doesn't share with the last one is final and merged with an equal
    state, if there is one. A transition holds the state it leads to and how many words come before those beyond it.
    """

    def __init__(self, words: Iterable[str]):
        self.steps: list[dict[str, tuple[int, int]]] = []
        self.ends: list[bool] = []
        self.sizes: list[int] = []
        known: dict[tuple, int] = {}
        # The path of the last word: for each state whether a word ends there, and its settled transitions.
        open_ends, open_steps, last = [False], [[]], ""

        def settle(depth: int) -> None:
            """Closes the states of the path beyond ``depth``."""
            for at in range(len(last), depth, -1):
                key = (open_ends.pop(), *open_steps.pop())
                state = known.get(key)
                if state is None:
                    state = known[key] = self._add(key)
                open_steps[-1].append((last[at - 1], state))

        for word in words:
            if word <= last and open_ends != [False]:
                raise ValueError("words must be given once each, in ascending order")
            shared = 0
            for a, b in zip(word, last):
                if a != b:
                    break
                shared += 1
            settle(shared)
            for _ in word[shared:]:
                open_ends.append(False)
                open_steps.append([])
            open_ends[-1] = True
            last = word
        settle(0)
        self.start = self._add((open_ends[0], *open_steps[0]))

    def _add(self, key: tuple) -> int:
        count, steps = int(key[0]), {}
        for symbol, state in key[1:]:
            steps[symbol] = (state, count)
            count += self.sizes[state]
        self.steps.append(steps)
        self.ends.append(key[0])
        self.sizes.append(count)
        return len(self.steps) - 1

    def __len__(self) -> int:
        return self.sizes[self.start]

    def follow(self, state: int, number: int, text: str) -> tuple[int, int] | None:
        """State and number after ``text``, or None."""
        steps = self.steps
        for symbol in text:
            step = steps[state].get(symbol)
            if step is None:
                return None
            state = step[0]
            number += step[1]
        return state, number

    def number(self, word: str) -> int | None:
        at = self.follow(self.start, 0, word)
        return at[1] if at and self.ends[at[0]] else None

    def replaced(self, state: int, number: int, rest: str) -> Iterator[int]:
        """Numbers of the words beyond ``state`` that differ from ``rest`` in exactly one symbol."""
        for i, symbol in enumerate(rest):
            tail = rest[i + 1 :]
            for other, (to, before) in self.steps[state].items():
                if other != symbol:
                    at = self.follow(to, number + before, tail)
                    if at and self.ends[at[0]]:
                        yield at[1]
            step = self.steps[state].get(symbol)
            if step is None:
                return
            state, number = step[0], number + step[1]

    def shortened(self, state: int, number: int, rest: str) -> Iterator[int]:
        """Numbers of the words beyond ``state`` that are ``rest`` without one symbol, each once."""
        for i, symbol in enumerate(rest):
            if i == 0 or symbol != rest[i - 1]:  # leaving out either of two equal neighbours gives one word
                at = self.follow(state, number, rest[i + 1 :])
                if at and self.ends[at[0]]:
                    yield at[1]
            step = self.steps[state].get(symbol)
            if step is None:
                return
            state, number = step[0], number + step[1]
