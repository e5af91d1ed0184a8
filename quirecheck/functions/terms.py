"""Many terms sought in one walk over a text: an automaton of Aho and Corasick."""

from __future__ import annotations

from collections.abc import Iterable


class Terms:
    """States are the beginnings of terms; a step goes to the longest beginning that the text so far ends with."""

    def __init__(self, terms: Iterable[str]):
        """``terms`` are numbered in order; none is empty."""
        self.steps: list[dict[str, int]] = [{}]
        self.ends: list[tuple[int, ...]] = [()]
        for number, term in enumerate(terms):
            at = 0
            for letter in term:
                after = self.steps[at].get(letter)
                if after is None:
                    after = self.steps[at][letter] = len(self.steps)
                    self.steps.append({})
                    self.ends.append(())
                at = after
            self.ends[at] += (number,)
        self.shorter = [0] * len(self.steps)
        level = list(self.steps[0].values())
        while level:
            following = []
            for at in level:
                for letter, after in self.steps[at].items():
                    self.shorter[after] = self._from(self.shorter[at], letter)
                    self.ends[after] += self.ends[self.shorter[after]]
                    following.append(after)
            level = following

    def _from(self, at: int, letter: str) -> int:
        while letter not in self.steps[at]:
            if not at:
                return 0
            at = self.shorter[at]
        return self.steps[at][letter]

    def within(self, text: str) -> set[int]:
        """Numbers of the terms that the text contains."""
        found: set[int] = set()
        steps, ends, at = self.steps, self.ends, 0
        for letter in text:
            after = steps[at].get(letter)
            if after is None:
                after = self._from(at, letter)
            at = after
            if ends[at]:
                found.update(ends[at])
        return found
