"""Many names in one text, by an Aho-Corasick automaton."""

from __future__ import annotations

from collections import deque

from pyspark.sql import Column
from pyspark.sql import functions as F


class Matcher:
    """All of ``words`` at once: a trie whose states fall back to the longest other beginning that ends there."""

    def __init__(self, words: list[str]):
        self.next: list[dict[str, int]] = [{}]
        self.fall, self.ends = [0], [[]]
        for i, w in enumerate(words):
            state = 0
            for c in w:
                if c not in self.next[state]:
                    self.next[state][c] = len(self.next)
                    self.next.append({})
                    self.fall.append(0)
                    self.ends.append([])
                state = self.next[state][c]
            self.ends[state].append(i)
        queue = deque(self.next[0].values())
        while queue:
            state = queue.popleft()
            for c, t in self.next[state].items():
                back = self.fall[state]
                while back and c not in self.next[back]:
                    back = self.fall[back]
                self.fall[t] = self.next[back].get(c, 0)
                # a place is reported once, so what ends here only by falling back is linked, not copied
                queue.append(t)

    def found(self, text: str) -> set[int]:
        """Numbers of the words that ``text`` holds."""
        out, seen, state = set(self.ends[0]), {0}, 0
        for c in text:
            while state and c not in self.next[state]:
                state = self.fall[state]
            state = self.next[state].get(c, 0)
            at = state
            while at not in seen:
                seen.add(at)
                out.update(self.ends[at])
                at = self.fall[at]
        return out


def missing(text: str | None, words: list[str] | None) -> list[str]:
    words = words or []
    found = Matcher(words).found(text or "") if text is not None else set()
    return [w for i, w in enumerate(words) if i not in found]


def names_missing_in(text: Column, names: Column) -> Column:
    """Those of ``names`` that ``text`` doesn't hold, null text holding none; the text is read once, whatever the number of names."""
    return F.udf(missing, "array<string>", useArrow=True)(text, names)
