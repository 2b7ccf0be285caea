"""Token ids of words, each encoded once for as long as the table lasts."""

from __future__ import annotations

from collections.abc import Callable
from itertools import chain

import numpy as np

#: Words that a table holds before it starts anew, by default.
MOST_WORDS = 600_000


class WordIds:
    """A growing table from word to ids. ``encode`` turns a list of words into lists of ids."""

    def __init__(self, encode: Callable[[list[str]], list[list[int]]], show: Callable[[list[list[int]]], list[str]] | None = None, most: int = MOST_WORDS):
        self.encode, self.show, self.most = encode, show, most
        self.clear()

    def clear(self) -> None:
        self.place: dict[str, int] = {}
        self.flat, self.used = np.zeros(1 << 16, np.uint32), 0
        self.starts = np.zeros(1 << 14, np.int64)
        self.shown: list[str] = []

    def learn(self, words: set[str]) -> None:
        """Encode the words that are not in the table yet."""
        fresh = [w for w in words if w not in self.place]
        if not fresh:
            return
        ids = self.encode(fresh)
        lengths = np.fromiter(map(len, ids), np.int64, len(ids))
        total, n = self.used + int(lengths.sum()), len(self.place)
        while len(self.flat) < total:
            self.flat = np.concatenate([self.flat, np.zeros_like(self.flat)])
        while len(self.starts) < n + len(fresh) + 1:
            self.starts = np.concatenate([self.starts, np.zeros_like(self.starts)])
        self.flat[self.used : total] = np.fromiter(chain.from_iterable(ids), np.uint32, total - self.used)
        self.starts[n : n + len(fresh) + 1] = self.used + np.concatenate(([0], np.cumsum(lengths)))
        self.place.update(zip(fresh, range(n, n + len(fresh))))
        if self.show:
            self.shown.extend(self.show(ids))
        self.used = total

    def full(self) -> bool:
        return len(self.place) > self.most

    def numbers(self, words: list[str]) -> np.ndarray:
        """Places in the table; every word must have been learned."""
        return np.fromiter(map(self.place.__getitem__, words), np.int64, len(words))

    def expand(self, numbers: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """All ids of the words in a row, and how many each word has."""
        first = self.starts[numbers]
        lengths = self.starts[numbers + 1] - first
        ends = np.cumsum(lengths)
        at = np.arange(int(ends[-1]) if len(ends) else 0) + np.repeat(first - (ends - lengths), lengths)
        return self.flat[at], lengths
