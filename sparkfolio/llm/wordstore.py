"""Token ids of distinct strings, kept by a Python worker for the texts that follow."""

from __future__ import annotations

from collections.abc import Callable

import numpy as np


class WordStore(dict):
    """Maps strings to numbers; ``ids`` turns lists of strings into token ids.

    ``encode`` gets the new strings of a call together and returns their ids end to end and
    how many each has.  After ``most`` strings, or 50 times as many characters, the store starts
    anew, which bounds a worker's memory.  The result does not depend on what the store holds.
    """

    def __init__(self, encode: Callable[[list[str]], tuple[np.ndarray, np.ndarray]], most: int):
        super().__init__()
        self.encode, self.most = encode, most
        self._empty()

    def _empty(self) -> None:
        self.clear()
        self.new: list[str] = []
        self.chars = 0
        self.flat = np.zeros(1 << 16, np.int32)
        self.used = 0
        self.start = np.zeros(0, np.int64)
        self.count = np.zeros(0, np.int64)

    def __missing__(self, word: str) -> int:
        at = self[word] = len(self)
        self.new.append(word)
        self.chars += len(word)
        return at

    def numbers(self, words: list[str]) -> np.ndarray:
        return np.fromiter(map(self.__getitem__, words), np.int32, len(words))

    def ids(self, rows: list[np.ndarray]) -> tuple[np.ndarray, np.ndarray]:
        """Token ids of rows of ``numbers``, end to end, and how many each row has."""
        if self.new:
            flat, count = self.encode(self.new)
            while self.used + len(flat) > len(self.flat):
                self.flat = np.concatenate([self.flat, np.zeros(len(self.flat), np.int32)])
            self.flat[self.used : self.used + len(flat)] = flat
            self.start = np.concatenate([self.start, self.used + np.cumsum(count) - count])
            self.count = np.concatenate([self.count, count])
            self.used += len(flat)
            self.new = []
        numbers = np.concatenate(rows) if rows else np.zeros(0, np.int32)
        out, counts = gather(self.flat, self.start[numbers], self.count[numbers])
        ends = np.concatenate(([0], np.cumsum(counts)))[np.cumsum([0, *map(len, rows)])]
        if len(self) > self.most or self.chars > 50 * self.most:
            self._empty()
        return out, np.diff(ends)


def gather(flat: np.ndarray, start: np.ndarray, count: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """``flat[start : start + count]`` of every entry, end to end; and ``count``."""
    total = int(count.sum())
    before = np.cumsum(count) - count
    return flat[np.repeat(start - before, count) + np.arange(total)], count
