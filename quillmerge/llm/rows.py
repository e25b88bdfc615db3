"""Id sequences of many words in one array, for encoders that meet the same words again and again."""

from __future__ import annotations

from collections.abc import Iterable

import numpy as np


def spread(begin: np.ndarray, size: np.ndarray) -> np.ndarray:
    """The positions begin, begin + 1, ... of every stretch, one stretch after another."""
    return np.repeat(begin - np.cumsum(size) + size, size) + np.arange(int(size.sum()))


class WordRows:
    """word -> row; a row's ids are a stretch of one array.  Row 0 is the empty word, without ids.

    Bounded: beyond ``most`` rows, words met in a single batch are forgotten, and learnt
    again should they come back.
    """

    def __init__(self, most: int = 1_000_000):
        self.most = most
        self._clear()

    def _clear(self) -> None:
        self.row: dict[str, int] = {"": 0}
        self.flat, self.used = np.empty(1 << 16, np.int32), 0
        self.begin, self.size, self.seen, self.n = *np.zeros((3, 1 << 14), np.int64), 1

    def append(self, words: Iterable[str], sizes: np.ndarray, ids: np.ndarray) -> None:
        """New words with their ids."""
        while self.used + len(ids) > len(self.flat):
            self.flat = np.concatenate([self.flat, np.empty_like(self.flat)])
        while self.n + len(sizes) > len(self.size):
            self.begin, self.size, self.seen = (np.concatenate([x, np.zeros_like(x)]) for x in (self.begin, self.size, self.seen))
        rows = slice(self.n, self.n + len(sizes))
        self.flat[self.used : self.used + len(ids)] = ids
        self.size[rows], self.seen[rows] = sizes, 0
        self.begin[rows] = self.used + np.cumsum(sizes) - sizes
        self.used, self.n = self.used + len(ids), rows.stop
        self.row.update(zip(words, range(rows.start, rows.stop), strict=True))

    def ids(self, rows: np.ndarray) -> np.ndarray:
        """The ids of the rows, one row after another."""
        return self.flat[spread(self.begin[rows], self.size[rows])]

    def shrink(self) -> None:
        """Call before a batch: keeps within the bound."""
        if self.n <= self.most:
            return
        kept = {w: r for w, r in self.row.items() if self.seen[r] > 1 and w}
        if 2 * len(kept) > self.most:
            return self._clear()
        rows = np.fromiter(kept.values(), np.int64, len(kept))
        sizes, ids = self.size[rows], self.ids(rows)
        self._clear()
        self.append(kept, sizes, ids)

    def rows(self, words: list[str]) -> np.ndarray:
        """The rows of distinct words that are all known."""
        out = np.fromiter(map(self.row.__getitem__, words), np.int64, len(words))
        self.seen[out] += 1
        return out
