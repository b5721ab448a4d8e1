"""A bounded table of distinct strings and their ids, joined to positions with numpy."""

from __future__ import annotations

from collections.abc import Callable
from itertools import chain, islice

import numpy as np


class DistinctTable:
    """`segment` is called once for each distinct string that the table holds.

    Beyond `limit` strings, or `limit_bytes` of letters and ids, the older half of the strings is kept:
    frequent strings are met early. Results do not depend on what is kept. `release` empties the
    table when a task ends, so an idle worker holds nothing.
    """

    def __init__(self, segment: Callable[[list[str]], list[list[int]]], limit: int = 200_000, limit_bytes: int = 16_000_000):
        self.segment, self.limit, self.limit_bytes = segment, limit, limit_bytes
        self.release()

    def release(self) -> None:
        self.codes: dict[str, int] = {}
        self.letters = 0
        self.flat = np.zeros(1 << 16, dtype=np.int32)
        self.starts = np.zeros(1 << 14, dtype=np.int64)
        self.sizes = np.zeros(1 << 14, dtype=np.int64)
        self.used = 0

    def _full(self) -> bool:
        return len(self.codes) > self.limit or self.letters + 4 * self.used > self.limit_bytes

    def _shrink(self) -> None:
        kept = dict(islice(self.codes.items(), len(self.codes) // 2))
        self.letters = sum(map(len, kept))
        self.codes = kept
        self.used = int(self.starts[len(kept)]) if kept else 0
        if self._full():  # a few very long strings
            self.release()

    def _add(self, strings: list[str]) -> None:
        found = self.segment(strings)
        sizes = np.fromiter(map(len, found), dtype=np.int64, count=len(found))
        total, first = int(sizes.sum()), len(self.codes)
        while self.used + total > len(self.flat):
            self.flat = np.concatenate([self.flat, np.zeros_like(self.flat)])
        while first + len(strings) > len(self.starts):
            self.starts = np.concatenate([self.starts, np.zeros_like(self.starts)])
            self.sizes = np.concatenate([self.sizes, np.zeros_like(self.sizes)])
        self.flat[self.used : self.used + total] = np.fromiter(chain.from_iterable(found), dtype=np.int32, count=total)
        self.starts[first : first + len(strings)] = self.used + np.cumsum(sizes) - sizes
        self.sizes[first : first + len(strings)] = sizes
        self.codes.update(zip(strings, range(first, first + len(strings))))
        self.letters += sum(map(len, strings))
        self.used += total

    def join(self, per_text: list[list[str]]) -> tuple[np.ndarray, np.ndarray]:
        """Ids of all texts by position, flat, and the bounds of each text."""
        if self._full():
            self._shrink()
        counts = np.cumsum([0, *map(len, per_text)])
        every = list(chain.from_iterable(per_text))
        new = [x for x in dict.fromkeys(every) if x not in self.codes]
        if new:
            self._add(new)
        codes = np.fromiter(map(self.codes.__getitem__, every), dtype=np.int64, count=len(every))
        return self._placed(codes, counts)

    def join_kinds(self, kinds: list[str], at: np.ndarray, counts: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """`join` of texts whose strings are `kinds[at]`, `counts` of them up to each text: the table is asked
        once for each distinct string."""
        if self._full():
            self._shrink()
        new = [x for x in kinds if x not in self.codes]
        if new:
            self._add(new)
        codes = np.fromiter(map(self.codes.__getitem__, kinds), dtype=np.int64, count=len(kinds))
        return self._placed(codes[at], counts)

    def _placed(self, codes: np.ndarray, counts: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        sizes = self.sizes[codes]
        ends = np.cumsum(sizes)
        total = int(ends[-1]) if len(ends) else 0
        flat = self.flat[np.repeat(self.starts[codes] - (ends - sizes), sizes) + np.arange(total)]
        return flat, np.concatenate([[0], ends])[counts]
