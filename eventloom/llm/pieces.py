"""Token ids of pieces of text, each different piece encoded once per worker."""

from __future__ import annotations

import itertools
from collections.abc import Callable, Iterator

import numpy as np


class PieceCache(dict):
    """Numbers pieces in the order they are first seen; `encode_new` gives the ids of new pieces, end to end, and their counts."""

    def __init__(self, encode_new: Callable[[list[str]], tuple[np.ndarray, np.ndarray]]):
        super().__init__()
        self.encode_new = encode_new
        self.fresh: list[str] = []
        self.ids, self.starts, self.lengths = np.zeros(0, np.uint32), np.zeros(0, np.int64), np.zeros(0, np.int64)

    def __missing__(self, piece: str) -> int:
        number = self[piece] = len(self)
        self.fresh.append(piece)
        return number

    def _learn(self) -> None:
        flat, lengths = self.encode_new(self.fresh)
        self.starts = np.concatenate([self.starts, len(self.ids) + np.cumsum(lengths) - lengths])
        self.lengths, self.ids = np.concatenate([self.lengths, lengths]), np.concatenate([self.ids, flat])
        self.fresh = []

    def encode(self, texts: list[list[str]]) -> Iterator[np.ndarray]:
        """The ids of each text, given as its pieces."""
        sizes = np.fromiter(map(len, texts), np.int64, len(texts))
        codes = np.fromiter(map(self.__getitem__, itertools.chain.from_iterable(texts)), np.int64, int(sizes.sum()))
        if self.fresh:
            self._learn()
        lengths = self.lengths[codes]
        before = np.cumsum(lengths) - lengths
        flat = self.ids[np.repeat(self.starts[codes] - before, lengths) + np.arange(int(lengths.sum()))]
        ends = np.concatenate([[0], np.cumsum(lengths)])[np.cumsum(sizes)]
        yield from np.split(flat, ends[:-1]) if len(texts) else []
