"""Hashes of words and word shingles, computed over whole batches of texts with numpy.

A word is a run of letters, digits or underscores of the lower-cased text, in any script. Texts are concatenated in
groups of bounded size, so the arrays of a group stay small however long the batch is; a longer text is its own group.
"""

from __future__ import annotations

import functools
from collections.abc import Iterator, Sequence
from dataclasses import dataclass

import numpy as np

SHINGLE_WORDS = 5
GROUP_CHARS = 1_000_000
_BASE = 0x9E3779B97F4A7C15 | 1
_U = np.uint64


def mix(x: np.ndarray) -> np.ndarray:
    """A bijective scrambling of 64-bit integers (the finaliser of the splitmix64 generator)."""
    x = (x ^ (x >> _U(30))) * _U(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> _U(27))) * _U(0x94D049BB133111EB)
    return x ^ (x >> _U(31))


@functools.cache
def _word_characters() -> np.ndarray:
    return np.array([chr(c).isalnum() or c == 0x5F for c in range(0x110000)])


@functools.cache
def _is_space() -> np.ndarray:
    """All but the ASCII white space characters."""
    table = np.ones(0x110000, bool)
    table[[0x20, 0x09, 0x0A, 0x0B, 0x0C, 0x0D]] = False
    return table


@functools.cache
def _powers(n: int) -> tuple[np.ndarray, np.ndarray]:
    """The powers of the base and of its inverse modulo 2**64."""
    inverse = pow(_BASE, -1, 1 << 64)
    up, down = np.full(n, _BASE, _U), np.full(n, inverse, _U)
    up[0] = down[0] = 1
    with np.errstate(over="ignore"):
        return np.cumprod(up, dtype=_U), np.cumprod(down, dtype=_U)


@dataclass(frozen=True)
class Words:
    """The words of consecutive texts: `hashes` of all of them, and where each text's words begin (`offsets`, one more than texts)."""

    hashes: np.ndarray
    offsets: np.ndarray
    starts: np.ndarray  # code points from the start of the joined texts
    ends: np.ndarray

    def texts(self) -> np.ndarray:
        """The index of each word's text."""
        return np.repeat(np.arange(len(self.offsets) - 1), np.diff(self.offsets))


def _hash_words(texts: Sequence[str], table: np.ndarray) -> Words:
    joined = "\n".join(texts) + "\n"
    points = np.frombuffer(joined.encode("utf-32-le", "surrogatepass"), np.uint32)
    word = table[points]
    word[-1] = False
    edges = np.flatnonzero(np.diff(word, prepend=False))
    starts, ends = edges[::2], edges[1::2]
    lengths = np.fromiter((len(t) + 1 for t in texts), np.int64, len(texts))
    offsets = np.concatenate([[0], np.searchsorted(starts, np.cumsum(lengths))])
    size = 1 << max(10, int(len(points)).bit_length())
    up, down = _powers(size)
    with np.errstate(over="ignore"):
        values = mix(points.astype(_U) + _U(1)) * up[: len(points)]
        sums = np.concatenate([np.zeros(1, _U), np.cumsum(values, dtype=_U)])
        hashes = mix((sums[ends] - sums[starts]) * down[starts])
    return Words(hashes, offsets, starts, ends)


def hash_words(texts: Sequence[str]) -> Words:
    """Words of letters, digits and underscores of the lower-cased texts."""
    return _hash_words([t.lower() for t in texts], _word_characters())


def hash_tokens(texts: Sequence[str]) -> Words:
    """White-space separated tokens (ASCII white space), exactly as written."""
    return _hash_words(texts, _is_space())


def groups(texts: Sequence[str], most: int = GROUP_CHARS) -> Iterator[tuple[int, int]]:
    """Ranges of texts of at most `most` characters together; a longer text is a range of its own."""
    start = size = 0
    for i, text in enumerate(texts):
        if i > start and size + len(text) > most:
            yield start, i
            start, size = i, 0
        size += len(text)
    if start < len(texts):
        yield start, len(texts)


def shingles(words: Words, width: int = SHINGLE_WORDS) -> tuple[np.ndarray, np.ndarray]:
    """Hashes of all runs of `width` words within a text, and where each text's runs begin.

    A text of fewer words, but not none, has its whole word list as its only shingle.
    """
    hashes, offsets = words.hashes, words.offsets
    lengths = np.diff(offsets)
    counts = np.where(lengths >= width, lengths - width + 1, (lengths > 0).astype(np.int64))
    out = np.concatenate([[0], np.cumsum(counts)])
    text = np.repeat(np.arange(len(lengths)), counts)
    first = np.arange(out[-1]) - out[text] + offsets[text]
    span = np.minimum(lengths[text], width)
    with np.errstate(over="ignore"):
        total = np.zeros(out[-1], _U)
        for k in range(width):
            inside = k < span
            word = hashes[np.minimum(first + k, max(len(hashes) - 1, 0))] if len(hashes) else total
            total = np.where(inside, total * _U(_BASE) + word, total)
        return mix(total + span.astype(_U)), out


def sorted_sets(hashes: np.ndarray, offsets: np.ndarray) -> list[np.ndarray]:
    """Each text's distinct shingles in ascending order."""
    return [np.unique(hashes[a:b]) for a, b in zip(offsets[:-1], offsets[1:], strict=True)]


@functools.cache
def _term_characters() -> np.ndarray:
    """ASCII letters and digits and everything above ASCII."""
    table = np.ones(0x110000, bool)
    table[:0x80] = [chr(c).isalnum() for c in range(0x80)]
    return table


def ascii_lower(text: str) -> str:
    """The text with A-Z, and nothing else, lower-cased."""
    return text.encode("utf-8", "surrogatepass").lower().decode("utf-8", "surrogatepass")


def hash_terms(texts: Sequence[str]) -> Words:
    """Runs of ASCII letters and digits and of anything above ASCII, A-Z lower-cased."""
    return _hash_words([ascii_lower(t) for t in texts], _term_characters())


def hash_folded_tokens(texts: Sequence[str]) -> Words:
    """White-space separated tokens, A-Z lower-cased."""
    return _hash_words([ascii_lower(t) for t in texts], _is_space())
