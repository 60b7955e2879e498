"""Hashed word shingles of whole texts, made by numpy over the bytes of Arrow batches."""

from __future__ import annotations

import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa

#: Texts are hashed in slices of at most so many bytes; a longer text is cut between words.
SLICE_BYTES = 1 << 20
_GAP = re.compile(rb"[\x20\x09-\x0D]")

_SPACE = np.zeros(256, bool)
_SPACE[[9, 10, 11, 12, 13, 32]] = True
_LOWER = np.arange(256, dtype=np.uint8)
_LOWER[65:91] += 32
_BYTE = np.random.default_rng(11).integers(1, 1 << 63, 256, dtype=np.uint64) | np.uint64(1)
_PLACES = np.random.default_rng(12).integers(1, 1 << 63, 64, dtype=np.uint64) | np.uint64(1)
_BASE = np.uint64(0x9E3779B97F4A7C15)
_INVERSE = np.uint64(pow(0x9E3779B97F4A7C15, -1, 1 << 64))


def mixed(x: np.ndarray) -> np.ndarray:
    """A one-to-one scramble of 64-bit numbers."""
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


def _powers(base: np.uint64, n: int) -> np.ndarray:
    return np.multiply.accumulate(np.concatenate([np.ones(1, np.uint64), np.full(n, base)]))


def _slices(texts: pa.Array) -> Iterator[list[bytes]]:
    held, size = [], 0
    for text in texts:
        text = text.as_py() or b""
        if held and size + len(text) > SLICE_BYTES:
            yield held
            held, size = [], 0
        held.append(text)
        size += len(text)
    yield held


def _word_hashes(texts: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
    """The hashes of all words, and how many of them lie before each text and before the end."""
    sizes = np.array([len(t) for t in texts], dtype=np.int64)
    data = _LOWER[np.frombuffer(b"".join(texts), np.uint8)]
    first = np.concatenate([[0], np.cumsum(sizes)])
    word = ~_SPACE[data]
    fresh = np.ones(len(data) + 1, bool)  # at a text's first byte, and at the end, a word can't go on
    fresh[1:-1] = False
    fresh[first] = True
    before = np.concatenate([[False], word])
    start = np.flatnonzero(word & (fresh[:-1] | ~before[:-1]))
    end = np.flatnonzero(word & (fresh[1:] | ~np.concatenate([word[1:], [False]]))) + 1
    # the polynomial of a word's bytes, as a difference of running sums divided by the power at its start: the same wherever the word stands
    sums = np.concatenate([np.zeros(1, np.uint64), np.cumsum(_BYTE[data] * _powers(_BASE, len(data))[:-1])])
    return mixed((sums[end] - sums[start]) * _powers(_INVERSE, len(data))[start]), np.searchsorted(start, first)


def _long_word_hashes(text: bytes) -> np.ndarray:
    """The hashes of the words of one long text, made from slices that end between words."""
    found, lo = [], 0
    while lo < len(text):
        cut = _GAP.search(text, min(len(text), lo + SLICE_BYTES))
        hi = cut.end() if cut else len(text)
        found.append(_word_hashes([text[lo:hi]])[0])
        lo = hi
    return np.concatenate(found)


def _sets(texts: list[bytes], width: int) -> Iterator[np.ndarray]:
    if len(texts) == 1 and len(texts[0]) > SLICE_BYTES:
        words = _long_word_hashes(texts[0])
        at = np.array([0, len(words)])
    else:
        words, at = _word_hashes(texts)
    runs = max(0, len(words) - width + 1)
    shingle = np.zeros(runs, np.uint64)
    for i in range(width):
        shingle += words[i : i + runs] * _PLACES[i]
    shingle = mixed(shingle)
    for lo, hi in zip(at, at[1:]):
        if hi - lo >= width:
            yield np.unique(shingle[lo : hi - width + 1])
        elif hi > lo:
            yield mixed((words[lo:hi] * _PLACES[: hi - lo]).sum(keepdims=True) + np.uint64(hi - lo))
        else:
            yield shingle[:0]


def shingle_sets(texts: pa.Array, width: int = 5) -> Iterator[np.ndarray]:
    """For each text the sorted distinct hashes of its shingles of `width` words, A-Z lower-cased; a shorter text is one shingle, one without words none."""
    for held in _slices(texts.cast(pa.binary())):
        if held:
            yield from _sets(held, width)
