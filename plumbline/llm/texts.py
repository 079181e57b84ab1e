"""Texts as byte arrays: words, word hashes and shingle sets of whole batches at once.

A word is a maximal run of bytes other than space and 0x09 to 0x0D, with A-Z lower-cased where asked. All of it runs over
one batch of texts joined into one array, so the cost is a few numpy passes per byte whatever the number of texts.
"""

from __future__ import annotations

from collections.abc import Iterable, Iterator
from functools import lru_cache

import numpy as np

#: Bytes of text handled together; one longer text is handled alone.
CHUNK_BYTES = 250_000

SPACES = np.zeros(256, bool)
SPACES[[0x20, 0x09, 0x0A, 0x0B, 0x0C, 0x0D]] = True
LOWER = np.arange(256, dtype=np.uint8)
LOWER[ord("A") : ord("Z") + 1] += 32


def mix(x: np.ndarray) -> np.ndarray:
    """A 64-bit finaliser: every input bit reaches every output bit."""
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


def draws(start: int, n: int, seed: int) -> np.ndarray:
    """n 64-bit constants from a counter."""
    base = np.uint64((seed * 0x9E3779B97F4A7C15) & 0xFFFFFFFFFFFFFFFF)
    return mix(np.arange(start + 1, start + n + 1, dtype=np.uint64) * np.uint64(0x9E3779B97F4A7C15) + base)


@lru_cache(4)
def _factors(n: int, seed: int) -> np.ndarray:
    return draws(0, n, seed) | np.uint64(1)


def chunks(texts: Iterable[bytes], most: int = CHUNK_BYTES) -> Iterator[tuple[int, list[bytes]]]:
    """(position of the first, texts) of runs of about `most` bytes."""
    first, held, size = 0, [], 0
    for at, data in enumerate(texts):
        if held and size + len(data) > most:
            yield first, held
            first, held, size = at, [], 0
        held.append(data)
        size += len(data) + 1
    if held:
        yield first, held


def joined(parts: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
    """(bytes with a newline after each part, start of each part and the end)."""
    ends = np.cumsum([len(p) + 1 for p in parts])
    return np.frombuffer(b"\n".join(parts) + b"\n", np.uint8), np.concatenate([[0], ends]).astype(np.int64)


def word_bounds(data: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Starts and ends of words."""
    space = SPACES[data]
    edge = np.flatnonzero(np.diff(np.concatenate([[True], space, [True]])))
    return edge[0::2], edge[1::2]


def word_hashes(data: np.ndarray, starts: np.ndarray, ends: np.ndarray, seed: int = 1) -> np.ndarray:
    """One 64-bit value per word: a sum of bytes times random odd factors of their places, mixed."""
    if not len(starts):
        return np.zeros(0, np.uint64)
    lengths = ends - starts
    word_of = np.repeat(np.arange(len(starts)), lengths)
    at = np.arange(len(word_of)) - np.repeat(np.cumsum(lengths) - lengths, lengths)
    longest = int(lengths.max())
    factors = _factors(1 << max(6, (longest - 1).bit_length()), seed)
    terms = (data[np.repeat(starts, lengths) + at].astype(np.uint64) + np.uint64(1)) * factors[at]
    return mix(np.add.reduceat(terms, np.cumsum(lengths) - lengths) + lengths.astype(np.uint64))


def shingles(parts: list[bytes], width: int, lower: bool = True) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(part of each shingle, hash of each shingle in order, words per part).

    A part with fewer words than the width gives its whole sequence as one shingle, one without words none.
    """
    data, edges = joined(parts)
    if lower:
        data = LOWER[data]
    starts, ends = word_bounds(data)
    words = word_hashes(data, starts, ends)
    part = np.searchsorted(edges, starts, side="right") - 1
    n_words = np.bincount(part, minlength=len(parts)) if len(part) else np.zeros(len(parts), np.int64)
    first = np.concatenate([[0], np.cumsum(n_words)])[:-1]
    total = np.zeros(len(words), np.uint64)
    filled = np.zeros(len(words), np.int64)
    for k, factor in enumerate(_factors(64, 2)[:width] if width <= 64 else _factors(width, 2)[:width]):
        there = np.arange(len(words)) + k < (first + n_words)[part] if len(words) else np.zeros(0, bool)
        shifted = np.zeros(len(words), np.uint64)
        shifted[: len(words) - k if k else None] = words[k:] if k < len(words) else 0
        total += np.where(there, shifted * factor, np.uint64(0))
        filled += there
    keep = (filled == width) | ((np.arange(len(words)) == first[part]) & (filled < width)) if len(words) else np.zeros(0, bool)
    return part[keep], mix(total + filled.astype(np.uint64))[keep], n_words


def shingle_sets(parts: list[bytes], width: int) -> list[np.ndarray]:
    """The sorted distinct shingle hashes of each part."""
    part, value, _ = shingles(parts, width)
    order = np.lexsort((value, part))
    part, value = part[order], value[order]
    new = np.ones(len(part), bool)
    new[1:] = (part[1:] != part[:-1]) | (value[1:] != value[:-1])
    part, value = part[new], value[new]
    return np.split(value, np.searchsorted(part, np.arange(1, len(parts)))) if parts else []
