"""Words, word hashes and shingles of a batch of texts, as flat numpy arrays.

A *word* is a maximal run of letters and digits, lower-cased. Whole batches are
handled as one array of code points, so no step runs once per word in Python.
"""

from __future__ import annotations

import re
from collections.abc import Sequence
from functools import lru_cache

import numpy as np

WORD = re.compile(r"[^\W_]+")
U64 = np.uint64
CODES = 0x110000


def words(text: str | None) -> list[str]:
    """The words of one text. Null has none."""
    return WORD.findall(text.lower()) if text else []


def mix(x: np.ndarray, seed: int = 0) -> np.ndarray:
    """A 64-bit finaliser: every bit of the result depends on every bit of ``x`` and of the seed."""
    x = x ^ U64((seed * 0x9E3779B97F4A7C15 + 0x632BE59BD9B4E019) & 0xFFFFFFFFFFFFFFFF)
    x = (x ^ (x >> U64(30))) * U64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> U64(27))) * U64(0x94D049BB133111EB)
    return x ^ (x >> U64(31))


@lru_cache(maxsize=1)
def _letters() -> tuple[np.ndarray, np.ndarray]:
    """(is a letter or digit, a random number) of each code point."""
    kind = np.fromiter((chr(c).isalnum() for c in range(CODES)), bool, CODES)
    return kind, mix(np.arange(CODES, dtype=U64), 11)


MULTIPLIER = 0x9E3779B97F4A7C15
INVERSE = pow(MULTIPLIER, -1, 1 << 64)
CHUNK = 1 << 17  # code points handled at a time, so that the arrays stay in the processor's cache


@lru_cache(maxsize=8)
def _powers(size: int) -> tuple[np.ndarray, np.ndarray]:
    """Powers of the multiplier and of its inverse modulo 2**64, at least ``size`` of each."""
    out = []
    for base in (MULTIPLIER, INVERSE):
        p = np.full(size, base, dtype=U64)
        p[0] = 1
        out.append(np.multiply.accumulate(p))
    return out[0], out[1]


def _chunk_words(texts: Sequence[str]) -> tuple[np.ndarray, np.ndarray]:
    """(hashes of the words, number of words of each text)."""
    joined = "\x00".join(texts).lower()
    codes = np.frombuffer(joined.encode("utf-32-le", "surrogatepass"), dtype=np.uint32)
    kind, number = _letters()
    inside = np.zeros(len(codes) + 2, bool)
    inside[1:-1] = kind[codes]
    edge = np.flatnonzero(inside[1:] != inside[:-1])
    start, end = edge[::2], edge[1::2]
    breaks = np.flatnonzero(codes == 0)
    upto = np.concatenate([np.searchsorted(start, breaks), [len(start)]])
    counts = np.diff(upto, prepend=0)
    if not len(start):
        return np.zeros(0, U64), counts
    power, inverse = _powers(1 << max(17, int(len(codes)).bit_length()))
    total = np.zeros(len(codes) + 1, U64)
    np.cumsum(number[codes] * power[: len(codes)], out=total[1:])
    h = (total[end] - total[start]) * inverse[start]
    return mix(h + (end - start).astype(U64), 12), counts


def flat_words(texts: Sequence[str | None]) -> tuple[np.ndarray, np.ndarray]:
    """(64-bit hashes of all words in order, offsets of the texts). Null has no words."""
    hashes, counts = [np.zeros(0, U64)], [np.zeros(0, np.int64)]
    part, size = [], 0
    for i, t in enumerate(texts):
        t = (t or "").replace("\x00", " ")
        part.append(t)
        size += len(t) + 1
        if size >= CHUNK or i == len(texts) - 1:
            h, n = _chunk_words(part)
            hashes.append(h)
            counts.append(n)
            part, size = [], 0
    offsets = np.zeros(len(texts) + 1, np.int64)
    np.cumsum(np.concatenate(counts), out=offsets[1:])
    return np.concatenate(hashes), offsets


def word_hash(word: str) -> int:
    """The hash that :func:`flat_words` gives to one word."""
    return int(flat_words([word])[0][0])


def owners(offsets: np.ndarray) -> np.ndarray:
    """The text number of every element."""
    return np.repeat(np.arange(len(offsets) - 1), np.diff(offsets))


def shingle_hashes(flat: np.ndarray, offsets: np.ndarray, size: int) -> tuple[np.ndarray, np.ndarray]:
    """(hash of the ``size`` words that start at a position, positions where such a run fits in its text)."""
    if len(flat) < size:
        return np.zeros(0, U64), np.zeros(0, np.int64)
    end = np.repeat(offsets[1:], np.diff(offsets))
    at = np.flatnonzero(np.arange(len(flat)) + size <= end)
    h = np.zeros(len(at), U64)
    for i in range(size):
        h = h * U64(0xD6E8FEB86659FD93) + (flat[at + i] ^ (flat[at + i] >> U64(32)))
    return mix(h, 13), at


def member_of(values: np.ndarray, ordered: np.ndarray) -> np.ndarray:
    """Which of ``values`` are in the sorted array ``ordered``."""
    if not len(ordered):
        return np.zeros(len(values), bool)
    return ordered[np.minimum(np.searchsorted(ordered, values), len(ordered) - 1)] == values
