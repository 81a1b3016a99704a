"""Which lines of which contents are asked for, in a filter that finds each of them and few others."""

from __future__ import annotations

import hashlib

import numpy as np

SEGMENTS = 64
#: Words of a filter at most (64 MB), and numbers that are put into one; of lines not asked for, it finds one in forty then.
MOST_WORDS, MOST_NUMBERS = 1 << 23, 1 << 26

_STEP, _MIX = np.uint64(0x9E3779B97F4A7C15), (np.uint64(0xBF58476D1CE4E5B9), np.uint64(0x94D049BB133111EB))


def content_number(repo: str, blob: str) -> int:
    return int.from_bytes(hashlib.blake2b(f"{repo}\0{blob}".encode(), digest_size=8).digest(), "little")


def line_numbers(contents: list[int], first: list[int], end: list[int]) -> np.ndarray:
    """Numbers of the lines ``first`` to ``end`` of each content, one after the other."""
    lengths = np.array(end, np.int64) - np.array(first, np.int64)
    starts = np.cumsum(lengths) - lengths
    places = np.arange(lengths.sum(), dtype=np.int64) + np.repeat(np.array(first, np.int64) - starts, lengths)
    x = np.repeat(np.array(contents, np.uint64), lengths) + places.astype(np.uint64) * _STEP
    x = (x ^ (x >> np.uint64(30))) * _MIX[0]
    x = (x ^ (x >> np.uint64(27))) * _MIX[1]
    return x ^ (x >> np.uint64(31))


def words_for(n: int) -> int:
    """Words of a filter of ``n`` numbers: a power of two, 16 bits for each as far as :data:`MOST_WORDS` go."""
    return min(max(SEGMENTS, 1 << (n // 4).bit_length()), MOST_WORDS)


def segment(numbers: np.ndarray) -> np.ndarray:
    """The part of a filter where a number stands."""
    return (numbers >> np.uint64(64 - (SEGMENTS.bit_length() - 1))).astype(np.int32)


def _word(numbers: np.ndarray, words: int) -> np.ndarray:
    return (numbers >> np.uint64(64 - (words.bit_length() - 1))).astype(np.int64)


def _bits(numbers: np.ndarray) -> np.ndarray:
    """Up to four bits of a word, by the low bits of a number."""
    out = np.zeros(len(numbers), np.uint64)
    for shift in range(0, 24, 6):
        out |= np.uint64(1) << ((numbers >> np.uint64(shift)) & np.uint64(63))
    return out


def fill_segment(numbers: np.ndarray, words: int) -> bytes:
    """The words of the segment of a filter in which all of ``numbers`` stand."""
    own = words // SEGMENTS
    out = np.zeros(own, np.uint64)
    np.bitwise_or.at(out, _word(numbers, words) % own, _bits(numbers))
    return out.tobytes()


def stands(numbers: np.ndarray, found: np.ndarray) -> np.ndarray:
    """For each number, whether it may be in the filter with the words ``found``."""
    bits = _bits(numbers)
    return (found[_word(numbers, len(found))] & bits) == bits
