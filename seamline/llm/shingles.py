"""Words and word shingles of many texts at once, as 64-bit hashes in numpy.

Words are runs of bytes other than 0x20 and 0x09 to 0x0D, with A-Z lower-cased. A text's shingles are its runs of five
words; a text with fewer words has its whole sequence as the one shingle, a text without words has none.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

WIDTH = 5
SPACES = b" \t\n\x0b\x0c\r"
_BASE = 0x9E3779B97F4A7C15
_IS_SPACE = np.zeros(256, bool)
_IS_SPACE[list(SPACES)] = True
#: All ASCII characters but letters and digits.
PUNCTUATION = np.array([b < 128 and not chr(b).isalnum() for b in range(256)])
_LOWER = np.arange(256, dtype=np.uint8)
_LOWER[65:91] += 32
_powers: list[np.ndarray] = []


def mix(x: np.ndarray) -> np.ndarray:
    """A bijection of 64-bit numbers that spreads every bit (the finaliser of splitmix64)."""
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


_BYTE = mix(np.arange(1, 257, dtype=np.uint64))
_PLACE = mix(np.arange(1001, 1001 + WIDTH, dtype=np.uint64)) | np.uint64(1)


def _tables(n: int) -> tuple[np.ndarray, np.ndarray]:
    """Powers of an odd base and of its inverse modulo 2^64."""
    if not _powers or len(_powers[0]) < n:
        size = max(n, 1 << 16)
        _powers[:] = [np.cumprod(np.concatenate([[np.uint64(1)], np.full(size, np.uint64(b))])) for b in (_BASE, pow(_BASE, -1, 1 << 64))]
    return _powers[0], _powers[1]


def join_texts(texts: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
    """All bytes, lower-cased, a space after each text; and where each text starts, with the end."""
    data = _LOWER[np.frombuffer(b" ".join([*texts, b""]), np.uint8)]
    starts = np.cumsum([0, *[len(t) + 1 for t in texts]])
    return data, starts


def words_of(data: np.ndarray, starts: np.ndarray, gaps: np.ndarray = _IS_SPACE) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """(hash, first byte, byte after, first word of each text and the end) of the words; gaps: which bytes end a word."""
    space = gaps[data]
    edge = np.diff(np.concatenate([[True], space]).view(np.int8))
    begin, end = np.flatnonzero(edge == -1), np.flatnonzero(edge == 1)
    power, inverse = _tables(len(data) + 1)
    total = np.concatenate([[np.uint64(0)], np.cumsum(_BYTE[data] * inverse[: len(data)])])
    code = mix((total[end] - total[begin]) * power[begin] + (end - begin).astype(np.uint64))
    return code, begin, end, np.searchsorted(begin, starts)


def shingle_sets(texts: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
    """Distinct shingles, sorted within each text; and where each text's start, with the end."""
    data, starts = join_texts(texts)
    code, _, _, first = words_of(data, starts)
    n_words = np.diff(first)
    rolled = np.zeros(max(len(code) - WIDTH + 1, 0), np.uint64)
    for j in range(WIDTH):
        rolled += code[j : j + len(rolled)] * _PLACE[j]
    rolled = mix(rolled)
    sets, sizes = [], []
    for a, n in zip(first.tolist(), n_words.tolist()):
        if n >= WIDTH:
            own = np.sort(rolled[a : a + n - WIDTH + 1])
            if len(own) > 1:
                own = own[np.concatenate([[True], own[1:] != own[:-1]])]
        elif n:
            own = mix((code[a : a + n] * _PLACE[:n]).sum(dtype=np.uint64) + np.full(1, n, np.uint64))
        else:
            own = code[:0]
        sets.append(own)
        sizes.append(len(own))
    return (np.concatenate(sets) if sets else code[:0]), np.cumsum([0, *sizes])


def normal_form(text: bytes) -> bytes:
    """The words with one space between them: equal for texts with the same sequence of words."""
    return b" ".join(text.translate(bytes(_LOWER)).split())


def byte_slices(column: pa.Array, most: int) -> Iterator[tuple[int, int]]:
    """Runs of rows of a string or binary column with at most so many bytes together, or a single row."""
    sizes = pc.binary_length(column).fill_null(0).to_pylist()
    low, total = 0, 0
    for k, n in enumerate(sizes):
        if k > low and total + n > most:
            yield low, k
            low, total = k, 0
        total += n
    if low < len(sizes):
        yield low, len(sizes)
