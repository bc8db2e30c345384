"""Vectorised word and shingle hashing over Arrow text columns.

Texts are cut into chunks of bounded bytes; in a chunk every word of every text is located and hashed
with a handful of numpy passes, so the cost is a few nanoseconds a byte whatever the word count.
"""

from __future__ import annotations

import ctypes
from collections.abc import Callable, Iterator
from typing import NamedTuple

import numpy as np
import pyarrow as pa

CHUNK_BYTES = 1 << 20

_trim = getattr(ctypes.CDLL(None), "malloc_trim", None)  # glibc has it

_rng = np.random.Generator(np.random.PCG64(20240917))
_BYTE = _rng.integers(1, 2**63, 256, dtype=np.uint64) * np.uint64(2) + np.uint64(1)
_BASE = 0x9E3779B97F4A7C15 | 1
_INV = pow(_BASE, -1, 1 << 64)
_powers = [np.ones(1, np.uint64), np.ones(1, np.uint64)]

#: Bytes of a word: of an alphanumeric one (ASCII letters and digits, and all of a non-ASCII character), and of one between white space.
ALNUM = np.zeros(256, bool)
ALNUM[0x30:0x3A] = ALNUM[0x41:0x5B] = ALNUM[0x61:0x7B] = ALNUM[0x80:] = True
NONSPACE = np.ones(256, bool)
NONSPACE[[0x20, *range(0x09, 0x0E)]] = False

_LOWER = np.arange(256, dtype=np.uint8)
_LOWER[0x41:0x5B] += 0x20
_LOWER_VALUE = _BYTE[_LOWER]


class Words(NamedTuple):
    """Words of a chunk of texts: byte spans and hashes; first[i]:first[i+1] are those of the chunk's text i; hashes of their first bytes."""

    start: np.ndarray
    end: np.ndarray
    hash: np.ndarray
    first: np.ndarray
    heads: list[np.ndarray]


def mix(x: np.ndarray) -> np.ndarray:
    """A bijective 64-bit finaliser."""
    x = x ^ (x >> np.uint64(30))
    x = x * np.uint64(0xBF58476D1CE4E5B9)
    x = x ^ (x >> np.uint64(27))
    x = x * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


def _power(n: int) -> tuple[np.ndarray, np.ndarray]:
    if len(_powers[0]) < n:
        size = 1 << (n - 1).bit_length()
        for k, base in enumerate((_BASE, _INV)):
            steps = np.full(size, base, np.uint64)
            steps[0] = 1
            _powers[k] = np.multiply.accumulate(steps)
    return _powers[0], _powers[1]


def chunks(texts: pa.Array, most: int = CHUNK_BYTES) -> Iterator[tuple[int, int, np.ndarray, np.ndarray]]:
    """(first row, row after the last, bytes, offsets in those bytes) for runs of texts of about ``most`` bytes; null is empty."""
    if isinstance(texts, pa.ChunkedArray):
        texts = texts.combine_chunks()
    texts = texts.cast(pa.large_string())
    if texts.null_count:
        texts = texts.fill_null("")
    n = len(texts)
    if not n:
        return
    offsets = np.frombuffer(texts.buffers()[1], np.int64)[texts.offset : texts.offset + n + 1]
    data = np.frombuffer(texts.buffers()[2], np.uint8) if texts.buffers()[2] is not None else np.zeros(0, np.uint8)
    lo = 0
    while lo < n:
        hi = max(lo + 1, int(np.searchsorted(offsets, offsets[lo] + most, side="right")) - 1)
        hi = min(hi, n)
        yield lo, hi, data[offsets[lo] : offsets[hi]], offsets[lo : hi + 1] - offsets[lo]
        lo = hi


def tidy(function: Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    """The function, giving memory back to the system after its last batch: a worker runs other tasks later, beside other workers."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        yield from function(batches)
        released()

    return run


def released() -> None:
    """Give freed memory back to the system."""
    pa.default_memory_pool().release_unused()
    if _trim is not None:
        _trim(0)


def slices(batches: Iterator[pa.RecordBatch], rows: int = 2000) -> Iterator[pa.RecordBatch]:
    """Batches of fewer rows, so that copies of their texts take little memory."""
    for batch in batches:
        for lo in range(0, batch.num_rows, rows):
            yield batch.slice(lo, rows)


def words(data: np.ndarray, offsets: np.ndarray, member: np.ndarray, longest: int = 0, heads: tuple[int, ...] = ()) -> Words:
    """Maximal runs of member bytes within each text, hashed with A-Z in lower case; with ``longest``, longer ones in pieces of so many bytes.

    heads: numbers of first bytes to hash besides the whole word (a shorter word: all of it).
    """
    n = len(data)
    if not n:
        none = np.zeros(0, np.int64)
        return Words(none, none, none.astype(np.uint64), np.zeros(len(offsets), np.int64), [none.astype(np.uint64) for _ in heads])
    inside = member[data]
    opens = inside.copy()
    opens[1:] &= ~inside[:-1]
    edges = offsets[:-1][offsets[:-1] < n]
    opens[edges] = inside[edges]
    closes = np.zeros(n + 1, bool)
    closes[1:n] = inside[:-1] & (~inside[1:] | opens[1:])
    closes[n] = inside[-1]
    start, end = np.flatnonzero(opens), np.flatnonzero(closes)
    if longest and ((end - start) > longest).any():
        pieces = (end - start + longest - 1) // longest
        begin = np.cumsum(pieces) - pieces
        nth = np.arange(int(pieces.sum())) - np.repeat(begin, pieces)
        start, end = np.repeat(start, pieces) + nth * longest, np.repeat(end, pieces)
        end = np.minimum(end, start + longest)
    power, inverse = _power(n)
    total = np.zeros(n + 1, np.uint64)
    np.cumsum(_LOWER_VALUE[data] * power[:n], out=total[1:])
    upto = lambda last: mix((total[last] - total[start]) * inverse[start] + (last - start).astype(np.uint64))
    return Words(start, end, upto(end), np.searchsorted(start, offsets), [upto(np.minimum(start + k, end)) for k in heads])


def grams(hashes: np.ndarray, k: int) -> np.ndarray:
    """Hash of each run of k consecutive words; the caller leaves out runs that cross texts."""
    n = len(hashes) - k + 1
    if n <= 0:
        return np.zeros(0, np.uint64)
    total = hashes[:n].copy()
    for j in range(1, k):
        total *= np.uint64(0xD6E8FEB86659FD93)
        total += hashes[j : j + n]
    return mix(total + np.uint64(k))
