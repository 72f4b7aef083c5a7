"""Words of whole texts in Arrow batches, as numpy arrays.

A word is a run of ``[^\\x20\\x09-\\x0D]``. All separators are single bytes in UTF-8, so words are found on the bytes of
the Arrow buffers, without Python strings.
"""

from __future__ import annotations

import contextlib
import ctypes
import gc
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import xxhash

CHUNK_BYTES = 1 << 20


def _steady_memory() -> None:
    """Let arrays of a megabyte or more go back to the system when they are freed.

    The C library raises this limit as arrays are freed, and then keeps ever larger ones; a Python worker, which lives
    through many stages, would hold hundreds of megabytes that it doesn't use.
    """
    with contextlib.suppress(OSError, AttributeError):
        ctypes.CDLL(None).mallopt(-3, 1 << 20)  # M_MMAP_THRESHOLD


_steady_memory()
#: Models that a worker process has loaded, by name and path.
_LOADED: dict[str, dict[str, object]] = {}


def loaded(kind: str) -> dict[str, object]:
    """The models of a kind that this process has loaded."""
    return _LOADED.setdefault(kind, {})


def only(*kinds: str) -> None:
    """Let go of all loaded models but those of ``kinds``, and of memory that libraries keep for later.

    A Python worker lives through many stages; each begins with this call, so that it doesn't hold what others have needed.
    """
    old = [k for k, models in _LOADED.items() if k not in kinds and models]
    for k in old:
        _LOADED[k].clear()
    pa.default_memory_pool().release_unused()
    if old:
        gc.collect()
        with contextlib.suppress(OSError, AttributeError):
            ctypes.CDLL(None).malloc_trim(0)

_SPACE = np.zeros(256, dtype=bool)
_SPACE[[0x20, *range(0x09, 0x0E)]] = True
_LOWER = np.arange(256, dtype=np.uint8)
_LOWER[ord("A") : ord("Z") + 1] += 32
_EMPTY = np.zeros(0, dtype=np.uint8)


def flat_bytes(texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """The bytes of all texts and the n + 1 offsets of the texts in them. Nulls count as empty."""
    if isinstance(texts, pa.ChunkedArray):
        texts = texts.combine_chunks()
    texts = texts.cast(pa.large_string()) if texts.type != pa.large_string() else texts
    if texts.null_count:
        texts = texts.fill_null("")
    _, offsets, data = texts.buffers()
    at = np.frombuffer(offsets, dtype=np.int64)[texts.offset : texts.offset + len(texts) + 1]
    if data is None or at[-1] == at[0]:
        return _EMPTY, np.zeros(len(texts) + 1, dtype=np.int64)
    return np.frombuffer(data, dtype=np.uint8)[at[0] : at[-1]], at - at[0]


def chunks(batch: pa.RecordBatch, column: str = "text", most: int = CHUNK_BYTES) -> Iterator[pa.RecordBatch]:
    """Slices of the batch with about ``most`` bytes of text each, one row at least."""
    _, at = flat_bytes(batch.column(column))
    begin = 0
    while begin < batch.num_rows:
        end = max(begin + 1, int(np.searchsorted(at, at[begin] + most, side="right")) - 1)
        yield batch.slice(begin, end - begin)
        begin = end


@dataclass
class Words:
    """The words of n texts. of[i]:of[i + 1] are text i's words; word j is letters[at[j]:at[j + 1]] and starts at byte start[j]."""

    letters: np.ndarray
    at: np.ndarray
    of: np.ndarray
    start: np.ndarray

    def array(self) -> pa.Array:
        return pa.Array.from_buffers(pa.large_binary(), len(self.at) - 1, [None, pa.py_buffer(self.at), pa.py_buffer(self.letters)])

    def coded(self) -> tuple[np.ndarray, pa.Array]:
        """A code for each word, and the distinct words by code."""
        if len(self.at) == 1:
            return np.zeros(0, dtype=np.int32), pa.array([], pa.large_binary())
        coded = self.array().dictionary_encode()
        return coded.indices.to_numpy(), coded.dictionary

    def hashes(self) -> np.ndarray:
        """64-bit hashes of the words; equal words have equal ones in every batch."""
        codes, distinct = self.coded()
        own = np.fromiter((xxhash.xxh3_64_intdigest(w) for w in distinct.to_pylist()), dtype=np.uint64, count=len(distinct))
        return own[codes] if len(codes) else np.zeros(0, dtype=np.uint64)


def split_words(data: np.ndarray, offsets: np.ndarray, lower: bool = False, also: np.ndarray | None = None) -> Words:
    """Words of the texts data[offsets[i]:offsets[i + 1]]; ``lower`` lower-cases A-Z only; new words start where ``also`` is true too."""
    inside = ~_SPACE[data]
    n = len(data)
    edge = np.zeros(n + 1, dtype=bool)
    if also is not None:
        edge[:n] = also
    edge[offsets] = True
    starts = inside.copy()
    starts[1:] &= ~inside[:-1] | edge[1:n]
    start = np.flatnonzero(starts)
    ends = inside.copy()
    ends[:-1] &= ~inside[1:] | edge[1:n]
    length = np.flatnonzero(ends) + 1 - start
    at = np.zeros(len(start) + 1, dtype=np.int64)
    np.cumsum(length, out=at[1:])
    letters = data[inside]
    return Words(_LOWER[letters] if lower else letters, at, np.searchsorted(start, offsets), start)


_M1, _M2, _M3 = (np.uint64(x) for x in (0x9E3779B97F4A7C15, 0xBF58476D1CE4E5B9, 0x94D049BB133111EB))


def mixed(x: np.ndarray) -> np.ndarray:
    """Each 64-bit value mapped to another so that all bits depend on all bits (the splitmix64 finalizer)."""
    x = (x ^ (x >> np.uint64(30))) * _M2
    x = (x ^ (x >> np.uint64(27))) * _M3
    return x ^ (x >> np.uint64(31))


def rolling(h: np.ndarray, k: int, base: int = 0x5851F42D4C957F2D) -> np.ndarray:
    """Rabin-Karp hashes, modulo 2**64, of the len(h) - k + 1 windows of k values: one update for each step of the window.

    The recurrence w[i + 1] = (w[i] - h[i] * base**(k - 1)) * base + h[i + k] is solved for all i at once: with prefix sums
    of h[i] * base**-i, each window is a difference of two prefix sums times a power of the (odd, hence invertible) base.
    """
    n = len(h)
    if n < k:
        return np.zeros(0, dtype=np.uint64)
    inverse = pow(base, -1, 1 << 64)
    down = powers(inverse, n)
    total = np.zeros(n + 1, dtype=np.uint64)
    np.cumsum(h * down, out=total[1:])
    return mixed((total[k:] - total[:-k]) * powers(base, n)[k - 1 :])


_POWERS: dict[int, np.ndarray] = {}


def powers(base: int, n: int) -> np.ndarray:
    """base**0 ... base**(n - 1) modulo 2**64; kept for the next call."""
    found = _POWERS.get(base)
    if found is None or len(found) < n:
        size = max(1 << 16, 1 << (n - 1).bit_length())
        found = np.full(size, base, dtype=np.uint64)
        found[0] = 1
        found = np.multiply.accumulate(found)
        _POWERS[base] = found
    return found[:n]


def spans(starts: np.ndarray, lengths: np.ndarray) -> np.ndarray:
    """The concatenation of arange(starts[i], starts[i] + lengths[i])."""
    total = int(lengths.sum())
    if not total:
        return np.zeros(0, dtype=np.int64)
    first = np.cumsum(lengths) - lengths
    return np.arange(total, dtype=np.int64) + np.repeat(starts - first, lengths)
