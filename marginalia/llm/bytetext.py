"""Array views of the texts in an Arrow batch: words and their hashes without a Python object per word.

Spark hands each task Arrow batches; the helpers here look at a batch's UTF-8
bytes as one numpy array.  Both word classes of the operators are decided by
ASCII bytes alone (every byte from 0x80 on belongs to a word), so words can be
found on bytes and never split a character.
"""

from __future__ import annotations

import ctypes
import gc
import hashlib
from collections.abc import Iterator, Sequence
from functools import cache

import numpy as np
import pyarrow as pa

#: Texts are taken in pieces of about this many bytes, so that the arrays stay small; a longer text is a piece by itself.
BLOCK_BYTES = 1 << 19

_ASCII_LOWER = np.arange(256, dtype=np.uint8)
_ASCII_LOWER[65:91] += 32

#: Letters, digits and every non-ASCII character, after A-Z are lower-cased.
ALNUM = np.zeros(256, bool)
ALNUM[48:58] = ALNUM[97:123] = ALNUM[128:] = True
#: Everything but space, tab, line feed, vertical tab, form feed and carriage return.
NONSPACE = np.ones(256, bool)
NONSPACE[[32, 9, 10, 11, 12, 13]] = False


def mix64(x: np.ndarray) -> np.ndarray:
    """A bijective 64-bit finaliser (splitmix64), so that every bit of a hash depends on the whole input."""
    x = x.astype(np.uint64, copy=True)
    x ^= x >> np.uint64(30)
    x *= np.uint64(0xBF58476D1CE4E5B9)
    x ^= x >> np.uint64(27)
    x *= np.uint64(0x94D049BB133111EB)
    x ^= x >> np.uint64(31)
    return x


_BASE = 0x9E3779B97F4A7C15
_BASE_INVERSE = pow(_BASE, -1, 1 << 64)
_BYTE_CODES = mix64(np.arange(1, 257, dtype=np.uint64))
_powers: list[np.ndarray] = [np.ones(1, np.uint64), np.ones(1, np.uint64)]


def powers(n: int) -> tuple[np.ndarray, np.ndarray]:
    """The first n powers of the hash base, and of its inverse, modulo 2**64."""
    if len(_powers[0]) < n:
        for k, base in enumerate((_BASE, _BASE_INVERSE)):
            out = np.empty(max(n, BLOCK_BYTES + 2), np.uint64)
            out[0] = 1
            out[1:] = np.uint64(base)
            _powers[k] = np.multiply.accumulate(out)
    return _powers[0][:n], _powers[1][:n]


def span_hashes(codes: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
    """A 64-bit hash of each codes[start:end]; equal spans have equal hashes wherever they stand."""
    if not len(starts):
        return np.zeros(0, np.uint64)
    up, down = powers(len(codes) + 1)
    total = np.empty(len(codes) + 1, np.uint64)
    total[0] = 0
    np.cumsum(codes * up[:-1], out=total[1:])
    h = (total[ends] - total[starts]) * down[starts]
    return mix64(h + (ends - starts).astype(np.uint64) * np.uint64(0xD6E8FEB86659FD93))


def window_hashes(words: np.ndarray, size: int) -> np.ndarray:
    """A hash of each run of `size` consecutive word hashes."""
    n = len(words) - size + 1
    if n <= 0:
        return np.zeros(0, np.uint64)
    h = np.zeros(n, np.uint64)
    for j in range(size):
        h *= np.uint64(0xC2B2AE3D27D4EB4F)
        h += words[j : j + n]
    return mix64(h)


def window_digests(words: np.ndarray, size: int) -> np.ndarray:
    """A 128-bit digest of each run of `size` words, from their digests: two halves that take in one word after the other and each other."""
    n = len(words) - size + 1
    if n <= 0:
        return np.zeros((0, 2), np.uint64)
    a, b = np.full(n, size, np.uint64), np.zeros(n, np.uint64)
    for j in range(size):
        a = mix64(a ^ words[j : j + n, 0]) + b
        b = mix64(b ^ words[j : j + n, 1]) ^ a
    return np.stack((a, b), axis=1)


class Block:
    """Some consecutive texts of a batch: their bytes, and where each text begins and ends in them."""

    def __init__(self, texts: pa.Array):
        if pa.types.is_large_string(texts.type):
            texts = texts.cast(pa.string())
        if texts.null_count:
            texts = texts.fill_null("")
        n = len(texts)
        offsets = np.frombuffer(texts.buffers()[1], np.int32, n + 1, texts.offset * 4).astype(np.int64)
        data = texts.buffers()[2]
        self.bytes = np.frombuffer(data, np.uint8, int(offsets[-1] - offsets[0]), int(offsets[0])) if data is not None and offsets[-1] > offsets[0] else np.zeros(0, np.uint8)
        self.offsets = offsets - offsets[0]
        self.n = n

    def lower(self) -> np.ndarray:
        return _ASCII_LOWER[self.bytes]


class Words:
    """The words of a block under a byte class; `first[i]:first[i+1]` are those of text i."""

    def __init__(self, block: Block, is_word: np.ndarray):
        self.low = low = block.lower()
        self.inside = inside = is_word[low]
        edges = np.zeros(len(low) + 1, bool)
        edges[block.offsets] = True
        self.starts = np.flatnonzero(inside & (edges[:-1] | ~np.concatenate(([False], inside[:-1])))) if len(low) else np.zeros(0, np.int64)
        self.ends = np.flatnonzero(inside & (edges[1:] | ~np.concatenate((inside[1:], [False])))) + 1 if len(low) else np.zeros(0, np.int64)
        self.first = np.searchsorted(self.starts, block.offsets)

    def hashes(self) -> np.ndarray:
        """A hash of each word."""
        return span_hashes(_BYTE_CODES[self.low], self.starts, self.ends)

    def numbers(self) -> tuple[np.ndarray, list[bytes]]:
        """(number of each word among the distinct ones, these): Arrow's dictionary compares the words themselves."""
        ends = np.concatenate(([0], np.cumsum(self.ends - self.starts))).astype(np.int64)
        buffers = [None, pa.py_buffer(ends), pa.py_buffer(self.low[self.inside])]
        coded = pa.Array.from_buffers(pa.large_binary(), len(self.starts), buffers).dictionary_encode()
        return coded.indices.to_numpy().astype(np.int64), coded.dictionary.to_pylist()

    def digests(self) -> np.ndarray:
        """A 128-bit cryptographic digest of each word, as two numbers."""
        numbers, distinct = self.numbers()
        blake = hashlib.blake2b
        raw = b"".join([blake(w, digest_size=16).digest() for w in distinct])
        return np.frombuffer(raw, "<u8").reshape(-1, 2)[numbers]

    def beginnings(self, lengths: Sequence[int]) -> Iterator[tuple[np.ndarray, np.ndarray]]:
        """For each length: which words have more characters, and a hash of the first ones of each."""
        codes, begins = _BYTE_CODES[self.low], np.flatnonzero((self.low & 0xC0) != 0x80)
        at = np.searchsorted(begins, self.starts)
        begins = np.append(begins, np.full(max(lengths) + 1, len(self.low)))
        for chars in lengths:
            ends = begins[at + chars]
            longer = np.flatnonzero(ends < self.ends)
            yield longer, span_hashes(codes, self.starts[longer], ends[longer])

    def text(self, i: int, j: int) -> bytes:
        """Words i to j - 1 joined by single spaces."""
        raw = self.low.data
        return b" ".join(bytes(raw[s:e]) for s, e in zip(self.starts[i:j].tolist(), self.ends[i:j].tolist()))


@cache
def _trim():
    """glibc's malloc_trim, where there is one."""
    try:
        return ctypes.CDLL(None).malloc_trim
    except (AttributeError, OSError):
        return lambda _: 0


def release_memory() -> None:
    """Gives freed memory back to the system: Python workers live on between tasks beside the executor's JVM."""
    gc.collect()
    pa.default_memory_pool().release_unused()
    _trim()(0)


def pieces(batches, column: str):
    """Slices of the batches that hold about BLOCK_BYTES of `column`, with the column as an array."""
    try:
        yield from _pieces(batches, column)
    finally:
        release_memory()


def _pieces(batches, column: str):
    for batch in batches:
        texts = batch.column(batch.schema.get_field_index(column))
        if not len(texts):
            continue
        if pa.types.is_large_string(texts.type) or not pa.types.is_string(texts.type):
            texts = texts.cast(pa.string())
        ends = np.frombuffer(texts.buffers()[1], np.int32, len(texts) + 1, texts.offset * 4).astype(np.int64)
        at = 0
        while at < len(texts):
            to = max(at + 1, int(np.searchsorted(ends, ends[at] + BLOCK_BYTES, "right")) - 1)
            yield batch.slice(at, to - at), texts.slice(at, to - at)
            at = to


def per_text(values: np.ndarray, first: np.ndarray) -> np.ndarray:
    """Sums of `values` over first[i]:first[i+1], which may be empty."""
    total = np.zeros(len(values) + 1, np.int64)
    np.cumsum(values, out=total[1:])
    return total[first[1:]] - total[first[:-1]]
