"""Pre-tokens of a byte-level BPE tokenizer as arrays, and a bounded table of the pre-tokens seen so far.

The split pattern of these tokenizers,

    's|'t|'re|'ve|'m|'ll|'d| ?\\p{L}+| ?\\p{N}+| ?[^\\s\\p{L}\\p{N}]+|\\s+(?!\\S)|\\s+

depends on four classes of characters only, so its matches over a block of texts
can be computed with array operations on code points.
"""

from __future__ import annotations

import unicodedata
from functools import cache

import numpy as np
import pyarrow as pa
import regex
from tokenizers import pre_tokenizers

from .bytetext import mix64, span_hashes

OTHER, LETTER, NUMBER, SPACE = range(4)
#: Characters that are compared at a time.
_COMPARED = 1 << 18


@cache
def classes() -> np.ndarray:
    """The class of each code point."""
    table = np.zeros(0x110000, np.uint8)
    points = [*range(0xD800), *range(0xE000, 0x110000)]
    every = "".join(map(chr, points))
    for kind, pattern in ((LETTER, r"\p{L}+"), (NUMBER, r"\p{N}+"), (SPACE, r"\p{White_Space}+")):
        for m in regex.finditer(pattern, every):
            table[points[m.start()] : points[m.end() - 1] + 1] = kind
    table[0xD800:0xE000] = OTHER
    # Letters and numbers of the newest Unicode versions: those that this Python doesn't know either are looked up in the tokenizers library.
    split = pre_tokenizers.ByteLevel(add_prefix_space=False, use_regex=True).pre_tokenize_str
    for c in np.flatnonzero((table == LETTER) | (table == NUMBER)).tolist():
        if unicodedata.category(chr(c)) == "Cn" and split(f"!{chr(c)}!")[-1][1] == (0, 3):
            table[c] = OTHER
    return table


@cache
def code_table() -> np.ndarray:
    """A random-looking 64-bit number for each code point."""
    return mix64(np.arange(1, 0x110001, dtype=np.uint64))


class Chars:
    """The code points of some texts in a row; text i has those from offsets[i] to offsets[i + 1]."""

    def __init__(self, texts: list[str]):
        self.text = "".join(texts)
        self.points = np.frombuffer(self.text.encode("utf-32-le"), np.uint32)
        self.offsets = np.concatenate(([0], np.cumsum([len(t) for t in texts], dtype=np.int64))).astype(np.int64)

    def hashes(self, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
        return span_hashes(code_table()[self.points], starts, ends)

    def spans(self, starts: np.ndarray) -> pa.Array:
        """The spans that begin at `starts`, each up to the next one."""
        p = self.points
        widths = 1 + (p >= 0x80).astype(np.int8) + (p >= 0x800) + (p >= 0x10000)
        ends = np.concatenate(([0], np.cumsum(widths, dtype=np.int64)))
        at = np.append(ends[starts], ends[-1]) if len(starts) else np.zeros(1, np.int64)
        large = at[-1] >= 1 << 31
        buffers = [None, pa.py_buffer(at.astype(np.int64 if large else np.int32)), pa.py_buffer(self.text.encode())]
        return pa.Array.from_buffers(pa.large_string() if large else pa.string(), len(starts), buffers)


def texts_of(column: pa.Array) -> list[str]:
    return [t or "" for t in column.to_pylist()]


def pretoken_starts(chars: Chars, special: str | None = None) -> np.ndarray:
    """Where the pre-tokens begin; each ends where the next begins. Occurrences of `special` are pre-tokens, and the text between them is split by itself."""
    points, n = chars.points, len(chars.points)
    if not n:
        return np.zeros(0, np.int64)
    edge = np.zeros(n + 1, bool)
    edge[chars.offsets] = True
    whole = []
    if special:
        at = chars.text.find(special)
        while at >= 0:
            to = at + len(special)
            if not edge[at + 1 : to].any():
                edge[at] = edge[to] = True
                whole.append((at, to))
                at = chars.text.find(special, to)
            else:  # it lies across two texts
                at = chars.text.find(special, at + 1)
    kind = classes()[points]
    blank = kind == SPACE
    first = edge[:-1].copy()
    first[1:] |= kind[1:] != kind[:-1]
    # The blank right before a word starts a pre-token; a plain space takes the word along.
    after = np.zeros(n, bool)
    after[1:] = blank[:-1] & ~edge[1:-1]
    led = first & ~blank & after
    start = first.copy()
    at = np.flatnonzero(led)
    start[at] = points[at - 1] != 32
    start[at - 1] = True
    # Contractions: an apostrophe alone between a word or blank other than a space, and certain letters.
    quote = np.flatnonzero((points[:-1] == 39) & start[:-1] & first[:-1] & (kind[1:] == LETTER) & ~edge[1:-1])
    if len(quote):
        one = points[quote + 1]
        room = quote + 2 < n
        second = np.where(room & ~edge[np.minimum(quote + 2, n)], points[np.minimum(quote + 2, n - 1)], 0)
        size = np.select([np.isin(one, [115, 116, 109, 100]), np.isin(one, [114, 118]) & (second == 101), (one == 108) & (second == 108)], [1, 2, 2], 0)
        quote, size = quote[size > 0], size[size > 0]
        start[quote + 1] = False
        rest = quote + 1 + size
        start[rest[rest < n]] = True
    for a, b in whole:
        start[a:b] = False
        start[a] = True
    return np.flatnonzero(start)


class Memo:
    """Numbers the distinct spans of the blocks that a task sees, so that each is worked out once.

    The numbers stand in a hash table of two arrays with linear probing.  Hashes only say where to look: each
    span is compared with the one that has its number, character by character, and those that merely share
    its hash are kept in a dict.  When the table holds `most` spans it is emptied, which bounds its memory,
    and fills again.
    """

    def __init__(self, work, most: int):
        """work: gets the list of new strings and adds its results in order; work.clear() drops them all."""
        self.work, self.most = work, most
        self.bits = (2 * most).bit_length()
        self.clear()

    def clear(self) -> None:
        self.keys = np.zeros(1 << self.bits, np.uint64)
        self.values = np.zeros(1 << self.bits, np.int32)
        self.others: dict[str, int] = {}
        self.points, self.used = np.zeros(1 << 20, np.uint32), 0  # the spans one after the other
        self.at, self.size, self.n = np.zeros(1 << 16, np.int64), np.zeros(1 << 16, np.int64), 0
        self.work.clear()

    def _add(self, chars: Chars, starts: np.ndarray, ends: np.ndarray) -> None:
        """Works out new spans and remembers their characters."""
        sizes = ends - starts
        total = int(sizes.sum())
        if self.used + total > len(self.points):
            self.points = np.concatenate((self.points, np.zeros(max(len(self.points), total), np.uint32)))
        if self.n + len(sizes) > len(self.at):
            self.at, self.size = (np.concatenate((x, np.zeros(max(len(x), len(sizes)), np.int64))) for x in (self.at, self.size))
        at = np.cumsum(sizes) - sizes
        self.points[self.used : self.used + total] = chars.points[np.arange(total) + np.repeat(starts - at, sizes)]
        self.at[self.n : self.n + len(sizes)] = self.used + at
        self.size[self.n : self.n + len(sizes)] = sizes
        self.used, self.n = self.used + total, self.n + len(sizes)
        text = chars.text
        self.work([text[s:e] for s, e in zip(starts.tolist(), ends.tolist())])

    def _differ(self, chars: Chars, starts: np.ndarray, ends: np.ndarray, numbers: np.ndarray) -> np.ndarray:
        """The places of spans that aren't those with their numbers."""
        sizes = ends - starts
        differ = self.size[numbers] != sizes
        cuts = np.unique(np.searchsorted(starts, np.arange(0, len(chars.points) + _COMPARED, _COMPARED)))
        for a, b in zip(cuts[:-1].tolist(), cuts[1:].tolist()):  # bounds the arrays
            at = np.arange(starts[a], ends[b - 1]) + np.repeat(self.at[numbers[a:b]] - starts[a:b], sizes[a:b])
            unequal = self.points.take(at, mode="clip") != chars.points[starts[a] : ends[b - 1]]
            if unequal.any():
                differ[a:b] |= np.add.reduceat(unequal, starts[a:b] - starts[a]) > 0
        return np.flatnonzero(differ)

    def _find(self, hashes: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(numbers, places of those that aren't there)."""
        slots = (hashes >> np.uint64(64 - self.bits)).astype(np.int64)
        keys = self.keys[slots]
        out = self.values[slots]
        open_ = np.flatnonzero(keys != hashes)
        absent = []
        while len(open_):
            empty = self.keys[slots[open_]] == 0
            absent.append(open_[empty])
            open_ = open_[~empty]
            slots[open_] = (slots[open_] + 1) & ((1 << self.bits) - 1)
            hit = self.keys[slots[open_]] == hashes[open_]
            out[open_[hit]] = self.values[slots[open_[hit]]]
            open_ = open_[~hit]
        return out, np.concatenate(absent) if absent else open_

    def _insert(self, hashes: np.ndarray, numbers: np.ndarray) -> None:
        slots = (hashes >> np.uint64(64 - self.bits)).astype(np.int64)
        while len(hashes):
            free = self.keys[slots] == 0
            self.keys[slots[free]] = hashes[free]
            done = self.keys[slots] == hashes
            self.values[slots[done]] = numbers[done]
            hashes, numbers, slots = hashes[~done], numbers[~done], (slots[~done] + 1) & ((1 << self.bits) - 1)

    def numbers(self, chars: Chars, starts: np.ndarray) -> np.ndarray:
        """The number of each span from one start to the next; the results of `work` are found by it until the next call."""
        if not len(starts):
            return np.zeros(0, np.int32)
        if self.n > self.most:
            self.clear()
        ends = np.append(starts[1:], len(chars.points))
        hashes = np.maximum(chars.hashes(starts, ends), np.uint64(1))
        out, missed = self._find(hashes)
        if len(missed):
            new, index, inverse = np.unique(hashes[missed], return_index=True, return_inverse=True)
            if self.n + len(new) > 1 << (self.bits - 1):  # a block of its own with very many spans
                self.clear()
                while len(np.unique(hashes)) > 1 << (self.bits - 1):
                    self.bits += 1
                    self.clear()
                return self.numbers(chars, starts)
            first, spans = self.n, missed[index]
            self._add(chars, starts[spans], ends[spans])
            self._insert(new, np.arange(first, self.n, dtype=np.int32))
            out[missed] = (first + inverse).astype(np.int32)
        for k in self._differ(chars, starts, ends, out).tolist():
            word = chars.text[starts[k] : ends[k]]
            if word not in self.others:
                self.others[word] = self.n
                self._add(chars, starts[k : k + 1], ends[k : k + 1])
            out[k] = self.others[word]
        return out
