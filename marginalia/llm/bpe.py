"""Byte-level BPE encoding and decoding with contiguous rank arrays.

The merges of a short word are done on two small arrays: the parts between the
boundaries that are left, and the rank of the merge of each part with the next.
The minimum is looked for again and again; its boundary is deleted and the two
neighbouring ranks are looked up anew.  Words of one length are merged together,
one row each.  Words over SHORT bytes use a heap of ranks instead, since
rescanning would take time with the square of their length.

Equal words of a task are merged once; the memory for them is bounded.
"""

from __future__ import annotations

import hashlib
import heapq
import json
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .bytetext import pieces
from .pretokens import Chars, Memo, pretoken_starts, texts_of

#: Longest word in bytes that is merged by rescanning.
SHORT = 64
#: Distinct words that a task remembers, at about 300 bytes each.
MOST_WORDS = 200_000
_NONE = np.int32(0x7FFFFFFF)


def byte_letters() -> list[str]:
    """The printable character that byte-level vocabularies write for each byte."""
    plain = [*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)]
    moved = iter(range(0x100, 0x200))
    return [chr(b) if b in plain else chr(next(moved)) for b in range(256)]


class Vocabulary:
    """The ranks of a byte-level BPE in the tokenizers library's JSON format."""

    def __init__(self, path: str):
        with open(path, encoding="utf-8") as f:
            spec = json.load(f)
        model = spec["model"]
        if model["type"] != "BPE" or spec["normalizer"] or model.get("unk_token") or model.get("ignore_merges"):
            raise ValueError("only a plain byte-level BPE is supported")
        of_byte = byte_letters()
        of_letter = {c: b for b, c in enumerate(of_byte)}
        ids = model["vocab"]
        special = [t for t in spec["added_tokens"]]
        if len(special) > 1 or any(t["single_word"] or t["lstrip"] or t["rstrip"] for t in special):
            raise ValueError("at most one added token, without options, is supported")
        self.special = special[0]["content"] if special else None
        self.special_id = special[0]["id"] if special else None
        self.first = np.array([ids[c] for c in of_byte], np.int32)
        self.bytes = [b""] * (max([*ids.values(), *(t["id"] for t in special)]) + 1)
        for token, i in ids.items():
            self.bytes[i] = bytes(of_letter[c] for c in token)
        if special:
            self.bytes[self.special_id] = self.special.encode()
        pairs = [p if isinstance(p, list) else p.split(" ") for p in model["merges"]]
        keys = np.array([ids[a] << 32 | ids[b] for a, b in pairs], np.int64)
        order = np.argsort(keys)
        self.keys, self.ranks = keys[order], order.astype(np.int32)
        self.merged = np.array([ids[a + b] for a, b in pairs], np.int32)  # by rank
        self._rank_of = dict(zip(keys.tolist(), range(len(keys))))

    def rank(self, left: np.ndarray, right: np.ndarray) -> np.ndarray:
        """The rank of the merge of each pair of ids; _NONE where there is none."""
        keys = left.astype(np.int64) << 32 | right
        at = np.minimum(np.searchsorted(self.keys, keys), len(self.keys) - 1)
        return np.where(self.keys[at] == keys, self.ranks[at], _NONE)

    def merge_rows(self, parts: np.ndarray) -> list[list[int]]:
        """The ids of words of one length, a row of byte ids each."""
        out: list = [None] * len(parts)

        def done(which: np.ndarray, ids: np.ndarray) -> None:
            for r, row in zip(which.tolist(), ids.tolist()):
                out[r] = row

        rows = np.arange(len(parts))
        ranks = self.rank(parts[:, :-1], parts[:, 1:])
        while len(rows):
            width = parts.shape[1]
            if width == 1:
                done(rows, parts)
                break
            least = ranks.argmin(axis=1)  # the leftmost of equal ranks
            best = ranks[np.arange(len(rows)), least]
            ready = best == _NONE
            if ready.any():
                done(rows[ready], parts[ready])
                go = ~ready
                rows, parts, ranks, least, best = rows[go], parts[go], ranks[go], least[go], best[go]
                if not len(rows):
                    break
            line = np.arange(len(rows))
            parts[line, least] = self.merged[best]
            keep = np.ones(parts.shape, bool)
            keep[line, least + 1] = False
            parts = parts[keep].reshape(len(rows), width - 1)
            ranks = ranks[keep[:, 1:]].reshape(len(rows), width - 2)
            has = least > 0
            ranks[line[has], least[has] - 1] = self.rank(parts[line[has], least[has] - 1], parts[line[has], least[has]])
            has = least < width - 2
            ranks[line[has], least[has]] = self.rank(parts[line[has], least[has]], parts[line[has], least[has] + 1])
        return out

    def merge_long(self, parts: list[int]) -> list[int]:
        n, rank_of = len(parts), self._rank_of
        after, before = list(range(1, n + 1)), list(range(-1, n - 1))
        heap = [(r, i, parts[i], parts[i + 1]) for i in range(n - 1) if (r := rank_of.get(parts[i] << 32 | parts[i + 1])) is not None]
        heapq.heapify(heap)
        while heap:
            r, i, a, b = heapq.heappop(heap)
            j = after[i]
            if parts[i] != a or j >= n or parts[j] != b:
                continue  # one of the two has been merged meanwhile
            parts[i], parts[j] = int(self.merged[r]), -1
            after[i] = k = after[j]
            if k < n:
                before[k] = i
                if (r := rank_of.get(parts[i] << 32 | parts[k])) is not None:
                    heapq.heappush(heap, (r, i, parts[i], parts[k]))
            if (k := before[i]) >= 0 and (r := rank_of.get(parts[k] << 32 | parts[i])) is not None:
                heapq.heappush(heap, (r, k, parts[k], parts[i]))
        return [p for p in parts if p >= 0]

    def encode_words(self, words: list[str]) -> list[list[int]]:
        """The ids of pre-tokens."""
        out: list = [None] * len(words)
        by_length: dict[int, list[int]] = {}
        raw = [w.encode() for w in words]
        for k, b in enumerate(raw):
            if words[k] == self.special:
                out[k] = [self.special_id]
            elif len(b) > SHORT:
                out[k] = self.merge_long(self.first[np.frombuffer(b, np.uint8)].tolist())
            else:
                by_length.setdefault(len(b), []).append(k)
        for length, which in by_length.items():
            codes = np.frombuffer(b"".join(raw[k] for k in which), np.uint8).reshape(-1, length)
            for k, ids in zip(which, self.merge_rows(self.first[codes])):
                out[k] = ids
        return out

    def decode(self, ids) -> bytes:
        return b"".join(map(self.bytes.__getitem__, ids))


@lru_cache(maxsize=4)
def vocabulary(path: str) -> Vocabulary:
    return Vocabulary(path)


class _Digests:
    """Of each distinct word: its ids in decimal with commas, how many they are, and the bytes they decode to."""

    def __init__(self, path: str):
        self.vocabulary = vocabulary(path)
        self.digits = [b"%d," % i for i in range(len(self.vocabulary.bytes))]

    def clear(self) -> None:
        self.decimal, self.decoded, self.count = [], [], np.zeros(1 << 16, np.int64)

    def __call__(self, words: list[str]) -> None:
        at = len(self.decimal)
        if at + len(words) > len(self.count):
            self.count = np.concatenate((self.count, np.zeros(max(len(self.count), len(words)), np.int64)))
        found, digits = self.vocabulary.encode_words(words), self.digits.__getitem__
        self.count[at : at + len(words)] = list(map(len, found))
        self.decimal += [b"".join(map(digits, ids)) for ids in found]
        self.decoded += map(self.vocabulary.decode, found)


def _round_trips(path: str):
    def run(batches):
        seen = _Digests(path)
        memo = Memo(seen, MOST_WORDS)  # ends with the task: idle workers hold no words
        for batch, column in pieces(batches, "text"):
            chars = Chars(texts_of(column))
            starts = pretoken_starts(chars, seen.vocabulary.special)
            numbers = memo.numbers(chars, starts)
            first = np.searchsorted(starts, chars.offsets)
            total = np.concatenate(([0], np.cumsum(seen.count[numbers])))
            sizes = total[first[1:]] - total[first[:-1]]
            numbers, decimal, decoded = numbers.tolist(), seen.decimal.__getitem__, seen.decoded.__getitem__
            of_ids, of_text = [], []
            for a, b in zip(first[:-1].tolist(), first[1:].tolist()):
                part = numbers[a:b]
                of_ids.append(hashlib.sha256(b"".join(map(decimal, part))[:-1]).hexdigest())
                text = b"".join(map(decoded, part)).decode("utf-8", "replace")
                of_text.append(hashlib.sha256(text.encode()).hexdigest())
            yield pa.record_batch([batch.column(0), pa.array(sizes, pa.int64()), pa.array(of_ids), pa.array(of_text)], names=["doc_id", "n_tokens", "ids_sha256", "decoded_sha256"])

    return run


def round_trip_digests(docs: DataFrame, path: str, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(doc_id, n_tokens, ids_sha256, decoded_sha256): each whole text encoded, and its ids decoded again.

    A null text counts as empty: no tokens, digests of the empty string. Rows are independent of each
    other, so null or repeated ids and other columns of docs change nothing.
    """
    texts = docs.select(F.col(id_col).alias("doc_id"), F.col(text_col).cast("string").alias("text"))
    kind = texts.schema["doc_id"].dataType.simpleString()
    return texts.mapInArrow(_round_trips(path), f"doc_id {kind}, n_tokens long, ids_sha256 string, decoded_sha256 string")


def _ids(path: str, names: list[str]):
    def run(batches):
        words = vocabulary(path)
        for batch, column in pieces(batches, "text"):
            chars = Chars(texts_of(column))
            starts = pretoken_starts(chars, words.special)
            coded = chars.spans(starts).dictionary_encode()
            known, number = words.encode_words(coded.dictionary.to_pylist()), coded.indices.to_pylist()
            first = np.searchsorted(starts, chars.offsets)
            rows = [[i for k in number[a:b] for i in known[k]] for a, b in zip(first[:-1].tolist(), first[1:].tolist())]
            yield pa.record_batch([*(batch.column(n) for n in names), pa.array(rows, pa.list_(pa.int32()))], names=[*names, "ids"])

    return run


def encode(docs: DataFrame, path: str, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(doc_id, ids array<int>) of each row of docs; a null text has no ids."""
    texts = docs.select(F.col(id_col).alias("doc_id"), F.col(text_col).cast("string").alias("text"))
    return texts.mapInArrow(_ids(path, ["doc_id"]), f"doc_id {texts.schema['doc_id'].dataType.simpleString()}, ids array<int>")


def decode(rows: DataFrame, path: str, id_col: str = "doc_id", ids_col: str = "ids") -> DataFrame:
    """(doc_id, text) of rows with ids; null ids give an empty text, bytes that are no UTF-8 the replacement character."""

    def run(batches):
        words = vocabulary(path)
        for batch in batches:
            texts = [words.decode(x or ()).decode("utf-8", "replace") for x in batch.column(1).to_pylist()]
            yield pa.record_batch([batch.column(0), pa.array(texts, pa.string())], names=["doc_id", "text"])

    rows = rows.select(F.col(id_col).alias("doc_id"), F.col(ids_col).alias("ids"))
    return rows.mapInArrow(run, f"doc_id {rows.schema['doc_id'].dataType.simpleString()}, text string")
