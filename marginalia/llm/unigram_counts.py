"""Token counts of a unigram tokenizer without building its tokens.

The best segmentation maximises the sum of the piece scores.  An Aho-Corasick
automaton lists every vocabulary piece that ends at a character, longest first,
and a forward pass carries only the best score and the number of its pieces.

Tie rules are those of the tokenizers library's unigram model: a path replaces
another only if its score is strictly higher, and paths are tried in the order
of their starts, so the longer last piece wins.  A character that is no piece
scores ten less than the lowest piece and counts its UTF-8 bytes (byte fallback).

A boundary that no piece crosses cannot change the segmentation on its two
sides, so texts are cut there and equal chunks of a task are worked out once.
Sums of scores may round differently from the start of a chunk than from the
start of the text.  Where all scores are whole numbers nothing is rounded, but for texts of
millions of characters, which are worked out whole; else those are that have a
chunk in which two paths come closer than CLOSE.
"""

from __future__ import annotations

from array import array
from functools import lru_cache
from itertools import chain

import ahocorasick
import numpy as np
import pyarrow as pa
import sentencepiece
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .bytetext import pieces
from .pretokens import Chars, Memo, texts_of

SPACE = "▁"
#: Distinct chunks that a Python worker remembers, at about 100 bytes each.
MOST_CHUNKS = 1_000_000
UNKNOWN_PENALTY = 10.0
#: Scores that differ by less may be in another order after rounding.
CLOSE = 1e-6


def pieces_of(path: str) -> list[tuple[str, float]]:
    """The pieces and scores of a sentencepiece file."""
    model = sentencepiece.SentencePieceProcessor(model_file=path)
    return [(model.id_to_piece(i), float(model.get_score(i))) for i in range(model.get_piece_size())]


class Vocabulary:
    def __init__(self, scored: list[tuple[str, float]]):
        self.automaton = ahocorasick.Automaton()
        best: dict[str, float] = {}
        for piece, score in scored:
            best[piece] = score
        for piece, score in best.items():
            if piece:
                self.automaton.add_word(piece, (len(piece), score))
        self.automaton.make_automaton()
        self.single = {p for p in best if len(p) == 1}
        self.unknown = min(best.values(), default=0.0) - UNKNOWN_PENALTY
        # Sums of whole numbers (or of 1024ths) below 2**53 aren't rounded: texts up to this length have exact scores.
        unit = next((u for u in (1, 1024) if all(float(s * u).is_integer() for s in best.values())), None)
        self.exact_chars = int(2**53 / unit / max(abs(self.unknown), 1)) if unit else 0
        pairs = {p[i : i + 2] for p in best for i in range(len(p) - 1)}
        letters = sorted({c for p in pairs for c in p})
        #: The number of each character that stands beside another in a piece, 0 for all others.
        self.number = np.zeros(0x110000, np.int32)
        self.number[[ord(c) for c in letters]] = np.arange(1, len(letters) + 1)
        self.joined = np.zeros((len(letters) + 1, len(letters) + 1), bool)
        for a, b in pairs:
            self.joined[self.number[ord(a)], self.number[ord(b)]] = True

    def starts(self, chars: Chars) -> np.ndarray:
        """Where no piece crosses."""
        if not len(chars.points):
            return np.zeros(0, np.int64)
        number = self.number[chars.points]
        start = np.ones(len(number), bool)
        start[1:] = ~self.joined[number[:-1], number[1:]]
        edges = chars.offsets[:-1]
        start[edges[edges < len(start)]] = True
        return np.flatnonzero(start)

    def best(self, text: str) -> tuple[int, float, bool]:
        """(tokens, score, close) of the best segmentation; `close` if two paths to a place nearly tie."""
        n, close, watch = len(text), False, not self.exact_chars
        score, count = array("d", bytes(8 * n + 8)), array("q", bytes(8 * n + 8))
        single, unknown, at = self.single, self.unknown, 0  # the best paths to positions before `at` are final
        for end, (length, value) in chain(self.automaton.iter(text), [(n, (0, 0.0))]):
            if end >= at:
                if at and text[at - 1] not in single:  # a path by a character that is no piece is tried last
                    s = score[at - 1] + unknown
                    close |= watch and abs(s - score[at]) < CLOSE
                    if s > score[at]:
                        score[at], count[at] = s, count[at - 1] + len(text[at - 1].encode())
                for k in range(at, end):  # no piece ends after these characters
                    score[k + 1], count[k + 1] = score[k] + unknown, count[k] + len(text[k].encode())
                if end == n:
                    return count[n], score[n], close
                at = end + 1
                score[at], count[at] = score[at - length] + value, count[at - length] + 1
            else:
                s = score[at - length] + value
                if watch and abs(s - score[at]) < CLOSE:
                    close = True
                if s > score[at]:
                    score[at], count[at] = s, count[at - length] + 1
        raise AssertionError("the last end is the text's")


class _Counts:
    def __init__(self, vocabulary: Vocabulary):
        self.vocabulary = vocabulary

    def clear(self) -> None:
        self.n, self.count, self.score, self.close = 0, np.zeros(1 << 18, np.int64), np.zeros(1 << 18), np.zeros(1 << 18, bool)

    def __call__(self, chunks: list[str]) -> None:
        if self.n + len(chunks) > len(self.count):
            self.count, self.score, self.close = (np.concatenate((x, np.zeros(max(len(x), len(chunks)), x.dtype))) for x in (self.count, self.score, self.close))
        found, part = [self.vocabulary.best(c) for c in chunks], slice(self.n, self.n + len(chunks))
        self.count[part], self.score[part], self.close[part] = zip(*found)
        self.n += len(chunks)


@lru_cache(maxsize=2)
def vocabulary(path: str) -> Vocabulary:
    return Vocabulary(pieces_of(path))


@lru_cache(maxsize=2)
def _memo(path: str) -> Memo:
    return Memo(_Counts(vocabulary(path)), MOST_CHUNKS)


def totals(texts: list[str], memo: Memo) -> tuple[list[int], list[float]]:
    """(counts, scores) of whole texts."""
    seen = memo.work
    chars = Chars([SPACE + t.replace(" ", SPACE) if t else "" for t in texts])
    starts = seen.vocabulary.starts(chars)
    numbers = memo.numbers(chars, starts)
    first = np.searchsorted(starts, chars.offsets)
    counts, scores = [], []
    for k, (a, b) in enumerate(zip(first[:-1].tolist(), first[1:].tolist())):
        part = numbers[a:b]  # sums of one text at a time, so that its score doesn't depend on the texts beside it
        count, score = int(seen.count[part].sum()), float(seen.score[part].sum())
        if seen.close[part].any() or 0 < seen.vocabulary.exact_chars < chars.offsets[k + 1] - chars.offsets[k]:
            count, score, _ = seen.vocabulary.best(chars.text[chars.offsets[k] : chars.offsets[k + 1]])
        counts.append(count)
        scores.append(score)
    return counts, scores


def _count(path: str):
    def run(batches):
        memo = _memo(path)
        for batch, column in pieces(batches, "text"):
            texts = texts_of(column)
            counts, scores = totals(texts, memo)
            yield pa.record_batch([batch.column("doc_id"), pa.array(list(map(len, texts)), pa.int64()), pa.array(counts, pa.int64()), pa.array(scores, pa.float64())], names=["doc_id", "n_chars", "n_tokens", "score"])

    return run


def token_counts(docs: DataFrame, path: str, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(doc_id, n_chars, n_tokens, score) of each whole text under the pieces and scores of a sentencepiece file.

    The file may hold any kind of model: its pieces and scores are read as a unigram vocabulary.
    A space in front is added and spaces are written as U+2581, as the file's tokenizers do. A null or empty
    text has no tokens and score 0. Rows are independent of each other; other columns change nothing. An empty
    table gives no rows.
    """
    texts = docs.select(F.col(id_col).alias("doc_id"), F.col(text_col).cast("string").alias("text"))
    return texts.mapInArrow(_count(path), f"doc_id {texts.schema['doc_id'].dataType.simpleString()}, n_chars long, n_tokens long, score double")
