"""Cross-tokenizer alignment: which tokens of two tokenizers cover the same bytes.

Each text is encoded by a byte-level BPE (A) and by a sentencepiece model (B).  The tokens of both are merged
by their byte ends, as two sorted lists are: in a step, the current A and B token of a document are linked, the
one that ends first goes on, and where both end together the text is cut into groups.  The steps are taken for
all documents of a block at once.  The state is one array of A places and one of B places; finished documents
leave the arrays.  A long document is dealt into lanes at ends that A and B share, so it doesn't run on alone.

How often a pair of ids is linked, counted in documents, needs the whole corpus.  A block of documents keeps
its distinct pairs, and how many of its documents hold each.  These are summed by pair, and the sums go back to
the blocks that asked for them, so a frequent pair makes a row for each block and not for each document, no
task sees all pairs of a corpus, and nothing is broadcast.
"""

from __future__ import annotations

import hashlib
import os
from collections.abc import Callable, Sequence
from functools import lru_cache

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_schema
from pyspark.sql.types import StructType

from .bpe import byte_letters
from .bytetext import pieces, release_memory
from .pretokens import Chars, Memo, pretoken_starts
from .storage import saved

SPACE = "▁"
#: Distinct words of each tokenizer that a Python worker remembers, at about 150 bytes each.
MOST_WORDS = 300_000
#: Text of the documents that share a table of pairs; a longer document is a block by itself.
BLOCK_BYTES = 4 << 20
#: A tokens of a lane, about: a longer document is dealt into several.
LANE = 512


class Encoded:
    """The ids of distinct words one after the other, and whether their bytes are those of the word."""

    def __init__(self, encode: Callable[[list[str]], list[list[int]]], token_bytes: Sequence[bytes]):
        self.encode, self.bytes = encode, token_bytes

    def clear(self) -> None:
        self.ids, self.used = np.zeros(1 << 18, np.int32), 0
        self.at, self.count, self.same, self.n = np.zeros(1 << 16, np.int64), np.zeros(1 << 16, np.int64), np.zeros(1 << 16, bool), 0

    def __call__(self, words: list[str]) -> None:
        rows = self.encode(words)
        sizes = np.array([len(r) for r in rows], np.int64)
        flat = np.array([i for r in rows for i in r], np.int32)
        self.ids = _room(self.ids, self.used + len(flat))
        self.at, self.count, self.same = (_room(x, self.n + len(rows)) for x in (self.at, self.count, self.same))
        self.ids[self.used : self.used + len(flat)] = flat
        part, of = slice(self.n, self.n + len(rows)), self.bytes.__getitem__
        self.at[part] = self.used + np.cumsum(sizes) - sizes
        self.count[part] = sizes
        self.same[part] = [b"".join(map(of, r)) == w.encode() for r, w in zip(rows, words)]
        self.used, self.n = self.used + len(flat), self.n + len(rows)


def _room(x: np.ndarray, n: int) -> np.ndarray:
    return x if n <= len(x) else np.concatenate((x, np.zeros(max(len(x), n - len(x)), x.dtype)))


class Tokenizer:
    """Encodes many texts at once by their distinct words; `starts` says where the words of some texts begin."""

    def __init__(self, encode, token_bytes: Sequence[bytes], starts: Callable[[Chars], np.ndarray]):
        self.memo, self.starts = Memo(Encoded(encode, token_bytes), MOST_WORDS), starts
        self.sizes = np.array([len(b) for b in token_bytes], np.int64)

    def tokens(self, chars: Chars) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """(ids, how many each text has, whether their bytes are those of the text)."""
        found, starts = self.memo.work, self.starts(chars)
        numbers = self.memo.numbers(chars, starts)
        first = np.searchsorted(starts, chars.offsets)
        sizes = found.count[numbers]
        total = np.concatenate(([0], np.cumsum(sizes)))
        ids = found.ids[np.arange(total[-1]) + np.repeat(found.at[numbers] - total[:-1], sizes)]
        wrong = np.concatenate(([0], np.cumsum(~found.same[numbers])))
        return ids, np.diff(total[first]), np.diff(wrong[first]) == 0


@lru_cache(maxsize=2)
def byte_bpe(path: str) -> Tokenizer:
    """A byte-level BPE in the tokenizers library's format; its pre-tokens are merged one by one by the library."""
    os.environ["TOKENIZERS_PARALLELISM"] = "false"  # a task has one core
    import tokenizers

    library = tokenizers.Tokenizer.from_file(path)
    letters = dict(enumerate(byte_letters()))
    of_letter = {c: b for b, c in letters.items()}
    table = [b""] * library.get_vocab_size()
    for token, i in library.get_vocab(with_added_tokens=False).items():
        table[i] = bytes(of_letter[c] for c in token)
    merge = library.model.tokenize
    encode = lambda words: [[t.id for t in merge(w.encode().decode("latin-1").translate(letters))] for w in words]
    return Tokenizer(encode, table, pretoken_starts)


@lru_cache(maxsize=2)
def piece_bpe(path: str) -> Tokenizer:
    """A sentencepiece model that adds a space in front of a text.

    Where no piece has a space behind another character, a space after one begins a word that is encoded by
    itself; the model adds the space that is left out.
    """
    import sentencepiece

    model = sentencepiece.SentencePieceProcessor(model_file=path)
    names = [model.id_to_piece(i) for i in range(model.get_piece_size())]
    table = [bytes([int(p[3:5], 16)]) if model.is_byte(i) else p.replace(SPACE, " ").encode() for i, p in enumerate(names)]
    alone = [model.piece_to_id(SPACE)]
    by_words = all(SPACE not in p.lstrip(SPACE) for p in names)

    def encode(words: list[str]) -> list[list[int]]:
        out = model.encode([w[1:] for w in words], num_threads=1)
        return [ids if len(w) > 1 else alone for w, ids in zip(words, out)]

    def starts(chars: Chars) -> np.ndarray:
        first = np.zeros(len(chars.points) + 1, bool)
        if by_words:
            blank = chars.points == 32
            first[1:-1] = blank[1:] & ~blank[:-1] & (chars.points[:-1] != ord(SPACE))
        first[chars.offsets] = True
        return np.flatnonzero(first[:-1])

    return Tokenizer(encode, table, starts)


def lanes(a_ends: np.ndarray, b_ends: np.ndarray, a_first: np.ndarray, b_first: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The first A and B tokens of the lanes: those of the texts, and of parts of the long ones that begin where both tokenizers have an end."""
    a, b = a_first[:-1], b_first[:-1]
    if np.diff(a_first).max(initial=0) > LANE:
        at_b = np.minimum(np.searchsorted(b_ends, a_ends), len(b_ends) - 1)
        at_a = np.flatnonzero(b_ends[at_b] == a_ends)
        at_b = at_b[at_a]
        text = np.searchsorted(a_first, at_a, "right") - 1
        part = (at_a - a_first[text]) // LANE
        new = np.flatnonzero((text[1:] == text[:-1]) & (part[1:] > part[:-1]))
        a, b = np.sort(np.append(a, at_a[new] + 1)), np.sort(np.append(b, at_b[new] + 1))
    return a, b


def lockstep(a_ends: np.ndarray, b_ends: np.ndarray, a_first: np.ndarray, b_first: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """(A place, B place) of all links, and which A and B tokens end at a cut.

    The ends count bytes from the beginning of the block; text i has the A tokens from a_first[i] on and the B
    tokens from b_first[i] on, and both cover it.
    """
    some = np.flatnonzero(np.diff(a_first))
    a_first, b_first = np.append(a_first[some], a_first[-1]), np.append(b_first[some], b_first[-1])
    i, j = lanes(a_ends, b_ends, a_first, b_first)
    stop = np.append(i[1:], len(a_ends))
    a_cut, b_cut = np.zeros(len(a_ends), bool), np.zeros(len(b_ends), bool)
    links_a, links_b = [], []
    while len(i):
        links_a.append(i)
        links_b.append(j)
        ends_a, ends_b = a_ends[i], b_ends[j]
        go_a, go_b = ends_a <= ends_b, ends_b <= ends_a
        both = go_a & go_b
        a_cut[i[both]] = b_cut[j[both]] = True
        i, j = i + go_a, j + go_b
        live = i < stop
        if not live.all():
            i, j, stop = i[live], j[live], stop[live]
    nothing = [np.zeros(0, np.int64)]
    return np.concatenate(links_a or nothing), np.concatenate(links_b or nothing), a_cut, b_cut


def joined(a: np.ndarray, b: np.ndarray, a_cut: np.ndarray, b_cut: np.ndarray, a_first: np.ndarray, b_first: np.ndarray, table: list[bytes]) -> list[bytes]:
    """The groups of each text as `a1,a2|b1;a3|b2`. `table` has the decimal ids with a comma, then with a bar, then with a semicolon behind."""
    n = len(table) // 3
    last_a, last_b = np.append(0, np.flatnonzero(a_cut) + 1), np.append(0, np.flatnonzero(b_cut) + 1)
    group_a, group_b = np.cumsum(a_cut) - a_cut, np.cumsum(b_cut) - b_cut
    codes = np.empty(len(a) + len(b), np.int64)
    codes[np.arange(len(a)) + last_b[group_a]] = a + n * a_cut
    codes[np.arange(len(b)) + last_a[group_b + 1]] = b + 2 * n * b_cut
    codes, of, first = codes.tolist(), table.__getitem__, (a_first + b_first).tolist()
    return [b"".join(map(of, codes[s:e]))[:-1] for s, e in zip(first[:-1], first[1:])]


@lru_cache(maxsize=2)
def _decimals(n: int) -> list[bytes]:
    return [b"%d%s" % (i, c) for c in (b",", b"|", b";") for i in range(n)]


class _Documents:
    """What is kept of the documents of a block."""

    def __init__(self, a: Tokenizer, b: Tokenizer):
        self.a, self.b = a, b
        self.table = _decimals(max(len(a.sizes), len(b.sizes)))
        self.clear()

    def clear(self) -> None:
        self.ids, self.bytes, self.n = [], 0, 0
        self.counts: list[list] = [[], [], [], [], []]  # n_a, n_b, n_groups, n_links, groups_sha256
        self.keys, self.docs = [], []

    def add(self, ids: list, texts: list[str | None]) -> None:
        """Aligns some documents; those without tokens, and those that a tokenizer doesn't give back, have none."""
        chars = Chars([" " + t if t else "" for t in texts])
        a, n_a, same_a = self.a.tokens(chars)
        b, n_b, same_b = self.b.tokens(chars)
        good = same_a & same_b
        if not good.all():
            a, b = a[np.repeat(good, n_a)], b[np.repeat(good, n_b)]
            n_a, n_b = n_a * good, n_b * good
        a_first, b_first = np.append(0, np.cumsum(n_a)), np.append(0, np.cumsum(n_b))
        at_a, at_b, a_cut, b_cut = lockstep(np.cumsum(self.a.sizes[a]), np.cumsum(self.b.sizes[b]), a_first, b_first)
        doc_of = np.repeat(np.arange(len(texts)), n_a)
        doc = doc_of[at_a]
        n_links, n_groups = np.bincount(doc, minlength=len(texts)), np.bincount(doc_of[a_cut], minlength=len(texts))
        digests = [hashlib.sha256(x).hexdigest() if x else "" for x in joined(a, b, a_cut, b_cut, a_first, b_first, self.table)]
        for kept, more in zip(self.counts, (n_a, n_b, n_groups, n_links, digests)):
            kept += more if isinstance(more, list) else more.tolist()
        self.keys.append(a[at_a].astype(np.int64) << 32 | b[at_b])
        self.docs.append(doc + self.n)
        self.ids += ids
        self.n += len(texts)
        self.bytes += len(chars.points)

    def block(self, number: int, schema: pa.Schema) -> pa.RecordBatch:
        """The block as a row: its documents, their distinct pairs with numbers and times, and the pairs."""
        coded = pa.array(np.concatenate(self.keys)).dictionary_encode()
        pairs = coded.dictionary.to_numpy()
        order = np.argsort(pairs)
        pairs, n = pairs[order], max(len(pairs), 1)
        number_of = np.argsort(order)[coded.indices.to_numpy()]
        counted = pc.value_counts(pa.array(np.concatenate(self.docs) * n + number_of))
        held, times = counted.field("values").to_numpy(), counted.field("counts").to_numpy()
        order = np.argsort(held)
        held, times = held[order], times[order]
        row = dict(zip(["n_a", "n_b", "n_groups", "n_links", "groups_sha256"], self.counts))
        row |= {"block": number, "doc_id": self.ids, "n_pairs": np.bincount(held // n, minlength=self.n).tolist()}
        row |= {"pair_of": (held % n).astype("<i4").tobytes(), "times": times.astype("<i4").tobytes(), "pairs": pairs, "docs": np.bincount(held % n, minlength=len(pairs))}
        self.clear()
        return pa.RecordBatch.from_arrays([pa.array([row[f.name]], f.type) for f in schema], schema=schema)


_BLOCK = "block long, doc_id array<{kind}>, n_a array<long>, n_b array<long>, n_groups array<long>, n_links array<long>, groups_sha256 array<string>, n_pairs array<long>, pair_of binary, times binary, pairs array<long>, docs array<long>"


def blocks(docs: DataFrame, a_path: str, b_path: str) -> DataFrame:
    """The aligned documents of docs (doc_id, text) in blocks, written as a table."""
    kind = docs.schema["doc_id"].dataType.simpleString()
    schema = StructType.fromDDL(_BLOCK.format(kind=kind))
    arrow = to_arrow_schema(schema)

    def run(batches):
        kept, number = _Documents(byte_bpe(a_path), piece_bpe(b_path)), TaskContext.get().partitionId() << 32
        for batch, column in pieces(batches, "text"):
            kept.add(batch.column(0).to_pylist(), column.to_pylist())
            if kept.bytes >= BLOCK_BYTES:
                yield kept.block(number, arrow)
                number += 1
        if kept.n:
            yield kept.block(number, arrow)
        release_memory()

    return saved(docs.mapInArrow(run, schema), "aligned")


def pair_counts(aligned: DataFrame) -> DataFrame:
    """(pair, n, best): in how many documents each pair of ids is linked, and whether no pair of its A id is in more; pair is a * 2**32 + b."""
    each = aligned.select(F.explode(F.arrays_zip("pairs", "docs")).alias("x")).select("x.pairs", "x.docs")
    counts = each.groupBy(F.col("pairs").alias("pair")).agg(F.sum("docs").alias("n"))
    # An A id has a partition of one row for each B id at most.
    return counts.withColumn("best", F.col("n") == F.max("n").over(W.partitionBy(F.shiftright("pair", 32))))


def _scored(names: list[str]):
    def run(block: pa.Table, answers: pa.Table) -> pa.Table:
        row = {n: block.column(n).combine_chunks() for n in block.column_names}
        order = np.argsort(answers.column("pair").to_numpy())
        counts, best = answers.column("n").to_numpy()[order], answers.column("best").to_numpy()[order]
        pair_of, times = (np.frombuffer(row[k][0].as_py(), "<i4") for k in ("pair_of", "times"))
        n_pairs = row["n_pairs"].flatten().to_numpy()
        first = np.append(0, np.cumsum(n_pairs))
        links = lambda x: (t := np.append(0, np.cumsum(x)))[first[1:]] - t[first[:-1]]
        totals = {"n_best": links(times * best[pair_of]), "count_sum": links(times * counts[pair_of])}
        return pa.table({n: pa.array(totals[n], pa.int64()) if n in totals else row[n].flatten() for n in names})

    return run


def aligned_counts(docs: DataFrame, a_path: str, b_path: str, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(doc_id, n_a, n_b, n_groups, n_links, n_best, count_sum, groups_sha256) of each whole text.

    Null and empty texts have no tokens: zeros and an empty digest. So have texts that a tokenizer doesn't give
    back byte by byte, as those with U+2581. Every row is a document, so repeated rows count as often as they
    occur, and null or repeated ids change nothing; nor do other columns. An empty table gives no rows.
    """
    texts = docs.select(F.col(f"`{id_col}`").alias("doc_id"), F.col(f"`{text_col}`").cast("string").alias("text"))
    aligned = blocks(texts, a_path, b_path)
    asked = aligned.select(F.col("block").alias("by"), F.explode("pairs").alias("pair"))
    answers = asked.join(pair_counts(aligned).hint("shuffle_hash"), "pair").select("by", "pair", "n", "best")
    names = ["doc_id", "n_a", "n_b", "n_groups", "n_links", "n_best", "count_sum", "groups_sha256"]
    kind = texts.schema["doc_id"].dataType.simpleString()
    schema = ", ".join(f"{n} {kind if n == 'doc_id' else 'string' if n == 'groups_sha256' else 'long'}" for n in names)
    return aligned.drop("pairs", "docs").groupBy("block").cogroup(answers.groupBy("by")).applyInArrow(_scored(names), schema)
