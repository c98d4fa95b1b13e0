"""Token-id files: frequency-ranked ids in byte-aligned variable-length coding with separate control bytes.

An id is written as its rank by frequency over the whole corpus, so frequent ids
take one byte.  Four ranks share a control byte, two bits each for their lengths
of 1 to 4 bytes; control and data bytes are two separate streams, so a decoder
finds the lengths of four values with one table lookup.

A file is a Parquet table of blocks in ascending doc_id order (part, block):
doc_ids and counts of the documents in the block, the ids of its part before it,
and the two streams.  The rank
table is a second Parquet table beside it.  Both are read by Spark from any file
system, and a block can be decoded alone.
"""

from __future__ import annotations

import os
import uuid
import zlib
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from .bpe import byte_letters
from .bytetext import pieces
from .pretokens import Chars, Memo, pretoken_starts, texts_of
from .storage import shared_folder

#: Distinct pre-tokens that a Python worker remembers, at about 120 bytes each.
MOST_WORDS = 1_000_000
#: Lengths of the four values of each control byte.
LENGTHS = ((np.arange(256)[:, None] >> np.array([0, 2, 4, 6])) & 3).astype(np.uint8) + np.uint8(1)


def encode_ranks(ranks: np.ndarray) -> tuple[bytes, bytes]:
    """(control, data) of unsigned 32-bit ranks; the last control byte is filled up with zeros, which have no data."""
    ranks = ranks.astype("<u4")
    lengths = np.ones(len(ranks), np.uint8)
    for bits in (8, 16, 24):
        lengths += ranks >= np.uint32(1 << bits)
    codes = np.zeros(-(-len(ranks) // 4) * 4, np.uint8)
    codes[: len(ranks)] = lengths - 1
    control = (codes.reshape(-1, 4) << np.array([0, 2, 4, 6], np.uint8)).sum(axis=1, dtype=np.uint8)
    used = np.arange(4, dtype=np.uint8) < lengths[:, None]
    return control.tobytes(), ranks.view(np.uint8).reshape(-1, 4)[used].tobytes()


def decode_ranks(control: bytes, data: bytes, n: int) -> np.ndarray:
    lengths = LENGTHS[np.frombuffer(control, np.uint8)].reshape(-1)[:n]
    out = np.zeros((n, 4), np.uint8)
    out[np.arange(4, dtype=np.uint8) < lengths[:, None]] = np.frombuffer(data, np.uint8)
    return out.view("<u4").reshape(-1)


@lru_cache(maxsize=2)
def _tokenizer(path: str):
    os.environ["TOKENIZERS_PARALLELISM"] = "false"  # a task has one core
    from tokenizers import Tokenizer

    tokenizer = Tokenizer.from_file(path)
    tokenizer.no_padding()
    tokenizer.no_truncation()
    return tokenizer


class _Flat:
    """The ids of the distinct pre-tokens, one after the other; number 0 is the end of a document."""

    def __init__(self, path: str, end_id: int):
        self.tokenizer, self.end_id = _tokenizer(path), end_id
        special = self.tokenizer.get_added_tokens_decoder()
        if len(special) > 1:
            raise ValueError("at most one added token is supported")
        self.special_id, self.special = next(((i, t.content) for i, t in special.items()), (None, None))
        # The library's model works on one printable character for each byte.
        self.letters = {b: c for b, c in enumerate(byte_letters())}

    def clear(self) -> None:
        self.ids, self.used = np.zeros(1 << 20, np.int32), 0
        self.at, self.count, self.n = np.zeros(1 << 18, np.int64), np.zeros(1 << 18, np.int64), 0
        self._add([[self.end_id]])

    def _add(self, rows) -> None:
        sizes = np.array([len(r) for r in rows], np.int64)
        flat = np.array([i for r in rows for i in r], np.int32)
        if self.used + len(flat) > len(self.ids):
            self.ids = np.concatenate((self.ids, np.zeros(max(len(self.ids), len(flat)), np.int32)))
        if self.n + len(rows) > len(self.at):
            self.at, self.count = (np.concatenate((x, np.zeros(max(len(x), len(rows)), np.int64))) for x in (self.at, self.count))
        self.ids[self.used : self.used + len(flat)] = flat
        self.at[self.n : self.n + len(rows)] = self.used + np.cumsum(sizes) - sizes
        self.count[self.n : self.n + len(rows)] = sizes
        self.used, self.n = self.used + len(flat), self.n + len(rows)

    def __call__(self, words: list[str]) -> None:
        tokens, letters = self.tokenizer.model.tokenize, self.letters
        self._add([[self.special_id] if w == self.special else [t.id for t in tokens(w.encode().decode("latin-1").translate(letters))] for w in words])


@lru_cache(maxsize=2)
def _memo(path: str, end_id: int) -> Memo:
    return Memo(_Flat(path, end_id), MOST_WORDS)


def token_ids(column: pa.Array, path: str, end_id: int) -> tuple[np.ndarray, np.ndarray]:
    """(ids, counts): the ids of the texts one after the other, each with end_id behind it.

    The tokenizers library merges each pre-token by itself, so each distinct one is given to its model once.
    """
    memo = _memo(path, end_id)
    flat = memo.work
    chars = Chars(texts_of(column))
    starts = pretoken_starts(chars, flat.special)
    numbers = memo.numbers(chars, starts) + 1
    first = np.searchsorted(starts, chars.offsets)
    numbers = np.insert(numbers, first[1:], 0)
    sizes = flat.count[numbers]
    total = np.concatenate(([0], np.cumsum(sizes)))
    ids = flat.ids[np.arange(total[-1]) + np.repeat(flat.at[numbers] - total[:-1], sizes)]
    bounds = total[first + np.arange(len(first))]
    return ids, np.diff(bounds)


def _count(path: str, end_id: int):
    def run(batches):
        counts = np.zeros(1 << 16, np.int64)
        for _, column in pieces(batches, "text"):
            ids, _ = token_ids(column, path, end_id)
            more = np.bincount(ids, minlength=len(counts))
            if len(more) > len(counts):
                counts = np.concatenate((counts, np.zeros(len(more) - len(counts), np.int64)))
            counts += more
        seen = np.flatnonzero(counts)
        yield pa.record_batch([pa.array(seen, pa.int64()), pa.array(counts[seen], pa.int64())], names=["id", "n"])

    return run


def frequency_ranks(docs: DataFrame, path: str, end_id: int) -> DataFrame:
    """(id, n, rank): all ids that occur in docs (doc_id, text), the most frequent first; at most one row for each id of the vocabulary."""
    counts = docs.select("text").mapInArrow(_count(path, end_id), "id long, n long").groupBy("id").agg(F.sum("n").alias("n"))
    return counts.select("id", "n", (F.row_number().over(W.orderBy(F.desc("n"), "id")) - 1).alias("rank"))


def _blocks(path: str, end_id: int, ranks):
    def run(batches):
        part, block, before, table = TaskContext.get().partitionId(), 0, 0, ranks.value
        for batch, column in pieces(batches, "text"):
            ids, counts = token_ids(column, path, end_id)
            control, data = encode_ranks(table[ids])
            row = {"part": part, "block": block, "doc_ids": batch.column(0).to_pylist(), "counts": counts.tolist(), "before": before, "n_ids": len(ids), "control": control, "data": data}
            block, before = block + 1, before + len(ids)
            yield pa.RecordBatch.from_pylist([row], schema=_BLOCK)

    return run


_BLOCK = pa.schema([("part", pa.int32()), ("block", pa.int64()), ("doc_ids", pa.list_(pa.int64())), ("counts", pa.list_(pa.int64())), ("before", pa.int64()), ("n_ids", pa.int64()), ("control", pa.binary()), ("data", pa.binary())])


def write(docs: DataFrame, folder: str, path: str, end_id: int, id_col: str = "doc_id", text_col: str = "text") -> None:
    """Writes the ids of docs to folder/ids and the rank table to folder/ranks.

    The texts are dealt by ranges of (doc_id, hash of the text, a number of the row), so that rows that share an
    id, and even equal rows, spread as well.
    """
    spark = docs.sparkSession
    docs = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).cast("string").alias("text"))
    frequency_ranks(docs, path, end_id).write.parquet(f"{folder}/ranks")
    table = spark.read.parquet(f"{folder}/ranks").select("id", "rank").toPandas()  # bounded by the vocabulary
    rank_of = np.zeros(int(table["id"].max()) + 1 if len(table) else 1, np.uint32)
    rank_of[table["id"]] = table["rank"]
    n = int(spark.conf.get("spark.sql.shuffle.partitions"))
    keys = ["doc_id", "h", "row"]
    ordered = docs.withColumns({"h": F.xxhash64("text"), "row": F.monotonically_increasing_id()}).repartitionByRange(n, *keys).sortWithinPartitions(*keys).drop("h", "row")
    blocks = ordered.mapInArrow(_blocks(path, end_id, spark.sparkContext.broadcast(rank_of)), "part int, block long, doc_ids array<long>, counts array<long>, before long, n_ids long, control binary, data binary")
    blocks.write.option("compression", "none").parquet(f"{folder}/ids")


def _documents(id_of):
    def run(batches):
        table = id_of.value
        for batch in batches:
            for i in range(batch.num_rows):  # one block at a time
                row = batch.slice(i, 1).to_pylist()[0]
                ids = table[decode_ranks(row["control"], row["data"], row["n_ids"])]
                starts = np.cumsum([0, *row["counts"]])
                crcs = [zlib.crc32(ids[a:b].tobytes()) for a, b in zip(starts[:-1].tolist(), starts[1:].tolist())]
                yield pa.record_batch([pa.array(row["doc_ids"], pa.int64()), pa.array(starts[:-1] + row["start"], pa.int64()), pa.array(row["counts"], pa.int64()), pa.array(crcs, pa.int64())], names=["doc_id", "start", "n_tokens", "ids_crc32"])

    return run


def read_index(spark: SparkSession, folder: str) -> DataFrame:
    """(doc_id, start, n_tokens, ids_crc32) of a file, from its decoded ids; start counts the ids of all documents before."""
    blocks = spark.read.parquet(f"{folder}/ids")
    table = spark.read.parquet(f"{folder}/ranks").select("id", "rank").toPandas()
    id_of = np.zeros(len(table), "<u4")
    id_of[table["rank"]] = table["id"]
    # One row for each part, of which there are as many as shuffle partitions.
    parts = blocks.groupBy("part").agg(F.sum("n_ids").alias("n")).select("part", (F.sum("n").over(W.orderBy("part")) - F.col("n")).alias("ahead"))
    starts = blocks.join(F.broadcast(parts), "part").withColumn("start", F.col("ahead") + F.col("before"))
    return starts.select("doc_ids", "counts", "n_ids", "control", "data", "start").mapInArrow(_documents(spark.sparkContext.broadcast(id_of)), "doc_id long, start long, n_tokens long, ids_crc32 long")


def written_index(docs: DataFrame, path: str, end_id: int = 2, folder: str | None = None) -> DataFrame:
    """Writes docs to files and returns read_index() of them.

    A null text counts as empty and has the end id only. Null ids come first, rows of one id in the order
    of the hashes of their texts. An empty table gives empty files. Other columns of docs aren't written.
    """
    folder = folder or f"{shared_folder(docs.sparkSession)}/tokens-{uuid.uuid4().hex}"
    write(docs, folder, path, end_id)
    return read_index(docs.sparkSession, folder)
