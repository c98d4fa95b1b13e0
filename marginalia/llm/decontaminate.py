"""Benchmark decontamination: a broadcast hash set of normalised test n-grams.

Words are the runs of letters, digits and non-ASCII characters after A-Z are
lower-cased.  A window is SIZE consecutive words of a benchmark item, or a whole
shorter item.  The hashes of the distinct windows form a sorted array; each task
hashes the windows of its documents, looks them up, and compares the words of
every hit with those of the window once, however many items and places have it.

The benchmark's size is summed before anything is sent.  Items that hold more
than BLOCK_BYTES of text are dealt into blocks of about that size, an item beyond
it in parts that overlap by a window less one word, and the
documents pass the blocks one after the other.  A task looks at CHAIN blocks at most;
then the documents are written with what was found, and the next blocks begin.  So
a task's memory has a bound for any benchmark, and a
benchmark of n blocks costs n / CHAIN passes.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .bytetext import ALNUM, Block, Words, pieces, window_hashes
from .storage import discard, saved

SIZE = 13
#: Benchmark text that is broadcast at a time.
BLOCK_BYTES = 4 << 20
#: Blocks that one pass over the documents takes.
CHAIN = 4
_SIEVE_BITS = 20


class Windows:
    """The distinct windows of some items and the items that have each, sorted by hash for each window size."""

    def __init__(self, items: list[tuple[str | None, str]], size: int = SIZE):
        self.items = [i for i, _ in items]
        words = Words(Block(pa.array([t for _, t in items], pa.string())), ALNUM)
        hashes, first = words.hashes(), words.first
        self.numbers, distinct = words.numbers()
        numbers, self.number_of = self.numbers, dict(zip(distinct, range(len(distinct))))
        length = np.diff(first)
        self.by_size: dict[int, tuple[np.ndarray, ...]] = {}
        for n in sorted({min(x, size) for x in length.tolist() if x}):
            which = np.flatnonzero((length >= n) if n == size else (length == n))
            counts = length[which] - n + 1
            owner = np.repeat(which, counts)
            start = np.arange(counts.sum()) + np.repeat(first[which] - np.cumsum(counts) + counts, counts)
            # Windows are numbered by their words, one word after the other; a window's items are listed once.
            window = numbers[start]
            for j in range(1, n):
                window = np.unique(window * len(numbers) + numbers[start + j], return_inverse=True)[1]
            _, at, window = np.unique(window, return_index=True, return_inverse=True)
            pairs = np.unique(window * len(items) + owner)
            keys = window_hashes(hashes, n)[start[at]]
            order = np.argsort(keys, kind="stable")
            low = np.searchsorted(pairs, order * len(items))
            high = np.searchsorted(pairs, (order + 1) * len(items))
            sieve = np.zeros(1 << _SIEVE_BITS, bool)
            sieve[keys >> np.uint64(64 - _SIEVE_BITS)] = True
            self.by_size[n] = (keys[order], start[at[order]], low, high, pairs % len(items), sieve)

    def hits(self, words: Words) -> tuple[list[tuple[int, int, int]], set[tuple[int, int]]]:
        """((text, first word, size) of each place where a window of the items stands, (text, item) of the items that have it).

        The hashes only say where to look: the words of a place are compared by their numbers among the words of the items.
        """
        hashes, mine = words.hashes(), None
        text_of = np.repeat(np.arange(len(words.first) - 1), np.diff(words.first))
        last = words.first[1:][text_of]  # where the text of each word ends
        places, found = [], set()
        for n, (keys, start, low, high, owners, sieve) in self.by_size.items():
            every = window_hashes(hashes, n)
            at = np.flatnonzero(sieve[every >> np.uint64(64 - _SIEVE_BITS)])
            at = at[at + n <= last[at]]
            a, b = np.searchsorted(keys, every[at]), np.searchsorted(keys, every[at], "right")
            if not (a < b).any():
                continue
            if mine is None:
                numbers, distinct = words.numbers()
                mine = np.array([self.number_of.get(w, -1) for w in distinct], np.int64)[numbers]
            sizes = b - a
            at, window = np.repeat(at, sizes), np.arange(sizes.sum()) + np.repeat(a - np.cumsum(sizes) + sizes, sizes)
            same = np.ones(len(at), bool)
            for j in range(n):
                same &= mine[at + j] == self.numbers[start[window] + j]
            at, window = at[same], window[same]
            texts = text_of[at]
            places += zip(texts.tolist(), (at - words.first[texts]).tolist(), [n] * len(at))
            for pair in np.unique(texts * len(keys) + window).tolist():
                text, k = divmod(pair, len(keys))
                found.update((text, i) for i in owners[low[k] : high[k]].tolist())
        return places, found


def cut(benchmark: DataFrame, id_col: str, text_col: str, size: int, part_bytes: int) -> DataFrame:
    """(item, text): the items, those of more than part_bytes in parts that share size - 1 words, so that each window lies in a part and no other arises."""

    def run(batches):
        for batch, column in pieces(batches, "text"):
            which, texts = [], []
            for k, text in enumerate(column.to_pylist()):
                if len(text) * 4 > part_bytes and len(raw := text.encode()) > part_bytes:
                    words = Words(Block(pa.array([text])), ALNUM)
                    a, n = 0, len(words.starts)
                    while n > size and a < n:
                        b = max(int(np.searchsorted(words.ends, words.starts[a] + part_bytes, "right")), a + size)
                        b = n if n - b < size else b
                        which.append(k)
                        texts.append(raw[words.starts[a] : words.ends[b - 1]].decode())
                        a = b - size + 1 if b < n else n
                    if n > size:
                        continue
                which.append(k)
                texts.append(text)
            yield pa.record_batch([batch.column(0).take(pa.array(which, pa.int64())), pa.array(texts, pa.string())], names=["item", "text"])

    items = benchmark.select(F.col(f"`{id_col}`").cast("string").alias("item"), F.col(f"`{text_col}`").cast("string").alias("text")).filter("text IS NOT NULL")
    return items.mapInArrow(run, "item string, text string")


def blocks(benchmark: DataFrame, id_col: str, text_col: str, size: int, block_bytes: int) -> Iterator[list[tuple[str | None, str]]]:
    """The items in blocks of about block_bytes, one block on the driver at a time."""
    items = cut(benchmark, id_col, text_col, size, block_bytes)
    total = items.agg(F.sum(F.octet_length("text")).alias("n")).first()["n"] or 0
    n = -(-total // block_bytes)
    if n > 1:
        items = saved(items.withColumn("b", F.pmod(F.xxhash64("item", "text"), F.lit(n))), "items")
    for b in range(n):
        yield [(r["item"], r["text"]) for r in (items.filter(F.col("b") == b) if n > 1 else items).select("item", "text").collect()]
    if n > 1:
        discard(items)


def _scan(windows, then=None):
    """Adds the hits of a block of items; `then` makes the output of each batch with its words, else it is passed on."""

    def run(batches):
        known = windows.value
        for batch, column in pieces(batches, "__text"):
            words = Words(Block(column), ALNUM)
            spans: list[list[int]] = [list(x or ()) for x in batch.column("__spans").to_pylist()]
            items: list[set] = [set(x or ()) for x in batch.column("__items").to_pylist()]
            places, found = known.hits(words)
            for doc, i, n in places:
                spans[doc] += (i, n)
            for doc, item in found:
                if known.items[item] is not None:
                    items[doc].add(known.items[item])
            columns = dict(zip(batch.schema.names, batch.columns))
            columns["__spans"] = pa.array([merged(x) for x in spans], pa.list_(pa.int32()))
            columns["__items"] = pa.array([sorted(x) for x in items], pa.list_(pa.string()))
            out = pa.record_batch(list(columns.values()), names=list(columns))
            yield then(out, column, words) if then else out

    return run


def _only(then):
    """`then` where there are no items to scan for."""

    def run(batches):
        for batch, column in pieces(batches, "__text"):
            yield then(batch, column, Words(Block(column), ALNUM))

    return run


def merged(spans: list[int]) -> list[int]:
    """Disjoint (first word, size) pairs that cover the same words."""
    out: list[int] = []
    for a, n in sorted(zip(spans[::2], spans[1::2])):
        if out and a <= out[-2] + out[-1]:
            out[-1] = max(out[-1], a + n - out[-2])
        else:
            out += (a, n)
    return out


def scanned(docs: DataFrame, benchmark: DataFrame, then, schema, size: int = SIZE, id_col: str = "doc_id", text_col: str = "text", item_col: str = "item_id", item_text_col: str = "text", block_bytes: int = BLOCK_BYTES) -> DataFrame:
    """What `then` makes of docs: the struct `row` of their columns, __id, __text, __spans (the words hit) and __items (the items found)."""
    row = F.struct(*[F.col(f"`{c}`") for c in docs.columns]) if docs.columns else F.lit(None)
    out = docs.select(row.alias("row"), F.col(f"`{id_col}`").alias("__id"), F.col(f"`{text_col}`").cast("string").alias("__text"), F.array().cast("array<int>").alias("__spans"), F.array().cast("array<string>").alias("__items"))
    every, spark, before, chained, written = blocks(benchmark, item_col, item_text_col, size, block_bytes), docs.sparkSession, None, 0, []
    for items in every:
        if before is not None:
            out, chained = out.mapInArrow(_scan(before), out.schema), chained + 1
            if chained % CHAIN == 0:
                out = saved(out, "scanned")
                written.append(out)
                discard(*written[:-1])
                del written[:-1]
        before = spark.sparkContext.broadcast(Windows(items, size))
    return out.mapInArrow(_scan(before, then) if before is not None else _only(then), schema)


def _report(batch: pa.RecordBatch, column: pa.Array, words: Words) -> pa.RecordBatch:
    n_words = np.diff(words.first)
    n_hit = np.array([sum(x[1::2]) for x in batch.column("__spans").to_pylist()], np.int64)
    items = batch.column("__items").to_pylist()
    digests = [hashlib.sha256(",".join(x).encode()).hexdigest() for x in items]
    return pa.record_batch([batch.column("__id"), pa.array(n_words, pa.int64()), pa.array(n_hit), pa.array([len(x) for x in items], pa.int64()), pa.array(digests), pa.array((n_hit > 0) & (20 * n_hit >= n_words))], names=["doc_id", "n_words", "n_hit", "n_items", "items_sha256", "contaminated"])


def contamination(docs: DataFrame, benchmark: DataFrame, size: int = SIZE, **columns) -> DataFrame:
    """(doc_id, n_words, n_hit, n_items, items_sha256, contaminated) of each row of docs.

    A null text has no words and a null item no windows; an empty benchmark hits nothing. An item without
    an id marks words but isn't counted; items that share an id count once. Rows are judged one by one, so
    repeated or null doc_ids and other columns change nothing. An empty table gives no rows.
    """
    id_col, text_col = columns.get("id_col", "doc_id"), columns.get("text_col", "text")
    docs = docs.select(*[F.col(f"`{c}`") for c in dict.fromkeys((id_col, text_col))])
    kind = docs.schema[id_col].dataType.simpleString()
    return scanned(docs, benchmark, _report, f"doc_id {kind}, n_words long, n_hit long, n_items long, items_sha256 string, contaminated boolean", size, **columns)


def _clean(text_col: str, names: list[str], mode: str):
    def then(batch: pa.RecordBatch, column: pa.Array, words: Words) -> pa.RecordBatch:
        n_words = np.diff(words.first)
        spans = batch.column("__spans").to_pylist()
        keep = np.array([not x or 20 * sum(x[1::2]) < n for x, n in zip(spans, n_words.tolist())], bool)
        row = batch.column("row")
        out = pa.RecordBatch.from_arrays(row.flatten(), names=names)
        if mode == "documents":
            return out.filter(pa.array(keep))
        texts, block = column.to_pylist(), Block(column)
        for k in np.flatnonzero(~keep).tolist():
            low, high, at = int(block.offsets[k]), int(block.offsets[k + 1]), int(words.first[k])
            kept, raw = [], block.bytes
            for a, n in zip(spans[k][::2], spans[k][1::2]):
                kept.append(raw[low : words.starts[at + a]].tobytes())
                low = int(words.ends[at + a + n - 1])
            texts[k] = b"".join([*kept, raw[low:high].tobytes()]).decode()
        return out.set_column(names.index(text_col), text_col, pa.array(texts, out.schema.field(text_col).type))

    return then


def decontaminated(docs: DataFrame, benchmark: DataFrame, mode: str = "documents", size: int = SIZE, text_col: str = "text", **columns) -> DataFrame:
    """docs without contaminated documents (mode "documents"), or without the words hit in them (mode "spans").

    A document is contaminated if a word is hit and a twentieth of its words or more are. Others stay as they are,
    null and empty texts too, and so do repeated rows; columns may have any name, and empty tables stay empty.
    """
    if mode not in ("documents", "spans"):
        raise ValueError(f"the mode is documents or spans, not {mode!r}")
    return scanned(docs, benchmark, _clean(text_col, docs.columns, mode), docs.schema, size, text_col=text_col, **columns)


_WORDS = r"regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+')"
#: The rows of contamination() over the tables documents and benchmark in DuckDB's SQL.
ORACLE_SQL = f"""
WITH d AS (SELECT doc_id, {_WORDS} AS w FROM documents), b AS (SELECT item_id, w, least(len(w), {SIZE}) AS n FROM (SELECT item_id, {_WORDS} AS w FROM benchmark) WHERE len(w) > 0),
win AS (SELECT DISTINCT item_id, n, array_to_string(w[i:i + n - 1], ' ') AS s FROM (SELECT item_id, w, n, unnest(range(1, len(w) - n + 2)) AS i FROM b)),
x AS (SELECT doc_id, n, i, array_to_string(w[i:i + n - 1], ' ') AS s FROM (SELECT doc_id, w, n, unnest(range(1, len(w) - n + 2)) AS i FROM d, (SELECT DISTINCT n FROM win))),
hit AS (SELECT doc_id, i, n, item_id FROM x JOIN win USING (n, s)),
h AS (SELECT doc_id, count(DISTINCT p) AS n_hit FROM (SELECT doc_id, unnest(range(i, i + n)) AS p FROM hit) GROUP BY doc_id),
t AS (SELECT doc_id, count(*) AS n_items, string_agg(item, ',' ORDER BY item) AS items FROM (SELECT DISTINCT doc_id, item_id::VARCHAR AS item FROM hit) GROUP BY doc_id)
SELECT doc_id, len(w)::BIGINT AS n_words, coalesce(n_hit, 0)::BIGINT AS n_hit, coalesce(n_items, 0)::BIGINT AS n_items, sha256(coalesce(items, '')) AS items_sha256,
  coalesce(n_hit, 0) > 0 AND 20 * coalesce(n_hit, 0) >= len(w) AS contaminated FROM d LEFT JOIN h USING (doc_id) LEFT JOIN t USING (doc_id)"""
