"""Ordinal cumulative-link regression on graded ratings.

P(grade <= k) = sigmoid(threshold_k - s) with one score s = w . x for all grades
and ordered thresholds.  x holds the words and beginnings of words of several
lengths, hashed to 2**BITS buckets, one feature for each time that a text has
them up to MOST times, and a few shares of character kinds.  The fit is a small
optimisation on the driver over a bounded sample of rated documents, a part of
which is held out to set the cut; scoring is a single pass that needs the
weights only.
"""

from __future__ import annotations

from dataclasses import dataclass, replace

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .bytetext import ALNUM, Block, Words, mix64, per_text, pieces, release_memory
from .storage import discard, saved

BITS = 18
#: Characters at the start of a longer word that are features as well.
PREFIXES = range(3, 9)
#: Times up to which a word or beginning is counted.
MOST = 3
#: Rated documents that are fitted at most, those with the smallest hashes of id and text, and their features in all: the
#: first ones in this order are taken that have no more together.
SAMPLE, SAMPLE_FEATURES = 4000, 8_000_000
#: Least probability of the best grade from which a document is kept. The cut lies higher where CLEAN allows it.
LEAST = 0.5
#: Share of the held-out documents of the best grade that the cut keeps, and the fewest that set a cut.
CLEAN, FEWEST = 0.99, 50
#: One in so many documents of the sample is held out.
HELD = 4
_STEPS, _RATE, _DECAY = 200, 0.05, 1e-2
#: Log ratios below _TELLING are left out of the fit.
_SHAPES, _PRIOR, _TELLING = 7, 4, 0.5


def features(column: pa.Array) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(index, value, first): the sparse features of text i are those from first[i] to first[i + 1]. A text without words has shapes only."""
    block = Block(column)
    words = Words(block, ALNUM)
    hashes = words.hashes()
    buckets = (hashes >> np.uint64(64 - BITS)).astype(np.int64)
    n = block.n
    doc = np.repeat(np.arange(n), np.diff(words.first))
    again = np.concatenate(([False], (buckets[1:] == buckets[:-1]) & (doc[1:] == doc[:-1]))) if len(doc) else np.zeros(0, bool)
    found = [doc << BITS | buckets]
    for longer, stems in words.beginnings(PREFIXES):
        found.append(doc[longer] << BITS | (mix64(stems + np.uint64(1)) >> np.uint64(64 - BITS)).astype(np.int64))
    keys, times = np.unique(np.concatenate(found), return_counts=True)
    doc, index = [keys >> BITS], [keys & ((1 << BITS) - 1)]
    for k in range(2, MOST + 1):
        often = times >= k
        doc.append(doc[0][often])
        index.append((mix64(index[0][often].astype(np.uint64) + np.uint64(k << 40)) >> np.uint64(64 - BITS)).astype(np.int64))
    doc, index = np.concatenate(doc), np.concatenate(index)
    distinct = np.bincount(np.unique(found[0]) >> BITS, minlength=n)
    keys = np.unique(doc << BITS | index)
    doc, index = keys >> BITS, keys & ((1 << BITS) - 1)
    value = np.ones(len(index))
    raw = block.bytes
    size = np.maximum(np.diff(block.offsets), 1)
    n_words = np.diff(words.first)
    kinds = [np.isin(raw, np.frombuffer(b"#*$%&|<>", np.uint8)), (raw >= 65) & (raw <= 90), (raw >= 48) & (raw <= 57), raw == 33]
    shapes = [per_text(k, block.offsets) / size for k in kinds] + [n_words / size / 4]
    shapes += [per_text(again, words.first) / np.maximum(n_words, 1), distinct / np.maximum(n_words, 1) / 8]
    shapes = np.minimum(1, np.stack(shapes, axis=1) * 8)
    index = np.concatenate((index, np.tile(np.arange(_SHAPES) + (1 << BITS), n)))
    value = np.concatenate((value, shapes.reshape(-1)))
    doc = np.concatenate((doc, np.repeat(np.arange(n), _SHAPES)))
    order = np.argsort(doc, kind="stable")
    return index[order], value[order], np.searchsorted(doc[order], np.arange(n + 1))


@dataclass
class Model:
    weights: np.ndarray
    thresholds: np.ndarray
    least: float = LEAST

    def scores(self, index: np.ndarray, value: np.ndarray, first: np.ndarray) -> np.ndarray:
        return np.add.reduceat(np.append(self.weights[index] * value, 0.0), first[:-1]) if len(first) > 1 else np.zeros(0)

    def tails(self, scores: np.ndarray) -> np.ndarray:
        """P(grade > k) for k from 0 on, a row for each score."""
        return 1 / (1 + np.exp(np.clip(self.thresholds - scores[:, None], -500, 500)))


def fit(index: np.ndarray, value: np.ndarray, first: np.ndarray, grades: np.ndarray, n_grades: int) -> Model:
    """Maximum likelihood with weight decay by Adam. Thresholds stay ordered: all but the first are sums of positive gaps."""
    n, row = len(grades), np.repeat(np.arange(len(grades), dtype=np.int32), np.diff(first))
    share = np.cumsum(np.bincount(grades, minlength=n_grades))[:-1] + 1.0
    odds = np.log(share / (n + n_grades - share))
    # Word buckets are scaled by their log ratio between documents of the best grade and the rest, drawn towards 0
    # where few rated documents have them, so that few ratings suffice to find the words that matter.
    word = index < 1 << BITS
    has = np.bincount(index[word], minlength=1 << BITS)
    high = np.bincount(index[word & (grades == n_grades - 1)[row]], minlength=1 << BITS)
    rate = ((grades == n_grades - 1).sum() + 1) / (n + 2)
    expected, low = has + _PRIOR, has - high
    ratio = np.log((high + _PRIOR * rate) / (expected * rate)) - np.log((low + _PRIOR * (1 - rate)) / (expected * (1 - rate)))
    scale = np.concatenate((np.where(np.abs(ratio) >= _TELLING, ratio, 0), np.ones(_SHAPES)))
    tells = scale[index] != 0
    index, row, value = index[tells], row[tells], value[tells] * scale[index[tells]]
    first = np.searchsorted(row, np.arange(n + 1))
    params = np.zeros((1 << BITS) + _SHAPES + n_grades - 1)
    cut = len(params) - (n_grades - 1)
    params[cut] = odds[0]
    params[cut + 1 :] = np.log(np.maximum(np.diff(odds), 1e-3))
    first_moment, second_moment = np.zeros_like(params), np.zeros_like(params)
    for step in range(1, _STEPS + 1):
        _, gradient = loss(params, index, value, first, grades, n_grades)
        first_moment += 0.1 * (gradient - first_moment)
        second_moment += 0.01 * (gradient**2 - second_moment)
        params -= _RATE * first_moment / (1 - 0.9**step) / (np.sqrt(second_moment / (1 - 0.99**step)) + 1e-8)
    return Model(params[:cut] * scale, thresholds(params[cut:]))


def thresholds(params: np.ndarray) -> np.ndarray:
    return np.cumsum(np.concatenate((params[:1], np.exp(params[1:]))))


def loss(params: np.ndarray, index: np.ndarray, value: np.ndarray, first: np.ndarray, grades: np.ndarray, n_grades: int) -> tuple[float, np.ndarray]:
    """(mean negative log likelihood with weight decay, its gradient) of weights, the first threshold and the logs of the gaps after it."""
    n, row, cut = len(grades), np.repeat(np.arange(len(grades), dtype=np.int32), np.diff(first)), len(params) - (n_grades - 1)
    t = thresholds(params[cut:])
    s = np.add.reduceat(np.append(params[index] * value, 0.0), first[:-1]) * (np.diff(first) > 0)
    below = 1 / (1 + np.exp(-np.clip(np.concatenate((t, [np.inf]))[grades] - s, -500, 500)))
    under = 1 / (1 + np.exp(-np.clip(np.concatenate(([-np.inf], t))[grades] - s, -500, 500)))
    p = np.maximum(below - under, 1e-12)
    d_below, d_under = below * (1 - below) / p, under * (1 - under) / p
    gradient = np.zeros_like(params)
    gradient[:cut] = np.bincount(index, value * (d_below - d_under)[row], cut) / n
    gradient[: 1 << BITS] += _DECAY * params[: 1 << BITS]
    by_cut = np.zeros(n_grades + 1)
    np.add.at(by_cut, grades + 1, -d_below)
    np.add.at(by_cut, grades, d_under)
    by_cut = by_cut[1:n_grades] / n
    sums = np.cumsum(by_cut[::-1])[::-1]
    gradient[cut] = sums[0]
    gradient[cut + 1 :] = sums[1:] * np.exp(params[cut + 1 :])
    return float(-np.log(p).mean() + _DECAY / 2 * (params[: 1 << BITS] ** 2).sum()), gradient


def least_top(tops: np.ndarray) -> float:
    """The highest probability that keeps CLEAN of the documents of the best grade, whose probabilities are `tops`; LEAST if that is higher or they are too few."""
    return max(LEAST, float(np.sort(tops)[int(len(tops) * (1 - CLEAN))])) if len(tops) >= FEWEST else LEAST


def fit_with_cut(index: np.ndarray, value: np.ndarray, first: np.ndarray, grades: np.ndarray, n_grades: int) -> Model:
    """A model of all documents. Its cut is that of a model which hasn't seen the last of HELD parts, on this part."""
    seen = len(grades) - len(grades) // HELD
    least, best = LEAST, grades[seen:] == n_grades - 1
    if best.sum() >= FEWEST:
        part = fit(index[: first[seen]], value[: first[seen]], first[: seen + 1], grades[:seen], n_grades)
        tops = part.tails(part.scores(index[first[seen] :], value[first[seen] :], first[seen:] - first[seen]))[:, -1]
        least = least_top(tops[best])
    return replace(fit(index, value, first, grades, n_grades), least=least)


def ratings(labels: DataFrame) -> DataFrame:
    """(doc_id, grade): 0 for low quality, 1 for toxic text of good quality, 2 for the rest; rows without an id or a quality give none."""
    toxic = F.coalesce("toxic", F.lit(0)) > 0
    grade = F.when(F.col("quality") <= 0, 0).when(toxic, 1).otherwise(2)
    return labels.filter("doc_id IS NOT NULL AND quality IS NOT NULL").select("doc_id", grade.alias("grade")).groupBy("doc_id").agg(F.min("grade").alias("grade"))


def _features(batches):
    for batch, column in pieces(batches, "text"):
        index, value, first = features(column)
        index, value = index.astype("<i4"), value.astype("<f4")
        cuts = list(zip(first[:-1].tolist(), first[1:].tolist()))
        yield pa.record_batch([batch.column("h"), batch.column("grade"), pa.array([index[a:b].tobytes() for a, b in cuts], pa.binary()), pa.array([value[a:b].tobytes() for a, b in cuts], pa.binary())], names=["h", "grade", "index", "value"])


def trained(docs: DataFrame, graded: DataFrame, n_grades: int = 3, sample: int = SAMPLE, most_features: int = SAMPLE_FEATURES, id_col: str = "doc_id", text_col: str = "text") -> Model | None:
    """A model of at most `sample` rated documents (doc_id, grade) of docs with `most_features` features; None if docs has none.

    Equal rows count once, rows of one id with different texts each with the grade of the id; null texts and
    ids aren't rated.
    """
    h = F.xxhash64(F.col(f"`{id_col}`"), F.col(f"`{text_col}`").cast("string"))
    rows = docs.filter(F.col(f"`{text_col}`").isNotNull()).select(F.col(f"`{id_col}`").alias("doc_id"), h.alias("h"))
    rated = saved(rows.join(graded.select("doc_id", F.col("grade").cast("int").alias("grade")), "doc_id").distinct(), "rated")
    every = max(-(-rated.count() // (2 * sample)), 1)
    few = F.broadcast(saved(rated.filter(F.pmod("h", F.lit(every)) == 0).orderBy("h", "doc_id").limit(sample), "chosen"))
    texts = docs.select(F.col(f"`{id_col}`").alias("doc_id"), F.col(f"`{text_col}`").cast("string").alias("text"), h.alias("h")).join(few, ["doc_id", "h"])
    found = texts.select("h", "grade", "text").mapInArrow(_features, "h long, grade int, index binary, value binary").dropDuplicates(["h", "grade"])
    found = saved(found, "features")
    sizes = sorted((r["h"], r["n"]) for r in found.select("h", (F.octet_length("index") / 4).cast("long").alias("n")).collect())
    fit = np.cumsum([n for _, n in sizes]) <= most_features
    last = sizes[max(int(fit.sum()) - 1, 0)][0] if sizes else 0
    rows = sorted(found.filter(F.col("h") <= last).collect(), key=lambda r: (r["h"], r["grade"]))
    discard(rated, found)
    if not rows:
        return None
    index, value = (np.frombuffer(b"".join(r[c] for r in rows), kind) for c, kind in (("index", "<i4"), ("value", "<f4")))
    first = np.concatenate(([0], np.cumsum([len(r["index"]) // 4 for r in rows])))
    grades = np.array([r["grade"] for r in rows])
    del rows
    model = fit_with_cut(index, value, first, grades, n_grades)
    del index, value
    release_memory()
    return model


def _grade(model, least: float | None):
    def run(batches):
        for batch, column in pieces(batches, "text"):
            if model is None:
                none = pa.nulls(batch.num_rows, pa.float64())
                yield pa.record_batch([batch.column("doc_id"), none, none, pa.array([True] * batch.num_rows)], names=["doc_id", "expected_grade", "p_top", "kept"])
                continue
            tails = model.value.tails(model.value.scores(*features(column)))
            top = tails[:, -1]
            yield pa.record_batch([batch.column("doc_id"), pa.array(np.round(tails.sum(axis=1), 6)), pa.array(np.round(top, 6)), pa.array(top >= (model.value.least if least is None else least))], names=["doc_id", "expected_grade", "p_top", "kept"])

    return run


def graded(docs: DataFrame, model: Model | None, least: float | None = None, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(doc_id, expected_grade, p_top, kept): kept if the probability of the best grade is at least `least`, by default the cut of the model.

    A null text is scored like an empty one, by its shape alone. Without a model (no rated document) the
    grades are null and every row is kept. Rows are scored one by one; other columns change nothing.
    """
    texts = docs.select(F.col(id_col).alias("doc_id"), F.col(text_col).cast("string").alias("text"))
    shared = docs.sparkSession.sparkContext.broadcast(model) if model else None
    return texts.mapInArrow(_grade(shared, least), f"doc_id {texts.schema['doc_id'].dataType.simpleString()}, expected_grade double, p_top double, kept boolean")


def selected(docs: DataFrame, model: Model | None, least: float | None = None, text_col: str = "text") -> DataFrame:
    """The rows of docs that are kept, with all their columns.

    A null text is scored like an empty one. Without a model all rows are kept. Repeated rows are all kept or
    all rejected; columns of any name and type pass through; an empty table stays empty.
    """
    if model is None:
        return docs
    shared, names = docs.sparkSession.sparkContext.broadcast(model), docs.columns

    def run(batches):
        for batch, column in pieces(batches, text_col):
            top = shared.value.tails(shared.value.scores(*features(column)))[:, -1]
            yield batch.select(names).filter(pa.array(top >= (shared.value.least if least is None else least)))

    return docs.mapInArrow(run, docs.schema)
