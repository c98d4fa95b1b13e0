"""Brute-force vector search."""

from __future__ import annotations

from decimal import ROUND_HALF_UP, Decimal

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark import Broadcast
from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_schema
from pyspark.sql.types import StructType

#: Queries that are sent to all tasks at once, and those that meet rows in one matrix.
BLOCK, TILE = 4000, 500
#: Rows that queries meet in one matrix.
ROWS = 8000
#: Digits of a score.
DIGITS = 5


def dot(a: Column, b: Column) -> Column:
    return F.aggregate(F.zip_with(a, b, lambda x, y: x.cast("double") * y.cast("double")), F.lit(0.0), lambda s, x: s + x)


def unit(vector: Column) -> Column:
    """The vector at length 1; a zero vector stays. The length is worked out once, not for each number."""
    scaled = lambda length: F.transform(vector, lambda x: F.when(length > 0, x.cast("double") / length).otherwise(F.lit(0.0)))
    return F.get(F.transform(F.array(F.sqrt(dot(vector, vector))), scaled), F.lit(0))


def shortened(rows: DataFrame, dims: int, id_col: str = "vec_id", vector_col: str = "embedding") -> DataFrame:
    """(id, vector): the first dims, at length 1 again."""
    cut = rows.select(id_col, F.slice(vector_col, 1, dims).alias("cut"))
    return cut.select(id_col, unit(F.col("cut")).alias("vector"))


def rounded(x: np.ndarray) -> np.ndarray:
    """x to DIGITS digits as Spark rounds: halves of the shortest decimal away from zero."""
    scaled = np.abs(x) * 10**DIGITS
    out = np.copysign(np.floor(scaled + 0.5), x) / 10**DIGITS
    for i in np.flatnonzero(np.abs(scaled - np.floor(scaled) - 0.5) < 1e-6):
        out[i] = float(Decimal(repr(float(x[i]))).quantize(Decimal(1).scaleb(-DIGITS), ROUND_HALF_UP))
    return out


def _matrix(vectors: pa.ListArray, size: int) -> tuple[np.ndarray, np.ndarray]:
    """The places of whole vectors of this size, and a matrix of them."""
    whole = np.flatnonzero(pc.fill_null(pc.equal(pc.list_value_length(vectors), size), False).to_numpy(zero_copy_only=False))
    matrix = vectors.take(pa.array(whole)).flatten().to_numpy(zero_copy_only=False).astype(float).reshape(len(whole), size)
    there = np.ones(len(whole), bool)
    nulls = vectors.take(pa.array(whole)).flatten()
    if nulls.null_count:
        there = ~nulls.is_null().to_numpy(zero_copy_only=False).reshape(len(whole), size).any(axis=1)
    return whole[there], matrix[there]


def _exact(a: np.ndarray, b: np.ndarray, i: np.ndarray, j: np.ndarray) -> np.ndarray:
    """The products of the rows i of a and j of b, summed in the order of `dot`."""
    out = np.zeros(len(i))
    for d in range(a.shape[1]):
        out += a[i, d] * b[j, d]
    return rounded(out)


def _kept(rows: pa.Table, k: int) -> pa.Table:
    """The best k rows (q, uid, score) of each query; unknown scores come last and ties go to the smaller uid."""
    place = pc.negate(pc.fill_null(rows["score"], -np.inf))
    place = pc.if_else(pc.is_nan(place), -np.inf, place)
    order = pc.sort_indices(pa.table({"q": rows["q"], "place": place, "uid": rows["uid"]}), [("q", "ascending"), ("place", "ascending"), ("uid", "ascending")], null_placement="at_start")
    rows = rows.take(order).combine_chunks()
    q = rows["q"].to_numpy()
    first = np.searchsorted(q, q)
    return rows.filter(pa.array(np.arange(len(q)) - first < k))


def _nearest(queries: pa.ListArray, k: int, batches, kinds: pa.Schema) -> pa.Table:
    """(q, uid, score): the best k rows of each query among batches (uid, vector).

    Products of matrices in single precision show which rows may be among the best; scores are worked out for these
    in double precision, and only they decide. Pairs of vectors that have no product (one is missing, lacks a
    number, or is of another size) have no score and fill up what is left of a query's k.
    """
    best = kinds.empty_table()
    least = np.full(len(queries), -np.inf)
    sizes = [n for n in pc.unique(pc.list_value_length(queries)).to_pylist() if n is not None]
    sides = {n: _matrix(queries, n) for n in sizes}
    for batch in batches:
        for at in range(0, batch.num_rows, ROWS):
            part = batch.slice(at, ROWS)
            uids, vectors, found = part.column(0), part.column(1), [best]
            unknown = np.ones((len(queries), part.num_rows), bool) if np.isneginf(least).any() else None
            for n, (qs, a) in sides.items():
                rs, b = _matrix(vectors, n)
                if not len(rs) or not len(qs):
                    continue
                low, margin = b.T.astype(np.float32), 10.0**-DIGITS + 1e-6 * max(n, 1)
                for tile in range(0, len(qs), TILE):
                    mine = qs[tile : tile + TILE]
                    scores = a[tile : tile + TILE].astype(np.float32) @ low
                    scores[np.isnan(scores)] = np.inf
                    bar = least[mine]
                    if np.isneginf(bar).any() and scores.shape[1] > k:
                        bar = np.maximum(bar, -np.partition(-scores, k - 1, axis=1)[:, k - 1])
                    i, j = np.nonzero(scores >= (bar - margin).astype(np.float32)[:, None])
                    exact = _exact(a, b, tile + i, j)
                    found.append(pa.table([pa.array(mine[i], pa.int32()), uids.take(pa.array(rs[j])), pa.array(exact)], schema=kinds))
                    if unknown is not None:
                        unknown[np.ix_(mine, rs)] = False
            if unknown is not None and unknown.any():
                order = pc.sort_indices(uids, null_placement="at_start").to_numpy()
                free = unknown[:, order]
                i, j = np.nonzero(free & (np.cumsum(free, axis=1) <= k) & np.isneginf(least)[:, None])
                found.append(pa.table([pa.array(i, pa.int32()), uids.take(pa.array(order[j])), pa.nulls(len(i), pa.float64())], schema=kinds))
            best = _kept(pa.concat_tables(found), k)
            q, score = best["q"].to_numpy(), best["score"].to_numpy()
            full = np.flatnonzero((np.arange(len(q)) - np.searchsorted(q, q) == k - 1) & ~np.isnan(score))
            least[q[full]] = score[full]
    return best


def top_k(queries: DataFrame, rows: DataFrame, k: int, id_col: str = "vec_id", vector_col: str = "embedding") -> DataFrame:
    """(qid, uid, score, position) of a stated query set against all rows, by cosine.

    The queries pass in blocks of about BLOCK, each sent to all tasks, so rows are never shuffled; the k best of
    each query are found among each task's before they meet.
    """
    of = lambda df, name: df.select(F.col(id_col).alias(name), unit(F.col(vector_col)).alias("vector"))
    q, r, kinds = of(queries, "qid"), of(rows, "uid"), [df.schema[id_col].dataType.simpleString() for df in (queries, rows)]
    schema = StructType.fromDDL(f"qid {kinds[0]}, uid {kinds[1]}, score double")
    arrow, numbers = to_arrow_schema(schema), to_arrow_schema(StructType.fromDDL(f"q int, uid {kinds[1]}, score double"))
    blocks, out = max(1, -(-q.count() // BLOCK)), None
    for b in range(blocks):
        part = (q if blocks == 1 else q.filter(F.pmod(F.xxhash64("qid"), F.lit(blocks)) == b)).toArrow().combine_chunks()
        columns = [part.column(c).combine_chunks() if part.num_rows else pa.array([], part.schema.field(c).type) for c in range(2)]
        sent: Broadcast = rows.sparkSession.sparkContext.broadcast(columns)

        def run(batches, sent=sent):
            qids, vectors = sent.value
            best = _nearest(vectors, k, batches, numbers)
            for batch in pa.table([qids.take(best["q"].combine_chunks()), best["uid"], best["score"]], schema=arrow).to_batches():
                yield batch

        found = r.mapInArrow(run, schema)
        best = found.withColumn("position", F.row_number().over(W.partitionBy("qid").orderBy(F.desc("score"), "uid")) - 1).filter(F.col("position") < k)
        out = best if out is None else out.union(best)
    return out


def missing(sections: DataFrame, vectors: DataFrame, model: str, uid: str = "section_uid") -> DataFrame:
    """Sections without a vector of this model."""
    return sections.join(vectors.filter(F.col("model") == model).select(uid), uid, "left_anti")
