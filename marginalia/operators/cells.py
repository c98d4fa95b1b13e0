"""A coarse index of vectors: every row lies in the cell of its nearest centre.

The centres are fitted on a bounded sample, by spherical k-means; cells hold all rows. A query looks into the
cells whose centres are nearest. What lies in a cell is compared in whole, so scores are exact, and only rows of
cells that weren't looked into can be missed. Each cell keeps the widest angle to its centre, which bounds what
a query can find there: with `exact`, cells whose bound reaches the k-th score found are looked into too.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_schema
from pyspark.sql.types import StructType

from marginalia.operators.vectors import unit
from marginalia.sources.store import materialised

#: Rows that the centres are fitted on, and rounds of fitting.
SAMPLE, ROUNDS = 20_000, 12
#: Centres at most: they go to every task.
MOST = 4096
#: Rows of a cell that a query meets in one place; larger cells are dealt by salts.
PART = 50_000
#: Cells that a query looks into.
PROBES = 16


@dataclass(frozen=True)
class Cells:
    """rows (cell, salt, uid, vector), cells (cell, salts, angle), and the centres as an array."""

    rows: DataFrame
    cells: DataFrame
    centres: np.ndarray


def _matrix(column: pa.ChunkedArray | pa.Array) -> np.ndarray:
    column = column.combine_chunks() if isinstance(column, pa.ChunkedArray) else column
    return column.flatten().to_numpy(zero_copy_only=False).reshape(len(column), -1) if len(column) else np.zeros((0, 1))


def fitted(sample: np.ndarray, n: int, seed: int = 5) -> np.ndarray:
    """n centres of length 1 (fewer if the sample has fewer distinct rows)."""
    sample = np.unique(sample, axis=0)
    centres = sample[np.random.default_rng(seed).permutation(len(sample))[:n]]
    for _ in range(ROUNDS):
        nearest = (sample @ centres.T).argmax(axis=1)
        sums = np.zeros_like(centres)
        np.add.at(sums, nearest, sample)
        size = np.linalg.norm(sums, axis=1, keepdims=True)
        centres = np.where(size > 0, sums / np.where(size > 0, size, 1), centres)
    return centres


def build(rows: DataFrame, n_cells: int | None = None, id_col: str = "vec_id", vector_col: str = "embedding", sample: int = SAMPLE) -> Cells:
    """The index of all rows; about the root of their number as cells unless it is given. Rows without a vector are left out."""
    spark = rows.sparkSession
    unit_rows = rows.filter(F.col(vector_col).isNotNull()).select(F.col(id_col).alias("uid"), unit(F.col(vector_col)).alias("vector"))
    n = n_cells or max(1, min(MOST, round(rows.count() ** 0.5)))
    picked = unit_rows.orderBy(F.xxhash64("uid"), "uid").limit(sample).select("vector").toArrow()
    centres = fitted(_matrix(picked.column("vector")), n) if picked.num_rows else np.zeros((1, 1))
    sent, kind = spark.sparkContext.broadcast(centres), rows.schema[id_col].dataType.simpleString()

    def assign(batches):
        for batch in batches:
            if batch.num_rows:
                near = _matrix(batch.column(1)) @ sent.value.T
                cell = near.argmax(axis=1)
                yield pa.record_batch([pa.array(cell, pa.int32()), pa.array(near[np.arange(len(cell)), cell]), *batch.columns], names=["cell", "near", "uid", "vector"])

    assigned = materialised(unit_rows.mapInArrow(assign, f"cell int, near double, uid {kind}, vector array<double>"), "cells")
    cells = assigned.groupBy("cell").agg(F.ceil(F.count("*") / PART).cast("int").alias("salts"), F.acos(F.greatest(F.lit(-1.0), F.least(F.lit(1.0), F.min("near")))).alias("angle"))
    cells = materialised(cells, "cell-bounds")  # MOST rows
    salted = assigned.join(F.broadcast(cells.select("cell", "salts")), "cell").withColumn("salt", F.pmod(F.xxhash64("uid"), "salts").cast("int"))
    return Cells(salted.select("cell", "salt", "uid", "vector"), cells, centres)


def _looked(index: Cells, queries: DataFrame, chosen: DataFrame, k: int) -> DataFrame:
    """(qid, uid, score): the best k of each query in each of its chosen cells (qid, cell), and those that tie with the last."""
    asks = chosen.join(F.broadcast(index.cells.select("cell", "salts")), "cell").withColumn("salt", F.explode(F.sequence(F.lit(0), F.col("salts") - 1)))
    asks = asks.join(queries, "qid").select(F.col("cell").alias("of"), F.col("salt").alias("part"), "qid", "vector")
    kinds = queries.schema["qid"].dataType.simpleString(), index.rows.schema["uid"].dataType.simpleString()
    schema = StructType.fromDDL(f"qid {kinds[0]}, uid {kinds[1]}, score double")
    arrow = to_arrow_schema(schema)

    def run(asked: pa.Table, there: pa.Table) -> pa.Table:
        if not asked.num_rows or not there.num_rows:
            return arrow.empty_table()
        out, vectors, uids = [], _matrix(there.column("vector")), there.column("uid").combine_chunks()
        for at in range(0, asked.num_rows, 256):
            part = asked.slice(at, 256)
            scores = _matrix(part.column("vector")) @ vectors.T
            least = -np.partition(-scores, k - 1, axis=1)[:, k - 1] - 1e-5 if scores.shape[1] > k else np.full(len(scores), -2.0)
            q, r = np.nonzero(scores >= least[:, None])
            out.append(pa.table([part.column("qid").take(pa.array(q)), uids.take(pa.array(r)), pa.array(scores[q, r])], schema=arrow))
        return pa.concat_tables(out)

    found = asks.groupBy("of", "part").cogroup(index.rows.groupBy("cell", "salt")).applyInArrow(run, schema)
    return found.withColumn("score", F.round("score", 5))


def _best(scores: DataFrame, k: int) -> DataFrame:
    place = F.row_number().over(W.partitionBy("qid").orderBy(F.desc("score"), "uid"))
    return scores.withColumn("position", place - 1).filter(F.col("position") < k)


def top_k(index: Cells, queries: DataFrame, k: int, probes: int = PROBES, exact: bool = False, id_col: str = "vec_id", vector_col: str = "embedding") -> DataFrame:
    """(qid, uid, score, position): the rows that are nearest to each query by cosine, among those of its `probes` nearest cells; all of vectors.top_k if `exact`."""
    spark = queries.sparkSession
    asked = materialised(queries.filter(F.col(vector_col).isNotNull()).select(F.col(id_col).alias("qid"), unit(F.col(vector_col)).alias("vector")), "queries")
    bounds = {r.cell: r.angle for r in index.cells.select("cell", "angle").collect()}  # MOST rows
    angle = np.array([bounds.get(c, -1.0) for c in range(len(index.centres))])
    sent, kind = spark.sparkContext.broadcast((index.centres, angle)), asked.schema["qid"].dataType.simpleString()

    def cells(batches):
        centres, widest = sent.value
        for batch in batches:
            if not batch.num_rows or (widest < 0).all():
                continue
            near = _matrix(batch.column(1)) @ centres.T
            near[:, widest < 0] = -2  # no row is there
            order = np.argsort(-near, axis=1, kind="stable")
            place = np.empty_like(order)
            np.put_along_axis(place, order, np.arange(order.shape[1])[None, :], axis=1)
            bound = np.cos(np.maximum(0.0, np.arccos(np.clip(near, -1, 1)) - np.maximum(widest, 0)))
            q, c = np.nonzero((near > -2) & ((place < probes) | exact))
            yield pa.record_batch([batch.column(0).take(pa.array(q)), pa.array(c, pa.int32()), pa.array(place[q, c], pa.int32()), pa.array(bound[q, c])], names=["qid", "cell", "place", "bound"])

    chosen = materialised(asked.mapInArrow(cells, f"qid {kind}, cell int, place int, bound double"), "probes")
    found = _best(_looked(index, asked, chosen.filter(F.col("place") < probes).select("qid", "cell"), k), k)
    if not exact:
        return found
    found = materialised(found, "nearest")
    least = found.groupBy("qid").agg(F.min("score").alias("least"), F.count("*").alias("n"))
    rest = chosen.filter(F.col("place") >= probes).join(least, "qid", "left").filter((F.coalesce("n", F.lit(0)) < k) | (F.col("bound") + 2e-5 >= F.col("least")))
    return _best(found.drop("position").union(_looked(index, asked, rest.select("qid", "cell"), k)), k)
