"""An index of sections and their relations: built once, read by all questions, and brought up to date by what has changed.

A generation is a set of tables beside those of other generations:

* packed (blk, uids, dls, hashes, terms, ends, slots, tfs): a row for each block of sections with all its terms, put
  together by the task that reads the sections, so nothing of them is shuffled and a frequent term lies in many
  files; the hashes are what the change gate compares,
* keys (term, keys): the beginnings of each term, for prefixes,
* stats (n, avg_dl): one row.

A generation counts once it stands in `finished`, which is written last; so a build that fails leaves the one
before in place.  The graph is a snapshot of its own,

* edges (owner, src, dst, relation), steps (at, to, via, backwards, salt), hubs (at, salts), degrees (node, degree),

and if its build fails, the new generation keeps the snapshot of the one before: losing a few relations is better
than losing the index.
"""

from __future__ import annotations

import logging
import uuid
from collections.abc import Callable
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from marginalia.operators import graph, lexical
from marginalia.sources import vault
from marginalia.sources.store import discard, materialised, small_batches

_LOG = logging.getLogger(__name__)
#: Bytes of a part of a file of blocks that a task reads at once; a block has some hundred thousand.
ROW_GROUP = 16 << 20
#: Makes (owner, src, dst, relation) from sections alone; an owner is the section whose change makes the edge anew.
Links = Callable[[DataFrame], DataFrame]


@dataclass(frozen=True)
class Index:
    spark: SparkSession
    folder: str
    generation: int = 1
    graph_folder: str | None = None
    graph_generation: int | None = None

    def _table(self, name: str) -> DataFrame:
        return self.spark.read.parquet(f"{self.folder}/{name}")

    def _graph(self, name: str) -> DataFrame:
        return self.spark.read.parquet(f"{self.graph_folder}/{name}")

    @property
    def packed(self) -> DataFrame:
        return self._table("packed")

    @property
    def blocks(self) -> DataFrame:
        """(term, blk, most, least, mask, posts)."""
        return lexical.by_term(self.packed)

    @property
    def postings(self) -> DataFrame:
        """(term, slot, uid, tf, dl)."""
        return self.blocks.select("term", F.inline("posts"))

    @property
    def keys(self) -> DataFrame:
        """(key, term)."""
        return self._table("keys").select(F.explode("keys").alias("key"), "term")

    @property
    def rows(self) -> DataFrame:
        """(uid, num, dl, content_hash)."""
        return lexical.rows_of(self.packed)

    @property
    def stats(self) -> DataFrame:
        return self._table("stats")

    @property
    def edges(self) -> DataFrame:
        return self._graph("edges")

    @property
    def degrees(self) -> DataFrame:
        return self._graph("degrees")

    @property
    def steps(self) -> graph.Steps | None:
        return graph.dealt(self._graph("steps"), hubs=self._graph("hubs")) if self.graph_folder else None


def signature(rows: DataFrame) -> str:
    """A name for the files that a table is read from, with their sizes and times."""
    files = rows.select("_metadata.file_path", "_metadata.file_size", "_metadata.file_modification_time").distinct()
    x = files.agg(F.coalesce(F.bit_xor(F.xxhash64("file_path", "file_size", "file_modification_time")), F.lit(0)).alias("h"), F.count("*").alias("n")).first()
    return f"{x.n}-{x.h & (1 << 64) - 1:016x}"


def _hash(sections: DataFrame, uid: str) -> Column:
    """Of all that a section holds, since edges come from more than the weighted columns."""
    return F.sha2(F.to_json(F.struct(*[F.col(c) for c in sections.columns if c != uid])), 256)


def _fresh(sections: DataFrame, weights: dict[str, float], uid: str, first: int = 0) -> DataFrame:
    return lexical.packed(sections, weights, uid, _hash(sections, uid), first)


def _write_graph(path: str, edges: DataFrame) -> None:
    edges.write.parquet(f"{path}/edges")
    edges = edges.sparkSession.read.parquet(f"{path}/edges")
    steps = graph.dealt(graph.both_ways(edges))
    steps.rows.write.parquet(f"{path}/steps")
    steps.hubs.write.parquet(f"{path}/hubs")
    steps.rows.groupBy(F.col("at").alias("node")).agg(F.count("*").alias("degree")).write.parquet(f"{path}/degrees")


def _write(spark: SparkSession, folder: str, generation: int, blocks: list[DataFrame], edges: Callable[[DataFrame], DataFrame] | None, before: Index | None = None) -> Index:
    """One generation in a directory of its own; an unfinished one of the same number has another name and is never read."""
    path = f"{folder}/generation={generation}/{uuid.uuid4().hex}"
    with small_batches(spark):
        for part in blocks:
            part.write.mode("append").option("parquet.block.size", ROW_GROUP).parquet(f"{path}/packed")
    index = Index(spark, path, generation)
    lexical.prefix_keys(index.packed.select(F.explode("terms").alias("term")).distinct()).write.parquet(f"{path}/keys")
    stats = index.rows.agg(F.count("*").alias("n"), F.coalesce(F.sum("dl"), F.lit(0)).alias("total"))
    stats.select("n", (F.col("total") / F.col("n")).alias("avg_dl")).coalesce(1).write.parquet(f"{path}/stats")
    shown = (before.graph_folder, before.graph_generation) if before else (None, None)
    if edges is not None:
        try:
            _write_graph(f"{path}/graph", edges(index.rows))
            shown = f"{path}/graph", generation
        except Exception:
            _LOG.warning("generation %d keeps the graph of generation %s", generation, shown[1], exc_info=True)
    finished = spark.createDataFrame([(generation, path, *shown)], "generation long, path string, graph_path string, graph_generation long")
    finished.coalesce(1).write.mode("append").parquet(f"{folder}/finished")
    return Index(spark, path, generation, *shown)


def latest(spark: SparkSession, folder: str) -> tuple[int, Index] | None:
    """(number, index) of the last finished generation."""
    path = spark._jvm.org.apache.hadoop.fs.Path(f"{folder}/finished")
    if not path.getFileSystem(spark._jsc.hadoopConfiguration()).exists(path):
        return None
    last = spark.read.parquet(f"{folder}/finished").orderBy(F.desc("generation"), "path").first()
    return last.generation, Index(spark, last.path, last.generation, last.graph_path, last.graph_generation)


def build(sections: DataFrame, weights: dict[str, float], folder: str, uid: str = "section_uid", links: Links | None = None, derived: Callable[[DataFrame], DataFrame] | None = None) -> Index:
    """The first generation, of all sections. `links` makes edges of sections, `derived` those that follow from rows (uid, content_hash) of all."""
    edges = _edges(None, (lambda: links(sections)) if links else None, None, derived) if links or derived else None
    return _write(sections.sparkSession, folder, 1, [_fresh(sections, weights, uid)], edges)


def _edges(old: DataFrame | None, fresh: Callable[[], DataFrame] | None, gone: DataFrame | None, derived: Callable[[DataFrame], DataFrame] | None) -> Callable[[DataFrame], DataFrame]:
    """Makes the edges of a generation: those of owners that haven't changed, those of fresh sections, and those derived from all rows."""

    def make(rows: DataFrame) -> DataFrame:
        parts = []
        if old is not None:
            parts.append(old.filter("owner IS NOT NULL").join(gone, "owner", "left_anti"))
        if fresh is not None:
            parts.append(fresh())
        if derived is not None:
            parts.append(derived(rows))
        out = parts[0].select("owner", "src", "dst", "relation")
        for part in parts[1:]:
            out = out.unionByName(part.select("owner", "src", "dst", "relation"))
        return out

    return make


def update(sections: DataFrame, weights: dict[str, float], folder: str, uid: str = "section_uid", links: Links | None = None, derived: Callable[[DataFrame], DataFrame] | None = None) -> tuple[int, Index]:
    """(number, index) after what has changed since the last generation.

    Only added and changed sections are tokenized, and only their edges are made anew. They get blocks behind the others;
    blocks without a removed or changed row are copied as they are, and the rest lose these rows. Nothing is
    written if nothing has changed.
    """
    spark, before = sections.sparkSession, latest(sections.sparkSession, folder)
    if before is None:
        return 1, build(sections, weights, folder, uid, links, derived)
    number, old = before
    now = materialised(sections.select(F.col(uid).alias("uid"), _hash(sections, uid).alias("content_hash")), "rows")
    gate = vault.change_gate(old.rows.withColumnRenamed("uid", "path"), now.withColumnRenamed("uid", "path"))
    changes = materialised(gate.filter("change <> 'unchanged'"), "changes")
    if changes.isEmpty():
        discard(now, changes)
        return before
    added = sections.join(changes.filter("change <> 'removed'").select(F.col("path").alias(uid)), uid, "left_semi")
    last = old.packed.agg(F.max("blk")).first()[0]
    fresh = _fresh(added, weights, uid, 0 if last is None else last + 1)
    gone = old.rows.join(changes.filter("change <> 'added'").select(F.col("path").alias("uid")), "uid", "left_semi")
    slots = F.collect_list(F.pmod("num", F.lit(lexical.BLOCK)).cast("tinyint")).alias("gone")
    touched = materialised(gone.groupBy(F.floor(F.col("num") / lexical.BLOCK).alias("blk")).agg(slots), "gone")
    kept, left = old.packed.join(touched, "blk", "left_anti"), lexical.without(old.packed.join(touched, "blk"))
    edges, changed = None, changes.filter("change <> 'added'").select(F.col("path").alias("owner"))
    if links and old.graph_generation == number:
        edges = _edges(old.edges, lambda: links(added), changed, derived)
    elif links or derived:  # without a snapshot of these rows, all edges are made anew
        edges = _edges(None, (lambda: links(sections)) if links else None, None, derived)
    index = _write(spark, folder, number + 1, [kept.select(fresh.columns), left.select(fresh.columns), fresh], edges, old)
    discard(now, changes, touched)
    return number + 1, index


def current(source: DataFrame, sections: DataFrame, weights: dict[str, float], folder: str, links: Links | None = None, derived: Callable[[DataFrame], DataFrame] | None = None) -> Index:
    """The index of sections that are made from the files of `source`: the one in the folder if these files have one, else a new one."""
    own = f"{folder}/index-{signature(source)}-{'-'.join(f'{c}-{w:g}' for c, w in weights.items())}"
    found = latest(source.sparkSession, own)
    return found[1] if found else build(sections, weights, own, links=links, derived=derived)


def counts(index: Index, documents: DataFrame, sections: DataFrame) -> DataFrame:
    """(documents, sections, relations, generation): how many there are, with the relations and the number of a generation."""
    relations = index.edges if index.graph_folder else index.rows.limit(0)
    one = documents.agg(F.count("*").alias("documents"))
    for name, rows in (("sections", sections), ("relations", relations)):
        one = one.crossJoin(F.broadcast(rows.agg(F.count("*").alias(name))))
    return one.withColumn("generation", F.lit(index.generation).cast("long"))
