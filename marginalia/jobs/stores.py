"""Retrieval over several stores: a vault whose sections have uids and a graph, and others whose rows have numbers only.

A row is named by (source_kind, number) from the lists to the prompt. Each store has an index of its own; a row
has the score of its place in the list of its store, and lists that tie follow each other in the order of
the stores. Rows without a uid take no part in the graph, and their statuses count as current.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from marginalia.config import Search
from marginalia.jobs import retrieve as job
from marginalia.jobs.index import Index
from marginalia.operators import fuse, graph
from marginalia.sources.store import materialised


@dataclass(frozen=True)
class Store:
    """Sections (section_uid, heading, path, ...) of a kind with their index. `steps` and uids belong to the vault only."""

    kind: str
    sections: DataFrame
    index: Index
    steps: graph.Steps | None = None
    has_uids: bool = False


def retrieve(stores: list[Store], questions: DataFrame, config: Search = Search(), body: bool = True) -> DataFrame:
    """Ranked rows (qid, source_kind, number, section_uid, rank, score, ...) of all stores for each question; section_uid is null where a store has none."""
    out, list_no = None, 0
    for store in stores:
        lex = job.seeds(store.sections, questions, config, index=store.index)
        more = None
        if store.has_uids and store.steps is not None and config.graph.enabled:
            more = graph.new_nodes(graph.expand(graph.seed_roots(lex, config.graph.seed_count), store.steps, config.graph), lex, config.graph)
        lists = fuse.rrf_union(lex, job.no_nodes(lex) if more is None else more, config.fusion).withColumn("list_no", F.col("list_no") + list_no)
        rows = job.with_columns(materialised(lists, "fused"), store.sections, [c for c in ("heading", "status", "path") if c in store.sections.columns])
        if "status" not in rows.columns:
            rows = rows.withColumn("status", F.lit(None).cast("string"))
        number = F.col("uid").cast("string")
        rows = rows.select("*", F.lit(store.kind).alias("source_kind"), number.alias("number"), F.when(F.lit(store.has_uids), number).alias("section_uid")).drop("uid")
        out, list_no = rows if out is None else out.unionByName(rows), list_no + 2
    weight = fuse.status_weight(F.col("status"), config.status)
    out = out.withColumn("status_weight", weight).withColumn("score", F.col("score") * F.col("status_weight"))
    out = fuse.boost_heading(fuse.ranked(out, config.fused_limit), questions, config.boosts)
    if not body:
        return out
    out, read = materialised(out, "ranked"), None
    for store in stores:
        uid = out.filter(F.col("source_kind") == store.kind).withColumn("uid", F.col("number").cast(store.sections.schema["section_uid"].dataType))
        part = job.with_columns(uid, store.sections, ["body"]).drop("uid")
        read = part if read is None else read.unionByName(part)
    return read
