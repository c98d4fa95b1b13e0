"""The whole way from questions to ranked sections and prompts, for many questions in one plan."""

from __future__ import annotations

import uuid
from dataclasses import replace

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from marginalia.config import Search, with_override
from marginalia.jobs.index import Index, build
from marginalia.operators import bench, context, fuse, graph, lexical, pack
from marginalia.sources.store import materialised, shared_folder

#: Sections up to which their uids are broadcast, at about 50 bytes each.
BROADCAST_ROWS = 200_000
COLUMNS = ["qid", "uid", "rank", "score", "list_no", "position", "hops", "via", "backwards", "status_weight", "heading_match"]


def column_weights(sections: DataFrame, config: Search) -> dict[str, float]:
    """The weighted columns that the sections have."""
    b = config.bm25
    every = {"note_title": b.title, "heading": b.heading, "heading_path": b.heading_path, "body": b.body, "tags": b.tags}
    return {c: w for c, w in every.items() if c in sections.columns}


def seeds(sections: DataFrame, questions: DataFrame, config: Search = Search(), prefix_last: bool = True, index: Index | None = None) -> DataFrame:
    """(qid, uid, score, position): the best lexical hits by an index; without one, an index is built for these questions."""
    if index is None:
        index = build(sections, column_weights(sections, config), f"{shared_folder(sections.sparkSession)}/index-{uuid.uuid4().hex}")
    keys = index.keys if prefix_last else None
    best = lexical.best(index.packed, index.stats, lexical.query_terms(questions), config.lexical_limit, config.bm25, keys)
    return materialised(best, "seeds")  # read by the expansion and the fusion


def of_few(sections: DataFrame, rows: DataFrame) -> DataFrame:
    """The sections that rows (uid) name. Up to BROADCAST_ROWS uids go to the tasks that read the sections, so no other section leaves them; beyond that they meet by a shuffle."""
    named = materialised(rows.select("uid").distinct(), "uids")
    small = named.limit(BROADCAST_ROWS + 1).count() <= BROADCAST_ROWS
    return sections.withColumnRenamed("section_uid", "uid").join(F.broadcast(named) if small else named, "uid", "left_semi")


def with_columns(rows: DataFrame, sections: DataFrame, columns: list[str]) -> DataFrame:
    """rows (uid, ...) with further columns of their sections, which are read for these rows only."""
    return rows.join(of_few(sections, rows).select("uid", *columns), "uid")


def no_nodes(seeds: DataFrame) -> DataFrame:
    """What graph.new_nodes gives where there is no graph."""
    return seeds.select("qid", F.col("uid").alias("node"), F.lit(0).alias("hops"), F.lit(None).cast("string").alias("via"), F.lit(False).alias("backwards"), "position").filter("false")


def retrieve(sections: DataFrame, edges: DataFrame | graph.Steps | None, questions: DataFrame, config: Search = Search(), contexts: DataFrame | None = None, prefix_last: bool = True, aliases: dict[str, list[str]] | None = None, index: Index | None = None, body: bool = True) -> DataFrame:
    """Ranked rows of each question (qid, question): lexical seeds, expansion, fusion, status, truncation, then the boosts, which only reorder.

    A question without a searchable term has no rows. Without edges, or with the graph off, only the seeds count.
    contexts has (qid, app, cwd), or (qid, wm_class, cwd) to be resolved with the aliases and the question.

    The fused rows are written before anything is read of the sections: what orders them is read for these
    only, and bodies, unless they aren't wanted, for those that are left at the end.
    """
    lex = seeds(sections, questions, config, prefix_last, index)
    if config.graph.enabled and edges is not None:
        roots = graph.seed_roots(lex, config.graph.seed_count)
        more = graph.new_nodes(graph.expand(roots, edges, config.graph), lex, config.graph)
    else:
        more = no_nodes(lex)
    fused = materialised(fuse.rrf_union(lex, more, config.fusion), "fused")
    names = [c for c in ("heading", "status", "note_title", "path", "heading_path", "start_line") if c in sections.columns]
    if contexts is not None:  # the boosts look into bodies
        names.append("body")
    rows = with_columns(fused, sections, names)
    weight = fuse.status_weight(F.col("status"), config.status) if "status" in names else F.lit(1.0)
    rows = rows.withColumn("status_weight", weight).withColumn("score", F.col("score") * F.col("status_weight"))
    rows = fuse.boost_heading(fuse.ranked(rows, config.fused_limit), questions, config.boosts)
    if contexts is not None:
        if "wm_class" in contexts.columns:
            contexts = context.effective(contexts, questions, aliases or {})
        rows = context.boosted(rows.withColumnRenamed("note_title", "title"), contexts, config.boosts)
    return with_columns(materialised(rows, "ranked"), sections, ["body"]) if body and "body" in sections.columns and "body" not in names else rows


def looked_up(wanted: DataFrame, sections: DataFrame) -> DataFrame:
    """(qid, place, uid, ...) of listed sections (qid, uids) that exist, in the order of the list; a uid that is listed twice stands at its last place."""
    places = wanted.select("qid", F.posexplode("uids").alias("place", "uid")).groupBy("qid", "uid").agg(F.max("place").alias("place"))
    return with_columns(places, sections, [c for c in sections.columns if c != "section_uid"])


def prompts(rows: DataFrame, questions: DataFrame, budget_tokens: int, config: Search = Search()) -> DataFrame:
    """(qid, prompt, sources) of ranked rows with their sections' columns; questions below the confidence gate have none."""
    sure = pack.gated(rows, questions, config.min_confidence).filter("confident").select("qid")
    heading = F.when(F.coalesce("heading_path", F.lit("")) == "", F.col("note_title")).otherwise(F.col("heading_path"))
    blocks = rows.join(sure, "qid").withColumn("block", pack.block(F.col("rank"), F.col("path"), heading, F.col("start_line"), pack.cut(pack.sanitised(F.col("body")))))
    return pack.prompts(pack.packed(blocks, budget_tokens, config.context_sections), questions.join(sure, "qid", "left_semi"))


def benchmark(sections: DataFrame, edges: DataFrame, questions: DataFrame, combos: list[dict[str, str]], config: Search = Search()) -> DataFrame:
    """(combo, n, recall_1, recall_3, recall_5, mrr) of questions (qid, question, expected) under each combination of overrides."""
    out, indexes = None, {}
    for number, combo in enumerate(combos):
        settings = replace(config)
        for key, value in combo.items():
            settings = with_override(settings, key, value)
        weights = tuple(column_weights(sections, settings).items())
        if weights not in indexes:
            indexes[weights] = build(sections, dict(weights), f"{shared_folder(sections.sparkSession)}/index-{uuid.uuid4().hex}")
        found = bench.ranks(questions, retrieve(sections, edges, questions, settings, index=indexes[weights], body=False)).withColumn("combo", F.lit(number))
        out = found if out is None else out.union(found)
    return bench.report(out, ["combo"])
