"""The registered queries of retrieval over the driver's tables."""

from __future__ import annotations

import uuid
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from marginalia.config import Graph, Search
from marginalia.functions import text as T
from marginalia.jobs import index
from marginalia.jobs import notes as notes_job
from marginalia.jobs import retrieve as job
from marginalia.jobs import stores
from marginalia.operators import actions, bench, cells, context, fuse, graph, lexical, memory, pack, vectors
from marginalia.sources import lines, tables, vault
from marginalia.sources.store import shared_folder
from marginalia.sources.tables import table
from marginalia.streaming import events as st

BUDGET = 600
INCLUDE, EXCLUDE = ["**/en/*", "**/fr/*"], ["**ref=**"]
QUERY_EVERY = 50


def documents(s, d):
    return tables.spread(table(s, d, "documents"))


def _index(s, d, columns=("heading", "body")):
    """The index of the documents, which all questions of a session share; that of single columns has no graph, since its lists aren't expanded."""
    rows = tables.document_sections(documents(s, d))
    weights = {c: w for c, w in job.column_weights(rows, Search()).items() if c in columns}
    derived = (lambda _: copies(s, d).withColumn("owner", F.lit(None).cast("long"))) if len(columns) > 1 else None
    return index.current(table(s, d, "documents"), rows, weights, shared_folder(s), derived=derived)


def sections(s, d):
    """Documents as sections with the status that their labels give."""
    return _labelled(s, d, documents(s, d))


def _labelled(s, d, docs):
    labels = table(s, d, "labels").select(F.col("doc_id").alias("section_uid"), tables.status_of().alias("status"))
    return tables.document_sections(docs).join(labels, "section_uid", "left")


def looked_at(s, d):
    """The sections for jobs that read few of them, where they lie."""
    return _labelled(s, d, table(s, d, "documents"))


def questions(s, d):
    return table(s, d, "benchmark").select(F.col("item_id").alias("qid"), F.col("text").alias("question"))


def turns(s, d):
    return table(s, d, "conversations")


def asked(s, d):
    """User turns as questions, numbered by conversation and turn."""
    return turns(s, d).filter("role = 'user'").select((F.col("conv_id") * 1000 + F.col("turn")).alias("qid"), F.col("text").alias("question"))


def copies(s, d):
    """A `related` edge from each further copy of a text to its first document."""
    docs = documents(s, d).select("doc_id", F.sha2("text", 256).alias("h"))
    first = docs.groupBy("h").agg(F.min("doc_id").alias("dst"), F.count("*").alias("n")).filter("n > 1")
    return docs.join(first, "h").filter("doc_id <> dst").select(F.col("doc_id").alias("src"), "dst", F.lit("related").alias("relation"))


def provenance(s, d):
    """One row for each document, rated by its quality label."""
    rating = F.when(F.col("quality") == 1, 1).when(F.col("quality") == 0, -1)
    return documents(s, d).select(F.col("doc_id").alias("id"), F.col("source").alias("query")).join(table(s, d, "labels").select(F.col("doc_id").alias("id"), rating.alias("rating")), "id", "left")


def stream(s, d):
    return table(s, d, "events").withColumn("ts", F.col("ts").cast("timestamp"))


def results(s, d, body=False, config=Search()):
    index_ = _index(s, d)
    return job.retrieve(looked_at(s, d), index_.steps, questions(s, d), config, index=index_, body=body)


LEXICAL = Search(graph=Graph(enabled=False))


def corrections(s, d):
    writes = table(s, d, "benchmark").select(F.col("text").alias("question"), F.col("text").alias("answer"), F.col("item_id").alias("created_at"), F.col("item_id").alias("seq"))
    return memory.saved_corrections(writes)


def corrections_log(s, d):
    """Items are saved; every second one is deleted, twice, and half of those are saved again. A delete may name an id that never was."""
    at = F.col("qid") * 10
    rows = questions(s, d).select("qid", "question", at.alias("seq"))
    write = lambda rows: memory.saves(rows.select("question", F.col("question").alias("answer"), F.col("seq").alias("created_at"), "seq"))
    even = rows.filter("qid % 2 = 0").withColumn("id", F.when(F.col("qid") % 14 == 0, -F.col("seq")).otherwise(F.col("seq")))
    gone = even.select("id", F.explode(F.array(F.col("seq") + 5, F.col("seq") + 6)).alias("seq"))
    again = rows.filter("qid % 4 = 0").withColumn("seq", F.col("seq") + 7)
    return memory.corrections_log(write(rows).unionByName(memory.deletes(gone)).unionByName(write(again)))


def utc(column: str):
    return F.date_format(column, "yyyy-MM-dd HH:mm:ss.SSSSSS").alias(column)


def lex_bm25_topk(s, d):
    return job.seeds(sections(s, d), questions(s, d), index=_index(s, d))


def lex_weights_sweep(s, d):
    """Two weights of headings, each with an index of its own."""
    out = []
    for combo, weight in enumerate((1.0, 20.0)):
        rows = tables.document_sections(documents(s, d))
        own = index.current(table(s, d, "documents"), rows, {"heading": weight, "body": 1.0}, shared_folder(s))
        out.append(job.seeds(rows, questions(s, d), index=own).withColumn("combo", F.lit(combo).cast("long")))
    return out[0].unionByName(out[1]).select("combo", "qid", "uid", "score", "position")


def lex_all_terms(s, d):
    return lexical.all_terms(_index(s, d).packed, lexical.query_terms(questions(s, d)))


def q_tokenize_stats(s, d):
    w = documents(s, d).select("doc_id", T.tokens(F.col("text")).alias("w"))
    return w.select("doc_id", F.size("w").cast("long").alias("n_tokens"), F.size(F.array_distinct("w")).cast("long").alias("n_distinct"))


def q_phrase(s, d):
    """The beginnings of items of three tokens, and whole items."""
    first = F.array_join(F.slice(T.tokens(F.col("question")), 1, 3), " ")
    every = questions(s, d).select(F.explode(F.array(F.struct("qid", first.alias("phrase")), F.struct((F.col("qid") + 1_000_000).alias("qid"), F.col("question").alias("phrase")))).alias("x")).select("x.*")
    return lexical.phrase(sections(s, d), every).select("qid", "uid", F.col("at").cast("long").alias("at"))


def q_snippet(s, d):
    return documents(s, d).select("doc_id", T.snippet(F.col("text")).alias("snippet"))


def q_no_answer(s, d):
    return questions(s, d).join(lex_all_terms(s, d).select("qid").distinct(), "qid", "left_anti").select("qid")


def q_unsearchable(s, d):
    """How many rows each item has, and each item in which only stop words, marks or nothing are left."""
    bare = F.element_at(F.array(*map(F.lit, ("how do I?", " ... -- ?!", ""))), (F.col("qid") % 3 + 1).cast("int"))
    every = questions(s, d).union(questions(s, d).select(F.col("qid") + 1_000_000, bare))
    found = job.seeds(looked_at(s, d), every, index=_index(s, d)).groupBy("qid").agg(F.count("*").alias("n"))
    return every.select("qid").join(found, "qid", "left").select("qid", F.coalesce("n", F.lit(0).cast("long")).alias("n"))


def q_stats(s, d):
    """Counts of the index and its generation."""
    return index.counts(_index(s, d), table(s, d, "documents"), tables.line_sections(documents(s, d)))


def parse_lines(s, d):
    return tables.line_sections(documents(s, d)).groupBy("doc_id").agg(F.count("*").alias("n_lines"), F.max("line").cast("long").alias("last_line"))


def parse_token_estimate(s, d):
    return documents(s, d).select("doc_id", F.round(T.token_estimate(F.col("text")), 3).alias("tokens"))


def src_page_sections(s, d):
    return tables.page_sections(table(s, d, "pages")).select(F.col("section_uid").alias("page_id"), "heading", F.size(T.tokens(F.col("body"))).cast("long").alias("n_tokens"))


def src_page_links(s, d):
    return tables.page_links(table(s, d, "pages"))


def src_glob_filter(s, d):
    return vault.accepted(table(s, d, "pages"), INCLUDE, EXCLUDE, "url").select("page_id", "url")


def src_change_gate(s, d):
    before = documents(s, d).join(table(s, d, "labels"), "doc_id").select(F.col("doc_id").alias("path"), F.sha2(F.when(F.col("toxic") == 1, F.upper("text")).otherwise(F.col("text")), 256).alias("content_hash"))
    now = documents(s, d).filter("lang <> 'es'").select(F.col("doc_id").alias("path"), F.sha2("text", 256).alias("content_hash"))
    return vault.change_gate(before, now)


def g_expand_2hop(s, d):
    edges = tables.foreign_keys(table(s, d, "nation"), table(s, d, "customer"), table(s, d, "supplier"))
    roots = table(s, d, "region").select(F.col("r_regionkey").cast("long").alias("qid"), F.concat(F.lit("region:"), F.col("r_regionkey").cast("string")).alias("node"), F.lit(1.0).alias("score"))
    out = graph.expand(roots, edges)
    return out.select("qid", "node", F.round("score", 9).alias("score"), F.col("hops").cast("long").alias("hops"), "via", "backwards")


def g_pagerank_10(s, d):
    return graph.pagerank(tables.page_links(table(s, d, "pages")), 10).select("node", F.round("rank", 9).alias("rank"))


def g_disabled(s, d):
    """Without the graph only lexical rows are ranked."""
    return results(s, d, config=LEXICAL).select("qid", "uid", F.col("rank").cast("long").alias("rank"), F.round("score", 9).alias("score"), F.col("list_no").cast("long").alias("list_no"))


def g_contradictions(s, d):
    """A bad section contradicts the first good one under the same heading."""
    sec = sections(s, d).select("section_uid", "heading", "status")
    good = sec.filter("status = 'current'").groupBy("heading").agg(F.min("section_uid").alias("dst"))
    edges = sec.filter("status = 'obsolete'").join(good, "heading").select(F.col("section_uid").alias("src"), "dst", F.lit("contradicts").alias("relation"))
    return graph.contradictions(edges)


def g_unresolved_contradictions(s, d):
    """Documents contradict the next one; every fifth supersedes it, and obsolete ones are settled."""
    docs = documents(s, d).select(F.col("doc_id").alias("src"), (F.col("doc_id") + 1).alias("dst"))
    edges = docs.withColumn("relation", F.lit("contradicts")).union(docs.filter("src % 5 = 0").select("dst", "src", F.lit("supersedes")))
    return graph.unresolved_contradictions(edges, sections(s, d))


def g_neighbourhood(s, d):
    return graph.neighbourhood(tables.foreign_keys(table(s, d, "nation"), table(s, d, "customer"), table(s, d, "supplier")), "nation:7")


def parse_edges(s, d):
    """Edges of bodies with a typed relation, a bare link and a section above."""
    body = F.concat(F.lit("text\n  related:: [[d"), F.col("doc_id") + 1, F.lit("]]\nsee [["), "source", F.lit("]] and [["), "source", F.lit("]]"))
    return vault.edges(documents(s, d).select(F.concat(F.lit("d"), "doc_id").alias("section_uid"), F.when(F.col("doc_id") % 2 == 0, F.lit("top")).alias("parent_uid"), body.alias("body")))


def parse_actions(s, d):
    body = F.concat(F.lit("@file src/"), "source", F.lit(":"), "doc_id", F.lit("\ntext @app no\n  @video https://v.example/w?t="), "doc_id", F.lit("s\n@project /p/"), "lang")
    return vault.actions(documents(s, d).select(F.col("doc_id").alias("section_uid"), body.alias("body"))).withColumn("line", F.col("line").cast("long"))


def parse_note_sections(s, d):
    """A note of each document with two headings and text before them."""
    content = F.concat(F.lit("---\ntitle: T\nstatus: draft\n---\nintro\n# "), "source", F.lit(" {#one}\n\nalpha\n\n## "), "lang", F.lit("\n```\n# no heading\n```\n"))
    rows = vault.sections(documents(s, d).select(F.concat(F.lit("n"), "doc_id", F.lit(".md")).alias("path"), content.alias("content")))
    return rows.select("section_uid", "parent_uid", "heading", "heading_path", "body", F.col("start_line").cast("long").alias("start_line"), F.col("end_line").cast("long").alias("end_line"), "status")


def src_glob_count(s, d):
    """Pages that each source's patterns accept; a source without any shows a wrong pattern."""
    sources = {"en": (["**/en/*"], []), "all": ([], []), "none": (["*.md"], []), "plain": (["**"], EXCLUDE)}
    return vault.accepted_counts(table(s, d, "pages"), sources, "url")


def vec_queue(s, d):
    vectors_ = table(s, d, "embeddings").select(F.col("vec_id").alias("section_uid"), F.when(F.col("vec_id") % 3 == 0, "old").otherwise("new").alias("model"))
    return vectors.missing(sections(s, d), vectors_, "new").select("section_uid")


def retrieve_ranked(s, d):
    out = results(s, d)
    return out.select("qid", "uid", F.col("rank").cast("long").alias("rank"), F.round("score", 9).alias("score"), fuse.explain().alias("explain"))


def rank_status(s, d):
    weight = fuse.status_weight(F.col("status"))
    return sections(s, d).groupBy(F.coalesce("status", F.lit("none")).alias("status")).agg(F.count("*").alias("n"), F.max(weight).alias("weight"))


def _lists(s, d):
    sec, q = sections(s, d), questions(s, d)
    return [job.seeds(sec.select("section_uid", column), q, index=_index(s, d, (column,))) for column in ("heading", "body")]


def rank_rrf_sum(s, d):
    return lexical.top_k(fuse.rrf_sum(_lists(s, d), [1.0, 0.5]), 20)


def boost_context(s, d):
    contexts = questions(s, d).select("qid", F.lit("example").alias("app"), F.concat(F.lit("src"), (F.col("qid") % 20).cast("string")).alias("cwd"))
    rows = results(s, d, body=True).withColumn("title", F.col("heading")).withColumn("heading_path", F.col("path"))
    return context.boosted(rows, contexts).select("qid", "uid", F.col("rank").cast("long").alias("rank"), "active_app", "current_project")


def ctx_informal_name(s, d):
    return table(s, d, "pages").select("page_id", context.informal_name(actions.host(F.col("url"))).alias("app"))


def boost_recent(s, d):
    """Events open documents; questions are asked an hour after each other."""
    opened = stream(s, d).select((F.col("event_id") * 7 % 997).alias("uid"), "ts")
    asked_at = questions(s, d).select("qid", (F.lit("2024-01-05").cast("timestamp") + F.make_dt_interval(hours=F.col("qid").cast("int"))).alias("ts"))
    out = fuse.boost_recent(results(s, d), asked_at, opened, 2)
    return out.select("qid", "uid", F.col("rank").cast("long").alias("rank"), F.round("score", 9).alias("score"), "recent")


def trust_weight(s, d):
    """Languages as classes of sources, and every tenth document a correction besides."""
    kind = F.expr("CASE lang WHEN 'en' THEN 'note' WHEN 'fr' THEN 'code' WHEN 'de' THEN 'old' WHEN 'es' THEN 'imported' END")
    docs = table(s, d, "documents").select(F.col("doc_id").alias("uid"), kind.alias("trust"))
    every = docs.filter("uid % 10 > 0").union(docs.filter("uid % 10 = 0").withColumn("trust", F.lit("correction")))
    out = fuse.by_trust(results(s, d), every)
    return out.select("qid", "uid", F.col("rank").cast("long").alias("rank"), F.round("score", 9).alias("score"), "trust")


def src_second_store(s, d):
    """Pages beside the documents: they have numbers only, and no relations."""
    pages = tables.page_sections(table(s, d, "pages"))
    page_index = index.current(table(s, d, "pages"), pages, job.column_weights(pages, Search()), shared_folder(s))
    own = _index(s, d)
    every = [stores.Store("vault", looked_at(s, d), own, own.steps, True), stores.Store("page", pages, page_index)]
    out = stores.retrieve(every, questions(s, d))
    return out.select("qid", "source_kind", "number", "section_uid", F.col("rank").cast("long").alias("rank"), F.round("score", 9).alias("score"), "via", F.sha2("body", 256).alias("body_sha256"))


def _blocks(s, d):
    body = pack.cut(pack.sanitised(F.col("body")))
    return results(s, d, body=True).withColumn("block", pack.block(F.col("rank"), F.col("path"), F.col("heading"), F.lit(1), body))


def pack_greedy(s, d):
    return pack.packed(_blocks(s, d), BUDGET, Search().context_sections).select("qid", "uid", F.col("rank").cast("long").alias("rank"), F.col("bytes_used").cast("long").alias("bytes_used"))


def pack_budget(s, d):
    """The budget that a model leaves, and one source fewer where three bytes to a token say that it isn't kept."""
    budget, most = pack.budget(1_944, 1_024), Search().context_sections
    blocks = _blocks(s, d).withColumn("n_found", F.count("*").over(W.partitionBy("qid")))
    kept = pack.recounted(pack.packed(blocks, budget, most), F.ceil(F.octet_length("block") / 3), budget, most)
    return kept.select("qid", "uid", F.col("rank").cast("long").alias("rank"), F.col("counted").cast("long").alias("counted"))


def pack_prompts(s, d):
    out = pack.prompts(pack.packed(_blocks(s, d), BUDGET, Search().context_sections), questions(s, d))
    return out.select("qid", F.sha2("prompt", 256).alias("prompt_sha256"), "sources")


def q_gate(s, d):
    """A high gate, so that some questions fall below it."""
    return pack.gated(results(s, d), questions(s, d), 0.0213).select("qid", "confident", F.array_join("closest", ",").alias("closest"))


def q_section_lookup(s, d):
    """The sections of listed uids in the order of the list."""
    wanted = questions(s, d).select("qid", F.array(F.col("qid") % 7, F.lit(-1).cast("long"), F.col("qid") % 5, F.col("qid") % 7).alias("uids"))
    return job.looked_up(wanted, looked_at(s, d)).select("qid", F.col("place").cast("long").alias("place"), "uid", "heading")


def pack_correction(s, d):
    """The best correction of a question before the question of its prompt."""
    best = memory.best_corrections(questions(s, d), corrections(s, d), fuzzy=True).join(corrections(s, d).select("id", "answer", "stale"), "id")
    plain = questions(s, d).select("qid", F.concat(F.lit("Question: none\n"), F.lit("Question: "), "question").alias("prompt"))
    rows = plain.join(best, "qid", "left").withColumn("block", F.coalesce(memory.correction_block(F.col("answer"), F.col("stale")), F.lit("")))
    return rows.select("qid", F.sha2(pack.with_correction(F.col("prompt"), F.col("block")), 256).alias("prompt_sha256"))


def cache_get(s, d):
    """Turns ask for the answers of their own texts."""
    keys = turns(s, d).select("conv_id", "turn", F.sha2("text", 256).alias("key"))
    return memory.lookup(keys, cache_upsert(s, d)).select("conv_id", "turn", F.sha2("answer", 256).alias("answer_sha256"))


def prov_rate(s, d):
    """Events rate documents; the last one of a document counts."""
    ratings = stream(s, d).select((F.col("event_id") % 500).alias("id"), F.when(F.col("value") > 50, 1).otherwise(-1).alias("rating"), F.struct("ts", "event_id").alias("ts"))
    return memory.rating_counts(memory.rate(provenance(s, d), ratings))


def corr_list(s, d):
    rows = corrections(s, d).withColumn("stale", F.col("id") % 3 == 0)
    return memory.listed(rows).select(F.col("place").cast("long").alias("place"), "id", "n_stale")


def corr_delete(s, d):
    return memory.standing(corrections_log(s, d)).select("id", "normalized", "created_at", "writes")


def bench_latency(s, d):
    """Events as runs of the question of their type; some don't reach generation."""
    reached = F.col("event_id") % 3 > 0
    runs = stream(s, d).select(F.col("event_type").alias("question"), F.struct("ts", "event_id").alias("run"), F.col("value").alias("total_ms"), F.when(reached, F.floor(F.col("value") / 2)).otherwise(0).cast("double").alias("ttft_ms"), F.when(reached, F.col("value")).otherwise(0.0).alias("generation_ms"), (F.col("event_id") % 50).alias("output_tokens"))
    return bench.latency(runs).withColumn("tokens_per_second", F.round("tokens_per_second", 6))


def cache_key(s, d):
    packed = pack.packed(_blocks(s, d), BUDGET, Search().context_sections)
    return memory.cache_keys(packed.select("qid", "rank", "uid", "body"), None, 1, 200, 0.2, 0)


def cache_upsert(s, d):
    before = F.lag("text").over(W.partitionBy("conv_id").orderBy("turn"))
    writes = turns(s, d).withColumn("question", before).filter("role = 'assistant' AND question IS NOT NULL")
    writes = writes.select(F.sha2("question", 256).alias("key"), F.col("text").alias("answer"), F.concat(F.lit("m"), (F.col("conv_id") % 3).cast("string")).alias("model"), F.col("conv_id").alias("created_at"), (F.col("conv_id") * 1000 + F.col("turn")).alias("seq"))
    return memory.upserted(writes)


def prov_counts(s, d):
    return memory.rating_counts(provenance(s, d))


def prov_rated(s, d):
    return memory.rated(provenance(s, d))


def prov_recent_ring(s, d):
    return memory.recent(turns(s, d).filter("role = 'user'"), ["conv_id"], "turn", 8).select("conv_id", "turn", F.col("age").cast("long").alias("age"))


def corr_normalize(s, d):
    return asked(s, d).select("qid", T.normalized(F.col("question")).alias("normalized"))


def corr_save(s, d):
    writes = asked(s, d).select("question", F.col("question").alias("answer"), F.col("qid").alias("created_at"), F.col("qid").alias("seq"))
    return memory.saved_corrections(writes).select("id", "normalized", "created_at", "writes", "stale")


def corr_jaccard_best(s, d):
    """The benchmark items are the corrections, and asked again; so are the user turns."""
    every = questions(s, d).union(asked(s, d).select(F.col("qid") + 1_000_000, "question"))
    return memory.best_corrections(every, corrections(s, d), 0.2, fuzzy=True)


def corr_staleness(s, d):
    docs = documents(s, d).select(F.col("source").alias("correction_id"), F.col("doc_id").alias("section_uid"), F.sha2("text", 256).alias("content_hash"))
    gone = table(s, d, "labels").filter("quality = 0 AND toxic = 1").select(F.col("doc_id").alias("section_uid"))
    return memory.staleness(docs, docs.join(gone, "section_uid", "left_anti"))


def _declared(s, d):
    """An action of each document: files exist for even numbers, and applications are named after nations."""
    kind = F.expr("CASE lang WHEN 'en' THEN 'file' WHEN 'fr' THEN 'url' WHEN 'de' THEN 'app' WHEN 'es' THEN 'video' ELSE 'project' END")
    target = F.when(F.col("lang") == "de", F.element_at(F.array(*map(F.lit, ("nation_7", "org.nation.nation_13", "nation_", "nowhere"))), (F.col("doc_id") % 4 + 1).cast("int"))).otherwise(F.concat_ws("/", "lang", "source"))
    rows = documents(s, d).select(F.col("doc_id").alias("section_uid"), kind.alias("kind"), target.alias("target"), (F.col("doc_id") % 9).cast("int").alias("line"), F.when(F.col("doc_id") % 2 == 0, F.col("doc_id")).alias("seconds"))
    there = rows.filter("kind = 'file' AND section_uid % 2 = 0").select("target")
    return actions.resolved(rows, there, _apps(s, d)).withColumn("seq", F.lit(1))


def _apps(s, d):
    return table(s, d, "nation").select(F.concat(F.lit("org.nation."), F.initcap("n_name")).alias("app_id"), F.initcap("n_name").alias("app_name"))


def act_resolve(s, d):
    return _declared(s, d).select("section_uid", "kind", "label", "enabled", F.col("slot").cast("long").alias("slot"), F.col("to.value").alias("target"), F.col("to.line").alias("line"), F.col("to.seconds").alias("seconds"))


def act_app_resolve(s, d):
    """Beginnings of the names of nations, of which some have one nation only."""
    names = table(s, d, "nation").select(F.explode(F.transform(F.sequence(F.lit(1), F.length("n_name")), lambda k: F.concat(F.lit(" "), F.substring("n_name", F.lit(1), k)))).alias("name")).distinct()
    return actions.resolve_app(names, _apps(s, d))


def act_expand(s, d):
    pages = table(s, d, "pages").select("page_id", "url", F.when(F.col("page_id") % 3 > 0, F.col("page_id")).alias("seconds"))
    to = actions.typed(F.when(F.col("page_id") % 2 == 0, "video").otherwise("url"), F.col("url"), F.lit(1), F.col("seconds"))
    argv = {"player": F.array(F.lit("mpv"), F.lit("--start={seconds}"), F.lit("{url}")), "opener": F.array(F.lit("open"), F.lit("{url}"))}
    return pages.select("page_id", *[F.array_join(actions.expanded(a, to), " ").alias(name) for name, a in argv.items()])


OPENERS = {"markdown": ["nvim", "{path}"], "text": ["code", "-g", "{path}:{line}"], "project": ["code", "{path}"], "url": ["open", "{url}"], "video": ["missing", "{url}"]}


def act_template(s, d):
    kinds = F.when(F.col("to.type") == "file", F.struct(F.lit("file").alias("type"), F.concat("to.value", F.when(F.col("section_uid") % 2 == 0, ".MD").otherwise(".rs")).alias("value"), "to.line", "to.seconds")).otherwise(F.col("to"))
    rows = _declared(s, d).withColumn("to", kinds)
    return rows.select("section_uid", F.array_join(actions.expanded(actions.template(F.col("to"), OPENERS, {"mpv"}), F.col("to")), " ").alias("argv"))


def act_offered(s, d):
    declared = _declared(s, d)
    out = actions.offered(results(s, d).select("qid", "uid", "rank", "path", "heading"), declared)
    return out.select("qid", F.col("id").cast("long").alias("id"), F.col("slot").cast("long").alias("slot"), "kind", "label", F.col("to.value").alias("target"), "enabled")


def act_labels(s, d):
    seconds = F.floor(F.col("value") * 100).cast("long")
    return stream(s, d).select("event_id", actions.time_label(seconds).alias("label"))


def act_urls(s, d):
    return table(s, d, "pages").select("page_id", actions.host(F.col("url")).alias("host"), actions.with_time(F.col("url"), F.col("page_id")).alias("timed"))


def _outcomes(s, d, *found):
    """The ranks in each of the results that are found; what is expected is looked up once for all."""
    expected = lex_all_terms(s, d).groupBy("qid").agg(F.collect_list("uid").alias("expected"))
    wanted = questions(s, d).join(expected, "qid", "left").withColumn("expected", F.coalesce("expected", F.array().cast("array<long>")))
    return [bench.ranks(wanted, x) for x in found]


def _outcomes_of_lists(s, d):
    return _outcomes(s, d, *[x.withColumn("rank", F.col("position") + 1) for x in _lists(s, d)])


def bench_recall_mrr(s, d):
    out = bench.report(*_outcomes(s, d, results(s, d)))
    return out.select("n", *[F.round(c, 9).alias(c) for c in ("recall_1", "recall_3", "recall_5", "mrr")])


def bench_modes(s, d):
    """The report with the graph (0) and without it (1)."""
    found = _outcomes(s, d, *[results(s, d, config=c) for c in (Search(), LEXICAL)])
    every = [x.withColumn("combo", F.lit(k).cast("long")) for k, x in enumerate(found)]
    out = bench.report(every[0].union(every[1]), ["combo"])
    return out.select("combo", "n", *[F.round(c, 9).alias(c) for c in ("recall_1", "recall_3", "recall_5", "mrr")])


def bench_diff(s, d):
    heads, bodies = _outcomes_of_lists(s, d)
    name = F.col("qid").alias("question")
    out = bench.moved(heads.select(name, "rank"), bodies.select(name, "rank", F.col("qid").alias("pos")))
    return out.select(*[F.col(c).cast("long").alias(c) for c in ("place", "question", "was", "now", "delta")])


def bench_sweep_best(s, d):
    """Two columns alone as combinations of weights."""
    every = [x.withColumn("combo", F.lit(k)) for k, x in enumerate(_outcomes_of_lists(s, d))]
    out = bench.best_combination(bench.report(every[0].union(every[1]), ["combo"]))
    return out.select(F.col("combo").cast("long").alias("combo"), "n", F.round("mrr", 9).alias("mrr"))


def bench_percentiles(s, d):
    return bench.percentiles(stream(s, d), "value", {"p50": 0.5, "p95": 0.95, "p99": 0.99}, ["event_type"])


def st_debounce(s, d):
    out = st.bursts(st.content_changes(stream(s, d).withColumn("event_type", F.regexp_replace("event_type", "^view$", "access")), "event_type"), "6 hours", ["user_id"])
    return out.select("user_id", utc("started"), utc("ended"), "n")


def st_supersede(s, d):
    q = stream(s, d).select(F.col("event_id").alias("query_id"), F.col("user_id").alias("conn"), "ts", F.timestamp_micros(F.unix_micros("ts") + F.round(F.col("value") * 600).cast("long") * 1_000_000).alias("ended"))
    return st.superseded(q).select("query_id", "cancelled")


def st_settled(s, d):
    return st.settled(stream(s, d), ["user_id"], "event_type", 3600.0).select("event_id", "user_id", "event_type")


def st_history(s, d):
    return st.history(stream(s, d), ["user_id"], "event_type", ["ts", "event_id"], 100).select("event_id", "user_id", F.col("age").cast("long").alias("age"))


def st_status(s, d):
    return st.status(stream(s, d), ["event_type"], "value").select("event_type", "n", utc("last_ts"), "last_value")


def st_token_batch(s, d):
    """Events as tokens of the query of their hour; errors are other events, and ticks come every three hours."""
    rows = stream(s, d).withColumn("text", F.when(F.col("event_type") != "error", F.col("event_type"))).withColumn("query_id", F.hour("ts").cast("string"))
    return st.token_batches(rows, "user_id", 3 * 3_600_000).select("user_id", "query_id", utc("started"), "n", "text")


def st_path_filter(s, d):
    """Events as changes of files: users are folders, of which some are hidden."""
    folder = F.element_at(F.array(*map(F.lit, ("notes", ".git", "target", "src"))), (F.col("user_id") % 4 + 1).cast("int"))
    paths = F.concat(F.when(F.col("event_id") % 7 == 0, "/vault").otherwise("/v"), F.when(F.col("event_id") % 11 == 0, "").otherwise(F.concat(F.lit("/"), folder, F.lit("/"), "event_type", F.lit(".md"))))
    return st.relevant_paths(stream(s, d).withColumn("path", paths), "/v/").select("event_id", "path")


def st_stale_event_drop(s, d):
    """Every third event of a user asks a question; each event belongs to the one of its number or of the one before."""
    rows = stream(s, d).withColumn("n", F.row_number().over(W.partitionBy("user_id").orderBy("ts", "event_id")))
    asks = rows.filter("n % 3 = 1").select(F.col("user_id").alias("conn"), F.floor(F.col("n") / 3).cast("long").alias("query_id"), "ts")
    answers = rows.select("event_id", F.col("user_id").alias("conn"), F.floor((F.col("n") - F.when(F.col("event_id") % 2 == 0, 1).otherwise(4)) / 3).cast("long").alias("query_id"), "ts")
    return st.current_events(answers, asks).select("event_id", "query_id")


def gen_think_filter(s, d):
    answers = turns(s, d).filter("role = 'assistant'").withColumn("raw", F.concat(F.lit("<think>"), F.substring("text", 1, 20), F.when(F.col("turn") % 4 == 1, "</think>").otherwise(""), F.col("text")))
    return answers.select("conv_id", "turn", F.sha2(T.without_thinking(F.col("raw")), 256).alias("answer_sha256"))


def st_generation_poll(s, d):
    rows = stream(s, d).withColumn("generation", F.get_json_object("props", "$.k").cast("long"))
    return st.generation_changes(rows, ["user_id"]).select("event_id", "generation")


ALIASES = {"Files": ["www.example"], "News": ["news", "blog.example"], "is": ["docs.example.org"]}


def ctx_alias(s, d):
    rows = table(s, d, "pages").select("page_id", actions.host(F.col("url")).alias("wm_class"))
    return context.alias_for(rows, ALIASES).select("page_id", "app")


def ctx_app_in_query(s, d):
    return asked(s, d).select("qid", context.app_named_in(F.col("question"), {"The": [], "data": [], "Zoo": []}).alias("app"))


def ctx_bucket(s, d):
    host = actions.host(F.col("url"))
    return table(s, d, "pages").select("page_id", context.bucket(F.when(F.col("page_id") % 3 > 0, host), F.when(F.col("page_id") % 2 > 0, F.concat(F.lit("/"), host))).alias("bucket"))


def ctx_default(s, d):
    rows = stream(s, d).withColumn("context", F.when(F.col("event_type") == "click", F.get_json_object("props", "$.k")).otherwise(""))
    return context.with_default(rows, ["user_id"], ["ts", "event_id"]).select("event_id", "effective_context")


def vec_topk(s, d):
    every = table(s, d, "embeddings")
    return vectors.top_k(every.filter(F.col("vec_id") % QUERY_EVERY == 0), every, 30)


def vec_index_topk(s, d):
    """The queries of vec_topk by the index of cells, which looks into further cells until no other row can be among the best."""
    every = table(s, d, "embeddings")
    return cells.top_k(cells.build(every), every.filter(F.col("vec_id") % QUERY_EVERY == 0), 30, exact=True)


def vec_hybrid(s, d):
    """Items ask with their words, and with the vector of their number; both lists count."""
    vectors_ = table(s, d, "embeddings")
    asks = vectors_.join(questions(s, d).select(F.col("qid").alias("vec_id")), "vec_id", "left_semi")
    near = cells.top_k(cells.build(vectors_), asks, 30, exact=True)
    words = job.seeds(looked_at(s, d), questions(s, d), index=_index(s, d))
    return lexical.top_k(fuse.rrf_sum([words, near], [1.0, 0.7]), 20)


def vec_mrl_truncate(s, d):
    cut = vectors.shortened(table(s, d, "embeddings"), 32)
    return cut.select("vec_id", F.size("vector").cast("long").alias("dims"), F.round(F.get("vector", F.lit(0)), 6).alias("first"), F.round(F.get("vector", F.lit(31)), 6).alias("last"))


def sink_jsonl(s, d):
    """Turns as lines and back; some lines are broken off."""
    sent = turns(s, d).select("conv_id", "turn", "text", ((F.col("conv_id") + F.col("turn")) % 7 == 0).alias("broken"))
    text = lines.to_lines(sent.select("conv_id", "turn", "text"))
    broken = lines.to_lines(sent.filter("broken").select("conv_id", "turn", "text")).select(F.expr("substring(value, 1, length(value) - 2)").alias("value"))
    whole = text.filter((F.get_json_object("value", "$.conv_id").cast("long") + F.get_json_object("value", "$.turn").cast("long")) % 7 != 0)
    got = lines.from_lines(whole.union(broken), "conv_id long, turn long, text string")
    return got.groupBy("conv_id", "malformed").agg(F.count("*").alias("n"), F.sum("turn").alias("turns"), F.sum(F.length("text")).alias("chars"))


def _path(s, name):
    return f"{shared_folder(s)}/{name}-{uuid.uuid4().hex}"


def sink_json_report(s, d):
    """The report of two combinations, written and read as a baseline."""
    path, every = _path(s, "report"), [x.withColumn("combo", F.lit(k)) for k, x in enumerate(_outcomes_of_lists(s, d))]
    lines.write_report(bench.report(every[0].union(every[1]), ["combo"]), path)
    return lines.read_report(s, path).select("combo", "n", *[F.round(c, 9).alias(c) for c in ("recall_1", "recall_3", "recall_5", "mrr")])


def sink_bench_export(s, d):
    """Well-rated answers as a question file, which is read back."""
    uids = F.when(F.col("id") % 3 > 0, F.array(F.col("id").cast("string"), (F.col("id") + 1).cast("string"))).otherwise(F.array().cast("array<string>"))
    path = _path(s, "questions")
    lines.write_questions(memory.exported(provenance(s, d).withColumn("section_uids", uids)), path)
    return lines.read_questions(s, path).select("question", F.array_join("expected", ",").alias("expected"), "context", "note")


def src_questions_yaml(s, d):
    """Items as YAML question files, which are read back: expected uids with marks, some without a context, notes of two lines."""
    uids = F.when(F.col("qid") % 3 > 0, F.array(F.concat(F.lit("n#"), "qid"), F.concat(F.lit("it's, \"x\" # "), F.col("qid") + 1))).otherwise(F.array().cast("array<string>"))
    path = _path(s, "questions")
    rows = questions(s, d).select("qid", "question", uids.alias("expected"), F.when(F.col("qid") % 2 == 0, "vim: ~").alias("context"), F.concat(F.lit("- first\n  note: "), "qid").alias("note"))
    lines.write_question_list(rows, path)
    return lines.read_question_list(s, path).select("question", F.array_join("expected", "|").alias("expected"), "context", "note")


def q_source_refs(s, d):
    rows = results(s, d, body=True).withColumn("heading_path", F.col("heading")).withColumn("start_line", F.lit(1).cast("long"))
    return fuse.source_refs(rows).withColumn("rank", F.col("rank").cast("long")).withColumn("score", F.round("score", 9))


def q_actions_lookup(s, d):
    wanted = questions(s, d).select("qid", F.array(F.col("qid") % 7, F.col("qid") % 5, F.lit(-1).cast("long")).alias("uids"))
    return actions.looked_up(wanted, _declared(s, d)).select("qid", "section_uid", "kind", "label", "enabled")


def prov_record(s, d):
    """User turns are recorded after the documents."""
    new = asked(s, d).select(F.col("question").alias("query"), F.col("qid").alias("seq"))
    return memory.recorded(provenance(s, d), new).select("id", "query", "rating")


def corr_stale_count(s, d):
    return memory.stale_count(corrections(s, d).withColumn("stale", F.col("id") % 3 == 0))


def corr_version(s, d):
    return memory.version(corrections_log(s, d))


def src_desktop_entries(s, d):
    """Entries of customers in a folder of all and in one of the even ones, which comes first."""
    text = lambda *parts: F.concat(F.lit("[Desktop Entry]\n"), *parts, F.lit("\n[Desktop Action new]\nName=Other\nNoDisplay=true\n"))
    rows = table(s, d, "customer").select(F.concat(F.lit("app"), "c_custkey").alias("app_id"), "c_custkey", "c_name")
    own = rows.filter("c_custkey % 2 = 0").select(F.lit(0).alias("dir_rank"), "app_id", text(F.lit("Name="), "c_name", F.lit("\nExec=own %U"), F.when(F.col("c_custkey") % 10 == 0, "\nHidden=true").otherwise("")).alias("content"))
    shared = rows.select(F.lit(1).alias("dir_rank"), "app_id", text(F.lit("Exec=shared %U\nName = Shared "), "c_custkey", F.when(F.col("c_custkey") % 3 == 0, "\nNoDisplay=true").otherwise("")).alias("content"))
    return vault.desktop_entries(own.union(shared))


def _write_notes(s, rows, root):
    """Rows (note, part, text) as files of the root that are named by their notes; a file that is there is replaced."""
    path, temporary = s._jvm.org.apache.hadoop.fs.Path, _path(s, "files")
    rows.repartition("note").sortWithinPartitions("note", "part").select("note", "text").write.partitionBy("note").text(temporary)
    fs = path(root).getFileSystem(s._jsc.hadoopConfiguration())
    fs.mkdirs(path(root))
    for folder in fs.listStatus(path(temporary)):
        if folder.isDirectory():
            name = folder.getPath().getName().split("=", 1)[1]
            parts = [f.getPath() for f in fs.listStatus(folder.getPath()) if f.getPath().getName().startswith("part-")]
            fs.delete(path(f"{root}/{name}.md"), False)
            fs.rename(parts[0], path(f"{root}/{name}.md"))
    fs.delete(path(temporary), True)
    return fs, path


def src_vault_scan(s, d):
    """Notes of fifty documents each are scanned; then some get a section, some are written again as they were, some go, and one breaks."""
    root, store = _path(s, "vault"), _path(s, "notes")
    docs = documents(s, d).withColumn("k", F.floor(F.col("doc_id") / 50)).withColumn("note", F.concat_ws("-", F.lit("n"), "k"))
    text = F.concat(F.lit("# Document {#d"), "doc_id", F.lit("}\n\n"), F.regexp_replace("text", r"[#`\r]", " "), F.lit("\n"))
    rows = docs.select("note", "k", F.col("doc_id").alias("part"), text.alias("text"))
    _write_notes(s, rows, root)
    notes, first = notes_job.scan(s, root, store)
    out = [first.withColumn("scan", F.lit(1)).crossJoin(F.broadcast(notes.sections.agg(F.count("*").alias("sections"))))]
    more = rows.filter("k % 4 = 0").groupBy("note").agg(F.lit(1 << 40).alias("part"), F.lit("# Added {#added}\n\nmore\n").alias("text"))
    fs, path = _write_notes(s, rows.filter("k % 4 < 2").select("note", "part", "text").unionByName(more.select("note", "part", "text")), root)
    for row in rows.filter("k % 4 = 2").select("note").distinct().collect():  # one for two hundred documents
        fs.delete(path(f"{root}/{row.note}.md"), False)
    broken = fs.create(path(f"{root}/n-3.md"), True)
    broken.write(bytearray(b"# Broken\n\n\xff\xfe\n"))
    broken.close()
    notes, second = notes_job.scan(s, root, store)
    out.append(second.withColumn("scan", F.lit(2)).crossJoin(F.broadcast(notes.sections.agg(F.count("*").alias("sections")))))
    return out[0].union(out[1]).select(F.col("scan").cast("long").alias("scan"), "indexed", "unchanged", "removed", "failed", "sections")


def src_path_absolutise(s, d):
    paths = F.concat(F.when(F.col("page_id") % 3 == 0, "/else/").otherwise("notes/"), "page_id")
    return table(s, d, "pages").select("page_id", vault.absolute(paths, "/vault/").alias("path"))


def _lines_as_results(s, d):
    """Lines of documents as the sections that were found for a question about each document; each third line is missing."""
    rows = tables.line_sections(documents(s, d)).filter("line % 3 > 0").withColumn("line", F.col("line").cast("long"))
    return rows.select(F.col("doc_id").alias("qid"), F.lit("note").alias("path"), F.col("line").alias("order_index"), (-F.col("line")).alias("rank"), "body")


def pack_merge_adjacent(s, d):
    return pack.merged_adjacent(_lines_as_results(s, d)).select("qid", "first", "n", "rank", F.sha2("body", 256).alias("body_sha256"))


def pack_parent_dedupe(s, d):
    """Lines of even numbers are parts of the line before."""
    rows = _lines_as_results(s, d).select("qid", F.col("order_index").alias("uid"), F.when(F.col("order_index") % 2 == 0, F.col("order_index") - 1).alias("parent_uid"), F.concat(F.lit("line "), "order_index").alias("heading_path"))
    return pack.without_parents(rows).select("qid", "uid", "heading_path")


def _parts(s, d):
    """Long documents in parts beside the short ones."""
    rows = documents(s, d).select(F.col("doc_id").alias("section_uid"), F.col("text").alias("body"))
    return vault.subchunks(rows, 300, 120, 20)


def parse_subchunk(s, d):
    """What the parts of a document amount to: none is above the bound, and joined they are the document."""
    parts = _parts(s, d).withColumn("doc_id", F.coalesce("parent_uid", "section_uid").cast("long"))
    whole = vault.joined_parts(parts.withColumn("parent_uid", F.col("doc_id")), ["doc_id"])
    sizes = parts.groupBy("doc_id").agg((F.max(F.when(F.col("parent_uid").isNotNull(), F.octet_length("body"))) <= int(120 * vault.TOKEN_BYTES)).alias("within"))
    return whole.join(sizes, "doc_id").select("doc_id", (F.col("n") > 1).alias("cut"), F.sha2("body", 256).alias("body_sha256"), F.coalesce("within", F.lit(True)).alias("within"))


def pack_parts(s, d):
    """Every document is found, and so are those of its parts that hold a digit; a document with a part among them goes."""
    parts = _parts(s, d).filter("parent_uid IS NULL OR body RLIKE '[0-9]'").select(F.col("section_uid").alias("uid"), "parent_uid")
    wholes = parts.select(F.col("parent_uid").alias("uid"), F.lit(None).cast("string").alias("parent_uid")).filter("uid IS NOT NULL").distinct()
    cut = documents(s, d).select(F.col("doc_id").cast("string").alias("uid"), F.lit(None).cast("string").alias("parent_uid"))
    rows = cut.union(parts.filter("parent_uid IS NOT NULL")).union(wholes).distinct().select(F.lit(1).alias("qid"), "*", F.concat(F.lit("path of "), "uid").alias("heading_path"))
    kept = pack.without_parents(rows)
    return kept.groupBy(F.coalesce("parent_uid", "uid").cast("long").alias("doc_id")).agg(F.bool_or(F.col("parent_uid").isNotNull()).alias("by_parts"), F.max("heading_path").alias("heading_path"))


def parse_front_matter(s, d):
    content = F.concat(F.lit('---\nid: n'), "doc_id", F.lit('\ntitle: "A: '), "lang", F.lit('"\ntags: [a, '), "source", F.lit(', ]\napps: []\n'), F.when(F.col("doc_id") % 2 == 0, F.lit("supersedes: old\nstatus: draft\n")).otherwise(""), F.lit("status:  current \n"), F.when(F.col("doc_id") % 5 > 0, "---\n").otherwise(""), F.lit("project: none\n# Text"))
    rows = vault.note_fields(documents(s, d).select(F.col("doc_id").alias("path"), content.alias("content")))
    return rows.select("path", "id", "title", "topic", F.array_join("tags", ",").alias("tags"), F.size("apps").cast("long").alias("n_apps"), "project", "status", "supersedes")


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    names = """lex_bm25_topk lex_all_terms q_tokenize_stats q_phrase q_snippet q_no_answer q_stats parse_lines parse_token_estimate
        src_page_sections src_page_links src_glob_filter src_change_gate g_expand_2hop g_pagerank_10 g_contradictions retrieve_ranked
        rank_status rank_rrf_sum boost_context ctx_informal_name ctx_default pack_greedy pack_prompts cache_key cache_upsert prov_counts prov_rated
        prov_recent_ring corr_normalize corr_save corr_jaccard_best corr_staleness act_offered act_labels act_urls bench_recall_mrr
        bench_diff bench_sweep_best bench_percentiles st_debounce st_supersede st_settled st_history st_status st_token_batch
        st_generation_poll vec_topk vec_mrl_truncate act_resolve act_app_resolve act_expand act_template st_path_filter st_stale_event_drop
        gen_think_filter ctx_alias ctx_app_in_query ctx_bucket g_unresolved_contradictions g_neighbourhood parse_edges parse_actions
        parse_note_sections src_glob_count vec_queue q_gate q_section_lookup pack_correction cache_get prov_rate corr_list corr_delete
        bench_latency sink_jsonl sink_json_report sink_bench_export q_source_refs q_actions_lookup prov_record corr_stale_count corr_version
        src_desktop_entries src_path_absolutise src_vault_scan src_questions_yaml lex_weights_sweep q_unsearchable g_disabled trust_weight pack_budget bench_modes src_second_store boost_recent vec_index_topk vec_hybrid parse_subchunk pack_parts pack_merge_adjacent pack_parent_dedupe parse_front_matter"""
    return {name: globals()[name] for name in names.split()}
