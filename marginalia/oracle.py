"""SQL for DuckDB that gives the rows of the registered queries."""

from __future__ import annotations

from marginalia.functions.text import FOLD_FROM, FOLD_TO, STOPWORDS, WHITE
from marginalia.queries import BUDGET, QUERY_EVERY

STOPS = ", ".join(f"'{w}'" for w in STOPWORDS)


def tok(x: str) -> str:
    return f"list_filter(regexp_split_to_array(translate(lower(coalesce({x}, '')), '{FOLD_FROM}', '{FOLD_TO}'), '[^\\p{{L}}\\p{{N}}_.-]+'), lambda t: t <> '')"


def qtok(x: str) -> str:
    return f"list_filter(list_transform({tok(x)}, lambda t: regexp_replace(t, '[.-]+$', '')), lambda t: t <> '' AND t NOT IN ({STOPS}))"


EDGE = r"^[^\p{L}\p{N}]+|[^\p{L}\p{N}]+$"


def words(x: str) -> str:
    return f"list_transform(regexp_split_to_array(lower({x}), '\\s+'), lambda w: regexp_replace(w, '{EDGE}', '', 'g'))"


def norm(x: str) -> str:
    kept = f"list_filter({words(x)}, lambda w: w <> '' AND w NOT IN ({STOPS}))"
    return f"CASE WHEN len({kept}) > 0 THEN array_to_string({kept}, ' ') ELSE array_to_string(list_filter(regexp_split_to_array(lower({x}), '\\s+'), lambda w: w <> ''), ' ') END"


SEC = """sec AS (SELECT d.doc_id AS uid, split_part(text, chr(10), 1) AS heading, substr(text, length(split_part(text, chr(10), 1)) + 2) AS body, source AS path,
  CASE WHEN toxic = 1 THEN 'archived' WHEN quality = 1 THEN 'current' WHEN quality = 0 THEN 'obsolete' END AS status FROM documents d LEFT JOIN labels l USING (doc_id))"""
QT = f"""qw AS (SELECT item_id AS qid, {qtok('text')} AS w FROM benchmark),
qs AS (SELECT qid, len(w) AS n, unnest(w) AS term, unnest(range(len(w))) AS slot FROM qw),
qt AS (SELECT qid, term, min(slot) AS slot, bool_or(slot = n - 1) AS last FROM qs GROUP BY ALL)"""


def bm25(name: str, columns: dict[str, float], k: int = 30, sec: str = "sec") -> str:
    """CTEs that end in `name`: (qid, uid, score, position)."""
    rows = " UNION ALL ".join(f"SELECT uid, unnest({tok(c)}) AS term, {w}::DOUBLE AS w FROM {sec}" for c, w in columns.items())
    size = " + ".join(f"len({tok(c)})" for c in columns)
    return f"""{name}_p AS (SELECT uid, term, sum(w) AS tf FROM ({rows}) GROUP BY ALL),
{name}_d AS (SELECT uid, {size} AS dl FROM {sec}), {name}_a AS (SELECT count(*) AS n, avg(dl) AS a FROM {name}_d),
{name}_t AS (SELECT qid, slot, term FROM qt UNION SELECT qid, slot, v.term FROM qt JOIN (SELECT DISTINCT term FROM {name}_p) v ON starts_with(v.term, qt.term) WHERE last),
{name}_m AS (SELECT qid, slot, uid, dl, sum(tf) AS tf FROM {name}_p JOIN {name}_t USING (term) JOIN {name}_d USING (uid) GROUP BY ALL),
{name}_f AS (SELECT qid, slot, count(*) AS df FROM {name}_m GROUP BY ALL),
{name}_s AS (SELECT qid, uid, round(sum(greatest(ln((n - df + 0.5) / (df + 0.5)), 1e-6) * (tf * 2.2 / (tf + 1.2 * (0.25 + 0.75 * dl / a)))), 6) AS score FROM {name}_m JOIN {name}_f USING (qid, slot), {name}_a GROUP BY ALL),
{name} AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY qid ORDER BY score DESC, uid) - 1 AS position FROM {name}_s) WHERE position < {k})"""


FULL = {"heading": 8.0, "body": 1.0}
COPIES = """cp AS (SELECT doc_id AS src, m AS dst FROM (SELECT doc_id, min(doc_id) OVER (PARTITION BY text) AS m FROM documents) WHERE doc_id <> m)"""


def layers(roots: str, steps: str, hops: int = 2) -> str:
    """CTEs that end in `ex`: (qid, node, score, hops, via, backwards)."""
    out = f"st AS ({steps}), l0 AS ({roots})"
    for h in range(1, hops + 1):
        out += f""",
l{h} AS (SELECT qid, node, score, via, backwards FROM (SELECT *, row_number() OVER (PARTITION BY qid, node ORDER BY score DESC, via, backwards, "at") AS r FROM
  (SELECT qid, st."to" AS node, st."at" AS "at", score * 0.6::DOUBLE * weight AS score, st.via, st.backwards FROM l{h - 1} JOIN st ON st."at" = l{h - 1}.node)) WHERE r = 1)"""
    every = " UNION ALL ".join(["SELECT qid, node, score, 0 AS hops, NULL::VARCHAR AS via, false AS backwards FROM l0", *(f"SELECT qid, node, score, {h}, via, backwards FROM l{h}" for h in range(1, hops + 1))])
    return out + f""",
ex AS (SELECT qid, node, score, hops, via, backwards FROM (SELECT *, row_number() OVER (PARTITION BY qid, node ORDER BY score DESC, hops) AS r FROM ({every})) WHERE r = 1)"""


STATUS = "CASE status WHEN 'draft' THEN 0.9 WHEN 'archived' THEN 0.4 WHEN 'obsolete' THEN 0.25 ELSE 1.0 END::DOUBLE"
RETRIEVE = f"""{SEC}, {QT}, {COPIES}, {bm25('lex', FULL)},
{layers("SELECT qid, uid AS node, 1.0::DOUBLE / (position + 1) AS score FROM lex WHERE position < 5 AND uid IN (SELECT src FROM cp UNION SELECT dst FROM cp)",
        "SELECT src AS \"at\", dst AS \"to\", 'related' AS via, false AS backwards, 0.6::DOUBLE AS weight FROM cp UNION SELECT dst, src, 'related', true, 0.6::DOUBLE FROM cp")},
nw AS (SELECT qid, node AS uid, hops, via, backwards, row_number() OVER (PARTITION BY qid ORDER BY score DESC, node) - 1 AS position FROM ex WHERE hops > 0 AND score >= 0.05 AND (qid, node) NOT IN (SELECT (qid, uid) FROM lex)),
fu AS (SELECT qid, uid, 0 AS list_no, position, 1.0::DOUBLE / (60 + position + 1) AS score, 0 AS hops, NULL::VARCHAR AS via, false AS backwards FROM lex UNION ALL SELECT qid, uid, 1, position, 1.0::DOUBLE / (60 + position + 1), hops, via, backwards FROM nw),
ws AS (SELECT fu.* EXCLUDE (score), score * {STATUS} AS score, {STATUS} AS status_weight, heading, body, path FROM fu JOIN sec USING (uid)),
tr AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY qid ORDER BY score DESC, list_no, position) AS before FROM ws) WHERE before <= 20),
ht AS (SELECT item_id AS qid, list_distinct(list_filter({words('text')}, lambda w: strlen(w) > 2 AND w NOT IN ({STOPS}))) AS terms FROM benchmark),
hm AS (SELECT tr.*, len(list_filter(terms, lambda t: contains(lower(heading), t))) > 0 AS heading_match FROM tr JOIN ht USING (qid)),
res AS (SELECT * EXCLUDE (score, before), s AS score, row_number() OVER (PARTITION BY qid ORDER BY s DESC, before) AS rank FROM (SELECT *, score * CASE WHEN heading_match THEN 1.3 ELSE 1.0 END::DOUBLE AS s FROM hm))"""
LEXICAL = RETRIEVE.replace(COPIES, "cp AS (SELECT doc_id AS src, doc_id AS dst FROM documents WHERE false)")
ALL_TERMS = """nt AS (SELECT qid, count(*) AS n FROM qt GROUP BY ALL),
al AS (SELECT qid, uid FROM (SELECT qid, uid, count(*) AS h FROM lex_p JOIN (SELECT qid, term FROM qt) USING (term) GROUP BY ALL) JOIN nt USING (qid) WHERE h = n)"""


EXPLAIN = """concat_ws(' · ', CASE WHEN heading_match THEN 'matched heading' WHEN list_no = 0 THEN 'matched text' END,
  CASE WHEN via IS NOT NULL THEN hops || CASE WHEN hops = 1 THEN ' hop ' ELSE ' hops ' END || CASE WHEN backwards THEN 'back to ' ELSE 'to ' END || via END, CASE WHEN status_weight < 1 THEN 'superseded' END)"""
FOUND_LINES = "ln AS (SELECT doc_id, l, n FROM (SELECT doc_id, unnest(string_split(text, chr(10))) AS l, unnest(range(1, len(string_split(text, chr(10))) + 1)) AS n FROM documents) WHERE l <> '' AND n % 3 > 0)"


def clean(x: str) -> str:
    return rf"regexp_replace(replace(replace({x}, '</source>', '<\/source>'), '<source', '<\source'), '[\x00-\x08\x0B-\x1F\x7F-\x9F]', '', 'g')"


def trim(x: str) -> str:
    return f"regexp_replace({x}, '^{WHITE}+|{WHITE}+$', '', 'g')"


PACK = rf"""cl AS (SELECT *, {clean("body")} AS c FROM res), hd AS (SELECT *, substr(c, 1, 4000) AS h FROM cl),
bk AS (SELECT *, CASE WHEN length(c) > 4000 THEN (CASE WHEN contains(h, chr(10) || chr(10)) AND strlen(substr(h, 1, length(h) - instr(reverse(h), chr(10) || chr(10)) - 1)) > strlen(h) // 2 THEN substr(h, 1, length(h) - instr(reverse(h), chr(10) || chr(10)) - 1) ELSE regexp_replace(h, '{WHITE}+$', '') END) || chr(10) || '[…truncated]' ELSE c END AS b FROM hd),
bl AS (SELECT *, '<source ' || rank || '>' || chr(10) || 'path: ' || path || chr(10) || 'heading: ' || heading || chr(10) || 'lines: 1' || chr(10) || b || chr(10) || '</source>' || chr(10) || chr(10) AS block FROM bk),
pk AS (SELECT * FROM (SELECT *, sum(strlen(block)) OVER (PARTITION BY qid ORDER BY rank) AS bytes_used FROM bl) WHERE (bytes_used <= {BUDGET} * 3.6 OR rank = 1) AND rank <= 5)"""
TWO = f"""{SEC}, {QT}, {bm25('lex', FULL)}, {ALL_TERMS}, {bm25('heads', {'heading': 8.0})}, {bm25('bodies', {'body': 1.0})},
rk AS (SELECT q.qid, 0 AS combo, min(position + 1) AS rank FROM (SELECT item_id AS qid FROM benchmark) q LEFT JOIN (SELECT heads.* FROM heads JOIN al USING (qid, uid)) USING (qid) GROUP BY ALL
  UNION ALL SELECT q.qid, 1, min(position + 1) FROM (SELECT item_id AS qid FROM benchmark) q LEFT JOIN (SELECT bodies.* FROM bodies JOIN al USING (qid, uid)) USING (qid) GROUP BY ALL)"""
HOST = "regexp_extract(url, '(?s)^(?:.*?://)?([^/]*)', 1)"
COSINE = "list_transform(embedding, lambda x: x::DOUBLE)"


def unit(v: str) -> str:
    return f"list_transform({v}, lambda x: x / sqrt(list_sum(list_transform({v}, lambda y: y * y))))"


VEC_TOPK = f"""WITH u AS (SELECT vec_id, {unit(COSINE)} AS v FROM embeddings), s AS (SELECT a.vec_id AS qid, b.vec_id AS uid, round(list_dot_product(a.v, b.v), 5) AS score FROM u a, u b WHERE a.vec_id % {QUERY_EVERY} = 0)
SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY qid ORDER BY score DESC, uid) - 1 AS position FROM s) WHERE position < 30"""


def pagerank(iterations: int) -> str:
    out = """WITH e AS (SELECT DISTINCT 'page:' || page_id AS src, 'href:' || h AS dst FROM (SELECT page_id, unnest(regexp_extract_all(html, 'href="([^"]*)"', 1)) AS h FROM pages)),
dg AS (SELECT src AS node, count(*) AS degree FROM e GROUP BY ALL), nd AS (SELECT node, degree FROM (SELECT src AS node FROM e UNION SELECT dst FROM e) LEFT JOIN dg USING (node)),
r0 AS (SELECT node, degree, 1.0::DOUBLE / (SELECT count(*) FROM nd) AS rank FROM nd)"""
    for i in range(1, iterations + 1):
        out += f""",
g{i} AS MATERIALIZED (SELECT dst AS node, sum(rank / degree) AS got FROM e JOIN r{i - 1} ON src = node GROUP BY dst), z{i} AS MATERIALIZED (SELECT coalesce(sum(rank), 0) AS lost FROM r{i - 1} WHERE degree IS NULL),
r{i} AS MATERIALIZED (SELECT node, degree, (1 - 0.85::DOUBLE) / (SELECT count(*) FROM nd) + 0.85::DOUBLE * (coalesce(got, 0) + lost / (SELECT count(*) FROM nd)) AS rank FROM nd LEFT JOIN g{i} USING (node), z{i})"""
    return out + f" SELECT node, round(rank, 9) AS rank FROM r{iterations}"


def modes(name: str, combo: int, retrieve: str) -> str:
    """A report of all questions by one way of retrieval, as one row."""
    cut = ", ".join(f"round(avg(CASE WHEN rank <= {k} THEN 1.0 ELSE 0.0 END), 9) AS recall_{k}" for k in (1, 3, 5))
    return f"""SELECT * FROM (WITH {retrieve}, {ALL_TERMS}, {name} AS (SELECT q.qid, min(rank) AS rank FROM (SELECT item_id AS qid FROM benchmark) q LEFT JOIN (SELECT res.qid, res.rank FROM res JOIN al USING (qid, uid)) USING (qid) GROUP BY ALL)
SELECT {combo}::BIGINT AS combo, count(*) AS n, {cut}, round(avg(coalesce(1.0::DOUBLE / rank, 0)), 9) AS mrr FROM {name})"""


def time_text(c: str) -> str:
    return f"strftime({c}, '%Y-%m-%d %H:%M:%S.%f')"


ASKED = "SELECT conv_id * 1000 + turn AS qid, text AS question FROM conversations WHERE role = 'user'"
LABEL = "CASE WHEN s >= 3600 THEN (s // 3600) || ':' || lpad((s % 3600 // 60)::VARCHAR, 2, '0') ELSE lpad((s // 60)::VARCHAR, 2, '0') END || ':' || lpad((s % 60)::VARCHAR, 2, '0')"


APPS = "ap AS (SELECT 'org.nation.' || upper(n_name[1]) || lower(n_name[2:]) AS app_id, upper(n_name[1]) || lower(n_name[2:]) AS app_name, lower(n_name) AS n FROM nation)"
DECLARED = f"""dc AS (SELECT doc_id, CASE lang WHEN 'en' THEN 'file' WHEN 'fr' THEN 'url' WHEN 'de' THEN 'app' WHEN 'es' THEN 'video' ELSE 'project' END AS kind, lang || '/' || source AS raw, CASE WHEN lang = 'de' THEN ['nation_7', 'org.nation.nation_13', 'nation_', 'nowhere'][doc_id % 4 + 1] END AS app FROM documents),
dr AS (SELECT doc_id AS section_uid, kind, CASE kind WHEN 'file' THEN 1 WHEN 'video' THEN 2 WHEN 'app' THEN 3 WHEN 'project' THEN 4 ELSE 5 END AS slot,
  CASE WHEN kind = 'app' THEN CASE doc_id % 4 WHEN 0 THEN 'org.nation.Nation_7' WHEN 1 THEN 'org.nation.Nation_13' ELSE app END ELSE raw END AS target,
  CASE kind WHEN 'app' THEN CASE doc_id % 4 WHEN 0 THEN 'Nation_7' WHEN 1 THEN 'Nation_13' ELSE app END WHEN 'url' THEN split_part(raw, '/', 1) WHEN 'video' THEN '▶ ' || CASE WHEN doc_id % 2 = 0 THEN LABEL ELSE 'Video' END ELSE split_part(raw, '/', -1) END AS label,
  CASE kind WHEN 'file' THEN raw IN (SELECT raw FROM dc WHERE kind = 'file' AND doc_id % 2 = 0) WHEN 'project' THEN raw IN (SELECT raw FROM dc WHERE kind = 'file' AND doc_id % 2 = 0) WHEN 'app' THEN doc_id % 4 < 2 ELSE true END AS enabled,
  CASE WHEN kind = 'file' THEN greatest(doc_id % 9, 1) END AS line, CASE WHEN kind = 'video' AND doc_id % 2 = 0 THEN doc_id END AS seconds FROM dc)""".replace("LABEL", LABEL.replace("s //", "doc_id //").replace("s >=", "doc_id >=").replace("(s %", "(doc_id %").replace("s %", "doc_id %"))


#: The log of corrections, folded one event after the other: `live` is the id of the form's correction after it, `was` before it.
LOG = f"""WITH RECURSIVE sv AS (SELECT item_id * 10 AS seq, {norm('text')} AS n FROM benchmark UNION ALL SELECT item_id * 10 + 7, {norm('text')} FROM benchmark WHERE item_id % 4 = 0),
dl AS (SELECT item_id * 10 + k AS seq, CASE WHEN item_id % 14 = 0 THEN -item_id * 10 ELSE item_id * 10 END AS id FROM benchmark, (VALUES (5), (6)) v(k) WHERE item_id % 2 = 0),
ev AS (SELECT seq, 'save' AS kind, n, NULL::BIGINT AS id FROM sv UNION ALL SELECT dl.seq, 'delete', n, dl.id FROM dl JOIN sv ON sv.seq = dl.id),
eo AS (SELECT *, row_number() OVER (PARTITION BY n ORDER BY seq) AS r FROM ev),
f AS (SELECT n, r, seq, kind, NULL::BIGINT AS was, CASE WHEN kind = 'save' THEN seq END AS live, false AS hit FROM eo WHERE r = 1
  UNION ALL SELECT e.n, e.r, e.seq, e.kind, f.live, CASE WHEN e.kind = 'save' THEN coalesce(f.live, e.seq) WHEN e.id = f.live THEN NULL ELSE f.live END, coalesce(e.kind = 'delete' AND e.id = f.live, false) FROM f JOIN eo e ON e.n = f.n AND e.r = f.r + 1)"""


def oracle_sql() -> dict[str, str]:
    lex = f"WITH {SEC}, {QT}, {bm25('lex', FULL)}"
    return {
        "lex_bm25_topk": f"{lex} SELECT qid, uid, score, position FROM lex",
        "lex_all_terms": f"{lex}, {ALL_TERMS} SELECT qid, uid FROM al",
        "q_tokenize_stats": f"SELECT doc_id, len(w)::BIGINT AS n_tokens, len(list_distinct(w))::BIGINT AS n_distinct FROM (SELECT doc_id, {tok('text')} AS w FROM documents)",
        "q_phrase": f"""WITH {SEC}, p AS (SELECT item_id AS qid, {tok('text')}[1:3] AS p FROM benchmark UNION ALL SELECT item_id + 1000000, {tok('text')} FROM benchmark), d AS (SELECT uid, {tok('body')} AS w FROM sec),
x AS (SELECT uid, w, unnest(w) AS term, unnest(range(len(w))) AS "at" FROM d) SELECT qid, uid, "at" FROM x JOIN p ON term = p[1] AND w["at" + 1:"at" + len(p)] = p""",
        "q_snippet": f"SELECT doc_id, CASE WHEN length(t) > 240 THEN regexp_replace(substr(t, 1, 240), '{WHITE}+$', '') || '…' ELSE t END AS snippet FROM (SELECT doc_id, {trim('text')} AS t FROM documents)",
        "q_no_answer": f"{lex}, {ALL_TERMS} SELECT item_id AS qid FROM benchmark WHERE item_id NOT IN (SELECT qid FROM al)",
        "q_stats": f"WITH {COPIES} SELECT (SELECT count(*) FROM documents) AS documents, (SELECT count(*) FROM (SELECT unnest(string_split(text, chr(10))) AS l FROM documents) WHERE l <> '') AS sections, (SELECT count(*) FROM cp) AS relations, 1::BIGINT AS generation",
        "parse_lines": "SELECT doc_id, count(*) AS n_lines, max(n)::BIGINT AS last_line FROM (SELECT doc_id, unnest(string_split(text, chr(10))) AS l, unnest(range(1, len(string_split(text, chr(10))) + 1)) AS n FROM documents) WHERE l <> '' GROUP BY doc_id",
        "parse_token_estimate": "SELECT doc_id, round(strlen(text) / 3.6::DOUBLE, 3) AS tokens FROM documents",
        "src_page_sections": rf"""SELECT page_id, regexp_replace(regexp_extract(html, '<h1>(.*?)</h1>', 1, 's'), '<[^>]*>', '', 'g') AS heading,
  len({tok("regexp_replace(regexp_replace(html, '<(?:script|style)[^>]*>.*?</(?:script|style)>', ' ', 'gs'), '<[^>]*>', ' ', 'g')")})::BIGINT AS n_tokens FROM pages""",
        "src_page_links": "SELECT DISTINCT 'page:' || page_id AS src, 'href:' || h AS dst, 'link' AS relation FROM (SELECT page_id, unnest(regexp_extract_all(html, 'href=\"([^\"]*)\"', 1)) AS h FROM pages)",
        "src_glob_filter": "SELECT page_id, url FROM pages WHERE regexp_matches(url, '^(?:.*/)?(?:en|fr)/[^/]*$') AND NOT regexp_matches(url, '^.*ref=.*$')",
        "src_change_gate": """WITH b AS (SELECT doc_id AS path, sha256(CASE WHEN toxic = 1 THEN upper(text) ELSE text END) AS was FROM documents JOIN labels USING (doc_id)), n AS (SELECT doc_id AS path, sha256(text) AS now FROM documents WHERE lang <> 'es')
SELECT path, CASE WHEN was IS NULL THEN 'added' WHEN now IS NULL THEN 'removed' WHEN was = now THEN 'unchanged' ELSE 'changed' END AS change FROM b FULL JOIN n USING (path)""",
        "g_expand_2hop": f"""WITH fk AS (SELECT 'nation:' || n_nationkey AS src, 'region:' || n_regionkey AS dst FROM nation UNION ALL SELECT 'customer:' || c_custkey, 'nation:' || c_nationkey FROM customer UNION ALL SELECT 'supplier:' || s_suppkey, 'nation:' || s_nationkey FROM supplier),
{layers("SELECT r_regionkey::BIGINT AS qid, 'region:' || r_regionkey AS node, 1.0::DOUBLE AS score FROM region", "SELECT src AS \"at\", dst AS \"to\", 'parent' AS via, false AS backwards, 0.3::DOUBLE AS weight FROM fk UNION SELECT dst, src, 'parent', true, 0.3::DOUBLE FROM fk")}
SELECT qid, node, round(score, 9) AS score, hops::BIGINT AS hops, via, backwards FROM ex""",
        "g_pagerank_10": pagerank(10),
        "g_contradictions": f"WITH {SEC}, g AS (SELECT heading, min(uid) AS dst FROM sec WHERE status = 'current' GROUP BY heading) SELECT DISTINCT least(uid, dst) AS a, greatest(uid, dst) AS b FROM sec JOIN g USING (heading) WHERE status = 'obsolete'",
        "retrieve_ranked": f"""WITH {RETRIEVE}, x AS (SELECT *, {EXPLAIN} AS e FROM res)
SELECT qid, uid, rank, round(score, 9) AS score, CASE WHEN e = '' THEN 'matched' ELSE e END AS explain FROM x""",
        "rank_status": f"WITH {SEC} SELECT coalesce(status, 'none') AS status, count(*) AS n, max({STATUS}) AS weight FROM sec GROUP BY 1",
        "rank_rrf_sum": f"""WITH {SEC}, {QT}, {bm25('heads', {'heading': 8.0})}, {bm25('bodies', {'body': 1.0})},
u AS (SELECT qid, uid, round(sum(s), 9) AS score FROM (SELECT qid, uid, 1.0::DOUBLE / (60 + position + 1) AS s FROM heads UNION ALL SELECT qid, uid, 0.5::DOUBLE / (60 + position + 1) FROM bodies) GROUP BY ALL)
SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY qid ORDER BY score DESC, uid) - 1 AS position FROM u) WHERE position < 20""",
        "boost_context": f"""WITH {RETRIEVE}, c AS (SELECT *, contains(lower(concat_ws(' ', heading, path, body)), 'example') AS active_app, path = 'src' || (qid % 20) OR starts_with(path, 'src' || (qid % 20) || '/') AS current_project FROM res)
SELECT qid, uid, row_number() OVER (PARTITION BY qid ORDER BY score * CASE WHEN current_project THEN 1.35 ELSE 1.0 END::DOUBLE * CASE WHEN active_app THEN 1.25 ELSE 1.0 END::DOUBLE DESC, rank) AS rank, active_app, current_project FROM c""",
        "ctx_informal_name": f"SELECT page_id, coalesce(list_filter(string_split(lower({HOST}), '.'), lambda p: p <> '' AND p NOT IN ('agent', 'app', 'desktop', 'bin', 'gui'))[-1], nullif(lower({HOST}), '')) AS app FROM pages",
        "ctx_default": """WITH c AS (SELECT event_id, user_id, ts, CASE WHEN event_type = 'click' THEN nullif(props->>'$.k', '') END AS g FROM events)
SELECT event_id, coalesce(g, last_value(g IGNORE NULLS) OVER (PARTITION BY user_id ORDER BY ts, event_id ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING)) AS effective_context FROM c""",
        "pack_greedy": f"WITH {RETRIEVE}, {PACK} SELECT qid, uid, rank, bytes_used::BIGINT AS bytes_used FROM pk",
        "pack_prompts": f"WITH {RETRIEVE}, {PACK} SELECT item_id AS qid, sha256(coalesce(string_agg(block, '' ORDER BY rank), 'No sources were found.' || chr(10) || chr(10)) || 'Question: ' || {clean('any_value(text)')}) AS prompt_sha256, count(block) AS sources FROM benchmark LEFT JOIN pk ON qid = item_id GROUP BY item_id",
        "cache_key": f"WITH {RETRIEVE}, {PACK} SELECT qid, sha256(string_agg(uid || chr(1) || body || chr(1), '' ORDER BY rank) || concat_ws(chr(1), 'none', '1', '200', '0.200', '0')) AS key FROM pk GROUP BY qid",
        "cache_upsert": """WITH w AS (SELECT *, lag(text) OVER (PARTITION BY conv_id ORDER BY turn) AS q, conv_id * 1000 + turn AS seq FROM conversations), k AS (SELECT sha256(q) AS key, * FROM w WHERE role = 'assistant' AND q IS NOT NULL)
SELECT key, arg_max(text, seq) AS answer, arg_min('m' || (conv_id % 3), seq) AS model, arg_max(conv_id, seq) AS created_at FROM k GROUP BY key""",
        "prov_counts": "SELECT count(*) AS total, count_if(quality = 1) AS good, count_if(quality = 0) AS bad FROM documents LEFT JOIN labels USING (doc_id)",
        "prov_rated": "SELECT doc_id AS id, source AS query, CASE WHEN quality = 1 THEN 1 ELSE -1 END::INTEGER AS rating FROM documents JOIN labels USING (doc_id) WHERE quality IN (0, 1)",
        "prov_recent_ring": "SELECT conv_id, turn, age FROM (SELECT conv_id, turn, row_number() OVER (PARTITION BY conv_id ORDER BY turn DESC) AS age FROM conversations WHERE role = 'user') WHERE age <= 8",
        "corr_normalize": f"SELECT qid, {norm('question')} AS normalized FROM ({ASKED})",
        "corr_save": f"SELECT min(qid) AS id, normalized, arg_max(qid, qid) AS created_at, count(*) AS writes, false AS stale FROM (SELECT qid, {norm('question')} AS normalized FROM ({ASKED})) GROUP BY normalized",
        "corr_jaccard_best": f"""WITH q AS (SELECT qid, {norm('question')} AS n FROM (SELECT item_id AS qid, text AS question FROM benchmark UNION ALL SELECT qid + 1000000, question FROM ({ASKED}))),
c AS (SELECT min(item_id) AS id, n FROM (SELECT item_id, {norm('text')} AS n FROM benchmark) GROUP BY n),
p AS (SELECT qid, id, q.n = c.n AS exact, list_distinct(string_split(q.n, ' ')) AS a, list_distinct(string_split(c.n, ' ')) AS b FROM q, c),
s AS (SELECT qid, id, exact, CASE WHEN exact THEN 1.0 ELSE round(len(list_intersect(a, b))::DOUBLE / (len(a) + len(b) - len(list_intersect(a, b))), 9) END::DOUBLE AS score FROM p)
SELECT qid, id, exact, score FROM (SELECT *, row_number() OVER (PARTITION BY qid ORDER BY exact DESC, score DESC, id DESC) AS r FROM s WHERE exact OR score >= 0.2) WHERE r = 1""",
        "corr_staleness": "SELECT source AS correction_id, bool_or(doc_id IN (SELECT doc_id FROM labels WHERE quality = 0 AND toxic = 1)) AS stale FROM documents GROUP BY source",
        "act_offered": f"""WITH {RETRIEVE}, {DECLARED},
a AS (SELECT qid, 0 AS slot, rank, 0 AS seq, heading AS label, 'file' AS type, path AS target, 1 AS line, NULL::BIGINT AS seconds, true AS enabled FROM res
  UNION ALL SELECT qid, slot, rank, 1, label, kind, target, line, seconds, enabled FROM res JOIN dr ON uid = section_uid),
o AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY qid, type, target, line, seconds ORDER BY slot, rank, seq, label) AS r FROM a) WHERE r = 1)
SELECT qid, id, slot::BIGINT AS slot, ['open_file', 'open_file', 'open_video', 'launch_desktop_app', 'open_project', 'open_url'][slot + 1] AS kind, label, target, enabled
FROM (SELECT *, row_number() OVER (PARTITION BY qid ORDER BY slot, rank, seq, label, type, target, line, seconds) AS id FROM o) WHERE id <= 9""",
        "act_resolve": f"WITH {DECLARED} SELECT section_uid, kind, label, enabled, slot::BIGINT AS slot, target, line::BIGINT AS line, seconds FROM dr",
        "act_app_resolve": f"""WITH {APPS}, w AS (SELECT DISTINCT ' ' || substr(n_name, 1, k) AS name, lower(substr(n_name, 1, k)) AS w FROM (SELECT n_name, unnest(range(1, length(n_name) + 1)) AS k FROM nation))
SELECT name, CASE WHEN count_if(n = w) > 0 THEN min(app_id) FILTER (n = w) ELSE min(app_id) END AS app_id FROM w JOIN ap ON starts_with(n, w) GROUP BY name HAVING count_if(n = w) > 0 OR count(*) = 1""",
        "act_expand": """WITH p AS (SELECT page_id, url, CASE WHEN page_id % 3 > 0 THEN page_id END AS s, page_id % 2 = 0 AS v FROM pages)
SELECT page_id, CASE WHEN v THEN 'mpv --start=' || coalesce(s, 0) || ' ' || url ELSE 'mpv --start={seconds} ' || url END AS player,
  'open ' || url || CASE WHEN v AND s IS NOT NULL THEN CASE WHEN contains(url, '?') THEN '&' ELSE '?' END || 't=' || s || 's' ELSE '' END AS opener FROM p""",
        "act_template": f"""WITH {DECLARED} SELECT section_uid, CASE kind WHEN 'file' THEN CASE WHEN section_uid % 2 = 0 THEN 'nvim ' || target || '.MD' ELSE 'code -g ' || target || '.rs:' || line END
  WHEN 'project' THEN 'code ' || target WHEN 'url' THEN 'open ' || target WHEN 'app' THEN 'gtk-launch ' || target ELSE 'mpv --start=' || coalesce(seconds, 0) || ' ' || target END AS argv FROM dr""",
        "st_path_filter": """WITH p AS (SELECT event_id, CASE WHEN event_id % 7 = 0 THEN '/vault' ELSE '/v' END || CASE WHEN event_id % 11 = 0 THEN '' ELSE '/' || ['notes', '.git', 'target', 'src'][user_id % 4 + 1] || '/' || event_type || '.md' END AS path FROM events)
SELECT event_id, path FROM p WHERE starts_with(path, '/v/') AND NOT contains(path, '/.git/') AND NOT contains(path, '/target/')""",
        "st_stale_event_drop": """WITH r AS (SELECT event_id, user_id, ts, row_number() OVER (PARTITION BY user_id ORDER BY ts, event_id) AS n FROM events),
a AS (SELECT user_id, n // 3 AS q, ts AS f, lead(ts) OVER (PARTITION BY user_id ORDER BY ts, n // 3) AS t FROM r WHERE n % 3 = 1)
SELECT event_id, q AS query_id FROM r JOIN a USING (user_id) WHERE q = floor((n - CASE WHEN event_id % 2 = 0 THEN 1 ELSE 4 END) / 3)::BIGINT AND ts >= f AND (t IS NULL OR ts < t)""",
        "gen_think_filter": "SELECT conv_id, turn, sha256(CASE WHEN turn % 4 = 1 THEN text ELSE '' END) AS answer_sha256 FROM conversations WHERE role = 'assistant'",
        "ctx_alias": f"""WITH h AS (SELECT page_id, lower({HOST}) AS h FROM pages) SELECT page_id, CASE WHEN h = '' THEN NULL WHEN h = 'www.example' OR starts_with(h, 'www.example.') THEN 'files'
  WHEN h IN ('news', 'blog.example') OR starts_with(h, 'news.') OR starts_with(h, 'blog.example.') THEN 'news' WHEN h = 'docs.example.org' OR starts_with(h, 'docs.example.org.') THEN 'is'
  ELSE coalesce(list_filter(string_split(h, '.'), lambda p: p <> '' AND p NOT IN ('agent', 'app', 'desktop', 'bin', 'gui'))[-1], h) END AS app FROM h""",
        "ctx_app_in_query": rf"""WITH w AS (SELECT qid, regexp_split_to_array(lower(question), '[^\p{{L}}\p{{N}}]+') AS w FROM ({ASKED}))
SELECT qid, CASE WHEN list_contains(w, 'the') THEN 'the' WHEN list_contains(w, 'zoo') THEN 'zoo' WHEN list_contains(w, 'data') THEN 'data' END AS app FROM w""",
        "ctx_bucket": f"SELECT page_id, CASE WHEN page_id % 3 > 0 THEN {HOST} ELSE '-' END || '|' || CASE WHEN page_id % 2 > 0 THEN '/' || {HOST} ELSE '-' END AS bucket FROM pages",
        "g_unresolved_contradictions": """SELECT doc_id AS a, doc_id + 1 AS b FROM documents WHERE doc_id % 5 <> 0
  AND doc_id NOT IN (SELECT doc_id FROM labels WHERE quality = 0 AND toxic <> 1) AND doc_id + 1 NOT IN (SELECT doc_id FROM labels WHERE quality = 0 AND toxic <> 1)""",
        "g_neighbourhood": "SELECT 'region:' || n_regionkey AS node, 'parent' AS via, false AS backwards FROM nation WHERE n_nationkey = 7 UNION ALL SELECT 'customer:' || c_custkey, 'parent', true FROM customer WHERE c_nationkey = 7 UNION ALL SELECT 'supplier:' || s_suppkey, 'parent', true FROM supplier WHERE s_nationkey = 7",
        "parse_edges": "SELECT 'd' || doc_id AS src, 'd' || doc_id + 1 AS dst, 'related' AS relation FROM documents UNION ALL SELECT 'd' || doc_id, source, 'link' FROM documents UNION ALL SELECT 'd' || doc_id, 'top', 'parent' FROM documents WHERE doc_id % 2 = 0",
        "parse_actions": """SELECT doc_id AS section_uid, 'file' AS kind, 'src/' || source AS target, doc_id AS line, NULL::BIGINT AS seconds FROM documents
UNION ALL SELECT doc_id, 'video', 'https://v.example/w', NULL, doc_id FROM documents UNION ALL SELECT doc_id, 'project', '/p/' || lang, NULL, NULL FROM documents""",
        "parse_note_sections": """WITH n AS (SELECT 'n' || doc_id AS n, source AS s, lang AS l FROM documents)
SELECT n || '#preamble' AS section_uid, NULL AS parent_uid, NULL AS heading, 'T' AS heading_path, 'intro' AS body, 5 AS start_line, 5 AS end_line, 'draft' AS status FROM n
UNION ALL SELECT n || '#one', NULL, s, s, 'alpha', 6, 9, 'draft' FROM n
UNION ALL SELECT n || '#' || l, n || '#one', l, s || ' > ' || l, '```' || chr(10) || '# no heading' || chr(10) || '```', 10, 14, 'draft' FROM n""",
        "src_glob_count": """WITH c AS (SELECT 'en' AS source, count_if(regexp_matches(url, '^(?:.*/)?en/[^/]*$')) AS n FROM pages UNION ALL SELECT 'all', count(*) FROM pages UNION ALL SELECT 'none', count_if(regexp_matches(url, '^[^/]*\\.md$')) FROM pages
UNION ALL SELECT 'plain', count_if(NOT regexp_matches(url, '^.*ref=.*$')) FROM pages) SELECT source, n, CASE WHEN n = 0 THEN 'its patterns match no file' END AS warning FROM c""",
        "vec_queue": "SELECT doc_id AS section_uid FROM documents WHERE doc_id NOT IN (SELECT vec_id FROM embeddings WHERE vec_id % 3 <> 0)",
        "q_gate": f"WITH {RETRIEVE}, g AS (SELECT qid, max(score) AS top, string_agg(uid, ',' ORDER BY rank) FILTER (rank <= 3) AS c FROM res GROUP BY qid) SELECT item_id AS qid, coalesce(top >= 0.0213, false) AS confident, CASE WHEN NOT coalesce(top >= 0.0213, false) THEN coalesce(c, '') END AS closest FROM benchmark LEFT JOIN g ON qid = item_id",
        "q_section_lookup": f"WITH {SEC}, w AS (SELECT item_id AS qid, item_id % 7 AS u, 3 AS place FROM benchmark UNION ALL SELECT item_id, item_id % 5, 2 FROM benchmark), m AS (SELECT qid, u, max(place) AS place FROM w GROUP BY ALL) SELECT qid, place::BIGINT AS place, uid, heading FROM m JOIN sec ON u = uid",
        "pack_correction": "SELECT item_id AS qid, sha256('Question: none' || chr(10) || 'A correct answer given before: ' || (SELECT arg_max(x.text, x.item_id) FROM benchmark x WHERE NORM_X = NORM_B) || chr(10) || chr(10) || 'Question: ' || b.text) AS prompt_sha256 FROM benchmark b".replace("NORM_X", norm("x.text")).replace("NORM_B", norm("b.text")),
        "cache_get": """WITH w AS (SELECT *, lag(text) OVER (PARTITION BY conv_id ORDER BY turn) AS q, conv_id * 1000 + turn AS seq FROM conversations), k AS (SELECT sha256(q) AS key, arg_max(text, seq) AS answer FROM w WHERE role = 'assistant' AND q IS NOT NULL GROUP BY ALL)
SELECT conv_id, turn, sha256(answer) AS answer_sha256 FROM conversations LEFT JOIN k ON key = sha256(text)""",
        "prov_rate": """WITH r AS (SELECT event_id % 500 AS id, arg_max(CASE WHEN value > 50 THEN 1 ELSE -1 END, (ts, event_id)) AS n FROM events GROUP BY 1),
p AS (SELECT coalesce(n, CASE quality WHEN 1 THEN 1 WHEN 0 THEN -1 END) AS rating FROM documents LEFT JOIN labels USING (doc_id) LEFT JOIN r ON doc_id = id) SELECT count(*) AS total, count_if(rating > 0) AS good, count_if(rating < 0) AS bad FROM p""",
        "corr_list": f"WITH c AS (SELECT min(item_id) AS id, max(item_id) AS created_at FROM (SELECT item_id, {norm('text')} AS n FROM benchmark) GROUP BY n) SELECT row_number() OVER (ORDER BY created_at DESC, id) AS place, id, (SELECT count_if(id % 3 = 0) FROM c) AS n_stale FROM c",
        "corr_delete": f"{LOG} SELECT l AS id, n AS normalized, arg_max(seq, seq) FILTER (WHERE kind = 'save') AS created_at, count(*) FILTER (WHERE kind = 'save') AS writes FROM (SELECT *, coalesce(live, was) AS l FROM f) GROUP BY n, l HAVING arg_max(kind, seq) FILTER (WHERE kind = 'save' OR hit) = 'save'",
        "bench_latency": """WITH w AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY event_type ORDER BY ts, event_id) AS nth FROM events) WHERE nth > 1),
m AS (SELECT event_type AS question, value, event_id FROM w UNION ALL SELECT '', value, event_id FROM w)
SELECT question, count(*) AS n, quantile_disc(value, 0.5) AS p50, quantile_disc(value, 0.99) AS p99, max(value) AS max,
  coalesce(quantile_disc(floor(value / 2), 0.5) FILTER (WHERE event_id % 3 > 0 AND floor(value / 2) > 0), 0) AS ttft_p50, coalesce(quantile_disc(floor(value / 2), 0.99) FILTER (WHERE event_id % 3 > 0 AND floor(value / 2) > 0), 0) AS ttft_p99,
  round(coalesce(avg((event_id % 50) / (value / 1000)) FILTER (WHERE event_id % 3 > 0 AND value > 0 AND event_id % 50 > 0), 0), 6) AS tokens_per_second FROM m GROUP BY question""",
        "sink_jsonl": """WITH t AS (SELECT *, (conv_id + turn) % 7 = 0 AS b FROM conversations)
SELECT CASE WHEN NOT b THEN conv_id END AS conv_id, b AS malformed, count(*) AS n, sum(CASE WHEN NOT b THEN turn END)::BIGINT AS turns, sum(CASE WHEN NOT b THEN length(text) END)::BIGINT AS chars FROM t GROUP BY 1, 2""",
        "sink_json_report": f"""WITH {TWO} SELECT combo::BIGINT AS combo, count(*) AS n, round(avg(CASE WHEN rank <= 1 THEN 1.0 ELSE 0.0 END), 9) AS recall_1, round(avg(CASE WHEN rank <= 3 THEN 1.0 ELSE 0.0 END), 9) AS recall_3,
  round(avg(CASE WHEN rank <= 5 THEN 1.0 ELSE 0.0 END), 9) AS recall_5, round(avg(coalesce(1.0::DOUBLE / rank, 0)), 9) AS mrr FROM rk GROUP BY combo""",
        "sink_bench_export": "SELECT source AS question, doc_id || ',' || (doc_id + 1) AS expected, NULL::VARCHAR AS context, NULL::VARCHAR AS note FROM documents JOIN labels USING (doc_id) WHERE quality = 1 AND doc_id % 3 > 0",
        "q_source_refs": f"""WITH {RETRIEVE}, x AS (SELECT *, {trim('body')} AS t, {EXPLAIN} AS e FROM res)
SELECT qid, rank, 0::BIGINT AS section_id, uid AS section_uid, path, heading AS heading_path, 1::BIGINT AS start_line, 1::BIGINT AS end_line, round(score, 9) AS score,
  CASE WHEN length(t) > 240 THEN regexp_replace(substr(t, 1, 240), '{WHITE}+$', '') || '…' ELSE t END AS snippet, CASE WHEN e = '' THEN 'matched' ELSE e END AS explain FROM x""",
        "q_actions_lookup": f"WITH {DECLARED}, w AS (SELECT item_id AS qid, item_id % 7 AS u FROM benchmark UNION SELECT item_id, item_id % 5 FROM benchmark) SELECT qid, section_uid, kind, label, enabled FROM w JOIN dr ON u = section_uid",
        "prov_record": f"""SELECT doc_id AS id, source AS query, CASE quality WHEN 1 THEN 1 WHEN 0 THEN -1 END::INTEGER AS rating FROM documents LEFT JOIN labels USING (doc_id)
UNION ALL SELECT (SELECT max(doc_id) FROM documents) + row_number() OVER (ORDER BY qid), question, NULL FROM ({ASKED})""",
        "corr_stale_count": f"SELECT count_if(id % 3 = 0) AS n_stale FROM (SELECT min(item_id) AS id FROM (SELECT item_id, {norm('text')} AS n FROM benchmark) GROUP BY n)",
        "corr_version": f"{LOG} SELECT count(*) FILTER (WHERE kind = 'save' OR hit) AS version FROM f",
        "src_desktop_entries": """SELECT 'app' || c_custkey AS app_id, CASE WHEN c_custkey % 2 = 0 THEN c_name ELSE 'Shared ' || c_custkey END AS app_name, CASE WHEN c_custkey % 2 = 0 THEN 'own %U' ELSE 'shared %U' END AS exec
FROM customer WHERE CASE WHEN c_custkey % 2 = 0 THEN c_custkey % 10 <> 0 ELSE c_custkey % 3 <> 0 END""",
        "boost_recent": f"""WITH {RETRIEVE}, op AS (SELECT event_id * 7 % 997 AS uid, ts FROM events), q AS (SELECT item_id AS qid, TIMESTAMP '2024-01-05' + to_hours(item_id) AS ts FROM benchmark),
b AS (SELECT res.*, EXISTS (SELECT 1 FROM op, q WHERE op.uid = res.uid AND q.qid = res.qid AND op.ts <= q.ts AND op.ts >= q.ts - INTERVAL 2 DAYS) AS recent FROM res),
c AS (SELECT *, score * CASE WHEN recent THEN 1.1 ELSE 1.0 END::DOUBLE AS lifted FROM b) SELECT qid, uid, row_number() OVER (PARTITION BY qid ORDER BY lifted DESC, rank) AS rank, round(lifted, 9) AS score, recent FROM c""",
        "src_second_store": rf"""WITH {RETRIEVE}, psec AS (SELECT page_id AS uid, url AS path, regexp_replace(regexp_extract(html, '<h1>(.*?)</h1>', 1, 's'), '<[^>]*>', '', 'g') AS heading,
  regexp_replace(regexp_replace(html, '<(?:script|style)[^>]*>.*?</(?:script|style)>', ' ', 'gs'), '<[^>]*>', ' ', 'g') AS body FROM pages), {bm25('pl', FULL, sec='psec')},
al2 AS (SELECT qid, 'vault' AS source_kind, uid, list_no, position, via, score, heading, body FROM ws UNION ALL SELECT qid, 'page', uid, 2, position, NULL, 1.0::DOUBLE / (60 + position + 1), psec.heading, psec.body FROM pl JOIN psec USING (uid)),
tr2 AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY qid ORDER BY score DESC, list_no, position) AS before FROM al2) WHERE before <= 20),
hm2 AS (SELECT *, score * CASE WHEN heading_match THEN 1.3 ELSE 1.0 END::DOUBLE AS s FROM (SELECT tr2.*, len(list_filter(terms, lambda t: contains(lower(heading), t))) > 0 AS heading_match FROM tr2 JOIN ht USING (qid)))
SELECT qid, source_kind, uid::VARCHAR AS number, CASE WHEN source_kind = 'vault' THEN uid::VARCHAR END AS section_uid, row_number() OVER (PARTITION BY qid ORDER BY s DESC, before) AS rank, round(s, 9) AS score, via, sha256(body) AS body_sha256 FROM hm2""",
        "src_vault_scan": """WITH k AS (SELECT doc_id // 50 AS k, count(*) AS n FROM documents GROUP BY 1)
SELECT 1::BIGINT AS scan, count(*) AS indexed, 0::BIGINT AS unchanged, 0::BIGINT AS removed, 0::BIGINT AS failed, sum(n)::BIGINT AS sections FROM k
UNION ALL SELECT 2, count(*) FILTER (WHERE k % 4 = 0), count(*) FILTER (WHERE k % 4 = 1 OR k % 4 = 3 AND k <> 3), count(*) FILTER (WHERE k % 4 = 2), 1, (sum(n + CASE WHEN k % 4 = 0 THEN 1 ELSE 0 END) FILTER (WHERE k % 4 <> 2))::BIGINT FROM k""",
        "src_path_absolutise": "SELECT page_id, CASE WHEN page_id % 3 = 0 THEN '/else/' ELSE '/vault/notes/' END || page_id AS path FROM pages",
        "pack_merge_adjacent": f"""WITH {FOUND_LINES}, r AS (SELECT *, n - row_number() OVER (PARTITION BY doc_id ORDER BY n) AS run FROM ln)
SELECT doc_id AS qid, min(n) AS first, count(*) AS n, -max(n) AS rank, sha256(string_agg(l, chr(10) || chr(10) ORDER BY r.n)) AS body_sha256 FROM r GROUP BY doc_id, run""",
        "pack_parent_dedupe": f"""WITH {FOUND_LINES} SELECT a.doc_id AS qid, a.n AS uid, 'line ' || coalesce(b.n, a.n) AS heading_path FROM ln a LEFT JOIN ln b ON a.doc_id = b.doc_id AND a.n % 2 = 0 AND b.n = a.n - 1
WHERE NOT (a.n % 2 = 1 AND (a.doc_id, a.n + 1) IN (SELECT (doc_id, n) FROM ln))""",
        "parse_front_matter": """SELECT doc_id AS path, CASE WHEN ok THEN 'n' || doc_id END AS id, CASE WHEN ok THEN 'A: ' || lang END AS title, NULL::VARCHAR AS topic, CASE WHEN ok THEN 'a,' || source END AS tags, CASE WHEN ok THEN 0 END::BIGINT AS n_apps,
  NULL::VARCHAR AS project, CASE WHEN ok THEN 'current' END AS status, CASE WHEN ok AND doc_id % 2 = 0 THEN 'old' END AS supersedes FROM (SELECT *, doc_id % 5 > 0 AS ok FROM documents)""",
        "act_labels": f"SELECT event_id, {LABEL} AS label FROM (SELECT event_id, floor(value * 100)::BIGINT AS s FROM events)",
        "act_urls": f"SELECT page_id, {HOST} AS host, url || CASE WHEN contains(url, '?') THEN '&t=' ELSE '?t=' END || page_id || 's' AS timed FROM pages",
        "bench_recall_mrr": f"""WITH {RETRIEVE}, {ALL_TERMS}, rk AS (SELECT q.qid, min(rank) AS rank FROM (SELECT item_id AS qid FROM benchmark) q LEFT JOIN (SELECT res.qid, res.rank FROM res JOIN al USING (qid, uid)) USING (qid) GROUP BY ALL)
SELECT count(*) AS n, round(avg(CASE WHEN rank <= 1 THEN 1.0 ELSE 0.0 END), 9) AS recall_1, round(avg(CASE WHEN rank <= 3 THEN 1.0 ELSE 0.0 END), 9) AS recall_3, round(avg(CASE WHEN rank <= 5 THEN 1.0 ELSE 0.0 END), 9) AS recall_5, round(avg(coalesce(1.0::DOUBLE / rank, 0)), 9) AS mrr FROM rk""",
        "bench_modes": f"{modes('rk', 0, RETRIEVE)} UNION ALL {modes('rk', 1, LEXICAL)}",
        "lex_weights_sweep": f"""WITH {SEC}, {QT}, {bm25('one', {'heading': 1.0, 'body': 1.0})}, {bm25('many', {'heading': 20.0, 'body': 1.0})}
SELECT 0::BIGINT AS combo, qid, uid, score, position FROM one UNION ALL SELECT 1, qid, uid, score, position FROM many""",
        "q_unsearchable": f"{lex} SELECT item_id AS qid, (SELECT count(*) FROM lex WHERE qid = item_id) AS n FROM benchmark UNION ALL SELECT item_id + 1000000, 0 FROM benchmark",
        "g_disabled": f"WITH {LEXICAL} SELECT qid, uid, rank, round(score, 9) AS score, list_no::BIGINT AS list_no FROM res",
        "trust_weight": f"""WITH {RETRIEVE}, tc AS (SELECT doc_id AS uid, CASE WHEN doc_id % 10 = 0 THEN 'correction' WHEN lang = 'en' THEN 'note' WHEN lang = 'fr' THEN 'code' WHEN lang = 'de' THEN 'old' WHEN lang = 'es' THEN 'imported' END AS trust FROM documents),
tw AS (SELECT qid, uid, rank AS before, trust, score * CASE trust WHEN 'correction' THEN 1.2 WHEN 'code' THEN 0.95 WHEN 'old' THEN 0.8 WHEN 'imported' THEN 0.7 ELSE 1.0 END::DOUBLE AS s FROM res JOIN tc USING (uid))
SELECT qid, uid, row_number() OVER (PARTITION BY qid ORDER BY s DESC, before) AS rank, round(s, 9) AS score, trust FROM tw""",
        "pack_budget": f"""WITH {RETRIEVE}, {PACK}, nf AS (SELECT qid, count(*) AS n_found FROM res GROUP BY qid), rc AS (SELECT *, sum(ceil(strlen(block) / 3.0)) OVER (PARTITION BY qid)::BIGINT AS counted, row_number() OVER (PARTITION BY qid ORDER BY rank) AS nth FROM pk)
SELECT qid, uid, rank, counted FROM rc JOIN nf USING (qid) WHERE counted <= 600 OR nth <= greatest(least(n_found, 5), 2) - 1""",
        "src_questions_yaml": """SELECT text AS question, CASE WHEN item_id % 3 > 0 THEN 'n#' || item_id || '|it''s, "x" # ' || (item_id + 1) ELSE '' END AS expected, CASE WHEN item_id % 2 = 0 THEN 'vim: ~' END AS context, '- first' || chr(10) || '  note: ' || item_id AS note FROM benchmark""",
        "bench_diff": f"""WITH {TWO}, m AS (SELECT a.qid AS question, b.rank AS was, a.rank AS now, coalesce(a.rank, 1000) - coalesce(b.rank, 1000) AS delta FROM rk a JOIN rk b ON a.qid = b.qid AND a.combo = 1 AND b.combo = 0 WHERE a.rank IS DISTINCT FROM b.rank)
SELECT row_number() OVER (ORDER BY delta DESC, question DESC) AS place, * FROM m""",
        "bench_sweep_best": f"WITH {TWO}, s AS (SELECT combo::BIGINT AS combo, count(*) AS n, avg(coalesce(1.0::DOUBLE / rank, 0)) AS m FROM rk GROUP BY combo) SELECT combo, n, round(m, 9) AS mrr FROM s ORDER BY m DESC, combo LIMIT 1",
        "bench_percentiles": "SELECT event_type, quantile_disc(value, 0.5) AS p50, quantile_disc(value, 0.95) AS p95, quantile_disc(value, 0.99) AS p99 FROM events GROUP BY event_type",
        "st_debounce": f"""WITH e AS (SELECT user_id, ts, CASE WHEN ts - lag(ts) OVER (PARTITION BY user_id ORDER BY ts) < INTERVAL 6 HOURS THEN 0 ELSE 1 END AS new FROM events WHERE event_type <> 'view'),
g AS (SELECT *, sum(new) OVER (PARTITION BY user_id ORDER BY ts ROWS UNBOUNDED PRECEDING) AS b FROM e)
SELECT user_id, {time_text('min(ts)')} AS started, {time_text('max(ts) + INTERVAL 6 HOURS')} AS ended, count(*) AS n FROM g GROUP BY user_id, b""",
        "st_supersede": "SELECT event_id AS query_id, coalesce(lead(ts) OVER (PARTITION BY user_id ORDER BY ts, event_id) < ts + to_seconds(round(value * 600)::BIGINT), false) AS cancelled FROM events",
        "st_settled": """WITH n AS (SELECT event_id, user_id, ts, event_type, lead(ts) OVER (PARTITION BY user_id ORDER BY ts, event_id) AS nx FROM events),
q AS (SELECT *, lag(event_type) OVER (PARTITION BY user_id ORDER BY ts, event_id) AS l FROM n WHERE nx IS NULL OR epoch_us(nx) - epoch_us(ts) > 3600000000) SELECT event_id, user_id, event_type FROM q WHERE l IS NULL OR l <> event_type""",
        "st_history": """WITH k AS (SELECT * FROM (SELECT event_id, user_id, ts, event_type, lag(event_type) OVER (PARTITION BY user_id ORDER BY ts, event_id) AS l FROM events) WHERE l IS NULL OR l <> event_type)
SELECT event_id, user_id, age FROM (SELECT *, row_number() OVER (PARTITION BY user_id ORDER BY ts DESC, event_id DESC) AS age FROM k) WHERE age <= 100""",
        "st_status": f"SELECT event_type, count(*) AS n, {time_text('max(ts)')} AS last_ts, arg_max(value, (ts, event_id)) AS last_value FROM events GROUP BY event_type",
        "st_token_batch": f"""WITH RECURSIVE e AS (SELECT user_id, ts, CASE WHEN event_type <> 'error' THEN event_type END AS x, hour(ts)::VARCHAR AS q, epoch_us(ts) // 10800000000 AS k, row_number() OVER (PARTITION BY user_id ORDER BY ts, event_id) AS r FROM events),
z AS (SELECT user_id, 0 AS r, NULL::VARCHAR AS cq, NULL::BIGINT AS ck, NULL::TIMESTAMP AS st, '' AS t, 0::BIGINT AS n, NULL::STRUCT(q VARCHAR, s TIMESTAMP, n BIGINT, t VARCHAR) AS a, NULL::STRUCT(q VARCHAR, s TIMESTAMP, n BIGINT, t VARCHAR) AS b FROM (SELECT DISTINCT user_id FROM events)
  UNION ALL SELECT user_id, r, CASE WHEN x IS NULL THEN cq ELSE q END, k, CASE WHEN m = 0 THEN ts ELSE st END, CASE WHEN x IS NULL OR full_ THEN '' ELSE w END, CASE WHEN x IS NULL OR full_ THEN 0 ELSE m + 1 END,
    CASE WHEN n > 0 AND (ck <> k OR x IS NULL) THEN {{'q': cq, 's': st, 'n': n, 't': t}} END, CASE WHEN full_ THEN {{'q': q, 's': CASE WHEN m = 0 THEN ts ELSE st END, 'n': m + 1, 't': w}} END
  FROM (SELECT *, x IS NOT NULL AND strlen(w) >= 24 AS full_ FROM (SELECT *, CASE WHEN m > 0 THEN t ELSE '' END || coalesce(x, '') AS w FROM (SELECT e.*, z.cq, z.ck, z.st, z.t, z.n, CASE WHEN z.ck = e.k AND z.cq = e.q AND e.x IS NOT NULL THEN z.n ELSE 0 END AS m FROM z JOIN e ON e.user_id = z.user_id AND e.r = z.r + 1)))),
l AS (SELECT user_id, a AS v FROM z UNION ALL SELECT user_id, b FROM z UNION ALL SELECT user_id, {{'q': cq, 's': st, 'n': n, 't': t}} FROM z JOIN (SELECT user_id, max(r) AS r FROM e GROUP BY user_id) USING (user_id, r) WHERE n > 0)
SELECT user_id, v.q AS query_id, strftime(v.s, '%Y-%m-%d %H:%M:%S.%f') AS started, v.n AS n, v.t AS text FROM l WHERE v IS NOT NULL""",
        "st_generation_poll": "SELECT event_id, g AS generation FROM (SELECT event_id, g, lag(g) OVER (PARTITION BY user_id ORDER BY ts, event_id) AS l FROM (SELECT *, (props->>'$.k')::BIGINT AS g FROM events)) WHERE l IS NULL OR l <> g",
        "parse_subchunk": "SELECT doc_id, strlen(text) > 300 * 3.6 AS cut, sha256(coalesce(text, '')) AS body_sha256, true AS within FROM documents",
        "pack_parts": "SELECT doc_id, strlen(text) > 300 * 3.6 AND regexp_matches(text, '[0-9]') AS by_parts, 'path of ' || doc_id AS heading_path FROM documents",
        "vec_topk": VEC_TOPK,
        "vec_index_topk": VEC_TOPK,
        "vec_hybrid": f"""WITH {SEC}, {QT}, {bm25('lex', FULL)}, e AS (SELECT vec_id, {unit(COSINE)} AS v FROM embeddings),
nr AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY qid ORDER BY score DESC, uid) - 1 AS position FROM (SELECT a.vec_id AS qid, b.vec_id AS uid, round(list_dot_product(a.v, b.v), 5) AS score FROM e a, e b WHERE a.vec_id IN (SELECT item_id FROM benchmark))) WHERE position < 30),
u AS (SELECT qid, uid, round(sum(s), 9) AS score FROM (SELECT qid, uid, 1.0::DOUBLE / (60 + position + 1) AS s FROM lex UNION ALL SELECT qid, uid, 0.7::DOUBLE / (60 + position + 1) FROM nr) GROUP BY ALL)
SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY qid ORDER BY score DESC, uid) - 1 AS position FROM u) WHERE position < 20""",
        "vec_mrl_truncate": f"SELECT vec_id, len(v)::BIGINT AS dims, round(v[1], 6) AS first, round(v[32], 6) AS last FROM (SELECT vec_id, {unit(f'({COSINE})[1:32]')} AS v FROM embeddings)",
    }
