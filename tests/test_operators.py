"""Ranking, context, packing, actions, memory, benchmark and stream operators on small cases."""

import datetime as dt
import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from marginalia.config import ConfigError, Search, load, sweep, with_override
from marginalia.functions import text as T
from marginalia.jobs import index
from marginalia.jobs import retrieve as job
from marginalia.operators import actions, bench, cells, context, fuse, graph, lexical, memory, pack, vectors
from marginalia.sources import lines, vault
from marginalia.streaming import events as st


def one(spark, column, **values):
    return spark.range(1).select(*[F.lit(v).alias(k) for k, v in values.items()]).select(column.alias("x")).first().x


def test_config():
    assert with_override(Search(), "graph.max_hops", "3").graph.max_hops == 3
    for key, value in (("graph.hops", "1"), ("graf.max_hops", "1"), ("graph", "1"), ("lexical_limit.x", "1")):
        with pytest.raises(KeyError):
            with_override(Search(), key, value)
    with pytest.raises(ValueError):
        with_override(Search(), "lexical_limit", "many")
    assert len(with_override(with_override(Search(), "lexical_limit", "0"), "graph.hop_decay", "2").problems()) == 2
    assert sweep(["a=1,2", "b=x,y"]) == [{"a": "1", "b": "x"}, {"a": "1", "b": "y"}, {"a": "2", "b": "x"}, {"a": "2", "b": "y"}]


def test_settings_file(tmp_path, monkeypatch):
    home = tmp_path / "home"
    (home / "notes").mkdir(parents=True)
    monkeypatch.setenv("HOME", str(home))
    file = tmp_path / "settings.toml"

    def problems(text):
        file.write_text(text)
        with pytest.raises(ConfigError) as error:
            load(str(file))
        return error.value.problems

    file.write_text('[[sources]]\nname = "own"\npath = "~/notes"\ninclude = ["**/*.{md,txt}", "[!a]*"]\n[search]\nlexical_limit = 7\n[search.graph]\nhop_decay = 1\n[openers]\nurl = ["browser", "{url}"]\n')
    config = load(str(file))
    assert config.sources[0].path == str(home / "notes") and config.sources[0].trust == "note"
    assert (config.search.lexical_limit, config.search.fused_limit, config.search.graph.hop_decay) == (7, 20, 1.0)
    assert config.openers.url == ("browser", "{url}") and config.openers.text[0] == "nvim"
    wrong = """
[openers]
video = []
[search]
lexical_limit = 0
context_sections = 30
fused = 1
[search.graph]
max_hops = "two"
"""
    paths = ["~", "/", "nowhere", str(file), "~/notes", "~/notes"]
    every = "".join(f'[[sources]]\nname = "s{min(i, 4)}"\npath = "{p}"\n' for i, p in enumerate(paths)) + '[[sources]]\npath = "~/notes"\nexclude = ["{a,b", "[x", "ok"]\ntrust = "hearsay"\n'
    found = problems(every + wrong)
    # two settings that can't be read, four paths, a name twice, four of the last source, an opener, two limits
    assert len(found) == 2 + 4 + 1 + 4 + 1 + 2, found
    assert any("home" in x for x in found) and any("twice" in x for x in found) and any("max_hops" in x for x in found) and any("search.fused" in x for x in found)
    assert problems("") == ["no sources are set, so there is nothing to index"]
    assert len(problems("[[sources")) == 1
    with pytest.raises(ConfigError):
        load(str(tmp_path / "none.toml"))


def test_question_lists(spark, tmp_path):
    text = """# head

---
- question: how do I stop: the crop?
  expected: [a#one, "b, c \\"x\\"", 'it''s']
  note: >
    folded over
    lines: two

    end
- question: "quoted \\u00e9 # no comment"
  expected:
    - one#a   # why
    - two
  # a comment
  context: ~
-  question: plain
    on two lines
  note: |
    kept
    by lines
"""
    (tmp_path / "q.yaml").write_text(text)
    got = {r.question: (r.expected, r.context, r.note) for r in lines.read_question_list(spark, str(tmp_path / "q.yaml")).collect()}
    assert got == {
        "how do I stop: the crop?": (["a#one", 'b, c "x"', "it's"], None, "folded over lines: two\nend"),
        "quoted é # no comment": (["one#a", "two"], None, None),
        "plain on two lines": ([], None, "kept\nby lines"),
    }
    for number, bad in enumerate(("junk\n- question: x\n", "- expected: [a]\n", "- question: x\n  other: y\n")):
        (tmp_path / f"{number}.yaml").write_text(bad)
        with pytest.raises(Exception, match="question"):
            lines.read_question_list(spark, str(tmp_path / f"{number}.yaml")).collect()
    odd = [("- a\n- question: b", ["x: y", '"', "\\", "]"], "#", "\u2028- c"), ("'", [], None, "~")]
    rows = spark.createDataFrame(odd, "question string, expected array<string>, context string, note string")
    lines.write_question_list(rows, str(tmp_path / "written"))
    assert sorted(tuple(r) for r in lines.read_question_list(spark, str(tmp_path / "written")).collect()) == sorted(odd)


def test_normal_forms(spark):
    same = [("How do I mirror bones?", "how do i mirror bones"), ("how do I deploy", "how should I deploy")]
    for a, b in same:
        assert one(spark, T.normalized(F.col("t")), t=a) == one(spark, T.normalized(F.col("t")), t=b)
    assert one(spark, T.normalized(F.col("t")), t="  Deploy,  now!  ") == "deploy now"
    assert one(spark, T.normalized(F.col("t")), t="how do I") == "how do i"


def test_tokens(spark):
    assert one(spark, T.tokens(F.col("t")), t="Éa foo_bar v1.2-x (y)") == ["ea", "foo_bar", "v1.2-x", "y"]
    assert one(spark, T.query_tokens(F.col("t")), t="How do I stop it badly.") == ["stop", "badly"]
    assert one(spark, T.snippet(F.col("t")), t="  " + "a" * 239 + " b") == "a" * 239 + "…"
    assert one(spark, T.without_thinking(F.col("t")), t="<think>x</think>a<think>y") == "a"


def sections(spark, rows):
    return spark.createDataFrame(rows, "section_uid string, note_title string, heading string, heading_path string, body string, tags array<string>, status string, path string, start_line int")


def ask(spark, rows, question, edges=(), **kw):
    q = spark.createDataFrame([(1, question)], "qid long, question string")
    e = spark.createDataFrame(list(edges), "src string, dst string, relation string")
    return job.retrieve(sections(spark, rows), e, q, **kw).withColumn("explain", fuse.explain()).orderBy("rank").collect()


def row(uid, heading, body, status=None):
    return (uid, uid.split("#")[0], heading, heading, body, [], status, "p.md", 1)


def test_contradiction_is_reached(spark):
    rows = [row("obs#root", "Obs", "intro"), row("obs#old", "Old", "move the crop rectangle"), row("obs#smooth", "Smooth", "apply damping")]
    out = {r.uid: r for r in ask(spark, rows, "crop rectangle", [("obs#smooth", "obs#old", "contradicts")])}
    assert out["obs#smooth"].hops == 1 and out["obs#smooth"].via == "contradicts" and "1 hop back to contradicts" in out["obs#smooth"].explain
    off = ask(spark, rows, "crop rectangle", [("obs#smooth", "obs#old", "contradicts")], config=with_override(Search(), "graph.enabled", "false"))
    assert [r.hops for r in off] == [0]


def test_obsolete_is_demoted_and_headings_lift(spark):
    out = ask(spark, [row("a#x", "t", "Deploytoken", "obsolete"), row("b#x", "t", "Deploytoken", "current")], "Deploytoken")
    assert [r.uid for r in out] == ["b#x", "a#x"] and "superseded" in out[1].explain
    out = ask(spark, [row("n#body", "other", "Wireguardtoken " * 3), row("n#heading", "Wireguardtoken", "x")], "Wireguardtoken")
    assert out[0].uid == "n#heading" and "matched heading" in out[0].explain


def test_index_follows_changes(spark, tmp_path, monkeypatch):
    """An update equals a new build, tokenizes only what has changed, and a failed one leaves the generation before."""
    weights, folder = {"heading": 8.0, "body": 1.0}, str(tmp_path / "index")
    make = lambda rows: spark.createDataFrame(rows, "section_uid string, heading string, body string")
    before = [("a", "Deploy", "to the host"), ("b", None, "alpha beta"), ("c", "Gone", "soon"), ("e", "", "")]
    after = [("a", "Deploy", "to the host"), ("b", "New", "alpha gamma"), ("d", "Fresh", "delta"), ("e", "", "")]
    assert index.latest(spark, folder) is None
    index.build(make(before), weights, folder)
    assert index.update(make(before), weights, folder)[0] == 1
    rows = lambda i: [sorted(map(tuple, x.collect()), key=repr) for x in (i.postings.select("uid", "term", "dl", "tf"), i.keys.select("key", "term"), i.stats, i.rows.select("uid", "content_hash"))]
    seen, tokenized = [], lexical.tokenized
    monkeypatch.setattr(lexical, "tokenized", lambda s, *a: seen.append(sorted(r.section_uid for r in s.collect())) or tokenized(s, *a))
    number, updated = index.update(make(after), weights, folder)
    assert number == 2 and seen == [["b", "d"]]
    slots = [(r.blk, r.slot) for r in updated.blocks.select("blk", F.inline("posts")).select("blk", "slot", "uid").distinct().collect()]
    assert len(slots) == len(set(slots)) == 3 and updated.blocks.filter(F.bit_count("mask") != F.size("posts")).isEmpty()
    assert rows(updated) == rows(index.build(make(after), weights, str(tmp_path / "other"))) == rows(index.latest(spark, folder)[1])
    monkeypatch.setattr(lexical, "prefix_keys", lambda _: 1 / 0)
    with pytest.raises(ZeroDivisionError):
        index.update(make(before), weights, folder)
    assert index.latest(spark, folder)[0] == 2 and rows(index.latest(spark, folder)[1]) == rows(updated)


def test_expansion_limits(spark):
    edges = spark.createDataFrame([("a", "b", "related"), ("b", "c", "related"), ("c", "d", "related"), ("a", "c", "parent"), ("a", "z", "unknown")], "src string, dst string, relation string")
    roots = spark.createDataFrame([(1, "a", 1.0), (1, "nowhere", 1.0)], "qid long, node string, score double")
    out = {r.node: (round(r.score, 4), r.hops) for r in graph.expand(roots, edges).collect()}
    assert out == {"a": (1.0, 0), "b": (0.36, 1), "c": (0.18, 1), "d": (0.0648, 2)}
    assert {r.node for r in graph.neighbourhood(edges, "c").collect()} == {"a", "b", "d"}


def test_pagerank_sums_to_one(spark):
    edges = spark.createDataFrame([("a", "b"), ("b", "c"), ("c", "a"), ("a", "d")], "src string, dst string")
    assert abs(graph.pagerank(edges, 5).agg(F.sum("rank")).first()[0] - 1) < 1e-9


def test_prefix_and_phrases(spark):
    rows = sections(spark, [row("a#x", "Deploying", "now"), row("b#x", "h", "deploy it not")])
    q = spark.createDataFrame([(1, "how do I deploy?"), (2, "deploy thing")], "qid long, question string")
    assert {r.uid for r in job.seeds(rows, q).filter("qid = 1").collect()} == {"a#x", "b#x"}
    assert {r.uid for r in job.seeds(rows, q).filter("qid = 2").collect()} == {"b#x"}
    p = spark.createDataFrame([(1, "it not")], "qid long, phrase string")
    assert [(r.uid, r.at) for r in lexical.phrase(rows, p).collect()] == [("b#x", 1)]


def test_context_reorders_only(spark):
    rows = [(1, f"u{i}", i + 1, 1.0 / (61 + i), 0, i, t, "blender" if t == "plain" else "", p, "b") for i, (t, p) in enumerate([("none", "/x/blender.md"), ("plain", "/y/b.md"), ("other", "/home/p/c.md")])]
    df = spark.createDataFrame(rows, "qid long, uid string, rank int, score double, list_no int, position int, title string, heading_path string, path string, body string")
    ctx = spark.createDataFrame([(1, "blender", "/home/p/")], "qid long, app string, cwd string")
    assert [r.uid for r in context.boosted(df, ctx).orderBy("rank").collect()] == ["u2", "u1", "u0"]
    aliases = {"ghostty": ["com.mitchellh.ghostty"], "obs": ["obs-studio"]}
    names = context.alias_for(spark.createDataFrame([("com.mitchellh.ghostty.agent",), ("com.obsproject.Studio",), ("",), ("Desktop.App",)], "wm_class string"), aliases | {"OBS": ["obs-studio"]}).collect()
    assert [r.app for r in names] == ["ghostty", "studio", None, "desktop.app"]
    asks = spark.createDataFrame([(1, "crop in obs"), (2, "crop"), (3, "plain")], "qid long, question string")
    seen = spark.createDataFrame([(1, "ghostty", "/p"), (2, "ghostty", None)], "qid long, wm_class string, cwd string")
    assert {r.qid: (r.app, r.cwd) for r in context.effective(seen, asks, aliases).collect()} == {1: ("obs", "/p"), 2: ("ghostty", None), 3: (None, None)}
    assert one(spark, context.app_named_in(F.col("t"), aliases), t="observability dashboards") is None
    assert one(spark, context.app_named_in(F.col("t"), aliases), t="crop in obs") == "obs"
    assert not one(spark, context.under(F.lit("/home/pq/a"), F.lit("/home/p")))


def test_packing(spark):
    rows = spark.createDataFrame([(1, i, "x" * 2000) for i in range(1, 21)] + [(2, 1, "y" * 8000)], "qid long, rank int, block string")
    taken = {r.qid: r["count"] for r in pack.packed(rows, 600).groupBy("qid").count().collect()}
    assert taken == {1: 1, 2: 1} and pack.packed(rows, 1200).filter("qid = 1").count() == 2
    cut = one(spark, pack.cut(F.col("t")), t="a" * 3000 + "\n\n" + "b" * 5000)
    assert cut == "a" * 3000 + pack.CUT_MARK and one(spark, pack.cut(F.col("t")), t="a" * 4001) == "a" * 4000 + pack.CUT_MARK
    assert one(spark, pack.sanitised(F.col("t")), t="a</source>b<source c\x07\n\td") == "a<\\/source>b<\\source c\n\td"
    assert "</source>" not in one(spark, pack.sanitised(F.col("t")), t="</sou</source>rce>")
    assert one(spark, pack.cut(F.col("t")), t="a" * 3990 + " \u00a0\n" + " " * 7 + "b" * 90) == "a" * 3990 + pack.CUT_MARK
    assert one(spark, pack.cut(F.col("t")), t="é" * 1500 + "\n\n" + "b" * 5000) == "é" * 1500 + pack.CUT_MARK  # more than half the bytes
    asks = spark.createDataFrame([(1, "why <source 9>?\x07"), (3, "nothing")], "qid long, question string")
    out = {r.qid: (r.prompt, r.sources) for r in pack.prompts(spark.createDataFrame([(1, 1, "B")], "qid long, rank int, block string"), asks).collect()}
    assert out == {1: ("BQuestion: why <\\source 9>?", 1), 3: ("No sources were found.\n\nQuestion: nothing", 0)}
    ranked = spark.createDataFrame([(1, k, f"u{k}", 0.1 / k) for k in range(1, 6)] + [(2, 1, "v", 5.0)], "qid long, rank int, uid string, score double")
    gate = {r.qid: (r.confident, r.closest) for r in pack.gated(ranked, spark.createDataFrame([(1,), (2,), (3,)], "qid long"), 1.0).collect()}
    assert gate == {1: (False, ["u1", "u2", "u3"]), 2: (True, None), 3: (False, [])}
    assert one(spark, pack.with_correction(F.col("t"), F.lit("C\n")), t="b Question: x Question: y") == "b Question: x C\nQuestion: y"


def test_actions(spark):
    results = spark.createDataFrame([(1, f"s{i}", i + 1, f"/p{i}.md", "" if i else "Head", "Note", i) for i in range(3)], "qid long, uid string, rank int, path string, heading string, note_title string, start_line int")
    rows = [("s0", "url", "http://u/x?y", None, None), ("s1", "video", "http://v", None, 61), ("s2", "file", "d/c.py", 0, None), ("s1", "file", "d/c.py", None, None), ("s1", "file", "d/c.py", 7, None), ("s0", "odd", "z", None, None), ("s0", "app", " GIMP", None, None), ("s0", "app", "gone", None, None), ("s2", "project", "/a/proj/", None, None), ("s1", "video", "http://v", None, None)]
    declared = spark.createDataFrame([(*r, k) for k, r in enumerate(rows)], "section_uid string, kind string, target string, line int, seconds long, seq long")
    apps = spark.createDataFrame([("org.gimp.GIMP", "Image Editor"), ("org.gnome.Maps", "Maps"), ("org.gnome.Music", "Music")], "app_id string, app_name string")
    known = actions.resolved(declared, spark.createDataFrame([("/a/proj/",)], "target string"), apps)
    out = [(r.id, r.kind, r.label, r.to.value, r.enabled) for r in actions.offered(results, known, 20).orderBy("id").collect()]
    assert [r[1:] for r in out] == [
        ("open_file", "Head", "/p0.md", True), ("open_file", "Note", "/p1.md", True), ("open_file", "Note", "/p2.md", True),
        ("open_file", "c.py", "d/c.py", False), ("open_file", "c.py", "d/c.py", False),
        ("open_video", "▶ 01:01", "http://v", True), ("open_video", "▶ Video", "http://v", True),
        ("launch_desktop_app", "Image Editor", "org.gimp.GIMP", True), ("launch_desktop_app", "gone", "gone", False),
        ("open_project", "proj", "/a/proj/", True), ("open_url", "u", "http://u/x?y", True),
    ]
    assert [r[0] for r in out] == list(range(1, 12)) and actions.offered(results, known).count() == 9
    outside = known.filter("kind = 'url'").withColumn("qid", F.lit(1).cast("long")).withColumn("section_uid", F.lit("elsewhere"))
    assert [r.label for r in actions.offered(results, outside).orderBy("id").collect()][-1] == "u"
    assert one(spark, actions.time_label(F.lit(414))) == "06:54" and one(spark, actions.time_label(F.lit(3723))) == "1:02:03"
    assert one(spark, actions.with_time(F.lit("http://v?a=1"), F.lit(5))) == "http://v?a=1&t=5s" and one(spark, actions.host(F.lit("https://a.b?c/d"))) == "a.b?c"
    video = lambda s: actions.typed(F.lit("video"), F.lit("http://v"), F.lit(1), F.lit(s))
    player, opener = F.array(F.lit("mpv"), F.lit("--start={seconds}"), F.lit("{url}")), F.array(F.lit("open"), F.lit("{url}"))
    assert one(spark, actions.expanded(player, video(7))) == ["mpv", "--start=7", "http://v"] and one(spark, actions.expanded(player, video(None)))[1] == "--start=0"
    assert one(spark, actions.expanded(opener, video(7))) == ["open", "http://v?t=7s"] and one(spark, actions.expanded(opener, video(None))) == ["open", "http://v"]
    file = actions.typed(F.lit("file"), F.lit("/a b/x.MD"), F.lit(4), F.lit(None))
    openers = {"markdown": ["nvim", "+{line}", "{path}"], "text": ["code"], "project": ["dir"], "url": ["www"], "video": ["gone"]}
    assert one(spark, actions.expanded(actions.template(file, openers, set()), file)) == ["nvim", "+4", "/a b/x.MD"]
    assert one(spark, actions.template(video(1), openers, {"mpv"})) == ["mpv", "--start={seconds}", "{url}"] and one(spark, actions.template(video(1), openers, set())) == ["xdg-open", "{url}"]
    wanted = spark.createDataFrame([(" gimp ",), ("gim",), ("Maps",), ("org.gnome.m",), ("org.gnome.music",), ("zzz",), (" ",), ("image",)], "name string")
    assert {r.name: r.app_id for r in actions.resolve_app(wanted, apps).collect()} == {" gimp ": "org.gimp.GIMP", "Maps": "org.gnome.Maps", "org.gnome.music": "org.gnome.Music", "image": "org.gimp.GIMP"}


def test_memory(spark):
    corrections = spark.createDataFrame([(1, "q", "deploy container image", False), (2, "q", "deploy rsync", True)], "id long, question string, normalized string, stale boolean")
    q = spark.createDataFrame([(1, "how do I deploy container image"), (2, "deploy image container now"), (3, "unrelated words")], "qid long, question string")
    best = {r.qid: (r.id, r.exact) for r in memory.best_corrections(q, corrections, 0.4, fuzzy=True).collect()}
    assert best == {1: (1, True), 2: (1, False)}
    sources = spark.createDataFrame([(1, "a", "v1"), (2, "b", "v1")], "correction_id long, section_uid string, content_hash string")
    for hash_, expected in (("v1", {1: False, 2: True}), ("v2", {1: True, 2: True})):
        now = spark.createDataFrame([("a", hash_)], "section_uid string, content_hash string")
        out = memory.refreshed(corrections, sources, now).collect()
        assert {r.id: r.stale for r in out} == expected and sum(r.changed for r in out) == (hash_ == "v2")
    writes = spark.createDataFrame([("k", "a", "m1", 1, 1), ("k", "b", "m2", 2, 2)], "key string, answer string, model string, created_at long, seq long")
    assert tuple(memory.upserted(writes).first()) == ("k", "b", "m1", 2)
    packed = spark.createDataFrame([(1, 1, "a", "x"), (1, 2, "b", "y"), (2, 1, "b", "y"), (2, 2, "a", "x")], "qid long, rank int, uid string, body string")
    keys = lambda model, version: {r.qid: r.key for r in memory.cache_keys(packed, model, 1, 200, 0.2, version).collect()}
    a, b, c = keys(None, 0), keys("m", 0), keys(None, 1)
    assert len({a[1], a[2], b[1], c[1]}) == 4 and a == keys(None, 0)
    prov = spark.createDataFrame([(1, "q", ["a"], None), (2, "q", ["b"], -1)], "id long, query string, section_uids array<string>, rating int")
    ratings = spark.createDataFrame([(1, -1, 1), (1, 1, 2), (9, 1, 1)], "id long, rating int, ts long")
    assert tuple(memory.rating_counts(memory.rate(prov, ratings)).first()) == (2, 1, 1)
    with pytest.raises(ValueError):
        memory.exported(memory.rate(prov, ratings), 2)
    assert memory.exported(memory.rate(prov, ratings), 1).count() == 1


def test_benchmark_numbers(spark):
    ranks = lambda xs: spark.createDataFrame([(i, x) for i, x in enumerate(xs)], "qid long, rank int")
    r = bench.report(ranks([1, 3, 9, None])).first()
    assert (r.recall_1, r.recall_3, r.recall_5) == (0.25, 0.5, 0.5)
    assert bench.report(ranks([1, None])).first().mrr == 0.5 and bench.report(ranks([5])).first().mrr == 0.2
    assert tuple(bench.report(ranks([])).first()) == (0, 0.0, 0.0, 0.0, 0.0)
    before = spark.createDataFrame([("a", 5), ("b", 1), ("c", 2)], "question string, rank int")
    after = spark.createDataFrame([("a", 1, 0), ("b", None, 1), ("c", 2, 2), ("d", 1, 3)], "question string, rank int, pos int")
    assert [(m.question, m.delta) for m in bench.moved(before, after).orderBy("place").collect()] == [("b", 999), ("a", -4)]
    reports = spark.createDataFrame([(0, 0.5), (1, 0.7), (2, 0.7)], "combo int, mrr double")
    assert bench.best_combination(reports).first().combo == 1
    with pytest.raises(AssertionError):
        bench.check_floor(0.5, 0.8)


def test_sources(spark):
    files = spark.createDataFrame([("a/b.md",), ("a/x/c.md",), ("a/target/d.md",), ("e.txt",)], "path string")
    assert {r.path for r in vault.accepted(files, ["**/*.md"], ["**/target/**"]).collect()} == {"a/b.md", "a/x/c.md"}
    assert {r.path for r in vault.accepted(files, [], ["a/*"]).collect()} == {"a/x/c.md", "a/target/d.md", "e.txt"}
    body = "@file src/a.py:12\n@video https://v.org/w?t=90s\n@video https://v.org/z 1:02:03\n@app gimp\nplain"
    found = {r.target: (r.kind, r.line, r.seconds) for r in vault.actions(spark.createDataFrame([("u", body)], "section_uid string, body string")).collect()}
    assert found == {"src/a.py": ("file", 12, None), "https://v.org/w": ("video", None, 90), "https://v.org/z": ("video", None, 3723), "gimp": ("app", None, None)}
    entries = [(0, "gimp", "[Desktop Entry]\nName=GIMP\nExec=gimp %U\n[Other]\nName=No\n"), (1, "gimp", "[Desktop Entry]\nName=Later\n"), (0, "h", "[Desktop Entry]\nName=H\nHidden=true\n")]
    out = vault.desktop_entries(spark.createDataFrame(entries, "dir_rank int, app_id string, content string")).collect()
    assert [tuple(r) for r in out] == [("gimp", "GIMP", "gimp %U")]
    long = "\n\n".join(f"paragraph {i} " + "word " * 100 for i in range(10))
    parts = vault.subchunks(spark.createDataFrame([("u", long), ("v", "short")], "section_uid string, body string")).withColumn("section_uid", F.coalesce("parent_uid", "section_uid")).groupBy("section_uid").count().collect()
    assert {r.section_uid: r["count"] for r in parts} == {"u": 5, "v": 1}


def test_vectors(spark):
    rows = spark.createDataFrame([(0, [1.0, 0.0]), (1, [0.9, 0.1]), (2, [0.0, 2.0]), (3, [0.0, 0.0])], "vec_id long, embedding array<float>")
    out = vectors.top_k(rows.filter("vec_id = 0"), rows, 2).orderBy("position").collect()
    assert [r.uid for r in out] == [0, 1] and out[0].score == 1.0


def test_vectors_of_any_kind_have_the_scores_of_dot(spark, monkeypatch):
    """Matrices only show where to look: equal vectors, halves, missing ones, holes and other sizes rank as the plain products do, and no pair is a row of the plan."""
    g = np.random.default_rng(3)
    rows = [(i, g.normal(size=6).round(1).tolist()) for i in range(300)] + [(300 + i, [1.0, 0.0, 0.0, 0.0, 0.0, 0.0]) for i in range(40)]
    rows += [(400, None), (401, []), (402, [1.0, 2.0]), (403, [1.0, None, 0.0, 0.0, 0.0, 0.0]), (404, [float("nan")] * 6), (405, [0.0] * 6)]
    every = spark.createDataFrame(rows, "vec_id long, embedding array<float>").repartition(3)
    asked = every.filter("vec_id % 50 = 0 OR vec_id > 400")
    a, b = (df.select(F.col("vec_id").alias(n), vectors.unit(F.col("embedding")).alias(f"v{n}")) for df, n in ((asked, "qid"), (every, "uid")))
    pairs = a.crossJoin(b).select("qid", "uid", F.round(vectors.dot(F.col("vqid"), F.col("vuid")), 5).alias("score"))
    want = sorted(map(repr, lexical.top_k(pairs, 25).collect()))
    for name, size in (("BLOCK", 4000), ("BLOCK", 3), ("ROWS", 16), ("TILE", 2)):
        monkeypatch.setattr(vectors, name, size)
        out = vectors.top_k(asked, every, 25)
        assert sorted(map(repr, out.collect())) == want and len(want) == 25 * asked.count()
    assert "NestedLoop" not in out._jdf.queryExecution().executedPlan().toString()
    halves = np.array([0.000005, 0.123455, -0.123455, 1.000005, 0.5, 0.0000149999])
    assert vectors.rounded(halves).tolist() == [r.x for r in spark.createDataFrame([(float(x),) for x in halves], "x double").select(F.round("x", 5).alias("x")).collect()]


def at(seconds):
    return dt.datetime(2024, 1, 1) + dt.timedelta(seconds=seconds)


def test_events(spark):
    e = spark.createDataFrame([(at(0), "/v/a.md", "modify"), (at(1), "/v/.git/x", "modify"), (at(2), "/v", "modify"), (at(3), "/v/b.md", "access"), (at(4), "/vv/b.md", "create")], "ts timestamp, path string, kind string")
    assert [r.path for r in st.relevant_paths(st.content_changes(e), "/v/").collect()] == ["/v/a.md"]
    q = spark.createDataFrame([(1, "c", at(0), at(10)), (2, "c", at(5), at(6)), (3, "d", at(0), at(9))], "query_id long, conn string, ts timestamp, ended timestamp")
    assert {r.query_id: r.cancelled for r in st.superseded(q).collect()} == {1: True, 2: False, 3: False}
    answers = spark.createDataFrame([("c", 1, at(1)), ("c", 1, at(7)), ("c", 2, at(7))], "conn string, query_id long, ts timestamp")
    assert st.current_events(answers, q.select("conn", "query_id", "ts")).count() == 2
    h = spark.createDataFrame([(i, "c", t) for i, t in enumerate(["a", "a ", "\u00a0\t", "b", " a"])], "event_id long, conn string, text string")
    assert [r.text for r in st.history(h, ["conn"], "text", ["event_id"], 2).orderBy("age").collect()] == ["a", "b"]


def test_stream_and_batch_agree_on_closed_bursts(spark, tmp_path):
    rows = [(1, at(s)) for s in (0, 10, 5000, 5010)] + [(2, at(20)), (1, at(90_000))]
    source = str(tmp_path / "in")
    spark.createDataFrame(rows, "user_id long, ts timestamp").coalesce(1).write.parquet(source)
    batch = st.bursts(spark.read.parquet(source), "10 minutes", ["user_id"]).filter("started < timestamp'2024-01-02'")
    live = spark.readStream.schema("user_id long, ts timestamp").parquet(source).withWatermark("ts", "1 hour")
    query = st.bursts(live, "10 minutes", ["user_id"]).writeStream.format("memory").queryName("bursts").outputMode("append").option("checkpointLocation", str(tmp_path / "c")).trigger(availableNow=True).start()
    query.awaitTermination(60)
    assert sorted(map(tuple, spark.table("bursts").collect())) == sorted(map(tuple, batch.collect())) and batch.count() == 3


def test_reindex_stream_catches_up(spark, tmp_path):
    """What changes during a pause, or before a rebuild that fails, comes with the next rebuild."""
    source, seen, checkpoint = str(tmp_path / "in"), [], str(tmp_path / "c")
    changes = lambda: st.content_changes(spark.readStream.schema("ts timestamp, path string, kind string").parquet(source))

    def add(*rows):
        spark.createDataFrame([(at(k), *r) for k, r in enumerate(rows)], "ts timestamp, path string, kind string").coalesce(1).write.mode("append").parquet(source)

    def run(rebuild, paused=False):
        st.reindex_stream(changes(), rebuild, checkpoint, lambda: paused).awaitTermination(60)

    def good(paths, generation):
        seen.append((generation, sorted(r.path for r in paths.collect())))

    def bad(paths, generation):
        raise RuntimeError("the rebuild failed")

    add(("/v/a.md", "modify"), ("/v/a.md", "modify"), ("/v/b.md", "access"))
    run(good, paused=True)
    add(("/v/c.md", "create"))
    with pytest.raises(Exception, match="the rebuild failed"):
        run(bad)
    run(good)
    add(("/v/d.md", "create"))
    run(good)
    assert [p for _, p in seen] == [["/v/a.md", "/v/c.md"], ["/v/d.md"]] and seen[0][0] < seen[1][0]


def test_large_corrections_and_numbers(spark):
    """Rare words first: similar sets are found as by comparing all, also with a word that all share."""
    import random

    r = random.Random(8)
    texts = [" ".join(["common", *(f"w{r.randrange(40)}" for _ in range(r.randint(1, 9)))]) for _ in range(80)]
    c = spark.createDataFrame([(i, t, t, i % 3 == 0) for i, t in enumerate(texts)], "id long, question string, normalized string, stale boolean")
    asks = [" ".join(["common", *(f"w{r.randrange(40)}" for _ in range(r.randint(1, 9)))]) for _ in range(60)]
    q = spark.createDataFrame(list(enumerate(asks)), "qid long, question string")
    for threshold in (0.3, 0.5, 0.8):
        expected = {}
        for i, a in enumerate(asks):
            best = []
            for k, t in enumerate(texts):
                x, y = set(a.split()), set(t.split())
                score = 1.0 if a == t else round(len(x & y) / len(x | y) * (0.8 if k % 3 == 0 else 1), 9)
                if a == t or score >= threshold:
                    best.append((a == t, score, k))
            if best:
                expected[i] = max(best)[2]
        assert {x.qid: x.id for x in memory.best_corrections(q, c, threshold, fuzzy=True).collect()} == expected
    rows = spark.createDataFrame([(i % 3, float(i * 7 % 100)) for i in range(200)] + [(None, 5.0), (1, None)], "kind int, v double")
    out = {x.kind: (x.p50, x.p99) for x in bench.percentiles(rows, "v", {"p50": 0.5, "p99": 0.99}, ["kind"]).collect()}
    for kind in (0, 1, 2):
        values = sorted(float(i * 7 % 100) for i in range(200) if i % 3 == kind)
        assert out[kind] == (values[-(-len(values) // 2) - 1], values[-(-99 * len(values) // 100) - 1])
    assert out[None] == (5.0, 5.0)


def test_lines(spark, tmp_path):
    sent = spark.createDataFrame([(1, "a\nb\"c"), (2, None), (None, "ü")], "id long, text string")
    text = lines.to_lines(sent)
    assert all("\n" not in r.value for r in text.collect())
    odd = spark.createDataFrame([('{"id": 3, "text": "x',), ("",), (None,), ("[1]",), ('{"id": "word"}',), ('{"id": 4, "text": "' + "y" * 100 + '"}',)], "value string")
    got = lines.from_lines(text.union(odd), "id long, text string", most=60).collect()
    assert [tuple(r) for r in got[:3]] == [(1, 'a\nb"c', False), (2, None, False), (None, "ü", False)]
    assert all(r.id is None and r.text is None for r in got[3:]) and all(r.malformed for r in got[3:])
    asks = spark.createDataFrame([("q", ["a#b"]), ("r", [])], "question string, expected array<string>")
    lines.write_questions(asks, str(tmp_path / "q"))
    assert sorted(tuple(r) for r in lines.read_questions(spark, str(tmp_path / "q")).collect()) == [("q", ["a#b"], None, None), ("r", [], None, None)]
    (tmp_path / "bad.json").write_text('{"question": "q", "expected": [')
    with pytest.raises(Exception):  # noqa: B017
        lines.read_questions(spark, str(tmp_path / "bad.json")).collect()
    few = spark.createDataFrame([("q", 1, ["a"]), ("r", 1, []), ("s", -1, ["b"])], "query string, rating int, section_uids array<string>")
    assert [tuple(r) for r in memory.exported(few, 1).collect()] == [("q", ["a"])]
    with pytest.raises(ValueError):
        memory.exported(few, 2)


def test_note_fields(spark):
    notes = [("a", "---\nid: x\ntags: [p, 'q r', ]\n---\nstatus: later"), ("b", "status: none\n---\nid: y\n---"), ("c", "---\n---\n"), ("d", None), ("e", "---\r\ntitle: \"T: u\"\r\n---")]
    out = {r.path: r for r in vault.note_fields(spark.createDataFrame(notes, "path string, content string")).collect()}
    assert out["a"].id == "x" and out["a"].status is None and out["a"].tags[0] == "p" and len(out["a"].tags) == 2
    assert all(out[k].id is None and out[k].status is None for k in "bcd") and out["e"].title == "T: u"


def test_parts_and_neighbours(spark):
    rows = [(1, "a", None, "A"), (1, "a/1", "a", "x"), (1, "b/1", "b", "y"), (2, "a", None, "A")]
    out = pack.without_parents(spark.createDataFrame(rows, "qid long, uid string, parent_uid string, heading_path string"))
    assert sorted((r.qid, r.uid, r.heading_path) for r in out.collect()) == [(1, "a/1", "A"), (1, "b/1", "y"), (2, "a", "A")]
    rows = [(1, "n", 3, 1, "c"), (1, "n", 2, 5, "b"), (1, "n", 5, 2, "e"), (1, "m", 4, 3, "z"), (2, "n", 4, 1, "d")]
    out = pack.merged_adjacent(spark.createDataFrame(rows, "qid long, path string, order_index long, rank long, body string"))
    assert sorted((r.qid, r.path, r["first"], r.n, r["rank"], r.body) for r in out.collect()) == [(1, "m", 4, 1, 3, "z"), (1, "n", 2, 2, 1, "b\n\nc"), (1, "n", 5, 1, 2, "e"), (2, "n", 4, 1, 1, "d")]


def test_records_and_counts(spark):
    before = spark.createDataFrame([(7, "old", 1)], "id long, query string, rating int")
    new = spark.createDataFrame([("b", ["s"], None, 2), ("a", [], "m", 1)], "query string, section_uids array<string>, model string, seq long")
    assert sorted((r.id, r.query, r.rating) for r in memory.recorded(before, new).collect()) == [(7, "old", 1), (8, "a", None), (9, "b", None)]
    assert sorted(r.id for r in memory.recorded(before.filter("id < 0"), new).collect()) == [1, 2] and memory.recorded(before, new.filter("seq < 0")).count() == 1
    none = spark.createDataFrame([], "stale boolean")
    assert memory.stale_count(none).first().n_stale == 0
    known = spark.createDataFrame([("u", "file"), ("u", "url")], "section_uid string, kind string")
    asks = spark.createDataFrame([(1, ["u", "u", "v"]), (2, [])], "qid long, uids array<string>")
    assert sorted(r.kind for r in actions.looked_up(asks, known).collect()) == ["file", "url"]


def _topics(seed, n):
    """Rows of frequent words, and of words of a topic that a dozen rows share."""
    r = random.Random(seed)
    return [(i, " ".join([f"w{int(r.paretovariate(0.8)) % 50}" for _ in range(r.randint(0, 40))] + [f"t{i // 12}x{r.randint(0, 3)}" for _ in range(4)])) for i in range(n)]


def test_block_maxima_give_the_same_rows_and_skip_blocks(spark, tmp_path, monkeypatch):
    rows = spark.createDataFrame(_topics(1, 4000), "section_uid long, body string")
    built = index.build(rows, {"body": 1.0}, str(tmp_path / "index"))
    r = random.Random(2)
    asked = [(q, f"w1 w{r.randint(2, 49)} t{(t := r.randint(0, 330))}x0 t{t}x1 t{t}x" if q % 4 else r.choice(["w1", "nowhere", "w2 w3 w", "t5x1"])) for q in range(40)]
    terms = lexical.query_terms(spark.createDataFrame(asked, "qid long, question string"))
    read, scored = [], lexical.scored
    monkeypatch.setattr(lexical, "scored", lambda b, s, chosen, *a: read.append(chosen.count()) or scored(b, s, chosen, *a))
    monkeypatch.setattr(lexical, "QUESTIONS", 15)
    for keys in (None, built.keys):
        read.clear()
        every = lexical.bm25(built.postings, built.stats, terms, keys=keys)
        expected = lexical.top_k(every, 10).collect()
        got = lexical.best(built.blocks, built.stats, terms, 10, keys=keys, first=4).collect()
        assert sorted(map(tuple, got)) == sorted(map(tuple, expected)) and len(got) > 200
        total = 40 * built.blocks.select("blk").distinct().count()
        assert len(read) == 2 and read[0] <= 160 and sum(read) < 0.7 * total
        print(f"{sum(read)} of {total} blocks")


def test_a_frequent_term_lies_in_many_ranges(spark, tmp_path, monkeypatch):
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")  # the table is small
    monkeypatch.setattr(index, "discard", lambda *tables: spark.conf.unset("spark.sql.adaptive.coalescePartitions.enabled"))
    rows = spark.createDataFrame([(i, "the same " + ("rare" if i % 500 == 0 else "")) for i in range(20_000)], "section_uid long, body string")
    built = index.build(rows, {"body": 1.0}, str(tmp_path / "index"))
    files = built.blocks.filter("term = 'the'").groupBy(F.input_file_name()).agg(F.count("*").alias("n")).collect()
    assert len(files) > 1 and max(f.n for f in files) < 0.8 * sum(f.n for f in files)
    assert built.blocks.agg(F.max(F.size("posts"))).first()[0] <= lexical.BLOCK


def test_blocks_are_put_together_without_a_shuffle(spark, tmp_path, monkeypatch):
    """Texts of any length stay in the tasks that read them, and blocks answer as the postings do, whatever the groups of questions."""
    r = random.Random(4)
    rows = [(i, r.choice([None, "", "alpha head", "w1 beta"]), text, [f"w{i % 9}"]) for i, text in _topics(3, 700)] + [(700 + i, None, " ".join(f"w{r.randint(0, 900)}" for _ in range(30_000)), []) for i in range(2)]
    made = spark.createDataFrame(rows, "section_uid long, heading string, body string, tags array<string>")
    weights = {"heading": 8.0, "body": 1.0, "tags": 0.5}
    plan = lexical.packed(made, weights, "section_uid", F.lit(""))._jdf.queryExecution().executedPlan().toString()
    assert "Exchange" not in plan and "Sort" not in plan
    built = index.build(made, weights, str(tmp_path / "index"))
    words = [(i, term, tf) for i, *text in rows for term, tf in _weighed(text, weights).items()]
    assert sorted(words) == sorted(tuple(x) for x in built.postings.select("uid", "term", "tf").collect())
    assert built.rows.count() == 702 and built.rows.filter("num % 64 > 0").count() > 600
    asked = [(q, f"w{q} w1 beta t{q}x1 t{q}" if q % 3 else "w1 w2") for q in range(30)]
    terms = lexical.query_terms(spark.createDataFrame(asked, "qid long, question string"))
    every = sorted(map(tuple, lexical.top_k(lexical.bm25(built.postings, built.stats, terms, keys=built.keys), 10).collect()))
    has = {}
    for i, term, _ in words:
        has.setdefault(i, set()).add(term)
    both = sorted((q, i) for q, text in asked for i, there in has.items() if set(text.split()) <= there)
    for size in (2000, 7):
        monkeypatch.setattr(lexical, "QUESTIONS", size)
        assert sorted(map(tuple, lexical.best(built.packed, built.stats, terms, 10, keys=built.keys).collect())) == every
        assert sorted(map(tuple, lexical.all_terms(built.packed, terms).collect())) == both and both


def test_what_is_expected_is_looked_up_once(spark, tmp_path, monkeypatch):
    """The report of two lists reads the index of all columns once, and makes a graph of that one only."""
    from marginalia import queries

    for name in ("documents", "benchmark", "labels"):
        spark.read.parquet(f"/root/testdata/sf0.001/{name}.parquet").limit(20).write.parquet(str(tmp_path / f"{name}.parquet"))
    seen, graphs, all_terms, write = [], [], lexical.all_terms, index._write_graph
    monkeypatch.setattr(lexical, "all_terms", lambda *a: seen.append(1) or all_terms(*a))
    monkeypatch.setattr(index, "_write_graph", lambda *a: graphs.append(1) or write(*a))
    assert queries.sink_json_report(spark, str(tmp_path)).count() == 2
    assert len(seen) == 1 and len(graphs) == 1


def _weighed(columns, weights):
    """The terms of a row with their weighted counts."""
    out = {}
    for text, weight in zip(columns, weights.values(), strict=True):
        for term in (text if isinstance(text, list) else (text or "").split()):
            out[term] = out.get(term, 0.0) + weight
    return out


def test_graph_of_a_generation(spark, tmp_path):
    """Edges are made anew for changed sections only; a build that fails keeps the snapshot before."""
    folder, weights = str(tmp_path / "index"), {"body": 1.0}
    make = lambda rows: spark.createDataFrame(rows, "section_uid string, body string, parent_uid string")
    seen = []

    def links(rows):
        seen.append(sorted(r.section_uid for r in rows.collect()))
        return vault.edges(rows).withColumn("owner", F.col("src"))

    edges = lambda i: sorted((e.src, e.dst) for e in i.edges.collect())
    first = index.build(make([("a", "see [[b]]", None), ("b", "see [[c]]", "a"), ("c", "", None)]), weights, folder, links=links)
    assert edges(first) == [("a", "b"), ("b", "a"), ("b", "c")] and first.graph_generation == 1
    after = [("a", "see [[b]]", None), ("b", "see [[d]]", "a"), ("d", "see [[a]]", None)]
    number, second = index.update(make(after), weights, folder, links=links)
    assert number == 2 and seen[1] == ["b", "d"] and edges(second) == [("a", "b"), ("b", "a"), ("b", "d"), ("d", "a")]
    assert {r.node: r.degree for r in second.degrees.collect()} == {"a": 3, "b": 3, "d": 2}
    number, third = index.update(make([*after, ("e", "see [[a]]", None)]), weights, folder, links=lambda _: 1 / 0)
    assert number == 3 and third.generation == 3 and third.graph_generation == 2 and edges(third) == edges(second)
    assert third.rows.count() == 4 and edges(index.latest(spark, folder)[1]) == edges(second)
    number, fourth = index.update(make(after), weights, folder, links=links)
    assert seen[-1] == ["a", "b", "d"] and fourth.graph_generation == 4 and edges(fourth) == edges(second)


def test_hubs_are_dealt_by_salts(spark, monkeypatch):
    rows = [("hub", f"n{i}", "related") for i in range(3000)] + [(f"n{i}", f"n{i + 1}", "link") for i in range(50)] + [("x", "hub", "parent")]
    edges = spark.createDataFrame(rows, "src string, dst string, relation string")
    roots = spark.createDataFrame([(q, n, 1.0) for q, n in ((1, "hub"), (2, "x"), (3, "n7"), (4, "gone"))], "qid long, node string, score double")
    plain = sorted(map(repr, graph.expand(roots, edges).collect()))
    ranks = {r.node: round(r["rank"], 12) for r in graph.pagerank(edges, 3).collect()}
    monkeypatch.setattr(graph, "HUB", 100)
    steps = graph.dealt(graph.both_ways(edges))
    assert [tuple(h) for h in steps.hubs.collect()] == [("hub", 31)]
    assert steps.rows.filter("at = 'hub'").groupBy("salt").count().agg(F.max("count")).first()[0] < 200
    assert sorted(map(repr, graph.expand(roots, edges).collect())) == sorted(map(repr, graph.expand(roots, steps).collect())) == plain
    monkeypatch.setattr(graph, "BROADCAST_ROWS", 0)
    assert sorted(map(repr, graph.expand(roots, edges).collect())) == plain
    assert {r.node: round(r["rank"], 12) for r in graph.pagerank(edges, 3).collect()} == ranks


def test_bodies_of_other_sections_are_not_shuffled(spark, tmp_path):
    rows = [row(f"s{i}", f"t{i}", f"alpha w{i} beta w{i % 7}") for i in range(200)]
    sections(spark, rows).write.parquet(str(tmp_path / "sections"))
    stored = spark.read.parquet(str(tmp_path / "sections"))
    built = index.build(stored, {"body": 1.0}, str(tmp_path / "index"))
    questions = spark.createDataFrame([(1, "alpha w5")], "qid long, question string")
    limit = spark.conf.get("spark.sql.autoBroadcastJoinThreshold")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        out = job.retrieve(stored, None, questions, index=built)
        assert out.count() == 20 and out.filter("body IS NULL").isEmpty()
        plan = out._jdf.queryExecution().executedPlan().toString()
        read = plan[plan.index("LeftSemi, BuildRight") :].split("BroadcastExchange")[0]  # from the semi join down to the scan of the sections
        assert plan.count("FileScan") <= 8 and "body" in read and "FileScan" in read and "Exchange" not in read
    finally:
        spark.conf.set("spark.sql.autoBroadcastJoinThreshold", limit)


def test_phrases_of_many_tokens(spark):
    r = random.Random(3)
    rows = [(i, " ".join(r.choice("abcde") for _ in range(r.randint(0, 40)))) for i in range(60)]
    asked = [(q, " ".join(r.choice("abcde") for _ in range(r.randint(0, 4)))) for q in range(30)] + [(90, "never a"), (91, "a")]
    got = lexical.phrase(spark.createDataFrame(rows, "section_uid long, body string"), spark.createDataFrame(asked, "qid long, phrase string"))
    want = [(q, i, at) for q, p in asked for i, b in rows for at in range(len(b.split())) if p.split() and b.split()[at : at + len(p.split())] == p.split()]
    assert sorted(map(tuple, got.collect())) == sorted(want) and len(want) > 100


def test_corrections_are_folded_from_a_log(spark):
    """The version rises by one for each save and each delete that hits."""

    def after(*events):
        log = spark.createDataFrame([(k, kind, *((x, f"answer {k}", k, None) if kind == "save" else (None, None, None, x))) for k, (kind, x) in enumerate(events, 1)], "seq long, kind string, question string, answer string, created_at long, id long")
        log = memory.corrections_log(log)
        return memory.version(log).first().version, sorted((r.id, r.normalized, r.answer, r.writes) for r in memory.standing(log).collect())

    assert after() == (0, [])
    assert after(("save", "deploy")) == (1, [(1, "deploy", "answer 1", 1)])
    two = [("save", "Deploy!"), ("save", "backup")]
    assert after(*two) == (2, [(1, "deploy", "answer 1", 1), (2, "backup", "answer 2", 1)])
    assert after(*two, ("delete", 1)) == (3, [(2, "backup", "answer 2", 1)])
    assert after(*two, ("delete", 1), ("delete", 1), ("delete", 77)) == (3, [(2, "backup", "answer 2", 1)])
    assert after(*two, ("save", "deploy")) == (3, [(1, "deploy", "answer 3", 2), (2, "backup", "answer 2", 1)])
    again = [*two, ("delete", 1), ("save", "deploy"), ("delete", 1)]
    assert after(*again) == (4, [(2, "backup", "answer 2", 1), (4, "deploy", "answer 4", 1)])
    assert after(*again, ("delete", 4)) == (5, [(2, "backup", "answer 2", 1)])
    # A save that replaced another made no correction, so a delete of it misses, and so does that of a later one.
    assert after(("save", "deploy"), ("save", "deploy"), ("delete", 2), ("save", "deploy"), ("delete", 4)) == (3, [(1, "deploy", "answer 4", 3)])
    assert after(("save", "deploy"), ("save", "deploy"), ("delete", 2), ("save", "deploy"), ("delete", 1)) == (4, [])


def test_latency(spark):
    runs = [("a", 0, 900.0, 9.0, 9.0, 9), ("a", 1, 10.0, 2.0, 100.0, 20), ("a", 2, 30.0, 0.0, 100.0, 0), ("a", 3, 20.0, 4.0, 0.0, 7), ("b", 0, 1.0, 1.0, 1.0, 1)]
    out = {r.question: tuple(r)[1:] for r in bench.latency(spark.createDataFrame(runs, "question string, run long, total_ms double, ttft_ms double, generation_ms double, output_tokens long")).collect()}
    assert out == {"a": (3, 20.0, 30.0, 30.0, 2.0, 4.0, 200.0), "": (3, 20.0, 30.0, 30.0, 2.0, 4.0, 200.0)}


def test_parts_are_bounded_and_join_again(spark):
    r = random.Random(6)
    texts = ["", "short", "x" * 5000, "é🙂" * 900, "word " * 900, "One. Two! Three? " * 200, "\n\n".join("line of text\n" * r.randint(1, 40) for _ in range(30)), "a b\n\n" + "y" * 3000 + " tail " * 300]
    texts += ["".join(r.choice(["a", "é", " ", ". ", "\n", "\n\n", "🙂" * 9, "w" * 60]) for _ in range(r.randint(300, 900))) for _ in range(20)]
    for text in texts:
        for size, overlap in ((200, 0), (200, 60), (37, 12)):
            spans = list(vault.cut_parts(text, size, overlap))
            assert spans[0][0] == 0 and spans[-1][1] == len(text) and all(len(text[s:e].encode()) <= size for s, e in spans)
            assert all(a[0] < b[0] <= a[1] < b[1] and len(text[b[0] : a[1]].encode()) <= overlap for a, b in zip(spans, spans[1:]))
    rows = spark.createDataFrame([(i, t) for i, t in enumerate(texts)] + [(99, None)], "section_uid long, body string")
    parts = vault.subchunks(rows, 100, 50, 10)
    assert parts.filter("parent_uid IS NOT NULL AND octet_length(body) > 180").isEmpty()
    whole = vault.joined_parts(parts.withColumn("parent_uid", F.coalesce("parent_uid", "section_uid")), [])
    assert {int(x.parent_uid): x.body for x in whole.collect()} == {**dict(enumerate(texts)), 99: ""}
    some = vault.joined_parts(parts.filter("parent_uid IS NOT NULL AND chunk <> 1"), []).filter("first = 0")
    assert {x.n for x in some.collect()} == {1}
    with pytest.raises(ValueError):
        vault.subchunks(rows, 100, 50, 30)


def _vectors(spark, n, seed=1):
    """Clusters of near vectors, equal ones, a zero vector and a missing one."""
    g = np.random.default_rng(seed)
    centres = g.normal(size=(60, 16))
    rows = [(i, (centres[i % 60] + 0.35 * g.normal(size=16)).tolist()) for i in range(n)]
    rows += [(n + i, centres[3].tolist()) for i in range(200)] + [(n + 200, [0.0] * 16), (n + 201, None)]
    return spark.createDataFrame(rows, "vec_id long, embedding array<float>")


def test_cells_of_vectors(spark, monkeypatch):
    every = _vectors(spark, 6000)
    queries = every.filter("vec_id % 50 = 0")
    monkeypatch.setattr(cells, "PART", 100)
    built = cells.build(every)
    assert built.rows.count() == 6201 and built.rows.groupBy("cell", "salt").count().agg(F.max("count")).first()[0] < 200
    exact = {(r.qid, r.uid, r.position): r.score for r in vectors.top_k(queries, every.filter("embedding IS NOT NULL"), 10).collect()}
    got = {(r.qid, r.uid, r.position): r.score for r in cells.top_k(built, queries, 10, exact=True).collect()}
    assert got == exact
    near = {(r.qid, r.uid) for r in cells.top_k(built, queries, 10).collect()}
    recall = len(near & {(q, u) for q, u, _ in exact}) / len(exact)
    print(f"recall {recall:.3f}")
    assert recall >= 0.9
    few = cells.top_k(cells.build(every.limit(3), 7), queries.limit(2), 10, exact=True)
    assert few.count() == 6 and cells.top_k(cells.build(every.limit(0)), queries, 10).count() == 0


def test_trust_reorders_and_no_row_goes(spark):
    rows = spark.createDataFrame([(1, "a", 1, 1.0), (1, "b", 2, 0.9), (1, "c", 3, 0.9), (1, "d", 4, 0.1)], "qid long, uid string, rank int, score double")
    classes = spark.createDataFrame([("a", "imported"), ("b", "correction"), ("b", "old"), ("c", "note"), ("c", None), ("e", "note"), ("d", "unheard")], "uid string, trust string")
    out = {r.uid: (r.rank, round(r.score, 9)) for r in fuse.by_trust(rows, classes).collect()}
    assert out == {"c": (1, 0.9), "b": (2, 0.72), "a": (3, 0.7), "d": (4, 0.1)}


def test_recounted_packing(spark):
    rows = [(q, r, "x" * 30) for q, n in ((1, 3), (2, 1), (3, 2)) for r in range(1, n + 1)]
    rows = spark.createDataFrame(rows, "qid long, rank int, block string").withColumn("n_found", F.expr("element_at(array(9, 1, 2), int(qid))"))
    kept = lambda budget: sorted((r.qid, r["rank"]) for r in pack.recounted(rows, F.length("block"), budget, 3).collect())
    assert kept(90) == [(1, 1), (1, 2), (1, 3), (2, 1), (3, 1), (3, 2)]
    assert kept(70) == [(1, 1), (1, 2), (2, 1), (3, 1), (3, 2)]
    assert kept(10) == [(1, 1), (1, 2), (2, 1), (3, 1)]
    assert pack.budget(100, 90) == 0


def test_recent_openings_lift_and_no_row_goes(spark):
    at = lambda day, hour=0: dt.datetime(2024, 3, day, hour)
    rows = spark.createDataFrame([(1, u, k, s) for k, (u, s) in enumerate([("a", 1.0), ("b", 0.95), ("c", 0.94), ("d", 0.5), ("e", 0.4)], 1)], "qid long, uid string, rank int, score double")
    asked = spark.createDataFrame([(1, at(10, 12))], "qid long, ts timestamp")
    log = spark.createDataFrame([("a", at(10, 13)), ("a", at(7, 11)), ("b", at(10, 12)), ("b", at(1)), ("c", at(7, 12)), ("d", at(8, 23)), ("d", at(11)), ("zz", at(10))], "uid string, ts timestamp")
    out = fuse.boost_recent(rows, asked, log, 3).orderBy("rank").collect()
    assert [(r.uid, r.recent) for r in out] == [("b", True), ("c", True), ("a", False), ("d", True), ("e", False)]
    assert fuse.boost_recent(rows, asked, log, 0).filter("recent").collect()[0].uid == "b"
