"""Actions offered with the results: resolving, ordering, deduplicating, expanding."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from marginalia.functions import text as T

SLOTS = ["note", "code", "video", "app", "project", "url"]
KINDS = {"note": "note", "file": "code", "video": "video", "app": "app", "project": "project", "url": "url"}
#: What the actions of the slots do.
ACTIONS = ["open_file", "open_file", "open_video", "launch_desktop_app", "open_project", "open_url"]
#: Video players that are tried after the configured one.
PLAYERS = (["mpv", "--start={seconds}", "{url}"],)
MOST = 9


def slot(kind: Column) -> Column:
    """The place of a kind among the slots; null for an unknown kind."""
    out = F.lit(None).cast("int")
    for k, s in KINDS.items():
        out = F.when(kind == k, F.lit(SLOTS.index(s))).otherwise(out)
    return out


def time_label(seconds: Column) -> Column:
    """mm:ss, or h:mm:ss from an hour on; null stays null."""
    s = seconds.cast("long")
    h, m, r = F.floor(s / 3600), F.floor(s % 3600 / 60), s % 60
    return F.when(h > 0, F.format_string("%d:%02d:%02d", h, m, r)).when(s.isNotNull(), F.format_string("%02d:%02d", m, r))


def host(url: Column) -> Column:
    """What stands after the scheme, up to the first slash."""
    return F.regexp_extract(url, r"(?s)^(?:.*?://)?([^/]*)", 1)


def file_name(path: Column, instead: str) -> Column:
    """The last part of a path, or `instead` where it has none."""
    last = F.regexp_extract(path, r"([^/]+)/*$", 1)
    return F.when((last == "") | (last == ".."), F.lit(instead)).otherwise(last)


def resolved(declared: DataFrame, existing: DataFrame | None = None, apps: DataFrame | None = None) -> DataFrame:
    """Declared rows (section_uid, kind, target, line, seconds) with slot, label, enabled and a typed target `to`; unknown kinds go.

    Files and folders that aren't among `existing` (target), and applications that `apps` (app_id, app_name)
    doesn't resolve, are disabled. Without these tables everything is there.
    """
    out = declared.withColumn("slot", slot(F.col("kind"))).filter("slot IS NOT NULL").withColumn("line", F.greatest(F.coalesce("line", F.lit(1)), F.lit(1)))
    there, app_id, app_name = F.lit(True), F.col("target"), F.col("target")
    if existing is not None:
        out = out.join(existing.select("target", F.lit(True).alias("__there")).distinct(), "target", "left")
        there = F.col("__there").isNotNull() | ~F.col("kind").isin("file", "project")
    if apps is not None:
        names = out.filter("kind = 'app'").select(F.col("target").alias("name"))
        known = resolve_app(names, apps).join(apps, "app_id").select(F.col("name").alias("target"), F.lit("app").alias("kind"), F.col("app_id").alias("__id"), F.col("app_name").alias("__name"))
        out = out.join(known, ["target", "kind"], "left")
        there = there & (F.col("__id").isNotNull() | (F.col("kind") != "app"))
        app_id, app_name = F.coalesce("__id", "target"), F.coalesce("__name", "target")
    kind, target = F.col("kind"), F.col("target")
    label = F.when(kind == "file", file_name(target, "File")).when(kind == "project", file_name(target, "Project")).when(kind == "url", host(target)).when(kind == "app", app_name)
    label = label.otherwise(F.concat(F.lit("▶ "), F.coalesce(time_label(F.col("seconds")), F.lit("Video"))))
    to = typed(kind, F.when(kind == "app", app_id).otherwise(target), F.col("line"), F.col("seconds"))
    return out.withColumns({"label": label, "enabled": there, "to": to}).drop("__there", "__id", "__name")


def typed(kind: Column, value: Column, line: Column, seconds: Column) -> Column:
    """A target by which actions are told apart: files with their line, videos with their second."""
    return F.struct(F.when(kind == "note", "file").otherwise(kind).alias("type"), value.alias("value"), F.when(kind.isin("note", "file"), line.cast("long")).alias("line"), F.when(kind == "video", seconds.cast("long")).alias("seconds"))


def offered(results: DataFrame, declared: DataFrame, most: int = MOST) -> DataFrame:
    """(qid, id, kind, label, to, enabled, slot): a note action for each result (qid, uid, rank, path, heading, start_line, exists) and the declared ones.

    Declared rows are those of resolved() with `seq`, their order in the section; with a qid of their own they
    may belong to sections outside the results and come last in their slot. Actions are ordered by slot, rank
    and seq; each target is offered once, and at most nine are. The last four columns of results may be missing.
    """
    has = lambda c, other: F.col(c) if c in results.columns else F.lit(other)
    title = F.when(F.coalesce(has("heading", ""), F.lit("")) == "", has("note_title", "")).otherwise(has("heading", ""))
    line = F.greatest(F.coalesce(has("start_line", 1), F.lit(1)), F.lit(1))
    notes = results.select("qid", F.lit(0).alias("slot"), "rank", F.lit(0).cast("long").alias("seq"), title.alias("label"), typed(F.lit("note"), F.col("path"), line, F.lit(None)).alias("to"), has("exists", True).alias("enabled"))
    own = declared.withColumnRenamed("section_uid", "uid")
    ranks = results.select("qid", "uid", "rank")
    more = own.join(ranks, ["qid", "uid"], "left") if "qid" in declared.columns else own.join(ranks, "uid")
    more = more.select("qid", "slot", F.coalesce("rank", F.lit(2**31 - 1)).alias("rank"), F.col("seq").cast("long").alias("seq"), "label", "to", "enabled")
    order = ["slot", "rank", "seq", "label"]
    every = notes.union(more).withColumn("r", F.row_number().over(W.partitionBy("qid", "to").orderBy(*order))).filter("r = 1")
    numbered = every.withColumn("id", F.row_number().over(W.partitionBy("qid").orderBy(*order, "to"))).filter(F.col("id") <= most)
    kind = F.element_at(F.array(*map(F.lit, ACTIONS)), F.col("slot") + 1)
    return numbered.select("qid", "id", kind.alias("kind"), "label", "to", "enabled", "slot")


def with_time(url: Column, seconds: Column) -> Column:
    """The URL with its start time as a parameter."""
    return F.concat(url, F.when(F.contains(url, F.lit("?")), "&t=").otherwise("?t="), seconds.cast("long").cast("string"), F.lit("s"))


def expanded(argv: Column, to: Column) -> Column:
    """An argv array with the parts of a typed target filled in inside each element.

    {path} and {line} of a file, {path} of a project, {url}, {app}, {url} and {seconds} of a video. A video with
    a start time whose argv has no {seconds} gets the time back into its URL.
    """
    kind, value = to["type"], to["value"]
    rebuilt = F.when((kind == "video") & to["seconds"].isNotNull() & ~F.exists(argv, lambda a: F.contains(a, F.lit("{seconds}"))), with_time(value, to["seconds"])).otherwise(value)
    put = lambda arg, name, by: F.replace(arg, F.lit("{" + name + "}"), by.cast("string"))

    def fill(arg: Column) -> Column:
        video = put(put(arg, "url", rebuilt), "seconds", F.coalesce(to["seconds"], F.lit(0).cast("long")))
        out = F.when(kind == "file", put(put(arg, "path", value), "line", to["line"])).when(kind == "project", put(arg, "path", value))
        return out.when(kind == "url", put(arg, "url", value)).when(kind == "app", put(arg, "app", value)).otherwise(video)

    return F.transform(argv, fill)


def template(to: Column, openers: dict[str, list[str]], installed: set[str], players: Sequence[list[str]] = PLAYERS) -> Column:
    """The argv of a typed target: openers has markdown, text, project, url and video; of video players the first one installed is taken."""
    argv = lambda words: F.array(*map(F.lit, words))
    ending = F.lower(F.regexp_extract(to["value"], r"[^/]\.([^./]*)$", 1))
    video = next((p for p in [openers["video"], *players] if p and p[0] in installed), ["xdg-open", "{url}"])
    out = F.when((to["type"] == "file") & ending.isin("md", "markdown", "txt"), argv(openers["markdown"])).when(to["type"] == "file", argv(openers["text"]))
    return out.when(to["type"] == "project", argv(openers["project"])).when(to["type"] == "url", argv(openers["url"])).when(to["type"] == "app", argv(["gtk-launch", "{app}"])).otherwise(argv(video))


def resolve_app(wanted: DataFrame, apps: DataFrame) -> DataFrame:
    """(name, app_id): by exact id, then exact name, then by what one application alone has: the beginning of its id or name, or the last part of its id. A blank name has none."""
    a = apps.select("app_id", F.lower("app_id").alias("i"), F.lower("app_name").alias("n"), F.lower(F.element_at(F.split("app_id", r"\."), -1)).alias("l"))
    w = wanted.select("name", F.lower(T.trimmed(F.col("name"))).alias("w")).filter("w <> ''").distinct()
    # Both are small catalogues; the first letter of what a name can match makes the join an equality.
    keys = a.select("app_id", "i", "n", "l", F.explode(F.array_distinct(F.array(*(F.substring(c, 1, 1) for c in "inl")))).alias("k"))
    pairs = w.withColumn("k", F.substring("w", 1, 1)).join(keys, "k")
    level = F.when(F.col("w") == F.col("i"), 0).when(F.col("w") == F.col("n"), 1).when(F.col("i").startswith(F.col("w")) | (F.col("l") == F.col("w")) | F.col("n").startswith(F.col("w")), 2)
    best = pairs.withColumn("level", level).filter("level IS NOT NULL").groupBy("name", "level").agg(F.min("app_id").alias("app_id"), F.countDistinct("app_id").alias("n"))
    top = best.withColumn("r", F.row_number().over(W.partitionBy("name").orderBy("level"))).filter("r = 1")
    return top.filter("level < 2 OR n = 1").select("name", "app_id")


def looked_up(wanted: DataFrame, declared: DataFrame) -> DataFrame:
    """The declared actions of listed sections (qid, uids), once for each question and section; sections without any have no row."""
    uids = wanted.select("qid", F.explode(F.array_distinct("uids")).alias("section_uid"))
    return uids.join(declared, "section_uid")
