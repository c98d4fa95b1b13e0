"""Reciprocal-rank fusion, status weights, boosts and truncation of ranked lists."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from marginalia.config import TRUST, Boosts, Fusion, Status
from marginalia.functions import text as T


def rrf(position: Column, weight: float = 1.0, k: int = 60) -> Column:
    return F.lit(float(weight)) / (F.lit(k) + position + 1)


def rrf_union(lexical: DataFrame, graph: DataFrame, config: Fusion = Fusion()) -> DataFrame:
    """(qid, uid, list_no, position, score, hops, via, backwards) of two disjoint lists; each row has the score of its own list only."""
    a = lexical.select("qid", "uid", F.lit(0).alias("list_no"), "position", rrf(F.col("position"), config.lexical_weight, config.k).alias("score"), F.lit(0).alias("hops"), F.lit(None).cast("string").alias("via"), F.lit(False).alias("backwards"))
    b = graph.select("qid", F.col("node").alias("uid"), F.lit(1).alias("list_no"), "position", rrf(F.col("position"), config.graph_weight, config.k).alias("score"), "hops", "via", "backwards")
    return a.unionByName(b)


def rrf_sum(lists: list[DataFrame], weights: list[float] | None = None, k: int = 60) -> DataFrame:
    """(qid, uid, score) of lists (qid, uid, position) that may overlap: the sum over the lists."""
    weights = weights or [1.0] * len(lists)
    rows = None
    for one, weight in zip(lists, weights, strict=True):
        part = one.select("qid", "uid", rrf(F.col("position"), weight, k).alias("s"))
        rows = part if rows is None else rows.union(part)
    return rows.groupBy("qid", "uid").agg(F.round(F.sum("s"), 9).alias("score"))


def status_weight(status: Column, config: Status = Status()) -> Column:
    """1 for a missing or unknown status."""
    out = F.lit(config.current)
    for name in ("draft", "archived", "obsolete"):
        out = F.when(status == name, F.lit(getattr(config, name))).otherwise(out)
    return F.when(status.isNull(), F.lit(config.current)).otherwise(out)


def ranked(rows: DataFrame, limit: int | None = None, order: list[str] | None = None) -> DataFrame:
    """rows with `rank` from 1 by score, ties by the order given (list and position): a stable sort, cut after `limit`."""
    keys = [F.desc("score"), *(order or ["list_no", "position"])]
    out = rows.withColumn("rank", F.row_number().over(W.partitionBy("qid").orderBy(*keys)))
    return out.filter(F.col("rank") <= limit) if limit else out


def boost_heading(rows: DataFrame, questions: DataFrame, config: Boosts = Boosts(), heading: str = "heading") -> DataFrame:
    """Ranked rows whose heading contains a term of the question, times the boost, ranked again; no row goes."""
    terms = questions.select("qid", T.heading_terms(F.col("question")).alias("__terms"))
    low = F.lower(F.coalesce(F.col(heading), F.lit("")))
    out = rows.join(terms, "qid", "left").withColumn("heading_match", F.coalesce(F.exists("__terms", lambda t: low.contains(t)), F.lit(False)))
    out = out.withColumn("score", F.col("score") * F.when(F.col("heading_match"), config.heading).otherwise(1.0)).withColumnRenamed("rank", "__before")
    return ranked(out.drop("__terms"), order=["__before"]).drop("__before")


def explain(context: bool = False) -> Column:
    """Why a row is there, in words; `context` if the rows have active_app and current_project."""
    path = F.format_string("%d %s %s %s", F.col("hops"), F.when(F.col("hops") == 1, "hop").otherwise("hops"), F.when(F.col("backwards"), "back to").otherwise("to"), F.col("via"))
    found = F.when(F.col("heading_match"), "matched heading").when(F.col("list_no") == 0, "matched text")
    around = [F.when(F.col("current_project"), "in the current project"), F.when(F.col("active_app"), "matches the focused app")] if context else []
    parts = F.concat_ws(" · ", found, F.when(F.col("via").isNotNull(), path), *around, F.when(F.col("status_weight") < 1, "superseded"))
    return F.when(parts == "", "matched").otherwise(parts)


def source_refs(rows: DataFrame) -> DataFrame:
    """Ranked rows as sources of an answer: a place of one line, a snippet and the reason; the number is open, since uids name sections."""
    line = F.col("start_line")
    return rows.select("qid", "rank", F.lit(0).cast("long").alias("section_id"), F.col("uid").alias("section_uid"), "path", "heading_path", line.alias("start_line"), line.alias("end_line"), "score", T.snippet(F.col("body")).alias("snippet"), explain("active_app" in rows.columns).alias("explain"))


def boost_recent(rows: DataFrame, asked: DataFrame, opened: DataFrame, days: int = 7, boost: float = 1.10, order: list[str] | None = None) -> DataFrame:
    """Ranked rows (qid, uid, rank, score) with `recent`, and those recent lifted and ranked again; no row goes.

    A row is recent if its section was opened (uid, ts) within `days` days before its question was asked (qid, ts).
    What counts is the last opening before the question: of earlier days that is the last of the day, so only the
    day of the question is looked at in whole, and a section that is opened all the time meets one row for each day.
    """
    day = lambda c: F.unix_date(F.to_date(c))
    log = opened.select("uid", "ts", day(F.col("ts")).alias("day"))
    last = log.groupBy("uid", "day").agg(F.max("ts").alias("ts"))
    wanted = rows.select("qid", "uid").join(asked.select("qid", F.col("ts").alias("at")), "qid").distinct()
    today = wanted.withColumn("day", day(F.col("at")))
    span = F.expr(f"INTERVAL {int(days)} DAYS")
    near = (F.col("ts") <= F.col("at")) & (F.col("ts") >= F.col("at") - span)
    before = today.withColumn("day", F.explode(F.sequence(F.col("day") - days, F.col("day") - 1))) if days > 0 else today.filter("false")
    hits = before.join(last, ["uid", "day"]).filter(near).select("qid", "uid").union(today.join(log, ["uid", "day"]).filter(near).select("qid", "uid"))
    out = rows.join(hits.distinct().withColumn("recent", F.lit(True)), ["qid", "uid"], "left").withColumn("recent", F.coalesce("recent", F.lit(False)))
    out = out.withColumn("score", F.col("score") * F.when(F.col("recent"), boost).otherwise(1.0)).withColumnRenamed("rank", "__before")
    return ranked(out, order=order or ["__before"]).drop("__before")


def by_trust(rows: DataFrame, classes: DataFrame, weights: dict[str, float] = TRUST, order: list[str] | None = None) -> DataFrame:
    """Ranked rows (qid, uid, rank, score) with `trust`, weighted by the class of their source (uid, trust) and ranked again; no row goes.

    A section without a class, or of one without a weight, has weight 1. A section with several classes has the
    smallest weight. Classes are looked up for the rows that are ranked only.
    """
    table = F.create_map(*[F.lit(x) for pair in weights.items() for x in pair])
    known = classes.select("uid", "trust", F.coalesce(F.element_at(table, F.col("trust")), F.lit(1.0)).alias("__weight"))
    least = known.join(rows.select("uid").distinct(), "uid", "left_semi").groupBy("uid").agg(F.min(F.struct("__weight", "trust")).alias("__least"))
    out = rows.join(least, "uid", "left").withColumn("trust", F.col("__least.trust"))
    out = out.withColumn("score", F.col("score") * F.coalesce("__least.__weight", F.lit(1.0))).withColumnRenamed("rank", "__before").drop("__least")
    return ranked(out, order=order or ["__before"]).drop("__before")
