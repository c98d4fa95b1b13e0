"""What the desktop shows, as columns of a question: applications and projects that lift results."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from marginalia.config import Boosts
from marginalia.operators.fuse import ranked

SUPPRESSED = "\0none"
# Last parts of a window class that name no application.
PLAIN = ["agent", "app", "desktop", "bin", "gui"]


def informal_name(wm_class: Column) -> Column:
    """The last part of a dotted window class that says something, or the whole class if none does; null for an empty one."""
    parts = F.filter(F.split(F.lower(wm_class), r"\."), lambda p: (p != "") & ~p.isin(PLAIN))
    return F.coalesce(F.get(parts, F.size(parts) - 1), F.nullif(F.lower(wm_class), F.lit("")))


def alias_for(rows: DataFrame, aliases: dict[str, list[str]], column: str = "wm_class") -> DataFrame:
    """rows with `app`: the first alias name, in order and lower-cased, of which a variant is the class or begins it before a dot; else the informal name."""
    low, app = F.lower(F.col(column)), F.lit(None).cast("string")
    for name in sorted(aliases, reverse=True):
        hit = F.lit(False)
        for variant in aliases[name]:
            hit = hit | (low == variant.lower()) | low.startswith(variant.lower() + ".")
        app = F.when(hit, F.lit(name.lower())).otherwise(app)
    return rows.withColumn("app", F.when(low != "", F.coalesce(app, informal_name(F.col(column)))))


def app_named_in(question: Column, aliases: dict[str, list[str]]) -> Column:
    """The first alias name, lower-cased, that is a word of the question."""
    words, out = F.split(F.lower(question), r"[^\p{L}\p{N}]+"), F.lit(None).cast("string")
    for name in sorted(aliases, reverse=True):
        out = F.when(F.array_contains(words, name.lower()), F.lit(name.lower())).otherwise(out)
    return out


def effective(contexts: DataFrame, questions: DataFrame, aliases: dict[str, list[str]]) -> DataFrame:
    """(qid, app, cwd) of contexts (qid, wm_class, cwd): an application that the question names goes before the focused one."""
    focused = alias_for(contexts.select("qid", "wm_class", "cwd"), aliases).withColumnRenamed("app", "__focused")
    every = questions.select("qid", app_named_in(F.col("question"), aliases).alias("__named")).join(focused, "qid", "left")
    return every.select("qid", F.coalesce("__named", "__focused").alias("app"), "cwd")


def under(path: Column, cwd: Column) -> Column:
    """Whether a path is a folder or lies in it, by whole components; false without a folder."""
    folder = F.regexp_replace(cwd, "/+$", "")
    return F.coalesce((path == folder) | path.startswith(F.concat(folder, F.lit("/"))), F.lit(False))


def boosted(rows: DataFrame, contexts: DataFrame, config: Boosts = Boosts()) -> DataFrame:
    """Ranked rows (title, heading_path, body, path) lifted by the context (qid, app, cwd) of their question and ranked again; no row goes."""
    text = F.lower(F.concat_ws(" ", "title", "heading_path", "body"))
    out = rows.join(contexts.select("qid", "app", "cwd"), "qid", "left")
    app = F.coalesce((F.col("app") != "") & text.contains(F.lower("app")), F.lit(False))
    project = under(F.col("path"), F.col("cwd"))
    out = out.withColumn("active_app", app).withColumn("current_project", project)
    score = F.col("score") * F.when(project, config.project).otherwise(1.0) * F.when(app, config.app).otherwise(1.0)
    out = out.withColumn("score", score).withColumnRenamed("rank", "__before").drop("app", "cwd")
    return ranked(out, order=["__before"]).drop("__before")


def bucket(wm_class: Column, cwd: Column) -> Column:
    return F.concat_ws("|", F.coalesce(wm_class, F.lit("-")), F.coalesce(cwd, F.lit("-")))


def with_default(rows: DataFrame, by: list[str], order: list[str], context: str = "context") -> DataFrame:
    """rows with an empty context replaced by the last one before in time; a suppressed context stays empty."""
    window = W.partitionBy(*by).orderBy(*order).rowsBetween(W.unboundedPreceding, -1)
    given = F.when((F.col(context) != "") & (F.col(context) != SUPPRESSED), F.col(context))
    last = F.last(given, ignorenulls=True).over(window)
    return rows.withColumn("effective_context", F.when(F.col(context) == SUPPRESSED, None).otherwise(F.coalesce(given, last)))
