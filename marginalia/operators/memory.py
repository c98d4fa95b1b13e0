"""What is remembered: answers, provenance with ratings, corrections."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from marginalia.functions import text as T
from marginalia.operators.numbering import numbered
from marginalia.sources.store import materialised

FUZZY_THRESHOLD, STALE_FACTOR = 0.5, 0.8


def cache_keys(sections: DataFrame, model: str | None, prompt_version: int, max_tokens: int, temperature: float, correction_version: int) -> DataFrame:
    """(qid, key) of packed sections (qid, rank, uid, body): a digest over uids and bodies in order and the settings; the question isn't in it."""
    parts = F.transform(F.sort_array(F.collect_list(F.struct("rank", "uid", "body"))), lambda x: F.concat(x["uid"].cast("string"), F.lit("\x01"), x["body"], F.lit("\x01")))
    tail = "\x01".join([model or "none", str(prompt_version), str(max_tokens), f"{temperature:.3f}", str(correction_version)])
    return sections.groupBy("qid").agg(F.sha2(F.concat(F.array_join(parts, ""), F.lit(tail)), 256).alias("key"))


def upserted(writes: DataFrame) -> DataFrame:
    """The answer cache after all writes (key, answer, model, created_at, seq): the last answer of a key with the model of its first."""
    last, first = F.max_by(F.struct("answer", "created_at"), "seq"), F.min_by("model", "seq")
    return writes.groupBy("key").agg(last.alias("x"), first.alias("model")).select("key", "x.answer", "model", "x.created_at")


def lookup(questions: DataFrame, cache: DataFrame) -> DataFrame:
    """questions with the cached answer of their key, null if there is none."""
    return questions.join(cache.select("key", "answer"), "key", "left")


def rate(provenance: DataFrame, ratings: DataFrame) -> DataFrame:
    """provenance (id, ..., rating) with the latest of ratings (id, rating, ts); ratings of unknown ids do nothing."""
    last = ratings.groupBy("id").agg(F.max_by("rating", "ts").alias("__new"))
    return provenance.join(last, "id", "left").withColumn("rating", F.coalesce("__new", "rating")).drop("__new")


def recorded(provenance: DataFrame, answers: DataFrame) -> DataFrame:
    """provenance with a row for each of answers (query, section_uids, model, seq), whose ids follow the greatest one in the order of seq; none is rated yet."""
    last = provenance.agg(F.coalesce(F.max("id"), F.lit(0)).alias("__last"))
    new = numbered(answers, ["seq"], "id").crossJoin(F.broadcast(last)).withColumn("id", F.col("id") + F.col("__last"))
    return provenance.unionByName(new.drop("__last", "seq"), allowMissingColumns=True)


def rated(provenance: DataFrame) -> DataFrame:
    return provenance.filter(F.col("rating").isNotNull())


def rating_counts(provenance: DataFrame) -> DataFrame:
    return provenance.agg(F.count("*").alias("total"), F.count_if(F.col("rating") > 0).alias("good"), F.count_if(F.col("rating") < 0).alias("bad"))


def recent(rows: DataFrame, by: list[str], order: str, most: int = 8) -> DataFrame:
    """The last `most` rows of each group, the newest first in `age` from 1."""
    age = F.row_number().over(W.partitionBy(*by).orderBy(F.desc(order)))
    return rows.withColumn("age", age).filter(F.col("age") <= most)


def exported(provenance: DataFrame, least: int = 20) -> DataFrame:
    """(question, expected) of well-rated rows with sections; an error if there are fewer than `least`."""
    out = provenance.filter((F.col("rating") > 0) & (F.size("section_uids") > 0)).select(F.col("query").alias("question"), F.col("section_uids").alias("expected"))
    n = out.count()
    if n < least:
        raise ValueError(f"{n} rated questions are too few for a benchmark; it takes {least}")
    return out


def corrections_log(log: DataFrame) -> DataFrame:
    """The log of corrections (seq, kind, question, answer, created_at, id) with its `normalized` form, `own` and `prior`.

    The log is only ever appended to. A save of a form that has no correction makes one, whose id is the save's seq (`own`);
    a save of a form that has one replaces it and keeps its id. A delete is a tombstone for an id, and hits if that
    correction is there. `prior` is what last happened to the form before, so a save is a first one unless that was a save.
    Deletes that miss are left out.
    """
    saves = log.filter("kind = 'save'").withColumn("normalized", T.normalized(F.col("question")))
    forms = saves.select(F.col("seq").alias("id"), "normalized")
    deletes = log.filter("kind = 'delete'").join(forms, "id").filter("seq > id")
    deletes = deletes.groupBy("id", "normalized").agg(F.min("seq").alias("seq"))  # only the first can hit
    order = W.partitionBy("normalized").orderBy("seq")
    while True:
        deletes = materialised(deletes, "deletes")
        every = saves.select("seq", "kind", "normalized", "question", "answer", "created_at", F.lit(None).cast("long").alias("id"))
        every = every.unionByName(deletes.select("seq", F.lit("delete").alias("kind"), "normalized", "id"), allowMissingColumns=True)
        every = every.withColumn("prior", F.lag("kind").over(order))
        # A delete of a save that was no first one names no correction; others may have been taken for first ones behind it.
        first = every.filter("kind = 'save' AND coalesce(prior, 'delete') = 'delete'").select(F.col("seq").alias("id"))
        named = materialised(deletes.join(first, "id", "left_semi"), "named")
        if named.count() == deletes.count():
            break
        deletes = named
    starts = F.last(F.when((F.col("kind") == "save") & (F.coalesce("prior", F.lit("delete")) == "delete"), F.col("seq")), ignorenulls=True)
    return every.withColumn("own", starts.over(order.rowsBetween(W.unboundedPreceding, W.currentRow)))


def standing(log: DataFrame) -> DataFrame:
    """(id, normalized, question, answer, created_at, writes, stale): the corrections after all of a corrections_log, fresh; writes counts the saves of each since it was made."""
    rows = log.groupBy("normalized", "own").agg(F.max_by(F.struct("kind", "seq"), "seq").alias("last"), F.max_by(F.struct("question", "answer", "created_at"), F.when(F.col("kind") == "save", F.col("seq"))).alias("x"), F.count_if(F.col("kind") == "save").alias("writes"))
    return rows.filter("last.kind = 'save'").select(F.col("own").alias("id"), "normalized", "x.question", "x.answer", "x.created_at", "writes", F.lit(False).alias("stale"))


def version(log: DataFrame) -> DataFrame:
    """(version): one for each save and each delete that hit, of a corrections_log; so it never falls, and no earlier state has the same."""
    return log.agg(F.count("*").alias("version"))


def saves(writes: DataFrame) -> DataFrame:
    """Writes (question, answer, created_at, seq) as rows of a log."""
    return writes.select("seq", F.lit("save").alias("kind"), "question", "answer", "created_at", F.lit(None).cast("long").alias("id"))


def deletes(ids: DataFrame) -> DataFrame:
    """Deletes (id, seq) as rows of a log."""
    nothing = F.lit(None).cast("string")
    return ids.select("seq", F.lit("delete").alias("kind"), nothing.alias("question"), nothing.alias("answer"), F.lit(None).cast("long").alias("created_at"), "id")


def saved_corrections(writes: DataFrame) -> DataFrame:
    """Corrections after writes (question, answer, created_at, seq) alone: the last of each normal form, fresh."""
    keyed = writes.withColumn("normalized", T.normalized(F.col("question")))
    last = F.max_by(F.struct("question", "answer", "created_at"), "seq")
    return keyed.groupBy("normalized").agg(last.alias("x"), F.count("*").alias("writes"), F.min("seq").alias("id")).select("id", "normalized", "x.question", "x.answer", "x.created_at", "writes", F.lit(False).alias("stale"))


def with_sources(corrections: DataFrame, sources: DataFrame) -> DataFrame:
    """corrections with their sources (correction_id, section_uid, content_hash) as a sorted array, empty if there are none."""
    lists = sources.groupBy(F.col("correction_id").alias("id")).agg(F.sort_array(F.collect_list(F.struct("section_uid", "content_hash"))).alias("sources"))
    return corrections.join(lists, "id", "left").withColumn("sources", F.coalesce("sources", F.array().cast("array<struct<section_uid:string,content_hash:string>>")))


def staleness(sources: DataFrame, current: DataFrame) -> DataFrame:
    """(correction_id, stale): stale if any of its (section_uid, content_hash) isn't current any more; corrections without sources have no row."""
    now = current.select("section_uid", "content_hash", F.lit(True).alias("__same")).distinct()
    checked = sources.join(now, ["section_uid", "content_hash"], "left")
    return checked.groupBy("correction_id").agg(F.bool_or(F.col("__same").isNull()).alias("stale"))


def refreshed(corrections: DataFrame, sources: DataFrame, current: DataFrame) -> DataFrame:
    """corrections with `stale` as of now and `changed`; those without sources stay as they are."""
    new = staleness(sources, current).select(F.col("correction_id").alias("id"), F.col("stale").alias("__stale"))
    out = corrections.join(new, "id", "left").withColumn("__stale", F.coalesce("__stale", "stale"))
    return out.withColumn("changed", F.col("__stale") != F.col("stale")).withColumn("stale", F.col("__stale")).drop("__stale")


def listed(corrections: DataFrame) -> DataFrame:
    """corrections with `place`, the newest first and equal ones by id, and `n_stale`, how many are stale in all."""
    stale = corrections.agg(F.count_if(F.col("stale")).alias("n_stale"))
    return numbered(corrections, [F.desc("created_at"), F.asc("id")], "place").crossJoin(F.broadcast(stale))


def stale_count(corrections: DataFrame) -> DataFrame:
    return corrections.agg(F.count_if(F.col("stale")).alias("n_stale"))


def jaccard(a: Column, b: Column) -> Column:
    """Of two arrays as sets; 0 if either is empty."""
    either = F.size(F.array_union(a, b))
    return F.when((F.size(a) == 0) | (F.size(b) == 0), F.lit(0.0)).otherwise(F.size(F.array_intersect(a, b)) / either)


def best_corrections(questions: DataFrame, corrections: DataFrame, threshold: float = FUZZY_THRESHOLD, fuzzy: bool = False) -> DataFrame:
    """(qid, id, exact, score): the correction of each question. An equal normal form wins; else, if `fuzzy`, the highest word similarity, less if stale, the last id on ties.

    The sets of a pair whose similarity reaches the threshold t share a word among the first n - ceil(t n) + 1 of
    each, if both are in one order. Words are ordered from the rarest among the corrections on, so candidates come
    from a join on rare words and sets of near sizes, and the similarity is counted on the whole sets.
    """
    words = F.array_distinct(F.filter(F.split("n", " "), lambda x: x != ""))
    q = questions.select("qid", T.normalized(F.col("question")).alias("n")).withColumn("w", words)
    c = corrections.select("id", F.col("normalized").alias("n"), "stale").withColumn("w", words)
    every = q.join(c.select("id", "n"), "n").select("qid", "id", F.lit(True).alias("exact"), F.lit(1.0).alias("score"))
    if fuzzy:
        if not 0 < threshold <= 1:
            raise ValueError("the threshold lies above 0 and is 1 at most")
        often = c.select(F.explode("w").alias("word")).groupBy("word").agg(F.count("*").alias("often"))

        def beginnings(rows: DataFrame, key: str) -> DataFrame:
            """(key, n, word): the rarest words of each set, enough to meet every similar set in one."""
            each = rows.select(key, F.size("w").alias("n"), F.explode("w").alias("word")).join(often, "word", "left")
            order = F.row_number().over(W.partitionBy(key).orderBy(F.coalesce("often", F.lit(0)), "word"))
            return each.withColumn("r", order).filter(F.col("r") <= F.col("n") - F.ceil(F.col("n") * (threshold - 1e-9)) + 1).select(F.col(key), F.col("n").alias(f"n_{key}"), "word")

        near = (F.col("n_id") >= F.col("n_qid") * (threshold - 1e-9)) & (F.col("n_qid") >= F.col("n_id") * (threshold - 1e-9))
        pairs = beginnings(q, "qid").join(beginnings(c, "id"), "word").filter(near).select("qid", "id").distinct()
        whole = pairs.join(q.select("qid", F.col("w").alias("a")), "qid").join(c.select("id", "stale", F.col("w").alias("b")), "id")
        score = F.round(jaccard(F.col("a"), F.col("b")) * F.when(F.col("stale"), STALE_FACTOR).otherwise(1.0), 9)
        every = every.union(whole.select("qid", "id", F.lit(False), score.alias("score")).filter(F.col("score") >= threshold))
    place = F.row_number().over(W.partitionBy("qid").orderBy(F.desc("exact"), F.desc("score"), F.desc("id")))
    return every.withColumn("r", place).filter("r = 1").drop("r")


def correction_block(answer: Column, stale: Column) -> Column:
    """What the prompt says of a correction."""
    return F.when(stale, F.concat(F.lit("An earlier answer, whose sources have changed since: "), answer, F.lit("\n\n"))).otherwise(F.concat(F.lit("A correct answer given before: "), answer, F.lit("\n\n")))
