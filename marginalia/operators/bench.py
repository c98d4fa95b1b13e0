"""Retrieval quality: ranks, recall, reciprocal rank, percentiles, comparisons and sweeps."""

from __future__ import annotations

from functools import reduce
from operator import and_

from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from marginalia.operators.numbering import numbered, running
from marginalia.sources.store import materialised

MISSING_RANK = 1000


def ranks(questions: DataFrame, results: DataFrame) -> DataFrame:
    """(qid, rank): the place of the first result (qid, uid, rank) that is expected (questions: qid, expected array), null if none is."""
    wanted = questions.select("qid", F.explode("expected").alias("uid"))
    hit = results.join(wanted, ["qid", "uid"]).groupBy("qid").agg(F.min("rank").alias("rank"))
    return questions.select("qid").join(hit, "qid", "left")


def report(outcomes: DataFrame, by: list[str] | None = None) -> DataFrame:
    """n, Recall@1/3/5 and MRR, zeros for no outcome; a miss counts as 0."""
    recall = [F.coalesce(F.avg(F.when(F.col("rank") <= k, 1.0).otherwise(0.0)), F.lit(0.0)).alias(f"recall_{k}") for k in (1, 3, 5)]
    mrr = F.coalesce(F.avg(F.coalesce(1.0 / F.col("rank"), F.lit(0.0))), F.lit(0.0)).alias("mrr")
    return outcomes.groupBy(*(by or [])).agg(F.count("*").alias("n"), *recall, mrr)


def percentiles(rows: DataFrame, value: str, quantiles: dict[str, float], by: list[str] | None = None) -> DataFrame:
    """Nearest-rank percentiles: the smallest value that so large a share of the rows doesn't pass. Null values don't count.

    Values are counted before they are ordered, and ordered in ranges, so no task holds all values of a group.
    """
    by = by or []
    counts = rows.filter(F.col(value).isNotNull()).groupBy(*by, value).agg(F.count("*").alias("__n"))
    every = running(counts, [*by, value], F.col("__n"), "__upto")
    total = every.groupBy(*by).agg(F.min(F.col("__upto") - F.col("__n")).alias("__start"), F.sum("__n").alias("__all"))
    if by:
        same = [F.col(f"e.{c}").eqNullSafe(F.col(f"t.{c}")) for c in by]
        every = every.alias("e").join(total.alias("t"), reduce(and_, same)).select("e.*", "__start", "__all")
    else:
        every = every.crossJoin(F.broadcast(total))
    share = (F.col("__upto") - F.col("__start")) / F.col("__all")
    return every.groupBy(*by).agg(*[F.min(F.when(share >= q, F.col(value))).alias(name) for name, q in quantiles.items()])


def latency(runs: DataFrame) -> DataFrame:
    """(question, n, p50, p99, max, ttft_p50, ttft_p99, tokens_per_second) of runs (question, run, total_ms, ttft_ms, generation_ms, output_tokens).

    The first run of each question is a warm-up and doesn't count. A question of "" stands for all together. Runs
    without a first token, or without generation or output, don't count for the columns of those; where
    none counts there are zeros.
    """
    order = F.row_number().over(W.partitionBy("question").orderBy("run"))
    warm = runs.withColumn("__nth", order).filter("__nth > 1").drop("__nth")
    every = materialised(warm.withColumn("question", F.explode(F.array("question", F.lit("")))), "runs")
    rate = F.when((F.col("generation_ms") > 0) & (F.col("output_tokens") > 0), F.col("output_tokens") / (F.col("generation_ms") / 1000))
    out = every.groupBy("question").agg(F.count("*").alias("n"), F.max("total_ms").alias("max"), F.coalesce(F.avg(rate), F.lit(0.0)).alias("tokens_per_second"))
    out = out.join(percentiles(every, "total_ms", {"p50": 0.5, "p99": 0.99}, ["question"]), "question")
    first = percentiles(every.filter("ttft_ms > 0"), "ttft_ms", {"ttft_p50": 0.5, "ttft_p99": 0.99}, ["question"])
    out = out.join(first, "question", "left")
    return out.select("question", "n", "p50", "p99", "max", *[F.coalesce(c, F.lit(0.0)).alias(c) for c in ("ttft_p50", "ttft_p99")], "tokens_per_second")


def moved(before: DataFrame, after: DataFrame) -> DataFrame:
    """(place, question, was, now, delta) of questions in both whose rank changed, the worst first; ties in reverse order of `after` (question, rank, pos)."""
    both = after.select("question", F.col("rank").alias("now"), "pos").join(before.select("question", F.col("rank").alias("was")), "question").filter(~F.col("now").eqNullSafe(F.col("was")))
    delta = F.coalesce("now", F.lit(MISSING_RANK)) - F.coalesce("was", F.lit(MISSING_RANK))
    out = numbered(both.withColumn("delta", delta), [F.desc("delta"), F.desc("pos")], "place")
    return out.select("place", "question", "was", "now", "delta")


def best_combination(reports: DataFrame) -> DataFrame:
    """The row with the highest MRR of reports (combo, mrr, ...); the first combination on ties."""
    return reports.orderBy(F.desc("mrr"), "combo").limit(1)


def check_floor(recall_3: float, floor: float) -> None:
    if recall_3 < floor:
        raise AssertionError(f"Recall@3 is {recall_3:.2f}, below the floor of {floor:.2f}")
