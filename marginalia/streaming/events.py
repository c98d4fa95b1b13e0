"""Event streams: which events count, bursts, superseded queries, histories. The functions take batches and streams alike unless they say otherwise."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from marginalia.functions import text as T

# Kinds of file events that don't change content, and folders that aren't watched.
QUIET_KINDS = ["access", "metadata"]
HIDDEN_FOLDERS = [".notes", ".git", "target", "node_modules"]


def content_changes(events: DataFrame, kind: str = "kind") -> DataFrame:
    return events.filter(~F.lower(F.col(kind)).isin(QUIET_KINDS))


def relevant_paths(events: DataFrame, root: str, path: str = "path") -> DataFrame:
    """Events below the root, not on it, and in no hidden folder."""
    root = root.rstrip("/")
    inside = F.substring(F.col(path), F.lit(len(root) + 2), F.length(path))
    return events.filter(F.col(path).startswith(root + "/") & (inside != "") & ~F.arrays_overlap(F.split(inside, "/"), F.array(*map(F.lit, HIDDEN_FOLDERS))))


def bursts(events: DataFrame, gap: str, by: list[str], ts: str = "ts") -> DataFrame:
    """(by, started, ended, n): events with less than `gap` between them are one burst. A stream needs a watermark on ts first."""
    out = events.groupBy(F.session_window(F.col(ts), gap).alias("w"), *by).agg(F.count("*").alias("n"))
    return out.select(*by, F.col("w.start").alias("started"), F.col("w.end").alias("ended"), "n")


def superseded(queries: DataFrame, conn: str = "conn", ts: str = "ts", ended: str = "ended") -> DataFrame:
    """Batch: queries with `cancelled`, true if the next query of the connection began before this one ended."""
    following = F.lead(ts).over(W.partitionBy(conn).orderBy(ts, "query_id"))
    return queries.withColumn("cancelled", F.coalesce(following < F.col(ended), F.lit(False)))


def current_events(events: DataFrame, queries: DataFrame) -> DataFrame:
    """Batch: events (conn, query_id, ts) whose query is the latest of its connection at their time."""
    nxt = F.lead("ts").over(W.partitionBy("conn").orderBy("ts", "query_id"))
    spans = queries.select("conn", "query_id", F.col("ts").alias("__from"), nxt.alias("__to"))
    return events.join(spans, ["conn", "query_id"]).filter((F.col("ts") >= F.col("__from")) & (F.col("__to").isNull() | (F.col("ts") < F.col("__to")))).drop("__from", "__to")


def settled(events: DataFrame, by: list[str], text: str, gap_seconds: float, ts: str = "ts", order: str = "event_id") -> DataFrame:
    """Batch: events after which nothing comes for the gap, without those whose text is that of the settled one before."""
    w = W.partitionBy(*by).orderBy(ts, order)
    quiet = events.withColumn("__next", F.lead(ts).over(w)).filter(F.col("__next").isNull() | ((F.unix_micros("__next") - F.unix_micros(ts)) > int(gap_seconds * 1_000_000)))
    return quiet.withColumn("__last", F.lag(text).over(w)).filter(F.col("__last").isNull() | (F.col("__last") != F.col(text))).drop("__next", "__last")


def history(rows: DataFrame, by: list[str], text: str, order: list[str], most: int = 100) -> DataFrame:
    """Batch: submitted texts, trimmed, without blanks and repeats in a row, the last `most` of each group; `age` counts from the newest."""
    w = W.partitionBy(*by).orderBy(*order)
    kept = rows.withColumn(text, T.trimmed(F.col(text))).filter(F.col(text) != "").withColumn("__last", F.lag(text).over(w)).filter(F.col("__last").isNull() | (F.col("__last") != F.col(text))).drop("__last")
    age = F.row_number().over(W.partitionBy(*by).orderBy(*[F.desc(c) for c in order]))
    return kept.withColumn("age", age).filter(F.col("age") <= most)


def status(events: DataFrame, by: list[str], value: str, ts: str = "ts", order: str = "event_id") -> DataFrame:
    """(by, n, last_ts, last_value): counters and the newest value."""
    return events.groupBy(*by).agg(F.count("*").alias("n"), F.max(ts).alias("last_ts"), F.max_by(value, F.struct(ts, order)).alias("last_value"))


def token_batches(events: DataFrame, by: str, tick_millis: int = 33, most: int = 24, ts: str = "ts", order: str = "event_id", query: str = "query_id", text: str = "text") -> DataFrame:
    """Batch: (by, query, started, n, text), the tokens as they are shown: once they have `most` bytes, at the next tick, or before another event.

    Rows without text are other events. The first token of another query drops what waits of the one before.
    Tokens of one query between two ticks or other events are gathered: a tick holds few.
    """
    w = W.partitionBy(by).orderBy(ts, order)
    tick = F.floor(F.unix_micros(F.col(ts)) / (tick_millis * 1000))
    rows = events.select(by, ts, order, F.col(query).alias("query"), F.col(text).alias("text"), tick.alias("tick"))
    other = lambda shift: ~(shift("query").over(w).eqNullSafe(F.col("query")))
    apart = F.lag("text").over(w).isNull() | (F.lag("tick").over(w) != F.col("tick")) | other(F.lag)
    dropped = F.lead("text").over(w).isNotNull() & (F.lead("tick").over(w) == F.col("tick")) & other(F.lead)
    runs = rows.withColumns({"apart": apart, "dropped": dropped}).filter("text IS NOT NULL").withColumn("run", F.count_if("apart").over(w))
    gathered = F.sort_array(F.collect_list(F.struct(F.col(ts).alias("ts"), F.col(order).alias("order"), "text")))
    lists = runs.groupBy(by, "run").agg(F.first("query").alias("query"), gathered.alias("x"), F.max_by("dropped", F.struct(ts, order)).alias("dropped"))
    none = F.array().cast("array<struct<started:timestamp,n:bigint,text:string>>")
    start = F.struct(none.alias("done"), F.lit(None).cast("timestamp").alias("started"), F.lit(0).cast("bigint").alias("n"), F.lit("").alias("text"))

    def take(acc, x):
        started, n, whole = F.when(acc["n"] == 0, x["ts"]).otherwise(acc["started"]), acc["n"] + 1, F.concat(acc["text"], x["text"])
        full = F.octet_length(whole) >= most
        done = F.when(full, F.concat(acc["done"], F.array(F.struct(started.alias("started"), n.alias("n"), whole.alias("text"))))).otherwise(acc["done"])
        return F.struct(done.alias("done"), started.alias("started"), F.when(full, F.lit(0).cast("bigint")).otherwise(n).alias("n"), F.when(full, "").otherwise(whole).alias("text"))

    end = lists.withColumn("acc", F.aggregate("x", start, take))
    rest = F.when((F.col("acc.n") > 0) & ~F.col("dropped"), F.array(F.struct("acc.started", "acc.n", "acc.text"))).otherwise(none)
    return end.select(by, "query", F.explode(F.concat("acc.done", rest)).alias("b")).select(by, F.col("query").alias(query), "b.started", "b.n", "b.text")


def generation_changes(polls: DataFrame, by: list[str], generation: str = "generation", ts: str = "ts", order: str = "event_id") -> DataFrame:
    """Batch: polls at which the generation differs from the poll before; the first counts."""
    w = W.partitionBy(*by).orderBy(ts, order)
    return polls.withColumn("__last", F.lag(generation).over(w)).filter(F.col("__last").isNull() | (F.col("__last") != F.col(generation))).drop("__last")


def reindex_stream(changes: DataFrame, rebuild: Callable[[DataFrame, int], None], checkpoint: str, paused: Callable[[], bool] = lambda: False):
    """Starts a stream that calls rebuild(changed paths, generation) for each micro-batch that has changes.

    Triggers that come during a rebuild meet in the next micro-batch. Generations are batch numbers, so a batch
    that is run again after a failure writes the same version. The paths of a batch are written beside the
    checkpoint first and deleted once a rebuild has taken them, so what changes while paused() holds, or before
    a rebuild that fails, comes with the next rebuild.
    """
    pending = f"{checkpoint}/pending"

    def each(batch: DataFrame, number: int) -> None:
        spark = batch.sparkSession
        batch.select("path").distinct().write.mode("overwrite").parquet(f"{pending}/batch={number}")
        if paused():
            return
        waiting = spark.read.schema("path string, batch long").parquet(pending)
        paths = waiting.select("path").distinct()
        if not paths.isEmpty():
            rebuild(paths, number + 1)
        folder = spark._jvm.org.apache.hadoop.fs.Path(pending)
        folder.getFileSystem(spark._jsc.hadoopConfiguration()).delete(folder, True)

    return changes.writeStream.foreachBatch(each).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
