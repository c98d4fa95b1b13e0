"""Streams in event order against the batch operators and a fold over sorted events."""

import random

import pytest
from pyspark.sql import functions as F

from marginalia.streaming import events as st
from marginalia.streaming import stateful

SCHEMA = "conn string, event_id long, millis long, query_id string, text string, took long"
END = 10_000_000


def _events(seed, n=400):
    """Unordered by up to a second; the last two events close the watermark."""
    r = random.Random(seed)
    rows = []
    for i in range(n):
        at = r.randrange(0, 40_000) if i % 2 else r.randrange(0, 4_000) * 10
        rows.append((r.choice("abc"), i, at, r.choice(["q1", "q2"]) if r.random() < 0.3 else f"q{at // 9000}", None if r.random() < 0.1 else r.choice(["a", "bé", " token", "longer text"]), r.choice([None, 0, 40, 500, 9000])))
    rows.sort(key=lambda x: x[2] + r.randrange(0, 900))
    return rows, [("z", n, END, "q", "x", 0), ("z", n + 1, END + 1, "q", "x", 0)]


def _streamed(spark, tmp_path, parts, fold, columns):
    """What a stream over the parts, a micro-batch each, gives."""
    folder = str(tmp_path / "events")
    for k, part in enumerate(parts):
        spark.createDataFrame(part, SCHEMA).withColumn("part", F.lit(k)).coalesce(1).write.mode("append").parquet(folder)
    rows = spark.readStream.schema(SCHEMA + ", part int").option("maxFilesPerTrigger", 1).option("latestFirst", False).parquet(folder)
    rows = rows.withColumn("ts", F.timestamp_millis("millis")).withColumn("ended", (F.col("millis") + F.col("took")) * 1000)
    out = stateful.in_order(rows, fold, "conn", "ts", "event_id", columns, "1 second")
    name = f"t{random.randrange(10**9)}"
    query = out.writeStream.format("memory").queryName(name).option("checkpointLocation", str(tmp_path / "checkpoint")).trigger(availableNow=True).start()
    assert query.awaitTermination(240)
    return sorted(tuple(x) for x in spark.table(name).filter("conn <> 'z'").collect())


def _parts(seed):
    rows, end = _events(seed)
    return [rows[:150], rows[150:280], rows[280:], end[:1], end[1:]], rows


def _batch(spark, rows):
    return spark.createDataFrame(rows, SCHEMA).withColumn("ts", F.timestamp_millis("millis")).withColumn("ended", F.timestamp_millis(F.col("millis") + F.col("took")))


def test_token_batches(spark, tmp_path):
    parts, rows = _parts(1)
    fold = stateful.TokenBatches(900, 24)
    want = []
    for conn in "abc":
        mine = sorted((x[2] * 1000, x[1], {"query_id": x[3], "text": x[4]}) for x in rows if x[0] == conn)
        want += [(conn, *x) for x in stateful.advance(fold, {}, [(t, e) for t, _, e in mine], END * 1000)]
    assert sum(len(x[4].encode()) >= 24 for x in want) > 3 and len(want) > 100
    batch = st.token_batches(_batch(spark, rows), "conn", 900).withColumn("started", F.unix_micros("started")).select("conn", "query_id", "started", "n", "text")
    assert sorted(map(tuple, batch.collect())) == sorted(want)
    assert _streamed(spark, tmp_path, parts, fold, ["query_id", "text"]) == sorted(want)


def test_tokens_that_wait_are_dropped_by_another_query():
    fold = stateful.TokenBatches(33, 24)
    events = [(0, {"query_id": "a", "text": "one"}), (1, {"query_id": "b", "text": "two"}), (33_000, {"query_id": "b", "text": "x" * 30}), (33_001, {"query_id": "c", "text": "y"}), (33_002, {"query_id": "c", "text": None})]
    assert stateful.advance(fold, {}, events, 10**9) == [("b", 1, 1, "two"), ("b", 33_000, 1, "x" * 30), ("c", 33_001, 1, "y")]


def test_superseded(spark, tmp_path):
    parts, rows = _parts(2)
    queries = _batch(spark, rows).withColumn("query_id", F.col("event_id").cast("string"))
    order = sorted((x[2], x[1]) for x in rows)
    assert len(order) == len(rows)
    want = sorted((r.conn, r.query_id, r.cancelled) for r in st.superseded(queries.withColumn("query_id", F.col("event_id"))).select("conn", F.col("query_id").cast("string"), "cancelled").collect())
    assert 0 < sum(x[2] for x in want) < len(want)
    named = [[(*x[:3], str(x[1]), *x[4:]) for x in part] for part in parts]
    assert _streamed(spark, tmp_path, named, stateful.Superseded(), ["query_id", "ended"]) == want


def test_settled(spark, tmp_path):
    parts, rows = _parts(3)
    want = sorted((r.conn, r.event_id, r.text) for r in st.settled(_batch(spark, rows), ["conn"], "text", 0.2).collect())
    assert 5 < len(want) < len(rows)
    assert _streamed(spark, tmp_path, parts, stateful.Settled(0.2), ["event_id", "text"]) == want


def test_late_events_are_left_out(spark, tmp_path):
    """An event behind the watermark changes nothing; one that is merely out of order does."""
    base = [("a", 1, 10_000, "1", None, 5_000), ("a", 2, 20_000, "2", None, 100)]
    parts = [base, [("a", 3, 12_000, "3", None, 0), ("a", 4, 19_500, "4", None, 5_000)], [("z", 9, END, "9", None, 0)], [("z", 10, END + 1, "10", None, 0)]]
    got = _streamed(spark, tmp_path, parts, stateful.Superseded(), ["query_id", "ended"])
    assert got == [("a", "1", False), ("a", "2", False), ("a", "4", True)]
    with pytest.raises(AssertionError):
        assert ("a", "3", False) in got
