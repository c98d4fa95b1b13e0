"""Streams of which the events of a key are taken in their own order: keyed state with event-time timers.

Events wait in state until the watermark has passed them; then nothing earlier can come, and they are taken in
order of time. A fold says what an event does, and what happens if none comes until some time. What comes
behind the watermark is late and left out, as in other stateful operators. State is dropped from memory to RocksDB,
so it may outgrow an executor's memory.
"""

from __future__ import annotations

import json
from abc import ABC, abstractmethod
from collections.abc import Iterable, Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle

#: The state store that keyed state with timers needs; it is set for the session by `in_order`.
PROVIDER = ("spark.sql.streaming.stateStore.providerClass", "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider")


class Fold(ABC):
    """Takes the events of a key in order. The state is a dict that JSON can hold; times are microseconds."""

    #: What `in_order` returns beside the key.
    schema: str

    @abstractmethod
    def take(self, state: dict, ts: int, event: dict) -> list[tuple]:
        """Rows that an event gives."""

    @abstractmethod
    def wake(self, state: dict) -> int | None:
        """When `quiet` is due if no event comes before."""

    @abstractmethod
    def quiet(self, state: dict) -> list[tuple]:
        """Rows that the lack of events gives; wake() is later then, or None."""


def advance(fold: Fold, state: dict, events: Iterable[tuple[int, dict]], until: int) -> list[tuple]:
    """The rows of events in order, and of the time up to `until`."""
    out = []

    def idle(to: int) -> None:
        while (due := fold.wake(state)) is not None and due <= to:
            out.extend(fold.quiet(state))

    for ts, event in events:
        idle(ts)
        out += fold.take(state, ts, event)
    idle(until)
    return out


class Superseded(Fold):
    """(query_id, cancelled) of queries (query_id, ended micros): whether the next one of the key began before this one ended."""

    schema = "query_id string, cancelled boolean"

    def take(self, state, ts, event):
        held = state.get("id")
        state.update(id=event["query_id"], ended=ts if event["ended"] is None else event["ended"])
        return [] if held is None else [(held, True)]

    def wake(self, state):
        return None if state.get("id") is None else state["ended"]

    def quiet(self, state):
        return [(state.pop("id"), False)]


class Settled(Fold):
    """(event_id, text) of events after which nothing comes for the gap, without those whose text is that of the settled one before."""

    schema = "event_id long, text string"

    def __init__(self, gap_seconds: float):
        self.gap = int(gap_seconds * 1_000_000)

    def take(self, state, ts, event):
        state.update(id=event["event_id"], text=event["text"], ts=ts)
        return []

    def wake(self, state):
        return None if state.get("id") is None else state["ts"] + self.gap + 1

    def quiet(self, state):
        last, text, number = state.get("last"), state["text"], state.pop("id")
        state["last"] = text
        return [(number, text)] if last is None or text is not None and text != last else []


class TokenBatches(Fold):
    """(query_id, started, n, text) of tokens (query_id, text): shown when they have `most` bytes, at the next tick, or before any other event.

    The first token of another query drops what waits of the one before. An event without text is no token.
    """

    schema = "query_id string, started long, n long, text string"

    def __init__(self, tick_millis: int = 33, most: int = 24):
        self.tick, self.most = tick_millis * 1000, most

    def _shown(self, state):
        if not state.get("n"):
            return []
        n, state["n"] = state["n"], 0
        return [(state["query"], state["started"], n, state["text"])]

    def take(self, state, ts, event):
        if event["text"] is None:
            return self._shown(state)
        if state.get("query") != event["query_id"]:
            state.update(query=event["query_id"], n=0)
        if not state["n"]:
            state.update(started=ts, text="")
        state.update(n=state["n"] + 1, text=state["text"] + event["text"])
        return self._shown(state) if len(state["text"].encode()) >= self.most else []

    def wake(self, state):
        return (state["started"] // self.tick + 1) * self.tick if state.get("n") else None

    def quiet(self, state):
        return self._shown(state)


class _Ordered(StatefulProcessor):
    def __init__(self, fold: Fold, key: str, names: list[str]):
        self.fold, self.key, self.names = fold, key, names

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.waiting = handle.getListState("waiting", "ts long, place long, event string")
        self.state = handle.getValueState("state", "state string")

    def handleInputRows(self, key, rows, timerValues) -> Iterator[pd.DataFrame]:
        passed = max(timerValues.getCurrentWatermarkInMs(), 0) * 1000
        new = [(int(t), int(p), e) for batch in rows for t, p, e in zip(batch["at"], batch["place"], batch["event"]) if t > passed]
        if new:
            self.waiting.appendList(new)
            self._call(min(t for t, _, _ in new))
        return iter(())

    def _call(self, micros: int) -> None:
        """Asks for a timer at the first millisecond that isn't before, unless one is set that comes earlier."""
        at = -(-micros // 1000)
        timers = [t for part in self.handle.listTimers() for t in (part if isinstance(part, list) else [part])]
        if not any(int(t) <= at for t in timers):
            self.handle.registerTimer(at)

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[pd.DataFrame]:
        now = timerValues.getCurrentWatermarkInMs() * 1000
        waiting = sorted(tuple(r) for r in self.waiting.get()) if self.waiting.exists() else []
        ready = [(t, json.loads(e)) for t, _, e in waiting if t <= now]
        later = waiting[len(ready) :]
        state = json.loads(self.state.get()[0]) if self.state.exists() else {}
        out = advance(self.fold, state, ready, now)
        self.state.update((json.dumps(state),))
        if later:
            self.waiting.put(later)
        elif waiting:
            self.waiting.clear()
        due = [t for t in (self.fold.wake(state), later[0][0] if later else None) if t is not None]
        if due:
            self.handle.registerTimer(max(-(-min(due) // 1000), now // 1000 + 1))
        if out:
            yield pd.DataFrame([(*key, *row) for row in out], columns=[self.key, *self.names])


def in_order(events: DataFrame, fold: Fold, key: str, ts: str, place: str, columns: list[str], delay: str) -> DataFrame:
    """The rows of a fold over a stream: for each key, its events in order of ts and place, each with the columns named.

    The watermark follows the latest event by `delay`: an event that comes later than that is left out, and a row
    is given once the watermark has passed the time at which it is decided.
    """
    spark = events.sparkSession
    spark.conf.set(*PROVIDER)
    kind = dict(events.dtypes)[key]
    rows = events.withWatermark(ts, delay).select(F.col(key), ts, F.unix_micros(F.col(ts)).alias("at"), F.col(place).cast("long").alias("place"), F.to_json(F.struct(*columns), {"ignoreNullFields": "false"}).alias("event"))
    names = [part.split()[0] for part in fold.schema.split(", ")]
    return rows.groupBy(key).transformWithStateInPandas(_Ordered(fold, key, names), outputStructType=f"{key} {kind}, {fold.schema}", outputMode="append", timeMode="eventTime")
