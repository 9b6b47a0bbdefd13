"""Progress, limits and revocations as stateful streams (IDs T04, T07, T08, T12); each has a batch twin that gives the same rows.

Every operator keeps a few values for a key and lets timers on event time drop them. A key's events are taken in the order (time, id) within a
micro-batch; between batches they must come in order, as the channels of the source give them: an event that is older than the newest
one of its key is read as if it had come now, and one older than the watermark (LATE behind the newest event) is dropped before.
Spark keeps this state in RocksDB only: see `state_store`.
"""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame, SparkSession, Window, functions as F
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle

from scryline.streaming.progress import LATE, ORDER, TERMINAL


def state_store(spark: SparkSession) -> None:
    """The state store that these operators need; before a query starts."""
    spark.conf.set("spark.sql.streaming.stateStore.providerClass", "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider")


def _ms(t: pd.Timestamp) -> int:
    return int(t.value // 1_000_000)


class _Ordered(StatefulProcessor):
    """Rows of a key in order, whatever batches they come in; `one` takes a row and gives rows, `state` is a tuple of VALUES or None."""

    VALUES, ORDER, OUT = "", ["timestamp", "event_id"], []

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.held = handle.getValueState("held", self.VALUES)

    def one(self, state: tuple | None, row) -> tuple[tuple | None, list[tuple], int | None]:
        """The state after a row, what it gives, and when (ms) the state may go."""
        raise NotImplementedError

    def over(self, key: tuple, state: tuple) -> list[tuple]:
        """What a state gives whose time has come."""
        return []

    def handleInputRows(self, key, rows, timerValues) -> Iterator[pd.DataFrame]:
        state = tuple(self.held.get()) if self.held.exists() else None
        out, until = [], None
        for r in pd.concat(list(rows)).sort_values(self.ORDER, kind="stable").itertuples(index=False):
            state, given, until = self.one(state, r)
            out += given
        for t in list(self.handle.listTimers()):
            self.handle.deleteTimer(t)
        if state is None:
            self.held.clear()
        else:
            self.held.update(state)
            if until is not None:
                self.handle.registerTimer(max(until, timerValues.getCurrentWatermarkInMs() + 1))
        yield pd.DataFrame(out, columns=self.OUT)

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[pd.DataFrame]:
        out = self.over(key, tuple(self.held.get())) if self.held.exists() else []
        self.held.clear()
        yield pd.DataFrame(out, columns=self.OUT)

    def close(self) -> None:
        pass


def _run(events: DataFrame, key: str, when: str, processor: StatefulProcessor, schema: str) -> DataFrame:
    return events.withWatermark(when, LATE).groupBy(key).transformWithStateInPandas(processor, schema, "Append", "EventTime")


# T04
class _Silences(_Ordered):
    VALUES, OUT = "last timestamp, ended boolean", ["job_id", "last"]

    def __init__(self, idle: int):
        self.idle = idle

    def one(self, state, row):
        given = [(row.job_id, state[0])] if state and not state[1] and (row.timestamp - state[0]).total_seconds() >= self.idle else []
        newest = row.timestamp if state is None else max(state[0], row.timestamp)
        ended = bool(state and state[1]) or row.status in TERMINAL
        return (newest.to_pydatetime(), ended), given, _ms(pd.Timestamp(newest)) + (self.idle * 1000 if not ended else 3_600_000)

    def over(self, key, state):
        return [] if state[1] else [(key[0], state[0])]


def silences_stream(events: DataFrame, idle: int = 15) -> DataFrame:
    """job_id, last: each time that a job which hasn't ended was silent for `idle` seconds after its event at `last`. events (job_id, event_id, status, timestamp)."""
    return _run(events.select("job_id", "event_id", "status", "timestamp"), "job_id", "timestamp", _Silences(idle), "job_id string, last timestamp")


def silences(events: DataFrame, idle: int = 15) -> DataFrame:
    """T04, batch twin; a silence counts at the end, too."""
    order = Window.partitionBy("job_id").orderBy("timestamp", "event_id")
    ended = F.max(F.col("status").isin(TERMINAL).cast("int")).over(order.rowsBetween(Window.unboundedPreceding, Window.currentRow))
    rows = events.withColumn("_next", F.lead("timestamp").over(order)).withColumn("_ended", ended)
    long = F.col("_next").isNull() | (F.col("_next").cast("double") - F.col("timestamp").cast("double") >= idle)
    return rows.where((F.col("_ended") == 0) & long).select("job_id", F.col("timestamp").alias("last"))


# T07
class _Limit(_Ordered):
    VALUES, ORDER, OUT = "begin timestamp, n int", ["ts", "event_id"], ["user_id", "event_id", "ts", "allowed", "retry_after"]

    def __init__(self, limit: int, seconds: int):
        self.limit, self.seconds = limit, seconds

    def one(self, state, row):
        if state is None or (row.ts - state[0]).total_seconds() >= self.seconds:
            state = (row.ts.to_pydatetime(), 0)
        begin, n = state[0], state[1] + 1
        ok = n <= self.limit
        wait = 0 if ok else int(self.seconds - (row.ts - begin).total_seconds())
        return (begin, n), [(row.user_id, row.event_id, row.ts, ok, wait)], _ms(pd.Timestamp(begin)) + self.seconds * 1000


def rate_limit_stream(requests: DataFrame, limit: int = 10, seconds: int = 60) -> DataFrame:
    """Requests (user_id, event_id, ts) with allowed, retry_after; a user's window begins at the first request that no window holds. Batch twin: progress.rate_limited."""
    return _run(requests.select("user_id", "event_id", "ts"), "user_id", "ts", _Limit(limit, seconds), "user_id long, event_id long, ts timestamp, allowed boolean, retry_after long")


# T12
class _Transitions(_Ordered):
    VALUES, OUT = "status string", ["job_id", "event_id", "before", "status"]

    def one(self, state, row):
        before = state[0] if state else None
        back = before in ORDER and row.status in ORDER and ORDER.index(row.status) < ORDER.index(before)
        given = [(row.job_id, row.event_id, before, row.status)] if back or before in TERMINAL else []
        return (row.status,), given, _ms(row.timestamp) + 86_400_000


def bad_transitions_stream(history: DataFrame) -> DataFrame:
    """job_id, event_id, before, status: steps backwards, or after the end. A job's state goes a day after its last event. Batch twin: progress.bad_transitions."""
    return _run(history.select("job_id", "event_id", "status", "timestamp"), "job_id", "timestamp", _Transitions(), "job_id string, event_id long, before string, status string")


# T08
class _Blacklist(StatefulProcessor):
    """A user's revoked tokens with their expiry, and the time up to which all of theirs are void."""

    OUT = ["user_id", "event_id", "token_id", "invalid"]

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.revoked = handle.getMapState("revoked", "token_id string", "expires_at timestamp")
        self.cutoff = handle.getValueState("cutoff", "at timestamp")

    def handleInputRows(self, key, rows, timerValues) -> Iterator[pd.DataFrame]:
        out, cutoff = [], self.cutoff.get()[0] if self.cutoff.exists() else None
        held = {k[0]: pd.Timestamp(v[0]) for k, v in self.revoked.iterator()}
        for r in pd.concat(list(rows)).sort_values(["ts", "event_id"], kind="stable").itertuples(index=False):
            if r.kind == "revoke":
                held[r.token_id] = max(r.expires_at, held.get(r.token_id, r.expires_at))
            elif r.kind == "cutoff":
                cutoff = r.ts.to_pydatetime() if cutoff is None else max(cutoff, r.ts.to_pydatetime())
            else:
                void = r.token_id in held and held[r.token_id] > r.ts
                out.append((r.user_id, r.event_id, r.token_id, bool(void or (cutoff is not None and r.issued_at <= pd.Timestamp(cutoff)))))
        self._keep(held, timerValues)
        if cutoff is not None:
            self.cutoff.update((cutoff,))
        yield pd.DataFrame(out, columns=self.OUT)

    def _keep(self, held: dict, timerValues) -> None:
        """Tokens that have expired go; the next timer is at the first expiry among the rest."""
        now = timerValues.getCurrentWatermarkInMs()
        self.revoked.clear()
        for t in list(self.handle.listTimers()):
            self.handle.deleteTimer(t)
        held = {k: v for k, v in held.items() if _ms(v) > now}
        for k, v in held.items():
            self.revoked.updateValue((k,), (v.to_pydatetime(),))
        if held:
            self.handle.registerTimer(max(now + 1, _ms(min(held.values()))))

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[pd.DataFrame]:
        self._keep({k[0]: pd.Timestamp(v[0]) for k, v in self.revoked.iterator()}, timerValues)
        yield pd.DataFrame([], columns=self.OUT)

    def close(self) -> None:
        pass


def blacklist_stream(events: DataFrame) -> DataFrame:
    """user_id, event_id, token_id, invalid of each check among events (user_id, event_id, ts, kind, token_id, issued_at, expires_at).

    kind: `revoke` voids a token until expires_at, `cutoff` all of the user's tokens issued up to ts, anything else checks a token. A token is
    invalid if it was revoked before and hasn't expired, or was issued at or before the cutoff. Batch twin: blacklist_checks.
    """
    rows = events.select("user_id", "event_id", "ts", "kind", "token_id", "issued_at", "expires_at")
    return _run(rows, "user_id", "ts", _Blacklist(), "user_id long, event_id long, token_id string, invalid boolean")


def blacklist_checks(events: DataFrame) -> DataFrame:
    """T08, batch twin: what was so at each check."""
    order = ["ts", "event_id"]
    token, user = (Window.partitionBy(*k).orderBy(*order).rowsBetween(Window.unboundedPreceding, -1) for k in (["user_id", "token_id"], ["user_id"]))
    until = F.max(F.when(F.col("kind") == "revoke", F.col("expires_at"))).over(token)
    cutoff = F.max(F.when(F.col("kind") == "cutoff", F.col("ts"))).over(user)
    rows = events.withColumn("_until", until).withColumn("_cutoff", cutoff).where(~F.col("kind").isin("revoke", "cutoff"))
    void = F.coalesce(F.col("_until") > F.col("ts"), F.lit(False)) | F.coalesce(F.col("issued_at") <= F.col("_cutoff"), F.lit(False))
    return rows.select("user_id", "event_id", "token_id", void.alias("invalid"))
