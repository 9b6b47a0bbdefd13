"""Progress events: parsing, folding, exactly-once forwarding, rate limits, snapshots (IDs T01 - T13, X48, X56).

Batch twins are DataFrame aggregations; the streaming forms take a streaming DataFrame of the same columns.
The source has no late-data rule; here events may be LATE behind the newest one.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame, functions as F
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

EVENT = "job_id string, event string, status string, progress string, message string, timestamp timestamp, data string"
KINDS = ["status_change", "progress_update", "completed", "failed", "heartbeat"]
TERMINAL = ["COMPLETED", "FAILED"]
LATE = "10 minutes"


def parse_events(raw: DataFrame, column: str = "value") -> DataFrame:
    """JSON texts -> typed events; malformed ones go."""
    e = raw.select(F.from_json(column, EVENT).alias("e")).select("e.*").withColumn("progress", F.col("progress").try_cast("int"))
    return e.where(F.col("job_id").isNotNull() & F.col("event").isin(KINDS) & F.col("progress").between(0, 100) & F.col("timestamp").isNotNull())


def sse_line(event: Column, data: Column) -> Column:
    """X48"""
    return F.format_string("event: %s\ndata: %s\n\n", event, data)


def job_states(events: DataFrame, job: str = "job_id", when: str = "timestamp", tie: str = "event_id") -> DataFrame:
    """By job: latest status and progress, when work began, when it ended. One aggregation; also for streams in complete mode."""
    order = F.struct(when, tie)
    return events.groupBy(job).agg(
        F.max_by("status", order).alias("status"), F.max_by("progress", order).alias("progress"), F.min(F.when(F.col("status") == "CLONING", F.col(when))).alias("started_at"),
        F.min(F.when(F.col("status").isin(TERMINAL), F.col(when))).alias("ended_at"), F.count("*").alias("events"),
    )


def until_terminal(events: DataFrame, job: str = "job_id", when: str = "timestamp", tie: str = "event_id") -> DataFrame:
    """T03, T09, batch twin: each event once, none after the job's first terminal one."""
    ends = events.where(F.col("status").isin(TERMINAL)).groupBy(job).agg(F.min(F.struct(when, tie)).alias("_end"))
    once = events.dropDuplicates([job, tie]).join(ends, job, "left")
    return once.where(F.col("_end").isNull() | (F.struct(when, tie) <= F.col("_end"))).drop("_end")


FORWARDED = "job_id string, event_id long, status string, progress int, timestamp timestamp"


def forward_stream(events: DataFrame) -> DataFrame:
    """A stream of FORWARDED rows: duplicates within LATE go, and so does what follows a job's terminal event.

    State of a job: whether it has ended; it is dropped an hour after the watermark has passed its last event.
    """

    def step(key, batches: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        if state.hasTimedOut:
            state.remove()
            return
        ended = state.get[0] if state.exists else False
        rows = pd.concat(list(batches)).sort_values(["timestamp", "event_id"])
        out = []
        for r in rows.itertuples(index=False):
            if not ended:
                out.append(r)
                ended = r.status in TERMINAL
        state.update((ended,))
        last = int(rows["timestamp"].max().timestamp() * 1000)
        state.setTimeoutTimestamp(max(last, state.getCurrentWatermarkMs()) + 3_600_000)
        if out:
            yield pd.DataFrame(out, columns=rows.columns)

    clean = events.withWatermark("timestamp", LATE).dropDuplicatesWithinWatermark(["job_id", "event_id"]).select("job_id", "event_id", "status", "progress", "timestamp")
    return clean.groupBy("job_id").applyInPandasWithState(step, FORWARDED, "ended boolean", "append", GroupStateTimeout.EventTimeTimeout)


def rate_limited(requests: DataFrame, user: str = "user_id", when: str = "ts", tie: str = "event_id", limit: int = 10, seconds: int = 60) -> DataFrame:
    """Requests with allowed, retry_after. A user's window begins at the first request that no window holds, not at a full minute.

    Requests are read in order, user after user; a task holds one window's start and count.
    """
    columns = [user, tie, when]

    def fold(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        who, begin, n = None, None, 0
        for pdf in batches:
            ok, wait = [], []
            for u, t in zip(pdf[user], pdf[when], strict=True):
                if u != who or begin is None or (t - begin).total_seconds() >= seconds:
                    who, begin, n = u, t, 0
                n += 1
                ok.append(n <= limit)
                wait.append(0 if n <= limit else int(seconds - (t - begin).total_seconds()))
            yield pdf.assign(allowed=ok, retry_after=wait)

    schema = requests.select(*columns).withColumn("allowed", F.lit(True)).withColumn("retry_after", F.lit(0).cast("long")).schema
    return requests.select(*columns).repartition(user).sortWithinPartitions(user, when, tie).mapInPandas(fold, schema)


def publish(snapshot_path: str, log_path: str):
    """A foreachBatch function: first the snapshot (latest event of each job), then the log."""

    def write(batch: DataFrame, epoch: int) -> None:
        newest = batch.groupBy("job_id").agg(F.max(F.struct("timestamp", "status", "progress")).alias("s")).select("job_id", "s.*")
        newest.write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy("job_id").parquet(snapshot_path)
        batch.withColumn("epoch", F.lit(epoch)).write.mode("append").parquet(log_path)

    return write


def scheduled(stream: DataFrame, sweep: Callable[[DataFrame, int], None], checkpoint: str, every: str = "30 minutes"):
    """Runs sweep (as of expired sandboxes) over what has come, at fixed times; sweep must bear to be run again."""
    return stream.writeStream.trigger(processingTime=every).option("checkpointLocation", checkpoint).foreachBatch(sweep).start()


def idle_heartbeats(events: DataFrame, now: Column, idle: int = 15) -> DataFrame:
    """Jobs not ended that have been silent for `idle` seconds."""
    return job_states(events).join(events.groupBy("job_id").agg(F.max("timestamp").alias("last")), "job_id").where(~F.col("status").isin(TERMINAL) & (F.unix_timestamp(now) - F.unix_timestamp("last") >= idle)).select("job_id", "last")


def blacklisted(tokens: DataFrame, revoked: DataFrame, cutoffs: DataFrame, now: Column) -> DataFrame:
    """Tokens (token_id, user_id, issued_at) that are revoked and not expired yet, or issued at or before their user's cutoff."""
    r = revoked.where(F.col("expires_at") > now).select("token_id").distinct().withColumn("_r", F.lit(True))
    both = tokens.join(r, "token_id", "left").join(cutoffs, "user_id", "left")
    return both.withColumn("invalid", F.coalesce("_r", F.lit(False)) | F.coalesce(F.col("issued_at") <= F.col("cutoff"), F.lit(False))).select("token_id", "user_id", "invalid")


ORDER = ["PENDING", "CLONING", "ANALYZING_STRUCTURE", "GENERATING_SUMMARY", "RUNNING_STATIC_ANALYSIS", "CHUNKING_CODE", "AI_REVIEWING", "GENERATING_REPORT", "COMPLETED"]


def bad_transitions(history: DataFrame, job: str = "job_id", order: str = "sequence") -> DataFrame:
    """Steps backwards, or after the end."""
    from pyspark.sql import Window

    rank = F.create_map(*[F.lit(x) for i, s in enumerate(ORDER) for x in (s, i)])
    prev = F.lag("status").over(Window.partitionBy(job).orderBy(order))
    back = F.element_at(rank, F.col("status")) < F.element_at(rank, F.col("_prev"))
    return history.withColumn("_prev", prev).where(F.coalesce(back, F.lit(False)) | F.col("_prev").isin(TERMINAL)).drop("_prev")


def snapshot_message(message: Column, error: Column, status: Column) -> Column:
    """X56"""
    return F.coalesce(message, error, F.initcap(F.replace(F.lower(status), F.lit("_"), F.lit(" "))))
