"""Stateful streams against their batch twins, with a restart from the checkpoint in between."""

import datetime as dt
import random

import pytest

from scryline.streaming import progress, stateful

BASE = dt.datetime(2024, 1, 1)


def at(seconds):
    return BASE + dt.timedelta(seconds=seconds)


@pytest.fixture
def streamed(spark, tmp_path):
    """Runs rows through an operator in files, half before and half after a restart; the last file moves the watermark past everything."""

    def run(rows, schema, op, files=4):
        spark.conf.set("spark.sql.session.timeZone", "UTC")
        stateful.state_store(spark)
        spark.conf.set("spark.sql.shuffle.partitions", "2")
        source, out = str(tmp_path / "in"), str(tmp_path / "out")
        cuts = [round(len(rows) * k / files) for k in range(files + 1)]
        for k in range(files):
            spark.createDataFrame(rows[cuts[k] : cuts[k + 1]], schema).coalesce(1).write.mode("append").parquet(source)
            if k in (files // 2 - 1, files - 1):
                stream = op(spark.readStream.schema(schema).option("maxFilesPerTrigger", 1).parquet(source))
                q = stream.writeStream.format("parquet").option("checkpointLocation", str(tmp_path / "checkpoint")).trigger(availableNow=True).start(out)
                q.awaitTermination(120)
        spark.conf.set("spark.sql.shuffle.partitions", "4")
        return sorted(map(tuple, spark.read.parquet(out).collect()))

    return run


def test_silences(spark, streamed):
    rng, rows, t = random.Random(1), [], 0
    for i in range(120):
        t += rng.choice([1, 2, 9, 30])
        rows.append((f"j{rng.randrange(4)}", i, "COMPLETED" if i in (60, 90) else "AI_REVIEWING", at(t)))
    schema = "job_id string, event_id long, status string, timestamp timestamp"
    end = [("end", 1000, "COMPLETED", at(t + 100_000))]
    got = streamed(rows + end, schema, lambda s: stateful.silences_stream(s, 15))
    assert got == sorted(map(tuple, stateful.silences(spark.createDataFrame(rows + end, schema), 15).collect())) and len(got) > 10


def test_rate_limit(spark, streamed):
    rng, rows, t = random.Random(2), [], 0
    for i in range(150):
        t += rng.choice([0, 1, 3, 20])
        rows.append((rng.randrange(3), i, at(t)))
    schema = "user_id long, event_id long, ts timestamp"
    got = streamed(rows, schema, lambda s: stateful.rate_limit_stream(s, 4, 30))
    want = progress.rate_limited(spark.createDataFrame(rows, schema), limit=4, seconds=30).collect()
    assert got == sorted((r.user_id, r.event_id, r.ts, r.allowed, r.retry_after) for r in want) and not all(r.allowed for r in want)


def test_transitions(spark, streamed):
    rng = random.Random(3)
    rows = [(f"j{rng.randrange(4)}", i, rng.choice([*progress.ORDER, "FAILED"]), at(i * 5)) for i in range(80)]
    schema = "job_id string, event_id long, status string, timestamp timestamp"
    got = streamed(rows, schema, stateful.bad_transitions_stream)
    want = progress.bad_transitions(spark.createDataFrame(rows, schema), order="event_id").collect()
    assert [(r[0], r[1], r[3]) for r in got] == sorted((r.job_id, r.event_id, r.status) for r in want) and got


def test_blacklist(spark, streamed):
    rng, rows, t = random.Random(4), [], 1000
    for i in range(150):
        t += rng.choice([1, 5, 40])
        kind = rng.choice(["revoke", "check", "check", "check", "cutoff" if i % 7 == 0 else "check"])
        rows.append((rng.randrange(3), i, at(t), kind, f"t{rng.randrange(5)}" if kind != "cutoff" else None, at(t - rng.randrange(400)), at(t + rng.randrange(200)) if kind == "revoke" else None))
    schema = "user_id long, event_id long, ts timestamp, kind string, token_id string, issued_at timestamp, expires_at timestamp"
    got = streamed(rows, schema, stateful.blacklist_stream)
    assert got == sorted(map(tuple, stateful.blacklist_checks(spark.createDataFrame(rows, schema)).collect())) and len({r[3] for r in got}) == 2
