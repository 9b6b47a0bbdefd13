"""File sources, analyzers, the table store, and a stream against its batch twin."""

import json

import pytest
from pyspark.sql import functions as F

from scryline.sources import files, store
from scryline.streaming import progress


def test_manifest(spark, tmp_path):
    (tmp_path / "src").mkdir()
    (tmp_path / "node_modules").mkdir()
    (tmp_path / "src" / "a.py").write_text("x = 1\n")
    (tmp_path / "src" / "b.bin").write_bytes(b"a\0b")
    (tmp_path / "src" / "c.png").write_text("p")
    (tmp_path / "node_modules" / "d.js").write_text("d")
    assert [r.path for r in files.file_manifest(spark, str(tmp_path)).select("path").collect()] == ["src/a.py"]


def test_analyzers(spark):
    ruff = json.dumps([{"code": "F401", "message": "unused", "filename": "/r/a.py", "location": {"row": 3}}])
    bandit = json.dumps({"results": [{"filename": "b.py", "line_number": 7, "issue_severity": "HIGH", "issue_confidence": "MEDIUM", "issue_text": "t", "test_id": "B301"}]})
    eslint = json.dumps([{"filePath": "/r/c.ts", "messages": [{"ruleId": None, "severity": 2, "message": "m", "line": 0}]}])
    run = lambda x: spark.createDataFrame([(x,)], "stdout string")
    r = files.ruff_issues(run(ruff), "/r").first()
    assert (r.file_path, r.line_start, r.line_end, r.title, r.confidence) == ("a.py", 3, 3, "Ruff F401: unused", 0.9)
    b = files.bandit_issues(run(bandit), "/r").first()
    assert (b.severity, b.confidence, b.title, b.line_end) == ("high", 0.75, "B301", 7)
    e = files.eslint_issues(run(eslint), "/r").first()
    assert (e.severity, e.line_start, e.title) == ("medium", None, "ESLint finding")
    assert files.ruff_issues(run("no json"), "/r").count() == 0


def test_store(spark, tmp_path):
    path = str(tmp_path / "t")
    df = spark.createDataFrame([(1, "a"), (1, "b"), (2, "c")], "job_id int, x string")
    assert store.replace_partition(df, path, "job_id", 2) == (3, 2)
    store.replace_partition(spark.createDataFrame([(1, "z")], "job_id int, x string"), path, "job_id")
    assert sorted((r.job_id, r.x) for r in spark.read.parquet(path).collect()) == [(1, "z"), (2, "c")]
    with pytest.raises(ValueError, match="batch"):
        store.replace_partition(df, path, "job_id", 0)
    old, new = spark.createDataFrame([("k", 1, "o")], "id string, at int, v string"), spark.createDataFrame([("k", 2, "n"), ("m", 1, "x")], "id string, at int, v string")
    assert sorted((r.id, r.v) for r in store.upsert(old, new, ["id"], "at").collect()) == [("k", "n"), ("m", "x")]
    with pytest.raises(ValueError, match="scope"):
        store.scope(None, None, "")


def test_roadmap_rules(spark, tmp_path):
    p = tmp_path / "rules.yaml"
    p.write_text("rules:\n- {rule_id: R1, week: 2, skill_group: s, requirement: r, priority: P0}\n")
    assert files.roadmap_rules(spark, str(p)).first().week == "2"
    p.write_text("rules:\n- {rule_id: R1, week: 2, skill_group: s, requirement: r}\n- {rule_id: R1, week: 3, skill_group: s, requirement: r}\n")
    with pytest.raises(ValueError, match="twice"):
        files.roadmap_rules(spark, str(p))


def test_stream_equals_batch_twin(spark, tmp_path):
    rows = [("j1", 1, "CLONING", 10, "2024-01-01 00:00:01"), ("j1", 2, "COMPLETED", 100, "2024-01-01 00:00:05"), ("j1", 2, "COMPLETED", 100, "2024-01-01 00:00:05"), ("j1", 3, "AI_REVIEWING", 60, "2024-01-01 00:00:09"), ("j2", 4, "CLONING", 5, "2024-01-01 00:00:02")]
    df = spark.createDataFrame(rows, "job_id string, event_id long, status string, progress int, timestamp string").withColumn("timestamp", F.to_timestamp("timestamp"))
    df.coalesce(1).write.parquet(str(tmp_path / "in"))
    stream = spark.readStream.schema(df.schema).parquet(str(tmp_path / "in"))
    q = progress.forward_stream(stream).writeStream.format("memory").queryName("forwarded").option("checkpointLocation", str(tmp_path / "cp")).trigger(availableNow=True).start()
    q.awaitTermination(120)
    got = sorted((r.job_id, r.event_id) for r in spark.sql("SELECT * FROM forwarded").collect())
    want = sorted((r.job_id, r.event_id) for r in progress.until_terminal(df).collect())
    assert got == want == [("j1", 1), ("j1", 2), ("j2", 4)]


def test_malformed_events_go(spark):
    good = json.dumps({"job_id": "j", "event": "progress_update", "status": "CLONING", "progress": "12", "timestamp": "2024-01-01T00:00:00"})
    bad = [json.dumps({"job_id": "j", "event": "other", "progress": 1}), "x", json.dumps({"job_id": "j", "event": "completed", "progress": 101, "timestamp": "2024-01-01T00:00:00"})]
    assert progress.parse_events(spark.createDataFrame([(x,) for x in [good, *bad]], "value string")).count() == 1


def test_rate_limit(spark):
    rows = [("u", i, f"2024-01-01 00:00:{i:02}") for i in range(12)] + [("u", 99, "2024-01-01 00:01:30")]
    df = spark.createDataFrame(rows, "user_id string, event_id int, ts string").withColumn("ts", F.to_timestamp("ts"))
    got = {r.event_id: (r.allowed, r.retry_after) for r in progress.rate_limited(df).collect()}
    assert got[9] == (True, 0) and got[10] == (False, 50) and got[99] == (True, 0)
