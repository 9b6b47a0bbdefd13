"""Operators against plain models, on random and golden rows."""

import random

import pytest
from pyspark.sql import functions as F

from scryline.operators import chunking, findings, graph, greedy, ranges, retrieval, trace
from scryline.plans import review_queries


def test_occurrences_equal_first_fit(spark):
    rng, rows = random.Random(1), []
    for i in range(300):
        a = rng.randint(1, 60)
        rows.append((rng.randint(1, 3), f"k{rng.randint(0, 1)}", "f.py", f"i{i:03}", a, a + rng.randint(0, 6)))
    got = findings.merge_ranges(spark.createDataFrame(rows, "job_id int, finding_key string, path string, issue_id string, line_start int, line_end int"), ["job_id", "finding_key", "path"]).collect()
    groups: dict = {}
    for r in sorted(rows, key=lambda r: (r[4], r[5], r[3])):
        open_ = groups.setdefault(r[:3], [])
        fit = next((g for g in open_ if r[4] <= g["hi"] and g["lo"] <= r[5]), None)
        if fit is None:
            open_.append({"lo": r[4], "hi": r[5], "ids": {r[3]}})
        else:
            fit["hi"] = max(fit["hi"], r[5])
            fit["ids"].add(r[3])
    want = {frozenset(g["ids"]) for gs in groups.values() for g in gs}
    found: dict = {}
    for r in got:
        found.setdefault((r.job_id, r.finding_key, r.island), set()).add(r.issue_id)
    assert {frozenset(x) for x in found.values()} == want


def test_two_detectors_make_one_finding(spark):
    rows = [(1, "k", "app/services/importer.py", "a", 12, 16, "high", "security", "ai_review", 0.9), (1, "k", "app\\services\\importer.py", "b", 13, 16, "high", "security", "bandit", None)]
    df = spark.createDataFrame(rows, "job_id int, finding_key string, file_path string, issue_id string, line_start int, line_end int, severity string, category string, source string, confidence double")
    r = findings.finding_groups(df).first()
    assert (r.occurrence_count, r.raw_issue_count, r.issue_id) == (1, 2, "a")


def test_dedupe_equals_model(spark):
    rng, rows = random.Random(2), []
    for i in range(400):
        a = rng.randint(1, 80)
        rows.append((rng.randint(1, 4), f"i{i:03}", a, a + rng.randint(0, 9), rng.choice([None, 0.1, 0.5, 0.9])))
    df = spark.createDataFrame(rows, "job_id int, issue_id string, line_start int, line_end int, confidence double")
    got = sorted((r.job_id, r.issue_id) for r in findings.dedupe_overlaps(df, ["job_id"]).collect())
    want = []
    for job in range(1, 5):
        kept = []
        for r in sorted((r for r in rows if r[0] == job), key=lambda r: (r[2], -(-1.0 if r[4] is None else r[4]), r[1])):
            at = next((k for k, x in enumerate(kept) if r[2] <= x[3] and x[2] <= r[3]), None)
            if at is None:
                kept.append(r)
            elif (r[4] or -1) > (kept[at][4] or -1):
                kept[at] = r
        want += [(job, r[1]) for r in kept]
    assert got == sorted(want)


def test_windows_equal_loops(spark):
    for n in (0, 1, 50, 51, 511, 512, 513, 974, 975, 2000):
        words = [f"w{i}" for i in range(n)]
        want, start = [], 0
        while start < n:
            want.append(" ".join(words[start : start + 512]))
            if start + 512 >= n:
                break
            start += 462
        df = spark.createDataFrame([(1, "  ".join(words))], "id int, t string")
        assert [r.content for r in chunking.split_documents(df, ["id"], "t").orderBy("chunk_index").collect()] == want


def test_coverage_of_ranges(spark):
    pieces = spark.createDataFrame([("f", 23, 25), ("f", 26, 38), ("g", 1, 5), ("g", 7, 9)], "file_path string, line_start int, line_end int")
    targets = spark.createDataFrame([("f", "t1", 23, 38), ("g", "t2", 2, 8), ("h", "t3", 1, 1)], "file_path string, target string, a int, b int")
    assert dict(ranges.covered(targets, pieces, ["file_path"], "target").collect()) == {"t1": True, "t2": False, "t3": False}
    gap = ranges.gaps(pieces.withColumn("total", F.lit(40)), ["file_path"], "total").collect()
    assert sorted((r.file_path, r.gap_start, r.gap_end) for r in gap) == [("f", 1, 22), ("f", 39, 40), ("g", 6, 6), ("g", 10, 40)]


def test_diverse_top_k_backfills(spark):
    df = spark.createDataFrame([("q", f"f{i // 8}", i, float(100 - i)) for i in range(16)], "query string, file string, doc int, score double")
    got = [r.doc for r in retrieval.diverse(df, ["query"], "file", 6).orderBy("rank").collect()]
    assert got == [0, 1, 2, 8, 9, 10]
    only = [r.doc for r in retrieval.diverse(df.where("file = 'f0'"), ["query"], "file", 6).orderBy("rank").collect()]
    assert only == [0, 1, 2, 3, 4, 5]


def test_nested_candidates_keep_the_narrow_one():
    wide = {"strategy": "semantic", "file_path": "f", "chunk_index": 0, "line_start": 1, "line_end": 50, "score": 0.9}
    narrow = {**wide, "chunk_index": 1, "line_start": 10, "line_end": 20, "score": 0.5}
    assert [c["chunk_index"] for c in greedy.unique([wide, narrow])] == [1]
    assert greedy.unique([narrow, {**narrow, "strategy": "lexical", "score": 0.4}])[0]["strategy"] == "lexical+semantic"


def test_components(spark):
    df = spark.createDataFrame([(1, "a"), (2, "a"), (2, "b"), (3, "b"), (9, "z"), (8, "y"), (9, "y")], "id int, via string")
    assert dict(graph.shared_components(df, "id", "via").collect()) == {1: 1, 2: 1, 3: 1, 8: 8, 9: 8}


def test_contract_counts(spark):
    q = spark.createDataFrame([("b", "p1"), ("b", "p2"), ("b", "p3")], "batch string, probe string")
    r = spark.createDataFrame([("b", "p1"), ("b", "p1"), ("b", "p4")], "batch string, probe string")
    assert tuple(trace.contract(q, r, ["batch"], "probe").first()) == ("b", 2, 1, 1)


def test_source_chunks_of_python():
    text = "import os\n\nclass A:\n    def f(self):\n        return 1\n\ndef g():\n    return 2\n"
    got = [(c["chunk_type"], c["function_name"], c["class_name"], c["line_start"], c["line_end"]) for c in chunking.source_chunks("a.py", "python", text)]
    assert got == [("module", None, None, 1, 2), ("class", None, "A", 3, 5), ("function", "f", "A", 4, 5), ("function", "g", None, 7, 8)]


def test_token_batches(spark):
    df = spark.createDataFrame([("s", i, 40) for i in range(5)], "source string, doc int, tokens long")
    assert [r.batch for r in chunking.token_batches(df, "source", ["doc"], "tokens", 16, 100).orderBy("doc").collect()] == [0, 0, 1, 1, 2]


def test_bm25_golden(spark):
    docs = spark.createDataFrame([("owasp", "SQL injection prevention in Python uses parameters"), ("style", "Use four spaces")], "doc string, text string")
    q = spark.createDataFrame([(0, "SQL injection prevention Python")], "query int, text string")
    r = retrieval.top_k(retrieval.bm25(docs, q, "doc", "text"), ["query"], 1).first()
    assert r.doc == "owasp" and r.score > 0


def test_review_plan(spark):
    from scryline.operators import review_plan

    rules = spark.createDataFrame([("roadmap_rule", "p", "R2", "2", "P1"), ("roadmap_rule", "p", "R9", "GEN", "P0"), ("roadmap_rule", "p", "R1", "2", "P2"), ("other", "p", "R3", "2", "P0"), ("roadmap_rule", "p", "R4", "3", "P0")], "doc_type string, profile_id string, rule_id string, week string, priority string")
    assert [r.rule_id for r in review_plan.applicable_rules(rules, "p", ["2"]).collect()] == ["R1", "R2", "R9"]
    assert (review_plan.smart_budget(None), review_plan.smart_budget(7), review_plan.smart_budget(999)) == (160, 120, 240)
    checks = spark.createDataFrame([("a", "x", True), ("a", "y", False), ("b", "x", True)], "probe string, name string, passed boolean")
    assert {r.probe: (r.passed, r.failed) for r in review_plan.all_checks(checks, "probe").collect()} == {"a": (False, ["y"]), "b": (True, [])}


@pytest.mark.parametrize("counts, score, status", [
    ([(1, 0, 0, 0), (0, 1, 0, 0)], 72, "critical"), ([(0, 8, 0, 0)], 31, "critical"), ([(0, 1, 1, 1)], 83, "warning"),
    ([(0, 0, 9, 0)], 68, "warning"), ([(0, 0, 1, 2), (0, 0, 0, 1)], 89, "healthy"), ([], 95, "unknown"), ([(9, 9, 9, 9)], 0, "critical"),
])
def test_codebase_health(spark, monkeypatch, counts, score, status):
    names = [f"{s}_count" for s in ("critical", "high", "medium", "low")]
    rows = spark.createDataFrame([(k, sum(c), 0, *c) for k, c in enumerate(counts)], f"job_id long, total_findings long, info_count long, {', '.join(f'{n} long' for n in names)}")
    repos = spark.createDataFrame([(k, "r", None if k == 0 else 1.0) for k in range(4)], "id long, name string, last_reviewed double")
    monkeypatch.setattr(review_queries, "_reports", lambda *_: rows)
    monkeypatch.setattr(review_queries, "view", lambda *_: repos)
    got = review_queries.codebase_health(spark, "").first()
    assert (got.score, got.status, got.repos_reviewed, got.repositories) == (score, status, 3, 4)
