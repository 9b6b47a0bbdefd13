"""Operators from retrieval to persisted issues, where no SQL judges them: lineages, lanes, contracts that fail, tree probes."""

import random
import re
import time

import pytest
from pyspark.sql import functions as F

from scryline.functions import matchers
from scryline.operators import chunking, lanes, review_flow
from scryline.plans import search_queries
from scryline.plans.search_queries import SNIPPETS
from scryline.streaming import progress
from tests.conftest import SMALL


def test_ingested_is_one_lineage(spark):
    docs = spark.createDataFrame([(1, "a b a"), (2, ""), (3, " ".join(f"w{i}" for i in range(600)))], "id int, t string")
    vectors, posted = review_flow.ingested(docs, ["id"], "t", spark.createDataFrame([("1", [0.5])], "cache_id string, vector array<double>"), F.col("id").cast("string"))
    assert sorted((r.id, r.chunk_index, r.vector) for r in vectors.collect()) == [(1, 0, [0.5]), (3, 0, None), (3, 1, None)]
    got = {(r.doc, r.term): (r.dl, r.tf) for r in posted.collect()}
    assert got["1:0", "a"] == (3, 2) and got["3:1", "w599"] == (138, 1) and len(got) == 2 + 512 + 138


def test_lanes_equal_a_loop(spark):
    rng = random.Random(4)
    rows = list({(job, lane, ord_, f"f{rng.randrange(4)}", rng.randrange(5)): 0 for job in range(5) for lane, ord_ in (("defect", 0), ("coverage", 1), ("coverage", 2), ("coverage", 5), ("roadmap", 3)) for _ in range(12)})
    rows = [(*r, rng.random()) for r in rows]
    df = spark.createDataFrame(rows, "job int, lane string, probe_ord int, file_path string, chunk_index int, score double")
    for full in (False, True):
        want, used = set(), {}
        for lane in ("defect", "coverage", "roadmap"):
            for job in range(5):
                for ord_ in sorted({r[2] for r in rows if r[0] == job and r[1] == lane}):
                    own = [r for r in rows if r[:3] == (job, lane, ord_) and (lane != "coverage" or r[3:5] not in used.setdefault(job, set()))]
                    chosen = sorted(own, key=lambda r: (-r[5], r[3], r[4]))[:3]
                    want |= {r[:5] for r in chosen}
                    if lane == "coverage" or (lane == "defect" and not full):
                        used.setdefault(job, set()).update(r[3:5] for r in chosen)
        assert {tuple(r)[:5] for r in lanes.lane_selection(df, "job", 3, full).select("job", "lane", "probe_ord", "file_path", "chunk_index").collect()} == want


def test_uncovered_fixes_fail(spark):
    plans = spark.createDataFrame([(1, "planned", 0), (2, "rejected", 1)], "issue_id int, status string, ord int")
    ids, none = plans.select("issue_id"), spark.createDataFrame([], "issue_id int, verdict string")
    logic = spark.createDataFrame([(1, "fixed"), (1, "fixed")], "issue_id int, verdict string")
    mixed = logic.unionByName(spark.createDataFrame([(1, "unresolved"), (1, "uncertain")], "issue_id int, verdict string"))
    assert [r.verdict for r in review_flow.verified_fixes(plans.where("issue_id = 1"), ids, ids, mixed, none).collect()] == ["unresolved"]
    assert {r.issue_id: r.verdict for r in review_flow.verified_fixes(plans, ids, ids, logic, none).collect()} == {1: "fixed", 2: "uncertain"}
    with pytest.raises(Exception, match="not every selected issue"):
        review_flow.verified_fixes(plans, ids, ids, none, none).collect()


def test_expected_without_probe_fails(spark):
    items = spark.createDataFrame([(1, [], [], "x")], "id int, detectors array<string>, probes array<string>, claim_type string")
    with pytest.raises(Exception, match="no probe"):
        review_flow.benchmark_expected(items, spark.createDataFrame([], "claim_type string, probes array<string>")).collect()


def test_judge_matches(spark):
    kind = "probe_id string, issues array<struct<finding_id:string,file_path:string,line_start:int,line_end:int,claim_type:string,category:string,evidence:array<struct<file_path:string,line_start:int,line_end:int>>>>"
    results = spark.createDataFrame([("p", [("f1", "src/a.py", 3, 5, "ssrf", "security", []), ("f2", "other.py", 1, 1, "ssrf", "security", [("x/a.py", 4, 4)]), ("f3", "src/a.py", 9, 9, "ssrf", "security", [])]), ("q", [("f4", "src/a.py", 3, 5, "ssrf", "security", [])])], kind)
    expected = spark.createDataFrame([("e", ["p"], "a.py", 4, 6, "ssrf", "security")], "expected_id string, expected_probes array<string>, file_path string, line_start int, line_end int, claim_type string, category string")
    assert sorted(r.finding_id for r in review_flow.judge_matches(results, expected).collect()) == ["f1", "f2"]


@pytest.mark.parametrize("n", range(len(SNIPPETS)))
def test_tree_probes(n):
    text, want = SNIPPETS[n]
    tree = matchers.parsed(text.lower())
    assert [k for k, f in matchers.TREE_PROBES.items() if f(text.lower(), tree)] == want


def test_scheduled(spark, tmp_path):
    seen = []
    stream = spark.readStream.format("rate").load()
    query = progress.scheduled(stream, lambda batch, epoch: seen.append(epoch), str(tmp_path), "1 second")
    for _ in range(60):
        time.sleep(0.5)
        if seen:
            break
    query.stop()
    assert seen


def _loop(probes, candidates, budget):
    """Bundles of one job after another, in plain loops: probe -> chunks that it had and has."""
    had, left = {}, {}
    for job in sorted({p[0] for p in probes}):
        own = sorted((p for p in probes if p[0] == job), key=lambda p: (lanes.LANES.index(p[1]), p[2]))
        roadmap, taken, kept = any(p[1] == "roadmap" for p in own), set(), []
        for lane in lanes.LANES:
            bundles = []
            for p in [p for p in own if p[1] == lane]:
                rows = sorted((c for c in candidates if c[:3] == p[:3] and not (lane == "coverage" and c[3:5] in taken)), key=lambda c: (-c[5], c[3:5]))[: p[4]]
                had[p[:3]] = len(rows)
                bundles.append((p, rows))
                if lane == "coverage":
                    taken |= {c[3:5] for c in rows}
            cap = budget.of_probe(lane, roadmap) or 99
            bundles = _cut([(p, rows[:cap]) for p, rows in bundles], budget.of_lane(lane, roadmap))
            if lane == "defect" and not budget.full_audit:
                taken |= {c[3:5] for _, rows in bundles for c in rows}
            kept += bundles
        for p, rows in kept if budget.full_audit else _cut(kept, budget.job):
            left[p[:3]] = [c[3:5] for c in rows]
    return had, left


def _cut(bundles, most):
    most = max(most, sum(bool(rows) for _, rows in bundles))
    if sum(len(rows) for _, rows in bundles) <= most:
        return bundles
    seats = []
    for k, (_, rows) in enumerate(bundles):
        if not rows:
            break
        seats.append((k, rows[0]))
    seats = seats[:most]
    for k, (p, rows) in enumerate(bundles):
        want = p[4] if p[3] == lanes.WHOLE_STRUCTURAL else 2
        for c in [c for c in rows if c[6]]:
            if sum(c2[6] and (k, c2) in seats for c2 in rows) < want and (k, c) not in seats and len(seats) < most:
                seats.append((k, c))
    rest = sorted(((p[5], c[5], p[3], c[3], c[4], k, c) for k, (p, rows) in enumerate(bundles) for c in rows if (k, c) not in seats), reverse=True)
    seats += [(k, c) for *_, k, c in rest[: most - len(seats)]]
    return [(p, [c for c in rows if (k, c) in seats]) for k, (p, rows) in enumerate(bundles)]


@pytest.mark.parametrize("full", [False, True])
def test_lane_bundles_equal_a_loop(spark, full):
    """40 coverage probes and some of the other lanes; caps of every kind bite; a job without candidates, a probe without, candidates without a probe."""
    rng = random.Random(9)
    names = lambda lane, i: lanes.WHOLE_STRUCTURAL if (lane, i) == ("defect", 2) else f"{lane}.{i}"
    probes = [(job, lane, i, names(lane, i), rng.randint(1, 5), rng.randrange(3)) for job in range(4) for lane, n in (("defect", 6), ("coverage", 40), ("roadmap", 5 if job != 1 else 0)) for i in range(n)]
    keys = {(p[0], p[1], p[2], f"f{rng.randrange(12)}", rng.randrange(9)) for p in probes if p[0] < 3 and p[2] != 3 for _ in range(14)} | {(0, "defect", 77, "f1", 1), (2, "coverage", -1, "f1", 1)}
    candidates = [(*k, rng.randrange(8) / 8, rng.random() < 0.3) for k in sorted(keys)]
    budget = lanes.Budget(job=90, lanes={"defect": 14, "coverage": 70, "roadmap": 9}, chunks_per_batch=24, probes_per_batch=6, full_audit=full)
    p = spark.createDataFrame(probes, "job int, lane string, probe_ord int, probe_id string, top_k int, rank int")
    c = spark.createDataFrame(candidates, "job int, lane string, probe_ord int, file_path string, chunk_index int, score double, structural boolean").repartition(5)
    out = lanes.lane_bundles(p, c, "job", budget)
    had, left = _loop(probes, candidates, budget)
    got = {(r.job, r.lane, r.probe_ord): r for r in out.collect()}
    assert set(got) == {x[:3] for x in probes}
    for k, r in got.items():
        assert [(x.file_path, x.chunk_index) for x in r.chunks] == left[k] and r.selected == had[k] and r.trimmed_count == had[k] - len(left[k])
        assert r.status == ("no_candidate_evidence" if not had[k] else "ok" if left[k] else "trimmed_by_global_cap")
    assert out._jdf.queryExecution().analyzed().toString().count("Join") == 0  # the plan doesn't grow with the probes


def test_lane_bundles_of_a_hot_job(spark):
    """A probe of very many candidates: only those that can matter are sent to the fold."""
    c = spark.range(60_000).selectExpr("1 as job", "'coverage' as lane", "cast(id % 2 as int) as probe_ord", "concat('f', id % 300) as file_path", "cast(id / 300 as int) as chunk_index", "cast(id % 1000 as double) as score", "false as structural")
    p = spark.createDataFrame([(1, "coverage", i, f"c{i}", 5, 1) for i in range(2)], "job int, lane string, probe_ord int, probe_id string, top_k int, rank int")
    out = lanes.lane_bundles(p, c, "job")
    assert sorted(len(r.chunks) for r in out.collect()) == [5, 5]
    assert "WindowGroupLimit" in out._jdf.queryExecution().executedPlan().toString()


def test_select_candidates_query(spark):
    """W03, W04, W17 against a plain version: each language's candidates, chosen one after another."""
    nested = lambda a, b: a[1] == b[1] and ((a[3] <= b[3] and a[4] >= b[4]) or (b[3] <= a[3] and b[4] >= a[4]))
    lists = {}
    for r in spark.read.parquet(f"{SMALL}/documents.parquet").collect():
        kind = ("structural", "lexical", "semantic")[r.doc_id % 3]
        lists.setdefault(r.lang, {}).setdefault(kind, []).append((kind, f"m{r.doc_id % 40}", r.doc_id % 1000, r.doc_id % 50, r.doc_id % 50 + r.n_chars % 9, r.n_chars % 997 / 997.0))
    order = lambda c: (-c[5], c[1], c[2], c[0])

    def once(rows):
        """Falling scores; the narrower of nested chunks takes the wider one's place."""
        out = []
        for c in rows:
            at = next((i for i, k in enumerate(out) if k[1:3] == c[1:3]), None)
            if at is not None:
                out[at] = ("+".join(sorted({*out[at][0].split("+"), *c[0].split("+")})), *out[at][1:])
                continue
            at = next((i for i, k in enumerate(out) if nested(c, k)), None)
            if at is None:
                out.append(c)
            elif c[4] - c[3] < out[at][4] - out[at][3]:
                out[at] = c
        return sorted(out, key=lambda c: -c[5])

    want = {}
    for lang, by in lists.items():
        by = {k: sorted(sorted(v, key=lambda c: (-c[5], c[2]))[:50], key=order) for k, v in by.items()}
        fits = lambda chosen, c: all(c[1:3] != x[1:3] and not nested(c, x) for x in chosen)
        chosen = []
        for c in [*once(once(by.get("structural", []))[:2]), *once(by.get("lexical", [])[:2]), *once(by.get("semantic", [])[:2])]:
            if len(chosen) < 8 and fits(chosen, c):
                chosen.append(c)
        late = []
        for c in once(sorted([c for v in by.values() for c in v], key=order)):
            if len(chosen) == 8:
                break
            if fits(chosen, c):
                (late if sum(x[1] == c[1] for x in chosen) >= 4 else chosen).append(c)
        chosen += [c for c in late if c[1:3] not in [x[1:3] for x in chosen]][: 8 - len(chosen)]
        want[lang] = chosen
    got = {}
    for r in search_queries.select_candidates(spark, SMALL).orderBy("probe_id", "place").collect():
        got.setdefault(r.probe_id, []).append((r.strategy, r.file_path, r.chunk_index, r.line_start, r.line_end, r.score))
    assert got == want


def test_source_chunks_query(spark):
    """D07, W14, X33 against a plain version: windows of lines that grow while their tokens fit."""
    count = lambda line: len(re.findall(r"\w+|[^\w\s]", line))
    want = []
    for r in spark.read.parquet(f"{SMALL}/documents.parquet").collect():
        rows, begin, made = (r.text or "").splitlines(), 0, []
        while begin < len(rows):
            end = begin + 1
            while end < len(rows) and sum(map(count, rows[begin : end + 1])) <= chunking.MOST_TOKENS:
                end += 1
            if any(x.strip() for x in rows[begin:end]):
                made.append((begin + 1, end, sum(map(count, rows[begin:end]))))
            if end == len(rows):
                break
            begin = max(begin + 1, end - chunking.LINE_OVERLAP)
        want += [(f"{r.source}/{r.lang}/{r.doc_id}.txt", i, len(made), *m) for i, m in enumerate(made)]
    assert sorted(map(tuple, search_queries.source_chunks(spark, SMALL).collect())) == sorted(want)
