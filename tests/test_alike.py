"""Work that many rows share is done once: no shuffles, pairs or rows beyond what the results need."""

import random

import pytest
from pyspark.sql import functions as F

from scryline import registry
from scryline.operators import findings, ranges, review_flow, trace
from tests.conftest import SMALL


@pytest.fixture
def big(spark):
    """A session that takes no table for small."""
    before = spark.conf.get("spark.sql.autoBroadcastJoinThreshold")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    yield spark
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", before)


def shuffles(df) -> int:
    return df._jdf.queryExecution().executedPlan().toString().count("Exchange hashpartitioning")


def rows_of(df, *columns):
    return sorted(tuple(r) for r in df.select(*columns).collect())


def test_occurrences_are_shuffled_twice(big):
    """once by the start of a range, once to merge; before, four times, and once more for their keys."""
    assert shuffles(registry.QUERIES["occurrence_merge"](big, SMALL)) == 2


def test_finding_groups_are_shuffled_three_times(big):
    """F19"""
    assert shuffles(registry.QUERIES["finding_groups"](big, SMALL)) == 3


@pytest.mark.parametrize("last", [300, 20_000])
def test_occurrences_within_and_over_cells(spark, last):
    rng = random.Random(last)
    lines = [(a := rng.randrange(1, last), a + rng.randrange(0, last // 20)) for _ in range(120)]
    rows = [(1, "k", "a.py", a, b, f"i{n:03d}", "high", "bug", "ruff", None) for n, (a, b) in enumerate(lines)]
    df = spark.createDataFrame(rows, "job_id int, finding_key string, file_path string, line_start int, line_end int, issue_id string, severity string, category string, source string, confidence double")
    want = []
    for n, (a, b) in sorted(enumerate(lines), key=lambda x: (x[1][0], x[1][1])):
        if want and a <= want[-1][1]:
            want[-1] = (want[-1][0], max(b, want[-1][1]), want[-1][2] + 1, min(want[-1][3], f"i{n:03d}"))
        else:
            want.append((a, b, 1, f"i{n:03d}"))
    assert rows_of(findings.occurrences(df), "line_start", "line_end", "raw", "issue_id") == want


@pytest.mark.parametrize("most", [5_000, 0])
def test_finding_keys_of_few_and_of_many_inputs(spark, monkeypatch, most):
    monkeypatch.setattr(findings, "KEY_INPUTS", most)
    df = spark.createDataFrame([("bug", "bare_except", 1), (None, "bare_except", 2), ("bug", None, 3), ("bug", "bare_except", 4)], "category string, claim string, n int")
    got = findings.with_finding_key(df, "category", "claim", "claim")
    assert got.columns == ["category", "claim", "n", "finding_key"] and got.count() == 4
    want = df.withColumn("finding_key", findings.finding_key(F.col("category"), F.col("claim"), F.col("claim"), None))
    assert sorted(map(str, got.collect())) == sorted(map(str, want.collect()))


def hot(n: int):
    """n issues of two files, with few different ranges; ids repeat now and then."""
    rng = random.Random(n)
    return [(f"i{rng.randrange(n)}", f"f{rng.randrange(2)}", a := rng.randrange(1, 40), a + rng.randrange(-2, 8)) for _ in range(n)]


def joins(df) -> list[str]:
    return [line for line in df._jdf.queryExecution().executedPlan().toString().splitlines() if "Join" in line]


def test_overlaps_of_equal_ranges_are_counted_once(spark):
    """before, 9 million pairs of 3,000 rows; the join that is left is with a row for each different range."""
    rows = hot(3000)
    df = spark.createDataFrame(rows, "id string, file string, line_start int, line_end int")
    q = df.where("id < 'i2'").select(F.col("id").alias("query_id"), "file", F.col("line_start").alias("q_start"), F.col("line_end").alias("q_end"))
    got = ranges.overlap_counts(q, df, ["file"], 16)
    assert all("Broadcast" in x for x in joins(got))
    want = [(i, a, b, sum(g == f and c <= b and d >= a for _, g, c, d in rows)) for i, f, a, b in rows if i < "i2"]
    assert rows_of(got, "query_id", "q_start", "q_end", "n") == sorted(x for x in want if x[-1])


def chunked(spark):
    """Chunks of 10 lines that overlap by 3, of several versions of two files, and one of a later file with fewer lines than it says."""
    rows = [(f"f{f}", 1000 * v + k, s, s + 9, "\n".join(f"f{f}v{v}l{n}" for n in range(s, s + 10))) for f in (0, 1) for v in range(20) for k, s in enumerate(range(1 + v % 3, 30 + v, 7))]
    return [*rows, ("f0", 9_000_000, 90, 95, "a\nb")], "file string, chunk_index long, line_start int, line_end int, content string"


def test_first_chunk_of_many_lines(spark):
    """F2"""
    rows, schema = chunked(spark)
    issues = hot(2000)
    q = spark.createDataFrame(issues, "id string, file string, line int, other int")
    got = ranges.first_containing(q, spark.createDataFrame(rows, schema), ["file"], "id", "line", ["line_start", "line_end"])
    assert all("Broadcast" in x for x in joins(got))
    want = {}
    for i, f, line, _ in issues:
        for g, k, s, e, _ in rows:
            if f == g and s <= line <= e:
                want[i] = min(want.get(i, (k, s, e)), (k, s, e))
    assert rows_of(got, "id", "chunk_index", "line_start", "line_end") == sorted((i, *x) for i, x in want.items())


def test_snippets_of_many_issues(spark):
    """F8: issues of one range share its snippet; an id of several ranges has the lines of all."""
    rows, schema = chunked(spark)
    issues = [*hot(2000), ("far", "f0", 88, 97)]
    q = spark.createDataFrame(issues, "id string, file string, q_start int, q_end int")
    got = ranges.snippet(spark.createDataFrame(rows, schema), q, ["file"], "id")
    texts = {}
    for f, k, s, e, content in rows:
        for n, t in enumerate(content.split("\n"), s):
            if n <= e and texts.get((f, n), (-1,))[0] < k:
                texts[f, n] = (k, t)
    lines: dict = {}
    for i, f, a, b in issues:
        for n in range(max(1, a - 3), b + 4):
            if (f, n) in texts:
                lines.setdefault(i, {}).setdefault(n, set()).add(texts[f, n][1])
    alone = {i: x for i, x in lines.items() if all(len(t) == 1 for t in x.values())}  # of an id with two files, either text of a line is due
    want = sorted((i, min(x), "\n".join(next(iter(x[n])) if n in x else "" for n in range(min(x), max(x) + 1))) for i, x in alone.items())
    found = rows_of(got, "id", "first_line", "snippet")
    assert [r for r in found if r[0] in alone] == want and {r[0] for r in found} == set(lines)


@pytest.fixture(scope="module")
def matched(spark):
    """Findings and expected ones of few places, some ids of several places or probes, and the pairs that are due."""
    rng = random.Random(5)
    place = lambda: (rng.choice(["src/a.py", "b.py", "x/src/a.py"]), a := rng.randrange(1, 60), a + rng.randrange(0, 6))
    f = [(f"f{rng.randrange(900) if n % 9 == 0 else n}", rng.choice("pq"), rng.choice(["c", "d", None]), "bug", *place(), [place() for _ in range(rng.choice([0, 0, 0, 2]))]) for n in range(900)]
    e = [(f"e{rng.randrange(90) if n % 9 == 0 else n}", rng.choice([["p"], ["p", "q"], ["z", "q"]]), *place(), rng.choice(["c", None]), "bug") for n in range(90)]
    kind = "array<struct<file_path:string,line_start:int,line_end:int>>"
    findings_ = spark.createDataFrame(f, f"finding_id string, probe_id string, claim_type string, category string, file_path string, line_start int, line_end int, evidence {kind}")
    expected = spark.createDataFrame(e, "expected_id string, expected_probes array<string>, file_path string, line_start int, line_end int, claim_type string, category string")
    due = {(x[0], y[0]) for x in f for y in e if x[1] in y[1] and (y[5] is None or x[2] == y[5]) for p, a, b in [x[4:7], *x[7]] if (p == y[2] or p.endswith("/" + y[2])) and a <= y[4] and b >= y[3]}
    return findings_, expected, due


def test_matches_by_class(matched):
    """the pairs that are due, once each; the plan shuffles ids, not pairs."""
    got = rows_of(trace.finding_matches(*matched[:2]), "finding_id", "expected_id")
    assert got == sorted(matched[2]) and len(got) > 1000


def test_match_counts_without_pairs(matched):
    """F3"""
    n, used = trace.match_counts(*matched[:2])
    per: dict = {}
    for _, e in matched[2]:
        per[e] = per.get(e, 0) + 1
    assert rows_of(n, "expected_id", "n") == sorted(per.items())
    assert {r[0] for r in used.collect()} == {f for f, _ in matched[2]}
    bait = matched[0].where("file_path = 'b.py'").select("finding_id")
    pairs = trace.finding_matches(*matched[:2])
    assert trace.evaluation(*matched[:2], pairs, bait).first() == trace.evaluation_of(*matched[:2], n, used, bait).first()


def test_pairs_of_the_query_are_not_shuffled(big):
    """ids are dealt out once; before, all pairs were, to drop repeats, and all findings, to meet the expected ones."""
    plan = registry.QUERIES["expected_match"](big, SMALL)._jdf.queryExecution().executedPlan().toString()
    assert all("finding_id" in x and "expected_id" not in x for x in plan.splitlines() if "Exchange hashpartitioning" in x) or plan.count("Exchange hashpartitioning") <= 2


def test_baits_share_their_findings(spark):
    """ids are gathered once for all baits that the same findings hit."""
    rows = hot(3000)
    f = spark.createDataFrame([(i, f"src/{p}", a, max(a, b)) for i, p, a, b in rows], "finding_id string, file_path string, line_start int, line_end int")
    b = spark.createDataFrame([(f"b{n}", p, a, max(a, c)) for n, (_, p, a, c) in enumerate(hot(500))], "bait_id string, file_path string, line_start int, line_end int")
    hit, sets = review_flow.bait_sets(f, b)
    want = {}
    for n, (_, p, a, c) in enumerate(hot(500)):
        want[f"b{n}"] = sorted({i for i, q, x, y in rows if p == q and x <= max(a, c) and max(x, y) >= a})
    assert {r.bait_id: r.finding_ids for r in review_flow.bait_hits(f, b).collect()} == {k: v for k, v in want.items() if v}
    assert sets.count() == len({tuple(v) for v in want.values() if v}) < 500 == hit.count()
