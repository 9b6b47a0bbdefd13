"""Stored indexes and tables, many terms at once, ranges and places of hot files."""

import random
import time

import pytest
from pyspark.sql import functions as F

from scryline.operators import findings, ranges, retrieval, terms, trace
from scryline.operators.text_index import TextIndex
from scryline.operators.vector_index import VectorIndex, recall
from scryline.sources.versions import KeyedTable
from tests.conftest import SMALL, plain


@pytest.fixture(scope="module")
def docs(spark):
    rng = random.Random(1)
    words = [f"w{k}" for k in range(200)]
    rows = [(f"d{i}", " ".join(rng.choices(words, [1 / (k + 1) for k in range(200)], k=rng.randrange(1, 60)))) for i in range(300)]
    return spark.createDataFrame(rows + [("d0x", ""), ("d1x", None)], "doc string, text string")


def test_text_index_equals_bm25(spark, docs, tmp_path):
    queries = spark.createDataFrame([(0, "w3 W9 w150 w9 nowhere"), (1, "w0"), (2, "")], "query int, text string")
    index = TextIndex(spark, str(tmp_path / "i"), buckets=8)
    assert index.search(queries).count() == 0
    index.add(docs.where("doc < 'd2'"), "doc", "text")
    index.add(docs, "doc", "text")
    want = plain(retrieval.bm25(docs, queries, "doc", "text").select("query", "doc", "score").collect())
    assert plain(index.search(queries).select("query", "doc", "score").collect()) == want
    assert len(index.manifests.newest()[1]["segments"]) == 2
    index.merge()
    again = TextIndex(spark, str(tmp_path / "i"), buckets=99)  # the stored number of buckets holds
    assert plain(again.search(queries).select("query", "doc", "score").collect()) == want and again.buckets == 8
    assert again.vacuum() == 2 and plain(again.search(queries).select("query", "doc", "score").collect()) == want
    again.remove(docs.where("doc >= 'd2'"), "doc")
    assert plain(again.search(queries).select("query", "doc", "score").collect()) == plain(retrieval.bm25(docs.where("doc < 'd2'"), queries, "doc", "text").select("query", "doc", "score").collect())


def test_text_index_prunes_by_term(spark, docs, tmp_path):
    index = TextIndex(spark, str(tmp_path / "i"), buckets=32)
    index.add(docs, "doc", "text")
    hits = index.hits(spark.createDataFrame([("w7",)], "term string"))
    plan = hits._jdf.queryExecution().executedPlan().toString()
    assert "PartitionFilters: [" in plan and "bucket" in plan.split("PartitionFilters: [")[1].split("]")[0]
    read = {f.split("/bucket=")[1].split("/")[0] for f in index.postings([5]).select(F.input_file_name()).distinct().toPandas().iloc[:, 0]}
    assert len(read) == 1 and hits.count() == docs.where("text rlike '(^| )w7( |$)'").count()


def test_bm25_of_many_terms(docs, spark, monkeypatch):
    """Terms that stand in the plan and terms that are joined give the same scores."""
    queries = spark.createDataFrame([(0, " ".join(f"w{k}" for k in range(0, 200, 3)))], "query int, text string")
    want = plain(retrieval.bm25(docs, queries, "doc", "text").collect())
    monkeypatch.setattr(retrieval, "INLINE_TERMS", 3)
    assert plain(retrieval.bm25(docs, queries, "doc", "text").collect()) == want


def test_index_is_safe_from_other_writers(spark, docs, tmp_path):
    index = TextIndex(spark, str(tmp_path / "i"))
    index.add(docs.limit(3), "doc", "text")
    version, state = index.manifests.newest()
    index.manifests.commit(version, state)
    with pytest.raises(RuntimeError, match="another job"):
        index.manifests.commit(version, state)


def test_keyed_table(spark, tmp_path):
    rng, table, held = random.Random(2), KeyedTable(spark, str(tmp_path / "t"), ["a", "b"], buckets=4), {}
    for turn in range(4):
        rows = [(rng.randrange(6), f"k{rng.randrange(3)}", turn * 100 + k, [float(k)]) for k in range(8)]
        table.upsert(spark.createDataFrame(rows, "a int, b string, n int, v array<double>"), newest=["n"])
        for a, b, n, v in rows:
            if (a, b) not in held or held[a, b][0] < n:
                held[a, b] = (n, v)
        assert {(r.a, r.b): (r.n, r.v) for r in table.read().collect()} == held
    before = table.manifests.newest()
    one = table.read().limit(1).withColumn("n", F.lit(-1))
    key = one.select("a", "b", F.pmod(F.xxhash64("a", "b"), F.lit(4)).alias("bucket")).first()
    table.upsert(one)
    after = table.manifests.newest()
    assert {b for b in before[1]["folders"] if before[1]["folders"][b] != after[1]["folders"][b]} == {str(key.bucket)}  # no other bucket is written anew
    assert table.lookup(spark.createDataFrame([(key.a, key.b)], "a int, b string")).first().n == -1
    assert table.read(before[0]).where("n = -1").count() == 0  # the old version stands
    table.delete(spark.createDataFrame([(key.a, key.b)], "a int, b string"))
    assert table.read().count() == len(held) - 1
    with pytest.raises(ValueError, match="columns"):
        table.upsert(spark.createDataFrame([(1, "k0", 2)], "a int, b string, other int"))
    table.vacuum()
    assert table.read().count() == len(held) - 1


def test_lost_write_leaves_the_old_state(spark, tmp_path):
    table = KeyedTable(spark, str(tmp_path / "t"), ["a"], buckets=2)
    table.upsert(spark.createDataFrame([(1, "x"), (2, "y")], "a int, s string"))
    bad = spark.createDataFrame([(1, "z")], "a int, s string").where(F.assert_true(F.col("a") > 1).isNull())
    with pytest.raises(Exception):  # noqa: B017
        table.upsert(bad)
    assert sorted(map(tuple, table.read().collect())) == [(1, "x"), (2, "y")]


def test_vector_index_recall(spark, tmp_path):
    """Where vectors lie in groups, few cells of many hold what exact search finds; where they don't, most cells do. All cells are exact."""
    rng = random.Random(7)
    centres = [[rng.gauss(0, 1) for _ in range(16)] for _ in range(12)]
    rows = [(i, [x + rng.gauss(0, 0.25) for x in centres[i % 12]]) for i in range(600)]
    grouped = spark.createDataFrame(rows, "doc long, vector array<double>")
    loose = spark.read.parquet(f"{SMALL.replace('0.001', '0.01')}/embeddings.parquet").select(F.col("vec_id").alias("doc"), F.col("embedding").alias("vector"))
    for name, v, few, share in (("grouped", grouped, 3, 0.5), ("loose", loose, 8, 0.95)):
        index = VectorIndex(spark, str(tmp_path / name))
        index.build(v, 10)
        q = v.where("doc % 50 = 0").select(F.col("doc").alias("query"), "vector")
        assert recall(index, v, q, 10, 10) == 1.0
        assert recall(index, v, q, 10, few) >= 0.95 and index.read_share(q, few) < share


def test_terms_equal_the_loop(spark, monkeypatch):
    rng = random.Random(3)
    letters = "abÉé "
    words = sorted({"".join(rng.choices(letters.lower(), k=rng.randint(1, 4))) for _ in range(60)} | {""})
    texts = [None, "", *["".join(rng.choices(letters, k=rng.randrange(40))) for _ in range(40)]]
    rows = spark.createDataFrame(list(enumerate(texts)), "i int, text string")
    t = spark.createDataFrame([(w,) for w in words + [None, words[3]]], "term string")
    want = {i: [] if x is None else [w for w in words if w in x.lower()] for i, x in enumerate(texts)}
    for block in (terms.BLOCK_CHARS, 40):
        monkeypatch.setattr(terms, "BLOCK_CHARS", block)
        assert {r.i: sorted(r.terms) for r in terms.held_terms(rows, "text", t).collect()} == want


def test_terms_take_no_longer_when_they_are_many():
    text = "the quick brown fox " * 20_000
    took = []
    for n in (10, 10_000):
        m = terms.Matcher([f"term{k}x" for k in range(n)])
        m("warm")
        began = time.perf_counter()
        assert m(text) == []
        took.append(time.perf_counter() - began)
    assert took[1] < 5 * took[0]


def test_one_hot_file(spark):
    """All rows in one file: cells and starts are merged apart, with the result of the plain sweep."""
    rng = random.Random(4)
    rows = [(1, "k", "f.py", f"i{i:05}", a := rng.choice([7, rng.randint(1, 40_000)]), a + rng.randint(0, 3), "low", "bug", "ruff", 0.5) for i in range(6_000)]
    df = spark.createDataFrame(rows, "job_id int, finding_key string, file_path string, issue_id string, line_start int, line_end int, severity string, category string, source string, confidence double")
    want, end = [], -1
    for a, b, i in sorted((r[4], r[5], r[3]) for r in rows):
        if a > end:
            want.append([a, b, 1])
        else:
            want[-1][1], want[-1][2] = max(want[-1][1], b), want[-1][2] + 1
        end = max(end, b)
    out = findings.occurrences(df)
    assert sorted((r.line_start, r.line_end, r.raw) for r in out.collect()) == [tuple(w) for w in want]
    points = ranges.by_start(df, ["file_path"]).withColumn("cell", F.floor(F.col("line_start") / ranges.CELL_LINES))
    sizes = [r["count"] for r in points.groupBy("cell").count().collect()]
    assert len(sizes) >= 9 and max(sizes) < 0.2 * len(rows)


def test_covered_and_gaps(spark):
    rng = random.Random(5)
    pieces = [(f"f{rng.randrange(3)}", a := rng.randint(1, 900), a + rng.randint(0, 20), 1000) for _ in range(120)]
    targets = [(i, f"f{rng.randrange(4)}", a := rng.randint(1, 900), a + rng.randint(0, 25)) for i in range(150)]
    lines = {}
    for f, a, b, _ in pieces:
        lines.setdefault(f, set()).update(range(a, b + 1))
    p = spark.createDataFrame(pieces, "f string, line_start int, line_end int, total int")
    got = {r.id: r.covered for r in ranges.covered(spark.createDataFrame(targets, "id int, f string, a int, b int"), p, ["f"], "id", width=16).collect()}
    assert got == {i: set(range(a, b + 1)) <= lines.get(f, set()) for i, f, a, b in targets} and len(set(got.values())) == 2
    missing = {(r.f, k) for r in ranges.gaps(p, ["f"], "total").collect() for k in range(r.gap_start, r.gap_end + 1)}
    assert missing == {(f, k) for f in lines for k in range(1, 1001) if k not in lines[f]}


def test_places_of_a_common_name(spark):
    """Files of one name in many folders: whole endings meet, and only where lines are near."""
    rng = random.Random(6)
    paths = [f"pkg{k}/src/main.py" for k in range(40)] + ["./Pkg1\\src\\main.py", "main.py"]
    actual = [(i, rng.choice(paths), a := rng.randint(1, 400), a + rng.randint(0, 90)) for i in range(500)]
    expected = [(i, rng.choice(["src/main.py", "main.py", "pkg3/src/main.py", "PKG1/src/main.py", "c/main.py"]), a := rng.randint(1, 400), a + rng.randint(0, 90)) for i in range(60)]
    clean = lambda p: p.lower().replace("\\", "/").removeprefix("./")
    want = {(i, j) for i, p, a, b in actual for j, e, c, d in expected if (clean(p) == clean(e) or clean(p).endswith("/" + clean(e))) and a <= d and b >= c}
    got = ranges.places_met(spark.createDataFrame(actual, "i int, path string, a_start int, a_end int"), spark.createDataFrame(expected, "j int, e_path string, line_start int, line_end int"), [])
    pairs = [(r.i, r.j) for r in got.collect()]
    assert set(pairs) == want and len(pairs) == len(want)


def test_finding_matches_by_evidence(spark):
    kind = "finding_id string, probe_id string, file_path string, line_start int, line_end int, claim_type string, category string, evidence array<struct<file_path:string,line_start:int,line_end:int>>"
    f = spark.createDataFrame([("a", "p", "x.py", None, None, "c", "bug", [("lib/y.py", 3, 9)]), ("b", "p", "x.py", 1, 2, "c", "bug", None)], kind)
    e = spark.createDataFrame([("e", ["p", "q"], "y.py", 9, 12, None, "bug"), ("g", ["p"], "x.py", 2, 2, "other", "bug")], "expected_id string, expected_probes array<string>, file_path string, line_start int, line_end int, claim_type string, category string")
    assert [tuple(r) for r in trace.finding_matches(f, e).collect()] == [("a", "e")]
