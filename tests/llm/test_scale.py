"""Hot keys, long lines and many tasks: what grows, how, and that nothing is lost on the way."""

import random
import time

import duckdb
import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

from scryline.llm import lines, lm, packing
from tests.conftest import same


def test_hot_bigram_is_spread(spark, monkeypatch):
    """One bigram makes up half of all: no bucket gets more than three times the mean."""
    monkeypatch.setattr(lm, "BUCKET", 2_000)
    monkeypatch.setattr(lm, "BLOCK", 1_000)
    rng = random.Random(1)
    rows = [(i, " ".join("very hot" if rng.random() < 0.7 else f"w{rng.randrange(4000)}" for _ in range(200))) for i in range(300)]
    docs = spark.createDataFrame(rows, "doc_id long, text string").repartition(4)
    scorer = lm.learn(docs, spark.createDataFrame([(i, i % 2) for i in range(300)], "doc_id long, quality int"))
    sizes = {}
    sender = lm.Sender(scorer.vocabulary, scorer.frequent, 1 + scorer.losses.total // lm.BUCKET, scorer.hot)
    for base in range(12):
        held = [(i, lm.TRAIN | lm.SCORE, scorer.vocabulary(t)) for i, t in rows[base * 25 : base * 25 + 25]]
        for r in sender.block(base << 20, held).itertuples(index=False):
            sizes[r.bucket] = sizes.get(r.bucket, 0) + len(r.at) // 4
    assert max(sizes.values()) <= 3 * np.mean(list(sizes.values()))
    assert lm.scored(docs, scorer).where("tokens > 0").count() == 300


def test_long_lines_are_linear(spark):
    """Two near copies of a line of 200,000 words, and of one around the bound, where both ways of hashing meet."""
    rng = random.Random(2)
    long = [f"w{rng.randrange(10**6)}" for _ in range(200_000)]
    edge = {n: [f"v{n}x{k}" for k in range(n)] for n in range(lines.LONG - 2, lines.LONG + 4)}
    rows = [(1, " ".join(long)), (2, " ".join(long[:70_000] + long[70_001:])), (3, " ".join([*long[:9], "other", *long[10:]])), (4, " ".join(long[:-2]))]
    rows += [(100 + n, " ".join(w)) for n, w in edge.items()] + [(200 + n, " ".join(w[:7] + w[8:])) for n, w in edge.items()] + [(300 + n, " ".join(["x", *w])) for n, w in edge.items()] + [(400 + n, " ".join(w[:-1] + ["y"])) for n, w in edge.items()]
    df = spark.createDataFrame(rows, "doc_id long, text string").repartition(4)
    began = time.time()
    got = sorted(r.doc_id for r in lines.drops(df).select("doc_id").collect())
    assert time.time() - began < 60
    assert got == sorted([2, 3, *[k + n for k in (200, 300, 400) for n in edge]])


def test_many_lines_of_a_document(spark):
    """Half of 100,000 lines go; the text is cut once."""
    text = "\n".join(f"line {k // 2} of a long document here" for k in range(100_000))
    began = time.time()
    (r,) = lines.deduplicated(spark.createDataFrame([(1, text)], "doc_id long, text string")).collect()
    assert time.time() - began < 60 and r.text == "line 0 of a long document here"  # each is one word away from the first


def test_places_between(spark):
    """First, last, neighbouring and all lines may go."""
    rows = [(1, "a b c d e\nf g h i j\n\nk l m n o"), (2, "f g h i j\nnew one of five words\nk l m n o"), (3, "a b c d e\nf g h i j"), (4, "x y z q r\na b c d e\nf g h i j\ns t u v w")]
    got = {r.doc_id: r.text for r in lines.deduplicated(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    assert got == {1: rows[0][1], 2: "new one of five words", 4: "x y z q r\ns t u v w"}


def test_lines_are_cut_once(spark, monkeypatch):
    """No pass over the corpus cuts texts or lines for a filter first and for what it computes again."""
    plans, real = {}, lines.staged

    def spy(df, tag):
        plans[tag] = df._jdf.queryExecution().optimizedPlan().toString()
        return real(df, tag)

    monkeypatch.setattr(lines, "staged", spy)
    rows = [(k, f"one two three four {k}\nshort\n\none more line of words") for k in range(9)]
    got = lines.drops(spark.createDataFrame(rows, "doc_id long, text string")).collect()
    assert {(r.doc_id, p) for r in got for p in r.places} == {(k, p) for k in range(1, 9) for p in (0, 1, 3)}
    for tag in ("lines", "candidate-words", "line-drops"):
        assert "split(" in plans[tag] and not [x for x in plans[tag].splitlines() if "Filter" in x and "split(" in x], tag


def test_white_space_of_all_kinds(spark, tmp_path):
    """Every kind of white space, within lines and around them, against the SQL."""
    rng, rows = random.Random(5), []
    pool = [[f"W{rng.randrange(9)}é" for _ in range(rng.randint(1, 8))] for _ in range(60)]
    blank = lambda least: "".join(rng.choice(lines.BLANK.replace("\n", "")) if rng.random() < 0.4 else " " for _ in range(rng.choice([least, least, 1, 2])))
    for d in range(80):
        ls = [blank(0) + "".join(w + blank(1) for w in rng.choice(pool)[:-1] + ["end"]) + rng.choice(["", blank(0)]) for _ in range(4)]
        rows.append((d, "\n".join([*ls, blank(0), "a\u00a0b\u2003c d", "\t"][: rng.randint(1, 7)])))
    spark.createDataFrame(rows, "doc_id long, text string").coalesce(1).write.parquet(str(tmp_path / "documents.parquet"))
    con = duckdb.connect()
    con.execute(f"CREATE VIEW documents AS FROM '{tmp_path}/documents.parquet/*.parquet'")
    same(lines.op9_line_dedup(spark, str(tmp_path)), con, lines.OP9_SQL)


@pytest.mark.parametrize("round_rows", [20, 5])
def test_packing_in_many_tasks(spark, monkeypatch, round_rows):
    """With leftovers of many tasks no two sequences fit together in the end, and no piece is lost."""
    monkeypatch.setattr(packing, "ROUND_ROWS", round_rows)
    rng = random.Random(3)
    rows = [(i, " ".join(f"w{k}" for k in range(rng.choice([3, 20, 60, 100, 110])))) for i in range(600)]
    docs = spark.createDataFrame(rows, "doc_id long, text string").repartition(40)
    got = packing.pack_documents(docs, packing.tokenizer_path(), capacity=512).toPandas()
    assert sorted(got["doc_id"]) == [i for i, _ in rows]
    fill = got.groupby("sequence_id")["length"].sum().sort_values().to_numpy()
    assert fill.max() <= 512 and len(fill) <= 1.25 * -(-fill.sum() // 512)  # small tasks pack loosely
    least = [x for x in fill if x < 512 - packing.NEARLY]
    assert len(least) < 2 or least[0] + least[1] > 512
    for _, rows_ in got.sort_values("offset").groupby("sequence_id"):
        assert (rows_["offset"].to_numpy() == np.concatenate(([0], rows_["length"].cumsum()[:-1]))).all()


def test_packing_when_nothing_fits(spark, monkeypatch):
    """Items of a bit more than half: none fit together; one small one goes to the roomiest."""
    monkeypatch.setattr(packing, "ROUND_ROWS", 4)
    made = pd.DataFrame({"doc_id": range(40), "text": ["a " * (260 + i) for i in range(40)]})
    made.loc[40] = [40, "b " * 200]
    got = packing.pack_documents(spark.createDataFrame(made).repartition(8), packing.tokenizer_path(), capacity=512)
    assert got.groupBy("sequence_id").agg(F.sum("length").alias("n")).count() == 40
