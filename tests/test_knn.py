"""Exact search by matrix products: the same as the definition, on odd vectors too, ranked as it is rounded."""

import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from scryline.operators import retrieval
from scryline.operators.vector_index import VectorIndex

#: Scores of 0.9999995 to 0.9999999 with the direction (1, 0), which all round to 1.0; the best raw scores have the greatest ids.
CLOSE = [(i, [1.0, 0.0003 - i * 0.00001]) for i in range(20)] + [(100 + i, [1.0, 1.0]) for i in range(20)]


def by_definition(vectors, queries, k, digits):
    pairs = vectors.crossJoin(queries.withColumnRenamed("vector", "_q")).select("query", "doc", retrieval.cosine(F.col("vector"), F.col("_q")).alias("score"))
    pairs = pairs.withColumn("score", F.round("score", digits)) if digits else pairs
    return retrieval.top_k(pairs, ["query"], k)


def plain(df):
    return sorted((str(r["query"]), r["rank"], str(r["doc"]), f"{r['score']:.9g}") for r in df.collect())


def test_ranks_follow_rounded_scores(spark):
    """rows that tie in their rounded scores go by doc."""
    v = spark.createDataFrame(CLOSE, "doc long, vector array<float>")
    q = spark.createDataFrame([(0, [1.0, 0.0])], "query long, vector array<float>")
    assert [r["doc"] for r in retrieval.knn(v, q, 5, digits=6).orderBy("rank").collect()] == [0, 1, 2, 3, 4]
    assert [r["doc"] for r in retrieval.knn(v, q, 5).orderBy("rank").collect()] == [19, 18, 17, 16, 15]


def test_cells_rank_by_rounded_scores(spark, tmp_path):
    """F12"""
    v = spark.createDataFrame(CLOSE, "doc long, vector array<float>")
    index = VectorIndex(spark, str(tmp_path / "v"))
    index.build(v, 2)
    q = spark.createDataFrame([(0, [1.0, 0.0])], "query long, vector array<float>")
    assert [r["doc"] for r in index.search(q, 5, 2, digits=6).orderBy("rank").collect()] == [0, 1, 2, 3, 4]


@pytest.mark.parametrize(("docs", "digits", "tile"), [("long", 3, 64), ("string", None, 64), ("long", 6, 1 << 20), ("string", 2, 1000)])
def test_same_as_the_definition(spark, monkeypatch, docs, digits, tile):
    """Null, zero, short and repeated vectors, vectors that hold a null or nan, null docs, and searches for more than there is."""
    monkeypatch.setattr(retrieval, "TILE", tile)
    rng = random.Random(tile)
    rows = [(i, [rng.choice([-1.0, 0.0, 0.5, 1.0]) for _ in range(3)]) for i in range(300)] + [(300, None), (301, [1.0, 2.0]), (302, [1.0, None, 2.0]), (303, [0.0, 0.0, 0.0]), (None, [1.0, 0.5, 0.5]), (304, [])]
    if digits == 6:
        rows.append((305, [float("nan"), 1.0, 1.0]))
    v = spark.createDataFrame(rows, "doc long, vector array<double>").withColumn("doc", F.col("doc").cast(docs)).repartition(5)
    asked = [(0, [1.0, 0.0, 0.5]), (1, [0.0, 0.0, 0.0]), (2, None), (3, [2.0, 1.0]), (4, [0.3, 0.2, None]), (5, [-1.0, -0.5, 1.0]), (6, [])]
    q = spark.createDataFrame(asked, "query int, vector array<double>")
    for k in (1, 7, 400):
        assert plain(retrieval.knn(v, q, k, digits=digits)) == plain(by_definition(v, q, k, digits))


def test_no_pairs_leave_the_scan(spark):
    """scores are matrix products; before, Spark walked through each pair's numbers."""
    rng = np.random.default_rng(1)
    v = spark.createDataFrame([(i, x.tolist()) for i, x in enumerate(rng.normal(size=(200, 8)))], "doc long, vector array<double>")
    plan = retrieval.knn(v, v.where("doc < 20").withColumnRenamed("doc", "query"), 5)._jdf.queryExecution().executedPlan().toString()
    assert "MapInArrow" in plan and "NestedLoopJoin" not in plan and "CartesianProduct" not in plan
