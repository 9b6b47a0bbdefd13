"""Structural probes and postings do their work once."""

from pyspark.sql import functions as F

from scryline import registry
from scryline.functions import matchers
from scryline.operators import retrieval
from tests.conftest import SMALL, plain


def test_some_probes_only(spark):
    """two probes of the text need no syntax trees."""
    plan = registry.QUERIES["structural_scores"](spark, SMALL)._jdf.queryExecution().executedPlan().toString()
    assert "ArrowEvalPython" not in plan
    c = spark.createDataFrame([("python", "execute(f'x') jwt.decode(x, \"none\"")], "language string, chunk_text string")
    assert matchers.matched_probes(c, probes=["security.jwt_algorithm_allowlist"]).first()["_probes"] == ["security.jwt_algorithm_allowlist"]
    assert matchers.matched_probes(c).first()["_probes"] == ["security.sql_nosql_injection", "security.jwt_algorithm_allowlist"]


def test_trees_are_parsed_once(spark):
    """before, the explosion of the probes tested them first, and so computed them again."""
    plan = registry.QUERIES["structural_flags"](spark, SMALL)._jdf.queryExecution().optimizedPlan().toString()
    assert plan.count("explode(_probes") == 1 and "size(_probes" not in plan and "Filter (size(" not in plan


def test_postings_without_a_shuffle(spark):
    """F16: words are counted within the row."""
    docs = spark.createDataFrame([("a", "b A b c_1 b"), ("a", "x"), ("n", None), ("e", " ;"), ("z", "É b")], "doc string, text string")
    got = retrieval.postings(docs, "doc", "text")
    assert "Exchange" not in got._jdf.queryExecution().executedPlan().toString()
    assert plain(got.collect()) == plain([("a", 5, "b", 3), ("a", 5, "a", 1), ("a", 5, "c_1", 1), ("a", 1, "x", 1), ("z", 1, "b", 1)])


def test_old_segments_go(spark, monkeypatch):
    """F16: the index keeps no segment that it doesn't use beside the merged one."""
    from scryline.plans import store_queries

    seen = []
    monkeypatch.setattr(store_queries.TextIndex, "vacuum", lambda self, f=store_queries.TextIndex.vacuum: seen.append(f(self)))
    registry.QUERIES["stored_bm25"](spark, SMALL).select(F.count("*")).collect()
    assert seen == [3, 1]
