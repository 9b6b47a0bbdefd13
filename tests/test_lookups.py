import pytest
from pyspark.sql import functions as F

from scryline.operators import lookups


def test_filters(spark):
    t = spark.createDataFrame([("j", "tool", 2, 1), ("j", None, 1, 2), ("j", "llm", 1, 1), ("k", "tool", 0, 0)], "job_id string, event_type string, called_at int, sequence int")
    assert lookups.tool_events(t).count() == 3
    assert [(r.called_at, r.sequence) for r in lookups.trace_events(t, "j").collect()] == [(1, 1), (1, 2), (2, 1)]
    assert t.where(lookups.name_is("job_id", "J")).count() == 3
    schema = "verdict string, confidence double, title string, description string, line_start int, line_end int"
    c = spark.createDataFrame([("issue", 0.7, "t", "d", 1, 1), ("issue", 0.69, "t", "d", 1, 1), ("issue", 0.9, " ", "d", 1, 1), ("issue", 0.9, "t", None, 1, 1), ("issue", 0.9, "t", "d", 2, 1), ("ok", 0.9, "t", "d", 1, 1), ("issue", None, "t", "d", 1, 1)], schema)
    assert lookups.eligible(c).count() == 1


def test_lookups(spark):
    rows = spark.createDataFrame([(1, "u", 5), (2, "u", 7), (3, "v", 6), (3, "v", 6)], "id int, user_id string, created_at int")
    assert [r.id for r in lookups.of_owner(rows, "user_id", "u").collect()] == [2, 1]
    assert [r.id for r in lookups.of_owner(rows, "user_id", "u", newest_first=False).collect()] == [1, 2]
    assert [tuple(r) for r in lookups.by_key(rows, "id", 1, ["created_at"]).collect()] == [(5,)]
    assert lookups.by_key(rows, "id", 9).collect() == []
    with pytest.raises(Exception, match="comes twice"):
        lookups.by_key(rows, "id", 3).collect()


def test_embeddings_in_order(spark):
    e = spark.createDataFrame([([(1, [1.0]), (0, [0.0]), (2, None)],)], "items array<struct<index int, embedding array<double>>>")
    assert e.select(lookups.ordered_embeddings(F.col("items")).alias("x")).first().x == [[0.0], [1.0]]
