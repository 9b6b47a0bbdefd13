"""Look-ups and plain filters over review tables (IDs P10, P11, P15, O17, X22 - X24, X36)."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

MIN_CONFIDENCE = 0.7


def tool_events(trace: DataFrame) -> DataFrame:
    """P10: events of tools; those without a type count as such."""
    return trace.where((F.col("event_type") == "tool") | F.col("event_type").isNull())


def name_is(column: str, name: str) -> Column:
    """Equal but for case."""
    return F.lower(column) == F.lower(F.lit(name))


def eligible(candidates: DataFrame) -> DataFrame:
    """Candidates (verdict, confidence, title, description, line_start, line_end) that may become issues; a missing value rules one out."""
    filled = lambda c: F.trim(F.coalesce(F.col(c), F.lit(""))) != ""
    return candidates.where((F.col("verdict") == "issue") & (F.col("confidence") >= MIN_CONFIDENCE) & filled("title") & filled("description") & (F.col("line_start") <= F.col("line_end")))


def trace_events(trace: DataFrame, job: str) -> DataFrame:
    """A job's events in the order of their calls."""
    return trace.where(F.col("job_id") == job).orderBy("called_at", "sequence")


def by_key(rows: DataFrame, key: str, value, columns: list[str] | None = None) -> DataFrame:
    """The row of a key, or some of its columns; no row if there is none, and an error if there are several."""
    found = rows.where(F.col(key) == value).groupBy(key).agg(F.count("*").alias("_n"), F.min(F.struct(*[c for c in rows.columns if c != key])).alias("_row"))
    one = found.where(F.assert_true(F.col("_n") == 1, F.lit("a key comes twice")).isNull())
    return one.select(key, "_row.*").select(*(columns or rows.columns))


def of_owner(rows: DataFrame, owner: str, value, newest_first: bool = True, at: str = "created_at", tie: str = "id") -> DataFrame:
    """An owner's rows, newest or oldest first."""
    return rows.where(F.col(owner) == value).orderBy(F.desc(at) if newest_first else F.asc(at), tie)


def ordered_embeddings(items: Column) -> Column:
    """Items (array of struct<index, embedding>) -> their embeddings by index; missing ones go."""
    placed = F.transform(F.filter(items, lambda x: x["embedding"].isNotNull()), lambda x, at: F.struct(x["index"].alias("index"), at.alias("at"), x["embedding"].alias("embedding")))
    return F.transform(F.array_sort(placed), lambda x: x["embedding"])
