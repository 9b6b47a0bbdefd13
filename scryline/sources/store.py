"""Tables on a shared folder: append, replace, upsert, scoped reads (IDs S10 - S12, S14, S15, S17, S19, S20, P02 - P05, P16, P17, P25, J26, U07, U10, X10, X21, X25, X34)."""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame, SparkSession, functions as F

from scryline.functions.scalars import clean_metadata
from scryline.operators.reports import latest


def append(df: DataFrame, path: str, schema) -> None:
    """Rows of exactly this schema."""
    df.select([F.col(f.name).cast(f.dataType) for f in schema.fields]).write.mode("append").parquet(path)


def read_scope(spark: SparkSession, path: str, key: str, value) -> DataFrame:
    """One key's rows; the key is a partition column, so other files aren't read."""
    return spark.read.parquet(path).where(F.col(key) == value)


def replace_partition(df: DataFrame, path: str, key: str, batch: int = 500) -> tuple[int, int]:
    """The key's rows are replaced at once; returns rows and round trips."""
    if batch <= 0:
        raise ValueError("batch must be positive")
    n = df.count()
    df.write.mode("overwrite").option("partitionOverwriteMode", "dynamic").option("maxRecordsPerFile", max(batch, 10_000)).partitionBy(key).parquet(path)
    return n, math.ceil(n / batch)


def upsert(old: DataFrame, new: DataFrame, keys: list[str], updated: str) -> DataFrame:
    """The latest row of each key."""
    return latest(old.unionByName(new), keys, [updated])


def replace_sources(old: DataFrame, new: DataFrame, sources: list[str]) -> DataFrame:
    """Rows of these sources give way to the new ones."""
    return old.where(~F.col("source").isin(sources)).unionByName(new)


def vector_rows(docs: DataFrame, embedding: Column) -> DataFrame:
    """Id, content, metadata without nulls, embedding."""
    return docs.select("id", "content", clean_metadata(F.col("metadata")).alias("metadata"), embedding.alias("embedding"))


def all_documents(table: DataFrame) -> DataFrame:
    """Every row with the score 1."""
    return table.withColumn("score", F.lit(1.0))


def reset(table: DataFrame, path: str) -> None:
    """S17"""
    table.limit(0).write.mode("overwrite").parquet(path)


def without_job(table: DataFrame, job_id) -> DataFrame:
    """S20"""
    if job_id is None or not str(job_id).strip():
        raise ValueError("a job is needed")
    return table.where(F.col("job_id") != job_id)


def batch_trace(chunks: DataFrame, batch: str = "batch") -> DataFrame:
    """By batch: files, chunks, tokens."""
    return chunks.groupBy(batch).agg(F.array_sort(F.collect_set("file_path")).alias("files"), F.count("*").alias("chunks"), F.sum("token_count").alias("tokens"))


def metadata_filter(metadata: Column, wanted: dict) -> Column:
    """Lists mean one of, other values equality; keys without value are left out, keys that a row lacks fail; weeks means week."""
    out = F.lit(True)
    for k, v in wanted.items():
        if not v:
            continue
        value = F.element_at(metadata, "week" if k == "weeks" else k)
        out = out & F.coalesce(value.isin([str(x) for x in v]) if isinstance(v, list | tuple | set) else value == str(v), F.lit(False))
    return out


def scope(generation_key: str | None, branch_key: str | None, job_id: str | None) -> Column:
    """The narrowest scope that is given; one is needed."""
    for name, value in (("index_generation_key", generation_key), ("repo_branch_key", branch_key), ("job_id", job_id)):
        if value:
            return F.col(name) == value
    raise ValueError("a scope is needed")


def by_ids(df: DataFrame, key: str, ids: list, job: Column | None = None) -> DataFrame:
    """P02"""
    out = df.where(F.col(key).isin(ids))
    return out if job is None else out.where(job)


def owned(df: DataFrame, user: str, value) -> DataFrame:
    """P16, P17"""
    return df.where(F.col(user) == value)


def updated_where(df: DataFrame, condition: Column, **values) -> DataFrame:
    """Columns set where the condition holds."""
    hit = F.coalesce(condition, F.lit(False))
    return df.withColumns({k: F.when(hit, v if isinstance(v, Column) else F.lit(v)).otherwise(F.col(k)) for k, v in values.items()})


def excluded(rows: DataFrame, keys: DataFrame, on: list[str]) -> DataFrame:
    """Rows whose keys aren't listed."""
    return rows.join(keys.select(*on).distinct(), on, "left_anti")


def only_value(df: DataFrame, column: str) -> DataFrame:
    """The column's value if it has exactly one that isn't empty, else null."""
    c = F.nullif(F.col(column), F.lit(""))
    return df.agg(F.when(F.count_distinct(c) == 1, F.max(c)).alias(column))


def first_value(df: DataFrame, column: str, order: str) -> DataFrame:
    """The first value that isn't empty."""
    return df.where((F.col(column) != "") & F.col(column).isNotNull()).agg(F.min_by(column, order).alias(column))


def of_tools(traces: DataFrame, tools: list[str]) -> DataFrame:
    """X21"""
    return traces.where(F.col("tool_name").isin(tools))


def manifest(chunks: DataFrame, key: str = "index_generation_key") -> DataFrame:
    """By generation: how many chunks, and its state."""
    return chunks.where(F.col(key).isNotNull()).groupBy(key).agg(F.count("*").alias("chunks")).withColumn("status", F.lit("INDEXED"))


def catalogue_complete(applicable: DataFrame, loaded: DataFrame, key: str = "rule_id") -> DataFrame:
    """Are all applicable rules loaded?"""
    return excluded(applicable, loaded, [key]).agg((F.count("*") == 0).alias("complete"))
