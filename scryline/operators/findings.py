"""Findings: occurrences, representatives, groups, pages (IDs A03 - A07, A24 - A26, P01, P02, P12, O01, O10, W21, X41)."""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame, Window, functions as F

from scryline.functions.claims import finding_key
from scryline.functions.scalars import AI_SOURCES, SEVERITIES, report_priority, severity_order, severity_rank, source_order
from scryline.functions.text import normalize_path
from scryline.operators.ranges import by_start, merged


def merge_ranges(rows: DataFrame, keys: list[str], start: str = "line_start", end: str = "line_end", tie: str = "issue_id") -> DataFrame:
    """Rows with `island`, the number of their range of overlapping lines within keys (ends included).

    Sorted by start, a row opens an island if it begins after all ends before it; this equals joining each row to the first
    group that it overlaps.
    """
    order = Window.partitionBy(*keys).orderBy(start, end, tie)
    before = F.max(end).over(order.rowsBetween(Window.unboundedPreceding, -1))
    opens = F.when(before.isNull() | (F.col(start) > before), 1).otherwise(0)
    return rows.withColumn("_opens", opens).withColumn("island", F.sum("_opens").over(order.rowsBetween(Window.unboundedPreceding, Window.currentRow))).drop("_opens")


#: Different inputs of finding keys up to which these are computed once each and broadcast.
KEY_INPUTS = 5_000


def with_finding_key(issues: DataFrame, category: str, claim: str, title: str, rule_id: str | None = None, out: str = "finding_key") -> DataFrame:
    """issues with their finding key. A key is long to compute, so where there are few different inputs, it is computed once for each and broadcast; the
    issues themselves aren't shuffled."""
    columns = list(dict.fromkeys(c for c in (category, claim, title, rule_id) if c))
    key = finding_key(F.col(category), F.col(claim), F.col(title), F.col(rule_id) if rule_id else None)
    inputs = issues.select(*columns)
    found = inputs.distinct().limit(KEY_INPUTS + 1).collect()
    if len(found) > KEY_INPUTS:
        return issues.withColumn(out, key)
    keyed = issues.sparkSession.createDataFrame(found, inputs.schema).select(F.struct(*columns).alias("_of"), key.alias(out))
    return issues.join(F.broadcast(keyed), F.struct(*[issues[c] for c in columns]).eqNullSafe(F.col("_of")), "left").drop("_of")


def representative_key(rich: Column | None = None) -> Column:
    """The order in which rows represent their group: severity, rich evidence, source, confidence (null last), id."""
    return F.struct(
        severity_order(F.col("severity")).alias("s"), (~rich if rich is not None else F.lit(False)).alias("e"), source_order(F.col("source")).alias("o"),
        (-F.coalesce(F.col("confidence"), F.lit(-1.0))).alias("c"), F.col("issue_id").alias("i"),
    )


def representatives(rows: DataFrame, keys: list[str], columns: list[str]) -> DataFrame:
    """For each group its representative's columns; one aggregation of the least key, combined before the shuffle."""
    best = rows.groupBy(*keys).agg(F.min(F.struct(representative_key().alias("k"), *columns)).alias("b"))
    return best.select(*keys, *[F.col(f"b.{c}").alias(c) for c in columns])


def occurrences(issues: DataFrame, key: str = "finding_key") -> DataFrame:
    """A04 + A05: one row for each island of a finding in a file, with its range, sources and representative (`best`).

    Rows that begin at the same line are added up first, then ranges are merged within cells of lines and over them, so a file with most rows
    isn't one task's work.
    """
    keys = ["job_id", key, "path"]
    rows = issues.withColumn("path", normalize_path(F.col("file_path")))
    best = F.min(F.struct(representative_key()["s"].alias("s"), representative_key()["o"].alias("o"), representative_key()["c"].alias("c"), "issue_id", "severity", "category", "source")).alias("best")
    points = by_start(rows, keys, F.count("*").alias("raw"), F.collect_set("source").alias("sources"), best)
    islands = merged(points, keys, [F.sum("raw").alias("raw"), F.array_distinct(F.flatten(F.collect_list("sources"))).alias("sources"), F.min("best").alias("best")], rows=rows)  # sources are few
    return islands.select(*keys, "line_start", "line_end", "raw", F.array_sort("sources").alias("sources"), "best.issue_id", "best.severity", "best.category", "best")


def finding_groups(issues: DataFrame, key: str = "finding_key") -> DataFrame:
    """One row for each finding of a job: representative (the least of its occurrences' ones), occurrences, raw rows, files."""
    out = occurrences(issues, key).groupBy("job_id", key).agg(F.count("*").alias("occurrence_count"), F.sum("raw").alias("raw_issue_count"), F.array_sort(F.collect_set("path")).alias("affected_files"), F.min("best").alias("best"))
    return out.select("job_id", key, "occurrence_count", "raw_issue_count", "affected_files", *[f"best.{c}" for c in ("issue_id", "severity", "category", "source")])


def severity_counts(rows: DataFrame, keys: list[str]) -> DataFrame:
    """A column for each severity, zero where there is none."""
    return rows.groupBy(*keys).agg(*[F.count_if(F.col("severity") == s).alias(f"{s}_count") for s in SEVERITIES], F.count("*").alias("total_findings"))


def report_aggregate(issues: DataFrame, key: str = "finding_key") -> DataFrame:
    """Counts of findings (not rows) by severity for each job, and the raw rows."""
    found = severity_counts(representatives(issues, ["job_id", key], ["issue_id", "severity", "category"]), ["job_id"])
    return found.join(issues.groupBy("job_id").agg(F.count("*").alias("raw_issue_count")), "job_id")


def zero_filled(domain: list[str], rows: DataFrame, column: str, name: str = "n") -> DataFrame:
    """Counts in the domain's order."""
    spark = rows.sparkSession
    fixed = spark.createDataFrame([(i, d) for i, d in enumerate(domain)], f"ord int, {column} string")
    return fixed.join(rows.groupBy(column).agg(F.count("*").alias(name)), column, "left").select("ord", column, F.coalesce(name, F.lit(0)).alias(name))


def top_risky_files(issues: DataFrame, keys: list[str], limit: int = 5, tie: str = "issue_id") -> DataFrame:
    """The files of each group by best category, worst severity and number of issues; ties by first row."""
    files = issues.withColumn("path", F.coalesce(F.nullif(normalize_path(F.col("file_path")), F.lit("")), F.lit("Unknown file"))).groupBy(*keys, "path").agg(
        F.min(report_priority(F.col("category"))).alias("p"), F.max(severity_rank(F.col("severity"))).alias("r"), F.count("*").alias("issue_count"), F.min(tie).alias("first")
    )
    order = Window.partitionBy(*keys).orderBy("p", F.desc("r"), F.desc("issue_count"), "first")
    names = F.create_map(*[F.lit(x) for s in SEVERITIES for x in (5 - SEVERITIES.index(s), s)])
    return files.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= limit).select(*keys, "rank", "path", "issue_count", F.element_at(names, F.col("r")).alias("max_severity"))


def group_filter(*, severity: str | None = None, category: str | None = None, source: str | None = None, path: str | None = None):
    """An aggregate condition on the rows of a finding; severity and category test the representative."""

    def apply(issues: DataFrame, key: str = "finding_key") -> DataFrame:
        raw, norm = F.lower(F.replace("file_path", F.lit("\\"), F.lit("/"))), F.lower(normalize_path(F.col("file_path")))
        hit = F.lit(True)
        if path is not None:
            wanted = [F.lit(path.replace("\\", "/").lower().strip()), F.lower(normalize_path(F.lit(path)))]
            hit = F.lit(False)
            for t in wanted:
                hit = hit | F.contains(raw, t) | F.contains(norm, t) | ((raw != "") & F.contains(t, raw)) | ((norm != "") & F.contains(t, norm))
        from_source = F.lit(True) if source is None else F.col("source").isin(AI_SOURCES if source == "ai_review" else [source])
        out = issues.groupBy("job_id", key).agg(F.min(F.struct(representative_key().alias("k"), "severity", "category")).alias("b"), F.bool_or(from_source).alias("s"), F.bool_or(hit).alias("p"), F.count("*").alias("raw_issue_count"))
        if severity is not None:
            out = out.where(F.col("b.severity") == severity)
        if category is not None:
            out = out.where(F.col("b.category") == category)
        return out.where("s and p").select("job_id", key, F.col("b.severity").alias("severity"), F.col("b.category").alias("category"), "raw_issue_count")

    return apply


def issue_filter(issues: DataFrame, *, severity: str | None = None, category: str | None = None, source: str | None = None, path: str | None = None) -> DataFrame:
    """Equality on each that is given, and a case-blind LIKE on the path (its wild cards aren't escaped)."""
    for name, value in (("severity", severity), ("category", category), ("source", source)):
        if value is not None:
            issues = issues.where(F.col(name) == value)
    return issues if path is None else issues.where(F.col("file_path").ilike(f"%{path}%"))


def page(rows: DataFrame, field: str, created: str, *, descending: bool, number: int, size: int, tie: str) -> DataFrame:
    """One page, both keys in the same direction, ties by id."""
    way = F.desc if descending else F.asc
    order = severity_order(F.col(field)) if field == "severity" else F.col(field)
    return rows.orderBy(order.desc() if descending else order.asc(), way(created), F.asc(tie)).offset((number - 1) * min(size, 100)).limit(min(size, 100))


def dedupe_overlaps(issues: DataFrame, keys: list[str]) -> DataFrame:
    """By start, then falling confidence; a row that overlaps kept ones replaces the first of them if it is surer.

    Read by start, a row can overlap the last kept row only: those before it end before that one begins. So the fold holds one row,
    whatever the group; it depends on what was kept before, hence the order and Python.
    """

    columns = issues.columns

    def fold(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        held = None
        for pdf in batches:
            pdf = pdf if held is None else pd.concat([held, pdf], ignore_index=True)
            if pdf.empty:
                continue
            group = list(zip(*[pdf[k].tolist() for k in keys], strict=True))
            start, end, sure = pdf["line_start"].tolist(), pdf["line_end"].tolist(), pdf["confidence"].astype("float64").fillna(-1.0).tolist()
            last, kept = 0, []
            for i in range(1, len(pdf)):
                if group[i] != group[last] or start[i] > end[last]:
                    kept.append(last)
                    last = i
                elif sure[i] > sure[last]:
                    last = i
            held = pdf.iloc[[last]]
            yield pdf.iloc[kept]
        if held is not None:
            yield held[columns]

    ordered = issues.repartition(*keys).sortWithinPartitions(*keys, "line_start", F.coalesce("confidence", F.lit(-1.0)).desc(), "issue_id")
    return ordered.mapInPandas(fold, issues.schema)

