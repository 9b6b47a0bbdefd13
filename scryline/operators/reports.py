"""Dashboards and report texts (IDs A20 - A23, A34, O11 - O15, W08, W09, J05 - J07, J20, X44, X57, X58, U04)."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window, functions as F

from scryline.functions.scalars import SEVERITIES, count_text, js_round
from scryline.functions.text import first_match

#: Jobs under way, and how many completed ones the dashboard looks at. Fixed values.
ACTIVE = ["PENDING", "CLONING", "ANALYZING_STRUCTURE", "GENERATING_SUMMARY", "RUNNING_STATIC_ANALYSIS", "CHUNKING_CODE", "AI_REVIEWING", "GENERATING_REPORT"]
RECENT_LIMIT = 12


def latest_time(completed: str = "completed_on", started: str | None = None, created: str = "created_on") -> Column:
    """The first that there is of completed, started, created."""
    return F.coalesce(*[F.col(c) for c in (completed, started, created) if c])


def recent_completed(jobs: DataFrame, limit: int = RECENT_LIMIT) -> DataFrame:
    """O11"""
    return jobs.where("status = 'COMPLETED'").orderBy(latest_time().desc(), "id").limit(limit)


def active_reviews(jobs: DataFrame) -> DataFrame:
    """O13"""
    return jobs.where(F.col("status").isin(ACTIVE)).orderBy(latest_time().desc(), "id").withColumn("is_queued", F.col("status") == "PENDING")


def with_reports(jobs: DataFrame, reports: DataFrame) -> DataFrame:
    """Jobs with their report's total, and where a click leads."""
    r = reports.select(F.col("job_id").alias("id"), "total_findings", F.lit(True).alias("_has"))
    return jobs.join(r, "id", "left").withColumn("href", F.concat(F.lit("/reviews/"), F.col("id").cast("string"), F.when(F.col("_has"), "/report").otherwise(""))).drop("_has")


def with_repository(jobs: DataFrame, repos: DataFrame) -> DataFrame:
    """Jobs with the repository's name, or its id where it has none."""
    names = repos.select(F.col("id").alias("repository_id"), "name")
    return jobs.join(names, "repository_id", "left").withColumn("repository_name", F.coalesce("name", F.col("repository_id").cast("string"))).drop("name")


def latest_report(jobs: DataFrame, reports: DataFrame, condition: Column | None = None) -> DataFrame:
    """The report, of those that meet the condition, whose job is the latest: one row at most."""
    both = jobs.join(reports.withColumnRenamed("job_id", "id").drop("created_on"), "id")
    both = both if condition is None else both.where(condition)
    return both.agg(F.max_by(F.struct("id", "total_findings"), F.struct(latest_time(), (-F.col("id")).alias("i"))).alias("b")).where("b is not null").select("b.*")


def totals(reports: DataFrame) -> DataFrame:
    """The sums of all counts, and how many reports there are; zeros without any."""
    return reports.agg(*[F.coalesce(F.sum(f"{s}_count"), F.lit(0)).alias(f"{s}_count") for s in SEVERITIES], F.coalesce(F.sum("total_findings"), F.lit(0)).alias("total_findings"), F.count("*").alias("report_count"))


def job_counts(jobs: DataFrame) -> DataFrame:
    s = F.col("status")
    return jobs.agg(
        F.count("*").alias("jobs"), F.count_if(s == "COMPLETED").alias("completed"), F.count_if(s == "PENDING").alias("queued"),
        F.count_if(s.isin(ACTIVE) & (s != "PENDING")).alias("running"), F.count_if(s.isin(ACTIVE)).alias("active"), F.count_if(s == "FAILED").alias("failed"),
    )


def repo_counts(repos: DataFrame) -> DataFrame:
    return repos.agg(F.count("*").alias("repositories"), F.count("last_reviewed").alias("repos_reviewed"))


def risk_posture(jobs: DataFrame, repos: DataFrame, reports: DataFrame, requested: int, failed_loads: int) -> DataFrame:
    """One row with the counts and the tone: the first case that holds."""
    row = job_counts(jobs).crossJoin(totals(reports)).crossJoin(repo_counts(repos))  # one row each
    incomplete = F.lit(failed_loads > 0) | (F.col("report_count") < requested)
    tone = first_match(
        [
            ((F.col("completed") == 0) & (F.col("running") > 0), "running"),
            (F.col("completed") == 0, "pending"),
            (F.col("report_count") == 0, "unavailable"),
            (F.col("critical_count") > 0, "critical"),
            (F.col("high_count") > 0, "high"),
            (incomplete, "unavailable"),
            (F.col("total_findings") > 0, "attention"),
        ],
        F.lit("clear"),
    )
    return row.select(tone.alias("tone"), "critical_count", "high_count", "total_findings", "repos_reviewed", "report_count")


def codebase_health(repos: DataFrame, reports: DataFrame) -> DataFrame:
    """Score from 0 to 100 and its status."""
    row = totals(reports).crossJoin(repo_counts(repos))
    penalty = F.when(F.col("repositories") > 0, js_round((1 - F.col("repos_reviewed") / F.col("repositories")) * 20)).otherwise(0)
    raw = 100 - penalty - F.col("critical_count") * 15 - F.col("high_count") * 8 - F.col("medium_count") * 3 - F.col("low_count")
    score = F.greatest(F.lit(0), F.least(F.lit(100), raw))
    status = first_match([(F.col("report_count") == 0, "unknown"), ((F.col("critical_count") > 0) | (F.col("score") < 40), "critical"), ((F.col("high_count") > 0) | (F.col("score") < 70), "warning")], F.lit("healthy"))
    return row.withColumn("score", score).select("score", status.alias("status"), "repos_reviewed", "repositories")


def trend(reports: DataFrame, column: str, created: str = "created_on", tie: str = "job_id") -> DataFrame:
    """How the latest report's count compares with the one before it. Two rows are looked at, no window over all."""
    two = reports.orderBy(F.desc(created), F.desc(tie)).limit(2).agg(F.max_by(column, F.struct(created, tie)).alias("now"), F.min_by(column, F.struct(created, tie)).alias("before"), F.count("*").alias("n"))
    return two.select(first_match([(F.col("n") < 2, "unknown"), (F.col("now") > F.col("before"), "up"), (F.col("now") < F.col("before"), "down")], F.lit("stable")).alias("trend"))


def needs_attention(jobs: DataFrame, reports: DataFrame, risky: DataFrame, failed_loads: int, limit: int = 6) -> DataFrame:
    """Five lists one after the other, cut at the limit; each list is cut before they meet."""
    spark = jobs.sparkSession

    def section(df: DataFrame, n: int, tone: str, key: Column, count: Column, order: list[Column]) -> DataFrame:
        part = df.orderBy(*order).limit(limit)
        rank = F.row_number().over(Window.orderBy(*order))  # of at most `limit` rows
        return part.select(F.lit(n).alias("section"), rank.alias("place"), F.lit(tone).alias("tone"), key.cast("string").alias("key"), count.cast("long").alias("count"))

    parts = [section(reports.where(f"{s}_count > 0"), i, s, F.col("job_id"), F.col(f"{s}_count"), [F.desc(f"{s}_count"), F.desc("created_on"), F.asc("job_id")]) for i, s in ((1, "critical"), (2, "high"))]
    parts.append(section(jobs.where("status = 'FAILED'"), 3, "failed", F.col("id"), F.lit(None), [latest_time().desc(), F.asc("id")]))
    if failed_loads:
        parts.append(spark.createDataFrame([(4, 1, "report", "report-load-failures", failed_loads)], "section int, place int, tone string, key string, count long"))
    parts.append(section(risky, 5, "file", F.concat_ws(":", F.col("job_id").cast("string"), "path"), F.col("issue_count"), [F.desc("issue_count"), F.asc("path"), F.asc("job_id")]))
    out = parts[0]
    for p in parts[1:]:
        out = out.unionByName(p)
    return out.orderBy("section", "place").limit(limit)


def timeline(jobs: DataFrame, reports: DataFrame, today: str, limit: int = 8) -> DataFrame:
    """The latest events with their day's label, and the number of the run of equal labels."""
    s = F.col("status")
    kind = first_match([(s == "COMPLETED", "review_completed"), (s == "FAILED", "review_failed"), (s == "PENDING", "review_queued"), (s.isin(ACTIVE), "review_running")])
    events = jobs.withColumn("type", kind).where("type is not null").withColumn("day", F.when(s.isin("COMPLETED", "FAILED"), F.coalesce("completed_on", "created_on")).otherwise(F.col("created_on")))
    top = events.orderBy(F.desc("day"), "id").limit(limit)
    top = top.join(reports.select(F.col("job_id").alias("id"), "total_findings"), "id", "left")
    label = first_match([(F.col("day") == F.to_date(F.lit(today)), F.lit("Today")), (F.col("day") == F.date_sub(F.to_date(F.lit(today)), 1), F.lit("Yesterday"))], F.date_format("day", "yyyy-MM-dd"))
    order = Window.orderBy(F.desc("day"), "id")  # over at most `limit` rows
    opens = F.when(F.col("label") == F.lag("label").over(order), 0).otherwise(1)
    return top.withColumn("label", label).withColumn("_o", opens).select("id", "type", "label", F.sum("_o").over(order).alias("run"), F.coalesce("total_findings", F.lit(0)).alias("findings"))


def primary_action(jobs: DataFrame, repos: DataFrame, reports: DataFrame, requested: int) -> DataFrame:
    """The first case that holds."""
    row = job_counts(jobs).crossJoin(totals(reports)).crossJoin(repo_counts(repos))
    label = first_match(
        [
            (F.col("repositories") == 0, "Connect a repository"), (F.col("active") > 0, "View active reviews"), (F.col("completed") == 0, "Start your first review"),
            (F.col("total_findings") > 0, "Review findings"), (F.col("report_count") < requested, "Open completed reviews"),
        ],
        F.lit("Open latest report"),
    )
    return row.select(label.alias("label"))


def summary_text(counts: DataFrame) -> DataFrame:
    """One sentence from the counts."""
    parts = F.concat_ws(", ", *[F.concat(F.col(f"{s}_count").cast("string"), F.lit(f" {s}")) for s in SEVERITIES])
    return counts.withColumn("summary", F.concat(count_text(F.col("total_findings"), "finding"), F.lit(": "), parts))


def first_priorities(issues: DataFrame, n: int, order: list[Column]) -> DataFrame:
    """The first issues as `title (path:line)`."""
    return issues.orderBy(*order).limit(n).select(F.format_string("%s (%s:%d)", "title", "file_path", "line_start").alias("line"))


def merge_selection(old: DataFrame, new: DataFrame, key: str) -> DataFrame:
    """Union by key, the new row wins."""
    return old.join(new.select(key), key, "left_anti").unionByName(new)


def latest(rows: DataFrame, keys: list[str], order: list[str]) -> DataFrame:
    """The latest row of each key; one aggregation, no sort."""
    rest = [c for c in rows.columns if c not in keys]
    return rows.groupBy(*keys).agg(F.max(F.struct(*[F.col(c).alias(f"_{i}") for i, c in enumerate(order)], F.struct(*rest).alias("_row"))).alias("b")).select(*keys, "b._row.*")


def expired(jobs: DataFrame, statuses: list[str], cutoff: Column, completed: str = "completed_on", created: str = "created_on") -> DataFrame:
    """Finished, and completed (or where unknown, created) by the cutoff."""
    return jobs.where(F.col("status").isin(statuses) & (F.coalesce(completed, created) <= cutoff))
