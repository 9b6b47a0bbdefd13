"""Queries of planning and verdicts, with their DuckDB SQL."""

from __future__ import annotations

from pyspark.sql import functions as F

from scryline.operators import review_plan
from scryline.plans.adapters import duck_with, table, view

RISK = "CASE l_partkey % 97 % 5 WHEN 0 THEN 'security' WHEN 1 THEN 'api' WHEN 2 THEN 'database' WHEN 3 THEN 'config' ELSE 'general' END"


def _chunks(spark, sf):
    """Lines of orders as chunks of a part's file."""
    t = table(spark, sf, "lineitem")
    return t.select(F.concat(F.expr("CASE l_suppkey % 4 WHEN 0 THEN 'src/auth/' WHEN 1 THEN 'src/db/' WHEN 2 THEN 'lib/' ELSE 'docs/' END"), F.lit("f"), (F.col("l_partkey") % 97).cast("string"), F.lit(".py")).alias("file_path"), F.expr(RISK).alias("risk_area"), F.col("l_linenumber").alias("chunk_index"), F.lit(None).cast("int").alias("total_chunks"))


C_SQL = f"c AS (SELECT CASE l_suppkey % 4 WHEN 0 THEN 'src/auth/' WHEN 1 THEN 'src/db/' WHEN 2 THEN 'lib/' ELSE 'docs/' END || 'f' || (l_partkey % 97) || '.py' AS file_path, {RISK} AS risk_area, l_linenumber AS chunk_index FROM lineitem)"


def files_to_review(spark, sf):
    """P20, A09"""
    tree = spark.createDataFrame([("lib/README.md", False), ("middleware/x.py", True), ("lib/f1.py", True)], "path string, should_review boolean")
    return review_plan.files_to_review(tree, _chunks(spark, sf))


FILES_SQL = f"""WITH {C_SQL}, g AS (SELECT file_path, max(chunk_index + 1) AS n, list(DISTINCT risk_area) AS r FROM c GROUP BY 1),
f AS (SELECT file_path FROM g UNION SELECT 'middleware/x.py' UNION SELECT 'lib/f1.py'), x AS (SELECT f.file_path, coalesce(g.n, 0) AS total_chunks, coalesce(g.r, []) AS r, regexp_matches(f.file_path, '(^|/)(auth|security|crypto|middleware)(/|\\.|$)') AS s FROM f LEFT JOIN g USING (file_path))
SELECT file_path, CASE WHEN list_has_any(r, ['security', 'api']) OR s THEN 'high' WHEN list_has_any(r, ['database', 'config']) THEN 'medium' ELSE 'low' END AS priority,
CASE WHEN list_contains(r, 'security') OR s THEN 'security' WHEN list_contains(r, 'database') THEN 'database' WHEN list_contains(r, 'api') THEN 'api' WHEN list_contains(r, 'config') THEN 'config' ELSE 'general' END AS risk_area, CAST(total_chunks AS INT) AS total_chunks FROM x"""


def coverage_probes(spark, sf):
    """O14"""
    return review_plan.coverage_probes(files_to_review(spark, sf)).select("probe_id", "category", "priority", "file_scope")


COVERAGE_SQL = f"""WITH f AS ({FILES_SQL}) SELECT 'coverage.' || regexp_replace(regexp_replace(lower(file_path), '[^a-z0-9]+', '_', 'g'), '^_+|_+$', '', 'g') AS probe_id, CASE risk_area WHEN 'api' THEN 'bug' WHEN 'database' THEN 'performance' WHEN 'config' THEN 'security' WHEN 'security' THEN 'security' ELSE 'maintainability' END AS category,
priority, file_path AS file_scope FROM f WHERE priority IN ('high', 'medium') ORDER BY CASE priority WHEN 'high' THEN 0 ELSE 1 END, file_path LIMIT 4"""


def smart_reasons(spark, sf):
    """P24, X13"""
    c = _chunks(spark, sf).withColumn("risk_area", F.when(F.col("chunk_index") < 4, F.col("risk_area")).otherwise("general"))
    reason = review_plan.smart_reason(F.col("risk_area"), F.col("file_path"))
    return c.select(reason.alias("reason"), review_plan.selection_rank(F.coalesce(reason, F.lit(""))).alias("rank"), review_plan.fallback_rank(F.col("risk_area"), F.col("file_path")).alias("fallback")).groupBy("reason", "rank", "fallback").agg(F.count("*").alias("n"))


REASONS_SQL = f"""WITH {C_SQL}, r AS (SELECT file_path, CASE WHEN chunk_index < 4 THEN risk_area ELSE 'general' END AS k FROM c),
x AS (SELECT CASE WHEN k <> 'general' THEN 'risk_area:' || k WHEN regexp_matches(file_path, '/(auth|db)/') THEN 'risk_path' END AS reason, CASE WHEN k <> 'general' THEN 0 WHEN regexp_matches(file_path, '/(auth|db)/') THEN 1 ELSE 3 END AS fallback FROM r)
SELECT reason, CASE reason WHEN 'risk_area:security' THEN 0 WHEN 'risk_path' THEN 1 WHEN 'risk_area:api' THEN 2 WHEN 'risk_area:database' THEN 3 WHEN 'risk_area:config' THEN 4 ELSE 10 END AS rank, fallback, count(*) AS n FROM x GROUP BY ALL"""


def scenario_verdict(spark, sf):
    """A31"""
    s = table(spark, sf, "lineitem").select(
        F.col("l_orderkey").alias("issue_id"), F.expr("CASE l_linenumber WHEN 1 THEN 'exploit' WHEN 2 THEN 'preserved_behavior' ELSE 'related_test' END").alias("kind"),
        F.expr("CASE WHEN l_partkey % 11 = 0 THEN 'skipped' WHEN l_linenumber = 1 AND l_partkey % 5 > 0 THEN 'failed' ELSE 'passed' END").alias("baseline_status"), F.expr("CASE WHEN l_suppkey % 7 = 0 THEN 'failed' ELSE 'passed' END").alias("patched_status"),
    )
    return review_plan.scenario_verdict(s)


VERDICT_SQL = """WITH s AS (SELECT l_orderkey AS issue_id, l_linenumber AS k, CASE WHEN l_partkey % 11 = 0 THEN 'skipped' WHEN l_linenumber = 1 AND l_partkey % 5 > 0 THEN 'failed' ELSE 'passed' END AS b, CASE WHEN l_suppkey % 7 = 0 THEN 'failed' ELSE 'passed' END AS p FROM lineitem),
g AS (SELECT issue_id, bool_or(b = 'skipped') OR NOT bool_or(k = 1) OR NOT bool_or(k = 2) OR bool_or(k = 1 AND b <> 'failed') OR bool_or(k = 2 AND b <> 'passed') AS u, bool_or(k <= 2 AND p <> 'passed') OR bool_or(k >= 3 AND b = 'passed' AND p = 'failed') AS x FROM s GROUP BY issue_id)
SELECT issue_id, CASE WHEN u THEN 'uncertain' WHEN x THEN 'unresolved' ELSE 'fixed' END AS verdict FROM g"""


def trace_stages(spark, sf):
    """G12, X28"""
    j = view(spark, sf, "v_jobs").select(F.col("id").alias("job_id"), "status", F.lit(1).alias("cloned"), (F.col("id") % 2).alias("files"), (F.col("id") % 3).alias("static_runs"), (F.col("id") % 4).alias("chunks"), (F.col("id") % 5).alias("ai_chunks"), F.when(F.col("status") == "COMPLETED", 1).otherwise(0).alias("reports"))
    return review_plan.trace_stages(j).groupBy("stage", "state").agg(F.count("*").alias("n"))


STAGES_SQL = duck_with("v_jobs") + """, c AS (SELECT status, unnest(['clone', 'structure', 'static', 'chunks', 'ai', 'report']) AS stage, unnest([1, id % 2, id % 3, id % 4, id % 5, CASE WHEN status = 'COMPLETED' THEN 1 ELSE 0 END]) AS n FROM v_jobs)
SELECT stage, CASE WHEN n > 0 THEN 'done' WHEN status = 'FAILED' THEN 'failed' WHEN status = 'AI_REVIEWING' AND stage = 'ai' THEN 'running' ELSE 'pending' END AS state, count(*) AS n FROM c GROUP BY ALL"""

QUERIES = {
    "files_to_review": (files_to_review, FILES_SQL),
    "coverage_probes": (coverage_probes, COVERAGE_SQL),
    "smart_reasons": (smart_reasons, REASONS_SQL),
    "scenario_verdict": (scenario_verdict, VERDICT_SQL),
    "trace_stages": (trace_stages, STAGES_SQL),
}
