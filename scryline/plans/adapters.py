"""Views of the driver's tables as review data: integer and string expressions that any SQL engine can repeat.

Each view is one SELECT in SQL that both engines understand, except where a function's name differs; then the DuckDB
text is derived by the replacements in DUCK.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

SEVERITY = "CASE l_linenumber % 5 WHEN 0 THEN 'critical' WHEN 1 THEN 'high' WHEN 2 THEN 'medium' WHEN 3 THEN 'low' ELSE 'info' END"
CATEGORY = "CASE l_partkey % 6 WHEN 0 THEN 'security' WHEN 1 THEN 'bug' WHEN 2 THEN 'performance' WHEN 3 THEN 'maintainability' WHEN 4 THEN 'requirement' ELSE 'style' END"
SOURCE = "CASE l_orderkey % 6 WHEN 0 THEN 'KB' WHEN 1 THEN 'ai_review' WHEN 2 THEN 'secret_scanner' WHEN 3 THEN 'bandit' WHEN 4 THEN 'eslint' ELSE 'ruff' END"
CLAIM = "CASE l_partkey % 7 WHEN 0 THEN 'SQL Injection' WHEN 1 THEN 'hardcoded_secret' WHEN 2 THEN 'n_1_query' WHEN 3 THEN 'otp_leakage' WHEN 4 THEN 'bare_except' WHEN 5 THEN 'ssrf_external_calls' ELSE 'pickle_deserialization' END"
CENTS = "CAST(round({} * 100) AS BIGINT)"

VIEWS = {
    "v_issues": f"""
SELECT md5(concat_ws('|', l_orderkey, l_partkey, l_suppkey, l_linenumber, {CENTS.format('l_quantity')}, {CENTS.format('l_extendedprice')}, {CENTS.format('l_discount')},
           {CENTS.format('l_tax')}, l_returnflag, l_linestatus, CAST(CAST(l_shipdate AS DATE) AS STRING))) AS issue_id,
       l_suppkey AS job_id, concat('src/m', CAST(l_partkey % 50 AS STRING), '.py') AS file_path, CAST(l_partkey % 200 + 1 AS INT) AS line_start,
       CAST(l_partkey % 200 + 1 + CAST(l_quantity AS INT) % 15 AS INT) AS line_end, {SEVERITY} AS severity, {CATEGORY} AS category, {SOURCE} AS source,
       l_discount * 10 AS confidence, {CLAIM} AS claim, CAST(l_shipdate AS DATE) AS created_on
FROM lineitem""",
    "v_jobs": """
SELECT o_orderkey AS id, o_custkey AS repository_id, CASE WHEN o_orderstatus = 'F' AND o_orderkey % 10 = 9 THEN 'FAILED' WHEN o_orderstatus = 'F' THEN 'COMPLETED' WHEN o_orderstatus = 'O' THEN 'AI_REVIEWING' ELSE 'PENDING' END AS status,
       CAST(o_orderdate AS DATE) AS created_on, CASE WHEN o_orderstatus = 'F' AND o_orderkey % 3 > 0 THEN CAST(o_orderdate AS DATE) END AS completed_on, o_totalprice AS cost
FROM orders""",
    "v_repos": "SELECT c_custkey AS id, c_name AS name, CASE WHEN c_custkey % 4 > 0 THEN c_acctbal END AS last_reviewed FROM customer",
    "v_traces": """
SELECT event_id, user_id AS job_id, event_type AS tool, ts, CAST(floor(value) AS BIGINT) AS tokens, CASE event_id % 3 WHEN 0 THEN 'defect' WHEN 1 THEN 'coverage' ELSE 'roadmap' END AS lane, event_id % 7 AS sent
FROM events""",
}

#: Spark's words and DuckDB's.
DUCK = [(" AS STRING)", " AS VARCHAR)")]


def duck(name: str) -> str:
    """`name AS (SELECT ...)` for a WITH clause of DuckDB."""
    text = VIEWS[name]
    for a, b in DUCK:
        text = text.replace(a, b)
    return f"{name} AS ({text})"


def duck_with(*names: str) -> str:
    return "WITH " + ",\n".join(duck(n) for n in names)


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def view(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    text = VIEWS[name]
    source = text.rsplit("FROM ", 1)[1].strip()
    return spark.sql(text.rsplit("FROM ", 1)[0] + "FROM {source}", source=table(spark, sf_dir, source))
