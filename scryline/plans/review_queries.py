"""Queries of findings, coverage, dashboards, metrics and progress, with their DuckDB SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window, functions as F

from scryline.functions import scalars
from scryline.functions.text import lookup
from scryline.operators import chunking, findings, graph, greedy, ranges, reports, trace
from scryline.plans.adapters import CATEGORY, CLAIM, duck_with, table, view
from scryline.streaming import progress

KEY_SQL = """CASE c WHEN 'SQL Injection' THEN 'security:sql_injection' WHEN 'hardcoded_secret' THEN 'security:hardcoded_secret' WHEN 'n_1_query' THEN 'performance:n_plus_one_query' WHEN 'otp_leakage' THEN category || ':otp_exposure'
 WHEN 'bare_except' THEN 'bug:bare_except' WHEN 'ssrf_external_calls' THEN category || ':ssrf' ELSE category || ':unsafe_deserialization' END"""
I_SQL = duck_with("v_issues") + f",\ni AS (SELECT *, {KEY_SQL.replace('CASE c', 'CASE claim')} AS finding_key FROM v_issues)"
SEV = "CASE severity WHEN 'critical' THEN 0 WHEN 'high' THEN 1 WHEN 'medium' THEN 2 WHEN 'low' THEN 3 ELSE 4 END"
SRC = "CASE source WHEN 'KB' THEN 0 WHEN 'ai_review' THEN 1 WHEN 'secret_scanner' THEN 2 WHEN 'bandit' THEN 3 WHEN 'eslint' THEN 4 ELSE 5 END"
REP_ORDER = f"{SEV}, {SRC}, -coalesce(confidence, -1.0), issue_id"


def issues(spark: SparkSession, sf: str) -> DataFrame:
    return findings.with_finding_key(view(spark, sf, "v_issues"), "category", "claim", "claim")


RULES = "CASE l_partkey % 3 WHEN 0 THEN concat(' RC-W', CAST(l_partkey % 5 AS STRING), '-16 ') WHEN 1 THEN ' ' END"


def claim_normalize(spark, sf):
    """every issue's key, with the rule of its part where there is one."""
    v = table(spark, sf, "lineitem").select(F.expr(CATEGORY).alias("category"), F.expr(CLAIM).alias("claim"), F.expr(RULES).alias("rule_id"))
    return findings.with_finding_key(v, "category", "claim", "claim", "rule_id").groupBy("claim", "category", "rule_id", "finding_key").agg(F.count("*").alias("n"))


CLAIM_SQL = f"""WITH i AS (SELECT {CATEGORY} AS category, {CLAIM} AS claim, {RULES.replace('STRING', 'VARCHAR')} AS rule_id FROM lineitem)
SELECT claim, category, rule_id, CASE WHEN trim(coalesce(rule_id, '')) <> '' THEN 'roadmap:' || replace(lower(trim(rule_id)), '-', '_') ELSE {KEY_SQL.replace('CASE c', 'CASE claim')} END AS finding_key, count(*) AS n FROM i GROUP BY ALL"""


def occurrence_merge(spark, sf):
    """A04"""
    return findings.occurrences(issues(spark, sf)).select("job_id", "finding_key", "path", "line_start", "line_end", "raw", F.array_join("sources", ",").alias("sources"), "issue_id", "severity")


OCC_CTE = I_SQL + f""",
o AS (SELECT *, max(line_end) OVER (PARTITION BY job_id, finding_key, file_path ORDER BY line_start, line_end, issue_id ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS seen FROM i),
n AS (SELECT *, sum(CASE WHEN seen IS NULL OR line_start > seen THEN 1 ELSE 0 END) OVER (PARTITION BY job_id, finding_key, file_path ORDER BY line_start, line_end, issue_id ROWS UNBOUNDED PRECEDING) AS island FROM o),
r AS (SELECT *, row_number() OVER (PARTITION BY job_id, finding_key, file_path, island ORDER BY {REP_ORDER}) AS k FROM n),
occ AS (SELECT job_id, finding_key, file_path AS path, island, min(line_start) AS line_start, max(line_end) AS line_end, count(*) AS raw, string_agg(DISTINCT source, ',' ORDER BY source) AS sources, max(CASE WHEN k = 1 THEN issue_id END) AS issue_id, max(CASE WHEN k = 1 THEN severity END) AS severity FROM r GROUP BY ALL)"""
OCC_SQL = OCC_CTE + " SELECT job_id, finding_key, path, line_start, line_end, raw, sources, issue_id, severity FROM occ"


def finding_groups(spark, sf):
    """A26"""
    return findings.finding_groups(issues(spark, sf)).select("job_id", "finding_key", "occurrence_count", "raw_issue_count", F.array_join("affected_files", ",").alias("files"), "issue_id", "severity", "category", "source")


REPS = f"rep AS (SELECT *, row_number() OVER (PARTITION BY job_id, finding_key ORDER BY {REP_ORDER}) AS k FROM i QUALIFY k = 1)"
GROUPS_SQL = OCC_CTE + f""", {REPS},
g AS (SELECT job_id, finding_key, count(*) AS occurrence_count, CAST(sum(raw) AS BIGINT) AS raw_issue_count, string_agg(DISTINCT path, ',' ORDER BY path) AS files FROM occ GROUP BY ALL)
SELECT g.*, rep.issue_id, rep.severity, rep.category, rep.source FROM g JOIN rep USING (job_id, finding_key)"""


def representatives(spark, sf):
    """A05"""
    return findings.representatives(issues(spark, sf), ["job_id", "finding_key"], ["issue_id", "severity", "source"])


REPS_SQL = I_SQL + f", {REPS} SELECT job_id, finding_key, issue_id, severity, source FROM rep"
SEV_COUNTS = ", ".join(f"count(*) FILTER (WHERE severity = '{s}') AS {s}_count" for s in scalars.SEVERITIES)


def report_aggregate(spark, sf):
    """A03, A06"""
    return findings.report_aggregate(issues(spark, sf))


REPORT_SQL = I_SQL + f", {REPS}, a AS (SELECT job_id, {SEV_COUNTS}, count(*) AS total_findings FROM rep GROUP BY job_id) SELECT a.*, r.raw_issue_count FROM a JOIN (SELECT job_id, count(*) AS raw_issue_count FROM i GROUP BY job_id) r USING (job_id)"


def severity_counts(spark, sf):
    """A06"""
    return findings.severity_counts(issues(spark, sf), ["job_id"])


SEVERITY_SQL = I_SQL + f" SELECT job_id, {SEV_COUNTS}, count(*) AS total_findings FROM i GROUP BY job_id"


def category_zero_fill(spark, sf):
    """A24, A25"""
    return findings.zero_filled([*scalars.CATEGORIES, "unknown"], issues(spark, sf), "category")


ZERO_SQL = duck_with("v_issues") + """ SELECT CAST(d.ord AS INT) AS ord, d.category, count(i.issue_id) AS n FROM (VALUES (0, 'security'), (1, 'bug'), (2, 'performance'), (3, 'maintainability'), (4, 'requirement'), (5, 'style'), (6, 'unknown')) d(ord, category)
LEFT JOIN v_issues i ON i.category = d.category GROUP BY ALL"""


def source_counts(spark, sf):
    """A01, A02, P01"""
    return findings.issue_filter(issues(spark, sf), severity="high", path="M1").groupBy("source").agg(F.count("*").alias("n"))


SOURCES_SQL = duck_with("v_issues") + " SELECT source, count(*) AS n FROM v_issues WHERE severity = 'high' AND file_path ILIKE '%M1%' GROUP BY source"


def top_risky_files(spark, sf):
    """A07, G03"""
    return findings.top_risky_files(issues(spark, sf), ["job_id"])


CAT = "CASE category WHEN 'security' THEN 1 WHEN 'bug' THEN 2 WHEN 'performance' THEN 3 WHEN 'maintainability' THEN 4 WHEN 'requirement' THEN 5 ELSE 6 END"
RISKY = f"""f AS (SELECT job_id, file_path AS path, min({CAT}) AS p, min({SEV}) AS s, count(*) AS issue_count, min(issue_id) AS first FROM v_issues GROUP BY ALL),
risky AS (SELECT job_id, CAST(row_number() OVER (PARTITION BY job_id ORDER BY p, s, issue_count DESC, first) AS INT) AS rank, path, issue_count, CASE s WHEN 0 THEN 'critical' WHEN 1 THEN 'high' WHEN 2 THEN 'medium' WHEN 3 THEN 'low' ELSE 'info' END AS max_severity FROM f QUALIFY rank <= 5)"""
RISKY_SQL = duck_with("v_issues") + f", {RISKY} SELECT * FROM risky"


def issue_page(spark, sf):
    """The second page of findings by severity."""
    reps = findings.representatives(issues(spark, sf), ["job_id", "finding_key"], ["issue_id", "severity", "created_on"])
    return findings.page(reps, "severity", "created_on", descending=False, number=2, size=25, tie="issue_id").select("job_id", "finding_key", "issue_id", "severity")


PAGE_SQL = I_SQL + f", {REPS} SELECT job_id, finding_key, issue_id, severity FROM rep ORDER BY {SEV}, created_on, issue_id LIMIT 25 OFFSET 25"


def issue_group_having(spark, sf):
    """P12"""
    return findings.group_filter(severity="critical", source="ai_review", path="./src\\m7.py")(issues(spark, sf))


HAVING_SQL = I_SQL + f""", {REPS}, g AS (SELECT job_id, finding_key, count(*) AS raw_issue_count, bool_or(source IN ('ai_review', 'KB')) AS s, bool_or(contains(file_path, 'src/m7.py') OR contains('./src/m7.py', file_path)) AS p FROM i GROUP BY ALL)
SELECT g.job_id, g.finding_key, rep.severity, rep.category, g.raw_issue_count FROM g JOIN rep USING (job_id, finding_key) WHERE s AND p AND rep.severity = 'critical'"""


def dedupe_overlap(spark, sf):
    """W21"""
    return findings.dedupe_overlaps(issues(spark, sf).select("job_id", "finding_key", "file_path", "issue_id", "line_start", "line_end", "confidence"), ["job_id", "finding_key", "file_path"])


_SURER = "o.line_start > f.line_end OR coalesce(o.confidence, -1) > coalesce(f.confidence, -1)"
DEDUPE_SQL = I_SQL.replace("WITH ", "WITH RECURSIVE ", 1) + f""",
o AS (SELECT job_id, finding_key, file_path, issue_id, line_start, line_end, confidence, row_number() OVER (PARTITION BY job_id, finding_key, file_path ORDER BY line_start, coalesce(confidence, -1) DESC, issue_id) AS k FROM i),
f AS (SELECT *, 1 AS island FROM o WHERE k = 1 UNION ALL
      SELECT o.job_id, o.finding_key, o.file_path, {', '.join(f"CASE WHEN {_SURER} THEN o.{c} ELSE f.{c} END AS {c}" for c in ("issue_id", "line_start", "line_end", "confidence"))}, o.k, f.island + CASE WHEN o.line_start > f.line_end THEN 1 ELSE 0 END AS island
      FROM f JOIN o ON o.job_id = f.job_id AND o.finding_key = f.finding_key AND o.file_path = f.file_path AND o.k = f.k + 1)
SELECT job_id, finding_key, file_path, issue_id, line_start, line_end, confidence FROM f QUALIFY row_number() OVER (PARTITION BY job_id, finding_key, file_path, island ORDER BY k DESC) = 1"""


def _pieces(spark, sf):
    return view(spark, sf, "v_issues").select("job_id", "file_path", "issue_id", "line_start", "line_end", "severity")


def range_covered(spark, sf):
    """Are the seven lines from two after a file's first issue covered by its issues?"""
    p = _pieces(spark, sf)
    t = p.groupBy("job_id", "file_path").agg((F.min("line_start") + 2).alias("a")).select("job_id", "file_path", F.concat_ws(":", F.col("job_id").cast("string"), "file_path").alias("target"), "a", (F.col("a") + 6).alias("b"))
    return ranges.covered(t, p, ["job_id", "file_path"], "target")


COVERED_SQL = duck_with("v_issues") + """,
t AS (SELECT job_id || ':' || file_path AS target, min(line_start) + 2 AS a FROM v_issues GROUP BY job_id, file_path),
p AS (SELECT job_id || ':' || file_path AS target, line_start, line_end FROM v_issues),
l AS (SELECT target, unnest(range(a, a + 7)) AS n FROM t),
c AS (SELECT l.target, l.n, bool_or(p.target IS NOT NULL) AS hit FROM l LEFT JOIN p ON p.target = l.target AND l.n BETWEEN p.line_start AND p.line_end GROUP BY ALL)
SELECT target, bool_and(hit) AS covered FROM c GROUP BY target"""


def uncovered_gaps(spark, sf):
    """The lines of 1 to 230 that no issue of a file touches."""
    return ranges.gaps(_pieces(spark, sf).withColumn("total", F.lit(230)), ["job_id", "file_path"], "total").select("job_id", "file_path", "gap_start", "gap_end")


GAPS_SQL = duck_with("v_issues") + """,
o AS (SELECT job_id, file_path, line_start, line_end, coalesce(max(line_end) OVER (PARTITION BY job_id, file_path ORDER BY line_start, line_end ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS seen FROM v_issues)
SELECT job_id, file_path, seen + 1 AS gap_start, line_start - 1 AS gap_end FROM o WHERE line_start > seen + 1
UNION ALL SELECT job_id, file_path, max(line_end) + 1, 230 FROM v_issues GROUP BY job_id, file_path HAVING max(line_end) < 230"""


def overlap_join(spark, sf):
    """For each high issue, how many others of its file and job overlap it."""
    p = _pieces(spark, sf)
    q = p.where("severity = 'high'").select("job_id", "file_path", F.col("issue_id").alias("query_id"), F.col("line_start").alias("q_start"), F.col("line_end").alias("q_end"))
    return ranges.overlapping(q, p.select("job_id", "file_path", "issue_id", "line_start", "line_end"), ["job_id", "file_path"]).where("query_id <> issue_id").groupBy("query_id").agg(F.count("*").alias("n"))


OVERLAP_SQL = duck_with("v_issues") + " SELECT q.issue_id AS query_id, count(*) AS n FROM v_issues q JOIN v_issues p USING (job_id, file_path) WHERE q.severity = 'high' AND p.issue_id <> q.issue_id AND p.line_start <= q.line_end AND p.line_end >= q.line_start GROUP BY 1"


def overlap_bucketed(spark, sf):
    """J02 by cells of lines: the same question over whole files, whatever the job."""
    p = _pieces(spark, sf)
    q = p.where("severity = 'critical'").select("file_path", F.col("issue_id").alias("query_id"), F.col("line_start").alias("q_start"), F.col("line_end").alias("q_end"))
    return ranges.overlap_counts(q, p, ["file_path"], 16).groupBy("query_id").agg(F.sum("n").alias("n"))


BUCKETED_SQL = duck_with("v_issues") + " SELECT q.issue_id AS query_id, count(*) AS n FROM v_issues q JOIN v_issues p USING (file_path) WHERE q.severity = 'critical' AND p.line_start <= q.line_end AND p.line_end >= q.line_start GROUP BY 1"


def _windows(spark, sf):
    d = table(spark, sf, "documents").select(F.concat(F.lit("src/m"), (F.col("doc_id") % 50).cast("string"), F.lit(".py")).alias("file_path"), "doc_id", "text")
    return chunking.line_windows(d, ["file_path", "doc_id"], "text").select("file_path", (F.col("doc_id") * 1000 + F.col("chunk_index")).alias("chunk_index"), "line_start", "line_end", "content")


WINDOWS_SQL = """w0 AS (SELECT 'src/m' || (doc_id % 50) || '.py' AS file_path, doc_id, string_split(text, chr(10)) AS l0 FROM documents), w1 AS (SELECT file_path, doc_id, CASE WHEN l0[-1] = '' THEN l0[1:len(l0) - 1] ELSE l0 END AS l FROM w0),
w2 AS (SELECT file_path, doc_id, l, unnest(range(1, greatest(len(l) - 10, 1) + 1, 50)) AS s FROM w1 WHERE len(l) > 0),
w AS (SELECT file_path, doc_id * 1000 + (s - 1) // 50 AS chunk_index, s AS line_start, least(s + 59, len(l)) AS line_end, l[s:least(s + 59, len(l))] AS content FROM w2)"""


def containment_first(spark, sf):
    """The first chunk of their file that holds the first line of each issue."""
    q = _pieces(spark, sf).select("file_path", "issue_id", "line_start").withColumnRenamed("line_start", "line")
    return ranges.first_containing(q, _windows(spark, sf).drop("content"), ["file_path"], "issue_id", "line", ["line_start", "line_end"])


FIRST_SQL = duck_with("v_issues") + f", {WINDOWS_SQL}, h AS (SELECT i.issue_id, w.chunk_index, w.line_start, w.line_end, row_number() OVER (PARTITION BY i.issue_id ORDER BY w.chunk_index) AS k FROM v_issues i JOIN w ON w.file_path = i.file_path AND i.line_start BETWEEN w.line_start AND w.line_end) SELECT issue_id, chunk_index, CAST(line_start AS INT) AS line_start, CAST(line_end AS INT) AS line_end FROM h WHERE k = 1"


def static_semi(spark, sf):
    """Chunks that a critical security issue touches; issues of job 3 count for all files."""
    i = view(spark, sf, "v_issues").where("severity = 'critical' and category = 'security'").select(F.when(F.col("job_id") != 3, F.col("file_path")).alias("file_path"), "line_start", "line_end")
    return ranges.with_static_issues(_windows(spark, sf).drop("content"), i, "chunk_index").select("chunk_index")


STATIC_SQL = duck_with("v_issues") + f", {WINDOWS_SQL} SELECT DISTINCT w.chunk_index FROM w WHERE EXISTS (SELECT 1 FROM v_issues i WHERE i.severity = 'critical' AND i.category = 'security' AND (i.job_id = 3 OR i.file_path = w.file_path) AND w.line_start <= i.line_end AND w.line_end >= i.line_start)"


def source_snippet(spark, sf):
    """The lines around each issue, out of the chunks of its file."""
    w = _windows(spark, sf)
    q = _pieces(spark, sf).select("file_path", "issue_id", F.col("line_start").alias("q_start"), F.col("line_end").alias("q_end"))
    return ranges.snippet(w, q, ["file_path"], "issue_id").select("issue_id", F.col("first_line").cast("long").alias("first_line"), F.md5("snippet").alias("snippet_md5"))


SNIPPET_SQL = duck_with("v_issues") + f""", {WINDOWS_SQL},
q AS (SELECT issue_id, file_path, greatest(line_start - 3, 1) AS a, line_end + 3 AS b FROM v_issues),
x AS (SELECT q.issue_id, q.a, q.b, w.chunk_index, w.line_start AS s, unnest(w.content) AS t, generate_subscripts(w.content, 1) + w.line_start - 1 AS n FROM q JOIN w ON w.file_path = q.file_path AND w.line_start <= q.b AND w.line_end >= q.a),
y AS (SELECT issue_id, n, arg_max(t, chunk_index) AS t FROM x WHERE n BETWEEN a AND b GROUP BY ALL),
z AS (SELECT issue_id, min(n) AS lo, max(n) AS hi FROM y GROUP BY issue_id),
f AS (SELECT z.issue_id, z.lo, u.n FROM z, unnest(range(z.lo, z.hi + 1)) AS u(n))
SELECT f.issue_id, CAST(f.lo AS BIGINT) AS first_line, md5(string_agg(coalesce(y.t, ''), chr(10) ORDER BY f.n)) AS snippet_md5 FROM f LEFT JOIN y ON y.issue_id = f.issue_id AND y.n = f.n GROUP BY f.issue_id, f.lo"""


def _events(spark, sf):
    return table(spark, sf, "events")


def coverage_percent(spark, sf):
    """Users seen by clicks against those seen by purchases."""
    e = _events(spark, sf)
    row = ranges.coverage(e.where("event_type = 'purchase'").select("user_id"), e.where("event_type = 'click'").select("user_id"), ["user_id"])
    return row.select("expected", "reviewed", scalars.percent(F.col("reviewed"), F.col("expected")).alias("percent"), scalars.ratio(F.col("reviewed"), F.col("expected")).alias("ratio"))


PERCENT_SQL = """WITH e AS (SELECT DISTINCT user_id FROM events WHERE event_type = 'purchase'), r AS (SELECT DISTINCT user_id FROM events WHERE event_type = 'click'),
c AS (SELECT count(*) AS expected, count(r.user_id) AS reviewed FROM e LEFT JOIN r USING (user_id)) SELECT expected, reviewed, round_even(least(100.0, reviewed * 100.0 / expected), 1) AS percent, round_even(CAST(reviewed AS DOUBLE) / expected, 4) AS ratio FROM c"""


def coverage_anti(spark, sf):
    """The first 25 users and days with a purchase and without a click."""
    e = _events(spark, sf).withColumn("day", F.dayofyear("ts"))
    return ranges.missing(e.where("event_type = 'purchase'").select("user_id", "day"), e.where("event_type = 'click'").select("user_id", "day"), ["user_id", "day"])


ANTI_SQL = "WITH e AS (SELECT user_id, event_type, CAST(dayofyear(ts) AS INT) AS day FROM events) SELECT DISTINCT user_id, day FROM e p WHERE event_type = 'purchase' AND NOT EXISTS (SELECT 1 FROM e c WHERE c.user_id = p.user_id AND c.day = p.day AND c.event_type = 'click') ORDER BY user_id, day LIMIT 25"


def latest_status(spark, sf):
    """O02"""
    return reports.latest(_events(spark, sf).select("user_id", "event_type", "ts", "event_id"), ["user_id"], ["ts", "event_id"]).select("user_id", "event_type", "event_id")


LATEST_SQL = "SELECT user_id, arg_max(event_type, (ts, event_id)) AS event_type, arg_max(event_id, (ts, event_id)) AS event_id FROM events GROUP BY user_id"


def status_lag(spark, sf):
    """How each job's report compares with the one before it of the same repository (here: of ten)."""
    r = findings.severity_counts(issues(spark, sf), ["job_id"]).select("job_id", "total_findings")
    prev = F.lag("total_findings").over(Window.partitionBy(F.col("job_id") % 10).orderBy("job_id"))
    return r.withColumn("p", prev).select("job_id", F.when(F.col("p").isNull(), "unknown").when(F.col("total_findings") > F.col("p"), "up").when(F.col("total_findings") < F.col("p"), "down").otherwise("stable").alias("trend"))


LAG_SQL = duck_with("v_issues") + ", r AS (SELECT job_id, count(*) AS t FROM v_issues GROUP BY job_id), l AS (SELECT job_id, t, lag(t) OVER (PARTITION BY job_id % 10 ORDER BY job_id) AS p FROM r) SELECT job_id, CASE WHEN p IS NULL THEN 'unknown' WHEN t > p THEN 'up' WHEN t < p THEN 'down' ELSE 'stable' END AS trend FROM l"


def expired_jobs(spark, sf):
    """P09, A28"""
    j = reports.expired(view(spark, sf, "v_jobs"), ["COMPLETED", "FAILED"], F.lit("1996-06-30").cast("date"))
    return j.select("id", "status")


EXPIRED_SQL = duck_with("v_jobs") + " SELECT id, status FROM v_jobs WHERE status IN ('COMPLETED', 'FAILED') AND coalesce(completed_on, created_on) <= DATE '1996-06-30'"


def _reports(spark, sf):
    i = view(spark, sf, "v_issues")
    return findings.severity_counts(i, ["job_id"]).join(i.groupBy("job_id").agg(F.max("created_on").alias("created_on")), "job_id")


REPORTS_CTE = f"rp AS (SELECT job_id, {SEV_COUNTS}, count(*) AS total_findings, max(created_on) AS created_on FROM v_issues GROUP BY job_id)"


def risk_posture(spark, sf):
    """A20, A21"""
    return reports.risk_posture(view(spark, sf, "v_jobs"), view(spark, sf, "v_repos"), _reports(spark, sf), 12, 0)


POSTURE_SQL = duck_with("v_issues", "v_jobs", "v_repos") + f""", {REPORTS_CTE},
t AS (SELECT CAST(sum(critical_count) AS BIGINT) AS critical_count, CAST(sum(high_count) AS BIGINT) AS high_count, CAST(sum(total_findings) AS BIGINT) AS total_findings, count(*) AS report_count FROM rp),
j AS (SELECT count(*) FILTER (WHERE status = 'COMPLETED') AS c, count(*) FILTER (WHERE status = 'AI_REVIEWING') AS r FROM v_jobs), v AS (SELECT count(last_reviewed) AS repos_reviewed FROM v_repos)
SELECT CASE WHEN c = 0 AND r > 0 THEN 'running' WHEN c = 0 THEN 'pending' WHEN report_count = 0 THEN 'unavailable' WHEN critical_count > 0 THEN 'critical' WHEN high_count > 0 THEN 'high' WHEN report_count < 12 THEN 'unavailable' WHEN total_findings > 0 THEN 'attention' ELSE 'clear' END AS tone,
critical_count, high_count, total_findings, repos_reviewed, report_count FROM t, j, v"""


def codebase_health(spark, sf):
    """A22"""
    return reports.codebase_health(view(spark, sf, "v_repos"), _reports(spark, sf))


HEALTH_SQL = duck_with("v_issues", "v_repos") + f""", {REPORTS_CTE},
t AS (SELECT count(*) AS n, coalesce(sum(critical_count), 0) AS c, coalesce(sum(high_count), 0) AS h, coalesce(sum(medium_count), 0) AS m, coalesce(sum(low_count), 0) AS l FROM rp),
v AS (SELECT count(last_reviewed) AS reviewed, count(*) AS n FROM v_repos),
s AS (SELECT t.*, v.reviewed, v.n AS repositories, greatest(0, least(100, 100 - CASE WHEN v.n > 0 THEN floor((1 - v.reviewed / v.n) * 20 + 0.5) ELSE 0 END - c * 15 - h * 8 - m * 3 - l))::BIGINT AS score FROM t, v)
SELECT score, CASE WHEN n = 0 THEN 'unknown' WHEN c > 0 OR score < 40 THEN 'critical' WHEN h > 0 OR score < 70 THEN 'warning' ELSE 'healthy' END AS status, reviewed AS repos_reviewed, repositories FROM s"""


def quick_stats(spark, sf):
    """A23, X57"""
    j, r = view(spark, sf, "v_jobs"), _reports(spark, sf)
    row = reports.job_counts(j).crossJoin(reports.totals(r).select("total_findings", "critical_count")).crossJoin(reports.trend(r, "total_findings")).crossJoin(reports.primary_action(j, view(spark, sf, "v_repos"), r, 12))
    return row.select("jobs", "active", "total_findings", "critical_count", "trend", "label")


STATS_SQL = duck_with("v_issues", "v_jobs") + f""", {REPORTS_CTE}, o AS (SELECT total_findings AS t, row_number() OVER (ORDER BY created_on DESC, job_id DESC) AS k FROM rp), n AS (SELECT max(CASE WHEN k = 1 THEN t END) AS a, max(CASE WHEN k = 2 THEN t END) AS b FROM o)
SELECT (SELECT count(*) FROM v_jobs) AS jobs, (SELECT count(*) FROM v_jobs WHERE status IN ('PENDING', 'AI_REVIEWING')) AS active, (SELECT CAST(sum(total_findings) AS BIGINT) FROM rp) AS total_findings, (SELECT CAST(sum(critical_count) AS BIGINT) FROM rp) AS critical_count,
CASE WHEN a IS NULL OR b IS NULL THEN 'unknown' WHEN a > b THEN 'up' WHEN a < b THEN 'down' ELSE 'stable' END AS trend, 'View active reviews' AS label FROM n"""


def needs_attention(spark, sf):
    """O12"""
    return reports.needs_attention(view(spark, sf, "v_jobs"), _reports(spark, sf), findings.top_risky_files(issues(spark, sf), ["job_id"], 1), 3, limit=9)


ATTENTION_SQL = duck_with("v_issues", "v_jobs") + f""", {RISKY}, {REPORTS_CTE}, r4 AS (SELECT * FROM rp),
a AS (SELECT 1 AS section, row_number() OVER (ORDER BY critical_count DESC, created_on DESC, job_id) AS place, 'critical' AS tone, CAST(job_id AS VARCHAR) AS key, critical_count AS count FROM r4 WHERE critical_count > 0),
b AS (SELECT 2, row_number() OVER (ORDER BY high_count DESC, created_on DESC, job_id), 'high', CAST(job_id AS VARCHAR), high_count FROM r4 WHERE high_count > 0),
c AS (SELECT 3, row_number() OVER (ORDER BY coalesce(completed_on, created_on) DESC, id), 'failed', CAST(id AS VARCHAR), NULL FROM v_jobs WHERE status = 'FAILED'),
e AS (SELECT 5, row_number() OVER (ORDER BY issue_count DESC, path, job_id), 'file', job_id || ':' || path, issue_count FROM risky WHERE rank <= 1),
u AS (SELECT * FROM a UNION ALL SELECT * FROM b UNION ALL SELECT * FROM c UNION ALL SELECT 4, 1, 'report', 'report-load-failures', 3 UNION ALL SELECT * FROM e)
SELECT CAST(section AS INT) AS section, CAST(place AS INT) AS place, tone, key, CAST(count AS BIGINT) AS count FROM u ORDER BY section, place LIMIT 9"""


def timeline(spark, sf):
    """W09, J06"""
    return reports.timeline(view(spark, sf, "v_jobs"), _reports(spark, sf), "1998-08-02")


TIMELINE_SQL = duck_with("v_issues", "v_jobs") + f""", {REPORTS_CTE},
e AS (SELECT id, CASE status WHEN 'COMPLETED' THEN 'review_completed' WHEN 'FAILED' THEN 'review_failed' WHEN 'PENDING' THEN 'review_queued' ELSE 'review_running' END AS type, CASE WHEN status IN ('COMPLETED', 'FAILED') THEN coalesce(completed_on, created_on) ELSE created_on END AS day FROM v_jobs),
t AS (SELECT * FROM e ORDER BY day DESC, id LIMIT 8), l AS (SELECT *, CASE WHEN day = DATE '1998-08-02' THEN 'Today' WHEN day = DATE '1998-08-01' THEN 'Yesterday' ELSE strftime(day, '%Y-%m-%d') END AS label FROM t),
g AS (SELECT *, CASE WHEN label = lag(label) OVER (ORDER BY day DESC, id) THEN 0 ELSE 1 END AS o FROM l)
SELECT g.id, type, label, CAST(sum(o) OVER (ORDER BY day DESC, g.id ROWS UNBOUNDED PRECEDING) AS BIGINT) AS run, coalesce(rp.total_findings, 0) AS findings FROM g LEFT JOIN rp ON rp.job_id = g.id"""


def recent_reviews(spark, sf):
    """O11, J05, J06, J20"""
    return reports.with_repository(reports.with_reports(reports.recent_completed(view(spark, sf, "v_jobs")), _reports(spark, sf)), view(spark, sf, "v_repos")).select("id", "repository_name", "total_findings", "href")


RECENT_SQL = duck_with("v_issues", "v_jobs") + f""", {REPORTS_CTE}, t AS (SELECT * FROM v_jobs WHERE status = 'COMPLETED' ORDER BY coalesce(completed_on, created_on) DESC, id LIMIT 12)
SELECT t.id, coalesce(c_name, CAST(t.repository_id AS VARCHAR)) AS repository_name, rp.total_findings, '/reviews/' || t.id || CASE WHEN rp.job_id IS NULL THEN '' ELSE '/report' END AS href FROM t LEFT JOIN rp ON rp.job_id = t.id LEFT JOIN customer ON c_custkey = t.repository_id"""


def latest_report(spark, sf):
    """J07, X58"""
    return reports.latest_report(view(spark, sf, "v_jobs"), _reports(spark, sf), F.col("total_findings") > 0)


LATEST_REPORT_SQL = duck_with("v_issues", "v_jobs") + f", {REPORTS_CTE} SELECT j.id, rp.total_findings FROM v_jobs j JOIN rp ON rp.job_id = j.id ORDER BY coalesce(completed_on, j.created_on) DESC, j.id LIMIT 1"


def retrieval_metrics(spark, sf):
    """Documents of a language ranked by length, good ones expected; queries are sources."""
    d = table(spark, sf, "documents").select("doc_id", "source", "lang", "n_chars")
    ranked = d.withColumn("rank", F.row_number().over(Window.partitionBy("source").orderBy(F.desc("n_chars"), "doc_id"))).where("rank <= 10").select(F.col("source").alias("query"), F.col("doc_id").alias("item"), "rank")
    good = table(spark, sf, "labels").where("quality = 0").select("doc_id").join(d, "doc_id").select(F.col("source").alias("query"), F.col("doc_id").alias("item"))
    ms = d.groupBy(F.col("source").alias("query")).agg(F.sum("n_chars").alias("ms"))
    out = trace.first_rank(ranked, good, "query", "item").join(ms, "query").withColumn("run", F.lit("r"))
    return trace.retrieval_summary(out, ["run"]).select("run", *[F.round(c, 6).alias(c) for c in ("recall_5", "recall_10", "mrr_10")], "p50", "p95")


METRICS_SQL = """
WITH r AS (SELECT source AS query, doc_id, row_number() OVER (PARTITION BY source ORDER BY n_chars DESC, doc_id) AS rank FROM documents QUALIFY rank <= 10),
g AS (SELECT DISTINCT source AS query, doc_id FROM documents JOIN labels USING (doc_id) WHERE quality = 0), m AS (SELECT source AS query, sum(n_chars) AS ms FROM documents GROUP BY source),
f AS (SELECT q.query, min(r.rank) AS rank FROM (SELECT DISTINCT query FROM g) q LEFT JOIN (SELECT r.* FROM r JOIN g USING (query, doc_id)) r ON r.query = q.query GROUP BY q.query),
x AS (SELECT f.*, m.ms, row_number() OVER (ORDER BY m.ms) - 1 AS k, count(*) OVER () AS n FROM f JOIN m USING (query))
SELECT 'r' AS run, round(avg(CASE WHEN coalesce(rank, 99) <= 5 THEN 1.0 ELSE 0.0 END), 6) AS recall_5, round(avg(CASE WHEN coalesce(rank, 99) <= 10 THEN 1.0 ELSE 0.0 END), 6) AS recall_10, round(avg(coalesce(1.0 / rank, 0.0)), 6) AS mrr_10,
CAST(max(CASE WHEN k = round_even((n - 1) * 50 / 100.0, 0) THEN ms END) AS BIGINT) AS p50, CAST(max(CASE WHEN k = round_even((n - 1) * 95 / 100.0, 0) THEN ms END) AS BIGINT) AS p95 FROM x"""


EXPECTED = "severity = 'high' and job_id % 50 = 0"


def _expected(v: DataFrame) -> tuple[DataFrame, DataFrame]:
    """All findings, and the expected ones of every fiftieth job."""
    f = v.select(F.col("issue_id").alias("finding_id"), F.col("finding_key").alias("probe_id"), "file_path", "line_start", "line_end", F.col("claim").alias("claim_type"), "category", F.array().cast("array<struct<file_path:string,line_start:int,line_end:int>>").alias("evidence"))
    e = v.where(EXPECTED).select(F.col("issue_id").alias("expected_id"), F.array("finding_key", F.lit("other")).alias("expected_probes"), F.regexp_replace("file_path", "^src/", "").alias("file_path"), "line_start", "line_end", F.when(F.col("line_start") % 2 == 0, F.col("claim")).alias("claim_type"), "category")
    return f, e


def expected_match(spark, sf):
    """All findings against the expected ones of every fiftieth job."""
    return trace.finding_matches(*_expected(issues(spark, sf)))


EXPECTED_SQL = I_SQL + """ SELECT DISTINCT f.issue_id AS finding_id, e.issue_id AS expected_id FROM i f JOIN i e ON f.finding_key = e.finding_key AND f.category = e.category AND f.file_path = e.file_path AND f.line_start <= e.line_end AND f.line_end >= e.line_start
WHERE e.job_id % 50 = 0 AND e.severity = 'high' AND (e.line_start % 2 = 1 OR f.claim = e.claim)"""


def evaluation(spark, sf):
    """A16, A17, U05"""
    v = issues(spark, sf)
    f, e = _expected(v)
    return trace.evaluation_of(f, e, *trace.match_counts(f, e), v.where("category = 'style'").select(F.col("issue_id").alias("finding_id")))


EVALUATION_SQL = I_SQL + f""", m AS ({EXPECTED_SQL[len(I_SQL):]}), f AS (SELECT DISTINCT issue_id AS id FROM i), u AS (SELECT finding_id AS id FROM m UNION SELECT issue_id FROM i WHERE category = 'style'),
p AS (SELECT expected_id, count(*) AS n FROM m GROUP BY 1), x AS (SELECT count(DISTINCT issue_id) AS expected FROM i WHERE job_id % 50 = 0 AND severity = 'high')
SELECT x.expected, (SELECT count(*) FROM p) AS found, (SELECT CAST(coalesce(sum(n - 1), 0) AS BIGINT) FROM p) AS duplicates, (SELECT count(*) FROM f WHERE id NOT IN (SELECT id FROM u)) AS out_of_scope, (SELECT count(*) FROM f) AS findings, CASE WHEN x.expected > 0 THEN round_even(CAST((SELECT count(*) FROM p) AS DOUBLE) / x.expected, 4) ELSE 0.0 END AS recall FROM x"""


def lane_metrics(spark, sf):
    """A11, A12"""
    return trace.lane_metrics(view(spark, sf, "v_traces").withColumn("result_count", F.lit(2)))


LANES_SQL = duck_with("v_traces") + " SELECT lane, count(*) AS calls, CAST(sum(CASE WHEN sent = 0 THEN 2 ELSE sent END) AS BIGINT) AS sent, CAST(sum(tokens) AS BIGINT) AS tokens, count(DISTINCT job_id) AS jobs FROM v_traces GROUP BY lane"


def tool_metrics(spark, sf):
    """A13"""
    t = view(spark, sf, "v_traces").select("tool", F.col("sent").alias("findings"), (F.col("event_id") % 5 == 0).cast("int").alias("exit_code"))
    return trace.tool_metrics(t)


TOOLS_SQL = duck_with("v_traces") + " SELECT tool, count(*) AS runs, CAST(sum(sent) AS BIGINT) AS findings, count(*) FILTER (WHERE event_id % 5 = 0) AS failed FROM v_traces GROUP BY tool"


def contract_check(spark, sf):
    """Users who purchased are asked for, those who viewed answer, by lane."""
    t = view(spark, sf, "v_traces")
    return trace.contract(t.where("tool = 'purchase'").select("lane", "job_id").distinct(), t.where("tool = 'view'"), ["lane"], "job_id")


CONTRACT_SQL = duck_with("v_traces") + """, q AS (SELECT lane, job_id FROM v_traces WHERE tool = 'purchase' GROUP BY ALL), r AS (SELECT lane, job_id, count(*) AS n FROM v_traces WHERE tool = 'view' GROUP BY ALL)
SELECT coalesce(q.lane, r.lane) AS lane, count(*) FILTER (WHERE r.job_id IS NULL) AS missing, CAST(coalesce(sum(CASE WHEN q.job_id IS NOT NULL THEN greatest(r.n - 1, 0) END), 0) AS BIGINT) AS duplicate, count(*) FILTER (WHERE q.job_id IS NULL) AS unknown FROM q FULL JOIN r ON q.lane = r.lane AND q.job_id = r.job_id GROUP BY 1"""


def positional_pairs(spark, sf):
    """The i-th click of a user with the i-th purchase."""
    t = view(spark, sf, "v_traces").select("job_id", "ts", "event_id", "tool")
    return trace.positional_join(t.where("tool = 'click'"), t.where("tool = 'purchase'"), ["job_id"], ["ts", "event_id"]).select("job_id", "place", "event_id", "r_event_id")


POSITIONAL_SQL = duck_with("v_traces") + """, n AS (SELECT job_id, tool, event_id, CAST(row_number() OVER (PARTITION BY job_id, tool ORDER BY ts, event_id) AS INT) AS place FROM v_traces)
SELECT a.job_id, a.place, a.event_id, b.event_id AS r_event_id FROM n a LEFT JOIN n b ON b.tool = 'purchase' AND b.job_id = a.job_id AND b.place = a.place WHERE a.tool = 'click'"""


def session_latest(spark, sf):
    """A36"""
    return trace.latest_session(view(spark, sf, "v_traces").withColumn("when", F.struct("ts", "event_id")), "lane", "when").groupBy("lane", "tool").agg(F.count("*").alias("n"))


SESSION_SQL = duck_with("v_traces") + " SELECT lane, tool, count(*) AS n FROM v_traces WHERE lane = (SELECT arg_max(lane, (ts, event_id)) FROM v_traces) GROUP BY ALL"


def worst_status(spark, sf):
    """A29"""
    return trace.worst_status(view(spark, sf, "v_issues"), ["job_id", "file_path"], "severity", ["info", "low", "medium", "high", "critical"])


WORST_SQL = duck_with("v_issues") + f" SELECT job_id, file_path, arg_min(severity, {SEV}) AS severity FROM v_issues GROUP BY ALL"


def smart_chunk_plan(spark, sf):
    """W07, A10"""
    c = view(spark, sf, "v_issues").groupBy("job_id", "file_path", F.col("line_start").alias("chunk_index")).agg(F.min(scalars.severity_order(F.col("severity"))).alias("s"))
    c = c.select("job_id", "file_path", "chunk_index", F.when(F.col("s") <= 1, F.col("s")).alias("reason_rank"), F.col("s").alias("fallback_rank"))
    return greedy.smart_plan(c, 12, per_file=2, files=14).select("job_id", "file_path", "chunk_index", "why")


SMART_SQL = duck_with("v_issues") + f""",
c AS (SELECT job_id, file_path, line_start AS chunk_index, min({SEV}) AS s FROM v_issues GROUP BY ALL), d AS (SELECT *, CASE WHEN s <= 1 THEN s END AS rr, count(*) OVER (PARTITION BY job_id) <= 12 AS fits FROM c),
f AS (SELECT *, row_number() OVER (PARTITION BY job_id, file_path ORDER BY rr NULLS LAST, chunk_index) AS f FROM d), r AS (SELECT *, row_number() OVER (PARTITION BY job_id ORDER BY rr, file_path, chunk_index) AS k FROM f WHERE rr IS NOT NULL AND f <= 2 QUALIFY k <= 12),
nf AS (SELECT job_id, count(DISTINCT file_path) AS n FROM r GROUP BY job_id),
b AS (SELECT *, row_number() OVER (PARTITION BY job_id, file_path ORDER BY s, chunk_index) AS g FROM d WHERE NOT EXISTS (SELECT 1 FROM r WHERE r.job_id = d.job_id AND r.file_path = d.file_path) QUALIFY g = 1),
a AS (SELECT b.*, row_number() OVER (PARTITION BY b.job_id ORDER BY s, file_path) AS m FROM b)
SELECT job_id, file_path, chunk_index, 'all' AS why FROM d WHERE fits UNION ALL SELECT job_id, file_path, chunk_index, 'reason' FROM r WHERE NOT fits
UNION ALL SELECT a.job_id, file_path, chunk_index, 'breadth' FROM a LEFT JOIN nf USING (job_id) WHERE NOT fits AND m <= 14 - coalesce(nf.n, 0)"""


def trim_budget(spark, sf):
    """30 seats for each job; probes are categories."""
    v = view(spark, sf, "v_issues").select("job_id", F.col("category").alias("probe_id"), "file_path", "issue_id", "confidence", "source", "severity")
    place = F.row_number().over(Window.partitionBy("job_id", "probe_id").orderBy(F.desc("confidence"), "issue_id"))
    rank = scalars.trim_rank(F.col("probe_id"), F.lit("high"))
    rows = v.withColumn("place", place).withColumn("bundle_ord", lookup({c: i for i, c in enumerate(scalars.CATEGORIES)}, F.col("probe_id"))).withColumn("structural", F.col("source") == "bandit").withColumn("rank", rank).withColumn("score", F.col("confidence")).withColumn("chunk_index", F.col("issue_id"))
    return greedy.trim_to_budget(rows, 30).select("job_id", "seat", "phase", "issue_id")


TRIM_SQL = duck_with("v_issues") + """,
p AS (SELECT *, row_number() OVER (PARTITION BY job_id, category ORDER BY confidence DESC, issue_id) AS place, CASE category WHEN 'security' THEN 0 WHEN 'bug' THEN 1 WHEN 'performance' THEN 2 WHEN 'maintainability' THEN 3 WHEN 'requirement' THEN 4 ELSE 5 END AS b,
             CASE category WHEN 'security' THEN 7 WHEN 'bug' THEN 6 WHEN 'performance' THEN 5 WHEN 'style' THEN 3 ELSE 4 END AS rank FROM v_issues),
n AS (SELECT *, row_number() OVER (PARTITION BY job_id, category, source = 'bandit' ORDER BY place) AS n FROM p), f AS (SELECT *, CASE WHEN place = 1 THEN 1 WHEN source = 'bandit' AND n <= 2 THEN 2 ELSE 3 END AS phase FROM n)
SELECT job_id, CAST(row_number() OVER (PARTITION BY job_id ORDER BY phase, CASE WHEN phase < 3 THEN b END NULLS LAST, CASE WHEN phase < 3 THEN place END NULLS LAST, rank DESC, confidence DESC, category DESC, file_path DESC, issue_id DESC) AS INT) AS seat, CAST(phase AS INT) AS phase, issue_id FROM f QUALIFY seat <= 30"""


def audit_bundles(spark, sf):
    """W22"""
    v = view(spark, sf, "v_issues")
    c = v.select("job_id", "file_path", F.col("line_start").alias("chunk_index")).distinct()
    return greedy.audit_bundles(c, v.where("severity = 'critical'").select("job_id", "file_path", F.col("line_start").alias("chunk_index"))).select("job_id", "bundle_id", "file_path", "chunk_index")


AUDIT_SQL = duck_with("v_issues") + """, c AS (SELECT DISTINCT job_id, file_path, line_start AS chunk_index FROM v_issues), a AS (SELECT DISTINCT job_id, file_path, line_start AS chunk_index FROM v_issues WHERE severity = 'critical'),
l AS (SELECT c.*, row_number() OVER (PARTITION BY job_id, file_path ORDER BY chunk_index) AS k FROM c ANTI JOIN a USING (job_id, file_path, chunk_index))
SELECT job_id, 'coverage.full_audit.' || left(sha256(file_path), 12) || '.' || ((k - 1) // 6) AS bundle_id, file_path, chunk_index FROM l"""


def components(spark, sf):
    """Suppliers that share a part's first issue are one component."""
    m = view(spark, sf, "v_issues").where("severity = 'critical' and category = 'security'").select("job_id", F.concat_ws(":", "file_path", F.col("line_start").cast("string")).alias("via"))
    return graph.shared_components(m, "job_id", "via")


COMPONENTS_SQL = duck_with("v_issues").replace("WITH ", "WITH RECURSIVE ", 1) + """,
m AS (SELECT DISTINCT job_id, file_path || ':' || line_start AS via FROM v_issues WHERE severity = 'critical' AND category = 'security'),
e AS (SELECT DISTINCT a.job_id AS a, b.job_id AS b FROM m a JOIN m b USING (via)), w(node, reach) AS (SELECT a, b FROM e UNION SELECT w.node, e.b FROM w JOIN e ON e.a = w.reach)
SELECT node AS job_id, min(reach) AS component FROM w GROUP BY node"""


def progress_fold(spark, sf):
    """The batch twin of the streaming fold."""
    e = table(spark, sf, "events").select("user_id", "event_id", "ts", F.when(F.col("event_type") == "signup", "CLONING").when(F.col("event_type") == "purchase", "COMPLETED").when(F.col("event_type") == "error", "FAILED").otherwise("AI_REVIEWING").alias("status"), (F.col("event_id") % 101).alias("progress"))
    s = progress.job_states(e, job="user_id", when="ts")
    return s.select("user_id", "status", "progress", F.date_format("started_at", "yyyy-MM-dd HH:mm:ss").alias("started_at"), F.date_format("ended_at", "yyyy-MM-dd HH:mm:ss").alias("ended_at"), "events")


FOLD_CTE = "e AS (SELECT user_id, event_id, ts, CASE event_type WHEN 'signup' THEN 'CLONING' WHEN 'purchase' THEN 'COMPLETED' WHEN 'error' THEN 'FAILED' ELSE 'AI_REVIEWING' END AS status, event_id % 101 AS progress FROM events)"
FOLD_SQL = f"WITH {FOLD_CTE} SELECT user_id, arg_max(status, (ts, event_id)) AS status, arg_max(progress, (ts, event_id)) AS progress, strftime(min(CASE WHEN status = 'CLONING' THEN ts END), '%Y-%m-%d %H:%M:%S') AS started_at, strftime(min(CASE WHEN status IN ('COMPLETED', 'FAILED') THEN ts END), '%Y-%m-%d %H:%M:%S') AS ended_at, count(*) AS events FROM e GROUP BY user_id"


def forward_until_terminal(spark, sf):
    """The batch twin of the forwarding stream."""
    e = table(spark, sf, "events").select("user_id", "event_id", "ts", F.when(F.col("event_type") == "purchase", "COMPLETED").when(F.col("event_type") == "error", "FAILED").otherwise("AI_REVIEWING").alias("status"))
    return progress.until_terminal(e, job="user_id", when="ts").select("user_id", "event_id", "status")


FORWARD_SQL = """WITH e AS (SELECT user_id, event_id, ts, CASE event_type WHEN 'purchase' THEN 'COMPLETED' WHEN 'error' THEN 'FAILED' ELSE 'AI_REVIEWING' END AS status FROM events),
x AS (SELECT user_id, min((ts, event_id)) AS last FROM e WHERE status IN ('COMPLETED', 'FAILED') GROUP BY user_id) SELECT e.user_id, e.event_id, e.status FROM e LEFT JOIN x USING (user_id) WHERE x.last IS NULL OR (e.ts, e.event_id) <= x.last"""


def rate_limit(spark, sf):
    """Here three requests a day and user; the window begins at its first request."""
    return progress.rate_limited(table(spark, sf, "events").select("user_id", "event_id", "ts"), limit=3, seconds=86_400).select("user_id", "event_id", "allowed", "retry_after")


RATE_SQL = """WITH RECURSIVE o AS (SELECT user_id, event_id, ts, row_number() OVER (PARTITION BY user_id ORDER BY ts, event_id) AS k FROM events),
f AS (SELECT user_id, event_id, ts, k, ts AS b, 1 AS n FROM o WHERE k = 1 UNION ALL SELECT o.user_id, o.event_id, o.ts, o.k, CASE WHEN epoch_us(o.ts) - epoch_us(f.b) >= 86400000000 THEN o.ts ELSE f.b END, CASE WHEN epoch_us(o.ts) - epoch_us(f.b) >= 86400000000 THEN 1 ELSE f.n + 1 END FROM f JOIN o ON o.user_id = f.user_id AND o.k = f.k + 1)
SELECT user_id, event_id, n <= 3 AS allowed, CASE WHEN n <= 3 THEN 0 ELSE (86400000000 - (epoch_us(ts) - epoch_us(b))) // 1000000 END AS retry_after FROM f"""


def review_progress(spark, sf):
    """G02, T06"""
    d, t = (F.col("event_id") % 13), (F.col("event_id") % 11)
    return table(spark, sf, "events").select("event_id", scalars.review_progress(d, t).alias("progress"))


PROGRESS_SQL = "SELECT event_id, CAST(CASE WHEN event_id % 11 <= 0 OR event_id % 13 <= 0 THEN 50 ELSE least(92, 50 + greatest(1, least(event_id % 13, event_id % 11) * 42 // (event_id % 11))) END AS INT) AS progress FROM events"


QUERIES = {
    "claim_normalize": (claim_normalize, CLAIM_SQL),
    "occurrence_merge": (occurrence_merge, OCC_SQL),
    "finding_groups": (finding_groups, GROUPS_SQL),
    "representatives": (representatives, REPS_SQL),
    "report_aggregate": (report_aggregate, REPORT_SQL),
    "severity_counts": (severity_counts, SEVERITY_SQL),
    "category_zero_fill": (category_zero_fill, ZERO_SQL),
    "source_counts": (source_counts, SOURCES_SQL),
    "top_risky_files": (top_risky_files, RISKY_SQL),
    "issue_page": (issue_page, PAGE_SQL),
    "issue_group_having": (issue_group_having, HAVING_SQL),
    "dedupe_overlap": (dedupe_overlap, DEDUPE_SQL),
    "range_covered": (range_covered, COVERED_SQL),
    "uncovered_gaps": (uncovered_gaps, GAPS_SQL),
    "overlap_join": (overlap_join, OVERLAP_SQL),
    "overlap_bucketed": (overlap_bucketed, BUCKETED_SQL),
    "containment_first": (containment_first, FIRST_SQL),
    "static_semi": (static_semi, STATIC_SQL),
    "source_snippet": (source_snippet, SNIPPET_SQL),
    "coverage_percent": (coverage_percent, PERCENT_SQL),
    "coverage_anti": (coverage_anti, ANTI_SQL),
    "latest_status": (latest_status, LATEST_SQL),
    "status_lag": (status_lag, LAG_SQL),
    "expired_jobs": (expired_jobs, EXPIRED_SQL),
    "risk_posture": (risk_posture, POSTURE_SQL),
    "codebase_health": (codebase_health, HEALTH_SQL),
    "quick_stats": (quick_stats, STATS_SQL),
    "needs_attention": (needs_attention, ATTENTION_SQL),
    "timeline": (timeline, TIMELINE_SQL),
    "recent_reviews": (recent_reviews, RECENT_SQL),
    "latest_report": (latest_report, LATEST_REPORT_SQL),
    "retrieval_metrics": (retrieval_metrics, METRICS_SQL),
    "expected_match": (expected_match, EXPECTED_SQL),
    "evaluation": (evaluation, EVALUATION_SQL),
    "lane_metrics": (lane_metrics, LANES_SQL),
    "tool_metrics": (tool_metrics, TOOLS_SQL),
    "contract_check": (contract_check, CONTRACT_SQL),
    "positional_pairs": (positional_pairs, POSITIONAL_SQL),
    "session_latest": (session_latest, SESSION_SQL),
    "worst_status": (worst_status, WORST_SQL),
    "smart_chunk_plan": (smart_chunk_plan, SMART_SQL),
    "trim_budget": (trim_budget, TRIM_SQL),
    "audit_bundles": (audit_bundles, AUDIT_SQL),
    "components": (components, COMPONENTS_SQL),
    "progress_fold": (progress_fold, FOLD_SQL),
    "forward_until_terminal": (forward_until_terminal, FORWARD_SQL),
    "rate_limit": (rate_limit, RATE_SQL),
    "review_progress": (review_progress, PROGRESS_SQL),
}

