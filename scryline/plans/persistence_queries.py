"""Queries from a probe's candidates to what is kept and shown of it, with their DuckDB SQL."""

from __future__ import annotations

from pyspark.sql import functions as F

from scryline.operators import persistence
from scryline.plans.adapters import duck_with, table, view
from scryline.plans.flow_queries import BUNDLES_SQL, lane_bundles


def retrieved_probes(spark, sf):
    """issues' sources as strategies of the jobs' probes; every third job asks for one file, some chunks are excluded."""
    v = view(spark, sf, "v_issues")
    strategy = F.when(F.col("source") == "ai_review", "semantic").when(F.col("source") == "KB", "bm25").when(F.col("source") == "bandit", "structural").when(F.col("source") == "eslint", "file_scope").otherwise("exact")
    c = v.select(F.col("job_id").cast("string").alias("probe_id"), strategy.alias("strategy"), "file_path", F.col("line_start").alias("chunk_index"), F.col("confidence").alias("score"), (F.col("line_start") % 4 / 10.0).alias("path_score"), (F.col("confidence") / 10).alias("semantic_score"), F.lit(0.5).alias("lexical_score"))
    p = v.groupBy("job_id").agg(F.min("claim").alias("query")).select(F.col("job_id").cast("string").alias("probe_id"), F.when(F.col("job_id") % 2 == 0, "security").otherwise("bug").alias("category"), "query", (F.col("job_id") % 12).cast("int").alias("top_k"), F.when(F.col("job_id") % 3 == 0, "src/m7.py").when(F.col("job_id") % 3 == 1, F.lit(None)).otherwise("nowhere").alias("file_scope"))
    out = persistence.retrieved_probes(c, p, c.where("chunk_index % 5 = 0").select("probe_id", "file_path", "chunk_index"))
    text = lambda c, f: F.array_join(F.transform(c, f), ",")
    return out.select("probe_id", "status", F.coalesce(text("counts", lambda x: F.concat_ws(":", x["strategy"], x["n"].cast("string"))), F.lit("")).alias("counts"), F.coalesce(text("chunks", lambda x: F.concat_ws(":", x["doc"]["file_path"], x["doc"]["chunk_index"].cast("string"), F.array_join(x["strategies"], "+"))), F.lit("")).alias("chunks"))


RETRIEVED_SQL = duck_with("v_issues") + """,
c AS (SELECT CAST(job_id AS VARCHAR) AS probe_id, job_id, CASE source WHEN 'ai_review' THEN 'semantic' WHEN 'KB' THEN 'bm25' WHEN 'bandit' THEN 'structural' WHEN 'eslint' THEN 'structural' ELSE 'exact' END AS strategy, file_path, line_start AS chunk_index, confidence AS score, line_start % 4 / 10.0 AS path, confidence / 10 AS sem FROM v_issues
  WHERE line_start % 5 <> 0 AND (job_id % 3 = 1 OR (job_id % 3 = 0 AND file_path = 'src/m7.py'))),
x AS (SELECT probe_id, job_id, strategy, file_path, chunk_index, max(score) AS score, max(path) AS path, max(sem) AS sem FROM c GROUP BY ALL),
q AS (SELECT CAST(job_id AS VARCHAR) AS probe_id, min(claim) AS query FROM v_issues GROUP BY 1),
k AS (SELECT x.*, row_number() OVER (PARTITION BY x.probe_id, strategy ORDER BY score DESC, file_path, chunk_index) AS r, regexp_extract_all(query, '[A-Za-z_][A-Za-z0-9_:.]*') AS t FROM x JOIN q USING (probe_id)),
w AS (SELECT *, CASE WHEN len(t) > 0 AND len(list_filter(t, lambda y: regexp_matches(y, '::|\\.|_') OR (regexp_matches(y, '[a-z]') AND regexp_matches(y, '[A-Z]')))) >= greatest(1, len(t) // 2) THEN 0 WHEN job_id % 2 = 0 THEN 1 ELSE 2 END AS kind FROM k),
f AS (SELECT probe_id, job_id, file_path, chunk_index, sum((CASE strategy WHEN 'semantic' THEN [0.25, 0.3, 0.35] WHEN 'bm25' THEN [0.35, 0.3, 0.3] WHEN 'exact' THEN [0.2, 0.2, 0.2] ELSE [0.5, 0.55, 0.45] END)[kind + 1]::DOUBLE / (60 + r)) AS rrf, string_agg(strategy, '+' ORDER BY strategy) AS s, max(path) AS path, max(sem) AS sem FROM w GROUP BY ALL),
g AS (SELECT *, rrf + greatest(-0.12, least(0.18, path * 0.25 + least(sem, 1.0) * 0.02 + 0.5 * 0.02)) AS final FROM f),
p AS (SELECT *, row_number() OVER (PARTITION BY probe_id ORDER BY round(final, 12) DESC, file_path, chunk_index) AS place FROM g QUALIFY place <= least(greatest(job_id % 12, 1), 10)),
b AS (SELECT probe_id, string_agg(file_path || ':' || chunk_index || ':' || s, ',' ORDER BY place) AS chunks FROM p GROUP BY 1), n AS (SELECT probe_id, strategy, count(*) AS n FROM x GROUP BY ALL), m AS (SELECT probe_id, string_agg(strategy || ':' || n, ',' ORDER BY strategy) AS counts FROM n GROUP BY 1)
SELECT q.probe_id, CASE WHEN chunks IS NULL THEN 'no_candidate_evidence' ELSE 'ok' END AS status, coalesce(counts, '') AS counts, coalesce(chunks, '') AS chunks FROM q LEFT JOIN b USING (probe_id) LEFT JOIN m USING (probe_id)"""


def persisted_issues(spark, sf):
    """Findings as judged candidates, with odd categories and severities, rules of their own, of their probe's or of any, and their lines out of chunks."""
    i = view(spark, sf, "v_issues").where("source <> 'ruff' and claim <> 'otp_leakage'")
    none = F.lit(None).cast("string")
    probe = F.when(F.col("category") == "security", "security.mass_assignment").when(F.col("category") == "bug", "bug.inventory_invariant").when(F.col("category") == "style", "unknown").otherwise("probe.other")
    at = lambda c: F.struct(F.col("file_path"), F.col(c).alias("line_start"))
    c = i.select(
        F.col("issue_id").alias("candidate_id"), "job_id", probe.alias("probe_id"), F.when(F.col("severity") == "info", "no_issue").otherwise("issue").alias("verdict"), F.col("confidence"), F.when(F.col("line_start") % 4 == 0, none).otherwise(F.concat(F.lit("Some "), "claim")).alias("title"), F.lit("why so").alias("description"),
        F.when(F.col("line_start") % 2 == 0, "use left-pad").alias("suggestion"), "file_path", "line_start", "line_end", F.when(F.col("line_start") % 6 == 0, "odd").otherwise(F.concat(F.lit(" "), F.upper("severity"))).alias("severity"), F.when(F.col("line_start") % 5 == 0, none).otherwise(F.upper("category")).alias("category"),
        F.col("claim").alias("claim_type"), F.when(F.col("source") == "KB", "RC-9").alias("rule_id"), F.array(at("line_start")).alias("supporting"), F.array().cast("array<string>").alias("contradicting"),
    )
    body = F.array_join(F.transform(F.sequence(F.col("line_start") - 1, F.col("line_end") + 1), lambda n: F.concat(F.lit("line "), n.cast("string"))), "\n")
    e = i.where("line_end % 3 > 0").select(F.col("issue_id").alias("candidate_id"), F.lit(0).alias("ord"), (F.col("line_end") % 7 == 0).alias("contradicts"), F.lit(0).alias("chunk_index"), (F.col("line_start") - 1).alias("line_start"), (F.col("line_end") + 1).alias("line_end"), body.alias("content"))
    probes = i.groupBy(probe.alias("probe_id")).agg(F.lit(1).alias("ord")).where("probe_id <> 'unknown'").select("probe_id", F.when(F.col("probe_id") == "probe.other", 2).otherwise(1).alias("ord"), F.array().cast("array<string>").alias("allowed_claim_types"), F.when(F.col("probe_id") == "probe.other", F.array(F.lit("RC-1"), F.lit("RC-2"))).otherwise(F.array().cast("array<string>")).alias("related_rule_ids"))
    rules = table(spark, sf, "region").select(F.concat(F.lit("RC-"), F.col("r_regionkey").cast("string")).alias("rule_id"), F.when(F.col("r_regionkey") == 2, "left-pad").otherwise("nothing").alias("package"), F.array(F.lit("zzz")).alias("terms"))
    out = persistence.persisted_issues(c, e, probes, rules)
    get = lambda path: F.get_json_object("raw_output", path)
    return out.select("candidate_id", "severity", "category", "title", "source", get("$.claim_type").alias("claim"), get("$.finding_key").alias("finding_key"), get("$.probe_review.rule_id").alias("rule_id"), get("$.references[0]").alias("reference"), get("$.probe_review.supporting_evidence[0].line_start").alias("evidence"), get("$.probe_review.source_context.first_line").alias("first_line"), F.md5(get("$.probe_review.source_context.snippet")).alias("snippet"))


PERSISTED_ISSUES_SQL = duck_with("v_issues") + """,
i AS (SELECT *, CASE category WHEN 'security' THEN 's' WHEN 'bug' THEN 'b' WHEN 'style' THEN 'u' ELSE 'o' END AS p FROM v_issues WHERE source <> 'ruff' AND claim <> 'otp_leakage' AND severity <> 'info' AND confidence >= 0.7 AND line_start <= line_end AND line_end % 3 > 0 AND line_end % 7 > 0),
k AS (SELECT *, CASE WHEN line_start % 5 = 0 THEN 'requirement' ELSE category END AS cat, CASE p WHEN 's' THEN 'high' WHEN 'b' THEN 'high' ELSE CASE WHEN line_start % 6 = 0 THEN 'medium' ELSE severity END END AS sev,
  CASE WHEN source = 'KB' THEN 'RC-9' WHEN p IN ('s', 'b') THEN NULL WHEN line_start % 2 = 0 THEN 'RC-2' ELSE 'RC-1' END AS rule,
  CASE claim WHEN 'SQL Injection' THEN 'sql_injection' WHEN 'n_1_query' THEN 'n_plus_one_query' WHEN 'ssrf_external_calls' THEN 'ssrf' WHEN 'pickle_deserialization' THEN 'unsafe_deserialization' ELSE claim END AS ct FROM i)
SELECT issue_id AS candidate_id, sev AS severity, cat AS category, CASE WHEN line_start % 4 = 0 THEN 'AI review finding' ELSE 'Some ' || claim END AS title, CASE WHEN rule IS NULL THEN 'ai_review' ELSE 'KB' END AS source, ct AS claim,
 CASE WHEN rule IS NOT NULL THEN 'roadmap:' || replace(lower(rule), '-', '_') ELSE CASE WHEN ct IN ('sql_injection', 'hardcoded_secret') THEN 'security' WHEN ct = 'n_plus_one_query' THEN 'performance' WHEN ct = 'bare_except' THEN 'bug' ELSE cat END || ':' || ct END AS finding_key, rule AS rule_id, CASE WHEN rule IN ('RC-1', 'RC-2') THEN 'roadmap_rule_catalog' WHEN cat = 'security' THEN 'backend_directed_security_probe' ELSE 'backend_directed_probe' END AS reference,
 CAST(line_start AS VARCHAR) AS evidence, CAST(greatest(1, line_start - 1) AS VARCHAR) AS first_line, md5((SELECT string_agg('line ' || n, chr(10) ORDER BY n) FROM range(line_start - 1, line_end + 2) r(n) WHERE n >= 1)) AS snippet FROM k"""


def trace_views(spark, sf):
    """users' events as jobs' tool calls and others, suppliers' issues, orders as reports."""
    t = view(spark, sf, "v_traces")
    e = t.select("job_id", F.when(F.col("tool") == "view", "note").when(F.col("tool") == "click", F.lit(None)).otherwise("tool").alias("event_type"), "tool", F.when(F.col("sent") > 3, "ok").otherwise("error").alias("status"), F.col("tokens").alias("input_tokens"), F.col("sent").alias("output_tokens"), F.when(F.col("sent") > 2, F.col("tokens")).alias("total_tokens"), F.col("ts").alias("called_at"), F.col("event_id").alias("sequence"))
    jobs = table(spark, sf, "customer").select(F.col("c_custkey").alias("job_id"))
    reports = table(spark, sf, "nation").select((F.col("n_nationkey") * 3).alias("job_id"), F.col("n_name").alias("model"), F.col("n_regionkey").alias("created_at"))
    cover = jobs.select("job_id", F.when(F.col("job_id") % 5 == 0, "FAILED").otherwise("AI_REVIEWING").alias("status"), *[(F.col("job_id") % k).alias(c) for k, c in ((1, "reports"), (2, "cloned"), (3, "files"), (4, "static_runs"), (6, "chunks"), (7, "ai_chunks"))])
    out = persistence.trace_views(jobs, e, view(spark, sf, "v_issues").select("job_id", "source"), reports, cover)
    stages = F.array_join(F.transform("stages", lambda s: F.concat_ws(":", s["stage"], s["state"])), ",")
    sources = F.array_join(F.transform(F.array_sort(F.map_entries("issue_counts_by_source")), lambda s: F.concat_ws(":", s["key"], s["value"].cast("string"))), ",")
    return out.select("job_id", "has_ai_started", "tool_call_count", "latest_tool_name", "latest_tool_status", sources.alias("sources"), "ai_issue_count", "static_issue_count", "report_model", F.col("coverage.files").alias("files"), stages.alias("stages"), F.col("token_totals.input_tokens").alias("tokens_in"), F.col("token_totals.total_tokens").alias("tokens"))


_STAGE = "'{s}:' || CASE WHEN job_id % {k} > 0 THEN 'done' WHEN job_id % 5 = 0 THEN 'failed' WHEN '{n}' = 'AI_REVIEWING' THEN 'running' ELSE 'pending' END"
TRACE_VIEWS_SQL = duck_with("v_traces", "v_issues") + """,
e AS (SELECT *, tool <> 'view' AS call FROM v_traces), t AS (SELECT job_id, count(*) FILTER (WHERE call) AS n, arg_max(tool, (ts, event_id)) FILTER (WHERE call) AS last_tool, arg_max(CASE WHEN sent > 3 THEN 'ok' ELSE 'error' END, (ts, event_id)) FILTER (WHERE call) AS last_status,
  CAST(sum(tokens) AS BIGINT) AS tin, CAST(sum(CASE WHEN sent > 2 AND tokens <> 0 THEN tokens ELSE tokens + sent END) AS BIGINT) AS tall FROM e GROUP BY job_id),
s AS (SELECT job_id, source, count(*) AS n FROM v_issues GROUP BY ALL), i AS (SELECT job_id, string_agg(source || ':' || n, ',' ORDER BY source) AS sources, CAST(sum(CASE WHEN source IN ('ai_review', 'KB') THEN n ELSE 0 END) AS BIGINT) AS ai, CAST(sum(CASE WHEN source IN ('ai_review', 'KB') THEN 0 ELSE n END) AS BIGINT) AS st FROM s GROUP BY job_id),
j AS (SELECT c_custkey AS job_id FROM customer)
SELECT job_id, coalesce(n, 0) > 0 AS has_ai_started, coalesce(n, 0) AS tool_call_count, last_tool AS latest_tool_name, last_status AS latest_tool_status, sources, coalesce(ai, 0) AS ai_issue_count, coalesce(st, 0) AS static_issue_count, n_name AS report_model, job_id % 3 AS files,
 """ + " || ',' || ".join(_STAGE.format(s=s, k=k, n=n) for s, k, n in (("clone", 2, "CLONING"), ("structure", 3, ""), ("static", 4, ""), ("chunks", 6, ""), ("ai", 7, "AI_REVIEWING"), ("report", 1, ""))) + """ AS stages, coalesce(tin, 0) AS tokens_in, coalesce(tall, 0) AS tokens
FROM j LEFT JOIN t USING (job_id) LEFT JOIN i USING (job_id) LEFT JOIN (SELECT n_nationkey * 3 AS job_id, n_name FROM nation) r USING (job_id)"""


def retrieval_logs(spark, sf):
    """The logs of the bundles that both trims leave."""
    b = lane_bundles(spark, sf).withColumn("c", F.filter(F.split("chunks", ","), lambda x: x != ""))
    item = lambda x: F.struct(F.split(x, ":")[0].alias("file_path"), F.split(x, ":")[1].cast("int").alias("chunk_index"), F.lit(0.5).alias("semantic_score"), F.lit(0.25).alias("lexical_score"), F.lit(1.0).alias("score"))
    texts = F.array(F.concat(F.lit("how of "), F.col("probe_ord").cast("string")))
    b = b.select("job_id", F.concat_ws(".", "lane", F.col("probe_ord").cast("string")).alias("probe_id"), "lane", F.lit("bug").alias("category"), F.array(F.lit("R1")).alias("rules"), texts.alias("queries"), "status", F.array(F.lit("bm25")).alias("strategies"), F.array(F.struct(F.lit("bm25").alias("strategy"), F.lit(3).alias("n"))).alias("counts"), "selected", "trimmed_count", F.lit(7).alias("duration_ms"), F.transform("c", item).alias("chunks"))
    chunks = view(spark, sf, "v_issues").groupBy("job_id", "file_path", F.col("line_start").alias("chunk_index")).agg(F.min("line_start").alias("line_start"), F.max("line_end").alias("line_end"), F.min("claim").alias("content"))
    out = persistence.retrieval_logs(b, chunks)
    seen = F.array_join(F.transform("output.results", lambda r: F.concat_ws(":", r["file_path"], r["chunk_index"].cast("string"), r["line_end"].cast("string"), r["content_size"].cast("string"), F.left(r["content_sha256"], F.lit(6)))), ",")
    return out.select("job_id", "probe_id", F.col("input.query").alias("query"), F.col("output.status").alias("status"), F.col("output.sent_to_judge").alias("sent"), F.col("output.selected_count").alias("selected"), F.col("output.trimmed_count").alias("trimmed"), F.coalesce(seen, F.lit("")).alias("results"))


LOGS_SQL = f"""WITH bundles AS ({BUNDLES_SQL}), {duck_with('v_issues').removeprefix('WITH ')},
h AS (SELECT job_id, file_path, line_start AS chunk_index, max(line_end) AS line_end, min(claim) AS content FROM v_issues GROUP BY ALL),
x AS (SELECT job_id, lane, probe_ord, unnest(string_split(chunks, ',')) AS c, generate_subscripts(string_split(chunks, ','), 1) AS k FROM bundles WHERE chunks <> ''),
r AS (SELECT x.job_id, lane, probe_ord, string_agg(h.file_path || ':' || h.chunk_index || ':' || h.line_end || ':' || strlen(content) || ':' || left(sha256(content), 6), ',' ORDER BY k) AS results, count(*) AS n FROM x JOIN h ON h.job_id = x.job_id AND h.file_path = split_part(c, ':', 1) AND h.chunk_index = CAST(split_part(c, ':', 2) AS INT) GROUP BY ALL)
SELECT job_id, lane || '.' || probe_ord AS probe_id, 'how of ' || probe_ord AS query, status, CAST(coalesce(n, 0) AS INT) AS sent, selected, trimmed_count AS trimmed, coalesce(results, '') AS results FROM bundles LEFT JOIN r USING (job_id, lane, probe_ord)"""


def benchmark_rows(spark, sf):
    """Raw outputs of every shape, with the issues' own values."""
    v = view(spark, sf, "v_issues")
    raws = [
        '{"probe_review": {"probe_id": "%P", "claim_type": "%C", "supporting_evidence": [{"file_path": "%F", "line_start": %L, "line_end": %L}, 3, {"file_path": "b.py"}]}}', '{"probe_review": {"probe_id": "", "claim_type": 4, "supporting_evidence": {"file_path": "%F"}}}', '{"probe_review": [], "claim_type": "%C"}', "no json %C", '{"probe_review": {"probe_id": null, "claim_type": "%C", "supporting_evidence": []}}',
    ]
    raw = F.get(F.array(*[F.lit(r) for r in raws]), (F.col("line_start") % 5).cast("int"))
    for mark, c in (("%P", F.concat(F.lit("p."), "category")), ("%C", F.col("claim")), ("%F", F.col("file_path")), ("%L", F.col("line_start").cast("string"))):
        raw = F.replace(raw, F.lit(mark), c)
    out = persistence.benchmark_rows(v.withColumn("raw_output", raw))
    seen = F.array_join(F.transform("evidence", lambda e: F.concat_ws(":", e["file_path"], e["line_start"].cast("string"))), ",")
    return out.groupBy("job_id", "probe_id", "claim_type", seen.alias("evidence")).agg(F.count("*").alias("n"))


BENCH_ROWS_SQL = duck_with("v_issues") + """ SELECT job_id, CASE WHEN line_start % 5 = 0 THEN 'p.' || category END AS probe_id, CASE WHEN line_start % 5 IN (0, 4) THEN claim END AS claim_type, CASE WHEN line_start % 5 = 0 THEN file_path || ':' || line_start || ',b.py' ELSE '' END AS evidence, count(*) AS n
FROM v_issues WHERE source IN ('ai_review', 'KB') AND category <> 'style' GROUP BY ALL"""


QUERIES = {
    "retrieved_probes": (retrieved_probes, RETRIEVED_SQL),
    "persisted_issues": (persisted_issues, PERSISTED_ISSUES_SQL),
    "trace_views": (trace_views, TRACE_VIEWS_SQL),
    "retrieval_logs": (retrieval_logs, LOGS_SQL),
    "benchmark_rows": (benchmark_rows, BENCH_ROWS_SQL),
}
