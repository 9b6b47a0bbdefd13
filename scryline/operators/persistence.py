"""From a probe's candidates to what is kept and shown of it: bundles, issues, logs, trace views, benchmark findings (IDs X06, X15, X20, X27, X49)."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window, functions as F

from scryline.functions.claims import finding_key, probe_claim
from scryline.functions.scalars import CATEGORIES, SEVERITIES, one_of, or_else
from scryline.functions.text import is_review_target, lookup
from scryline.operators.graph import matching_rule
from scryline.operators.lookups import eligible
from scryline.operators.ranges import snippet
from scryline.operators.retrieval import fuse
from scryline.operators.review_flow import CHUNK, TITLE_CHARS, references
from scryline.operators.review_plan import trace_stages

#: Severities that a probe's issues have whatever the judge says. Fixed values.
PROBE_SEVERITIES = {
    "bug.inventory_invariant": "high",
    "security.insecure_randomness": "medium",
    "security.jwt_algorithm_allowlist": "critical",
    "security.mass_assignment": "high",
    "security.open_redirect": "medium",
    "security.role_authorization": "high",
    "security.sensitive_data_logging": "high",
    "security.sensitive_response_exposure": "medium",
    "security.unrestricted_file_upload": "high",
}
DEFAULT_TITLE = "AI review finding"


def probe_severity(probe_id: Column, severity: Column) -> Column:
    """G09, X15"""
    return F.coalesce(lookup(PROBE_SEVERITIES, probe_id), one_of(severity, SEVERITIES, "medium"))


def retrieved_probes(candidates: DataFrame, probes: DataFrame, excluded: DataFrame) -> DataFrame:
    """A row for each probe: status, strategies' numbers of different chunks, and the top_k chunks by rank fusion, in order.

    candidates (probe_id, strategy, chunk, score, path_score, semantic_score, lexical_score) as the strategies found them, probes (probe_id, category,
    query, top_k, file_scope), excluded (probe_id, chunk). Of a probe with a file only that file's chunks count; those of `file_scope` are structural.
    """
    rows = candidates.withColumn("strategy", F.when(F.col("strategy") == "file_scope", "structural").otherwise(F.col("strategy")))
    rows = rows.join(probes.select("probe_id", "file_scope"), "probe_id").where(F.col("file_scope").isNull() | (F.col("file_path") == F.col("file_scope")))
    rows = rows.join(excluded.select("probe_id", *CHUNK).distinct(), ["probe_id", *CHUNK], "left_anti").withColumn("doc", F.struct(*CHUNK))
    fused = fuse(rows.select("probe_id", "strategy", "doc", "score", "path_score", "semantic_score", "lexical_score"), probes.select("probe_id", "category", "query"))
    place = F.row_number().over(Window.partitionBy("probe_id").orderBy(F.desc("final_score"), "doc"))
    most = F.least(F.greatest("top_k", F.lit(1)), F.lit(10))
    chosen = fused.withColumn("place", place).where(F.col("place") <= 10).join(probes.select("probe_id", "top_k"), "probe_id").where(F.col("place") <= most)
    bundles = chosen.groupBy("probe_id").agg(F.array_sort(F.collect_list(F.struct("place", "doc", "strategies"))).alias("chunks"))
    counts = rows.select("probe_id", "strategy", "doc").distinct().groupBy("probe_id", "strategy").agg(F.count("*").alias("n")).groupBy("probe_id").agg(F.array_sort(F.collect_list(F.struct("strategy", "n"))).alias("counts"))
    out = probes.select("probe_id").join(bundles, "probe_id", "left").join(counts, "probe_id", "left")
    return out.select("probe_id", F.when(F.col("chunks").isNull(), "no_candidate_evidence").otherwise("ok").alias("status"), "counts", "chunks")


def persisted_issues(candidates: DataFrame, evidence: DataFrame, probes: DataFrame, rules: DataFrame) -> DataFrame:
    """Judged candidates as issues, with all that is kept of them.

    candidates: those of review_flow.review_issues, with suggestion, supporting and contradicting (arrays); evidence (candidate_id, ord, contradicts,
    chunk_index, line_start, line_end, content): a candidate's chunks in order; probes (probe_id, ord, allowed_claim_types, related_rule_ids); rules (rule_id, package, terms).
    Categories and severities that aren't known become `requirement` and `medium`; some probes set the severity. A candidate without a rule
    takes that of its probe's which its text names, or else its first; if its probe isn't known, the first probe's that has any.
    """
    held = evidence.groupBy("candidate_id").agg(F.bool_or("contradicts").alias("_bad"), F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("ord", "content"))), lambda x: x["content"]), "\n").alias("_seen")).where("not _bad").drop("_bad")
    rows = eligible(candidates.withColumn("title", F.coalesce(F.nullif("title", F.lit("")), F.lit(DEFAULT_TITLE)))).where(is_review_target(F.col("file_path"))).join(held, "candidate_id")
    own = probes.select("probe_id", "allowed_claim_types", F.col("related_rule_ids").alias("_own"))
    any_ = probes.where(F.size("related_rule_ids") > 0).groupBy().agg(F.min_by("related_rule_ids", "ord").alias("_any"))  # one row
    rows = rows.join(own, "probe_id", "left").join(F.broadcast(any_))
    wanted = F.coalesce("_own", "_any")
    text = F.concat_ws(" ", "title", "description", "suggestion")
    derived = matching_rule(rows.where(F.coalesce("rule_id", F.lit("")) == "").select("candidate_id", text.alias("text"), wanted.alias("rule_ids")), rules, "candidate_id").withColumnRenamed("rule_id", "_derived")
    rows = rows.join(derived, "candidate_id", "left").withColumn("rule_id", F.coalesce(F.nullif("rule_id", F.lit("")), "_derived"))
    rows = rows.join(rules.select("rule_id").distinct().withColumn("known", F.lit(True)), "rule_id", "left")
    rows = rows.withColumns({"category": one_of(F.col("category"), CATEGORIES, "requirement"), "severity": probe_severity(F.col("probe_id"), F.col("severity"))})
    rows = rows.withColumn("claim_type", probe_claim(F.col("probe_id"), F.col("claim_type"), F.col("title"), F.concat_ws("\n", "description", "suggestion", "_seen")))
    rows = rows.where(F.coalesce(F.size("allowed_claim_types") <= 0, F.lit(True)) | F.array_contains("allowed_claim_types", F.col("claim_type")))
    lines = snippet(evidence.select("candidate_id", "chunk_index", "line_start", "line_end", "content"), rows.select("candidate_id", F.col("line_start").alias("q_start"), F.col("line_end").alias("q_end")), ["candidate_id"], "candidate_id")
    rows = rows.join(lines, "candidate_id", "left").withColumn("source_context", F.when(F.col("snippet").isNotNull(), F.struct("first_line", "snippet")))
    key = finding_key(F.col("category"), F.col("claim_type"), F.col("title"), F.col("rule_id"))
    raw = F.struct(
        "claim_type", key.alias("finding_key"), references(F.col("category"), F.col("rule_id"), F.coalesce("known", F.lit(False))).alias("references"),
        F.struct("probe_id", "rule_id", "claim_type", F.col("supporting").alias("supporting_evidence"), F.col("contradicting").alias("contradicting_evidence"), "source_context").alias("probe_review"),
    )
    return rows.select(
        "candidate_id", "job_id", "file_path", "line_start", "line_end", "severity", "category", F.substring("title", 1, TITLE_CHARS).alias("title"), "description", "suggestion", "confidence",
        F.when(F.coalesce("rule_id", F.lit("")) != "", "KB").otherwise("ai_review").alias("source"), F.to_json(raw).alias("raw_output"),
    )


def retrieval_logs(bundles: DataFrame, chunks: DataFrame) -> DataFrame:
    """The log of each bundle, without any source: probe_id, input, output (structs).

    bundles (job_id, probe_id, lane, category, rules, queries, status, strategies, counts, selected, trimmed_count, duration_ms, chunks), chunks (job_id, file_path, chunk_index,
    line_start, line_end, content) with scores in the bundles' chunks (semantic_score, lexical_score, score).
    """
    given = F.struct("probe_id", "lane", "category", F.col("rules").alias("related_rule_ids"), F.col("queries").alias("retrieval_queries"), F.get("queries", 0).alias("query"))
    each = bundles.select("job_id", "probe_id", F.posexplode("chunks").alias("pos", "c")).select("job_id", "probe_id", "pos", "c.*")
    found = each.join(chunks.select("job_id", *CHUNK, "line_start", "line_end", F.sha2("content", 256).alias("content_sha256"), F.octet_length("content").alias("content_size")), ["job_id", *CHUNK], "left")
    item = F.struct("pos", F.struct(F.lit("ok").alias("status"), *CHUNK, "line_start", "line_end", "semantic_score", "lexical_score", F.col("score").alias("final_score"), "content_sha256", "content_size").alias("r"))
    results = found.groupBy("job_id", "probe_id").agg(F.transform(F.array_sort(F.collect_list(item)), lambda x: x["r"]).alias("results"))
    n = F.size("chunks")
    out = F.struct("status", "duration_ms", F.col("strategies").alias("strategies_used"), F.col("counts").alias("candidate_counts"), F.col("selected").alias("selected_count"), "trimmed_count", n.alias("sent_to_judge"), n.alias("result_count"), "results")
    return bundles.join(results, ["job_id", "probe_id"], "left").select("job_id", "probe_id", F.lit("probe_retrieval").alias("tool_name"), given.alias("input"), out.alias("output"))


def trace_views(jobs: DataFrame, events: DataFrame, issues: DataFrame, reports: DataFrame, coverage: DataFrame) -> DataFrame:
    """The trace of each job: whether AI has begun, tool calls and the last one, issues by source, report, coverage, stages, tokens.

    jobs (job_id), events (job_id, event_type, tool, status, input_tokens, output_tokens, total_tokens, called_at, sequence), issues (job_id, source), reports
    (job_id, model, created_at), coverage (job_id, status and the stages' counts).
    """
    tool = (F.col("event_type") == "tool") | F.col("event_type").isNull()
    order = F.struct("called_at", "sequence")
    calls = events.groupBy("job_id").agg(
        F.count_if(tool).alias("tool_call_count"), F.max_by(F.when(tool, F.struct("tool", "status")), F.when(tool, order)).alias("last"),
        *[F.sum(F.coalesce(c, F.lit(0))).alias(c) for c in ("input_tokens", "output_tokens")], F.sum(or_else(F.col("total_tokens"), F.coalesce("input_tokens", F.lit(0)) + F.coalesce("output_tokens", F.lit(0)))).alias("total_tokens"),
    )
    by_source = issues.groupBy("job_id", "source").agg(F.count("*").alias("n"))
    ai = F.col("source").isin("ai_review", "KB")
    sources = by_source.groupBy("job_id").agg(F.map_from_entries(F.array_sort(F.collect_list(F.struct("source", "n")))).alias("issue_counts_by_source"), F.sum(F.when(ai, F.col("n")).otherwise(0)).alias("ai_issue_count"), F.sum(F.when(~ai, F.col("n")).otherwise(0)).alias("static_issue_count"))
    stages = trace_stages(coverage).groupBy("job_id").agg(F.transform(F.array_sort(F.collect_list(F.struct("place", "stage", "state"))), lambda x: F.struct(x["stage"].alias("stage"), x["state"].alias("state"))).alias("stages"))
    counts = coverage.select("job_id", F.struct(*[c for c in coverage.columns if c not in ("job_id", "status")]).alias("coverage"))
    out = jobs.select("job_id").join(calls, "job_id", "left").join(sources, "job_id", "left").join(reports.select("job_id", F.col("model").alias("report_model"), F.col("created_at").alias("report_created_at")), "job_id", "left").join(counts, "job_id", "left").join(stages, "job_id", "left")
    zero = {c: F.coalesce(c, F.lit(0)).cast("long") for c in ("tool_call_count", "input_tokens", "output_tokens", "total_tokens", "ai_issue_count", "static_issue_count")}
    return out.withColumns(zero).select(
        "job_id", (F.col("tool_call_count") > 0).alias("has_ai_started"), "tool_call_count", F.col("last.tool").alias("latest_tool_name"), F.col("last.status").alias("latest_tool_status"), "issue_counts_by_source", "ai_issue_count", "static_issue_count",
        "report_model", "report_created_at", "coverage", "stages", F.struct("input_tokens", "output_tokens", "total_tokens").alias("token_totals"),
    )


def benchmark_rows(issues: DataFrame) -> DataFrame:
    """What AI review found besides style, with probe, claim and evidence out of raw_output (JSON); what isn't of the kind there is null, or leaves no evidence."""
    v = F.try_parse_json("raw_output")
    text = lambda name: F.when(F.coalesce(F.startswith(F.schema_of_variant(F.try_variant_get(v, f"$.probe_review.{name}", "variant")), F.lit("STRING")), F.lit(False)), F.try_variant_get(v, f"$.probe_review.{name}", "string"))
    items = F.coalesce(F.try_variant_get(v, "$.probe_review.supporting_evidence", "array<variant>"), F.array().cast("array<variant>"))
    objects = F.filter(items, lambda x: F.startswith(F.schema_of_variant(x), F.lit("OBJECT")))
    at = lambda x, name, kind: F.try_variant_get(x, f"$.{name}", kind).alias(name)
    evidence = F.transform(objects, lambda x: F.struct(at(x, "file_path", "string"), at(x, "line_start", "int"), at(x, "line_end", "int")))
    kept = issues.where(F.col("source").isin("ai_review", "KB") & (F.col("category") != "style"))
    return kept.select("issue_id", "job_id", "file_path", "line_start", "line_end", "category", "severity", "source", F.nullif(text("probe_id"), F.lit("")).alias("probe_id"), text("claim_type").alias("claim_type"), evidence.alias("evidence"))
