"""Planning a review and judging its fixes (IDs P13, P18, P20, P24, O09, O14, O15, O20, X11, X13, X14, X39, X40, X62, A28, A31, A32, G12, X28)."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

from scryline.functions.scalars import category_for_risk, priority_level
from scryline.functions.text import exact_score, file_name, first_match, is_review_target, path_parts, slug

# Fixed values.
SMART_PARTS = ["agent", "agents", "ai", "api", "auth", "chat", "crypto", "db", "deps", "endpoints", "llm", "memory", "middleware", "rag", "repositories", "routers", "security"]
SMART_CONFIGS = [
    ".env.example", ".gitignore", "docker-compose.yaml", "docker-compose.yml", "dockerfile", "dockerfile.dev", "dockerfile.prod", "next.config.js", "next.config.mjs", "next.config.ts", "package.json", "pyproject.toml",
    "requirements.txt", "tsconfig.json",
]
SMART_RISKS = ["security", "api", "database", "config"]
SECURITY_PARTS = ["auth", "security", "crypto", "middleware"]


def _parts_and_stem(path: Column) -> Column:
    return F.concat(path_parts(path), F.array(F.regexp_replace(file_name(path), r"(.)\.[^.]*$", "$1")))


def _overlap(path: Column, names: list[str]) -> Column:
    return F.arrays_overlap(_parts_and_stem(path), F.array(*[F.lit(n) for n in names]))


def smart_reason(risk: Column, path: Column) -> Column:
    """Why a chunk is chosen; null if nothing speaks for it."""
    return first_match([(risk.isin(SMART_RISKS), F.concat(F.lit("risk_area:"), risk)), (_overlap(path, SMART_PARTS), "risk_path"), (file_name(path).isin(SMART_CONFIGS), "project_config")])


SELECTION_RANK = {"risk_area:security": 0, "risk_path": 1, "risk_area:api": 2, "risk_area:database": 3, "risk_area:config": 4, "project_config": 5}


def selection_rank(reason: Column) -> Column:
    """Lower is chosen first."""
    return first_match([(F.startswith(reason, F.lit(k)), v) for k, v in SELECTION_RANK.items()], F.lit(10))


def fallback_rank(risk: Column, path: Column) -> Column:
    """X13"""
    return first_match([(risk.isin(SMART_RISKS), 0), (_overlap(path, SMART_PARTS), 1), (file_name(path).isin(SMART_CONFIGS), 2)], F.lit(3))


def review_rank(chunk_type: Column) -> Column:
    """Functions, classes, the rest."""
    return first_match([(chunk_type == "function", 0), (chunk_type == "class", 1)], F.lit(2))


def review_mode(value: str | None) -> str:
    """full_audit unless smart is asked for; anything else is an error."""
    mode = (value or "full_audit").strip().lower()
    if mode not in ("full_audit", "smart"):
        raise ValueError(f"no such review mode: {value}")
    return mode


def smart_budget(value: int | None) -> int:
    """160 unless given, from 120 to 240."""
    return 160 if value is None else max(120, min(240, value))


def chunk_infos(chunks: DataFrame) -> DataFrame:
    """X11: review targets with defaults, and the text that is searched."""
    e = lambda c, d: F.coalesce(F.col(c), F.lit(d))
    rows = chunks.where(is_review_target(F.col("file_path"))).withColumns({"risk_area": e("risk_area", "general"), "language": e("language", "text"), "chunk_type": e("chunk_type", "")})
    return rows.withColumn("search_text", F.lower(F.concat_ws(" ", "file_path", e("chunk_text", ""))))


def files_to_review(tree: DataFrame, chunks: DataFrame) -> DataFrame:
    """file_path, priority, risk_area, total_chunks of all files that are to be reviewed or have chunks."""
    risks = chunks.groupBy("file_path").agg(F.max(F.coalesce("total_chunks", F.col("chunk_index") + 1)).alias("total_chunks"), F.collect_set("risk_area").alias("r"))
    files = tree.where("should_review").select(F.col("path").alias("file_path")).unionByName(risks.select("file_path")).distinct()
    has = lambda x: F.coalesce(F.array_contains("r", x), F.lit(False))
    secure = _overlap(F.col("file_path"), SECURITY_PARTS)
    priority = first_match([(has("security") | has("api") | secure, "high"), (has("database") | has("config"), "medium")], F.lit("low"))
    risk = first_match([(has("security") | secure, "security"), (has("database"), "database"), (has("api"), "api"), (has("config"), "config")], F.lit("general"))
    return files.join(risks, "file_path", "left").select("file_path", priority.alias("priority"), risk.alias("risk_area"), F.coalesce("total_chunks", F.lit(0)).alias("total_chunks"))


def priority_rank(priority: Column) -> Column:
    return first_match([(priority_level(priority) == "high", 0), (priority_level(priority) == "medium", 1)], F.lit(2))


def coverage_probes(files: DataFrame, most: int = 4) -> DataFrame:
    """The first files of high or medium priority as probes."""
    top = files.where("priority in ('high', 'medium')").orderBy(priority_rank(F.col("priority")), "file_path").limit(most)
    return top.select(F.concat(F.lit("coverage."), slug(F.col("file_path"), "_")).alias("probe_id"), category_for_risk(F.col("risk_area")).alias("category"), "priority", "risk_area", F.col("file_path").alias("file_scope"), F.lit("coverage").alias("probe_kind"))


def sorted_rules(rules: DataFrame) -> DataFrame:
    """Rules that need judging first, then by priority, group, check and id."""
    return rules.orderBy((~F.col("needs_ai_verification")).cast("int"), priority_rank(F.col("priority")), "skill_group", "check_type", "rule_id")


def week_order(week: Column) -> Column:
    return first_match([(week == "GEN", 10_000)], F.coalesce(week.try_cast("int"), F.lit(20_000)))


def applicable_rules(rules: DataFrame, profile: str, weeks: list[str] | None) -> DataFrame:
    """A profile's rules of its weeks and of all weeks, in order; a bad priority or an id that comes twice fails the query."""
    mine = rules.where((F.col("doc_type") == "roadmap_rule") & (F.col("profile_id") == profile) & F.col("rule_id").isNotNull() & (F.col("rule_id") != ""))
    if weeks is not None:
        mine = mine.where((F.col("week") == "GEN") | F.col("week").isin([str(w) for w in weeks]))
    checked = mine.groupBy("rule_id").agg(F.count("*").alias("_n"), F.first("week").alias("week"), F.first("priority").alias("priority"))
    ok = F.assert_true(F.col("priority").isin("P0", "P1", "P2"), F.lit("a rule has an invalid priority")).isNull() & F.assert_true(F.col("_n") == 1, F.lit("a rule id comes twice")).isNull()
    return checked.where(ok).select("rule_id", "week", "priority").orderBy(week_order(F.col("week")), "rule_id")


def rule_text(rules: DataFrame) -> DataFrame:
    """Rules as documents; what is missing leaves no line."""
    part = lambda name, c: F.concat(F.lit(f"{name}: "), F.col(c))
    return rules.select("rule_id", F.concat_ws("\n", part("Rule", "rule_id"), part("Week", "week"), part("Skill group", "skill_group"), part("Requirement", "requirement"), part("Hint", "verification_hint")).alias("content"))


def exact_candidates(chunks: DataFrame, query: str, final: Column, k: int) -> DataFrame:
    """Chunks that hold a term of the query, best final score first."""
    rows = chunks.withColumn("exact", exact_score(F.lit(query), F.col("chunk_text"), F.col("file_path"))).where("exact > 0")
    return rows.withColumn("final_score", final).orderBy(F.desc("final_score"), "file_path", "chunk_index").limit(k)


def in_scope(candidates: DataFrame, scope: str | None) -> DataFrame:
    """Of a probe with a file, only that file's chunks, raised by 0.4; several lines go before one."""
    if scope is None:
        return candidates
    rows = candidates.where(F.col("file_path") == scope).withColumn("score", F.col("score") + 0.4)
    return rows.orderBy(F.desc(F.col("line_end") > F.col("line_start")), F.desc("score"), "chunk_index")


def chart(counts: DataFrame, value: str = "n", name: str = "category") -> DataFrame:
    """What is above zero, greatest first."""
    return counts.where(F.col(value) > 0).orderBy(F.desc(value), name)


def ruff_selection(issues: DataFrame, column: str) -> DataFrame:
    """Distinct rule codes, or files, of ruff's issues."""
    return issues.where("source = 'ruff'").select(column).where(F.col(column).isNotNull()).distinct()


def cleanup_summary(candidates: DataFrame) -> DataFrame:
    """Scanned, cleaned, skipped and freed over all kinds of workspace. candidates (path, bytes, cleaned)."""
    return candidates.agg(F.count("*").alias("scanned"), F.count_if("cleaned").alias("cleaned"), F.count_if(~F.col("cleaned")).alias("skipped"), F.coalesce(F.sum(F.when(F.col("cleaned"), F.col("bytes"))), F.lit(0)).alias("freed"))


def scenario_verdict(scenarios: DataFrame, issue: str = "issue_id") -> DataFrame:
    """Scenarios (issue, kind, baseline_status, patched_status) -> verdict: fixed only if exploit and preserved behaviour both ran and hold."""
    b, p = F.col("baseline_status"), F.col("patched_status")
    exploit, kept, related = (F.col("kind") == k for k in ("exploit", "preserved_behavior", "related_test"))
    idle = b.isin("skipped", "not_run") | p.isin("skipped", "not_run")
    flags = scenarios.groupBy(issue).agg(
        F.bool_or(idle).alias("idle"), F.bool_or(exploit).alias("has_exploit"), F.bool_or(kept).alias("has_kept"), F.bool_or(exploit & (b != "failed")).alias("no_bug"), F.bool_or(kept & (b != "passed")).alias("sick"),
        F.bool_or((exploit | kept) & (p != "passed")).alias("broken"), F.bool_or(related & (b == "passed") & (p == "failed")).alias("regressed"),
    )
    unsure = F.col("idle") | ~(F.col("has_exploit") & F.col("has_kept")) | F.col("no_bug") | F.col("sick")
    return flags.select(issue, F.when(unsure, "uncertain").when(F.col("broken") | F.col("regressed"), "unresolved").otherwise("fixed").alias("verdict"))


def all_checks(checks: DataFrame, key: str) -> DataFrame:
    """Does every named check of a key hold, and which don't?"""
    return checks.groupBy(key).agg(F.bool_and("passed").alias("passed"), F.array_sort(F.collect_set(F.when(~F.col("passed"), F.col("name")))).alias("failed"))


STAGES = [("clone", "CLONING", "cloned"), ("structure", "ANALYZING_STRUCTURE", "files"), ("static", "RUNNING_STATIC_ANALYSIS", "static_runs"), ("chunks", "CHUNKING_CODE", "chunks"), ("ai", "AI_REVIEWING", "ai_chunks"), ("report", "GENERATING_REPORT", "reports")]


def trace_stages(coverage: DataFrame) -> DataFrame:
    """Coverage (job_id, status and a count for each stage) -> six rows a job with each stage's status: done, running, failed or pending."""
    stages = F.array(*[F.struct(F.lit(i).alias("place"), F.lit(k).alias("stage"), F.when(F.col(c) > 0, "done").when(F.col("status") == "FAILED", "failed").when(F.col("status") == s, "running").otherwise("pending").alias("state")) for i, (k, s, c) in enumerate(STAGES)])
    return coverage.select("job_id", F.inline(stages))
