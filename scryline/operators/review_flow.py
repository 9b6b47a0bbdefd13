"""From retrieval to persisted issues: lanes, judge payloads, issues, reports, fix checks, traces (IDs A17, G07, G11, J11, J12, J25, S18, U01, U06, X06, X15, X17, X20, X27, X42, X43, X45, X49, X50, X54)."""

from __future__ import annotations

import re
from functools import reduce

import pandas as pd
from pyspark.sql import Column, DataFrame, Window, functions as F
from pyspark.sql.types import ArrayType, StringType

from scryline.functions.claims import finding_key, probe_claim
from scryline.functions.text import is_review_target
from scryline.operators.alike import classes, joined, stored
from scryline.operators.chunking import split_documents
from scryline.operators.findings import report_aggregate
from scryline.operators.lookups import eligible
from scryline.operators.ranges import places_met
from scryline.operators.retrieval import postings
from scryline.operators.trace import finding_matches

CHUNK = ["file_path", "chunk_index"]
TITLE_CHARS = 255
RISKY_FILES = 5


def audit_plan(baseline: DataFrame, coverage: DataFrame, roadmap: DataFrame) -> DataFrame:
    """The probes of the three parts, one after the other by (part, ord); each part has `ord`."""
    parts = [p.withColumn("part", F.lit(k)) for k, p in enumerate((baseline, coverage, roadmap))]
    return reduce(lambda a, b: a.unionByName(b, allowMissingColumns=True), parts)


def strategy_union(probe: str, lists: dict[str, DataFrame]) -> DataFrame:
    """Candidates (probe, chunk, score) of each strategy with their strategy and place; file_scope counts as structural and stands first."""
    out = None
    for k, (name, rows) in enumerate(lists.items()):
        group = "structural" if name == "file_scope" else name
        rows = rows.select(probe, *CHUNK, "score", F.lit(group).alias("strategy"), F.lit(0 if name == "file_scope" else k + 1).alias("part"))
        out = rows if out is None else out.unionByName(rows)
    place = Window.partitionBy(probe, "strategy").orderBy("part", F.desc("score"), *CHUNK)
    return out.withColumn("ord", F.row_number().over(place)).drop("part")


def strategy_counts(candidates: DataFrame, probe: str) -> DataFrame:
    """How many different chunks each strategy found for a probe."""
    return candidates.select(probe, "strategy", *CHUNK).distinct().groupBy(probe, "strategy").agg(F.count("*").alias("n"))


def _at(v: Column, path: str, kind: str = "variant") -> Column:
    """What stands at a path of a variant; null only where nothing does, or it isn't of the kind."""
    return F.try_variant_get(v, path, kind)


def _kind(v: Column, name: str) -> Column:
    return F.coalesce(F.startswith(F.schema_of_variant(v), F.lit(name)), F.lit(False))


def _number_fits(v: Column, name: str, low: float, high: float | None = None, whole: bool = False) -> Column:
    """Nothing or JSON's null, or a number (or its text) within bounds."""
    raw = _at(v, f"$.{name}", "string")
    n = raw.try_cast("double")
    ok = n.isNotNull() & (n >= low)
    if high is not None:
        ok = ok & (n <= high)
    if whole:
        ok = ok & (n == F.floor(n))
    return raw.isNull() | F.coalesce(ok, F.lit(False))


def _issue_fits(issue: Column) -> Column:
    return _kind(issue, "OBJECT") & _number_fits(issue, "confidence", 0, 1) & _number_fits(issue, "line_start", 1, whole=True) & _number_fits(issue, "line_end", 1, whole=True)


def judge_payloads(payloads: DataFrame, key: str, payload: str) -> DataFrame:
    """Key, results (array of struct<probe_id, verdict, confidence, issues array<string>>), rejected, unscoped.

    Each payload is parsed once. Valid results and issues stay, the others are counted. A result needs a probe and one of three verdicts as texts, a list of
    issues or none (null is neither), and valid ones exactly if the verdict is `issue`; an issue is an object whose lines are whole numbers from 1
    and whose confidence is in 0..1. Payloads without `results` may be of the older form and list candidates, each a result with one issue. unscoped:
    something was lost whose probe isn't known.
    """
    v = F.try_parse_json(payload)
    rows = payloads.select(key, _at(v, "$.results").alias("_new"), _at(v, "$.candidates").alias("_old"))
    rows = rows.select(key, F.col("_new").isNull().alias("legacy"), _at(F.coalesce("_new", "_old"), "$", "array<variant>").alias("items"))
    none = F.array().cast("array<variant>")

    def result(r: Column) -> Column:
        given = _at(r, "$.issues")
        listed = F.when(given.isNull(), none).otherwise(_at(r, "$.issues", "array<variant>"))
        issues = F.when(~_kind(r, "OBJECT"), F.lit(None)).when(F.col("legacy"), F.when(_at(r, "$.verdict", "string") == "issue", F.array(r)).otherwise(none)).otherwise(listed)
        return F.struct(r.alias("raw"), issues.alias("given"), F.filter(issues, _issue_fits).alias("issues"))

    def fits(x: Column) -> Column:
        r, verdict = x["raw"], _at(x["raw"], "$.verdict", "string")
        known = _kind(r, "OBJECT") & _kind(_at(r, "$.probe_id"), "STRING") & (_at(r, "$.probe_id", "string") != "") & verdict.isin("issue", "no_issue", "uncertain")
        whole = F.when(F.col("legacy"), _issue_fits(r)).otherwise(_number_fits(r, "confidence", 0, 1))
        return F.coalesce(known & whole & x["given"].isNotNull() & ((verdict == "issue") == (F.size(x["issues"]) > 0)), F.lit(False))

    lost = lambda x: F.when(F.col("legacy") | x["given"].isNull(), 0).otherwise(F.size(x["given"]) - F.size(x["issues"]))
    rows = rows.withColumn("read", F.transform("items", result))
    kept = F.filter("read", fits)
    bad = F.size("read") - F.size(kept)
    rejected = F.aggregate("read", F.lit(0), lambda s, x: s + lost(x)) + bad
    shaped = F.transform(kept, lambda x: F.struct(
        _at(x["raw"], "$.probe_id", "string").alias("probe_id"), _at(x["raw"], "$.verdict", "string").alias("verdict"), _at(x["raw"], "$.confidence", "string").try_cast("double").alias("confidence"),
        F.transform(x["issues"], lambda i: F.to_json(i)).alias("issues"),
    ))
    empty = F.array().cast("array<struct<probe_id:string,verdict:string,confidence:double,issues:array<string>>>")
    return rows.select(key, F.coalesce(shaped, empty).alias("results"), F.when(F.col("items").isNull(), 1).otherwise(rejected).alias("rejected"), F.coalesce(bad > 0, F.lit(True)).alias("unscoped"))


def references(category: Column, rule_id: Column, known: Column) -> Column:
    """Known: whether the rule is in the catalogue."""
    return F.when(rule_id.isNotNull() & known, F.array(F.lit("roadmap_rule_catalog"), rule_id)).when(category == "security", F.array(F.lit("backend_directed_security_probe"))).otherwise(F.array(F.lit("backend_directed_probe")))


#: Other names of packages. Fixed values.
PACKAGE_NAMES = {"next": ["next.js", "nextjs"], "tailwindcss": ["tailwind"]}


def package_in_text(package: Column, text: Column) -> Column:
    """Text: lower case."""
    p = F.lower(package)
    other = [(p == k) & reduce(lambda a, b: a | b, [F.contains(text, F.lit(n)) for n in names]) for k, names in PACKAGE_NAMES.items()]
    return reduce(lambda a, b: a | b, other, F.contains(text, p))


def review_issues(candidates: DataFrame, evidence: DataFrame, probes: DataFrame, rules: DataFrame) -> DataFrame:
    """Candidates that may become issues, as issues.

    candidates (candidate_id, job_id, probe_id, verdict, confidence, title, description, file_path, line_start, line_end, severity,
    category, claim_type, rule_id), evidence (candidate_id, contradicts) with a row for each chunk that supports a candidate, probes
    (probe_id, allowed_claim_types), rules (rule_id). A candidate goes if it isn't eligible, has no evidence, is about a README,
    makes a claim that its probe doesn't allow, or is contradicted.
    """
    held = evidence.groupBy("candidate_id").agg(F.bool_or("contradicts").alias("contradicted")).where("not contradicted").select("candidate_id")
    rows = eligible(candidates).where(is_review_target(F.col("file_path"))).join(held, "candidate_id", "left_semi")
    rows = rows.join(probes.select("probe_id", "allowed_claim_types"), "probe_id", "left").join(rules.select("rule_id").distinct().withColumn("known", F.lit(True)), "rule_id", "left")
    rows = rows.withColumn("claim_type", probe_claim(F.col("probe_id"), F.col("claim_type"), F.col("title"), F.col("description")))
    rows = rows.where(F.coalesce(F.size("allowed_claim_types") <= 0, F.lit(True)) | F.array_contains("allowed_claim_types", F.col("claim_type")))
    key = finding_key(F.col("category"), F.col("claim_type"), F.col("title"), F.col("rule_id"))
    return rows.select(
        "candidate_id", "job_id", "file_path", "line_start", "line_end", "severity", "category", F.substring("title", 1, TITLE_CHARS).alias("title"), "description", "confidence",
        F.when(F.coalesce("rule_id", F.lit("")) != "", "KB").otherwise("ai_review").alias("source"), "claim_type", key.alias("finding_key"),
        references(F.col("category"), F.col("rule_id"), F.coalesce("known", F.lit(False))).alias("references"),
        F.struct("probe_id", "rule_id", "claim_type").alias("probe_review"),
    )


def prioritized_files(risky: DataFrame, priorities: DataFrame, job: str) -> DataFrame:
    """Risky (job, rank, path, issue_count, max_severity), then those of priorities (job, ord, path) that aren't there; five at most."""
    rest = priorities.join(risky.select(job, "path"), [job, "path"], "left_anti").groupBy(job, "path", "ord").agg(F.lit(0).cast("long").alias("issue_count"), F.lit("info").alias("max_severity"))
    both = risky.select(job, F.lit(0).alias("part"), F.col("rank").cast("long").alias("ord"), "path", "issue_count", "max_severity").unionByName(rest.select(job, F.lit(1).alias("part"), F.col("ord").cast("long").alias("ord"), "path", "issue_count", "max_severity"))
    place = F.row_number().over(Window.partitionBy(job).orderBy("part", "ord", "path"))
    return both.withColumn("rank", place).where(F.col("rank") <= RISKY_FILES).select(job, "rank", "path", "issue_count", "max_severity")


def files_analyzed(jobs: DataFrame, reports: DataFrame, trees: DataFrame, job: str) -> DataFrame:
    """Job, total_files: the report's own number, or else the size of the newest tree (job, analyzed_at, files), or 0."""
    newest = trees.groupBy(job).agg(F.max_by("files", "analyzed_at").alias("files"))
    return jobs.select(job).join(reports.select(job, "total_files"), job, "left").join(newest, job, "left").select(job, F.coalesce("total_files", "files", F.lit(0)).cast("long").alias("total_files"))


def report_rows(issues: DataFrame, totals: DataFrame, risky: DataFrame, job: str = "job_id") -> DataFrame:
    """The report of each job, computed anew from its issues; totals (job, total_files), risky as from prioritized_files."""
    files = risky.groupBy(job).agg(F.array_sort(F.collect_list(F.struct("rank", "path", "issue_count", "max_severity"))).alias("top_risky_files"))
    return report_aggregate(issues).join(totals, job, "left").join(files, job, "left")


#: From best to worst.
VERDICTS = ["fixed", "uncertain", "unresolved"]


def verified_fixes(plans: DataFrame, issues: DataFrame, specs: DataFrame, logic: DataFrame, deterministic: DataFrame) -> DataFrame:
    """Plans (issue_id, status, ord) -> issue_id, ord, verdict, one for each; logic, deterministic (issue_id, verdict).

    A plan that isn't planned is uncertain; else the worst of its verdicts holds. It fails if a planned issue has no spec, no issue or no
    verdict of the logic check: every selected issue must be covered.
    """
    ids = lambda df, name: df.select("issue_id").distinct().withColumn(name, F.lit(True))
    rows = plans.join(ids(issues, "has_issue"), "issue_id", "left").join(ids(specs, "has_spec"), "issue_id", "left")
    worst = F.array_max(F.collect_set(F.array_position(F.array(*map(F.lit, VERDICTS)), F.col("verdict"))))
    of = lambda df, name: df.groupBy("issue_id").agg(F.get(F.array(*map(F.lit, VERDICTS)), worst.cast("int") - 1).alias(name))
    rows = rows.join(of(logic, "logic"), "issue_id", "left").join(of(deterministic, "sure"), "issue_id", "left")
    planned = F.col("status") == "planned"
    covered = ~planned | (F.col("has_issue").isNotNull() & F.col("has_spec").isNotNull() & F.col("logic").isNotNull())
    bad = lambda v: F.coalesce(F.col("logic") == v, F.lit(False)) | F.coalesce(F.col("sure") == v, F.lit(False))
    verdict = F.when(~planned, "uncertain").when(bad("unresolved"), "unresolved").when(bad("uncertain"), "uncertain").otherwise("fixed")
    return rows.where(F.assert_true(covered, F.lit("not every selected issue was verified")).isNull()).select("issue_id", "ord", verdict.alias("verdict"))


def retrieval_traces(selected: DataFrame, probe: str) -> DataFrame:
    """A row for each probe with its chunks in order; selected (probe, rank, chunk, content): the content is left as its length in bytes."""
    chunk = F.struct("rank", *CHUNK, F.octet_length("content").alias("content_bytes"))
    return selected.groupBy(probe).agg(F.array_sort(F.collect_list(chunk)).alias("results"), F.count("*").alias("sent_to_judge"))


def job_traces(events: DataFrame, issues: DataFrame, tools: list[str], job: str = "job_id") -> DataFrame:
    """Of each job with events: how many, the last tool, and how many issues come from AI and from analyzers."""
    seen = events.where(F.col("tool").isin(tools)).groupBy(job).agg(F.count("*").alias("events"), F.max_by("tool", F.struct("ts", "event_id")).alias("last_tool"))
    ai = F.col("source").isin("ai_review", "KB")
    counts = issues.groupBy(job).agg(F.count_if(ai).alias("ai_issues"), F.count_if(~ai).alias("static_issues"))
    zero = {c: F.coalesce(c, F.lit(0)).cast("long") for c in ("ai_issues", "static_issues")}
    return seen.join(counts, job, "left").withColumns(zero)


def trace_ranks(expected: DataFrame, traces: DataFrame) -> DataFrame:
    """Of each expected issue the least rank among the chunks that traces hold of its place, of its own probes where it names some.

    expected (expected_id, probes, file_path, line_start, line_end), traces (probe_id, chunks array<struct<file_path, line_start,
    line_end>>). A chunk that many traces of a probe hold counts once, with its least rank.
    """
    t = traces.select("probe_id", F.posexplode("chunks").alias("pos", "c")).groupBy("probe_id", F.col("c.file_path").alias("path"), F.col("c.line_start").alias("a_start"), F.col("c.line_end").alias("a_end")).agg(F.min("pos").alias("pos"))
    both = places_met(t, expected.withColumnRenamed("file_path", "e_path"), [])
    own = (F.size("probes") <= 0) | F.array_contains("probes", F.col("probe_id"))
    best = both.where(own).groupBy("expected_id").agg(F.min(F.col("pos") + 1).alias("rank"))
    return expected.select("expected_id").join(best, "expected_id", "left").select("expected_id", F.col("rank").isNotNull().alias("retrieved"), "rank")


def bait_hits(findings: DataFrame, baits: DataFrame) -> DataFrame:
    """Baits (bait_id, file_path, line_start, line_end) that findings (finding_id, file_path, line_start, line_end) hit, with the findings' ids in order."""
    hit, sets = bait_sets(findings, baits)
    return hit.join(sets, "set").select("bait_id", "finding_ids")


def bait_sets(findings: DataFrame, baits: DataFrame) -> tuple[DataFrame, DataFrame]:
    """bait_id, set, and set, finding_ids: baits that the same findings hit share a set. Equal places are matched once, and a set's ids are gathered once."""
    place = ["file_path", "line_start", "line_end"]
    f, b = classes(findings, place, "_f", "finding-places"), classes(baits, place, "_b", "bait-places")
    met = bait_pairs(f.withColumnRenamed("_f", "finding_id"), b.withColumnRenamed("_b", "bait_id")).groupBy("bait_id").agg(F.array_sort(F.collect_set("finding_id")).alias("_fs"))
    of_place = stored(met.withColumnRenamed("bait_id", "_b"), "place-hits")
    per = stored(joined(joined(baits.select("bait_id", *place), b, place), of_place, ["_b"]).groupBy("bait_id").agg(F.array_sort(F.array_distinct(F.flatten(F.collect_set("_fs")))).alias("_fs")), "bait-classes")
    groups = classes(per, ["_fs"], "set", "bait-sets")
    members = stored(groups.select("set", F.explode("_fs").alias("_f")), "bait-set-classes")
    sets = joined(joined(findings.select("finding_id", *place), f, place), members, ["_f"]).groupBy("set").agg(F.array_sort(F.collect_set("finding_id")).alias("finding_ids"))
    return joined(per, groups, ["_fs"]).select("bait_id", "set"), sets


def bait_pairs(findings: DataFrame, baits: DataFrame) -> DataFrame:
    """bait_id, finding_id: a row for each hit, however many a bait has."""
    a = findings.select("finding_id", F.col("file_path").alias("path"), F.col("line_start").alias("a_start"), F.col("line_end").alias("a_end"))
    return places_met(a, baits.select("bait_id", F.col("file_path").alias("e_path"), "line_start", "line_end"), []).select("bait_id", "finding_id").distinct()


def judge_matches(results: DataFrame, expected: DataFrame) -> DataFrame:
    """Results (probe_id, issues array<struct<finding_id, file_path, line_start, line_end, claim_type, category, evidence>>) spelled out, then matched as findings."""
    each = results.select("probe_id", F.explode("issues").alias("i")).select("probe_id", "i.*")
    return finding_matches(each, expected)


def benchmark_findings(issues: DataFrame) -> DataFrame:
    """Issues of AI review that aren't about style; their order is (created_on, issue_id)."""
    return issues.where(F.col("source").isin("ai_review", "KB") & (F.col("category") != "style"))


def benchmark_expected(items: DataFrame, probes: DataFrame) -> DataFrame:
    """Items (id, detectors, probes, claim_type) that AI review is to detect, with their own probes or those that `probes` (claim_type,
    probes) has for the claim; it fails where neither has any."""
    kept = items.where((F.size("detectors") <= 0) | F.array_contains("detectors", "ai_review"))
    rows = kept.join(probes.select("claim_type", F.col("probes").alias("usual")), "claim_type", "left").withColumn("probes", F.when(F.size("probes") > 0, F.col("probes")).otherwise(F.col("usual"))).drop("usual")
    return rows.where(F.assert_true(F.coalesce(F.size("probes") > 0, F.lit(False)), F.lit("an expected issue has no probe")).isNull())


def benchmark_stages(results: DataFrame, gold: DataFrame) -> DataFrame:
    """Results (corpus, stage, query, rank) of each gold query (query, ord), whose order is (corpus, stage, ord); a query without a result has no rank.

    Each gold query carries the runs, which are what a benchmark is set up with.
    """
    runs = results.groupBy().agg(F.collect_set(F.struct("corpus", "stage")).alias("runs"))
    each = gold.select("query", "ord").join(F.broadcast(runs)).select("query", "ord", F.inline("runs"))  # one row
    return each.join(results, ["corpus", "stage", "query"], "left").select("corpus", "stage", "ord", "query", "rank")


#: Separators and brackets of tech stacks. Fixed values.
STACK_SEPARATORS = [",", ";", "\n"]
STACK_GROUPS = {")": "(", "]": "[", "}": "{"}
_STACK_TOKEN = re.compile(r'"(?:\\.|[^"\\])*"|[()\[\]{},;\n"]|[^()\[\]{},;\n"]+', re.DOTALL)


def _stack_items(text: str) -> list[str]:
    """Tokens are whole quotations, single signs and runs of other characters; a quotation mark that stands alone never closes."""
    parts, depth, sound = [""], "", True
    for token in _STACK_TOKEN.findall(text):
        if token in STACK_GROUPS:
            sound &= depth[-1:] == STACK_GROUPS[token]
            depth = depth[:-1]
        elif token in STACK_GROUPS.values():
            depth += token
        sound &= token != '"'
        if token in STACK_SEPARATORS and not depth:
            parts.append("")
        else:
            parts[-1] += token
    parts = [x.strip() for x in (parts if sound and not depth else [text])]
    if sound and not depth:
        parts = [x[1:-1].strip() if len(x) > 1 and x[0] == x[-1] == '"' else x for x in parts]
    return [x for x in parts if x]


@F.pandas_udf(ArrayType(StringType()))
def tech_stack(text: pd.Series) -> pd.Series:
    """Parts between separators outside quotes and brackets; the whole text where these don't match. It needs a stack, hence Python."""
    return pd.Series([None if t is None else _stack_items(t) for t in text])


def tool_value(text: Column, name: str = "input") -> Column:
    """A JSON object stays one (in canonical form); any other JSON or text becomes the value of `name`."""
    v = F.try_parse_json(text)
    return F.when(F.schema_of_variant(v).startswith("OBJECT"), F.to_json(v)).when(v.isNotNull(), F.concat(F.lit(f'{{"{name}":'), F.to_json(v), F.lit("}"))).otherwise(F.to_json(F.struct(text.alias(name))))


def tool_status(output: Column) -> Column:
    """Of a tool's output (a JSON object): `error` if it has one, its status if that is a text, else `ok`."""
    v = F.try_parse_json(output)
    status = F.when(_kind(_at(v, "$.status"), "STRING"), F.nullif(_at(v, "$.status", "string"), F.lit("")))
    return F.when(_at(v, "$.error").isNotNull(), "error").otherwise(F.coalesce(status, F.lit("ok")))


def ingested(docs: DataFrame, keys: list[str], text: str, embeddings: DataFrame, cache_key: Column) -> tuple[DataFrame, DataFrame]:
    """Chunks with their vectors, and postings of the chunks, out of one lineage. embeddings (cache_id, vector)."""
    chunks = split_documents(docs, keys, text).withColumn("cache_id", cache_key)
    vectors = chunks.join(embeddings.select("cache_id", "vector"), "cache_id", "left")
    doc = F.concat_ws(":", *[F.col(k).cast("string") for k in keys], F.col("chunk_index").cast("string"))
    return vectors, postings(chunks.select(doc.alias("doc"), "content"), "doc", "content")

