"""Queries of retrieval lanes, judge payloads, persisted issues, reports and benchmarks, with their DuckDB SQL."""

from __future__ import annotations

from pyspark.sql import Window, functions as F

from scryline.functions import claims
from scryline.operators import findings, lanes, review_flow, review_plan
from scryline.plans.adapters import duck_with, table, view
from scryline.plans.plan_queries import COVERAGE_SQL, coverage_probes
from scryline.plans.review_queries import EXPECTED, I_SQL, RISKY, REPORT_SQL, issues


#: What stands for a document's id, first word, first words, a confidence of 0.0 to 1.2 and a line of 0 to 3, in the cases below; in words of both engines.
MARKS = {
    "%I%": "concat('p', CAST(doc_id AS STRING))",
    "%W%": "coalesce(nullif(regexp_extract(lower(text), '[a-z]+', 0), ''), 'none')",
    "%T%": "concat('words ', trim(regexp_replace(substring(text, 1, 80), '[^a-zA-Z]+', ' ')))",
    "%C%": "concat(CAST(CAST(floor(doc_id % 13 / 10) AS INT) AS STRING), '.', CAST(doc_id % 13 % 10 AS STRING))",
    "%L%": "CAST(n_chars % 4 AS STRING)",
}


def _case_of(texts: list[str], column: str, duck: bool) -> str:
    """The document's case, by its id, with what its marks stand for."""
    quoted = lambda x: "'" + (x.replace("'", "''") if duck else x.replace("\\", "\\\\").replace("'", "\\'").replace("\n", "\\n")) + "'"
    cases = ", ".join(quoted(x) for x in texts)
    out = f"[{cases}][doc_id % {len(texts)} + 1]" if duck else f"array({cases})[doc_id % {len(texts)}]"
    for mark, value in MARKS.items():
        if any(mark in x for x in texts):
            value = value.replace("AS STRING", "AS VARCHAR").replace("[^a-zA-Z]+', ' ')", "[^a-zA-Z]+', ' ', 'g')") if duck else value
            out = f"replace({out}, '{mark}', {value})"
    return f"{out} AS {column}"


def _documents_as(spark, sf, **texts: list[str]):
    """doc_id and each document's cases."""
    return table(spark, sf, "documents").selectExpr("doc_id", *[_case_of(t, name, False) for name, t in texts.items()])


def _by_case(names: list[str], cases: list[tuple]) -> str:
    """What is due by hand for each case, with the documents' own words in it."""
    return f"SELECT doc_id, {', '.join(_case_of([c[k] for c in cases], name, True) for k, name in enumerate(names))} FROM documents"


#: Judges' payloads, with marks.
PAYLOADS = [
    '{"results": [{"probe_id": "%I%", "verdict": "issue", "confidence": %C%, "issues": [{"title": "%T%", "line_start": %L%, "line_end": 2}]}]}',
    '{"results": [{"probe_id": "%I%", "verdict": "issue", "issues": [{"title": "%T%", "line_start": "%L%"}, {"line_start": 0}, 7]}, {"probe_id": "%W%", "verdict": "no_issue"}]}',
    '{"results": [{"probe_id": "%I%", "verdict": "issue", "issues": []}]}',
    '{"results": [{"probe_id": "%I%", "verdict": "no_issue", "issues": [{"title": "%T%"}]}, {"probe_id": "c", "verdict": "uncertain", "issues": []}]}',
    '{"results": [{"probe_id": "", "verdict": "no_issue"}, {"probe_id": "%W%", "verdict": "maybe"}, 5, "%T%"]}',
    '{"results": [{"probe_id": "%I%", "verdict": "issue", "issues": {"title": "%T%"}}]}',
    '{"results": {"probe_id": "%I%"}}', '{"results": []}', '{"other": "%T%"}', "no json, %T%", '["%T%"]',
    '{"candidates": [{"probe_id": "%I%", "verdict": "issue", "title": "%T%", "confidence": %C%}, {"probe_id": "%W%", "verdict": "no_issue"}, {"probe_id": "c", "verdict": "issue", "line_end": %L%}]}',
    '{"results": [{"probe_id": "%I%", "verdict": "uncertain", "confidence": %C%}]}',
    '{"results": [{"probe_id": "%I%", "verdict": "no_issue", "issues": null}, {"probe_id": "%W%", "verdict": "no_issue", "confidence": null}]}',
    '{"results": null, "candidates": [{"probe_id": "%I%", "verdict": "no_issue"}]}', '{"candidates": null}', '{"candidates": [3, {"probe_id": 4, "verdict": "issue"}]}',
    '{"results": [{"probe_id": %L%, "verdict": "no_issue"}, {"verdict": "no_issue"}, {"probe_id": "%W%"}, {"probe_id": "%I%", "verdict": "issue", "issues": [{"confidence": "%C%", "line_end": 1.5}, {"confidence": "%C%"}]}]}',
]


def judge_payloads(spark, sf):
    """Payloads of every form, with each document's words, numbers and id."""
    out = review_flow.judge_payloads(_documents_as(spark, sf, payload=PAYLOADS), "doc_id", "payload")
    n = F.aggregate("results", F.lit(0), lambda s, r: s + F.size(r["issues"]))
    return out.select("doc_id", F.size("results").alias("kept"), n.alias("issues"), "rejected", "unscoped", F.array_join(F.transform("results", lambda r: F.concat_ws(":", r["probe_id"], r["verdict"], F.size(r["issues"]).cast("string"))), ",").alias("verdicts"))


_IN = "TRY_CAST(json_extract_string({x}, '$.{k}') AS DOUBLE)"
_OK = "(json_extract_string({x}, '$.{k}') IS NULL OR coalesce({n} >= {low} AND {more}, FALSE))"


def _fits_sql(x: str, keys: tuple[str, ...]) -> str:
    out = []
    for k in keys:
        n = _IN.format(x=x, k=k)
        out.append(_OK.format(x=x, k=k, n=n, low=0 if k == "confidence" else 1, more=f"{n} <= 1" if k == "confidence" else f"{n} = floor({n})"))
    return " AND ".join(out)


PAYLOADS_SQL = f"""
WITH d AS (SELECT doc_id, {_case_of(PAYLOADS, 'p', True)} FROM documents), j AS (SELECT doc_id, CASE WHEN json_valid(p) THEN CAST(p AS JSON) END AS j FROM d),
t AS (SELECT doc_id, NOT coalesce(json_exists(j, '$.results'), FALSE) AS legacy, CASE WHEN json_exists(j, '$.results') THEN json_extract(j, '$.results') WHEN json_exists(j, '$.candidates') THEN json_extract(j, '$.candidates') END AS v FROM j),
x AS (SELECT doc_id, legacy, coalesce(json_type(v) = 'ARRAY', FALSE) AS listed, CASE WHEN json_type(v) = 'ARRAY' THEN from_json(v, '["JSON"]') ELSE [] END AS items FROM t),
r AS (SELECT doc_id, legacy, unnest(items) AS r, generate_subscripts(items, 1) AS k FROM x),
i AS (SELECT *, json_type(r) = 'OBJECT' AS object, json_extract_string(r, '$.verdict') AS verdict, json_type(r, '$.probe_id') = 'VARCHAR' AND json_extract_string(r, '$.probe_id') <> '' AS named,
  CASE WHEN json_type(r) <> 'OBJECT' THEN NULL WHEN legacy THEN CASE WHEN json_extract_string(r, '$.verdict') = 'issue' THEN [r] ELSE [] END WHEN NOT json_exists(r, '$.issues') THEN [] WHEN json_type(r, '$.issues') = 'ARRAY' THEN from_json(json_extract(r, '$.issues'), '["JSON"]') END AS given FROM r),
f AS (SELECT *, list_filter(given, lambda y: json_type(y) = 'OBJECT' AND {_fits_sql('y', ('confidence', 'line_start', 'line_end'))}) AS fit FROM i),
g AS (SELECT *, coalesce(object AND named AND verdict IN ('issue', 'no_issue', 'uncertain') AND given IS NOT NULL AND (verdict = 'issue') = (len(fit) > 0) AND CASE WHEN legacy THEN {_fits_sql('r', ('confidence', 'line_start', 'line_end'))} ELSE {_fits_sql('r', ('confidence',))} END, FALSE) AS good FROM f),
s AS (SELECT doc_id, count(*) FILTER (WHERE good) AS kept, sum(len(fit)) FILTER (WHERE good) AS issues, count(*) FILTER (WHERE NOT good) AS bad, sum(CASE WHEN legacy OR given IS NULL THEN 0 ELSE len(given) - len(fit) END) AS lost,
  string_agg(json_extract_string(r, '$.probe_id') || ':' || verdict || ':' || len(fit), ',' ORDER BY k) FILTER (WHERE good) AS verdicts FROM g GROUP BY doc_id)
SELECT x.doc_id, CAST(coalesce(kept, 0) AS INT) AS kept, CAST(coalesce(issues, 0) AS INT) AS issues, CAST(CASE WHEN listed THEN coalesce(bad + lost, 0) ELSE 1 END AS INT) AS rejected, NOT listed OR coalesce(bad, 0) > 0 AS unscoped, coalesce(verdicts, '') AS verdicts FROM x LEFT JOIN s USING (doc_id)
"""

#: Tech stacks and their parts, joined by bars, with marks.
STACKS = [
    ("Python, %T%; DuckDB\nJava", "Python|%T%|DuckDB|Java"), ('Django (%T%, ORM), "%W%, b"', "Django (%T%, ORM)|%W%, b"), ("Go [gin, %W%], {%T%; y}", "Go [gin, %W%]|{%T%; y}"), ("Rust (%T%, serde", "Rust (%T%, serde"),
    ('%T%, "open', '%T%, "open'), ("A (%W%] , c", "A (%W%] , c"), (" , ;;%W% ", "%W%"), (" ;, ", ""), ('"%W% \\" , r", s', '%W% \\" , r|s'), ("%T%)", "%T%)"),
]


def tech_stacks(spark, sf):
    """Stacks with each document's words in them."""
    return _documents_as(spark, sf, text=[t for t, _ in STACKS]).select("doc_id", F.array_join(review_flow.tech_stack("text"), "|").alias("parts"))


STACKS_SQL = _by_case(["parts"], [(p,) for _, p in STACKS])

#: A tool's input or output, its normal form (of an input, of an output) and its status, with marks.
TOOL_VALUES = [
    ('{"b": %L%, "a": [true, null], "t": "%T%"}', '{"a":[true,null],"b":%L%,"t":"%T%"}', '{"a":[true,null],"b":%L%,"t":"%T%"}', "ok"), ('[%L%, "%W%"]', '{"input":[%L%,"%W%"]}', '{"output":[%L%,"%W%"]}', "ok"), ("%L%", '{"input":%L%}', '{"output":%L%}', "ok"),
    ("plain %T%", '{"input":"plain %T%"}', '{"output":"plain %T%"}', "ok"), ('"%T%"', '{"input":"%T%"}', '{"output":"%T%"}', "ok"), ('{"%W%": ', '{"input":"{\\"%W%\\": "}', '{"output":"{\\"%W%\\": "}', "ok"),
    ('{"x": {"y": "%T%"}, "status": "%W%"}', '{"status":"%W%","x":{"y":"%T%"}}', '{"status":"%W%","x":{"y":"%T%"}}', "%W%"), ("null", '{"input":null}', '{"output":null}', "ok"), ('{"error": null, "status": "%W%"}', '{"error":null,"status":"%W%"}', '{"error":null,"status":"%W%"}', "error"),
    ('{"status": ""}', '{"status":""}', '{"status":""}', "ok"), ('{"status": %L%}', '{"status":%L%}', '{"status":%L%}', "ok"),
]


def tool_inputs(spark, sf):
    """What tools were given and gave, with each document's words, and the status of their logs."""
    v = _documents_as(spark, sf, text=[t for t, *_ in TOOL_VALUES]).withColumn("output", review_flow.tool_value(F.col("text"), "output"))
    return v.select("doc_id", review_flow.tool_value(F.col("text")).alias("value"), "output", review_flow.tool_status(F.col("output")).alias("status"))


INPUTS_SQL = _by_case(["value", "output", "status"], [c[1:] for c in TOOL_VALUES])


def package_mentions(spark, sf):
    """Which packages the pages' texts name, and what an issue of theirs refers to."""
    d = table(spark, sf, "documents").select("doc_id", F.lower("text").alias("t"))
    pick = F.get(F.array(*[F.lit(p) for p in ("next", "tailwindcss", "Le", "zod")]), (F.col("doc_id") % 4).cast("int"))
    rule = F.when(F.col("doc_id") % 3 == 0, F.concat(F.lit("R"), F.col("doc_id").cast("string")))
    refs = review_flow.references(F.when(F.col("doc_id") % 2 == 0, "security").otherwise("bug"), rule, F.col("doc_id") % 2 == 0)
    return d.select("doc_id", review_flow.package_in_text(pick, F.concat("t", F.when(F.col("doc_id") % 8 == 0, " nextjs").when(F.col("doc_id") % 8 == 1, " tailwind").otherwise(""))).alias("named"), F.array_join(refs, ",").alias("refs"))


MENTIONS_SQL = """SELECT doc_id, contains(lower(text) || CASE doc_id % 8 WHEN 0 THEN ' nextjs' WHEN 1 THEN ' tailwind' ELSE '' END, CASE doc_id % 4 WHEN 0 THEN 'next' WHEN 1 THEN 'tailwindcss' WHEN 2 THEN 'le' ELSE 'zod' END)
 OR (doc_id % 4 = 1 AND contains(lower(text) || CASE doc_id % 8 WHEN 1 THEN ' tailwind' ELSE '' END, 'tailwind')) AS named,
CASE WHEN doc_id % 6 = 0 THEN 'roadmap_rule_catalog,R' || doc_id WHEN doc_id % 2 = 0 THEN 'backend_directed_security_probe' ELSE 'backend_directed_probe' END AS refs FROM documents"""


def _candidates(spark, sf):
    """Issues of a job as candidates of the probes that their claims name, by lanes."""
    v = view(spark, sf, "v_issues")
    lane = F.when(F.col("category") == "security", "defect").when(F.col("category").isin("bug", "performance"), "coverage").otherwise("roadmap")
    return v.groupBy("job_id", lane.alias("lane"), F.when(F.col("category") == "bug", 1).when(F.col("category") == "performance", 2).otherwise(0).alias("probe_ord"), "file_path", F.col("line_start").alias("chunk_index")).agg(F.max("confidence").alias("score"))


def lane_selection(spark, sf):
    """Six chunks for each probe; coverage leaves out what was chosen before."""
    return lanes.lane_selection(_candidates(spark, sf), "job_id", 6).select("job_id", "lane", "probe_ord", "rank", "file_path", "chunk_index")


LANE_CTE = duck_with("v_issues") + """, c AS (SELECT job_id, CASE WHEN category = 'security' THEN 'defect' WHEN category IN ('bug', 'performance') THEN 'coverage' ELSE 'roadmap' END AS lane, CASE category WHEN 'bug' THEN 1 WHEN 'performance' THEN 2 ELSE 0 END AS probe_ord,
  file_path, line_start AS chunk_index, max(confidence) AS score FROM v_issues GROUP BY ALL)"""
LANE_SQL = LANE_CTE + """,
d AS (SELECT *, row_number() OVER (PARTITION BY job_id, lane, probe_ord ORDER BY score DESC, file_path, chunk_index) AS rank FROM c WHERE lane <> 'coverage' QUALIFY rank <= 6),
a AS (SELECT *, row_number() OVER (PARTITION BY job_id ORDER BY score DESC, file_path, chunk_index) AS rank FROM c WHERE lane = 'coverage' AND probe_ord = 1 AND NOT EXISTS (SELECT 1 FROM d WHERE d.lane = 'defect' AND d.job_id = c.job_id AND d.file_path = c.file_path AND d.chunk_index = c.chunk_index) QUALIFY rank <= 6),
u AS (SELECT job_id, file_path, chunk_index FROM d WHERE lane = 'defect' UNION SELECT job_id, file_path, chunk_index FROM a),
b AS (SELECT *, row_number() OVER (PARTITION BY job_id ORDER BY score DESC, file_path, chunk_index) AS rank FROM c WHERE lane = 'coverage' AND probe_ord = 2 AND NOT EXISTS (SELECT 1 FROM u WHERE u.job_id = c.job_id AND u.file_path = c.file_path AND u.chunk_index = c.chunk_index) QUALIFY rank <= 6)
SELECT job_id, lane, CAST(probe_ord AS INT) AS probe_ord, CAST(rank AS INT) AS rank, file_path, chunk_index FROM (SELECT * FROM d UNION ALL SELECT * FROM a UNION ALL SELECT * FROM b)"""


#: Budgets under which both trims take effect.
BUNDLE_BUDGET = lanes.Budget(job=28, lanes={"defect": 12, "coverage": 8, "roadmap": 14}, chunks_per_batch=16, probes_per_batch=8)


def _lane_probes(spark, sf):
    """Seven probes in each lane of every job, one for each claim; some have no candidates."""
    jobs = view(spark, sf, "v_issues").select("job_id").distinct()
    each = jobs.select("job_id", F.explode(F.sequence(F.lit(0), F.lit(20))).alias("k"))
    lane = F.get(F.array(*[F.lit(x) for x in lanes.LANES]), F.floor(F.col("k") / 7).cast("int"))
    return each.select("job_id", lane.alias("lane"), (F.col("k") % 7).alias("probe_ord"), F.concat(F.lit("p"), F.col("k").cast("string")).alias("probe_id"), (F.col("k") % 3 + 2).alias("top_k"), (F.col("k") % 4).alias("rank"))


def _lane_candidates(spark, sf):
    """Issues as candidates of their claim's probe; those of half the jobs have none of the third claim."""
    v = view(spark, sf, "v_issues").where("not (job_id % 2 = 0 and claim = 'n_1_query')")
    lane = F.when(F.col("category") == "security", "defect").when(F.col("category").isin("bug", "performance", "style"), "coverage").otherwise("roadmap")
    ord_ = F.array_position(F.array(*[F.lit(c) for c in LANE_CLAIMS]), F.col("claim")).cast("int") - 1
    return v.groupBy("job_id", lane.alias("lane"), ord_.alias("probe_ord"), "file_path", F.col("line_start").alias("chunk_index")).agg(F.max("confidence").alias("score"), F.bool_or(F.col("source") == "bandit").alias("structural"))


LANE_CLAIMS = ["SQL Injection", "hardcoded_secret", "n_1_query", "otp_leakage", "bare_except", "ssrf_external_calls", "pickle_deserialization"]


def lane_bundles(spark, sf):
    """Each probe's chunks after both trims, with what was cut."""
    b = lanes.lane_bundles(_lane_probes(spark, sf), _lane_candidates(spark, sf), "job_id", BUNDLE_BUDGET)
    chunks = F.array_join(F.transform("chunks", lambda c: F.concat_ws(":", c["file_path"], c["chunk_index"].cast("string"))), ",")
    return b.select("job_id", "lane", "probe_ord", "status", "selected", "trimmed_count", chunks.alias("chunks"))


def _trim_sql(rows: str, out: str, keys: str, cap: str) -> str:
    """rows (keys, turn of the bundle, probe_id, rank, place, ...) within the budget; e: the turn of the first empty bundle, from `empty_{out}`."""
    return f"""
{out}_a AS (SELECT *, row_number() OVER (PARTITION BY {keys}, turn ORDER BY place) AS p, count(*) OVER (PARTITION BY {keys}) AS n FROM {rows}),
{out}_m AS (SELECT {keys}, count(DISTINCT turn) AS m FROM {rows} GROUP BY ALL),
{out}_b AS (SELECT x.*, y.m, p = 1 AND turn < coalesce(e.e, 99) AS first FROM {out}_a x JOIN {out}_m y USING ({keys}) LEFT JOIN empty_{out} e USING ({keys})),
{out}_c AS (SELECT *, count_if(structural AND first) OVER (PARTITION BY {keys}, turn) AS had, row_number() OVER (PARTITION BY {keys}, turn, structural AND NOT first ORDER BY place) AS s FROM {out}_b),
{out}_d AS (SELECT *, CASE WHEN first THEN 1 WHEN structural AND s <= 2 - had THEN 2 ELSE 3 END AS phase FROM {out}_c),
{out}_e AS (SELECT *, row_number() OVER (PARTITION BY {keys} ORDER BY phase, CASE WHEN phase < 3 THEN turn END, CASE WHEN phase < 3 THEN place END, rank DESC, score DESC, probe_id DESC, file_path DESC, chunk_index DESC) AS seat FROM {out}_d),
{out} AS MATERIALIZED (SELECT job_id, lane, turn, probe_ord, probe_id, rank, place, file_path, chunk_index, score, structural FROM {out}_e WHERE n <= greatest({cap}, m) OR seat <= greatest({cap}, m))"""


def _bundles_sql() -> str:
    b, names = BUNDLE_BUDGET, ["defect", "coverage", "roadmap"]
    claim = "CASE claim " + " ".join(f"WHEN '{c}' THEN {i}" for i, c in enumerate(LANE_CLAIMS)) + " END"
    lane = "CASE WHEN category = 'security' THEN 'defect' WHEN category IN ('bug', 'performance', 'style') THEN 'coverage' ELSE 'roadmap' END"
    best = "row_number() OVER (PARTITION BY job_id, lane, probe_ord ORDER BY score DESC, file_path, chunk_index) AS place"
    text = duck_with("v_issues") + f""",
pr AS MATERIALIZED (SELECT job_id, ['defect', 'coverage', 'roadmap'][k // 7 + 1] AS lane, k // 7 * 7 + k % 7 AS turn, k % 7 AS probe_ord, 'p' || k AS probe_id, k % 3 + 2 AS top_k, k % 4 AS rank FROM (SELECT DISTINCT job_id FROM v_issues), range(21) r(k)),
ca AS MATERIALIZED (SELECT job_id, {lane} AS lane, {claim} AS probe_ord, file_path, line_start AS chunk_index, max(confidence) AS score, bool_or(source = 'bandit') AS structural FROM v_issues WHERE NOT (job_id % 2 = 0 AND claim = 'n_1_query') GROUP BY ALL),
cp AS MATERIALIZED (SELECT pr.*, file_path, chunk_index, score, structural FROM ca JOIN pr USING (job_id, lane, probe_ord)),
x0 AS MATERIALIZED (SELECT *, {best} FROM cp WHERE lane <> 'coverage' QUALIFY place <= top_k),
d0 AS (SELECT * FROM x0 WHERE lane = 'defect' AND place <= {b.of_probe('defect', True)}),
empty_dt AS (SELECT job_id, lane, min(turn) AS e FROM pr WHERE lane = 'defect' AND NOT EXISTS (SELECT 1 FROM d0 WHERE d0.job_id = pr.job_id AND d0.turn = pr.turn) GROUP BY ALL),{_trim_sql('d0', 'dt', 'job_id, lane', str(b.of_lane('defect', True)))},
u0 AS MATERIALIZED (SELECT job_id, file_path, chunk_index FROM dt)"""
    for i in range(7):
        text += f""",
v{i} AS MATERIALIZED (SELECT *, {best} FROM cp WHERE lane = 'coverage' AND probe_ord = {i} AND NOT EXISTS (SELECT 1 FROM u{i} u WHERE u.job_id = cp.job_id AND u.file_path = cp.file_path AND u.chunk_index = cp.chunk_index) QUALIFY place <= top_k),
u{i + 1} AS MATERIALIZED (FROM u{i} UNION SELECT job_id, file_path, chunk_index FROM v{i})"""
    text += f""",
c0 AS MATERIALIZED ({' UNION ALL '.join(f'FROM v{i}' for i in range(7))}), r0 AS (FROM x0 WHERE lane = 'roadmap'),
was AS (SELECT job_id, turn, count(*) AS selected FROM (FROM x0 UNION ALL FROM c0) GROUP BY ALL)"""
    for name, short in zip(names[1:], "cr"):
        text += f""",
empty_{short}t AS (SELECT job_id, lane, min(turn) AS e FROM pr WHERE lane = '{name}' AND NOT EXISTS (SELECT 1 FROM {short}0 x WHERE x.job_id = pr.job_id AND x.turn = pr.turn) GROUP BY ALL),{_trim_sql(f'{short}0', f'{short}t', 'job_id, lane', str(b.of_lane(name, True)))}"""
    return text + f""",
al AS MATERIALIZED (FROM dt UNION ALL FROM ct UNION ALL FROM rt),
empty_ft AS (SELECT job_id, min(turn) AS e FROM pr WHERE NOT EXISTS (SELECT 1 FROM al WHERE al.job_id = pr.job_id AND al.turn = pr.turn) GROUP BY ALL),{_trim_sql('al', 'ft', 'job_id', str(b.job))},
fin AS (SELECT job_id, turn, count(*) AS n, string_agg(file_path || ':' || chunk_index, ',' ORDER BY place) AS chunks FROM ft GROUP BY ALL)
SELECT job_id, lane, CAST(probe_ord AS INT) AS probe_ord, CASE WHEN selected IS NULL THEN 'no_candidate_evidence' WHEN n IS NULL THEN 'trimmed_by_global_cap' ELSE 'ok' END AS status, CAST(coalesce(selected, 0) AS INT) AS selected,
       CAST(coalesce(selected, 0) - coalesce(n, 0) AS INT) AS trimmed_count, coalesce(chunks, '') AS chunks FROM pr LEFT JOIN was USING (job_id, turn) LEFT JOIN fin USING (job_id, turn)"""


BUNDLES_SQL = _bundles_sql()


def strategy_union(spark, sf):
    """What each source finds for a job, as strategies; how many different chunks, and the first of each."""
    v = view(spark, sf, "v_issues").select("job_id", "file_path", F.col("line_start").alias("chunk_index"), F.col("confidence").alias("score"), "source")
    of = lambda s: v.where(F.col("source") == s)
    rows = review_flow.strategy_union("job_id", {"semantic": of("ai_review"), "bm25": of("KB"), "structural": of("bandit"), "file_scope": of("eslint")})
    first = rows.where("ord = 1").select("job_id", "strategy", "file_path", "chunk_index")
    return review_flow.strategy_counts(rows, "job_id").join(first, ["job_id", "strategy"])


UNION_SQL = duck_with("v_issues") + """, s AS (SELECT job_id, CASE source WHEN 'ai_review' THEN 'semantic' WHEN 'KB' THEN 'bm25' ELSE 'structural' END AS strategy, CASE source WHEN 'eslint' THEN 0 ELSE 1 END AS part, file_path, line_start AS chunk_index, confidence AS score FROM v_issues WHERE source IN ('ai_review', 'KB', 'bandit', 'eslint')),
n AS (SELECT job_id, strategy, count(DISTINCT (file_path, chunk_index)) AS n FROM s GROUP BY ALL), f AS (SELECT *, row_number() OVER (PARTITION BY job_id, strategy ORDER BY part, score DESC, file_path, chunk_index) AS k FROM s QUALIFY k = 1)
SELECT n.*, f.file_path, f.chunk_index FROM n JOIN f USING (job_id, strategy)"""


def review_issues(spark, sf):
    """All findings as judged candidates."""
    i = view(spark, sf, "v_issues")
    c = i.select(
        F.col("issue_id").alias("candidate_id"), "job_id", F.concat(F.lit("probe."), "category").alias("probe_id"), F.when(F.col("severity") == "info", "no_issue").otherwise("issue").alias("verdict"), "confidence",
        F.repeat(F.concat("claim", F.lit(" ")), 30).alias("title"), F.when(F.col("line_start") % 9 > 0, "why").otherwise(" ").alias("description"), F.when(F.col("line_start") % 13 == 0, "docs/README.md").otherwise(F.col("file_path")).alias("file_path"), "line_start", "line_end", "severity", "category",
        F.col("claim").alias("claim_type"), F.when(F.col("source") == "KB", F.concat(F.lit("RC-"), (F.col("line_start") % 3).cast("string"))).alias("rule_id"),
    )
    evidence = i.where("line_end % 5 > 0").select(F.col("issue_id").alias("candidate_id"), (F.col("line_end") % 7 == 0).alias("contradicts"))
    probes = spark.createDataFrame([("probe.security", ["sql_injection", "ssrf"]), ("probe.bug", [])], "probe_id string, allowed_claim_types array<string>")
    rules = spark.createDataFrame([("RC-1",), ("RC-2",)], "rule_id string")
    out = review_flow.review_issues(c, evidence, probes, rules)
    return out.select("candidate_id", "source", "claim_type", "finding_key", F.length("title").alias("title_chars"), F.array_join("references", ",").alias("refs"), F.col("probe_review.rule_id").alias("rule_id"))


REVIEW_SQL = duck_with("v_issues") + """, p AS (SELECT *, CASE WHEN source = 'KB' THEN 'RC-' || (line_start % 3) END AS rule_id,
  CASE claim WHEN 'SQL Injection' THEN 'sql_injection' WHEN 'n_1_query' THEN 'n_plus_one_query' WHEN 'otp_leakage' THEN 'otp_exposure' WHEN 'ssrf_external_calls' THEN 'ssrf' WHEN 'pickle_deserialization' THEN 'unsafe_deserialization' ELSE claim END AS ct FROM v_issues),
k AS (SELECT * FROM p WHERE severity <> 'info' AND confidence >= 0.7 AND line_start % 9 > 0 AND line_start % 13 > 0 AND line_end % 5 > 0 AND line_end % 7 > 0 AND (category <> 'security' OR ct IN ('sql_injection', 'ssrf')))
SELECT issue_id AS candidate_id, CASE WHEN rule_id IS NULL THEN 'ai_review' ELSE 'KB' END AS source, ct AS claim_type,
  CASE WHEN rule_id IS NOT NULL THEN 'roadmap:' || replace(lower(rule_id), '-', '_') ELSE CASE WHEN ct IN ('sql_injection', 'hardcoded_secret') THEN 'security' WHEN ct = 'n_plus_one_query' THEN 'performance' WHEN ct = 'bare_except' THEN 'bug' ELSE category END || ':' || ct END AS finding_key,
  CAST(least(255, 30 * (length(claim) + 1)) AS INT) AS title_chars, CASE WHEN rule_id IN ('RC-1', 'RC-2') THEN 'roadmap_rule_catalog,' || rule_id WHEN category = 'security' THEN 'backend_directed_security_probe' ELSE 'backend_directed_probe' END AS refs, rule_id FROM k"""


def prioritized_files(spark, sf):
    """Three risky files of a job, then its priorities."""
    i = view(spark, sf, "v_issues")
    risky = findings.top_risky_files(i, ["job_id"]).where("rank <= 3")
    wanted = i.select("job_id").distinct().select("job_id", F.posexplode(F.array(F.lit("src/m1.py"), F.lit("src/new.py"), F.lit("src/m2.py"), F.lit("b.py"))).alias("ord", "path"))
    return review_flow.prioritized_files(risky, wanted, "job_id")


PRIORITIZED_SQL = duck_with("v_issues") + f""", {RISKY}, r3 AS (SELECT * FROM risky WHERE rank <= 3), w AS (SELECT job_id, unnest([0, 1, 2, 3]) AS ord, unnest(['src/m1.py', 'src/new.py', 'src/m2.py', 'b.py']) AS path FROM (SELECT DISTINCT job_id FROM v_issues)),
u AS (SELECT job_id, 0 AS part, rank AS ord, path, issue_count, max_severity FROM r3 UNION ALL SELECT job_id, 1, ord, path, 0, 'info' FROM w ANTI JOIN r3 USING (job_id, path))
SELECT job_id, CAST(row_number() OVER (PARTITION BY job_id ORDER BY part, ord, path) AS INT) AS rank, path, issue_count, max_severity FROM u QUALIFY rank <= 5"""


def final_reports(spark, sf):
    """The report of each job anew; files from the report of even jobs, from the newest tree of those divisible by three."""
    i = issues(spark, sf)
    jobs = i.select("job_id").distinct()
    reports = jobs.where("job_id % 2 = 0").select("job_id", (F.col("job_id") + 5).alias("total_files"))
    trees = view(spark, sf, "v_issues").where("job_id % 3 = 0").select("job_id", F.col("created_on").alias("analyzed_at"), F.lit(9).alias("files"))
    risky = review_flow.prioritized_files(findings.top_risky_files(i, ["job_id"]), jobs.select("job_id", F.lit(0).alias("ord"), F.lit("x.py").alias("path")), "job_id")
    out = review_flow.report_rows(i, review_flow.files_analyzed(jobs, reports, trees, "job_id"), risky)
    return out.select("job_id", "total_findings", "raw_issue_count", "critical_count", "total_files", F.array_join(F.transform("top_risky_files", lambda f: f["path"]), ",").alias("files"))


FINAL_SQL = I_SQL + f""", {RISKY}, rr AS ({REPORT_SQL}), fs AS (SELECT job_id, string_agg(path, ',' ORDER BY rank) AS files, count(*) AS n FROM risky GROUP BY job_id)
SELECT rr.job_id, rr.total_findings, rr.raw_issue_count, rr.critical_count, CAST(CASE WHEN rr.job_id % 2 = 0 THEN rr.job_id + 5 WHEN rr.job_id % 3 = 0 THEN 9 ELSE 0 END AS BIGINT) AS total_files, CASE WHEN fs.n < 5 THEN fs.files || ',x.py' ELSE fs.files END AS files FROM rr JOIN fs USING (job_id)"""


def audit_plan(spark, sf):
    """Two baseline probes, the coverage probes, and a rule."""
    base = spark.createDataFrame([("security.sql_nosql_injection", 0), ("bug.async_concurrency", 1)], "probe_id string, ord int")
    cover = coverage_probes(spark, sf).withColumn("ord", F.row_number().over(Window.orderBy(review_plan.priority_rank(F.col("priority")), "file_scope")))  # four rows at most
    road = spark.createDataFrame([("roadmap.rc_w1_16", 0)], "probe_id string, ord int")
    return review_flow.audit_plan(base, cover, road).select("part", "ord", "probe_id", "file_scope")


PLAN_SQL = f"""WITH p AS ({COVERAGE_SQL}) SELECT 1 AS part, CAST(row_number() OVER (ORDER BY CASE priority WHEN 'high' THEN 0 ELSE 1 END, file_scope) AS INT) AS ord, probe_id, file_scope FROM p
UNION ALL SELECT * FROM (VALUES (0, 0, 'security.sql_nosql_injection', NULL), (0, 1, 'bug.async_concurrency', NULL), (2, 0, 'roadmap.rc_w1_16', NULL))"""


def verified_fixes(spark, sf):
    """Orders as selected issues, with a verdict each."""
    o = table(spark, sf, "orders").select(F.col("o_orderkey").alias("issue_id"), F.when(F.col("o_orderstatus") == "P", "rejected").otherwise("planned").alias("status"), F.col("o_custkey").alias("ord"))
    verdict = lambda n: F.when(F.col("issue_id") % n == 0, "unresolved").when(F.col("issue_id") % n == 1, "uncertain").otherwise("fixed").alias("verdict")
    planned = o.where("status = 'planned'")
    return review_flow.verified_fixes(o, planned, planned, planned.select("issue_id", verdict(5)), planned.where("ord % 2 = 0").select("issue_id", verdict(7)))


FIXES_SQL = """WITH o AS (SELECT o_orderkey AS issue_id, o_orderstatus <> 'P' AS planned, o_custkey AS ord FROM orders)
SELECT issue_id, ord, CASE WHEN NOT planned THEN 'uncertain' WHEN issue_id % 5 = 0 OR (ord % 2 = 0 AND issue_id % 7 = 0) THEN 'unresolved' WHEN issue_id % 5 = 1 OR (ord % 2 = 0 AND issue_id % 7 = 1) THEN 'uncertain' ELSE 'fixed' END AS verdict FROM o"""


def retrieval_traces(spark, sf):
    """The selected chunks of defect probes, one row a job."""
    s = lanes.lane_selection(_candidates(spark, sf).where("lane = 'defect'"), "job_id", 6).withColumn("content", F.concat("file_path", F.lit("é")))
    out = review_flow.retrieval_traces(s, "job_id")
    return out.select("job_id", "sent_to_judge", F.array_join(F.transform("results", lambda r: F.concat_ws(":", r["rank"].cast("string"), r["file_path"], r["chunk_index"].cast("string"), r["content_bytes"].cast("string"))), ",").alias("results"))


TRACES_SQL = f"WITH s AS ({LANE_SQL}) SELECT job_id, count(*) AS sent_to_judge, string_agg(rank || ':' || file_path || ':' || chunk_index || ':' || (length(file_path) + 2), ',' ORDER BY rank) AS results FROM s WHERE lane = 'defect' GROUP BY job_id"


def job_traces(spark, sf):
    """X27"""
    return review_flow.job_traces(view(spark, sf, "v_traces"), view(spark, sf, "v_issues"), ["click", "view", "purchase"])


JOB_TRACES_SQL = duck_with("v_traces", "v_issues") + """, t AS (SELECT job_id, count(*) AS events, arg_max(tool, (ts, event_id)) AS last_tool FROM v_traces WHERE tool IN ('click', 'view', 'purchase') GROUP BY job_id),
i AS (SELECT job_id, count(*) FILTER (WHERE source IN ('ai_review', 'KB')) AS a, count(*) FILTER (WHERE source NOT IN ('ai_review', 'KB')) AS s FROM v_issues GROUP BY job_id) SELECT t.*, coalesce(i.a, 0) AS ai_issues, coalesce(i.s, 0) AS static_issues FROM t LEFT JOIN i USING (job_id)"""


def trace_ranks(spark, sf):
    """Where the expected issues of every fiftieth job stand among the defect chunks of the jobs."""
    e = view(spark, sf, "v_issues").where(EXPECTED).select(F.col("issue_id").alias("expected_id"), F.when(F.col("line_start") % 2 == 0, F.array(F.lit("p1"))).otherwise(F.array().cast("array<string>")).alias("probes"), F.regexp_replace("file_path", "^src/", "").alias("file_path"), "line_start", "line_end")
    s = lanes.lane_selection(_candidates(spark, sf).where("lane = 'defect'"), "job_id", 6)
    chunks = F.array_sort(F.collect_list(F.struct("rank", "file_path", F.col("chunk_index").alias("line_start"), (F.col("chunk_index") + 3).alias("line_end"))))
    t = s.groupBy("job_id").agg(chunks.alias("c")).select(F.concat(F.lit("p"), (F.col("job_id") % 3).cast("string")).alias("probe_id"), F.transform("c", lambda x: F.struct(x["file_path"].alias("file_path"), x["line_start"].alias("line_start"), x["line_end"].alias("line_end"))).alias("chunks"))
    return review_flow.trace_ranks(e.dropDuplicates(["expected_id"]), t)


RANKS_SQL = f"""WITH s AS ({LANE_SQL}), {duck_with('v_issues').removeprefix('WITH ')}, e AS (SELECT DISTINCT issue_id AS expected_id, line_start % 2 = 0 AS own, file_path, line_start, line_end FROM v_issues WHERE severity = 'high' AND job_id % 50 = 0),
m AS (SELECT expected_id, min(rank) AS rank FROM e JOIN s USING (file_path) WHERE s.lane = 'defect' AND s.chunk_index <= e.line_end AND s.chunk_index + 3 >= e.line_start AND (NOT own OR s.job_id % 3 = 1) GROUP BY 1) SELECT expected_id, m.rank IS NOT NULL AS retrieved, m.rank FROM e LEFT JOIN m USING (expected_id)"""


def bait_hits(spark, sf):
    """Which critical findings hit the style issues of every fiftieth job."""
    v = view(spark, sf, "v_issues")
    b = v.where("category = 'style' and job_id % 50 = 0").select(F.col("issue_id").alias("bait_id"), F.regexp_replace("file_path", "^src/", "").alias("file_path"), "line_start", "line_end").dropDuplicates(["bait_id"])
    f = v.where("severity = 'critical'").select(F.col("issue_id").alias("finding_id"), "file_path", "line_start", "line_end")
    hit, sets = review_flow.bait_sets(f, b)
    return hit.join(sets.select("set", F.size("finding_ids").alias("n"), F.md5(F.array_join("finding_ids", ",")).alias("ids_md5")), "set").drop("set")  # once for each set


BAIT_SQL = duck_with("v_issues") + """, b AS (SELECT DISTINCT issue_id AS bait_id, file_path, line_start, line_end FROM v_issues WHERE category = 'style' AND job_id % 50 = 0)
SELECT bait_id, CAST(count(DISTINCT f.issue_id) AS INT) AS n, md5(string_agg(DISTINCT f.issue_id, ',' ORDER BY f.issue_id)) AS ids_md5 FROM b JOIN v_issues f ON f.severity = 'critical' AND f.file_path = b.file_path AND f.line_start <= b.line_end AND f.line_end >= b.line_start GROUP BY bait_id"""


def benchmark_findings(spark, sf):
    """What AI review found, by job."""
    return review_flow.benchmark_findings(view(spark, sf, "v_issues")).groupBy("job_id", "source").agg(F.count("*").alias("n"), F.min("created_on").alias("first"))


BENCHMARK_SQL = duck_with("v_issues") + " SELECT job_id, source, count(*) AS n, min(created_on) AS first FROM v_issues WHERE source IN ('ai_review', 'KB') AND category <> 'style' GROUP BY ALL"


def benchmark_expected(spark, sf):
    """Parts as expected issues."""
    p = table(spark, sf, "part")
    items = p.select(F.col("p_partkey").alias("id"), F.when(F.col("p_size") % 3 == 0, F.array(F.lit("bandit"))).when(F.col("p_size") % 3 == 1, F.array(F.lit("bandit"), F.lit("ai_review"))).otherwise(F.array().cast("array<string>")).alias("detectors"),
                     F.when(F.col("p_partkey") % 2 == 0, F.array(F.lit("own"))).otherwise(F.array().cast("array<string>")).alias("probes"), F.col("p_brand").alias("claim_type"))
    usual = p.select(F.col("p_brand").alias("claim_type"), F.array(F.concat(F.lit("probe."), "p_brand")).alias("probes")).distinct()
    return review_flow.benchmark_expected(items, usual).select("id", F.array_join("probes", ",").alias("probes"))


BENCH_EXPECTED_SQL = "SELECT p_partkey AS id, CASE WHEN p_partkey % 2 = 0 THEN 'own' ELSE 'probe.' || p_brand END AS probes FROM part WHERE p_size % 3 > 0"


def benchmark_stages(spark, sf):
    """Sources as corpora, languages as stages, every fiftieth document a gold query."""
    d = table(spark, sf, "documents")
    r = d.select(F.col("source").alias("corpus"), F.col("lang").alias("stage"), F.col("doc_id").alias("query"), (F.col("n_chars") % 10).alias("rank"))
    return review_flow.benchmark_stages(r, d.where("doc_id % 50 = 0").select(F.col("doc_id").alias("query"), F.col("doc_id").alias("ord")))


STAGES_SQL = """WITH r AS (SELECT DISTINCT source AS corpus, lang AS stage FROM documents), g AS (SELECT doc_id, source, lang, n_chars FROM documents WHERE doc_id % 50 = 0)
SELECT r.corpus, r.stage, g.doc_id AS ord, g.doc_id AS query, CASE WHEN g.source = r.corpus AND g.lang = r.stage THEN g.n_chars % 10 END AS rank FROM r, g"""


#: raw output, source, title -> claim, due by hand.
RAW = [
    ('{"test_id": "b301", "claim_type": "x"}', "bandit", "t", "unsafe_deserialization"), ('{"probe_review": {"probe_id": "security.ssrf_external_calls"}}', "ai_review", "t", "ssrf"),
    ('{"probe_review": {"claim_type": ""}, "claim_type": "n_1_query"}', "ai_review", "SQL injection here", "sql_injection"), ('{"claim_type": "OTP leakage"}', "ai_review", "t", "otp_exposure"),
    ('{"finding_key": "security:os_command_injection"}', "KB", "t", "command_injection"), ('{"ruleId": "no-eval"}', "eslint", "Eval used", "eslint_no_eval"), ("{}", "ruff", "Some %W% Title!", "some_%W%_title"), ('{"code": " "}', "ruff", "A %W%", "a_%W%"),
    ('{"claim_type": "own %W% claim"}', "ai_review", "t", "own_%W%_claim"), ('{"code": "X1"}', "%W%", "Odd", "%W%_x1"),
]


def issue_claims(spark, sf):
    """claims out of raw outputs, with each document's words in titles and stored claims."""
    v = _documents_as(spark, sf, raw=[r[0] for r in RAW], source=[r[1] for r in RAW], title=[r[2] for r in RAW])
    return v.select("doc_id", claims.issue_claim(F.col("raw"), F.col("source"), F.col("title"), F.lit("")).alias("claim"))


CLAIMS_SQL = _by_case(["claim"], [(r[3],) for r in RAW])


QUERIES = {
    "judge_payloads": (judge_payloads, PAYLOADS_SQL),
    "tech_stacks": (tech_stacks, STACKS_SQL),
    "tool_inputs": (tool_inputs, INPUTS_SQL),
    "package_mentions": (package_mentions, MENTIONS_SQL),
    "lane_selection": (lane_selection, LANE_SQL),
    "lane_bundles": (lane_bundles, BUNDLES_SQL),
    "strategy_union": (strategy_union, UNION_SQL),
    "review_issues": (review_issues, REVIEW_SQL),
    "prioritized_files": (prioritized_files, PRIORITIZED_SQL),
    "final_reports": (final_reports, FINAL_SQL),
    "audit_plan": (audit_plan, PLAN_SQL),
    "verified_fixes": (verified_fixes, FIXES_SQL),
    "retrieval_traces": (retrieval_traces, TRACES_SQL),
    "job_traces": (job_traces, JOB_TRACES_SQL),
    "trace_ranks": (trace_ranks, RANKS_SQL),
    "bait_hits": (bait_hits, BAIT_SQL),
    "benchmark_findings": (benchmark_findings, BENCHMARK_SQL),
    "benchmark_expected": (benchmark_expected, BENCH_EXPECTED_SQL),
    "benchmark_stages": (benchmark_stages, STAGES_SQL),
    "issue_claims": (issue_claims, CLAIMS_SQL),
}
