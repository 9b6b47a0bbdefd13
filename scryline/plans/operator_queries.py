"""Queries of operators that none of the others shows, with their DuckDB SQL."""

from __future__ import annotations

from pyspark.sql import functions as F

from scryline.functions import matchers, scalars, text as T
from scryline.operators import lookups, reports, review_plan, trace
from scryline.operators.findings import severity_counts
from scryline.operators.graph import context_paths, project_of
from scryline.plans.adapters import duck_with, table, view
from scryline.sources import files, store

#: Folders and files that pages are said to stand for.
FOLDERS = ["auth", "src/api", "db/models", "docs", "tests", "x.y", ".next/static", "lib/services"]
NAMES = ["config.py", "login.ts", "README.md", "package-lock.json", "app.min.js", "test_a.py", "Dockerfile", "notes.rst", "deps.tar.gz", "main", "routers.go"]


def _pick(values: list[str], by: str, duck: bool) -> str:
    quoted = ", ".join(f"'{v}'" for v in values)
    return f"[{quoted}][{by} % {len(values)} + 1]" if duck else f"array({quoted})[{by} % {len(values)}]"


def _page_paths(spark, sf):
    path = f"concat(regexp_replace(url, '^[a-z]+://', ''), '/', {_pick(FOLDERS, 'page_id', False)}, '/', {_pick(NAMES, 'page_id', False)})"
    return table(spark, sf, "pages").selectExpr("page_id", f"{path} AS path", "array('jwt.api', 'os', NULL)[page_id % 3] AS module", "html")


PAGE_PATHS = f"WITH p AS (SELECT page_id, regexp_replace(url, '^[a-z]+://', '') || '/' || {_pick(FOLDERS, 'page_id', True)} || '/' || {_pick(NAMES, 'page_id', True)} AS path, ['jwt.api', 'os'][page_id % 3 + 1] AS module, html FROM pages), s AS (SELECT *, lower(path) AS l, string_split(lower(path), '/') AS parts, string_split(lower(path), '/')[-1] AS name FROM p)"


def path_kinds(spark, sf):
    """Where each page's path belongs, and why it would be reviewed."""
    p, imports = F.col("path"), F.array_compact(F.array("module"))
    reason = review_plan.smart_reason(T.risk_area(p, imports), p)
    return _page_paths(spark, sf).select(
        "page_id", T.risk_area(p, imports).alias("risk"), T.is_semantic_file(p).alias("semantic"), T.is_plain_file(p).alias("plain"), T.is_non_runtime_evidence(p).alias("evidence"), files.language(p).alias("language"),
        files.extension(p).alias("extension"), reason.alias("reason"), review_plan.selection_rank(reason).alias("rank"), review_plan.fallback_rank(T.risk_area(p, imports), p).alias("fallback"), T.relative_path(p, F.substring_index("path", "/", 1)).alias("below"),
    )


_IN = lambda names, of: f"len(list_intersect({of}, {names!r})) > 0"
_RISK = f"CASE WHEN name IN ('config.py', 'settings.py', '.env') THEN 'config' WHEN {_IN(T.SECURITY_DIRS, 'parts')} OR module = 'jwt.api' THEN 'security' WHEN {_IN(T.DATABASE_DIRS, 'parts')} THEN 'database' WHEN {_IN(T.API_DIRS, 'parts')} THEN 'api' ELSE 'general' END"
_SMART = f"{_IN(review_plan.SMART_PARTS, 'parts')} OR {_IN(review_plan.SMART_PARTS, '[stem]')}"
_CONFIG = f"list_contains({review_plan.SMART_CONFIGS!r}, name)"
_LANGUAGES = " ".join(f"WHEN '.{k}' THEN '{v}'" for k, v in files.LANGUAGES.items())
PATH_KINDS_SQL = PAGE_PATHS + f""", e AS (SELECT *, regexp_extract(name, '.(\\.[^.]*)$', 1) AS ext, regexp_replace(name, '(.)\\.[^.]*$', '\\1') AS stem, NOT (name = 'readme' OR (starts_with(name, 'readme.') AND regexp_matches(name, '\\.(adoc|markdown|md|rst|txt)$'))) AS target,
  NOT (len(list_intersect(parts[:-2], ['.next', 'coverage', 'generated', 'vendor'])) > 0 OR name = 'package-lock.json' OR ends_with(name, '.min.js')) AS semantic FROM s),
r AS (SELECT *, {_RISK} AS risk FROM e),
w AS (SELECT *, CASE WHEN risk <> 'general' THEN 'risk_area:' || risk WHEN {_SMART} THEN 'risk_path' WHEN {_CONFIG} THEN 'project_config' END AS reason FROM r)
SELECT page_id, risk, semantic, semantic AND NOT ends_with(name, '.md') AND target AS plain, ends_with(name, '.md') OR ends_with(name, '.txt') OR starts_with(name, 'test_') OR contains(l, '/tests/') OR contains(l, '/test/') AS evidence,
 CASE ext {_LANGUAGES} END AS language, ext AS extension, reason, CAST(CASE reason WHEN 'risk_area:security' THEN 0 WHEN 'risk_path' THEN 1 WHEN 'risk_area:api' THEN 2 WHEN 'risk_area:database' THEN 3 WHEN 'risk_area:config' THEN 4 WHEN 'project_config' THEN 5 ELSE 10 END AS INT) AS rank,
 CAST(CASE WHEN risk <> 'general' THEN 0 WHEN {_SMART} THEN 1 WHEN {_CONFIG} THEN 2 ELSE 3 END AS INT) AS fallback, substring(path, instr(path, '/') + 1) AS below FROM w"""


def text_traces(spark, sf):
    """Each document's bounded query, terms, preview, sizes, hash and numbered lines."""
    t, d = F.col("text"), table(spark, sf, "documents").where("text is not null")
    trace_ = T.text_trace(t)
    return d.select(
        "doc_id", F.md5(T.bounded_query(t)).alias("bounded"), F.md5(F.array_join(F.slice(T.unique_terms(t), 1, 40), " ")).alias("terms"), F.md5(T.preview(t, 100)).alias("preview"), trace_["chars"].alias("chars"), trace_["bytes"].alias("bytes"), trace_["sha256"].alias("sha256"),
        F.md5(T.numbered(t, F.lit(7))).alias("numbered"), F.size(T.lines(t)).alias("n_lines"), T.needs_route_context(F.concat(t, F.when(F.col("doc_id") % 3 == 0, " x = Depends(a)\ndef f").otherwise(""))).alias("route"), F.md5(F.array_join(T.slice_lines(t, F.lit(2), F.lit(4)), "\n")).alias("slice"),
    )


TRACES_TEXT_SQL = r"""
WITH d AS (SELECT doc_id, text, regexp_extract_all(text, '\S+') AS w, list_transform(regexp_extract_all(text, '[a-zA-Z0-9_]+'), lambda x: lower(x)) AS t, string_split(text, chr(10)) AS l FROM documents WHERE text IS NOT NULL),
n AS (SELECT *, CASE WHEN l[-1] = '' THEN l[:-2] ELSE l END AS ls, list_filter(t, lambda x: length(x) >= 4) AS u FROM d)
SELECT doc_id, md5(array_to_string(w[:64], ' ')) AS bounded, md5(array_to_string(list_filter(u, lambda x, i: list_position(u, x) = i)[:40], ' ')) AS terms, md5(CASE WHEN length(text) > 100 THEN left(text, 100) || '...' ELSE text END) AS preview,
 CAST(length(text) AS INT) AS chars, CAST(strlen(text) AS INT) AS bytes, sha256(text) AS sha256, md5(array_to_string(list_transform(ls, lambda x, i: (6 + i) || ': ' || x), chr(10))) AS numbered, CAST(len(ls) AS INT) AS n_lines,
 contains(lower(text), '@router.') OR (contains(lower(text) || CASE WHEN doc_id % 3 = 0 THEN ' x = depends(a)' || chr(10) || 'def f' ELSE '' END, 'depends(') AND contains(lower(text) || CASE WHEN doc_id % 3 = 0 THEN ' x = depends(a)' || chr(10) || 'def f' ELSE '' END, 'def ')) AS route,
 md5(array_to_string(ls[2:4], chr(10))) AS slice FROM n"""


def addresses(spark, sf):
    """suppliers' addresses as repositories and collections, their comments as error messages."""
    name = F.lower(F.replace("s_name", F.lit("#"), F.lit("/")))
    heads = ["https://github.com/", "git@github.com:", "https://www.github.com/", "https://gitlab.com/", "http://bitbucket.org/", ""]
    url = F.concat(F.get(F.array(*[F.lit(h) for h in heads]), (F.col("s_suppkey") % len(heads)).cast("int")), name, F.when(F.col("s_suppkey") % 2 == 0, ".git").otherwise("/"))
    error = F.when(F.col("s_suppkey") % 5 == 0, F.concat(F.lit("<HTML>"), "s_name", F.lit("</html>"))).otherwise(F.col("s_name"))
    return table(spark, sf, "supplier").select("s_suppkey", T.github_full_name(url).alias("full_name"), T.platform(url).alias("platform"), T.safe_collection_name(F.concat(F.col("s_name"), F.lit("!"), url)).alias("collection"), scalars.clean_error(error).alias("error"))


ADDRESSES_SQL = r"""
WITH u AS (SELECT s_suppkey, s_name, ['https://github.com/', 'git@github.com:', 'https://www.github.com/', 'https://gitlab.com/', 'http://bitbucket.org/', ''][s_suppkey % 6 + 1] || lower(replace(s_name, '#', '/')) || CASE WHEN s_suppkey % 2 = 0 THEN '.git' ELSE '/' END AS u FROM supplier)
SELECT s_suppkey, CASE WHEN s_suppkey % 6 < 3 THEN lower(replace(s_name, '#', '/')) END AS full_name, CASE s_suppkey % 6 WHEN 3 THEN 'gitlab' WHEN 4 THEN 'bitbucket' WHEN 5 THEN 'other' ELSE 'github' END AS platform,
 left(regexp_replace(lower(s_name || '!' || u), '[^a-z0-9]', '_', 'g'), 63) AS collection, CASE WHEN s_suppkey % 5 = 0 THEN 'The provider returned an HTML error page.' ELSE s_name END AS error FROM u"""


def dependencies(spark, sf):
    """Parts as requirement lines of the files of their brands, and the frameworks these make."""
    p = table(spark, sf, "part").withColumn("n", F.get(F.array(*[F.lit(x) for x in ("FastAPI", "django", "numpy", "Celery", "left_pad.x")]), (F.col("p_partkey") % 5).cast("int")))
    line = F.concat("n", F.lit("=="), F.col("p_size").cast("string"), F.lit(".1  # "), "p_name")
    f = p.groupBy("p_brand").agg(F.array_join(F.array_sort(F.collect_set(line)), "\n").alias("text")).withColumn("path", F.concat(F.lit("b/"), "p_brand", F.lit("/requirements-dev.txt")))
    found = files.frameworks(f.select("path", "text")).agg(F.array_join(F.array_sort(F.collect_set("framework")), ",").alias("frameworks"))
    return f.select("p_brand", F.array_join(F.array_sort(F.array_distinct(T.dependency_names(F.col("text")))), ",").alias("names"), F.size(T.dependency_names(F.col("text"))).alias("n"), scalars.major_version(F.col("text")).alias("first")).crossJoin(found)  # one row


DEPENDENCIES_SQL = """
WITH p AS (SELECT *, ['FastAPI', 'django', 'numpy', 'Celery', 'left_pad.x'][p_partkey % 5 + 1] AS n FROM part), l AS (SELECT DISTINCT p_brand, n, n || '==' || p_size || '.1  # ' || p_name AS line, p_size FROM p),
g AS (SELECT p_brand, string_agg(DISTINCT replace(replace(lower(n), '_', '-'), '.', '-'), ',' ORDER BY replace(replace(lower(n), '_', '-'), '.', '-')) AS names, CAST(count(*) AS INT) AS n, CAST(arg_min(p_size, line) AS INT) AS first FROM l GROUP BY p_brand)
SELECT g.*, (SELECT string_agg(DISTINCT CASE n WHEN 'FastAPI' THEN 'FastAPI' WHEN 'django' THEN 'Django' WHEN 'Celery' THEN 'Celery' END, ',' ORDER BY CASE n WHEN 'FastAPI' THEN 'FastAPI' WHEN 'django' THEN 'Django' WHEN 'Celery' THEN 'Celery' END) FROM p) AS frameworks FROM g"""


def event_texts(spark, sf):
    """events' times in words, states, categories and percentages."""
    e = table(spark, sf, "events").withColumn("t", F.col("ts").cast("timestamp"))
    then = F.col("t") - F.expr("make_interval(0, 0, 0, 0, 0, cast(pmod(event_id * 7919, 100000) as int), 0)")
    none, status = F.lit(None).cast("string"), F.get(F.array(*[F.lit(s) for s in ("PENDING", "VALIDATING", "x")]), (F.col("event_id") % 3).cast("int"))
    stored = F.when(F.col("event_id") % 4 == 0, F.col("event_type"))
    return e.select(
        "event_id", scalars.relative_time(then, F.col("t")).alias("ago"), scalars.runtime_seconds(then, F.col("t")).alias("seconds"), scalars.count_text(F.col("event_id") % 3, "finding").alias("n"), scalars.fix_percent(status).alias("percent"),
        scalars.tool_status(stored, F.when(F.col("event_id") % 5 == 0, "_Exception").otherwise(F.col("event_type")), none, F.when(F.col("event_id") % 3 == 0, F.lit("done"))).alias("tool"), scalars.review_category(F.concat_ws(" ", "event_type", F.when(F.col("event_id") % 2 == 0, "JWT of a user").otherwise("cache")), F.lit("required_file")).alias("category"),
        scalars.priority_level(F.concat(F.lit(" P"), (F.col("event_id") % 4).cast("string"))).alias("level"),
    )


EVENT_TEXTS_SQL = """
WITH m AS (SELECT event_id, event_type, (event_id * 7919) % 100000 AS m FROM events), u AS (SELECT *, CASE WHEN m < 60 THEN 1 WHEN m < 1440 THEN 60 WHEN m < 43200 THEN 1440 ELSE 43200 END AS d, CASE WHEN m < 60 THEN 'minute' WHEN m < 1440 THEN 'hour' WHEN m < 43200 THEN 'day' ELSE 'month' END AS unit FROM m),
r AS (SELECT *, CAST(floor(m / d + 0.5) AS BIGINT) AS k FROM u)
SELECT event_id, CASE WHEN m < 1 THEN 'just now' ELSE k || ' ' || unit || CASE WHEN k = 1 THEN '' ELSE 's' END || ' ago' END AS ago, CAST(m * 60 AS DOUBLE) AS seconds, (event_id % 3) || ' finding' || CASE WHEN event_id % 3 = 1 THEN '' ELSE 's' END AS n,
 CAST(CASE event_id % 3 WHEN 0 THEN 0 WHEN 1 THEN 80 ELSE 0 END AS INT) AS percent, CASE WHEN event_id % 4 = 0 THEN event_type WHEN event_id % 5 = 0 THEN 'error' WHEN event_id % 3 = 0 THEN 'done' ELSE 'ok' END AS tool,
 CASE WHEN event_id % 2 = 0 THEN 'security' ELSE 'performance' END AS category, CASE event_id % 4 WHEN 0 THEN 'high' WHEN 1 THEN 'medium' ELSE 'low' END AS level FROM r"""


def event_lookups(spark, sf):
    """Tool events of one user in order, by name, with the row of a key."""
    e = table(spark, sf, "events").withColumns({"kind": F.when(F.col("event_id") % 3 == 0, "tool").when(F.col("event_id") % 3 == 1, "other"), "called_at": F.col("ts"), "sequence": F.col("event_id")}).withColumnRenamed("event_type", "type")
    mine = lookups.trace_events(e.withColumnRenamed("user_id", "job_id"), 7).withColumnRenamed("kind", "event_type")
    tools = lookups.tool_events(mine).where(lookups.name_is("type", "CLICK"))
    one = lookups.by_key(table(spark, sf, "customer"), "c_custkey", 7, ["c_name", "c_nationkey"])
    return tools.select("event_id", "type", F.round("value", 4).alias("value")).crossJoin(one)  # one row


EVENT_LOOKUPS_SQL = "SELECT event_id, event_type AS type, round(value, 4) AS value, c_name, c_nationkey FROM events, customer WHERE user_id = 7 AND event_id % 3 <> 1 AND event_type = 'click' AND c_custkey = 7"


def _rules(spark, sf):
    week = F.when(F.col("p_partkey") % 7 == 0, "GEN").otherwise((F.col("p_partkey") % 5).cast("string"))
    return table(spark, sf, "part").select(
        F.when(F.col("p_partkey") % 11 == 0, "").otherwise(F.concat(F.lit("R"), F.col("p_partkey").cast("string"))).alias("rule_id"), week.alias("week"), F.concat(F.lit("P"), (F.col("p_size") % 3).cast("string")).alias("priority"), F.lit("roadmap_rule").alias("doc_type"),
        F.when(F.col("p_partkey") % 2 == 0, "a").otherwise("b").alias("profile_id"), F.col("p_brand").alias("skill_group"), F.when(F.col("p_partkey") % 3 > 0, F.col("p_name")).alias("requirement"), F.lit(None).cast("string").alias("verification_hint"),
    )


def rule_catalogue(spark, sf):
    """A profile's rules of two weeks and of all, as documents, and whether a loaded half is complete."""
    r = _rules(spark, sf)
    mine = review_plan.applicable_rules(r, "a", ["1", "3"])
    texts = review_plan.rule_text(r.where("rule_id <> ''"))
    done = store.catalogue_complete(mine, mine.where("priority <> 'P0'"))
    return mine.join(texts, "rule_id").select("rule_id", "week", "priority", F.md5("content").alias("content")).crossJoin(done)  # one row


RULES_SQL = """
WITH r AS (SELECT CASE WHEN p_partkey % 11 = 0 THEN '' ELSE 'R' || p_partkey END AS rule_id, CASE WHEN p_partkey % 7 = 0 THEN 'GEN' ELSE CAST(p_partkey % 5 AS VARCHAR) END AS week, 'P' || (p_size % 3) AS priority, p_partkey % 2 = 0 AS a, p_brand, CASE WHEN p_partkey % 3 > 0 THEN p_name END AS req FROM part),
m AS (SELECT * FROM r WHERE a AND rule_id <> '' AND week IN ('GEN', '1', '3'))
SELECT rule_id, week, priority, md5('Rule: ' || rule_id || chr(10) || 'Week: ' || week || chr(10) || 'Skill group: ' || p_brand || coalesce(chr(10) || 'Requirement: ' || req, '')) AS content, (SELECT count(*) = 0 FROM m WHERE priority = 'P0') AS complete FROM m"""


def file_trees(spark, sf):
    """Pages as files: languages by number, folders by depth, the size."""
    f = _page_paths(spark, sf).select("path", F.octet_length("html").cast("long").alias("length"), F.col("html").alias("text"))
    langs = files.primary_language(files.tree_entries(f)).select(F.lit("language").alias("kind"), F.col("language").alias("name"), F.col("files").alias("n"))
    depth = files.nested_tree(f).groupBy("kind", "depth").agg(F.count("*").alias("n")).select("kind", F.col("depth").cast("string").alias("name"), "n")
    size = files.check_size(f, 1 << 50).select(F.lit("bytes").alias("kind"), F.lit("").alias("name"), F.col("bytes").alias("n"))
    lines = files.tree_entries(files.by_suffix(f, [".py", ".md"])).groupBy("should_review").agg(F.sum("line_count").alias("n")).select(F.lit("lines").alias("kind"), F.col("should_review").cast("string").alias("name"), "n")
    return langs.unionByName(depth).unionByName(size).unionByName(lines)


FILE_TREES_SQL = PAGE_PATHS + f""", e AS (SELECT *, regexp_extract(name, '.(\\.[^.]*)$', 1) AS ext, CASE WHEN html = '' THEN 0 WHEN ends_with(html, chr(10)) THEN len(string_split(html, chr(10))) - 1 ELSE len(string_split(html, chr(10))) END AS lines FROM s),
g AS (SELECT CASE ext {_LANGUAGES} END AS language, * FROM e), d AS (SELECT DISTINCT path, string_split(path, '/') AS q FROM s),
t AS (SELECT DISTINCT array_to_string(q[:k], '/') AS node, k, CASE WHEN k = len(q) THEN 'file' ELSE 'directory' END AS kind FROM d, range(1, 40) r(k) WHERE k <= len(q))
SELECT 'language' AS kind, language AS name, count(*) AS n FROM g WHERE language IS NOT NULL GROUP BY language UNION ALL SELECT kind, CAST(k AS VARCHAR), count(*) FROM t GROUP BY ALL UNION ALL SELECT 'bytes', '', CAST(sum(strlen(html)) AS BIGINT) FROM s
UNION ALL SELECT 'lines', CASE WHEN name = 'readme.md' THEN 'false' ELSE 'true' END, CAST(sum(lines) AS BIGINT) FROM g WHERE ext IN ('.py', '.md') GROUP BY ALL"""


def analyzer_outputs(spark, sf):
    """Line items as the JSON that ruff, bandit and eslint print, read again as issues."""
    v = table(spark, sf, "lineitem").where("l_orderkey % 5 = 0").select(F.concat(F.lit("/r/src/m"), (F.col("l_partkey") % 9).cast("string"), F.lit(".py")).alias("f"), (F.col("l_linenumber") - 1).alias("row"), F.concat("l_returnflag", "l_linestatus").alias("m"), F.concat(F.lit("F"), (F.col("l_suppkey") % 4).cast("string")).alias("code"), (F.col("l_partkey") % 3).alias("k"), "l_orderkey")
    by_order = lambda item: v.groupBy("l_orderkey").agg(F.collect_list(item).alias("i"))
    ruff = by_order(F.struct(F.col("code"), F.when(F.col("k") > 0, F.col("m")).alias("message"), F.col("f").alias("filename"), F.struct("row").alias("location"))).select(F.to_json("i").alias("stdout"))
    level = lambda c: F.get(F.array(*[F.lit(x) for x in ("HIGH", "medium", "odd")]), c.cast("int"))
    bandit = by_order(F.struct(F.col("f").alias("filename"), F.col("row").alias("line_number"), level(F.col("k")).alias("issue_severity"), level(F.col("k")).alias("issue_confidence"), F.col("m").alias("issue_text"), F.when(F.col("k") == 1, F.lit("")).otherwise(F.col("code")).alias("test_name"), F.col("code").alias("test_id"))).select(F.to_json(F.struct(F.col("i").alias("results"))).alias("stdout"))
    eslint = v.groupBy("l_orderkey", "f").agg(F.collect_list(F.struct(F.when(F.col("k") > 0, F.col("code")).alias("ruleId"), F.col("k").alias("severity"), F.col("m").alias("message"), F.col("row").alias("line"))).alias("messages")).groupBy("l_orderkey").agg(F.collect_list(F.struct(F.col("f").alias("filePath"), "messages")).alias("i")).select(F.to_json("i").alias("stdout"))
    out = files.ruff_issues(ruff, "/r").unionByName(files.bandit_issues(bandit, "/r")).unionByName(files.eslint_issues(eslint, "/r"))
    return out.groupBy("source", "file_path", "line_start", "severity", "title", "confidence").agg(F.count("*").alias("n"))


ANALYZERS_SQL = """
WITH v AS (SELECT 'src/m' || (l_partkey % 9) || '.py' AS file_path, CASE WHEN l_linenumber > 1 THEN CAST(l_linenumber - 1 AS INT) END AS line_start, l_returnflag || l_linestatus AS m, 'F' || (l_suppkey % 4) AS code, l_partkey % 3 AS k FROM lineitem WHERE l_orderkey % 5 = 0),
a AS (SELECT 'ruff' AS source, file_path, line_start, 'low' AS severity, CASE WHEN k > 0 THEN 'Ruff ' || code || ': ' || m ELSE 'Ruff ' || code END AS title, 0.9 AS confidence FROM v
UNION ALL SELECT 'bandit', file_path, line_start, CASE k WHEN 0 THEN 'high' WHEN 1 THEN 'medium' ELSE 'low' END, code, CASE k WHEN 0 THEN 0.9 WHEN 1 THEN 0.75 ELSE 0.6 END FROM v
UNION ALL SELECT 'eslint', file_path, line_start, CASE WHEN k = 2 THEN 'medium' ELSE 'low' END, 'ESLint ' || CASE WHEN k > 0 THEN code ELSE 'finding' END, 0.85 FROM v)
SELECT source, file_path, line_start, severity, title, CAST(confidence AS DOUBLE) AS confidence, count(*) AS n FROM a GROUP BY ALL"""


def report_lines(spark, sf):
    """Reports in a sentence, reviews under way, first priorities, a merged selection."""
    v = view(spark, sf, "v_issues")
    text = reports.summary_text(severity_counts(v, ["job_id"])).select(F.col("job_id").cast("string").alias("key"), F.lit("summary").alias("kind"), F.col("summary").alias("text"))
    active = reports.active_reviews(view(spark, sf, "v_jobs")).select(F.col("id").cast("string").alias("key"), F.lit("active").alias("kind"), F.concat_ws("|", "status", F.col("is_queued").cast("string")).alias("text"))
    first = reports.first_priorities(v.withColumn("title", F.col("claim")), 25, [F.asc("issue_id"), F.asc("job_id")]).select(F.col("line").alias("key"), F.lit("first").alias("kind"), F.lit("").alias("text"))
    old = view(spark, sf, "v_repos").select(F.col("id").cast("string").alias("key"), F.lit("selection").alias("kind"), F.col("name").alias("text"))
    merged = reports.merge_selection(old, old.where("cast(key as int) % 3 = 0").withColumn("text", F.lit("new")), "key")
    return text.unionByName(active).unionByName(first).unionByName(merged)


REPORT_LINES_SQL = duck_with("v_issues", "v_jobs", "v_repos") + """,
c AS (SELECT job_id, count(*) AS n, """ + ", ".join(f"count(*) FILTER (WHERE severity = '{s}') AS {s}" for s in scalars.SEVERITIES) + """ FROM v_issues GROUP BY job_id)
SELECT CAST(job_id AS VARCHAR) AS key, 'summary' AS kind, n || ' finding' || CASE WHEN n = 1 THEN '' ELSE 's' END || ': ' || """ + " || ', ' || ".join(f"{s} || ' {s}'" for s in scalars.SEVERITIES) + """ AS text FROM c
UNION ALL SELECT CAST(id AS VARCHAR), 'active', status || '|' || CASE WHEN status = 'PENDING' THEN 'true' ELSE 'false' END FROM v_jobs WHERE status IN ('PENDING', 'AI_REVIEWING')
UNION ALL SELECT * FROM (SELECT claim || ' (' || file_path || ':' || line_start || ')', 'first', '' FROM v_issues ORDER BY issue_id, job_id LIMIT 25)
UNION ALL SELECT CAST(id AS VARCHAR), 'selection', CASE WHEN id % 3 = 0 THEN 'new' ELSE name END FROM v_repos"""


def judge_tallies(spark, sf):
    """users' days as judge results: counts, their spelled-out issues, two runs compared."""
    e = table(spark, sf, "events").withColumn("day", F.to_date("ts"))
    r = e.groupBy("user_id", "day").agg(F.count_if(F.col("event_type") == "purchase").alias("p"), F.array_sort(F.collect_list(F.when(F.col("event_type") == "purchase", F.col("event_id")))).alias("issues"), F.count("*").alias("n"))
    r = r.withColumn("verdict", F.when(F.col("n") % 5 == 0, "uncertain").when(F.col("p") > 0, "issue").otherwise("no_issue")).withColumn("lane", F.when(F.col("user_id") % 2 == 0, "a").otherwise("b"))
    counts = trace.judge_counters(r, ["lane"])
    spelt = trace.flattened_results(r.select("lane", "verdict", "issues")).groupBy("lane").agg(F.count("issue").alias("spelt"), F.count("*").alias("rows"))
    both = counts.join(spelt, "lane")
    runs = [both.where(F.col("lane") == x).select(F.explode(F.create_map(*[y for c in ("reported", "issue", "spelt", "rows") for y in (F.lit(c), F.col(c))])).alias("metric", "value")) for x in ("a", "b")]
    return trace.compared(*runs).withColumn("ratio", trace.cost_comparison(F.col("candidate").cast("double"), F.col("baseline").cast("double")))


JUDGE_TALLIES_SQL = """
WITH r AS (SELECT user_id, CAST(ts AS DATE) AS day, count(*) FILTER (WHERE event_type = 'purchase') AS p, count(*) AS n FROM events GROUP BY ALL), v AS (SELECT *, CASE WHEN n % 5 = 0 THEN 'uncertain' WHEN p > 0 THEN 'issue' ELSE 'no_issue' END AS verdict FROM r),
l AS (SELECT user_id % 2 AS lane, CAST(sum(p) AS BIGINT) AS reported, count(*) FILTER (WHERE verdict = 'issue') AS issue, CAST(coalesce(sum(p) FILTER (WHERE verdict = 'issue'), 0) AS BIGINT) AS spelt, CAST(sum(CASE WHEN verdict = 'issue' THEN p WHEN p = 0 THEN 1 ELSE 0 END) AS BIGINT) AS rows FROM v GROUP BY 1),
u AS (UNPIVOT l ON reported, issue, spelt, rows INTO NAME metric VALUE value)
SELECT a.metric, a.value AS baseline, b.value AS candidate, b.value - a.value AS delta, CASE WHEN a.value > 0 THEN round_even(b.value / CAST(a.value AS DOUBLE), 4) END AS ratio FROM u a JOIN u b ON a.metric = b.metric WHERE a.lane = 0 AND b.lane = 1"""


def scoped_candidates(spark, sf):
    """Candidates of one file, without those listed, with one column set, and the only value of a column."""
    v = view(spark, sf, "v_issues").select("issue_id", "job_id", "file_path", "line_start", "line_end", F.col("line_start").alias("chunk_index"), F.col("confidence").alias("score"), "claim")
    own = review_plan.in_scope(v, "src/m7.py")
    rest = store.excluded(own, v.where("claim = 'bare_except'").select("chunk_index"), ["chunk_index"])
    done = store.updated_where(rest, F.col("line_end") == F.col("line_start"), claim=F.lit("one line"))
    only = store.only_value(v.where("job_id = 7").select(F.when(F.col("claim") == "SQL Injection", F.col("claim")).alias("c")), "c")
    return done.groupBy("claim").agg(F.count("*").alias("n"), F.round(F.sum("score"), 6).alias("score")).crossJoin(only)  # one row


SCOPED_SQL = duck_with("v_issues") + """, x AS (SELECT * FROM v_issues WHERE file_path = 'src/m7.py' AND line_start NOT IN (SELECT line_start FROM v_issues WHERE claim = 'bare_except'))
SELECT CASE WHEN line_end = line_start THEN 'one line' ELSE claim END AS claim, count(*) AS n, round(sum(confidence + 0.4), 6) AS score, (SELECT max(claim) FROM v_issues WHERE job_id = 7 AND claim = 'SQL Injection') AS c FROM x GROUP BY 1"""


def workspace_sweeps(spark, sf):
    """Orders as workspaces that were swept, and checks of customers that all hold or don't."""
    o = table(spark, sf, "orders")
    swept = review_plan.cleanup_summary(o.select(F.col("o_orderkey").cast("string").alias("path"), F.floor("o_totalprice").cast("long").alias("bytes"), (F.col("o_orderstatus") == "F").alias("cleaned")))
    checks = review_plan.all_checks(o.select("o_custkey", F.col("o_orderpriority").alias("name"), (F.col("o_orderstatus") != "P").alias("passed")), "o_custkey")
    return checks.select("o_custkey", "passed", F.array_join("failed", ",").alias("failed")).crossJoin(swept)  # one row


SWEEPS_SQL = """
WITH c AS (SELECT o_custkey, bool_and(o_orderstatus <> 'P') AS passed, coalesce(string_agg(DISTINCT o_orderpriority, ',' ORDER BY o_orderpriority) FILTER (WHERE o_orderstatus = 'P'), '') AS failed FROM orders GROUP BY 1),
s AS (SELECT count(*) AS scanned, count(*) FILTER (WHERE o_orderstatus = 'F') AS cleaned, count(*) FILTER (WHERE o_orderstatus <> 'F') AS skipped, CAST(coalesce(sum(CAST(floor(o_totalprice) AS BIGINT)) FILTER (WHERE o_orderstatus = 'F'), 0) AS BIGINT) AS freed FROM orders)
SELECT * FROM c, s"""


def nested_projects(spark, sf):
    """The nearest folder above each page's path that holds a marker, and a page's first context paths."""
    f = _page_paths(spark, sf).select("page_id", "path")
    markers = f.where("page_id % 4 = 0").select(F.regexp_replace("path", "/[^/]*$", "").alias("dir")).unionByName(f.where("page_id % 9 = 0").select(F.substring_index("path", "/", 1).alias("dir")))
    p = project_of(f.select("path").distinct(), markers)
    first = F.array(F.col("path"), F.lit("a"))
    return f.join(p, "path").select("page_id", "project", F.array_join(context_paths(first, F.array(F.lit("a"), F.lit("b")), F.array(F.col("path")), 3), ",").alias("context"))


PROJECTS_SQL = PAGE_PATHS + r""", m AS (SELECT DISTINCT regexp_replace(path, '/[^/]*$', '') AS dir FROM p WHERE page_id % 4 = 0 UNION SELECT string_split(path, '/')[1] FROM p WHERE page_id % 9 = 0),
a AS (SELECT DISTINCT path, array_to_string(string_split(path, '/')[:k], '/') AS dir, k FROM p, range(1, 40) r(k) WHERE k < len(string_split(path, '/'))), b AS (SELECT path, arg_max(dir, k) AS project FROM a JOIN m USING (dir) GROUP BY path)
SELECT page_id, project, path || ',a,b' AS context FROM p LEFT JOIN b USING (path)"""


def structural_scores(spark, sf):
    """Documents with a route of a one-time password, as chunks of three kinds: their structural candidates' scores."""
    code = F.lit("\n@router.post('/otp')\ndef issue(): debug_otp = random.randint(1, 9); save_otp(ttl=3)  # attempt\n")
    c = table(spark, sf, "documents").select(
        "doc_id", F.lit("python").alias("language"), F.concat(F.lit("# "), F.regexp_replace("text", "[\\x00-\\x1F]+", " "), F.when(F.col("doc_id") % 2 == 0, code).otherwise(F.lit("\nclass OtpResponse(BaseModel):\n    margin: int\n"))).alias("chunk_text"),
        F.get(F.array(F.lit("function"), F.lit("class"), F.lit("module")), (F.col("doc_id") % 3).cast("int")).alias("chunk_type"), F.lit("app/schemas/x.py").alias("file_path"), F.lit(0).alias("chunk_index"),
    )
    s = matchers.structural_candidates(c, F.lit(0.1), ["security.otp_exposure_rate_limit", "security.sensitive_response_exposure"])
    return s.select("doc_id", "probe_id", F.round("score", 6).alias("score"))


SCORES_SQL = """
WITH d AS (SELECT doc_id, ['function', 'class', 'module'][doc_id % 3 + 1] AS kind, lower(text) AS t FROM documents),
s AS (SELECT *, doc_id % 2 = 0 AS route, 0.12 * CASE WHEN doc_id % 2 = 0 THEN 1 + 1 + CASE WHEN regexp_matches(t, 'depends\\(|current_user|authenticated|authorize') THEN 1 ELSE 0 END + 1 + 1 + 1 + 1
 ELSE 1 + CASE WHEN regexp_matches(t, 'depends\\(|current_user|authenticated|authorize') THEN 1 ELSE 0 END + CASE WHEN regexp_matches(t, 'random.randint|secrets\\.|token_urlsafe') THEN 1 ELSE 0 END + CASE WHEN regexp_matches(t, 'rate_limit|attempt|throttle|lockout') THEN 1 ELSE 0 END + CASE WHEN regexp_matches(t, 'expire|ttl|delete|used_at|consumed') THEN 1 ELSE 0 END END AS g FROM d)
SELECT doc_id, 'security.otp_exposure_rate_limit' AS probe_id, round(CAST(0.6 + CASE WHEN route THEN 0.4 ELSE 0 END + CASE WHEN kind = 'function' AND g > 0 THEN 0.4 ELSE 0 END + least(g, 0.6) AS DOUBLE), 6) AS score FROM s
UNION ALL SELECT doc_id, 'security.sensitive_response_exposure', round(CAST(0.6 + CASE WHEN kind = 'class' THEN 0.8 ELSE 0 END AS DOUBLE), 6) FROM s WHERE NOT route"""


QUERIES = {
    "path_kinds": (path_kinds, PATH_KINDS_SQL),
    "text_traces": (text_traces, TRACES_TEXT_SQL),
    "addresses": (addresses, ADDRESSES_SQL),
    "dependencies": (dependencies, DEPENDENCIES_SQL),
    "event_texts": (event_texts, EVENT_TEXTS_SQL),
    "event_lookups": (event_lookups, EVENT_LOOKUPS_SQL),
    "rule_catalogue": (rule_catalogue, RULES_SQL),
    "file_trees": (file_trees, FILE_TREES_SQL),
    "analyzer_outputs": (analyzer_outputs, ANALYZERS_SQL),
    "report_lines": (report_lines, REPORT_LINES_SQL),
    "judge_tallies": (judge_tallies, JUDGE_TALLIES_SQL),
    "scoped_candidates": (scoped_candidates, SCOPED_SQL),
    "workspace_sweeps": (workspace_sweeps, SWEEPS_SQL),
    "nested_projects": (nested_projects, PROJECTS_SQL),
    "structural_scores": (structural_scores, SCORES_SQL),
}
