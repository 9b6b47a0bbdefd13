"""Numbers, dates, JSON and case tables as Column expressions (IDs G01 - G06, G08 - G10, G13, X55)."""

from __future__ import annotations

from pyspark.sql import Column, functions as F

from scryline.functions.text import any_of, first_match, lookup

# Ranks. Fixed values.
SEVERITY_ORDER = {"critical": 0, "high": 1, "medium": 2, "low": 3, "info": 4}
SEVERITY_RANK = {"critical": 5, "high": 4, "medium": 3, "low": 2, "info": 1}
SOURCE_ORDER = {"KB": 0, "ai_review": 1, "secret_scanner": 2, "bandit": 3, "eslint": 4, "ruff": 5}
CATEGORY_PRIORITY = {"security": 1, "bug": 2, "performance": 3, "maintainability": 4, "requirement": 5}
PRIORITY_RANK = {"P0": 3, "P1": 2, "P2": 1}
SEVERITIES = list(SEVERITY_ORDER)
CATEGORIES = ["security", "bug", "performance", "maintainability", "requirement", "style"]
AI_SOURCES = ["ai_review", "KB"]


def severity_order(severity: Column) -> Column:
    return F.coalesce(lookup(SEVERITY_ORDER, severity), F.lit(len(SEVERITY_ORDER)))


def severity_rank(severity: Column) -> Column:
    return F.coalesce(lookup(SEVERITY_RANK, severity), F.lit(0))


def source_order(source: Column) -> Column:
    return F.coalesce(lookup(SOURCE_ORDER, source), F.lit(len(SOURCE_ORDER)))


def report_priority(category: Column, priority: Column | None = None) -> Column:
    base = F.coalesce(lookup(CATEGORY_PRIORITY, category), F.lit(6))
    return base if priority is None else F.when(F.coalesce(priority == "P0", F.lit(False)), 0).otherwise(base)


def trim_rank(category: Column, priority: Column) -> Column:
    """Rank of a probe when bundles are trimmed: category and priority added; higher stays."""
    by_category = F.when((category == "style") | ((category == "maintainability") & (priority == "low")), 0).otherwise(F.coalesce(lookup({"security": 4, "bug": 3, "performance": 2}, category), F.lit(1)))
    return by_category + F.coalesce(lookup({"high": 3, "medium": 2, "low": 1}, priority), F.lit(1))


# G01, G02, G05, A22
def percent(covered: Column, total: Column) -> Column:
    """At most 100, one digit, half to even; 0 without a total."""
    return F.when(total > 0, F.bround(F.least(F.lit(100.0), covered * 100.0 / total), 1)).otherwise(F.lit(0.0))


def ratio(n: Column, d: Column) -> Column:
    return F.when(d > 0, F.bround(n / d, 4)).otherwise(F.lit(0.0))


def js_round(x: Column) -> Column:
    """Half towards plus infinity."""
    return F.floor(x + 0.5)


def review_progress(done: Column, total: Column) -> Column:
    """50 and a share of 42, at most 92."""
    share = F.greatest(F.lit(1), F.floor(F.least(done, total) * 42 / total).cast("int"))
    return F.when((total > 0) & (done > 0), F.least(F.lit(92), F.lit(50) + share)).otherwise(F.lit(50))


def runtime_seconds(started: Column, completed: Column) -> Column:
    """Never negative, null if either is."""
    return F.greatest(F.lit(0.0), (F.unix_micros(completed) - F.unix_micros(started)) / 1e6)


def relative_time(then: Column, now: Column) -> Column:
    """Rounded to the unit that fits, as text; minutes first."""
    minutes = js_round((F.unix_micros(now) - F.unix_micros(then)) / 6e7)
    units = [(60, 1, "minute"), (1440, 60, "hour"), (43200, 1440, "day"), (525600, 43200, "month"), (None, 525600, "year")]
    text = lambda n, u: F.concat(F.abs(n).cast("string"), F.lit(f" {u}"), F.when(F.abs(n) == 1, "").otherwise("s"), F.when(n < 0, " ahead").otherwise(" ago"))
    pairs = [(F.abs(minutes) < 1, F.lit("just now"))] + [(F.abs(minutes) < most if most else F.lit(True), text(js_round(minutes / d), u)) for most, d, u in units]
    return first_match(pairs)


def count_text(n: Column, noun: str) -> Column:
    """Number and noun, with its plural."""
    return F.concat(n.cast("string"), F.lit(f" {noun}"), F.when(n == 1, "").otherwise("s"))


# G06, G08, G09, G13
def json_object_text(text: Column) -> Column:
    """The first JSON object of a fenced or free text, as text; null if what is found doesn't parse."""
    fenced = F.nullif(F.regexp_extract(text, r"(?s)```(?:json)?\s*(\{.*?\})\s*```", 1), F.lit(""))
    free = F.nullif(F.regexp_extract(text, r"(?s)(\{.*\})", 1), F.lit(""))
    found = F.coalesce(fenced, free)
    return F.when(F.try_parse_json(found).isNotNull(), found)


def safe_int(x: Column) -> Column:
    """A whole number, or 0."""
    return F.coalesce(x.try_cast("long"), F.lit(0).cast("long"))


def or_else(a: Column, b: Column) -> Column:
    """a unless it is null or 0, else b."""
    return F.coalesce(F.nullif(a, F.lit(0)), b, F.lit(0))


def token_usage(input_: Column, prompt: Column, output: Column, completion: Column, total: Column) -> Column:
    """(input, output, total) from either naming, null if all are 0."""
    i, o = F.coalesce(input_, prompt, F.lit(0)), F.coalesce(output, completion, F.lit(0))
    t = or_else(total, i + o)
    return F.when((i != 0) | (o != 0) | (t != 0), F.struct(i.alias("input_tokens"), o.alias("output_tokens"), t.alias("total_tokens")))


def one_of(x: Column, values, default: str) -> Column:
    """A value of the domain in lower case, or the default."""
    v = F.lower(F.trim(x))
    return F.when(v.isin(list(values)), v).otherwise(F.lit(default))


def major_version(x: Column) -> Column:
    """The first whole number, null if there is none."""
    return F.regexp_extract(x, r"(\d+)", 1).try_cast("int")


def version_satisfies(actual: Column, wanted: Column) -> Column:
    """Unknown versions satisfy."""
    return F.coalesce(major_version(actual) == major_version(wanted), F.lit(True))


# G10. Fixed values.
REVIEW_WORDS = [
    (["jwt", "auth", "password", "token", "secret"], "security"),
    (["cache", "ttl", "redis", "performance"], "performance"),
    (["websocket", "sse", "pub/sub", "realtime"], "realtime"),
    (["rag", "llm", "memory", "retriev", "chatbot"], "ai"),
]
STRUCTURE_CHECKS = ["required_dependency", "required_folder", "required_file", "required_config_key", "min_file_count"]


def review_category(text: Column, check_type: Column) -> Column:
    """By keywords, the first list that has one; then by the kind of check."""
    t = F.lower(text)
    pairs = [(any_of(t, words), category) for words, category in REVIEW_WORDS]
    return first_match([*pairs, (check_type.isin(STRUCTURE_CHECKS), "structure")], F.lit("requirement"))


def priority_level(value: Column, high=("p0", "high", "critical", "must")) -> Column:
    """High, medium or low."""
    v = F.lower(F.trim(value))
    return first_match([(v.isin(*high), "high"), (v.isin("p1", "medium"), "medium")], F.lit("low"))


RISK_CATEGORY = {**{c: c for c in CATEGORIES}, "api": "bug", "database": "performance", "config": "security"}


def category_for_risk(risk: Column) -> Column:
    return F.coalesce(lookup(RISK_CATEGORY, risk), F.lit("maintainability"))


# X26, X47, X59, P22
def tool_status(stored: Column, tool: Column, error: Column, output_status: Column) -> Column:
    """X26"""
    return F.coalesce(stored, F.when((tool == "_Exception") | error.isNotNull(), F.lit("error")), output_status, F.lit("ok"))


def clean_error(message: Column, fixed: str = "The provider returned an HTML error page.") -> Column:
    """An HTML page becomes a fixed message."""
    m = F.lower(message)
    return F.when(F.contains(m, F.lit("<html")) & F.contains(m, F.lit("</html>")), F.lit(fixed)).otherwise(message)


FIX_PERCENT = {"PENDING": 0, "PREPARING": 10, "GENERATING_PATCH": 45, "VALIDATING": 80, "WAITING_APPROVAL": 100, "APPROVED": 100, "FAILED": 100}


def fix_percent(status: Column) -> Column:
    """X59"""
    return F.coalesce(lookup(FIX_PERCENT, status), F.lit(0))


def clean_metadata(m: Column) -> Column:
    """A map without null values."""
    return F.map_filter(m, lambda k, v: v.isNotNull())
