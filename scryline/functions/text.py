"""Text, hash and path functions as Column expressions (IDs: SURVEY section 2.9)."""

from __future__ import annotations

from pyspark.sql import Column, functions as F




def any_of(text: Column, terms) -> Column:
    """Whether text contains any of the terms; false for null text."""
    out = F.lit(False)
    for t in terms:
        out = out | F.contains(text, F.lit(t))
    return F.coalesce(out, F.lit(False))


def all_of(text: Column, terms) -> Column:
    out = F.lit(True)
    for t in terms:
        out = out & F.contains(text, F.lit(t))
    return F.coalesce(out, F.lit(False))


def matched(text: Column, pattern: str) -> Column:
    return F.coalesce(F.regexp_like(text, F.lit(pattern)), F.lit(False))


def first_match(pairs, otherwise: Column | None = None) -> Column:
    """The value of the first condition that holds: pairs of (condition, value)."""
    out = None
    for condition, value in pairs:
        value = value if isinstance(value, Column) else F.lit(value)
        out = F.when(condition, value) if out is None else out.when(condition, value)
    return out if otherwise is None else out.otherwise(otherwise)


def lookup(table: dict, key: Column) -> Column:
    """The table's value for key, null if it has none."""
    return F.element_at(F.create_map(*[F.lit(x) for kv in table.items() for x in kv]), key)


# tokens
def tokenize(text: Column) -> Column:
    """lower-cased runs of ASCII letters, digits and underscores, with repeats."""
    return F.transform(F.regexp_extract_all(F.coalesce(text, F.lit("")), F.lit("[a-zA-Z0-9_]+"), F.lit(0)), lambda t: F.lower(t))


def count_tokens(text: Column) -> Column:
    """words and single other visible characters, by Unicode."""
    return F.size(F.regexp_extract_all(F.coalesce(text, F.lit("")), F.lit(r"(?U)\w+|[^\w\s]"), F.lit(0)))


def plain_tokens(text: Column) -> Column:
    """runs between white space."""
    return F.regexp_extract_all(F.coalesce(text, F.lit("")), F.lit(r"(?U)\S+"), F.lit(0))


def estimated_tokens(text: Column) -> Column:
    return F.greatest(F.lit(1), F.size(plain_tokens(text)))


def truncate_embedding_text(text: Column, most: int) -> Column:
    """first 6 characters for each token allowed, then the first tokens only if there are too many."""
    cut = F.substring(text, 1, 6 * most)
    tokens = plain_tokens(cut)
    return F.when(F.size(tokens) > most, F.array_join(F.slice(tokens, 1, most), " ")).otherwise(cut)


# identities
def slug(text: Column, dash: str = "-") -> Column:
    return F.regexp_replace(F.regexp_replace(F.lower(text), "[^a-z0-9]+", dash), f"^{dash}+|{dash}+$", "")


def kb_chunk_id(source: Column, index: Column, content: Column) -> Column:
    """slug, index and the first 12 digits of the content's hash."""
    return F.concat_ws("-", slug(source), index.cast("string"), F.left(F.sha2(content, 256), F.lit(12)))


def joined_hash(*parts: Column) -> Column:
    """sha-256 of the parts with NUL between them (null parts count as empty)."""
    return F.sha2(F.concat_ws("\0", *[F.coalesce(p.cast("string"), F.lit("")) for p in parts]), 256)


def repo_branch_key(repository_id: Column, branch: Column) -> Column:
    """F06"""
    return joined_hash(repository_id, branch)


def index_generation_key(branch_key: Column, commit: Column) -> Column:
    """a blank commit leaves the branch's key."""
    clean = F.trim(F.coalesce(commit, F.lit("")))
    return F.when(clean == "", branch_key).otherwise(joined_hash(branch_key, clean))


def content_hash(content: Column) -> Column:
    return F.sha2(content, 256)


def embedding_cache_id(generation_key: Column, file_path: Column, content_hash_: Column, occurrence: Column, provider: str, model: str, version: str, dimension: int | None, chunker: str) -> Column:
    return joined_hash(generation_key, file_path, content_hash_, occurrence, F.lit(provider), F.lit(model), F.lit(version), F.lit(str(dimension or "unknown")), F.lit(chunker))


# Where a file belongs. Fixed values.
CONFIG_FILENAMES = ["config.py", "settings.py", ".env"]
SECURITY_DIRS = ["auth", "security", "crypto", "middleware"]
SECURITY_IMPORTS = ["jwt", "bcrypt", "hashlib", "cryptography", "secrets"]
DATABASE_DIRS = ["db", "models", "repositories"]
DATABASE_IMPORTS = ["sqlalchemy", "pymongo"]
API_DIRS = ["routers", "api", "endpoints"]


def _strings(values) -> Column:
    return F.array(*[F.lit(v) for v in values])


def path_parts(path: Column) -> Column:
    return F.split(F.lower(F.replace(path, F.lit("\\"), F.lit("/"))), "/")


def file_name(path: Column) -> Column:
    return F.element_at(path_parts(path), -1)


def risk_area(path: Column, imports: Column) -> Column:
    """config, security, database, api, or general; imports: array of module names."""
    parts, roots = path_parts(path), F.transform(imports, lambda i: F.lower(F.substring_index(i, ".", 1)))
    over = lambda a, values: F.coalesce(F.arrays_overlap(a, _strings(values)), F.lit(False))
    return first_match(
        [
            (file_name(path).isin(CONFIG_FILENAMES), "config"),
            (over(parts, SECURITY_DIRS) | over(roots, SECURITY_IMPORTS), "security"),
            (over(parts, DATABASE_DIRS) | over(roots, DATABASE_IMPORTS), "database"),
            (over(parts, API_DIRS), "api"),
        ],
        F.lit("general"),
    )


def module_name(path: Column) -> Column:
    """name of the parent folder, or root."""
    parts = F.split(F.replace(path, F.lit("\\"), F.lit("/")), "/")
    return F.coalesce(F.nullif(F.get(parts, F.size(parts) - 2), F.lit("")), F.lit("root"))


# paths
def normalize_path(path: Column) -> Column:
    """forward slashes, no leading ./, no empty or single-dot parts; null and empty give empty."""
    p = F.regexp_replace(F.trim(F.replace(path, F.lit("\\"), F.lit("/"))), r"^(\./)+", "")
    absolute = F.startswith(p, F.lit("/"))
    inner = F.array_join(F.filter(F.split(p, "/"), lambda x: (x != "") & (x != ".")), "/")
    clean = F.when(absolute, F.concat(F.lit("/"), inner)).otherwise(inner)
    return F.when(path.isNull() | (path == ""), F.lit("")).otherwise(F.when(clean == "", F.lit(".")).otherwise(clean))


def lower_path(path: Column) -> Column:
    """lower case, no leading ./."""
    return F.regexp_replace(F.lower(F.replace(path, F.lit("\\"), F.lit("/"))), r"^(\./)+", "")


def path_matches(actual: Column, expected: Column) -> Column:
    """equal, or ending in /expected."""
    a, e = lower_path(actual), lower_path(expected)
    return (a == e) | F.endswith(a, F.concat(F.lit("/"), e))


def path_suffixes(path: Column) -> Column:
    """all that a path matches: itself, and what follows each of its slashes."""
    parts = F.split(lower_path(path), "/")
    return F.transform(F.sequence(F.lit(1), F.size(parts)), lambda i: F.array_join(F.slice(parts, i, F.size(parts)), "/"))


def relative_path(path: Column, root: Column) -> Column:
    """What follows root; paths elsewhere stay."""
    p = F.replace(path, F.lit("\\"), F.lit("/"))
    r = F.concat(F.rtrim(root, F.lit("/")), F.lit("/"))
    return F.when(F.startswith(p, r), F.substr(p, F.length(r) + 1)).otherwise(p)


# Kinds of path. Fixed values.
README_SUFFIXES = [".adoc", ".markdown", ".md", ".rst", ".txt"]
SEMANTIC_SKIP_DIRS = [".next", "coverage", "generated", "vendor"]
LOCKFILES = ["bun.lock", "bun.lockb", "cargo.lock", "composer.lock", "npm-shrinkwrap.json", "package-lock.json", "pipfile.lock", "pnpm-lock.yaml", "poetry.lock", "uv.lock", "yarn.lock"]
SEMANTIC_SKIP_SUFFIXES = [".css.map", ".js.map", ".min.css", ".min.js"]
EVIDENCE_SUFFIXES = [".md", ".txt"]
EVIDENCE_NAME_PARTS = ["test_spec", "verify_logic"]
EVIDENCE_PATH_PARTS = ["/tests/", "/test/", "__tests__"]
NON_RUNTIME_PATH_PARTS = ["/tests/", "/test/", "/docs/"]
NON_RUNTIME_SUFFIXES = [".md", ".rst"]
TEST_PREFIX = "test_"


def _ends(name: Column, suffixes: list[str]) -> Column:
    out = F.lit(False)
    for x in suffixes:
        out = out | F.endswith(name, F.lit(x))
    return out


def is_review_target(path: Column) -> Column:
    """Not a README."""
    name = file_name(path)
    return ~F.coalesce((name == "readme") | (F.startswith(name, F.lit("readme.")) & _ends(name, README_SUFFIXES)), F.lit(False))


def is_semantic_file(path: Column) -> Column:
    """No generated folder, lock file, minified script or map."""
    name, parts = file_name(path), path_parts(path)
    folders = F.slice(parts, F.lit(1), F.size(parts) - 1)
    return ~(F.arrays_overlap(folders, _strings(SEMANTIC_SKIP_DIRS)) | name.isin(LOCKFILES) | _ends(name, SEMANTIC_SKIP_SUFFIXES))


def is_plain_file(path: Column) -> Column:
    """A semantic file that is no Markdown and a review target."""
    return is_semantic_file(path) & ~F.endswith(file_name(path), F.lit(".md")) & is_review_target(path)


def is_non_runtime_evidence(path: Column) -> Column:
    """P23, for ranking of search results."""
    p, name = F.lower(F.replace(path, F.lit("\\"), F.lit("/"))), file_name(path)
    return _ends(name, EVIDENCE_SUFFIXES) | any_of(name, EVIDENCE_NAME_PARTS) | F.startswith(name, F.lit(TEST_PREFIX)) | any_of(p, EVIDENCE_PATH_PARTS)


def is_non_runtime(path: Column) -> Column:
    """P23, for probe candidates."""
    p, name = F.lower(F.replace(path, F.lit("\\"), F.lit("/"))), file_name(path)
    return any_of(p, NON_RUNTIME_PATH_PARTS) | F.startswith(name, F.lit(TEST_PREFIX)) | _ends(name, NON_RUNTIME_SUFFIXES)


# Secrets. Fixed values.
SECRET_PATTERNS = [
    r"(?U)\bAKIA[0-9A-Z]{16}\b",
    r"(?U)\bghp_[A-Za-z0-9_]{30,}\b",
    r"(?U)\bxox[baprs]-[A-Za-z0-9-]{20,}\b",
    r"(?U)\bsk-[A-Za-z0-9]{32,}\b",
    r"(?Ui)\b(api[_-]?key|secret|password|token)\b\s*[:=]\s*['\"][^'\"]{24,}",
]


def has_secret(text: Column) -> Column:
    """P08"""
    out = F.contains(text, F.lit("PRIVATE KEY-----"))
    for p in SECRET_PATTERNS:
        out = out | F.regexp_like(text, F.lit(p))
    return F.coalesce(out, F.lit(False))


def mask_secrets(text: Column, mask: str = "[REDACTED]") -> Column:
    """what the patterns of P08 find, masked (own design: the source of this function isn't known)."""
    for p in SECRET_PATTERNS:
        text = F.regexp_replace(text, p, mask)
    return text


# Scores. Fixed values.
QUERY_STOP_WORDS = ["and", "for", "the", "this", "that", "with", "rule", "whether", "repository", "requirement", "verification", "hint", "inspect", "evidence", "related", "look", "real", "control", "data", "flow"]
TERM_STOP_WORDS = ["and", "are", "for", "from", "has", "have", "into", "the", "this", "that", "with"]
SOURCE_DIRS = ["app", "api", "backend", "frontend", "src", "services", "routers", "repositories"]
RRF_K = 60


def share_contained(terms: Column, text: Column) -> Column:
    """Share of the terms (an array) that text contains; 0 without terms."""
    hits = F.size(F.filter(terms, lambda t: F.contains(text, t)))
    return F.when(F.size(terms) > 0, hits / F.size(terms)).otherwise(F.lit(0.0))


def query_terms(query: Column) -> Column:
    """F16: distinct lower-cased terms of 3 characters or more that are no stop words."""
    found = F.array_distinct(F.transform(F.regexp_extract_all(query, F.lit("[A-Za-z0-9_/.:-]+"), F.lit(0)), lambda t: F.lower(t)))
    return F.filter(found, lambda t: (F.length(t) >= 3) & ~t.isin(QUERY_STOP_WORDS))


def lexical_score(query: Column, text: Column) -> Column:
    """F16"""
    return F.least(share_contained(query_terms(query), text), F.lit(1.0)) * 0.35


def important_terms(query: Column) -> Column:
    """the first 32 terms of 3 characters or more that are no stop words, repeats included."""
    return F.slice(F.filter(tokenize(query), lambda t: (F.length(t) >= 3) & ~t.isin(TERM_STOP_WORDS)), 1, 32)


def exact_score(query: Column, content: Column, path: Column) -> Column:
    """share of important terms in path and content."""
    return F.least(F.lit(1.0), share_contained(important_terms(query), F.lower(F.concat(path, F.lit("\n"), content))))


def source_path_score(path: Column) -> Column:
    """F18"""
    directory = F.when(F.arrays_overlap(path_parts(path), _strings(SOURCE_DIRS)), 0.2).otherwise(0.0)
    extension = F.when(file_name(path).rlike(r"\.(py|ts|tsx|js|jsx)$"), 0.15).otherwise(0.0)
    return directory + extension - F.when(is_non_runtime_evidence(path), 0.75).otherwise(0.0)


CATEGORY_HINTS = {"security": ["auth", "security", "jwt", "token", "session", "middleware"], "bug": ["service", "worker", "task", "route", "api"], "performance": ["repository", "database", "db", "cache", "query"]}
PROBE_HINTS = {
    "bug.inventory_invariant": ["/repositories/", "/services/", "/schemas/"],
    "security.insecure_randomness": ["/security.py", "/auth.py"],
    "security.jwt_algorithm_allowlist": ["/deps.py", "/security.py", "/config.py"],
    "security.mass_assignment": ["/schemas/", "/repositories/", "/api/"],
    "security.open_redirect": ["/auth.py", "/api/", "/routes/"],
    "security.role_authorization": ["/reports", "/api/", "/services/"],
    "security.sensitive_response_exposure": ["/schemas/", "/reports", "/api/"],
}


def path_score(path: Column, category: str, probe_id: str, query: Column) -> Column:
    """F19"""
    p = F.lower(F.replace(path, F.lit("\\"), F.lit("/")))
    score = F.when(any_of(p, CATEGORY_HINTS.get(category, [])), 0.2).otherwise(0.0)
    score = score + F.when(F.exists(F.slice(important_terms(query), 1, 10), lambda t: F.contains(p, t)), 0.1).otherwise(0.0)
    hints = [(F.contains(p, F.lit(h)), max(0.12, 0.34 - 0.1 * i)) for i, h in enumerate(PROBE_HINTS.get(probe_id, []))]
    if hints:
        score = score + first_match(hints, F.lit(0.0))
    return score - F.when(is_non_runtime(path), 0.45).otherwise(0.0)


def risk_score(chunk_risk: Column, probe_risk: str, category: str) -> Column:
    """F19"""
    rules = [(F.lit(bool(probe_risk)) & (chunk_risk == probe_risk), 0.12)]
    if category == "security":
        rules.append((chunk_risk.isin("security", "config", "api"), 0.12))
    if category == "performance":
        rules.append((chunk_risk.isin("database", "api"), 0.1))
    return first_match(rules, F.lit(0.0))


def weighted_score(vector: Column, bm25: Column) -> Column:
    """0.7 and 0.3 over the signals that are above 0; 0 if none is."""
    weight = F.when(vector > 0, 0.7).otherwise(0.0) + F.when(bm25 > 0, 0.3).otherwise(0.0)
    total = F.when(vector > 0, vector * 0.7).otherwise(0.0) + F.when(bm25 > 0, bm25 * 0.3).otherwise(0.0)
    return F.when(weight > 0, total / weight).otherwise(F.lit(0.0))


def candidate_score(semantic: Column, lexical: Column, exact: Column, path: Column, risk: Column) -> Column:
    """F21"""
    return semantic * 0.45 + lexical * 0.25 + exact * 0.2 + path + risk


def looks_like_symbols(query: Column) -> Column:
    """at least half of the terms (one at least) look like identifiers."""
    terms = F.regexp_extract_all(query, F.lit("[A-Za-z_][A-Za-z0-9_:.]*"), F.lit(0))
    symbolic = F.filter(terms, lambda t: t.rlike(r"::|\.|_") | (t.rlike("[a-z]") & t.rlike("[A-Z]")))
    return (F.size(terms) > 0) & (F.size(symbolic) >= F.greatest(F.lit(1), F.floor(F.size(terms) / 2).cast("int")))


RRF_WEIGHTS = {
    "symbol": {"semantic": 0.25, "bm25": 0.35, "exact": 0.2, "structural": 0.5},
    "guarded": {"semantic": 0.3, "bm25": 0.3, "exact": 0.2, "structural": 0.55},
    "other": {"semantic": 0.35, "bm25": 0.3, "exact": 0.2, "structural": 0.45},
}


def rrf_weight(strategy: Column, category: Column, query: Column) -> Column:
    """a strategy's weight in rank fusion."""
    kind = F.when(looks_like_symbols(query), "symbol").when(category.isin("security", "requirement"), "guarded").otherwise("other")
    return lookup({f"{k}:{s}": w for k, ws in RRF_WEIGHTS.items() for s, w in ws.items()}, F.concat_ws(":", kind, strategy))


def bounded_prior(path: Column, semantic: Column, lexical: Column) -> Column:
    """F23"""
    raw = path * 0.25 + F.least(semantic, F.lit(1.0)) * 0.02 + F.least(lexical, F.lit(1.0)) * 0.02
    return F.greatest(F.lit(-0.12), F.least(F.lit(0.18), raw))


IGNORED_CALLS = ["apirouter", "asyncsession", "basemodel", "depends", "dict", "false", "float", "get", "int", "len", "list", "max", "min", "none", "post", "print", "put", "str", "sum", "super", "token", "true", "user"]


def referenced_symbols(content: Column) -> Column:
    """distinct lower-cased names that are called or begin with a capital."""
    calls = F.regexp_extract_all(content, F.lit(r"(?U)\b([A-Za-z_][A-Za-z0-9_]*)\s*\("), F.lit(1))
    types = F.regexp_extract_all(content, F.lit(r"(?U)\b([A-Z][A-Za-z0-9_]+)\b"), F.lit(1))
    return F.filter(F.array_distinct(F.transform(F.concat(calls, types), lambda n: F.lower(n))), lambda n: ~n.isin(IGNORED_CALLS))


# F26 - F30
def jaccard(a: Column, b: Column) -> Column:
    """of two arrays as sets; 1 if both are empty."""
    union = F.size(F.array_union(a, b))
    return F.when(union == 0, 1.0).otherwise(F.size(F.array_intersect(a, b)) / union)


def normal_query(query: Column) -> Column:
    """single spaces, lower case."""
    return F.lower(F.trim(F.regexp_replace(query, r"(?U)\s+", " ")))


def bounded_query(query: Column, words: int = 64) -> Column:
    """the first 64 words."""
    return F.array_join(F.slice(plain_tokens(query), 1, words), " ")


def unique_terms(text: Column, least: int = 4) -> Column:
    """distinct terms of 4 characters or more in their order."""
    return F.array_distinct(F.filter(tokenize(text), lambda t: F.length(t) >= least))


def preview(text: Column, most: int = 700) -> Column:
    """F29"""
    return F.when(F.length(text) > most, F.concat(F.left(text, F.lit(most)), F.lit("..."))).otherwise(text)


def text_trace(text: Column) -> Column:
    """sizes, hash and preview."""
    return F.struct(F.length(text).alias("chars"), F.octet_length(text).alias("bytes"), F.sha2(text, 256).alias("sha256"), preview(text).alias("preview"))


# F31 - F33, F35, F38 - F39
LINE_ENDS = "\r\n|[\n\x0b\f\r\x1c-\x1e\x85  ]"


def lines(text: Column) -> Column:
    """lines without their ends; an end at the end of the text opens no further line."""
    parts = F.split(text, LINE_ENDS, -1)
    return F.when(F.element_at(parts, -1) == "", F.slice(parts, F.lit(1), F.size(parts) - 1)).otherwise(parts)


def slice_lines(text: Column, first: Column, last: Column) -> Column:
    n = F.greatest(F.lit(0), F.least(last, F.size(lines(text))) - F.greatest(first, F.lit(1)) + 1)
    return F.slice(lines(text), F.greatest(first, F.lit(1)), n)


def numbered(text: Column, first: Column) -> Column:
    """each line with its number."""
    return F.array_join(F.transform(lines(text), lambda x, i: F.concat((first + i).cast("string"), F.lit(": "), x)), "\n")


def source_context(text: Column, start: Column, end: Column, around: int = 2) -> Column:
    """F32: the lines and two more on each side."""
    return slice_lines(text, start - around, end + around)


def diff_files(diff: Column) -> Column:
    """array of (path, diff), one for each file of a unified diff."""
    parts = F.filter(F.split(diff, "(?m)^(?=diff --git )"), lambda p: F.startswith(p, F.lit("diff --git ")))
    return F.transform(parts, lambda p: F.struct(F.regexp_extract(p, r"(?m)^diff --git a/.* b/(.*)$", 1).alias("path"), p.alias("diff")))


def dependency_names(text: Column) -> Column:
    """package names of requirement lines, with single dashes, in lower case."""
    named = F.transform(F.split(text, "\n"), lambda x: F.regexp_extract(F.trim(F.regexp_replace(x, "#.*$", "")), r"^([A-Za-z0-9][A-Za-z0-9._-]*)", 1))
    return F.transform(F.filter(named, lambda x: x != ""), lambda x: F.lower(F.regexp_replace(x, "[-_.]+", "-")))


def needs_route_context(content: Column) -> Column:
    """F38"""
    c = F.lower(content)
    return F.contains(c, F.lit("@router.")) | (F.contains(c, F.lit("depends(")) & F.contains(c, F.lit("def ")))


def github_full_name(url: Column) -> Column:
    """owner/name of a GitHub address, null for any other."""
    name = F.regexp_extract(F.trim(url), r"^(?:https?://(?:www\.)?github\.com/|git@github\.com:)([^/\s]+/[^/\s]+?)(?:\.git)?/?$", 1)
    return F.nullif(name, F.lit(""))


def platform(url: Column) -> Column:
    host = F.lower(F.regexp_extract(url, r"^(?:https?://|git@)(?:www\.)?([^/:]+)", 1))
    return first_match([(F.contains(host, F.lit("github")), "github"), (F.contains(host, F.lit("gitlab")), "gitlab"), (F.contains(host, F.lit("bitbucket")), "bitbucket")], F.lit("other"))


def safe_collection_name(name: Column) -> Column:
    """X37"""
    return F.left(F.regexp_replace(F.lower(name), r"[^\p{Alnum}]", "_"), F.lit(63))
