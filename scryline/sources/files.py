"""File sources: manifests, binaries, trees, catalogues, analyzer output (IDs S01 - S09, S22, S23, A08, A27, P21, U03, X29 - X32, F34)."""

from __future__ import annotations

import ast
from pathlib import Path

import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession, functions as F
from pyspark.sql.types import ArrayType, StringType

from scryline.functions.text import dependency_names, file_name, is_review_target, lines, lookup, relative_path

# Fixed values.
IGNORED_DIRS = [".git", ".mypy_cache", ".pytest_cache", ".ruff_cache", "__pycache__", "build", "dist", "node_modules", "venv", ".venv"]
BINARY_EXTENSIONS = [".7z", ".class", ".dll", ".dylib", ".exe", ".gif", ".ico", ".jar", ".jpeg", ".jpg", ".lockb", ".mp3", ".mp4", ".o", ".pdf", ".png", ".pyc", ".pyo", ".so", ".wasm", ".webp", ".zip"]
MOST_BYTES = 1_048_576
LANGUAGES = {"py": "python", "js": "javascript", "jsx": "javascript", "ts": "typescript", "tsx": "typescript", "java": "java", "go": "go", "rs": "rust", "rb": "ruby", "php": "php", "cs": "csharp", "cpp": "cpp", "c": "c", "kt": "kotlin", "swift": "swift", "md": "markdown", "json": "json", "yml": "yaml", "yaml": "yaml", "toml": "toml", "html": "html", "css": "css", "sql": "sql", "sh": "shell"}


def extension(path: Column) -> Column:
    """Lower-cased extension with its dot, empty if there is none."""
    return F.regexp_extract(file_name(path), r".(\.[^.]*)$", 1)


def is_binary(path: Column, content: Column) -> Column:
    """By extension, or a NUL among the first 4,096 bytes; unreadable content counts as binary."""
    nul = F.instr(F.decode(F.substring(content, 1, 4096), "ISO-8859-1"), "\0") > 0
    return extension(path).isin(BINARY_EXTENSIONS) | F.coalesce(nul, F.lit(True))


def file_manifest(spark: SparkSession, root: str, tracked: DataFrame | None = None, most_bytes: int = MOST_BYTES) -> DataFrame:
    """Path (below root), length, content of the files to look at, by path. tracked (path): only these, if given."""
    files = spark.read.format("binaryFile").option("recursiveFileLookup", True).load(root)
    path = F.regexp_replace(F.col("path"), r"^file:/+", "/")
    files = files.where(F.col("length") <= most_bytes).select(relative_path(path, F.lit(str(root))).alias("path"), "length", "content")
    folders = F.slice(F.split("path", "/"), F.lit(1), F.size(F.split("path", "/")) - 1)
    files = files.where(~F.arrays_overlap(folders, F.array(*[F.lit(d) for d in IGNORED_DIRS]))).where(~is_binary(F.col("path"), F.col("content")))
    return (files if tracked is None else files.join(tracked.select("path"), "path", "left_semi")).orderBy("path")


def language(path: Column) -> Column:
    return lookup(LANGUAGES, F.regexp_replace(extension(path), r"^\.", ""))


def tree_entries(files: DataFrame) -> DataFrame:
    """Files (path, length, text) -> path, language, size, lines, should_review, ignore_reason."""
    review = is_review_target(F.col("path"))
    return files.select("path", language(F.col("path")).alias("language"), F.col("length").alias("size_bytes"), F.size(lines(F.col("text"))).alias("line_count"), review.alias("should_review"), F.when(~review, "readme").alias("ignore_reason"))


def nested_tree(files: DataFrame) -> DataFrame:
    """path, parent, depth, kind: one row for each folder and file."""
    p = F.split("path", "/")
    rows = files.select("path", F.size(p).alias("n"), F.explode(F.transform(F.sequence(F.lit(1), F.size(p)), lambda k: F.struct(F.array_join(F.slice(p, F.lit(1), k), "/").alias("node"), F.array_join(F.slice(p, F.lit(1), k - 1), "/").alias("parent"), k.alias("depth")))).alias("e"))
    return rows.select(F.col("e.node").alias("path"), F.col("e.parent").alias("parent"), F.col("e.depth").alias("depth"), F.when(F.col("e.depth") == F.col("n"), "file").otherwise("directory").alias("kind")).distinct()


def primary_language(entries: DataFrame, order: str = "path") -> DataFrame:
    """Languages by number of files; of equally frequent ones, the one seen first leads."""
    return entries.where("language is not null").groupBy("language").agg(F.count("*").alias("files"), F.min(order).alias("first")).orderBy(F.desc("files"), "first")


def check_size(files: DataFrame, most: int = 500 * 1024 * 1024) -> DataFrame:
    """The total, or an error beyond the limit."""
    total = files.agg(F.coalesce(F.sum("length"), F.lit(0)).alias("bytes"))
    return total.where(F.assert_true(F.col("bytes") <= most, F.lit("the repository is too large")).isNull())


def kb_documents(spark: SparkSession, manifest: str) -> DataFrame:
    """A YAML manifest (sources: name, path, glob, language, doc_type, category) -> source, name, content and the literals."""
    import yaml

    sources = (yaml.safe_load(Path(manifest).read_text()) or {}).get("sources") or []
    if not sources:
        raise ValueError("the manifest has no sources")
    out = None
    for s in sources:
        missing = [k for k in ("name", "path", "glob") if not s.get(k)]
        if missing:
            raise ValueError(f"a source lacks {', '.join(missing)}")
        paths = sorted(str(p) for p in (Path(manifest).parent / s["path"]).glob(s["glob"]))
        if not paths:
            raise ValueError(f"{s['name']} has no files")
        df = spark.read.text(paths, wholetext=True).select(F.lit(s["name"]).alias("source"), F.element_at(F.split(F.input_file_name(), "/"), -1).alias("name"), F.col("value").alias("content"), *[F.lit(s.get(k)).cast("string").alias(k) for k in ("language", "doc_type", "category")])
        out = df if out is None else out.unionByName(df)
    return out


RULE_SCHEMA = "rule_id string, week string, priority string, skill_group string, requirement string, category string, check_type string, needs_ai_verification boolean, verification_hint string, rationale string"


def roadmap_rules(spark: SparkSession, path: str) -> DataFrame:
    """Rules of a YAML catalogue; a rule without id, week, skill group or requirement, or an id twice, is an error."""
    import yaml

    rules = (yaml.safe_load(Path(path).read_text()) or {}).get("rules") or []
    names = [c.split()[0] for c in RULE_SCHEMA.split(", ")]
    ids = [r.get("rule_id") for r in rules]
    if bad := [r for r in rules if not all(str(r.get(k) or "").strip() for k in ("rule_id", "week", "skill_group", "requirement"))]:
        raise ValueError(f"rule {bad[0].get('rule_id')} is incomplete")
    if len(set(ids)) < len(ids):
        raise ValueError("a rule_id stands twice")
    rows = [tuple(bool(r.get(n)) if n == "needs_ai_verification" else None if r.get(n) is None else str(r[n]) for n in names) for r in rules]
    return spark.createDataFrame(rows, RULE_SCHEMA)


# Analyzer output. runs: file with a JSON text in stdout; root: the folder that paths are relative to.
def _issue(root: Column, path: Column, start: Column, end: Column, severity: Column, category: str, title: Column, text: Column, suggestion: Column, source: str, confidence: Column) -> list[Column]:
    line = F.when(start >= 1, start)
    return [
        relative_path(F.coalesce(path, F.lit("")), root).alias("file_path"), line.alias("line_start"), F.coalesce(F.when(end >= 1, end), line).alias("line_end"), severity.alias("severity"), F.lit(category).alias("category"),
        title.alias("title"), text.alias("description"), suggestion.alias("suggestion"), F.lit(source).alias("source"), confidence.cast("double").alias("confidence"),
    ]


def ruff_issues(runs: DataFrame, root: str) -> DataFrame:
    """Text that is no JSON array gives nothing."""
    s = "array<struct<code:string,message:string,filename:string,location:struct<row:int>,end_location:struct<row:int>,fix:struct<message:string>>>"
    r = runs.select(F.explode(F.from_json("stdout", s)).alias("i"))
    code, default = F.coalesce(F.nullif(F.trim("i.code"), F.lit("")), F.lit("finding")), "Ruff reported a finding."
    text = F.coalesce(F.nullif(F.trim("i.message"), F.lit("")), F.lit(default))
    title = F.when(code == "finding", F.lit("Ruff finding")).when(text == default, F.concat(F.lit("Ruff "), code)).otherwise(F.concat(F.lit("Ruff "), code, F.lit(": "), text))
    return r.where("i is not null").select(*_issue(F.lit(root), F.col("i.filename"), F.col("i.location.row"), F.col("i.end_location.row"), F.lit("low"), "style", title, text, F.col("i.fix.message"), "ruff", F.lit(0.9)))


def bandit_issues(runs: DataFrame, root: str) -> DataFrame:
    """S06"""
    s = "struct<results:array<struct<filename:string,line_number:int,issue_severity:string,issue_confidence:string,issue_text:string,test_name:string,test_id:string>>>"
    r = runs.select(F.explode(F.from_json("stdout", s)["results"]).alias("i"))
    level = lambda c, table, other: F.coalesce(lookup(table, F.upper(c)), F.lit(other))
    title = F.coalesce(F.nullif(F.col("i.test_name"), F.lit("")), F.nullif(F.col("i.test_id"), F.lit("")), F.lit("Bandit finding"))
    return r.where("i is not null").select(
        *_issue(F.lit(root), F.col("i.filename"), F.col("i.line_number"), F.col("i.line_number"), level("i.issue_severity", {"HIGH": "high", "MEDIUM": "medium", "LOW": "low"}, "low"), "security", title,
                F.coalesce("i.issue_text", F.lit("Bandit reported a finding.")), F.lit("Review the security finding and apply Bandit guidance."), "bandit", level("i.issue_confidence", {"HIGH": 0.9, "MEDIUM": 0.75}, 0.6))
    )


def eslint_issues(runs: DataFrame, root: str) -> DataFrame:
    """S07"""
    s = "array<struct<filePath:string,messages:array<struct<ruleId:string,severity:int,message:string,line:int>>>>"
    r = runs.select(F.explode(F.from_json("stdout", s)).alias("f")).select("f.filePath", F.explode("f.messages").alias("i"))
    return r.where("i is not null").select(
        *_issue(F.lit(root), F.col("filePath"), F.col("i.line"), F.col("i.line"), F.when(F.col("i.severity") == 2, "medium").otherwise("low"), "style", F.concat(F.lit("ESLint "), F.coalesce(F.nullif(F.col("i.ruleId"), F.lit("")), F.lit("finding"))),
                F.coalesce("i.message", F.lit("ESLint reported a finding.")), F.lit("Review the ESLint rule guidance and update the file."), "eslint", F.lit(0.85))
    )


def static_run_documents(runs: DataFrame, issues: DataFrame, key: str) -> DataFrame:
    """Runs with their issues nested, rule id the first that there is."""
    rule = F.coalesce(*[F.get_json_object("raw", f"$.{k}") for k in ("code", "test_id", "ruleId")])
    nested = issues.groupBy(key).agg(F.array_sort(F.collect_list(F.struct("file_path", "line_start", rule.alias("rule_id"), "description", "severity", "category"))).alias("parsed_issues"))
    return runs.join(nested, key, "left")


def by_suffix(files: DataFrame, suffixes: list[str]) -> DataFrame:
    """X31"""
    return files.where(extension(F.col("path")).isin(suffixes))


# Frameworks. Fixed values.
NODE_FRAMEWORKS = {"next": "Next.js", "react": "React", "vue": "Vue", "express": "Express", "tailwindcss": "Tailwind CSS"}
PYTHON_FRAMEWORKS = {"fastapi": "FastAPI", "django": "Django", "flask": "Flask", "celery": "Celery", "sqlalchemy": "SQLAlchemy"}


@F.pandas_udf(ArrayType(StringType()))
def python_import_roots(text: pd.Series) -> pd.Series:
    """Distinct top-level modules that each source imports; none where it doesn't parse."""
    out = []
    for t in text:
        roots = set()
        try:
            for n in ast.walk(ast.parse(t or "")):
                if isinstance(n, ast.Import):
                    roots |= {a.name.split(".")[0] for a in n.names}
                elif isinstance(n, ast.ImportFrom) and n.module:
                    roots.add(n.module.split(".")[0])
        except (SyntaxError, ValueError, RecursionError):
            pass
        out.append(sorted(roots))
    return pd.Series(out)


def frameworks(files: DataFrame) -> DataFrame:
    """Files (path, text) -> framework: from package.json, requirement lines and imports."""
    keys = lambda section: F.map_keys(F.from_json("text", "struct<dependencies:map<string,string>,devDependencies:map<string,string>>")[section])
    name = file_name(F.col("path"))
    none = F.array().cast("array<string>")
    node = files.where(name == "package.json").select(F.explode(F.concat(F.coalesce(keys("dependencies"), none), F.coalesce(keys("devDependencies"), none))).alias("d")).select(lookup(NODE_FRAMEWORKS, F.col("d")).alias("framework"))
    listed = files.where(name.rlike(r"^requirements.*\.txt$")).select(F.explode(dependency_names(F.col("text"))).alias("d"))
    used = files.where(F.endswith(name, F.lit(".py"))).select(F.explode(python_import_roots("text")).alias("d"))
    return node.unionByName(listed.unionByName(used).select(lookup(PYTHON_FRAMEWORKS, F.col("d")).alias("framework"))).where("framework is not null").distinct()


def json_lines(spark: SparkSession, path: str, schema: str) -> DataFrame:
    """JSON lines; blank lines are no rows."""
    return spark.read.schema(schema).json(path)


def markdown_report(title: str, row: dict) -> str:
    """Of one collected row."""
    return "\n".join([f"# {title}", "", "| Metric | Value |", "|---|---|", *[f"| {k} | {v} |" for k, v in row.items()]])


def depth_paths(text: Column) -> Column:
    """Indented tree text as array of (depth, name), two spaces a level."""
    rows = F.filter(lines(text), lambda x: F.trim(x) != "")
    return F.transform(rows, lambda x: F.struct(F.floor((F.length(x) - F.length(F.ltrim(x))) / 2).cast("int").alias("depth"), F.trim(x).alias("name")))
