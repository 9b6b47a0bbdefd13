"""Structural probes over the lower-cased text of Python chunks (IDs M01 - M29).

Twenty-two are Column expressions. Four look at the syntax tree and run as one Pandas UDF, with a text test where
the text doesn't parse. Terms and patterns are fixed values.
"""

from __future__ import annotations

import ast
import re
from collections.abc import Callable, Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame, functions as F
from pyspark.sql.types import ArrayType, StringType

from scryline.functions.text import all_of, any_of, matched

BUILT = ['f"', "f'", ".format("]

#: probe id -> expression over the lower-cased text
TEXT_PROBES: dict[str, Callable[[Column], Column]] = {
    "security.sql_nosql_injection": lambda c: any_of(c, ["execute(", "from_statement(", "raw("]) & any_of(c, [*BUILT, " + "]),
    "security.command_injection": lambda c: any_of(c, ["subprocess", "os.system", "popen("]) & any_of(c, ["shell=true", *BUILT]),
    "security.ssrf_external_calls": lambda c: any_of(c, ["httpx", "requests.", "client.get(", "axios", "fetch("]) & any_of(c, ["url", "uri", "webhook"]),
    "security.object_authorization": lambda c: all_of(c, ["current_user", "get_by_id"]) & any_of(c, ["_id", "id:"]),
    "security.role_authorization": lambda c: all_of(c, ["@router.", "get_current_user"])
    & any_of(c, ["admin", "cost_price", "margin", "profit", "report"])
    & ~any_of(c, ["require_admin", "require_role", "is_admin", "check_permission", "has_permission"]),
    "security.mass_assignment": lambda c: (all_of(c, ["setattr("]) & any_of(c, ["payload", ".items()", "model_dump(", "dict"]))
    | (any_of(c, ["basemodel", "model_dump("]) & matched(c, r"(?U)\b(cost_price|is_admin|is_active|owner_id|role)\b")),
    "security.insecure_randomness": lambda c: any_of(c, ["token", "secret", "password", "credential", "nonce"]) & any_of(c, ["random.seed(", "random.choice(", "random.randint(", "random.random("]),
    "security.open_redirect": lambda c: all_of(c, ["redirectresponse(", "url="]) & any_of(c, ["next", "redirect", "return_url"]) & ~(all_of(c, ["startswith(", "//"]) & any_of(c, ["\\\\", "backslash"])),
    "security.sensitive_response_exposure": lambda c: any_of(c, ["cost_price", "hashed_password", "private_key", "profit", "margin"]) & all_of(c, ["basemodel"]) & matched(c, r"(?U)class\s+[a-z0-9_]*response\b"),
    "security.weak_password_hash": lambda c: all_of(c, ["password"]) & any_of(c, ["md5(", "sha1("]),
    "security.reset_token_lifecycle": lambda c: all_of(c, ["reset", "token"]) & any_of(c, ["redis.set(", ".set(", "setex("]),
    "security.refresh_token_validation": lambda c: all_of(c, ["refresh"]) & any_of(c, ["jwt", "decode(", "token"]),
    "security.logout_revocation": lambda c: all_of(c, ["logout"]) & any_of(c, ["revoke", "blacklist", "success"]),
    "security.otp_exposure_rate_limit": lambda c: any_of(c, ["otp", "verification_code", "one_time_password", "one_time"]),
    "security.insecure_default_credentials": lambda c: any_of(c, ["password", "secret", "api_key", "token"]) & any_of(c, ["getenv(", "field(default=", ' or "']),
    "bug.async_concurrency": lambda c: any_of(c, ["stock", "inventory", "quantity"]) & any_of(c, ["get_by_", "select("]) & all_of(c, ["update_"]) & matched(c, r"(?U)=\s*[a-z_][a-z0-9_.]*\s+-\s+[a-z_]"),
    "bug.inventory_invariant": lambda c: all_of(c, ["delta", "quantity"])
    & (matched(c, r"(?U)\bquantity\s*\+=\s*[a-z_]") | matched(c, r"(?U)\bquantity\s*=\s*[a-z0-9_.]+\.quantity\s*\+\s*[a-z_]"))
    & ~(matched(c, r"(?U)(?:quantity\s*\+\s*delta|new_quantity)\s*<\s*0") | any_of(c, ["checkconstraint", "quantity >= 0", "quantity>=0", "max(0"])),
    "bug.state_transaction_consistency": lambda c: all_of(c, ["except"]) & any_of(c, ["commit(", "update_", "create_"]),
    "bug.task_retry_timeout": lambda c: any_of(c, ["@shared_task", "@celery_app.task", "@app.task"]) & ~any_of(c, ["autoretry_for", "time_limit", "soft_time_limit", "self.retry("]),
    "bug.idempotency_race": lambda c: any_of(c, ["idempotency", "webhook"]) & any_of(c, ["exists(", "get_by_"]) & any_of(c, ["create(", "insert(", "add("]),
    "performance.pagination_bounds": lambda c: any_of(c, [".all()", "scalars().all", "list("]) & any_of(c, ["filtered_", "[p for ", "[item for ", "offset :"]),
    "maintainability.resource_lifecycle": lambda c: any_of(c, ["create_engine(", "create_async_engine("]) & any_of(c, ["def "]),
}

LOG_METHODS = {"critical", "debug", "error", "exception", "info", "log", "warning"}
SENSITIVE = ("api_key", "authorization", "cookie", "credential", "passwd", "password", "secret", "token")
IO_CALLS = (".execute", ".query", ".fetch", ".find", ".get_by_", "repository.", "repo.", "client.")
_LOGGED = re.compile(r"(?:logger|logging)\.(?:debug|info|warning|error|exception|critical)\s*\([^\n]*(?:password|passwd|token|secret|api_key|cookie|authorization|credential)")


def _calls(tree: ast.AST) -> Iterator[ast.Call]:
    return (n for n in ast.walk(tree) if isinstance(n, ast.Call))


def _name(node: ast.AST) -> str:
    try:
        return ast.unparse(node).lower()
    except (ValueError, RecursionError):
        return ""


def _allowed(algorithms: ast.expr | None) -> bool:
    """A list of exactly one entry that reads settings.algorithm."""
    if not isinstance(algorithms, ast.List | ast.Tuple | ast.Set) or len(algorithms.elts) != 1:
        return False
    return ast.dump(algorithms.elts[0]) == ast.dump(ast.parse("settings.algorithm", mode="eval").body)


def jwt_algorithms(text: str, tree: ast.AST | None) -> bool:
    """M07"""
    if tree is None:
        return "jwt.decode(" in text and ('"none"' in text or "'none'" in text)
    decodes = (c for c in _calls(tree) if isinstance(c.func, ast.Attribute) and c.func.attr == "decode" and isinstance(c.func.value, ast.Name) and c.func.value.id == "jwt")
    return any(not _allowed(next((k.value for k in c.keywords if k.arg == "algorithms"), None)) for c in decodes)


def _identifiers(value: ast.AST) -> Iterator[str]:
    """Names, attributes, and constant keys of subscripts and get() calls."""
    for n in ast.walk(value):
        key = None
        if isinstance(n, ast.Name):
            yield n.id
        elif isinstance(n, ast.Attribute):
            yield n.attr
        elif isinstance(n, ast.Subscript):
            key = n.slice
        elif isinstance(n, ast.Call) and isinstance(n.func, ast.Attribute) and n.func.attr == "get" and n.args:
            key = n.args[0]
        if isinstance(key, ast.Constant) and isinstance(key.value, str):
            yield key.value


def sensitive_logging(text: str, tree: ast.AST | None) -> bool:
    """M08"""
    if tree is None:
        return bool(_LOGGED.search(text))
    for c in _calls(tree):
        if isinstance(c.func, ast.Attribute) and c.func.attr.lower() in LOG_METHODS and "log" in _name(c.func.value):
            values = [v for v in [*c.args, *(k.value for k in c.keywords)] if not isinstance(v, ast.Constant)]
            if any(term in i.lower() for v in values for i in _identifiers(v) for term in SENSITIVE):
                return True
    return False


def file_upload(text: str, tree: ast.AST | None) -> bool:
    """M09"""
    if tree is None:
        return any(t in text for t in ("uploadfile", "multipart", "filename")) and any(t in text for t in (".write(", "copyfileobj(", "shutil.copy(", "shutil.copy2("))
    if not any(isinstance(n, ast.Name) and n.id.lower() == "uploadfile" for n in ast.walk(tree)):
        return False
    return any(_name(c.func).endswith((".write", "copyfileobj", "shutil.copy", "shutil.copy2")) for c in _calls(tree))


def n_plus_one(text: str, tree: ast.AST | None) -> bool:
    """M20"""
    if tree is None:
        return False
    loops = (n for n in ast.walk(tree) if isinstance(n, ast.For | ast.AsyncFor))
    return any(sink in _name(c.func) for loop in loops for s in loop.body for c in _calls(s) for sink in IO_CALLS)


#: probe id -> function of the lower-cased text and its tree (null where it doesn't parse)
TREE_PROBES: dict[str, Callable[[str, ast.AST | None], bool]] = {
    "security.jwt_algorithm_allowlist": jwt_algorithms,
    "security.sensitive_data_logging": sensitive_logging,
    "security.unrestricted_file_upload": file_upload,
    "performance.n_plus_one": n_plus_one,
}


def parsed(text: str) -> ast.AST | None:
    try:
        return ast.parse(text)
    except (SyntaxError, ValueError, RecursionError, MemoryError):
        return None


@F.pandas_udf(ArrayType(StringType()))
def tree_probes(text: pd.Series) -> pd.Series:
    """The tree probes that match each lower-cased text; each text is parsed once."""
    out = []
    for t in text:
        tree = parsed(t) if t is not None else None
        out.append([k for k, f in TREE_PROBES.items() if t is not None and f(t, tree)])
    return pd.Series(out)


def matched_probes(chunks: DataFrame, text: str = "chunk_text", trees: bool = True, probes: list[str] | None = None) -> DataFrame:
    """chunks with _probes, the ids of the probes that match, of all or of some; only Python chunks match."""
    low = F.lower(F.col(text))
    wanted = {k: f for k, f in TEXT_PROBES.items() if probes is None or k in probes}
    found = lambda c: F.filter(F.array(*[F.when(f(c), F.lit(k)) for k, f in wanted.items()]).cast("array<string>"), lambda k: k.isNotNull())
    flags = F.get(F.transform(F.array(low), found), 0)  # the text is bound: it is put together and lowered once, not for each term
    python = F.lower("language") == "python"
    if trees and (probes is None or any(k in probes for k in TREE_PROBES)):
        flags = F.concat(flags, F.coalesce(tree_probes(low), F.array().cast("array<string>")))
        flags = flags if probes is None else F.filter(flags, lambda k: k.isin(probes))
    return chunks.withColumn("_probes", F.when(python & F.col(text).isNotNull(), flags).otherwise(F.array().cast("array<string>")))


OTP_SIGNALS = [
    ["@router.", '"/otp', "'/otp"],
    ["debug_otp", "return", "response", "logger"],
    ["depends(", "current_user", "authenticated", "authorize"],
    ["random.randint", "random.randrange", "secrets.", "token_urlsafe"],
    ["create_otp", "save_otp", "store_otp", "otprecord", "otp_code", "otp_hash", "hashed_otp"],
    ["rate_limit", "attempt", "throttle", "lockout"],
    ["expire", "ttl", "delete", "used_at", "consumed"],
]


def otp_bonus(content: Column, chunk_type: Column) -> Column:
    """M28"""
    signals = lambda c: sum((F.when(any_of(c, terms), 0.12).otherwise(0.0) for terms in OTP_SIGNALS), F.lit(0.0))
    found = lambda c: F.struct(F.when(all_of(c, ["@router.", "/otp"]), 0.4).otherwise(0.0).alias("route"), signals(c).alias("signals"))
    scored = lambda x: x["route"] + F.when((chunk_type == "function") & (x["signals"] > 0), 0.4).otherwise(0.0) + F.least(x["signals"], F.lit(0.6))
    return F.get(F.transform(F.transform(F.array(F.lower(content)), found), scored), 0)  # text and signals are bound, so each is computed once


def shape_bonus(probe_id: Column, chunk_type: Column, path: Column, content: Column) -> Column:
    """M27"""
    kind, p = F.lower(chunk_type), F.lower(F.replace(path, F.lit("\\"), F.lit("/")))
    return (
        F.when(probe_id == "security.sensitive_response_exposure", F.when((kind == "class") & F.contains(p, F.lit("/schemas/")), 0.8).otherwise(0.0))
        .when(probe_id == "security.otp_exposure_rate_limit", otp_bonus(content, kind))
        .otherwise(F.when(kind == "function", 0.4).otherwise(0.0))
    )


def structural_candidates(chunks: DataFrame, base: Column, probes: list[str] | None = None) -> DataFrame:
    """A row for each probe (all, or some) and chunk that match, with its score; base: the candidate's own score."""
    rows = matched_probes(chunks, probes=probes).withColumn("probe_id", F.explode_outer("_probes")).where("probe_id is not null").drop("_probes")  # for the inner form Spark computes the probes once more, to test that there are any
    return rows.withColumn("score", base + 0.5 + shape_bonus(F.col("probe_id"), F.col("chunk_type"), F.col("file_path"), F.col("chunk_text")))


def structural_order() -> list[Column]:
    """Best score first, then the narrowest, then path and index."""
    return [F.desc("score"), F.asc(F.col("line_end") - F.col("line_start")), F.desc("file_path"), F.asc("chunk_index")]
