"""Canonical claims and finding keys (IDs F09 - F14). Tables are fixed values."""

from __future__ import annotations

from pyspark.sql import Column, functions as F

from scryline.functions.text import first_match, lookup

GENERIC_CLAIMS = ["hardcoded_credentials", "review_finding", "security_finding", "sensitive_data_exposure"]
PASSWORD_HASH_CLAIMS = ["weak_cryptographic_practice", "weak_cryptography"]
OTP_RANDOMNESS_CLAIMS = [
    "cryptographically_insecure_randomness", "insecure_otp_generation", "insecure_otp_randomness", "insecure_randomness", "non_cryptographic_otp_generation",
    "non_cryptographic_randomness", "otp_generated_using_non_cryptographic_random_function", "otp_random_module", "otp_using_random_module", "predictable_otp_generation",
    "predictable_randomness", "weak_cryptographic_practice", "weak_otp_generation", "weak_random_number_generator_for_otp", "weak_randomness",
]
CATEGORY_OVERRIDES = {
    "bare_except": "bug", "command_injection": "security", "hardcoded_secret": "security", "n_plus_one_query": "performance", "sql_injection": "security", "weak_password_hash": "security",
}
ALIASES = {
    "arbitrary_code_execution_via_pickle": "unsafe_deserialization",
    "default_admin_credentials": "insecure_default_credentials",
    "hardcoded_admin_credentials": "insecure_default_credentials",
    "hardcoded_admin_password": "insecure_default_credentials",
    "insecure_deserialization": "unsafe_deserialization",
    "insecure_deserialization_via_pickle": "unsafe_deserialization",
    "insecure_default_admin_credentials": "insecure_default_credentials",
    "insecure_otp_randomness": "otp_weak_randomness",
    "missing_authorization_check": "missing_object_level_authorization",
    "missing_authorization_check_in_delete": "missing_object_level_authorization",
    "missing_otp_authentication": "otp_missing_authentication",
    "missing_otp_rate_limit": "otp_missing_rate_limit",
    "n_1_query": "n_plus_one_query",
    "os_command_injection": "command_injection",
    "otp_brute_force": "otp_missing_rate_limit",
    "otp_disclosure": "otp_exposure",
    "otp_exposed_in_api_response": "otp_exposure",
    "otp_exposed_in_response": "otp_exposure",
    "otp_generated_using_non_cryptographic_random_function": "otp_weak_randomness",
    "otp_in_api_response": "otp_exposure",
    "otp_leakage": "otp_exposure",
    "otp_no_expiration": "otp_lifecycle",
    "otp_plaintext_persistence": "otp_plaintext_storage",
    "otp_predictable_generation": "otp_weak_randomness",
    "otp_random_module": "otp_weak_randomness",
    "otp_using_random_module": "otp_weak_randomness",
    "password_logged_in_plaintext": "sensitive_data_logging",
    "performance_n_plus_one": "n_plus_one_query",
    "pickle_deserialization": "unsafe_deserialization",
    "plaintext_password_logging": "sensitive_data_logging",
    "sensitive_data_in_logs": "sensitive_data_logging",
    "server_side_request_forgery": "ssrf",
    "ssrf_external_calls": "ssrf",
    "unsafe_deserialization_via_pickle": "unsafe_deserialization",
    "weak_random_number_generator_for_otp": "otp_weak_randomness",
}
PROBE_CLAIMS = {
    "security.command_injection": "command_injection",
    "security.hardcoded_secret": "hardcoded_secret",
    "security.insecure_default_credentials": "insecure_default_credentials",
    "security.open_redirect": "open_redirect",
    "security.sensitive_data_logging": "sensitive_data_logging",
    "security.ssrf_external_calls": "ssrf",
    "security.sql_nosql_injection": "sql_injection",
    "security.unsafe_deserialization": "unsafe_deserialization",
    "security.unrestricted_file_upload": "unrestricted_file_upload",
    "security.weak_password_hash": "weak_password_hash",
}
RULE_CLAIMS = {
    "B301": "unsafe_deserialization", "B403": "unsafe_deserialization", "S301": "unsafe_deserialization", "S403": "unsafe_deserialization",
    "B110": "bare_except", "S110": "bare_except",
    "B105": "hardcoded_secret", "B106": "hardcoded_secret", "B107": "hardcoded_secret", "S105": "hardcoded_secret", "S106": "hardcoded_secret", "S107": "hardcoded_secret",
    "B324": "weak_cryptography", "S324": "weak_cryptography",
    "B602": "command_injection", "B605": "command_injection", "S602": "command_injection", "S605": "command_injection",
    "B608": "sql_injection", "S608": "sql_injection",
}
TITLE_PHRASES = [
    (["otp leakage", "otp exposed", "otp exposed in api", "otp in api response", "otp exposed in response", "debug_otp"], "otp_exposure"),
    (
        ["otp generated using non-cryptographic", "weak random number generator for otp", "otp using random", "otp with random", "non-cryptographic random otp", "insecure random otp"],
        "otp_weak_randomness",
    ),
    (["default admin credential", "default credential"], "insecure_default_credentials"),
    (["unsafe deserial", "pickle"], "unsafe_deserialization"),
    (["hardcoded secret", "hard-coded secret", "hardcoded password", "jwt secret"], "hardcoded_secret"),
    (["server-side request forgery", "ssrf"], "ssrf"),
    (["sensitive data logging", "credential logged", "password logged", "plaintext password"], "sensitive_data_logging"),
    (["sql injection"], "sql_injection"),
]
TOKEN_SETS = [
    (["unsafe", "deserial"], "unsafe_deserialization"),
    (["insecure", "deserial"], "unsafe_deserialization"),
    (["pickle", "deserial"], "unsafe_deserialization"),
    (["pickle", "code", "execution"], "unsafe_deserialization"),
    (["server", "side", "request", "forgery"], "ssrf"),
    (["ssrf"], "ssrf"),
    (["otp", "missing", "authentication"], "otp_missing_authentication"),
    (["otp", "unauthenticated"], "otp_missing_authentication"),
    (["otp", "rate", "limit"], "otp_missing_rate_limit"),
    (["otp", "brute", "force"], "otp_missing_rate_limit"),
    (["otp", "plain", "storage"], "otp_plaintext_storage"),
    (["otp", "exposure"], "otp_exposure"),
    (["otp", "disclosure"], "otp_exposure"),
    (["otp", "exposed"], "otp_exposure"),
    (["otp", "api", "response"], "otp_exposure"),
    (["otp", "weak", "random"], "otp_weak_randomness"),
    (["otp", "predictable"], "otp_weak_randomness"),
    (["otp", "non", "cryptographic"], "otp_weak_randomness"),
    (["otp", "random", "function"], "otp_weak_randomness"),
    (["otp", "random", "generator"], "otp_weak_randomness"),
    (["otp", "random", "module"], "otp_weak_randomness"),
    (["otp", "generated", "random"], "otp_weak_randomness"),
    (["weak", "random", "otp"], "otp_weak_randomness"),
    (["non", "cryptographic", "otp"], "otp_weak_randomness"),
    (["otp", "expiry"], "otp_lifecycle"),
    (["otp", "reuse"], "otp_lifecycle"),
    (["default", "admin", "credential"], "insecure_default_credentials"),
    (["default", "admin", "password"], "insecure_default_credentials"),
]
# Words of contextual claims. Fixed values.
PASSWORD_WORDS = ["credential", "password", "passwords"]
HASH_WORDS = ["hash", "hashed", "hashing", "hashlib", "md5", "sha1"]
OTP_WORDS = ["one", "time", "password"]
WEAK_WORDS = ["randint", "predictable"]
WEAK_PAIRS = [["pseudo", "random"], ["non", "cryptographic", "random"], ["weak", "random"], ["insecure", "random"]]


def bound(x: Column, f) -> Column:
    """f(x), with x computed once: a long expression that uses its input often stays small."""
    return F.get(F.transform(F.array(x), f), F.lit(0))


def _first_of(table, fits) -> Column:
    """The claim of the table's first entry (words, claim) that fits; null if none does."""
    entries = F.array(*[F.struct(F.array(*[F.lit(w) for w in words]).alias("words"), F.lit(claim).alias("claim")) for words, claim in table])
    return F.get(F.filter(entries, lambda e: fits(e["words"])), F.lit(0))["claim"]


def claim_from_title(title: Column) -> Column:
    """of the first group of phrases that the title has one of; null if none."""
    return bound(F.lower(title), lambda t: _first_of(TITLE_PHRASES, lambda words: F.exists(words, lambda w: F.contains(t, w))))


def _has_all(tokens: Column, words: list[str]) -> Column:
    return F.size(F.array_except(F.array(*[F.lit(w) for w in words]), tokens)) == 0


def identifier(text: Column) -> Column:
    """Lower case, each run of other characters than letters and digits one underscore, none at the ends."""
    return F.regexp_replace(F.regexp_replace(F.lower(text), "[^a-z0-9]+", "_"), "^_+|_+$", "")


def normalize_claim(claim: Column, title: Column) -> Column:
    """snake case, aliases, token sets, then the title where the claim says nothing in particular."""
    source = F.coalesce(F.nullif(F.trim(claim), F.lit("")), title)
    snake = identifier(source)
    by_tokens = lambda a: bound(F.split(a, "_"), lambda tokens: _first_of(TOKEN_SETS, lambda words: F.size(F.array_except(words, tokens)) == 0))
    aliased = bound(F.coalesce(F.nullif(snake, F.lit("")), F.lit("review_finding")), lambda p: F.coalesce(lookup(ALIASES, p), p))
    return bound(aliased, lambda a: F.coalesce(by_tokens(a), F.when(a.isin(GENERIC_CLAIMS), claim_from_title(title)), a))


def contextual_claim(claim: Column, context: Column) -> Column:
    """broad claims that their context makes precise."""
    tokens = F.regexp_extract_all(F.lower(context), F.lit("[a-z0-9]+"), F.lit(0))
    some = lambda words: F.arrays_overlap(tokens, F.array(*[F.lit(w) for w in words]))
    hashes = some(PASSWORD_WORDS) & some(HASH_WORDS)
    otp = some(["otp"]) | _has_all(tokens, OTP_WORDS)
    weak = some(WEAK_WORDS)
    for words in WEAK_PAIRS:
        weak = weak | _has_all(tokens, words)
    return first_match(
        [
            ((claim == "insecure_default_credentials") & (claim_from_title(context) == "hardcoded_secret"), "hardcoded_secret"),
            (claim.isin(PASSWORD_HASH_CLAIMS) & hashes, "weak_password_hash"),
            (claim.isin(OTP_RANDOMNESS_CLAIMS) & otp & weak, "otp_weak_randomness"),
        ],
        claim,
    )


def probe_claim(probe_id: Column, claim: Column, title: Column, context: Column) -> Column:
    """F10"""
    plain = F.coalesce(lookup(PROBE_CLAIMS, probe_id), normalize_claim(claim, title))
    return bound(plain, lambda c: contextual_claim(c, F.concat_ws("\n", title, context)))


def finding_key(category: Column, claim: Column, title: Column, rule_id: Column | None = None) -> Column:
    """roadmap:rule, or category:claim with the claim's own category first."""
    plain = bound(normalize_claim(claim, title), lambda c: F.concat_ws(":", F.lower(F.trim(F.coalesce(lookup(CATEGORY_OVERRIDES, c), category))), c))
    if rule_id is None:
        return plain
    return F.when(F.coalesce(F.trim(rule_id), F.lit("")) != "", F.concat(F.lit("roadmap:"), identifier(rule_id))).otherwise(plain)


def issue_rule(raw: Column, source: Column) -> Column:
    """the roadmap rule of a knowledge-base issue; null for others. raw: JSON text."""
    return F.when(source == "KB", F.nullif(F.trim(F.get_json_object(raw, "$.probe_review.rule_id")), F.lit("")))


def issue_context(title: Column, description: Column, suggestion: Column, code: Column) -> Column:
    """what a broad claim is read in."""
    return F.concat_ws("\n", title, description, suggestion, code)


def issue_claim(raw: Column, source: Column, title: Column, context: Column) -> Column:
    """rule, probe, claim, stored key: the first that there is, even if it is blank; if that is blank, or there is none, the title,
    source and rule, or the whole title. raw: JSON text."""
    get = lambda path: F.get_json_object(raw, f"$.{path}")
    rule = F.coalesce(*[F.nullif(F.trim(get(x)), F.lit("")) for x in ("test_id", "rule_id", "ruleId", "code")])
    stored = F.nullif(F.trim(get("finding_key")), F.lit(""))
    stored = F.when(F.contains(stored, F.lit(":")), F.regexp_replace(stored, "^[^:]*:", "")).otherwise(stored)
    given = F.coalesce(lookup(RULE_CLAIMS, F.upper(rule)), lookup(PROBE_CLAIMS, get("probe_review.probe_id")), get("probe_review.claim_type"), get("claim_type"), stored)
    claim = F.coalesce(F.nullif(given, F.lit("")), claim_from_title(title), F.when(rule.isNotNull(), F.concat_ws("_", source, rule)), title)
    return bound(normalize_claim(claim, title), lambda c: contextual_claim(c, context))
