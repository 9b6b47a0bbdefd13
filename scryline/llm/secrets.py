"""Secret scans: fixed patterns, and values in the context of credentials that would be hard to guess.

A value that stands where a credential would (after a key such as `password` or `client_secret` and a sign, after `Bearer`, after a command's
option, or between `user:` and `@` in a URL) is cut into words, dates, repeats, keyboard walks and brute-force spans by dynamic programming, so that
the whole takes the fewest guesses. A value of HARD bits of guesses or more is a secret: its span is reported as `guess`.

A word's price is its rarity among all words of the corpus outside such values (so a password doesn't become a word by being copied).
Only what could be a word in some value is looked up: the different values, which are few, give their letter runs of MIN_WORD to MAX_WORD
letters, the corpus's words that are among them are counted, and each value gets those that it holds back by joins. Values that are
easy without any words, which only make them easier, aren't looked up. A small side is broadcast after a count, and joined by shuffle beyond it.

Defined results: a null text is an empty one; rows that repeat, and rows without a doc_id, are scanned each for itself; spans are counted in code points,
their end isn't in them; each kind's spans don't overlap, those of different kinds may; a value met in several contexts is one span; texts
and values of any length go through whole; further columns are ignored; an empty table gives no rows.
"""

from __future__ import annotations

import itertools
import math
import re
from collections.abc import Iterator
from functools import cache

import numpy as np
import pandas as pd
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, SparkSession, functions as F

from scryline.llm.common import bounded, documents, release, staged, text_blocks

KINDS = ("assign", "access", "hex", "guess")
#: Spans of these patterns count from so many characters on, of the group given.
BASE = (
    (re.compile(r"""(password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", re.I | re.A), 2, 6),
    (re.compile(r"AKIA[A-Z0-9]+"), 0, 20),
    (re.compile(r"[0-9a-f]{24,}"), 0, 24),  # a run of fewer is dropped, and no other begins within it
)
#: What a text must hold to have a span of each pattern.
HINTS = (r"(?i)password|passwd|secret|token|api_?key", "AKIA", "[0-9a-f]{24}")
_KEY = r"[A-Za-z0-9_.-]*(?:pass(?:word|wd|phrase|code)?|pwd|secret|token|api[_-]?key|access[_-]?key|private[_-]?key|auth[_-]?key|credentials?|signature)"
_VALUE = r"""(?:"([^"\n]+)"|'([^'\n]+)'|([^\s"'<>,;(){}\[\]]+))"""
CONTEXTS = (
    re.compile(rf"""(?<![A-Za-z0-9_.-]){_KEY}["']?[\x20\t]*(?::=|=>|==?|:)[\x20\t]*{_VALUE}""", re.I | re.A),
    re.compile(rf"""(?<!\S)--?{_KEY}[\x20\t]+{_VALUE}""", re.I | re.A),
    re.compile(rf"""\bbearer[\x20\t]+{_VALUE}""", re.I | re.A),
    re.compile(r"://[^\s/:@]*:([^\s/@]+)@"),
)
CONTEXT_HINT = r"(?i)pass|pwd|secret|token|key|credential|signature|bearer|://"
MIN_WORD, MAX_WORD = 3, 24
#: Bits from which on a value is a secret: 10^10 guesses.
HARD = math.log2(1e10)
#: Bits that say which kind of span comes next; and the longest unit whose repeats are looked for.
SWITCH, UNIT = 2.0, 24
BROADCAST_ROWS = 500_000
#: The keys of a keyboard, row by row; each row is half a key to the right of the one above. Fixed values.
KEYBOARD = ("`1234567890-=", " qwertyuiop[]\\", " asdfghjkl;'", " zxcvbnm,./")
SHIFTED = str.maketrans('~!@#$%^&*()_+{}|:"<>?', "`1234567890-=[]\\;',./")
_PLACES = {c: (2 * x + y, y) for y, row in enumerate(KEYBOARD) for x, c in enumerate(row) if c != " "}
_DATES = re.compile(r"(?=((?:19|20)\d\d([-/._]?)(?:0[1-9]|1[0-2])\2(?:0[1-9]|[12]\d|3[01])))|(?=((?:0[1-9]|[12]\d|3[01])([-/._]?)(?:0[1-9]|1[0-2])\4(?:19|20)\d\d))|(?=((?:0[1-9]|[12]\d|3[01])([-/._]?)(?:0[1-9]|1[0-2])\6\d\d))|(?=((?:19|20)\d\d))", re.A)
#: Bits of a full date of 130 years with or without separators of five kinds, of one with a year of two digits, of a year.
_DATE_BITS = {1: math.log2(130 * 365 * 5), 3: math.log2(130 * 365 * 5), 5: math.log2(100 * 365 * 5), 7: math.log2(130)}
_RUNS = re.compile(r"[^\W\d_]+")


def base_spans(text: str, which: tuple[bool, ...] = (True,) * 3) -> list[tuple[int, int, int]]:
    """start, kind, end of the fixed patterns' spans, in order."""
    return sorted((m.start(), k, m.end()) for k, (pattern, group, least) in enumerate(BASE) if which[k] for m in pattern.finditer(text) if m.end(group) - m.start(group) >= least)


def context_values(text: str) -> list[tuple[int, int]]:
    """start and end of the values in the context of a credential; of those that overlap, the one that begins first, then the longest."""
    found = sorted({m.span(m.lastindex) for pattern in CONTEXTS for m in pattern.finditer(text)}, key=lambda s: (s[0], -s[1]))
    out: list[tuple[int, int]] = []
    for start, end in found:
        if not out or start >= out[-1][1]:
            out.append((start, end))
    return out


def runs(value: str) -> Iterator[str]:
    """What could be words in a value: all parts of its letter runs, lower-cased, of MIN_WORD to MAX_WORD letters."""
    return (r[i : i + n] for r in _RUNS.findall(value.lower()) for n in range(MIN_WORD, min(MAX_WORD, len(r)) + 1) for i in range(len(r) - n + 1))


def _character(c: str) -> float:
    """Bits of a character that nothing tells about."""
    if "0" <= c <= "9":
        return math.log2(10)
    if c.isascii():
        return math.log2(26) if c.isalpha() else math.log2(33)
    return math.log2(26) + 2 if c.isalpha() else math.log2(33) + 7


def _case(word: str) -> float:
    """Bits of a word's capitals: none, the first or all are usual; others may stand anywhere."""
    upper = sum(c.isupper() for c in word)
    if not upper:
        return 0.0
    if upper == len(word) or (upper == 1 and word[0].isupper()):
        return 1.0
    return 1 + math.log2(sum(math.comb(len(word), k) for k in range(1, min(upper, len(word) - upper) + 1)))


@cache
def _degree() -> float:
    """Bits of where a walk on the keyboard turns to: the mean number of a key's neighbours."""
    return math.log2(sum(_beside(a, b) for a in _PLACES for b in _PLACES) / len(_PLACES))


def _beside(a: str, b: str) -> bool:
    (x, y), (v, w) = _PLACES.get(a, (99, 99)), _PLACES.get(b, (-99, -99))
    return a != b and abs(y - w) <= 1 and abs(x - v) <= (2 if y == w else 1)


def guess_bits(value: str, words: dict[str, float]) -> float:
    """The fewest bits of guesses over all cuts of a value; words: bits of each that the corpus has."""
    lower, n = value.lower(), len(value)
    if len(lower) != n:  # a letter whose lower case is longer
        lower = "".join(c.lower() if len(c.lower()) == 1 else c for c in value)
    best = [0.0] + [math.inf] * n
    brute = math.inf  # best[i] where the last span is a brute-force one
    longest = max(map(len, words), default=0)
    dates: dict[int, list[tuple[int, float]]] = {}
    for m in _DATES.finditer(value):
        for group, bits in _DATE_BITS.items():
            if m[group]:
                dates.setdefault(m.start(), []).append((m.end(group), bits))
        year = re.match(r"(?:19|20)\d\d", value[m.start() : m.start() + 4])
        if year:
            dates.setdefault(m.start(), []).append((m.start() + 4, _DATE_BITS[7]))
    units: dict[str, float] = {}
    same = {u: _same(value, u) for u in range(1, min(UNIT, n // 2) + 1)}
    keys, shift = lower.translate(SHIFTED), [c != k for c, k in zip(value, lower.translate(SHIFTED), strict=True)]

    def reach(j: int, bits: float) -> None:
        if bits < best[j]:
            best[j] = bits

    for i in range(n):
        here = best[i] + SWITCH
        for k in range(MIN_WORD, min(longest, n - i) + 1):
            price = words.get(lower[i : i + k])
            if price is not None:
                reach(i + k, here + price + _case(value[i : i + k]))
        for j, price in dates.get(i, ()):
            reach(j, here + price)
        if (i == 0 or not _beside(keys[i - 1], keys[i])) and i + 2 < n and _beside(keys[i], keys[i + 1]) and _beside(keys[i + 1], keys[i + 2]):
            _walk(keys, shift, i, best, reach)
        for u in range(1, min(UNIT, (n - i) // 2) + 1):
            times = 1 + (int(same[u][i]) // u if i < len(same[u]) else 0)  # as often as it goes
            if times > 1 and times * u > 2:
                unit = value[i : i + u]
                if unit not in units:
                    units[unit] = guess_bits(unit, words)
                reach(i + times * u, here + units[unit] + math.log2(times))
        brute = min(brute, here) + _character(value[i])
        reach(i + 1, brute)
    return best[n]


def _same(value: str, u: int) -> np.ndarray:
    """How many characters from each place on equal those u places later."""
    codes = np.frombuffer(value.encode("utf-32-le", "surrogatepass"), "<u4")
    differs = np.append(codes[:-u] != codes[u:], True)
    at = np.where(differs, np.arange(len(differs)), len(differs))
    return np.minimum.accumulate(at[::-1])[::-1] - np.arange(len(differs))


def _walk(keys: str, shift: list[bool], i: int, best: list[float], reach) -> None:
    """Spans along one walk of neighbouring keys that begins at i; each may begin anywhere on it, so the price is carried on step by step."""
    start = math.log2(len(_PLACES))
    held, direction, first = math.inf, None, i
    j = i
    while j + 1 < len(keys) and _beside(keys[j], keys[j + 1]):
        a, b = _PLACES[keys[j]], _PLACES[keys[j + 1]]
        step = (b[0] - a[0], b[1] - a[1])
        turn = _degree() if step != direction else 0.0
        fresh = best[j] + SWITCH + start + _degree() + shift[j] * 2
        held, first = (held + turn, first) if held + turn <= fresh else (fresh, j)
        held += 2 * (shift[j + 1] != shift[j])
        direction = step
        j += 1
        if j - first >= 2:
            reach(j + 1, held + math.log2(j - first + 1))


def scanned(docs: DataFrame) -> DataFrame:
    """docs (doc_id, text) -> doc_id, base array<struct<start, kind, end>>, found array<struct<start, end, value>>: values in context; words: how many."""
    span, value = pa.list_(pa.struct([("start", pa.int64()), ("kind", pa.int32()), ("end", pa.int64())])), pa.list_(pa.struct([("start", pa.int64()), ("end", pa.int64()), ("value", pa.string())]))

    def scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for block in text_blocks(batches, "text", 1 << 23):
            texts = pc.fill_null(block.column("text"), "")
            hints = np.stack([pc.match_substring_regex(texts, h).to_numpy(zero_copy_only=False) for h in (*HINTS, CONTEXT_HINT)], axis=1)
            base, found = [[] for _ in range(len(texts))], [[] for _ in range(len(texts))]
            for i in np.flatnonzero(hints.any(axis=1)).tolist():
                text = texts[i].as_py()
                base[i] = [{"start": s, "kind": k, "end": e} for s, k, e in base_spans(text, tuple(hints[i, :3]))]
                if hints[i, 3]:
                    found[i] = [{"start": s, "end": e, "value": text[s:e]} for s, e in context_values(text)]
            yield pa.RecordBatch.from_arrays([block.column("doc_id"), pa.array(base, span), pa.array(found, value), pc.add(pc.cast(pc.count_substring(texts, " "), pa.int64()), 1)], names=["doc_id", "base", "found", "words"])
        release()

    bounded(docs.sparkSession)
    kind = docs.schema["doc_id"].dataType.simpleString()
    return docs.select("doc_id", "text").mapInArrow(scan, f"doc_id {kind}, base array<struct<start: long, kind: int, end: long>>, found array<struct<start: long, end: long, value: string>>, words long")


def _words(text: Column) -> Column:
    return F.explode(F.split(F.lower(text), r"[^\p{L}]+"))


def word_counts(docs: DataFrame, found: DataFrame, wanted: DataFrame) -> DataFrame:
    """word, n of the wanted (word) ones among the corpus's words outside the values found (value, n)."""
    fits = F.length("word").between(MIN_WORD, MAX_WORD)
    small = wanted.count() <= BROADCAST_ROWS
    inside = found.select(_words(F.col("value")).alias("word"), "n").where(fits).groupBy("word").agg(F.sum("n").alias("inside"))
    every = docs.select(_words(F.col("text")).alias("word")).where(fits)
    if small:
        counted = every.join(F.broadcast(wanted), "word", "left_semi").groupBy("word").agg(F.count("*").alias("n"))
    else:
        counted = every.groupBy("word").agg(F.count("*").alias("n")).join(wanted, "word", "left_semi")
    out = staged(counted.join(inside, "word", "left").select("word", (F.col("n") - F.coalesce("inside", F.lit(0))).alias("n")).where("n > 0"), "words-of-values")
    return out


def hard_values(docs: DataFrame, found: DataFrame, total: int, hard: float = HARD) -> DataFrame:
    """found (value, n) -> value, bits of those that take `hard` bits of guesses or more; total: the words of docs."""

    @F.pandas_udf("double")
    def without_words(values: pd.Series) -> pd.Series:
        return pd.Series([guess_bits(v, {}) for v in values], dtype="float64")

    def parts(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for value in (v for pdf in batches for v in pdf["value"]):
            words = runs(value)
            while some := sorted(set(itertools.islice(words, 100_000))):
                yield pd.DataFrame({"value": value, "word": some})

    open_ = staged(found.select("value").where(without_words("value") >= hard), "open-values")
    held = open_.mapInPandas(parts, "value string, word string")
    words = word_counts(docs, found, staged(held.select("word").distinct(), "parts-of-values"))
    own = (held.join(F.broadcast(words), "word") if words.count() <= BROADCAST_ROWS else held.join(words, "word")).groupBy("value").agg(F.collect_set(F.struct("word", "n")).alias("words"))

    @F.pandas_udf("double")
    def bits(values: pd.Series, words: pd.Series, counts: pd.Series) -> pd.Series:
        price = lambda w, n: {} if w is None else {a: max(0.0, math.log2(total / b)) for a, b in zip(w, n, strict=True)}
        return pd.Series([guess_bits(v, price(w, n)) for v, w, n in zip(values, words, counts, strict=True)], dtype="float64")

    return staged(open_.join(own, "value", "left").select("value", bits("value", "words.word", "words.n").alias("bits")).where(F.col("bits") >= hard), "hard-values")


def _text(spans: Column) -> Column:
    names = F.array(*map(F.lit, KINDS))
    return F.array_join(F.transform(spans, lambda s: F.concat_ws(":", F.element_at(names, s["kind"] + 1), s["start"].cast("string"), s["end"].cast("string"))), ",")


def secrets(docs: DataFrame, hard: float = HARD) -> DataFrame:
    """docs (doc_id, text) -> doc_id, n_assign, n_access, n_hex, base_sha256, spans, n_guess; one row for each row."""
    rows = staged(scanned(docs).withColumn("rid", F.monotonically_increasing_id()), "scanned")
    each = rows.where(F.size("found") > 0).select("rid", F.inline("found"))
    values = staged(each.groupBy("value").agg(F.count("*").alias("n")), "values")
    hit = hard_values(docs.select("text"), values, rows.agg(F.sum("words")).first()[0] or 1, hard)
    hits = each.join(F.broadcast(hit) if hit.count() <= BROADCAST_ROWS else hit, "value").groupBy("rid").agg(
        F.collect_list(F.struct("start", F.lit(KINDS.index("guess")).alias("kind"), "end")).alias("guessed")
    )
    none = F.array().cast("array<struct<start: bigint, kind: int, end: bigint>>")
    out = rows.join(hits, "rid", "left").withColumn("guessed", F.coalesce("guessed", none))
    kinds = F.transform("base", lambda s: s["kind"])
    count = [(F.size(kinds) - F.size(F.array_remove(kinds, k))).cast("long").alias(f"n_{KINDS[k]}") for k in range(3)]
    return out.select(
        "doc_id", *count, F.sha2(_text(F.col("base")), 256).alias("base_sha256"), _text(F.array_sort(F.concat("base", "guessed"))).alias("spans"), F.size("guessed").cast("long").alias("n_guess")
    )


def op12_secrets(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The secrets in every document."""
    return secrets(documents(spark, sf_dir))
