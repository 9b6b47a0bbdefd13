"""Cutting documents and source files into chunks; cache identities (IDs W05, W06, W10 - W14, D07, F36, J08, U02, X33)."""

from __future__ import annotations

import ast
import re
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame, Window, functions as F

from scryline.functions.text import has_secret, is_plain_file, is_semantic_file, lines, plain_tokens

#: Tokens and overlap of a document's window; lines and overlap of a file's; tokens of a chunk at most. Fixed values.
WINDOW, OVERLAP = 512, 50
LINES, LINE_OVERLAP = 60, 10
MOST_TOKENS = 1500


def document_windows(text: Column) -> Column:
    """Array of windows of 512 tokens, 50 of them shared, joined by single spaces; none without tokens."""
    t = plain_tokens(text)
    starts = F.sequence(F.lit(0), F.greatest(F.size(t) - OVERLAP - 1, F.lit(0)), F.lit(WINDOW - OVERLAP))
    return F.when(F.size(t) > 0, F.transform(starts, lambda s: F.array_join(F.slice(t, s + 1, WINDOW), " "))).otherwise(F.array().cast("array<string>"))


def split_documents(docs: DataFrame, keys: list[str], text: str) -> DataFrame:
    """Keys, chunk_index, total_chunks, content."""
    w = docs.select(*keys, document_windows(F.col(text)).alias("w"))
    return w.select(*keys, F.size("w").alias("total_chunks"), F.posexplode("w").alias("chunk_index", "content"))


def line_windows(docs: DataFrame, keys: list[str], text: str) -> DataFrame:
    """Keys, chunk_index, line_start, line_end, content: 60 lines, 10 of them shared."""
    rows = docs.select(*keys, lines(F.col(text)).alias("l")).withColumn("n", F.size("l")).where("n > 0")
    starts = F.sequence(F.lit(1), F.greatest(F.col("n") - LINE_OVERLAP, F.lit(1)), F.lit(LINES - LINE_OVERLAP))
    rows = rows.select(*keys, "l", "n", F.posexplode(starts).alias("chunk_index", "line_start"))
    end = F.least(F.col("line_start") + LINES - 1, F.col("n"))
    return rows.select(*keys, "chunk_index", "line_start", end.alias("line_end"), F.array_join(F.slice("l", F.col("line_start"), end - F.col("line_start") + 1), "\n").alias("content"))


def occurrence_index(chunks: DataFrame, order: str) -> DataFrame:
    """0-based place among equal contents of a file."""
    return chunks.withColumn("occurrence_index", F.row_number().over(Window.partitionBy("file_path", "content_hash").orderBy(order)) - 1)


def cache_split(current: DataFrame, existing: DataFrame, key: str = "cache_id") -> DataFrame:
    """Key, action: reuse, embed or prune. One full outer join of distinct ids."""
    c = current.select(key).distinct().withColumn("_c", F.lit(True))
    e = existing.select(key).distinct().withColumn("_e", F.lit(True))
    action = F.when(F.col("_c") & F.col("_e"), "reuse").when(F.col("_c"), "embed").otherwise("prune")
    return c.join(e, key, "full_outer").select(key, action.alias("action"))


def sendable(chunks: DataFrame, text: str = "content") -> DataFrame:
    """Chunks without secrets."""
    return chunks.where(~has_secret(F.col(text)))


_TOKEN = re.compile(r"\w+|[^\w\s]")


def _tokens(text: str) -> int:
    return len(_TOKEN.findall(text))


def _bounded_windows(rows: list[str], first: int) -> Iterator[tuple[int, int, str]]:
    """Greedy windows of at most MOST_TOKENS tokens, LINE_OVERLAP lines shared; blank windows are skipped."""
    sizes, at = [_tokens(r) for r in rows], 0
    while at < len(rows):
        end, total = at, 0
        while end < len(rows) and (end == at or total + sizes[end] <= MOST_TOKENS):
            total += sizes[end]
            end += 1
        text = "\n".join(rows[at:end])
        if text.strip():
            yield first + at, first + end - 1, text
        if end == len(rows):
            return
        at = max(end - LINE_OVERLAP, at + 1)


def python_imports(tree: ast.AST) -> list[str]:
    """sorted distinct modules that are imported."""
    found = set()
    for n in ast.walk(tree):
        if isinstance(n, ast.Import):
            found |= {a.name for a in n.names}
        elif isinstance(n, ast.ImportFrom) and n.module:
            found.add(n.module)
    return sorted(found)


def _python_ranges(tree: ast.Module) -> list[tuple[str, str | None, str | None, int, int]]:
    """kind, function, class, first and last line of classes, their methods and functions."""
    out = []

    def visit(nodes: list[ast.stmt], owner: str | None) -> None:
        for n in nodes:
            first = min([n.lineno, *(d.lineno for d in getattr(n, "decorator_list", []))])
            if isinstance(n, ast.ClassDef):
                out.append(("class", None, n.name, first, n.end_lineno))
                visit(n.body, n.name)
            elif isinstance(n, ast.FunctionDef | ast.AsyncFunctionDef):
                out.append(("function", n.name, owner, first, n.end_lineno))

    visit(tree.body, None)
    return out


def source_chunks(path: str, language: str, text: str) -> Iterator[dict]:
    """Chunks of one file. Python: classes, methods, functions and what lies between; else windows of lines."""
    rows = text.splitlines()
    try:
        tree = ast.parse(text) if language == "python" else None
    except (SyntaxError, ValueError, RecursionError):
        tree = None
    made = []
    if tree is not None:
        ranges = _python_ranges(tree)
        imports = python_imports(tree)
        covered = sorted((a, b) for *_, a, b in ranges)
        at = 1
        for a, b in [*covered, (len(rows) + 1, len(rows) + 1)]:  # W16: islands that nothing covers
            if a > at and "".join(rows[at - 1 : a - 1]).strip():
                ranges.append(("module", None, None, at, a - 1))
            at = max(at, b + 1)
        for kind, function, class_, a, b in sorted(ranges, key=lambda r: (r[3], -r[4])):
            for lo, hi, part in _bounded_windows(rows[a - 1 : b], a):
                made.append((kind, function, class_, imports, lo, hi, part))
    else:
        made = [("window", None, None, [], lo, hi, part) for lo, hi, part in _bounded_windows(rows, 1)]
    for i, (kind, function, class_, imports, lo, hi, part) in enumerate(made):
        yield {"file_path": path, "language": language, "chunk_type": kind, "chunk_index": i, "total_chunks": len(made), "function_name": function, "class_name": class_, "line_start": lo, "line_end": hi, "imports": imports, "token_count": _tokens(part), "chunk_text": part}


CHUNK_SCHEMA = "file_path string, language string, chunk_type string, chunk_index int, total_chunks int, function_name string, class_name string, line_start int, line_end int, imports array<string>, token_count int, chunk_text string"


def chunk_sources(files: DataFrame) -> DataFrame:
    """Files (file_path, language, text) -> CHUNK_SCHEMA; Python files by their syntax, other eligible files by lines."""
    eligible = files.where(F.when(F.col("language") == "python", is_semantic_file(F.col("file_path"))).otherwise(is_plain_file(F.col("file_path"))))

    def cut(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        columns = [c.split()[0] for c in CHUNK_SCHEMA.split(", ")]
        for pdf in batches:
            made = [c for p, g, t in zip(pdf["file_path"], pdf["language"], pdf["text"], strict=True) if t for c in source_chunks(p, g, t)]
            yield pd.DataFrame(made, columns=columns)

    return eligible.select("file_path", "language", "text").mapInPandas(cut, CHUNK_SCHEMA)


def token_batches(rows: DataFrame, key: str, order: list[str], size: str, most_items: int, most_tokens: int, lane: str | None = None) -> DataFrame:
    """Rows with `batch`: a new one opens when it would hold too many items or tokens, or the lane changes.

    The running sum starts anew at each cut, which no window can say; keys (jobs) are read one after the other as a sorted stream, of
    which a task holds a batch's count and sum.
    """
    schema = rows.withColumn("batch", F.lit(0)).schema

    def fold(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        who, batch, n, total, last = None, 0, 0, 0, None
        for pdf in batches:
            out = []
            lanes = pdf[lane].tolist() if lane else [None] * len(pdf)
            for k, t, g in zip(pdf[key].tolist(), pdf[size].tolist(), lanes, strict=True):
                t = min(max(int(t), 1), most_tokens)
                if k != who:
                    who, batch, n, total = k, 0, 0, 0
                elif n >= most_items or total + t > most_tokens or g != last:
                    batch, n, total = batch + 1, 0, 0
                n, total, last = n + 1, total + t, g
                out.append(batch)
            yield pdf.assign(batch=out)

    return rows.repartition(key).sortWithinPartitions(key, *order).mapInPandas(fold, schema)
