"""Selections whose next step depends on the ones before (IDs W03, W04, W07, W17 - W20, W22, A10, X08, X09).

A probe has a few hundred candidates at most, and each probe is folded by itself in one call; budgets and caps that
don't depend on order are windows.
"""

from __future__ import annotations

import pandas as pd
from pyspark.sql import DataFrame, Window, functions as F

CANDIDATE = "probe_id string, strategy string, file_path string, chunk_index int, line_start int, line_end int, score double"


def _nested(a: dict, b: dict) -> bool:
    if a["file_path"] != b["file_path"]:
        return False
    return (a["line_start"] <= b["line_start"] and a["line_end"] >= b["line_end"]) or (b["line_start"] <= a["line_start"] and b["line_end"] >= a["line_end"])


def _key(c: dict) -> tuple:
    return c["file_path"], c["chunk_index"]


def unique(candidates: list[dict]) -> list[dict]:
    """By falling score; equal chunks are one, and of nested chunks the narrower stays, in the place of the wider."""
    kept: list[dict] = []
    place: dict[tuple, int] = {}
    for c in sorted(candidates, key=lambda c: -c["score"]):
        if _key(c) in place and _key(kept[place[_key(c)]]) == _key(c):
            old = kept[place[_key(c)]]
            old["strategy"] = "+".join(sorted({*old["strategy"].split("+"), *c["strategy"].split("+")}))
            continue
        at = next((i for i, k in enumerate(kept) if _nested(c, k)), None)
        if at is None:
            place[_key(c)] = len(kept)
            kept.append(dict(c))
        elif c["line_end"] - c["line_start"] < kept[at]["line_end"] - kept[at]["line_start"]:
            place[_key(c)] = at
            kept[at] = dict(c)
    return sorted(kept, key=lambda c: -c["score"])


def _fits(selected: list[dict], c: dict) -> bool:
    """X09"""
    return all(_key(s) != _key(c) and not _nested(c, s) for s in selected)


def reserve(by_strategy: dict[str, list[dict]], k: int, structural: int = 2) -> list[dict]:
    """The best structural ones, then two lexical and two semantic, none nested in another."""
    out: list[dict] = []
    for name, limit in (("structural", structural), ("lexical", 2), ("semantic", 2)):
        listed = by_strategy.get(name, [])
        for c in unique(unique(listed)[:limit] if name == "structural" else listed[:limit]):
            if len(out) < k and _fits(out, c):
                out.append(c)
    return out


def fill(reserved: list[dict], ranked: list[dict], k: int) -> list[dict]:
    """Up to k, at most k // 2 of a file and none nested; what the files' limit put off fills the rest."""
    out, put_off = list(reserved), []
    files: dict[str, int] = {}
    for c in out:
        files[c["file_path"]] = files.get(c["file_path"], 0) + 1
    for c in ranked:
        if len(out) >= k:
            return out
        if not _fits(out, c):
            continue
        if files.get(c["file_path"], 0) >= max(1, k // 2):
            put_off.append(c)
            continue
        out.append(c)
        files[c["file_path"]] = files.get(c["file_path"], 0) + 1
    taken = {_key(c) for c in out}
    for c in put_off:
        if len(out) < k and _key(c) not in taken:
            out.append(c)
            taken.add(_key(c))
    return out[: max(k, 0)] if k <= 0 else out


def select_candidates(candidates: DataFrame, k: int) -> DataFrame:
    """CANDIDATE rows -> the k chosen of each probe, in order (`place`)."""

    def choose(pdf: pd.DataFrame) -> pd.DataFrame:
        rows = pdf.sort_values(["score", "file_path", "chunk_index", "strategy"], ascending=[False, True, True, True], kind="stable").to_dict("records")
        by = {s: [dict(c) for c in rows if c["strategy"] == s] for s in ("structural", "lexical", "semantic")}
        chosen = fill(reserve(by, k), unique([dict(c) for c in rows]), k)
        return pd.DataFrame(chosen, columns=list(pdf.columns)).assign(place=range(1, len(chosen) + 1))

    return candidates.groupBy("probe_id").applyInPandas(choose, CANDIDATE + ", place int")


def unique_candidates(candidates: DataFrame) -> DataFrame:
    """W17 for each probe."""

    def once(pdf: pd.DataFrame) -> pd.DataFrame:
        rows = pdf.sort_values(["score", "file_path", "chunk_index", "strategy"], ascending=[False, True, True, True], kind="stable").to_dict("records")
        return pd.DataFrame(unique(rows), columns=list(pdf.columns))

    return candidates.groupBy("probe_id").applyInPandas(once, CANDIDATE)


def rank_related(candidates: list[dict], most: int = 3, per_file: int = 2) -> list[dict]:
    """The best related and the best adjacent one, then the best, two of a file at most."""
    ranked = unique(candidates)
    out: list[dict] = []
    for strategy in ("related", "adjacent"):
        c = next((c for c in ranked if strategy in c["strategy"] and c not in out), None)
        if c is not None:
            out.append(c)
    files = {c["file_path"]: 1 for c in out}
    for c in ranked:
        if len(out) >= most:
            break
        if c not in out and files.get(c["file_path"], 0) < per_file:
            out.append(c)
            files[c["file_path"]] = files.get(c["file_path"], 0) + 1
    return out


def trim_to_budget(rows: DataFrame, budget: int, job: str = "job_id") -> DataFrame:
    """Within a job's budget: first one chunk of each probe, then two structural ones of each, then by rank and score.

    rows: job, probe_id, bundle_ord, place (in the bundle), structural (boolean), rank, score, file_path, chunk_index.
    """
    n = F.row_number().over(Window.partitionBy(job, "probe_id", "structural").orderBy("place"))
    phase = F.when(F.col("place") == 1, 1).when(F.col("structural") & (F.col("_n") <= 2), 2).otherwise(3)
    rows = rows.withColumn("_n", n).withColumn("phase", phase)
    early = F.when(F.col("phase") < 3, F.col("bundle_ord"))
    order = Window.partitionBy(job).orderBy("phase", early.asc_nulls_last(), F.when(F.col("phase") < 3, F.col("place")).asc_nulls_last(), F.desc("rank"), F.desc("score"), F.desc("probe_id"), F.desc("file_path"), F.desc("chunk_index"))
    return rows.withColumn("seat", F.row_number().over(order)).where(F.col("seat") <= budget).drop("_n")


def cap_per_probe(rows: DataFrame, keys: list[str], cap: int, order: list) -> DataFrame:
    """W20"""
    return rows.withColumn("_n", F.row_number().over(Window.partitionBy(*keys).orderBy(*order))).where(F.col("_n") <= cap).drop("_n")


def audit_bundles(chunks: DataFrame, audited: DataFrame, job: str = "job_id", size: int = 6) -> DataFrame:
    """Chunks that no bundle has, by file in slices of six: bundle_id, file_path, chunk_index."""
    left = chunks.join(audited.select(job, "file_path", "chunk_index").distinct(), [job, "file_path", "chunk_index"], "left_anti")
    part = F.floor((F.row_number().over(Window.partitionBy(job, "file_path").orderBy("chunk_index")) - 1) / size)
    name = F.concat(F.lit("coverage.full_audit."), F.left(F.sha2("file_path", 256), F.lit(12)), F.lit("."), part.cast("string"))
    return left.withColumn("bundle_id", name)


def smart_plan(chunks: DataFrame, budget: int, per_file: int = 6, files: int = 12, job: str = "job_id") -> DataFrame:
    """All chunks if they fit; else the best (reason_rank) six of each file within the budget, and, where that reaches too few files, first chunks of more.

    chunks: job, file_path, chunk_index, reason_rank (null if nothing speaks for it), fallback_rank.
    """
    every = Window.partitionBy(job)
    rows = chunks.withColumn("_all", F.count("*").over(every) <= budget)
    in_file = F.row_number().over(Window.partitionBy(job, "file_path").orderBy(F.col("reason_rank").asc_nulls_last(), "chunk_index"))
    rows = rows.withColumn("_f", in_file)
    ok = F.col("reason_rank").isNotNull() & (F.col("_f") <= per_file)
    seat = F.row_number().over(Window.partitionBy(job).orderBy(F.when(ok, 0).otherwise(1), "reason_rank", "file_path", "chunk_index"))
    rows = rows.withColumn("_seat", seat).withColumn("_in", ok & (F.col("_seat") <= budget))
    rows = rows.withColumn("_file_in", F.max(F.col("_in").cast("int")).over(Window.partitionBy(job, "file_path")))
    n_files = F.size(F.collect_set(F.when(F.col("_in"), F.col("file_path"))).over(every))
    rows = rows.withColumn("_nf", n_files)
    first = F.row_number().over(Window.partitionBy(job, "file_path").orderBy("fallback_rank", "chunk_index"))
    rows = rows.withColumn("_first", (F.col("_file_in") == 0) & (first == 1))
    more = F.row_number().over(Window.partitionBy(job).orderBy(F.when(F.col("_first"), 0).otherwise(1), "fallback_rank", "file_path"))
    rows = rows.withColumn("_add", F.col("_first") & (more <= F.lit(files) - F.col("_nf")))
    return rows.where("_all or _in or _add").select(*chunks.columns, F.when(F.col("_all"), "all").when(F.col("_in"), "reason").otherwise("breadth").alias("why"))


def plan_payload(selected: DataFrame, job: str = "job_id") -> DataFrame:
    """A10: by file: its chunks in order, reasons, and totals."""
    return selected.groupBy(job, "file_path").agg(F.array_sort(F.collect_list("chunk_index")).alias("required"), F.array_sort(F.collect_set("why")).alias("reasons"), F.count("*").alias("chunks"))
