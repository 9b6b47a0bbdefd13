"""Sharding by minimax contiguous partition.

Groups of equal texts are atomic and ordered by their smallest doc_id. The driver binary-searches the
smallest capacity with which a greedy sweep over the ordered group sizes needs no more than the wanted
number of shards, and cuts there. It holds only block totals (at most about MAX_BLOCKS) and fetches the
groups of the few blocks in which a cut can fall, so its memory doesn't grow with the corpus.

Defined results: a null text has no bytes and counts as an empty one; null doc_ids sort first; rows that
repeat are all kept, side by side; an empty table gives no rows; other columns of the input are ignored.
"""

from __future__ import annotations

from bisect import bisect_right

import numpy as np
from pyspark.sql import DataFrame, SparkSession, functions as F

from scryline.llm.common import documents, partitions, staged

MAX_BLOCKS = 1 << 18
LEAST_BLOCK = 1024


class _Missing(Exception):
    """Blocks whose groups the search needs."""

    def __init__(self, blocks: set[int]):
        self.blocks = blocks


def greedy_cuts(ends: np.ndarray, detail: dict[int, np.ndarray], capacity: int, shards: int) -> list[int] | None:
    """Byte positions at which a greedy sweep ends each shard, or None if `shards` of this capacity don't suffice.

    ends: bytes up to the end of each block; detail: by block, bytes up to the end of each of its groups.
    Raises _Missing with the blocks that must be known first (and a guess at the later ones).
    """
    total, at, cuts, missing = int(ends[-1]), 0, [], set()
    for _ in range(shards):
        target = at + capacity
        if target >= total:
            if missing:
                raise _Missing(missing)
            return [*cuts, total]
        block = int(np.searchsorted(ends, target, side="right"))
        floor = int(ends[block - 1]) if block else 0
        if floor == target:
            nxt = floor
        elif block in detail:
            groups = detail[block]
            k = bisect_right(groups, target)
            nxt = int(groups[k - 1]) if k else floor
        else:
            missing.add(block)
            nxt = max(floor, at + 1)
        if nxt <= at:
            if missing:
                raise _Missing(missing)
            return None
        at = nxt
        cuts.append(at)
    if missing:
        raise _Missing(missing)
    return None


def minimax_cuts(ends: np.ndarray, largest: int, shards: int, fetch, detail: dict[int, np.ndarray] | None = None) -> list[int]:
    """The cuts of the smallest feasible capacity. fetch(blocks) returns their detail."""
    total = int(ends[-1])
    detail = {} if detail is None else detail

    def feasible(capacity: int) -> list[int] | None:
        while True:
            try:
                return greedy_cuts(ends, detail, capacity, shards)
            except _Missing as e:
                detail.update(fetch(e.blocks))

    low, high = max(-(-total // shards), largest), -(-total // shards) + largest  # the greedy sweep always fits the upper one
    best = feasible(high)
    while low < high:
        mid = (low + high) // 2
        if (cuts := feasible(mid)) is not None:
            high, best = mid, cuts
        else:
            low = mid + 1
    return best


def shard_documents(docs: DataFrame, shards: int = 8) -> DataFrame:
    """docs (doc_id, text) -> doc_id, size, text_crc32, shard, slot, capacity (of the fullest shard).

    Shards are contiguous in the order of groups of equal texts (smallest doc_id first); slot counts from 0
    in each shard. Two range sorts of narrow rows; no text is shuffled.
    """
    spark = docs.sparkSession
    text = F.coalesce(F.col("text"), F.lit(""))
    rows = staged(
        docs.select(
            F.col("doc_id"),
            (F.octet_length(text).cast("long") + 1).alias("size"),
            F.crc32(text.cast("binary")).alias("text_crc32"),
            F.unhex(F.md5(text.cast("binary"))).alias("grp"),
        ),
        "shard-rows",
    )
    groups = rows.groupBy("grp").agg(F.min("doc_id").alias("first_id"), F.sum("size").alias("gsize"), F.count("*").alias("gcount"))
    p = partitions(spark)
    groups = staged(
        groups.repartitionByRange(p, "first_id", "grp").sortWithinPartitions("first_id", "grp").withColumn("mid", F.monotonically_increasing_id()),
        "shard-groups",
    )
    n, largest = groups.agg(F.count("*"), F.max("gsize")).first()
    if not n:
        return rows.select("doc_id", "size", "text_crc32", F.lit(0).alias("shard"), F.lit(0).cast("long").alias("slot"), F.lit(0).cast("long").alias("capacity"))
    per_block = max(LEAST_BLOCK, -(-n // MAX_BLOCKS))
    pid, idx = F.shiftright("mid", 33), F.col("mid").bitwiseAND((1 << 33) - 1)
    blocked = groups.withColumn("pid", pid).withColumn("block", F.floor(idx / per_block))
    totals = sorted(blocked.groupBy("pid", "block").agg(F.sum("gsize").alias("bytes"), F.sum("gcount").alias("rows")).collect())
    ends = np.cumsum(np.array([r["bytes"] for r in totals], dtype=np.int64))
    row_ends = np.cumsum(np.array([r["rows"] for r in totals], dtype=np.int64))
    place = {(r["pid"], r["block"]): i for i, r in enumerate(totals)}

    members: dict[int, list] = {}

    def fetch(blocks: set[int]) -> dict[int, np.ndarray]:
        wanted = [(totals[b]["pid"], totals[b]["block"]) for b in blocks]
        low = [(p_ << 33) + b * per_block for p_, b in wanted]
        near = F.lit(False)
        for a in low:  # ranges of mid, which reach the Parquet scan
            near = near | F.col("mid").between(a, a + per_block - 1)
        got: dict[int, list] = {b: [] for b in blocks}
        for r in groups.where(near).select("mid", "first_id", "grp", "gsize", "gcount").collect():
            got[place[(r["mid"] >> 33, (r["mid"] & ((1 << 33) - 1)) // per_block)]].append(r)
        out = {}
        for b, found in got.items():
            members[b] = sorted(found, key=lambda r: r["mid"])
            out[b] = (int(ends[b - 1]) if b else 0) + np.cumsum(np.array([r["gsize"] for r in members[b]], dtype=np.int64))
        return out

    detail: dict[int, np.ndarray] = {}
    cuts = minimax_cuts(ends, int(largest), shards, fetch, detail)
    # Where each further shard starts: its first group, and how many rows stand before it.
    starts, before = [], [0]
    for cut in cuts[:-1]:
        block = int(np.searchsorted(ends, cut, side="right"))
        if block not in detail:
            detail.update(fetch({block}))
        k = bisect_right(detail[block], cut)
        first = members[block][k]
        starts.append((first["first_id"], bytes(first["grp"])))
        before.append((int(row_ends[block - 1]) if block else 0) + sum(r["gcount"] for r in members[block][:k]))

    ordered = staged(
        rows.join(groups.select("grp", "first_id"), "grp")
        .select("first_id", "grp", "doc_id", "size", "text_crc32")
        .repartitionByRange(p, "first_id", "grp", "doc_id")
        .sortWithinPartitions("first_id", "grp", "doc_id")
        .withColumn("mid", F.monotonically_increasing_id()),
        "shard-ordered",
    )
    counts = dict(ordered.groupBy(pid.alias("pid")).count().collect())  # one row for each partition
    offset, running = {}, 0
    for k in sorted(counts):
        offset[k] = running
        running += counts[k]
    here = F.struct(F.col("first_id"), F.col("grp"))
    shard = F.lit(0)
    for first_id, grp in starts:
        shard = shard + (here >= F.struct(F.lit(first_id).cast("long"), F.lit(grp))).cast("int")
    at = F.element_at(F.create_map(*[F.lit(x) for kv in offset.items() for x in kv]), pid)
    begin = F.element_at(F.array(*[F.lit(x).cast("long") for x in before]), F.col("shard") + 1)
    capacity = max(b - a for a, b in zip([0, *cuts[:-1]], cuts, strict=True))
    return ordered.withColumn("shard", shard).select("doc_id", "size", "text_crc32", "shard", (at + idx - begin).cast("long").alias("slot"), F.lit(capacity).cast("long").alias("capacity"))


def op1_sharding(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All documents in shards 0 to 7 under the law `bytes`."""
    out = shard_documents(documents(spark, sf_dir).select("doc_id", "text"), shards=8)
    return out.select("doc_id", "size", "text_crc32", F.lit("bytes").alias("law"), "shard", "slot", F.lit(None).cast("int").alias("grown_shard"), "capacity")
