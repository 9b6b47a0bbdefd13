"""Retrieval lanes, from candidates to the bundles that are judged (IDs X07, X08, W19, W20, W22).

Which chunks a probe gets depends on the probes before it, so a job is folded in order: tasks read their jobs' candidates as one sorted
stream and carry, for the job at hand, the chunks taken so far and its bundles. The plan is the same for any number of probes, and a task holds one
job's bundles, never its candidates. Of a probe's candidates only as many can matter as there are chunks that the probes before it may take,
and its own; windows by job, lane and probe drop the others before the shuffle, so a job of many candidates doesn't send them to one task.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass, field

import pandas as pd
from pyspark.sql import DataFrame, Window, functions as F

LANES = ("defect", "coverage", "roadmap")
#: Judge calls that a lane may take, with and without probes of a roadmap; none: no budget. Fixed values.
CALLS = {True: {"defect": 4, "coverage": 1, "roadmap": 4}, False: {"defect": 8, "coverage": 1, "roadmap": 0}}
#: The probe that keeps all its structural chunks. Fixed value.
WHOLE_STRUCTURAL = "security.otp_exposure_rate_limit"
MOST_PER_PROBE = 10


@dataclass(frozen=True)
class Budget:
    """How many chunks a job, its lanes and its judge's batches may hold."""

    job: int = 256
    lanes: dict[str, int] = field(default_factory=lambda: {"defect": 120, "coverage": 24, "roadmap": 120})
    probes_per_batch: int = 8
    chunks_per_batch: int = 24
    full_audit: bool = False

    def of_lane(self, lane: str, has_roadmap: bool) -> int:
        calls = 0 if self.full_audit else CALLS[has_roadmap][lane]
        return min(self.lanes[lane], calls * self.chunks_per_batch) if calls > 0 else self.lanes[lane]

    def of_probe(self, lane: str, has_roadmap: bool) -> int | None:
        """A defect probe's share of a batch, beside a roadmap."""
        return max(1, self.chunks_per_batch // self.probes_per_batch) if lane == "defect" and has_roadmap and not self.full_audit else None


@dataclass
class Bundle:
    """A probe with the chunks it has been given: dicts of file_path, chunk_index, score, structural."""

    lane: str
    ord: int
    probe_id: str
    top_k: int
    rank: int
    chunks: list[dict] = field(default_factory=list)
    before: int = 0

    @property
    def status(self) -> str:
        return "no_candidate_evidence" if not self.before else "ok" if self.chunks else "trimmed_by_global_cap"


def key(c: dict) -> tuple[str, int]:
    return c["file_path"], c["chunk_index"]


def trim(bundles: list[Bundle], most: int) -> None:
    """Within the budget stay the first chunk of each bundle up to the first empty one, then two structural chunks of each (all of the one probe),
    then the rest by rank and score. The budget is no less than the bundles that have chunks."""
    most = max(most, sum(bool(b.chunks) for b in bundles))
    if sum(len(b.chunks) for b in bundles) <= most:
        return
    kept: list[set] = [set() for _ in bundles]
    left = most
    for b, own in zip(bundles, kept, strict=True):
        if left <= 0 or not b.chunks:
            break
        own.add(key(b.chunks[0]))
        left -= 1
    for b, own in zip(bundles, kept, strict=True):
        structural = [c for c in b.chunks if c["structural"]]
        target = b.top_k if b.probe_id == WHOLE_STRUCTURAL else 2
        slots = max(0, target - sum(key(c) in own for c in structural))
        more = [key(c) for c in structural if key(c) not in own][: max(0, min(slots, left))]
        own.update(more)
        left -= len(more)
    rest = [(b.rank, c["score"], b.probe_id, *key(c), i) for i, b in enumerate(bundles) for c in b.chunks if key(c) not in kept[i]]
    for *_, path, index, i in sorted(rest, reverse=True)[: max(0, left)]:
        kept[i].add((path, index))
    for b, own in zip(bundles, kept, strict=True):
        b.chunks = [c for c in b.chunks if key(c) in own]


class Fold:
    """A job's lanes, fed probe by probe in order."""

    def __init__(self, budget: Budget):
        self.budget, self.has_roadmap = budget, False
        self.done: list[Bundle] = []
        self.lane: list[Bundle] = []
        self.taken: set = set()

    def open(self, bundle: Bundle) -> None:
        if self.lane and self.lane[-1].lane != bundle.lane:
            self.close_lane()
        self.lane.append(bundle)

    def offer(self, chunk: dict) -> None:
        """The next best candidate of the probe opened last."""
        b = self.lane[-1]
        if len(b.chunks) < b.top_k and not (b.lane == "coverage" and key(chunk) in self.taken):
            b.chunks.append(chunk)
            b.before += 1

    def close_probe(self) -> None:
        b = self.lane[-1]
        if b.lane == "coverage":
            self.taken.update(map(key, b.chunks))

    def close_lane(self) -> None:
        lane = self.lane[-1].lane if self.lane else ""
        if lane:
            cap = self.budget.of_probe(lane, self.has_roadmap)
            for b in self.lane if cap else []:
                b.chunks = b.chunks[:cap]
            trim(self.lane, self.budget.of_lane(lane, self.has_roadmap))
            if lane == "defect" and not self.budget.full_audit:
                self.taken.update(key(c) for b in self.lane for c in b.chunks)
        self.done += self.lane
        self.lane = []

    def close(self) -> list[Bundle]:
        self.close_lane()
        if not self.budget.full_audit:
            trim(self.done, self.budget.job)
        return self.done


CHUNKS = "array<struct<file_path:string,chunk_index:int,score:double,structural:boolean>>"


def lane_bundles(probes: DataFrame, candidates: DataFrame, job: str = "job_id", budget: Budget | None = None, most: int = MOST_PER_PROBE) -> DataFrame:
    """A bundle for each probe: job, lane, probe_ord, probe_id, status, selected (before any trim), trimmed_count, chunks in order.

    probes (job, lane, probe_ord, probe_id, top_k, rank), candidates (job, lane, probe_ord, file_path, chunk_index, score, structural), the
    best score first, ties by chunk. Lanes go in their order and probes in theirs. Coverage leaves out what defect probes kept (unless all is
    audited) and what coverage probes before were given, also where that was trimmed later. top_k is at least 1 and at most `most`.
    """
    budget = budget or Budget()
    top_k = F.least(F.greatest("top_k", F.lit(1)), F.lit(most)).cast("int").alias("top_k")
    probes = probes.select(job, "lane", "probe_ord", "probe_id", top_k, "rank")
    counts = probes.groupBy(job).agg(F.count_if(F.col("lane") != "roadmap").alias("n"))
    before = (counts.agg(F.max("n")).first()[0] or 0) * most
    best = Window.partitionBy(job, "lane", "probe_ord").orderBy(F.desc("score"), "file_path", "chunk_index")
    rows = candidates.select(job, "lane", "probe_ord", "file_path", "chunk_index", "score", "structural").withColumn("place", F.row_number().over(best)).where(F.col("place") <= before + most)
    order = lambda df: df.withColumn("turn", F.array_position(F.array(*map(F.lit, LANES)), F.col("lane")))
    roadmap = F.max((F.col("lane") == "roadmap").cast("int")).over(Window.partitionBy(job)).alias("roadmap")
    heads = order(probes.select("*", roadmap)).withColumn("place", F.lit(0))
    stream = heads.unionByName(order(rows), allowMissingColumns=True).repartition(job).sortWithinPartitions(job, "turn", "probe_ord", "place")
    kind = probes.schema[job].dataType.simpleString()

    def fold(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        at, state, known = None, None, False

        def given() -> pd.DataFrame:
            done = state.close()
            return pd.DataFrame({
                job: [at] * len(done), "lane": [b.lane for b in done], "probe_ord": [b.ord for b in done], "probe_id": [b.probe_id for b in done], "status": [b.status for b in done],
                "selected": [b.before for b in done], "trimmed_count": [b.before - len(b.chunks) for b in done], "chunks": [b.chunks for b in done],
            })

        for pdf in batches:
            out = []
            for r in pdf.to_dict("records"):
                if state is None or r[job] != at:
                    if state is not None and state.lane + state.done:
                        out.append(given())
                    at, state, known = r[job], Fold(budget), False
                if r["place"] == 0:
                    state.has_roadmap = r["roadmap"] == 1
                    if state.lane:
                        state.close_probe()
                    state.open(Bundle(r["lane"], int(r["probe_ord"]), r["probe_id"], int(r["top_k"]), int(r["rank"])))
                    known = True
                elif known and (state.lane[-1].lane, state.lane[-1].ord) == (r["lane"], r["probe_ord"]):  # candidates of probes that aren't there are left out
                    state.offer({"file_path": r["file_path"], "chunk_index": int(r["chunk_index"]), "score": r["score"], "structural": bool(r["structural"])})
            if out:
                yield pd.concat(out)
        if state is not None and state.lane + state.done:
            yield given()

    return stream.mapInPandas(fold, f"`{job}` {kind}, lane string, probe_ord int, probe_id string, status string, selected int, trimmed_count int, chunks {CHUNKS}")


def lane_selection(candidates: DataFrame, job: str, k: int, full_audit: bool = False) -> DataFrame:
    """Candidates (job, lane, probe_ord, file_path, chunk_index, score) -> the k of each probe before any trim, with their rank."""
    probes = candidates.select(job, "lane", "probe_ord").distinct().select("*", F.lit("").alias("probe_id"), F.lit(k).alias("top_k"), F.lit(0).alias("rank"))
    whole = Budget(job=1 << 60, lanes=dict.fromkeys(LANES, 1 << 60), chunks_per_batch=1 << 60, full_audit=full_audit)
    bundles = lane_bundles(probes, candidates.withColumn("structural", F.lit(False)), job, whole, k)
    return bundles.select(job, "lane", "probe_ord", F.posexplode("chunks").alias("pos", "c")).select(job, "lane", "probe_ord", (F.col("pos") + 1).alias("rank"), "c.file_path", "c.chunk_index", "c.score")
