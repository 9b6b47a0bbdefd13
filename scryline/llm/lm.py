"""Language-model scoring by cross-entropy difference.

A target model and a background model are interpolated bigram models with the same smoothing over one vocabulary, all words
of the corpus; a word is known by a hash of 31 bits, a bigram by the two hashes in a long. The background's
counts, which come from every document, are scaled to the target's mass, so that the two are matched.
A document's score is the mean over its tokens of the background's loss less the target's. The target is every document
labelled good.

Words are counted into a table on the executors. Then each document sends its bigrams to buckets, whose number follows the
corpus; in a bucket all occurrences of a bigram meet, so it is counted and scored there, and each document gets
its sums back. The counts of the single words are broadcast for the FREQUENT most frequent words at most; bigrams with another
word find them by a join with the table.

Hot bigrams, which would fill a bucket, don't meet: the pass that counts the words notes those that make up a share of some block of text above that
of a quarter of a bucket in the corpus, as a bigram with that share of the corpus must somewhere. The documents' numbers of these are
added up by partial sums, and their losses are looked up where the document is. Which bigrams go which way changes no score, and nothing is left
out on any.

Defined results: null texts and texts without words have no tokens, no cross-entropies and the score 0; documents with
a null doc_id are scored but aren't in the target; rows that repeat count, and are scored, each for itself; without a
target, all scores are 0; an empty table gives no rows.
"""

from __future__ import annotations

import re
import zlib
from collections.abc import Callable, Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession, functions as F

from scryline.llm.common import bounded, documents, release, staged

#: Words whose counts are broadcast, at most (2^PLACE_BITS can be told apart); those of the others are joined.
FREQUENT = 1 << 18
#: Bigrams of a bucket, as a mean; of a block of documents that a task sends at a time; that a task counts at a time.
BUCKET, BLOCK, COUNTED = 1 << 20, 1 << 19, 1 << 21
#: Rows (of a long and an int) up to which the target's ids are broadcast.
BROADCAST_ROWS = 2_000_000
KEEP, LEAN = 0.8, 5  # rare contexts lean on single words
TRAIN, TARGET, SCORE = 1, 2, 4
COMMON, RARE, DOCUMENT, HOT = 0, 1, 2, 3
#: Hot bigrams that are broadcast, at most; the least share of a block that makes one.
MOST_HOT, LEAST_SHARE = 1 << 20, 2.0**-20
BITS, PLACE_BITS = 31, 20
_WORD = re.compile(r"\w+")


def tokens(text: str | None) -> list[str]:
    return _WORD.findall((text or "").lower())


class Vocabulary:
    """Ids: 0 the edge of a text, then hashes of words."""

    size = 1 << BITS

    def __call__(self, text: str | None) -> np.ndarray:
        found = tokens(text)
        return np.array([0, *[1 + zlib.crc32(w.encode("utf-8", "surrogatepass")) % (self.size - 1) for w in found], 0] if found else [], np.int64)


def _counts(docs: DataFrame, ids: Callable[[str | None], np.ndarray], share: float | None = None, bigrams: bool = False) -> DataFrame:
    """docs (text, flags) -> kind, key, n over all documents, n_target over the target's, of words (kind 0).

    share: also bigrams (kind 1) that make up that share of a block, with no more than a part of their occurrences; bigrams: all of them, instead of words.
    """

    def count(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        held, size = [], 0

        def summed() -> Iterator[pd.DataFrame]:
            marked = np.concatenate(held)
            ends = np.cumsum([len(x) for x in held])
            if not bigrams:
                key, n = np.unique(np.delete(marked, np.concatenate(([0], ends[:-1]))[np.diff(ends, prepend=0) > 0]), return_counts=True)
                yield pd.DataFrame({"kind": 0, "key": key >> 1, "n": n, "n_target": n * (key & 1)})
            if (bigrams or share) and size:
                inner = np.ones(len(marked) - 1, bool)
                inner[ends[(ends > 0) & (ends < len(marked))] - 1] = False  # from one document to the next
                cells = ((marked[:-1] >> 1 << BITS | marked[1:] >> 1) * 2 + (marked[1:] & 1))[inner]
                if not bigrams:  # those whose last word alone is as frequent can be
                    cells = cells[_often(cells >> 1 & (1 << BITS) - 1, share * size)]
                key, n = np.unique(cells, return_counts=True)
                chosen = n >= (1 if bigrams else max(2, share * size / 2))  # a bigram of the target counts apart
                key, n = key[chosen], n[chosen]
                yield pd.DataFrame({"kind": 1, "key": key >> 1, "n": n, "n_target": n * (key & 1)})

        for pdf in batches:
            for text, flags in zip(pdf["text"], pdf["flags"], strict=True):
                held.append(ids(text) * 2 + bool(flags & TARGET))
                size += len(held[-1])
                if size > COUNTED:
                    yield from summed()
                    held, size = [], 0
                    release()
        if held:
            yield from summed()

    rows = docs.select("text", "flags").mapInPandas(count, "kind int, key long, n long, n_target long")
    return rows.groupBy("kind", "key").agg(F.sum("n").alias("n"), F.sum("n_target").alias("n_target"))


def _often(keys: np.ndarray, least: float) -> np.ndarray:
    """Which of the keys (below 2^BITS) occur at least so often, or share some of their bits with others that do."""
    low = keys & (1 << 20) - 1
    return np.bincount(low, minlength=1 << 20)[low] >= least


def bigram_counts(docs: DataFrame, vocabulary: Vocabulary, target: frozenset) -> DataFrame:
    """cell (first id times vocabulary size plus second id), n over all documents, n_target over the target's."""
    flags = F.when(F.col("doc_id").isin(list(target)), TARGET).otherwise(0) if target else F.lit(0)
    return _counts(docs.select("text", flags.alias("flags")), vocabulary, bigrams=True).withColumnRenamed("key", "cell").drop("kind")


@dataclass
class Losses:
    """How many different words there are, and the sums of their counts in the corpus and in the target."""

    different: int
    total: int
    mass: int

    def _of(self, both, first, second, scale: float, log: Callable):
        """Of a bigram by its counts and those of its words: bigrams and single words, interpolated."""
        single = (second * scale + 0.5) / (self.mass + 0.5 * (self.different + 1))  # one more for words never seen
        seen = first * scale
        return -log(both * scale * KEEP / (seen + LEAN) + (1 - seen * KEEP / (seen + LEAN)) * single)

    def __call__(self, n: list, n_target: list, log: Callable) -> tuple:
        """The target's and the background's; n and n_target: counts of the bigram, its first and its second word."""
        return self._of(*n_target, 1.0, log), self._of(*n, self.mass / max(1, self.total), log)


@dataclass
class Scorer:
    """The models: docs (doc_id, text, flags) and their words' counts, both on the executors."""

    of: DataFrame
    docs: DataFrame
    vocabulary: Vocabulary
    words: DataFrame  # id, n, n_target
    frequent: np.ndarray  # rows: id (ascending), n, n_target of the words that are broadcast
    losses: Losses
    hot: np.ndarray  # bigrams (first id << BITS | second), ascending


def learn(docs: DataFrame, labels: DataFrame) -> Scorer:
    """docs (doc_id, text), labels (doc_id, quality)."""
    good = staged(labels.where("quality = 1 and doc_id is not null").select("doc_id").distinct().withColumn("good", F.lit(TARGET)), "lm-target")
    good = F.broadcast(good) if good.count() <= BROADCAST_ROWS else good
    flagged = docs.select("doc_id", "text").join(good, "doc_id", "left").select("doc_id", "text", F.coalesce("good", F.lit(0)).bitwiseOR(F.lit(TRAIN)).alias("flags"))
    vocabulary = Vocabulary()
    bounded(docs.sparkSession)
    # about six characters a word; the estimate sets which bigrams are hot, nothing else
    tokens = max(1, (docs.agg(F.sum(F.length("text"))).first()[0] or 0) // 6)
    share = min(1.0, max(LEAST_SHARE, BUCKET / 4 / tokens))
    counted = staged(_counts(flagged, vocabulary, share), "lm-words")
    words = counted.where("kind = 0").select(F.col("key").alias("id"), "n", "n_target")
    hot = np.sort(counted.where("kind = 1").orderBy(F.desc("n"), "key").limit(MOST_HOT).select("key").toPandas()["key"].to_numpy(np.int64))
    # Steps of a quarter of a doubling: as many of the highest as hold FREQUENT words at most.
    step = F.floor(F.log2("n") * 4).alias("step")
    steps = sorted(words.groupBy(step).agg(F.count("*").alias("words"), F.sum("n").alias("n"), F.sum("n_target").alias("n_target")).collect(), reverse=True)
    held, lowest = 0, None
    for r in steps:
        held += r["words"]
        if held > FREQUENT:
            break
        lowest = r["step"]
    top = words.where(step >= lowest).orderBy("id").toPandas() if lowest is not None else pd.DataFrame({"id": [], "n": [], "n_target": []})
    different, total, mass = (sum(r[c] for r in steps) for c in ("words", "n", "n_target"))
    return Scorer(docs, flagged, vocabulary, words, top[["id", "n", "n_target"]].to_numpy(np.int64).T.copy(), Losses(different, total, mass), hot)


class Sender:
    """Blocks of documents -> rows for the buckets: bigrams of frequent words, other bigrams, and the documents themselves; hot bigrams go with their block to any bucket."""

    def __init__(self, vocabulary: Vocabulary, frequent: np.ndarray, buckets: int, hot: np.ndarray):
        self.vocabulary, self.frequent, self.buckets, self.hot = vocabulary, frequent, buckets, hot

    def __call__(self, batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        base, held, size = TaskContext.get().partitionId() << 40, [], 0
        for pdf in batches:
            for row in zip(pdf["doc_id"], pdf["text"], pdf["flags"], strict=True):
                ids = self.vocabulary(row[1])
                held.append((row[0], row[2], ids))
                size += len(ids) + 1
                if size > BLOCK:
                    yield self.block(base, held)
                    base, held, size = base + len(held), [], 0
        if held:
            yield self.block(base, held)

    def block(self, base: int, held: list) -> pd.DataFrame:
        flags = np.array([f for _, f, _ in held], np.int64)
        lengths = np.array([len(ids) for *_, ids in held])
        ids = np.concatenate([x for *_, x in held])
        ends = np.cumsum(lengths)[lengths > 0]
        first, second = np.ones(len(ids), bool), np.ones(len(ids), bool)
        first[ends - 1] = False
        second[ends - lengths[lengths > 0]] = False
        known, place = find(self.frequent, ids)
        common = known[first] & known[second]
        all_at = np.repeat((np.arange(len(held)) << 3 | flags).astype(np.int32), np.maximum(lengths - 1, 0))
        out = []
        is_hot, hot_at = find(self.hot[None], ids[first] << BITS | ids[second])
        if is_hot.any():
            at, times = np.unique(all_at[is_hot].astype(np.int64) << 32 | hot_at[is_hot], return_counts=True)
            out.append((zlib.crc32(base.to_bytes(8, "little")) % self.buckets, base, HOT, (at >> 32).astype(np.int32).tobytes(), np.stack([at & 0xFFFFFFFF, times]).astype(np.int32).tobytes(), None))
        for kind, chosen, bits, x in ((COMMON, common & ~is_hot, PLACE_BITS, place), (RARE, ~common & ~is_hot, BITS, ids)):
            cells, at = (x[first] << bits | x[second])[chosen], all_at[chosen]
            bucket = (cells.astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15) >> np.uint64(33)).astype(np.int64) % self.buckets
            order = np.argsort(bucket, kind="stable")
            cells, at, bucket = cells[order], at[order], bucket[order]
            found, start = np.unique(bucket, return_index=True)
            for b, i, j in zip(found, start, np.append(start, len(cells))[1:], strict=True):
                out.append((int(b), base, kind, np.diff(at[i:j], prepend=np.int32(0)).tobytes(), packed(kind, cells[i:j]), None))
        wanted = np.flatnonzero(flags & SCORE)
        if len(wanted):
            out.append((base % self.buckets, base, DOCUMENT, np.maximum(lengths - 1, 0)[wanted].tobytes(), wanted.tobytes(), [held[k][0] for k in wanted]))
        return pd.DataFrame(out, columns=["bucket", "base", "kind", "at", "cells", "ids"])


def packed(kind: int, cells: np.ndarray) -> bytes:
    """Bigrams of frequent words have two places of PLACE_BITS, so five bytes hold them."""
    if kind == RARE:
        return cells.tobytes()
    return (cells & 0xFFFFFFFF).astype(np.uint32).tobytes() + (cells >> 32).astype(np.uint8).tobytes()


def unpacked(kind: int, held: bytes) -> np.ndarray:
    if kind == RARE:
        return np.frombuffer(held, np.int64)
    n = len(held) // 5
    return np.frombuffer(held, np.uint8, n, 4 * n).astype(np.int64) << 32 | np.frombuffer(held, np.uint32, n)


def find(frequent: np.ndarray, ids: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Whether each id is a frequent word's, and its place there."""
    if not frequent.shape[1]:
        return np.zeros(len(ids), bool), np.zeros(len(ids), np.int64)
    k = np.minimum(np.searchsorted(frequent[0], ids), frequent.shape[1] - 1)
    return frequent[0, k] == ids, k


JUDGED = "kind int, rid long, doc_id string, tokens long, target_loss double, loss double, cell long, n0 long, t0 long, k1 long, n1 long, t1 long, k2 long, n2 long, t2 long"


def _judge(pdf: pd.DataFrame, frequent: np.ndarray, losses: Callable) -> pd.DataFrame:
    """A bucket: sums of a document over bigrams of frequent words; other bigrams, with what is known; documents."""

    def taken(kind: int) -> tuple[np.ndarray, ...]:
        """rid, wanted, different cells, of each occurrence which it is, and the cells' counts in corpus and target."""
        part = pdf[pdf["kind"] == kind]
        at = [np.cumsum(np.frombuffer(x, np.int32), dtype=np.int32) for x in part["at"]]
        rid = np.repeat(part["base"].to_numpy(np.int64), [len(x) for x in at])
        at = np.concatenate([np.zeros(0, np.int32), *at])
        rid += at >> 3
        flags = (at & 7).astype(np.uint8)
        cells, inverse = np.unique(np.concatenate([np.zeros(0, np.int64), *[unpacked(kind, x) for x in part["cells"]]]), return_inverse=True)
        n, t = (np.bincount(inverse[(flags & f) > 0], minlength=len(cells)) for f in (TRAIN, TARGET))
        wanted = (flags & SCORE) > 0
        return rid[wanted], cells, inverse[wanted], n, t

    rid, cells, inverse, n, t = taken(COMMON)
    first, second = cells >> PLACE_BITS, cells & (1 << PLACE_BITS) - 1
    target_loss, loss = losses([n, frequent[1, first], frequent[1, second]], [t, frequent[2, first], frequent[2, second]], np.log)
    rid, back = np.unique(rid, return_inverse=True)
    out = [{"kind": np.full(len(rid), COMMON), "rid": rid, "target_loss": np.bincount(back, target_loss[inverse], len(rid)), "loss": np.bincount(back, loss[inverse], len(rid))}]
    del cells, inverse, n, t, first, second, target_loss, loss, back

    rid, cells, inverse, n, t = taken(RARE)
    rows = {"kind": np.full(len(rid), RARE), "rid": rid, "n0": n[inverse], "t0": t[inverse]}
    for k, ids in ((1, cells >> BITS), (2, cells & (1 << BITS) - 1)):
        known, place = find(frequent, ids)
        counts = np.where(known, frequent[1:, place], 0) if frequent.shape[1] else np.zeros((2, len(ids)), np.int64)
        rows |= {f"k{k}": np.where(known, -1, ids)[inverse], f"n{k}": counts[0][inverse], f"t{k}": counts[1][inverse]}
    out.append(rows)
    del cells, inverse, n, t

    for base, at, cells in zip(*[pdf.loc[pdf["kind"] == HOT, c] for c in ("base", "at", "cells")], strict=True):
        at, (places, times) = np.frombuffer(at, np.int32), np.frombuffer(cells, np.int32).reshape(2, -1)
        out.append({"kind": np.full(len(at), HOT), "rid": base + (at >> 3).astype(np.int64), "cell": places.astype(np.int64), "n0": times.astype(np.int64), "t0": (at & 7).astype(np.int64)})

    for base, at, cells, ids in zip(*[pdf.loc[pdf["kind"] == DOCUMENT, c] for c in ("base", "at", "cells", "ids")], strict=True):
        places = np.frombuffer(cells, np.int64)
        out.append({"kind": np.full(len(places), DOCUMENT), "rid": base + places, "doc_id": np.array(list(ids), object), "tokens": np.frombuffer(at, np.int64)})
    # Columns that a kind of row doesn't have are 0 there, or null for doc_id: neither sums nor maxima mind.
    none = {c: np.float64(0) if kind == "double" else None if kind == "string" else np.int64(0) for c, kind in (x.split() for x in JUDGED.split(", "))}
    return pd.DataFrame({c: np.concatenate([x[c] if c in x else np.full(len(x["rid"]), zero, object if zero is None else None) for x in out]) for c, zero in none.items()})


def _others(rare: DataFrame, scorer: Scorer) -> DataFrame:
    """rid, target_loss, loss of bigrams with a word whose counts weren't broadcast. A word's key is -1 if they were."""

    def joined(rows: DataFrame, key: str, sides: tuple) -> DataFrame:
        words = scorer.words.select(F.col("id").alias(key), "n", "n_target")
        out = rows.join(words, key, "left")
        return out.withColumns({f"{c}{k}": F.when(F.col(f"k{k}") >= 0, F.coalesce(x, F.lit(0))).otherwise(F.col(f"{c}{k}")) for k in sides for c, x in (("n", "n"), ("t", "n_target"))}).drop("n", "n_target")

    both = (F.col("k1") >= 0) & (F.col("k2") >= 0)
    one = joined(rare.where(~both).withColumn("key", F.greatest("k1", "k2")), "key", (1, 2)).drop("key")
    two = joined(joined(rare.where(both), "k1", (1,)), "k2", (2,))
    n, t = ([F.col(f"{c}{k}") for k in (0, 1, 2)] for c in "nt")
    target_loss, loss = scorer.losses(n, t, F.log)
    return one.unionByName(two).select("rid", target_loss.alias("target_loss"), loss.alias("loss"))


def _hot(judged: DataFrame, scorer: Scorer) -> DataFrame:
    """rid, target_loss, loss of hot bigrams: judged (rid, cell: which one, n0: how often, t0: the document's flags)."""
    spark, flagged = judged.sparkSession, lambda f: F.col("t0").bitwiseAND(F.lit(f)) > 0
    rows = judged.where(F.col("kind") == HOT)
    both = rows.groupBy("cell").agg(*[F.sum(F.when(flagged(f), F.col("n0")).otherwise(0)).alias(c) for c, f in (("b", TRAIN), ("bt", TARGET))])
    known = spark.createDataFrame(pd.DataFrame({"cell": np.arange(len(scorer.hot)), "id1": scorer.hot >> BITS, "id2": scorer.hot & (1 << BITS) - 1}))
    for k in (1, 2):
        word = scorer.words.select(F.col("id").alias(f"id{k}"), F.col("n").alias(f"n{k}"), F.col("n_target").alias(f"t{k}"))
        known = known.join(word, f"id{k}", "left").fillna(0, [f"n{k}", f"t{k}"])
    target_loss, loss = scorer.losses([F.col(c) for c in ("b", "n1", "n2")], [F.col(c) for c in ("bt", "t1", "t2")], F.log)
    priced = both.join(known, "cell").select("cell", target_loss.alias("a"), loss.alias("b"))  # MOST_HOT rows at most
    each = rows.where(flagged(SCORE)).join(F.broadcast(priced), "cell")
    return each.groupBy("rid").agg(F.sum(F.col("a") * F.col("n0")).alias("target_loss"), F.sum(F.col("b") * F.col("n0")).alias("loss"))


def scored(docs: DataFrame, scorer: Scorer) -> DataFrame:
    """docs (doc_id, text) -> doc_id, tokens, target_ce, background_ce, score."""
    vocabulary, frequent, losses = scorer.vocabulary, scorer.frequent, scorer.losses
    if docs is scorer.of:
        rows, size = scorer.docs.withColumn("flags", F.col("flags").bitwiseOR(F.lit(SCORE))), losses.total
    else:
        wanted = docs.select("doc_id", "text", F.lit(SCORE).alias("flags"))
        rows = scorer.docs.union(wanted)
        size = losses.total + (_counts(wanted, vocabulary).agg(F.sum("n")).first()[0] or 0)
    buckets = 1 + size // BUCKET
    bounded(docs.sparkSession)
    shared = docs.sparkSession.sparkContext.broadcast((frequent, scorer.hot))

    def send(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        yield from Sender(vocabulary, shared.value[0], buckets, shared.value[1])(batches)

    def judge(pdf: pd.DataFrame) -> pd.DataFrame:
        out = _judge(pdf, shared.value[0], losses)
        release()
        return out

    sent = rows.withColumn("doc_id", F.col("doc_id").cast("string")).mapInPandas(send, "bucket int, base long, kind int, at binary, cells binary, ids array<string>")
    judged = staged(sent.groupBy("bucket").applyInPandas(judge, JUDGED), "lm-judged")
    known = judged.where(F.col("kind").isin(COMMON, DOCUMENT)).select("rid", "doc_id", "tokens", "target_loss", "loss")
    if len(scorer.hot):
        known = known.unionByName(_hot(judged, scorer), allowMissingColumns=True)
    others = _others(judged.where(F.col("kind") == RARE).select("rid", *[f"{c}{k}" for k in (0, 1, 2) for c in "nt"], "k1", "k2"), scorer)
    each = known.unionByName(others, allowMissingColumns=True).groupBy("rid").agg(*[F.max(c).alias(c) for c in ("doc_id", "tokens")], *[F.sum(c).alias(c) for c in ("target_loss", "loss")])
    target_ce, background_ce = (F.when((F.col("tokens") > 0) & F.lit(losses.mass > 0), F.col(c) / F.col("tokens")) for c in ("target_loss", "loss"))
    return each.select(F.col("doc_id").cast(docs.schema["doc_id"].dataType), "tokens", target_ce.alias("target_ce"), background_ce.alias("background_ce"), F.coalesce(background_ce - target_ce, F.lit(0.0)).alias("score"))


def op10_lm_scoring(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every document's cross-entropies under the two models, and their difference."""
    docs = documents(spark, sf_dir).select("doc_id", "text")
    labels = spark.read.parquet(f"{sf_dir}/labels.parquet")
    return scored(docs, learn(docs, labels))
