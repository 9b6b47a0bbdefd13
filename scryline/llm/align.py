"""Cross-tokenizer alignment: which tokens of one tokenizer share text with which of another.

Two tokenizers cut the same bytes (a space, then the text). Offsets where tokens of both end cut them into groups; every token of
the one in a group is linked with every token of the other there. An id pair counts the documents that hold it linked.

A task works through blocks of documents. Both tokenizers always cut at a single space between two other characters and neither looks
across it, so a block's texts are split there and each different part is tokenised once. The parts stand one behind the other on one axis
of bytes, and DuckDB works on the tokens' intervals on it: the ends that both sides have, numbered by a window sum, are the groups;
an ASOF join puts tokens into them; range and equi-joins give the links of each part, hence of each document. A document's pairs, with their
number of links, are written once; tasks count them in part and Spark adds the parts up. The counts of the FREQUENT most
frequent pairs at most are broadcast, so no pair that many documents hold is shuffled by row; the others find theirs by a join.

Defined results: texts that are null or empty, or of which the tokens' bytes aren't those of the text after a space (as with U+2581,
which the second tokenizer takes for a space), have no tokens, zeros and an empty digest; rows that repeat, and rows without a doc_id, are
aligned and counted each for itself; the names of special tokens are plain text; texts of any length go through whole; further
columns are ignored; an empty table gives no rows.
"""

from __future__ import annotations

import functools
import hashlib
import os
import re
import tempfile
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession, functions as F

from scryline.llm.common import bounded, documents, release, staged, text_blocks

#: Bytes of text of a block of documents; parts that are tokenised in one go; keys that a task counts at a time.
BLOCK, RUN, COUNTED = 1 << 22, 2_000, 1 << 22
#: Pairs whose counts are broadcast, at most (12 bytes each).
FREQUENT = 1 << 20
#: Bits of an id pair's key that hold the second id.
LOW = 15
#: All characters that either tokenizer, or Python, takes for white space. Fixed values.
SPACES = "\t-\r\x1c-\x20\x85\xa0  -     　"
_CUT = re.compile(f"(?<=[^{SPACES}]) (?=[^{SPACES}])")
_ODD = f"^ | $| [{SPACES}]|[{SPACES}] "
_EDGE = re.compile(f"[{SPACES}]")

SCHEMA = "doc_id long, n_a long, n_b long, n_groups long, n_links long, groups_sha256 string, keys array<int>, links array<long>"


class Tokenizers:
    """The two tokenizers and the bytes of their tokens."""

    def __init__(self, path_a: str, path_b: str):
        os.environ.setdefault("TOKENIZERS_PARALLELISM", "false")
        from sentencepiece import SentencePieceProcessor
        from tokenizers import Tokenizer

        self.a = Tokenizer.from_file(path_a)
        self.a.encode_special_tokens = True
        self.b = SentencePieceProcessor(model_file=path_b)
        plain = [*range(33, 127), *range(161, 173), *range(174, 256)]  # bytes that are written as the character of their number; the others follow 255
        written = {chr(k): k for k in plain} | {chr(256 + i): k for i, k in enumerate(k for k in range(256) if k not in plain)}
        self.bytes_a = [bytes(written[c] for c in self.a.id_to_token(i)) for i in range(self.a.get_vocab_size())]
        self.bytes_b = [bytes([int(p[3:5], 16)]) if self.b.is_byte(i) else p.replace("▁", " ").encode() for i, p in enumerate(map(self.b.id_to_piece, range(self.b.vocab_size())))]
        self.size_a, self.size_b = (np.array([len(x) for x in table], np.int64) for table in (self.bytes_a, self.bytes_b))

    def encode(self, texts: list[str]) -> list[tuple[list[int], list[int]] | None]:
        """Ids of each text after a space; None where the tokens' bytes aren't the text's."""
        out = []
        for text, a, b in zip(texts, self.a.encode_batch_fast([" " + t for t in texts], add_special_tokens=False), self.b.encode(texts, num_threads=1), strict=True):
            whole = b" " + text.encode()
            same = b"".join(map(self.bytes_a.__getitem__, a.ids)) == whole == b"".join(map(self.bytes_b.__getitem__, b))
            out.append((a.ids, b) if same else None)
        return out


class Axis:
    """Different parts, one behind the other, with the tokens of both sides: the k-th part on it is parts[k]."""

    def __init__(self, parts: list[str], tokenizers: Tokenizers):
        even, odd = [], []
        for i, p in enumerate(parts):
            (odd if not p or _EDGE.match(p[0]) or _EDGE.match(p[-1]) else even).append(i)
        groups = [even[lo : lo + RUN] for lo in range(0, len(even), RUN)] + [[i] for i in odd]
        sides: list[list[list[int]]] = [[], []]
        self.parts: list[int] = []
        self.broken: list[int] = []
        while groups:
            again = []
            for group, found in zip(groups, tokenizers.encode([" ".join(parts[i] for i in g) for g in groups]), strict=True):
                if found:
                    self.parts += group
                    for side, ids in zip(sides, found, strict=True):
                        side.append(ids)
                elif len(group) > 1:
                    again += [[i] for i in group]
                else:
                    self.broken += group
            groups = again
        self.ids = [np.concatenate([np.zeros(0, np.int64), *[np.asarray(x, np.int64) for x in side]]) for side in sides]
        self.ends = [np.cumsum(size[ids]) for ids, size in zip(self.ids, (tokenizers.size_a, tokenizers.size_b), strict=True)]
        self.part_ends = np.cumsum(np.array([len(parts[i].encode()) + 1 for i in self.parts], np.int64))


GROUPS = """
CREATE OR REPLACE TEMP TABLE groups AS
SELECT e, sum(1) OVER (ORDER BY e ROWS UNBOUNDED PRECEDING)::BIGINT - 1 AS g FROM a JOIN b USING (e)
"""
PLACED = "CREATE OR REPLACE TEMP TABLE in_{0} AS SELECT k, id, g FROM {0} ASOF JOIN groups ON {0}.e <= groups.e"
PAIRS = f"""
CREATE OR REPLACE TEMP TABLE pairs AS
WITH part_of AS (SELECT g, part FROM groups ASOF JOIN parts ON groups.e <= parts.e),
x AS (SELECT g, id, count(*) AS n FROM in_a GROUP BY g, id), y AS (SELECT g, id, count(*) AS n FROM in_b GROUP BY g, id)
SELECT part, (x.id << {LOW} | y.id)::INTEGER AS key, sum(x.n * y.n)::BIGINT AS links FROM x JOIN y USING (g) JOIN part_of USING (g) GROUP BY ALL
"""
OF_DOCUMENTS = """
WITH held AS (SELECT doc, part, count(*) AS n FROM occurrences GROUP BY doc, part)
SELECT doc, key, sum(n * links)::BIGINT AS links FROM held JOIN pairs USING (part) GROUP BY doc, key ORDER BY doc, key
"""


class Aligner:
    """Blocks of documents -> rows of SCHEMA."""

    def __init__(self, path_a: str, path_b: str):
        import duckdb

        self.tokenizers = Tokenizers(path_a, path_b)
        self.db = duckdb.connect(config={"threads": 1, "memory_limit": "400MB", "temp_directory": tempfile.mkdtemp()})
        n = max(len(self.tokenizers.bytes_a), len(self.tokenizers.bytes_b))
        self.spelt = [f"{i}{sign}" for sign in ("", ",", "|", ";") for i in range(n)]
        self.n = n

    def __call__(self, ids: pa.Array, texts: pa.Array) -> pa.RecordBatch:
        has = pc.fill_null(pc.greater(pc.binary_length(texts), 0), False)
        full = np.flatnonzero(has.to_numpy(zero_copy_only=False))
        count = len(texts)
        sums = {c: np.zeros(count, np.int64) for c in ("n_a", "n_b", "n_groups", "n_links")}
        digests, keys, links, sizes = [""] * count, np.zeros(0, np.int32), np.zeros(0, np.int64), np.zeros(count, np.int64)
        if len(full):
            docs, part, parts = split(texts.filter(has))
            docs = full[docs]
            axis = Axis(parts, self.tokenizers)
            gone = np.zeros(len(parts), bool)
            gone[axis.broken] = True
            bad = np.unique(docs[gone[part]])
            stays = ~np.isin(docs, bad)
            docs, part = docs[stays], part[stays]
            of_part, strings = self.aligned(axis, len(parts))
            self.db.register("occurrences", pa.table({"doc": docs, "part": part}))
            found = self.db.sql(OF_DOCUMENTS).fetchnumpy()
            keys, links = found["key"].astype(np.int32), found["links"].astype(np.int64)
            sizes = np.bincount(found["doc"], minlength=count).astype(np.int64)
            for c, values in of_part.items():
                np.add.at(sums[c], docs, values[part])
            np.add.at(sums["n_links"], found["doc"], links)
            begin = np.flatnonzero(np.concatenate(([True], docs[1:] != docs[:-1]))) if len(docs) else np.zeros(0, int)
            for lo, hi in zip(begin, np.append(begin[1:], len(docs)), strict=True):
                digests[docs[lo]] = hashlib.sha256(";".join(map(strings.__getitem__, part[lo:hi].tolist())).encode()).hexdigest()
        offsets = pa.array(np.concatenate(([0], np.cumsum(sizes))).astype(np.int32))
        lists = [pa.ListArray.from_arrays(offsets, pa.array(x)) for x in (keys, links)]
        return pa.RecordBatch.from_arrays([ids.cast(pa.int64()), *map(pa.array, sums.values()), pa.array(digests, pa.string()), *lists], names=["doc_id", *sums, "groups_sha256", "keys", "links"])

    def aligned(self, axis: Axis, n_parts: int) -> tuple[dict[str, np.ndarray], list[str]]:
        """Of each part its numbers of tokens and groups, and its groups as text; fills the table `pairs`."""
        db = self.db
        for name, ids, ends in zip("ab", axis.ids, axis.ends, strict=True):
            db.register(name, pa.table({"k": np.arange(len(ids)), "e": ends, "id": ids}))
        place = np.asarray(axis.parts, np.int64)
        db.register("parts", pa.table({"part": place, "e": axis.part_ends}))
        db.execute(GROUPS)
        for name in "ab":
            db.execute(PLACED.format(name))
        db.execute(PAIRS)
        g = [db.sql(f"SELECT g FROM in_{name} ORDER BY k").fetchnumpy()["g"] for name in "ab"]
        ends = db.sql("SELECT e FROM groups ORDER BY e").fetchnumpy()["e"]
        at = [np.searchsorted(axis.part_ends, e) for e in (*axis.ends, ends)]
        of_part = {c: np.bincount(place[x], minlength=n_parts) for c, x in zip(("n_a", "n_b", "n_groups"), at, strict=True)}
        # All tokens by group and side; what stands behind each says whether the next is of the same side, group or part.
        side = np.repeat([0, 1], [len(x) for x in g])
        turn = np.concatenate(g) * 2 + side
        order = np.argsort(turn, kind="stable")
        turn, token, owner = turn[order], np.concatenate(axis.ids)[order], np.concatenate(at[:2])[order]
        last = np.append(owner[1:] != owner[:-1], True) if len(owner) else np.zeros(0, bool)
        following = np.append(turn[1:], -1) if len(turn) else turn
        sign = np.where(last, 0, np.where(following == turn, 1, np.where(following >> 1 == turn >> 1, 2, 3)))
        pieces = list(map(self.spelt.__getitem__, (sign * self.n + token).tolist()))
        strings, lo = [""] * n_parts, 0
        for p, hi in zip(axis.parts, (np.flatnonzero(last) + 1).tolist(), strict=True):
            strings[p] = pieces[lo] if hi == lo + 1 else "".join(pieces[lo:hi])
            lo = hi
        return of_part, strings


@functools.cache
def aligner(path_a: str, path_b: str) -> Aligner:
    """One for each worker: the tokenizers take longer to read than a small block takes to align."""
    return Aligner(path_a, path_b)


def split(texts: pa.Array) -> tuple[np.ndarray, np.ndarray, list[str]]:
    """Of texts that aren't empty: which text, and which of the different parts, each part of them is, in order; the different parts."""
    odd = pc.match_substring_regex(texts, _ODD)
    plain = pc.split_pattern(texts.filter(pc.invert(odd)), " ")
    rest = pa.array([_CUT.split(t) for t in texts.filter(odd).to_pylist()], plain.type)
    is_odd = odd.to_numpy(zero_copy_only=False)
    docs = np.concatenate([np.flatnonzero(~is_odd), np.flatnonzero(is_odd)])
    sizes = np.concatenate([x.value_lengths().to_numpy(zero_copy_only=False) for x in (plain, rest)])
    flat = pa.concat_arrays([plain.flatten(), rest.flatten()]).dictionary_encode()
    return np.repeat(docs, sizes.astype(np.int64)), flat.indices.to_numpy().astype(np.int64), flat.dictionary.to_pylist()


def aligned(docs: DataFrame, path_a: str, path_b: str) -> DataFrame:
    """docs (doc_id, text) -> rows of SCHEMA, one for each row; keys: the linked id pairs, links: how many links each has."""

    def align(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for block in text_blocks(batches, "text", BLOCK):
            yield aligner(path_a, path_b)(block.column("doc_id"), block.column("text"))
            release()

    bounded(docs.sparkSession)
    return docs.select("doc_id", "text").mapInArrow(align, SCHEMA)


def pair_counts(rows: DataFrame) -> DataFrame:
    """rows (keys array<int>) -> key, n: how many rows hold it."""

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, size = [], 0

        def summed() -> pa.RecordBatch:
            key, n = np.unique(np.concatenate(held), return_counts=True)
            return pa.RecordBatch.from_arrays([pa.array(key.astype(np.int32)), pa.array(n.astype(np.int64))], names=["key", "n"])

        for batch in batches:
            held.append(batch.column("keys").flatten().to_numpy())
            size += len(held[-1])
            if size > COUNTED:
                yield summed()
                held, size = [], 0
        if size:
            yield summed()

    return rows.select("keys").mapInArrow(count, "key int, n long").groupBy("key").agg(F.sum("n").alias("n"))


def frequent_pairs(pairs: DataFrame, most: int) -> tuple[np.ndarray, np.ndarray, int]:
    """Keys (ascending) and counts of as many of the most frequent pairs as stay within `most`, and the least count that is sure to be there."""
    step = F.floor(F.log2("n") * 8).cast("int").alias("step")
    held, lowest = 0, None
    for r in sorted(pairs.groupBy(step).agg(F.count("*").alias("pairs"), F.min("n").alias("least")).collect(), reverse=True):
        held += r["pairs"]
        if held > most:
            break
        lowest = r["least"]
    if lowest is None:
        return np.zeros(0, np.int32), np.zeros(0, np.int64), 1 << 62
    top = pairs.where(F.col("n") >= lowest).orderBy("key").toPandas()
    return top["key"].to_numpy(np.int32), top["n"].to_numpy(np.int64), lowest


def scored(rows: DataFrame, most: int = FREQUENT) -> DataFrame:
    """rows of SCHEMA (written) -> doc_id, n_a, n_b, n_groups, n_links, groups_sha256, n_best, count_sum."""
    spark = rows.sparkSession
    pairs = staged(pair_counts(rows), "pair-counts")
    best = np.zeros(1 << 31 - LOW, np.int64)  # of each first id the highest count: bounded by the ids
    for r in pairs.groupBy(F.shiftright("key", LOW).alias("a")).agg(F.max("n").alias("n")).collect():
        best[r["a"]] = r["n"]
    keys, counts, lowest = frequent_pairs(pairs, most)
    shared = spark.sparkContext.broadcast((best, keys, counts))

    def judged(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """Documents, with what frequent pairs give; then a row for each other pair."""
        best, keys, counts = shared.value
        for batch in batches:
            key, links = (batch.column(c).flatten().to_numpy() for c in ("keys", "links"))
            sizes = batch.column("keys").value_lengths().to_numpy(zero_copy_only=False)
            owner = np.repeat(np.arange(len(sizes)), sizes)
            at = np.minimum(np.searchsorted(keys, key), max(len(keys) - 1, 0))
            known = keys[at] == key if len(keys) else np.zeros(len(key), bool)
            n = counts[at[known]]
            n_best, count_sum = np.zeros(len(sizes), np.int64), np.zeros(len(sizes), np.int64)
            np.add.at(n_best, owner[known], np.where(n == best[key[known] >> LOW], links[known], 0))
            np.add.at(count_sum, owner[known], n * links[known])
            rid = batch.column("rid").to_numpy()
            rest = [rid[owner[~known]], key[~known], links[~known], best[key[~known] >> LOW]]
            none = [pa.nulls(len(rest[0]), pa.int64())] * 2
            for columns in ([pa.array(rid), pa.array(n_best), pa.array(count_sum), pa.nulls(len(rid), pa.int32()), *[pa.nulls(len(rid), pa.int64())] * 2], [pa.array(rest[0]), *none, *map(pa.array, rest[1:])]):
                yield pa.RecordBatch.from_arrays(columns, names=["rid", "n_best", "count_sum", "key", "links", "best"])

    found = rows.select("rid", "keys", "links").mapInArrow(judged, "rid long, n_best long, count_sum long, key int, links long, best long")
    each = found.where("key is null").select("rid", "n_best", "count_sum")
    if lowest > 1:  # else every pair is frequent
        rare = found.where("key is not null").join(pairs.where(F.col("n") < lowest), "key")
        more = rare.groupBy("rid").agg(F.sum(F.when(F.col("n") == F.col("best"), F.col("links")).otherwise(0)).alias("more_best"), F.sum(F.col("n") * F.col("links")).alias("more_sum"))
        each = each.join(more, "rid", "left").select("rid", *[(F.col(c) + F.coalesce(m, F.lit(0))).alias(c) for c, m in (("n_best", "more_best"), ("count_sum", "more_sum"))])
    return rows.drop("keys", "links").join(each, "rid").drop("rid")


def alignment(docs: DataFrame, path_a: str, path_b: str, most: int = FREQUENT) -> DataFrame:
    """docs (doc_id, text) -> doc_id, n_a, n_b, n_groups, n_links, n_best, count_sum, groups_sha256; one row for each row."""
    rows = staged(aligned(docs, path_a, path_b).withColumn("rid", F.monotonically_increasing_id()), "aligned")
    return scored(rows, most).select("doc_id", "n_a", "n_b", "n_groups", "n_links", "n_best", "count_sum", "groups_sha256")


def op13_alignment(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every document's tokens of two public tokenizers, aligned."""
    import public_tokenizers

    return alignment(documents(spark, sf_dir), public_tokenizers.path("byte_bpe_50k.json"), public_tokenizers.path("piece_bpe_32k.model"))
