"""Best-fit packing of tokenised documents into sequences, by hierarchical residual packing.

Each partition tokenises its documents and packs their pieces best-fit (longest first, each into the open
sequence that it fills most). Nearly full sequences are emitted. Underfull ones are items of the next round,
where ROUND_ROWS of them, dealt out anew, meet in one task. After a round no two sequences of a task fit together, so each task has one
that is at most half full, and none but those can go into others. The next round takes these, and as many of the others: those with the
most room, since no more can be needed. So each round has a ROUND_ROWS-th as many tasks, and after the last, which has one, no two sequences
fit together. A sequence travels as one binary value (28 bytes for each of its pieces).

Defined results: a null text is an empty one; an empty text is a piece of one token (the end id); rows that
repeat are packed each for itself; a null doc_id stays null; an empty table gives no rows.
"""

from __future__ import annotations

import re
import struct
import zlib
from collections.abc import Callable, Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession, functions as F

from scryline.llm.common import bounded, documents, release, staged

ITEM = np.dtype([("doc_id", "<i8"), ("start", "<i8"), ("piece", "<i4"), ("length", "<i4"), ("crc", "<u4")])
NO_ID = np.iinfo(np.int64).min
#: A sequence with this many free tokens or fewer is nearly full.
NEARLY = 16
#: Leftovers that meet in one task.
ROUND_ROWS = 50_000
#: Encodings that a task remembers (about 200 bytes each): of runs met twice and of those met once; and the longest such run.
CACHE_ENTRIES, ONCE_ENTRIES, CACHE_CHARS = 200_000, 150_000, 48
_SEPARATORS = re.compile("[\x1c-\x1f]")


class Encoder:
    """Token ids of texts as little-endian 32-bit bytes, as the tokenizer gives them for the whole text.

    The tokenizer lower-cases, drops white space and never joins what stands on its two sides, so runs between white
    space are encoded once and remembered. It cuts a run into pieces by PIECES; its model encodes each piece for itself, so a
    run's ids are those of its pieces. All this holds for texts of Latin-1 characters, which have one form only; other texts,
    and those with one of the four control characters that Python alone splits at, or with a special token, go through the
    tokenizer whole.

    The memory is bounded: runs are remembered for good from their second occurrence on, so the many that occur once don't
    drive out the others; what is full is forgotten.
    """

    #: Fixed value: the tokenizer's own pattern.
    PIECES = r"'s|'t|'re|'ve|'m|'ll|'d|[\p{L}]+|[\p{N}]|[^\s\p{L}\p{N}]+"

    def __init__(self, path: str):
        import regex
        from tokenizers import Tokenizer, pre_tokenizers

        self.tokenizer = Tokenizer.from_file(path)
        self.model = self.tokenizer.model
        self.cut = regex.compile(self.PIECES).findall
        as_bytes = pre_tokenizers.ByteLevel(add_prefix_space=False, use_regex=False).pre_tokenize_str
        #: The model works on bytes that are written as characters.
        self.written = {k: as_bytes(chr(k))[0][0] for k in range(128, 256)}
        self.cache: dict[str, bytes] = {}
        self.once: dict[str, bytes] = {}

    def _ids(self, texts: list[str]) -> list[bytes]:
        return [np.array(e.ids, "<u4").tobytes() for e in self.tokenizer.encode_batch_fast(texts, add_special_tokens=False)]

    def _piece(self, piece: str) -> bytes:
        found = [t.id for t in self.model.tokenize(piece if piece.isascii() else piece.translate(self.written))]
        return struct.pack(f"<{len(found)}I", *found)

    def _remembered(self, part: str, encode: Callable[[str], bytes]) -> bytes:
        """Of a run or piece that isn't in the cache."""
        ids = self.once.pop(part, None)
        if ids is not None:
            self.cache[part] = ids
            return ids
        ids = encode(part)
        if len(part) <= CACHE_CHARS:
            self.once[part] = ids
        return ids

    def _run(self, run: str) -> bytes:
        """A run of lower-cased Latin-1 characters."""
        if run.isalpha():
            return self._piece(run)
        known = self.cache.get
        return b"".join([known(p) or self._remembered(p, self._piece) for p in self.cut(run)])

    def encode(self, texts: list[str]) -> list[bytes]:
        out = []
        for t in texts:
            lowered = _lowered(t)
            if lowered is None:
                out.append(self._ids([t])[0])
                continue
            runs = lowered.split()
            ids = list(map(self.cache.get, runs))
            if None in ids:
                known = self.cache.get
                ids = [x or known(r) or self._remembered(r, self._run) for x, r in zip(ids, runs, strict=True)]
            out.append(b"".join(ids))
            if len(self.cache) > CACHE_ENTRIES:
                self.cache.clear()
            if len(self.once) > ONCE_ENTRIES:
                self.once.clear()
        return out


def _lowered(text: str) -> str | None:
    """Lower case, where Python's is sure to be the tokenizer's own; else null."""
    if "<|" in text or _SEPARATORS.search(text):
        return None
    try:
        text.encode("latin-1")
    except UnicodeEncodeError:
        return None
    return text.lower()


def pieces(doc_ids: list, encoded: list[bytes], end_id: int, capacity: int) -> np.ndarray:
    tail, out = end_id.to_bytes(4, "little"), []
    for doc_id, ids in zip(doc_ids, encoded, strict=True):
        ids += tail
        n = len(ids) // 4
        for k, start in enumerate(range(0, n, capacity)):
            part = ids[4 * start : 4 * (start + capacity)]
            out.append((NO_ID if doc_id is None else doc_id, start, k, len(part) // 4, zlib.crc32(part)))
    return np.array(out, dtype=ITEM)


def best_fit(lengths: np.ndarray, capacity: int) -> list[list[int]]:
    """Bins of indices: longest first, each into the open bin with the least room that still holds it."""
    room: list[list[int]] = [[] for _ in range(capacity + 1)]
    open_, bins = 0, []
    order = np.argsort(-lengths.astype(np.int64), kind="stable")
    for i, length in zip(order.tolist(), lengths[order].tolist(), strict=True):
        fits = open_ >> length
        if fits:
            r = length + (fits & -fits).bit_length() - 1
            b = room[r].pop()
            if not room[r]:
                open_ ^= 1 << r
            bins[b].append(i)
        else:
            r, b = capacity, len(bins)
            bins.append([i])
        left = r - length
        if not room[left]:
            open_ |= 1 << left
        room[left].append(b)
    return bins


def _merged(fill: np.ndarray, items: list[bytes], capacity: int) -> pd.DataFrame:
    made = best_fit(fill, capacity)
    return pd.DataFrame({"fill": np.array([int(fill[b].sum()) for b in made], np.int32), "items": [b"".join(items[i] for i in b) for b in made]})


def local_bins(docs: DataFrame, tokenizer: str, end_id: int, capacity: int) -> DataFrame:
    """docs (doc_id, text) -> fill, items: each partition's documents, packed."""

    def pack(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        encoder, found = Encoder(tokenizer), []
        for pdf in batches:
            ids = [None if pd.isna(x) else int(x) for x in pdf["doc_id"]]
            texts = ["" if t is None else t for t in pdf["text"]]
            for lo in range(0, len(texts), 256):
                found.append(pieces(ids[lo : lo + 256], encoder.encode(texts[lo : lo + 256]), end_id, capacity))
            release()
        if found:
            items = np.sort(np.concatenate(found), order=["doc_id", "piece", "crc"])
            yield _merged(items["length"], [x.tobytes() for x in items], capacity)

    bounded(docs.sparkSession)
    return docs.select("doc_id", "text").mapInPandas(pack, "fill int, items binary")


def pack_documents(docs: DataFrame, tokenizer: str, end_id: int = 1, capacity: int = 4096) -> DataFrame:
    """docs (doc_id, text) -> doc_id, piece, start, length, ids_crc32, sequence_id, offset.

    Only documents of more than capacity tokens (with the end id) are cut. sequence_id: round, task and number in it.
    """
    number = F.monotonically_increasing_id().alias("number")
    pool = staged(local_bins(docs, tokenizer, end_id, capacity).select("fill", "items", number), "bins-0")
    done, rounds, tasks = [], 0, 0
    while tasks != 1:
        least = pool.where(F.col("fill") < capacity - NEARLY).agg(F.min("fill")).first()[0]
        # what has less room than the smallest leftover fills can't be joined with anything
        open_ = (F.col("fill") < capacity - NEARLY) & (F.col("fill") + F.lit(least or capacity) <= capacity)
        chosen = open_
        if tasks:
            half = F.col("fill") <= capacity // 2
            small = pool.where(open_ & half).count()  # one of each task at most
            roomy = pool.where(open_ & ~half).orderBy("fill", "number").limit(small).select("number", F.lit(True).alias("roomy"))
            pool = staged(pool.join(roomy, "number", "left"), f"chosen-{rounds}")
            chosen = open_ & (half | F.coalesce("roomy", F.lit(False)))
        left = pool.where(chosen)
        n = left.count()
        if n < 2:
            break
        done.append(pool.where(~open_).withColumn("round", F.lit(rounds)))
        tasks = -(-n // ROUND_ROWS)
        rounds += 1
        # the tasks' leftovers are dealt out anew each round, small and large alike
        grouped = left.withColumn("task", F.pmod(F.xxhash64("items", F.lit(rounds)), F.lit(tasks)))

        def merge(pdf: pd.DataFrame) -> pd.DataFrame:
            pdf = pdf.sort_values(["fill", "number"], ascending=[False, True])
            return _merged(pdf["fill"].to_numpy(), pdf["items"].tolist(), capacity)

        merged = grouped.groupBy("task").applyInPandas(merge, "fill int, items binary").unionByName(pool.where(open_ & ~chosen).select("fill", "items"))
        pool = staged(merged.select("fill", "items", number), f"bins-{rounds}")
    done.append(pool.withColumn("round", F.lit(rounds)))
    packed = done[0]
    for more in done[1:]:
        packed = packed.unionByName(more, allowMissingColumns=True)

    def spell(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            for lo in range(0, len(pdf), 2000):
                part = pdf.iloc[lo : lo + 2000]
                items = np.frombuffer(b"".join(part["items"]), ITEM)
                per = part["items"].map(len).to_numpy() // ITEM.itemsize
                seq = np.repeat(part["sequence_id"].to_numpy(), per)
                ends = np.cumsum(items["length"].astype(np.int64))
                base = np.repeat(np.concatenate(([0], ends[np.cumsum(per)[:-1] - 1])), per)
                ids = pd.array(items["doc_id"].astype(np.int64), dtype="Int64")
                ids[items["doc_id"] == NO_ID] = pd.NA
                yield pd.DataFrame({"doc_id": ids, "piece": items["piece"], "start": items["start"], "length": items["length"].astype(np.int64), "ids_crc32": items["crc"].astype(np.int64), "sequence_id": seq, "offset": ends - items["length"] - base})

    numbered = packed.select("items", (F.shiftleft(F.col("round").cast("long"), 56) + F.col("number")).alias("sequence_id"))
    return numbered.mapInPandas(spell, "doc_id long, piece int, start long, length long, ids_crc32 long, sequence_id long, offset long")


def tokenizer_path() -> str:
    import public_tokenizers

    return public_tokenizers.path("word_bpe_49k.json")


def op3_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All documents in sequences of at most 4,096 tokens."""
    return pack_documents(documents(spark, sf_dir), tokenizer_path())
