"""Benchmark decontamination by pigeonhole edit matching.

An item that occurs in a text with at most k edits has, cut into k + 1 pieces, at least one piece that occurs
unchanged. All pieces of all items are looked up at once, by the hashes of their first and last characters among those of
the text's runs of as many; around each exact hit, Myers' bit-parallel algorithm gives the least edit distance of the item
to any part of the text there.

Texts are compared in lower case with runs of other characters than letters and digits as one space.
k is error_rate times the item's length in that form. Items are taken in blocks of BLOCK_CHARS characters (some 70,000
items), so what a task holds is bounded; each block is one pass over the documents.

Defined results: null and empty texts match nothing, nor do null items or items with no letter or digit;
rows that repeat are each reported; equal items under several ids are reported under each.
"""

from __future__ import annotations

import re
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession, functions as F

from scryline.llm.common import bounded, documents, release

ERROR_RATE = 0.05
#: Characters of the items of a block, as a mean.
BLOCK_CHARS = 1 << 24
#: The longest run of characters that is hashed.
LONGEST = 16
#: Characters of a text that are hashed at a time.
CHUNK = 1 << 18
_ODD = np.uint64(0x9E3779B97F4A7C15)
_OTHER = re.compile(r"[\W_]+")


def normal(text: str | None) -> str:
    return _OTHER.sub(" ", (text or "").lower()).strip()


def pieces(item: str, k: int) -> list[tuple[int, str]]:
    """k + 1 pieces (place, text) of nearly equal length; fewer if the item has fewer characters."""
    n = min(k + 1, len(item))
    at = [round(i * len(item) / n) for i in range(n + 1)]
    return [(a, item[a:b]) for a, b in zip(at, at[1:], strict=False)]


def myers(item: str, text: str, most: int) -> tuple[int, int]:
    """Least edit distance of item to any part of text, and where that part ends; stops early at 0."""
    m = len(item)
    peq: dict[str, int] = {}
    for i, c in enumerate(item):
        peq[c] = peq.get(c, 0) | 1 << i
    full, top = (1 << m) - 1, 1 << (m - 1)
    pv, mv, score, best, end = full, 0, m, m, 0
    for j, c in enumerate(text):
        eq = peq.get(c, 0)
        xv = eq | mv
        xh = (((eq & pv) + pv) ^ pv) | eq
        ph = mv | ~(xh | pv) & full
        mh = pv & xh
        if ph & top:
            score += 1
        elif mh & top:
            score -= 1
        ph = ph << 1 & full
        mh = mh << 1 & full
        pv = mh | ~(xv | ph) & full
        mv = ph & xv
        if score < best:
            best, end = score, j + 1
            if not best:
                break
    return best, end


def windows(form: str) -> Iterator[tuple[int, np.ndarray]]:
    """q and the hashes of all runs of q characters, for q = 1, 2, 4, 8, 16: each made of two of the one before."""
    q, h = 1, (np.frombuffer(form.encode("utf-32-le", "surrogatepass"), "<u4").astype(np.uint64) + np.uint64(1)) * _ODD
    while True:
        yield q, h
        if q == LONGEST or len(h) <= q:
            return
        h = h[:-q] * (_ODD + np.uint64(4 * q)) + h[q:]
        q *= 2


class Pieces:
    """Pieces whose length is from q up to 2q - 1 (q and more for the longest), by the hash of their first q characters.

    seen says of a hash's high bits whether any piece has them: nearly all places of a text end there.
    """

    def __init__(self, q: int, rows: np.ndarray):
        rows = rows[np.argsort(rows["first"], kind="stable")]
        self.q, self.rows, self.first = q, rows, np.ascontiguousarray(rows["first"])
        bits = min(24, max(10, (32 * len(rows)).bit_length()))
        self.shift, self.seen = np.uint64(64 - bits), np.zeros(1 << bits, bool)
        self.seen[(self.first >> self.shift).astype(np.intp)] = True

    def hits(self, h: np.ndarray, most: int) -> tuple[np.ndarray, np.ndarray]:
        """Places (before most) and rows: the first q and the last q characters of the row's piece stand there."""
        at = np.flatnonzero(self.seen[(h[:most] >> self.shift).astype(np.intp)])
        if not len(at):
            return at, at
        lo = np.searchsorted(self.first, h[at], "left")
        count = np.searchsorted(self.first, h[at], "right") - lo
        row = np.arange(count.sum()) + np.repeat(lo - (np.cumsum(count) - count), count)
        at = np.repeat(at, count)
        end = at + self.rows["length"][row] - self.q
        fits = end < len(h)
        at, row, end = at[fits], row[fits], end[fits]
        same = h[end] == self.rows["last"][row]
        return at[same], row[same]


class Matcher:
    def __init__(self, items: list[tuple[int, str]], error_rate: float):
        self.items = []
        self.reach = 0
        found: dict[int, list[tuple]] = {}
        for item_id, text in items:
            form = normal(text)
            if form:
                k = int(len(form) * error_rate)
                hashes = dict(windows(form))
                for at, piece in pieces(form, k):
                    q = min(LONGEST, 1 << len(piece).bit_length() - 1)
                    h = hashes[q]
                    found.setdefault(q, []).append((h[at], h[at + len(piece) - q], len(self.items), at, len(piece)))
                    self.reach = max(self.reach, len(piece))
                self.items.append((item_id, form, k))
        row = [("first", "<u8"), ("last", "<u8"), ("item", "<i8"), ("at", "<i8"), ("length", "<i8")]
        self.pieces = {q: Pieces(q, np.array(rows, row)) for q, rows in found.items()}

    def places(self, form: str) -> list[tuple[int, int]]:
        """Where an item begins if a piece of it that occurs in form stands in its place, and the item; in order."""
        out = set()
        for lo in range(0, len(form), CHUNK):
            part = form[lo : lo + CHUNK + self.reach]
            for q, h in windows(part):
                if q in self.pieces:
                    at, row = self.pieces[q].hits(h, CHUNK)
                    for place, (_, _, n, before, length) in zip((at + lo).tolist(), self.pieces[q].rows[row].tolist(), strict=True):
                        if form.startswith(self.items[n][1][before : before + length], place):
                            out.add((place - before, n))
        return sorted(out)

    def hits(self, text: str | None) -> list[tuple[int, int, int]]:
        """item id, edits, where in the normal form the part ends: the best part for each item within its budget."""
        form = normal(text)
        best: dict[int, tuple[int, int]] = {}
        for begin, n in self.places(form) if self.pieces else ():
            if n in best and not best[n][0]:
                continue
            _, item, k = self.items[n]
            lo, hi = max(0, begin - k), begin + len(item) + 2 * k + 1
            if begin >= 0 and form.startswith(item, begin):
                got = (0, begin + len(item))
            else:
                edits, stop = myers(item, form[lo:hi], k)
                got = (edits, lo + stop)
            if got[0] <= k and (n not in best or got < best[n]):
                best[n] = got
        return sorted((self.items[n][0], e, at) for n, (e, at) in best.items())


def _blocks(items: DataFrame) -> Iterator[list[tuple[int, str]]]:
    items = items.select("item_id", "text").where("text is not null").distinct()
    n = -(-(items.agg(F.sum(F.length("text") + 1)).first()[0] or 0) // BLOCK_CHARS)
    for b in range(n):
        part = items.where(F.pmod(F.xxhash64("item_id", "text"), F.lit(n)) == b)
        yield sorted(((r["item_id"], r["text"]) for r in part.collect()), key=lambda x: (x[0] is not None, x))


def matches(docs: DataFrame, items: DataFrame, error_rate: float = ERROR_RATE) -> DataFrame:
    """docs (doc_id, text), items (item_id, text) -> doc_id, item_id, edits, ends_at: each item that a text holds."""
    schema = "doc_id long, item_id long, edits int, ends_at long"
    bounded(docs.sparkSession)
    out = None
    for block in _blocks(items):

        def search(batches: Iterator[pd.DataFrame], block=block) -> Iterator[pd.DataFrame]:
            matcher = Matcher(block, error_rate)
            for pdf in batches:
                rows = [(d, *hit) for d, t in zip(pdf["doc_id"], pdf["text"], strict=True) for hit in matcher.hits(t)]
                yield pd.DataFrame(rows, columns=["doc_id", "item_id", "edits", "ends_at"])

        part = docs.select("doc_id", "text").mapInPandas(search, schema)
        out = part if out is None else out.unionByName(part)
    return docs.sparkSession.createDataFrame([], schema) if out is None else out


def _clean(block: list[tuple[int, str]], error_rate: float):
    """A filter of texts that hold none of the block's items."""
    matchers: list[Matcher] = []  # one for each task, made on first use

    @F.pandas_udf("boolean")
    def clean(text: pd.Series) -> pd.Series:
        if not matchers:
            matchers.append(Matcher(block, error_rate))
        out = pd.Series([not matchers[0].hits(t) for t in text], dtype=bool)
        release()
        return out

    return clean


def decontaminated(docs: DataFrame, items: DataFrame, error_rate: float = ERROR_RATE) -> DataFrame:
    """The rows of docs whose text holds no item; all columns. One pass for all blocks of items, without a join."""
    bounded(docs.sparkSession)
    for block in _blocks(items):
        docs = docs.where(_clean(block, error_rate)("text"))
    return docs


def op6_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every benchmark item that a document holds with at most 5 % edits."""
    return matches(documents(spark, sf_dir), spark.read.parquet(f"{sf_dir}/benchmark.parquet"))
