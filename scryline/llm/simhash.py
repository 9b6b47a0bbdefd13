"""SimHash near-duplicates by meet-in-the-middle ball hashing.

Two fingerprints at most 2r bits apart have a variant in common that is at most r bits from either. So every
distinct fingerprint emits all its variants within r bits (2,081 for r = 2 of 64), and equal variants meet.

What is shuffled: a variant goes to the slice that the parities of k groups of its bits name. The variants of one
fingerprint that go to the same slice travel as the one fingerprint and are spelled out there, so each fingerprint is sent
1 + k + k (k - 1) / 2 times at most, to as many of the 2^k slices; k follows the number of fingerprints, so that a slice
has a bounded number of them. A slice works through its variants in sub-slices of bounded size, each of which takes its
fingerprints as ranges of a sorted array: the work is in proportion to the variants. Fingerprints
that share a variant are within 2r bits of each other pairwise, so a link from each to the smallest one loses
nothing; a slice returns a spanning forest of such links, never all pairs of a group.
"""

from __future__ import annotations

import math
from functools import lru_cache

import numpy as np
import pandas as pd
import xxhash
from pyspark.sql import Column, DataFrame, SparkSession, functions as F

from scryline.llm.common import bounded, documents, fresh, release, staged

BITS = 64
#: Bytes of the fingerprints that one slice gets, as a mean; from there on there are more slices.
SLICE_BYTES = 1 << 24
#: Variants that are spelled out at a time.
SUB_ROWS = 500_000
#: Rows of copies that go (16 bytes each) up to which they are broadcast.
GONE_ROWS = 500_000
LAST = (1 << 63) - 1


def fingerprint(text: str | None, words: int) -> int:
    """64-bit SimHash over shingles of so many words (repeats count), 0 without words. Only A-Z are lower-cased."""
    tokens = (text or "").encode("utf-8", "surrogatepass").lower().split()
    if not tokens:
        return 0
    line = b" ".join(tokens)
    if len(tokens) <= words:
        return xxhash.xxh64_intdigest(line, 42)
    ends = np.cumsum(np.fromiter(map(len, tokens), np.int64, len(tokens)) + 1) - 1
    starts = np.concatenate(([0], ends[:-1] + 1))
    n = len(tokens) - words + 1
    digest = xxhash.xxh64_intdigest
    ones = np.zeros(BITS, np.int64)
    a, b = starts[:n].tolist(), ends[words - 1 :].tolist()
    for lo in range(0, n, 65536):
        h = np.array([digest(line[i:j], 42) for i, j in zip(a[lo : lo + 65536], b[lo : lo + 65536])], dtype="<u8")
        ones += np.unpackbits(h.view(np.uint8).reshape(-1, 8), axis=1, bitorder="little").sum(axis=0, dtype=np.int64)
    out = 0
    for k in np.flatnonzero(2 * ones > n).tolist():
        out |= 1 << k
    return out


def fingerprints(docs: DataFrame, words: int) -> DataFrame:
    """docs (doc_id, text) -> doc_id, fp (the fingerprint's 64 bits as a long)."""

    @F.pandas_udf("long")
    def of(text: pd.Series) -> pd.Series:
        return pd.Series(np.array([fingerprint(t, words) for t in text], dtype=np.uint64).view(np.int64))

    return docs.select("doc_id", of("text").alias("fp"))


def ball(radius: int, width: int = BITS) -> np.ndarray:
    """All masks of at most radius of width bits."""
    masks = {0}
    for _ in range(radius):
        masks |= {m | (1 << b) for m in masks for b in range(width)}
    return np.array(sorted(masks), dtype=np.uint64)


def _codes(slice_bits: int, sub_bits: int) -> np.ndarray:
    """The linear hash's code of each bit of a fingerprint: its group in the low bits, above it a fixed pseudo-random number."""
    x, out = 0x9E3779B97F4A7C15, []
    for k in range(BITS):
        x = (x + 0x9E3779B97F4A7C15) & (2**64 - 1)
        z = ((x ^ (x >> 30)) * 0xBF58476D1CE4E5B9) & (2**64 - 1)
        z = ((z ^ (z >> 27)) * 0x94D049BB133111EB) & (2**64 - 1)
        out.append(((z ^ (z >> 31)) & ((1 << sub_bits) - 1)) << slice_bits | (1 << k % slice_bits if slice_bits else 0))
    return np.array(out, dtype=np.int64)


@lru_cache(maxsize=64)
def _tables(slice_bits: int, sub_bits: int) -> np.ndarray:
    """What each value of each byte adds to the linear hash."""
    codes = _codes(slice_bits, sub_bits)
    tables = np.zeros((8, 256), np.int64)
    for byte in range(8):
        for v in range(256):
            for k in range(8):
                if v >> k & 1:
                    tables[byte, v] ^= codes[8 * byte + k]
    return tables


def syndrome(values: np.ndarray, slice_bits: int, sub_bits: int = 0) -> np.ndarray:
    tables = _tables(slice_bits, sub_bits)
    parts = np.ascontiguousarray(values, dtype="<u8").view(np.uint8).reshape(-1, 8)
    out = tables[0][parts[:, 0]]
    for byte in range(1, 8):
        out = out ^ tables[byte][parts[:, byte]]
    return out


def slices(n: int, size: int, radius: int, least: int) -> int:
    """k, from least on, so that each of 2^k slices gets SLICE_BYTES of n rows of so many bytes at most."""
    k = least
    while n * size * copies(k, radius) > SLICE_BYTES << k and k < 24:
        k += 1
    return k


def copies(k: int, radius: int) -> int:
    """How often a row is sent to 2^k slices at most."""
    return sum(math.comb(k, r) for r in range(min(radius, k) + 1))


def dealing(n: int, size: int, radius: int, width: int, least: int, parts: int) -> tuple[int, int]:
    """Into how many parts the bits of a table are cut (1: they aren't), and k of the slices: whichever sends a row less often."""
    whole = slices(n, size, radius, least)
    if parts <= 2 * radius:
        return 1, whole
    within = slices(n >> width // parts, size, radius, 0)
    return (parts, within) if parts * copies(within, radius) < copies(whole, radius) else (1, whole)


def part_of(part: int, parts: int, width: int) -> tuple[int, int]:
    """The first bit and the number of bits of a part."""
    lo = part * width // parts
    return lo, (part + 1) * width // parts - lo


def popcount(x: np.ndarray) -> np.ndarray:
    return np.bitwise_count(x)


def forest(a: np.ndarray, b: np.ndarray) -> tuple[list[tuple[int, int]], dict[int, int]]:
    """A spanning forest of the links a-b, and the root of each of its nodes."""
    parent: dict[int, int] = {}

    def root(x: int) -> int:
        while parent.setdefault(x, x) != x:
            parent[x] = parent[parent[x]]
            x = parent[x]
        return x

    out = []
    for x, y in zip(a.tolist(), b.tolist(), strict=True):
        p, q = root(x), root(y)
        if p != q:
            parent[max(p, q)] = min(p, q)
            out.append((x, y))
    return out, {x: root(x) for x in parent}


def _shuffled(v: np.ndarray, i: np.ndarray) -> np.ndarray:
    """A pseudo-random key of each row, in one of four orders that the variant chooses."""
    z = (i.astype(np.uint64) << np.uint64(2) | v & np.uint64(3)) * np.uint64(0xBF58476D1CE4E5B9)
    return (z ^ z >> np.uint64(29)) * np.uint64(0x94D049BB133111EB)


def slice_links(keys: np.ndarray, where: int, slice_bits: int, radius: int, width: int, distance, sure: int, most: int, masks: np.ndarray | None = None) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Links (two indices, and whether they are sure) between rows that share a variant of this slice.

    distance(i, j): of pairs of indices. Of the rows that share a variant, those at most `most` from the first are
    linked to it; the others are gone through again, until none is left. Links of at most `sure` are sure: of these, a
    spanning forest is returned. The others may fail later, so such a row is linked to the one before it too, and which
    row is first depends on the variant (rows within 2 * radius share several); of them, those that the forest doesn't
    connect already are returned.
    """
    masks = ball(radius, width) if masks is None else masks  # others: the variants that a slice has of each row
    sub_bits = max(0, math.ceil(math.log2(max(1.0, len(keys) * len(masks) / (SUB_ROWS << slice_bits)))))
    codes, own = syndrome(masks, slice_bits, sub_bits), syndrome(keys, slice_bits, sub_bits)
    by_code = np.argsort(own, kind="stable")
    own = own[by_code]
    links: list[np.ndarray] = []  # of index, index, sure
    size = 0

    def link(i: np.ndarray, j: np.ndarray, d: np.ndarray) -> None:
        nonlocal links, size
        code = (np.minimum(i, j) * np.int64(len(keys)) + np.maximum(i, j)) << 1 | (d > sure)
        links.append(code)
        size += len(code)
        if size > 4 * SUB_ROWS:
            links = [np.unique(np.concatenate(links))]
            size = len(links[0])

    for sub in range(1 << sub_bits):
        want = codes ^ (sub << slice_bits | where)
        lo, hi = np.searchsorted(own, want, "left"), np.searchsorted(own, want, "right")
        count = hi - lo
        n = int(count.sum())
        if not n:
            continue
        which = by_code[np.arange(n) + np.repeat(lo - (np.cumsum(count) - count), count)]
        variants = keys[which] ^ np.repeat(masks, count)
        ordered = np.sort(variants)
        met = np.unique(ordered[1:][ordered[1:] == ordered[:-1]])
        if not len(met):
            continue
        at = np.minimum(np.searchsorted(met, variants), len(met) - 1)
        hit = np.flatnonzero(met[at] == variants)
        v, i = variants[hit], which[hit]
        order = np.lexsort((_shuffled(v, i) if sure < most else i, v))
        v, i = v[order], i[order]
        while len(v):
            first = np.concatenate(([True], v[1:] != v[:-1]))
            head = i[first][np.cumsum(first) - 1]
            d = distance(head, i)
            near = ~first & (d <= most)
            link(head[near], i[near], d[near])
            if sure < most:
                unsure = np.flatnonzero(near & (d > sure))
                before = distance(i[unsure - 1], i[unsure])
                fits = before <= most
                link(i[unsure - 1][fits], i[unsure][fits], before[fits])
            v, i = v[~first & ~near], i[~first & ~near]
    if not links:
        return np.empty(0, np.int64), np.empty(0, np.int64), np.empty(0, bool)
    found = np.unique(np.concatenate(links))
    is_sure, pairs = (found & 1) == 0, found >> 1
    a, b = pairs // len(keys), pairs % len(keys)
    kept, roots = forest(a[is_sure], b[is_sure])
    root = np.arange(len(keys))
    if roots:
        root[np.fromiter(roots.keys(), np.int64)] = np.fromiter(roots.values(), np.int64)
    a, b = a[~is_sure], b[~is_sure]
    apart = root[a] != root[b]
    a, b = a[apart], b[apart]
    return (
        np.concatenate([np.array([x for x, _ in kept], np.int64), a]), np.concatenate([np.array([y for _, y in kept], np.int64), b]),
        np.concatenate([np.ones(len(kept), bool), np.zeros(len(a), bool)]),
    )


def table_keys(wide: np.ndarray, table: int, width: int) -> np.ndarray:
    """The table's own bits of fingerprints of several 64-bit words."""
    word, shift = divmod(table * width, 64)
    out = wide[:, word] >> np.uint64(shift)
    if shift + width > 64:
        out = out | wide[:, word + 1] << np.uint64(64 - shift)
    return out & np.uint64((1 << width) - 1) if width < 64 else out


def ball_links(distinct: DataFrame, radius: int = 2, width: int = BITS, tables: int = 1, slice_bits: int = 6, sure: int = 4, most: int = 4, parts: int = 1) -> DataFrame:
    """distinct (node, wide) -> a, b, sure: links that connect all nodes of which a table's bits differ in at most 2 * radius places.

    wide: the bits of all tables, as little-endian 64-bit words. most: the greatest distance over all bits of a link;
    sure: the greatest of one that needs no further verification. There are 2^slice_bits slices of each table at least.

    The slices of a whole table get a row 1 + k + k (k - 1) / 2 times, and k follows the number of rows. parts: beyond, a table's bits may be cut into so many
    parts, more than 2 * radius. Two rows that differ in at most 2 * radius bits then have one part whole in common, so each row is sent once for each part,
    to those with the same bits there, and its variants differ in the other parts' bits alone: more variants in all, but a fixed number of copies.
    """
    words = -(-tables * width // 64)
    row = np.dtype([("node", "<i8"), ("wide", "<u8", (words,))])
    parts, slice_bits = dealing(distinct.count(), row.itemsize, radius, width, slice_bits, parts)
    bits = max(part_of(p, parts, width)[1] for p in range(parts)) if parts > 1 else 0
    masks = [ball(radius, width)]
    if parts > 1:
        fixed = [np.uint64((1 << n) - 1) << np.uint64(lo) for lo, n in (part_of(p, parts, width) for p in range(parts))]
        masks = [masks[0][masks[0] & x == 0] for x in fixed]

    def deal(batches):
        offsets = [np.unique(syndrome(m, slice_bits)) for m in masks]
        for pdf in batches:
            rows = np.empty(len(pdf), row)
            rows["node"] = pdf["node"].to_numpy(np.int64)
            rows["wide"] = np.frombuffer(b"".join(pdf["wide"]), "<u8").reshape(-1, words)
            for t in range(tables):
                if parts == 1 and len(offsets[0]) == 1 << slice_bits:  # every slice gets every fingerprint
                    blob = rows.tobytes()
                    yield pd.DataFrame({"slice": (t << slice_bits) + np.arange(1 << slice_bits), "rows": [blob] * (1 << slice_bits)})
                    continue
                keys = table_keys(rows["wide"], t, width)
                own = syndrome(keys, slice_bits)
                for p in range(parts):
                    value = np.zeros(len(rows), np.int64)
                    if parts > 1:
                        lo, n = part_of(p, parts, width)
                        value = (keys >> np.uint64(lo) & np.uint64((1 << n) - 1)).astype(np.int64)
                    base = ((t * parts + p) << bits | value) << slice_bits
                    for lo in range(0, len(rows), 4096):
                        to = (base[lo : lo + 4096, None] | own[lo : lo + 4096, None] ^ offsets[p]).ravel()
                        what = np.repeat(np.arange(lo, min(lo + 4096, len(rows))), len(offsets[p]))
                        order = np.argsort(to, kind="stable")
                        to, what = to[order], what[order]
                        edge = np.flatnonzero(np.concatenate(([True], to[1:] != to[:-1])))
                        yield pd.DataFrame({"slice": to[edge], "rows": [rows[x].tobytes() for x in np.split(what, edge[1:])]})

    def meet(key, pdf):
        rows = np.frombuffer(b"".join(pdf["rows"]), row)
        rows = rows[np.argsort(rows["node"], kind="stable")]
        wide = rows["wide"]
        where = int(key[0]) & ((1 << slice_bits) - 1)
        table, part = divmod(int(key[0]) >> slice_bits + bits, parts)

        def distance(i, j):
            return popcount(wide[i] ^ wide[j]).sum(axis=1, dtype=np.int64)

        i, j, is_sure = slice_links(table_keys(wide, table, width), where, slice_bits, radius, width, distance, sure, most, masks[part])
        out = pd.DataFrame({"a": rows["node"][i], "b": rows["node"][j], "sure": is_sure})
        release()
        return out

    return distinct.select("node", "wide").mapInPandas(deal, "slice long, rows binary").groupBy("slice").applyInPandas(meet, "a long, b long, sure boolean").distinct()


def components(links: DataFrame) -> DataFrame:
    """links (a, b) -> node, root (the smallest node that is reachable), for all nodes that have a link.

    Alternates the large-star and small-star steps until the links no longer change: O(log^2 n) rounds of
    group-bys and joins; each round's links are written to the shared folder.
    """
    edges = staged(links.select(F.greatest("a", "b").alias("u"), F.least("a", "b").alias("v")).where("u <> v").distinct(), "links")
    state = None
    while True:
        both = edges.unionByName(edges.select(F.col("v").alias("u"), F.col("u").alias("v")))
        least = both.groupBy("u").agg(F.least(F.min("v"), F.col("u")).alias("m"))
        large = both.join(least, "u").where("v > u and v <> m").select(F.col("v").alias("u"), F.col("m").alias("v")).distinct()
        # every node also keeps its link to the smallest neighbour
        large = staged(large, "large-star")
        least = large.groupBy("u").agg(F.min("v").alias("m"))
        joined = large.join(least, "u")
        small = joined.where("v <> m").select(F.col("v").alias("u"), F.col("m").alias("v")).unionByName(least.select("u", F.col("m").alias("v")))
        edges = staged(small.where("u <> v").distinct(), "small-star")
        now = tuple(edges.agg(F.count("*"), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)"))).first())
        if now == state:
            break
        state = now
    return edges.groupBy("u").agg(F.min("v").alias("root")).select(F.col("u").alias("node"), "root")


def _labelled(rows: DataFrame, links) -> DataFrame:
    """rows (node, ...) with component_id, the smallest doc_id of the node's component. links(firsts) -> a, b."""
    firsts = staged(rows.groupBy("node").agg(F.min("doc_id").alias("first_id"), F.first("wide").alias("wide")), "distinct-fingerprints")
    if firsts.limit(2).count() < 2:
        return rows.join(firsts.select("node", F.col("first_id").alias("component_id")), "node")
    roots = staged(components(links(firsts)), "roots")
    nodes = roots.unionByName(roots.select(F.col("root").alias("node"), "root").distinct())
    linked = firsts.join(nodes, "node").select("node", "first_id", "root")
    least = linked.groupBy("root").agg(F.min("first_id").alias("component_id"))
    by_node = firsts.select("node", "first_id").join(linked.select("node", "root"), "node", "left").join(least, "root", "left")
    return rows.join(by_node.select("node", F.coalesce("component_id", "first_id").alias("component_id")), "node")


def near_duplicates(docs: DataFrame, words: int = 5, radius: int = 2) -> DataFrame:
    """docs (doc_id, text) -> doc_id, fp, component_id: the smallest doc_id reachable by links of at most 2 * radius bits.

    A null or empty text, or one of white space, has the fingerprint 0 and is linked like any other. Rows that
    repeat are all returned. A null doc_id gets the component of its fingerprint (null if it has no other).
    """
    rows = staged(fingerprints(docs, words), "fingerprints").withColumn("node", F.col("fp")).withColumn("wide", little_endian(F.col("fp")))
    return _labelled(rows, lambda firsts: ball_links(firsts, radius, sure=2 * radius, most=2 * radius)).select("doc_id", "fp", "component_id")


def little_endian(x: Column) -> Column:
    """The 8 bytes of a long, lowest first."""
    digits = F.lpad(F.hex(x), 16, "0")
    return F.unhex(F.concat(*[F.substring(digits, k, 2) for k in range(15, 0, -2)]))


#: Of the near-copy operator: fingerprints of TABLES times WIDTH bits. At a Jaccard similarity of 0.8 a table's 36 bits differ
#: in at most 4 with a chance of 0.36, so one of ten tables does with 0.99; unrelated texts do so in 1 of 100,000 pairs.
TABLES, WIDTH = 10, 36
#: Parts of a table's bits for many rows: one more than the bits in which two rows of a link may differ.
PARTS = 5
#: Distances over all 360 bits: 54.6 (deviation 6.8) are expected at a similarity of 0.8, and 62 at 0.75. Links of SURE_BITS or
#: fewer hold without a look at the texts; those of up to MOST_BITS are verified by their shingles.
SURE_BITS, MOST_BITS = 36, 78
SIMILARITY = 0.8


def wide_fingerprint(text: str | None, words: int = 5) -> bytes:
    """SimHash of TABLES * WIDTH bits (up to the next 64) over the different shingles of so many words; zeros without words."""
    tokens = (text or "").lower().split()
    size = -(-TABLES * WIDTH // 64)
    if not tokens:
        return bytes(8 * size)
    line = " ".join(tokens).encode("utf-8", "surrogatepass")
    digest = xxhash.xxh64_intdigest
    n = max(1, len(tokens) - words + 1)
    ends = np.cumsum(np.fromiter((len(t.encode("utf-8", "surrogatepass")) for t in tokens), np.int64, len(tokens)) + 1) - 1
    starts = np.concatenate(([0], ends[:-1] + 1))[:n].tolist()
    ends = ends[min(words, len(tokens)) - 1 :].tolist()
    hashed = np.unique(np.fromiter((digest(line[i:j], 42) for i, j in zip(starts, ends)), "<u8", n))
    ones = np.zeros(64 * size, np.int64)
    for lo in range(0, len(hashed), 16384):
        h = hashed[lo : lo + 16384]
        z = h[:, None] + np.arange(1, size + 1, dtype=np.uint64) * np.uint64(0x9E3779B97F4A7C15)
        z = (z ^ (z >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
        z = (z ^ (z >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
        z ^= z >> np.uint64(31)
        ones += np.add.reduce(np.unpackbits(z.view(np.uint8).reshape(len(h), -1), axis=1, bitorder="little"), axis=0, dtype=np.int32)
    ones[TABLES * WIDTH :] = 0
    return np.packbits(2 * ones > len(hashed), bitorder="little").tobytes()


def shingles(text: Column, words: int) -> Column:
    """The different shingles of so many words, as hashes; the whole sequence where there are fewer words."""
    h = F.transform(F.filter(F.split(F.lower(F.coalesce(text, F.lit(""))), r"\s+"), lambda w: w != ""), lambda w: F.xxhash64(w))
    at = lambda h: F.transform(F.sequence(F.lit(1), F.greatest(F.size(h) - (words - 1), F.lit(1))), lambda i: F.xxhash64(F.slice(h, i, words)))
    return F.array_distinct(F.flatten(F.transform(F.array(h), at)))  # the words are hashed once


def _keyed(docs: DataFrame, id_: str = "_id", th: str = "_th") -> DataFrame:
    """docs with the key of a text: a null doc_id counts as the last one."""
    return docs.withColumns({id_: F.coalesce("doc_id", F.lit(LAST)), th: F.xxhash64("text")})


def similar(pairs: DataFrame, rows: DataFrame, docs: DataFrame, words: int) -> DataFrame:
    """Those of pairs (a, b: nodes) whose texts' shingles have a Jaccard similarity of SIMILARITY or more.

    rows (doc_id, th, node). Only the shingles of texts that are in a pair are gathered.
    """
    nodes = pairs.select(F.explode(F.array("a", "b")).alias("node")).distinct()
    one = rows.join(nodes, "node", "left_semi").groupBy("node").agg(F.min(F.struct(F.coalesce("doc_id", F.lit(LAST)).alias("_id"), F.col("th").alias("_th"))).alias("key"))
    one = staged(one.select("node", "key.*"), "verified-nodes")
    found = _keyed(docs.select("doc_id", "text")).join(F.broadcast(one) if one.count() <= GONE_ROWS else one, ["_id", "_th"])
    sets = staged(found.select("node", shingles(F.col("text"), words).alias("s")).dropDuplicates(["node"]), "shingles")
    both = pairs.join(sets.select(F.col("node").alias("a"), F.col("s").alias("sa")), "a").join(sets.select(F.col("node").alias("b"), F.col("s").alias("sb")), "b")
    common = F.size(F.array_intersect("sa", "sb"))
    return both.where(common >= SIMILARITY * (F.size("sa") + F.size("sb") - common)).select("a", "b")


def near_copies(docs: DataFrame, words: int = 5) -> DataFrame:
    """docs (doc_id, text) -> doc_id, th (hash of the text), component_id: near copies at a similarity of 0.8 or more.

    Fingerprints of TABLES tables are hashed by balls of radius 2; colliding ones are compared over all their bits, and by
    their shingles where the bits don't settle it.
    """

    bounded(docs.sparkSession)

    @F.pandas_udf("binary")
    def of(text: pd.Series) -> pd.Series:
        out = pd.Series([wide_fingerprint(t, words) for t in text])
        release()
        return out

    rows = staged(docs.select("doc_id", F.xxhash64("text").alias("th"), of("text").alias("wide")), "wide-fingerprints").withColumn("node", F.xxhash64("wide"))

    def links(firsts: DataFrame) -> DataFrame:
        found = staged(ball_links(firsts, 2, WIDTH, TABLES, slice_bits=2, sure=SURE_BITS, most=MOST_BITS, parts=PARTS), "candidate-links")
        certain = found.where("sure").select("a", "b")
        roots = staged(components(certain), "sure-roots")
        root = lambda x: roots.select(F.col("node").alias(x), F.col("root").alias(f"root_{x}"))
        unsure = found.where("not sure").join(root("a"), "a", "left").join(root("b"), "b", "left")
        apart = unsure.where(F.coalesce("root_a", "a") != F.coalesce("root_b", "b")).select("a", "b")  # the others are in one component already
        return certain.unionByName(similar(staged(apart, "unsure-links"), rows, docs, words))

    return _labelled(rows, links).select("doc_id", "th", "component_id")


def without_near_copies(docs: DataFrame) -> DataFrame:
    """docs with one row of each component of near copies: that of the smallest doc_id; same columns, whatever their names.

    Of rows with equal doc_id, that of the least text hash stays, once; rows with a null doc_id count as the last ones. Null
    texts and texts without words are copies of one another. An empty table gives no rows.
    """
    id_, th = fresh(docs, "_id", "_th")
    rows = staged(near_copies(docs), "near-copies").select(F.coalesce("doc_id", F.lit(LAST)).alias(id_), F.col("th").alias(th), F.coalesce("component_id", F.lit(LAST)).alias("c"))
    best = rows.groupBy("c").agg(F.min(F.struct(id_, th)).alias("best"))
    once = rows.groupBy(id_, th, "c").agg(F.count("*").alias("n"))
    repeated = bool(once.where("n > 1").limit(1).count())
    gone = staged(once.join(best, "c").where((F.col(id_) != F.col("best")[id_]) | (F.col(th) != F.col("best")[th])).select(id_, th), "copies")
    if gone.count() <= GONE_ROWS:
        gone = F.broadcast(gone)
    kept = _keyed(docs, id_, th).join(gone, [id_, th], "left_anti")
    return (kept.dropDuplicates([id_, th]) if repeated else kept).select(*docs.columns)


def op2_simhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Fingerprints of 4-word shingles of all documents, linked at 4 or fewer differing bits."""
    out = near_duplicates(documents(spark, sf_dir).select("doc_id", "text"), words=4, radius=2)
    return out.select("doc_id", F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint"), "component_id")
