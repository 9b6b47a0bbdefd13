"""Line dedup by a deletion-neighbourhood join, with DataFrame functions only.

A line goes if an earlier line of the corpus (by doc_id, then place) is the same or one word away: a word
more, a word less or another word. Such lines have a variant in common: each line emits itself and all forms with
one word deleted, as hashed keys. Lines that lose the word at the same place, and a line that another becomes by
losing one, are within the bound; so the earliest of each such set is enough, and no pairs are formed.

What is shuffled: first, lines are counted by the 128-bit key of their lower case without the white space around it. Then each
different line emits four keys of its halves (an edit leaves one half untouched, whichever way the lengths go); only lines that
share a half with another line emit their variants. The nearest earlier line that this finds is verified word by word. Positions
to drop are joined back to the documents. Small sides are broadcast only after a count, and joined by shuffle beyond it.

The edit bound is one word, but none for a line of fewer than MIN_WORDS words (lower-cased runs between white space), of which one edit leaves
less than 0.8: it goes only if an earlier one has the same key. Blank lines take no part. Exact copies and near copies are judged against every earlier
line, kept or not.

Defined results: documents with a null text or null doc_id stay as they are and take no part; of rows with equal doc_id and
text, lines at the same place are equally early, so both stay; a document of which only blank lines are left, and which had
another, goes; an empty table gives no rows; other columns stay, whatever their names, and n_chars, where there is one, follows
the text.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession, Window, functions as F

from scryline.llm.common import documents, fresh, staged

#: One edit in fewer words leaves less than 0.8 of a line, the likeness from which on copies are near here.
MIN_WORDS = 5
#: Lines of so many words and more have their variants by running sums over CHUNK words and over chunks; those of up to one more by hashing what is left. Around the bound lines have
#: both, so neighbours share a way.
LONG, CHUNK = 256, 256
#: Rows (of a few dozen bytes) up to which a side is broadcast.
BROADCAST_ROWS = 500_000
SPACE = r"[\x20\x09-\x0D]+"
BLANK = " \t\n\v\f\r"


def _words(line: Column) -> Column:
    low = F.lower(line)  # a single space is no pattern, and cuts in a third of the time
    return F.array_remove(F.when(line.rlike(r"[\x09-\x0D]"), F.split(low, SPACE)).otherwise(F.split(low, " ")), "")


def _trimmed(line: Column) -> Column:
    """The line without the white space around it. Trimming a set of characters walks through the whole line, so it is left to the lines that need it."""
    inner = F.trim(line)
    others = [f(c) for c in BLANK[1:] for f in (inner.startswith, inner.endswith)]
    return F.when(reduce(Column.__or__, others), F.trim(line, F.lit(BLANK))).otherwise(inner)


def _keys(line: Column) -> list[Column]:
    form = F.lower(_trimmed(line))
    return [F.xxhash64(form).alias("k1"), F.xxhash64(F.lit(1), form).alias("k2")]


def _lines(docs: DataFrame, bits: int) -> DataFrame:
    """doc_id, th (hash of the text), pos, ord (an order key of doc_id and pos), line."""
    texts = docs.where("doc_id is not null and text is not null").select("doc_id", F.xxhash64("text").alias("th"), F.split("text", "\n", -1).alias("ls"))  # before each line gets a row
    rows = texts.select("doc_id", "th", F.posexplode_outer("ls").alias("pos", "line"))  # no text is without lines; for the inner form Spark cuts texts once more, to test that
    if bits:
        order = F.shiftleft(F.col("doc_id").cast("long"), bits).bitwiseOR(F.col("pos").cast("long"))
    else:
        order = F.col("doc_id").cast("decimal(20,0)") * F.lit(1 << 31).cast("decimal(11,0)") + F.col("pos").cast("decimal(10,0)")
    return rows.select("doc_id", "th", "pos", order.alias("ord"), "line")


def _order_bits(docs: DataFrame) -> int:
    """How many bits of a long the place needs beside doc_id; 0 if both don't fit."""
    low, high, most = docs.where("text is not null").agg(F.min("doc_id"), F.max("doc_id"), F.max(F.octet_length("text") - F.octet_length(F.replace("text", F.lit("\n"), F.lit(""))))).first()
    bits = max(1, int(most or 0).bit_length())
    return bits if low is None or (low >= 0 and int(high).bit_length() + bits <= 62) else 0


def _joined(big: DataFrame, small: DataFrame, on: list[str], how: str = "inner") -> DataFrame:
    """big join small; small is broadcast if it has been counted to be so."""
    return big.join(F.broadcast(small) if small.count() <= BROADCAST_ROWS else small, on, how)


def thresholds(docs: DataFrame, bits: int) -> DataFrame:
    """k1, k2, t: of each line that recurs or has an earlier neighbour, the order key of the earliest such line."""
    h = F.transform("ws", lambda w: F.xxhash64(w))
    lines = _lines(docs, bits)
    rows = lines.where(_trimmed(F.col("line")) != "").select("ord", *_keys(F.col("line")), _words(F.col("line")).alias("ws")).withColumn("h", h)
    n = F.size("h")

    def half(kind: int, m: Column) -> Column:
        left = F.floor(m / 2).cast("int")
        words = F.slice("h", F.lit(1), left) if kind == 0 else F.slice("h", n - (m - left) + 1, m - left)
        return F.when(n >= MIN_WORDS, F.xxhash64(F.lit(kind), m, words))

    halves = {f"half{2 * s + k}": half(k, n - s) for s in (0, 1) for k in (0, 1)}
    rows = rows.select("k1", "k2", "ord", *[c.alias(name) for name, c in halves.items()])
    distinct = staged(rows.groupBy("k1", "k2").agg(F.min("ord").alias("first"), F.count("*").alias("n"), *[F.min(x).alias(x) for x in halves]), "lines")

    by_half = distinct.where("half0 is not null").select("k1", "k2", "first", F.explode(F.array(*halves)).alias("half"))
    crowded = by_half.groupBy("half").agg(F.min("k1").alias("a"), F.max("k1").alias("b")).where("a <> b").select("half")
    chosen = staged(by_half.join(crowded, "half", "left_semi").select("k1", "k2", "first").distinct(), "candidates")

    at = _joined(lines.select(F.col("ord").alias("first"), "line"), chosen.select("first"), ["first"], "left_semi")  # only these lines get keys
    found = _joined(at.select("first", *_keys(F.col("line")), "line"), chosen, ["k1", "k2", "first"])
    found = found.select("k1", "k2", "first", F.transform(_words(F.col("line")), lambda w: F.xxhash64(w)).alias("h"))
    words = staged(found.dropDuplicates(["k1", "k2"]), "candidate-words")

    # place n: nothing deleted. The hash of two arrays in turn is that of the two put together.
    forms = F.transform(F.sequence(F.lit(0), n), lambda i: F.struct(F.when(i == n, F.lit(-1)).otherwise(i).alias("at"), F.xxhash64(F.slice("h", F.lit(1), i), F.slice("h", i + 2, n)).alias("v")))
    none = F.array().cast("array<struct<at:int,v:bigint>>")
    short, long = F.when(n <= LONG + 1, forms).otherwise(none), F.when(n >= LONG, _long_forms(F.col("h"))).otherwise(none)
    variants = words.select("k1", "k2", "first", F.inline(F.concat(short, long)))
    by_variant = Window.partitionBy("v")  # a row for each place: no more than a line has words
    at_place = variants.groupBy("v", "at").agg(F.min("first").alias("m"), F.max("first").alias("x")).select(
        "v", "at", "m", F.min("m").over(by_variant).alias("all_m"), F.max("x").over(by_variant).alias("all_x"), F.min(F.when(F.col("at") == -1, F.col("m"))).over(by_variant).alias("whole_m")
    )
    shared = staged(at_place.where("all_m < all_x").select("v", "at", F.when(F.col("at") == -1, F.col("all_m")).otherwise(F.least("m", "whole_m")).alias("near")), "shared-variants")
    nearest = _joined(variants, shared, ["v", "at"]).where("near < first").groupBy("k1", "k2", "first").agg(F.min("near").alias("near"))
    nearest = staged(nearest, "nearest")
    other = words.select(F.col("first").alias("near"), F.col("h").alias("g"))
    pairs = nearest.join(words.select("k1", "k2", "h"), ["k1", "k2"]).join(other, "near")
    near = pairs.where(edit_distance_at_most_one("h", "g")).groupBy("k1", "k2").agg(F.min("near").alias("near"))
    recurring = distinct.where("n > 1").select("k1", "k2", F.col("first").alias("near"))
    return staged(recurring.unionByName(near).groupBy("k1", "k2").agg(F.min("near").alias("t")), "thresholds")


def _long_forms(h: Column) -> Column:
    """at, v of each form of a long line, in about as many steps as it has words times CHUNK.

    A form is hashed to the exclusive or of its words' hashes with their places, so that of a line without one word is what stands before
    the word, as it is, and what stands after it, one place earlier. Both are summed over chunks of words first, then within the word's chunk.
    """
    xor = lambda xs: F.aggregate(xs, F.lit(0).cast("long"), lambda s, x: s.bitwiseXOR(x))
    chunk = lambda xs, c: F.slice(xs, c * CHUNK + 1, CHUNK)
    chunks = F.sequence(F.lit(0), F.floor((F.size(h) - 1) / CHUNK).cast("int"))
    bound = lambda x, f: F.get(F.transform(F.array(x), f), 0)  # noqa: E731  what f makes of x, which is computed once

    def running(xs: Column) -> Column:
        """What stands before each chunk, and at the end the whole."""
        tops = F.transform(chunks, lambda c: xor(chunk(xs, c)))
        return F.aggregate(tops, F.array(F.lit(0).cast("long")), lambda held, t: F.concat(held, F.array(F.element_at(held, -1).bitwiseXOR(t))))

    def spelt(x: Column) -> Column:
        def of_chunk(c: Column) -> Column:
            def of_word(p: Column, i: Column) -> Column:
                before = F.get(x["before"], c).bitwiseXOR(xor(F.slice(p["here"], 1, i)))
                upto = F.get(x["upto"], c).bitwiseXOR(xor(F.slice(p["earlier"], 1, i + 1)))
                return F.struct((c * CHUNK + i).cast("int").alias("at"), F.xxhash64(F.lit("long"), before.bitwiseXOR(F.element_at(x["upto"], -1).bitwiseXOR(upto))).alias("v"))

            parts = F.struct(chunk(x["here"], c).alias("here"), chunk(x["earlier"], c).alias("earlier"))
            return bound(parts, lambda p: F.transform(F.sequence(F.lit(0), F.size(p["here"]) - 1), lambda i: of_word(p, i)))

        whole = F.struct(F.lit(-1).alias("at"), F.xxhash64(F.lit("long"), F.element_at(x["before"], -1)).alias("v"))
        return F.concat(F.flatten(F.transform(chunks, of_chunk)), F.array(whole))

    hashed = lambda shift: F.transform(h, lambda w, i: F.xxhash64(w, i - shift))
    both = F.struct(hashed(0).alias("here"), hashed(1).alias("earlier"))
    summed = bound(both, lambda x: F.struct(x["here"].alias("here"), x["earlier"].alias("earlier"), running(x["here"]).alias("before"), running(x["earlier"]).alias("upto")))
    return bound(summed, spelt)


def edit_distance_at_most_one(a: str, b: str) -> Column:
    """Of arrays of word hashes: what they have in common at the two ends leaves at most one word of either."""

    def common(x: Column, y: Column) -> Column:
        k = F.least(F.size(a), F.size(b))
        differs = F.array_position(F.zip_with(F.slice(x, F.lit(1), k), F.slice(y, F.lit(1), k), lambda p, q: p != q), True)
        return F.when(differs == 0, k).otherwise(differs - 1)

    ends = common(F.col(a), F.col(b)) + common(F.reverse(a), F.reverse(b))
    return (F.abs(F.size(a) - F.size(b)) <= 1) & (ends >= F.greatest(F.size(a), F.size(b)) - 1)


def drops(docs: DataFrame) -> DataFrame:
    """doc_id, th, places: the places of the lines that go, for each document that has any."""
    bits = _order_bits(docs)
    limits = thresholds(docs, bits)
    rows = _joined(_lines(docs, bits).select("doc_id", "th", "pos", "ord", *_keys(F.col("line"))), limits, ["k1", "k2"]).where("ord > t")
    return staged(rows.groupBy("doc_id", "th").agg(F.collect_set("pos").alias("places")), "line-drops")


def with_drops(docs: DataFrame) -> tuple[DataFrame, str, str]:
    """docs with two more columns, and their names: the places of the lines that go (null where none do), the text of what stays."""
    gone, kept, id_, th = fresh(docs, "_places", "_kept", "_id", "_th")
    places = drops(docs).select(F.col("doc_id").alias(id_), F.col("th").alias(th), F.col("places").alias(gone))
    small = places.agg(F.count("*"), F.sum(F.size(gone))).first()
    if small[0] <= BROADCAST_ROWS and (small[1] or 0) <= 8 * BROADCAST_ROWS:
        places = F.broadcast(places)
    marked = docs.join(places, (docs["doc_id"] == F.col(id_)) & (F.xxhash64(docs["text"]) == F.col(th)), "left").drop(id_, th)
    # the lines are bound first, so the text is cut once
    staying = lambda ls: F.transform(F.array_except(F.sequence(F.lit(0), F.size(ls) - 1), F.col(gone)), lambda i: F.get(ls, i))
    stay = F.get(F.transform(F.array(F.split("text", "\n", -1)), staying), 0)
    return marked.withColumn(kept, F.when(F.col(gone).isNull(), F.col("text")).otherwise(F.array_join(stay, "\n"))), gone, kept


def deduplicated(docs: DataFrame) -> DataFrame:
    """docs (doc_id, text, ...) without the lines that go, and without documents of which nothing is left; same columns."""
    out, gone, kept = with_drops(docs)
    whole = F.col(gone).isNull()
    columns = [F.col(kept).alias(c) if c == "text" else F.when(whole, F.col(c)).otherwise(F.length(kept)).cast(docs.schema[c].dataType).alias(c) if c == "n_chars" else F.col(c) for c in docs.columns]
    return out.where(whole | F.col(kept).rlike(r"[^\x20\x09-\x0D]")).select(*columns)


def op9_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Of every document: its lines, how many go, whether it goes, and the md5 of the text that stays."""
    out, gone, kept = with_drops(documents(spark, sf_dir).select("doc_id", "text"))
    dropped = F.when(F.col(gone).isNull(), F.lit(0)).otherwise(F.size(gone))
    return out.select(
        "doc_id", F.coalesce(F.size(F.split("text", "\n", -1)), F.lit(0)).cast("long").alias("n_lines"), dropped.cast("long").alias("n_dropped"),
        ((dropped > 0) & ~F.col(kept).rlike(r"[^\x20\x09-\x0D]")).alias("gone"), F.md5(kept).alias("kept_md5"),
    )


OP9_SQL = r"""
WITH d AS (SELECT doc_id, text, string_split(text, chr(10)) AS ls FROM documents),
l AS (SELECT doc_id, unnest(range(len(ls))) AS pos, unnest(ls) AS line FROM d),
w AS (SELECT doc_id, pos, line, list_filter(regexp_split_to_array(lower(line), '[\x20\x09-\x0D]+'), lambda x: x <> '') AS ws FROM l),
k AS (SELECT *, row_number() OVER (ORDER BY doc_id, pos) AS ord, CASE WHEN len(ws) < 5 THEN chr(10) || lower(trim(line, chr(32) || chr(9) || chr(11) || chr(12) || chr(13))) ELSE array_to_string(ws, ' ') END AS s FROM w WHERE len(ws) > 0),
u AS (SELECT s, any_value(ws) AS ws, min(ord) AS f FROM k GROUP BY s),
x AS (SELECT s, f, ws, unnest(CASE WHEN len(ws) < 5 THEN [len(ws)] ELSE range(len(ws) + 1) END) AS i FROM u),
v AS (SELECT s, f, i, i = len(ws) AS whole, CASE WHEN len(ws) < 5 THEN s ELSE array_to_string(list_concat(ws[1:i], ws[i + 2:]), ' ') END AS v FROM x),
m AS (SELECT s, whole, min(f) OVER (PARTITION BY v) AS of_all, min(f) OVER (PARTITION BY v, whole, i) AS of_same,
             min(CASE WHEN whole THEN f END) OVER (PARTITION BY v) AS of_whole FROM v),
t AS (SELECT s, min(CASE WHEN whole THEN of_all ELSE least(of_same, coalesce(of_whole, of_same)) END) AS t FROM m GROUP BY s),
g AS (SELECT k.doc_id, k.pos FROM k JOIN t USING (s) WHERE k.ord > t.t),
r AS (SELECT l.doc_id, count(g.pos) AS n_dropped, coalesce(string_agg(l.line, chr(10) ORDER BY l.pos) FILTER (WHERE g.pos IS NULL), '') AS kept
      FROM l LEFT JOIN g ON l.doc_id = g.doc_id AND l.pos = g.pos GROUP BY l.doc_id)
SELECT d.doc_id, CAST(coalesce(len(d.ls), 0) AS BIGINT) AS n_lines, CAST(coalesce(r.n_dropped, 0) AS BIGINT) AS n_dropped,
       coalesce(r.n_dropped > 0 AND NOT regexp_matches(r.kept, '[^\x20\x09-\x0D]'), FALSE) AS gone, md5(r.kept) AS kept_md5
FROM d LEFT JOIN r USING (doc_id)
"""
