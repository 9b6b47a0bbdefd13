"""Document fingerprints by one-permutation MinHash, with DataFrame functions only.

Each shingle of WORDS words is hashed once; the hash's high bits name its bin, and each bin keeps its least
value. An empty bin takes the value of the first non-empty one in its own pseudo-random sequence of bins (optimal
densification): PROBES bins drawn by hash, and after them all bins in the order of another hash, so one is always found. LOW bits of each value are stored; the likeness of two fingerprints is the share of equal bins,
corrected for those that are equal by chance.

A row's shingles never leave it: bins are found by sorting its hashes together with one sentinel for each bin.

Defined results: a null text is an empty one; a text of fewer than WORDS words is one shingle (so all texts
without words are alike); the next document of a null doc_id's row, which comes after all others, is the
next such row or else the first document; rows that repeat follow one another in the order of their texts' hashes;
of a single row, the next document is the row itself; an empty table gives no rows.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window, functions as F

from scryline.llm.common import documents, staged

WORDS, BIN_BITS, LOW = 5, 7, 8
BINS = 1 << BIN_BITS
#: Bits of a value: the hash without its sign and the bin's bits.
VALUE_BITS = 63 - BIN_BITS
NONE = (1 << VALUE_BITS) - 1
PROBES = 8
#: Rows of a bucket of neighbouring doc_ids.
BUCKET_ROWS = 1_000


def with_bins(df: DataFrame, text: str, out: str) -> DataFrame:
    """df with the column out: the low bits of the value of each bin, as array<tinyint>."""
    t = f"_{out}_"
    df = df.withColumn(t + "h", F.transform(F.filter(F.split(F.lower(F.col(text)), r"[\x20\x09-\x0D]+"), lambda w: w != ""), lambda w: F.xxhash64(w)))
    df = df.withColumn(t + "n", F.size(t + "h"))
    n, h = F.col(t + "n"), F.col(t + "h")
    pair = lambda a, b: F.xxhash64(a, b)
    span = lambda c, at, less: F.slice(c, at, F.greatest(n - less, F.lit(0)))
    df = df.withColumn(t + "2", F.zip_with(span(h, 1, 1), span(h, 2, 1), pair))
    two = F.col(t + "2")
    df = df.withColumn(t + "4", F.zip_with(span(two, 1, 3), span(two, 3, 3), pair))
    df = df.withColumn(t + "5", F.when(n >= WORDS, F.zip_with(span(F.col(t + "4"), 1, 4), span(h, 5, 4), pair)).otherwise(F.array(F.xxhash64(h))))
    sentinels = F.transform(F.sequence(F.lit(0), F.lit(BINS - 1)), lambda b: F.shiftleft(b.cast("long"), VALUE_BITS).bitwiseOR(F.lit(NONE)))
    df = df.withColumn(t + "s", F.sort_array(F.concat(F.transform(t + "5", lambda x: F.shiftrightunsigned(x, 1)), sentinels)))
    s = F.col(t + "s")
    least = F.filter(s, lambda x, i: (i == 0) | (F.shiftright(x, VALUE_BITS) != F.shiftright(F.get(s, i - 1), VALUE_BITS)))
    df = df.withColumn(t + "v", F.transform(least, lambda x: x.bitwiseAND(F.lit(NONE))))
    v = F.col(t + "v")
    places = F.array(*[F.lit(j) for j in range(BINS)])
    filled = F.filter(F.zip_with(v, places, lambda x, j: F.struct(x.alias("x"), j.alias("j"))), lambda e: e["x"] != NONE)
    df = df.withColumn(t + "k", F.when(F.array_contains(v, F.lit(NONE)), filled))
    first = lambda b: F.array_min(F.transform(t + "k", lambda e: F.struct(F.xxhash64(e["j"], b).alias("o"), e["x"].alias("x"))))["x"]
    drawn = lambda b: F.transform(F.sequence(F.lit(0), F.lit(PROBES - 1)), lambda k: F.get(v, F.pmod(F.xxhash64(b, k), F.lit(BINS)).cast("int")))
    probed = lambda b: F.get(F.filter(drawn(b), lambda x: x != NONE), F.lit(0))
    full = F.transform(v, lambda x, b: F.when(x != NONE, x).otherwise(F.coalesce(probed(b), first(b))))
    low = lambda c: F.transform(c, lambda x: (x.bitwiseAND(F.lit((1 << LOW) - 1)) - F.lit(1 << (LOW - 1))).cast("tinyint"))
    df = df.withColumn(t + "f", F.when(F.array_contains(v, F.lit(NONE)), full).otherwise(v)).withColumn(out, low(F.col(t + "f")))
    return df.drop(*[t + x for x in "hn245svkf"])


def packed(bins: str) -> Column:
    """The stored form: two hex digits for each bin."""
    digits = F.array(*[F.lit(f"{k:02x}") for k in range(1 << LOW)])
    return F.array_join(F.transform(bins, lambda x: F.get(digits, x.cast("int") + F.lit(1 << (LOW - 1)))), "")


def likeness(a: str, b: str) -> Column:
    """Estimate of the two texts' Jaccard similarity, freed of the bias from equal low bits of unequal values."""
    equal = F.aggregate(F.zip_with(a, b, lambda x, y: (x == y).cast("int")), F.lit(0), lambda s, x: s + x)
    chance = 1.0 / (1 << LOW)
    return F.greatest(F.lit(0.0), (equal / F.lit(float(BINS)) - chance) / (1 - chance))


def with_next(df: DataFrame, columns: list[str]) -> DataFrame:
    """df with next_<column> of the row that follows in descending doc_id; the first follows the last.

    Neighbouring doc_ids share a bucket of about BUCKET_ROWS rows. A window pairs rows in a bucket; the first row
    of the bucket below stands in as a bucket's end. No task sees more than a few buckets, whatever the ids.
    """
    ids = df.select("doc_id")
    n, cuts = ids.agg(F.count("*"), F.percentile_approx("doc_id", [k / 64 for k in range(65)], 10_000)).first()
    cuts = sorted(set(cuts or [0]))
    low = cuts[0]
    width = [max(1, -(-(b - a) * 64 * BUCKET_ROWS // max(n, 1))) for a, b in zip(cuts, [*cuts[1:], cuts[-1] + 1], strict=True)]
    per = max(-(-(b - a + 1) // w) for a, b, w in zip(cuts, [*cuts[1:], cuts[-1]], width, strict=True)) + 1
    lits = lambda xs: F.array(*[F.lit(int(x)).cast("long") for x in xs])
    part = F.greatest(F.size(F.filter(lits(cuts), lambda c: c <= F.col("doc_id"))) - 1, F.lit(0))
    with_part = lambda d: d.withColumn("_part", F.when(F.col("doc_id").isNull(), F.lit(-1)).otherwise(part))
    step = F.floor((F.greatest(F.col("doc_id"), F.lit(low)) - F.get(lits(cuts), F.col("_part"))) / F.get(lits(width), F.col("_part")))
    bucket = F.when(F.col("_part") < 0, F.lit(-1).cast("long")).otherwise(F.col("_part") * F.lit(per).cast("long") + F.least(step, F.lit(per - 1)))
    placed = lambda d: with_part(d).withColumn("_bucket", bucket).drop("_part")

    heads = placed(ids).groupBy("_bucket").agg(F.max("doc_id").alias("head")).withColumn("_over", F.floor(F.col("_bucket") / 4096))
    tops = heads.groupBy("_over").agg(F.max_by("head", "_bucket").alias("top"))
    every = Window.orderBy(F.desc("_over"))  # one row for each 4,096 buckets
    after = tops.withColumn("below", F.coalesce(F.lead(F.struct("top")).over(every), F.first(F.struct("top")).over(every)))
    inner = Window.partitionBy("_over").orderBy(F.desc("_bucket"))
    ends = heads.withColumn("in", F.lead(F.struct("head")).over(inner)).join(after.select("_over", "below"), "_over")
    ends = staged(ends.select(F.coalesce(F.col("in.head"), F.col("below.top")).alias("doc_id"), F.col("_bucket").alias("_into")), "bucket-ends")

    # the end of each bucket; null doc_ids are few and stand for themselves
    extra = df.join(ends.where("doc_id is not null"), "doc_id").withColumn("_bucket", F.col("_into")).drop("_into").withColumn("_end", F.lit(1))
    rows = placed(df).withColumn("_end", F.lit(0)).unionByName(extra)
    order = Window.partitionBy("_bucket").orderBy("_end", F.desc("doc_id"), "_tie")
    for c in columns:
        rows = rows.withColumn(f"next_{c}", F.coalesce(F.lead(c).over(order), F.first(c).over(order)))
    return rows.where("_end = 0").drop("_end", "_bucket")


def op4_minhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Fingerprints of all documents and of their edited texts, and how alike these and the next document's are."""
    docs = documents(spark, sf_dir).select("doc_id", F.coalesce("text", F.lit("")).alias("text")).withColumn("_tie", F.xxhash64("text"))
    df = with_next(with_bins(docs, "text", "bins"), ["text", "bins"])
    n = F.length("text")
    cut = F.floor(n / 3).cast("int")
    df = df.withColumn("n_chars", n.cast("long")).withColumn("edited", F.concat(F.substring(F.col("text"), F.lit(1), n - cut), F.substring(F.col("next_text"), F.lit(1), cut)))
    df = with_bins(df.drop("text", "next_text"), "edited", "edited_bins")
    return df.select(
        "doc_id", "n_chars", F.sha2("edited", 256).alias("edited_sha256"), packed("bins").alias("fingerprint"), packed("edited_bins").alias("edited_fingerprint"),
        likeness("bins", "edited_bins").alias("near_edited"), likeness("bins", "next_bins").alias("near_next"),
    )
