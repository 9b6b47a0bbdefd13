"""The training-data operators against brute force, and their edge cases: nulls, empty texts, ties, repeats, empty tables, extra columns."""

import random
import zlib
from collections import Counter

import duckdb
import numpy as np
import pytest
from pyspark.sql import functions as F

import corpus_pipeline
from scryline.llm import decontaminate, language, lines, lm, minhash, packing, quality, sharding, simhash, urls
from tests.conftest import plain

SCHEMA = "doc_id long, text string, lang string, source string, n_chars long"


def words(rng, n, alphabet="abcdefghij"):
    return " ".join("".join(rng.choice(alphabet) for _ in range(rng.randint(2, 7))) for _ in range(n))


def documents(n=120, seed=3):
    rng, out = random.Random(seed), []
    for i in range(n):
        text = "\n".join(words(rng, rng.randint(1, 25)) for _ in range(rng.randint(1, 5)))
        if i % 7 == 3:
            text = out[rng.randrange(len(out))][1]  # a copy
        elif i % 7 == 5 and out[-1][1]:
            parts = out[-1][1].split(" ")
            parts[len(parts) // 2] = "changed"
            text = " ".join(parts)
        out.append((i * 3, text, "xx" if i % 2 else "yy", f"s{i % 5}", 0 if text is None else len(text)))
    return out


ODD = [(1, None, None, None, None), (2, "", "xx", "s", 0), (None, "no id at all here", "xx", "s", 17), (4, "same same same same same", "xx", "s", 24), (4, "same same same same same", "xx", "s", 24), (5, " \t\n ", "yy", None, 4), (6, "x" * 30_000, "yy", "s", 30_000)]


@pytest.fixture(scope="module")
def docs(spark):
    return spark.createDataFrame(documents(), SCHEMA).cache()


@pytest.fixture(scope="module")
def odd(spark):
    """With columns whose names the operators use themselves."""
    return spark.createDataFrame(ODD, SCHEMA).withColumn("fp", F.lit(1)).withColumn("ord", F.lit("o")).withColumn("line", F.lit(None).cast("string")).cache()


@pytest.fixture(scope="module")
def none(spark):
    return spark.createDataFrame([], SCHEMA)


# 1: sharding
@pytest.mark.parametrize("seed", range(20))
def test_cuts_are_minimax(seed):
    rng = random.Random(seed)
    sizes = [rng.choice([1, 2, 3, 50, 200]) for _ in range(rng.randint(3, 40))]
    shards, block = rng.randint(2, 6), rng.randint(1, 7)
    ends = np.cumsum([sum(sizes[i : i + block]) for i in range(0, len(sizes), block)])
    detail = lambda blocks: {b: (int(ends[b - 1]) if b else 0) + np.cumsum(sizes[b * block : (b + 1) * block]) for b in blocks}
    cuts = sharding.minimax_cuts(ends, max(sizes), shards, detail)

    def needed(capacity):
        n, room = 1, capacity
        for s in sizes:
            if s > capacity:
                return 10**9
            if s > room:
                n, room = n + 1, capacity
            room -= s
        return n

    best = next(c for c in range(1, sum(sizes) + 1) if needed(c) <= shards)
    assert max(b - a for a, b in zip([0, *cuts[:-1]], cuts)) == best


def test_shards(docs, odd, none):
    for df, n in ((docs, 120), (odd, len(ODD))):
        rows = sharding.shard_documents(df, 4).collect()
        assert len(rows) == n
        for s in {r.shard for r in rows}:
            assert sorted(r.slot for r in rows if r.shard == s) == list(range(sum(r.shard == s for r in rows)))
    text = {r.doc_id: r.text for r in docs.collect()}
    of = {}
    for r in sharding.shard_documents(docs, 4).collect():
        assert r.size == len(text[r.doc_id].encode()) + 1 and r.text_crc32 == zlib.crc32(text[r.doc_id].encode())
        assert of.setdefault(text[r.doc_id], r.shard) == r.shard
    assert sharding.shard_documents(none, 4).count() == 0


# 2: SimHash
def test_components_equal_brute_force(docs, odd, none):
    for df in (docs, odd):
        rows = simhash.near_duplicates(df, 4).collect()
        fps = [r.fp & (2**64 - 1) for r in rows]
        label = list(range(len(rows)))
        for _ in rows:
            for i in range(len(rows)):
                for j in range(i):
                    if bin(fps[i] ^ fps[j]).count("1") <= 4:
                        label[i] = label[j] = min(label[i], label[j])
        for i, r in enumerate(rows):
            ids = [rows[j].doc_id for j in range(len(rows)) if label[j] == label[i] and rows[j].doc_id is not None]
            assert r.component_id == (min(ids) if ids else None)
    assert simhash.near_duplicates(none, 4).count() == 0


@pytest.mark.parametrize("text", ["", None, "one", "A b c d", "a b c d e a b c d e", "É é x y z"])
def test_fingerprint_equals_definition(text):
    import xxhash

    w = (text or "").encode().lower().split()
    shingles = [b" ".join(w[i : i + 4]) for i in range(len(w) - 3)] if len(w) >= 4 else [b" ".join(w)] if w else []
    hs = [xxhash.xxh64_intdigest(s, 42) for s in shingles]
    assert simhash.fingerprint(text, 4) == sum(1 << k for k in range(64) if hs and 2 * sum(h >> k & 1 for h in hs) > len(hs))


@pytest.mark.parametrize("bits", [2, 6, 9])
def test_ball_links_miss_nothing(spark, bits):
    rng = random.Random(bits)
    fps = {rng.getrandbits(64) for _ in range(200)}
    for f in list(fps):
        for d in range(1, 6):
            fps.add(f ^ sum(1 << b for b in rng.sample(range(64), d)))
    signed = [(f - 2**64 if f >> 63 else f,) for f in fps]
    df = spark.createDataFrame(signed, "node long").withColumn("wide", simhash.little_endian(F.col("node")))
    roots = {r.node: r.root for r in simhash.components(simhash.ball_links(df, 2, slice_bits=bits)).collect()}
    arr = np.array([x[0] for x in signed], np.int64)
    near = np.bitwise_count(arr.view(np.uint64)[:, None] ^ arr.view(np.uint64)[None]) <= 4
    for i, j in zip(*np.nonzero(near)):
        a, b = int(arr[i]), int(arr[j])
        assert roots.get(a, a) == roots.get(b, b)


def test_near_copies(spark):
    rng = random.Random(5)
    base = words(rng, 400, "abcdefghijklmnopqrstuvwxyz").split()
    near = [*base[:200], "other", *base[201:]]
    rows = [(1, " ".join(base)), (2, " ".join(near)), (3, words(rng, 300, "qrstuvwxyz")), (4, " ".join(base)), (4, " ".join(base)), (None, "a b c d e f")]
    df = spark.createDataFrame([(i, t, "l", "s", len(t)) for i, t in rows], SCHEMA)
    assert sorted((r.doc_id is None, r.doc_id) for r in simhash.without_near_copies(df).collect()) == [(False, 1), (False, 3), (True, None)]


def test_similar_pairs_equal_brute_force(spark):
    rng = random.Random(8)
    base = words(rng, 200, "abcdefghijklmnopqrstuvwxyz").split()
    texts = ["", "a b", "a b c d e"]
    for edits in range(0, 12):
        w = list(base)
        for at in rng.sample(range(200), edits):
            w[at] = "other"
        texts.append(" ".join(w))

    def of(t):
        w = t.split()
        return {tuple(w[k : k + 5]) for k in range(max(1, len(w) - 4))}

    rows = [(None if k == 4 else k, t, k) for k, t in enumerate(texts)]
    df = spark.createDataFrame(rows, "doc_id long, text string, node long")
    keyed = df.select("doc_id", F.xxhash64("text").alias("th"), "node")
    pairs = [(a, b) for b in range(len(texts)) for a in range(b)]
    got = simhash.similar(spark.createDataFrame(pairs, "a long, b long"), keyed, df.drop("node"), 5)
    want = {(a, b) for a, b in pairs if len(of(texts[a]) & of(texts[b])) >= 0.8 * len(of(texts[a]) | of(texts[b]))}
    assert 3 < len(want) < len(pairs) and {tuple(r) for r in got.collect()} == want


# 3: packing
@pytest.mark.parametrize("seed", range(10))
def test_best_fit_holds_and_fills(seed):
    rng = np.random.default_rng(seed)
    sizes = rng.integers(1, 60, 300)
    bins = packing.best_fit(sizes, 100)
    assert sorted(i for b in bins for i in b) == list(range(300))
    assert max(sum(sizes[b]) for b in bins) <= 100
    assert len(bins) <= 11 / 9 * -(-int(sizes.sum()) // 100) + 1


def test_packing_round_trip(docs, odd, none):
    from tokenizers import Tokenizer

    path = packing.tokenizer_path()
    reference = Tokenizer.from_file(path)
    for df in (docs, odd):
        texts = {r.doc_id: r.text or "" for r in df.collect()}
        rows = packing.pack_documents(df, path, capacity=256).collect()
        for r in rows:
            ids = np.array([*reference.encode(texts[r.doc_id], add_special_tokens=False).ids, 1], "<u4")[r.start : r.start + r.length]
            assert zlib.crc32(ids.tobytes()) == r.ids_crc32 and len(ids) == r.length
        by: dict = {}
        for r in rows:
            by.setdefault(r.sequence_id, []).append((r.offset, r.length))
        for parts in by.values():
            parts.sort()
            assert [p[0] for p in parts] == [sum(x[1] for x in parts[:i]) for i in range(len(parts))] and sum(p[1] for p in parts) <= 256
    assert packing.pack_documents(none, path).count() == 0


@pytest.mark.parametrize("text", ["A<|endoftext|>b C", "Σας ΣΣ", "don't I'll 's", "x\x1cy \x1f", "é e\u0301", "12 3a1,", "", "...?!,", "²x½ ªb"])
def test_encoder_equals_tokenizer(text):
    e = packing.Encoder(packing.tokenizer_path())
    assert e.encode([text, text]) == e._ids([text, text])


# 4: MinHash
def test_minhash(spark, docs, odd, none):
    rng = random.Random(9)
    a = words(rng, 2000).split()
    pairs = [(k, " ".join(a), " ".join(a[k * 200 :] + words(rng, k * 200 or 1).split())) for k in range(6)]
    df = minhash.with_bins(minhash.with_bins(spark.createDataFrame(pairs, "k int, x string, y string"), "x", "p"), "y", "q")
    sets = lambda t: {tuple(t.split()[i : i + 5]) for i in range(len(t.split()) - 4)}
    for r in df.withColumn("est", minhash.likeness("p", "q")).collect():
        x, y = sets(r.x), sets(r.y)
        assert abs(r.est - len(x & y) / len(x | y)) < 0.17
    prints = {r.text: set() for r in docs.collect()}
    for r in minhash.with_bins(docs, "text", "b").withColumn("f", minhash.packed("b")).collect():
        prints[r.text].add(r.f)
    assert all(len(p) == 1 and len(next(iter(p))) == 256 for p in prints.values())
    for df, n in ((odd, len(ODD)), (none, 0)):
        d = df.select("doc_id", F.coalesce("text", F.lit("")).alias("text")).withColumn("_tie", F.xxhash64("text"))
        assert minhash.with_bins(minhash.with_next(d, ["text"]), "next_text", "b").count() == n


def test_next_document(spark, monkeypatch):
    monkeypatch.setattr(minhash, "BUCKET_ROWS", 3)
    ids = [1, 2, 3, 50, 51, 1_000_000, 1_000_001, 2**40, 2**40 + 5, *range(5000, 5100)]
    d = spark.createDataFrame([(i, f"t{i}") for i in ids], "doc_id long, text string").withColumn("_tie", F.lit(0))
    got = {r.doc_id: r.next_text for r in minhash.with_next(d, ["text"]).collect()}
    down = sorted(ids, reverse=True)
    assert got == {a: f"t{b}" for a, b in zip(down, [*down[1:], down[0]])}


# 5: URLs
def test_urls_equal_brute_force(spark):
    rng = random.Random(4)
    labels = ["com", "net", "org", "a", "b", "example", "ex", "xn--1"]
    rules = list({(rng.choice(["allow", "block"]), ".".join(rng.choice(labels) for _ in range(rng.randint(1, 3))), rng.choice(["/", "/a", "/a/b/", ""])) for _ in range(25)})
    rows = [(i, f"{rng.choice(['http', 'HTTPS'])}://{'.'.join(rng.choice(labels) for _ in range(rng.randint(1, 4))).upper()}{rng.choice(['', '/', '/a', '/a/b/c', '/q?x#y', '#z'])}") for i in range(300)]
    rows += [(900, None), (901, ""), (902, "no scheme"), (903, "://"), (904, "x://a.com\n/a"), (900, None)]
    got = urls.judge(spark.createDataFrame(rows, "page_id int, url string").withColumn("host", F.lit("x")), spark.createDataFrame(rules, "verdict string, host string, path string")).collect()
    assert len(got) == len(rows)
    for r in got:
        fits = [(len(h + p), v, h + p) for v, h, p in rules if (r.host == h or r.host.endswith("." + h)) and r.path.startswith(p)]
        assert (r.verdict, r.rule) == ((max(fits)[1], max(fits)[2]) if fits else ("allow", None))


# 6: decontamination
def edit_distance_in(item, text):
    row = [0] * (len(text) + 1)
    for i, c in enumerate(item, 1):
        last, row[0] = row[0], i
        for j, d in enumerate(text, 1):
            last, row[j] = row[j], min(last + (c != d), row[j] + 1, row[j - 1] + 1)
    return min(row)


def test_matches_equal_brute_force(spark):
    rng = random.Random(6)
    items = [(i, words(rng, rng.randint(6, 20), "abc")) for i in range(12)] + [(90, None), (91, "!!"), (92, "")]
    rows = []
    for d in range(40):
        t = list(words(rng, 20, "abcd") + " " + items[d % 12][1] + " " + words(rng, 5, "abcd"))
        for _ in range(d % 9):
            t[rng.randrange(len(t))] = rng.choice("abz")
        rows.append((d, "".join(t)))
    rows += [(100, None), (101, ""), (102, items[0][1].upper()), (102, items[0][1].upper())]
    got = decontaminate.matches(spark.createDataFrame(rows, "doc_id long, text string"), spark.createDataFrame(items, "item_id long, text string"), 0.08).collect()
    want = []
    for d, t in rows:
        for i, item in items:
            form = decontaminate.normal(item)
            if form and t:
                e = edit_distance_in(form, decontaminate.normal(t))
                if e <= int(len(form) * 0.08):
                    want.append((d, i, e))
    assert sorted((r.doc_id, r.item_id, r.edits) for r in got) == sorted(want)
    kept = decontaminate.decontaminated(spark.createDataFrame(rows, "doc_id long, text string"), spark.createDataFrame(items, "item_id long, text string"), 0.08)
    assert {r.doc_id for r in kept.collect()} == {d for d, _ in rows} - {w[0] for w in want}


# 7, 8, 10: models
def test_language(spark, docs, odd, none):
    rng = random.Random(8)
    rows = [(i, words(rng, 40, "aeioulmn" if i % 2 else "krtzsxyw"), "one" if i % 2 else "two", "s", 1) for i in range(80)]
    df = spark.createDataFrame(rows, SCHEMA)
    m = language.learn(df, F.col("doc_id") < 60)
    got = language.identify(df, m, ["doc_id", "lang"]).where("doc_id >= 60").collect()
    assert all(r.lang_pred == r.lang and 0 <= r.score <= 1 for r in got)
    out = {(r.doc_id, r.lang_pred, r.score) for r in language.identify(odd, m, ["doc_id"]).collect()}
    assert (1, "und", 0.0) in out and (5, "und", 0.0) in out
    assert language.identify(df, language.learn(none, F.lit(True)), ["doc_id"]).where("lang_pred <> 'und'").count() == 0


def test_kneser_ney_sums_to_one():
    rng = random.Random(1)
    texts = [language.normal(words(rng, 300, "abcde"))]
    m = language.Model({"x": texts}, 3)
    for context in ("a", "bc", " a", "zz"):
        n = len(context) + 1
        total = 0.0
        for c in " abcde":
            codes = np.array([ord(x) for x in context + c], "<u4")
            total += float(np.exp(m._lookup(codes, np.array([n - 1]), n))[0, 0])
        assert 0.95 < total < 1.001


def test_quality(spark, odd):
    rng = random.Random(2)
    rows = [(i, "\n".join(words(rng, 30) if i % 3 else " | ".join(words(rng, 30).split()) for _ in range(6)), "l", "s", 1) for i in range(150)]
    labels = spark.createDataFrame([(i, int(i % 3 > 0)) for i in range(150)] + [(None, 1), (7, None)], "doc_id long, quality int")
    df = spark.createDataFrame(rows, SCHEMA)
    c = quality.learn(df, labels, F.col("doc_id") < 100)
    got = {r.doc_id: r.score for r in quality.scored(df, c).collect()}
    assert sum((got[i] >= 0.5) == (i % 3 > 0) for i in range(100, 150)) >= 48
    assert all(0 <= r.score <= 1 for r in quality.scored(odd, c).collect())
    assert quality.learn(df, labels.limit(0), F.lit(True)).score(["x", None]).tolist() == [0.5, 0.5]


def test_lm_scores(spark, odd, none):
    rng = random.Random(3)
    rows = [(i, words(rng, 50, "abc" if i % 2 else "abd"), "l", "s", 1) for i in range(60)]
    labels = spark.createDataFrame([(i, i % 2) for i in range(40)], "doc_id long, quality int")
    df = spark.createDataFrame(rows, SCHEMA)
    scorer = lm.learn(df, labels)
    got = {r.doc_id: r.score for r in lm.scored(df, scorer).collect()}
    assert min(got[i] for i in range(41, 60, 2)) > max(got[i] for i in range(40, 60, 2))
    assert {(r.doc_id, r.tokens, r.score) for r in lm.scored(odd, scorer).where("doc_id in (1, 2, 5)").collect()} == {(1, 0, 0.0), (2, 0, 0.0), (5, 0, 0.0)}
    v = scorer.vocabulary
    counts = {}
    for _, t, *_ in rows:
        ids = v(t).tolist()
        for a, b in zip(ids, ids[1:]):
            counts[a * v.size + b] = counts.get(a * v.size + b, 0) + 1
    assert {r.cell: r.n for r in lm.bigram_counts(df, v, frozenset()).collect()} == counts
    assert lm.scored(none, lm.learn(none, labels)).count() == 0


@pytest.mark.parametrize("frequent", [0, 20, 1 << 18])
def test_lm_equals_brute_force(spark, monkeypatch, frequent):
    """More different words than a fixed vocabulary held, every labelled document in the target; rows that repeat, and null ids."""
    monkeypatch.setattr(lm, "FREQUENT", frequent)
    monkeypatch.setattr(lm, "BUCKET", 500)
    monkeypatch.setattr(lm, "BLOCK", 300)
    rng = random.Random(5)
    rows = [(i, " ".join(f"w{int(rng.paretovariate(0.4)) if rng.random() < 0.5 else rng.randrange(3000)}" for _ in range(rng.randint(0, 80)))) for i in range(150)]
    rows += [rows[3], (None, rows[4][1]), (150, None), (151, ""), *[(160 + i, "w1 hot pair " * 20 + f"w{i}") for i in range(12)]]
    monkeypatch.setattr(lm, "COUNTED", 400)  # many blocks, in some of which the pair is hot
    good = {i for i in range(120) if i % 3}
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    scorer = lm.learn(docs, spark.createDataFrame([(i, int(i in good)) for i in range(120)], "doc_id long, quality int"))
    assert len(scorer.hot)
    seen = [Counter(), Counter()]
    pairs = lambda t: list(zip(["", *t.split()], [*t.split(), ""])) if t else []
    for d, t in rows:
        for c in seen[: 1 + (d in good)]:
            c.update(pairs(t))
            c.update(b for _, b in pairs(t))
    size = len({b for _, t in rows for _, b in pairs(t)}) + 1
    totals = [sum(n for k, n in c.items() if isinstance(k, str)) for c in seen]
    assert size > 1024

    def ce(text, c, scale):
        out = 0
        for a, b in pairs(text):
            weight = 0.8 * c[a] * scale / (c[a] * scale + 5)
            out -= np.log((weight * c[a, b] / c[a] if c[a] else 0) + (1 - weight) * (c[b] * scale + 0.5) / (totals[1] + 0.5 * size))
        return out / len(pairs(text))

    new = [(900, rows[0][1] + " neverseen " + rows[1][1])]
    for some, df in ((rows, docs), (new, spark.createDataFrame(new, "doc_id long, text string"))):
        want = []
        for d, t in some:
            x = (ce(t, seen[1], 1), ce(t, seen[0], totals[1] / totals[0])) if pairs(t) else (None, None)
            want.append((str(d), len(pairs(t)), *x, x[1] - x[0] if pairs(t) else 0.0))
        got = sorted((str(r[0]), *r[1:]) for r in lm.scored(df, scorer).collect())
        assert [g[:2] for g in got] == [w[:2] for w in sorted(want)]
        for g, w in zip(got, sorted(want)):
            assert g[2:] == pytest.approx(w[2:], abs=1e-9) if w[2] is not None else g[2:] == w[2:]


# 9: lines
def line_model(rows):
    """Which lines go: by comparing every line with every earlier one."""
    seen, short, gone = [], set(), set()
    for d, t in sorted((r for r in rows if r[0] is not None and r[1] is not None), key=lambda r: r[0]):
        for k, line in enumerate(t.split("\n")):
            w = line.lower().split()
            if len(w) >= 5:
                for other in seen:
                    p = next((i for i, (a, b) in enumerate(zip(w, other)) if a != b), min(len(w), len(other)))
                    q = next((i for i, (a, b) in enumerate(zip(w[::-1], other[::-1])) if a != b), min(len(w), len(other)))
                    if abs(len(w) - len(other)) <= 1 and p + q >= max(len(w), len(other)) - 1:
                        gone.add((d, k))
                        break
                seen.append(w)
            elif w:
                form = line.lower().strip(" \t\n\v\f\r")
                if form in short:
                    gone.add((d, k))
                short.add(form)
    return gone


def test_lines_equal_brute_force(spark, docs):
    rng, rows = random.Random(7), []
    pool = [words(rng, rng.randint(1, 12), "ab") for _ in range(40)]
    for d in range(60):
        ls = []
        for _ in range(rng.randint(1, 5)):
            w = rng.choice(pool).split()
            if rng.random() < 0.5:
                k = rng.randrange(len(w))
                w[k : k + 1] = rng.choice([[], ["zz"], [w[k], "new"], [w[k].upper()]])
            ls.append(rng.choice(["", " ", "\t"]) + " ".join(w) + rng.choice(["", " "]))
        rows.append((d * 2, "\n".join(ls)))
    df = spark.createDataFrame(rows, "doc_id long, text string").withColumn("n_chars", F.length("text"))
    got = {(r.doc_id, p) for r in lines.drops(df).collect() for p in r.places}
    want = line_model(rows)
    assert got == want and want
    for r in lines.deduplicated(df).collect():
        text = dict(rows)[r.doc_id].split("\n")
        assert r.text == "\n".join(x for k, x in enumerate(text) if (r.doc_id, k) not in want) and r.n_chars == len(r.text)


def test_lines_odd(odd, none):
    out = lines.deduplicated(odd)
    assert out.columns == odd.columns and out.count() == len(ODD)
    assert lines.deduplicated(none).count() == 0


def test_line_sql(spark, tmp_path, docs):
    docs.coalesce(1).write.parquet(str(tmp_path / "documents.parquet"))
    con = duckdb.connect()
    con.execute(f"CREATE VIEW documents AS FROM '{tmp_path}/documents.parquet/*.parquet'")
    got = lines.op9_line_dedup(spark, str(tmp_path))
    names = sorted(got.columns)
    assert plain(got.select(*names).collect()) == plain(con.execute(f"SELECT {', '.join(names)} FROM ({lines.OP9_SQL})").fetchall())


# the pipeline
def test_pipeline(spark, tmp_path):
    rng = random.Random(11)
    text = lambda n=30: "\n".join(words(rng, n, "abcdefghijklmnop") for _ in range(4))
    item = words(rng, 15, "qrst")
    rows = [(i, text(), "one", "s", 1) for i in range(30)]
    rows += [(100, rows[0][1], "one", "s", 1), (101, text() + "\n" + item, "one", "s", 1), (102, "12345 !!", "one", "s", 1), (103, None, "one", "s", 1)]
    spark.createDataFrame(rows, SCHEMA).coalesce(1).write.parquet(str(tmp_path / "documents.parquet"))
    spark.createDataFrame([(0, item)], "item_id long, text string").coalesce(1).write.parquet(str(tmp_path / "benchmark.parquet"))
    docs, seen = spark.read.parquet(str(tmp_path / "documents.parquet")), []
    for name, stage in corpus_pipeline.STAGES[:-1]:
        out = stage(spark, docs, str(tmp_path))
        assert out.columns == docs.columns
        docs = out.cache()
        seen.append({r.doc_id for r in docs.collect()})
    clean = set(range(30))
    assert seen == [clean | {100, 101}, clean | {101}, clean | {101}, clean]
    packed = corpus_pipeline.run(spark, str(tmp_path)).collect()
    assert {r.doc_id for r in packed} == clean
