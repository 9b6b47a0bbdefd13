"""Registered queries and models against plain Python versions, held-out accuracy, recall of near copies, empty tables and clashing names."""

import hashlib
import random
import struct
import time
import zlib

import numpy as np
import pytest
import xxhash
from pyspark.sql import functions as F

import corpus_pipeline
from scryline.llm import decontaminate, language, lines, minhash, packing, quality, sharding, simhash, urls
from tests.conftest import SMALL
from tests.llm.test_llm import ODD, SCHEMA, documents, edit_distance_in, words


@pytest.fixture(scope="module")
def table(spark, tmp_path_factory):
    """A folder with documents: copies, near copies, empty and null texts, a repeated row, a null id."""
    at = tmp_path_factory.mktemp("tables")
    rows = documents(80) + [(i, t, *rest) for i, t, *rest in ODD if i != 6]
    spark.createDataFrame(rows, SCHEMA).coalesce(1).write.parquet(str(at / "documents.parquet"))
    return str(at), rows


def xx(value: bytes, seed: int) -> int:
    return xxhash.xxh64_intdigest(value, seed)


def long(x: int) -> bytes:
    return struct.pack("<Q", x)


def pair(a: int, b: int) -> int:
    return xx(long(b), xx(long(a), 42))


def bins(text: str) -> list[int]:
    """The model: bins of shingle hashes, each empty one filled from the first filled one in its own sequence."""
    w = [x for x in "".join(c if c not in "\t\n\v\f\r" else " " for c in text.lower()).split(" ") if x]
    h = [xx(x.encode(), 42) for x in w]
    if len(h) >= 5:
        two = [pair(a, b) for a, b in zip(h, h[1:])]
        four = [pair(a, b) for a, b in zip(two, two[2:])]
        found = [pair(a, b) for a, b in zip(four, h[4:])]
    else:
        x = 42
        for y in h:
            x = xx(long(y), x)
        found = [x]
    least: dict[int, int] = {}
    for x in found:
        b, v = x >> 1 >> 56, (x >> 1) & (1 << 56) - 1
        least[b] = min(v, least.get(b, v))
    signed = lambda x: x - (1 << 64) if x >> 63 else x
    hashed = lambda a, b: signed(xx(struct.pack("<i", b), xx(struct.pack("<i", a), 42)))

    def value(b: int) -> int:
        tried = [b, *[hashed(b, k) % 128 for k in range(8)], *sorted(range(128), key=lambda j: hashed(j, b))]
        return least[next(j for j in tried if j in least)]

    return [value(b) for b in range(128)]


def test_minhash_equals_model(spark, table):
    at, rows = table
    rows = sorted(((i, t or "") for i, t, *_ in rows if i is not None), key=lambda r: -r[0])
    got = {}
    for r in minhash.op4_minhash(spark, at).where("doc_id is not null").collect():
        got.setdefault(r.doc_id, r)
    alike = lambda a, b: max(0.0, (sum(x & 255 == y & 255 for x, y in zip(a, b)) / 128 - 1 / 256) / (1 - 1 / 256))
    for k, (i, t) in enumerate(rows):
        r = got[i]
        assert r.n_chars == len(t) and r.fingerprint == "".join(f"{v & 255:02x}" for v in bins(t))
        if k + 1 < len(rows) and rows[k + 1][0] != i and (k == 0 or rows[k - 1][0] != i):  # rows with equal ids follow one another in the order of hashes
            follower, cut = rows[k + 1][1], len(t) // 3
            edited = t[: len(t) - cut] + follower[:cut]
            assert r.edited_sha256 == hashlib.sha256(edited.encode()).hexdigest()
            assert r.edited_fingerprint == "".join(f"{v & 255:02x}" for v in bins(edited))
            assert r.near_edited == pytest.approx(alike(bins(t), bins(edited))) and r.near_next == pytest.approx(alike(bins(t), bins(follower)))


def test_sharding_query(spark, table):
    at, rows = table
    got = sharding.op1_sharding(spark, at).collect()
    sizes = sorted(len((t or "").encode()) + 1 for _, t, *_ in rows)
    assert sorted(r["size"] for r in got) == sizes
    assert sorted(r.text_crc32 for r in got) == sorted(zlib.crc32((t or "").encode()) for _, t, *_ in rows)
    for s in range(8):
        slots = sorted(r.slot for r in got if r.shard == s)
        assert slots == list(range(len(slots)))


def test_packing_is_tight(spark):
    rows = [(i, words(random.Random(i), random.Random(-i).randint(1, 60))) for i in range(400)]
    got = packing.pack_documents(spark.createDataFrame(rows, "doc_id long, text string"), packing.tokenizer_path(), capacity=512).collect()
    lengths = np.array([r.length for r in got])
    n = len({r.sequence_id for r in got})
    assert n <= 1.02 * -(-lengths.sum() // 512) + 1 and n <= len(packing.best_fit(lengths, 512)) + 1


# models
def plain_kneser_ney(texts, order):
    """log p(character | what stands before it), by counting n-grams in dictionaries."""
    counts = [{} for _ in range(order + 1)]
    for n in range(1, order + 1):
        for t in texts:
            for k in range(len(t) - n + 1):
                g = t[k : k + n]
                counts[n][g] = counts[n].get(g, 0) + 1
    for n in range(1, order):
        before = {}
        for g in counts[n + 1]:
            before[g[1:]] = before.get(g[1:], 0) + 1
        counts[n] = {g: max(1, before.get(g, 0) + (n == 1)) for g in counts[n]}

    def discount(n):
        one, two = (sum(c == k for c in counts[n].values()) for k in (1, 2))
        return min(0.95, max(0.1, one / (one + 2 * two))) if one + two else 0.75

    def p(context, c):
        n = len(context) + 1
        if n == 1:
            total, d = sum(counts[1].values()), discount(1)
            return (max(counts[1].get(c, 0) - d, 0) if c in counts[1] else 0) / total + d * len(counts[1]) / total / (len(counts[1]) + 1)
        after = [v for g, v in counts[n].items() if g[:-1] == context]
        if not after:
            return p(context[1:], c)
        return max(counts[n].get(context + c, 0) - discount(n), 0) / sum(after) + discount(n) * len(after) / sum(after) * p(context[1:], c)

    return p


def test_kneser_ney_equals_plain_version():
    rng = random.Random(3)
    texts = {x: [language.normal(words(rng, 30, x)) for _ in range(4)] for x in ("abcd", "cdefg")}
    model = language.Model(texts, 3)
    plain = [plain_kneser_ney(texts[x], 3) for x in model.languages]
    tests = [language.normal(t) for t in ("abca dcab ee", "zzz", "a", "gfe dcba q abab")]
    got = model.cross_entropy(tests)
    for t, row in zip(tests, got):
        for p, ce in zip(plain, row):
            assert ce == pytest.approx(-sum(np.log(p(t[max(0, k - 2) : k], t[k])) for k in range(1, len(t))) / (len(t) - 1), rel=1e-4)


@pytest.mark.parametrize("text", ["²½", "12 ³", "_-", "Ⅷ", None, ""])
def test_texts_without_a_letter(text):
    assert language.normal(text) == ""


def test_language_rejects_what_it_has_not_learned(spark):
    import duckdb

    rows = duckdb.sql(f"SELECT lang, text FROM '{SMALL}/documents.parquet' WHERE lang IN ('en', 'fr', 'de') AND length(text) > 30 ORDER BY doc_id").fetchall()
    fit, clean = {}, []
    for k, (lang, text) in enumerate(rows):
        if k % 3 and language.normal(text):
            fit.setdefault(lang, []).append(language.normal(text))
        elif not k % 3:
            clean.append(text)
    identifier = language.Identifier({x: t[::2] for x, t in fit.items()}, {x: t[1::2] for x, t in fit.items()})
    junk = ["xqzj kvwq zzxk qjxw vkqz wxjq", "Привет, как дела? Это русский текст", "kot siedzi na dachu i patrzy na ptaki ktore lataja wysoko", "你好世界这是中文"]
    df = spark.createDataFrame([(i, t) for i, t in enumerate(clean + junk)], "doc_id long, text string").withColumns({c: F.lit(c) for c in ("_judged", "lang_pred", "Score")})
    kept = language.accepted(df, identifier)
    assert kept.columns == df.columns
    ids = {r.doc_id for r in kept.collect()}
    assert ids == set(range(len(clean)))


def test_language_and_quality_held_out(spark):
    sf = "/root/testdata/sf0.01"
    lang = {r.doc_id: r.lang for r in spark.read.parquet(f"{sf}/documents.parquet").collect()}
    got = [r for r in language.op7_language(spark, sf).collect() if r.held_out and lang[r.doc_id]]
    assert np.mean([r.lang_pred == lang[r.doc_id] for r in got]) > 0.97
    label = {r.doc_id: r.quality for r in spark.read.parquet(f"{sf}/labels.parquet").collect()}
    got = [r for r in quality.op8_quality(spark, sf).collect() if r.held_out and r.doc_id in label]
    base = np.mean([label[r.doc_id] for r in got])
    assert np.mean([r.predicted == label[r.doc_id] for r in got]) > max(base, 1 - base)


def test_quality_equals_plain_version():
    import zstandard

    rng = random.Random(2)
    good, bad = ([words(rng, 60, a) for _ in range(30)] for a in ("abcdef", "uvwxyz"))
    c = quality.Classifier(good[:20], bad[:20], [(t, 1) for t in good[20:]] + [(t, 0) for t in bad[20:]])
    for text in [good[0], bad[0], words(rng, 900, "abcxyz"), "", None]:
        sizes = []
        for d in c.dictionaries:
            z = zstandard.ZstdCompressor(dict_data=zstandard.ZstdCompressionDict(d), level=3, write_content_size=False, write_dict_id=False)
            raw = (text or "").encode()
            sizes.append(sum(len(z.compress(raw[i : i + 2048])) for i in range(0, len(raw), 2048)))
        x = (sizes[0] - sizes[1]) / sum(sizes) if sum(sizes) else 0.0
        assert c.score([text])[0] == pytest.approx(1 / (1 + np.exp(-np.clip(c.slope * x + c.shift, -50, 50))))


# near copies
def test_near_copies_are_found(spark):
    """Eighty pairs of a similarity of 0.8 to 0.87, and a family of texts that are near each other but not near enough."""
    rng = random.Random(12)
    rows, want = [], []
    for k in range(80):
        w = words(rng, 300, "abcdefghijklmnopqrstuvwxyz").split()
        other = list(w)
        for at in rng.sample(range(0, 300, 5), rng.randint(4, 6)):
            other[at] = "other"
        sets = [{tuple(x[i : i + 5]) for i in range(296)} for x in (w, other)]
        assert len(sets[0] & sets[1]) >= 0.8 * len(sets[0] | sets[1])
        rows += [(2 * k, " ".join(w)), (2 * k + 1, " ".join(other))]
        want.append((2 * k, 2 * k + 1))
    base = words(rng, 300, "abcdefghijklmnopqrstuvwxyz").split()
    for k in range(30):
        w = list(base)
        for at in rng.sample(range(0, 300, 6), 14):
            w[at] = f"own{k}"
        rows.append((1000 + k, " ".join(w)))
    got = {r.doc_id: r.component_id for r in simhash.near_copies(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    assert sum(got[a] == got[b] for a, b in want) >= 0.95 * len(want)
    assert len({got[1000 + k] for k in range(30)}) == 30 and len({got[a] for a, _ in want}) == 80


def test_work_follows_the_variants():
    """At two million fingerprints of a slice, where a square would show: the better of two runs each."""
    took = []
    for n in (500_000, 2_000_000):
        keys = np.random.default_rng(1).integers(0, 2**63, n, dtype=np.int64).view(np.uint64)
        runs = []
        for _ in range(2):
            began = time.process_time()
            simhash.slice_links(keys, 3, 6, 2, 64, lambda i, j: np.bitwise_count(keys[i] ^ keys[j]).astype(np.int64), 4, 4)
            runs.append(time.process_time() - began)
        took.append(min(runs))
    assert took[1] < 6 * took[0]  # four times the fingerprints, and sorting


@pytest.mark.parametrize("n", [10, 10**6, 10**8])
def test_slices_are_bounded(n):
    k = simhash.slices(n, 16, 2, 6)
    assert n * 16 * (1 + k + k * (k - 1) / 2) / 2**k <= simhash.SLICE_BYTES and (k == 6 or n > 10**5)


# edges
CLASHES = ["_id", "_th", "_places", "_kept", "_judged", "_lang_pred", "_score", "k1", "first", "node", "c", "Wide", "fp"]


def test_clashing_names_pass_through(spark, table, tmp_path):
    at, rows = table
    docs = spark.read.parquet(f"{at}/documents.parquet").withColumns({c: F.lit(f"my {c}") for c in CLASHES})
    spark.createDataFrame([(0, "not in any text at all")], "item_id long, text string").coalesce(1).write.parquet(str(tmp_path / "benchmark.parquet"))
    for _, stage in corpus_pipeline.STAGES[:-1]:
        out = stage(spark, docs, str(tmp_path))
        assert out.columns == docs.columns
        assert all(r[c] == f"my {c}" for r in out.collect() for c in CLASHES)
    assert corpus_pipeline.STAGES[-1][1](spark, docs, str(tmp_path)).count() >= len(rows)


def test_empty_tables(spark, tmp_path):
    none = spark.createDataFrame([], SCHEMA)
    none.coalesce(1).write.parquet(str(tmp_path / "documents.parquet"))
    items = spark.createDataFrame([], "item_id long, text string")
    items.coalesce(1).write.parquet(str(tmp_path / "benchmark.parquet"))
    assert corpus_pipeline.run(spark, str(tmp_path)).count() == 0
    assert decontaminate.matches(none, items).count() == 0 and decontaminate.decontaminated(none, items).count() == 0
    assert urls.judge(spark.createDataFrame([], "page_id long, url string"), spark.createDataFrame(urls.RULES, "verdict string, host string, path string")).count() == 0
    classifier = quality.learn(none, spark.createDataFrame([], "doc_id long, quality int"), F.lit(True))
    assert quality.scored(none, classifier).count() == 0
    some = spark.createDataFrame([(1, "a text")], "doc_id long, text string")
    assert decontaminate.decontaminated(some, items).count() == 1
    assert urls.judge(spark.createDataFrame([(1, "http://a.net/")], "page_id long, url string"), spark.createDataFrame([], "verdict string, host string, path string")).first().verdict == "allow"


def test_long_text(spark):
    rng = random.Random(9)
    item = words(rng, 12, "pqrs")
    text = "\n".join(words(rng, 20) for _ in range(4000)) + "\n" + item
    df = spark.createDataFrame([(1, text), (2, text), (3, "short")], "doc_id long, text string")
    assert {(r.doc_id, r.item_id) for r in decontaminate.matches(df, spark.createDataFrame([(7, item)], "item_id long, text string")).collect()} == {(1, 7), (2, 7)}
    assert sorted(r.doc_id for r in lines.deduplicated(df).collect()) == [1, 3]
    assert sorted(r.doc_id for r in simhash.without_near_copies(df).collect()) == [1, 3]


def test_pieces_across_chunks(monkeypatch):
    """Any item within its budget is found, wherever the text is cut for hashing, and characters outside the BMP count as one."""
    rng = random.Random(10)
    for size in (1, 7, 64, 1 << 18):
        monkeypatch.setattr(decontaminate, "CHUNK", size)
        for rate in (0, 0.05, 0.3):
            items = [(i, "".join(rng.choice("abcé𐐀 ") for _ in range(rng.randint(1, 90)))) for i in range(8)]
            matcher = decontaminate.Matcher(items, rate)
            for _, item in items:
                edited = list(item)
                edited[rng.randrange(len(edited))] = "b"
                text = "".join(rng.choice("abc ") for _ in range(60)) + "".join(edited) + "ca"
                want = []
                for i, other in items:
                    form = decontaminate.normal(other)
                    e = edit_distance_in(form, decontaminate.normal(text))
                    if form and e <= int(len(form) * rate):
                        want.append((i, e))
                assert [(i, e) for i, e, _ in matcher.hits(text)] == want


def test_many_items_are_one_pass(spark):
    """Thousands of items are searched in one pass over the documents."""
    rng = random.Random(11)
    items = [(i, words(rng, 12, "abcdefghij")) for i in range(5000)]
    docs = spark.createDataFrame([(i, f"{words(rng, 30, 'xyz')} {items[i * 37][1]} {words(rng, 9, 'xyz')}") for i in range(60)], "doc_id long, text string")
    found = decontaminate.matches(docs, spark.createDataFrame(items, "item_id long, text string"))
    assert {(r.doc_id, r.item_id) for r in found.where("edits = 0").collect()} == {(i, i * 37) for i in range(60)}
    assert found._jdf.queryExecution().optimizedPlan().toString().count("MapInPandas") == 1
