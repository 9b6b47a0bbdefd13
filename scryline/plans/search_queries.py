"""Queries of search, chunking and text, with their DuckDB SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, functions as F

from scryline.functions import matchers, text as T
from scryline.operators import chunking, greedy, ranges, retrieval
from scryline.plans.adapters import table
from scryline.sources import store

QUERY = "The the onnthe erheon security of heresh"
VECTOR = 0
TOKENS = "list_transform(regexp_extract_all(text, '[a-zA-Z0-9_]+'), lambda x: lower(x))"


def _query(spark: SparkSession) -> DataFrame:
    return spark.createDataFrame([(0, QUERY)], "query int, text string")


def _docs(spark, sf):
    return table(spark, sf, "documents").select(F.col("doc_id").alias("doc"), "text", "lang", "source")


def _vectors(spark, sf):
    return table(spark, sf, "embeddings").select(F.col("vec_id").alias("doc"), F.col("embedding").alias("vector"), "label")


BM25_SQL = f"""
q AS (SELECT unnest(list_transform(regexp_extract_all('{QUERY}', '[a-zA-Z0-9_]+'), lambda x: lower(x))) AS term),
qt AS (SELECT term, count(*) AS qtf FROM q GROUP BY term),
t AS (SELECT doc_id AS doc, {TOKENS} AS t FROM documents),
st AS (SELECT count(*) AS n, avg(len(t)) AS avgdl FROM t),
e AS (SELECT doc, len(t) AS dl, unnest(t) AS term FROM t),
h AS (SELECT doc, dl, e.term, count(*) AS tf FROM e JOIN qt ON e.term = qt.term GROUP BY ALL),
df AS (SELECT term, count(*) AS df FROM h GROUP BY term),
s AS (SELECT h.doc, sum(qt.qtf * ln(1 + (st.n - df.df + 0.5) / (df.df + 0.5)) * h.tf * 2.5 / (h.tf + 1.5 * (0.25 + 0.75 * h.dl / st.avgdl))) AS score
      FROM h JOIN qt USING (term) JOIN df USING (term), st GROUP BY h.doc),
b AS (SELECT doc, score / max(score) OVER () AS score FROM s)"""


def bm25_topk(spark, sf):
    """F24, W23, O03"""
    scores = retrieval.normalized(retrieval.bm25(_docs(spark, sf), _query(spark), "doc", "text"))
    return retrieval.top_k(scores.withColumn("score", F.round("score", 6)), ["query"], 20).select("doc", "rank", "score")


BM25_TOPK_SQL = f"WITH {BM25_SQL}, r AS (SELECT doc, round(score, 6) AS score FROM b) SELECT doc, CAST(row_number() OVER (ORDER BY score DESC, doc) AS INT) AS rank, score FROM r QUALIFY rank <= 20"


def bm25_postings(spark, sf):
    """statistics of the index by term."""
    p = retrieval.postings(_docs(spark, sf), "doc", "text")
    return p.groupBy("term").agg(F.count("*").alias("df"), F.sum("tf").alias("cf"), F.max("tf").alias("max_tf"))


BM25_POSTINGS_SQL = f"WITH e AS (SELECT doc_id, unnest({TOKENS}) AS term FROM documents), p AS (SELECT doc_id, term, count(*) AS tf FROM e GROUP BY ALL) SELECT term, count(*) AS df, CAST(sum(tf) AS BIGINT) AS cf, max(tf) AS max_tf FROM p GROUP BY term"


def _knn(spark, sf, k, keep=None, queries="doc % 50 = 0"):
    v = _vectors(spark, sf)
    q = v.where(queries).select(F.col("doc").alias("query"), "vector")
    return retrieval.knn(v, q, k, keep, digits=6)


COS = "list_cosine_similarity(CAST({a} AS DOUBLE[]), CAST({b} AS DOUBLE[]))"
KNN = f"""SELECT q.vec_id AS query, v.vec_id AS doc, round(greatest(0, {COS.format(a='q.embedding', b='v.embedding')}), 6) AS score FROM embeddings q, embeddings v WHERE q.vec_id % 50 = 0 {{more}}"""


def knn_cosine(spark, sf):
    """O05"""
    return _rounded(_knn(spark, sf, 10))


def _rounded(df):
    return df.select(F.col("query").cast("long").alias("query"), "doc", F.round("score", 6).alias("score"), "rank")


def _knn_sql(k: int, more: str = "") -> str:
    return f"WITH s AS ({KNN.format(more=more)}) SELECT query, doc, score, CAST(row_number() OVER (PARTITION BY query ORDER BY score DESC, doc) AS INT) AS rank FROM s QUALIFY rank <= {k}"


def knn_filtered(spark, sf):
    """The filter reaches the scan."""
    return _rounded(_knn(spark, sf, 10, F.col("label") == 1))


def knn_batch(spark, sf):
    """O06, X04"""
    return _rounded(_knn(spark, sf, 5))


def hybrid_search(spark, sf):
    """The flagship: F01, F24, W23, O05, J01, F20, O04."""
    k = 5
    vectors = _knn(spark, sf, 2 * k, queries="doc = 0").select(F.lit(0).alias("query"), "doc", F.round("score", 6).alias("score"))
    words = retrieval.normalized(retrieval.bm25(_docs(spark, sf), _query(spark), "doc", "text")).withColumn("score", F.round("score", 6))
    words = retrieval.top_k(words, ["query"], 2 * k).select("query", "doc", "score")
    out = retrieval.hybrid(vectors, words, k)
    return out.select("doc", "rank", F.round("vector_score", 5).alias("vector_score"), F.round("bm25_score", 5).alias("bm25_score"), F.round("score", 5).alias("score"))


HYBRID_SQL = f"""
WITH {BM25_SQL},
w AS (SELECT doc, round(score, 6) AS score FROM b ORDER BY round(score, 6) DESC, doc LIMIT 10),
v AS (SELECT v.vec_id AS doc, round(greatest(0, {COS.format(a='q.embedding', b='v.embedding')}), 6) AS score FROM embeddings q, embeddings v WHERE q.vec_id = 0 ORDER BY score DESC, doc LIMIT 10),
j AS (SELECT coalesce(v.doc, w.doc) AS doc, coalesce(v.score, 0) AS vs, coalesce(w.score, 0) AS bs FROM v FULL JOIN w ON v.doc = w.doc),
f AS (SELECT doc, vs, bs, CASE WHEN vs <= 0 AND bs <= 0 THEN 0 ELSE (CASE WHEN vs > 0 THEN vs * 0.7 ELSE 0 END + CASE WHEN bs > 0 THEN bs * 0.3 ELSE 0 END) / (CASE WHEN vs > 0 THEN 0.7 ELSE 0 END + CASE WHEN bs > 0 THEN 0.3 ELSE 0 END) END AS s FROM j)
SELECT doc, CAST(row_number() OVER (ORDER BY s DESC, doc) AS INT) AS rank, round(vs, 5) AS vector_score, round(bs, 5) AS bm25_score, round(s, 5) AS score FROM f QUALIFY rank <= 5"""


def rrf_fusion(spark, sf):
    """Two ranked lists fused for one probe."""
    vectors = _knn(spark, sf, 40, queries="doc = 0").select("doc", F.lit("semantic").alias("strategy"), F.round("score", 6).alias("score"))
    words = retrieval.normalized(retrieval.bm25(_docs(spark, sf), _query(spark), "doc", "text")).withColumn("score", F.round("score", 6))
    words = retrieval.top_k(words, ["query"], 40).select("doc", F.lit("bm25").alias("strategy"), "score")
    lists = vectors.unionByName(words).select(
        F.lit("p1").alias("probe_id"), "strategy", "doc", "score", F.lit(0.2).alias("path_score"), F.when(F.col("strategy") == "semantic", F.col("score")).otherwise(0.0).alias("semantic_score"),
        F.when(F.col("strategy") == "bm25", F.col("score")).otherwise(0.0).alias("lexical_score"),
    )
    probes = spark.createDataFrame([("p1", "security", QUERY)], "probe_id string, category string, query string")
    return retrieval.fuse(lists, probes).select("doc", F.array_join("strategies", ",").alias("strategies"), F.round("rrf", 8).alias("rrf"), F.round("final_score", 6).alias("final_score"))


RRF_SQL = f"""
WITH {BM25_SQL},
w AS (SELECT doc, round(score, 6) AS score, row_number() OVER (ORDER BY round(score, 6) DESC, doc) AS r FROM b QUALIFY r <= 40),
v0 AS (SELECT v.vec_id AS doc, round(greatest(0, {COS.format(a='q.embedding', b='v.embedding')}), 6) AS score FROM embeddings q, embeddings v WHERE q.vec_id = 0),
v AS (SELECT doc, score, row_number() OVER (ORDER BY score DESC, doc) AS r FROM v0 QUALIFY r <= 40),
l AS (SELECT doc, 'semantic' AS s, 0.3 / (60 + r) AS p, score AS sem, 0.0 AS lex FROM v UNION ALL SELECT doc, 'bm25', 0.3 / (60 + r), 0.0, score FROM w)
SELECT doc, string_agg(s, ',' ORDER BY s) AS strategies, round(sum(p), 8) AS rrf, round(sum(p) + greatest(-0.12, least(0.18, 0.05 + least(max(sem), 1.0) * 0.02 + least(max(lex), 1.0) * 0.02)), 6) AS final_score FROM l GROUP BY doc"""


def select_diverse(spark, sf):
    """The best ten documents of each language by length, at most five of a source."""
    rows = table(spark, sf, "documents").select("lang", "source", F.col("doc_id").alias("doc"), F.col("n_chars").alias("score"))
    return retrieval.diverse(rows, ["lang"], "source", 10).select("lang", "source", "doc", "score", "rank")


DIVERSE_SQL = """
WITH g AS (SELECT lang, source, doc_id AS doc, n_chars AS score, row_number() OVER (PARTITION BY lang, source ORDER BY n_chars DESC, doc_id) AS g FROM documents)
SELECT lang, source, doc, score, CAST(row_number() OVER (PARTITION BY lang ORDER BY g > 5, score DESC, doc) AS INT) AS rank FROM g QUALIFY rank <= 10"""


def ranking_scores(spark, sf):
    """Lexical share and path prior of each document's own path."""
    d = _docs(spark, sf).withColumn("path", F.concat_ws("/", "source", "lang", F.concat(F.col("doc").cast("string"), F.lit(".py"))))
    s = T.lexical_score(F.lit(QUERY), F.lower(F.left("text", F.lit(4000)))) + T.source_path_score(F.col("path"))
    return d.select("doc", F.round(s, 6).alias("score"))


RANKING_SQL = f"""
WITH q AS (SELECT list_filter(list_distinct(list_transform(regexp_extract_all('{QUERY}', '[A-Za-z0-9_/.:-]+'), lambda x: lower(x))), lambda x: length(x) >= 3 AND x NOT IN ('the')) AS t)
SELECT doc_id AS doc, round(least(len(list_filter(t, lambda x: contains(lower(left(text, 4000)), x))) / len(t), 1.0) * 0.35 + 0.15, 6) AS score FROM documents, q"""


def doc_chunks_512(spark, sf):
    """W12, W06, F05"""
    c = chunking.split_documents(_docs(spark, sf), ["doc", "source"], "text")
    return c.select("doc", "chunk_index", "total_chunks", T.kb_chunk_id(F.col("source"), F.col("chunk_index"), F.col("content")).alias("chunk_id"), F.length("content").alias("chars"))


DOC_CHUNKS_SQL = """
WITH t AS (SELECT doc_id AS doc, source, regexp_extract_all(text, '[^\\s\\x0b]+') AS t FROM documents),
s AS (SELECT doc, source, t, unnest(range(0, greatest(len(t) - 51, 0) + 1, 462)) AS s, len(range(0, greatest(len(t) - 51, 0) + 1, 462)) AS n FROM t WHERE len(t) > 0),
c AS (SELECT doc, source, CAST(s / 462 AS INT) AS chunk_index, CAST(n AS INT) AS total_chunks, array_to_string(t[s + 1:s + 512], ' ') AS content FROM s)
SELECT doc, chunk_index, total_chunks, regexp_replace(lower(source), '[^a-z0-9]+', '-', 'g') || '-' || chunk_index || '-' || left(sha256(content), 12) AS chunk_id, CAST(length(content) AS INT) AS chars FROM c"""


def line_chunks_60(spark, sf):
    """W13, W06"""
    c = chunking.line_windows(_docs(spark, sf), ["doc"], "text")
    return c.select("doc", "chunk_index", "line_start", "line_end", F.md5("content").alias("content_md5"))


LINE_CHUNKS_SQL = """
WITH l AS (SELECT doc_id AS doc, string_split(text, chr(10)) AS l0 FROM documents), t AS (SELECT doc, CASE WHEN l0[-1] = '' THEN l0[1:len(l0) - 1] ELSE l0 END AS l FROM l),
s AS (SELECT doc, l, unnest(range(1, greatest(len(l) - 10, 1) + 1, 50)) AS s FROM t WHERE len(l) > 0)
SELECT doc, CAST((s - 1) / 50 AS INT) AS chunk_index, CAST(s AS INT) AS line_start, CAST(least(s + 59, len(l)) AS INT) AS line_end, md5(array_to_string(l[s:least(s + 59, len(l))], chr(10))) AS content_md5 FROM s"""


def content_cache_ids(spark, sf):
    """W05, F06"""
    d = table(spark, sf, "documents").select("doc_id", F.concat_ws("/", "source", "lang").alias("file_path"), F.sha2("text", 256).alias("content_hash"))
    d = chunking.occurrence_index(d, "doc_id")
    gen = T.index_generation_key(T.repo_branch_key(F.lit("repo"), F.lit("main")), F.lit("c0ffee"))
    return d.select("doc_id", "occurrence_index", T.embedding_cache_id(gen, F.col("file_path"), F.col("content_hash"), F.col("occurrence_index"), "local", "m", "1", 64, "v1").alias("cache_id"))


CACHE_IDS_SQL = """
WITH g AS (SELECT sha256(sha256('repo' || chr(0) || 'main') || chr(0) || 'c0ffee') AS gen),
d AS (SELECT doc_id, source || '/' || lang AS p, sha256(text) AS h FROM documents), o AS (SELECT doc_id, p, h, CAST(row_number() OVER (PARTITION BY p, h ORDER BY doc_id) - 1 AS INT) AS occurrence_index FROM d)
SELECT doc_id, occurrence_index, sha256(gen || chr(0) || p || chr(0) || h || chr(0) || occurrence_index || chr(0) || 'local' || chr(0) || 'm' || chr(0) || '1' || chr(0) || '64' || chr(0) || 'v1') AS cache_id FROM o, g"""


def cache_split(spark, sf):
    """Documents of even ids were indexed with those of ids divisible by three."""
    d = table(spark, sf, "documents").select("doc_id", F.sha2("text", 256).alias("cache_id"))
    return chunking.cache_split(d.where("doc_id % 2 = 0"), d.where("doc_id % 3 = 0")).groupBy("action").agg(F.count("*").alias("n"))


CACHE_SPLIT_SQL = """
WITH d AS (SELECT doc_id, sha256(text) AS h FROM documents), c AS (SELECT DISTINCT h FROM d WHERE doc_id % 2 = 0), e AS (SELECT DISTINCT h FROM d WHERE doc_id % 3 = 0)
SELECT CASE WHEN c.h IS NOT NULL AND e.h IS NOT NULL THEN 'reuse' WHEN c.h IS NOT NULL THEN 'embed' ELSE 'prune' END AS action, count(*) AS n FROM c FULL JOIN e ON c.h = e.h GROUP BY 1"""


def secret_filter(spark, sf):
    """P08"""
    d = table(spark, sf, "documents")
    return d.groupBy("lang").agg(F.count("*").alias("docs"), F.count_if(T.has_secret(F.col("text"))).alias("secret"))


SECRET_SQL = r"""
SELECT lang, count(*) AS docs, count(*) FILTER (WHERE contains(text, 'PRIVATE KEY-----') OR regexp_matches(text, '\bAKIA[0-9A-Z]{16}\b') OR regexp_matches(text, '\bghp_[A-Za-z0-9_]{30,}\b') OR regexp_matches(text, '\bxox[baprs]-[A-Za-z0-9-]{20,}\b')
  OR regexp_matches(text, '\bsk-[A-Za-z0-9]{32,}\b') OR regexp_matches(text, '\b(api[_-]?key|secret|password|token)\b\s*[:=]\s*[''"][^''"]{24,}', 'i')) AS secret FROM documents GROUP BY lang"""


def token_counts(spark, sf):
    """F01 - F04"""
    t = F.col("text")
    return table(spark, sf, "documents").select("doc_id", F.size(T.tokenize(t)).alias("keyword_tokens"), T.estimated_tokens(t).alias("plain_tokens"), F.length(T.truncate_embedding_text(t, 64)).alias("cut_chars"))


TOKEN_COUNTS_SQL = r"""
WITH d AS (SELECT doc_id, text, regexp_extract_all(text, '[^\s\x0b]+') AS p, regexp_extract_all(left(text, 384), '[^\s\x0b]+') AS c FROM documents)
SELECT doc_id, CAST(len(regexp_extract_all(text, '[a-zA-Z0-9_]+')) AS INT) AS keyword_tokens, CAST(greatest(1, len(p)) AS INT) AS plain_tokens,
       CAST(length(CASE WHEN len(c) > 64 THEN array_to_string(c[1:64], ' ') ELSE left(text, 384) END) AS INT) AS cut_chars FROM d"""


def unicode_tokens(spark, sf):
    """F02, by Unicode."""
    return table(spark, sf, "documents").select("doc_id", T.count_tokens(F.col("text")).alias("tokens"))


UNICODE_SQL = r"SELECT doc_id, CAST(len(regexp_extract_all(text, '[\p{L}\p{M}\p{Nd}\p{Pc}\p{Nl}]+|[^\p{L}\p{M}\p{Nd}\p{Pc}\p{Nl}\s\x0b\x85\p{Z}]')) AS INT) AS tokens FROM documents"


def token_batches(spark, sf):
    """Documents of a source in order, 16 items or 12,000 tokens in a batch."""
    d = table(spark, sf, "documents").select("source", "doc_id", F.floor(F.col("n_chars") / 4).cast("long").alias("tokens"))
    return chunking.token_batches(d, "source", ["doc_id"], "tokens", 16, 12_000).select("source", "doc_id", "batch")


TOKEN_BATCHES_SQL = """
WITH RECURSIVE o AS (SELECT source, doc_id, least(greatest(n_chars // 4, 1), 12000) AS t, row_number() OVER (PARTITION BY source ORDER BY doc_id) AS k FROM documents),
f AS (SELECT source, doc_id, k, 0 AS batch, 1 AS n, t AS total FROM o WHERE k = 1
      UNION ALL SELECT o.source, o.doc_id, o.k, CASE WHEN f.n >= 16 OR f.total + o.t > 12000 THEN f.batch + 1 ELSE f.batch END, CASE WHEN f.n >= 16 OR f.total + o.t > 12000 THEN 1 ELSE f.n + 1 END,
             CASE WHEN f.n >= 16 OR f.total + o.t > 12000 THEN o.t ELSE f.total + o.t END FROM f JOIN o ON o.source = f.source AND o.k = f.k + 1)
SELECT source, doc_id, CAST(batch AS INT) AS batch FROM f"""


#: Chunks of code, and the probes of their syntax tree that they match. The first is taken as another language's.
SNIPPETS = [
    ("requests.get(url)", []),
    ('cursor.execute(f"select {x}")', []),
    ("import subprocess\nsubprocess.run(cmd, shell=True)", []),
    ("requests.get(url)", []),
    ("item = repo.get_by_id(item_id)  # current_user", []),
    ('@router.get("/report")\ndef report(user=Depends(get_current_user)):\n    return 1', []),
    ('@router.get("/report")\ndef report(user=Depends(get_current_user)):\n    require_admin(user)', []),
    ("for k, v in payload.items():\n    setattr(user, k, v)", []),
    ("class User(BaseModel):\n    is_admin: bool = False", []),
    ('import jwt\njwt.decode(raw, key, algorithms=["none"])', ["security.jwt_algorithm_allowlist"]),
    ("import jwt\njwt.decode(raw, key, algorithms=[settings.ALGORITHM])", []),
    ('logger.info("x %s", user.password)', ["security.sensitive_data_logging"]),
    ('logger.info("password changed")', []),
    ('log.warning("x", extra=data.get("API_KEY"))', ["security.sensitive_data_logging"]),
    ("def save(f: UploadFile):\n    out.write(f.file.read())", ["security.unrestricted_file_upload"]),
    ("def save(f: UploadFile):\n    return f.filename", []),
    ("class ItemResponse(BaseModel):\n    cost_price: float", []),
    ("class ItemResponses(BaseModel):\n    cost_price: float", []),
    ("token = random.choice(letters)", []),
    ("color = random.choice(letters)", []),
    ("def go(next_url):\n    return RedirectResponse(url=next_url)", []),
    ('def go(next_url):\n    if not next_url.startswith("//") and "backslash":\n        return RedirectResponse(url=next_url)', []),
    ("def apply(item, delta):\n    item.quantity += delta", []),
    ("def apply(item, delta):\n    new_quantity = item.quantity + delta\n    if new_quantity < 0:\n        raise ValueError\n    quantity = item.quantity + delta", []),
    ("digest = hashlib.md5(password.encode())", []),
    ('redis.set("reset:" + token, user_id)', []),
    ("data = jwt.decode(refresh_token, key)", ["security.jwt_algorithm_allowlist"]),
    ('def logout():\n    return {"success": True}', []),
    ("item = repo.get_by_sku(s)\nstock_left = item.stock - n\nrepo.update_stock(s, stock_left)", []),
    ("try:\n    session.commit()\nexcept ValueError:\n    pass", []),
    ("for o in orders:\n    repo.get_by_id(o)", ["performance.n_plus_one"]),
    ("rows = repo.get_by_ids(orders)", []),
    ("rows = session.query(Item).all()\nfiltered_rows = [p for p in rows]", []),
    ("def engine():\n    return create_engine(dsn)", []),
    ("send(otp)", []),
    ('api_key = os.getenv("API_KEY") or "changeme"', []),
    ("@shared_task\ndef run():\n    pass", []),
    ("@shared_task(soft_time_limit=3)\ndef run():\n    pass", []),
    ("if not webhook_log.exists(key):\n    db.add(row)", []),
    ("x = 1", []),
    ('def broken(:\n    logger.warning("p", password)', ["security.sensitive_data_logging"]),
    ('jwt.decode(x, "none"', ["security.jwt_algorithm_allowlist"]),
    ("uploadfile multipart ( .write(", ["security.unrestricted_file_upload"]),
]


def structural_flags(spark, sf):
    """Each document with one of SNIPPETS: a word of it inside, its whole text as a comment behind; how many match each of the probes."""
    n = F.lit(len(SNIPPETS))
    d = table(spark, sf, "documents").select("doc_id", F.regexp_replace("text", "[\\x00-\\x1F]+", " ").alias("t"))
    snippet = F.get(F.array(*[F.lit(t) for t, _ in SNIPPETS]), (F.col("doc_id") % n).cast("int"))
    word = F.regexp_extract(F.lower("t"), "[a-z]+", 0)
    text = F.concat(F.regexp_replace(snippet, F.lit("^([^\n]*)"), F.concat(F.lit("$1  # "), word)), F.lit("\n# "), "t")
    rows = matchers.matched_probes(d.select("doc_id", F.when(F.col("doc_id") % n == 0, "java").otherwise("python").alias("language"), text.alias("chunk_text")))
    each = rows.select(F.explode_outer("_probes").alias("probe_id"), "doc_id").where("probe_id is not null")  # for the inner form Spark computes the probes once more
    return each.groupBy("probe_id").agg(F.count("*").alias("documents"), F.sum("doc_id").alias("ids"))


PATHS = ["README.md", "tests/a.py", "docs/guide.rst", "main.py", "Readme.", "readme.de.txt", "test/conf.py", "lib/notes.md", "test_b.py", "x/readme"]


def path_normalize(spark, sf):
    """Each page's url as a folder, and in it one of PATHS."""
    name = F.get(F.array(*[F.lit(x) for x in PATHS]), (F.col("page_id") % len(PATHS)).cast("int"))
    p = F.concat(F.lit("./src\\"), F.regexp_replace("url", "^[a-z]+://", ""), F.lit("/"), name)
    d = table(spark, sf, "pages").select("page_id", p.alias("p"))
    return d.select("page_id", T.normalize_path(F.col("p")).alias("path"), T.module_name(F.col("p")).alias("module"), T.is_review_target(F.col("p")).alias("target"), T.is_non_runtime(F.col("p")).alias("non_runtime"))


PATH_SQL = rf"""
WITH d AS (SELECT page_id, replace('./src\' || regexp_replace(url, '^[a-z]+://', '') || '/' || (ARRAY{PATHS})[page_id % {len(PATHS)} + 1], '\', '/') AS p FROM pages),
n AS (SELECT page_id, p, string_split(regexp_replace(trim(p), '^(\./)+', ''), '/') AS parts, string_split(p, '/') AS raw FROM d)
SELECT page_id, array_to_string(list_filter(parts, lambda x: x <> '' AND x <> '.'), '/') AS path, coalesce(nullif(raw[len(raw) - 1], ''), 'root') AS module,
       NOT regexp_matches(lower(raw[-1]), '^readme$|^readme[.](.*[.])?(adoc|markdown|md|rst|txt)$') AS target,
       regexp_matches(lower(p), '/tests/|/test/|/docs/') OR regexp_matches(lower(raw[-1]), '^test_|\.(md|rst)$') AS non_runtime FROM n"""


def jaccard_queries(spark, sf):
    """Likeness of each turn's words to those of the turn before."""
    from pyspark.sql import Window

    c = table(spark, sf, "conversations").select("conv_id", "turn", F.array_distinct(T.tokenize(F.col("text"))).alias("t"))
    w = Window.partitionBy("conv_id").orderBy("turn")
    c = c.withColumn("p", F.lag("t").over(w)).where("p is not null")
    return c.select("conv_id", "turn", F.round(T.jaccard(F.col("t"), F.col("p")), 6).alias("likeness"))


JACCARD_SQL = """
WITH c AS (SELECT conv_id, turn, list_distinct(list_transform(regexp_extract_all(text, '[a-zA-Z0-9_]+'), lambda x: lower(x))) AS t FROM conversations),
w AS (SELECT conv_id, turn, t, lag(t) OVER (PARTITION BY conv_id ORDER BY turn) AS p FROM c)
SELECT conv_id, turn, round(CASE WHEN len(list_distinct(list_concat(t, p))) = 0 THEN 1.0 ELSE len(list_intersect(t, p)) / len(list_distinct(list_concat(t, p))) END, 6) AS likeness FROM w WHERE p IS NOT NULL"""


def json_lenient(spark, sf):
    """Numbers out of JSON text; what doesn't parse counts as 0."""
    from scryline.functions.scalars import safe_int

    k = safe_int(F.get_json_object("props", "$.k"))
    return table(spark, sf, "events").groupBy("event_type").agg(F.count("*").alias("n"), F.sum(k).alias("k"), F.max(k).alias("k_max"))


JSON_SQL = "SELECT event_type, count(*) AS n, CAST(sum(coalesce(try_cast(json_extract_string(props, '$.k') AS BIGINT), 0)) AS BIGINT) AS k, max(coalesce(try_cast(json_extract_string(props, '$.k') AS BIGINT), 0)) AS k_max FROM events GROUP BY event_type"


def select_candidates(spark, sf):
    """Greedy selection for each language as a probe (checked against a brute-force model in the tests)."""
    d = table(spark, sf, "documents").select(
        F.col("lang").alias("probe_id"), F.element_at(F.array(F.lit("structural"), F.lit("lexical"), F.lit("semantic")), (F.col("doc_id") % 3 + 1).cast("int")).alias("strategy"), F.concat(F.lit("m"), (F.col("doc_id") % 40).cast("string")).alias("file_path"),
        (F.col("doc_id") % 1000).cast("int").alias("chunk_index"), (F.col("doc_id") % 50).cast("int").alias("line_start"), (F.col("doc_id") % 50 + F.col("n_chars") % 9).cast("int").alias("line_end"), (F.col("n_chars") % 997 / 997.0).alias("score"),
    )
    best = retrieval.top_k(d, ["probe_id", "strategy"], 50, tie="chunk_index").drop("rank")  # 50 hits of each list, as in production
    return greedy.select_candidates(best, 8)


def source_chunks(spark, sf):
    """Documents as plain files cut by tokens."""
    f = table(spark, sf, "documents").select(F.concat_ws("/", "source", "lang", F.concat(F.col("doc_id").cast("string"), F.lit(".txt"))).alias("file_path"), F.lit("text").alias("language"), "text")
    return chunking.chunk_sources(f).select("file_path", "chunk_index", "total_chunks", "line_start", "line_end", "token_count")


def metadata_filter(spark, sf):
    """The predicate over a metadata map."""
    d = table(spark, sf, "documents").select("doc_id", F.create_map(F.lit("lang"), F.col("lang"), F.lit("source"), F.col("source")).alias("metadata"))
    return d.where(store.metadata_filter(F.col("metadata"), {"lang": ["en", "fr"], "source": "src1", "weeks": None})).select("doc_id")


METADATA_SQL = "SELECT doc_id FROM documents WHERE lang IN ('en', 'fr') AND source = 'src1'"


def adjacent_chunks(spark, sf):
    """Neighbours of the first chunks of each document with an id below 50."""
    c = chunking.line_windows(_docs(spark, sf), ["doc"], "text").select(F.col("doc").cast("string").alias("file_path"), "chunk_index", "line_start")
    a = c.where("chunk_index = 0 or chunk_index = 2").select(F.lit("p").alias("probe_id"), "file_path", "chunk_index", F.when(F.col("chunk_index") == 0, 0).otherwise(1).alias("anchor_rank"))
    return ranges.adjacent(a, c).select("file_path", "chunk_index", F.round("bonus", 6).alias("bonus"))


ADJACENT_SQL = f"""
WITH c AS (SELECT CAST(doc AS VARCHAR) AS file_path, chunk_index FROM ({LINE_CHUNKS_SQL})), a AS (SELECT file_path, chunk_index, CASE WHEN chunk_index = 0 THEN 0 ELSE 1 END AS r FROM c WHERE chunk_index IN (0, 2)),
n AS (SELECT file_path, chunk_index + d AS chunk_index, max(r) AS r FROM a, (VALUES (-1), (1)) v(d) GROUP BY ALL)
SELECT n.file_path, n.chunk_index, round(2.0 / (n.r + 1), 6) AS bonus FROM n JOIN c USING (file_path, chunk_index) WHERE NOT EXISTS (SELECT 1 FROM a WHERE a.file_path = n.file_path AND a.chunk_index = n.chunk_index)"""


def symbol_related(spark, sf):
    """Conversations that mention a capitalised word of every fiftieth one."""
    c = table(spark, sf, "conversations").select(F.col("conv_id").cast("string").alias("file_path"), F.col("turn").alias("chunk_index"), "text")
    a = c.where("file_path % 50 = 0").select(F.lit("p").alias("probe_id"), F.col("file_path").cast("int").alias("anchor_rank"), F.col("text").alias("content"))
    return ranges.symbol_related(a, c, "text").select("file_path", "chunk_index", F.round("priority", 6).alias("priority"))


SYMBOL_SQL = r"""
WITH c AS (SELECT CAST(conv_id AS VARCHAR) AS file_path, turn AS chunk_index, text FROM conversations),
a AS (SELECT CAST(file_path AS INT) AS r, list_concat(regexp_extract_all(text, '([A-Za-z_][A-Za-z0-9_]*)\s*\(', 1), list_filter(regexp_extract_all(text, '[\p{L}\p{M}\p{N}_]+'), lambda x: regexp_full_match(x, '[A-Z][A-Za-z0-9_]+'))) AS names FROM c WHERE CAST(file_path AS INT) % 50 = 0),
s AS (SELECT r, lower(unnest(names)) AS word FROM a), p AS (SELECT word, 2.0 / (min(r) + 1) AS p FROM s WHERE word NOT IN ('apirouter', 'asyncsession', 'basemodel', 'depends', 'dict', 'false', 'float', 'get', 'int', 'len', 'list', 'max', 'min', 'none', 'post', 'print', 'put', 'str', 'sum', 'super', 'token', 'true', 'user') GROUP BY word),
w AS (SELECT DISTINCT file_path, chunk_index, unnest(regexp_extract_all(lower(text), '[\p{L}\p{M}\p{N}_]+')) AS word FROM c)
SELECT file_path, chunk_index, round(max(p), 6) AS priority FROM w JOIN p USING (word) GROUP BY ALL"""


def _structural_sql() -> str:
    """The text probes in SQL, written from their definitions."""
    has = lambda *t: "(" + " OR ".join(f"contains(c, '{x.replace(chr(39), chr(39) * 2)}')" for x in t) + ")"
    rx = lambda p: f"regexp_matches(c, '{p}')"
    built = ('f"', "f'", ".format(")
    probes = {
        "security.sql_nosql_injection": f"{has('execute(', 'from_statement(', 'raw(')} AND {has(*built, ' + ')}",
        "security.command_injection": f"{has('subprocess', 'os.system', 'popen(')} AND {has('shell=true', *built)}",
        "security.ssrf_external_calls": f"{has('httpx', 'requests.', 'client.get(', 'axios', 'fetch(')} AND {has('url', 'uri', 'webhook')}",
        "security.object_authorization": f"{has('current_user')} AND {has('get_by_id')} AND {has('_id', 'id:')}",
        "security.role_authorization": f"{has('@router.')} AND {has('get_current_user')} AND {has('admin', 'cost_price', 'margin', 'profit', 'report')} AND NOT {has('require_admin', 'require_role', 'is_admin', 'check_permission', 'has_permission')}",
        "security.mass_assignment": f"({has('setattr(')} AND {has('payload', '.items()', 'model_dump(', 'dict')}) OR ({rx(r'\b(cost_price|is_admin|is_active|owner_id|role)\b')} AND {has('basemodel', 'model_dump(')})",
        "security.insecure_randomness": f"{has('token', 'secret', 'password', 'credential', 'nonce')} AND {has('random.seed(', 'random.choice(', 'random.randint(', 'random.random(')}",
        "security.open_redirect": f"{has('redirectresponse(')} AND {has('url=')} AND {has('next', 'redirect', 'return_url')} AND NOT ({has('startswith(')} AND {has('//')} AND {has(chr(92) * 2, 'backslash')})",
        "security.sensitive_response_exposure": f"{has('cost_price', 'hashed_password', 'private_key', 'profit', 'margin')} AND {has('basemodel')} AND {rx(r'class\s+[a-z0-9_]*response\b')}",
        "security.weak_password_hash": f"{has('password')} AND {has('md5(', 'sha1(')}",
        "security.reset_token_lifecycle": f"{has('reset')} AND {has('token')} AND {has('redis.set(', '.set(', 'setex(')}",
        "security.refresh_token_validation": f"{has('refresh')} AND {has('jwt', 'decode(', 'token')}",
        "security.logout_revocation": f"{has('logout')} AND {has('revoke', 'blacklist', 'success')}",
        "security.otp_exposure_rate_limit": has("otp", "verification_code", "one_time_password", "one_time"),
        "security.insecure_default_credentials": f"{has('password', 'secret', 'api_key', 'token')} AND {has('getenv(', 'field(default=', ' or ' + chr(34))}",
        "bug.async_concurrency": f"{has('stock', 'inventory', 'quantity')} AND {has('get_by_', 'select(')} AND {has('update_')} AND {rx(r'=\s*[a-z_][a-z0-9_.]*\s+-\s+[a-z_]')}",
        "bug.inventory_invariant": f"({rx(r'\bquantity\s*\+=\s*[a-z_]')} OR {rx(r'\bquantity\s*=\s*[a-z0-9_.]+\.quantity\s*\+\s*[a-z_]')}) AND {has('delta')} AND NOT ({rx(r'(?:quantity\s*\+\s*delta|new_quantity)\s*<\s*0')} OR {has('checkconstraint', 'quantity >= 0', 'quantity>=0', 'max(0')})",
        "bug.state_transaction_consistency": f"{has('except')} AND {has('commit(', 'update_', 'create_')}",
        "bug.task_retry_timeout": f"{has('@shared_task', '@celery_app.task', '@app.task')} AND NOT {has('autoretry_for', 'time_limit', 'soft_time_limit', 'self.retry(')}",
        "bug.idempotency_race": f"{has('idempotency', 'webhook')} AND {has('exists(', 'get_by_')} AND {has('create(', 'insert(', 'add(')}",
        "performance.pagination_bounds": f"{has('.all()', 'scalars().all', 'list(')} AND {has('filtered_', '[p for ', '[item for ', 'offset :')}",
        "maintainability.resource_lifecycle": f"{has('create_engine(', 'create_async_engine(')} AND {has('def ')}",
    }
    each = " UNION ALL ".join(f"SELECT '{k}' AS probe_id, doc_id FROM p WHERE {v}" for k, v in probes.items())
    quoted = lambda x: "'" + x.replace("'", "''") + "'"
    n = len(SNIPPETS)
    trees = "".join(f" UNION ALL SELECT '{k}', doc_id FROM p WHERE i IN ({', '.join(map(str, at))})" for k in matchers.TREE_PROBES if (at := [j for j, (_, found) in enumerate(SNIPPETS) if k in found]))
    snippets = f"([{', '.join(quoted(t) for t, _ in SNIPPETS)}])[doc_id % {n} + 1]"
    return f"""WITH d AS (SELECT doc_id, regexp_replace(text, '[\\x00-\\x1F]+', ' ', 'g') AS t FROM documents),
p AS (SELECT doc_id, doc_id % {n} AS i, lower(regexp_replace({snippets}, '^([^\n]*)', '\\1  # ' || regexp_extract(lower(t), '[a-z]+')) || chr(10) || '# ' || t) AS c FROM d WHERE doc_id % {n} > 0),
m AS ({each + trees}) SELECT probe_id, count(*) AS documents, CAST(sum(doc_id) AS BIGINT) AS ids FROM m GROUP BY probe_id"""


QUERIES = {
    "hybrid_search": (hybrid_search, HYBRID_SQL),
    "bm25_topk": (bm25_topk, BM25_TOPK_SQL),
    "bm25_postings": (bm25_postings, BM25_POSTINGS_SQL),
    "knn_cosine": (knn_cosine, _knn_sql(10)),
    "knn_filtered": (knn_filtered, _knn_sql(10, "AND v.label = 1")),
    "knn_batch": (knn_batch, _knn_sql(5)),
    "rrf_fusion": (rrf_fusion, RRF_SQL),
    "select_diverse": (select_diverse, DIVERSE_SQL),
    "ranking_scores": (ranking_scores, RANKING_SQL),
    "doc_chunks_512": (doc_chunks_512, DOC_CHUNKS_SQL),
    "line_chunks_60": (line_chunks_60, LINE_CHUNKS_SQL),
    "content_cache_ids": (content_cache_ids, CACHE_IDS_SQL),
    "cache_split": (cache_split, CACHE_SPLIT_SQL),
    "secret_filter": (secret_filter, SECRET_SQL),
    "token_counts": (token_counts, TOKEN_COUNTS_SQL),
    "unicode_tokens": (unicode_tokens, UNICODE_SQL),
    "token_batches": (token_batches, TOKEN_BATCHES_SQL),
    "structural_flags": (structural_flags, _structural_sql()),
    "path_normalize": (path_normalize, PATH_SQL),
    "jaccard_queries": (jaccard_queries, JACCARD_SQL),
    "json_lenient": (json_lenient, JSON_SQL),
    "select_candidates": (select_candidates, None),
    "source_chunks": (source_chunks, None),
    "metadata_filter": (metadata_filter, METADATA_SQL),
    "adjacent_chunks": (adjacent_chunks, ADJACENT_SQL),
    "symbol_related": (symbol_related, SYMBOL_SQL),
}
