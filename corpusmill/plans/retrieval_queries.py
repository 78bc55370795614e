"""Embedding, retrieval, fusion and access queries."""

from __future__ import annotations

import numpy as np
from pyspark.sql import functions as F

from corpusmill.functions.text import terms
from corpusmill.functions.vectors import cosine, normalised
from corpusmill.operators import access as A
from corpusmill.operators import embedding as E
from corpusmill.operators import retrieval as R
from corpusmill.plans.registry import CHUNKS, Tables, chunks, query
from corpusmill.workspace import Workspace

UTC0 = "TIMESTAMP '2024-01-01 00:00:00'"


def vectors(t: Tables):
    return t("embeddings").select(F.col("vec_id").alias("chunk_id"), "embedding", "label")


def vector_queries(t: Tables):
    return t("embeddings").filter("vec_id % 50 = 0").select(F.col("vec_id").alias("query_id"), F.col("embedding").alias("q"))


def text_queries(t: Tables):
    return t("benchmark").select(F.col("item_id").alias("query_id"), F.col("text").alias("query"))


def hashing_model():
    def fn(texts: list[str]) -> np.ndarray:
        return np.array([[len(x), sum(map(ord, x)) % 1000, x.count(" ")] for x in texts], "f4")

    return fn


@query("SELECT chunk_id, 3 AS dimensions, CAST(length(content) AS DOUBLE) AS first FROM chunks", CHUNKS)
def e1_embed_batches(t):
    rows = E.embed(chunks(t), "chunk_id", "content", hashing_model, "hashing")
    return rows.select("chunk_id", "dimensions", F.get("embedding", F.lit(0)).cast("double").alias("first"))


V64 = "list_transform(embedding, lambda x: CAST(x AS DOUBLE))"


@query(f"SELECT vec_id, round(list_sum(list_transform(v, lambda x: x * (1 + vec_id % 3))) / sqrt(list_sum(list_transform(v, lambda x: pow(x * (1 + vec_id % 3), 2)))), 6) AS total FROM (SELECT vec_id, {V64} AS v FROM embeddings)")
def e2_normalise(t):
    scaled = F.transform("embedding", lambda x: x.cast("double") * (1 + F.col("vec_id") % 3))
    return t("embeddings").select("vec_id", F.round(F.aggregate(normalised(scaled), F.lit(0.0), lambda s, x: s + x), 6).alias("total"))


@query(f"SELECT label, dim, round(avg(x), 6) AS x FROM (SELECT label, unnest({V64}) AS x, unnest(range(64)) AS dim FROM embeddings) GROUP BY 1, 2")
def e3_mean_pool(t):
    return E.mean_pooled(t("embeddings"), "label", "embedding").select("label", F.posexplode("pooled").alias("dim", "x")).select("label", F.col("dim").cast("long").alias("dim"), F.round("x", 6).alias("x"))


@query(f"""SELECT doc, span, round(avg(x), 6) AS first FROM (SELECT vec_id % 7 AS doc, vec_id // 7 AS token, {V64}[1] AS x FROM embeddings) JOIN (SELECT unnest([0, 1, 2]) AS span, unnest([0, 4, 10]) AS a, unnest([6, 12, 11]) AS b) ON token >= a AND token < b GROUP BY 1, 2""")
def e4_span_pool(t):
    tokens = t("embeddings").select((F.col("vec_id") % 7).alias("doc"), F.floor(F.col("vec_id") / 7).alias("token"), "embedding")
    docs = t.spark.range(7).select(F.col("id").alias("doc"))
    spans = docs.select("doc", F.explode(F.array(*[F.struct(F.lit(s).alias("span"), F.lit(a).cast("long").alias("start_token"), F.lit(b).cast("long").alias("end_token")) for s, a, b in ((0, 0, 6), (1, 4, 12), (2, 10, 11))])).alias("s")).select("doc", "s.*")
    return E.span_pooled(spans, tokens, "doc", "embedding").select("doc", "span", F.round(F.get("pooled", F.lit(0)), 6).alias("first"))


@query("SELECT chunk_id, content_key, hit, CASE WHEN hit THEN -1 ELSE length(content) END AS v FROM (SELECT chunk_id, content, 'm:' || sha256(content) AS content_key, sha256(content) IN (SELECT sha256(content) FROM chunks WHERE doc_id % 3 = 0) AS hit FROM chunks)", CHUNKS)
def e5_cache_through(t):
    ch = chunks(t)
    cache = ch.filter("doc_id % 3 = 0").select(E.cache_key("m", F.col("content")).alias("cache_key"), F.lit(-1).alias("vector")).distinct()
    rows, _ = E.through_cache(ch, cache, "chunk_id", "content", "m", lambda miss: miss.select("cache_key", F.length("text").alias("vector")))
    return rows.select("chunk_id", F.col("cache_key").alias("content_key"), "hit", F.col("vector").alias("v"))


@query(f"SELECT config_id, qkey, max(cached_at) AS cached_at FROM (SELECT 'cfg' || (doc_id % 4) AS config_id, sha256(lang || (doc_id % 50)) AS qkey, {UTC0} + to_seconds(doc_id) AS cached_at FROM documents) WHERE cached_at + INTERVAL 300 SECOND > {UTC0} + INTERVAL 800 SECOND AND config_id <> 'cfg2' GROUP BY 1, 2")
def e6_live_cache(t):
    start = F.expr(UTC0)
    c = t("documents").select(F.concat(F.lit("cfg"), (F.col("doc_id") % 4).cast("string")).alias("config_id"), F.sha2(F.concat("lang", (F.col("doc_id") % 50).cast("string")), 256).alias("qkey"), (start + F.make_dt_interval(secs=F.col("doc_id"))).cast("timestamp").alias("cached_at"), "doc_id")
    live = E.live_entries(E.invalidated(c, "cfg2"), start + F.make_dt_interval(secs=F.lit(800)), 300, "config_id", "qkey")
    return live.select("config_id", "qkey", "cached_at")


@query("SELECT model, verdict, count(*) AS n FROM (SELECT 'm' || (vec_id % 3) AS model, CASE WHEN vec_id % 11 = 0 THEN 'empty' WHEN (CASE vec_id % 3 WHEN 0 THEN 64 WHEN 1 THEN 32 ELSE 64 END) = 64 THEN 'ok' ELSE 'mismatch' END AS verdict FROM embeddings) GROUP BY 1, 2")
def e7_dimension_audit(t):
    rows = t("embeddings").select(F.concat(F.lit("m"), (F.col("vec_id") % 3).cast("string")).alias("model"), F.when(F.col("vec_id") % 11 != 0, F.col("embedding")).alias("embedding"))
    expected = t.spark.createDataFrame([("m0", 64), ("m1", 32), ("m2", 64)], "model string, expected int")
    return E.dimension_audit(rows, expected, "model", "embedding")


SCORED = f"scored AS (SELECT q.vec_id AS query_id, c.vec_id AS chunk_id, c.label, list_cosine_similarity({V64.replace('embedding', 'q.embedding')}, {V64.replace('embedding', 'c.embedding')}) AS score FROM embeddings q CROSS JOIN embeddings c WHERE q.vec_id % 50 = 0)"


@query(f"SELECT c.vec_id, r.vec_id AS reference, round(list_cosine_similarity({V64.replace('embedding', 'c.embedding')}, {V64.replace('embedding', 'r.embedding')}), 6) AS score FROM embeddings c JOIN (SELECT label, min(vec_id) AS vec_id FROM embeddings GROUP BY 1) m USING (label) JOIN embeddings r ON r.vec_id = m.vec_id")
def f1_cosine(t):
    e = t("embeddings")
    first = e.groupBy("label").agg(F.min_by(F.struct(F.col("vec_id").alias("reference"), F.col("embedding").alias("q")), "vec_id").alias("r")).select("label", "r.*")
    return e.join(first, "label").select("vec_id", "reference", F.round(cosine(F.col("embedding"), F.col("q")), 6).alias("score"))


@query("SELECT query_id, chunk_id, rank, round(score, 6) AS score FROM (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, chunk_id) AS rank FROM scored) WHERE rank <= 10 AND score >= 0.1", SCORED)
def f2_exact_top_k(t):
    return R.exact_top_k(vectors(t), vector_queries(t), 10, 0.1).select("query_id", "chunk_id", "rank", F.round("score", 6).alias("score"))


@query()
def f3_ann_top_k(t):
    return R.ann_top_k(vectors(t), vector_queries(t), 10).select("query_id", "chunk_id", "rank", F.round("score", 6).alias("score"))


TOP20 = "top20 AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, chunk_id) AS rank FROM scored) WHERE rank <= 20)"


@query("SELECT query_id, t.chunk_id, rank, source, '/data/' || source || '/' || doc_id AS file_path FROM top20 t JOIN documents ON doc_id = t.chunk_id % (SELECT count(*) FROM documents)", SCORED, TOP20)
def f4_enrich(t):
    docs = t("documents")
    n = docs.agg(F.count("*").alias("docs"))
    top = R.exact_top_k(vectors(t), vector_queries(t), 20).crossJoin(F.broadcast(n)).withColumn("doc_id", F.col("chunk_id") % F.col("docs"))
    return top.join(docs.select("doc_id", "source"), "doc_id").select("query_id", "chunk_id", "rank", "source", F.concat(F.lit("/data/"), "source", F.lit("/"), F.col("doc_id").cast("string")).alias("file_path"))


@query("SELECT chunk_id, 1.0::DOUBLE AS score FROM chunks WHERE chunk_id IN ('3:0', '17:1', '999:0')", CHUNKS)
def f5_direct_fetch(t):
    return chunks(t).filter(F.col("chunk_id").isin("3:0", "17:1", "999:0")).select("chunk_id", F.lit(1.0).alias("score"))


@query("SELECT query_id, 'label' || label AS source_type, count(*) AS n FROM top20 GROUP BY 1, 2", SCORED, TOP20)
def f6_result_stats(t):
    top = R.exact_top_k(vectors(t), vector_queries(t), 20).join(vectors(t).select("chunk_id", "label"), "chunk_id")
    return top.groupBy("query_id", F.concat(F.lit("label"), F.col("label").cast("string")).alias("source_type")).agg(F.count("*").alias("n"))


BREAK = "'[^a-z0-9äöüßéèáíóúñ]+'"
POSTINGS = f"postings AS (SELECT chunk_id, term, count(*) AS tf, any_value(dl) AS dl FROM (SELECT chunk_id, unnest(w) AS term, len(w) AS dl FROM (SELECT chunk_id, list_filter(string_split_regex(lower(content), {BREAK}), lambda x: x <> '') AS w FROM chunks)) GROUP BY 1, 2)"
SIZES = f"sizes AS (SELECT count(*) AS n, avg(len(list_filter(string_split_regex(lower(content), {BREAK}), lambda x: x <> ''))) AS avgdl FROM chunks)"
WANTED = f"wanted AS (SELECT DISTINCT item_id AS query_id, unnest(list_filter(string_split_regex(lower(text), {BREAK}), lambda x: x <> '')) AS term FROM benchmark)"
BM25 = "bm25 AS (SELECT query_id, chunk_id, sum(ln(1 + (n - df + 0.5::DOUBLE) / (df + 0.5::DOUBLE)) * tf * 2.2::DOUBLE / (tf + 1.2::DOUBLE * (0.25::DOUBLE + 0.75::DOUBLE * dl / avgdl))) AS score FROM postings JOIN (SELECT term, count(*) AS df FROM postings GROUP BY 1) USING (term) JOIN wanted USING (term), sizes GROUP BY 1, 2)"
TEXT = (CHUNKS, POSTINGS, SIZES, WANTED, BM25)


def bm25_scores(t):
    return R.bm25(chunks(t), R.query_terms(text_queries(t)))


def keyword_top_k(t, k):
    return R.bm25_top_k(chunks(t), R.query_terms(text_queries(t)), k)


@query("SELECT query_id, chunk_id, rank, round(score / max(score) OVER (PARTITION BY query_id), 6) AS score FROM (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY round(score, 9) DESC, chunk_id) AS rank FROM bm25) WHERE rank <= 10", *TEXT)
def g1_bm25_top_k(t):
    return R.normalised_by_max(keyword_top_k(t, 10)).select("query_id", "chunk_id", "rank", F.round("score", 6).alias("score"))


@query("SELECT query_id, chunk_id, round(CASE WHEN score > 1 THEN least(score / 10, 1) ELSE score END, 6) AS score FROM bm25", *TEXT)
def g2_damped_scores(t):
    return bm25_scores(t).select("query_id", "chunk_id", F.round(R.damped(F.col("score")), 6).alias("score"))


@query("SELECT DISTINCT query_id, w.term, v.term AS near FROM wanted w JOIN (SELECT DISTINCT term FROM postings) v ON levenshtein(translate(w.term, 'äöüßéèáíóúñ', 'AOUSEFGHIJK'), translate(v.term, 'äöüßéèáíóúñ', 'AOUSEFGHIJK')) <= 1", *TEXT)
def g3_fuzzy_terms(t):
    vocabulary = chunks(t).select(F.explode(terms(F.col("content"))).alias("term")).distinct()
    return R.fuzzy_terms(R.query_terms(text_queries(t)), vocabulary).select("query_id", "term", "near")


@query("SELECT query_id, chunk_id, round(s * 1.5::DOUBLE, 6) AS score FROM (SELECT query_id, chunk_id, score / max(score) OVER (PARTITION BY query_id) AS s FROM bm25) WHERE s >= 0.3", *TEXT)
def g4_threshold_boost(t):
    n = R.shares_of_best(bm25_scores(t)).filter("score >= 0.3")
    return n.select("query_id", "chunk_id", F.round(F.col("score") * 1.5, 6).alias("score"))


@query("""SELECT chunk_id, string_agg(snippet, '|' ORDER BY term_no, pos) AS highlights FROM (
    SELECT chunk_id, term_no, pos, CASE WHEN pos - 1 > 50 THEN '...' ELSE '' END || substr(content, greatest(pos - 50, 1), least(pos - 1 + length(term) + 50, length(content)) - greatest(pos - 51, 0)) || CASE WHEN pos - 1 + length(term) + 50 < length(content) THEN '...' ELSE '' END AS snippet, row_number() OVER (PARTITION BY chunk_id ORDER BY term_no, pos) AS r
    FROM (SELECT chunk_id, content, term, term_no, unnest(range(1, greatest(length(content) - length(term) + 2, 2))) AS pos FROM chunks, (SELECT unnest(['tion', 'le la']) AS term, unnest([0, 1]) AS term_no) WHERE term_no = 0) WHERE substr(lower(content), pos, length(term)) = term) WHERE r <= 3 GROUP BY 1""", CHUNKS)
def g5_highlights(t):
    rows = chunks(t).select("chunk_id", R.highlights(F.col("content"), F.lit("Tion")).alias("h"))
    return rows.filter(F.size("h") > 0).select("chunk_id", F.array_join("h", "|").alias("highlights"))


WORDS = r"""words AS (SELECT word, min((chunk_id, pos)) AS first FROM (SELECT chunk_id, unnest(w) AS word, unnest(range(0, len(w))) AS pos FROM (SELECT chunk_id, regexp_extract_all(content, '[\p{L}\p{N}_]+') AS w FROM chunks)) GROUP BY 1)"""


@query("SELECT word FROM words WHERE starts_with(lower(word), 'wh') ORDER BY first LIMIT 10", CHUNKS, WORDS)
def g6_suggestions(t):
    return R.suggestions(R.term_dictionary(chunks(t)), t.spark.createDataFrame([("wh",)], "prefix string"), 10).select("word")


@query("SELECT prefix, rank, word FROM (SELECT prefix, row_number() OVER (PARTITION BY prefix ORDER BY first, word) AS rank, word FROM (SELECT DISTINCT substr(regexp_extract(text, '[\\p{L}\\p{N}_]+'), 1, 3) AS prefix FROM benchmark) JOIN words ON prefix <> '' AND starts_with(lower(word), lower(prefix))) WHERE rank <= 10", CHUNKS, WORDS)
def g6_prefixes(t):
    """The first three letters of every benchmark text, completed from all chunks in one job."""
    prefixes = t("benchmark").select(F.substring(F.regexp_extract("text", r"([\p{L}\p{N}_]+)", 1), 1, 3).alias("prefix"))
    return R.suggestions(R.term_dictionary(chunks(t)), prefixes, 10)


@query("SELECT item_id AS chunk_id, regexp_extract(' ' || text, '(?i)\\s(th\\S*(\\s+\\S+){0,2})', 1) AS phrase FROM benchmark WHERE regexp_extract(' ' || text, '(?i)\\s(th\\S*(\\s+\\S+){0,2})', 1) <> ''")
def g7_phrases(t):
    return R.phrases(t("benchmark").select(F.col("item_id").alias("chunk_id"), F.col("text").alias("content")), "th")


# Ranked lists to fuse: the 60 nearest of each query under three ways of scoring, so that every list is a full order.
LISTS = """nearest AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, chunk_id) AS r FROM scored) WHERE r <= 60), lists AS (SELECT query_id, s AS source, o AS ordinal, chunk_id, row_number() OVER (PARTITION BY query_id, s ORDER BY sc DESC, chunk_id) AS rank, sc AS score FROM (
    SELECT query_id, chunk_id, 'vector' AS s, 0 AS o, round(score, 9) AS sc FROM nearest WHERE score > 0.15 UNION ALL SELECT query_id, chunk_id, 'keyword', 1, round(score * (1 + chunk_id % 5), 9) FROM nearest WHERE chunk_id % 2 = 0 AND score > 0.1 UNION ALL SELECT query_id, chunk_id, 'graph', 2, round(score * (chunk_id % 3), 9) FROM nearest WHERE chunk_id % 3 <> 1 AND score > 0.2))"""
FUSED = "SELECT query_id, chunk_id, round(f, 6) AS score FROM (SELECT query_id, chunk_id, {agg} AS f FROM lists {where} GROUP BY 1, 2)"


def ranked_lists(t):
    s = Workspace(t.spark, "lists").keep(R.exact_top_k(vectors(t), vector_queries(t), 60).select("query_id", "chunk_id", F.col("score").alias("s")), "nearest")
    one = lambda name, o, rows, score: rows.select("query_id", "chunk_id", F.lit(name).alias("source"), F.lit(o).alias("ordinal"), F.round(score, 9).alias("score"))
    u = one("vector", 0, s.filter("s > 0.15"), F.col("s")).unionByName(one("keyword", 1, s.filter("chunk_id % 2 = 0 and s > 0.1"), F.col("s") * (1 + F.col("chunk_id") % 5))).unionByName(one("graph", 2, s.filter("chunk_id % 3 <> 1 and s > 0.2"), F.col("s") * (F.col("chunk_id") % 3)))
    from pyspark.sql import Window

    return u.withColumn("rank", F.row_number().over(Window.partitionBy("query_id", "source").orderBy(F.col("score").desc(), "chunk_id")))


def _out(df):
    return df.select("query_id", "chunk_id", F.round("score", 6).alias("score"))


@query(FUSED.format(agg="sum(1.0::DOUBLE / (60 + rank))", where=""), SCORED, LISTS)
def h1_rrf(t):
    return _out(R.rrf(ranked_lists(t)))


@query("SELECT query_id, chunk_id, round(sum(w * score / m), 6) AS score FROM (SELECT *, CASE source WHEN 'vector' THEN 0.5 WHEN 'keyword' THEN 0.3 ELSE 0.2 END::DOUBLE AS w, CASE WHEN max(score) OVER (PARTITION BY query_id, source) > 0 THEN max(score) OVER (PARTITION BY query_id, source) ELSE 1 END AS m FROM lists) GROUP BY 1, 2", SCORED, LISTS)
def h2_linear(t):
    return _out(R.linear(ranked_lists(t), {"vector": 0.5, "keyword": 0.3, "graph": 0.2}))


@query(FUSED.format(agg="max(score)", where="WHERE score > 0"), SCORED, LISTS)
def h3_max(t):
    return _out(R.max_fusion(ranked_lists(t)))


@query(FUSED.format(agg="sum(score)", where=""), SCORED, LISTS)
def h4_sum(t):
    return _out(R.sum_fusion(ranked_lists(t)))


@query("SELECT query_id, chunk_id, score FROM (SELECT query_id, chunk_id, round(f, 6) AS score, row_number() OVER (PARTITION BY query_id ORDER BY f DESC, seen, chunk_id) AS rank FROM (SELECT query_id, chunk_id, sum(1.0::DOUBLE / (60 + rank)) AS f, min((ordinal, rank)) AS seen FROM lists WHERE rank <= CASE source WHEN 'graph' THEN 10 ELSE 20 END GROUP BY 1, 2)) WHERE rank <= 10 AND score >= 0.01", SCORED, LISTS)
def h5_hybrid(t):
    wide = ranked_lists(t).filter(F.col("rank") <= F.when(F.col("source") == "graph", 10).otherwise(20))
    return _out(R.hybrid(wide, "rrf", 10, 0.01))


@query("SELECT q AS query_id, chunk_id, score FROM (SELECT q, chunk_id, round(f, 6) AS score, row_number() OVER (PARTITION BY q ORDER BY f DESC, seen, chunk_id) AS rank FROM (SELECT query_id // 150 AS q, chunk_id, sum(1.0::DOUBLE / (60 + rank)) AS f, min((query_id, rank)) AS seen FROM lists WHERE source = 'vector' GROUP BY 1, 2)) WHERE rank <= 15", SCORED, LISTS)
def h6_multi_query(t):
    v = ranked_lists(t).filter("source = 'vector'").withColumn("ordinal", F.col("query_id")).withColumn("query_id", F.floor(F.col("query_id") / 150))
    return _out(R.rrf(v).filter("rank <= 15"))


@query("SELECT query_id, chunk_id, rank, round(score, 6) AS score FROM (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, chunk_id) AS rank FROM (SELECT query_id, chunk_id, max(score) AS score FROM lists GROUP BY 1, 2)) WHERE rank <= 12", SCORED, LISTS)
def h7_simple_merge(t):
    return R.merge_best(ranked_lists(t), 12).select("query_id", "chunk_id", "rank", F.round("score", 6).alias("score"))


@query("SELECT query_id, chunk_id, ordinal AS step FROM (SELECT *, row_number() OVER (PARTITION BY query_id, chunk_id ORDER BY ordinal, rank) AS r FROM lists) WHERE r = 1", SCORED, LISTS)
def h8_first_context(t):
    return R.first_context(ranked_lists(t).withColumn("step", F.col("ordinal"))).select("query_id", "chunk_id", "step")


@query("SELECT query_id, chunk_id, rank FROM top20 WHERE rank <= 10", SCORED, TOP20)
def h9_sources(t):
    return R.exact_top_k(vectors(t), vector_queries(t), 10).select("query_id", "chunk_id", "rank")


@query("SELECT query_id, round(s, 6) AS score, CASE WHEN s >= 0.8 THEN 'highly_relevant' WHEN s >= 0.6 THEN 'relevant' WHEN s >= 0.4 THEN 'partially_relevant' ELSE 'irrelevant' END AS grade, s < 0.6 AS needs_correction FROM (SELECT query_id, least(avg(score * 2), 1) AS s FROM top20 GROUP BY 1)", SCORED, TOP20)
def h10_relevance(t):
    top = R.exact_top_k(vectors(t), vector_queries(t), 20).withColumn("score", F.col("score") * 2)
    return R.relevance(top, vector_queries(t)).withColumn("score", F.round("score", 6))


@query("SELECT c_custkey, CASE c_mktsegment WHEN 'BUILDING' THEN 'keyword' WHEN 'MACHINERY' THEN 'advanced' ELSE 'vector' END AS method FROM customer")
def h11_method(t):
    name = F.when(F.col("c_mktsegment") == "BUILDING", "keyword").when(F.col("c_mktsegment") == "MACHINERY", "hybrid_graph").otherwise("something_else")
    return t("customer").select("c_custkey", R.method_of(name).alias("method"))


# Access -----------------------------------------------------------------------------------------------------------

ROLE_ROWS = [("admin", ["*"]), ("user", [f"src{i}" for i in range(10)]), ("guest", ["src0"]), ("none", [])]
ROLES = "roles AS (SELECT 'admin' AS role, ['*'] AS folders UNION ALL SELECT 'user', ['src0','src1','src2','src3','src4','src5','src6','src7','src8','src9'] UNION ALL SELECT 'guest', ['src0'] UNION ALL SELECT 'none', CAST([] AS VARCHAR[]))"
DOCS = "docs AS (SELECT doc_id, CASE WHEN doc_id % 9 = 0 THEN NULL WHEN doc_id % 10 = 0 THEN '' ELSE source END AS folder, CASE WHEN doc_id % 6 = 0 THEN CAST([] AS VARCHAR[]) ELSE [lang] END AS tags FROM documents)"


def roles(t):
    return t.spark.createDataFrame(ROLE_ROWS, "role string, folders array<string>")


def docs(t):
    folder = F.when(F.col("doc_id") % 9 == 0, F.lit(None)).when(F.col("doc_id") % 10 == 0, F.lit("")).otherwise(F.col("source"))
    return t("documents").select("doc_id", folder.alias("folder"), F.when(F.col("doc_id") % 6 == 0, F.array().cast("array<string>")).otherwise(F.array("lang")).alias("tags"))


@query("SELECT c_custkey, len(coalesce(r.folders, d.folders)) AS n, list_contains(coalesce(r.folders, d.folders), '*') AS everything FROM (SELECT c_custkey, CASE c_custkey % 5 WHEN 0 THEN 'admin' WHEN 1 THEN 'guest' WHEN 2 THEN 'ghost' WHEN 3 THEN NULL ELSE 'none' END AS role FROM customer) LEFT JOIN roles r USING (role), (SELECT folders FROM roles WHERE role = 'user') d", ROLES)
def j1_allowed_folders(t):
    m = F.col("c_custkey") % 5
    users = t("customer").select("c_custkey", F.when(m == 0, "admin").when(m == 1, "guest").when(m == 2, "ghost").when(m == 3, F.lit(None)).otherwise("none").alias("role"))
    return A.allowed_folders(users, roles(t)).select("c_custkey", F.size("folders").cast("long").alias("n"), F.array_contains("folders", "*").alias("everything"))


@query("SELECT role, doc_id FROM docs, roles WHERE list_contains(folders, '*') OR (folder IS NOT NULL AND list_contains(folders, folder))", ROLES, DOCS)
def j2_pre_filter(t):
    return A.visible(docs(t), roles(t)).select("role", "doc_id")


@query("SELECT role, doc_id FROM docs, roles WHERE list_contains(folders, '*') OR folder IS NULL OR folder = '' OR list_contains(folders, folder)", ROLES, DOCS)
def j3_post_filter(t):
    return A.visible(docs(t), roles(t), blank_passes=True).select("role", "doc_id")


@query("SELECT doc_id FROM docs WHERE len(tags) = 0 OR list_has_any(tags, ['de', 'fr'])", DOCS)
def j4_tags(t):
    return docs(t).filter(A.tags_overlap(F.col("tags"), F.array(F.lit("de"), F.lit("fr")))).select("doc_id")


@query("SELECT role, count(*) AS reachable FROM chunks JOIN (SELECT doc_id, folder AS f FROM docs) USING (doc_id), roles WHERE list_contains(folders, '*') OR (f IS NOT NULL AND list_contains(folders, f)) GROUP BY 1", CHUNKS, ROLES, DOCS)
def j5_accessible_chunks(t):
    rows = chunks(t).drop("folder").join(docs(t).select("doc_id", "folder"), "doc_id")
    return A.visible(rows, roles(t)).groupBy("role").agg(F.count("*").alias("reachable"))


@query("SELECT role, coalesce(sum(n), 0) AS documents FROM roles LEFT JOIN (SELECT folder, count(*) AS n FROM docs GROUP BY 1) ON list_contains(folders, '*') OR folder IS NULL OR folder = '' OR list_contains(folders, folder) GROUP BY 1", ROLES, DOCS)
def j6_access_matrix(t):
    return A.access_matrix(roles(t), docs(t).groupBy("folder").agg(F.count("*").alias("n")))
