"""The plug-in surface with plain stand-ins for models, and the flagship query."""

from __future__ import annotations

from pyspark.sql import functions as F

from corpusmill.operators import access as A
from corpusmill.operators import context as X
from corpusmill.operators import plugins as P
from corpusmill.operators import retrieval as R
from corpusmill.plans.registry import CHUNKS, Tables, chunks, query
from corpusmill.plans.retrieval_queries import SCORED, roles, text_queries, vector_queries, vectors
from corpusmill.plans.retrieval_queries import TEXT as TEXT_CTES
from corpusmill.plans.retrieval_queries import ROLES
from corpusmill.workspace import Workspace


@query("SELECT query_id, chunk_id, rank FROM (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, chunk_id) AS rank FROM scored) WHERE rank <= 20 AND score >= 0.3", SCORED)
def b5_threshold_after_cut(t):
    return R.exact_top_k(vectors(t), vector_queries(t), 20, 0.3).select("query_id", "chunk_id", "rank")


def _extractor():
    def fn(paths: list, contents: list) -> list:
        return [{"content": c.decode("utf-8").upper()[:40], "pages": 1, "sections": c.count(b"\n"), "tables": len(p)} for p, c in zip(paths, contents)]

    return fn


@query("SELECT CASE WHEN doc_id % 10 = 0 THEN 'bad' ELSE 'good' END AS state, count(*) AS n, coalesce(sum(CASE WHEN doc_id % 10 <> 0 THEN length(text) - length(replace(text, chr(10), '')) END), 0) AS sections FROM documents GROUP BY 1")
def o2_extract(t):
    d = t("documents").select(F.concat(F.lit("/d/"), F.col("doc_id").cast("string")).alias("path"), F.when(F.col("doc_id") % 10 != 0, F.encode("text", "UTF-8")).alias("content"))
    rows = P.extract(d, _extractor)
    return rows.groupBy(F.when(F.col("error").isNull(), "good").otherwise("bad").alias("state")).agg(F.count("*").alias("n"), F.coalesce(F.sum("extracted.sections"), F.lit(0)).alias("sections"))


def _echo():
    def fn(prompts: list) -> list:
        if any(len(p) % 7 == 0 for p in prompts):
            raise ValueError("length")
        return [f"reply {len(p)}" for p in prompts]

    return fn


@query("SELECT doc_id, CASE WHEN length(text) % 7 <> 0 THEN 'reply ' || length(text) END AS reply, length(text) % 7 = 0 AS failed FROM documents")
def o3_generate(t):
    return P.generate(t("documents"), "doc_id", "text", _echo).select("doc_id", "reply", F.col("error").isNotNull().alias("failed"))


def _length_score():
    def fn(answers: list) -> list:
        return [len(a) % 10 / 10 for a in answers]

    return fn


@query("SELECT doc_id, metric, CASE WHEN metric = 'context_recall' AND doc_id % 3 = 0 THEN 0.0 ELSE length(text) % 10 / 10.0 END::DOUBLE AS score, CASE WHEN metric = 'context_recall' AND doc_id % 3 = 0 THEN 'Skipped' END AS note FROM documents, (SELECT unnest(['faithfulness', 'context_recall']) AS metric)")
def l7_evaluation_batch(t):
    runs = t("documents").select("doc_id", "text", F.when(F.col("doc_id") % 3 != 0, "lang").alias("ground_truth"))
    return P.score(runs, "doc_id", ["text"], {"faithfulness": _length_score, "context_recall": _length_score})


def _by_line(text: str):
    return (x for x in text.split("\n") if x)


@query("SELECT doc_id, count(*) AS chunks, CAST(sum(length(l)) AS BIGINT) AS chars FROM (SELECT doc_id, unnest(string_split(text, chr(10))) AS l FROM documents) WHERE l <> '' GROUP BY 1")
def o4_custom_chunker(t):
    return P.chunk_with(t("documents"), "doc_id", "text", _by_line).groupBy("doc_id").agg(F.count("*").alias("chunks"), F.sum(F.length("content")).cast("long").alias("chars"))


@query("""SELECT query_id, string_agg('[' || rank || '] ' || content || chr(10) || chr(10) || '    Source: ' || folder, chr(10) || chr(10) ORDER BY rank) AS context FROM (
    SELECT query_id, content, folder, row_number() OVER (PARTITION BY query_id ORDER BY round(score, 9) DESC, chunk_id) AS rank FROM bm25 JOIN chunks USING (chunk_id), roles WHERE role = 'user' AND list_contains(folders, folder)) WHERE rank <= 3 GROUP BY 1""", *TEXT_CTES, ROLES)
def answer_contexts(t):
    """For each benchmark text the chunks that answer it best among those a user may read, as a prompt context."""
    user = F.broadcast(roles(t).filter("role = 'user'").select("folders"))
    every = chunks(t).crossJoin(user)
    may = A.before_retrieval(F.col("folder"), F.col("folders"))
    scored = R.bm25(every, R.query_terms(text_queries(t)), readable=may).withColumn("score", F.round("score", 9))
    top = Workspace(t.spark, "answers").keep(R.top_k(scored, 3), "top")
    best = top.join(every.select("chunk_id", "content", "folder"), "chunk_id")
    return X.contexts(best.select("query_id", "rank", "content", F.col("folder").alias("source"), "score"), best.select("query_id").distinct(), max_length=1 << 30)
