"""Statistics, evaluation and context queries."""

from __future__ import annotations

from pyspark.sql import functions as F

from corpusmill.operators import context as X
from corpusmill.operators import evaluation as L
from corpusmill.operators import stats as K
from corpusmill.plans.registry import CHUNKS, FILES, JOBS, Tables, chunks, files, jobs, query

START = "TIMESTAMP '2024-01-01 00:00:00'"


@query("SELECT file_type, count(*) AS n FROM (SELECT coalesce(CASE doc_id % 8 WHEN 7 THEN NULL ELSE regexp_extract(path, '\\.([a-z]+)$', 1) END, 'unknown') AS file_type FROM files) GROUP BY 1", FILES)
def k1_files_by_type(t):
    return K.by_type(files(t).withColumn("kind", F.when(F.col("doc_id") % 8 != 7, F.regexp_extract("path", r"\.([a-z]+)$", 1))), "kind")


@query("SELECT job_id, total_files - processed_files - failed_files AS skipped, coalesce(c, 0) AS embeddings, round(CASE WHEN processed_files = 0 THEN 0 ELSE coalesce(c, 0)::DOUBLE / processed_files END, 6) AS avg_chunks_per_file, CASE WHEN status <> 'running' THEN 60.0 * (job_id % 100) END::DOUBLE AS seconds, coalesce(n, 0) AS graph_nodes, coalesce(e, 0) AS graph_edges FROM jobs LEFT JOIN (SELECT doc_id AS job_id, count(*) AS c FROM chunks GROUP BY 1) USING (job_id) LEFT JOIN (SELECT 'cfg' || (c_custkey % 7) AS config_id, count(*) AS n FROM customer GROUP BY 1) USING (config_id) LEFT JOIN (SELECT 'cfg' || (s_suppkey % 7) AS config_id, count(*) AS e FROM supplier GROUP BY 1) USING (config_id)", JOBS, CHUNKS)
def k2_ingestion_stats(t):
    n = chunks(t).groupBy(F.col("doc_id").alias("job_id")).agg(F.count("*").alias("chunks"))
    start = F.col("created_at").cast("timestamp")
    j = jobs(t).withColumns({"started_at": start, "finished_at": F.when(F.col("status") != "running", start + F.make_dt_interval(mins=(F.col("job_id") % 100).cast("int")))})
    of = lambda table, key: t(table).select(F.concat(F.lit("cfg"), (F.col(key) % 7).cast("string")).alias("config_id"))
    return K.ingestion_stats(j, n, of("customer", "c_custkey"), of("supplier", "s_suppkey")).select("job_id", "skipped", "embeddings", F.round("avg_chunks_per_file", 6).alias("avg_chunks_per_file"), "seconds", "graph_nodes", "graph_edges")


@query("SELECT job_id, CASE WHEN total_files = 0 THEN 0 ELSE round(100.0::DOUBLE * processed_files / total_files, 6) END AS progress FROM jobs", JOBS)
def k3_progress(t):
    return K.progress(jobs(t)).select("job_id", "progress")


@query("SELECT l_orderkey AS job_id, count(*) FILTER (l_returnflag <> 'R') AS processed, count(*) FILTER (l_returnflag = 'R') AS failed, CAST(sum(l_linenumber) AS BIGINT) AS chunks, CAST(sum(l_linenumber) AS BIGINT) AS embeddings, CAST(sum(l_linenumber * 2) AS BIGINT) AS nodes, CAST(sum(l_linenumber * 3) AS BIGINT) AS edges, coalesce(string_agg(DISTINCT CASE WHEN l_returnflag = 'R' THEN l_linestatus END, ',' ORDER BY CASE WHEN l_returnflag = 'R' THEN l_linestatus END), '') AS errors FROM lineitem GROUP BY 1")
def k3_outcome_counts(t):
    r = t("lineitem").select(F.col("l_orderkey").alias("job_id"), F.when(F.col("l_returnflag") == "R", "failed").when(F.col("l_returnflag") == "A", "duplicate").otherwise("ok").alias("status"), F.col("l_linenumber").alias("chunks"), F.col("l_linenumber").alias("embeddings"), (F.col("l_linenumber") * 2).alias("nodes"), (F.col("l_linenumber") * 3).alias("edges"), F.col("l_linestatus").alias("error"))
    return K.outcome_counts(r, "job_id").withColumn("errors", F.array_join("errors", ","))


LOG = """log AS (SELECT job_id, level, strftime(stamp, '%Y-%m-%dT%H:%M:%S') AS stamp, message FROM (
    SELECT job_id, 'ERROR' AS level, created_at AS stamp, 'file ' || failed_files || ' failed' AS message FROM jobs WHERE failed_files > 0 UNION ALL SELECT job_id, 'WARNING', created_at, 'partly' FROM jobs WHERE status = 'failed'
    UNION ALL SELECT job_id, 'INFO', created_at, 'started' FROM jobs UNION ALL SELECT job_id, CASE status WHEN 'failed' THEN 'ERROR' ELSE 'INFO' END, created_at + INTERVAL 1 HOUR, 'finished: ' || status FROM jobs WHERE status <> 'running'))"""


def log(t: Tables):
    j = jobs(t).select("job_id", "status", "created_at", F.when(F.col("status") != "running", F.col("created_at") + F.expr("INTERVAL 1 HOUR")).alias("finished_at"), F.when(F.col("failed_files") > 0, F.array(F.concat(F.lit("file "), F.col("failed_files").cast("string"), F.lit(" failed")))).otherwise(F.array().cast("array<string>")).alias("errors"), F.when(F.col("status") == "failed", F.array(F.lit("partly"))).otherwise(F.array().cast("array<string>")).alias("warnings"))
    return K.job_log(j)


@query("SELECT * FROM log", JOBS, LOG)
def k4_job_log(t):
    return log(t)


@query("SELECT *, (SELECT count(*) FROM log WHERE level = 'ERROR') AS total FROM log WHERE level = 'ERROR' ORDER BY stamp DESC, job_id, level, message LIMIT 30 OFFSET 10", JOBS, LOG)
def k4_log_page(t):
    return K.log_page(log(t), "error", 10, 30)


@query("SELECT f.config_id, documents, chunks, job_id FROM (SELECT config_id, count(*) AS documents FROM files GROUP BY 1) f JOIN (SELECT config_id, count(*) AS chunks FROM chunks JOIN (SELECT doc_id, config_id FROM files) USING (doc_id) GROUP BY 1) c USING (config_id) LEFT JOIN (SELECT config_id, arg_max(job_id, (created_at, job_id)) AS job_id FROM jobs GROUP BY 1) j USING (config_id)", FILES, CHUNKS, JOBS)
def k5_config_stats(t):
    from corpusmill.operators.corpus import latest_per

    d = files(t).groupBy("config_id").agg(F.count("*").alias("documents"))
    c = chunks(t).join(files(t).select("doc_id", "config_id"), "doc_id").groupBy("config_id").agg(F.count("*").alias("chunks"))
    j = latest_per(jobs(t).select("config_id", "created_at", "job_id"), "config_id", "created_at", "job_id").select("config_id", "job_id")
    return d.join(c, "config_id").join(j, "config_id", "left")


RUNS = f"runs AS (SELECT source AS config_id, doc_id, {START} + to_minutes(doc_id) AS created_at, quality::DOUBLE AS quality, CASE WHEN doc_id % 5 = 0 THEN NULL ELSE 1.0::DOUBLE - toxic END AS safety, (n_chars % 101)::DOUBLE / 100 AS length FROM labels JOIN documents USING (doc_id))"


def runs(t: Tables):
    d = t("labels").join(t("documents"), "doc_id")
    scores = F.map_filter(F.create_map(F.lit("quality"), F.col("quality").cast("double"), F.lit("safety"), F.when(F.col("doc_id") % 5 != 0, 1.0 - F.col("toxic")), F.lit("length"), (F.col("n_chars") % 101).cast("double") / 100), lambda k, v: v.isNotNull())
    return d.select(F.col("source").alias("config_id"), "doc_id", (F.expr(START) + F.make_dt_interval(mins=F.col("doc_id").cast("int"))).alias("created_at"), scores.alias("scores"))


@query("SELECT config_id, metric, count(*) AS runs, round(round(avg(s), 9), 4) AS mean, count(*) FILTER (s < 0.2) AS b0, count(*) FILTER (s >= 0.2 AND s < 0.4) AS b1, count(*) FILTER (s >= 0.4 AND s < 0.6) AS b2, count(*) FILTER (s >= 0.6 AND s < 0.8) AS b3, count(*) FILTER (s >= 0.8) AS b4, min(created_at) AS first, max(created_at) AS last FROM (SELECT config_id, created_at, 'quality' AS metric, quality AS s FROM runs UNION ALL SELECT config_id, created_at, 'safety', safety FROM runs WHERE safety IS NOT NULL UNION ALL SELECT config_id, created_at, 'length', length FROM runs) GROUP BY 1, 2", RUNS)
def k6_evaluation_summary(t):
    return K.evaluation_summary(runs(t), "config_id", "scores", "created_at")


@query("SELECT doc_id, round((quality + coalesce(safety, 0) + length) / (CASE WHEN safety IS NULL THEN 2 ELSE 3 END), 6) AS average FROM runs", RUNS)
def k7_run_average(t):
    return runs(t).select("doc_id", F.round(K.average_score(F.col("scores")), 6).alias("average"))


@query("SELECT event_type, count(*) AS n, round(sum(value), 4) AS total, round(quantile_cont(value, 0.5), 6) AS p50, round(quantile_cont(value, 0.95), 6) AS p95, round(quantile_cont(value, 0.99), 6) AS p99, count(*) FILTER (value <= 1) AS le_1, count(*) FILTER (value <= 5) AS le_5, count(*) FILTER (value <= 10) AS le_10, count(*) FILTER (value <= 50) AS le_50, count(*) FILTER (value <= 100) AS le_100 FROM events GROUP BY 1")
def k8_request_metrics(t):
    m = K.request_metrics(t("events"), "event_type", "value")
    return m.withColumns({"total": F.round("total", 4)} | {c: F.round(c, 6) for c in ("p50", "p95", "p99")})


@query("""SELECT 'llm_tokens' AS counter, 'provider=' || CASE user_id % 3 WHEN 0 THEN 'unknown' WHEN 1 THEN 'a' ELSE 'b' END || ',type=' || CASE WHEN event_id % 2 = 0 THEN 'prompt' ELSE 'completion' END AS labels, sum(event_id % 100)::DOUBLE AS value FROM events GROUP BY 2
    UNION ALL SELECT 'errors', 'service=' || (user_id % 4) || ',error_type=' || event_type, count(*) FROM events WHERE event_type = 'error' GROUP BY 2 UNION ALL SELECT 'cache_hits', 'cache_type=' || event_type, count(*) FROM events GROUP BY 2""")
def k8_counters(t):
    m = F.col("user_id") % 3
    e = t("events").select("event_type", (F.col("user_id") % 4).alias("service"), F.when(m == 1, "a").when(m == 2, "b").alias("provider"), F.when(F.col("event_id") % 2 == 0, "prompt").otherwise("completion").alias("side"), (F.col("event_id") % 100).alias("tokens"))
    out = K.counters(e, "llm_tokens", {"provider": "provider", "type": "side"}, F.col("tokens"))
    out = out.unionByName(K.counters(e.filter("event_type = 'error'"), "errors", {"service": "service", "error_type": "event_type"}))
    return out.unionByName(K.counters(e, "cache_hits", {"cache_type": "event_type"}))


@query("SELECT metric, CASE WHEN s < 0.2 THEN '0.0-0.2' WHEN s < 0.4 THEN '0.2-0.4' WHEN s < 0.6 THEN '0.4-0.6' WHEN s < 0.8 THEN '0.6-0.8' ELSE '0.8-1.0' END AS bucket, count(*) AS n FROM (SELECT 'quality' AS metric, quality AS s FROM runs UNION ALL SELECT 'safety', safety FROM runs WHERE safety IS NOT NULL UNION ALL SELECT 'length', length FROM runs) GROUP BY 1, 2", RUNS)
def k8_score_histogram(t):
    return K.score_histogram(runs(t).select(F.explode("scores").alias("metric", "score")), "metric", "score")


@query("SELECT user_id, event_type AS action, CAST(json_extract_string(props, '$.k') AS VARCHAR) AS resource, count(*) AS n FROM events GROUP BY 1, 2, 3")
def k9_audit_counts(t):
    return K.audit_counts(t("events").select("user_id", F.col("event_type").alias("action"), F.get_json_object("props", "$.k").alias("resource")))


@query("SELECT p_partkey, p_size + coalesce(n, 0) AS usage_count FROM part LEFT JOIN (SELECT l_partkey AS p_partkey, count(*) AS n FROM lineitem GROUP BY 1) USING (p_partkey)")
def k10_usage_counts(t):
    templates = t("part").select("p_partkey", F.col("p_size").alias("usage_count"))
    return K.usage_counts(templates, t("lineitem").select(F.col("l_partkey").alias("p_partkey")), "p_partkey")


@query("SELECT version, changed, count(*) AS n FROM (SELECT CASE WHEN v = '' OR v LIKE '1.%' THEN '2.0.0' ELSE v END AS version, concat_ws(',', CASE WHEN c_custkey % 3 = 0 THEN 'retrieval' END, CASE WHEN c_custkey % 4 = 0 THEN 'cache' END, CASE WHEN v = '' OR v LIKE '1.%' THEN 'version' END) AS changed FROM (SELECT c_custkey, CASE c_custkey % 5 WHEN 0 THEN '' WHEN 1 THEN '1.4' ELSE '2.1.0' END AS v FROM customer)) GROUP BY 1, 2")
def k11_migration(t):
    m = F.col("c_custkey") % 5
    c = t("customer").select("c_custkey", F.when(m == 0, F.lit(None)).when(m == 1, "1.4").otherwise("2.1.0").alias("version"), F.when(F.col("c_custkey") % 3 != 0, "{}").alias("retrieval"), F.when(F.col("c_custkey") % 4 != 0, "{}").alias("cache"))
    done = K.migrated(c, {"retrieval": F.lit("{}"), "cache": F.lit("{}")})
    return done.groupBy("version", F.array_join("changed", ",").alias("changed")).agg(F.count("*").alias("n"))


@query("SELECT c_nationkey, c_mktsegment, n FROM (SELECT c_nationkey, c_mktsegment, count(*) AS n FROM customer GROUP BY 1, 2) WHERE n > 1")
def k12_duplicate_names(t):
    from corpusmill.operators.corpus import duplicate_keys

    return duplicate_keys(t("customer"), "c_nationkey", "c_mktsegment")


def _lineage(t: Tables):
    r = chunks(t).select((F.col("doc_id") + 3).alias("query_id"), "chunk_id", "doc_id", F.col("chunk_index").alias("rank"), F.lit(0.5).alias("score"), "content")
    q = t("documents").select(F.col("doc_id").alias("query_id"), F.repeat(F.lit("answer "), 100).alias("answer"))
    return K.lineage_rows(r, files(t).select("doc_id", F.col("path").alias("file_path")), q)


@query("SELECT q.query_id, length(substr(repeat('answer ', 100), 1, 500)) AS answer_chars, coalesce(n, 0) AS chunks, coalesce(p, 0) AS preview_chars FROM (SELECT doc_id AS query_id FROM documents) q LEFT JOIN (SELECT doc_id + 3 AS query_id, count(*) AS n, CAST(sum(length(substr(content, 1, 200))) AS BIGINT) AS p FROM chunks GROUP BY 1) USING (query_id)", CHUNKS)
def k13_lineage(t):
    c = F.coalesce("chunks", F.array())
    return _lineage(t).select("query_id", F.length("answer_preview").alias("answer_chars"), F.greatest(F.size("chunks"), F.lit(0)).alias("n"), F.coalesce(F.aggregate("chunks", F.lit(0), lambda s, x: s + F.length(x["preview"])), F.lit(0)).alias("preview_chars")).withColumnRenamed("n", "chunks")


@query("SELECT query_id, config_id, created_at, answer_chars FROM (SELECT doc_id AS query_id, 'cfg' || (doc_id % 4) AS config_id, TIMESTAMP '2024-01-01 00:00:00' + to_seconds(doc_id * 37 % 1000) AS created_at, 500 AS answer_chars FROM documents) WHERE config_id = 'cfg3' ORDER BY created_at DESC, query_id LIMIT 20 OFFSET 5")
def k13_lineage_list(t):
    d = t("documents")
    q = d.select(F.col("doc_id").alias("query_id"), F.concat(F.lit("cfg"), (F.col("doc_id") % 4).cast("string")).alias("config_id"), (F.expr(START) + F.make_dt_interval(secs=F.col("doc_id") * 37 % 1000)).alias("created_at"), F.repeat(F.lit("answer "), 100).alias("answer"))
    r = chunks(t).select(F.col("doc_id").alias("query_id"), "chunk_id", "doc_id", F.col("chunk_index").alias("rank"), F.lit(0.5).alias("score"), "content")
    rows = K.lineage_rows(r, files(t).select("doc_id", F.col("path").alias("file_path")), q).join(q.select("query_id", "config_id", "created_at"), "query_id")
    return K.lineage_list(rows, "cfg3", 5, 20).select("query_id", "config_id", "created_at", F.length("answer_preview").alias("answer_chars"))


@query("SELECT path AS file_path, count(DISTINCT doc_id) AS queries, count(*) AS chunks FROM chunks JOIN (SELECT doc_id, path FROM files) USING (doc_id) WHERE doc_id + 3 IN (SELECT doc_id FROM documents) GROUP BY 1", CHUNKS, FILES)
def k14_attribution(t):
    return K.attribution(_lineage(t))


@query("SELECT doc_id FROM documents WHERE CAST('0x' || substr(md5(CAST(doc_id AS VARCHAR)), 1, 8) AS BIGINT) < CAST(0.25 * 4294967296 AS BIGINT)")
def k15_sample(t):
    return K.hash_sample(t("documents"), "doc_id", 0.25).select("doc_id")


# Replies of judges, made from labels --------------------------------------------------------------------------------

SCORE_REPLIES = """score_replies AS (SELECT doc_id, CASE doc_id % 7 WHEN 0 THEN 'broken' WHEN 1 THEN '```json' || chr(10) || '{"score": 1.7}' || chr(10) || '```' ELSE 'so {"score": ' || (doc_id % 10) / 10.0 || '}' END AS reply FROM labels)"""


def score_replies(t: Tables):
    m = F.col("doc_id") % 7
    return t("labels").select("doc_id", "quality", F.when(m == 0, F.lit("broken")).when(m == 1, F.lit('```json\n{"score": 1.7}\n```')).otherwise(F.concat(F.lit('so {"score": '), ((F.col("doc_id") % 10) / 10).cast("string"), F.lit("}"))).alias("reply"))


@query("SELECT doc_id, CASE doc_id % 7 WHEN 0 THEN 0.0 WHEN 1 THEN 1.0 ELSE (doc_id % 10) / 10.0 END::DOUBLE AS score FROM labels")
def l1_metric_score(t):
    return score_replies(t).select("doc_id", L.metric_score(F.col("reply")).alias("score"))


@query("SELECT doc_id, name, CASE WHEN doc_id % 7 = 0 THEN 0.0 WHEN name = 'clarity' THEN 1.0 WHEN name = 'depth' AND doc_id % 2 = 0 THEN 0.5 ELSE 0.0 END::DOUBLE AS score FROM labels, (SELECT unnest(['clarity', 'depth', 'style']) AS name)")
def l2_rubrics(t):
    body = F.concat(F.lit('{"scores":[{"name":"clarity","score":1.5}'), F.when(F.col("doc_id") % 2 == 0, F.lit(',{"name":"depth","score":0.5}')).otherwise(""), F.lit("]}"))
    r = t("labels").select("doc_id", F.when(F.col("doc_id") % 7 == 0, F.lit("nothing")).otherwise(body).alias("reply"))
    return L.rubric_scores(r, t.spark.createDataFrame([("clarity",), ("depth",), ("style",)], "name string"), "doc_id", "reply")


@query("SELECT doc_id, CASE doc_id % 4 WHEN 0 THEN 5.0 WHEN 1 THEN 1.0 ELSE 3.0 END::DOUBLE AS quality, CASE doc_id % 4 WHEN 1 THEN 0.0 ELSE 0.8 END::DOUBLE AS groundedness, CASE doc_id % 4 WHEN 0 THEN true WHEN 1 THEN false WHEN 2 THEN true ELSE false END AS does_pass FROM labels")
def l3_quality_verdict(t):
    m = F.col("doc_id") % 4
    reply = F.when(m == 0, F.lit('{"quality": 9, "groundedness": 0.8, "does_pass": "Yes"}')).when(m == 1, F.lit("garbled")).when(m == 2, F.lit('```json\n{"quality": "3", "groundedness": 0.8, "does_pass": 0.7}\n```')).otherwise(F.lit('x {"quality": 3, "groundedness": 0.8, "does_pass": 0.2} y'))
    return t("labels").select("doc_id", reply.alias("reply")).select("doc_id", *[c.alias(n) for n, c in L.quality_verdict(F.col("reply")).items()])


@query("SELECT doc_id, least(5, greatest(1, doc_id % 7 + 1))::DOUBLE AS quality, round(least(1, greatest(0, (doc_id % 7 + 1 - 1) / 4.0)), 6)::DOUBLE AS unit FROM labels")
def l4_score_maps(t):
    q = L.level_to_quality((F.col("doc_id") % 7).cast("double"))
    return t("labels").select("doc_id", q.alias("quality"), F.round(L.quality_to_unit(q), 6).alias("unit"))


@query("SELECT doc_id, least(5, doc_id % 6 + 1)::DOUBLE AS quality, (doc_id % 10) / 10.0 >= 0.5 AS does_pass, ((doc_id % 10) / 10.0)::DOUBLE AS pass_probability, round(CASE WHEN doc_id % 4 = 0 THEN 0.002 ELSE (doc_id * 0.15 + 7 * 0.60) / 1e6 END, 10)::DOUBLE AS cost_usd, CASE WHEN doc_id % 5 = 0 THEN 0.0 ELSE 0.9 END::DOUBLE AS groundedness FROM labels")
def l5_recorded_verdict(t):
    a = F.to_json(F.struct(F.struct((F.col("doc_id") % 6).alias("score")).alias("quality"), F.struct(((F.col("doc_id") % 10) / 10).alias("noul")).alias("does_pass"), F.struct(F.when(F.col("doc_id") % 5 != 0, 0.9).alias("noul")).alias("grounded")))
    p = F.when(F.col("doc_id") % 4 != 0, F.to_json(F.struct(F.struct(F.col("doc_id").alias("input_tokens"), F.lit(7).alias("output_tokens")).alias("usage")))).otherwise(F.lit("{}"))
    return t("labels").select("doc_id", a.alias("a"), p.alias("p")).select("doc_id", *[c.alias(n) for n, c in L.recorded_verdict(F.col("a")).items()], F.round(L.recorded_cost(F.col("p")), 10).alias("cost_usd"))


@query("SELECT event_id, round(CASE WHEN event_id % 10 = 0 THEN 0.002 ELSE (user_id * CASE event_type WHEN 'view' THEN 0.15 WHEN 'click' THEN 2.5 WHEN 'signup' THEN 0.25 ELSE 0.15 END + event_id % 100 * CASE event_type WHEN 'view' THEN 0.60 WHEN 'click' THEN 10.0 WHEN 'signup' THEN 1.25 ELSE 0.60 END) / 1e6 END::DOUBLE, 10) AS cost_usd FROM events")
def l6_cost(t):
    e = F.col("event_type")
    calls = t("events").select("event_id", F.when(e == "view", "gpt-4o-mini").when(e == "click", "my-gpt-4o-deploy").when(e == "signup", "claude-3-haiku-20240307").otherwise("unknown").alias("model"), F.when(F.col("event_id") % 10 != 0, F.col("user_id")).alias("tokens_in"), (F.col("event_id") % 100).alias("tokens_out"))
    prices = t.spark.createDataFrame([(i, *p) for i, p in enumerate(L.PRICES)], "ordinal int, name string, rate_in double, rate_out double")
    return L.cost(calls, prices).select("event_id", F.round("cost_usd", 10).alias("cost_usd"))


@query("""SELECT doc_id, round(len(list_filter(list_distinct(string_split_regex(lower(text), '[^a-z0-9äöüßéèáíóúñ]+')), lambda w: w <> '' AND list_contains(string_split_regex(lower(q), '[^a-z0-9äöüßéèáíóúñ]+'), w)))::DOUBLE / greatest(1, len(list_filter(list_distinct(string_split_regex(lower(text), '[^a-z0-9äöüßéèáíóúñ]+')), lambda w: w <> ''))), 6) AS overlap FROM documents JOIN (SELECT item_id, text AS q FROM benchmark) ON item_id = doc_id % 40""")
def l7_overlap_scorer(t):
    from corpusmill.functions.text import terms

    q = t("benchmark").select("item_id", F.array_distinct(terms(F.col("text"))).alias("q"))
    d = t("documents").select("doc_id", (F.col("doc_id") % 40).alias("item_id"), F.array_distinct(terms(F.col("text"))).alias("d"))
    return d.join(q, "item_id").select("doc_id", F.round(F.size(F.array_intersect("d", "q")) / F.greatest(F.lit(1), F.size("d")), 6).alias("overlap"))


VERDICTS = "verdicts AS (SELECT judge, doc_id AS case_id, rep, h < 6 AS does_pass, 1 + h % 5 + CASE WHEN judge = 'a' THEN 0 ELSE rep % 2 END AS quality, (100 + h * 10 + rep)::DOUBLE AS latency_ms, (h + 1) / 1000.0::DOUBLE AS cost_usd, 'm' || (h % 2) AS model, doc_id * 100 + rep * 2 + CASE judge WHEN 'a' THEN 0 ELSE 1 END AS ord FROM (SELECT *, (doc_id * 31 + rep * 7 + CASE judge WHEN 'a' THEN 0 ELSE 3 END) % 10 AS h FROM labels, (SELECT unnest(['a', 'b']) AS judge), (SELECT unnest([1, 2, 3, 4, 5]) AS rep)))"
REFS = "refs AS (SELECT doc_id AS case_id, CASE WHEN doc_id % 5 = 0 THEN coalesce((SELECT count(*) FILTER (does_pass) >= ceil(count(*) / 2.0) FROM verdicts v WHERE v.case_id = doc_id AND judge = 'a'), false) ELSE quality = 1 END AS reference FROM labels)"


def verdicts(t: Tables):
    v = t("labels").select(F.col("doc_id").alias("case_id"), F.explode(F.array(F.lit("a"), F.lit("b"))).alias("judge")).select("*", F.explode(F.sequence(F.lit(1), F.lit(5))).alias("rep"))
    v = v.withColumn("h", (F.col("case_id") * 31 + F.col("rep") * 7 + F.when(F.col("judge") == "a", 0).otherwise(3)) % 10)
    return v.select("judge", "case_id", "rep", (F.col("h") < 6).alias("does_pass"), (1 + F.col("h") % 5 + F.when(F.col("judge") == "a", 0).otherwise(F.col("rep") % 2)).alias("quality"), (100 + F.col("h") * 10 + F.col("rep")).cast("double").alias("latency_ms"), ((F.col("h") + 1) / 1000.0).alias("cost_usd"), F.concat(F.lit("m"), (F.col("h") % 2).cast("string")).alias("model"), (F.col("case_id") * 100 + F.col("rep") * 2 + F.when(F.col("judge") == "a", 0).otherwise(1)).alias("ord"))


def references(t: Tables):
    cases = t("labels").select(F.col("doc_id").alias("case_id"), F.when(F.col("doc_id") % 5 != 0, F.col("quality") == 1).alias("oracle_pass"))
    return L.references(cases, verdicts(t), "a")


@query("SELECT case_id, reference FROM refs", VERDICTS, REFS)
def l8_references(t):
    return references(t)


SUMMARY = """summary AS (SELECT judge, round(variance, 6) AS variance, round(repeatability, 6) AS repeatability, round(agreement, 6) AS agreement, round(p50, 6) AS p50, round(p95, 6) AS p95, round(latency, 6) AS latency, round(cost, 6) AS cost, round(quality, 6) AS quality, round(pass_rate, 6) AS pass_rate, model, round(agreement * repeatability, 6) AS signal FROM
    (SELECT judge, avg(v) AS variance, avg(p * p + (1 - p) * (1 - p)) AS repeatability FROM (SELECT judge, case_id, var_samp(quality) AS v, avg(does_pass::INT) AS p FROM verdicts GROUP BY 1, 2) GROUP BY 1)
    JOIN (SELECT judge, avg((does_pass = reference)::INT) AS agreement, quantile_cont(latency_ms, 0.5) AS p50, quantile_cont(latency_ms, 0.95) AS p95, avg(latency_ms) AS latency, sum(cost_usd) AS cost, avg(quality) AS quality, avg(does_pass::INT) AS pass_rate FROM verdicts JOIN refs USING (case_id) GROUP BY 1) USING (judge)
    JOIN (SELECT judge, arg_max(model, (n, -o)) AS model FROM (SELECT judge, model, count(*) AS n, min(ord) AS o FROM verdicts GROUP BY 1, 2) GROUP BY 1) USING (judge))"""


def _summary(t: Tables):
    s = L.judge_summary(verdicts(t), references(t))
    return s.select("judge", "model", *[F.round(c, 6).alias(c) for c in s.columns if c not in ("judge", "model")])


@query("SELECT * FROM summary", VERDICTS, REFS, SUMMARY)
def l9_judge_summary(t):
    return _summary(t)


@query("SELECT ord, judge, cost_usd FROM (SELECT *, coalesce(sum(cost_usd) OVER (ORDER BY ord ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS before FROM verdicts) WHERE round(before, 9) < 1.5", VERDICTS)
def l10_budget_cut(t):
    return L.within_budget(verdicts(t), 1.5, "ord", block=1 << 12).select("ord", "judge", "cost_usd")


@query("SELECT made, round(spent, 6) AS spent, made < asked AS stopped FROM (SELECT count(*) FILTER (round(before, 9) < 1.5) AS made, sum(cost_usd) FILTER (round(before, 9) < 1.5) AS spent, count(*) AS asked FROM (SELECT *, coalesce(sum(cost_usd) OVER (ORDER BY ord ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS before FROM verdicts))", VERDICTS)
def l10_budget_stop(t):
    return L.budget_stop(verdicts(t), 1.5, "ord", block=1 << 12).withColumn("spent", F.round("spent", 6))


@query("SELECT round(a.variance / b.variance, 4) AS variance_ratio, round(a.latency / b.latency, 4) AS latency_ratio, round(a.cost / b.cost, 4) AS cost_ratio FROM summary a, summary b WHERE a.judge = 'a' AND b.judge = 'b'", VERDICTS, REFS, SUMMARY)
def l11_head_to_head(t):
    h = L.head_to_head(_summary(t), "a", "b")
    return h.select(*[F.round(c, 4).alias(c) for c in h.columns])


CHECKS = "checks AS (SELECT doc_id AS id, side, c AS \"check\", CASE WHEN doc_id % 13 = 0 AND c = 'pii' THEN NULL ELSE (doc_id + o) % 3 = 0 END AS flagged, ((doc_id * 7 + o * 3) % 10) / 10.0::DOUBLE AS confidence, l, b FROM labels, (SELECT unnest(['output', 'output', 'input', 'input']) AS side, unnest(['toxicity', 'pii', 'injection', 'pii']) AS c, unnest([1, 2, 3, 4]) AS o, unnest([0.8, 0.7, 0.8, 0.7])::DOUBLE AS l, unnest([1, 2, 1, NULL]) AS b))"


@query("SELECT id, side, count(*) FILTER (NOT passed AND b IS NOT NULL) = 0 AS allowed, arg_min(CASE WHEN NOT passed AND b IS NOT NULL THEN \"check\" END, CASE WHEN NOT passed THEN b END) AS reason, coalesce(string_agg(CASE WHEN NOT passed AND b IS NULL THEN \"check\" END, ','), '') AS warnings, round(avg(score), 6) AS score FROM (SELECT *, flagged IS NULL OR NOT (flagged AND confidence >= l) AS passed, CASE WHEN flagged IS NULL THEN 0.5 WHEN flagged THEN 1 - confidence ELSE 1 END AS score FROM checks) GROUP BY 1, 2", CHECKS)
def l12_guardrails(t):
    c = t("labels").select(F.col("doc_id").alias("id"), F.posexplode(F.array(*[F.struct(F.lit(side).alias("side"), F.lit(c).alias("check")) for side, c in (("output", "toxicity"), ("output", "pii"), ("input", "injection"), ("input", "pii"))])).alias("o", "c"))
    o = F.col("o") + 1
    c = c.select("id", "c.side", "c.check", F.when((F.col("id") % 13 == 0) & (F.col("c.check") == "pii"), F.lit(None)).otherwise((F.col("id") + o) % 3 == 0).alias("flagged"), ((F.col("id") * 7 + o * 3) % 10 / 10).alias("confidence"))
    g = L.guardrails(c, {"toxicity": 0.8, "pii": 0.7, "injection": 0.8})
    return L.blocking_reason(g).join(g.groupBy("id", "side").agg(F.round(F.avg("score"), 6).alias("score")), ["id", "side"])


@query(r"SELECT lang, kind, count(*) AS n FROM (SELECT lang, 'email' AS kind FROM documents WHERE regexp_matches(text, '[A-Za-z0-9._%+-]+@[A-Za-z0-9.-]+\.[A-Za-z]{2,}') UNION ALL SELECT lang, 'card' FROM documents WHERE regexp_matches(text, '\b[0-9]{4}[ -]?[0-9]{4}[ -]?[0-9]{4}[ -]?[0-9]{4}\b') UNION ALL SELECT lang, 'phone' FROM documents WHERE regexp_matches(text, '\+?[0-9]{1,3}[ .-]\(?[0-9]{2,4}\)?[ .-][0-9]{3,4}[ .-]?[0-9]{3,4}') UNION ALL SELECT lang, 'ssn' FROM documents WHERE regexp_matches(text, '\b[0-9]{3}-[0-9]{2}-[0-9]{4}\b')) GROUP BY 1, 2")
def l13_pii_scan(t):
    return t("documents").select("lang", F.explode(L.pii_types(F.col("text"))).alias("kind")).groupBy("lang", "kind").agg(F.count("*").alias("n"))


# Contexts and conversations -----------------------------------------------------------------------------------------


@query("SELECT q.query_id, coalesce(CASE WHEN length(c) > 4000 THEN substr(c, 1, 4000) || '...' ELSE c END, 'No relevant context found.') AS context FROM (SELECT doc_id AS query_id FROM documents) q LEFT JOIN (SELECT doc_id + 3 AS query_id, string_agg('[' || r || '] ' || content || chr(10) || chr(10) || '    Source: ' || folder, chr(10) || chr(10) ORDER BY r) AS c FROM (SELECT *, row_number() OVER (PARTITION BY doc_id ORDER BY chunk_index) AS r FROM chunks) GROUP BY 1) USING (query_id)", CHUNKS)
def m1_contexts(t):
    r = chunks(t).select((F.col("doc_id") + 3).alias("query_id"), (F.col("chunk_index") + 1).alias("rank"), "content", F.col("folder").alias("source"), F.lit(0.5).alias("score"))
    return X.contexts(r, t("documents").select(F.col("doc_id").alias("query_id")))


@query("SELECT doc_id AS query_id, style, CASE WHEN length(c) > 300 THEN substr(c, 1, 300) || '...' ELSE c END AS context FROM (SELECT doc_id, 'bullet' AS style, string_agg('• ' || content, chr(10) || chr(10) ORDER BY r) AS c FROM ranked GROUP BY 1 UNION ALL SELECT doc_id, 'plain', string_agg(content, chr(10) || chr(10) ORDER BY r) FROM ranked GROUP BY 1 UNION ALL SELECT doc_id, 'xml', string_agg('<source id=\"' || r || '\" score=\"0.500\">' || chr(10) || content || chr(10) || '</source>', chr(10) || chr(10) ORDER BY r) FROM ranked GROUP BY 1)", CHUNKS, "ranked AS (SELECT doc_id, content, row_number() OVER (PARTITION BY doc_id ORDER BY start_char) AS r FROM chunks)")
def m1_context_styles(t):
    r = chunks(t).select(F.col("doc_id").alias("query_id"), (F.col("chunk_index") + 1).alias("rank"), "content", F.lit(None).cast("string").alias("source"), F.lit(0.5).alias("score"))
    one = [X.contexts(r, r.select("query_id").distinct(), style, 300).select("query_id", F.lit(style).alias("style"), "context") for style in ("bullet", "plain", "xml")]
    return one[0].unionByName(one[1]).unionByName(one[2])


@query("SELECT conv_id, string_agg(upper(role[1]) || role[2:] || ': ' || text, chr(10) ORDER BY turn) AS history FROM (SELECT *, row_number() OVER (PARTITION BY conv_id ORDER BY turn DESC) AS r FROM conversations) WHERE r <= 4 GROUP BY 1")
def m2_histories(t):
    return X.histories(t("conversations"), 2)


@query("SELECT conv_id, count(*) AS messages, count(*) // 2 + 1 AS conversation_turn, min(turn) AS first_turn, max(turn) AS last_turn FROM conversations GROUP BY 1")
def m3_conversation_state(t):
    return X.conversation_state(t("conversations"))


@query("SELECT c_custkey, CASE WHEN c_custkey % 2 = 0 THEN 'name' ELSE '' END AS missing, 'Dear ' || CASE WHEN c_custkey % 2 = 0 THEN '{name}' ELSE c_name END || ' of ' || c_mktsegment || ', {closing}' AS text FROM customer")
def m4_templates(t):
    template = F.lit("Dear {name} of {segment}, {closing}")
    given = F.when(F.col("c_custkey") % 2 == 0, F.array(F.lit("segment"), F.lit("closing"))).otherwise(F.array(F.lit("name"), F.lit("segment"), F.lit("closing")))
    name = F.when(F.col("c_custkey") % 2 == 0, F.lit("{name}")).otherwise(F.col("c_name"))
    return t("customer").select("c_custkey", F.array_join(X.missing(template, given), ",").alias("missing"), X.filled(template, {"name": name, "segment": F.col("c_mktsegment")}).alias("text"))


@query("SELECT item_id, 'about ' || item_id || ' and more|second question ' || item_id AS queries, CASE WHEN item_id % 2 = 0 THEN 'look up|answer' ELSE 'Answer the question' END AS plan FROM benchmark")
def m5_listed_replies(t):
    i = F.col("item_id").cast("string")
    q = F.concat(F.lit("1. 'about "), i, F.lit(" and more'\n- short\n• \"second question "), i, F.lit('"'))
    p = F.when(F.col("item_id") % 2 == 0, F.lit("1. look up\n2) answer\nbye")).otherwise(F.lit("no steps"))
    return t("benchmark").select("item_id", F.array_join(X.listed_queries(q), "|").alias("queries"), F.array_join(X.plan_steps(p), "|").alias("plan"))


# Replies as SQL text of each row, and the rules of each parser stated on them.
REPLY = "replies AS (SELECT doc_id, CASE doc_id % 4 WHEN 0 THEN 'Score: 0.9' || chr(10) || 'REASONING: fine' || chr(10) || 'so NEEDS_CORRECTION: NO' WHEN 1 THEN 'grade: Partially_Relevant' || chr(10) || 'SCORE: 3' WHEN 2 THEN 'I can''t say' ELSE 'GRADE: irrelevant SCORE: 0.25 REASONING: off' || chr(10) || 'topic' END AS r FROM labels)"
SCORED = "least(1.0, greatest(0.0, coalesce(try_cast(nullif(regexp_extract(r, 'SCORE:\\s*([\\d.]+)', 1), '') AS DOUBLE), {})))::DOUBLE AS score"


def replies(t):
    m = F.col("doc_id") % 4
    r = F.when(m == 0, F.lit("Score: 0.9\nREASONING: fine\nso NEEDS_CORRECTION: NO")).when(m == 1, F.lit("grade: Partially_Relevant\nSCORE: 3")).when(m == 2, F.lit("I can't say")).otherwise(F.lit("GRADE: irrelevant SCORE: 0.25 REASONING: off\ntopic"))
    return t("labels").select("doc_id", r.alias("r"))


@query(f"""SELECT doc_id, grade, score, reasoning, coalesce(said = 'yes', grade IN ('irrelevant', 'partially_relevant')) AS needs_correction FROM (SELECT doc_id, {SCORED.format(0.7)},
    coalesce(nullif(lower(regexp_extract(r, 'GRADE:\\s*(highly_relevant|relevant|partially_relevant|irrelevant)', 1, 'i')), ''), 'relevant') AS grade,
    trim(CASE WHEN contains(r, 'REASONING:') THEN string_split(string_split(r, 'REASONING:')[2], 'NEEDS_CORRECTION:')[1] ELSE '' END, chr(10) || ' ') AS reasoning,
    nullif(lower(regexp_extract(r, 'NEEDS_CORRECTION:\\s*(yes|no)', 1, 'i')), '') AS said FROM replies)""", REPLY)
def m6_labelled_replies(t):
    return replies(t).select("doc_id", *[c.alias(n) for n, c in X.grade_fields(F.col("r")).items()])


CRITIQUE = "critiques AS (SELECT doc_id, CASE doc_id % 3 WHEN 0 THEN 'RELEVANCE: High' || chr(10) || 'support: supported' || chr(10) || 'UTILITY: useful' || chr(10) || 'SCORE: 0.8' || chr(10) || 'CRITIQUE: good ' || chr(10) || 'NEEDS_REFINEMENT: yes' WHEN 1 THEN 'SUPPORT: supported UTILITY: not_useful CRITIQUE: vague' ELSE 'nothing' END AS r FROM labels)"


@query(f"""SELECT doc_id, relevance, support, utility, score, critique, coalesce(said = 'yes', support <> 'supported' OR utility = 'not_useful') AS needs_refinement FROM (SELECT doc_id, {SCORED.format(0.6)},
    coalesce(nullif(lower(regexp_extract(r, 'RELEVANCE:\\s*(high|medium|low)', 1, 'i')), ''), 'medium') AS relevance,
    coalesce(nullif(lower(regexp_extract(r, 'SUPPORT:\\s*(supported|partially_supported|unsupported)', 1, 'i')), ''), 'partially_supported') AS support,
    coalesce(nullif(lower(regexp_extract(r, 'UTILITY:\\s*(useful|partially_useful|not_useful)', 1, 'i')), ''), 'partially_useful') AS utility,
    trim(CASE WHEN contains(r, 'CRITIQUE:') THEN string_split(string_split(r, 'CRITIQUE:')[2], 'NEEDS_REFINEMENT:')[1] ELSE '' END, chr(10) || ' ') AS critique,
    nullif(lower(regexp_extract(r, 'NEEDS_REFINEMENT:\\s*(yes|no)', 1, 'i')), '') AS said FROM critiques)""", CRITIQUE)
def m6_critique_replies(t):
    m = F.col("doc_id") % 3
    r = F.when(m == 0, F.lit("RELEVANCE: High\nsupport: supported\nUTILITY: useful\nSCORE: 0.8\nCRITIQUE: good \nNEEDS_REFINEMENT: yes")).when(m == 1, F.lit("SUPPORT: supported UTILITY: not_useful CRITIQUE: vague")).otherwise(F.lit("nothing"))
    return t("labels").select("doc_id", r.alias("r")).select("doc_id", *[c.alias(n) for n, c in X.critique_fields(F.col("r")).items()])


@query("""SELECT doc_id, CASE doc_id % 3 WHEN 2 THEN '' ELSE 'look ' || doc_id END AS thought, CASE doc_id % 3 WHEN 0 THEN 'Search[term ' || doc_id || ']' WHEN 1 THEN 'find it' ELSE '' END AS action, CASE doc_id % 3 WHEN 2 THEN 'done' || chr(10) || 'now' ELSE '' END AS answer,
    'search' AS tool, CASE doc_id % 3 WHEN 0 THEN 'term ' || doc_id WHEN 1 THEN 'find it' ELSE '' END AS tool_input FROM labels""")
def m6_step_replies(t):
    m, i = F.col("doc_id") % 3, F.col("doc_id").cast("string")
    r = F.when(m == 0, F.concat(F.lit("Thought: look "), i, F.lit("\nAction: Search[term "), i, F.lit("]\nObservation: x"))).when(m == 1, F.concat(F.lit("thought: look "), i, F.lit("\nACTION: find it"))).otherwise(F.lit("Answer: done\nnow"))
    return t("labels").select("doc_id", r.alias("r")).select("doc_id", *[c.alias(n) for n, c in X.step_fields(F.col("r")).items()])


@query("SELECT doc_id, (quality = 1 AND doc_id % 3 <> 2) OR doc_id % 4 >= 2 AS accepted FROM labels")
def m7_acceptance(t):
    utility = F.when(F.col("doc_id") % 3 == 0, "useful").when(F.col("doc_id") % 3 == 1, "partially_useful").otherwise("not_useful")
    return t("labels").select("doc_id", X.acceptable(F.col("quality") == 1, utility, F.col("doc_id") % 4).alias("accepted"))


@query("SELECT doc_id, CASE WHEN doc_id % 5 = 0 THEN 'global' ELSE 'local' END AS route FROM labels")
def m8_routing(t):
    return t("labels").select("doc_id", X.route(F.when(F.col("doc_id") % 5 == 0, "It is GLOBAL.").otherwise("local")).alias("route"))
