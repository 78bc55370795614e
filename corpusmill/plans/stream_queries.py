"""File sources, sinks and streams over the tables."""

from __future__ import annotations

from pyspark.sql import functions as F

from corpusmill.operators.chunking import fixed_windows
from corpusmill.operators.store import buckets_for
from corpusmill.plans.registry import Tables, query
from corpusmill.plans.operations_queries import REFS, SUMMARY, VERDICTS, _summary as summary, runs, verdicts
from corpusmill.sources import files as S
from corpusmill.streaming import keyed as N
from corpusmill.workspace import Workspace, shuffle_partitions


@query()
def a4_file_metadata(t):
    """The files that hold the documents table."""
    seen = t("documents").select(F.col("_metadata.file_path").alias("path"), F.col("_metadata.file_size").alias("length"))
    return S.file_metadata(seen.distinct())


@query("SELECT doc_id, md5(replace(text, chr(10), chr(10) || 'x')) AS text_md5 FROM documents")
def a6_decode(t):
    d = t("documents")
    marked = F.replace("text", F.lit("\n"), F.concat(F.when(F.col("doc_id") % 2 == 0, F.lit("\r\n")).otherwise(F.lit("\r")), F.lit("x")))
    raw = F.when(F.col("doc_id") % 3 == 0, F.encode(F.concat(F.lit("﻿"), marked), "UTF-8")).otherwise(F.encode(marked, "UTF-8"))
    return d.select("doc_id", raw.alias("content")).select("doc_id", F.md5(S.decoded(F.col("content"))).alias("text_md5"))


@query("SELECT 'c' || item_id AS id, text AS question, CASE WHEN item_id % 3 = 0 THEN 0 ELSE 1 END AS chunks, CASE WHEN item_id % 2 = 0 THEN true END AS oracle_pass FROM benchmark")
def a9_eval_cases(t):
    b = t("benchmark")
    case = b.select(F.concat(F.lit("c"), F.col("item_id").cast("string")).alias("id"), F.col("text").alias("question"), F.when(F.col("item_id") % 3 == 1, F.array("text")).alias("retrieved_chunks"), F.when(F.col("item_id") % 3 == 2, F.col("text")).alias("contexts"), F.lit("a").alias("answer"), F.when(F.col("item_id") % 2 == 0, F.lit(True)).alias("oracle_pass"), "item_id")
    path = Workspace(t.spark, "cases").path("json")
    # A file of its own for each few cases, wrapped or bare.
    group = case.groupBy(F.floor(F.col("item_id") / 8).alias("g")).agg(F.collect_list(F.struct(*[c for c in case.columns if c != "item_id"])).alias("cases"))
    text = group.select(F.when(F.col("g") % 2 == 0, F.to_json(F.struct("cases"))).otherwise(F.to_json("cases")).alias("value"), "g")
    text.write.partitionBy("g").text(path)
    return S.load_cases(t.spark, path).select("id", "question", F.size("retrieved_chunks").alias("chunks"), "oracle_pass")


@query("SELECT judge, case_id, rep, printf('%.6f', quality::DOUBLE) AS quality, printf('%.3f', latency_ms) AS latency_ms, printf('%.8f', cost_usd::DOUBLE) AS cost_usd FROM verdicts", VERDICTS)
def a10_verdict_csv(t):
    path = Workspace(t.spark, "verdicts").path("csv")
    S.write_verdicts(verdicts(t).select("judge", "case_id", "rep", "quality", "latency_ms", "cost_usd"), path)
    return t.spark.read.option("header", True).schema("judge string, case_id long, rep int, quality string, latency_ms string, cost_usd string").csv(path)


@query("SELECT CAST(doc_id AS VARCHAR) AS id, 'q' || doc_id AS question FROM labels ORDER BY doc_id DESC LIMIT 25")
def a11_trace_export(t):
    path = Workspace(t.spark, "traces").path("json")
    r = runs(t).select(F.col("doc_id").alias("run_id"), "config_id", "created_at", F.concat(F.lit("q"), F.col("doc_id").cast("string")).alias("query"), F.array(F.lit("c")).alias("contexts"), F.lit("a").alias("answer"))
    S.export_traces(r, path, 25)
    return t.spark.read.schema("id string, question string").json(path)


def requests(t: Tables):
    return t("events").select(F.col("user_id").alias("key"), "event_id", F.col("ts").cast("timestamp").alias("ts"), (F.col("event_type") != "error").alias("ok"))


def _stream(t: Tables, name: str):
    """A table as a stream of its files, be it one file or a folder of them."""
    return t.spark.readStream.schema(t(name).schema).parquet(f"{t.sf_dir}/{{{name}}}.parquet")


def request_stream(t: Tables):
    return _stream(t, "events").select(F.col("user_id").alias("key"), "event_id", F.col("ts").cast("timestamp").alias("ts"), (F.col("event_type") != "error").alias("ok"))


def _audited(t: Tables, name: str, machine):
    """The events as a stream of several files, in no order of time, a fifth of them each micro-batch."""
    ws = Workspace(t.spark, name)
    files, out = ws.path("files"), ws.path("out")
    n = max(5, shuffle_partitions(t.spark))
    requests(t).repartition(n, F.xxhash64("event_id")).write.parquet(files)
    # All events wait for the end, so a bucket holds about 20,000 of them.
    buckets = buckets_for(requests(t).count(), 20_000, 4 * n)
    N.audit_to_end(t.spark.readStream.schema(requests(t).schema).option("maxFilesPerTrigger", -(-n // 5)).parquet(files), machine, out, ws.path("checkpoint"), ws.path("closing"), "400 days", buckets)
    return t.spark.read.parquet(out)


def _streamed(t: Tables, name: str, stream, schema: str | None = None):
    ws = Workspace(t.spark, name)
    out = ws.path("out")
    N.run_to_end(stream, out, ws.path("checkpoint"))
    return t.spark.read.parquet(out)


@query()
def n1_throttle_audit(t):
    return _audited(t, "throttle", N.TokenBucket(rps=0.0001, burst=3, ttl=1e9))


@query()
def n1_throttle_audit_batch(t):
    return N.batch_audit(requests(t), N.TokenBucket(rps=0.0001, burst=3, ttl=1e9))


@query()
def n2_breaker_timeline(t):
    return _audited(t, "breaker", N.Breaker(most=2, window=86400.0, wait=7200.0))


@query()
def n2_breaker_timeline_batch(t):
    return N.batch_audit(requests(t), N.Breaker(most=2, window=86400.0, wait=7200.0))


@query("SELECT event_id, key, failures FROM (SELECT event_id, user_id AS key, count(*) OVER (PARTITION BY user_id ORDER BY epoch_us(ts) RANGE BETWEEN 86399999999 PRECEDING AND CURRENT ROW) AS failures FROM events WHERE event_type = 'error') WHERE failures >= 2")
def n3_failure_alarms(t):
    return N.failure_alarms(requests(t), 86400, 2).select("event_id", "key", "failures")


@query("SELECT content_hash, chunks FROM (SELECT md5(text) AS content_hash, any_value(length(text)) AS n FROM documents GROUP BY 1), LATERAL (SELECT len(list_filter(range(0, n, 900), lambda s: true)) AS chunks)")
def n4_stream_ingest(t):
    ws = Workspace(t.spark, "ingest")
    stored = ws.path("chunks")
    docs = _stream(t, "documents").select("doc_id", "text", F.md5("text").alias("content_hash"))
    N.ingest_stream(docs, lambda b: fixed_windows(b, "doc_id", "text", min_size=0).select("content_hash", "chunk_index", "content"), stored, ws.path("checkpoint"), buckets=buckets_for(t("documents").count()))
    # A text without characters is stored and gives no chunk.
    return _chunk_counts(N.ingested_keys(t.spark, stored, docs.schema["content_hash"]), t.spark.read.parquet(stored))


def _chunk_counts(keys, chunks):
    """Keys with how many chunks they have: none for the empty text, null for a missing one."""
    counts = chunks.groupBy("content_hash").agg(F.count("*").alias("chunks"))
    return keys.join(counts, "content_hash", "left").withColumn("chunks", F.when(F.col("content_hash").isNotNull(), F.coalesce("chunks", F.lit(0))))


@query("SELECT content_hash, chunks, files FROM (SELECT md5(text) AS content_hash, any_value(length(text)) AS n, count(*) AS files FROM documents GROUP BY 1), LATERAL (SELECT len(list_filter(range(0, n, 900), lambda s: true)) AS chunks)")
def n4_ingest_in_batches(t):
    """The documents, and all of them once more, as a stream of files in five micro-batches: a text is cut once, whichever batch brings it first. files: how many of the table's documents have it."""
    ws = Workspace(t.spark, "batches")
    stored, arriving = ws.path("chunks"), ws.path("files")
    n = max(5, shuffle_partitions(t.spark))
    docs = t("documents").select("doc_id", "text", F.md5("text").alias("content_hash"))
    twice = docs.withColumn("turn", F.lit(0)).unionByName(docs.withColumn("turn", F.lit(1)))
    twice.repartition(n, F.xxhash64("doc_id", "turn")).drop("turn").write.parquet(arriving)
    stream = t.spark.readStream.schema(docs.schema).option("maxFilesPerTrigger", -(-n // 5)).parquet(arriving)
    N.ingest_stream(stream, lambda b: fixed_windows(b, "doc_id", "text", min_size=0).select("content_hash", "chunk_index", "content"), stored, ws.path("checkpoint"), buckets=buckets_for(t("documents").count()))
    return _chunk_counts(docs.groupBy("content_hash").agg(F.count("*").alias("files")), t.spark.read.parquet(stored))


@query("SELECT DISTINCT md5(text) AS content_hash, length(text) AS chars FROM documents")
def n5_stream_dedup(t):
    docs = _stream(t, "documents").select(F.md5("text").alias("content_hash"), F.length("text").alias("chars"), F.timestamp_seconds(F.col("doc_id") + 86400).alias("ts"))
    return _streamed(t, "dedup", N.deduplicated(docs, "content_hash", "ts", "3650 days")).select("content_hash", "chars")


@query("SELECT event_id FROM events WHERE NOT (user_id % 5 = 0 AND ts < TIMESTAMP '2024-01-10 00:00:00' + to_hours(user_id))")
def n6_not_revoked(t):
    revoked = requests(t).filter("key % 5 = 0").select("key").distinct().withColumn("expires_at", F.expr("TIMESTAMP '2024-01-10 00:00:00'") + F.make_dt_interval(hours=F.col("key").cast("int")))
    return N.not_revoked(requests(t), revoked).select("event_id")


@query("SELECT event_id FROM events WHERE NOT (user_id % 5 = 0 AND ts < TIMESTAMP '2024-01-10 00:00:00' + to_hours(user_id))")
def n6_not_revoked_stream(t):
    """The stream of events against the table of revoked keys."""
    revoked = requests(t).filter("key % 5 = 0").select("key").distinct().withColumn("expires_at", F.expr("TIMESTAMP '2024-01-10 00:00:00'") + F.make_dt_interval(hours=F.col("key").cast("int")))
    return _streamed(t, "revoked", N.not_revoked(request_stream(t), revoked).select("event_id"))


@query("SELECT judge, model, round(agreement, 6) AS agreement, 'live' AS mode FROM summary", VERDICTS, REFS, SUMMARY)
def a10_latest_summary(t):
    path = Workspace(t.spark, "latest").path("json")
    S.write_latest(summary(t), path, mode="live", repeats=5)
    row = t.spark.read.schema("mode string, repeats int, summaries map<string, struct<model: string, agreement: double>>").json(path)
    return row.select("mode", F.explode("summaries").alias("judge", "s")).select("judge", "s.model", F.round("s.agreement", 6).alias("agreement"), "mode")
