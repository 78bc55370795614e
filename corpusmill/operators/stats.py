"""Operations analytics: ingestion, evaluation summaries, request metrics, audit and lineage."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from corpusmill.workspace import Workspace

BUCKETS = ("0.0-0.2", "0.2-0.4", "0.4-0.6", "0.6-0.8", "0.8-1.0")


def by_type(docs: DataFrame, kind: str) -> DataFrame:
    return docs.groupBy(F.coalesce(kind, F.lit("unknown")).alias("file_type")).agg(F.count("*").alias("n"))


def ratio(a: Column, b: Column) -> Column:
    """a / b, 0 where b is 0."""
    return F.when(b == 0, F.lit(0.0)).otherwise(a / b)


def ingestion_stats(jobs: DataFrame, chunks_per_job: DataFrame, nodes: DataFrame | None = None, edges: DataFrame | None = None) -> DataFrame:
    """jobs: job_id, total_files, processed_files, failed_files and, for seconds and graph counts, started_at, finished_at and config_id. Skipped files, embeddings (one a chunk), mean chunks a file, seconds (null while open) and the nodes and edges of the job's configuration."""
    rows = jobs.join(chunks_per_job, "job_id", "left").withColumn("chunks", F.coalesce("chunks", F.lit(0)))
    if {"started_at", "finished_at"} <= set(jobs.columns):
        rows = rows.withColumn("seconds", (F.unix_micros("finished_at") - F.unix_micros("started_at")) / 1e6)
    for name, table in (("graph_nodes", nodes), ("graph_edges", edges)):
        if table is not None:
            rows = rows.join(table.groupBy("config_id").agg(F.count("*").alias(name)), "config_id", "left").withColumn(name, F.coalesce(name, F.lit(0)))
    return rows.withColumns({"embeddings": F.col("chunks"), "skipped": F.col("total_files") - F.col("processed_files") - F.col("failed_files"), "avg_chunks_per_file": ratio(F.col("chunks"), F.col("processed_files"))})


def progress(jobs: DataFrame) -> DataFrame:
    return jobs.withColumn("progress", F.round(ratio(100.0 * F.col("processed_files"), F.col("total_files")), 6))


def outcome_counts(results: DataFrame, job: str) -> DataFrame:
    """results: job, status (ok, duplicate, failed), chunks, error and any of embeddings, nodes, edges. Duplicates count as processed."""
    more = [F.coalesce(F.sum(c), F.lit(0)).alias(c) for c in ("embeddings", "nodes", "edges") if c in results.columns]
    return results.groupBy(job).agg(*more, F.count_if(F.col("status").isin("ok", "duplicate")).alias("processed"), F.count_if(F.col("status") == "failed").alias("failed"), F.sum("chunks").alias("chunks"), F.array_sort(F.collect_set(F.when(F.col("status") == "failed", F.col("error")))).alias("errors"))


def job_log(jobs: DataFrame) -> DataFrame:
    """jobs: job_id, created_at, finished_at, status, errors, warnings. A row per log line: job_id, level, stamp (string), message."""
    stamp = lambda c: F.date_format(c, "yyyy-MM-dd'T'HH:mm:ss")
    part = lambda name, level: jobs.select("job_id", F.lit(level).alias("level"), stamp("created_at").alias("stamp"), F.explode(name).alias("message"))
    start = jobs.select("job_id", F.lit("INFO").alias("level"), stamp("created_at").alias("stamp"), F.lit("started").alias("message"))
    end = jobs.filter("finished_at is not null").select("job_id", F.when(F.col("status") == "failed", "ERROR").otherwise("INFO").alias("level"), stamp("finished_at").alias("stamp"), F.concat(F.lit("finished: "), "status").alias("message"))
    return part("errors", "ERROR").unionByName(part("warnings", "WARNING")).unionByName(start).unionByName(end)


def log_page(log: DataFrame, level: str | None = None, skip: int = 0, limit: int = 50) -> DataFrame:
    """Lines of a level, any case, newest stamp (as a string) first, with the number of all such lines; ties in order of job, level and message."""
    rows = log if level is None else log.filter(F.upper("level") == level.upper())
    total = rows.agg(F.count("*").alias("total"))
    # One row meets a page.
    return rows.orderBy(F.col("stamp").desc(), "job_id", "level", "message").offset(skip).limit(limit).crossJoin(F.broadcast(total))


def score_bucket(score: Column) -> Column:
    return F.when(score < 0.2, BUCKETS[0]).when(score < 0.4, BUCKETS[1]).when(score < 0.6, BUCKETS[2]).when(score < 0.8, BUCKETS[3]).otherwise(BUCKETS[4])


def evaluation_summary(runs: DataFrame, config: str, scores: str, created: str) -> DataFrame:
    """Per config and metric: runs that have it, mean (4 places), five histogram counts and the date range."""
    flat = runs.select(config, created, F.explode(scores).alias("metric", "score"))
    hist = [F.count_if(score_bucket(F.col("score")) == b).alias(f"b{i}") for i, b in enumerate(BUCKETS)]
    return flat.groupBy(config, "metric").agg(F.count("*").alias("runs"), F.round(F.round(F.avg("score"), 9), 4).alias("mean"), *hist, F.min(created).alias("first"), F.max(created).alias("last"))


def average_score(scores: Column) -> Column:
    v = F.map_values(scores)
    return F.when(F.size(v) == 0, F.lit(0.0)).otherwise(F.aggregate(v, F.lit(0.0), lambda s, x: s + x) / F.size(v))


def request_metrics(events: DataFrame, kind: str, value: str) -> DataFrame:
    """Counts, sum and exact quantiles per label, with a histogram over fixed bounds."""
    bounds = (1, 5, 10, 50, 100)
    le = [F.count_if(F.col(value) <= b).alias(f"le_{b}") for b in bounds]
    own = events.groupBy(kind).agg(F.count("*").alias("n"), F.sum(value).alias("total"), *le)
    q = exact_quantiles(events, kind, value, {"p50": 0.5, "p95": 0.95, "p99": 0.99}).withColumnRenamed(kind, "q_label")
    return own.join(q, F.col(kind).eqNullSafe(F.col("q_label"))).select(kind, "n", "total", "p50", "p95", "p99", *[f"le_{b}" for b in bounds])


def exact_quantiles(rows: DataFrame, by: str, value: str, shares: dict[str, float], splitters: int = 256) -> DataFrame:
    """``by`` and one column per share: exact quantiles with linear interpolation (null without values; NaN is above all). No task holds a label's values.

    Sketched splitters of each label (a bounded number, from a mergeable sketch) cut its values into ranges; counts of the ranges tell in which one each
    wanted rank lies; only the distinct values of those ranges, with their counts, are put in order. A value of any frequency is one row there, and ranges hold about
    1 / ``splitters`` of a label's distinct values.
    """
    ws = Workspace(rows.sparkSession, "quantiles")
    # Equal values become one row with a count before anything is ordered.
    counts = ws.keep(rows.select(F.col(by).alias("label"), F.col(value).cast("double").alias("v")).filter("v is not null").groupBy("label", "v").agg(F.count("*").alias("n")), "counts")
    cuts = counts.groupBy(F.col("label").alias("l")).agg(F.array_distinct(F.percentile_approx("v", [i / splitters for i in range(1, splitters)], 10 * splitters)).alias("cuts"), F.sum("n").alias("total"))
    ranged = counts.join(cuts, F.col("label").eqNullSafe(F.col("l"))).select("label", "v", "n", "total", F.size(F.filter("cuts", lambda c: c <= F.col("v"))).alias("range"))
    ranged = ws.keep(ranged, "ranges")
    sums = ranged.groupBy("label", "total", "range").agg(F.sum("n").alias("n"))
    before = sums.withColumn("before", F.sum("n").over(Window.partitionBy("label").orderBy("range")) - F.col("n"))
    # The two ranks, from 0, that a share lies between.
    at = lambda share: (F.col("total") - 1) * F.lit(share)
    wanted = F.array(*[F.struct(F.lit(name).alias("name"), F.floor(at(p)).alias("low"), F.ceil(at(p)).alias("high"), (at(p) - F.floor(at(p))).alias("part")) for name, p in shares.items()])
    holds = before.select("label", "range", "before", "n", F.explode(wanted).alias("q")).filter((F.col("q.high") >= F.col("before")) & (F.col("q.low") < F.col("before") + F.col("n")))
    needed = holds.select(F.col("label").alias("l"), F.col("range").alias("r"), "before").distinct()
    inside = ranged.join(needed, F.col("label").eqNullSafe(F.col("l")) & (F.col("range") == F.col("r"))).drop("l", "r")
    last = F.col("before") + F.sum("n").over(Window.partitionBy("label", "range").orderBy("v"))
    placed = inside.withColumn("last", last).withColumn("start", F.col("last") - F.col("n")).withColumn("q", F.explode(wanted))
    is_in = lambda r: (F.col(f"q.{r}") >= F.col("start")) & (F.col(f"q.{r}") < F.col("last"))
    ends = placed.filter(is_in("low") | is_in("high")).groupBy("label", "q.name").agg(F.max(F.when(is_in("low"), F.col("v"))).alias("low"), F.max(F.when(is_in("high"), F.col("v"))).alias("high"), F.first("q.part").alias("part"))
    one = ends.withColumn("v", F.when(F.col("low") == F.col("high"), F.col("low")).otherwise(F.col("low") + (F.col("high") - F.col("low")) * F.col("part")))
    columns = [F.max(F.when(F.col("name") == name, F.col("v"))).alias(name) for name in shares]
    labels = rows.select(F.col(by).alias("label")).distinct()
    got = one.groupBy(F.col("label").alias("l")).agg(*columns)
    return labels.join(got, F.col("label").eqNullSafe(F.col("l")), "left").select(F.col("label").alias(by), *shares)


def quantile_metrics(events: DataFrame, kind: str, value: str, accuracy: int = 10_000) -> DataFrame:
    """Counts, sum and quantiles per label from sketches, for labels of any size: a quantile's rank is within 1 / accuracy."""
    q = [F.percentile_approx(value, p, accuracy).alias(f"p{int(100 * p)}") for p in (0.5, 0.95, 0.99)]
    return events.groupBy(kind).agg(F.count("*").alias("n"), F.sum(value).alias("total"), *q)


def counters(events: DataFrame, name: str, labels: dict[str, str], amount: Column | None = None) -> DataFrame:
    """A counter by its labels (name of a label to its column): counter, labels, value; a missing label is unknown, without ``amount`` every event counts one."""
    keys = [F.coalesce(F.col(c).cast("string"), F.lit("unknown")).alias(k) for k, c in labels.items()]
    got = events.groupBy(*keys).agg((F.count("*") if amount is None else F.coalesce(F.sum(amount), F.lit(0))).cast("double").alias("value"))
    return got.select(F.lit(name).alias("counter"), F.concat_ws(",", *[F.concat(F.lit(k + "="), F.col(k)) for k in labels]).alias("labels"), "value")


def score_histogram(scores: DataFrame, metric: str, score: str) -> DataFrame:
    """Scores of each metric in the five fixed buckets."""
    return scores.groupBy(F.col(metric).alias("metric"), score_bucket(F.col(score)).alias("bucket")).agg(F.count("*").alias("n"))


def audit_counts(log: DataFrame) -> DataFrame:
    return log.groupBy("user_id", "action", "resource").agg(F.count("*").alias("n"))


def usage_counts(templates: DataFrame, clones: DataFrame, key: str) -> DataFrame:
    n = clones.groupBy(key).agg(F.count("*").alias("clones"))
    return templates.join(n, key, "left").withColumn("usage_count", F.col("usage_count") + F.coalesce("clones", F.lit(0))).drop("clones")


def migrated(configs: DataFrame, defaults: dict[str, Column]) -> DataFrame:
    """Missing blocks get their default and old versions become 2.0.0; ``changed`` names the fields touched."""
    old = F.coalesce("version", F.lit("")).rlike(r"^(1\..*)?$")
    changed = F.array_compact(F.array(*[F.when(F.col(c).isNull(), c) for c in defaults], F.when(old, "version")))
    return configs.withColumn("changed", changed).withColumns({c: F.coalesce(c, d) for c, d in defaults.items()} | {"version": F.when(old, "2.0.0").otherwise(F.col("version"))})


def lineage_rows(results: DataFrame, docs: DataFrame, queries: DataFrame) -> DataFrame:
    """results: query_id, chunk_id, doc_id, rank, score, content; queries: query_id, answer. One nested row a query; chunk previews of 200 characters, answers of 500."""
    rows = results.join(docs, "doc_id", "left")
    chunk = F.struct("rank", "chunk_id", "score", F.substring("content", 1, 200).alias("preview"), F.struct("doc_id", "file_path").alias("source_file"))
    nested = rows.groupBy("query_id").agg(F.array_sort(F.collect_list(chunk)).alias("chunks"))
    return queries.select("query_id", F.substring("answer", 1, 500).alias("answer_preview")).join(nested, "query_id", "left")


def lineage_list(lineage: DataFrame, config: str, skip: int = 0, limit: int = 20) -> DataFrame:
    """Lineage of a configuration, newest first, without its chunks."""
    rows = lineage.filter(F.col("config_id") == config).drop("chunks")
    return rows.orderBy(F.col("created_at").desc(), "query_id").offset(skip).limit(limit)


def attribution(lineage: DataFrame) -> DataFrame:
    """Which files fed which queries."""
    flat = lineage.select("query_id", F.explode("chunks").alias("c"))
    return flat.groupBy(F.col("c.source_file.file_path").alias("file_path")).agg(F.countDistinct("query_id").alias("queries"), F.count("*").alias("chunks"))


def hash_sample(df: DataFrame, key: str, rate: float) -> DataFrame:
    """The rows whose key hashes below the rate: the same rows every time."""
    return df.filter(F.conv(F.substring(F.md5(F.col(key).cast("string")), 1, 8), 16, 10).cast("long") < F.lit(int(rate * (1 << 32))))
