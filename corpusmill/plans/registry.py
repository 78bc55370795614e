"""Queries by name with the SQL that gives the same rows, and fixtures both derive from the tables."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLE: dict[str, str] = {}


def query(sql: str | None = None, *ctes: str):
    """Registers ``f(t)``, where t(name) reads a table, under its own name."""

    def wrap(f):
        def run(spark: SparkSession, sf_dir: str) -> DataFrame:
            return f(Tables(spark, sf_dir))

        run.__name__ = f.__name__
        QUERIES[f.__name__] = run
        if sql:
            ORACLE[f.__name__] = (f"WITH {', '.join(ctes)} {sql}") if ctes else sql
        return f

    return wrap


class Tables:
    def __init__(self, spark: SparkSession, sf_dir: str):
        self.spark, self.sf_dir = spark, sf_dir

    def __call__(self, name: str) -> DataFrame:
        return self.spark.read.parquet(f"{self.sf_dir}/{name}.parquet")


# Fixtures: corpus files, chunks, jobs and so on, in Spark and as SQL of the same rows.

EXTENSIONS = ("txt", "md", "rst", "log", "pdf", "html", "csv", "xyz")


def files(t: Tables) -> DataFrame:
    d = t("documents")
    ext = F.element_at(F.array(*map(F.lit, EXTENSIONS)), (F.col("doc_id") % 8 + 1).cast("int"))
    return d.select("doc_id", "text", "lang", F.col("source").alias("folder"), F.concat(F.lit("/data/"), "source", F.lit("/"), F.col("doc_id").cast("string"), F.lit("."), ext).alias("path"), F.concat(F.lit("cfg"), (F.col("doc_id") % 4).cast("string")).alias("config_id"))


FILES = """files AS (SELECT doc_id, text, lang, source AS folder, '/data/' || source || '/' || doc_id || '.' || (['txt','md','rst','log','pdf','html','csv','xyz'])[CAST(doc_id % 8 + 1 AS INT)] AS path, 'cfg' || (doc_id % 4) AS config_id FROM documents)"""


def chunks(t: Tables) -> DataFrame:
    from corpusmill.operators.chunking import fixed_windows

    rows = fixed_windows(t("documents"), "doc_id", "text")
    return rows.select("doc_id", F.col("source").alias("folder"), "lang", F.concat(F.col("doc_id").cast("string"), F.lit(":"), F.col("chunk_index").cast("string")).alias("chunk_id"), "chunk_index", "start_char", "end_char", "content")


CHUNKS = r"""chunks AS (SELECT doc_id, folder, lang, doc_id || ':' || (row_number() OVER (PARTITION BY doc_id ORDER BY start_char) - 1) AS chunk_id, row_number() OVER (PARTITION BY doc_id ORDER BY start_char) - 1 AS chunk_index, start_char, end_char, content FROM (
    SELECT doc_id, source AS folder, lang, length(text) AS n, s AS start_char, least(s + 1000, length(text)) AS end_char, regexp_replace(substr(text, s + 1, 1000), '^\s+|\s+$', '', 'g') AS content FROM (SELECT *, unnest(range(0, length(text), 900)) AS s FROM documents)) WHERE length(content) >= 50 OR end_char = n)"""


def jobs(t: Tables) -> DataFrame:
    n = t("lineitem").groupBy("l_orderkey").agg(F.count("*").alias("total_files"), F.count_if(F.col("l_linestatus") == "F").alias("processed_files"), F.count_if((F.col("l_linestatus") != "F") & (F.col("l_returnflag") == "R")).alias("failed_files"))
    status = F.when(F.col("o_orderstatus") == "F", "completed").when(F.col("o_orderstatus") == "P", "failed").otherwise("running")
    o = t("orders").select(F.col("o_orderkey").alias("job_id"), F.concat(F.lit("cfg"), (F.col("o_custkey") % 10).cast("string")).alias("config_id"), status.alias("status"), F.col("o_orderdate").alias("created_at"), F.col("o_custkey").alias("user_id"))
    return o.join(n, o["job_id"] == n["l_orderkey"], "left").select("job_id", "config_id", "status", "created_at", "user_id", *[F.coalesce(c, F.lit(0)).alias(c) for c in ("total_files", "processed_files", "failed_files")])


JOBS = """jobs AS (SELECT o_orderkey AS job_id, 'cfg' || (o_custkey % 10) AS config_id, CASE o_orderstatus WHEN 'F' THEN 'completed' WHEN 'P' THEN 'failed' ELSE 'running' END AS status, o_orderdate AS created_at, o_custkey AS user_id, coalesce(total_files, 0) AS total_files, coalesce(processed_files, 0) AS processed_files, coalesce(failed_files, 0) AS failed_files
    FROM orders LEFT JOIN (SELECT l_orderkey, count(*) AS total_files, count(*) FILTER (l_linestatus = 'F') AS processed_files, count(*) FILTER (l_linestatus <> 'F' AND l_returnflag = 'R') AS failed_files FROM lineitem GROUP BY 1) ON o_orderkey = l_orderkey)"""
