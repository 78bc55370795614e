"""File sources and sinks: folder scans, decoding, evaluation cases, verdict and trace exports."""

from __future__ import annotations

import datetime as dt
from urllib.parse import unquote

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from corpusmill.functions.text import human_size
from corpusmill.operators.corpus import processor_type


def _empty_files(spark: SparkSession, read: DataFrame) -> DataFrame:
    """Files of length 0, which a scan leaves out though its index lists them: the index, less what the scan gives."""
    local = F.regexp_replace("path", "^file:/+", "file:/")
    listed = spark.createDataFrame([(unquote(p),) for p in read.inputFiles()], "path string").select(local.alias("path"))
    Path = spark._jvm.org.apache.hadoop.fs.Path
    rows = []
    for (path,) in listed.join(read.select(local.alias("path")), "path", "left_anti").collect():
        where = Path(path)
        status = where.getFileSystem(spark._jsc.hadoopConfiguration()).getFileStatus(where)
        rows.append((path, dt.datetime.fromtimestamp(status.getModificationTime() / 1000), int(status.getLen()), b""))
    return spark.createDataFrame(rows, "path string, modificationTime timestamp, length long, content binary")


def scan_folders(spark: SparkSession, folders: list[tuple[str, bool]], exclude: tuple[str, ...] = (), content: bool = False) -> DataFrame:
    """Supported files of several (folder, recursive) pairs, empty ones too: path, modificationTime, length and, if asked, content. Paths with an excluded substring are left out."""
    out = None
    for folder, recursive in folders:
        read = spark.read.format("binaryFile").option("recursiveFileLookup", str(recursive).lower()).load(folder)
        one = read.unionByName(_empty_files(spark, read))
        one = one if content else one.drop("content")
        out = one if out is None else out.unionByName(one)
    out = out.filter(processor_type(F.col("path")).isNotNull())
    for part in exclude:
        out = out.filter(~F.col("path").contains(part))
    return out


def file_metadata(files: DataFrame) -> DataFrame:
    """path, length to name, suffix, folder, size and its readable form."""
    name = F.element_at(F.split("path", "/"), -1)
    return files.select("path", name.alias("file_name"), F.lower(F.regexp_extract(name, r".(\.[^.]+)$", 1)).alias("file_type"), F.regexp_replace("path", "/[^/]*$", "").alias("folder"), F.col("length").alias("file_size_bytes"), human_size(F.col("length")).alias("file_size"))


def decoded(content: Column) -> Column:
    """UTF-8 with or without a byte order mark, else Latin-1; line ends become LF."""
    text = F.when(F.is_valid_utf8(content.cast("string")), F.decode(content, "UTF-8")).otherwise(F.decode(content, "ISO-8859-1"))
    return F.regexp_replace(F.regexp_replace(text, "^﻿", ""), "\r\n?", "\n")


def load_cases(spark: SparkSession, path: str) -> DataFrame:
    """Evaluation cases from JSON files that hold {"cases": [...]} or a bare list. ``contexts`` stands in for ``retrieved_chunks`` where that is missing or empty; either may be a list or one string. No case at all is an error."""
    text = T.StringType()
    case = T.StructType([T.StructField(c, text) for c in ("id", "question", "retrieved_chunks", "contexts", "answer", "notes")] + [T.StructField("oracle_pass", T.BooleanType()), T.StructField("oracle_quality", T.DoubleType())])
    wrapped = T.StructType([T.StructField("cases", T.ArrayType(case)), *case.fields])
    rows = spark.read.option("multiLine", True).schema(wrapped).json(path)
    listed = rows.filter("cases is not null").select(F.explode("cases").alias("c")).select("c.*")
    every = listed.unionByName(rows.filter("cases is null and id is not null").select(*case.names))
    if every.isEmpty():
        raise ValueError(f"no evaluation cases in {path}")

    def several(c: str) -> Column:
        many = F.from_json(F.col(c), "array<string>")
        got = F.when(F.trim(c).startswith("["), many).when(F.col(c) != "", F.array(F.col(c)))
        return F.when(F.size(got) > 0, got)

    chunks = F.coalesce(several("retrieved_chunks"), several("contexts"), F.array().cast("array<string>"))
    return every.withColumns({"retrieved_chunks": chunks, "notes": F.coalesce("notes", F.lit(""))}).drop("contexts")


def write_latest(summary: DataFrame, path: str, **about) -> None:
    """A summary of a comparison as one JSON record: what ``about`` says (mode, repeats, cap, ...) and each judge's row under its name."""
    rows = summary.groupBy().agg(F.map_from_entries(F.array_sort(F.collect_list(F.struct("judge", F.struct(*[c for c in summary.columns if c != "judge"]))))).alias("summaries"))
    rows.select(*[F.lit(v).alias(k) for k, v in sorted(about.items())], "summaries").coalesce(1).write.json(path)


def write_verdicts(verdicts: DataFrame, path: str) -> None:
    """CSV with fixed decimals: quality 6, groundedness 6, latency 3, cost 8."""
    fixed = {"quality": 6, "groundedness": 6, "latency_ms": 3, "cost_usd": 8}
    verdicts.select(*[F.format_string(f"%.{fixed[c]}f", F.col(c).cast("double")).alias(c) if c in fixed else c for c in verdicts.columns]).write.option("header", True).csv(path)


def export_traces(runs: DataFrame, path: str, newest: int, config: str | None = None) -> None:
    """The newest evaluation runs as cases without oracles."""
    some = runs if config is None else runs.filter(F.col("config_id") == config)
    some = some.orderBy(F.col("created_at").desc(), "run_id").limit(newest)
    some.select(F.col("run_id").cast("string").alias("id"), F.col("query").alias("question"), F.col("contexts").alias("retrieved_chunks"), "answer", F.lit(None).cast("boolean").alias("oracle_pass"), F.lit(None).cast("double").alias("oracle_quality")).write.json(path)
