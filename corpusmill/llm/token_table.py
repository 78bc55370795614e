"""Operator 1: token ids as Parquet list columns that can be read selectively.

Layout: one row a document in ascending id order (range partitioned, sorted, so files and pages hold disjoint id ranges),
columns ``doc_id`` (delta encoded), ``n_tokens``, ``part``, ``part_start`` (ids before the document in its file part) and
``ids`` (list<int>, dictionary encoded: a vocabulary under 65,536 entries takes two bytes an id). Row groups, data pages
and rows a page are bounded, and the column and offset indexes let a reader skip to the pages of the documents it asks for.

Defined cases: a null or empty text has only the end id; an empty table gives empty files; rows with the same id are each
encoded, in the order of their texts; null ids come first; a very long text is one row, encoded whole; other columns are ignored.
"""

from __future__ import annotations

import zlib
from array import array
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from corpusmill.llm.tokenize import encoder, slices
from corpusmill.workspace import shuffle_partitions

TOKEN_SCHEMA = "doc_id long, n_tokens long, part int, part_start long, ids array<int>"
WRITE_OPTIONS = {
    "compression": "zstd",
    "parquet.writer.version": "PARQUET_2_0",
    "parquet.enable.dictionary": "true",
    "parquet.enable.dictionary#doc_id": "false",
    "parquet.enable.dictionary#part_start": "false",
    "parquet.dictionary.page.size": str(1 << 20),
    "parquet.block.size": str(32 << 20),
    "parquet.page.size": str(256 << 10),
    "parquet.page.row.count.limit": "1000",
}


def encode_partition(path: str, end_id: int | None):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        enc, part, before = encoder(path), TaskContext.get().partitionId(), 0
        end = b"" if end_id is None else array("I", [end_id]).tobytes()
        for batch in slices(batches):
            coded = [enc.encode(t) + end for t in batch.column(1).to_pylist()]
            sizes = np.fromiter((len(c) >> 2 for c in coded), "i8", len(coded))
            ends = np.cumsum(sizes)
            ids = pa.ListArray.from_arrays(pa.array(np.concatenate([[0], ends]).astype("i4")), pa.array(np.frombuffer(b"".join(coded), "<i4")))
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(sizes), pa.array(np.full(len(coded), part, "i4")), pa.array(before + ends - sizes), ids], names=["doc_id", "n_tokens", "part", "part_start", "ids"])
            before += int(ends[-1]) if len(ends) else 0

    return run


def write_token_table(docs: DataFrame, out: str, tokenizer: str, end_id: int | None = 2, id_col: str = "doc_id", text_col: str = "text", partitions: int | None = None) -> None:
    """Encodes every whole text and writes the token table to ``out``. Texts are dealt out before they are encoded, so that sampling the ids for the ranges encodes nothing."""
    plain = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).alias("text"))
    dealt = plain.repartitionByRange(partitions or shuffle_partitions(docs.sparkSession), "doc_id").sortWithinPartitions("doc_id", "text")
    dealt.mapInArrow(encode_partition(tokenizer, end_id), TOKEN_SCHEMA).write.options(**WRITE_OPTIONS).parquet(out)


def read_token_table(spark: SparkSession, path: str, first_id: int | None = None, last_id: int | None = None, tokens: bool = True) -> DataFrame:
    """The rows whose id lies in the closed range, or all; ``tokens=False`` reads the metadata columns only. Ranges are pushed down to row groups and pages."""
    df = spark.read.schema(TOKEN_SCHEMA).parquet(path)
    if first_id is not None:
        df = df.filter(F.col("doc_id") >= first_id)
    if last_id is not None:
        df = df.filter(F.col("doc_id") <= last_id)
    return df if tokens else df.drop("ids")


def with_starts(table: DataFrame, metadata: DataFrame) -> DataFrame:
    """Adds ``start``: ids of all documents before this one. Only one total per file part is brought together, and broadcast."""
    totals = metadata.groupBy("part").agg(F.sum("n_tokens").alias("total"))
    offsets = totals.select("part", F.coalesce(F.sum("total").over(Window.orderBy("part").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)).alias("offset"))
    return table.join(F.broadcast(offsets), "part").withColumn("start", F.col("offset") + F.col("part_start")).drop("offset")


def _digests(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in slices(batches):
        lists = batch.column(1)
        at, raw = lists.offsets.to_numpy().astype("i8"), memoryview(np.ascontiguousarray(lists.values.to_numpy(), "<u4")).cast("B")
        crc = np.fromiter((zlib.crc32(raw[4 * a : 4 * b]) for a, b in zip(at[:-1], at[1:])), "i8", len(lists))
        yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(np.diff(at)), pa.array(crc), *batch.columns[2:]], names=["doc_id", "n_tokens", "ids_crc32", "part", "part_start"])


def token_digest(spark: SparkSession, path: str) -> DataFrame:
    """Per document, from the files at ``path``: doc_id, start, n_tokens, ids_crc32."""
    table = read_token_table(spark, path).select("doc_id", "ids", "part", "part_start")
    rows = table.mapInArrow(_digests, "doc_id long, n_tokens long, ids_crc32 long, part int, part_start long")
    return with_starts(rows, read_token_table(spark, path, tokens=False)).select("doc_id", "start", "n_tokens", "ids_crc32")
