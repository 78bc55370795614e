"""Operator 2: exact deduplication by a distributed content sort.

Sampled splitters range-partition the normalised bytes: by their first characters, then their SHA-256, then the id, so that
splitters stay short however long the texts are and one huge group of equals is spread over many partitions. Each partition is
sorted externally by its whole normalised bytes, then the id, which places equals adjacent, and neighbours are compared in full. Only a text that
holds the first or last splitting key of a partition can go on in another; those few runs, two a partition, are joined up by their SHA-256.

Defined cases: null text counts as empty; of equal texts the smallest id stays, null ids last; of rows with the same id and
text one stays; a very long text travels once and is compared by its bytes; an empty table gives an empty result; other columns,
whatever their names, are carried or ignored.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark import TaskContext
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from corpusmill.workspace import Workspace, shuffle_partitions

WHITE = r"[\x20\x09-\x0D]+"


def normalised(text):
    """Null as empty, each run of ASCII white space as one space."""
    return F.regexp_replace(F.coalesce(text, F.lit("")), WHITE, " ")


HEAD = 24


def _sorted_by_content(df: DataFrame, id_col: str, text_col: str, carry: bool, partitions: int | None) -> DataFrame:
    """id, norm, sha and, if asked, the row itself."""
    cols = [F.col(f"`{id_col}`").cast("long").alias("id"), normalised(F.col(f"`{text_col}`")).alias("norm")]
    if carry:
        cols.append(F.struct(*[F.col(f"`{c}`") for c in df.columns]).alias("row"))
    keyed = df.select(*cols).withColumns({"head": F.substring("norm", 1, HEAD), "sha": F.unhex(F.sha2("norm", 256))})
    dealt = keyed.repartitionByRange(partitions or shuffle_partitions(df.sparkSession), "head", "sha", F.col("id").asc_nulls_last())
    return dealt.sortWithinPartitions("norm", F.col("id").asc_nulls_last()).select("id", "norm", "sha", *(["row"] if carry else []))


def _run_starts(norm: pa.Array, last: pa.Scalar | None) -> np.ndarray:
    """True where a row's text differs from its predecessor's (from ``last`` for the first row)."""
    starts = np.ones(len(norm), bool)
    if len(norm) > 1:
        starts[1:] = pc.not_equal(norm.slice(1), norm.slice(0, len(norm) - 1)).to_numpy(zero_copy_only=False)
    if last is not None and len(norm):
        starts[0] = not last.equals(norm[0])
    return starts


RUNS = "doc_id long, local_keep long, local_first boolean, local_size long, sha binary, part int, head string"


def _annotate(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """A row for each row, sent when its run has ended; of a run's rows only the ids are held. The first has the text's first characters too."""
    part = TaskContext.get().partitionId()
    out: list[list] = [[] for _ in range(7)]
    run: dict = {}

    def flush() -> None:
        ids = run["ids"]
        n = len(ids)
        head = [run["text"].as_py()[:HEAD]] + [None] * (n - 1)
        for column, values in zip(out, (ids, [ids[0]] * n, [True] + [False] * (n - 1), [n] * n, [run["sha"].as_py()] * n, [part] * n, head)):
            column.extend(values)

    def batch_out() -> pa.RecordBatch:
        kinds = (pa.int64(), pa.int64(), pa.bool_(), pa.int64(), pa.binary(), pa.int32(), pa.string())
        made = pa.RecordBatch.from_arrays([pa.array(v, k) for v, k in zip(out, kinds)], names=[c.split()[0] for c in RUNS.split(", ")])
        for column in out:
            column.clear()
        return made

    for batch in batches:
        ids, norm = batch.column(0).to_pylist(), batch.column(1)
        starts = np.flatnonzero(_run_starts(norm, run["text"] if run else None)).tolist()
        if run:
            run["ids"].extend(ids[: starts[0] if starts else len(ids)])
        for a, b in zip(starts, [*starts[1:], len(ids)]):
            if run:
                flush()
            run = {"text": norm[a], "sha": batch.column(2)[a], "ids": ids[a:b]}
        if out[0]:
            yield batch_out()
    if run:
        flush()
        yield batch_out()


def _joined_edges(runs: DataFrame) -> DataFrame:
    """runs: part, head, sha, id, size, one a text and partition. Gives part, sha, keep, total and whether the run stays, for texts that lie in several partitions: such a text has the least or greatest key of each."""
    ends = runs.groupBy("part").agg(F.min(F.struct("head", "sha")).alias("low"), F.max(F.struct("head", "sha")).alias("high"))
    ends = ends.select("part", F.explode(F.array_distinct(F.array(F.col("low.sha"), F.col("high.sha")))).alias("sha"))
    edges = runs.select("part", "sha", "id", "size").join(F.broadcast(ends), ["part", "sha"])
    every = Window.partitionBy("sha")
    first = F.min(F.struct(F.col("id").isNull().alias("none"), "id", "part")).over(every)
    return edges.withColumns({"total": F.sum("size").over(every), "first": first}).select("part", "sha", F.col("first.id").alias("keep"), "total", (F.col("first.part") == F.col("part")).alias("stays"))


def duplicate_groups(df: DataFrame, id_col: str = "doc_id", text_col: str = "text", partitions: int | None = None) -> DataFrame:
    """One row per row: doc_id, keep_id, group_size, kept, text_sha256 (of the normalised text)."""
    ws = Workspace(df.sparkSession, "content-sort")
    runs = ws.keep(_sorted_by_content(df, id_col, text_col, False, partitions).mapInArrow(_annotate, RUNS), "runs")
    edges = _joined_edges(runs.filter("local_first").select("part", "head", "sha", F.col("local_keep").alias("id"), F.col("local_size").alias("size")))
    # Two rows a partition at most.
    return runs.drop("head").join(F.broadcast(edges), ["part", "sha"], "left").select(
        "doc_id",
        F.when(F.col("total").isNull(), F.col("local_keep")).otherwise(F.col("keep")).alias("keep_id"),
        F.coalesce("total", "local_size").alias("group_size"),
        (F.col("local_first") & F.coalesce("stays", F.lit(True))).alias("kept"),
        F.lower(F.hex("sha")).alias("text_sha256"),
    )


def _heads(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """The first row of each run with all its columns."""
    part, last = TaskContext.get().partitionId(), None
    for batch in batches:
        if not len(batch):
            continue
        norm = batch.column(1)
        starts = pa.array(np.flatnonzero(_run_starts(norm, last)))
        last = norm[len(norm) - 1]
        if len(starts):
            heads = pc.utf8_slice_codeunits(norm.take(starts), 0, HEAD)
            yield pa.RecordBatch.from_arrays([batch.column(3).take(starts), batch.column(0).take(starts), pa.array([part] * len(starts), pa.int32()), heads, batch.column(2).take(starts)], names=["row", "id", "part", "head", "sha"])


def drop_duplicates(df: DataFrame, id_col: str = "doc_id", text_col: str = "text", partitions: int | None = None) -> DataFrame:
    """The rows that stay, with the columns of ``df``."""
    ws = Workspace(df.sparkSession, "content-sort")
    schema = T.StructType([T.StructField("row", df.schema, False), T.StructField("id", T.LongType()), T.StructField("part", T.IntegerType()), T.StructField("head", T.StringType()), T.StructField("sha", T.BinaryType())])
    heads = ws.keep(_sorted_by_content(df, id_col, text_col, True, partitions).mapInArrow(_heads, schema), "heads")
    more = _joined_edges(heads.select("part", "head", "sha", "id", F.lit(1).alias("size"))).filter("not stays").select("part", "sha")
    return heads.join(F.broadcast(more), ["part", "sha"], "left_anti").select("row.*")
