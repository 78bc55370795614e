"""Where user code plugs in: extractors, generators, scorers and chunkers as batch functions, built once a partition."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T


def _batched(df: DataFrame, key: str, columns: list[str], make: Callable[[], Callable[..., list]], out: str, kind: T.DataType, batch_size: int) -> DataFrame:
    """key, ``out``, error: a batch that raises is tried again row by row, and a row that raises becomes an error row."""
    schema = T.StructType([df.schema[key], T.StructField(out, kind), T.StructField("error", T.StringType())])
    from pyspark.sql.pandas.types import to_arrow_type

    arrow = to_arrow_type(kind)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        fn = make()
        for batch in batches:
            # Only the rows of one call are Python objects, and its results leave before the next.
            for at in range(0, len(batch), batch_size):
                part = batch.slice(at, batch_size)
                some, errors = [c.to_pylist() for c in part.columns[1:]], [None] * len(part)
                try:
                    values = list(fn(*some))
                except Exception:
                    values = []
                    for i, row in enumerate(zip(*some)):
                        try:
                            values.append(list(fn(*[[x] for x in row]))[0])
                        except Exception as e:
                            values.append(None)
                            errors[i] = f"{type(e).__name__}: {e}"
                yield pa.RecordBatch.from_arrays([part.column(0), pa.array(values, arrow), pa.array(errors, pa.string())], names=[key, out, "error"])

    return df.select(key, *columns).mapInArrow(run, schema)


EXTRACTED = T.StructType([T.StructField("content", T.StringType()), T.StructField("pages", T.IntegerType()), T.StructField("sections", T.IntegerType()), T.StructField("tables", T.IntegerType())])


def extract(files: DataFrame, make: Callable[[], Callable[[list, list], list]], path: str = "path", content: str = "content", batch_size: int = 16) -> DataFrame:
    """path, extracted (content, pages, sections, tables), error: ``make`` gives a function of (paths, bytes)."""
    both = files.withColumn("__path", F.col(path))
    return _batched(both, path, ["__path", content], make, "extracted", EXTRACTED, batch_size)


def generate(prompts: DataFrame, key: str, prompt: str, make: Callable[[], Callable[[list], list]], batch_size: int = 32) -> DataFrame:
    """key, reply, error."""
    return _batched(prompts, key, [prompt], make, "reply", T.StringType(), batch_size)


def score(runs: DataFrame, key: str, columns: list[str], metrics: dict[str, Callable[[], Callable[..., list]]], needs_truth: tuple[str, ...] = ("context_recall",), truth: str = "ground_truth") -> DataFrame:
    """key, metric, score, note. A scorer that raises scores 0 with the error; metrics that need a ground truth are skipped with 0 where there is none."""
    out = None
    for name, make in metrics.items():
        rows = _batched(runs, key, columns, make, "score", T.DoubleType(), 32).join(runs.select(key, F.col(truth).alias("__truth")), key)
        skip = F.lit(name in needs_truth) & F.col("__truth").isNull()
        one = rows.select(key, F.lit(name).alias("metric"), F.when(skip, 0.0).otherwise(F.coalesce("score", F.lit(0.0))).alias("score"), F.when(skip, "Skipped").otherwise(F.col("error")).alias("note"))
        out = one if out is None else out.unionByName(one)
    return out


def chunk_with(df: DataFrame, id_col: str, text: str, chunker: Callable[[str], Iterator[str]]) -> DataFrame:
    """id, chunk_index, content by a user's function from a text to its chunks, as a table function."""

    class Chunks:
        def eval(self, key, t: str):
            for i, c in enumerate(chunker(t or "")):
                yield key, i, c

    kind = df.schema[id_col].dataType.simpleString()
    fn = F.udtf(Chunks, returnType=f"__id {kind}, chunk_index int, content string", useArrow=True)
    rows = df.select(F.col(id_col).alias("__key"), F.col(text).alias("__text"))
    return rows.lateralJoin(fn(F.col("__key").outer(), F.col("__text").outer())).select(F.col("__id").alias(id_col), "chunk_index", "content")
