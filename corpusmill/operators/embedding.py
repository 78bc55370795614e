"""Embedding stage: pluggable batch embedders, pooling, caches and audits."""

from __future__ import annotations

import time
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from corpusmill.functions.text import terms


def embed(df: DataFrame, key: str, text: str, make: Callable[[], Callable[[list[str]], np.ndarray]], model: str, batch_size: int = 64, retries: int = 3, backoff: float = 1.0) -> DataFrame:
    """key, embedding, model, dimensions, error. ``make`` is called once a partition and returns the batch function; a batch is tried ``retries`` times, after ``backoff`` seconds, then twice as many; one that never works becomes error rows, not a failed job."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        fn = make()
        for batch in batches:
            texts, vectors, errors = batch.column(1).to_pylist(), [], []
            for at in range(0, len(texts), batch_size):
                some = texts[at : at + batch_size]
                for turn in range(retries):
                    try:
                        got, why = [row.tolist() for row in np.asarray(fn(some), "f4")], None
                        break
                    except Exception as e:
                        got, why = [None] * len(some), f"{type(e).__name__}: {e}"
                        if turn + 1 < retries:
                            time.sleep(backoff * 2**turn)
                vectors += got
                errors += [why] * len(some)
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(vectors, pa.list_(pa.float32())), pa.array(errors, pa.string())], names=[key, "embedding", "error"])

    schema = T.StructType([df.schema[key], T.StructField("embedding", T.ArrayType(T.FloatType())), T.StructField("error", T.StringType())])
    return df.select(key, text).mapInArrow(run, schema).withColumns({"model": F.lit(model), "dimensions": F.when(F.col("embedding").isNotNull(), F.size("embedding"))})


def hashed_terms(c: Column, dims: int = 64) -> Column:
    """A deterministic stand-in for a model: signed counts of hashed terms, of unit length."""
    from corpusmill.functions.vectors import normalised, once

    hashes = F.transform(terms(c), lambda x: F.xxhash64(x))
    slots = lambda hs: F.transform(F.sequence(F.lit(0), F.lit(dims - 1)), lambda i: F.aggregate(F.filter(hs, lambda h: F.pmod(h, F.lit(dims)) == i), F.lit(0.0), lambda s, h: s + F.when(F.pmod(F.shiftright(h, 32), F.lit(2)) == 0, 1.0).otherwise(-1.0)))
    return normalised(once(hashes, slots))


def mean_pooled(tokens: DataFrame, key: str, vec: str) -> DataFrame:
    """One mean vector a key. Sums per position are partial, so a key of any size is never gathered."""
    flat = tokens.select(key, F.posexplode(vec).alias("dim", "x")).groupBy(key, "dim").agg(F.avg(F.col("x").cast("double")).alias("x"))
    return flat.groupBy(key).agg(F.transform(F.array_sort(F.collect_list(F.struct("dim", "x"))), lambda s: s["x"]).alias("pooled"))


def span_pooled(spans: DataFrame, tokens: DataFrame, doc: str, vec: str) -> DataFrame:
    """Mean of the token vectors in [start_token, end_token) of each span of a document. Spans are laid out as their tokens, which makes the range an equi-join."""
    cells = spans.select(doc, "span", F.explode(F.sequence("start_token", F.col("end_token") - 1)).alias("token"))
    met = cells.join(tokens.select(doc, "token", vec), [doc, "token"])
    flat = met.select(doc, "span", F.posexplode(vec).alias("dim", "x")).groupBy(doc, "span", "dim").agg(F.avg(F.col("x").cast("double")).alias("x"))
    return flat.groupBy(doc, "span").agg(F.transform(F.array_sort(F.collect_list(F.struct("dim", "x"))), lambda s: s["x"]).alias("pooled"))


def cache_key(model: str, text: Column) -> Column:
    return F.concat(F.lit(model + ":"), F.sha2(text, 256))


def through_cache(texts: DataFrame, cache: DataFrame, key: str, text: str, model: str, compute: Callable[[DataFrame], DataFrame]) -> tuple[DataFrame, DataFrame]:
    """(rows with their vectors and whether they hit, new cache rows). ``compute`` gets each distinct missing text once: cache_key, text to cache_key, vector."""
    keyed = texts.withColumn("cache_key", cache_key(model, F.col(text)))
    misses = keyed.select("cache_key", F.col(text).alias("text")).join(cache.select("cache_key"), "cache_key", "left_anti").dropDuplicates(["cache_key"])
    new = compute(misses)
    both = cache.select("cache_key", "vector", F.lit(True).alias("hit")).unionByName(new.select("cache_key", "vector", F.lit(False).alias("hit")))
    return keyed.join(both, "cache_key"), new


def live_entries(cache: DataFrame, asof: Column, ttl_seconds: int, *key: str) -> DataFrame:
    """The newest entry of each key that has not expired."""
    rest = [c for c in cache.columns if c not in key]
    alive = cache.filter(F.col("cached_at") + F.make_dt_interval(secs=F.lit(ttl_seconds)) > asof)
    return alive.groupBy(*key).agg(F.max_by(F.struct(*rest), "cached_at").alias("row")).select(*key, "row.*")


def invalidated(cache: DataFrame, *configs: str) -> DataFrame:
    """The cache without the entries of these configurations."""
    return cache.filter(~F.coalesce(F.col("config_id").isin(*configs), F.lit(False)))


def dimension_audit(vectors: DataFrame, expected: DataFrame, model: str, vec: str) -> DataFrame:
    """Rows by model and verdict: ok, empty or mismatch."""
    n = F.size(F.coalesce(vec, F.array()))
    verdict = F.when(n == 0, "empty").when(n == F.col("expected"), "ok").otherwise("mismatch")
    return vectors.join(expected, model, "left").withColumn("verdict", verdict).groupBy(model, "verdict").agg(F.count("*").alias("n"))
