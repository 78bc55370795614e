"""Short documents take all steps of k-means in one task, with the results of the dealt form."""

import numpy as np

from corpusmill import workspace as W
from corpusmill.operators import chunking as C


def test_short_documents_write_no_table_a_step(spark, monkeypatch):
    rng, kept = np.random.default_rng(7), []
    sizes = {0: 700, 1: 1, 2: 6, 3: 90, 4: 301}
    rows = [(d, i, rng.normal(size=16).tolist()) for d, n in sizes.items() for i in range(n)]
    df = spark.createDataFrame(rows, "doc_id long, chunk_index int, v array<double>").repartition(3)
    keep = W.Workspace.keep
    monkeypatch.setattr(W.Workspace, "keep", lambda self, t, name, **o: kept.append(name) or keep(self, t, name, **o))
    clusters = lambda **o: sorted(map(tuple, C.cluster_chunks(df, "doc_id", "v", **o).collect()))
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", "97")
    try:
        got = clusters()
    finally:
        spark.conf.unset("spark.sql.execution.arrow.maxRecordsPerBatch")
    assert len(got) == sum(sizes.values()) and len(kept) <= 3
    assert got == clusters(whole=0) == clusters(whole=100)


def test_terms_are_hashed_once_a_row(spark):
    """Against the plain count, on as many texts as took minutes when each of 16 places split the text anew for each of its sums."""
    import time

    from pyspark.sql import functions as F

    from corpusmill.operators.embedding import hashed_terms

    texts = spark.range(20_000).select(F.concat_ws(" ", *[F.concat(F.lit("w"), ((F.col("id") * p) % 97).cast("string")) for p in (1, 3, 7, 11, 13, 17, 19, 23, 29, 31)]).alias("t"))
    began = time.time()
    got = texts.select("t", hashed_terms(F.col("t"), 16).alias("v")).groupBy("t").agg(F.max("v").alias("v")).collect()
    assert time.time() - began < 30
    words = sorted({w for t, _ in got for w in t.split()})
    at = {r[0]: (r[1] % 16, 1.0 if (r[1] >> 32) % 2 == 0 else -1.0) for r in spark.createDataFrame([(w,) for w in words], "w string").select("w", F.xxhash64("w")).collect()}
    for t, v in got:
        want = np.zeros(16)
        for w in t.split():
            want[at[w][0]] += at[w][1]
        n = np.sqrt((want**2).sum())
        assert v == (want / n if n else want).tolist()
