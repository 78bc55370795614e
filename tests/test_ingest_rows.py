"""Stream ingestion looks keys up alone and writes no text of a batch but the chunks."""

import tempfile

from corpusmill.streaming import keyed
from corpusmill.workspace import Workspace


def test_ingestion_keeps_keys_only_and_takes_a_null_key_once(spark, monkeypatch):
    base, kept, keep = tempfile.mkdtemp(prefix="spark-"), [], Workspace.keep
    monkeypatch.setattr(Workspace, "keep", lambda self, df, name, **o: kept.append(df.columns) or keep(self, df, name, **o))
    rows = [("a", "x"), ("a", "x"), ("", "y"), (None, "z"), (None, "z")]
    for file in (rows, [*rows, ("b", "w")]):
        spark.createDataFrame(file, "content_hash string, text string").coalesce(1).write.mode("append").parquet(f"{base}/in")
    stream = spark.readStream.schema("content_hash string, text string").option("maxFilesPerTrigger", 1).parquet(f"{base}/in")
    keyed.ingest_stream(stream, lambda b: b, f"{base}/stored", f"{base}/checkpoint", buckets=2)
    got = [tuple(r) for r in spark.read.parquet(f"{base}/stored").select("content_hash", "text").collect()]
    assert sorted(got, key=str) == sorted([("a", "x"), ("", "y"), (None, "z"), ("b", "w")], key=str)
    assert kept and not any("text" in columns for columns in kept)
