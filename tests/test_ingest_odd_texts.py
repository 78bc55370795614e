"""Stream ingestion over documents without text, against its SQL."""

import duckdb
import pytest

from corpusmill.plans import ORACLE, QUERIES

TEXTS = ["", "", None, None, "x", "y" * 900, "é" * 901, " " * 2000, "x"]


@pytest.mark.parametrize("texts", [TEXTS, [], [""], [None]])
@pytest.mark.parametrize("name", ["n4_stream_ingest", "n4_ingest_in_batches"])
def test_texts_without_chunks_have_a_row(spark, tmp_path, name, texts):
    spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string").coalesce(1).write.parquet(f"{tmp_path}/documents.parquet")
    got = QUERIES[name](spark, str(tmp_path))
    con = duckdb.connect()
    con.execute(f"CREATE VIEW documents AS SELECT * FROM read_parquet('{tmp_path}/documents.parquet/*.parquet')")
    want = con.execute(ORACLE[name])
    names = [d[0] for d in want.description]
    assert sorted(map(tuple, got.select(names).collect()), key=str) == sorted(want.fetchall(), key=str)
