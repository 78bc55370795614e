"""Documents that a chunking task's Python holds at once."""

import pyarrow as pa

from corpusmill.operators import chunking as C


def test_pieces_of_a_few_documents_at_a_time(spark, monkeypatch):
    df = spark.createDataFrame([(1, "a")], "doc_id long, text string")
    monkeypatch.setattr(type(df), "mapInArrow", lambda self, f, schema: f)
    run = C.per_document(df, "doc_id", "text", lambda t: [(p, 0, 0) for p in t.split()])
    batch = pa.RecordBatch.from_arrays([pa.array(range(1000)), pa.array(["a b c", None, "d", ""] * 250)], names=["doc_id", "text"])
    out = list(run(iter([batch])))
    assert max(len(set(b["doc_id"].to_pylist())) for b in out) <= 128
    assert sum(len(b) for b in out) == 250 * 4 and [r for b in out for r in b["doc_id"].to_pylist()] == sorted(r for b in out for r in b["doc_id"].to_pylist())
