"""Pairs of blocks that a search task's Python holds at once."""

import tracemalloc

import numpy as np
import pyarrow as pa

from corpusmill.operators import retrieval as R


def test_pairs_of_blocks_are_read_one_at_a_time():
    rng = np.random.default_rng(1)
    x, q = rng.standard_normal((2000, 64)), rng.standard_normal((10, 64))
    n = 20
    columns = [pa.array([list(range(i * 2000, i * 2000 + 2000)) for i in range(n)]), pa.array([64] * n, pa.int32()), pa.array([x.tobytes()] * n), pa.array([list(range(10))] * n), pa.array([64] * n, pa.int32()), pa.array([q.tobytes()] * n)]
    batch = pa.RecordBatch.from_arrays(columns, names=["ids", "n", "x", "qids", "qn", "q"])
    tracemalloc.start()
    got = next(R._best_of_blocks(5, pa.int64(), pa.int64())(iter([batch])))
    peak = tracemalloc.get_traced_memory()[1]
    tracemalloc.stop()
    s = q @ x.T
    assert sorted(zip(got["query_id"].to_pylist(), got["chunk_id"].to_pylist())) == [(i, j) for i in range(10) for j in sorted(np.argsort(-s[i])[:5].tolist())]
    assert peak < 8_000_000


def test_user_functions_get_rows_of_one_call_at_a_time(spark, monkeypatch):
    from corpusmill.operators import plugins as P

    taken = []
    frame = spark.createDataFrame([(1, "")], "doc_id long, text string")
    monkeypatch.setattr(type(frame), "mapInArrow", lambda self, run, schema: taken.append(run))

    def make():
        def fn(texts):
            if any(t.startswith("7 ") for t in texts):
                raise ValueError("seven")
            return [t[:10] for t in texts]

        return fn

    P.generate(frame, "doc_id", "text", make)
    texts = [f"{i} " + "x" * 2000 for i in range(5000)]
    batch = pa.RecordBatch.from_arrays([pa.array(range(5000)), pa.array(texts)], names=["doc_id", "text"])
    tracemalloc.start()
    parts = taken[0](iter([batch]))
    got = [next(parts)]
    peak = tracemalloc.get_traced_memory()[1]
    tracemalloc.stop()
    got = pa.Table.from_batches([*got, *parts])
    assert got["doc_id"].to_pylist() == list(range(5000)) and got["reply"].to_pylist() == [None if i == 7 else t[:10] for i, t in enumerate(texts)]
    assert [i for i, e in enumerate(got["error"].to_pylist()) if e] == [7] and got["error"][7].as_py() == "ValueError: seven"
    assert peak < 1_000_000
