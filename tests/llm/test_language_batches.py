from types import SimpleNamespace

import numpy as np
import public_tokenizers
import pyarrow as pa

from corpusmill.llm import langid


def test_a_large_batch_is_told_in_parts_with_all_its_rows():
    path = public_tokenizers.path("word_bpe_49k.json")
    prob = np.full((2, len(langid.vocabulary(path)) + 1), 1e-4)
    batch = pa.RecordBatch.from_arrays([pa.array(range(2500)), pa.array(["some words"] * 2500)], names=["id", "text"])
    out = list(langid._predict(path, ["a", "b"], SimpleNamespace(value=prob))(iter([batch])))
    assert [len(b) for b in out] == [1000, 1000, 500]
    assert [x for b in out for x in b["id"].to_pylist()] == list(range(2500))
