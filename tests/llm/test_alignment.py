"""Operator 13 against byte-by-byte alignment and the whole tokenizers."""

import hashlib
from collections import Counter

import numpy as np
import public_tokenizers as P
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from corpusmill.llm import token_alignment as T

PATHS = P.path("byte_bpe_50k.json"), P.path("piece_bpe_32k.model")
TEXT = st.one_of(st.text(max_size=60), st.text(alphabet=" aAbcé'sßñ.,!?12²½-—“”\n\tTheofqu<|>endtx", max_size=80), st.lists(st.sampled_from(["don't", "l'été", "  ", "the", "naïve", "Straße", "<s>", "</s>", "<|endoftext|>", "10,000", "x=1;", "\n\n", "¿Qué?", "ﬁ", "日本", "▁", " "]), max_size=12).map(" ".join))


@settings(deadline=None, max_examples=400)
@given(TEXT)
def test_units_encode_as_whole_texts(text):
    pair = T.token_pair(*PATHS)
    if text:
        got, want = pair.encode(text), pair.whole(text)
        assert (got is None) == (want is None) and (got is None or all((x == y).all() and len(x) == len(y) for x, y in zip(got, want)))


def plain_aligned(ends_a, ends_b):
    cuts = sorted(set(ends_a) & set(ends_b))
    starts_a, starts_b = [0, *ends_a[:-1]], [0, *ends_b[:-1]]
    links = [(i, j) for i in range(len(ends_a)) for j in range(len(ends_b)) if starts_a[i] < ends_b[j] and starts_b[j] < ends_a[i]]
    return [sum(e <= c for e in ends_a) for c in cuts], [sum(e <= c for e in ends_b) for c in cuts], sorted(links)


@settings(deadline=None, max_examples=400)
@given(st.lists(st.sampled_from("abx|"), max_size=70))
def test_walk_against_all_pairs(kinds):
    # a, b: an end of either; | of both; x: of none.
    a = [i + 1 for i, k in enumerate(kinds) if k in "a|"] + [len(kinds) + 1]
    b = [i + 1 for i, k in enumerate(kinds) if k in "b|"] + [len(kinds) + 1]
    group_a, group_b, link_a, link_b = T.aligned(np.array(a), np.array(b))
    assert (group_a.tolist(), group_b.tolist(), sorted(zip(link_a.tolist(), link_b.tolist()))) == plain_aligned(a, b)


@pytest.mark.parametrize("n", [0, 1, 2, 3, 7, 8, 9, 1000])
def test_runs_of_any_length(n):
    ends = np.arange(1, n + 1) * 3
    shifted = np.concatenate([ends, [3 * n + 1, 3 * n + 2, *(ends + 3 * n + 4)]])
    other = np.concatenate([ends, [3 * n + 2, *(ends + 3 * n + 4)]])
    got = T.aligned(shifted, other)
    assert got[0].tolist() == [*range(1, n + 1), n + 2, *range(n + 3, 2 * n + 3)] and len(got[2]) == 2 * n + 2


def plain(docs):
    pair, rows, counts = T.token_pair(*PATHS), [], Counter()
    for doc_id, text in docs:
        found = pair.whole(text) if text else None
        if found is None:
            rows.append((doc_id, 0, 0, 0, [], ""))
            continue
        a, b = (x.tolist() for x in found)
        ends = [np.cumsum([len(tokens[i]) for i in ids]).tolist() for ids, tokens in ((a, pair.a_tokens), (b, pair.b_tokens))]
        group_a, group_b, links = plain_aligned(*ends)
        digest = ";".join(",".join(map(str, a[p:q])) + "|" + ",".join(map(str, b[r:s])) for p, q, r, s in zip([0, *group_a], group_a, [0, *group_b], group_b))
        pairs = [(a[i], b[j]) for i, j in links]
        counts.update(set(pairs))
        rows.append((doc_id, len(a), len(b), len(group_a), pairs, hashlib.sha256(digest.encode()).hexdigest()))
    best = {}
    for (x, _), c in counts.items():
        best[x] = max(c, best.get(x, 0))
    return sorted(((d, n, m, g, len(p), sum(counts[x] == best[x[0]] for x in p), sum(counts[x] for x in p), h) for d, n, m, g, p, h in rows), key=str)


DOCS = [(1, "The quick brown fox doesn't jump."), (2, "Die Straße führt über 1,000 Brücken; naïve Leute — “wirklich”?"), (2, "Die Straße führt"), (3, None), (4, ""), (5, " "), (6, "a▁b"), (7, "<|endoftext|> <s> x"), (8, "日本語のテキスト and more"), (None, "the the the the"), (9, "x" * 3000 + " " + "lorem ipsum dolor " * 200), (1, "The quick brown fox doesn't jump."), (10, "tab\tnew\nline  two   three "), (11, "x\x00y")]


@pytest.mark.parametrize("options", [{}, {"sent": 0}, {"sent": 20, "held": 30}])
def test_digest_against_plain_alignment(spark, options):
    out = T.alignment_digest(spark.createDataFrame(DOCS, "doc_id long, text string"), *PATHS, **options)
    assert out.columns == ["doc_id", "n_a", "n_b", "n_groups", "n_links", "n_best", "count_sum", "groups_sha256"]
    assert sorted((tuple(r) for r in out.collect()), key=str) == plain(DOCS)


def test_empty_table_and_clashing_columns(spark):
    assert T.alignment_digest(spark.createDataFrame([], "doc_id long, text string"), *PATHS).collect() == []
    docs = spark.createDataFrame([(1, "some words", 3, "x")], "doc_id long, text string, n_a int, keys string")
    assert [tuple(r) for r in T.alignment_digest(docs, *PATHS).collect()] == plain([(1, "some words")])


def test_aligned_tokens(spark):
    rows = {r["doc_id"]: r for r in T.align_texts(spark.createDataFrame(DOCS[:4], "doc_id long, text string"), *PATHS).collect()}
    assert rows[3]["a_ids"] is None and rows[1]["a_ends"][-1] == len(rows[1]["a_ids"]) and rows[1]["b_ends"][-1] == len(rows[1]["b_ids"])
    assert T.token_pair(*PATHS).a.decode(rows[1]["a_ids"]).strip() == DOCS[0][1]
