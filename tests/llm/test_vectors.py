"""Operator 11 against brute force."""

import numpy as np
import pytest

from corpusmill.llm import sign_hashing as S


def plain(rows, least=0.93):
    """vec_id -> (n_links, component_id) of rows (vec_id, vector, label)."""
    good = [i for i, (_, v, label) in enumerate(rows) if label is not None and v and all(x is not None and np.isfinite(x) for x in v) and any(v)]
    up, links = list(range(len(rows))), [0] * len(rows)

    def root(i):
        while up[i] != i:
            i = up[i]
        return i

    for n, i in enumerate(good):
        for j in good[n + 1 :]:
            (_, a, la), (_, b, lb) = rows[i], rows[j]
            if la == lb and len(a) == len(b):
                a, b = (np.array(x, "f8") / max(map(abs, x)) for x in (a, b))
                if a @ b / np.sqrt((a @ a) * (b @ b)) >= least:
                    links[i] += 1
                    links[j] += 1
                    up[max(root(i), root(j))] = min(root(i), root(j))
    least_id = {}
    for i, (v, *_) in enumerate(rows):
        if v is not None:
            least_id[root(i)] = min(v, least_id.get(root(i), v))
    return sorted(((rows[i][0], links[i], least_id.get(root(i))) for i in range(len(rows))), key=str)


SCHEMA = "vec_id long, embedding array<double>, label string"


def got(spark, rows, schema=SCHEMA, **options):
    out = S.near_vectors(spark.createDataFrame(rows, schema), **options).collect()
    assert all(r["kept"] == (r["vec_id"] == r["component_id"]) for r in out)
    return sorted(((r["vec_id"], r["n_links"], r["component_id"]) for r in out), key=str)


def test_groups_chains_and_defined_cases(spark):
    rng = np.random.default_rng(3)
    base = rng.standard_normal((12, 16))
    near = [(100 + i, (base[i % 12] + rng.standard_normal(16) * s).tolist(), "ab"[i % 2]) for i, s in enumerate(np.linspace(0.02, 0.6, 150))]
    chain = [(300 + i, [float(np.cos(i * 0.3)), float(np.sin(i * 0.3))], "c") for i in range(20)]
    copies = [(5, base[0].tolist(), "a"), (4, base[0].tolist(), "a"), (4, base[0].tolist(), "a"), (3, (base[0] * 2).tolist(), "a"), (2, base[0].tolist(), "b"), (1, base[0].tolist(), None)]
    odd = [(6, None, "a"), (7, [], "a"), (8, [0.0, 0.0], "a"), (9, [float("nan"), 1.0], "a"), (10, [None, 1.0], "a"), (11, [float("inf"), 1.0], "a"), (12, [1e300, 1e300], "a"), (13, [1e-300, 1e-300], "a"), (14, [1.0], "a"), (None, [1.0, 0.99], "a"), (None, [3.0, -1.0], "z")]
    rows = near + chain + copies + odd
    assert got(spark, rows) == plain(rows)


def test_dense_group_over_many_blocks(spark):
    rng = np.random.default_rng(5)
    middle = rng.standard_normal(8)
    rows = [(i, (middle + rng.standard_normal(8) * 0.3).tolist(), "x") for i in range(400)] + [(1000 + i, rng.standard_normal(8).tolist(), "x") for i in range(200)]
    assert got(spark, rows, block=40, bucket=50) == plain(rows)


def test_empty_and_other_columns(spark):
    assert got(spark, []) == []
    rows = [(1, [1.0, 0.0], 4, "u", 9), (2, [1.0, 0.1], 4, "v", 9)]
    assert got(spark, rows, "vec_id long, embedding array<float>, label int, node string, links int") == [(1, 1, 1), (2, 1, 1)]


@pytest.mark.parametrize("similarity", [0.8, 0.93, 0.99])
def test_recall_at_the_threshold(spark, similarity):
    """Pairs exactly at the similarity are found with the promised probability."""
    rng = np.random.default_rng(7)
    rows = []
    for i in range(600):
        a, b = rng.standard_normal((2, 24))
        a /= np.linalg.norm(a)
        b -= (a @ b) * a
        b /= np.linalg.norm(b)
        c = similarity + 1e-6
        rows += [(2 * i, a.tolist(), str(i % 3)), (2 * i + 1, (c * a + (1 - c * c) ** 0.5 * b).tolist(), str(i % 3))]
    out = got(spark, rows, similarity=similarity, bucket=16)
    found = sum(1 for v, n, c in out if v % 2 == 0 and n >= 1)
    assert found >= 595


def test_plan():
    bits, tables = S.hash_plan(1 << 40, 0.93, 0.999, 512)
    assert bits == 30 and tables < 400
    assert S.hash_plan(10, 1.0, 0.999, 512) == (4, 1)


def test_links_at_the_threshold_are_exact():
    x = np.array([[1.0, 0.0], [0.6, 0.8], [0.6, 0.8000001]])
    a, b = S.linked_pairs(x, np.arange(3), None, 0.6)
    assert sorted(zip(a.tolist(), b.tolist())) == [(0, 1), (1, 2)]
