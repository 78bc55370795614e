"""Summary trees by vectors, paths from both ends and prefix suggestions against plain loops."""

import hashlib
import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from corpusmill.operators import chunking as C
from corpusmill.operators import graph as G
from corpusmill.operators import retrieval as R
from test_operators import kmeans_clusters


@pytest.mark.parametrize("block", [3, 256])
def test_clusters_of_many_documents_at_once(spark, block):
    rng = np.random.default_rng(2)
    # Whole numbers: sums are exact in any order. Document 0 holds most chunks; indexes have gaps.
    sizes = {0: 150, 1: 1, 2: 4, 3: 10, 4: 37, 5: 23}
    rows = {d: [(d, int(7 * i + i % 3), rng.integers(0, 6, 3).astype(float).tolist()) for i in range(n)] for d, n in sizes.items()}
    rows[5] = [(5, i, [1.0, 1.0, 1.0]) for i in range(23)]
    df = spark.createDataFrame([r for d in rows.values() for r in d], "doc_id long, chunk_index int, v array<double>").repartition(5)
    got = {(r[0], r[1]): r[2] for r in C.cluster_chunks(df, "doc_id", "v", block=block).collect()}
    for d, own in rows.items():
        assert [got[(d, i)] for _, i, _ in own] == kmeans_clusters(np.array([v for *_, v in own]), max(1, len(own) // 5)).tolist()
    assert len(got) == sum(sizes.values())


def plain_tree(contents, embed, levels=3):
    out, level = [], contents
    for n in range(1, levels + 1):
        if len(level) < 2:
            break
        if len(level) > 5:
            own = kmeans_clusters(np.array([embed(i, c) for i, c in enumerate(level)]), max(1, len(level) // 5)).tolist()
            groups = [[c for c, o in zip(level, own) if o == k] for k in dict.fromkeys(own)]
        else:
            groups = [level]
        new = ["\n\n---\n\n".join(g)[:8000][:500] for g in groups]
        out += [(n, i, len(g), hashlib.md5("|".join(hashlib.md5(c.encode()).hexdigest() for c in g).encode()).hexdigest(), s) for i, (g, s) in enumerate(zip(groups, new))]
        level = new
    return out


def test_tree_of_three_levels_against_a_plain_loop(spark):
    rng, docs = random.Random(4), {}
    for d, n in enumerate((160, 40, 6, 3, 1)):
        docs[d] = [" ".join(rng.choices(["red", "green", "blue", "long", "short"], k=rng.randrange(2, 60))) for _ in range(n)]
    rows = [(d, i, 0, c) for d, own in docs.items() for i, c in enumerate(own)]
    leaves = spark.createDataFrame(rows, "doc_id long, chunk_index int, tree_level int, content string")
    vec = F.array(F.length("content").cast("double"), (F.col("chunk_index") % 4 * 50).cast("double"))
    tree = C.raptor_tree(leaves, "doc_id", embed=lambda level: level.withColumn("vec", vec)).filter("tree_level > 0").collect()
    got = sorted((r["doc_id"], r["tree_level"], r["chunk_index"], r["children"], r["parent_id"], r["content"]) for r in tree)
    want = sorted((d, *r) for d, own in docs.items() for r in plain_tree(own, lambda i, c: [float(len(c)), i % 4 * 50.0]))
    assert got == want and {r[1] for r in got} == {1, 2, 3}


def plain_path(links, a, b, most):
    level, seen = {a: [a]}, {a}
    for _ in range(most):
        if b in level:
            break
        new = {}
        for u, path in level.items():
            for v in links.get(u, ()):
                if v not in seen:
                    new[v] = min(new.get(v, [10**9]), path + [v])
        seen |= set(new)
        level = new
    return level.get(b)


def test_paths_from_both_ends(spark):
    rng, links = random.Random(8), {}
    edges = [(rng.randrange(60), rng.randrange(60)) for _ in range(75)] + [(0, n) for n in range(60, 120)] + [(200, 201)]
    for a, b in edges:
        links.setdefault(a, set()).add(b)
        links.setdefault(b, set()).add(a)
    pairs = [(n, rng.randrange(62), rng.randrange(62)) for n in range(60)] + [(60, 5, 5), (61, 200, 3), (62, 70, 80), (63, 999, 3), (64, None, 3), (65, 200, 201)]
    for most in (1, 4, 5):
        got = {r["pair"]: r["path"] for r in G.shortest_paths(spark.createDataFrame(edges, "src long, dst long"), spark.createDataFrame(pairs, "pair long, a long, b long"), most).collect()}
        assert len(got) == len(pairs) and got[60] == []
        for n, a, b in pairs:
            if a != b:
                assert got[n] == plain_path(links, a, b, most), (n, a, b, most)


def test_suggestions_of_many_prefixes(spark):
    texts = [(2, "Where whales; what_ever WHAT élan Élan"), (1, "nowhere Wherever where internationalisation"), (3, None), (4, "")]
    words = R.term_dictionary(spark.createDataFrame(texts, "chunk_id long, content string"))
    asked = spark.createDataFrame([("wh",), ("WHAT",), ("él",), ("internationalis",), ("internationalz",), ("",), (None,), ("wh",)], "prefix string")
    got = {}
    for r in sorted(R.suggestions(words, asked, 4).collect()):
        got.setdefault(r["prefix"], []).append(r["word"])
    assert got == {"wh": ["Wherever", "where", "Where", "whales"], "WHAT": ["what_ever", "WHAT"], "él": ["élan", "Élan"], "internationalis": ["internationalisation"]}
