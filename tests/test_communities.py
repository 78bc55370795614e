"""Modularity communities and their levels against a plain Louvain, exact sums and plain digests."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from corpusmill.operators import communities as C
from corpusmill.operators import graph as G
from corpusmill.plans import QUERIES


def planted(seed=4, groups=12, size=25, inside=150, across=200):
    rng = np.random.default_rng(seed)
    pairs = [(g * size + int(a), g * size + int(b)) for g in range(groups) for a, b in rng.integers(0, size, (inside, 2)) if a != b]
    return pairs + [(int(a), int(b)) for a, b in rng.integers(0, groups * size, (across, 2)) if a != b]


def weights(pairs):
    w = {}
    for a, b in pairs:
        w.setdefault(a, {})
        w.setdefault(b, {})
        w[a][b] = w[a].get(b, 0) + 1
        w[b][a] = w[b].get(a, 0) + 1
    return w


def quality(pairs, label, gamma):
    m, degree = len(pairs), {}
    for a, b in pairs:
        for x in (a, b):
            degree[label[x]] = degree.get(label[x], 0) + 1
    return sum(label[a] == label[b] for a, b in pairs) / m - gamma * sum(d * d for d in degree.values()) / (4 * m * m)


def plain_louvain(pairs, gamma, seed=0):
    """One node after the other, in random order, level by level."""
    rng, total = np.random.default_rng(seed), 2 * len(pairs)
    w = {u: dict(n) for u, n in weights(pairs).items()}
    where = {u: u for u in w}
    while True:
        k = {u: sum(n.values()) for u, n in w.items()}
        label, size, moved_ever = {u: u for u in w}, dict(k), False
        while True:
            moved = False
            for u in rng.permutation(list(w)).tolist():
                size[label[u]] -= k[u]
                to = {label[u]: 0}
                for v, x in w[u].items():
                    if v != u:
                        to[label[v]] = to.get(label[v], 0) + x
                best = max(to, key=lambda c: (to[c] - gamma * k[u] * size[c] / total, c == label[u]))
                moved |= best != label[u]
                label[u] = best
                size[best] += k[u]
            moved_ever |= moved
            if not moved:
                break
        where = {u: label[c] for u, c in where.items()}
        if not moved_ever:
            return where
        up = {}
        for u, n in w.items():
            for v, x in n.items():
                up.setdefault(label[u], {})
                up[label[u]][label[v]] = up[label[u]].get(label[v], 0) + x
        w = up


@pytest.fixture(scope="module")
def graph(spark):
    pairs = planted()
    return pairs, spark.createDataFrame([(a, b, 1.0) for a, b in pairs], "src long, dst long, weight double").cache()


@pytest.mark.parametrize("gamma", [1.0])
def test_quality_and_levels(spark, graph, gamma):
    pairs, edges = graph
    tree = C.community_levels(edges, gamma).cache()
    rows = C.members_by_level(tree).collect()
    nodes, levels = {x for p in pairs for x in p}, sorted({r["level"] for r in rows})
    reached = []
    for level in levels:
        label = {r["node"]: r["community"] for r in rows if r["level"] == level}
        # Each level partitions the nodes, its communities are named by their smallest node, and its modularity is the one told.
        assert set(label) == nodes and sum(r["level"] == level for r in rows) == len(nodes)
        assert all(label[c] == c and c == min(x for x in label if label[x] == c) for c in set(label.values()))
        reached.append(quality(pairs, label, gamma))
        assert abs(next(r["quality"] for r in rows if r["level"] == level) - reached[-1]) < 1e-9
    assert reached == sorted(reached)
    plain = max(quality(pairs, plain_louvain(pairs, gamma, s), gamma) for s in range(3))
    labels = {r["node"]: r["label"] for r in G.label_communities(edges).collect()}
    assert reached[-1] >= plain - 0.02 and reached[-1] >= quality(pairs, labels, gamma)


def test_resolution_changes_the_partition(graph):
    counts = [C.members_by_level(C.community_levels(graph[1], g, levels=2, sweeps=4)).groupBy("level").agg(F.countDistinct("community").alias("n")).orderBy(F.desc("level")).first()["n"] for g in (0.05, 20.0)]
    assert counts[0] < counts[1] / 4


def test_edges_that_are_odd(spark):
    schema = "src string, dst string, weight double"
    assert C.community_levels(spark.createDataFrame([], schema)).count() == 0
    assert C.community_levels(spark.createDataFrame([(None, "a", 1.0), ("a", "b", None), ("a", "b", 0.0)], schema)).count() == 0
    rows = C.community_levels(spark.createDataFrame([("a", "b", 1.0), ("b", "a", 2.0), ("z", "z", 1.0)], schema)).collect()
    assert {(r["level"], r["node"], r["community"]) for r in rows} == {(1, "a", "a"), (1, "b", "a"), (1, "z", "z")}
    alone = C.community_levels(spark.createDataFrame([("z", "z", 1.0)], schema)).collect()
    assert [(r["level"], r["node"], r["community"], r["quality"]) for r in alone] == [(1, "z", "z", 0.0)]


def test_digests_of_levels(spark):
    tree = spark.createDataFrame([(1, i, "ab"[i > 3]) for i in range(1, 7)] + [(2, "a", "a"), (2, "b", "a")], "level int, node string, community string")
    nodes = spark.createDataFrame([(str(i), f"N{i}", "t", "d" if i == 1 else None) for i in range(1, 7)], "node string, name string, type string, description string")
    relations = spark.createDataFrame([("1", "2", "R", None), ("4", "5", "R", "x"), ("3", "4", "R", ""), ("6", "1", "R", None), ("6", "2", "R", None), ("9", "1", "R", None)], "source string, target string, type string, description string")
    got = {(r["level"], r["community"]): (r["members"], r["digest"]) for r in C.level_digests(tree, nodes, relations).collect()}
    assert got == {
        (1, "a"): (3, "Entities:\n- N1 (t) - d\n- N2 (t)\n- N3 (t)\n\nRelations:\n- N1 --[R]--> N2"),
        (1, "b"): (3, "Entities:\n- N4 (t)\n- N5 (t)\n- N6 (t)\n\nRelations:\n- N4 --[R]--> N5 (x)"),
        (2, "a"): (2, "Entities:\n- N1 (community) - 3 members\n- N4 (community) - 3 members\n\nRelations:\n- N1 --[LINKS]--> N4 (1 relations)\n- N4 --[LINKS]--> N1 (2 relations)"),
    }


def test_pages_of_a_giant_community(spark):
    n = 3000
    tree = spark.range(n).select(F.lit(1).alias("level"), F.col("id").alias("node"), F.lit(0).cast("long").alias("community"))
    nodes = spark.range(n).select(F.col("id").alias("node"), F.concat(F.lit("n"), "id").alias("name"), F.lit("t").alias("type"), F.lit(None).cast("string").alias("description"))
    relations = spark.range(n - 1).select(F.col("id").alias("source"), (F.col("id") + 1).alias("target"), F.lit("R").alias("type"), F.lit(None).cast("string").alias("description"))
    rows = C.level_digests(tree, nodes, relations, lines=50).collect()
    lines = [x for r in rows for x in r["digest"].split("\n")]
    assert len(rows) == 60 and max(len(r["digest"].split("\n")) for r in rows) < 220
    assert sum(x.startswith("- ") and "-->" not in x for x in lines) == n and sum("-->" in x for x in lines) == n - 1


def test_registered_levels(spark, sf):
    members = QUERIES["i15_modularity_communities"](spark, sf).collect()
    parts = {r["l_partkey"] for r in spark.read.parquet(f"{sf}/lineitem.parquet").select("l_partkey").distinct().collect()}
    for level in {r["level"] for r in members}:
        nodes = [r["node"] for r in members if r["level"] == level]
        assert len(nodes) == len(set(nodes)) and {int(x[1:]) for x in nodes if x[0] == "p"} == parts


def test_sweeps_move_numbers_and_read_the_links_of_one_half(spark, monkeypatch):
    seen, swept = [], C._swept

    def spy(links, state, total, resolution, turn):
        seen.append({c: t for c, t in links.dtypes if c in "uv"} | dict(state.select("node", "community").dtypes))
        if turn < 2 and links.count():
            # The two halves of a pair of sweeps have all links between them, none of them both.
            mine = F.shiftright("bits", 0).bitwiseAND(F.lit(1)) == turn
            halves.append({(r["u"], r["v"]) for r in links.filter(mine).collect()})
            every.append({(r["u"], r["v"]) for r in links.collect()})
        return swept(links, state, total, resolution, turn)

    halves, every = [], []
    monkeypatch.setattr(C, "_swept", spy)
    edges = spark.createDataFrame([(f"n{a:03}", f"n{b:03}", 1.0) for a, b in planted(groups=4, across=40)], "src string, dst string, weight double")
    names = {r[0] for r in edges.select("src").union(edges.select("dst")).collect()}
    rows = C.community_levels(edges, levels=1).collect()
    assert seen and all(t == "bigint" for kinds in seen for t in kinds.values())
    assert halves[0] | halves[1] == every[0] and not halves[0] & halves[1] and halves[0] and halves[1]
    assert {r["node"] for r in rows} == names and {r["community"] for r in rows} < names


def test_pages_of_relations_beyond_those_of_members(spark):
    n = 12
    tree = spark.range(n).select(F.lit(1).alias("level"), F.col("id").alias("node"), F.lit(0).cast("long").alias("community"))
    nodes = spark.range(n + 1).select(F.col("id").alias("node"), F.concat(F.lit("n"), "id").alias("name"), F.lit("t").alias("type"), F.lit(None).cast("string").alias("description"))
    pairs = [(a, b) for a in range(n) for b in range(n) if a != b]
    relations = spark.createDataFrame([(a, b, "R", None) for a, b in pairs], "source long, target long, type string, description string")
    rows = C.level_digests(tree, nodes, relations, lines=20).collect()
    lines = [x for r in rows if r["community"] == 0 for x in r["digest"].split("\n")]
    assert sorted(x for x in lines if "-->" in x) == sorted(f"- n{a} --[R]--> n{b}" for a, b in pairs)
    assert sorted(x for x in lines if x.endswith("(t)")) == sorted(f"- n{a} (t)" for a in range(n))
    assert {r["members"] for r in rows if r["community"] == 0} == {n}
    # A node without a place in the tree stands alone.
    assert [(r["members"], r["digest"]) for r in rows if r["community"] == n] == [(1, f"Entities:\n- n{n} (t)\n\nRelations:\n(none)")]


def test_large_graphs_lie_in_buckets_where_sweeps_leave_them(spark, graph, monkeypatch):
    plans, swept = [], C._swept

    def spy(links, state, total, resolution, turn, *wide):
        out = swept(links, state, total, resolution, turn, *wide)
        wides.append(wide)
        plans.append(out._jdf.queryExecution().executedPlan().toString())
        return out

    wides = []
    monkeypatch.setattr(C, "_swept", spy)
    rows = lambda: sorted((r["level"], r["node"], r["community"], round(r["quality"], 9)) for r in C.community_levels(graph[1]).collect())
    monkeypatch.setattr(C, "DEALT", 10**9)
    plain = rows()
    assert not any("Bucketed: true" in p for p in plans) and not any(wides)
    plans.clear()
    wides.clear()
    monkeypatch.setattr(C, "DEALT", 0)
    assert rows() == plain
    # Links meet their other ends without a shuffle of their own, and move once.
    assert plans and all("Bucketed: true" in p and p.count("REPARTITION_BY_COL") == 1 for p in plans)
    # The best community around a node is found without a sort of what is around it.
    assert all(wides) and not any("SortAggregate" in p for p in plans)
    assert not [t.name for t in spark.catalog.listTables() if t.name.startswith("graph_")]


def test_first_pages_alone_are_those_of_all_pages(spark):
    n = 300
    tree = spark.range(n).select(F.lit(1).alias("level"), F.col("id").alias("node"), (F.col("id") % 2).alias("community"))
    nodes = spark.range(n).select(F.col("id").alias("node"), F.concat(F.lit("n"), "id").alias("name"), F.lit("t").alias("type"), F.lit(None).cast("string").alias("description"))
    relations = spark.range(n - 2).select(F.col("id").alias("source"), (F.col("id") + 2).alias("target"), F.lit("R").alias("type"), F.lit(None).cast("string").alias("description"))
    rows = lambda df: sorted(map(tuple, df.select("level", "community", "page", "members", "digest").collect()))
    every = rows(C.level_digests(tree, nodes, relations, lines=20))
    assert len(every) > 10 and rows(C.level_digests(tree, nodes, relations, lines=20, pages=1)) == [r for r in every if r[2] == 0]
