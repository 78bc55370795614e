"""Rounds over edges move numbers in the order of names, with the results of names."""

import random

from corpusmill import workspace as W
from corpusmill.operators import graph as G
from corpusmill.operators.components import connected_components


def kept_types(monkeypatch):
    kept, keep = [], W.Workspace.keep
    monkeypatch.setattr(W.Workspace, "keep", lambda self, t, name, **o: kept.append((name, {f.name: f.dataType.simpleString() for f in t.schema})) or keep(self, t, name, **o))
    return kept


def test_components_of_names_move_numbers(spark, monkeypatch):
    kept = kept_types(monkeypatch)
    edges = [("b", "a"), ("é", "b"), ("Z", "y"), ("x", "x"), (None, "a"), ("10", "9"), ("b", "a")]
    got = {r["node"]: r["component"] for r in connected_components(spark.createDataFrame(edges, "src string, dst string")).collect()}
    assert got == {"a": "a", "b": "a", "é": "a", "Z": "Z", "y": "Z", "x": "x", "10": "10", "9": "10"}
    assert all("string" not in types.values() for name, types in kept if name in ("large", "small"))


def test_label_rounds_move_numbers(spark, monkeypatch):
    kept, rng = kept_types(monkeypatch), random.Random(1)
    rows = [(f"n{rng.randrange(30)}", f"n{rng.randrange(30)}", float(rng.randrange(1, 4))) for _ in range(90)]
    edges = spark.createDataFrame(rows, "src string, dst string, weight double")
    names = sorted({x for a, b, _ in rows for x in (a, b)})
    half = {r[0]: r[1] for r in spark.createDataFrame([(x,) for x in names], "n string").selectExpr("n", "pmod(xxhash64(n), 2)").collect()}
    labels = {x: x for x in names}
    for i in range(10):
        heard = {}
        for a, b, w in rows:
            for u, v in ((a, b), (b, a)):
                heard.setdefault(u, {}).setdefault(labels[v], 0.0)
                heard[u][labels[v]] += w
        new = {u: min(heard[u], key=lambda x: (-heard[u][x], x)) if half[u] == i % 2 else labels[u] for u in names}
        same, labels = new == labels, new
        if same and i:
            break
    assert {r["node"]: r["label"] for r in G.label_communities(edges).collect()} == labels
    assert all("string" not in types.values() for name, types in kept if name.startswith("labels"))
