"""The keyed store: inserts, merges, deletes, refreshes, repeated and torn epochs, and how much of it they read."""

import os

import pytest
from pyspark.sql import functions as F

from corpusmill.operators.store import KeyedStore
from corpusmill.workspace import Workspace

SCHEMA = "cfg string, id long, body string"


@pytest.fixture
def make(spark):
    def store(**options):
        schema = spark.createDataFrame([], SCHEMA).schema
        return KeyedStore(spark, Workspace(spark, "store-test").path("store"), ["id"], schema, "cfg", **options)

    return store


def rows(spark, *some):
    return spark.createDataFrame(list(some), SCHEMA)


def held(store, epoch=None):
    found = [tuple(r) for r in store.read(epoch).collect()]
    assert len(found) == len(set(found))
    return set(found)


def test_epochs_against_a_plain_dictionary(spark, make):
    import random

    rng, store, plain, after = random.Random(4), make(buckets=4, segments=3), {}, {}
    for epoch in range(8):
        batch = {(rng.choice(["a", "b", None]), rng.choice([*range(60), None])): f"{epoch}" for _ in range(25)}
        kind = ["insert", "insert", "merge", "insert", "delete", "insert", "refresh", "insert"][epoch]
        if kind == "refresh":
            batch = {k: v for k, v in batch.items() if k[0] is None}
            store.refresh(None, rows(spark, *[(c, i, v) for (c, i), v in batch.items()]), epoch)
            plain = {k: v for k, v in plain.items() if k[0] is not None} | batch
        elif kind == "delete":
            store.delete(rows(spark, *[(c, i, v) for (c, i), v in batch.items()]).select("id", "cfg"), epoch)
            plain = {k: v for k, v in plain.items() if k not in batch}
        else:
            both = [(c, i, v) for (c, i), v in batch.items()]
            # Repeated keys: the least row counts.
            getattr(store, kind)(rows(spark, *both, *[(c, i, v + "z") for c, i, v in both[:5]]), epoch)
            plain = plain | batch if kind == "merge" else batch | plain
        after[epoch] = {(c, i, v) for (c, i), v in plain.items()}
        assert held(store) == after[epoch], (epoch, kind)
    assert all(held(store, e) == want for e, want in after.items())
    most = store.live().groupBy("store_scope", "store_bucket").count().agg(F.max("count")).first()[0]
    assert most <= 3
    store.clear(7)
    assert store.epochs() == [7] and held(store) == after[7]


def test_an_epoch_is_done_once_and_a_torn_one_again(spark, make):
    store = make(buckets=2)
    store.insert(rows(spark, ("a", 1, "x")), 0)
    store.insert(rows(spark, ("a", 2, "other")), 0)
    assert held(store) == {("a", 1, "x")}
    store.insert(rows(spark, ("a", 2, "y"), ("a", 3, "y")), 1)
    # As if the writer had stopped before the end of the manifest.
    os.remove(f"{store.path}/manifest/epoch=1/_SUCCESS")
    assert held(store) == {("a", 1, "x")}
    store.insert(rows(spark, ("a", 2, "z")), 1)
    assert held(store) == {("a", 1, "x"), ("a", 2, "z")}
    store.insert(rows(spark, ("a", 9, "z")), 5)
    with pytest.raises(ValueError):
        store.insert(rows(spark, ("a", 7, "z")), 3)


def test_empty_batches_and_an_empty_store(spark, make):
    store, none = make(), spark.createDataFrame([], SCHEMA)
    assert held(store) == set() and store.unseen(none).count() == 0
    store.insert(none, 0)
    store.merge(none, 1)
    store.delete(none, 2)
    store.refresh("a", none, 3)
    assert store.epochs() == [0, 1, 2, 3] and held(store) == set()
    store.insert(rows(spark, ("a", 1, None), (None, None, "")), 4)
    assert held(store) == {("a", 1, None), (None, None, "")}


def test_a_refresh_takes_rows_of_its_scope_only(spark, make):
    with pytest.raises(ValueError):
        make().refresh("a", rows(spark, ("b", 1, "x")), 0)


def test_reads_grow_with_the_batch(spark, make, monkeypatch):
    """A large store: an insert of few new keys opens few filters and next to no rows, a merge the buckets of its keys, a refresh nothing."""
    store = make(buckets=64)
    many = spark.range(40_000).select(F.lit("a").alias("cfg"), F.col("id"), F.repeat(F.lit("x"), 20).alias("body"))
    store.insert(many, 0)
    opened = {"rows": 0, "filters": 0}
    load = store._load

    def counted(kind, segments):
        opened[kind] += len(segments)
        return load(kind, segments)

    monkeypatch.setattr(store, "_load", counted)
    store.insert(rows(spark, ("a", 50_001, "n"), ("a", 50_002, "n"), ("a", 50_003, "n"), ("a", 7, "old")), 1)
    assert opened["filters"] <= 4 and 1 <= opened["rows"] <= 2
    opened.update(rows=0, filters=0)
    store.merge(rows(spark, ("a", 7, "new")), 2)
    assert opened["rows"] <= 2 and opened["filters"] == 0
    opened.update(rows=0, filters=0)
    store.refresh("b", rows(spark, ("b", 1, "n")), 3)
    assert opened == {"rows": 0, "filters": 0}
    monkeypatch.undo()
    assert store.read().count() == 40_004 and store.read().filter("id = 7").first().body == "new"


def test_strangers_seldom_pass_the_filters(spark, make):
    store = make(buckets=4)
    ids = lambda a, b: spark.range(a, b).select(F.lit("a").alias("cfg"), "id", F.lit("x").alias("body"))
    store.insert(ids(0, 30_000), 0)
    kept = []

    class Seen(Workspace):
        def keep(self, df, name, **options):
            out = super().keep(df, name, **options)
            kept.append((name, out.count()))
            return out

    one = store._one_each(ids(30_000, 50_000))
    assert store._unseen(one, store._touched(one, store.live()), Seen(spark, "seen")).count() == 20_000
    assert dict(kept)["hits"] < 600
