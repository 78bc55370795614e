"""Operator 11: near-duplicate vectors by random-hyperplane sign hashing in several tables.

A table gives a vector a code, one bit for each of its random hyperplanes. Vectors with the same label and code meet in a bucket, where
cosines are taken in double precision. Two vectors at the similarity agree on a bit with probability 1 - angle / pi; so many tables are
made that they share a bucket with probability ``recall`` at least, and more surely the more alike they are. Bits grow with the
logarithm of the largest label, so that buckets keep their size.

A pair that shares buckets of several tables counts in the first of them only, which both rows tell from the codes they carry. A bucket
therefore sends on, of each row, how many it links with and one row that it is connected to: never pairs, however dense a group is.
Buckets over ``block`` rows are dealt as pairs of blocks, each in a task of its own. Equal vectors of a label are one node with a
number of copies. Components are found by star contractions.

Defined cases: rows whose label is null, or whose vector is null, empty, zero or holds null or non-finite components, link with nothing and
are components of their own; vectors of different lengths don't link; components of any size are compared (each vector is scaled by
a power of two); repeated ids are separate vectors of one id; a null id counts after all others: its component is named by the smallest
other id, null if there is none; an empty table gives an empty result; other columns are ignored.
"""

from __future__ import annotations

import math
from collections.abc import Callable, Iterator
from functools import cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import FloatType

from corpusmill.operators.components import connected_components
from corpusmill.workspace import Workspace

#: Large buckets whose counts are sent to every worker; where there are more, they meet in a shuffle.
FEW = 100_000


def hash_plan(rows: int, similarity: float, recall: float, bucket: int) -> tuple[int, int]:
    """Bits of a code, so that evenly dealt rows come to ``bucket`` a code, and tables needed."""
    bits = min(30, max(4, math.ceil(math.log2(max(1, rows / bucket)))))
    met = (1 - math.acos(min(1.0, max(-1.0, similarity))) / math.pi) ** bits
    return bits, 1 if met >= 1 else math.ceil(math.log(1 - recall) / math.log(1 - met))


@cache
def _planes(dim: int, bits: int, tables: int, seed: int) -> np.ndarray:
    return np.random.default_rng((seed, dim)).standard_normal((dim, bits * tables))


def unit_rows(x: np.ndarray) -> np.ndarray:
    """Rows of length one. They are scaled by powers of two first, so that squares neither overflow nor vanish."""
    x = np.ldexp(x, -np.frexp(np.abs(x).max(axis=1, keepdims=True))[1])
    return x / np.sqrt((x * x).sum(axis=1, keepdims=True))


def _coded(bits: int, tables: int, width: str, seed: int):
    """(node, label, times, v) with dim, x (the vector's bytes) and its codes, as bytes and as a list."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        powers = 1 << np.arange(bits)
        for whole in batches:
            for at in range(0, len(whole), 2000):
                batch = whole.slice(at, 2000)
                vectors = batch.column(3).to_numpy(zero_copy_only=False)
                dims = np.array([len(v) for v in vectors], "i4")
                for dim in np.unique(dims):
                    own = np.flatnonzero(dims == dim)
                    x = np.stack([np.asarray(vectors[i], "f8") for i in own])
                    signs = unit_rows(x) @ _planes(int(dim), bits, tables, seed) > 0
                    codes = (signs.reshape(len(own), tables, bits) @ powers).astype("<i4")
                    take = pa.array(own)
                    columns = [*(batch.column(i).take(take) for i in range(3)), pa.array(np.full(len(own), dim, "i4")), pa.array([r.astype(width).tobytes() for r in x], pa.binary()), pa.array([c.tobytes() for c in codes], pa.binary()), pa.array(list(codes), pa.list_(pa.int32()))]
                    yield pa.RecordBatch.from_arrays(columns, names=["node", "label", "times", "dim", "x", "marks", "codes"])

    return run


def linked_pairs(x: np.ndarray, first: np.ndarray, second: np.ndarray | None, similarity: float) -> tuple[np.ndarray, np.ndarray]:
    """Positions of pairs at the similarity or over it, inside ``first`` or between both. Near the threshold the cosine is taken anew, without a matrix product's order of sums."""
    u = unit_rows(x)
    other = first if second is None else second
    s = u[first] @ u[other].T
    if second is None:
        s[np.tril_indices(len(first))] = -2
    r, c = np.nonzero(s >= similarity - 1e-9)
    close = np.flatnonzero(s[r, c] < similarity + 1e-9)
    a, b = first[r], other[c]
    scaled = np.ldexp(x, -np.frexp(np.abs(x).max(axis=1, keepdims=True))[1])
    good = np.ones(len(r), bool)
    for k in close.tolist():
        p, q = scaled[a[k]], scaled[b[k]]
        good[k] = math.fsum(p * q) / math.sqrt(math.fsum(p * p) * math.fsum(q * q)) >= similarity
    return a[good], b[good]


def _roots(n: int, a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """The smallest position connected to each of n."""
    root = np.arange(n)
    while True:
        low = root.copy()
        np.minimum.at(low, a, root[b])
        np.minimum.at(low, b, root[a])
        low = low[low]
        if (low == root).all():
            return root
        root = low


def _bucket_links(similarity: float, width: str) -> Callable[[pa.Table], pa.Table]:
    """A bucket, or two blocks of one: for each node its links (copies counted) with nodes it met in no earlier table, and a node it is connected to."""

    def run(rows: pa.Table) -> pa.Table:
        rows = rows.sort_by("node")
        node, own, times = (rows[c].to_numpy() for c in ("node", "own", "times"))
        low, high, t = (rows[c][0].as_py() for c in ("low", "high", "t"))
        n = len(node)
        x = np.frombuffer(b"".join(rows["x"].to_pylist()), width).reshape(n, -1).astype("f8")
        codes = np.frombuffer(b"".join(rows["marks"].to_pylist()), "<i4").reshape(n, -1)
        a, b = linked_pairs(x, np.flatnonzero(own == low), None if low == high else np.flatnonzero(own == high), similarity)
        if t and len(a):
            step = max(1, 4_000_000 // t)
            new = np.concatenate([~(codes[a[i : i + step], :t] == codes[b[i : i + step], :t]).any(axis=1) for i in range(0, len(a), step)])
            a, b = a[new], b[new]
        links = np.bincount(a, times[b], n) + np.bincount(b, times[a], n)
        has = np.flatnonzero(links)
        return pa.table({"node": node[has], "links": links[has].astype("i8"), "root": node[_roots(n, a, b)[has]]})

    return run


def linked_vectors(nodes: DataFrame, similarity: float = 0.93, recall: float = 0.999, bucket: int = 512, block: int = 512, width: str = "f8", seed: int = 17) -> DataFrame:
    """nodes: node, label, times, v (double). node, links, root: rows of several buckets; links of a node add up."""
    ws = Workspace(nodes.sparkSession, "sign-hashing")
    most = nodes.groupBy("label").count().agg(F.max("count")).first()[0] or 0
    bits, tables = hash_plan(most, similarity, recall, bucket)
    kind = nodes.schema["label"].dataType.simpleString()
    coded = nodes.select("node", "label", "times", "v").mapInArrow(_coded(bits, tables, width, seed), f"node long, label {kind}, times long, dim int, x binary, marks binary, codes array<int>")
    coded = ws.keep(coded, "coded")
    key = ["label", "dim", "t", "code"]
    sizes = coded.select("label", "dim", F.posexplode("codes").alias("t", "code")).groupBy(*key).count().filter(F.col("count") > block)
    large = ws.keep(sizes.select(*key, F.ceil(F.col("count") / block).cast("long").alias("blocks")), "large")
    rows = coded.select("node", "label", "times", "dim", "x", "marks", F.posexplode("codes").alias("t", "code"))
    rows = rows.join(F.broadcast(large) if large.count() <= FEW else large, key, "left").withColumn("blocks", F.coalesce("blocks", F.lit(1).cast("long")))
    rows = rows.withColumn("own", F.pmod(F.xxhash64("node"), "blocks")).withColumn("other", F.explode(F.sequence(F.lit(0).cast("long"), F.col("blocks") - 1)))
    dealt = rows.select(*key, F.least("own", "other").alias("low"), F.greatest("own", "other").alias("high"), "own", "node", "times", "x", "marks")
    return dealt.groupBy(*key, "low", "high").applyInArrow(_bucket_links(similarity, width), "node long, links long, root long")


def near_vectors(df: DataFrame, id_col: str = "vec_id", vec_col: str = "embedding", label_col: str = "label", similarity: float = 0.93, **options) -> DataFrame:
    """One row per row of ``df``: vec_id, n_links (other vectors of the label at the similarity or over it), component_id (smallest id reachable over links) and kept (the vector's id is that one)."""
    ws = Workspace(df.sparkSession, "near-vectors")
    width = "<f4" if isinstance(df.schema[vec_col].dataType.elementType, FloatType) else "<f8"
    v = F.col(f"`{vec_col}`").cast("array<double>")
    rows = df.select(F.col(f"`{id_col}`").cast("long").alias("vec_id"), F.col(f"`{label_col}`").alias("label"), v.alias("v"))
    finite = F.forall("v", lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < F.lit(float("inf"))))
    rows = rows.withColumn("valid", F.coalesce(F.col("label").isNotNull() & finite & F.exists("v", lambda x: x != 0), F.lit(False)))
    keyed = rows.filter("valid").select("vec_id", "label", "v", F.xxhash64("label", "v").alias("h"), F.xxhash64("v", "label", F.lit(1)).alias("k"))
    nodes = keyed.groupBy("h", "k").agg(F.first("label").alias("label"), F.first("v").alias("v"), F.count("*").alias("times"), F.min("vec_id").alias("least"))
    nodes = ws.keep(nodes.select(F.monotonically_increasing_id().alias("node"), "*"), "nodes")
    found = ws.keep(linked_vectors(nodes, similarity, width=width, **options), "links")
    parts = connected_components(found.filter("node <> root").select("node", "root").distinct(), "node", "root")
    links = found.groupBy("node").agg(F.sum("links").alias("links"))
    named = nodes.select("node", "h", "k", "times", "least").join(links, "node", "left").join(parts, "node", "left").withColumn("component", F.coalesce("component", "node"))
    named = ws.keep(named, "named")
    smallest = named.groupBy("component").agg(F.min("least").alias("component_id"))
    told = named.join(smallest, "component").select("h", "k", (F.coalesce("links", F.lit(0)) + F.col("times") - 1).alias("n_links"), "component_id")
    good = keyed.select("vec_id", "h", "k").join(told, ["h", "k"]).select("vec_id", "n_links", "component_id")
    alone = rows.filter("not valid").select("vec_id", F.lit(0).cast("long").alias("n_links"), F.col("vec_id").alias("component_id"))
    return good.unionByName(alone).withColumn("kept", F.col("vec_id").eqNullSafe(F.col("component_id")))
