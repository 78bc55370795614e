"""Connected components of an edge table by alternating star contractions."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from corpusmill.workspace import Workspace


def numbered(ws: Workspace, ends: DataFrame, *columns: str) -> DataFrame:
    """name, id: a written table of the values of the columns, without null, with numbers in their order, so that rounds over edges move and sort no text."""
    names = ends.select(F.explode(F.array(*columns)).alias("name")).filter("name is not null").distinct().orderBy("name")
    return ws.keep(names.select("name", F.monotonically_increasing_id().alias("id")), "names")


def connected_components(edges: DataFrame, src: str = "src", dst: str = "dst", max_rounds: int = 60) -> DataFrame:
    """(node, component) for every node of an edge; a component is named by its smallest node. Null ends and self-loops are left out, unless a loop is the only edge of its node, which then stands alone.

    A round links every larger neighbour of a node to the smallest (large star), then every smaller one (small star). Both are
    a partial minimum and an equi-join, so a hub of any degree is never gathered; the rounds needed grow with the logarithm of
    the longest path. Each round is written to the shared folder, which cuts the lineage.
    """
    ws = Workspace(edges.sparkSession, "components")
    ends = edges.select(F.col(src).alias("a"), F.col(dst).alias("b")).filter("a is not null and b is not null")
    if isinstance(ends.schema["a"].dataType, T.StringType) and isinstance(ends.schema["b"].dataType, T.StringType):
        ends = ws.keep(ends.distinct(), "ends")
        ids = numbered(ws, ends, "a", "b")
        a, b = (ids.select(F.col("name").alias(c), F.col("id").alias(n)) for c, n in (("a", "src"), ("b", "dst")))
        found = connected_components(ends.join(a, "a").join(b, "b").select("src", "dst"), max_rounds=max_rounds)
        node, component = (ids.select(F.col("id").alias(c), F.col("name").alias(f"{c}_name")) for c in ("node", "component"))
        return found.join(node, "node").join(component, "component").select(F.col("node_name").alias("node"), F.col("component_name").alias("component"))
    loops = ws.keep(ends.select(F.greatest("a", "b").alias("u"), F.least("a", "b").alias("v")).distinct(), "edges")
    now = loops.filter("u <> v")
    sign = None
    for _ in range(max_rounds):
        both = now.unionByName(now.select(F.col("v").alias("u"), F.col("u").alias("v")))
        least = both.groupBy("u").agg(F.least(F.first("u"), F.min("v")).alias("m"))
        large = both.filter("v > u").join(least, "u").select(F.col("v").alias("u"), F.col("m").alias("v")).filter("u <> v").distinct()
        large = ws.keep(large, "large")
        least = large.groupBy("u").agg(F.min("v").alias("m"))
        down = large.join(least, "u")
        small = down.filter("v <> m").select(F.col("v").alias("u"), F.col("m").alias("v")).unionByName(least.select("u", F.col("m").alias("v"))).distinct()
        small = ws.keep(small, "small")
        got = tuple(small.agg(F.count("*"), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)"))).first())
        ws.drop(large, now)
        now = small
        if got == sign:
            break
        sign = got
    else:
        raise RuntimeError(f"components still change after {max_rounds} rounds")
    stars = now.select(F.col("u").alias("node"), F.col("v").alias("component"))
    roots = now.select(F.col("v").alias("node")).distinct().select("node", F.col("node").alias("component"))
    alone = loops.filter("u = v").select(F.col("u").alias("node")).join(stars.unionByName(roots).select("node"), "node", "left_anti").select("node", F.col("node").alias("component"))
    return stars.unionByName(roots).unionByName(alone)
