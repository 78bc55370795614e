"""Communities by modularity at a resolution: parallel local moves, contraction, and the levels this gives, with digests of each level.

A level's graph is two tables: weights between different nodes, both ways, and degrees. In a sweep every node learns from one join and two
aggregations how much weight it has to each community around it and how large these are; half of the nodes, another half each time,
move to where modularity gains most, and a sweep moves the links of that half only, once. Nodes are numbers, in the order of their names, so that
sweeps move and sort no text. When few move, communities become the nodes of the next level. No node's neighbourhood and no
community's members are gathered: all steps are partial sums, partial maxima and equi-joins, whose skewed keys the engine splits.
"""

from __future__ import annotations

from itertools import accumulate

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from corpusmill.operators.graph import digests
from corpusmill.workspace import Workspace


#: Halves that are told apart by a bit each; later sweeps take them anew.
HALVES = 60
#: Links beyond which a graph is kept in buckets.
DEALT = 1_000_000


def _numbered(edges: DataFrame, sweeps: int) -> DataFrame:
    """name, node, bits: the edges' ends with numbers in the order of their names, and in a bit for each two sweeps the half that a node is in."""
    names = edges.select(F.explode(F.array("src", "dst")).alias("name")).distinct().orderBy("name")
    bits = F.lit(0).cast("long")
    for i in range(min(HALVES, (sweeps + 1) // 2)):
        bits = bits + F.shiftleft(F.pmod(F.xxhash64("name", F.lit(i)), F.lit(2)), i)
    return names.select("name", F.monotonically_increasing_id().alias("node"), bits.alias("bits"))


def _gapless(ids: DataFrame) -> DataFrame:
    """The same with numbers from 0 that leave none out between partitions."""
    part = F.shiftright("node", 33)
    counts = sorted(map(tuple, ids.groupBy(part.alias("part")).agg(F.count("*").alias("n")).collect()))
    before = list(accumulate((n for _, n in counts), initial=0))
    firsts = ids.sparkSession.createDataFrame([(p, b) for (p, _), b in zip(counts, before)], "part long, before long")
    within = F.col("node").bitwiseAND(F.lit((1 << 33) - 1))
    return ids.withColumn("part", part.cast("long")).join(F.broadcast(firsts), "part").select("name", (within + F.col("before")).alias("node"), "bits")


def _swept(links: DataFrame, state: DataFrame, total: float, resolution: float, turn: int, wide: int = 0) -> DataFrame:
    """links: u, v, w, bits (of u). state: node, community, k, bits. The state after one half of the nodes has moved, with ``moved``. Only links of nodes whose turn it is are read.

    Links meet the communities of their other ends where these lie, in small hash tables, and move once, to the node whose turn it is.
    wide: bits of a number, if gains in billionths fit into a long beside one; the best community is then a maximum of longs, without a sort."""
    mine = F.shiftright("bits", turn // 2 % HALVES).bitwiseAND(F.lit(1)) == turn % 2
    # The size of a community of one node is negative.
    sizes = state.groupBy("community").agg((F.sum("k") * F.when(F.count("*") == 1, -1.0).otherwise(1.0)).alias("signed"))
    placed = state.join(sizes, "community")
    other = placed.select(F.col("node").alias("v"), "community", "signed").hint("shuffle_hash")
    heard = links.filter(mine).select("u", "v", "w").join(other, "v").select("u", "community", "w", "signed").repartition("u")
    around = heard.groupBy("u", "community").agg(F.sum("w").alias("w"), F.max("signed").alias("signed")).select("u", "community", "w", F.abs("signed").alias("size"), (F.col("signed") < 0).alias("single"))
    own = placed.filter(mine).select(F.col("node").alias("u"), F.col("community").alias("now"), "k", F.abs("signed").alias("now_size"), (F.col("signed") < 0).alias("now_single"))
    here = F.col("community") == F.col("now")
    # What a move to the community is worth, less what the node itself adds to its own.
    worth = F.col("w") - resolution * F.col("k") * (F.col("size") - F.when(here, F.col("k")).otherwise(0.0)) / total
    # Of two nodes that stand alone only the one with the larger name moves, so that they don't change places.
    swap = F.col("now_single") & F.col("single") & (F.col("community") > F.col("now"))
    # In billionths, told once for each community around a node.
    gain = F.when(~here & ~swap, F.rint(worth * 1e9))
    alone = -resolution * F.col("k") * (F.col("now_size") - F.col("k")) / total
    told = around.join(own.hint("shuffle_hash"), "u").select("u", "community", alone.alias("alone"), F.when(here, worth).alias("stay"), gain.alias("gain"))
    here_or_alone = [F.max("alone").alias("alone"), F.max("stay").alias("stay")]
    if wide:
        last = F.lit((1 << wide) - 1)
        top = told.groupBy("u").agg(*here_or_alone, F.max(F.col("gain").cast("long") * F.lit(1 << wide) + last - F.col("community")).alias("top"))
        best = top.select("u", "alone", "stay", F.shiftright("top", wide).alias("gain"), (last - F.col("top").bitwiseAND(last)).alias("there"))
    else:
        least = F.min_by("community", F.when(F.col("gain").isNotNull(), F.struct(-F.col("gain"), F.col("community"))))
        best = told.groupBy("u").agg(*here_or_alone, F.max("gain").alias("gain"), least.alias("there"))
    moves = best.filter(F.col("gain") / 1e9 > F.coalesce("stay", "alone") + 1e-8).select(F.col("u").alias("node"), "there")
    return state.join(moves, "node", "left").select("node", F.coalesce("there", "community").alias("community"), "k", "bits", F.col("there").isNotNull().alias("moved"))


def _both_ways(pairs: DataFrame) -> DataFrame:
    """pairs: u, v, w, u_bits, v_bits; u <= v and pairs may repeat. u, v, w, bits (of u): a row for each direction of a pair, one for a loop."""
    once = pairs.groupBy("u", "v").agg(F.sum("w").alias("w"), F.first("u_bits").alias("u_bits"), F.first("v_bits").alias("v_bits"))
    there, back = F.struct("u", "v", F.col("u_bits").alias("bits")), F.struct(F.col("v").alias("u"), F.col("u").alias("v"), F.col("v_bits").alias("bits"))
    return once.select(F.explode(F.when(F.col("u") == F.col("v"), F.array(there)).otherwise(F.array(there, back))).alias("e"), "w").select("e.u", "e.v", "w", "e.bits")


def _ordered(ends: DataFrame) -> DataFrame:
    """ends: a, b, w, a_bits, b_bits. The same as pairs u <= v."""
    u, v = (F.when(F.col("a") <= F.col("b"), F.col(x)).otherwise(F.col(y)) for x, y in (("a", "b"), ("b", "a")))
    u_bits, v_bits = (F.when(F.col("a") <= F.col("b"), F.col(x)).otherwise(F.col(y)) for x, y in (("a_bits", "b_bits"), ("b_bits", "a_bits")))
    return ends.select(u.alias("u"), v.alias("v"), "w", u_bits.alias("u_bits"), v_bits.alias("v_bits"))


def _contracted(graph: DataFrame, state: DataFrame) -> DataFrame:
    """state: node, community, bits (of the community). u, v, w, bits between communities, both ways, from one direction of the links; a community's inner links are its loop."""
    a, b = (state.select(F.col("node").alias(n), F.col("community").alias(c), F.col("bits").alias(f"{c}_bits")).hint("shuffle_hash") for n, c in (("u", "a"), ("v", "b")))
    w = F.col("w") * F.when((F.col("a") == F.col("b")) & (F.col("u") != F.col("v")), 2).otherwise(1)
    return _both_ways(_ordered(graph.filter("u <= v").select("u", "v", "w").join(b, "v").join(a, "u").withColumn("w", w)))


def _kept(ws: Workspace, graph: DataFrame, rows: int) -> DataFrame:
    """Large graphs lie in buckets of one end, where sweeps leave them."""
    return ws.keep_dealt(graph, "v", "graph") if rows > DEALT else ws.keep(graph, "graph")


def community_levels(edges: DataFrame, resolution: float = 1.0, levels: int = 10, sweeps: int = 12, settled: float = 0.002) -> DataFrame:
    """edges: src, dst, weight (over 0). level (from 1), node, community, quality: the community of every node of a level, which is a node of the next, named by its smallest node; quality is the level's modularity at ``resolution``.

    Directions don't matter, repeated edges add up; edges with a null end or weight are left out; a self-loop counts for its node's
    degree. A level ends after two sweeps in a row that move at most ``settled`` of the nodes, or after ``sweeps``; levels end when one
    brings no more modularity, which is then not in the result, or when nothing moves. Without edges there is no row.
    """
    ws = Workspace(edges.sparkSession, "communities")
    clean = edges.select("src", "dst", F.col("weight").cast("double").alias("w")).filter("src is not null and dst is not null and w > 0")
    clean = ws.keep(clean, "edges")
    # Nodes are numbers in the order of their names until a level is told.
    ids = ws.keep(_numbered(clean, sweeps), "names")
    ids = ws.keep(_gapless(ids), "numbers")
    wide = ids.count().bit_length()
    ends = [ids.select(F.col("name").alias(c), F.col("node").alias(n), F.col("bits").alias(f"{n}_bits")).hint("shuffle_hash") for c, n in (("src", "a"), ("dst", "b"))]
    numbers = clean.join(ends[0], "src").join(ends[1], "dst").withColumn("w", F.col("w") * F.when(F.col("a") == F.col("b"), 2).otherwise(1))
    named = lambda rows: rows.join(ids.select("node", F.col("name").alias("__node")), "node").join(ids.select(F.col("node").alias("community"), F.col("name").alias("__community")), "community").select("level", F.col("__node").alias("node"), F.col("__community").alias("community"), "quality")
    rows = clean.count()
    graph = _kept(ws, _both_ways(_ordered(numbers)), rows)
    ws.drop(clean)
    # A link is there both ways, so its weight is summed where the graph lies.
    summed = lambda graph: graph.groupBy(F.col("v").alias("node")).agg(F.sum("w").alias("k"), F.max(F.col("u") != F.col("v")).alias("linked")).join(ids.select("node", "bits"), "node")
    degrees = ws.keep(summed(graph), "degrees")
    total = degrees.agg(F.sum("k")).first()[0]
    out, best = None, None
    for level in range(1, levels + 1) if total else ():
        links = graph.filter("u <> v")
        nodes, most = degrees.agg(F.count("*"), F.max("k")).first()
        # A gain is at most a node's degree, and so is a loss at a resolution of 1.
        fits = rows > DEALT and most * max(1.0, resolution) * 1e9 < 2.0 ** (62 - wide)
        start = degrees.select("node", F.col("node").alias("community"), "k", "bits", "linked")
        alone = start.filter("not linked").drop("linked")
        state = ws.keep(start.filter("linked").drop("linked"), "state")
        calm, moved_ever = 0, False
        for i in range(sweeps):
            new = ws.keep(_swept(links, state, total, resolution, i, *([wide] if fits else [])), "state")
            moved = new.filter("moved").count()
            moved_ever = moved_ever or moved > 0
            ws.drop(state)
            state = new.drop("moved")
            state._scratch_path = new._scratch_path
            calm = calm + 1 if moved <= settled * nodes else 0
            if calm == 2:
                break
        everyone = state.unionByName(alone)
        names = everyone.groupBy("community").agg(F.min("node").alias("node")).join(ids.select("node", "bits"), "node").select("community", F.col("node").alias("name"), F.col("bits").alias("name_bits"))
        everyone = ws.keep(everyone.join(names, "community").select("node", F.col("name").alias("community"), "k", F.col("name_bits").alias("bits")), "everyone")
        above = ws.keep(_contracted(graph, everyone), "graph")
        sums = ws.keep(everyone.groupBy("community").agg(F.sum("k").alias("k")), "sums")
        inside = above.filter("u = v").agg(F.sum("w")).first()[0] or 0.0
        quality = inside / total - resolution * sums.agg(F.sum(F.col("k") * F.col("k"))).first()[0] / (total * total)
        told = everyone.select(F.lit(level).alias("level"), "node", "community", F.lit(quality).alias("quality"))
        if not moved_ever or (best is not None and quality <= best + 1e-7):
            if best is None:
                out = ws.keep(named(told), "level")
            break
        best = quality
        told = ws.keep(named(told), "level")
        out = told if out is None else out.unionByName(told)
        ws.drop(graph, degrees, state)
        graph, rows = above, above.count()
        if rows > DEALT:
            graph = _kept(ws, above, rows)
            ws.drop(above)
        degrees = ws.keep(summed(graph), "degrees")
    ws.drop(graph, degrees)
    if out is None:
        out = edges.select(F.lit(1).alias("level"), F.col("src").alias("node"), F.col("src").alias("community"), F.lit(0.0).alias("quality")).limit(0)
    return out


def members_by_level(tree: DataFrame) -> DataFrame:
    """level, node, community, quality: of every level, the community that each node of the first level lies in."""
    out = now = tree.filter("level = 1").select("level", "node", "community", "quality")
    for level in range(2, (tree.agg(F.max("level")).first()[0] or 1) + 1):
        up = tree.filter(F.col("level") == level).select("level", F.col("node").alias("community"), F.col("community").alias("parent"), "quality")
        now = now.select("node", "community").join(up, "community").select("level", "node", F.col("parent").alias("community"), "quality")
        out = out.unionByName(now)
    return out


def _pages(rows: DataFrame, lines: int, *by: str) -> DataFrame:
    """Adds ``page``: rows of a community are dealt by their hash to as many pages as hold ``lines`` each on average."""
    count = rows.groupBy("community").agg(F.ceil(F.count("*") / lines).cast("long").alias("pages"))
    return rows.join(count, "community").withColumn("page", F.pmod(F.xxhash64(*by), "pages")).drop("pages")


def level_digests(tree: DataFrame, nodes: DataFrame, relations: DataFrame, lines: int = 200, pages: int | None = None) -> DataFrame:
    """level, community, page, members, digest: the texts that a summariser reads, from the lowest level up; with ``pages`` only that many of each community.

    nodes: node, name, type, description. relations: source, target (nodes), type, description. At the first level a community's
    lines are its nodes and the relations between them. Above, they are the communities of the level below, each named by its first member, and how many relations
    go between them. Pages hold about ``lines`` lines of either kind, so a community of any size is in no single row; where relations fill more
    pages than members, the later ones have relations only. A node outside the tree is a community of its own.
    """
    ws = Workspace(tree.sparkSession, "digests")
    items, links, out = nodes.select("node", "name", "type", "description"), relations.select("source", "target", "type", "description", F.lit(1).cast("long").alias("n")), None
    for level in range(1, (tree.agg(F.max("level")).first()[0] or 0) + 1):
        own = tree.filter(F.col("level") == level).select("node", "community")
        placed = ws.keep(items.join(own, "node", "left").withColumn("community", F.coalesce("community", "node")), "items")
        names = [placed.select(F.col("node").alias(end), F.col("name").alias(f"{end}_name"), F.col("community").alias(f"{end}_community")).hint("shuffle_hash") for end in ("source", "target")]
        ends = links.join(names[0], "source").join(names[1], "target").select("type", "description", "n", "source_name", "source_community", "target_name", "target_community")
        ends = ws.keep(ends, "relations")
        inner = ends.filter("source_community = target_community").select(F.col("source_community").alias("community"), F.col("source_name").alias("source"), "type", F.col("target_name").alias("target"), "description")
        # Pages are keys of their own for the digest.
        some = [_pages(placed, lines, "name"), _pages(inner, lines, "source", "type", "target")]
        text = digests(*[p if pages is None else p.filter(F.col("page") < pages) for p in some], "full", ("page", "community"))
        size = placed.groupBy("community").agg(F.count("*").alias("members"))
        rows = text.join(size, "community").select(F.lit(level).alias("level"), "community", "page", "members", "digest")
        out = rows if out is None else out.unionByName(rows)
        first = placed.groupBy("community").agg(F.min("name").alias("name"), F.count("*").alias("members"))
        items = first.select(F.col("community").alias("node"), "name", F.lit("community").alias("type"), F.concat(F.col("members").cast("string"), F.lit(" members")).alias("description"))
        across = ends.filter("source_community <> target_community").groupBy(F.col("source_community").alias("source"), F.col("target_community").alias("target")).agg(F.sum("n").alias("n"))
        links = across.select("source", "target", F.lit("LINKS").alias("type"), F.concat(F.col("n").cast("string"), F.lit(" relations")).alias("description"), "n")
    return out
