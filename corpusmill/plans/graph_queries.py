"""Knowledge-graph queries over nations, customers, suppliers and parts."""

from __future__ import annotations

from pyspark.sql import functions as F

from corpusmill.functions.vectors import cosine
from corpusmill.operators import communities as M
from corpusmill.operators import graph as G
from corpusmill.operators.retrieval import exact_top_k, hybrid_retrieval
from corpusmill.plans.registry import CHUNKS, Tables, chunks, query
from corpusmill.plans.retrieval_queries import TEXT, V64, keyword_top_k, vector_queries

REPLIES = """replies AS (SELECT doc_id, CASE doc_id % 7 WHEN 0 THEN 'no json, sorry {' WHEN 1 THEN 'Here:' || chr(10) || '```json' || chr(10) || j || chr(10) || '```' ELSE 'Reply: ' || j END AS reply FROM (SELECT doc_id, '{"entities":[{"name":" ' || source || ' ","type":"folder","confidence":' || CASE doc_id % 3 WHEN 0 THEN '0.4' ELSE '0.9' END || '},{"name":"' || lang || '"}],"relations":[{"source":"' || source || '","target":"' || lang || '","type":"holds"}]}' AS j FROM documents))"""


def replies(t: Tables):
    d = t("documents")
    j = F.concat(F.lit('{"entities":[{"name":" '), "source", F.lit(' ","type":"folder","confidence":'), F.when(F.col("doc_id") % 3 == 0, "0.4").otherwise("0.9"), F.lit('},{"name":"'), "lang", F.lit('"}],"relations":[{"source":"'), "source", F.lit('","target":"'), "lang", F.lit('","type":"holds"}]}'))
    m = F.col("doc_id") % 7
    return d.select("doc_id", F.when(m == 0, F.lit("no json, sorry {")).when(m == 1, F.concat(F.lit("Here:\n```json\n"), j, F.lit("\n```"))).otherwise(F.concat(F.lit("Reply: "), j)).alias("reply"))


@query("SELECT doc_id, name, type, confidence FROM (SELECT doc_id, source AS name, 'folder' AS type, CASE doc_id % 3 WHEN 0 THEN 0.4 ELSE 0.9 END::DOUBLE AS confidence FROM documents WHERE doc_id % 7 <> 0 UNION ALL SELECT doc_id, lang, 'unknown', 1.0 FROM documents WHERE doc_id % 7 <> 0) WHERE confidence >= 0.5")
def i1_reply_entities(t):
    return G.reply_entities(replies(t), "doc_id", "reply").select("doc_id", "name", "type", "confidence")


@query("SELECT doc_id, source, lang AS target, 'holds' AS type FROM documents WHERE doc_id % 7 <> 0")
def i2_reply_relations(t):
    return G.reply_relations(replies(t), "doc_id", "reply").select("doc_id", "source", "target", "type")


MENTIONS = "mentions AS (SELECT 'cfg' AS config_id, CASE (l_orderkey + l_linenumber) % 3 WHEN 0 THEN upper(p_name) WHEN 1 THEN ' ' || p_name ELSE p_name || ' ' END AS name, p_type AS type, l_discount AS confidence, l_orderkey AS chunk, l_orderkey * 10 + l_linenumber AS ord FROM lineitem JOIN part ON l_partkey = p_partkey)"


def mentions(t: Tables):
    rows = t("lineitem").join(t("part"), F.col("l_partkey") == F.col("p_partkey"))
    m = (F.col("l_orderkey") + F.col("l_linenumber")) % 3
    name = F.when(m == 0, F.upper("p_name")).when(m == 1, F.concat(F.lit(" "), "p_name")).otherwise(F.concat("p_name", F.lit(" ")))
    return rows.select(F.lit("cfg").alias("config_id"), name.alias("name"), F.col("p_type").alias("type"), F.col("l_discount").alias("confidence"), F.col("l_orderkey").alias("chunk"), (F.col("l_orderkey") * 10 + F.col("l_linenumber")).alias("ord"))


@query("SELECT lower(trim(name)) AS key, arg_min(name, (ord, name, type)) AS name, arg_min(type, (ord, name, type)) AS type, count(*) AS mention_count, count(DISTINCT chunk) AS chunks FROM mentions GROUP BY 1", MENTIONS)
def i3_merge_entities(t):
    return G.merged_entities(mentions(t), "ord").select("key", "name", "type", "mention_count", F.size("source_chunks").cast("long").alias("chunks"))


@query("SELECT l_suppkey AS src, l_partkey AS dst, 'SUPPLIES' AS relation, count(*)::DOUBLE AS weight, arg_min(l_discount, (l_orderkey * 10 + l_linenumber, l_discount)) AS confidence, array_to_string(list_sort(list(DISTINCT l_orderkey)), ',') AS chunks FROM lineitem GROUP BY 1, 2")
def i4_merge_edges(t):
    r = t("lineitem").select(F.col("l_suppkey").alias("src"), F.col("l_partkey").alias("dst"), F.lit("SUPPLIES").alias("relation"), F.col("l_discount").alias("confidence"), F.col("l_orderkey").alias("chunk"), (F.col("l_orderkey") * 10 + F.col("l_linenumber")).alias("ord"))
    return G.merged_edges(r, "ord", "src", "dst", "relation").withColumn("chunks", F.array_join(F.col("chunks").cast("array<string>"), ","))


@query("SELECT key, 'mode=' || arg_max(l_linestatus, ord) || coalesce(',note=' || arg_max(n, CASE WHEN n IS NOT NULL THEN ord END), '') AS properties FROM (SELECT 'p' || l_partkey AS key, l_linestatus, CASE WHEN l_linenumber = 1 THEN l_returnflag END AS n, l_orderkey * 10 + l_linenumber AS ord FROM lineitem) GROUP BY 1")
def i3_merge_properties(t):
    li = t("lineitem").select(F.concat(F.lit("p"), F.col("l_partkey").cast("string")).alias("key"), (F.col("l_orderkey") * 10 + F.col("l_linenumber")).alias("ord"), F.map_filter(F.create_map(F.lit("mode"), F.col("l_linestatus"), F.lit("note"), F.when(F.col("l_linenumber") == 1, F.col("l_returnflag"))), lambda k, v: v.isNotNull()).alias("properties"))
    p = F.col("properties")
    return G.merged_properties(li, "key", "ord", "properties").select("key", F.concat(F.lit("mode="), p["mode"], F.coalesce(F.concat(F.lit(",note="), F.try_element_at(p, F.lit("note"))), F.lit(""))).alias("properties"))


@query("""SELECT coalesce(e.key, r.key) AS key, CASE WHEN r.pos IS NOT NULL AND (e.pos IS NULL OR r.pos < e.pos) THEN 'unknown' ELSE e.type END AS node_type, coalesce(e.n, 0) + CASE WHEN r.pos IS NOT NULL AND (e.pos IS NULL OR r.pos < e.pos) THEN 1 ELSE 0 END AS mention_count
    FROM (SELECT 'p' || l_partkey AS key, min(l_orderkey * 100 + l_linenumber) AS pos, 'part' AS type, count(*) AS n FROM lineitem WHERE l_linenumber <= 2 GROUP BY 1) e FULL JOIN (SELECT key, min(pos) AS pos FROM (SELECT 'p' || l_partkey AS key, l_orderkey * 100 + 50 + l_linenumber AS pos FROM lineitem WHERE l_linenumber > 2 UNION ALL SELECT 's' || l_suppkey, l_orderkey * 100 + 50 + l_linenumber FROM lineitem WHERE l_linenumber > 2) GROUP BY 1) r ON e.key = r.key""")
def i5_endpoint_stubs(t):
    li = t("lineitem")
    part = F.concat(F.lit("P"), F.col("l_partkey").cast("string"))
    ents = li.filter("l_linenumber <= 2").select(F.col("l_orderkey").alias("chunk_ord"), F.col("l_linenumber").alias("ord"), part.alias("name"), F.lit("part").alias("type"))
    rels = li.filter("l_linenumber > 2").select(F.col("l_orderkey").alias("chunk_ord"), F.col("l_linenumber").alias("ord"), part.alias("source"), F.concat(F.lit("s"), F.col("l_suppkey").cast("string")).alias("target"))
    return G.with_stubs(ents, rels).select("key", "node_type", "mention_count")


# Ids of the graph: region 1.., nation 100.., supplier 10000.., part 1000000..
EDGES = "edges AS (SELECT 100 + n_nationkey AS src, 1 + n_regionkey AS dst, 'IN_REGION' AS relation FROM nation UNION ALL SELECT 10000 + s_suppkey, 100 + s_nationkey, 'LOCATED_IN' FROM supplier UNION ALL SELECT DISTINCT 10000 + l_suppkey, 1000000 + l_partkey, 'SUPPLIES' FROM lineitem)"
BOTH = "both_ways AS (SELECT src AS u, dst AS v FROM edges UNION SELECT dst, src FROM edges)"
# Supplier and part names of the whole table.
SPARSE = "sparse AS (SELECT DISTINCT 's' || l_suppkey AS src, 'p' || l_partkey AS dst FROM lineitem)"


def edge_rows(t: Tables):
    """Edges between nations and regions, suppliers and nations, suppliers and parts; of the last a row for each line."""
    n = t("nation").select((100 + F.col("n_nationkey")).cast("long").alias("src"), (1 + F.col("n_regionkey")).cast("long").alias("dst"), F.lit("IN_REGION").alias("relation"))
    s = t("supplier").select((10000 + F.col("s_suppkey")).cast("long").alias("src"), (100 + F.col("s_nationkey")).cast("long").alias("dst"), F.lit("LOCATED_IN").alias("relation"))
    p = t("lineitem").select((10000 + F.col("l_suppkey")).alias("src"), (1000000 + F.col("l_partkey")).alias("dst"), F.lit("SUPPLIES").alias("relation"))
    return n, s, p


def edges(t: Tables):
    n, s, p = edge_rows(t)
    return n.unionByName(s).unionByName(p.distinct())


def repeated_edges(t: Tables):
    """The edges for searches, which make distinct only what they reach."""
    n, s, p = edge_rows(t)
    return n.unionByName(s).unionByName(p)


def sparse_rows(t: Tables):
    return t("lineitem").select(F.concat(F.lit("s"), F.col("l_suppkey").cast("string")).alias("src"), F.concat(F.lit("p"), F.col("l_partkey").cast("string")).alias("dst"))


def sparse(t: Tables):
    return sparse_rows(t).distinct()


def supply_tree(t: Tables):
    """Levels of communities of suppliers and parts, the nodes with names, and the relations."""
    weights = supply_weights(t)
    tree = M.community_levels(weights)
    none = F.lit(None).cast("string")
    nodes = t("supplier").select(F.concat(F.lit("s"), F.col("s_suppkey").cast("string")).alias("node"), F.col("s_name").alias("name"), F.lit("supplier").alias("type"), none.alias("description"))
    nodes = nodes.unionByName(t("part").select(F.concat(F.lit("p"), F.col("p_partkey").cast("string")).alias("node"), F.concat("p_name", F.lit(" "), F.col("p_partkey").cast("string")).alias("name"), F.lit("part").alias("type"), F.col("p_type").alias("description")))
    relations = weights.select(F.col("src").alias("source"), F.col("dst").alias("target"), F.lit("SUPPLIES").alias("type"), none.alias("description"))
    return tree, nodes, relations


@query(f"""SELECT query_id, chunk_id, round(max(score), 6) AS score FROM (
    WITH matched AS (SELECT * FROM (SELECT q.vec_id AS query_id, c.vec_id AS node, list_cosine_similarity({V64.replace('embedding', 'q.embedding')}, {V64.replace('embedding', 'c.embedding')}) AS score, row_number() OVER (PARTITION BY q.vec_id ORDER BY list_cosine_similarity({V64.replace('embedding', 'q.embedding')}, {V64.replace('embedding', 'c.embedding')}) DESC, c.vec_id) AS r FROM embeddings q CROSS JOIN embeddings c WHERE q.vec_id % 50 = 0) WHERE r <= 5 AND score >= 0.3),
    links AS (SELECT vec_id AS u, vec_id // 2 AS v FROM embeddings UNION SELECT vec_id // 2, vec_id FROM embeddings),
    one AS (SELECT DISTINCT query_id, v AS node FROM matched JOIN links ON u = node), reached AS (SELECT query_id, node FROM matched UNION SELECT query_id, node FROM one UNION SELECT query_id, v FROM one JOIN links ON u = node)
    SELECT r.query_id, r.node % 50 AS chunk_id, coalesce(m.score, 0) AS score FROM reached r LEFT JOIN matched m USING (query_id, node)) GROUP BY 1, 2""")
def i6_graph_retrieval(t):
    return graph_scores(t, vector_queries(t), F.col("vec_id") % 50).select("query_id", "chunk_id", F.round("score", 6).alias("score"))


def graph_scores(t: Tables, queries, chunk):
    """Graph retrieval over a tree of vectors: the five nearest nodes, all within two steps of them, and their chunks."""
    e = t("embeddings")
    matched = exact_top_k(e.select(F.col("vec_id").alias("chunk_id"), "embedding"), queries, 5, 0.3).select("query_id", F.col("chunk_id").alias("node"), "score")
    tree = e.select(F.col("vec_id").alias("src"), F.floor(F.col("vec_id") / 2).alias("dst"))
    reached = G.neighbourhood(tree, matched, 2, by="query_id").select("query_id", "node")
    nodes = e.select(F.col("vec_id").alias("node_id"), F.concat(F.lit("n"), F.col("vec_id").cast("string")).alias("name"), F.array(chunk).alias("source_chunks"))
    return G.chunk_scores(matched, reached, nodes)


NEAR = f"list_cosine_similarity({V64.replace('embedding', 'q.embedding')}, {V64.replace('embedding', 'c.embedding')})"
# Each benchmark text asks with its words and with the vector of its number; document n's first chunk has vector n.
THREE = f"""asked AS (SELECT item_id AS query_id, embedding FROM benchmark JOIN embeddings ON vec_id = item_id), near AS (SELECT q.query_id, c.vec_id AS node, {NEAR} AS score FROM asked q CROSS JOIN embeddings c),
    by_vector AS (SELECT query_id, 'vector' AS source, 0 AS ordinal, node || ':0' AS chunk_id, row_number() OVER (PARTITION BY query_id ORDER BY round(score, 9) DESC, node || ':0') AS rank FROM near),
    by_keyword AS (SELECT query_id, 'keyword' AS source, 1 AS ordinal, chunk_id, row_number() OVER (PARTITION BY query_id ORDER BY round(score, 9) DESC, chunk_id) AS rank FROM bm25),
    matched AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, node) AS r FROM near) WHERE r <= 5 AND score >= 0.3),
    tree AS (SELECT vec_id AS u, vec_id // 2 AS v FROM embeddings UNION SELECT vec_id // 2, vec_id FROM embeddings),
    one AS (SELECT DISTINCT query_id, v AS node FROM matched JOIN tree ON u = node), reached AS (SELECT query_id, node FROM matched UNION SELECT query_id, node FROM one UNION SELECT query_id, v FROM one JOIN tree ON u = node),
    by_graph AS (SELECT query_id, 'graph' AS source, 2 AS ordinal, chunk_id, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, chunk_id) AS rank FROM (SELECT r.query_id, r.node || ':0' AS chunk_id, round(coalesce(m.score, 0), 9) AS score FROM reached r JOIN embeddings ON vec_id = r.node LEFT JOIN matched m USING (query_id, node))),
    lists AS (SELECT * FROM by_vector WHERE rank <= 20 UNION ALL SELECT * FROM by_keyword WHERE rank <= 20 UNION ALL SELECT * FROM by_graph WHERE rank <= 10),
    fused AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY f DESC, seen, chunk_id) AS rank FROM (SELECT query_id, chunk_id, sum(1.0::DOUBLE / (60 + rank)) AS f, min((ordinal, rank)) AS seen FROM lists GROUP BY 1, 2))"""


@query("SELECT f.query_id, f.rank, f.chunk_id, round(f, 6) AS score, (SELECT count(*) FROM lists l WHERE l.query_id = f.query_id AND source = 'keyword') AS by_keyword, (SELECT count(*) FROM lists l WHERE l.query_id = f.query_id AND source = 'graph') AS by_graph, length(content) AS chars FROM fused f JOIN chunks USING (chunk_id) WHERE rank <= 10 AND f >= 0.01", *TEXT, THREE)
def h5_three_retrievers(t):
    """Vector, keyword and graph retrieval of the same queries, fused over shared chunks."""
    e = t("embeddings")
    queries = t("benchmark").join(e, F.col("item_id") == F.col("vec_id")).select(F.col("item_id").alias("query_id"), F.col("embedding").alias("q"))
    rounded = lambda df: df.withColumn("score", F.round("score", 9))
    first = F.concat(F.col("vec_id").cast("string"), F.lit(":0"))
    sources = {"vector": rounded(exact_top_k(e.select(first.alias("chunk_id"), "embedding"), queries, 40)), "keyword": rounded(keyword_top_k(t, 20)), "graph": rounded(graph_scores(t, queries, first))}
    got = hybrid_retrieval(sources, chunks(t).select("chunk_id", "content"), "rrf", 10, 0.01)
    n = lambda s: F.coalesce(F.try_element_at("found_by", F.lit(s)), F.lit(0)).cast("long")
    return got.select("query_id", "rank", "chunk_id", F.round("score", 6).alias("score"), n("keyword").alias("by_keyword"), n("graph").alias("by_graph"), F.length("content").alias("chars"))


@query("SELECT node, min(level) AS level FROM (SELECT 105 AS node, 0 AS level UNION ALL SELECT v, 1 FROM both_ways WHERE u = 105 UNION ALL SELECT b.v, 2 FROM both_ways a JOIN both_ways b ON a.v = b.u WHERE a.u = 105) GROUP BY 1", EDGES, BOTH)
def i7_neighbourhood(t):
    seed = t.spark.range(1).select(F.lit(0).alias("seed"), F.lit(105).cast("long").alias("node"))
    return G.neighbourhood(repeated_edges(t), seed, 2).select("node", "level")


@query("WITH near AS (SELECT 105 AS node UNION SELECT CASE WHEN src = 105 THEN dst ELSE src END FROM edges WHERE relation <> 'IN_REGION' AND 105 IN (src, dst)) SELECT DISTINCT src, dst, relation FROM edges WHERE relation <> 'IN_REGION' AND (src IN (SELECT node FROM near) OR dst IN (SELECT node FROM near))".replace("WITH near AS", "SELECT * FROM (WITH near AS") + ")", EDGES)
def i7_neighbour_edges(t):
    seed = t.spark.range(1).select(F.lit(0).alias("seed"), F.lit(105).cast("long").alias("node"))
    return G.neighbour_edges(repeated_edges(t), seed, 2, ("LOCATED_IN", "SUPPLIES")).select("src", "dst", "relation")


@query("""SELECT seed, node, level FROM (SELECT n_nationkey AS seed, 100 + n_nationkey AS node, 0 AS level FROM nation UNION ALL SELECT * FROM (SELECT n, s, 1 FROM (SELECT s_nationkey AS n, 10000 + s_suppkey AS s, row_number() OVER (PARTITION BY s_nationkey ORDER BY s_suppkey) AS r FROM supplier) WHERE r <= 10)
    UNION ALL SELECT n, p, 2 FROM (SELECT n, p, row_number() OVER (PARTITION BY n ORDER BY p) AS r FROM (SELECT DISTINCT n, 1000000 + l_partkey AS p FROM lineitem JOIN (SELECT s_nationkey AS n, s_suppkey AS s, row_number() OVER (PARTITION BY s_nationkey ORDER BY s_suppkey) AS r FROM supplier) ON l_suppkey = s WHERE r <= 10)) WHERE r <= 10)""")
def i6_limited_levels(t):
    seeds = t("nation").select(F.col("n_nationkey").alias("seed"), (100 + F.col("n_nationkey")).cast("long").alias("node"))
    return G.neighbourhood(G.of_relations(repeated_edges(t), ("LOCATED_IN", "SUPPLIES")), seeds, 2, per_level=10)


@query("SELECT count(DISTINCT node) AS nodes, (SELECT count(*) FROM edges WHERE src IN (SELECT v FROM both_ways WHERE u IN (103, 107) UNION SELECT unnest([103, 107])) AND dst IN (SELECT v FROM both_ways WHERE u IN (103, 107) UNION SELECT unnest([103, 107]))) AS edges FROM (SELECT v AS node FROM both_ways WHERE u IN (103, 107) UNION ALL SELECT unnest([103, 107]))", EDGES, BOTH)
def i8_entity_context(t):
    seeds = t.spark.createDataFrame([(0, 103), (0, 107)], "seed int, node long")
    around = G.neighbourhood(repeated_edges(t), seeds, 1)
    inner = G.induced_edges(repeated_edges(t), around.select("seed", "node"))
    return around.agg(F.countDistinct("node").alias("nodes")).crossJoin(inner.agg(F.count("*").alias("edges")))


@query("""SELECT s_suppkey AS pair, CASE WHEN n_regionkey = 2 THEN (10000 + s_suppkey) || '-' || (100 + s_nationkey) || '-3' WHEN two IS NOT NULL THEN (10000 + s_suppkey) || '-' || two END AS path
    FROM supplier JOIN nation ON s_nationkey = n_nationkey LEFT JOIN (SELECT a.l_suppkey AS s, min_by(p || '-' || t || '-' || n || '-3', [p, t, n]) AS two FROM (SELECT DISTINCT l_suppkey, 1000000 + l_partkey AS p FROM lineitem) a
    JOIN (SELECT DISTINCT 10000 + l_suppkey AS t, 1000000 + l_partkey AS p, 100 + s_nationkey AS n FROM lineitem JOIN supplier ON s_suppkey = l_suppkey JOIN nation ON n_nationkey = s_nationkey WHERE n_regionkey = 2) USING (p) GROUP BY 1) ON s = s_suppkey""")
def i9_shortest_path(t):
    pairs = t("supplier").select(F.col("s_suppkey").alias("pair"), (10000 + F.col("s_suppkey")).alias("a"), F.lit(3).cast("long").alias("b"))
    return G.shortest_paths(edges(t), pairs, 4).select("pair", F.array_join(F.col("path").cast("array<string>"), "-").alias("path"))


@query("SELECT relation, count(*) AS edges, count(DISTINCT src) AS sources, count(DISTINCT dst) AS targets FROM edges GROUP BY 1", EDGES)
def i10_graph_stats(t):
    return edges(t).groupBy("relation").agg(F.count("*").alias("edges"), F.countDistinct("src").alias("sources"), F.countDistinct("dst").alias("targets"))


@query("SELECT relation, count(*) AS edges FROM edges WHERE src NOT IN (101, 102) AND dst NOT IN (101, 102) AND src % 7 <> 0 AND dst NOT IN (SELECT src FROM edges WHERE src % 7 = 0) GROUP BY 1", EDGES)
def i11_cascade_delete(t):
    e = edges(t)
    gone = e.filter("src % 7 = 0").select(F.col("src").alias("node")).unionByName(t.spark.createDataFrame([(101,), (102,)], "node long")).distinct()
    nodes = e.select(F.col("src").alias("node_id")).distinct()
    return G.cascade_delete(nodes, e, gone.filter("node % 7 = 0 or node in (101, 102)"))[1].groupBy("relation").agg(F.count("*").alias("edges"))


@query("SELECT vec_id, 'label' || label || ': n' || vec_id AS embed_text FROM embeddings WHERE vec_id % 4 = 0")
def i12_embedding_worklist(t):
    nodes = t("embeddings").withColumn("embedding", F.when(F.col("vec_id") % 4 != 0, F.col("embedding")).otherwise(F.array().cast("array<float>")))
    return nodes.filter(F.size("embedding") == 0).select("vec_id", F.concat(F.lit("label"), F.col("label").cast("string"), F.lit(": n"), F.col("vec_id").cast("string")).alias("embed_text"))


@query()
def i13_communities(t):
    s = sparse(t)
    names = t("supplier").select(F.concat(F.lit(" S"), F.col("s_suppkey").cast("string")).alias("name")).unionByName(s.select(F.col("dst").alias("name"))).unionByName(s.select(F.col("src").alias("name")))
    return G.communities(names, s.select(F.upper("src").alias("source"), F.col("dst").alias("target")))


@query("SELECT s_nationkey % 5 AS community, count(*) AS n FROM sparse JOIN (SELECT 's' || s_suppkey AS src, s_nationkey FROM supplier) USING (src) JOIN (SELECT 'p' || p_partkey AS dst, p_partkey % 5 AS c FROM part) USING (dst) WHERE s_nationkey % 5 = c GROUP BY 1", SPARSE)
def i14_inner_relations(t):
    m = t("supplier").select(F.concat(F.lit("s"), F.col("s_suppkey").cast("string")).alias("key"), (F.col("s_nationkey") % 5).cast("long").alias("community")).unionByName(t("part").select(F.concat(F.lit("p"), F.col("p_partkey").cast("string")).alias("key"), (F.col("p_partkey") % 5).alias("community")))
    return G.inner_relations(sparse(t), m).groupBy("community").agg(F.count("*").alias("n"))


@query()
def i15_label_communities(t):
    e = sparse(t).withColumn("weight", F.lit(1.0))
    labels = G.label_communities(e)
    return labels.groupBy("label").agg(F.count("*").alias("members")).crossJoin(G.modularity(e, labels))


def supply_weights(t: Tables):
    """Suppliers and parts, joined by how often a part comes from a supplier."""
    pairs = t("lineitem").groupBy("l_suppkey", "l_partkey").agg(F.count("*").cast("double").alias("weight"))
    return pairs.select(F.concat(F.lit("s"), F.col("l_suppkey").cast("string")).alias("src"), F.concat(F.lit("p"), F.col("l_partkey").cast("string")).alias("dst"), "weight")


@query()
def i15_modularity_communities(t):
    return M.members_by_level(M.community_levels(supply_weights(t))).withColumn("quality", F.round("quality", 6))


@query()
def i16_level_digests(t):
    tree, nodes, relations = supply_tree(t)
    return M.level_digests(tree, nodes, relations)


@query()
def i17_level_context(t):
    """Per configuration its communities' first pages as summaries, from the highest level down."""
    from pyspark.sql import Window

    tree, nodes, relations = supply_tree(t)
    pages = M.level_digests(tree, nodes, relations, pages=1)
    first = M.members_by_level(tree).join(nodes, "node").withColumn("r", F.row_number().over(Window.partitionBy("level", "community").orderBy("name"))).filter("r <= 5")
    entities = first.groupBy("level", "community").agg(F.array_sort(F.collect_list("name")).alias("entities"))
    rows = pages.join(entities, ["level", "community"]).select(F.concat(F.lit("level"), F.col("level").cast("string")).alias("config_id"), "level", "community", "entities", F.concat(F.col("members").cast("string"), F.lit(" members: "), F.substring("digest", 1, 60)).alias("summary"))
    return G.global_context(rows)


@query("""SELECT community, 'Entities:' || chr(10) || string_agg('- ' || n_name || ' (nation) - no. ' || n_nationkey, chr(10) ORDER BY n_name) || chr(10) || chr(10) || 'Relations:' || chr(10) || CASE WHEN community = 0 THEN '(none)' ELSE string_agg('- ' || n_name || ' --[IN_REGION]--> r' || community, chr(10) ORDER BY '- ' || n_name || ' --[IN_REGION]--> r' || community) END AS digest FROM (SELECT n_name, n_nationkey, n_regionkey AS community FROM nation) GROUP BY 1""")
def i16_digests(t):
    n = t("nation").withColumn("community", F.col("n_regionkey"))
    members = n.select("community", F.col("n_name").alias("name"), F.lit("nation").alias("type"), F.concat(F.lit("no. "), F.col("n_nationkey").cast("string")).alias("description"))
    rel = n.filter("community > 0").select("community", F.col("n_name").alias("source"), F.lit("IN_REGION").alias("type"), F.concat(F.lit("r"), F.col("community").cast("string")).alias("target"), F.lit("").alias("description"))
    return G.digests(members, rel)


@query("""SELECT config_id, string_agg('[Community ' || i || '] (Entities: ' || e || ')' || chr(10) || 'summary ' || lvl, chr(10) || chr(10) ORDER BY i) AS context FROM (SELECT config_id, lvl, row_number() OVER (PARTITION BY config_id ORDER BY lvl DESC) AS i, e FROM
    (SELECT c_mktsegment AS config_id, c_nationkey AS lvl, array_to_string((list(c_name ORDER BY c_name))[1:5], ', ') AS e FROM customer GROUP BY 1, 2)) WHERE i <= 10 GROUP BY 1""")
def i17_global_context(t):
    from pyspark.sql import Window

    # Of a community's members only the first few are ever gathered.
    c = t("customer").withColumn("r", F.row_number().over(Window.partitionBy("c_mktsegment", "c_nationkey").orderBy("c_name"))).filter("r <= 5")
    g = c.groupBy(F.col("c_mktsegment").alias("config_id"), F.col("c_nationkey").alias("level")).agg(F.array_sort(F.collect_list("c_name")).alias("entities"))
    return G.global_context(g.withColumns({"community": F.col("level"), "summary": F.concat(F.lit("summary "), F.col("level").cast("string"))}))
