"""Text normalisation and chunking."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from corpusmill.functions.text import strip_lines, words
from corpusmill.operators import chunking as C
from corpusmill.operators.embedding import hashed_terms
from corpusmill.plans.registry import CHUNKS, Tables, chunks, query


def _marked(t: Tables) -> DataFrame:
    """Documents with blank lines between lines and every third line a heading."""
    lines = F.transform(F.split("text", "\n"), lambda x, i: F.when(i % 3 == 0, F.concat(F.lit("## "), x)).otherwise(x))
    return t("documents").select("doc_id", F.array_join(lines, "\n").alias("text"))


@query(r"SELECT doc_id, md5(string_agg(regexp_replace(l, '^\s+|\s+$', '', 'g'), chr(10) ORDER BY i)) AS stripped_md5 FROM (SELECT doc_id, unnest(string_split(text, chr(10))) AS l, unnest(range(len(string_split(text, chr(10))))) AS i FROM documents) GROUP BY doc_id")
def c1_strip_lines(t):
    return t("documents").select("doc_id", F.md5(strip_lines(F.col("text"))).alias("stripped_md5"))


@query(r"SELECT chunk_id, length(content) AS char_count, len(list_filter(string_split_regex(content, '\s+'), lambda w: w <> '')) AS word_count, md5(content) AS content_hash FROM chunks", CHUNKS)
def c2_chunk_stats(t):
    return chunks(t).select("chunk_id", F.length("content").alias("char_count"), F.size(words(F.col("content"))).alias("word_count"), F.md5("content").alias("content_hash"))


@query(r"SELECT doc_id, len(string_split(text, chr(10))) AS line_count, len(list_filter(string_split(text, chr(10)), lambda x: regexp_replace(x, '^\s+|\s+$', '', 'g') = '')) AS empty_line_count, len(list_filter(string_split_regex(text, '\s+'), lambda w: w <> '')) AS word_count, length(text) AS char_count, doc_id % 8 = 1 AS is_markdown FROM documents")
def c3_document_stats(t):
    return t("documents").select("doc_id", *[c.alias(n) for n, c in C.text_stats("text").items()], (F.col("doc_id") % 8 == 1).alias("is_markdown"))


@query(r"SELECT doc_id, length(regexp_extract(l, '^(#+)', 1)) AS level, regexp_replace(regexp_extract(l, '^#+(.*)$', 1), '^\s+|\s+$', '', 'g') AS title, i + 1 AS line_number FROM (SELECT doc_id, CASE WHEN i % 3 = 0 THEN '## ' || l ELSE l END AS l, i FROM (SELECT doc_id, unnest(string_split(text, chr(10))) AS l, unnest(range(len(string_split(text, chr(10))))) AS i FROM documents)) WHERE l LIKE '#%' AND regexp_replace(regexp_extract(l, '^#+(.*)$', 1), '^\s+|\s+$', '', 'g') <> ''")
def c4_sections(t):
    return C.sections(_marked(t), "doc_id", "text")


@query("SELECT chunk_id, chunk_index, start_char, end_char, md5(content) AS content_hash FROM chunks", CHUNKS)
def c5_fixed_windows(t):
    return chunks(t).select("chunk_id", "chunk_index", "start_char", "end_char", F.md5("content").alias("content_hash"))


@query(r"""SELECT doc_id, row_number() OVER (PARTITION BY doc_id ORDER BY i) - 1 AS chunk_index, start_char, start_char + length(content) AS end_char, md5(content) AS content_hash FROM (
    SELECT doc_id, i, regexp_replace(p, '^\s+|\s+$', '', 'g') AS content, coalesce(sum(length(p) + 2) OVER (PARTITION BY doc_id ORDER BY i ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) + length(p) - length(regexp_replace(p, '^\s+', '')) AS start_char
    FROM (SELECT doc_id, unnest(string_split(replace(text, chr(10), chr(10) || chr(10)), chr(10) || chr(10))) AS p, unnest(range(len(string_split(replace(text, chr(10), chr(10) || chr(10)), chr(10) || chr(10))))) AS i FROM documents)) WHERE length(content) >= 50""")
def c6_paragraphs(t):
    d = t("documents").select("doc_id", F.replace("text", F.lit("\n"), F.lit("\n\n")).alias("text"))
    return C.paragraphs(d, "doc_id", "text").select("doc_id", "chunk_index", "start_char", "end_char", F.md5("content").alias("content_hash"))


@query("SELECT doc_id, 0 AS chunk_index, length(text) AS end_char, md5(text) AS content_hash FROM documents WHERE length(text) > 0")
def c7_whole_documents(t):
    return C.whole_documents(t("documents"), "doc_id", "text").select("doc_id", "chunk_index", "end_char", F.md5("content").alias("content_hash"))


@query()
def c8_recursive(t):
    return C.recursive(t("documents"), "doc_id", "text").select("doc_id", "chunk_index", "start_char", "end_char", F.md5("content").alias("content_hash"))


@query(r"""SELECT doc_id, i AS chunk_index, CASE WHEN tail <> '' THEN greatest(0, pos - length(tail) - 1) ELSE pos END AS start_char, pos + length(l) AS end_char, md5(regexp_replace(CASE WHEN tail <> '' THEN tail || ' ' || l ELSE l END, '^\s+|\s+$', '', 'g')) AS content_hash FROM (
    SELECT doc_id, i, l, coalesce(sum(length(l) + 1) OVER (PARTITION BY doc_id ORDER BY i ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS pos, coalesce(right(lag(l) OVER (PARTITION BY doc_id ORDER BY i), 40), '') AS tail
    FROM (SELECT doc_id, unnest(string_split(text, chr(10))) AS l, unnest(range(len(string_split(text, chr(10))))) AS i FROM documents)) WHERE length(regexp_replace(CASE WHEN tail <> '' THEN tail || ' ' || l ELSE l END, '^\s+|\s+$', '', 'g')) >= 20""")
def c9_overlap(t):
    lines = t("documents").select("doc_id", F.posexplode(F.split("text", "\n")).alias("i", "l"))
    return C.overlapped(lines, "doc_id", "i", "l", 40, 20).select("doc_id", "chunk_index", "start_char", "end_char", F.md5("content").alias("content_hash"))


@query()
def c10_semantic(t):
    return C.semantic(t("documents"), "doc_id", "text").select("doc_id", "chunk_index", "start_char", "end_char", "sentence_count", F.md5("content").alias("content_hash"))


@query()
def c11_late_spans(t):
    return C.late(t("documents"), "doc_id", "text").select("doc_id", "chunk_index", "start_char", "end_char", "span_start_token", "span_end_token", F.md5("content").alias("content_hash"))


@query()
def c12_raptor_leaves(t):
    return C.raptor(t("documents"), "doc_id", "text").select("doc_id", "chunk_index", "tree_level", "start_char", "end_char", F.md5("content").alias("content_hash"))


@query(r"""SELECT doc_id, CAST(floor(chunk_index / 5) AS INT) AS chunk_index, count(*) AS children, md5(string_agg(md5(content), '|' ORDER BY chunk_index)) AS parent_id, md5(substr(substr(string_agg(content, chr(10) || chr(10) || '---' || chr(10) || chr(10) ORDER BY chunk_index), 1, 8000), 1, 500)) AS summary_md5
    FROM chunks GROUP BY 1, 2""", CHUNKS)
def c13_raptor_parents(t):
    rows = C.raptor_parents(chunks(t).withColumn("tree_level", F.lit(0)), "doc_id")
    return rows.select("doc_id", "chunk_index", F.col("children").cast("long").alias("children"), "parent_id", F.md5("content").alias("summary_md5"))


@query()
def c13_summary_tree(t):
    """Leaves of every document and three levels over them, by k-means of hashed terms."""
    leaves = C.raptor(t("documents"), "doc_id", "text", size=100)
    tree = C.raptor_tree(leaves, "doc_id", embed=lambda level: level.withColumn("vec", hashed_terms(F.col("content"), 16)))
    return tree.select("doc_id", "tree_level", "chunk_index", "children", "parent_id", F.md5("content").alias("content_md5"))


@query(r"""SELECT strategy, count(*) AS chunks, sum(length(content)) AS chars FROM (SELECT 'document' AS strategy, text AS content FROM documents WHERE length(text) > 0 UNION ALL SELECT 'fixed', content FROM chunks) GROUP BY 1""", CHUNKS)
def c14_dispatch(t):
    one = [C.chunk(t("documents"), s, "doc_id", "text").select(F.lit(s).alias("strategy"), "content") for s in ("document", "fixed")]
    return one[0].unionByName(one[1]).groupBy("strategy").agg(F.count("*").alias("chunks"), F.sum(F.length("content")).cast("long").alias("chars"))


@query(r"SELECT chunk_id, regexp_replace(content, '^\s+|\s+$', '', 'g') AS embed_text FROM (SELECT chunk_id, CASE WHEN chunk_index % 5 = 0 THEN '  ' ELSE ' ' || content || ' ' END AS content FROM chunks) WHERE regexp_replace(content, '^\s+|\s+$', '', 'g') <> ''", CHUNKS)
def c15_valid_texts(t):
    from corpusmill.functions.text import strip

    blank = chunks(t).select("chunk_id", F.when(F.col("chunk_index") % 5 == 0, F.lit("  ")).otherwise(F.concat(F.lit(" "), "content", F.lit(" "))).alias("content"))
    return blank.select("chunk_id", strip(F.col("content")).alias("embed_text")).filter("embed_text <> ''")
