"""Scans, stores, paged reads, duplicates and job decisions."""

from __future__ import annotations

from pyspark.sql import functions as F

from corpusmill.operators import corpus as C
from corpusmill.operators.store import KeyedStore, buckets_for
from corpusmill.plans.registry import CHUNKS, FILES, JOBS, chunks, files, jobs, query
from corpusmill.workspace import Workspace

KIND = "CASE WHEN ext IN ('txt','md','rst','log') THEN 'text' WHEN ext IN ('csv','xls','xlsx') THEN 'excel' WHEN ext = 'pdf' THEN 'pdf' WHEN ext = 'html' THEN 'html' END"
EXT = "files2 AS (SELECT *, regexp_extract(path, '\\.([a-z]+)$', 1) AS ext FROM files)"
IDEM = "idem AS (SELECT *, sha256(config_id || ':' || md5(CAST(user_id AS VARCHAR))) AS idem FROM jobs)"


@query("SELECT path FROM files WHERE regexp_extract(path, '\\.([a-z]+)$', 1) <> 'xyz' AND path NOT LIKE '%/src1/%'", FILES)
def a1_scan_list(t):
    return files(t).filter(C.processor_type(F.col("path")).isNotNull() & ~F.col("path").contains("/src1/")).select("path").orderBy("path")


@query(f"SELECT path, {KIND} AS processor FROM files2", FILES, EXT)
def a2_processor_type(t):
    return files(t).select("path", C.processor_type(F.col("path")).alias("processor"))


@query(f"SELECT status, ext, count(*) AS n FROM (SELECT CASE WHEN {KIND} IS NULL THEN 'skipped' WHEN ext NOT IN ('txt','md','rst','pdf','docx','png','jpg') THEN 'unprocessable' ELSE 'ok' END AS status, ext FROM files2) GROUP BY 1, 2", FILES, EXT)
def a3_scan_audit(t):
    return C.scan_audit(files(t)).groupBy("status", F.expr("substring(regexp_extract(path, '(\\\\.[a-z]+)$', 1), 2)").alias("ext")).agg(F.count("*").alias("n"))


@query("SELECT doc_id, md5(text) AS content_hash FROM documents")
def a5_content_hash(t):
    return t("documents").select("doc_id", F.md5("text").alias("content_hash"))


@query("SELECT doc_id, CASE WHEN strlen(text) > 10000 THEN 'too_large' WHEN doc_id % 8 = 7 THEN 'unsupported' ELSE 'ok' END AS verdict FROM documents")
def a7_validation(t):
    f = files(t)
    size, kind = F.octet_length("text"), C.processor_type(F.col("path"))
    errors = F.array_compact(F.array(F.when(size > 10000, "too_large"), F.when(kind.isNull(), "unsupported")))
    return f.select("doc_id", F.coalesce(F.get(errors, F.lit(0)), F.lit("ok")).alias("verdict"))


@query(f"SELECT folder, count(*) AS file_count, string_agg(DISTINCT kind, ',' ORDER BY kind) AS types, coalesce(bool_or(kind = 'pdf'), false) AS has_multimodal FROM (SELECT *, {KIND} AS kind FROM files2) GROUP BY 1", FILES, EXT)
def a8_folder_inventory(t):
    return C.folder_inventory(files(t), "/data").withColumn("types", F.array_join("types", ","))


@query("SELECT config_id, path AS file_path, n FROM (SELECT config_id, '/data/' || folder AS path, count(*) AS n FROM files GROUP BY 1, 2) WHERE n > 1", FILES)
def a12_unique_keys(t):
    return C.duplicate_keys(files(t).select("config_id", F.concat(F.lit("/data/"), "folder").alias("file_path")), "config_id", "file_path")


@query("SELECT * FROM (SELECT config_id, 'chunks' AS part, count(*) AS n FROM chunks JOIN (SELECT doc_id, config_id FROM files) USING (doc_id) GROUP BY 1 UNION ALL SELECT config_id, 'files', count(*) FROM files GROUP BY 1 UNION ALL SELECT 'cfg' || (o_custkey % 10), 'jobs', count(*) FROM orders GROUP BY 1) WHERE config_id <> 'cfg1'", CHUNKS, FILES)
def a13_refresh_delete(t):
    f, c, j = C.full_refresh("cfg1", files(t), (chunks(t), "doc_id"), keep_history=False, history=jobs(t))
    parts = [("files", f), ("chunks", c.join(files(t).select("doc_id", "config_id"), "doc_id")), ("jobs", j)]
    counts = [d.groupBy("config_id").agg(F.count("*").alias("n")).select("config_id", F.lit(name).alias("part"), "n") for name, d in parts]
    return counts[0].unionByName(counts[1]).unionByName(counts[2])


@query("SELECT doc_id, lang, source FROM (SELECT doc_id, lang, source FROM documents WHERE doc_id % 3 <> 0 UNION SELECT doc_id, lang, source FROM documents WHERE doc_id % 3 = 0)")
def a12_store_insert(t):
    d = t("documents").select("doc_id", "lang", "source")
    some = d.filter("doc_id % 3 <> 0")
    return C.insert_new(some, d.unionByName(d.filter("doc_id % 2 = 0")), "doc_id")


def _chunk_store(t):
    """Chunks by document and index in the scope of their configuration: two thirds of the documents come first, then all, then one configuration anew with every other chunk."""
    rows = chunks(t).join(files(t).select("doc_id", "config_id"), "doc_id").select("config_id", "doc_id", "chunk_index", F.md5("content").alias("content_md5"), F.lit(0).alias("loaded"))
    store = KeyedStore(t.spark, Workspace(t.spark, "chunk-store").path("store"), ["doc_id", "chunk_index"], rows.schema, part="config_id", buckets=buckets_for(t("documents").count()))
    store.insert(rows.filter("doc_id % 3 <> 0"), 0)
    store.insert(rows.withColumn("loaded", F.lit(1)), 1)
    store.refresh("cfg1", rows.filter("config_id = 'cfg1' and chunk_index % 2 = 0").withColumn("loaded", F.lit(2)), 2)
    # Again, as after a failure of the caller: nothing is done twice.
    store.insert(rows.withColumn("loaded", F.lit(9)), 1)
    return store, rows


STORED = "stored AS (SELECT config_id, doc_id, chunk_index, md5(content) AS content_md5, CASE WHEN config_id = 'cfg1' THEN 2 WHEN doc_id % 3 <> 0 THEN 0 ELSE 1 END AS loaded FROM chunks JOIN (SELECT doc_id, config_id FROM files) USING (doc_id) WHERE config_id <> 'cfg1' OR chunk_index % 2 = 0)"


@query("SELECT * FROM stored", CHUNKS, FILES, STORED)
def a12_chunk_store(t):
    return _chunk_store(t)[0].read()


@query("SELECT * REPLACE (CASE WHEN doc_id % 100 = 0 THEN 3 ELSE loaded END AS loaded) FROM stored WHERE doc_id % 100 <> 50", CHUNKS, FILES, STORED)
def a13_store_merge_delete(t):
    """The same store after the chunks of some documents are merged and those of others deleted."""
    store, rows = _chunk_store(t)
    held = store.read()
    store.merge(held.filter("doc_id % 100 = 0").withColumn("loaded", F.lit(3)), 3)
    store.delete(rows.filter("doc_id % 100 = 50"), 4)
    return store.read()


@query("SELECT job_id, config_id, status, total FROM (SELECT *, (SELECT count(*) FROM jobs WHERE config_id = 'cfg3') AS total FROM jobs WHERE config_id = 'cfg3' ORDER BY created_at DESC, job_id LIMIT 20 OFFSET 40)", JOBS)
def b1_page(t):
    mine = jobs(t).filter("config_id = 'cfg3'")
    total = mine.agg(F.count("*").alias("total"))
    return C.page(mine, 40, 20, F.col("created_at").desc(), F.col("job_id")).select("job_id", "config_id", "status").crossJoin(F.broadcast(total))


@query("SELECT doc_id, chunk_index, content FROM chunks WHERE doc_id = 17 ORDER BY chunk_index", CHUNKS)
def b2_document_chunks(t):
    return chunks(t).filter("doc_id = 17").select("doc_id", "chunk_index", "content").orderBy("chunk_index")


@query("SELECT config_id, job_id, status FROM (SELECT *, row_number() OVER (PARTITION BY config_id ORDER BY created_at DESC, job_id DESC) AS r FROM jobs) WHERE r = 1", JOBS)
def b3_latest_job(t):
    return C.latest_per(jobs(t), "config_id", "created_at", "job_id").select("config_id", "job_id", "status")


@query("SELECT chunk_id FROM chunks JOIN (SELECT doc_id, path, config_id FROM files) USING (doc_id) WHERE config_id = 'cfg1' AND folder IN ('src1', 'src5', 'src9') AND lang IN ('en', 'de') AND path LIKE '%.md'", CHUNKS, FILES)
def b4_filter_set(t):
    rows = chunks(t).join(files(t).select("doc_id", "path", "config_id"), "doc_id")
    wanted = F.array(F.lit("en"), F.lit("de"))
    return rows.filter((F.col("config_id") == "cfg1") & F.col("folder").isin("src1", "src5", "src9") & F.arrays_overlap(F.array("lang"), wanted) & (C.extension(F.col("path")) == ".md")).select("chunk_id")


@query("SELECT p_partkey, p_name FROM part WHERE (regexp_matches(p_name, '(?i)RE') OR regexp_matches(p_type, '(?i)RE')) AND p_size > 25")
def b6_regex_search(t):
    return t("part").filter((F.col("p_name").rlike("(?i)RE") | F.col("p_type").rlike("(?i)RE")) & (F.col("p_size") > 25)).select("p_partkey", "p_name")


@query("SELECT md5(content) AS content_md5, 0.5::DOUBLE AS score, chunk_id, doc_id AS document_id, config_id, 'vector' AS source_type, doc_id || '.' || ext AS file_name, path AS file_path, ext AS file_type, chunk_index, c.folder AS folder_path, lang AS metadata FROM chunks c JOIN (SELECT doc_id, config_id, path, regexp_extract(path, '\\.([a-z]+)$', 1) AS ext FROM files) USING (doc_id)", CHUNKS, FILES)
def b7_public_fields(t):
    f = files(t).select("doc_id", "config_id", F.col("path").alias("file_path"), F.element_at(F.split("path", "/"), -1).alias("file_name"), F.regexp_extract("path", r"\.([a-z]+)$", 1).alias("file_type"))
    rows = chunks(t).join(f, "doc_id").withColumns({"score": F.lit(0.5), "source_type": F.lit("vector"), "metadata": F.create_map(F.lit("lang"), "lang"), "document_id": F.col("doc_id"), "folder_path": F.col("folder")})
    return C.public_record(rows).withColumns({"content_md5": F.md5("content"), "metadata": F.col("metadata")["lang"]}).drop("content")


@query("SELECT job_id, status FROM jobs WHERE user_id = 7", JOBS)
def b8_own_rows(t):
    return jobs(t).filter("user_id = 7").select("job_id", "status")


@query("SELECT doc_id, config_id, CASE WHEN path = min(path) OVER (PARTITION BY config_id, md5(text)) THEN 'store' ELSE 'skip' END AS action FROM files", FILES)
def d1_skip_stored(t):
    return C.mark_stored(files(t), "config_id", "text", "path").select("doc_id", "config_id", "action")


@query("SELECT doc_id FROM documents WHERE doc_id % 2 = 1 AND md5(text) NOT IN (SELECT md5(text) FROM documents WHERE doc_id % 2 = 0)")
def d2_incremental(t):
    d = t("documents").select("doc_id", F.md5("text").alias("h"))
    return C.new_only(d.filter("doc_id % 2 = 1"), d.filter("doc_id % 2 = 0"), "h").select("doc_id")


@query("SELECT md5(content) AS content_hash, count(*) AS n, min(chunk_id) AS first_chunk FROM chunks GROUP BY 1 HAVING count(*) > 1", CHUNKS)
def d3_duplicate_chunks(t):
    return chunks(t).groupBy(F.md5("content").alias("content_hash")).agg(F.count("*").alias("n"), F.min("chunk_id").alias("first_chunk")).filter("n > 1")


@query("""SELECT doc_id, source_hash, sha256('cfg' || (doc_id % 4) || ':' || source_hash) AS idem FROM (SELECT doc_id, sha256('{"folder":"' || source || '","lang":"' || lang || '","n":' || n_chars || '}') AS source_hash FROM documents)""")
def d4_idempotency_keys(t):
    source = F.sha2(F.to_json(F.struct(F.col("source").alias("folder"), "lang", F.col("n_chars").alias("n"))), 256)
    rows = t("documents").select("doc_id", source.alias("source_hash"))
    return rows.withColumn("idem", C.idempotency_key(F.concat(F.lit("cfg"), (F.col("doc_id") % 4).cast("string")), F.col("source_hash")))


def _keyed_jobs(t):
    return jobs(t).withColumn("idem", C.idempotency_key(F.col("config_id"), F.md5(F.col("user_id").cast("string"))))


def _requests(t):
    c = t("customer").select((F.col("c_custkey") + 50).alias("user_id"))
    return c.select("user_id", F.concat(F.lit("cfg"), (F.col("user_id") % 10).cast("string")).alias("config_id")).withColumn("idem", C.idempotency_key(F.col("config_id"), F.md5(F.col("user_id").cast("string"))))


REQUESTS = "requests AS (SELECT user_id, config_id, sha256(config_id || ':' || md5(CAST(user_id AS VARCHAR))) AS idem FROM (SELECT c_custkey + 50 AS user_id, 'cfg' || ((c_custkey + 50) % 10) AS config_id FROM customer))"
NEWEST = "newest AS (SELECT idem, status, job_id FROM (SELECT *, row_number() OVER (PARTITION BY idem ORDER BY created_at DESC, job_id DESC) AS r FROM idem) WHERE r = 1)"


@query("SELECT user_id, CASE WHEN n.status IS NOT NULL AND n.status NOT IN ('failed', 'cancelled') THEN 'existing' WHEN r.config_id IN (SELECT config_id FROM jobs WHERE status IN ('pending', 'running')) THEN 'conflict' ELSE 'created' END AS decision FROM requests r LEFT JOIN newest n USING (idem)", JOBS, IDEM, REQUESTS, NEWEST)
def d5_start_decisions(t):
    return C.start_decisions(_requests(t), _keyed_jobs(t)).select("user_id", "decision")


@query("SELECT user_id, CASE WHEN n.status IS NULL THEN 'not_found' WHEN n.status IN ('failed', 'cancelled') THEN 'new' WHEN n.status IN ('pending', 'running') THEN 'existing' ELSE 'rejected' END AS decision FROM requests LEFT JOIN newest n USING (idem)", JOBS, IDEM, REQUESTS, NEWEST)
def d6_retry_decisions(t):
    return C.retry_decisions(_requests(t), _keyed_jobs(t)).select("user_id", "decision")


@query("SELECT 'document' AS kind, CAST(doc_id AS VARCHAR) AS id FROM documents WHERE doc_id NOT IN (SELECT doc_id FROM chunks WHERE chunk_index > 0) UNION ALL SELECT 'chunk', chunk_id FROM chunks WHERE doc_id NOT IN (SELECT doc_id FROM documents WHERE lang <> 'en')", CHUNKS)
def d7_orphans(t):
    ch = chunks(t)
    bare = t("documents").join(ch.filter("chunk_index > 0").select("doc_id"), "doc_id", "left_anti").select(F.lit("document").alias("kind"), F.col("doc_id").cast("string").alias("id"))
    lost = ch.join(t("documents").filter("lang <> 'en'").select("doc_id"), "doc_id", "left_anti").select(F.lit("chunk").alias("kind"), F.col("chunk_id").alias("id"))
    return bare.unionByName(lost)


@query("SELECT doc_id, coalesce(n, 0) AS chunk_count FROM documents LEFT JOIN (SELECT doc_id, count(*) AS n FROM chunks WHERE chunk_index % 2 = 1 GROUP BY 1) USING (doc_id)", CHUNKS)
def d8_chunk_counts(t):
    n = chunks(t).filter("chunk_index % 2 = 1").groupBy("doc_id").agg(F.count("*").alias("n"))
    return t("documents").select("doc_id").join(n, "doc_id", "left").select("doc_id", F.coalesce("n", F.lit(0)).alias("chunk_count"))


@query("SELECT path, CASE WHEN folder = 'src1' THEN '.' WHEN folder LIKE 'src1%' THEN '/data/' || folder ELSE '/data/' || folder END AS folder_path FROM files", FILES)
def d9_folder_path(t):
    return files(t).select("path", C.folder_of(F.col("path"), "/data/src1").alias("folder_path"))
