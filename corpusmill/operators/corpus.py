"""Corpus tables: scans, audits, inventories, stores, duplicates, incremental loads and job decisions."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

# The file types of a scan, and of the processors that take them.
#: Extensions that a scan lists, by type.
EXTENSIONS = {
    "text": (".txt", ".md", ".rst", ".log"),
    "pdf": (".pdf",),
    "docx": (".docx", ".doc"),
    "image": (".png", ".jpg", ".jpeg", ".gif", ".bmp", ".tiff", ".webp"),
    "excel": (".xlsx", ".xls", ".csv"),
    "html": (".html", ".htm"),
}
#: Extensions that a registered processor takes; the scan lists others too.
PROCESSABLE = (".txt", ".md", ".markdown", ".rst", ".text", ".pdf", ".docx", ".png", ".jpg", ".jpeg", ".gif", ".bmp", ".tiff", ".webp")
# End of fixed values.

PROCESSORS = {ext: kind for kind, extensions in EXTENSIONS.items() for ext in extensions}


def extension(path: Column) -> Column:
    """Lower-cased suffix with its dot, or empty."""
    return F.lower(F.regexp_extract(path, r"[^/](\.[^./]+)$", 1))


def processor_type(path: Column) -> Column:
    lookup = F.create_map(*[F.lit(x) for pair in PROCESSORS.items() for x in pair])
    return F.try_element_at(lookup, extension(path))


def scan_audit(files: DataFrame, path: str = "path") -> DataFrame:
    """Status of each file: skipped (not listed by the scan), unprocessable (listed, but no processor takes it) or ok."""
    kind, ext = processor_type(F.col(path)), extension(F.col(path))
    return files.withColumns({"processor": kind, "status": F.when(kind.isNull(), "skipped").when(~ext.isin(*PROCESSABLE), "unprocessable").otherwise("ok")})


def folder_inventory(files: DataFrame, base: str, path: str = "path", max_depth: int = 5) -> DataFrame:
    """Each folder below ``base`` with its own file count, the types of all files below it, and whether any is multimodal. Hidden entries and files at the root are left out."""
    root = base.rstrip("/") + "/"
    parts = F.split(F.substring(F.col(path), len(root) + 1, 1 << 30), "/")
    rows = files.filter(F.col(path).startswith(root)).select(parts.alias("parts"), processor_type(F.col(path)).alias("type")).filter((F.size("parts") > 1) & ~F.exists("parts", lambda p: p.startswith(".")))
    depth = F.size("parts") - 1
    rows = rows.select("type", depth.alias("depth"), F.explode(F.transform(F.sequence(F.lit(1), F.least(depth, F.lit(max_depth))), lambda i: F.struct(i.alias("level"), F.array_join(F.slice("parts", F.lit(1), i), "/").alias("folder")))).alias("f"))
    return rows.groupBy(F.col("f.folder").alias("folder")).agg(F.count_if(F.col("f.level") == F.col("depth")).alias("file_count"), F.array_sort(F.collect_set("type")).alias("types"), F.bool_or(F.coalesce(F.col("type").isin("image", "pdf"), F.lit(False))).alias("has_multimodal"))


def duplicate_keys(df: DataFrame, *keys: str) -> DataFrame:
    """Key values that are not unique."""
    return df.groupBy(*keys).agg(F.count("*").alias("n")).filter("n > 1")


def mark_stored(files: DataFrame, config: str, text: str, order: str) -> DataFrame:
    """action per file: the first of equal content in a config, in order, is stored, the rest skipped. The hot content of a config is found by a partial minimum, then joined."""
    hashed = files.withColumn("content_hash", F.md5(text))
    first = hashed.groupBy(config, "content_hash").agg(F.min(order).alias("first"))
    return hashed.join(first, [config, "content_hash"]).withColumn("action", F.when(F.col(order) == F.col("first"), "store").otherwise("skip")).drop("first")


def new_only(incoming: DataFrame, stored: DataFrame, *keys: str) -> DataFrame:
    return incoming.join(stored.select(*keys).distinct(), list(keys), "left_anti")


#: The public fields of a retrieved chunk, in order.
PUBLIC = ("content", "score", "chunk_id", "document_id", "config_id", "source_type", "file_name", "file_path", "file_type", "chunk_index", "folder_path", "metadata")


def public_record(results: DataFrame) -> DataFrame:
    return results.select(*PUBLIC)


def insert_new(stored: DataFrame, incoming: DataFrame, *keys: str) -> DataFrame:
    """The store with the incoming rows whose key it doesn't have; of those that repeat a key the first by their other columns."""
    rest = [c for c in incoming.columns if c not in keys]
    one = incoming.groupBy(*keys).agg(F.min(F.struct(*rest)).alias("row")).select(*keys, "row.*") if rest else incoming.distinct()
    return stored.unionByName(new_only(one, stored, *keys).select(*stored.columns))


def full_refresh(config: str, files: DataFrame, *children: tuple[DataFrame, str], keep_history: bool = True, history: DataFrame | None = None) -> list[DataFrame]:
    """What stays when a configuration is loaded anew: its files go, so do rows of the tables in ``children`` (table, key to files) and, unless kept, its history."""
    gone = files.filter(F.col("config_id") == config)
    left = [files.filter(~F.col("config_id").eqNullSafe(F.lit(config)))]
    left += [table.join(gone.select(key).distinct(), key, "left_anti") for table, key in children]
    if history is not None:
        left.append(history if keep_history else history.filter(~F.col("config_id").eqNullSafe(F.lit(config))))
    return left


def latest_per(df: DataFrame, key: str, *order: str) -> DataFrame:
    """The newest row of each key, ties to the largest of the later columns."""
    rest = [c for c in df.columns if c != key]
    return df.groupBy(key).agg(F.max_by(F.struct(*rest), F.struct(*order)).alias("row")).select(key, "row.*")


def idempotency_key(config: Column, source_hash: Column) -> Column:
    return F.sha2(F.concat_ws(":", config, source_hash), 256)


def start_decisions(requests: DataFrame, jobs: DataFrame) -> DataFrame:
    """requests: config_id, idem. existing: the newest job of the same key has neither failed nor been cancelled; conflict: any job of the config is open; else created."""
    newest = latest_per(jobs.select("idem", "status", "job_id", "created_at"), "idem", "created_at", "job_id").select("idem", F.col("status").alias("newest_status"), F.col("job_id").alias("newest_job"))
    busy = jobs.filter(F.col("status").isin("pending", "running")).select("config_id").distinct().withColumn("busy", F.lit(True))
    joined = requests.join(newest, "idem", "left").join(busy, "config_id", "left")
    existing = F.col("newest_status").isNotNull() & ~F.col("newest_status").isin("failed", "cancelled")
    return joined.select(*requests.columns, F.when(existing, "existing").when(F.col("busy"), "conflict").otherwise("created").alias("decision"), F.when(existing, F.col("newest_job")).alias("job_id"))


def retry_decisions(requests: DataFrame, jobs: DataFrame) -> DataFrame:
    """failed or cancelled: new; open: existing; none: not_found; else rejected."""
    newest = latest_per(jobs.select("idem", "status", "job_id", "created_at"), "idem", "created_at", "job_id").select("idem", F.col("status").alias("newest"))
    return requests.join(newest, "idem", "left").select(*requests.columns, F.when(F.col("newest").isNull(), "not_found").when(F.col("newest").isin("failed", "cancelled"), "new").when(F.col("newest").isin("pending", "running"), "existing").otherwise("rejected").alias("decision"))


def page(df: DataFrame, skip: int, limit: int, *order: Column) -> DataFrame:
    """Rows skip to skip + limit in a total order."""
    return df.orderBy(*order).offset(skip).limit(limit)


def folder_of(path: Column, base: str) -> Column:
    """Parent folder relative to ``base``: '.' for files in it, the whole parent outside it."""
    parent, root = F.regexp_replace(path, "/[^/]*$", ""), base.rstrip("/")
    return F.when(parent == root, ".").when(parent.startswith(root + "/"), F.substring(parent, len(root) + 2, 1 << 30)).otherwise(parent)
