"""Role-based access as relational filters. Roles: role, folders (array; '*' opens all)."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def allowed_folders(users: DataFrame, roles: DataFrame, default: str = "user", enabled: bool = True) -> DataFrame:
    """Folders per user row: of its role, else of the default role, else none; all where access control is off."""
    fallback = roles.filter(F.col("role") == default).select(F.col("folders").alias("other"))
    joined = users.join(roles, "role", "left").join(F.broadcast(fallback), F.lit(True), "left")
    folders = F.coalesce("folders", "other", F.array().cast("array<string>")) if enabled else F.array(F.lit("*"))
    return joined.select(*users.columns, folders.alias("folders"))


def _open(folders: Column) -> Column:
    return F.array_contains(folders, "*")


def before_retrieval(folder: Column, folders: Column) -> Column:
    """As a filter of the scan: rows without a folder are left out, unless all is open."""
    return _open(folders) | F.coalesce(F.array_contains(folders, folder), F.lit(False))


def after_retrieval(folder: Column, folders: Column) -> Column:
    """Over results: rows without a folder pass."""
    return _open(folders) | folder.isNull() | (folder == "") | F.coalesce(F.array_contains(folders, folder), F.lit(False))


def visible(docs: DataFrame, roles: DataFrame, blank_passes: bool = False) -> DataFrame:
    """The rows of docs (with ``folder``) that each role sees, as role and the columns of docs: one equi-join on keys, a row's folder and one for all, so that many roles and folders are no product. ``blank_passes``: rows without a folder are for every role, as over results; else for those that see all only, as before a search."""
    every, blank = "*", "\0"
    keys = F.when(_open(F.col("folders")), F.array(F.lit(every))).otherwise(F.array_union(F.array_distinct(F.filter("folders", lambda x: x.isNotNull() & (x != ""))), F.array(F.lit(blank))))
    asked = roles.select("role", F.explode(keys).alias("__key"))
    none = F.col("folder").isNull() | (F.col("folder") == "")
    own = F.when(none, F.array(F.lit(every), F.lit(blank)) if blank_passes else F.array(F.lit(every))).otherwise(F.array_distinct(F.array(F.lit(every), F.col("folder"))))
    return docs.withColumn("__key", F.explode(own)).join(asked, "__key").drop("__key")


def tags_overlap(tags: Column, wanted: Column) -> Column:
    """No wanted tags, or none on the row: passes; else any in common."""
    return (F.size(wanted) == 0) | (F.size(F.coalesce(tags, F.array().cast("array<string>"))) == 0) | F.coalesce(F.arrays_overlap(tags, wanted), F.lit(False))


def access_matrix(roles: DataFrame, folder_counts: DataFrame) -> DataFrame:
    """Documents each role can reach. Rows are folders with their counts, not documents, so the product with the roles stays small."""
    return roles.join(folder_counts, after_retrieval(F.col("folder"), F.col("folders")), "left").groupBy("role").agg(F.coalesce(F.sum("n"), F.lit(0)).alias("documents"))
