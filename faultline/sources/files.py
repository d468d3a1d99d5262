"""Project files: scan, filters, decoding, routing."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from faultline.functions import text as T
from faultline.functions import vocab as V


def scan_project(spark: SparkSession, root: str, namespace: str) -> DataFrame:
    """Every file below ``root``. ``content`` is only read by queries that use it."""
    prefix = F.regexp_replace(F.lit(root.rstrip("/") + "/"), r"^[a-z0-9]+:/*(?=/)", "")
    full = F.regexp_replace("path", r"^[a-z0-9]+:/*(?=/)", "")
    files = spark.read.format("binaryFile").option("recursiveFileLookup", "true").load(root)
    relative = F.when(full.startswith(prefix), F.expr("substring(_full, length(_prefix) + 1)")).otherwise(full)
    return files.withColumn("_full", full).withColumn("_prefix", prefix).select(
        F.lit(namespace).alias("namespace"), relative.alias("path"), "length",
        F.col("modificationTime").alias("last_modified"), "content")


def listed(path: Column, length: Column) -> Column:
    """Rule of the dry-run list: folder, extension and size checks only."""
    folders = F.slice(F.split(path, "/"), F.lit(1), F.size(F.split(path, "/")) - 1)
    pruned = F.exists(folders, lambda d: d.startswith(".") | d.isin(V.SKIP_DIRS))
    ext = T.extension(path)
    readable = ext.isin(V.TEXT_EXTENSIONS)
    for suffix in V.TEXT_SUFFIXES:
        readable = readable | F.lower(path).endswith(suffix)
    return ~pruned & ~ext.isin(V.SKIP_EXTENSIONS) & readable & (length <= V.MAX_FILE_BYTES)


def indexable(path: Column, length: Column) -> Column:
    """Rule of indexing: the list rule without lock files, system files and bundles."""
    name = T.basename(path)
    bundle = F.lit(False)
    for suffix in V.SKIP_SUFFIXES:
        bundle = bundle | F.lower(name).endswith(suffix)
    return listed(path, length) & ~name.isin(V.SKIP_FILENAMES) & ~bundle


def filter_paths(files: DataFrame) -> DataFrame:
    return files.where(indexable(F.col("path"), F.col("length")))


def list_indexed(files: DataFrame) -> DataFrame:
    return files.where(listed(F.col("path"), F.col("length"))).select("namespace", "path").distinct()


def decode(content: Column) -> Column:
    """Strict UTF-8, else Latin-1."""
    return F.when(F.is_valid_utf8(content.cast("string")), F.decode(content, "UTF-8")).otherwise(
        F.decode(content, "ISO-8859-1"))


def decode_text(files: DataFrame) -> DataFrame:
    """(namespace, path, content) to (namespace, source_file, text); blank files drop out."""
    out = files.select("namespace", F.col("path").alias("source_file"), decode(F.col("content")).alias("text"))
    return out.where(T.strip(F.col("text")) != "")


def is_log_file(path: Column) -> Column:
    return T.extension(path).isin(V.LOG_EXTENSIONS)
