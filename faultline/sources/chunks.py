"""Chunk tables: line windows, ids, upsert, deletion, repository metadata."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from faultline.functions import text as T
from faultline.functions import vocab as V

STORED_TEXT = 500


def window_structs(lines: Column, size: int, step: int) -> Column:
    """array<struct<offset, last, text>> of the overlapping windows of a line array."""
    n = F.size(lines)
    starts = F.when(n > 0, F.sequence(F.lit(0), n - 1, F.lit(step))).otherwise(F.array().cast("array<int>"))
    return F.transform(starts, lambda i: F.struct(
        i.alias("offset"), F.least(i + size, n).alias("last"),
        F.array_join(F.slice(lines, i + 1, F.lit(size)), "\n").alias("text")))


def line_windows(files: DataFrame, size: int = V.WINDOW_LINES, step: int = V.WINDOW_STEP) -> DataFrame:
    """(namespace, source_file, text) to windows of at least 60 trimmed characters; no shuffle."""
    w = files.select("namespace", "source_file", F.explode(window_structs(T.lines_of(F.col("text")), size, step)).alias("w"))
    w = w.select("namespace", "source_file", (F.col("w.offset") + 1).cast("bigint").alias("line_start"),
                 F.col("w.last").cast("bigint").alias("line_end"), F.col("w.text").alias("text"))
    return w.where(F.length(T.strip(F.col("text"))) >= V.MIN_CHUNK_CHARS)


def chunk_id() -> Column:
    return F.sha2(F.concat_ws(":", "namespace", "source_file", F.col("line_start").cast("string"),
                              F.col("line_end").cast("string")), 256)


def with_ids(chunks: DataFrame) -> DataFrame:
    return chunks.withColumn("chunk_id", chunk_id())


def upsert_chunks(old: DataFrame, new: DataFrame) -> DataFrame:
    """One row per chunk id, the newest ``load_ts`` winning; both sides carry the same columns.

    ``max_by`` combines on the map side, so a chunk re-loaded many times is not gathered first. Docstrings and imports
    (a text, or lines joined by newlines) are cut to 500 characters.
    """
    rows = old.unionByName(new)
    columns = [c for c in rows.columns if c not in ("namespace", "chunk_id")]
    latest = rows.groupBy("namespace", "chunk_id").agg(F.max_by(F.struct(*columns), "load_ts").alias("row"))
    out = latest.select("namespace", "chunk_id", "row.*")
    if "docstring" in columns:
        out = out.withColumn("docstring", F.substring("docstring", 1, STORED_TEXT))
    if "imports" in columns:
        lines = dict(rows.dtypes)["imports"] == "array<string>"
        text = F.substring(F.array_join("imports", "\n") if lines else F.col("imports"), 1, STORED_TEXT)
        out = out.withColumn("imports", F.when(F.size("imports") == 0, F.col("imports")).otherwise(F.split(text, "\n")) if lines else text)
    return out


def write_namespaces(chunks: DataFrame, path: str) -> None:
    """Replace the namespaces present in ``chunks``; other namespaces stay untouched."""
    chunks.write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy("namespace").parquet(path)


def delete_namespace(chunks: DataFrame, namespace: str) -> DataFrame:
    return chunks.where(F.col("namespace") != namespace)


def repo_metadata(repos: DataFrame) -> DataFrame:
    """(repo_id, url, branch, commit…) to one metadata map per repository."""
    owner, name = T.repo_owner_name(F.col("url"))
    branch = F.when(F.col("branch") == "HEAD", "default").otherwise(F.col("branch"))
    entries = F.map_from_arrays(
        F.array(*[F.lit(k) for k in ("repo_owner", "repo_name", "branch", "commit_hash", "commit_message", "commit_author")]),
        F.array(owner, name, branch, F.substring("commit_sha", 1, 12),
                F.substring(T.strip(F.col("commit_message")), 1, 200), F.col("author")))
    return repos.select("repo_id", F.map_filter(entries, lambda k, v: v.isNotNull() & (v != "")).alias("repo"))


def attach_repo(chunks: DataFrame, repos: DataFrame) -> DataFrame:
    """Add the repository's entries to each chunk's metadata map (repository entries win)."""
    joined = chunks.join(repo_metadata(repos), "repo_id", "left")
    none = F.map_from_arrays(F.array().cast("array<string>"), F.array().cast("array<string>"))
    mine, theirs = F.coalesce("metadata", none), F.coalesce("repo", none)
    kept = F.map_filter(mine, lambda k, v: ~F.map_contains_key(theirs, k))
    return joined.withColumn("metadata", F.map_concat(kept, theirs)).drop("repo")
