"""A chunk table with versions: staged loads, change detection, one small file as commit.

``data/load=<id>/namespace=<name>`` holds the rows of a load, ``commits/<id>`` one row per namespace that the load replaces or
ends. A load is written first and counts only from the moment its commit is there: that is one file, put in place by the
writer's own commit, so a run that dies in between leaves the table as it was, and the same path can be read and
written in one job. The rows of a namespace are those of its last committed load; which folders these are is a join on
partition columns, so older loads are not read. One writer at a time.
"""

from __future__ import annotations

import uuid

from pyspark.errors import AnalysisException
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StringType, StructField, StructType

from faultline.session import cut
from faultline.sources.chunks import upsert_chunks

NS, ID = "namespace", "chunk_id"
_COMMIT = "version bigint, load string, namespace string, live boolean"


class ChunkTable:
    def __init__(self, spark: SparkSession, path: str) -> None:
        self.spark, self.path = spark, path.rstrip("/")

    def commits(self) -> DataFrame:
        """(version, load, namespace, live) of all committed loads."""
        try:
            return self.spark.read.schema(_COMMIT).option("recursiveFileLookup", "true").json(f"{self.path}/commits")
        except AnalysisException as missing:
            if missing.getCondition() != "PATH_NOT_FOUND":
                raise
            return self.spark.createDataFrame([], _COMMIT)

    def current(self) -> DataFrame:
        """(namespace, load, version) of the load that holds each namespace now."""
        last = self.commits().groupBy(NS).agg(F.max_by(F.struct("load", "version", "live"), "version").alias("c"))
        return last.where("c.live").select(NS, "c.load", "c.version")

    def read(self) -> DataFrame | None:
        """The rows of all namespaces as of now; None before the first load."""
        now = self.current()
        if now.isEmpty():
            return None
        found = self.spark.read.option("mergeSchema", "true").parquet(f"{self.path}/data").schema
        typed = StructType([StructField(f.name, StringType()) if f.name in (NS, "load") else f for f in found])
        rows = self.spark.read.schema(typed).parquet(f"{self.path}/data")  # names of namespaces that look like numbers stay text
        return rows.join(now.drop("version"), [NS, "load"], "left_semi").drop("load")

    def _stage(self, rows: DataFrame) -> str:
        """Write the rows of a load that does not count yet."""
        load = uuid.uuid4().hex
        rows.write.partitionBy(NS).parquet(f"{self.path}/data/load=n{load}")
        return f"n{load}"

    def _commit(self, load: str, namespaces: DataFrame, live: bool) -> None:
        version = (self.commits().agg(F.max("version")).first()[0] or 0) + 1
        rows = namespaces.select(F.lit(version).cast("bigint").alias("version"), F.lit(load).alias("load"), NS, F.lit(live).alias("live"))
        rows.coalesce(1).write.json(f"{self.path}/commits/{version:012d}-{load}")

    def upsert(self, chunks: DataFrame) -> DataFrame:
        """Add or replace chunks by id; (namespace, added, changed, unchanged). Only namespaces with a change are written."""
        new = cut(upsert_chunks(chunks, chunks.limit(0)), "load")
        old = self.read()
        if old is None:
            old = new.limit(0)
        was = old.select(NS, ID, content_digest(old).alias("_was"))
        seen = new.select(NS, ID, content_digest(new).alias("_is")).join(was, [NS, ID], "left")
        report = cut(seen.groupBy(NS).agg(
            F.count_if(F.col("_was").isNull()).alias("added"), F.count_if(F.col("_was") != F.col("_is")).alias("changed"),
            F.count_if(F.col("_was") == F.col("_is")).alias("unchanged")), "report")
        touched = report.where("added + changed > 0").select(NS)
        if not touched.isEmpty():
            here = touched.select(NS)
            merged = upsert_chunks(old.join(here, NS, "left_semi").unionByName(new.limit(0), allowMissingColumns=True),
                                   new.join(here, NS, "left_semi").unionByName(old.limit(0), allowMissingColumns=True))
            self._commit(self._stage(merged), touched, True)
        return report

    def delete(self, namespace: str) -> None:
        """End a namespace; its rows stay in older loads only."""
        held = self.current().where(F.col(NS) == namespace).select(NS)
        if not held.isEmpty():
            self._commit("none", cut(held, "ended"), False)


def content_digest(rows: DataFrame) -> Column:
    """Digest of what a chunk holds, whatever the order of columns and whenever it was loaded."""
    names = sorted(c for c in rows.columns if c not in (NS, ID, "load_ts") and rows.schema[c].dataType.typeName() != "void")
    return F.sha2(F.to_json(F.struct(*names)), 256)
