"""Connected components of a link table, by alternating star contractions."""

from __future__ import annotations

from pyspark.sql import DataFrame, Observation
from pyspark.sql import functions as F

from faultline.llm.common import keep


#: Links (two numbers each) that one task may work on; more are shuffled.
FEW = 1 << 16


def _toward_smallest(links: DataFrame, include_self: bool, few: bool) -> DataFrame:
    """(a, b, m): every link with the smallest neighbour of ``a``; aggregated before it is joined, so hubs stay cheap."""
    smallest = links.groupBy("a").agg(F.min("b").alias("m"))
    if include_self:
        smallest = smallest.withColumn("m", F.least("a", "m"))
    return links.join(smallest.hint("merge") if few else smallest, "a")


def _alone(rows: DataFrame, few: bool) -> DataFrame:
    return rows.coalesce(1) if few else rows


def _both(rows: DataFrame, *pairs: tuple[str, str]) -> DataFrame:
    """(a, b): a row for each of the pairs of columns; unlike a union this reads the rows once and keeps their partitions."""
    return rows.select(F.explode(F.array(*[F.struct(F.col(x).alias("a"), F.col(y).alias("b")) for x, y in pairs])).alias("_e")).select("_e.*")


def _kept(edges: DataFrame) -> tuple[DataFrame, tuple]:
    """The kept edges and their number and sum of hashes, which the job that writes them counts along."""
    seen = Observation()
    total = F.sum(F.xxhash64("a", "b").cast("decimal(38,0)"))
    out = keep(edges.observe(seen, F.count(F.lit(1)).alias("edges"), total.alias("total")), "links")
    return out, (seen.get["edges"], seen.get["total"])


def components(links: DataFrame, a: str = "a", b: str = "b") -> DataFrame:
    """node, root: each linked node with the smallest node it can reach. Links that already are stars cost one round. A round over few
    links is one task without shuffles, as each shuffle costs the driver as many tasks as there are partitions."""
    edges, before = _kept(links.select(F.greatest(a, b).alias("a"), F.least(a, b).alias("b")).where("a > b").distinct())
    while True:
        few = before[0] <= FEW
        rows = _both(_alone(edges, few), ("a", "b"), ("b", "a"))
        large = _toward_smallest(rows, True, few).where("b > a").select(F.col("b").alias("a"), F.col("m").alias("b"))
        large = _alone(large.where("a > b").distinct(), few)
        small = _both(_alone(_toward_smallest(large, False, few), few), ("a", "m"), ("b", "m"))
        edges, now = _kept(small.where("a > b").distinct())
        if now == before:
            break
        before = now
    return _both(_alone(edges, before[0] <= FEW), ("a", "b"), ("b", "b")).distinct().select(F.col("a").alias("node"), F.col("b").alias("root"))
