"""Sharding: minimax contiguous partition of atomic groups.

Groups of equal texts are atoms. They stand in the order of their digest, and the ordered sequence is cut into
``shards`` runs so that the largest run is as small as any cutting can make it. The smallest feasible capacity is found
by binary search with a greedy check, on sums of digest ranges instead of single groups: ranges in which a cut may fall
are opened digit by digit until lower and upper bound of the capacity meet. The driver holds a few thousand range sums
at any input size; no row is compared with anything but the cut points, so a text held by a third of all rows is one
sum and costs no join.

Defined results: a null text has size 1 and all null texts are one group; an empty table gives no rows; equal ids are
told apart by their text; rows equal in both get neighbouring slots; other columns are not read.
"""

from __future__ import annotations

from bisect import bisect_right
from itertools import accumulate

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from faultline.llm.common import keep

FIRST_DIGITS, MORE_DIGITS = 3, 2
ID_BLOCK = 4096
NO_ID = -(1 << 62)


class Runs:
    """Ordered items ``(name, size, is_atom)`` and the two greedy checks over them."""

    def __init__(self, items: list[tuple[str, int, bool]]) -> None:
        self.items = sorted(items)
        self.ends = list(accumulate(x[1] for x in self.items))
        self.total = self.ends[-1] if self.ends else 0

    def whole(self, capacity: int, shards: int) -> list[int]:
        """Item index at which each shard ends when no item is opened."""
        out, at = [], 0
        for _ in range(shards):
            base = self.ends[at - 1] if at else 0
            at = bisect_right(self.ends, base + capacity)
            out.append(at)
        return out

    def open(self, capacity: int, shards: int) -> list[int]:
        """Position in bytes at which each shard ends when items that are no atoms can be cut anywhere."""
        out, at = [], 0
        for _ in range(shards):
            at = min(at + capacity, self.total)
            i = bisect_right(self.ends, at)
            if i < len(self.items) and self.items[i][2]:
                at = self.ends[i - 1] if i else 0
            out.append(at)
        return out


def smallest(lo: int, hi: int, fits) -> int:
    """Smallest value in [lo, hi] that fits; ``hi`` does."""
    while lo < hi:
        mid = (lo + hi) // 2
        lo, hi = (lo, mid) if fits(mid) else (mid + 1, hi)
    return lo


def range_sums(groups: DataFrame, digits: int, within: list[str] | None = None) -> list[tuple[str, int, bool]]:
    name = F.substring("digest", 1, digits)
    if within is not None:
        groups = groups.where(F.substring("digest", 1, digits - MORE_DIGITS).isin(within))
    sums = groups.groupBy(name.alias("name")).agg(F.sum("size").alias("size"), F.count(F.lit(1)).alias("n"))
    return [(r["name"], r["size"], r["n"] == 1) for r in sums.collect()]


def minimax_cuts(groups: DataFrame, shards: int) -> tuple[list[str], int]:
    """Digests at which the 2nd, 3rd, ... shard begins, and the capacity. ``groups``: digest (hex), size > 0."""
    largest = groups.agg(F.max("size")).first()[0]
    if largest is None:
        return [], 0
    digits = FIRST_DIGITS
    runs = Runs(range_sums(groups, digits))
    while True:
        low = max(largest, -(-runs.total // shards))
        low = smallest(low, runs.total, lambda c: runs.open(c, shards)[-1] == runs.total)
        high = smallest(low, runs.total, lambda c: runs.whole(c, shards)[-1] == len(runs.items))
        if low == high:
            ends = runs.whole(high, shards)[:-1]
            return [runs.items[i][0] for i in ends if i < len(runs.items)], high
        opened = set()
        for first, last in zip(runs.whole(low, shards), runs.open(high, shards), strict=True):
            for i in range(first, len(runs.items)):
                if not runs.items[i][2]:
                    opened.add(runs.items[i][0])
                if runs.ends[i] >= last:
                    break
        digits += MORE_DIGITS
        finer = range_sums(groups, digits, sorted(opened))
        runs = Runs([x for x in runs.items if x[0] not in opened] + finer)


def measured(docs: DataFrame, id_col: str, text_col: str) -> DataFrame:
    text = F.col(text_col)
    return docs.select(
        F.col(id_col).alias("doc_id"),
        F.coalesce(F.sha2(text, 256), F.lit("")).alias("digest"),
        (F.coalesce(F.octet_length(text), F.lit(0)) + 1).cast("long").alias("size"),
        F.crc32(text).alias("text_crc32"),
    )


def slots(rows: DataFrame, within: str, order: list[Column]) -> DataFrame:
    """Gapless numbers from 0 per shard, counted in blocks of ids so that no task orders a whole shard."""
    blocks = rows.withColumn("_block", F.coalesce(F.floor(F.col("doc_id") / ID_BLOCK), F.lit(NO_ID)))
    before = Window.partitionBy(within).orderBy("_block").rowsBetween(Window.unboundedPreceding, -1)
    counts = blocks.groupBy(within, "_block").agg(F.count(F.lit(1)).alias("_n"))
    offsets = counts.select(within, "_block", F.coalesce(F.sum("_n").over(before), F.lit(0)).alias("_offset"))
    inside = F.row_number().over(Window.partitionBy(within, "_block").orderBy(*order))
    numbered = blocks.withColumn("_place", inside)
    return numbered.join(offsets, [within, "_block"]).withColumn(
        "slot", (F.col("_offset") + F.col("_place") - 1).cast("long")
    ).drop("_block", "_offset", "_place")


def shard_documents(docs: DataFrame, shards: int = 8, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id, digest, size, text_crc32, shard, slot for every row; equal texts share a shard."""
    rows = keep(measured(docs, id_col, text_col), "shard-sizes")
    cuts, _ = minimax_cuts(rows.groupBy("digest").agg(F.sum("size").alias("size")), shards)
    shard = sum((F.when(F.col("digest") >= c, 1).otherwise(0) for c in cuts), F.lit(0))
    return slots(rows.withColumn("shard", shard.cast("int")), "shard", [F.col("doc_id"), F.col("digest")])
