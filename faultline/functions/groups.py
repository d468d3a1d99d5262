"""Running totals, sessions and first-n lists that stay parallel when one group is huge.

A window over a whole group puts the group into one task. These helpers cut every group into
blocks first: each block is handled by its own task and only one row per block is ordered
across the group.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from faultline.session import cut

BLOCK = 4096


def running(
    df: DataFrame, keys: list[str], block: Column, order: list[str], value: Column, out: str, how: str = "sum"
) -> DataFrame:
    """Inclusive running ``sum`` or ``max`` of ``value`` per ``keys`` in ``order``.

    ``block`` must rise with the order. Rows meet only inside their block; across blocks one row
    each is ordered.
    """
    fold = {"sum": F.sum, "max": F.max}[how]
    tagged = df.withColumn("_block", block).withColumn("_value", value)
    per_block = tagged.groupBy(*keys, "_block").agg(fold("_value").alias("_all"))
    before = Window.partitionBy(*keys).orderBy("_block").rowsBetween(Window.unboundedPreceding, -1)
    carried = per_block.select(*keys, "_block", fold("_all").over(before).alias("_carry"))
    inside = Window.partitionBy(*keys, "_block").orderBy(*order).rowsBetween(Window.unboundedPreceding, 0)
    local = tagged.withColumn("_local", fold("_value").over(inside)).drop("_value")
    both = local.join(carried, [*keys, "_block"])
    total = (
        F.coalesce("_carry", F.lit(0)) + F.col("_local") if how == "sum" else F.greatest("_carry", "_local")
    )
    return both.withColumn(out, total).drop("_block", "_local", "_carry")


def first_n(df: DataFrame, keys: list[str], order: list[Column], n: int, rank: str = "rank") -> DataFrame:
    """First ``n`` rows per group. Spark trims each task to ``n`` rows per group before the shuffle."""
    w = Window.partitionBy(*keys).orderBy(*order)
    return df.withColumn(rank, F.row_number().over(w)).where(F.col(rank) <= n)


#: Keys (a few dozen bytes each) that may be sent to the tasks.
FEW_KEYS = 1 << 16
#: One row in so many bounds the groups in ``first_few``.
BOUNDING = 64


def first_few(df: DataFrame, keys: list[str], order: list[str], n: int, rank: str = "rank") -> DataFrame:
    """``first_n`` in the order of columns, for tables whose groups are far larger than ``n``: no task sorts all its rows.

    The n-th row among some rows of a group stands behind the group's n-th row or is it, so all rows behind it are left out where
    they are read. What is sorted is that many rows per group as bound it times ``n``, however many the group has.
    """
    place = F.struct(*order)
    some = df.where(F.pmod(F.xxhash64(*order), F.lit(BOUNDING)) == 0)
    bound = first_n(some, keys, [F.col(c) for c in order], n, rank="_no").where(F.col("_no") == n)
    bound = cut(bound.select(*[F.col(c).alias(f"_{c}") for c in keys], place.alias("_bound")), "bounds")
    if bound.limit(FEW_KEYS + 1).count() <= FEW_KEYS:
        same = [df[c].eqNullSafe(bound[f"_{c}"]) for c in keys]
        near = df.join(F.broadcast(bound), same, "left").where(F.col("_bound").isNull() | (place <= F.col("_bound")))
        df = near.select(*df.columns)
    return first_n(df, keys, [F.col(c) for c in order], n, rank)


#: Numbers (a few dozen bytes each in a task) that may be sent to the tasks.
FEW_HASHES = 1 << 18


def narrowed(rows: DataFrame, key: str, wanted: DataFrame) -> DataFrame:
    """The rows that may have a key of ``wanted``: all of them that have one and hardly any other, so that what follows moves and
    sorts few rows. If many keys are wanted these are all rows."""
    hashes = cut(wanted.select(F.xxhash64(key).alias("_hash")).distinct(), "wanted")
    if hashes.limit(FEW_HASHES + 1).count() > FEW_HASHES:
        return rows
    return rows.withColumn("_hash", F.xxhash64(key)).join(F.broadcast(hashes), "_hash", "left_semi").drop("_hash")


def ordered_list(rank: str, value: str) -> Column:
    """Aggregate: values as an array in rank order (for groups already cut to n rows)."""
    return F.transform(F.array_sort(F.collect_list(F.struct(rank, value))), lambda s: s[value])


def gap_sessions(df: DataFrame, keys: list[str], ts: str, gap_seconds: int) -> DataFrame:
    """Distinct seconds per group with a session number; a gap above ``gap_seconds`` starts a session."""
    seconds = df.select(*keys, F.col(ts).cast("long").alias("sec")).groupBy(*keys, "sec").agg(F.lit(1).alias("_one"))
    seconds = seconds.drop("_one").withColumn("_h", F.floor(F.col("sec") / 3600))
    w = Window.partitionBy(*keys, "_h").orderBy("sec")
    previous = F.lag("sec").over(w)
    local = seconds.withColumn("_break", F.when(F.col("sec") - previous > gap_seconds, 1).otherwise(0))
    local = local.withColumn("_local", F.sum("_break").over(w.rowsBetween(Window.unboundedPreceding, 0)))
    hours = local.groupBy(*keys, "_h").agg(
        F.min("sec").alias("_lo"), F.max("sec").alias("_hi"), F.sum("_break").alias("_breaks")
    )
    across = Window.partitionBy(*keys).orderBy("_h")
    opens = F.when(F.coalesce(F.col("_lo") - F.lag("_hi").over(across), F.lit(gap_seconds + 1)) > gap_seconds, 1)
    hours = hours.withColumn("_open", opens.otherwise(0))
    inclusive = across.rowsBetween(Window.unboundedPreceding, 0)
    hours = hours.withColumn(
        "_base", F.sum("_open").over(inclusive) + F.sum("_breaks").over(inclusive) - F.col("_breaks")
    )
    return local.join(hours.select(*keys, "_h", "_base"), [*keys, "_h"]).select(
        *keys, "sec", (F.col("_base") + F.col("_local")).alias("session")
    )


GRAM = 3
#: Lengths of longer pieces: three characters of a numbered name occur in a share of all names, so their lists grow with the table.
LONGER = (2 * GRAM, 4 * GRAM)


def grams(text: Column, n: int = GRAM) -> Column:
    """Distinct pieces of one to ``n`` characters, and of twice and four times ``n``, in passes over the characters."""
    chars = F.split(text, "")
    shifted = F.arrays_zip(*[(chars if i == 0 else F.slice(chars, i + 1, F.greatest(F.size(chars), F.lit(1)))).alias(f"c{i}") for i in range(n)])

    def pieces(m: int) -> Column:
        return F.transform(shifted, lambda z: F.concat(*[z[f"c{i}"] for i in range(m)]))

    def doubled(parts: Column, m: int) -> Column:
        # Zipped, as a lambda that refers to the whole array would build it anew for every place.
        both = F.arrays_zip(parts.alias("a"), F.slice(parts, m + 1, F.greatest(F.size(parts), F.lit(1))).alias("b"))
        return F.transform(both, lambda z: F.concat(z["a"], z["b"]))

    every = [pieces(m) for m in range(1, n + 1)]
    for _ in LONGER:
        n, every = 2 * n, [*every, doubled(every[-1], n)]
    return F.array_distinct(F.filter(F.flatten(F.array(*every)), lambda g: g.isNotNull()))


def _looked_up(distinct: DataFrame, wanted: DataFrame) -> DataFrame:
    """(_needle, _text): needles with the texts (_value, _text) of their rarest gram of the greatest length they have."""
    size = F.least(F.length("_needle"), F.lit(GRAM))
    for m in LONGER:
        size = F.when(F.length("_needle") >= m, F.lit(m)).otherwise(size)
    needed = wanted.select("_needle", F.explode(F.filter(grams(F.col("_needle")), lambda g: F.length(g) == size)).alias("_gram"))
    postings = distinct.select("_text", F.explode(grams(F.col("_value"))).alias("_gram"))
    lengths = F.broadcast(needed.select(F.length("_gram").alias("_length")).distinct())  # five at most
    postings = postings.withColumn("_length", F.length("_gram")).join(lengths, "_length", "left_semi").drop("_length")
    postings = cut(postings.join(needed.select("_gram").distinct(), "_gram", "left_semi"), "postings")
    often = postings.groupBy("_gram").agg(F.count(F.lit(1)).alias("_texts"))
    rarest = needed.join(often, "_gram", "left").groupBy("_needle").agg(
        F.min_by("_gram", F.struct("_texts", "_gram")).alias("_gram"), F.bool_and(F.col("_texts").isNotNull()).alias("_all"))
    return rarest.where("_all").join(postings, "_gram").select("_needle", "_text")


def containment_pairs(texts: DataFrame, text_col: str, needles: DataFrame, needle_col: str) -> DataFrame:
    """Distinct texts (all rows of ``texts`` if it has more columns) and needles they contain, by an inverted table of grams.

    Texts are cut into grams once, so a text costs its length whatever the needles are, and only grams that some needle has are
    kept, with a digest in place of the text. Each needle looks up the texts of its rarest gram (none if one of its grams occurs nowhere) and these
    are searched. Nothing reaches the driver.
    """
    wanted = needles.where(F.length(needle_col) > 0).select(F.col(needle_col).alias("_needle")).distinct()
    distinct = cut(texts.select(F.col(text_col).alias("_value")).distinct().withColumn("_text", F.sha2("_value", 256)), "texts")
    found = _looked_up(distinct, wanted)
    met = found.join(distinct, "_text").where(F.contains("_value", "_needle")).select(F.col("_value").alias(text_col), "_needle")
    if texts.columns != [text_col]:
        met = texts.join(met, text_col)
    return met.join(needles, F.col("_needle") == needles[needle_col]).drop("_needle")
