"""Mixing sources to target weights with a multivariate-hypergeometric splitting tree.

Targets: sources in code point order (null last) weigh 5, 2, 1, 5, ... and share ``share`` of all words; a target stops
at ``most`` times its source's words and the excess is shared again by weight.

Drawing: a seeded hash deals the documents of a source into blocks of about ``BLOCK_DOCS``; since the hash is random,
block numbers are a random permutation. A source's quota is a run of these blocks, passes over the source
following each other, and ends inside one block in which documents are taken in hash order as long as they fit. So a
source differs from its target by less than the smallest document left in that block.

Splitting: the quotas of all sources, in blocks, are divided among the output shards by a binary tree. Each node
draws how many blocks of each source go left, jointly hypergeometric: blocks are numbered through all sources, and the
count drawn among the first x numbers comes from halving the numbers again and again with a univariate draw per half.
Every (node, source) row finds its draw by itself, so nothing is gathered. A shard then owns a run of each source's
blocks, disjoint from all other shards' runs, and its rows carry a random key for the local shuffle.

Defined results: a null or blank text has size 0 and takes no words; an empty table gives no rows; rows with equal ids
are measured one by one and drawn alike; other columns are not read. All draws hash ids and the seed: reruns agree.
"""

from __future__ import annotations

import math
from collections.abc import Callable

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from faultline.functions.groups import running
from faultline.llm.common import WORD, keep, spread_seed

WEIGHTS = (5, 2, 1)
BLOCK_DOCS = 64
SUPER_BLOCK = 4096


def measured(docs: DataFrame, id_col: str, text_col: str, source_col: str) -> DataFrame:
    return docs.select(
        F.col(id_col).alias("doc_id"), F.col(source_col).cast("string").alias("source"),
        F.coalesce(F.regexp_count(F.col(text_col), F.lit(WORD)), F.lit(0)).cast("long").alias("size"),
    )


def targets(rows: DataFrame, share: float = 1.5, most: float = 2.0, weights: tuple[int, ...] = WEIGHTS) -> DataFrame:
    """source, rank, source_size, n_docs, target: one row per source."""
    per = rows.groupBy("source").agg(F.sum("size").alias("source_size"), F.count(F.lit(1)).alias("n_docs"))
    by_name = Window.orderBy(F.col("source").isNull(), F.col("source"))
    per = per.withColumn("rank", F.row_number().over(by_name).cast("long"))
    weight = F.array(*[F.lit(float(w)) for w in weights])[((F.col("rank") - 1) % len(weights)).cast("int")]
    per = per.withColumn("weight", weight).withColumn("cap", most * F.col("source_size"))
    # A source is full once the common level reaches cap / weight; the first one that is not full sets the level.
    by_level = Window.orderBy(F.col("cap") / F.col("weight"), "rank")
    whole = Window.partitionBy()
    budget = share * F.sum("source_size").over(whole)
    full = F.coalesce(F.sum("cap").over(by_level.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0.0))
    open_weight = F.sum("weight").over(by_level.rowsBetween(0, Window.unboundedFollowing))
    per = per.withColumn("_level", (budget - full) / open_weight)
    fits = F.col("_level") <= F.col("cap") / F.col("weight")
    level = F.first(F.when(fits, F.col("_level")), ignorenulls=True).over(
        by_level.rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing))
    target = F.coalesce(F.least(F.col("cap"), F.col("weight") * level), F.col("cap"))
    return per.withColumn("target", target).drop("_level", "weight", "cap")


def let(value: Column, body: Callable[[Column], Column]) -> Column:
    """``body`` of a value that is written once in the expression, however often it is used."""
    return F.transform(F.array(value), body)[0]


def log_factorial(n: Column) -> Column:
    def far(x: Column) -> Column:
        return x * F.log(x) - x + 0.5 * F.log(2 * math.pi * x) + 1 / (12 * x) - 1 / (360 * x * x * x)

    return F.when(n <= 20, F.log(F.factorial(n.cast("int")).cast("double"))).otherwise(let(n.cast("double"), far))


def hypergeometric(total: Column, marked: Column, drawn: Column, u: Column) -> Column:
    """How many of ``marked`` are among ``drawn`` of ``total``, by inverting the distribution at ``u`` in [0, 1).

    Walks ten deviations to both sides of the mode; what lies beyond has less weight than a double resolves.
    """
    def logp(c: Column, x: Column) -> Column:
        rest = c["n"] - c["k"] - c["d"] + x
        return -(log_factorial(x) + log_factorial(c["k"] - x) + log_factorial(c["d"] - x) + log_factorial(rest))

    def spread(c: Column) -> Column:
        share = c["k"] / F.greatest(c["n"], F.lit(1))
        variance = c["d"] * share * (1 - share) * (c["n"] - c["d"]) / F.greatest(c["n"] - 1, F.lit(1))
        return F.struct(
            c["n"].alias("n"), c["k"].alias("k"), c["d"].alias("d"), c["lo"].alias("lo"), c["hi"].alias("hi"),
            F.greatest(c["lo"], F.least(c["hi"], F.floor((c["d"] + 1) * ((c["k"] + 1) / (c["n"] + 2))))).alias("mode"),
            (F.ceil(10 * F.sqrt(variance)) + 10).alias("reach"))

    def weigh(c: Column) -> Column:
        values = F.sequence(F.greatest(c["lo"], c["mode"] - c["reach"]), F.least(c["hi"], c["mode"] + c["reach"]))
        return let(logp(c, c["mode"]), lambda top: F.transform(
            values, lambda x: F.struct(x.alias("x"), F.exp(logp(c, x) - top).alias("p"))))

    def pick(weighed: Column) -> Column:
        goal = u * F.aggregate(weighed, F.lit(0.0), lambda a, v: a + v["p"])
        start = F.struct(goal.alias("left"), F.lit(None).cast("long").alias("x"))
        return F.aggregate(weighed, start, lambda a, v: F.struct(
            (a["left"] - v["p"]).alias("left"), F.when(a["left"] >= 0, v["x"]).otherwise(a["x"]).alias("x")))["x"]

    case = F.struct(
        total.alias("n"), marked.alias("k"), drawn.alias("d"),
        F.greatest(F.lit(0).cast("long"), drawn + marked - total).alias("lo"), F.least(marked, drawn).alias("hi"))
    return let(case, lambda c: F.when(c["lo"] == c["hi"], c["lo"]).otherwise(
        let(let(spread(c), weigh), pick)))


def uniform(key: Column) -> Column:
    return F.shiftrightunsigned(F.xxhash64(key), 11).cast("double") / float(1 << 53)


def drawn_before(x: Column, total: Column, drawn: Column, key: Column) -> Column:
    """How many of ``drawn`` of the numbers 0 .. total-1 are below ``x``; equal for equal key, whatever x is asked."""
    steps = F.sequence(F.lit(1), F.ceil(F.log2(F.greatest(total, F.lit(1)).cast("double"))).cast("int") + 1)
    start = F.struct(
        x.alias("x"), total.alias("n"), drawn.alias("d"), F.lit(0).cast("long").alias("sum"), key.alias("key"),
    )

    def halve(a: Column, _: Column) -> Column:
        half = F.floor(a["n"] / 2).cast("long")
        draw = hypergeometric(a["n"], half, a["d"], uniform(a["key"]))

        def step(g: Column) -> Column:
            low = a["x"] < half
            return F.struct(
                F.when(low, a["x"]).otherwise(a["x"] - half).alias("x"), F.when(low, half).otherwise(a["n"] - half).alias("n"),
                F.when(low, g).otherwise(a["d"] - g).alias("d"), F.when(low, a["sum"]).otherwise(a["sum"] + g).alias("sum"),
                F.xxhash64(a["key"], low).alias("key"))

        return F.when((a["x"] > 0) & (a["x"] < a["n"]), let(draw, step)).otherwise(a)

    return let(F.aggregate(steps, start, halve),
               lambda end: end["sum"] + F.when(end["x"] >= end["n"], end["d"]).otherwise(F.lit(0)))


def split_quotas(quotas: DataFrame, shards: int, seed: int) -> DataFrame:
    """rank, shard, first, n: the run of each source's blocks that each shard owns. ``quotas``: rank, n (blocks)."""
    nodes = quotas.select(
        "rank", F.lit(0).alias("node"), F.lit(shards).alias("leaves"), F.lit(0).alias("shard"),
        F.lit(0).cast("long").alias("first"), F.col("n").cast("long").alias("n"))
    for _ in range(max(0, math.ceil(math.log2(shards)))):
        by_source = Window.partitionBy("node").orderBy("rank")
        left = F.floor((F.col("leaves") + 1) / 2).cast("int")
        nodes = nodes.withColumn("_end", F.sum("n").over(by_source)).withColumn(
            "_all", F.sum("n").over(Window.partitionBy("node"))).withColumn("_left", left)
        drawn = F.round(F.col("_all") * F.col("_left") / F.col("leaves")).cast("long")
        count = drawn_before(F.col("_end"), F.col("_all"), drawn, spread_seed("node", "leaves", seed=seed))
        nodes = keep(nodes.withColumn("_count", count), "mix-draws")
        nodes = nodes.withColumn("_x", F.col("_count") - F.coalesce(F.lag("_count").over(by_source), F.lit(0)))
        x = F.when(F.col("leaves") == 1, F.col("n")).otherwise(F.col("_x"))
        sides = F.array(
            F.struct((2 * F.col("node")).alias("node"), F.col("_left").alias("leaves"), F.col("shard").alias("shard"),
                     F.col("first").alias("first"), x.alias("n")),
            F.struct((2 * F.col("node") + 1).alias("node"), (F.col("leaves") - F.col("_left")).alias("leaves"),
                     (F.col("shard") + F.col("_left")).alias("shard"), (F.col("first") + x).alias("first"),
                     (F.col("n") - x).alias("n")))
        nodes = keep(nodes.select("rank", F.explode(sides).alias("_s")).select("rank", "_s.*")
                     .where(F.col("leaves") > 0), "mix-tree")
    return nodes.select("rank", "shard", "first", "n")


def fitting(docs: Column, room: Column) -> Column:
    """Documents of one block in the given (random) order up to the first that exceeds ``room``, then what still fits
    of the others, longest first."""
    none = F.filter(docs, lambda d: F.lit(False))

    def take(a: Column, d: Column, stop: Column) -> Column:
        fits = ~stop & (d["size"] <= a["room"])
        return F.struct(
            F.when(fits, a["room"] - d["size"]).otherwise(a["room"]).alias("room"),
            F.when(fits, F.concat(a["ids"], F.array(d))).otherwise(a["ids"]).alias("ids"),
            F.when(fits, a["left"]).otherwise(F.concat(a["left"], F.array(d))).alias("left"))

    start = F.struct(room.cast("long").alias("room"), none.alias("ids"), none.alias("left"))
    first = F.aggregate(docs, start, lambda a, d: take(a, d, F.size(a["left"]) > 0))
    longest = lambda x, y: F.when(x["size"] > y["size"], -1).when(x["size"] < y["size"], 1).when(
        x["order"] < y["order"], -1).when(x["order"] > y["order"], 1).otherwise(0)
    return let(first, lambda f: F.aggregate(
        F.array_sort(f["left"], longest), F.struct(f["room"].alias("room"), f["ids"].alias("ids"), none.alias("left")),
        lambda a, d: take(a, d, F.lit(False)))["ids"])


def mix(docs: DataFrame, shards: int = 8, seed: int = 7, share: float = 1.5, most: float = 2.0,
        weights: tuple[int, ...] = WEIGHTS, id_col: str = "doc_id", text_col: str = "text",
        source_col: str = "source") -> DataFrame:
    """One row per input row: doc_id, source, size, source_size, target, copies, taken, shards (one per copy)."""
    rows = keep(measured(docs, id_col, text_col, source_col), "mix-sizes")
    goals = keep(targets(rows, share, most, weights).withColumn(
        "blocks", F.ceil(F.col("n_docs") / BLOCK_DOCS).cast("long")
    ).withColumn(
        "passes", F.when(F.col("source_size") > 0, F.floor(F.col("target") / F.col("source_size"))).otherwise(0)
        .cast("long")
    ).withColumn("rest", F.col("target") - F.col("passes") * F.col("source_size")), "mix-targets")

    goals = goals.withColumnRenamed("source", "_source")
    tossed = rows.join(goals, F.col("source").eqNullSafe(F.col("_source")))
    tossed = tossed.withColumn("toss", spread_seed("doc_id", seed=seed)).withColumn("block", F.pmod("toss", "blocks"))
    per_block = tossed.groupBy("rank", "block").agg(F.sum("size").alias("words"), F.first("rest").alias("rest"))
    filled = running(per_block, ["rank"], F.floor(F.col("block") / SUPER_BLOCK), ["block"], F.col("words"), "filled")
    over = F.col("filled") > F.col("rest")
    # Blocks up to ``full`` are taken whole; the quota runs out in block ``last`` after ``room`` words of it.
    ends = keep(filled.where(F.col("rest") > 0).groupBy("rank").agg(
        F.max(F.when(~over, F.col("block"))).alias("full"), F.min(F.when(over, F.col("block"))).alias("last"),
        F.min_by(F.col("rest") - F.col("filled") + F.col("words"), F.when(over, F.col("block"))).alias("room")),
        "mix-ends")
    marked = tossed.join(ends, "rank", "left")
    in_last = marked.where(F.col("block") == F.col("last"))
    listed = in_last.groupBy("rank").agg(
        F.array_sort(F.collect_list(F.struct(F.xxhash64("toss").alias("order"), "doc_id", "size"))).alias("docs"),
        F.first("room").alias("room"))
    picks = listed.select("rank", F.explode(fitting(F.col("docs"), F.col("room"))).alias("_p"))
    # Rows with one id share size and hash, so an id counts as often as it was picked: rows of it are numbered.
    picked = picks.select("rank", "_p.doc_id", "_p.size").groupBy("rank", "doc_id", "size").agg(
        F.count(F.lit(1)).alias("picks"))

    nth = F.row_number().over(Window.partitionBy("rank", "doc_id", "size").orderBy("toss"))
    same = (F.col("rank") == F.col("p_rank")) & F.col("doc_id").eqNullSafe(F.col("p_id")) & (
        F.col("size") == F.col("p_size"))
    in_last = in_last.withColumn("nth", nth).join(
        picked.select(F.col("rank").alias("p_rank"), F.col("doc_id").alias("p_id"), F.col("size").alias("p_size"),
                      "picks"), same, "left")
    columns = ["doc_id", "source", "size", "source_size", "target", "rank", "blocks", "passes", "block", "toss"]
    in_last = in_last.select(*columns, (F.coalesce("picks", F.lit(0)) >= F.col("nth")).cast("long").alias("extra"))
    whole = marked.where(F.coalesce(F.col("block") != F.col("last"), F.lit(True)))
    before = F.coalesce(F.col("block") <= F.col("full"), F.lit(False))
    whole = whole.select(*columns, before.cast("long").alias("extra"))
    drawn = whole.unionByName(in_last).withColumn("copies", F.col("passes") + F.col("extra"))

    top = drawn.groupBy("rank").agg(
        F.max("passes").alias("passes"), F.max("blocks").alias("blocks"),
        F.max(F.when(F.col("extra") > 0, F.col("block"))).alias("high"))
    quotas = top.select("rank", (F.col("passes") * F.col("blocks") + F.coalesce(F.col("high") + 1, F.lit(0))).alias("n"))
    runs = split_quotas(keep(quotas, "mix-quotas"), shards, seed).where(F.col("n") > 0).groupBy("rank").agg(
        F.array_sort(F.collect_list(F.struct("first", "shard"))).alias("runs"))
    dealt = drawn.join(runs, "rank", "left")
    number = lambda e: e * F.col("blocks") + F.col("block")
    shard = lambda e: F.element_at(F.filter("runs", lambda r: r["first"] <= number(e)), -1)["shard"]
    passes = F.when(F.col("copies") > 0, F.sequence(F.lit(0).cast("long"), F.col("copies") - 1)).otherwise(
        F.array().cast("array<bigint>"))
    return dealt.select(
        "doc_id", "source", "size", "source_size", "target", "copies",
        (F.col("size") * F.col("copies")).alias("taken"), F.transform(passes, shard).alias("shards"))


def mixed_rows(mixture: DataFrame, seed: int = 7) -> DataFrame:
    """One row per copy: doc_id, shard, pass, place (a random key; sorting a shard by it is its local shuffle)."""
    rows = mixture.select("doc_id", F.posexplode("shards").alias("pass", "shard"))
    return rows.withColumn("place", spread_seed("shard", "pass", "doc_id", seed=seed))
