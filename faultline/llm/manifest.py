"""Merkle manifest of a dataset, its nodes stored in van Emde Boas order.

Each document is a leaf, each source a tree of ``FAN`` children per node over its leaves in order of id, and the
sources' roots are the leaves of one more tree, the forest. A tree is cut at half its height, into aligned subtrees
below and one above over their roots, and each half again until a subtree has at most ``STORED`` levels of edges. Such a
subtree is one row: a block with its nodes in one binary value, laid out by the same halving. ``addresses`` gives the place of
a node by arithmetic alone; building fills the places from the leaves up, and siblings are read from
places that lie next to each other. The roots of the blocks of one layer are the leaves of the next, so a tree of n
leaves takes log n rounds to the base FAN**STORED, each over one row per block, and proofs go down the same layers.

Leaves are numbered by a range sort with one count per partition and source, so a source that holds a third of all
rows is sorted, numbered and hashed by many tasks. No group is larger than a block.

Defined results: null fields count as ``-``; null sources are a source of their own, before all others; null ids come
first in theirs; rows equal in source and id stand by their leaf, equal rows all stay (they are interchangeable); a
source with one row has its leaf as subroot; an empty table gives no rows and no root. Extra columns are not read.
"""

from __future__ import annotations

import hashlib
from binascii import hexlify
from collections.abc import Iterator
from dataclasses import dataclass
from functools import lru_cache

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from faultline.llm.common import drop_kept, keep

FAN = 16
STORED = 2
HIGHEST = 16  # 16 ** 16 leaves
FIELDS = ("doc_id", "source", "lang", "n_chars", "text")
STEPS = "array<struct<l:binary,r:binary>>"


# ---- layout -----------------------------------------------------------------------------


def layers(height: int, stored: int = STORED) -> list[int]:
    """Heights of the blocks of a tree, from its leaves up: halves of halves until ``stored`` is not exceeded."""
    if height <= stored:
        return [height]
    return layers(height - height // 2, stored) + layers(height // 2, stored)


@lru_cache
def addresses(levels: int) -> list[np.ndarray]:
    """For each depth of a subtree of so many levels of nodes, the places of its nodes from left to right."""
    if levels == 1:
        return [np.zeros(1, np.int64)]
    upper = levels // 2
    top, below = addresses(upper), addresses(levels - upper)
    start = sum(map(len, top)) + sum(map(len, below)) * np.arange(FAN**upper, dtype=np.int64)
    return [*top, *((start[:, None] + places[None, :]).reshape(-1) for places in below)]


def widths(height: int, leaves: int) -> list[int]:
    """Nodes per depth, root first."""
    out = [leaves]
    for _ in range(height):
        out.append(-(-out[-1] // FAN))
    return out[::-1]


def block_nodes(height: int, leaves: list[bytes]) -> bytes:
    """All digests of a block in van Emde Boas order; places without a node hold zeros."""
    place = addresses(height + 1)
    out = bytearray(32 * sum(map(len, place)))
    row = leaves
    for depth in range(height, -1, -1):
        for node, at in zip(row, place[depth][:len(row)].tolist(), strict=True):
            out[32 * at:32 * at + 32] = node
        row = [hashlib.sha256(hexlify(b"".join(row[i:i + FAN]))).digest() for i in range(0, len(row), FAN)]
    return bytes(out)


def block_steps(nodes: bytes, height: int, leaves: int) -> Iterator[list[tuple[bytes, bytes]]]:
    """For each leaf of a block: (siblings to the left, to the right), as hex text, level by level up to the block's root."""
    place, wide, text = addresses(height + 1), widths(height, leaves), hexlify(nodes)
    rows = [[text[64 * at:64 * at + 64] for at in place[d][:wide[d]].tolist()] for d in range(height + 1)]
    for i in range(leaves):
        steps = []
        for depth in range(height, 0, -1):
            first = i - i % FAN
            run = rows[depth][first:first + FAN]
            steps.append((b"".join(run[:i - first]), b"".join(run[i - first + 1:])))
            i //= FAN
        yield steps


def fold(digest: bytes, steps: list[tuple[bytes, bytes]]) -> bytes:
    """The root (hex text) that a digest (hex text) and its siblings lead to."""
    for left, right in steps:
        digest = hashlib.sha256(left + digest + right).hexdigest().encode()
    return digest


# ---- leaves -----------------------------------------------------------------------------


def encoded(value: Column) -> Column:
    """``-`` for null, else the number of UTF-8 bytes, a colon and the value."""
    text = value.cast("string")
    return F.coalesce(F.concat(F.octet_length(text).cast("string"), F.lit(":"), text), F.lit("-"))


def leaf(*values: Column) -> Column:
    """Digest (32 bytes) of the fields."""
    return F.unhex(F.sha2(F.concat(*[encoded(v) for v in values]), 256))


def numbered(rows: DataFrame, group: list[str], order: list[str], out: str) -> DataFrame:
    """Rows with their place in their group, from 0: a range sort, then one count per partition and group."""
    by = [*group, *order, "_tie"]
    tied = rows.withColumn("_tie", F.monotonically_increasing_id())  # rows equal in all else are spread as well
    tied = tied.repartitionByRange(*by).sortWithinPartitions(*by).drop("_tie")
    dealt = keep(tied.withColumn("_part", F.spark_partition_id()).withColumn("_row", F.monotonically_increasing_id()), "numbered")
    runs = dealt.groupBy(*[F.col(g).alias(f"_{g}") for g in group], F.col("_part").alias("_p")).agg(
        F.count(F.lit(1)).alias("_n"), F.min("_row").alias("_first"))
    keys = ", ".join(f"_{g}" for g in group)
    before = F.expr(f"sum(_n) over ({'partition by ' + keys if keys else ''} order by _p rows between unbounded preceding and 1 preceding)")
    runs = runs.withColumn("_before", F.coalesce(before, F.lit(0)))
    same = F.col("_part") == F.col("_p")
    for g in group:
        same = same & F.col(g).eqNullSafe(F.col(f"_{g}"))
    place = F.col("_before") + F.col("_row") - F.col("_first")
    return dealt.join(runs, same).select(*rows.columns, place.cast("long").alias(out))


def height_of(n: Column) -> Column:
    """Levels of edges of a tree of n leaves."""
    powers = F.array(*[F.lit(FAN**i).cast("decimal(38,0)") for i in range(HIGHEST)])
    return F.size(F.filter(powers, lambda p: p < n))


def layer_height(height: Column, layer: int) -> Column:
    """Height of the blocks of a layer; null above the tree's root."""
    table = F.array(*[F.array(*[F.lit(x) for x in layers(h)]) for h in range(HIGHEST + 1)])
    return F.get(F.get(table, height), F.lit(layer))


# ---- trees ------------------------------------------------------------------------------


def grow(leaves: DataFrame, payload: list[str]) -> tuple[list[DataFrame], DataFrame]:
    """Blocks of all layers, and (tree, root), from leaves (tree, height, pos, digest); payload stays with the lowest layer."""
    highest = leaves.agg(F.max("height")).first()[0]
    level, made, roots = leaves, [], None
    for no in range(0 if highest is None else max(len(layers(h)) for h in range(highest + 1))):
        b = layer_height(F.col("height"), no)
        here = level.withColumn("b", b).where("b is not null")
        block = F.floor(F.col("pos") / F.element_at(F.array(*[F.lit(FAN**i).cast("long") for i in range(STORED + 1)]), F.col("b") + 1))
        held = F.array_sort(F.collect_list(F.struct("pos", "digest", *(payload if no == 0 else []))))
        rows = here.groupBy("tree", "height", "b", block.cast("long").alias("block")).agg(held.alias("held"))

        def build(batches):
            for pdf in batches:
                nodes = [block_nodes(b, [x["digest"] for x in held]) for b, held in zip(pdf["b"], pdf["digests"], strict=True)]
                yield pdf.drop(columns="digests").assign(nodes=nodes)

        rows = rows.withColumn("digests", F.transform("held", lambda x: F.struct(x["digest"].alias("digest"))))
        names = ["tree", "height", "b", "block", "held"]
        kind = ", ".join(f"{f.name} {f.dataType.simpleString()}" for f in rows.select(*names).schema)
        made.append(keep(rows.select(*names, "digests").mapInPandas(build, f"{kind}, nodes binary"), f"blocks-{no}"))
        level = made[-1].select("tree", "height", F.col("block").alias("pos"), F.substring("nodes", 1, 32).alias("digest"))
        done = level.where(layer_height(F.col("height"), no + 1).isNull()).select("tree", F.col("digest").alias("root"))
        roots = done if roots is None else roots.unionByName(done)
    return made, roots


def descend(blocks: list[DataFrame], tops: DataFrame) -> DataFrame:
    """(tree, pos, height, steps, carried) of the lowest layer's leaves' blocks: blocks joined with the steps above them.

    ``tops`` holds (tree, steps, carried): what lies above each tree's root.
    """
    above = None
    for no in range(len(blocks) - 1, -1, -1):
        mine = blocks[no]
        top = mine.where(layer_height(F.col("height"), no + 1).isNull()).select("tree", "block")
        start = top.join(tops, "tree")
        paths = start if above is None else start.unionByName(above)
        joined = mine.join(paths, ["tree", "block"])
        if no == 0:
            return joined

        def run(batches):
            for pdf in batches:
                for tree, held, nodes, b, steps, carried in pdf[["tree", "held", "nodes", "b", "steps", "carried"]].itertuples(index=False):
                    upper = [(s["l"], s["r"]) for s in steps]
                    own = block_steps(nodes, b, len(held))
                    yield pd.DataFrame({"tree": tree, "block": [x["pos"] for x in held], "carried": [carried] * len(held),
                                        "steps": [[{"l": left, "r": right} for left, right in (*s, *upper)] for s in own]})

        above = keep(joined.mapInPandas(run, f"tree long, block long, carried string, steps {STEPS}"), f"paths-{no}")
    raise ValueError("a tree without blocks")


@dataclass
class Manifest:
    """Blocks of the sources' trees and of the forest, the sources' roots, and the root of all (hex; None: no rows)."""

    trees: list[DataFrame]
    forest: list[DataFrame]
    sources: DataFrame
    root: str | None

    def drop(self) -> None:
        drop_kept(*self.trees, *self.forest, self.sources)


def build(documents: DataFrame, claim: Column | None = None, fields: tuple[str, ...] = FIELDS, id_col: str = "doc_id",
          source_col: str = "source") -> Manifest:
    """The manifest of all rows. ``claim`` is a digest to be held against the manifest later (null: the leaf itself)."""
    claimed = F.lit(None).cast("binary") if claim is None else claim
    rows = keep(documents.select(F.col(source_col).alias("source"), F.col(id_col).alias("id"), leaf(*[F.col(f) for f in fields]).alias("digest"),
                                 claimed.alias("claim")), "leaves")
    placed = keep(numbered(rows, ["source"], ["id", "digest"], "pos"), "placed")
    counts = placed.groupBy("source").agg(F.count(F.lit(1)).alias("n"))
    sources = keep(numbered(counts, [], ["source"], "tree").withColumn("height", height_of(F.col("n"))), "sources")
    named = sources.select(F.col("source").alias("_source"), "tree", "height")
    leaves = placed.join(named, F.col("source").eqNullSafe(F.col("_source"))).select("tree", "height", "pos", "digest", "id", "claim")
    trees, roots = grow(leaves, ["id", "claim"])
    if roots is None:
        return Manifest([], [], sources, None)
    known = keep(sources.join(roots, "tree"), "sources")
    high = F.lit(known.select(height_of(F.lit(known.count()))).first()[0])
    forest, top = grow(known.select(F.lit(0).cast("long").alias("tree"), high.alias("height"), F.col("tree").alias("pos"),
                                    F.col("root").alias("digest")), [])
    root = bytes(top.first()["root"]).hex()
    return Manifest(trees, forest, known, root)


def paths(manifest: Manifest) -> DataFrame:
    """The lowest blocks with the steps above them; ``carried`` is the source's root (hex)."""
    spark = manifest.sources.sparkSession
    nothing = spark.range(1).select(F.col("id").alias("tree"), F.array().cast(STEPS).alias("steps"), F.lit("").alias("carried"))
    tops = descend(manifest.forest, nothing)

    def run(batches):
        for pdf in batches:
            for held, nodes, b, steps in pdf[["held", "nodes", "b", "steps"]].itertuples(index=False):
                upper = [(s["l"], s["r"]) for s in steps]
                found = block_steps(nodes, b, len(held))
                yield pd.DataFrame({"tree": [x["pos"] for x in held], "carried": [bytes(x["digest"]).hex() for x in held],
                                    "steps": [[{"l": left, "r": right} for left, right in (*s, *upper)] for s in found]})

    tops = keep(tops.mapInPandas(run, f"tree long, carried string, steps {STEPS}"), "tops")
    return descend(manifest.trees, tops)


def audit(manifest: Manifest, id_type: str = "long", with_steps: bool = False) -> DataFrame:
    """Per leaf: id, leaf, subroot, proof_sha256 (of all siblings up to the root), folded_root from its claim, verified; on demand the siblings."""
    root = manifest.root
    extra = ", siblings array<string>" if with_steps else ""
    schema = f"id {id_type}, leaf string, subroot string, proof_sha256 string, folded_root string, verified boolean{extra}"
    if root is None:
        return manifest.sources.sparkSession.createDataFrame([], schema)

    def run(batches):
        for pdf in batches:
            for held, nodes, b, steps, subroot in pdf[["held", "nodes", "b", "steps", "carried"]].itertuples(index=False):
                upper = [(s["l"], s["r"]) for s in steps]
                known: dict[bytes, str] = {}  # what the steps above the block make of its root
                out = []
                for x, own in zip(held, block_steps(nodes, b, len(held)), strict=True):
                    mine = hexlify(x["digest"])
                    inner = fold(mine if x["claim"] is None else hexlify(x["claim"]), own)
                    if inner not in known:
                        known[inner] = fold(inner, upper).decode()
                    seen = [s for left, right in (*own, *upper) for s in (left, right)]
                    row = (x["id"], mine.decode(), subroot, hashlib.sha256(b"".join(seen)).hexdigest(), known[inner], known[inner] == root)
                    out.append((*row, [(left + right).decode() for left, right in (*own, *upper)]) if with_steps else row)
                names = ["id", "leaf", "subroot", "proof_sha256", "folded_root", "verified", *["siblings"] * with_steps]
                made = pd.DataFrame(out, columns=names)
                yield made.assign(id=pd.array([r[0] for r in out], "Int64")) if id_type == "long" else made

    return paths(manifest).mapInPandas(run, schema)
