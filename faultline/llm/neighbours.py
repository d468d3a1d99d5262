"""Embedding near-dedup by NN-descent.

Equal vectors are one node with a weight. Every node keeps a list of its nearest known nodes. Lists start from ``TABLES`` random
hyperplane tables (nodes of one bucket, in groups of bounded size) and are refined: the neighbours of a node, and
nodes that have it as neighbour, meet each other, and every node keeps the best it has seen, until hardly any
list changes. An audit compares sampled nodes with all rows, separately outside and inside of the components that are
completed in blocks, until ``AUDIT`` nodes with a link are found outside; while the mean share of a node's links that was
found is below ``RECALL`` for either, lists are doubled up to ``LONGEST_LIST``, tables are added and the descent goes on. No
lists are returned below it: after ``MOST_TABLES`` tables an error gives the recall. Links an audit finds are kept. Links are exact: the cosine in double precision decides.

Saturated lists hold links only, so the node may have more. Their components (by the links known so far) are enlarged to
completeness: all members of such a component meet in blocks and links are counted, without one row per pair. A dense
component of m vectors costs m / BLOCK copies of each of them.

Defined results: vectors that are null, zero, empty or hold null or non-finite components link with nothing; vectors of
different length are never alike; a null id has no component and is kept; rows with equal ids and vectors count as
copies; an empty table gives no rows; labels and other columns are not read.
"""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from faultline.llm.common import drop_kept, keep, spread_seed
from faultline.llm.graph import components
from faultline.llm.jaccard import streamed_groups
from faultline.llm.vectors import rows_of, usable

LIST = 10
TABLES = 8
BUCKET = 64
DESCENTS = 6
SETTLED = 0.005
RECALL = 0.95
AUDIT = 256
AUDIT_SEED = 1000
ASKED = 4096  # nodes an audit compares with all rows in one pass
CELLS = 1 << 21
BLOCK = 1024
LONGEST_LIST = 160
MOST_TABLES = 512

NEAR = "node long, other long, sim double"


def unit(v) -> np.ndarray:
    v = np.asarray(v, np.float64)
    return v / np.linalg.norm(v)


def cosines(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    return np.einsum("ik,jk->ij", a, b) if len(a) * len(b) < 4096 else a @ b.T


def best_pairs(ids: np.ndarray, m: np.ndarray, floors: np.ndarray, k: int) -> pd.DataFrame:
    """Each member's k best others in the group that beat its floor."""
    s = cosines(m, m)
    s[ids[:, None] == ids[None, :]] = -2
    k = min(k, len(ids) - 1)
    top = np.argpartition(-s, k - 1, axis=1)[:, :k] if k < len(ids) else np.argsort(-s, axis=1)[:, :k]
    sims = np.take_along_axis(s, top, axis=1)
    ok = sims > np.maximum(floors[:, None], -1.5)
    row, col = np.nonzero(ok)
    return pd.DataFrame({"node": ids[row], "other": ids[top[row, col]], "sim": sims[row, col]})


def table_pairs(nodes: DataFrame, first: int, last: int, bits: int, k: int) -> DataFrame:
    """Neighbours within hyperplane buckets of the tables ``first`` .. ``last - 1``."""
    def sign(batches):
        for pdf in batches:
            out = []
            for dim, part in pdf.groupby(pdf["v"].map(len)):
                m = np.stack(part["v"].tolist())
                for t in range(first, last):
                    planes = np.random.default_rng([t, dim]).standard_normal((dim, bits))
                    key = (m @ planes > 0) @ (1 << np.arange(bits, dtype=np.int64))
                    out.append(pd.DataFrame({"node": part["node"], "v": part["v"], "dim": dim, "t": t, "key": key}))
            if out:
                yield pd.concat(out, ignore_index=True)

    keyed = nodes.mapInPandas(sign, "node long, v array<double>, dim int, t int, key long")
    sizes = keyed.groupBy("dim", "t", "key").agg(F.ceil(F.count(F.lit(1)) / (2 * BUCKET)).cast("int").alias("parts"))
    dealt = keyed.join(sizes, ["dim", "t", "key"]).withColumn(
        "part", F.pmod(spread_seed("node", "t", seed=6), F.col("parts")))
    keys = ["dim", "t", "key", "part"]

    def meet(batches):
        for pdf in streamed_groups(batches, keys):
            if len(pdf) > 1:
                yield best_pairs(pdf["node"].to_numpy(), np.stack(pdf["v"].tolist()), np.full(len(pdf), -2.0), k)

    return dealt.select(*keys, "node", "v").repartition(*keys).sortWithinPartitions(*keys).mapInPandas(meet, NEAR)


def shortened(pairs: DataFrame, k: int) -> DataFrame:
    """Each node's k best neighbours, each once."""
    by_node = Window.partitionBy("node").orderBy(F.desc("sim"), "other")
    once = pairs.groupBy("node", "other").agg(F.max("sim").alias("sim"))
    return once.withColumn("rank", F.row_number().over(by_node)).where(F.col("rank") <= k)


def descend(lists: DataFrame, nodes: DataFrame, k: int, turn: int) -> DataFrame:
    """One refinement: neighbours of a node, in both directions, meet each other."""
    floors = lists.groupBy("node").agg(
        F.when(F.count(F.lit(1)) >= k, F.min("sim")).otherwise(F.lit(-2.0)).alias("floor"))
    back = lists.select(F.col("other").alias("center"), F.col("node").alias("member"))
    by_center = Window.partitionBy("center").orderBy(spread_seed("member", seed=turn))
    # Of the nodes that have a hub in their list k meet there in a turn, others in the next: which ones depends on the turn.
    back = back.withColumn("rank", F.row_number().over(by_center)).where(F.col("rank") <= k).drop("rank")
    met = lists.select(F.col("node").alias("center"), F.col("other").alias("member")).unionByName(back).unionByName(
        lists.select(F.col("node").alias("center"), F.col("node").alias("member"))).distinct()
    with_vectors = met.join(nodes.select(F.col("node").alias("member"), "v"), "member").join(
        floors.withColumnRenamed("node", "member"), "member")

    def meet(batches):
        for pdf in streamed_groups(batches, ["center"]):
            size = pdf["v"].map(len)
            for _, part in pdf.groupby(size):
                if len(part) > 1:
                    yield best_pairs(part["member"].to_numpy(), np.stack(part["v"].tolist()),
                                     part["floor"].fillna(-2).to_numpy(), k)

    found = with_vectors.select("center", "member", "v", "floor").repartition("center").sortWithinPartitions("center")
    return shortened(lists.select("node", "other", "sim").unionByName(found.mapInPandas(meet, NEAR)), k)


def true_links(nodes: DataFrame, asked: list, threshold: float) -> DataFrame:
    """node, other: all links of the asked rows (node, v), by comparing them with all rows."""
    known = nodes.sparkSession.sparkContext.broadcast([(r["node"], np.array(r["v"])) for r in asked])

    def compare(batches):
        for pdf in batches:
            for dim, part in pdf.groupby(pdf["v"].map(len)):
                mine = [(i, v) for i, v in known.value if len(v) == dim]
                if not mine:
                    continue
                ids, m = np.array([i for i, _ in mine]), np.stack([v for _, v in mine])
                step = max(1, CELLS // len(mine))
                for at in range(0, len(part), step):
                    rows = part.iloc[at:at + step]
                    i, j = np.nonzero(cosines(m, np.stack(rows["v"].tolist())) >= threshold)
                    out = pd.DataFrame({"node": ids[i], "other": rows["node"].to_numpy()[j]})
                    yield out[out["node"] != out["other"]]

    return nodes.select("node", "v").mapInPandas(compare, "node long, other long")


def audit(nodes: DataFrame, lists: DataFrame, bridges: DataFrame | None, threshold: float, n: int,
          turn: int = 0) -> tuple[float, float, DataFrame]:
    """Recall outside and inside of dense components, and the missed links as (node, other).

    Recall is the mean share of a sampled node's links that is held, over sampled nodes that have a link. Nodes outside are
    asked until ``AUDIT`` of them have a link or none is left: then all their links are known, with the missed ones added.
    Inside, a component with a saturated list is compared completely later: what it reaches counts as found.
    """
    links = lists.where(F.col("sim") >= threshold).select("node", "other")
    if bridges is not None:
        links = links.unionByName(bridges)
    both = keep(links.unionByName(links.select(F.col("other").alias("node"), F.col("node").alias("other"))).distinct(),
                "audit-links")
    roots = components(both, "node", "other")
    members = keep(roots.join(saturated(lists, threshold).join(roots, "node").select("root").distinct(), "root", "left_semi"),
                   "audit-dense")
    inside = members.count()
    spread = F.pmod(spread_seed("node", seed=AUDIT_SEED + turn), F.lit(1 << 30))
    held = both.withColumn("held", F.lit(1))
    found = []

    def ask(asked: DataFrame, within: DataFrame | None) -> tuple[np.ndarray, int]:
        rows = asked.collect()
        true = keep(true_links(nodes, rows, threshold), "audit")
        seen = true.join(held, ["node", "other"], "left")
        if within is not None:
            seen = seen.join(within.withColumnRenamed("root", "ra"), "node", "left").join(
                within.select(F.col("node").alias("other"), F.col("root").alias("rb")), "other", "left")
            seen = seen.withColumn("held", F.when(F.col("ra") == F.col("rb"), 1).otherwise(F.col("held"))).drop("ra", "rb")
        found.append(keep(seen.where("held is null").select("node", "other"), "audit-missed"))
        per_node = seen.groupBy("node").agg(F.avg(F.coalesce("held", F.lit(0))).alias("share")).toPandas()
        drop_kept(true)
        return per_node["share"].to_numpy(float), len(rows)

    in_shares = np.empty(0)
    if inside:
        some = members.orderBy(spread, "node").limit(AUDIT).select("node")
        in_shares, _ = ask(nodes.select("node", "v").join(F.broadcast(some), "node"), members)
    shares, low, asked, want = np.empty(0), 0, 0, AUDIT
    while n > inside and low < 1 << 30 and len(shares) < AUDIT:
        high = min(1 << 30, low + max(1, int((1 << 30) * want / (n - inside))))
        part = nodes.where((spread >= low) & (spread < high)).select("node", "v").join(members.select("node"), "node", "left_anti")
        more, size = ask(part, None)
        shares, low, asked = np.concatenate([shares, more]), high, asked + size
        rate = max(len(shares), 1) / max(asked, 1)
        want = min(ASKED, max(2 * want, int((AUDIT - len(shares)) / rate)))
    missed = found[0] if found else both.limit(0)
    for more in found[1:]:
        missed = missed.unionByName(more)
    missed = keep(missed.distinct(), "bridges")
    drop_kept(*found, both, members)
    outside = 1.0 if low >= 1 << 30 or not len(shares) else float(shares.mean())
    return outside, float(in_shares.mean()) if len(in_shares) else 1.0, missed


def saturated(lists: DataFrame, threshold: float) -> DataFrame:
    full = lists.groupBy("node").agg(F.min("sim").alias("least"), F.count(F.lit(1)).alias("n"), F.max("k").alias("k"))
    return full.where((F.col("least") >= threshold) & (F.col("n") >= F.col("k"))).select("node")


def neighbour_lists(nodes: DataFrame, threshold: float, n: int) -> tuple[DataFrame, DataFrame]:
    """(node, other, sim, k) and (node, other): lists whose audited recall of links is at least RECALL outside of dense
    components and inside, and further links that audits have found."""
    bits = max(1, int(np.ceil(np.log2(max(2, n) / BUCKET))))
    k, done = LIST, 0
    lists = bridges = None
    while True:
        pairs = table_pairs(nodes, done, done + TABLES, bits, k)
        done += TABLES
        old = lists
        lists = keep(shortened(pairs if old is None else pairs.unionByName(old.select("node", "other", "sim")), k), "lists")
        if old is not None:
            drop_kept(old)
        for turn in range(DESCENTS):
            before = lists
            lists = keep(descend(before, nodes, k, done + turn), "lists")
            new = lists.join(before, ["node", "other"], "left_anti").count()
            drop_kept(before)
            if new <= SETTLED * k * n:
                break
        lists = lists.withColumn("k", F.lit(k))
        outside, inside, missed = audit(nodes, lists, bridges, threshold, n, done)
        bridges = missed if bridges is None else keep(bridges.unionByName(missed).distinct(), "bridges")
        if min(outside, inside) >= RECALL:
            return lists, bridges
        if done >= MOST_TABLES:
            raise RuntimeError(f"{done} hyperplane tables left the recall of links at {outside:.4f} outside and "
                               f"{inside:.4f} inside of dense components, below {RECALL}")
        k = min(2 * k, LONGEST_LIST)


def dense_links(members: DataFrame, threshold: float) -> DataFrame:
    """node, links: for all members (node, root, v, weight) of dense components, compared block by block."""
    sizes = members.groupBy("root").agg(F.ceil(F.count(F.lit(1)) / BLOCK).cast("int").alias("parts"))
    cells = members.join(sizes, "root").withColumn("part", F.pmod(spread_seed("node", seed=4), F.col("parts")).cast("int"))
    cells = cells.withColumn("other", F.explode(F.sequence(F.lit(0), F.col("parts") - 1)))
    cells = cells.select("root", F.least("part", "other").alias("lo"), F.greatest("part", "other").alias("hi"), "part",
                         "node", "weight", "v")

    def meet(batches):
        for pdf in streamed_groups(batches, ["root", "lo", "hi"]):
            inner = pdf["lo"].iloc[0] == pdf["hi"].iloc[0]
            left, right = (pdf, pdf) if inner else (pdf[pdf["part"] == pdf["lo"]], pdf[pdf["part"] == pdf["hi"]])
            if not len(left) or not len(right):
                continue
            near = cosines(np.stack(left["v"].tolist()), np.stack(right["v"].tolist())) >= threshold
            ids, others = left["node"].to_numpy(), right["node"].to_numpy()
            near &= ids[:, None] != others[None, :]
            yield pd.DataFrame({"node": ids, "links": near @ right["weight"].to_numpy()})
            if not inner:
                yield pd.DataFrame({"node": others, "links": left["weight"].to_numpy() @ near})

    dealt = cells.repartition("root", "lo", "hi").sortWithinPartitions("root", "lo", "hi")
    return dealt.mapInPandas(meet, "node long, links long").groupBy("node").agg(F.sum("links").alias("links"))


def near_duplicates(embeddings: DataFrame, threshold: float = 0.9, id_col: str = "vec_id",
                    vec_col: str = "embedding") -> DataFrame:
    """vec_id, n_links, component_id, kept for every row."""
    rows = rows_of(embeddings, id_col, vec_col)
    length = F.aggregate("v", F.lit(0.0), lambda a, x: a + x * x)
    good = rows.where(F.col("id").isNotNull() & usable("v")).where(length > 0)
    classes = keep(good.groupBy("v").agg(F.min("id").alias("node"), F.count(F.lit(1)).alias("weight")), "vectors")

    def scaled(batches):
        for pdf in batches:
            yield pdf.assign(v=[unit(v) for v in pdf["v"]])

    nodes = keep(classes.select("node", "weight", "v").mapInPandas(scaled, "node long, weight long, v array<double>"), "nodes")
    n = nodes.count()
    lists, bridges = neighbour_lists(nodes, threshold, n)
    linked = lists.where(F.col("sim") >= threshold).select("node", "other").unionByName(bridges)
    links = keep(linked.unionByName(linked.select(F.col("other").alias("node"), F.col("node").alias("other"))).distinct(),
                 "near-links")
    roots = keep(components(links, "node", "other"), "near-roots")
    full = saturated(lists, threshold).join(roots, "node").select("root").distinct()
    dense = roots.join(keep(full, "dense-roots"), "root", "left_semi")
    members = keep(dense.join(nodes, "node").select("node", "root", "weight", "v"), "dense-members")
    counted = links.join(members.select("node"), "node", "left_anti").join(
        nodes.select(F.col("node").alias("other"), "weight"), "other").groupBy("node").agg(F.sum("weight").alias("links"))
    counts = counted.unionByName(dense_links(members, threshold))
    answers = classes.join(roots, "node", "left").join(counts, "node", "left").select(
        F.col("v").alias("_v"), (F.coalesce("links", F.lit(0)) + F.col("weight") - 1).alias("_links"),
        F.coalesce("root", "node").alias("_root"))
    out = rows.join(keep(answers, "near-answers"), (F.col("v") == F.col("_v")) & F.col("id").isNotNull(), "left")
    component = F.coalesce("_root", "id")
    return out.select(F.col("id").alias("vec_id"), F.coalesce("_links", F.lit(0)).cast("long").alias("n_links"),
                      component.alias("component_id"), F.coalesce(F.col("id") == component, F.lit(True)).alias("kept"))
