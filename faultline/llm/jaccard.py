"""N-gram Jaccard join with prefix trees.

A document's set holds the 63-bit hashes of its distinct word n-grams, in the order of the hashes: the global order. Equal
sets are one representative from here on. Two sets with Jaccard similarity ``num/den`` or more must share one of their
first ``n - ceil(num/den * n) + 1`` members. Grams that more than ``COMMON`` sets show among their first members would
bring masses of unlike sets together, so they stand last in the global order; a set whose first members hold such
grams uses the ones behind them, and a set that consists of little else takes its prefix from the common grams.

Joining: each shared prefix gram names a hub, the smallest set that has it. A set goes to the hub it shares most prefix
grams with, in groups of bounded size, and there the sets stand in a compressed trie. A set descends the trie once
for all sets that share a path; the overlap so far is kept at each node, and a subtree is left as soon as overlap plus
the members that remain on either side cannot reach the overlap needed, or when all of its sets are already linked to
the set. Found links are contracted to components. Rounds with other hubs follow while they still find links; at the end
all sets that share enough prefix grams with a set of another component meet it in a trie, so no link between components
is missed; sets whose prefixes hold common grams find their partners in blocks. Candidate pairs are never rows with sets.

A hot group (copies, a common passage) costs its members one row per round: hubs come from aggregates, equal sets are one
row, and groups are cut to ``GROUP`` sets each.

Defined results: without words or text a set is empty and linked with nothing; with fewer words than n the whole sequence is
one gram; repeated rows are copies; rows with equal ids and different texts are each joined and linked with one another; a null
id is returned without links; an empty table gives no rows; other columns are not read. Hashes of 63 bits stand for the
grams and, past the comparison of whole sets, for the sets.
"""

from __future__ import annotations

import hashlib

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from faultline.llm.common import SMALL, drop_kept, join_small, keep, spread_seed
from faultline.llm.graph import components

COMMON = 64
GROUP = 256
BLOCK = 1024
CELL = 128
ROUNDS = 2
CACHE = 1 << 20

ODD = [np.uint64(x) for x in (0x9E3779B97F4A7C15, 0xC2B2AE3D27D4EB4F, 0x165667B19E3779F9, 0x27D4EB2F165667C5,
                              0x85EBCA77C2B2AE63)]


def word_hash(word: bytes) -> int:
    return int.from_bytes(hashlib.blake2b(word, digest_size=8).digest(), "little")


def gram_set(text: str | None, n: int, cache: dict[bytes, int]) -> np.ndarray:
    """Sorted distinct 63-bit gram hashes of A-Z lower-cased text."""
    words = text.encode("utf-8", "surrogatepass").lower().split() if text else []
    if not words:
        return np.empty(0, np.int64)
    if len(cache) > CACHE:
        cache.clear()
    for w in words:
        if w not in cache:
            cache[w] = word_hash(w)
    h = np.array([cache[w] for w in words], np.uint64)
    size = min(n, len(h))
    out = np.full(len(h) - size + 1, size, np.uint64)
    for i in range(size):
        out = (out ^ (h[i:len(h) - size + 1 + i] * ODD[i % 5])) * ODD[4] + ODD[0]
        out ^= out >> np.uint64(29)
    return np.unique((out >> np.uint64(1)).view(np.int64))


def least_overlap(a, b, num: int, den: int):
    """Smallest intersection of sets of sizes a and b with similarity num/den or more."""
    return -(-(num * (a + b)) // (den + num))


def digest_of(members: np.ndarray) -> bytes:
    return hashlib.blake2b(members.tobytes(), digest_size=16).digest()


def prefix_length(n: int, num: int, den: int) -> int:
    return n - (-(-num * n // den)) + 1


def spare(p: int) -> int:
    """Members kept behind the prefix, for prefixes that hold common grams."""
    return p // 4 + 8


class Trie:
    """Compressed trie of ordered sets. A node: label, children by first member, sizes below it, sets that end in it."""

    __slots__ = ("label", "kids", "low", "high", "ends", "count")

    def __init__(self, label: np.ndarray) -> None:
        self.label, self.kids, self.ends = label, {}, []
        self.low, self.high, self.count = 1 << 62, 0, 0

    def insert(self, members: np.ndarray, size: int, item: int) -> None:
        node = self
        while True:
            node.low, node.high, node.count = min(node.low, size), max(node.high, size), node.count + 1
            if not len(members):
                node.ends.append(item)
                return
            kid = node.kids.get(members[0])
            if kid is None:
                kid = node.kids[members[0]] = Trie(members)
                members = members[:0]
                node = kid
                continue
            m = min(len(kid.label), len(members))
            apart = np.flatnonzero(kid.label[:m] != members[:m])
            same = int(apart[0]) if len(apart) else m
            if same < len(kid.label):
                upper = Trie(kid.label[:same])
                upper.low, upper.high, upper.count = kid.low, kid.high, kid.count
                kid.label = kid.label[same:]
                upper.kids[kid.label[0]] = kid
                node.kids[members[0]] = upper
                kid = upper
            node, members = kid, members[same:]

    def matches(self, members: np.ndarray, num: int, den: int, done) -> list[int]:
        """Items similar to ``members``; ``done(item)`` tells those that need no answer."""
        own, out = len(members), []
        stack = [(self, 0, 0)]
        while stack:
            node, overlap, depth = stack.pop()
            label = node.label
            if len(label):
                at = np.searchsorted(members, label)
                at[at == own] = own - 1
                overlap += int((members[at] == label).sum())
                depth += len(label)
                left = own - int(np.searchsorted(members, label[-1], side="right"))
            else:
                left = own
            if num * own > den * node.high or num * node.low > den * own:
                continue
            # Any set below has at least the smallest size: no overlap it can reach is enough if this one is not.
            need = least_overlap(own, max(node.low, -(-num * own // den)), num, den)
            if overlap + min(left, node.high - depth) < need:
                continue
            for item in node.ends:
                if not done(item) and den * overlap >= num * (own + depth - overlap):
                    out.append(item)
                    break
            stack.extend((kid, overlap, depth) for kid in node.kids.values())
        return out


def link_group(sets: list[np.ndarray], num: int, den: int, roots: list[int]) -> list[tuple[int, int]]:
    """Links among one group that join what ``roots`` (component of each set) keeps apart."""
    parent = {r: r for r in roots}

    def find(r: int) -> int:
        while parent[r] != r:
            parent[r] = parent[parent[r]]
            r = parent[r]
        return r

    links = []
    trie = Trie(np.empty(0, np.int64))
    for i in sorted(range(len(sets)), key=lambda i: len(sets[i])):
        if not len(sets[i]):
            continue
        for j in trie.matches(sets[i], num, den, lambda item, i=i: find(roots[item]) == find(roots[i])):
            a, b = find(roots[i]), find(roots[j])
            if a != b:
                links.append((i, j))
                parent[max(a, b)] = min(a, b)
        trie.insert(sets[i], len(sets[i]), i)
    return links


def sketched(docs: DataFrame, id_col: str, text_col: str, n: int, num: int, den: int) -> DataFrame:
    """doc_id, n, digest of the set, first: its first members (empty where only an equal set can be similar)."""
    def run(batches):
        cache: dict[bytes, int] = {}
        for pdf in batches:
            rows = []
            for text in pdf["text"]:
                grams = gram_set(text, n, cache)
                size = len(grams)
                p = prefix_length(size, num, den)
                alone = size == 0 or -(-num * (size + 1) // den) > size  # no larger or smaller set can be similar
                first = grams[:0] if alone and prefix_length(size, num, den) <= 1 else grams[: p + spare(p)]
                rows.append((size, digest_of(grams), first))
            out = pd.DataFrame(rows, columns=["n", "digest", "first"])
            out.insert(0, "doc_id", pdf["doc_id"].values)
            yield out

    rows = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).alias("text"))
    nulls = rows.where("doc_id is null").select("doc_id", "text")
    known = rows.where("doc_id is not null")
    schema = "doc_id long, n long, digest binary, first array<long>"
    return known.mapInPandas(run, schema).unionByName(nulls.mapInPandas(
        lambda batches: (x.assign(doc_id=pd.array([None] * len(x), "Int64")) for x in run(batches)), schema))


def prefixes(reps: DataFrame, texts: DataFrame, n: int, num: int, den: int) -> DataFrame:
    """gram, doc, n: the prefix of every representative in the order with common grams last, without grams of one set."""
    entries = reps.where(F.size("first") > 0).select("doc", "n", F.posexplode("first").alias("pos", "gram"))
    df = entries.groupBy("gram").agg(F.count(F.lit(1)).alias("df")).where("df > 1")
    hits = keep(entries.join(df, "gram"), "grams")
    common = F.col("df") > COMMON
    p = F.col("n") + 1 - F.floor((F.col("n") * num + den - 1) / den)
    held = F.least(F.col("n"), p + F.floor(p / 4) + 8)
    # Common grams before a member push it forward by one place each.
    shifts = hits.where(common).groupBy("doc").agg(F.sort_array(F.collect_list("pos")).alias("commons"))

    def within(rows: DataFrame) -> DataFrame:
        place = F.col("pos") - F.coalesce(F.size(F.filter("commons", lambda c: c < F.col("pos"))), F.lit(0))
        return rows.join(shifts, "doc", "left").where(place < p).select("gram", "doc", "n")

    dense = hits.groupBy("doc", "n").agg(F.sum(common.cast("long")).alias("c")).where(held - F.col("c") < p)
    dense = keep(dense.join(reps.select("doc", "id", "digest"), "doc").select("doc", "id", "n", "digest"), "dense")
    # Sets that hold too many common grams: all their members in the new order.
    counts = keep(df.where(common).select("gram", "df"), "common")
    whole = join_small(texts, dense, ["id"])
    if counts.limit(SMALL + 1).count() <= SMALL:
        anew = reordered(whole, counts, n, num, den)
    else:
        every = grams_of(whole, n).select("doc", "n", F.explode("members").alias("gram")).distinct()
        ordered = every.join(counts, "gram", "left").withColumn("df", F.coalesce("df", F.lit(0)))
        nth = F.row_number().over(Window.partitionBy("doc").orderBy("df", "gram"))
        anew = ordered.withColumn("place", nth - 1).where(F.col("place") < p).select("gram", "doc", "n", "df")
    anew = keep(anew, "anew")
    # A gram that only one set shows among its first members may stand in the new prefix of a set with common grams.
    new = keep(anew.where("df = 0").select("gram").distinct().join(df, "gram", "left_anti"), "new-grams")
    placed = within(hits.where(~common)).unionByName(within(join_small(entries, new, ["gram"]).select("doc", "n", "pos", "gram")))
    out = keep(placed.join(dense.select("doc"), "doc", "left_anti").unionByName(anew.select("gram", "doc", "n")), "prefixes")
    drop_kept(hits, anew)
    return out


def reordered(texts: DataFrame, counts: DataFrame, n: int, num: int, den: int) -> DataFrame:
    """gram, doc, n, df (0: not common): prefixes with the common grams last, by a lookup in every task.
    ``counts`` holds at most SMALL grams."""
    known = counts.toPandas().sort_values("gram")
    shared = texts.sparkSession.sparkContext.broadcast((known["gram"].to_numpy(), known["df"].to_numpy()))

    def run(batches):
        grams, df = shared.value
        for pdf in grams_in(batches, n):
            for doc, size, members in zip(pdf["doc"], pdf["n"], pdf["members"], strict=True):
                at = np.minimum(np.searchsorted(grams, members), max(0, len(grams) - 1))
                found = np.where(grams[at] == members, df[at], 0) if len(grams) else np.zeros(len(members), np.int64)
                order = np.lexsort((members, found))[:prefix_length(size, num, den)]
                yield pd.DataFrame({"gram": members[order], "doc": doc, "n": size, "df": found[order]})

    return texts.select("doc", "n", "digest", "text").mapInPandas(run, "gram long, doc long, n long, df long")


def grams_in(batches, n: int):
    cache: dict[bytes, int] = {}
    for pdf in batches:
        sets = [gram_set(t, n, cache) for t in pdf["text"]]
        right = [digest_of(s) == bytes(d) for s, d in zip(sets, pdf["digest"], strict=True)]
        yield pd.DataFrame({"doc": pdf["doc"], "n": pdf["n"], "members": sets})[right]


def grams_of(texts: DataFrame, n: int) -> DataFrame:
    """doc, n, members for rows with doc, n, digest, text whose text has that digest."""
    return texts.select("doc", "n", "digest", "text").mapInPandas(
        lambda batches: grams_in(batches, n), "doc long, n long, members array<long>")


def full_sets(wanted: DataFrame, reps: DataFrame, texts: DataFrame, n: int) -> DataFrame:
    """doc, n, members of the wanted sets, from their texts."""
    wanted = keep(wanted.toDF("doc").distinct().join(reps.select("doc", "id", "n", "digest"), "doc"), "wanted")
    return keep(grams_of(join_small(texts, wanted, ["id"]), n), "members")


def streamed_groups(batches, keys: list[str]):
    """Runs of rows with equal keys in sorted batches, as data frames."""
    held = None
    for pdf in batches:
        pdf = pdf if held is None else pd.concat([held, pdf], ignore_index=True)
        if not len(pdf):
            continue
        new = np.flatnonzero((pdf[keys] != pdf[keys].shift()).any(axis=1).to_numpy())
        for start, end in zip(new[:-1], new[1:], strict=True):
            yield pdf.iloc[start:end]
        held = pdf.iloc[new[-1]:]
    if held is not None and len(held):
        yield held


def shared_enough(na: str, nb: str, shared: str, num: int, den: int) -> Column:
    """Prefix grams two similar sets must share: all members up to the end of the shorter prefix are in both prefixes,
    so the overlap is at most the shared ones plus what stands behind a prefix, ``ceil(num/den * n) - 1`` members."""
    a, b = F.col(na), F.col(nb)
    need = F.floor((num * (a + b) + den + num - 1) / (den + num))
    behind = F.floor((num * F.greatest(a, b) + den - 1) / den) - 1
    return (num * F.greatest(a, b) <= den * F.least(a, b)) & (F.col(shared) + behind >= need)


def round_links(entries: DataFrame, reps: DataFrame, texts: DataFrame, roots: DataFrame | None, turn: int, n: int,
                num: int, den: int) -> DataFrame:
    """a, b: links found in groups around this turn's hubs."""
    if roots is not None:
        entries = entries.join(roots, "doc", "left").withColumn("root", F.coalesce("root", "doc"))
    else:
        entries = entries.withColumn("root", F.col("doc"))
    order = F.col("doc") if turn == 0 else spread_seed("root", seed=turn)
    hubs = entries.groupBy("gram").agg(
        F.min(F.struct(order.alias("order"), F.col("doc").alias("hub"), F.col("root").alias("hub_root"),
                       F.col("n").alias("hub_n"))).alias("h"),
        F.min("root").alias("lo"), F.max("root").alias("hi")).where("lo < hi").select("gram", "h.*")
    near = entries.join(hubs, "gram").where("root != hub_root")
    votes = near.groupBy("doc", "root", "n", "hub", "hub_root", "hub_n").agg(F.count(F.lit(1)).alias("votes"))
    votes = votes.where(shared_enough("n", "hub_n", "votes", num, den))
    best = votes.groupBy("doc", "root").agg(
        F.max(F.struct("votes", (-F.col("hub")).alias("hub"), "hub_root")).alias("b"))
    best = keep(best.select("doc", "root", (-F.col("b.hub")).alias("hub"), F.col("b.hub_root").alias("hub_root")), "hubs")
    sets = full_sets(best.select("doc").union(best.select("hub")), reps, texts, n)
    # Members of a hub are dealt out over groups of about GROUP sets; the hub joins each of them.
    sizes = best.groupBy("hub").agg(F.ceil(F.count(F.lit(1)) / GROUP).alias("parts"))
    dealt = best.join(sizes, "hub").withColumn("part", F.pmod(spread_seed("doc", seed=turn), "parts"))
    members = dealt.select("hub", "part", "doc", "root").unionByName(
        dealt.select("hub", "part", F.col("hub").alias("doc"), F.col("hub_root").alias("root")).distinct())

    full = members.join(sets.select("doc", "members"), "doc").repartition("hub", "part")
    return full.sortWithinPartitions("hub", "part").mapInPandas(linked_in(["hub", "part"], num, den), "a long, b long")


def family_groups(entries: DataFrame, common: DataFrame, roots: DataFrame, num: int, den: int) -> DataFrame:
    """g0..g4, doc: cells of sets that share enough prefix grams with sets of other components, for sets with a prefix
    gram that more than COMMON sets have there. Sets that such grams connect are a family; its prefixes meet block by
    block, so a family of m sets costs m / BLOCK copies of each prefix. Pairs never become rows: the sets of a block that
    have partners go into cells of CELL by CELL sets."""
    hubs = common.groupBy("gram").agg(F.min("doc").alias("hub"))
    chained = components(common.join(hubs, "gram").select(F.col("doc").alias("a"), F.col("hub").alias("b")))
    families = keep(chained.select(F.col("node").alias("doc"), F.col("root").alias("family")), "families")
    lists = entries.join(families, "doc").groupBy("doc", "family", "n").agg(F.collect_list("gram").alias("grams"))
    lists = lists.join(roots, "doc", "left").withColumn("root", F.coalesce("root", "doc"))
    sizes = families.groupBy("family").agg(F.ceil(F.count(F.lit(1)) / BLOCK).cast("int").alias("parts"))
    part = F.pmod(spread_seed("doc", seed=5), F.col("parts")).cast("int")
    cells = lists.join(sizes, "family").withColumn("part", part).withColumn(
        "other", F.explode(F.sequence(F.lit(0), F.col("parts") - 1)))
    cells = cells.select("family", F.least("part", "other").alias("lo"), F.greatest("part", "other").alias("hi"), "part",
                         "doc", "n", "root", "grams")

    def meet(batches):
        for pdf in streamed_groups(batches, ["family", "lo", "hi"]):
            family, lo, hi = (int(pdf[c].iloc[0]) for c in ("family", "lo", "hi"))
            pdf = pdf.sort_values(["n", "doc"])  # sets of like sizes stand in the same cells
            left, right = (pdf, pdf) if lo == hi else (pdf[pdf["part"] == lo], pdf[pdf["part"] == hi])
            if not len(left) or not len(right):
                continue
            places = np.repeat(np.arange(len(right)), [len(g) for g in right["grams"]])
            flat = np.concatenate(right["grams"].tolist())
            order = np.argsort(flat, kind="stable")
            flat, places = flat[order], places[order]
            ids, n, roots_ = (right[c].to_numpy() for c in ("doc", "n", "root"))
            met: set[tuple[int, int, int]] = set()
            for row, (doc, size, root, grams) in enumerate(
                    zip(left["doc"], left["n"], left["root"], left["grams"], strict=True)):
                a, b = np.searchsorted(flat, grams, "left"), np.searchsorted(flat, grams, "right")
                hits = np.concatenate([places[x:y] for x, y in zip(a, b, strict=True)])
                shared = np.bincount(hits, minlength=len(ids))
                most = np.maximum(n, size)
                need = -(-(num * (n + size)) // (den + num))
                ok = (shared > 0) & (roots_ != root) & (num * most <= den * np.minimum(n, size))
                ok &= shared - (-num * most // den) - 1 >= need
                if lo == hi:
                    ok[: row + 1] = False
                for j in np.flatnonzero(ok).tolist():
                    met.add((row // CELL, j // CELL, int(ids[j])))
                    met.add((row // CELL, j // CELL, int(doc)))
            if met:
                yield pd.DataFrame([(family, lo, hi, x, y, doc) for x, y, doc in sorted(met)],
                                   columns=["g0", "g1", "g2", "g3", "g4", "doc"])

    dealt = cells.repartition("family", "lo", "hi").sortWithinPartitions("family", "lo", "hi")
    return dealt.mapInPandas(meet, "g0 long, g1 long, g2 long, g3 long, g4 long, doc long")


def rest_links(entries: DataFrame, reps: DataFrame, texts: DataFrame, roots: DataFrame, n: int, num: int,
               den: int) -> DataFrame:
    """a, b: links that join what is still in different components, among all sets that share enough prefix grams."""
    open_ = entries.join(roots, "doc", "left").withColumn("root", F.coalesce("root", "doc"))
    split = open_.groupBy("gram").agg(
        F.min("root").alias("lo"), F.max("root").alias("hi"), F.count(F.lit(1)).alias("sets")).where("lo < hi")
    open_ = keep(open_.join(split, "gram").select("gram", "doc", "n", "root", "sets"), "open")
    rare = open_.where(F.col("sets") <= COMMON).drop("sets")
    other = rare.select("gram", F.col("doc").alias("b"), F.col("n").alias("nb"), F.col("root").alias("root_b"))
    pairs = rare.withColumnRenamed("doc", "a").join(other, "gram").where(
        (F.col("a") < F.col("b")) & (F.col("root") != F.col("root_b"))
        & (num * F.greatest("n", "nb") <= den * F.least("n", "nb")))
    pairs = pairs.groupBy("a", "b", "n", "nb").agg(F.count(F.lit(1)).alias("shared")).where(
        shared_enough("n", "nb", "shared", num, den)).select("a", "b")
    # A set and its partners with rare grams are a group; ``g1`` is -1 there and a block's number in families.
    stars = pairs.select(F.col("a").alias("g0"), F.explode(F.array("a", "b")).alias("doc")).distinct().select(
        "g0", *[F.lit(-1).cast("long").alias(f"g{i}") for i in range(1, 5)], "doc")
    groups = family_groups(entries, open_.where(F.col("sets") > COMMON), roots, num, den).unionByName(stars)
    groups = keep(groups, "groups")
    drop_kept(open_)
    sets = full_sets(groups.select("doc"), reps, texts, n)
    keys = [f"g{i}" for i in range(5)]
    full = groups.join(roots, "doc", "left").withColumn("root", F.coalesce("root", "doc")).join(
        sets.select("doc", "members"), "doc").repartition(*keys)
    return full.sortWithinPartitions(*keys).mapInPandas(linked_in(keys, num, den), "a long, b long")


def linked_in(keys: list[str], num: int, den: int):
    """Task code: links of ``link_group`` for every group of rows with equal ``keys``."""
    def run(batches):
        for pdf in streamed_groups(batches, keys):
            pdf = pdf.drop_duplicates("doc")
            ids = pdf["doc"].tolist()
            found = link_group([np.asarray(m) for m in pdf["members"]], num, den, pdf["root"].tolist())
            if found:
                yield pd.DataFrame([(ids[i], ids[j]) for i, j in found], columns=["a", "b"])

    return run


def similarity_classes(docs: DataFrame, n: int = 4, num: int = 85, den: int = 100, id_col: str = "doc_id",
                       text_col: str = "text") -> DataFrame:
    """doc_id, n_shingles, component_id for every row."""
    key = F.shiftrightunsigned(F.xxhash64("digest"), 1)
    all_ = keep(sketched(docs, id_col, text_col, n, num, den).withColumn(
        "doc", F.when((F.col("n") > 0) & F.col("doc_id").isNotNull(), key)), "sets")
    rows = keep(all_.select("doc_id", "n", "doc"), "rows")
    least = rows.where("doc is not null").groupBy("doc").agg(F.min("doc_id").alias("id"))
    # A row for every different set, with the smallest id that has it: its text is read there again.
    reps = all_.join(least, (all_["doc"] == least["doc"]) & (F.col("doc_id") == F.col("id"))).groupBy(least["doc"], "id").agg(
        F.min(F.struct("digest", "n", "first")).alias("s"))
    reps = keep(reps.select("doc", "id", "s.*"), "reps")
    drop_kept(all_)
    texts = docs.select(F.col(id_col).cast("long").alias("id"), F.col(text_col).alias("text"))
    entries = prefixes(reps, texts, n, num, den)
    links, roots = None, None
    for turn in range(ROUNDS):
        found = keep(round_links(entries, reps, texts, roots, turn, n, num, den), "found")
        if found.isEmpty():
            break
        links = found if links is None else links.unionByName(found)
        roots = keep(components(links).select(F.col("node").alias("doc"), "root"), "roots")
    if roots is None:
        roots = entries.select("doc", F.col("doc").alias("root")).limit(0)
    rest = keep(rest_links(entries, reps, texts, roots, n, num, den), "rest")
    links = rest if links is None else links.unionByName(rest)
    # Equal ids with several sets are links as well.
    several = rows.where("doc is not null").groupBy("doc_id").agg(F.min("doc").alias("a"), F.max("doc").alias("z")).where("a < z")
    same_id = rows.join(several, "doc_id").select("a", F.col("doc").alias("b")).where("b is not null")
    final = keep(components(links.unionByName(same_id)), "classes")
    joined = reps.select("doc", "id").join(final.select(F.col("node").alias("doc"), "root"), "doc")
    smallest = joined.groupBy("root").agg(F.min("id").alias("component"))
    linked = joined.join(smallest, "root").select("doc", "component")
    of_set = reps.select("doc", "id").join(linked, "doc", "left").select("doc", F.coalesce("component", "id").alias("component"))
    return rows.join(of_set, "doc", "left").select(
        "doc_id", F.col("n").alias("n_shingles"), F.coalesce("component", "doc_id").alias("component_id"))
