"""Error fingerprints and clusters.

One scan turns log entries into *signature facts* (per signature: entries, files, functions, frames,
sample messages), combined on the map side. Everything after that works on distinct signatures.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from faultline.functions import text as T
from faultline.functions import vocab as V
from faultline.functions.groups import first_n, ordered_list
from faultline.session import cut

NS = "namespace"
MERGE_SIMILARITY = 0.5
SHARED_FRAMES = 2
# Open signatures of a key that meet in one round. At most 1000, so that the choice is trimmed in every task before its shuffle.
BATCH = 1000


def error_entries(log: DataFrame) -> DataFrame:
    """Entries worth clustering (warning and above) with their features."""
    rows = log.withColumn("severity", T.severity(F.col("text"))).where(F.col("severity").isin(V.CLUSTERED_SEVERITIES))
    text = F.col("text")
    return rows.select(
        NS, "source_file", "ord", "text", "severity",
        T.entry_timestamp(text).alias("ts"),
        T.error_signature(text).alias("signature"),
        T.exception_type(text).alias("exception_type"),
        T.stack_frames(text).alias("frames"),
        T.file_line_refs(text).alias("refs"),
        T.function_refs(text).alias("functions"),
        T.normalise_error(text).alias("norm"),
        T.basename(F.col("source_file")).alias("file_name"),
    )


def _severity_rank(c: Column) -> Column:
    return T.lookup(c, V.SEVERITY_ORDER, 0)


PLACE_BITS = 1 << 31  # a place in an entry is an int, so it always fits


def _place(ord_: Column, idx: Column) -> Column:
    """Position of a value: its entry, then its place in the entry, as one number.

    Numbers keep the aggregate hashed; a struct or text buffer would make every task sort its facts.
    """
    return (ord_.cast("decimal(20,0)") * F.lit(PLACE_BITS) + idx.cast("int")).cast("decimal(38,0)")


def _entry_of(place: str) -> Column:
    return F.expr(f"cast({place} div {PLACE_BITS} as bigint)")


def signature_facts(entries: DataFrame) -> DataFrame:
    """namespace, signature, kind, value -> n, first (place), first_ts, last_ts, sev (rank).

    kind 'entry' has one row per signature; 'file', 'function', 'frame', 'message' one per distinct value.
    """
    def fact(kind: str, value: Column, idx: Column) -> Column:
        return F.struct(F.lit(kind).alias("kind"), value.alias("value"), idx.cast("int").alias("idx"))

    def facts(kind: str, values: Column) -> Column:
        return F.transform(values, lambda v, i: fact(kind, v, i))

    files = F.array_distinct(F.concat(
        F.array("file_name"), F.transform("refs", lambda r: T.basename(r["file"]))))
    everything = F.concat(
        F.array(fact("entry", F.lit(""), F.lit(0)), fact("message", F.col("norm"), F.lit(0))),
        facts("file", F.filter(files, lambda f: f != "")),
        facts("function", F.col("functions")),
        facts("frame", F.col("frames")),
    )
    rows = entries.select(NS, "signature", "ord", "ts", _severity_rank(F.col("severity")).alias("sev"), F.explode(everything).alias("f"))
    rows = rows.select(NS, "signature", "f.kind", "f.value", "ts", "sev", _place(F.col("ord"), F.col("f.idx")).alias("place"))
    return rows.groupBy(NS, "signature", "kind", "value").agg(
        F.count(F.lit(1)).alias("n"), F.min("place").alias("first"), F.min("ts").alias("first_ts"),
        F.max("ts").alias("last_ts"), F.max("sev").alias("sev"))


def signature_groups(facts: DataFrame) -> DataFrame:
    """One row per exact signature: n, first position, time range, worst severity."""
    severity = T.lookup(F.col("sev"), {rank: name for name, rank in V.SEVERITY_ORDER.items()})
    return facts.where(F.col("kind") == "entry").select(
        NS, "signature", "n", _entry_of("first").alias("pos"), "first_ts", "last_ts", severity.alias("severity"))


def signature_frames(facts: DataFrame) -> DataFrame:
    """Distinct frames per signature, keyed by the signature's first position."""
    pos = signature_groups(facts).select(NS, "signature", "pos")
    return facts.where(F.col("kind") == "frame").select(NS, "signature", F.col("value").alias("frame")).join(
        pos, [NS, "signature"])


# ---- similarity -------------------------------------------------------------------------


def _rarest_first(df: DataFrame, item: str, keep: Column, out: str) -> DataFrame:
    """Per (namespace, pos) the ``keep`` rarest items; two sets alike enough always share one of these.

    A group is the tokens of one signature, at most a hundred characters."""
    freq = df.groupBy(NS, item).agg(F.count(F.lit(1)).alias("_df"))
    w = Window.partitionBy(NS, "pos").orderBy("_df", item)
    size = F.count(F.lit(1)).over(Window.partitionBy(NS, "pos"))
    ranked = df.join(freq, [NS, item]).withColumn("_n", size).withColumn("_rank", F.row_number().over(w))
    return ranked.where(F.col("_rank") <= keep).select(NS, "pos", F.col(item).alias(out))


def similarity_keys(groups: DataFrame, frames: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(keys, frame_keys): join keys under which every similar pair of signatures meets.

    msg: the rarest half (plus one) of the tokens; exc: the type itself against every tail of the
    other type that ends in an exception word; frames: all but the most common frame.
    """
    msg = groups.where(F.col("signature").startswith("msg:")).select(
        NS, "pos", F.explode(T.tokens(T.clean_signature(F.col("signature")))).alias("token"))
    token_keys = _rarest_first(msg, "token", F.floor(F.col("_n") / 2) + 1, "key").select(
        NS, "pos", F.concat(F.lit("t:"), "key").alias("key"), F.lit("both").alias("role"))
    exc = groups.where(F.col("signature").startswith("exc:")).select(
        NS, "pos", T.clean_signature(F.col("signature")).alias("type"))
    whole = exc.select(NS, "pos", F.concat(F.lit("x:"), "type").alias("key"), F.lit("part").alias("role"))
    tails = exc.select(NS, "pos", F.explode(exception_tails(F.col("type"))).alias("key")).select(
        NS, "pos", F.concat(F.lit("x:"), "key").alias("key"), F.lit("whole").alias("role"))
    # Two shared frames include one that is not the most common frame of the signature. Found with an
    # aggregate: a signature may have any number of frames.
    common = frames.join(frames.groupBy(NS, "frame").agg(F.count(F.lit(1)).alias("_df")), [NS, "frame"])
    top = common.groupBy(NS, "pos").agg(F.max(F.struct("_df", "frame"))["frame"].alias("_top"))
    frame_keys = frames.select(NS, "pos", "frame").join(top, [NS, "pos"]).where(F.col("frame") != F.col("_top")).select(
        NS, "pos", F.col("frame").alias("key"))
    return token_keys.unionByName(whole).unionByName(tails), frame_keys


def exception_tails(name: Column) -> Column:
    """Every substring ending where an exception word ends; a contained type name is always one of them."""
    low = F.lower(name)

    def ends_of(word: str) -> Column:
        starts = F.filter(F.sequence(F.lit(1), F.length(low)), lambda i: F.substr(low, i, F.lit(len(word))) == word)
        return F.transform(starts, lambda i: i + (len(word) - 1))

    def tails_to(end: Column) -> Column:
        return F.transform(F.sequence(F.lit(1), end), lambda start: F.substr(name, start, end - start + 1))

    ends = F.flatten(F.array(*[ends_of(w) for w in V.EXCEPTION_WORDS]))
    return F.array_distinct(F.flatten(F.transform(ends, tails_to)))


@dataclass
class SimilarityIndex:
    groups: DataFrame
    keys: DataFrame
    frame_keys: DataFrame
    frames: DataFrame

    def pairs(self, left: DataFrame) -> DataFrame:
        """(namespace, a, b): similar signatures with ``a`` in ``left`` (namespace, pos), in either order.

        Rows made per key are (left signatures) x (signatures), so the caller bounds them by keeping
        ``left`` small; no key ever pairs its whole group with itself.
        """
        mine = left.select(NS, "pos")
        return self.meet(self.keys.join(mine, [NS, "pos"]), self.keys, self.frame_keys.join(mine, [NS, "pos"]), self.frame_keys)

    def meet(self, keys_a: DataFrame, keys_b: DataFrame, frames_a: DataFrame, frames_b: DataFrame) -> DataFrame:
        """(namespace, a, b): similar signatures that share a key of the given ones, in either order."""
        sig_a = self.groups.select(NS, F.col("pos").alias("a"), F.col("signature").alias("sig_a"))
        sig_b = self.groups.select(NS, F.col("pos").alias("b"), F.col("signature").alias("sig_b"))
        ka = keys_a.select(NS, F.col("pos").alias("a"), "key", F.col("role").alias("role_a"))
        kb = keys_b.select(NS, F.col("pos").alias("b"), "key", F.col("role").alias("role_b"))
        opposite = (F.col("role_a") == "both") | (F.col("role_a") != F.col("role_b"))
        met = ka.join(kb, [NS, "key"]).where((F.col("a") != F.col("b")) & opposite).select(NS, "a", "b").distinct()
        alike = met.join(sig_a, [NS, "a"]).join(sig_b, [NS, "b"]).where(
            T.signature_similarity(F.col("sig_a"), F.col("sig_b")) >= MERGE_SIMILARITY).select(NS, "a", "b")
        fa = frames_a.select(NS, F.col("pos").alias("a"), "key")
        fb = frames_b.select(NS, F.col("pos").alias("b"), "key")
        met_frames = fa.join(fb, [NS, "key"]).where(F.col("a") != F.col("b")).select(NS, "a", "b").distinct()
        shared = (
            met_frames
            .join(self.frames.select(NS, F.col("pos").alias("a"), "frame"), [NS, "a"])
            .join(self.frames.select(NS, F.col("pos").alias("b"), "frame"), [NS, "b", "frame"])
            .groupBy(NS, "a", "b").agg(F.count(F.lit(1)).alias("shared"))
            .where(F.col("shared") >= SHARED_FRAMES).select(NS, "a", "b"))
        return alike.unionByName(shared).distinct()


def similarity_index(facts: DataFrame) -> SimilarityIndex:
    groups = signature_groups(facts)
    frames = signature_frames(facts)
    keys, frame_keys = similarity_keys(groups, frames)
    return SimilarityIndex(groups, cut(keys, "keys"), cut(frame_keys, "frame-keys"), frames)


def signature_pairs(facts: DataFrame) -> DataFrame:
    """Similar signatures, first-seen one as ``a`` (the full list is the result asked for here)."""
    index = similarity_index(facts)
    pairs = index.pairs(index.groups).where(F.col("a") < F.col("b"))
    named = index.groups.select(NS, "pos", "signature")
    return (
        pairs.join(named.select(NS, F.col("pos").alias("a"), F.col("signature").alias("sig_a")), [NS, "a"])
        .join(named.select(NS, F.col("pos").alias("b"), F.col("signature").alias("sig_b")), [NS, "b"])
        .withColumn("similarity", T.signature_similarity(F.col("sig_a"), F.col("sig_b")))
        .select(NS, "sig_a", "sig_b", "similarity"))


# ---- clusters ---------------------------------------------------------------------------


def _settled(edges: DataFrame, ready: DataFrame, batch: int) -> DataFrame:
    """Leaders (namespace, pos) among ``ready``, whose smaller similar signatures are all in ``edges`` (a < b).

    Who has no smaller one leads at once, and whoever is similar to such a leader does not. The first ``batch`` others of each
    namespace are walked in order; who hangs on a signature that is not settled waits.
    """
    b = [NS, "b"]
    first = ready.join(edges.select(NS, F.col("b").alias("pos")).distinct(), [NS, "pos"], "left_anti")
    taken = edges.join(first.select(NS, F.col("pos").alias("a")), [NS, "a"], "left_semi").select(*b).distinct()
    rest = ready.join(edges.select(NS, F.col("b").alias("pos")).distinct(), [NS, "pos"], "left_semi").join(
        taken.select(NS, F.col("b").alias("pos")), [NS, "pos"], "left_anti")
    walked = first_n(rest, [NS], [F.col("pos")], batch).select(NS, "pos")
    open_edges = edges.join(walked.select(NS, F.col("pos").alias("b")), b, "left_semi").join(
        taken.select(NS, F.col("b").alias("a")), [NS, "a"], "left_anti")
    inside = open_edges.join(walked.select(NS, F.col("pos").alias("a"), F.lit(True).alias("known")), [NS, "a"], "left")
    near = inside.groupBy(NS, F.col("b").alias("pos")).agg(
        F.collect_set("a").alias("near"), F.bool_or(F.col("known").isNull()).alias("hangs"))
    none = F.array().cast("array<bigint>")
    rows = walked.join(near, [NS, "pos"], "left").groupBy(NS).agg(F.array_sort(F.collect_list(F.struct(
        "pos", F.coalesce("near", none).alias("near"), F.coalesce("hangs", F.lit(False)).alias("hangs")))).alias("rows"))
    start = F.struct(none.alias("led"), none.alias("waits"))

    def step(acc: Column, r: Column) -> Column:
        leads = F.struct(F.array_append(acc["led"], r["pos"]).alias("led"), acc["waits"].alias("waits"))
        waits = F.struct(acc["led"].alias("led"), F.array_append(acc["waits"], r["pos"]).alias("waits"))
        return F.when(F.arrays_overlap(acc["led"], r["near"]), acc).when(
            r["hangs"] | F.arrays_overlap(acc["waits"], r["near"]), waits).otherwise(leads)

    later = rows.select(NS, F.explode(F.aggregate("rows", start, step)["led"]).alias("pos"))
    return first.unionByName(later)


def leader_merge(facts: DataFrame, batch: int = BATCH) -> DataFrame:
    """namespace, signature, pos, leader: signatures in first-seen order; an unclaimed one leads and
    claims every later similar one.

    In rounds: of every join key the first ``batch`` open signatures meet. A signature that is among them in all its keys
    knows every smaller open one it is similar to, so many leaders are settled in one round, wherever they stand in the
    namespace; what is similar to a leader leaves. A round is needed per ``batch`` open signatures of one key, not of a namespace.
    In the end everyone goes to the earliest leader it is similar to, as in the one-by-one walk.
    """
    index = similarity_index(facts)
    groups = index.groups.select(NS, "pos")
    keys = index.keys.select(NS, "pos", F.col("key"), "role").unionByName(
        index.frame_keys.select(NS, "pos", F.concat(F.lit("f:"), "key").alias("key"), F.lit("frame").alias("role")))
    open_, links, led = groups, None, None
    while True:
        mine = keys.join(open_, [NS, "pos"]) if led is not None else keys
        early = cut(first_n(mine, [NS, "key"], [F.col("pos"), F.col("role")], batch, rank="place"), "early")
        held = mine.groupBy(NS, "pos").agg(F.count(F.lit(1)).alias("all")).join(
            early.groupBy(NS, "pos").agg(F.count(F.lit(1)).alias("seen")), [NS, "pos"], "left")
        late = held.where("seen is null or seen < all").select(NS, "pos")
        words = early.where("role <> 'frame'")
        frames = early.where("role = 'frame'").withColumn("key", F.substring("key", 3, 1 << 30))
        edges = cut(index.meet(words, words, frames, frames).where(F.col("a") < F.col("b")), "edges")
        leaders = cut(_settled(edges, open_.join(late, [NS, "pos"], "left_anti"), batch), "leaders")
        near = cut(index.pairs(leaders).where(F.col("a") < F.col("b")), "claimed")
        links = near if links is None else links.unionByName(near)
        led = leaders if led is None else led.unionByName(leaders)
        gone = leaders.unionByName(near.select(NS, F.col("b").alias("pos")).distinct())
        open_ = cut(open_.join(gone, [NS, "pos"], "left_anti"), "open")
        if open_.isEmpty():
            break
    claimed = links.groupBy(NS, F.col("b").alias("pos")).agg(F.min("a").alias("leader"))
    own = led.withColumn("leader", F.col("pos"))
    done = own.unionByName(claimed.join(led, [NS, "pos"], "left_anti"))
    return index.groups.select(NS, "signature", "pos").join(done, [NS, "pos"])


def number_clusters(merged: DataFrame) -> DataFrame:
    """cluster_id per signature; ids count leaders (one row per cluster) in first-seen order."""
    leaders = merged.select(NS, "leader").distinct()
    ids = leaders.withColumn("cluster_id", F.row_number().over(Window.partitionBy(NS).orderBy("leader")))
    return merged.join(ids, [NS, "leader"]).select(NS, "signature", "pos", "leader", "cluster_id")


@dataclass
class Clusters:
    """The log, its facts and cluster membership; the latter two written once and shared by the profile jobs."""

    log: DataFrame
    facts: DataFrame
    members: DataFrame


def cluster_errors(log: DataFrame, merge: bool = True, batch: int = BATCH) -> Clusters:
    facts = cut(signature_facts(error_entries(log)), "facts")
    if merge:
        merged = leader_merge(facts, batch)
    else:
        merged = signature_groups(facts).select(NS, "signature", "pos", F.col("pos").alias("leader"))
    return Clusters(log, facts, cut(number_clusters(merged), "members"))


def _of_kind(c: Clusters, kind: str) -> DataFrame:
    return c.facts.where(F.col("kind") == kind).join(c.members, [NS, "signature"])


def cluster_core(c: Clusters) -> DataFrame:
    """count, modal signature and exception type (ties: first seen), time range, worst severity."""
    rows = signature_groups(c.facts).drop("pos").join(c.members, [NS, "signature"])
    weight = F.struct(F.col("n"), (-F.col("pos")).alias("p"))
    exc = F.when(F.col("signature").startswith("exc:"), T.clean_signature(F.col("signature")))
    return rows.groupBy(NS, "cluster_id").agg(
        F.sum("n").alias("count"),
        F.max_by("signature", weight).alias("primary_signature"),
        F.coalesce(F.max_by(exc, F.when(exc.isNotNull(), weight)), F.lit("")).alias("exception_type"),
        F.min("first_ts").alias("first_seen"),
        F.max("last_ts").alias("last_seen"),
        F.max_by("severity", _severity_rank(F.col("severity"))).alias("severity"),
    ).withColumn("error_signature", T.clean_signature(F.col("primary_signature")))


def cluster_values(c: Clusters, kind: str, n: int = 10) -> DataFrame:
    """First ``n`` distinct files or functions of each cluster in name order."""
    rows = _of_kind(c, kind).select(NS, "cluster_id", "value").distinct()
    return first_n(rows, [NS, "cluster_id"], [F.col("value")], n)


def cluster_samples(c: Clusters, n: int = 3) -> DataFrame:
    """First lines of the first entries with distinct normalised text, in member order.

    Only the chosen entries' texts are fetched, from the log, by their position.
    """
    seen = F.struct(F.col("pos"), F.col("first"))
    rows = _of_kind(c, "message").groupBy(NS, "cluster_id", "value").agg(F.min(seen).alias("seen"))
    top = first_n(rows, [NS, "cluster_id"], [F.col("seen")], n).select(
        NS, "cluster_id", "rank", _entry_of("seen.first").alias("ord"))
    lines = c.log.select(NS, "ord", F.substring(T.first_line(F.col("text")), 1, 150).alias("sample"))
    return top.join(lines, [NS, "ord"]).select(NS, "cluster_id", "rank", "sample")


def common_frames(c: Clusters, n: int = 5) -> DataFrame:
    """Of the ``n`` most frequent frames of a cluster, those seen at least twice."""
    seen = F.struct(F.col("pos"), F.col("first"))
    rows = _of_kind(c, "frame").groupBy(NS, "cluster_id", "value").agg(
        F.sum("n").alias("hits"), F.min(seen).alias("seen"))
    top = first_n(rows, [NS, "cluster_id"], [F.col("hits").desc(), F.col("seen")], n)
    return top.where(F.col("hits") >= 2).select(NS, "cluster_id", "rank", F.col("value").alias("frame"), "hits")


def cluster_profile(c: Clusters) -> DataFrame:
    """One row per cluster with files, functions, samples and frames as (bounded) arrays."""
    def listed(df: DataFrame, value: str, out: str) -> DataFrame:
        return df.groupBy(NS, "cluster_id").agg(ordered_list("rank", value).alias(out))

    none = F.array().cast("array<string>")
    out = cluster_core(c)
    for df, value, name in (
        (cluster_values(c, "file"), "value", "related_files"),
        (cluster_values(c, "function"), "value", "related_functions"),
        (cluster_samples(c), "sample", "sample_messages"),
        (common_frames(c), "frame", "stack_frames"),
    ):
        out = out.join(listed(df, value, name), [NS, "cluster_id"], "left").withColumn(name, F.coalesce(name, none))
    return out


def cluster_report(log: DataFrame, profile: DataFrame) -> DataFrame:
    """Per namespace: entries, clusters, entries left out, dominant cluster (ties: lowest id)."""
    totals = log.groupBy(NS).agg(F.count(F.lit(1)).alias("total_entries"))
    weight = F.struct(F.col("count"), (-F.col("cluster_id")).alias("i"))
    found = profile.groupBy(NS).agg(
        F.count(F.lit(1)).alias("cluster_count"), F.sum("count").alias("clustered"),
        F.max_by("error_signature", weight).alias("dominant_signature"),
        F.max_by("cluster_id", weight).alias("dominant_cluster_id"), F.max("count").alias("dominant_count"))
    return totals.join(found, NS, "left").select(
        NS, "total_entries", F.coalesce("cluster_count", F.lit(0)).alias("cluster_count"),
        (F.col("total_entries") - F.coalesce("clustered", F.lit(0))).alias("unclustered_count"),
        "dominant_cluster_id", "dominant_signature", "dominant_count")
