"""Ranking, deduplication and context bundles of retrieved rows, all keyed by query_id."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from faultline.functions import text as T
from faultline.functions import vocab as V
from faultline.functions.groups import first_n, ordered_list

Q = "query_id"
PLACE = ["source_file", "line_start", "line_end"]


# ---- boosts -----------------------------------------------------------------------------


def boosts(ref_time: Column) -> Column:
    """Sum of the signal boosts of a row."""
    text = F.coalesce("text", F.lit(""))
    return (
        F.when(F.col("chunk_kind").isin("function", "method", "class"), V.BOOST_STRUCTURE).otherwise(0.0)
        + F.when(F.coalesce("docstring", F.lit("")) != "", V.BOOST_DOC).otherwise(0.0)
        + F.when(text.rlike(V.ERROR_SIGNAL), V.BOOST_ERROR).otherwise(0.0)
        + F.when(text.rlike(V.TRACE_SIGNAL), V.BOOST_TRACE).otherwise(0.0)
        + T.recency_boost(F.col("detected_timestamp"), ref_time))


def boost_rank(hits: DataFrame, ref_time: Column) -> DataFrame:
    """Confidence with boosts and the stable rank per query; ``pos`` is the order the hits came in."""
    boost = boosts(ref_time)
    base = T.confidence_of(F.col("distance"))
    confidence = F.when(boost > 0, F.least(F.lit(1.0), F.round(base + boost, 4))).otherwise(base)
    out = hits.withColumn("confidence", confidence).withColumn("confidence_label", T.confidence_label(F.col("confidence")))
    w = Window.partitionBy(Q).orderBy(F.col("confidence").desc(), "pos")
    return out.withColumn("rank", F.row_number().over(w))


def has_relevant(ranked: DataFrame) -> DataFrame:
    """Whether the first row of each query reaches the threshold."""
    return ranked.groupBy(Q).agg((F.min_by("confidence", "rank") >= V.RELEVANT).alias("has_relevant"))


def top_relevant(ranked: DataFrame, n: int = 5) -> DataFrame:
    return first_n(ranked.where(F.col("confidence") >= V.RELEVANT), [Q], [F.col("rank")], n, rank="place")


def split_evidence(ranked: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(logs, code) with the rank kept."""
    is_log = F.col("source_type") == "log"
    return ranked.where(is_log), ranked.where(~is_log)


# ---- deduplication ----------------------------------------------------------------------


def dedup_exact(hits: DataFrame, score: str = "distance") -> DataFrame:
    """One row per query and place: the lowest score, first on ties; ``pos`` stays the first one's."""
    others = [c for c in hits.columns if c not in (Q, *PLACE, "pos")]
    best = hits.groupBy(Q, *PLACE).agg(
        F.min_by(F.struct(*others), F.struct(F.col(score), F.col("pos"))).alias("row"), F.min("pos").alias("pos"))
    return best.select(Q, *PLACE, "row.*", "pos")


def _keep(kept: Column, c: Column) -> Column:
    """One step of the overlap walk: the first kept range meeting ``c`` is replaced if ``c`` scores lower."""
    meets = F.transform(kept, lambda e: (e["line_start"] <= c["line_end"]) & (c["line_start"] <= e["line_end"]))
    at = F.array_position(meets, True)
    replaced = F.transform(kept, lambda e, i: F.when((i + 1 == at) & (c["score"] < e["score"]), c).otherwise(e))
    return F.when(at > 0, replaced).otherwise(F.array_append(kept, c))


def dedup_overlap(hits: DataFrame, score: str = "distance", better: str = "low") -> DataFrame:
    """Per query and file, walk ranges by start and keep the better of two that meet.

    The walk depends on its order, so it runs as a fold over the sorted ranges of one query and file
    (a query has at most a few dozen hits). ``pos`` is renumbered: files by first hit, then lines.
    """
    value = F.col(score).cast("double") * (1.0 if better == "low" else -1.0)
    item = F.struct(F.col("line_start").cast("bigint").alias("line_start"), F.col("line_end").cast("bigint").alias("line_end"),
                    F.col("pos").cast("bigint").alias("pos"), value.alias("score"))
    empty = F.array().cast("array<struct<line_start:bigint,line_end:bigint,pos:bigint,score:double>>")
    folded = hits.groupBy(Q, "source_file").agg(
        F.aggregate(F.array_sort(F.collect_list(item)), empty, _keep).alias("kept"), F.min("pos").alias("file_pos"))
    kept = folded.select(Q, "source_file", "file_pos", F.posexplode("kept").alias("kept_no", "k"))
    kept = kept.select(Q, "source_file", "file_pos", "kept_no", F.col("k.pos").alias("pos"))
    w = Window.partitionBy(Q).orderBy("file_pos", "kept_no")
    out = hits.join(kept, [Q, "source_file", "pos"])
    return out.withColumn("pos", F.row_number().over(w)).drop("file_pos", "kept_no")


def dedup_ranked(ranked: DataFrame) -> DataFrame:
    """Exact and overlap rules on ranked rows, higher confidence winning, ranked again."""
    rows = ranked.withColumn("pos", F.col("rank")).withColumn("_low", -F.col("confidence")).drop("rank")
    unique = dedup_overlap(dedup_exact(rows, "_low"), "confidence", better="high").drop("_low")
    w = Window.partitionBy(Q).orderBy(F.col("confidence").desc(), "pos")
    return unique.withColumn("rank", F.row_number().over(w))


def cap_evidence(ranked: DataFrame, max_logs: int = 5, max_code: int = 5) -> DataFrame:
    out = []
    for side, limit in zip(split_evidence(ranked), (max_logs, max_code)):
        out.append(dedup_ranked(side).where(F.col("rank") <= limit))
    return out[0].unionByName(out[1])


# ---- bundles ----------------------------------------------------------------------------

BUNDLED = 5


def _numbered(ranked: DataFrame, prefix: str, *columns: str) -> DataFrame:
    return ranked.select(Q, *[F.col(c).alias(f"{prefix}_{c}") for c in ("rank", *columns)])


def siblings(ranked: DataFrame, max_siblings: int = 2, top_n: int = BUNDLED) -> DataFrame:
    """For the first rows of each query: nearest rows of the same file within 100 lines."""
    p = _numbered(ranked.where(F.col("rank") <= top_n), "p", *PLACE)
    s = _numbered(ranked, "s", *PLACE)
    gap = F.least(F.abs(F.col("s_line_start") - F.col("p_line_end")), F.abs(F.col("p_line_start") - F.col("s_line_end")))
    near = p.join(s, (p[Q] == s[Q]) & (p["p_source_file"] == s["s_source_file"]) & (p["p_rank"] != s["s_rank"])).select(
        p[Q], "p_rank", "s_rank", gap.alias("gap")).where(F.col("gap") <= 100)
    return first_n(near, [Q, "p_rank"], [F.col("gap"), F.col("s_rank")], max_siblings, rank="place")


def imported_names(imports: Column) -> Column:
    """Names after the last 'import' of each line, aliases removed."""
    def names(line: Column) -> Column:
        tail = F.element_at(F.split(T.strip(line), "import"), -1)
        found = F.transform(F.split(tail, ","), lambda s: T.strip(F.substring_index(T.strip(s), " as ", 1)))
        return F.when(line.contains("import"), F.filter(found, lambda n: (n != "") & (n != "*"))).otherwise(
            F.array().cast("array<string>"))

    return F.array_distinct(F.flatten(F.transform(imports, names)))


def import_definitions(ranked: DataFrame, limit: int = 3, top_n: int = BUNDLED) -> DataFrame:
    """For the first rows of each query: rows defining a function or class they import."""
    p = ranked.where(F.col("rank") <= top_n).select(
        Q, F.col("rank").alias("p_rank"), F.explode(imported_names(F.col("imports"))).alias("name"))
    d = ranked.select(Q, F.col("rank").alias("s_rank"), F.explode(F.array_distinct(
        F.filter(F.array("function_name", "class_name"), lambda n: n != ""))).alias("name"))
    met = p.join(d, [Q, "name"]).where(F.col("p_rank") != F.col("s_rank")).select(Q, "p_rank", "s_rank").distinct()
    return first_n(met, [Q, "p_rank"], [F.col("s_rank")], limit, rank="place")


def bundles(ranked: DataFrame, max_siblings: int = 2, top_n: int = BUNDLED) -> DataFrame:
    """(query_id, bundle, role, place, rank): each primary with its siblings and import definitions.

    A first row already used in an earlier bundle (same file and start) is no primary; that walk is
    a fold over at most ``top_n`` rows per query.
    """
    key = F.concat_ws(":", "source_file", F.col("line_start").cast("string"))
    keys = ranked.select(Q, F.col("rank").alias("s_rank"), key.alias("key"))
    parts = siblings(ranked, max_siblings, top_n).select(Q, "p_rank", F.lit("sibling").alias("role"), "place", "s_rank")
    parts = parts.unionByName(import_definitions(ranked, top_n=top_n).select(
        Q, "p_rank", F.lit("import").alias("role"), "place", "s_rank"))
    used = parts.join(keys, [Q, "s_rank"]).groupBy(Q, "p_rank").agg(F.collect_set("key").alias("used"))
    heads = keys.where(F.col("s_rank") <= top_n).select(Q, F.col("s_rank").alias("p_rank"), "key").join(
        used, [Q, "p_rank"], "left")
    none = F.array().cast("array<string>")
    rows = F.array_sort(F.collect_list(F.struct("p_rank", "key", F.coalesce("used", none).alias("used"))))
    start = F.struct(none.alias("seen"), F.array().cast("array<int>").alias("kept"))

    def step(acc: Column, r: Column) -> Column:
        taken = F.struct(F.array_append(F.concat(acc["seen"], r["used"]), r["key"]).alias("seen"),
                         F.array_append(acc["kept"], r["p_rank"]).alias("kept"))
        return F.when(F.array_contains(acc["seen"], r["key"]), acc).otherwise(taken)

    primaries = heads.groupBy(Q).agg(F.aggregate(rows, start, step)["kept"].alias("kept")).select(
        Q, F.posexplode("kept").alias("bundle_no", "p_rank"))
    lead = primaries.select(Q, (F.col("bundle_no") + 1).alias("bundle"), F.lit("primary").alias("role"),
                            F.lit(1).alias("place"), F.col("p_rank").alias("rank"))
    rest = parts.join(primaries, [Q, "p_rank"]).select(Q, (F.col("bundle_no") + 1).alias("bundle"), "role", "place",
                                                       F.col("s_rank").alias("rank"))
    return lead.unionByName(rest)


def _role_order() -> Column:
    return F.when(F.col("role") == "primary", 0).when(F.col("role") == "sibling", 1).otherwise(2)


def flatten_bundles(bundled: DataFrame, ranked: DataFrame) -> DataFrame:
    """Distinct rows of the bundles in reading order, with ``place``."""
    rows = bundled.join(ranked, [Q, "rank"]).withColumn("_o", F.struct("bundle", _role_order().alias("r"), "place"))
    first = rows.groupBy(Q, *PLACE).agg(F.min_by("rank", "_o").alias("rank"), F.min("_o").alias("_o"))
    w = Window.partitionBy(Q).orderBy("_o")
    return first.withColumn("place", F.row_number().over(w)).drop("_o")


def clip(text: Column, max_chars: int) -> Column:
    return F.when(F.length(text) > max_chars, F.concat(F.substring(text, 1, max_chars), F.lit("\n[...truncated]"))).otherwise(text)


def _number(c: Column) -> Column:
    """Two decimals of a four-decimal confidence, ties up."""
    return c.cast("decimal(9,4)").cast("decimal(9,2)").cast("string")


def render_context(rows: DataFrame, order: str = "rank", max_chars: int = 800) -> DataFrame:
    """One text per query: numbered blocks of its (few) rows."""
    block = F.concat(
        F.lit("] "), F.col("source_file"), F.lit("  lines "), F.col("line_start").cast("string"), F.lit("–"),
        F.col("line_end").cast("string"), F.lit("  confidence: "), _number(F.col("confidence")), F.lit("  type: "),
        F.col("source_type"), F.lit("\n"), clip(F.col("text"), max_chars))
    blocks = F.array_sort(F.collect_list(F.struct(F.col(order).alias("o"), block.alias("b"))))
    numbered = F.transform(blocks, lambda s, i: F.concat(F.lit("["), (i + 1).cast("string"), s["b"]))
    return rows.groupBy(Q).agg(F.array_join(numbered, "\n\n---\n\n").alias("context"))


SEPARATOR = "═" * 60


def budget_context(sections: DataFrame, limit: int = 8000) -> DataFrame:
    """Join the sections of each query (query_id, ordinal, section) within ``limit`` characters.

    A section that does not fit is cut to what is left when more than 200 characters remain, else
    skipped and the next one tried.
    """
    rows = F.transform(F.array_sort(F.collect_list(F.struct("ordinal", "section"))), lambda s: s["section"])
    start = F.struct(F.array().cast("array<string>").alias("kept"), F.lit(0).alias("used"))

    def step(acc: Column, s: Column) -> Column:
        left = F.lit(limit) - acc["used"]
        cut = F.concat(F.substr(s, F.lit(1), left - 50), F.lit("\n\n[...context truncated for safety]"))

        def add(t: Column) -> Column:
            return F.struct(F.array_append(acc["kept"], t).alias("kept"), (acc["used"] + F.length(t)).alias("used"))

        return F.when(acc["used"] + F.length(s) <= limit, add(s)).when(left > 200, add(cut)).otherwise(acc)

    kept = F.aggregate(rows, start, step)["kept"]
    return sections.groupBy(Q).agg(
        F.concat(F.lit("\n\n" + SEPARATOR), F.array_join(kept, "\n\n")).alias("context"),
        F.size(kept).alias("sections"))


def evidence_section(rows: DataFrame, title: str, mark: str, names: bool, ordinal: int,
                     limit: int = 8, max_chars: int = 1200) -> DataFrame:
    """(query_id, ordinal, section) of the first rows of a query."""
    label = F.concat(F.col("source_file"), F.lit("  lines "), F.col("line_start").cast("string"), F.lit("–"),
                     F.col("line_end").cast("string"), F.lit("  confidence: "), _number(F.col("confidence")))
    if names:
        label = F.concat(label, *[
            F.when(F.coalesce(c, F.lit("")) != "", F.concat(F.lit(f"  {w}: "), F.col(c))).otherwise("")
            for w, c in (("function", "function_name"), ("class", "class_name"))])
    block = F.concat(F.lit("] "), label, F.lit("\n"), clip(F.col("text"), max_chars))
    top = first_n(rows, [Q], [F.col("rank")], limit, rank="place").select(Q, "place", block.alias("b"))
    numbered = F.transform(ordered_list("place", "b"), lambda b, i: F.concat(F.lit(f"[{mark}"), (i + 1).cast("string"), b))
    return top.groupBy(Q).agg(F.concat(F.lit(f"## {title}\n\n"), F.array_join(numbered, "\n\n---\n\n")).alias("section")).select(
        Q, F.lit(ordinal).alias("ordinal"), "section")
