"""Per-file statistics and the weighted scores over clusters and retrieved rows."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from faultline.functions import text as T
from faultline.functions import vocab as V
from faultline.functions.groups import first_n, ordered_list

NS = "namespace"


# ---- files ------------------------------------------------------------------------------


def file_error_stats(chunks: DataFrame, keys: list[str]) -> DataFrame:
    """Severity counts per file name; ``severity`` is the stored one."""
    sev = F.coalesce("severity", F.lit("info"))
    name = F.coalesce(F.nullif(F.col("file_name"), F.lit("")), T.basename(F.col("source_file")))
    out = chunks.groupBy(*keys, name.alias("file_name")).agg(
        F.count_if(sev == "error").alias("error_count"), F.count_if(sev == "warning").alias("warning_count"),
        F.count_if(~sev.isin("error", "warning")).alias("info_count"), F.count(F.lit(1)).alias("total_chunks"))
    return out.withColumn("severity_score", F.col("error_count") * 3 + F.col("warning_count"))


def _plural(n: Column, word: str) -> Column:
    return F.when(n > 0, F.concat(n.cast("string"), F.lit(" " + word), F.when(n > 1, "s").otherwise("")))


def file_lines(stats: DataFrame, keys: list[str]) -> DataFrame:
    """Report line of each file; sort by error_count, warning_count (both down) and name to print."""
    part = F.concat_ws(", ", _plural(F.col("error_count"), "error"), _plural(F.col("warning_count"), "warning"))
    line = F.concat(F.lit("  "), F.col("file_name"), F.lit(" — "), F.when(part == "", "info only").otherwise(part))
    return stats.select(*keys, "file_name", "error_count", "warning_count", line.alias("line"))


def file_report(stats: DataFrame, keys: list[str]) -> DataFrame:
    """Totals, dominant file and closing line per group (input: one row per file)."""
    place = F.struct((-F.col("error_count")).alias("e"), (-F.col("warning_count")).alias("w"), F.col("file_name"))
    out = stats.groupBy(*keys).agg(
        F.count(F.lit(1)).alias("files_affected"), F.sum("error_count").alias("total_errors"),
        F.sum("warning_count").alias("total_warnings"), F.count_if(F.col("error_count") > 0).alias("files_with_errors"),
        F.min_by("file_name", place).alias("_top"), F.max("error_count").alias("_top_errors"))
    dominant = F.when(F.col("_top_errors") > 0, F.col("_top"))
    closing = F.when((F.col("files_affected") > 1) & (F.col("total_errors") > 0), F.concat(
        F.lit("Dominant error source: "), dominant, F.lit(" ("), F.col("_top_errors").cast("string"), F.lit("/"),
        F.col("total_errors").cast("string"), F.lit(" errors)")))
    return out.select(*keys, "files_affected", "total_errors", "total_warnings", "files_with_errors",
                      dominant.alias("dominant_file"), closing.alias("closing_line"))


def severity_distribution(rows: DataFrame, keys: list[str]) -> DataFrame:
    sev = T.severity(F.col("text"))
    counts = [F.count_if(sev == s).alias(s) for s in V.SEVERITY_WEIGHT]
    return rows.groupBy(*keys).agg(*counts).withColumn(
        "high_severity", F.col("fatal") + F.col("critical") + F.col("error"))


# ---- confidence of a retrieved set ------------------------------------------------------


def _steps(c: Column, table: list[tuple[float, float]], default: float) -> Column:
    """Value of the first threshold (highest first) that ``c`` reaches."""
    expr = F.when(c >= table[0][0], table[0][1])
    for threshold, value in table[1:]:
        expr = expr.when(c >= threshold, value)
    return expr.otherwise(default)


def is_broad(question: Column) -> Column:
    return T.matches_any(question, V.BROAD)


def retrieval_confidence(rows: DataFrame, questions: DataFrame, ref_time: Column) -> DataFrame:
    """Score per query over its ranked rows (query_id, rank, confidence, text, source_file)."""
    sev = T.severity(F.col("text"))
    age_h = (ref_time.cast("long") - T.entry_timestamp(F.col("text")).cast("long")) / 3600.0
    recency = F.when(age_h < 1, 1.0).when(age_h < 24, 0.8).when(age_h < 168, 0.5).when(age_h.isNotNull(), 0.2)
    f = rows.groupBy("query_id").agg(
        F.count(F.lit(1)).alias("n"), F.min_by("confidence", "rank").alias("top"), F.avg("confidence").alias("mean"),
        F.max(T.lookup(sev, V.SEVERITY_WEIGHT, 0.15)).alias("severity"), F.avg(recency).alias("recent"),
        F.count_if(sev.isin(V.ERROR_SEVERITIES)).alias("high"),
        F.count_distinct(F.nullif(T.basename(F.col("source_file")), F.lit(""))).alias("files"))
    f = questions.select("query_id", is_broad(F.col("question")).alias("broad")).join(f, "query_id", "left")
    factors = {
        "similarity": 0.6 * F.col("top") + 0.4 * F.col("mean"),
        "volume": _steps(F.col("n"), [(8, 1.0), (5, 0.85), (3, 0.65), (1, 0.3)], 0.0),
        "severity": F.col("severity"),
        "recency": F.coalesce("recent", F.lit(0.5)),
        "pattern": _steps(F.col("high"), [(3, 1.0), (2, 0.75), (1, 0.5)], 0.2),
        "cross_file": _steps(F.col("files"), [(4, 1.0), (3, 0.85), (2, 0.65), (1, 0.40)], 0.20),
    }
    total = F.lit(0.0)
    for name, value in factors.items():
        weight = F.when(F.col("broad"), V.CONFIDENCE_WEIGHTS["broad"][name]).otherwise(
            V.CONFIDENCE_WEIGHTS["specific"][name])
        total = total + weight * value
    score = F.when(F.col("n").isNull(), 0.0).otherwise(F.round(F.greatest(F.lit(0.0), F.least(F.lit(1.0), total)), 4))
    level = F.when(score >= 0.65, "high").when(score >= 0.40, "medium").otherwise("low")
    return f.select("query_id", "broad", F.coalesce("n", F.lit(0)).alias("n"),
                    *[F.round(v, 4).alias(k) for k, v in factors.items()], score.alias("score"), level.alias("level"))


# ---- causal confidence ------------------------------------------------------------------


def causal_factors(profile: DataFrame, trends: DataFrame, evidence: DataFrame | None = None) -> DataFrame:
    """Five factors per namespace from cluster profiles and trends.

    ``evidence`` may give code_chunks, references, dependencies, linked per namespace (default none).
    """
    c = profile.select(
        NS, "cluster_id", "count", "error_signature", "severity",
        F.size("stack_frames").alias("frames"), F.size("related_functions").alias("functions"),
        F.size("related_files").alias("files"))
    weight = F.struct(F.col("count"), (-F.col("cluster_id")).alias("i"))
    g = c.groupBy(NS).agg(
        F.count(F.lit(1)).alias("clusters"), F.sum("count").alias("clustered"),
        F.max_by(F.struct("cluster_id", "count", "error_signature", "severity", "frames", "files"), weight).alias("dom"),
        F.count_if(F.col("frames") > 0).alias("with_frames"), F.count_if(F.col("functions") > 0).alias("with_functions"))
    t = trends.select(NS, "cluster_id", "trend_label", "last_1h")
    alerts = trends.groupBy(NS).agg(F.count_if("spike_detected").alias("spike_count"))
    g = g.withColumn("cluster_id", F.col("dom.cluster_id")).join(t, [NS, "cluster_id"], "left").join(alerts, NS, "left")
    if evidence is None:
        for name in ("code_chunks", "references", "dependencies"):
            g = g.withColumn(name, F.lit(0))
        g = g.withColumn("linked", F.lit(False))
    else:
        g = g.join(evidence, NS, "left").fillna(0, ["code_chunks", "references", "dependencies"]).fillna(False, ["linked"])
    one = F.lit(1.0)
    share = F.col("dom.count") / F.col("clustered")
    frequency = F.when(F.col("dom.count") >= 5, F.least(one, share + 0.1)).otherwise(share)
    stack = F.least(one, 0.4 * F.col("with_frames") / F.col("clusters") + 0.3 * F.col("with_functions") / F.col("clusters")
                    + 0.3 * F.least(one, F.col("dom.frames") / 3))
    code = (F.when(F.col("linked"), 0.4).otherwise(0.0) + 0.3 * F.least(one, F.col("references") / 5)
            + 0.3 * F.least(one, F.col("code_chunks") / 5) + F.when(F.col("dom.files") > 0, 0.1).otherwise(0.0))
    dependency = (
        F.when(F.col("dependencies") == 0, 0.1).when(F.col("code_chunks") == 0, 0.2)
        .otherwise(F.least(one, 0.1 + 0.9 * F.least(one, F.col("dependencies") / F.col("code_chunks")))))
    base = T.lookup(F.col("trend_label"), V.TREND_CAUSAL_SCORE, 0.3)
    lively = F.when(F.col("last_1h") > 0, F.least(one, base + 0.1)).otherwise(base)
    trend = F.when(F.col("spike_count") > 0, F.least(one, lively + 0.1)).otherwise(lively)
    return g.select(
        NS, F.col("dom.cluster_id").alias("dominant_cluster_id"), F.col("dom.error_signature").alias("dominant_error"),
        F.col("dom.count").alias("dominant_count"), F.col("dom.severity").alias("dominant_severity"),
        frequency.alias("frequency"), stack.alias("stack_trace"), F.least(one, code).alias("code_match"),
        dependency.alias("dependency"), F.when(F.col("trend_label").isNull(), 0.3).otherwise(F.least(one, trend)).alias("trend"))


def causal_confidence(factors: DataFrame, weights: dict[str, float] | None = None) -> DataFrame:
    w = {**V.CAUSAL_WEIGHTS, **(weights or {})}
    scale = sum(w.values())
    total = F.lit(0.0)
    for name in V.CAUSAL_WEIGHTS:
        total = total + (w[name] / scale if scale > 0 else w[name]) * F.col(name)
    score = F.bround(F.greatest(F.lit(0.0), F.least(F.lit(100.0), total * 100))).cast("int")
    return factors.withColumn("score", score).withColumn(
        "level", F.when(F.col("score") >= 80, "high").when(F.col("score") >= 50, "medium").otherwise("low"))


def explain_confidence(scored: DataFrame, alerts: DataFrame | None = None,
                       weights: dict[str, float] | None = None) -> DataFrame:
    """Text per namespace: one bar line per factor, the dominant failure, active alerts."""
    w = {**V.CAUSAL_WEIGHTS, **(weights or {})}
    scale = sum(w.values()) or 1.0
    bars = []
    for name, label in V.CAUSAL_LABELS.items():
        v = F.col(name)
        bars.append(F.concat(
            F.lit("  "), F.expr(f"repeat('█', cast(floor({name} * 10) as int))"),
            F.expr(f"repeat('░', 10 - cast(floor({name} * 10) as int))"), F.lit(f" {label}: "),
            F.bround(v * 100).cast("int").cast("string"), F.lit("% (contributes "),
            F.bround(F.bround(v * (w[name] / scale) * 100, 1)).cast("int").cast("string"), F.lit(" pts)")))
    head = F.concat(F.lit("Causal Confidence: "), F.col("score").cast("string"), F.lit("/100 ("), F.col("level"), F.lit(")"))
    dominant = F.concat(F.lit('\nDominant failure: "'), F.col("dominant_error"), F.lit('" ('),
                        F.col("dominant_count").cast("string"), F.lit(" occurrences, "), F.col("dominant_severity"), F.lit(")"))
    lines = [head, *bars, dominant]
    if alerts is not None:
        scored = scored.join(alerts, NS, "left")
        active = F.concat_ws(", ", *[
            F.when(F.col(c) > 0, F.concat(F.col(c).cast("string"), F.lit(label)))
            for c, label in (("spike_count", " spike(s)"), ("regression_count", " regression(s)"),
                             ("new_error_count", " new error(s)"))])
        lines.append(F.when(active != "", F.concat(F.lit("Active alerts: "), active)))
    return scored.select(NS, "score", "level", F.concat_ws("\n", *lines).alias("explanation"))


# ---- cluster ranking --------------------------------------------------------------------


def cluster_rank(profile: DataFrame, trends: DataFrame) -> DataFrame:
    """profile plus trend columns and the rank score."""
    p = profile.join(trends.select(NS, "cluster_id", "last_1h", "last_24h", "pct_change", "trend_label"),
                     [NS, "cluster_id"], "left")
    clarity = (F.least(F.lit(1.0), F.size("related_files") / 3) + F.least(F.lit(1.0), F.size("related_functions") / 3)
               + F.least(F.lit(1.0), F.size("stack_frames") / 2))
    score = (3.0 * T.lookup(F.col("severity"), V.SEVERITY_RANK_SCORE, 1)
             + 2.0 * F.log2(F.greatest(F.lit(1), F.col("count")))
             + 2.5 * T.lookup(F.col("trend_label"), V.TREND_RANK_SCORE, 1) + 1.5 * clarity)
    return p.withColumn("rank_score", score)


def top_clusters(ranked: DataFrame, n: int = 5) -> DataFrame:
    """Best ``n`` clusters per namespace with the share of the most frequent cluster."""
    shares = ranked.groupBy(NS).agg(
        F.sum("count").alias("total_clustered"), F.count(F.lit(1)).alias("cluster_count"),
        F.round(F.max("count") / F.sum("count") * 100, 1).alias("dominant_share_pct"))
    top = first_n(ranked, [NS], [F.round("rank_score", 9).desc(), F.col("cluster_id")], n)
    return top.join(shares, NS)


def reasoning_block(top: DataFrame, explained: DataFrame, alerts: DataFrame, totals: DataFrame,
                    dependencies: DataFrame | None = None) -> DataFrame:
    """One text per namespace: score, dominant pattern, frequencies, trends, other clusters, dependencies."""
    def s(c: str) -> Column:
        return F.coalesce(F.col(c).cast("string"), F.lit("N/A"))

    first = F.concat(
        F.lit("\n## Dominant Failure Pattern\n- **Error**: "), F.col("error_signature"),
        F.lit("\n- **Exception type**: "), F.col("exception_type"), F.lit("\n- **Occurrences**: "), s("count"),
        F.lit("\n- **Severity**: "), F.col("severity"),
        F.lit("\n- **First seen**: "), F.coalesce(T.ts_text(F.col("first_seen")), F.lit("None")),
        F.lit("\n- **Last seen**: "), F.coalesce(T.ts_text(F.col("last_seen")), F.lit("None")),
        F.lit("\n- **Related files**: "), F.array_join("related_files", ", "),
        F.lit("\n- **Related functions**: "), F.array_join("related_functions", ", "),
        F.lit("\n- **Trend**: "), F.col("trend_label"))
    trend_line = F.concat(
        F.lit("  • Cluster "), s("cluster_id"), F.lit(": total="), s("count"), F.lit(", 1h="), s("last_1h"), F.lit(", 24h="),
        s("last_24h"), F.lit(", change="), F.when(F.bround("pct_change") >= 0, "+").otherwise(""),
        F.bround("pct_change").cast("int").cast("string"), F.lit("%, trend="), F.col("trend_label"))
    other = F.when(F.col("rank") > 1, F.concat(
        F.lit('- "'), F.col("error_signature"), F.lit('" × '), s("count"), F.lit(" (severity: "), F.col("severity"),
        F.lit(", trend: "), F.col("trend_label"), F.lit(")")))

    def joined(c: Column) -> Column:
        return F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("rank", c.alias("t")))), lambda r: r["t"]), "\n")

    by_id = F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("cluster_id", trend_line.alias("t")))),
                                     lambda r: r["t"]), "\n")
    g = top.groupBy(NS).agg(
        F.min_by(first, "rank").alias("first"), by_id.alias("trend_lines"), joined(other).alias("others"),
        F.max("cluster_count").alias("cluster_count"), F.max("dominant_share_pct").alias("share"))
    g = g.join(explained, NS).join(alerts, NS, "left").join(totals.select(NS, "total_entries"), NS)
    deps = F.lit(None).cast("string")
    if dependencies is not None:
        by = "no" if "no" in dependencies.columns else "dependency"
        listed = first_n(dependencies, [NS], [F.col(by)], 10).groupBy(NS).agg(
            ordered_list("rank", "dependency").alias("deps"))
        g = g.join(listed, NS, "left")
        deps = F.concat(F.lit("\n## Dependency Chain\n- "), F.array_join("deps", "\n- "))
    alert_lines = F.concat_ws("\n", *[
        F.when(F.col(c) > 0, F.concat(F.lit(mark), F.col(c).cast("string"), F.lit(label)))
        for c, mark, label in (("spike_count", "- ⚠ ", " spike(s) detected"), ("regression_count", "- 🔙 ", " regression(s)"),
                               ("new_error_count", "- 🆕 ", " newly introduced error(s)"))])
    sections = [
        F.concat(F.lit("## Causal Confidence Score: "), s("score"), F.lit("/100 ("), F.col("level"), F.lit(")")),
        F.col("first"),
        F.concat(F.lit("\n## Error Frequency Statistics\n- Total clusters: "), s("cluster_count"),
                 F.lit("\n- Total error entries: "), s("total_entries"), F.lit("\n- Dominant pattern share: "),
                 F.bround("share").cast("int").cast("string"), F.lit("%")),
        F.concat(F.lit("\n## Time-Based Trends\n"), F.concat_ws("\n", F.nullif(alert_lines, F.lit("")), F.col("trend_lines"))),
        F.when(F.col("others") != "", F.concat(F.lit("\n## Other Error Clusters\n"), F.col("others"))),
        deps,
        F.concat(F.lit("\n## Confidence Breakdown\n"), F.col("explanation")),
    ]
    return g.select(NS, "score", "level", F.concat_ws("\n", *sections).alias("block"))


def tool_confidence(calls: DataFrame, questions: DataFrame) -> DataFrame:
    """Share of successful tool calls per query, lifted from three successes on; 0.5 without calls."""
    g = calls.groupBy("query_id").agg(F.count(F.lit(1)).alias("calls"), F.count_if(~F.col("failed")).alias("ok"))
    base = F.col("ok") / F.col("calls")
    lifted = F.when(F.col("ok") >= 3, F.least(F.lit(1.0), base + 0.1)).otherwise(base)
    return questions.select("query_id").join(g, "query_id", "left").select(
        "query_id", F.coalesce("calls", F.lit(0)).alias("calls"), F.coalesce("ok", F.lit(0)).alias("successful"),
        F.coalesce(F.bround(lifted, 2), F.lit(0.5)).alias("confidence"))
