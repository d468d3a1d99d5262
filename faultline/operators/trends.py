"""Hourly error counts, spikes, repeating failures and per-cluster trends."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from faultline.functions import text as T
from faultline.functions import vocab as V
from faultline.operators.errors import NS, exception_tails
from faultline.session import cut

SPIKE_MULTIPLIER = 2.0
QUIET_GAP_HOURS = 6


def timed_severities(log: DataFrame) -> DataFrame:
    return log.select("*", T.severity(F.col("text")).alias("severity"), T.entry_timestamp(F.col("text")).alias("ts"))


def hourly_errors(log: DataFrame) -> DataFrame:
    """Errors per hour. Counting conditionally and dropping empty hours afterwards keeps the severity
    expression out of the scan filter, where it would be evaluated a second time."""
    rows = timed_severities(log).groupBy(NS, F.date_trunc("hour", "ts").alias("hour")).agg(
        F.count_if(F.col("severity").isin(V.ERROR_SEVERITIES)).alias("errors"))
    return rows.where(F.col("hour").isNotNull() & (F.col("errors") > 0))


def severity_totals(log: DataFrame) -> DataFrame:
    return timed_severities(log).groupBy(NS).agg(
        F.count(F.lit(1)).alias("entries"),
        F.count_if(F.col("severity").isin(V.ERROR_SEVERITIES)).alias("total_errors"),
        F.count_if(F.col("severity") == "warning").alias("total_warnings"),
        F.min("ts").alias("range_start"), F.max("ts").alias("range_end"))


def spikes(hourly: DataFrame) -> DataFrame:
    """Hours at or above twice the mean of the non-empty hours (input: one row per hour)."""
    means = hourly.groupBy(NS).agg(F.avg("errors").alias("mean"), F.count(F.lit(1)).alias("hours"))
    hot = hourly.join(means, NS).where(
        (F.col("hours") >= 2) & (F.col("errors") >= 2 * F.col("mean")) & (F.col("errors") >= 2))
    return hot.select(
        NS, F.col("hour").alias("start"), (F.col("hour") + F.expr("INTERVAL 1 HOUR")).alias("end"), "errors",
        F.round("mean", 2).alias("avg_rate"),
        F.when(F.col("errors") / F.col("mean") >= 3, "spike").otherwise("elevated").alias("severity"))


def repeating_failures(log: DataFrame) -> DataFrame:
    rows = timed_severities(log).where(F.col("severity").isin(V.CLUSTERED_SEVERITIES))
    rows = rows.select(NS, "ts", T.failure_signature(F.col("text")).alias("signature")).where("signature is not null")
    return rows.groupBy(NS, "signature").agg(
        F.count(F.lit(1)).alias("occurrences"), F.min("ts").alias("first_seen"), F.max("ts").alias("last_seen")
    ).where(F.col("occurrences") >= 2)


def trend_report(log: DataFrame) -> DataFrame:
    """One line of totals per namespace; the lists themselves stay in their own tables."""
    hourly = hourly_errors(log)
    n_spikes = spikes(hourly).groupBy(NS).agg(F.count(F.lit(1)).alias("spikes"))
    n_repeats = repeating_failures(log).groupBy(NS).agg(F.count(F.lit(1)).alias("repeating"))
    out = severity_totals(log).join(n_spikes, NS, "left").join(n_repeats, NS, "left").fillna(0, ["spikes", "repeating"])
    text = F.concat(
        F.lit("Time Range: "), T.ts_text(F.col("range_start")), F.lit(" → "), T.ts_text(F.col("range_end")),
        F.lit("\nTotals: "), F.col("total_errors").cast("string"), F.lit(" error(s), "),
        F.col("total_warnings").cast("string"), F.lit(" warning(s) across "), F.col("entries").cast("string"),
        F.lit(" log entries"))
    return out.select(NS, "entries", "total_errors", "total_warnings", "spikes", "repeating",
                      ((F.col("spikes") > 0) | (F.col("repeating") > 0)).alias("has_trends"), text.alias("summary"))


# ---- per-signature and per-cluster trends -----------------------------------------------


def signature_times(log: DataFrame, ref_time: Column) -> DataFrame:
    """Per clean signature over all timed entries: counts in the windows, range and largest gap.

    Equal seconds are combined before the shuffle; gaps are taken per hour, then between hours, so a
    signature holding a third of all entries never meets in one task.
    """
    ref = ref_time.cast("long")
    rows = log.select(
        NS, "ord", T.clean_signature(T.error_signature(F.col("text"))).alias("clean"),
        T.entry_timestamp(F.col("text")).cast("long").alias("s")).where("s is not null")
    seconds = rows.groupBy(NS, "clean", "s").agg(F.count(F.lit(1)).alias("n"), F.min("ord").alias("pos"))
    seconds = seconds.withColumn("h", F.floor(F.col("s") / 3600))
    w = Window.partitionBy(NS, "clean", "h").orderBy("s")
    hours = seconds.withColumn("gap", F.col("s") - F.lag("s").over(w)).groupBy(NS, "clean", "h").agg(
        F.max("gap").alias("gap"), F.min("s").alias("lo"), F.max("s").alias("hi"), F.sum("n").alias("n"),
        F.min("pos").alias("pos"),
        F.sum(F.when(F.col("s") >= ref - 3600, F.col("n")).otherwise(0)).alias("h1"),
        F.sum(F.when(F.col("s") >= ref - 86400, F.col("n")).otherwise(0)).alias("h24"),
        F.sum(F.when((F.col("s") >= ref - 172800) & (F.col("s") < ref - 86400), F.col("n")).otherwise(0)).alias("p24"))
    across = Window.partitionBy(NS, "clean").orderBy("h")
    hours = hours.withColumn("jump", F.col("lo") - F.lag("hi").over(across))
    return hours.groupBy(NS, "clean").agg(
        F.sum("n").alias("n"), F.min("pos").alias("pos"), F.min("lo").alias("first_s"), F.max("hi").alias("last_s"),
        F.sum("h1").alias("last_1h"), F.sum("h24").alias("last_24h"), F.sum("p24").alias("prev_24h"),
        F.when(F.sum("n") >= 2, F.coalesce(F.greatest(F.max("gap"), F.max("jump")), F.lit(0))).alias("max_gap_s"))


def cluster_times(core: DataFrame, times: DataFrame) -> DataFrame:
    """Times of each cluster: those of its primary signature, else of the first signature naming its type."""
    direct = core.join(times.withColumnRenamed("clean", "error_signature"), [NS, "error_signature"])
    missing = core.join(times.select(NS, F.col("clean").alias("error_signature")), [NS, "error_signature"], "left_anti")
    wanted = missing.where(F.col("exception_type") != "").withColumn("tail", F.lower("exception_type"))
    tails = times.withColumn("tail", F.explode(exception_tails(F.lower("clean"))))
    found = wanted.join(tails, [NS, "tail"])
    first = found.groupBy(NS, "cluster_id").agg(F.min("pos").alias("pos"))
    fallback = found.join(first, [NS, "cluster_id", "pos"]).dropDuplicates([NS, "cluster_id"])
    cols = [NS, "cluster_id", "n", "first_s", "last_s", "last_1h", "last_24h", "prev_24h", "max_gap_s"]
    matched = direct.select(*cols).unionByName(fallback.select(*cols))
    return core.select(NS, "cluster_id", F.col("count").alias("total")).join(matched, [NS, "cluster_id"], "left")


def label_trends(times: DataFrame, ref_time: Column) -> DataFrame:
    """pct_change, trend_label and the three flags; rows without times are 'unknown'."""
    ref = ref_time.cast("long")
    last1, last24, prev = F.col("last_1h"), F.col("last_24h"), F.col("prev_24h")
    pct = F.when(prev > 0, (last24 - prev) / prev * 100.0).when(last24 > 0, 100.0).otherwise(0.0)
    span = F.greatest(F.lit(1.0), (F.col("last_s") - F.col("first_s")) / 3600.0)
    surge = (last1 >= SPIKE_MULTIPLIER * (F.col("total") / span)) & (last1 >= 2)
    recent = F.col("last_s") >= ref - 86400
    label = (
        F.when(F.col("n").isNull(), "unknown")
        .when(surge, "spike")
        .when(F.col("first_s") >= ref - 86400, "new")
        .when(F.col("n") < 2, "stable")
        .when((F.col("max_gap_s") / 3600.0 >= QUIET_GAP_HOURS) & recent, "regression")
        .when(pct <= -30, "declining")
        .when(pct >= 50, "spike")
        .otherwise("stable"))
    out = times.withColumn("pct_change", F.when(F.col("n").isNull(), 0.0).otherwise(pct)).withColumn("trend_label", label)
    return out.fillna(0, ["last_1h", "last_24h", "prev_24h"]).select(
        NS, "cluster_id", "total", "last_1h", "last_24h", "prev_24h", "pct_change", "max_gap_s", "trend_label",
        (F.col("trend_label") == "spike").alias("spike_detected"), (F.col("trend_label") == "new").alias("is_new"),
        (F.col("trend_label") == "regression").alias("is_regression"))


def cluster_trends(core: DataFrame, log: DataFrame, ref_time: Column) -> DataFrame:
    times = cut(signature_times(log, ref_time), "times")  # read for the match and for the fallback
    return label_trends(cluster_times(core, times), ref_time)


def trend_alerts(trends: DataFrame) -> DataFrame:
    return trends.groupBy(NS).agg(
        F.count_if("spike_detected").alias("spike_count"), F.count_if("is_regression").alias("regression_count"),
        F.count_if("is_new").alias("new_error_count")
    ).withColumn("has_alerts", F.col("spike_count") + F.col("regression_count") + F.col("new_error_count") > 0)
