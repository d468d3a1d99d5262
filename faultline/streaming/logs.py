"""Log analytics as Structured Streaming jobs."""

from __future__ import annotations

import uuid
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StatefulProcessor

from faultline.functions import text as T
from faultline.functions import vocab as V
from faultline.session import scratch_root

NS = "namespace"
LATENESS = "10 minutes"
DAY_MINUTES, HOUR_MINUTES, QUIET_SECONDS = 1440, 60, 6 * 3600


def tail_logs(spark: SparkSession, folder: str, namespace: str) -> DataFrame:
    """Lines appended to the files of a folder, one line per event."""
    lines = spark.readStream.format("text").load(folder)
    return lines.select(F.lit(namespace).alias(NS), F.col("_metadata.file_path").alias("source_file"), F.col("value").alias("text"))


def stream_log_entries(log: DataFrame) -> DataFrame:
    """Stateless features of each line."""
    text = F.col("text")
    return log.select(
        NS, "source_file", T.entry_timestamp(text).alias("ts"), T.severity(text).alias("severity"),
        T.ingest_severity(text).alias("stored_severity"), T.error_signature(text).alias("signature"))


def stream_hourly_errors(entries: DataFrame) -> DataFrame:
    """Errors per hour; an hour comes out once no row for it can arrive any more, later rows are dropped."""
    timed = entries.where(F.col("ts").isNotNull()).withWatermark("ts", LATENESS)
    hours = timed.groupBy(NS, F.window("ts", "1 hour")).agg(
        F.count_if(F.col("severity").isin(V.ERROR_SEVERITIES)).alias("errors"))
    return hours.where(F.col("errors") > 0).select(NS, F.col("window.start").alias("hour"), "errors")


def stream_incidents(entries: DataFrame) -> DataFrame:
    """Sessions with a five-minute gap. Rows of a session are joined inside each task before the
    shuffle, so a namespace with most of the rows sends sessions, not rows."""
    timed = entries.where(F.col("ts").isNotNull()).withWatermark("ts", LATENESS)
    sessions = timed.groupBy(NS, F.session_window("ts", "5 minutes")).agg(
        F.count(F.lit(1)).alias("entries"), F.min("ts").alias("start_time"), F.max("ts").alias("end_time"))
    return sessions.select(NS, "start_time", "end_time", "entries")


_PARTIAL = "namespace string, signature string, minute bigint, n bigint, first_ts bigint, last_ts bigint"
_ALERT = "namespace string, signature string, kind string, at timestamp, n bigint, last_1h bigint, last_24h bigint"
FORGET_DAYS = 60


def _seconds(ts: pd.Series) -> pd.Series:
    return ts.to_numpy().astype("datetime64[us]").astype("int64") // 1_000_000


def _per_minute(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    for pdf in batches:
        pdf = pdf.assign(s=_seconds(pdf["ts"]))
        out = pdf.assign(minute=pdf["s"] // 60).groupby([NS, "signature", "minute"], as_index=False).agg(
            n=("s", "size"), first_ts=("s", "min"), last_ts=("s", "max"))
        yield out[[NS, "signature", "minute", "n", "first_ts", "last_ts"]]


class SignatureFollower(StatefulProcessor):
    """One signature: rows wait by minute until the watermark has passed it, then count in the order of event time.

    A first row gives ``new``, a row after six quiet hours ``regression``, six hours without rows ``quiet``. Late rows (within the
    watermark's delay) are sorted in before anything is said, so what comes out does not depend on batches. State: waiting
    minutes, and the counts of the last day; a day after the last row the counts go, after ``forget_days`` the rest.
    """

    def __init__(self, forget_days: int = FORGET_DAYS) -> None:
        self.forget = forget_days * 86400

    def init(self, handle) -> None:
        self.handle = handle
        self.waiting = handle.getMapState("waiting", "minute bigint", "n bigint, first_ts bigint, last_ts bigint")
        self.minutes = handle.getMapState("minutes", "minute bigint", "n bigint")
        self.seen = handle.getValueState("seen", "n bigint, last_ts bigint, quiet boolean, timer bigint")

    def handleInputRows(self, key, rows, timerValues):
        now = timerValues.getCurrentWatermarkInMs() // 1000
        for pdf in rows:
            for r in pdf.itertuples(index=False):
                if (r.minute + 1) * 60 <= now:
                    continue  # later than the watermark allows
                there = self.waiting.getValue((int(r.minute),)) or (0, r.first_ts, r.last_ts)
                self.waiting.updateValue((int(r.minute),), (there[0] + int(r.n), min(there[1], int(r.first_ts)), max(there[2], int(r.last_ts))))
        yield from self._advance(key, now)

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo):
        yield from self._advance(key, timerValues.getCurrentWatermarkInMs() // 1000, fired=True)

    def close(self) -> None:
        pass

    def _advance(self, key, now: int, fired: bool = False) -> Iterator[pd.DataFrame]:
        """Everything that the watermark settles, and a timer for what it settles next."""
        n, last, quiet, timer = self.seen.get() if self.seen.exists() else (0, None, True, None)
        counts = {m[0]: c[0] for m, c in self.minutes.iterator()}
        waiting = sorted((m[0], tuple(v)) for m, v in self.waiting.iterator())
        out = []

        def said(kind: str, at: int) -> None:
            minute = at // 60
            hour, day = (sum(c for m, c in counts.items() if minute - span < m <= minute) for span in (HOUR_MINUTES, DAY_MINUTES))
            out.append((*key, kind, pd.Timestamp(at, unit="s"), n, hour, day))

        for minute, (rows, first, newest) in waiting:
            if (minute + 1) * 60 > now:
                break
            back = last is not None and first - last >= QUIET_SECONDS
            if back and not quiet:
                said("quiet", last + QUIET_SECONDS)
            n, counts[minute] = n + rows, rows
            if last is None or back:
                said("new" if last is None else "regression", first)
            last, quiet = newest, False
            self.waiting.removeKey((minute,))
            self.minutes.updateValue((minute,), (rows,))
            for old in [m for m in counts if m <= minute - DAY_MINUTES]:
                del counts[old]
                self.minutes.removeKey((old,))
        if last is not None and not quiet and last + QUIET_SECONDS <= now:
            said("quiet", last + QUIET_SECONDS)
            quiet = True
        if last is not None and last + 86400 <= now:
            for m in counts:
                self.minutes.removeKey((m,))
            counts = {}
        left = [(m + 1) * 60 for m, _ in waiting if (m + 1) * 60 > now]
        if last is not None and not left and last + self.forget <= now:
            self.seen.clear()
        else:
            due = [*left[:1], *([] if last is None else [last + QUIET_SECONDS] * (not quiet) + [last + 86400] * bool(counts) + [last + self.forget])]
            due = min(d for d in due if d > now) * 1000 - 1
            if fired or timer != due:
                if timer is not None and not fired:
                    self.handle.deleteTimer(timer)
                self.handle.registerTimer(due)
            self.seen.update((n, last, quiet, due))
        yield pd.DataFrame(out, columns=[NS, "signature", "kind", "at", "n", "last_1h", "last_24h"])


def stream_signature_state(entries: DataFrame, identity: list[str] | None = None, forget_days: int = FORGET_DAYS) -> DataFrame:
    """Per signature: new, regression and quiet, each with the counts at that time.

    ``identity`` names the columns that make a row; rows delivered again within the watermark's delay then count once. Rows shrink to one per minute
    in each task first, so a signature with a third of the rows costs its state task one row per minute and partition.
    """
    followed = F.col("ts").isNotNull() & F.col("severity").isin(V.CLUSTERED_SEVERITIES)
    timed = entries.where(followed).withWatermark("ts", LATENESS)  # time goes on with the rows that are followed
    if identity:
        timed = timed.dropDuplicatesWithinWatermark(identity)
    minutes = timed.select(NS, "signature", "ts").mapInPandas(_per_minute, _PARTIAL)
    return minutes.groupBy(NS, "signature").transformWithStateInPandas(
        SignatureFollower(forget_days), _ALERT, "append", "eventTime")


def run_available(stream: DataFrame, label: str) -> DataFrame:
    """Process what is there, keep progress and output in the shared folder, return the output so far."""
    spark = stream.sparkSession
    root = f"{scratch_root(spark)}/faultline-stream-{label}-{uuid.uuid4().hex}"
    query = (
        stream.writeStream.format("parquet").option("path", f"{root}/out").option("checkpointLocation", f"{root}/progress")
        .outputMode("append").trigger(availableNow=True).start())
    query.awaitTermination()
    return spark.read.schema(stream.schema).parquet(f"{root}/out")
