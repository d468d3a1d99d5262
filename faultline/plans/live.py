"""Registered streaming queries, run over the events as a file stream."""

from __future__ import annotations

from pyspark.sql import functions as F

from faultline.functions import vocab as V
from faultline.plans import oracle as O
from faultline.plans import views
from faultline.plans.registry import Catalog, stamp
from faultline.streaming import logs as S

C = Catalog()
NS = "namespace"


def _entries(spark, sf):
    return S.stream_log_entries(views.entries_of(views.event_stream(spark, sf)))


_ST = O.LOG_VIEW + f""",
se AS (SELECT namespace, source_file, {O.entry_ts('text')} AS ts, {O.severity('text')} AS severity, {O.ingest_severity('text')} AS stored_severity, {O.signature('text')} AS signature FROM log_view)"""


@C.add("Z1_stream_log_entries", O.sql(_ST, f"SELECT namespace, source_file, {O.ts_text('ts')} AS ts, severity, stored_severity, signature FROM se"))
def stream_log_entries(spark, sf):
    return S.run_available(_entries(spark, sf), "entries").select(NS, "source_file", stamp("ts"), "severity", "stored_severity", "signature")


@C.add("Z2_stream_hourly_errors", O.sql(_ST, f"""
SELECT namespace, {O.ts_text("date_trunc('hour', ts)")} AS hour, count(*) AS errors FROM se WHERE severity IN ({O.lits(V.ERROR_SEVERITIES)})
AND date_trunc('hour', ts) + INTERVAL 1 HOUR <= (SELECT max(ts) FROM se) - INTERVAL 10 MINUTE GROUP BY ALL"""))
def stream_hourly_errors(spark, sf):
    return S.run_available(S.stream_hourly_errors(_entries(spark, sf)), "hours").select(NS, stamp("hour"), "errors")


@C.add("Z3_stream_incidents", O.sql(_ST + """,
sb AS (SELECT *, CASE WHEN date_diff('second', lag(ts) OVER (PARTITION BY namespace ORDER BY ts), ts) <= 300 THEN 0 ELSE 1 END AS b FROM se),
ss AS (SELECT *, sum(b) OVER (PARTITION BY namespace ORDER BY ts ROWS UNBOUNDED PRECEDING) AS s FROM sb)""", f"""
SELECT namespace, {O.ts_text('min(ts)')} AS start_time, {O.ts_text('max(ts)')} AS end_time, count(*) AS entries FROM ss GROUP BY namespace, s
HAVING max(ts) + INTERVAL 5 MINUTE <= (SELECT max(ts) FROM se) - INTERVAL 10 MINUTE"""))
def stream_incidents(spark, sf):
    out = S.run_available(S.stream_incidents(_entries(spark, sf)), "incidents")
    return out.select(NS, stamp("start_time"), stamp("end_time"), "entries")


# A run ends where six hours pass without a row; a minute counts once the watermark has passed it.
_RUNS = _ST + f""",
mark AS (SELECT max(ts) - INTERVAL 10 MINUTE AS w FROM se WHERE severity IN ({O.lits(V.CLUSTERED_SEVERITIES)})),
sg AS (SELECT namespace, signature, ts, date_trunc('minute', ts) AS minute FROM se, mark WHERE severity IN ({O.lits(V.CLUSTERED_SEVERITIES)}) AND date_trunc('minute', ts) + INTERVAL 1 MINUTE <= w),
sb AS (SELECT *, CASE WHEN date_diff('second', lag(ts) OVER (PARTITION BY namespace, signature ORDER BY ts), ts) < 21600 THEN 0 ELSE 1 END AS b FROM sg),
sr AS (SELECT *, sum(b) OVER (PARTITION BY namespace, signature ORDER BY ts ROWS UNBOUNDED PRECEDING) AS run FROM sb),
rs AS (SELECT namespace, signature, run, min(ts) AS first_ts, max(ts) AS last_ts FROM sr GROUP BY ALL),
ev AS (SELECT namespace, signature, CASE WHEN run = 1 THEN 'new' ELSE 'regression' END AS kind, first_ts AS at_ts, date_trunc('minute', first_ts) AS upto FROM rs
  UNION ALL SELECT namespace, signature, 'quiet', last_ts + INTERVAL 6 HOUR, date_trunc('minute', last_ts) FROM rs, mark WHERE last_ts + INTERVAL 6 HOUR <= w)"""


@C.add("Z4_stream_signature_state", O.sql(_RUNS, f"""
SELECT e.namespace, e.signature, e.kind, {O.ts_text('e.at_ts')} AS at_time, count(*) AS n,
  count(*) FILTER (WHERE minute > date_trunc('minute', at_ts) - INTERVAL 60 MINUTE) AS last_1h, count(*) FILTER (WHERE minute > date_trunc('minute', at_ts) - INTERVAL 1440 MINUTE) AS last_24h
FROM ev e JOIN sg s ON s.namespace = e.namespace AND s.signature = e.signature AND s.minute <= e.upto GROUP BY e.namespace, e.signature, e.kind, e.at_ts"""))
def stream_signature_state(spark, sf):
    out = S.run_available(S.stream_signature_state(_entries(spark, sf)), "signatures")
    return out.select(NS, "signature", "kind", stamp(F.col("at"), "at_time"), "n", "last_1h", "last_24h")
