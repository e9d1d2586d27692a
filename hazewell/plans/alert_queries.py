"""Queries of advice, alerts, run monitoring, lineage and artifacts."""

from __future__ import annotations

import uuid

from pyspark.sql import functions as F

from hazewell.operators import alerts as P
from hazewell.plans.registry import query as q
from hazewell.session import shared_dir
from hazewell.sources import lineage as Q
from hazewell.sources import readers

c = F.col
ASOF = "2024-01-31 00:00:00"
TA = f"TIMESTAMP '{ASOF}'"

q("health_summary", "P1", lambda t: P.health_summary(t.outlook), """
SELECT station_id, day, current, CASE WHEN current <= 12 THEN 'low' WHEN current <= 35 THEN 'moderate' WHEN current <= 55 THEN 'high' WHEN current <= 150 THEN 'very_high' ELSE 'critical' END AS risk,
  CASE WHEN path[-1] > path[1] * 1.2 THEN 'worsening' WHEN path[-1] < path[1] * 0.8 THEN 'improving' ELSE 'stable' END AS trend, list_max(path) AS peak FROM outlook""", "current peak")


def _now(t):
    last = t.outlook.agg(F.max("day").alias("last_day"))
    return t.outlook.join(last, c("day") == c("last_day"))


ADVICE = [("current <= 12", "good air", 1), ("current > 12 AND current <= 35", "moderate air", 2), ("current > 35 AND current <= 55", "unhealthy for sensitive groups", 3),
          ("current > 55 AND current <= 150", "unhealthy air", 3), ("current > 150", "hazardous air", 4), ("list_max(path) > 55", "poor air ahead", 3), ("path[-1] < path[1] * 0.8", "air improves", 1),
          ("sensitivity = 'high' AND current > 25", "high sensitivity", 3), ("activity = 'active'", "active lifestyle", 2), ("age_group = 'child'", "child safety", 3),
          ("age_group = 'elderly'", "elderly health", 3), ("condition = 'asthma'", "asthma management", 3), ("condition = 'heart_disease'", "heart precautions", 3)]
q("user_advice", "P2", lambda t: P.advice(_now(t), t.users, 10), "WITH j AS (SELECT * FROM users JOIN (SELECT * FROM outlook WHERE day = (SELECT max(day) FROM outlook)) USING (station_id)), a AS (" + " UNION ALL ".join(
    f"SELECT user_id, station_id, '{title}' AS title, {p} AS priority FROM j WHERE {cond}" for cond, title, p in ADVICE) + """)
SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY user_id ORDER BY priority DESC, title) AS rank FROM a) WHERE rank <= 10""")
EM = "SELECT station_id, day, '{k}' AS kind, '{s}' AS severity, {v} AS value, {h} AS hour FROM outlook WHERE {w}"
PEAK, PH = "list_max(path)", "list_position(path, list_max(path)) - 1"
q("emergencies", "P3", lambda t: P.emergencies(t.outlook, 120.0), " UNION ALL ".join([
    EM.format(k="emergency", s="critical", v="current", h="0", w="current >= 120"), EM.format(k="forecast_emergency", s="high", v=PEAK, h=PH, w=f"{PEAK} >= 120")]), "value")
q("threshold_alerts", "P4", lambda t: P.threshold_alerts(t.outlook), " UNION ALL ".join([
    EM.format(k="emergency", s="critical", v="current", h="0", w="current >= 150"), EM.format(k="critical", s="high", v="current", h="0", w="current >= 55 AND current < 150"),
    EM.format(k="warning", s="medium", v="current", h="0", w="current >= 35 AND current < 55"), EM.format(k="forecast_emergency", s="high", v=PEAK, h=PH, w=f"{PEAK} >= 150"),
    EM.format(k="forecast_critical", s="medium", v=PEAK, h=PH, w=f"{PEAK} >= 55 AND {PEAK} < 150")]), "value")
q("alert_expiry", "P5", lambda t: P.alert_expiry(t.alerts, ASOF).select("alert_id", "expires", "expired"), f"""
SELECT alert_id, e AS expires, e < {TA} AS expired FROM (SELECT alert_id, ts + CASE severity WHEN 'critical' THEN 24 WHEN 'high' THEN 12 ELSE 6 END * INTERVAL 1 HOUR AS e FROM alerts)""")
q("alert_channels", "P6", lambda t: P.alert_channels(t.alerts, t.users), """
SELECT alert_id, a.user_id, unnest(CASE WHEN u.user_id IS NULL THEN ['email'] ELSE list_concat(CASE WHEN email THEN ['email'] ELSE [] END, CASE WHEN sms THEN ['sms'] ELSE [] END, CASE WHEN push THEN ['push'] ELSE [] END) END) AS channel
FROM alerts a LEFT JOIN users u ON u.user_id = a.user_id""")
q("quiet_hours", "P7", lambda t: P.quiet_hours(t.alerts, t.users), """
SELECT alert_id, a.user_id, CASE WHEN quiet_start <= quiet_end THEN hour(ts) >= quiet_start AND hour(ts) < quiet_end ELSE hour(ts) >= quiet_start OR hour(ts) < quiet_end END AS quiet
FROM alerts a JOIN users u ON u.user_id = a.user_id""")
q("rate_limited_alerts", "P8", lambda t: P.rate_limit(t.alerts, 10, 50).select("alert_id", "user_id", "ts"), """
WITH h AS (SELECT *, row_number() OVER (PARTITION BY user_id, date_trunc('hour', ts) ORDER BY ts, alert_id) AS r FROM alerts),
d AS (SELECT *, row_number() OVER (PARTITION BY user_id, date_trunc('day', ts) ORDER BY ts, alert_id) AS s FROM h WHERE r <= 10)
SELECT alert_id, user_id, ts FROM d WHERE s <= 50""")
RM = """rm AS (SELECT job, count(*) AS runs, avg(CASE WHEN ok THEN 1 ELSE 0 END) * 100 AS uptime, max(ts) AS last_run, max(ts) FILTER (WHERE ok) AS lo FROM runs GROUP BY 1),
tl AS (SELECT job, avg(seconds) AS mean_seconds FROM (SELECT *, row_number() OVER (PARTITION BY job ORDER BY ts DESC, run_id DESC) AS rn FROM runs) WHERE rn <= 100 GROUP BY 1),
fr AS (SELECT r.job, count(*) AS failures_in_row FROM runs r JOIN rm ON rm.job = r.job AND r.ts > lo GROUP BY 1),
mt AS (SELECT rm.job, runs, uptime, mean_seconds, coalesce(failures_in_row, 0) AS failures_in_row, last_run FROM rm JOIN tl ON tl.job = rm.job LEFT JOIN fr ON fr.job = rm.job)"""
q("run_insights", "P9", lambda t: P.run_insights(t.runs, "2024-01-30 12:00:00"), f"""
WITH {RM} SELECT job, 'failures' AS rule, 'high' AS severity, failures_in_row AS value FROM mt WHERE failures_in_row >= 3 UNION ALL SELECT job, 'uptime', 'medium', uptime FROM mt WHERE uptime < 80
UNION ALL SELECT 'all', 'failure_share', 'high', v FROM (SELECT 1 - avg(CASE WHEN ok THEN 1 ELSE 0 END) AS v FROM runs WHERE ts >= TIMESTAMP '2024-01-30 12:00:00' - INTERVAL 24 HOUR) WHERE v > 0.1""", "value")
q("run_metrics", "P10", lambda t: P.run_metrics(t.runs), f"WITH {RM} SELECT * FROM mt", "uptime mean_seconds")


def _logged(t):
    path = shared_dir(t.spark, f"lineage-{uuid.uuid4().hex}")
    half = c("quality") > 0.1
    Q.log_lineage(t.lineage.filter(half), path)
    Q.log_lineage(t.lineage.filter(~half), path)
    return t.spark.read.parquet(path).select("event_id", "ts", "kind", "source", "station_id", "record_count")


q("lineage_append", "Q1", _logged, "SELECT event_id, ts, kind, source, station_id, record_count FROM lineage")
q("lineage_for_station", "Q2", lambda t: Q.lineage_for(t.lineage, 3, ASOF), f"SELECT * FROM lineage WHERE station_id = 3 AND ts >= {TA} - INTERVAL 7 DAY", "quality")
q("lineage_chain", "Q3", lambda t: Q.lineage_chain(t.lineage, t.lineage.filter("quality > 0.3")), """
WITH RECURSIVE ch AS (SELECT event_id, parent_event_id AS ancestor, 1 AS depth FROM lineage WHERE quality > 0.3 AND parent_event_id IS NOT NULL
  UNION ALL SELECT ch.event_id, l.parent_event_id, depth + 1 FROM ch JOIN lineage l ON l.event_id = ch.ancestor WHERE l.parent_event_id IS NOT NULL)
SELECT * FROM ch""")
q("artifact_upsert", "Q4", lambda t: Q.upsert_artifact(t.artifacts.filter("source <> '1-URGENT'"), t.artifacts.filter("source = '1-URGENT'")).select("path", "stage", "artifact_id", "created", "size_bytes"), """
SELECT path, stage, artifact_id, created, size_bytes FROM (SELECT *, row_number() OVER (PARTITION BY path, stage ORDER BY created DESC, artifact_id DESC) AS rn FROM artifacts) WHERE rn = 1""", "size_bytes")
q("artifact_search", "Q5", lambda t: Q.find_artifacts(t.artifacts, source="1-URGENT", stage="F", station_id=7).select("artifact_id", "path", "created"), """
SELECT artifact_id, path, created FROM artifacts WHERE source = '1-URGENT' AND stage = 'F' AND station_id = 7""")


def _stale(t):
    named = t.artifacts.select("artifact_id", F.when(c("stage") == "F", "events.parquet").when(c("stage") == "O", "orders.parquet").otherwise(c("path")).alias("path"))
    files = readers.list_files(t.spark, t.folder)
    return Q.stale_artifacts(named, files)


q("stale_artifacts", "Q6", _stale, "SELECT artifact_id, path FROM artifacts WHERE stage NOT IN ('F', 'O')")


def _errors(t):
    return t.events.select(
        c("event_id").alias("error_id"), "ts", F.element_at(F.array(F.lit("timeout"), F.lit("parse"), F.lit("schema")), (c("k") % 3 + 1).cast("int")).alias("error_type"),
        c("event_type").alias("operation"), (c("k") % 8 == 0).alias("recovered"))


ERR = "er AS (SELECT event_id AS error_id, ts, CASE k % 3 WHEN 0 THEN 'timeout' WHEN 1 THEN 'parse' ELSE 'schema' END AS error_type, event_type AS operation, k % 8 = 0 AS recovered FROM ev)"
q("error_rollup", "Q7", lambda t: Q.error_rollup(_errors(t)), f"""
WITH {ERR} SELECT error_type, operation, count(*) AS n, count(*) FILTER (WHERE NOT recovered) AS "open", avg(CASE WHEN recovered THEN 1 ELSE 0 END) AS recovery_rate
FROM er GROUP BY GROUPING SETS ((error_type), (operation), ())""", "recovery_rate")
q("recent_errors", "Q7", lambda t: Q.recent_errors(_errors(t)), f"WITH {ERR} SELECT * FROM er ORDER BY ts DESC, error_id DESC LIMIT 10")
