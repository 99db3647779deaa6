"""Streams over the events table, drained and read back."""

from __future__ import annotations

from pyspark.sql import functions as F

from quadrat.plans.panels import Panels, query
from quadrat.plans.projections import R
from quadrat.sources.shared import folder
from quadrat.streaming import attempts as At


@query("str_attempt_window", "w AS (SELECT strftime(time_bucket(INTERVAL 1 HOUR, ts), '%Y-%m-%d %H:%M:%S') AS start, time_bucket(INTERVAL 1 HOUR, ts) + INTERVAL 1 HOUR AS till, event_type AS backend, value FROM events) SELECT start, backend, count(*) AS attempts, round(avg(value), 6) AS latency FROM w WHERE till <= (SELECT max(ts) - INTERVAL 10 MINUTE FROM events) GROUP BY start, backend")
def str_attempt_window(p: Panels):
    """Windows that the watermark has closed."""
    out = At.drain(At.attempt_window(At.source(p.spark, p.sf_dir)), folder(p.spark))
    return out.select(F.date_format("window.start", "yyyy-MM-dd HH:mm:ss").alias("start"), "backend", "attempts", R("latency").alias("latency"))


@query("str_attempt_dedup", "SELECT event_type, count(DISTINCT user_id) AS users, count(DISTINCT user_id) AS attempts FROM events GROUP BY event_type")
def str_attempt_dedup(p: Panels):
    """Users and attempts that the stream has let through; all events come in one batch, so each user has one."""
    return At.drain(At.attempt_dedup(At.source(p.spark, p.sf_dir)), folder(p.spark)).groupBy("event_type").agg(F.count_distinct("user_id").alias("users"), F.count("*").alias("attempts"))


@query("str_state_coverage", "SELECT event_type, user_id, count(*) AS n FROM events GROUP BY ALL")
def str_state_coverage(p: Panels):
    return At.drain(At.state_coverage(At.source(p.spark, p.sf_dir)), folder(p.spark), "update", ["event_type", "user_id"])


@query("str_leak_guard", "SELECT event_id, user_id, user_id IN (SELECT user_id FROM events WHERE event_type = 'purchase') AS leaked FROM events")
def str_leak_guard(p: Panels):
    history = p.table("events").where("event_type = 'purchase'")
    return At.drain(At.leak_guard(At.source(p.spark, p.sf_dir), history, "user_id").select("event_id", "user_id", "leaked"), folder(p.spark))
