"""Queries that run events as a stream to its end, with keyed state."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..streaming import state
from ..streaming.usage import events_stream

QUERIES: dict = {}
ORACLES: dict[str, str] = {}
MOST, TTL_HOURS = 500, 24


def register(name: str, query, sql: str) -> None:
    QUERIES[name] = query
    ORACLES[name] = sql


def _events(s, d):
    return events_stream(s, f"{d.rstrip('/')}/events.parquet")


def _last_calls(s, d):
    calls = _events(s, d).select(F.col("event_type").alias("tool"), "event_id", "ts", F.col("value").alias("duration_ms"), (F.col("event_type") != "error").alias("success"))
    _, checkpoint = state.finished(state.last_calls(calls, MOST), "last-calls", "update")
    return state.kept_calls(s, checkpoint).select("tool", "event_id", F.date_format("ts", "yyyy-MM-dd HH:mm:ss.SSSSSS").alias("ts"), "duration_ms", "success")


register(
    "usage_last_calls",
    _last_calls,
    f"SELECT event_type AS tool, event_id, strftime(ts, '%Y-%m-%d %H:%M:%S.%f') AS ts, value AS duration_ms, event_type <> 'error' AS success FROM events QUALIFY row_number() OVER (PARTITION BY event_type ORDER BY ts DESC, event_id DESC) <= {MOST}",
)


def _hits(s, d):
    asked = _events(s, d).select("event_id", F.concat_ws("/", F.col("user_id").cast("string"), "event_type").alias("key"), "ts")
    return state.finished(state.cache_hits(asked, TTL_HOURS * 3_600_000), "cache-hits")[0]


register(
    "cache_hits",
    _hits,
    f"""WITH RECURSIVE o AS (SELECT event_id, user_id::VARCHAR || '/' || event_type AS key, epoch_ms(ts) AS ms, row_number() OVER (PARTITION BY user_id, event_type ORDER BY epoch_ms(ts), event_id) AS k FROM events),
    f AS (SELECT key, k, event_id, ms AS since, false AS hit FROM o WHERE k = 1 UNION ALL
      SELECT o.key, o.k, o.event_id, CASE WHEN o.ms - since <= {TTL_HOURS * 3_600_000} THEN since ELSE o.ms END, o.ms - since <= {TTL_HOURS * 3_600_000} FROM f JOIN o ON o.key = f.key AND o.k = f.k + 1)
    SELECT event_id, key, hit FROM f""",
)


def _purchases(s, d):
    events = lambda kind: _events(s, d).where(F.col("event_type") == kind)
    return state.finished(state.followed_by(events("view"), events("purchase"), "1 day"), "view-to-purchase")[0].select("user_id", "first_id", "then_id")


register(
    "view_to_purchase",
    _purchases,
    "SELECT v.user_id, v.event_id AS first_id, p.event_id AS then_id FROM events v JOIN events p ON v.user_id = p.user_id AND v.event_type = 'view' AND p.event_type = 'purchase' AND p.ts BETWEEN v.ts AND v.ts + INTERVAL 1 DAY",
)
