"""Streaming jobs over the events table."""

from __future__ import annotations

from pyspark.sql import DataFrame, functions as F

from dwops.functions import values as v
from dwops.reports.registry import Tables, report
from dwops.session import fresh_path
from dwops.streaming import jobs


def _events(t: Tables, ts: str | None = "ts") -> DataFrame:
    # A pattern, as a file stream takes no single file by name.
    return jobs.file_stream(t.spark, f"{t.directory}/events.parquet*", t.events.schema, ts)


def _paths(t: Tables, name: str) -> tuple[str, str]:
    return fresh_path(t.spark, name), fresh_path(t.spark, f"{name}_checkpoint")


@report("stream_daily_summary", """select cast(ts as date) as day, count(*) as event_count, cast(sum(cast(value as decimal(18,2))) as double) as total,
  sum(cast(value as decimal(18,2)))::double / count(*) as avg_value from events group by 1""")
def stream_daily_summary(t: Tables) -> DataFrame:
    aggs = [F.count(F.lit(1)).alias("event_count"), v.exact_sum("value").alias("total"), v.exact_avg("value").alias("avg_value")]
    path = jobs.stream_summary(_events(t), "ts", "1 day", aggs, *_paths(t, "daily_summary"))
    return jobs.read_summary(t.spark, path).withColumn("day", F.col("window_start").cast("date")).drop("window_start")


@report("stream_sessions", """
with p as (select user_id, ts, lag(ts) over (partition by user_id order by ts) as prev from events),
f as (select user_id, ts, sum(case when prev is null or ts - prev > interval 30 minutes then 1 else 0 end) over (partition by user_id order by ts) as s from p),
w as (select user_id, min(ts) as session_start, max(ts) + interval 30 minutes as session_end, count(*) as actions from f group by user_id, s)
select * from w where session_end <= (select max(ts) - interval 1 hour from events)""")
def stream_sessions(t: Tables) -> DataFrame:
    path = jobs.stream_sessions(_events(t), "user_id", "ts", "30 minutes", "1 hour", *_paths(t, "sessions"))
    return t.spark.read.parquet(path)


@report("stream_sessions_all", """
with p as (select user_id, ts, lag(ts) over (partition by user_id order by ts) as prev from events),
f as (select user_id, ts, sum(case when prev is null or ts - prev > interval 30 minutes then 1 else 0 end) over (partition by user_id order by ts) as s from p),
w as (select user_id, min(ts) as session_start, max(ts) + interval 30 minutes as session_end, count(*) as actions from f group by user_id, s)
select *, session_end > (select max(ts) - interval 1 hour from events) as is_open from w""")
def stream_sessions_all(t: Tables) -> DataFrame:
    """Written and still open sessions together: what a batch job finds."""
    out, checkpoint = _paths(t, "sessions")
    closed = t.spark.read.parquet(jobs.stream_sessions(_events(t), "user_id", "ts", "30 minutes", "1 hour", out, checkpoint))
    still_open = jobs.open_sessions(t.spark, "user_id", checkpoint)
    return closed.withColumn("is_open", F.lit(False)).unionByName(still_open.withColumn("is_open", F.lit(True)))


@report("stream_incremental", "select event_id, ts, user_id, event_type, value from events")
def stream_incremental(t: Tables) -> DataFrame:
    path = jobs.stream_incremental(_events(t), "event_id", *_paths(t, "incremental"))
    return t.spark.read.parquet(path).select("event_id", F.col("ts").cast("timestamp_ntz").alias("ts"), "user_id", "event_type", "value")


@report("stream_upsert", """
with l as (select user_id, event_type, value from events qualify row_number() over (partition by user_id order by ts desc, event_id desc) = 1)
select coalesce(c_custkey, user_id) as c_custkey, c_name, case when user_id is null then 'none' else event_type end as last_event from customer full join l on c_custkey = user_id""")
def stream_upsert(t: Tables) -> DataFrame:
    changes = _events(t).select(F.col("user_id").alias("c_custkey"), F.col("event_type").alias("last_event"), "ts", "event_id")
    order = ["-ts", "-event_id"]
    log = jobs.stream_upsert(changes, ["c_custkey"], order, *_paths(t, "changes"))
    target = t("customer", "c_custkey", "c_name").withColumn("last_event", F.lit("none"))
    return jobs.upserted(target, log, ["c_custkey"], order=order)
