"""Streaming queries, each with the batch result it must equal."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from chronoward.streaming import events as se


#: How late an event may be.
DELAY = "2 days"


def tumbling_stream(spark: SparkSession, d: str) -> DataFrame:
    out = se.drain(se.tumbling(se.event_stream(spark, d), "12 hours", DELAY), "complete")
    return out.withColumn("window_start", F.unix_micros("window_start"))


def sliding_stream(spark: SparkSession, d: str) -> DataFrame:
    out = se.drain(se.sliding(se.event_stream(spark, d), "5 hours", "1 hour", DELAY), "complete")
    return out.withColumn("window_start", F.unix_micros("window_start"))


def session_stream(spark: SparkSession, d: str) -> DataFrame:
    out = se.drain(se.sessions(se.event_stream(spark, d), "6 hours", DELAY), "complete")
    return out.withColumn("first_ts", F.unix_micros("first_ts")).withColumn("last_ts", F.unix_micros("last_ts"))


def stateful_onset(spark: SparkSession, d: str) -> DataFrame:
    return se.drain(se.sustained_onsets(se.event_stream(spark, d), 65.0, 3, DELAY, "30 days"), "append")


def stream_join(spark: SparkSession, d: str) -> DataFrame:
    """Purchases within six hours after a click of the same user, from two streams."""
    e = se.event_stream(spark, d)
    pairs = se.followed_within(e.filter("event_type = 'click'"), se.event_stream(spark, d).filter("event_type = 'purchase'"), "6 hours", DELAY)
    return se.drain(pairs, "append").select("user_id", "first_id", "later_id")


QUERIES = {f.__name__: f for f in (tumbling_stream, sliding_stream, session_stream, stateful_onset, stream_join)}

SQL = {
    "stream_join": """
        select a.user_id, a.event_id first_id, b.event_id later_id from events a join events b on a.user_id = b.user_id
        where a.event_type = 'click' and b.event_type = 'purchase' and b.ts > a.ts and b.ts <= a.ts + interval 6 hours""",
    "tumbling_stream": """
        select cast(floor(epoch_us(ts) / 43200000000) * 43200000000 as bigint) window_start, event_type, count(*) n,
               round(sum("value"), 4) total from events group by 1, 2""",
    "sliding_stream": """
        with e as (select *, unnest(range(0, 5)) k from events)
        select cast((floor(epoch_us(ts) / 3600000000) - k) * 3600000000 as bigint) window_start, event_type, count(*) n,
               round(max("value"), 6) greatest from e group by 1, 2""",
    "session_stream": """
        with g as (select user_id, epoch_us(ts) t, case when epoch_us(ts) - lag(epoch_us(ts)) over w < 21600000000 then 0 else 1 end s
                   from events window w as (partition by user_id order by ts, event_id)),
             h as (select *, sum(s) over (partition by user_id order by t rows unbounded preceding) k from g)
        select user_id, count(*) n, min(t) first_ts, max(t) last_ts from h group by user_id, k""",
    "stateful_onset": """
        with o as (select user_id, ts, event_id, "value" <= 65 low, row_number() over w n,
                          row_number() over w - row_number() over (partition by user_id, "value" <= 65 order by ts, event_id) g
                   from events window w as (partition by user_id order by ts, event_id)),
             r as (select *, row_number() over (partition by user_id, g order by ts, event_id) k from o where low)
        select user_id, epoch_us(ts) onset_us from r where k = 3""",
}
