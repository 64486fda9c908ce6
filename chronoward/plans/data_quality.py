"""Queries of the general training-data problems: p1, p2, p7."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from chronoward.functions.timeparts import micros_since_1970
from chronoward.operators.gridding import regular_grid
from chronoward.operators.implausible import SpikeSpec, flag_implausible
from chronoward.operators.interval_islands import merge_intervals
from chronoward.session import table

#: Possible range of each channel and the smallest noise scale that counts.
CHANNEL_LIMITS = {
    "ABP Mean": (20.0, 250.0, 0.5),
    "HR": (20.0, 250.0, 0.5),
    "SpO2": (40.0, 100.0, 0.3),
}

#: A fraction lies in [0, 1]; flat windows come in twelfths, hence the larger noise.
FRACTION_LIMITS = {
    "flatline_fraction": (0.0, 1.0, 0.08),
    "extreme_value_fraction": (0.0, 1.0, 0.04),
}

READING_SPEC = SpikeSpec(limits=CHANNEL_LIMITS)

#: Windows of three minutes; a fraction rests at 0.
WINDOW_SPEC = SpikeSpec(
    limits=FRACTION_LIMITS, slot_seconds=180.0, period_slots=12,
    frozen_min_run=8, resting_value=0.0, edge_spikes=True,
)


def usable_reading():
    """``minute_valid`` true, a finite value and at least one finite sample."""
    v = F.col("minute_value")
    return F.coalesce(
        F.col("minute_valid") & v.isNotNull() & ~F.isnan(v) & (F.abs(v) < float("inf"))
        & (F.col("finite_samples_per_minute") > 0),
        F.lit(False),
    )


def p1_flags(spark: SparkSession, d: str) -> DataFrame:
    """Every implausible reading or window with the tests it failed."""
    readings = flag_implausible(
        table(spark, d, "minute_timeline"), ["segment_id", "channel_name"], "channel_name", "reading_id",
        "minute_time", ["minute_value"], READING_SPEC, usable_reading(),
    )
    windows = flag_implausible(
        table(spark, d, "signal_quality"), ["segment_id", "channel_name"], "channel_name", "window_id",
        "window_start_seconds", ["flatline_fraction", "extreme_value_fraction"], WINDOW_SPEC,
    )
    return readings.withColumn("table_name", F.lit("minute_timeline")).unionByName(
        windows.withColumn("table_name", F.lit("signal_quality"))
    )


def p1_found(spark: SparkSession, d: str) -> DataFrame:
    return p1_flags(spark, d).select("table_name", "record_id").distinct()


def _grid(spark: SparkSession, d: str, only_missing: bool) -> DataFrame:
    return regular_grid(
        table(spark, d, "minute_timeline"), ["segment_id", "channel_name"],
        (F.col("minute_time") - F.col("origin_seconds")) / 60.0, F.col("minute_value"), usable_reading(),
        only_missing=only_missing,
    )


def p2_found(spark: SparkSession, d: str) -> DataFrame:
    return (
        _grid(spark, d, only_missing=True)
        .filter("is_missing")
        .select("segment_id", "channel_name", F.col("grid_index").alias("minute_index"))
    )


def p2_regular_series(spark: SparkSession, d: str) -> DataFrame:
    return _grid(spark, d, only_missing=False).withColumns({
        "value": F.round("value", 5), "effective_support": F.round("effective_support", 5)
    })


def p7_found(spark: SparkSession, d: str) -> DataFrame:
    vaso = table(spark, d, "vaso_interval").select(
        F.lit("icustay").alias("k"), F.col("icustay_id").cast("string").alias("x"),
        micros_since_1970(F.col("vaso_start")).alias("a"), micros_since_1970(F.col("vaso_end")).alias("b"),
    )
    segments = table(spark, d, "waveform_segment").select(
        F.lit("parent_record").alias("k"), F.col("parent_record").alias("x"),
        micros_since_1970(F.col("segment_start_time")).alias("a"),
        micros_since_1970(F.col("segment_end_time")).alias("b"),
    )
    return merge_intervals(vaso.unionByName(segments), F.col("k"), F.col("x"), F.col("a"), F.col("b"))


QUERIES = {
    "p1_found": p1_found,
    "p1_flags": p1_flags,
    "p2_found": p2_found,
    "p2_regular_series": p2_regular_series,
    "p7_found": p7_found,
}

_USABLE = (
    "coalesce(minute_valid and isfinite(minute_value) and finite_samples_per_minute > 0, false)"
)

SQL = {
    "p2_found": f"""
        with g as (select segment_id, channel_name,
                          cast(round_even((minute_time - origin_seconds) / 60, 0) as bigint) m, {_USABLE} u
                   from minute_timeline),
             r as (select segment_id, channel_name, min(m) lo, max(m) hi from g group by 1, 2),
             a as (select segment_id, channel_name, unnest(range(lo, hi + 1)) minute_index from r)
        select segment_id, channel_name, minute_index from a
        where (segment_id, channel_name, minute_index) not in
              (select (segment_id, channel_name, m) from g where u)""",
    "p2_regular_series": f"""
        with x as (select segment_id, channel_name, (minute_time - origin_seconds) / 60 x, cast(minute_value as double) v,
                          {_USABLE} u from minute_timeline),
             g as (select *, cast(round_even(x, 0) as bigint) m from x where isfinite(x)),
             r as (select segment_id, channel_name, min(m) lo, max(m) hi from g group by 1, 2),
             a as (select segment_id, channel_name, unnest(range(lo, hi + 1)) grid_index from r),
             n as (select segment_id, channel_name, m grid_index, count(*) n from g where u group by 1, 2, 3),
             s as (select segment_id, channel_name, m + d grid_index, x - (m + d) t, v
                   from g, (select unnest(range(-3, 4)) d) where u and abs(x - (m + d)) < 2.5),
             k as (select *, pow(1 - pow(abs(t) / 2.5, 3), 3) w from s),
             f as (select segment_id, channel_name, grid_index, sum(w) s0, sum(w * t) s1, sum(w * t * t) s2,
                          sum(w * w) ss, sum(w * v) y0, sum(w * t * v) y1 from k group by 1, 2, 3),
             e as (select segment_id, channel_name, grid_index, s0 * s0 / ss effective_support, y0 / s0 level,
                          s0 * s2 - s1 * s1 det, (s2 * y0 - s1 * y1) line, s0 from f)
        select segment_id, channel_name, grid_index, coalesce(n, 0) n_readings, n is null is_missing,
               round(case when effective_support >= 1.2 and det > 1e-3 * s0 * s0 then line / det
                          when effective_support >= 1 then level end, 5) "value",
               round(coalesce(effective_support, 0), 5) effective_support
        from a left join n using (segment_id, channel_name, grid_index) left join e using (segment_id, channel_name, grid_index)""",
    "p7_found": """
        with i as (select 'icustay' entity_kind, cast(icustay_id as varchar) entity_id,
                          epoch_us(vaso_start) s, epoch_us(vaso_end) e from vaso_interval
                   union all
                   select 'parent_record', parent_record, epoch_us(segment_start_time), epoch_us(segment_end_time)
                   from waveform_segment),
             v as (select * from i where entity_id is not null and s is not null and e is not null and e > s),
             b as (select *, max(e) over (partition by entity_kind, entity_id order by s, e
                                          rows between unbounded preceding and 1 preceding) m from v),
             n as (select *, sum(case when m is null or s > m then 1 else 0 end)
                              over (partition by entity_kind, entity_id order by s, e rows unbounded preceding) g from b),
             p as (select entity_kind, entity_id, g, min(s) start_us, max(e) end_us from n group by 1, 2, 3),
             q as (select *, lead(start_us) over (partition by entity_kind, entity_id order by start_us) nx from p)
        select entity_kind, entity_id, 'period' piece, start_us, end_us from p
        union all
        select entity_kind, entity_id, 'gap', end_us, nx from q where nx is not null""",
}
