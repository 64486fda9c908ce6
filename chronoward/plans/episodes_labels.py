"""Queries over minute timelines: bins, episodes, onset labels, negative filters."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from chronoward.operators import episodes as ep
from chronoward.operators import labels as lb
from chronoward.operators import timeline as tl
from chronoward.plans.data_quality import usable_reading
from chronoward.session import checkpoint, settled_side, table

#: Event rules per channel (MAP <= 65, HR > 110, SpO2 < 90).
RULES = {
    "ABP Mean": ("hypotension", "le", 65.0),
    "HR": ("tachycardia", "gt", 110.0),
    "SpO2": ("hypoxia", "lt", 90.0),
}
SUSTAIN = 5
INPUT_MINUTES = 10
HORIZONS = [5, 10]
GAPS = [2, 5]
KEYS = ["segment_id", "event_name"]


def readings(spark: SparkSession, d: str) -> DataFrame:
    """Usable readings, repeated rows once."""
    rows = table(spark, d, "minute_timeline").filter(usable_reading()).select(
        "segment_id", "channel_name", "reading_id", F.col("minute_value").cast("double").alias("v"),
        tl.minute_index(F.col("minute_time"), F.col("origin_seconds")).alias("m"),
    )
    return rows.dropDuplicates(["segment_id", "channel_name", "reading_id", "m"])


def timeline(spark: SparkSession, d: str) -> DataFrame:
    """``segment_id, channel_name, event_name, minute, value, n, event``."""
    bins = tl.bin_median(readings(spark, d), ["segment_id", "channel_name"], F.col("m"), F.col("v"))
    name, flag = tl.channel_events(F.col("channel_name"), F.col("value"), RULES)
    return bins.withColumn("event_name", name).withColumn("event", flag)


def minute_bins(spark: SparkSession, d: str) -> DataFrame:
    return timeline(spark, d).select("segment_id", "channel_name", "minute", "value", "n", "event")


def minute_validity_fraction(spark: SparkSession, d: str) -> DataFrame:
    keys = ["segment_id", "channel_name"]
    extent = table(spark, d, "minute_timeline").groupBy(*keys).agg(
        F.min(tl.minute_index(F.col("minute_time"), F.col("origin_seconds"))).alias("lo"),
        F.max(tl.minute_index(F.col("minute_time"), F.col("origin_seconds"))).alias("hi"),
    )
    out = tl.validity(timeline(spark, d), keys, extent)
    return out.withColumn("valid_fraction", F.round("valid_fraction", 9))


def sustained_episodes(spark: SparkSession, d: str) -> DataFrame:
    return ep.maximal_episodes(timeline(spark, d), KEYS, SUSTAIN)


def sustained_starts_collapsed(spark: SparkSession, d: str) -> DataFrame:
    return ep.sustained_starts(timeline(spark, d), KEYS, SUSTAIN, collapse=True)


def sustained_starts_all(spark: SparkSession, d: str) -> DataFrame:
    return ep.sustained_starts(timeline(spark, d), KEYS, SUSTAIN, collapse=False)


def longest_qualifying_run(spark: SparkSession, d: str) -> DataFrame:
    return ep.longest_run(timeline(spark, d), KEYS, 3)


def anchors(spark: SparkSession, d: str) -> DataFrame:
    """``anchor_id, segment_id, event_name, input_end``: anchors on their segment's minute grid."""
    rows = table(spark, d, "feature_cache").filter("anchor_time is not null").select(
        "anchor_id", "segment_id", "anchor_time"
    ).distinct()
    origin = table(spark, d, "minute_timeline").groupBy("segment_id").agg(F.min("origin_seconds").alias("origin"))
    names = F.array(*[F.lit(r[0]) for r in RULES.values()])
    return rows.join(origin, "segment_id").select(
        "anchor_id", "segment_id", F.explode(names).alias("event_name"),
        tl.minute_index(F.col("anchor_time"), F.col("origin")).alias("input_end"),
    )


def settled_bins(spark: SparkSession, d: str) -> DataFrame:
    """``segment_id, event_name, minute, event``, computed once for everything a query makes of it."""
    return checkpoint(timeline(spark, d).select(*KEYS, "minute", "event"))


def _lengths(bins: DataFrame) -> DataFrame:
    return bins.groupBy(*KEYS).agg((F.max("minute") + 1).alias("length"))


def _labelled(spark: SparkSession, d: str, strict: bool, bins: DataFrame | None = None) -> DataFrame:
    bins = settled_bins(spark, d) if bins is None else bins
    return lb.onset_labels(
        anchors(spark, d), ep.annotated(bins, KEYS, SUSTAIN), _lengths(bins), KEYS, INPUT_MINUTES, HORIZONS, SUSTAIN,
        strict_clean=strict,
    )


def label_onset_horizon(spark: SparkSession, d: str) -> DataFrame:
    return _labelled(spark, d, strict=False)


def label_onset_strict_clean(spark: SparkSession, d: str) -> DataFrame:
    return _labelled(spark, d, strict=True)


def label_fixed_gap(spark: SparkSession, d: str) -> DataFrame:
    bins = settled_bins(spark, d)
    return lb.fixed_gap_labels(
        anchors(spark, d), ep.annotated(bins, KEYS, SUSTAIN), _lengths(bins), KEYS, INPUT_MINUTES, GAPS, SUSTAIN
    )


def label_reason_counts(spark: SparkSession, d: str) -> DataFrame:
    """Counts by event, horizon, label and reason, with totals over events (grouping sets)."""
    return (
        label_onset_horizon(spark, d).rollup("horizon", "event_name")
        .agg(
            F.count(F.lit(1)).alias("n"), F.count_if(F.col("label") == 1).alias("n_positive"),
            F.count_if(F.col("label") == 0).alias("n_negative"), F.count_if(F.col("label") == -1).alias("n_invalid"),
        )
        .select(F.coalesce(F.col("horizon"), F.lit(-1)).alias("horizon"),
                F.coalesce("event_name", F.lit("all")).alias("event_name"), "n", "n_positive", "n_negative", "n_invalid")
    )


def cube_reason_counts(spark: SparkSession, d: str) -> DataFrame:
    return (
        label_onset_horizon(spark, d).cube("horizon", "reason").agg(F.count(F.lit(1)).alias("n"))
        .select(F.coalesce(F.col("horizon"), F.lit(-1)).alias("horizon"),
                F.coalesce(F.col("reason"), F.lit(-1)).alias("reason"), "n")
    )


def legacy_anchor_horizon(spark: SparkSession, d: str) -> DataFrame:
    """Sustained event in the minutes after the input; any active event masks every label."""
    return _legacy_labels(settled_bins(spark, d), checkpoint(anchors(spark, d)))


def _legacy_labels(bins: DataFrame, a: DataFrame) -> DataFrame:
    active = lb.sustained_in_range(a, bins, KEYS, -INPUT_MINUTES, -1, SUSTAIN)
    stable = active.groupBy("anchor_id").agg((~F.max("has_event")).alias("stable"))
    parts = []
    for h in HORIZONS:
        future = lb.sustained_in_range(a, bins, KEYS, 0, h - 1, SUSTAIN)
        parts.append(
            future.join(stable, "anchor_id").select(
                "anchor_id", *KEYS, F.lit(h).alias("horizon"),
                F.when(F.col("stable") & F.col("has_data"), F.col("has_event").cast("int")).otherwise(-1).alias("label"),
            )
        )
    out = parts[0]
    for p in parts[1:]:
        out = out.unionByName(p)
    return out


def legacy_filtered_negatives(spark: SparkSession, d: str) -> DataFrame:
    """Legacy labels; negatives dropped by segment, then by mean last onset, then by unclean outcome."""
    bins, a = settled_bins(spark, d), checkpoint(anchors(spark, d))
    last = checkpoint(ep.sustained_starts(bins, KEYS, SUSTAIN, collapse=True).groupBy(*KEYS).agg(
        F.max("minute").alias("last_start")
    ))
    mean = settled_side(last.groupBy("event_name").agg(F.avg("last_start").alias("cutoff")))
    base = checkpoint(_legacy_labels(bins, a).join(a, ["anchor_id", *KEYS]))
    clean = (
        base.filter("label = 0")
        .withColumn("minute", F.explode(F.sequence(F.col("input_end") + F.col("horizon"),
                                                   F.col("input_end") + F.col("horizon") + SUSTAIN - 1)))
        .join(bins, [*KEYS, "minute"], "left")
        .groupBy("anchor_id", *KEYS, "horizon")
        .agg((F.count_if(F.coalesce(~F.col("event"), F.lit(False))) == SUSTAIN).alias("clean"))
    )
    joined = (
        base.join(last.withColumn("had", F.lit(True)), KEYS, "left").join(mean, "event_name", "left")
        .join(clean, ["anchor_id", *KEYS, "horizon"], "left")
    )
    reason = (
        F.when(F.col("label") != 0, F.lit(0)).when(F.col("had"), F.lit(3))
        .when(F.col("input_end") + F.col("horizon") > F.col("cutoff"), F.lit(4))
        .when(~F.coalesce("clean", F.lit(False)), F.lit(5)).otherwise(F.lit(0))
    )
    return joined.select(
        "anchor_id", *KEYS, "horizon", reason.alias("filter_reason"),
        F.when(reason == 0, F.col("label")).otherwise(-1).alias("filtered_label"),
    )


def _with_group(spark: SparkSession, d: str) -> tuple[DataFrame, DataFrame]:
    """(onset labels with the anchor's input end, sustained episodes); the group of an anchor is its segment."""
    bins = settled_bins(spark, d)
    labels = _labelled(spark, d, strict=False, bins=bins).join(anchors(spark, d), ["anchor_id", *KEYS])
    return labels, ep.maximal_episodes(bins, KEYS, SUSTAIN)


def negative_filter_group(spark: SparkSession, d: str) -> DataFrame:
    labels, episodes = _with_group(spark, d)
    groups = episodes.select(*KEYS).distinct()
    out = lb.filter_negatives(labels, "segment_id", groups, None, F.col("input_end"))
    return out.select("anchor_id", *KEYS, "horizon", "filtered_label", "filter_reason")


def negative_filter_mean_cutoff(spark: SparkSession, d: str) -> DataFrame:
    labels, episodes = _with_group(spark, d)
    last = episodes.groupBy(*KEYS).agg(F.max("start").alias("s"))
    cut = settled_side(last.groupBy("event_name").agg(F.avg("s").alias("cutoff")))
    out = lb.filter_negatives(labels, "segment_id", None, cut, F.col("input_end") + F.col("horizon"))
    return out.select("anchor_id", *KEYS, "horizon", "filtered_label", "filter_reason")


def negative_filter_group_cutoff(spark: SparkSession, d: str) -> DataFrame:
    labels, episodes = _with_group(spark, d)
    cut = episodes.groupBy(*KEYS).agg(F.max("start").cast("double").alias("cutoff"))
    out = lb.filter_negatives(labels, "segment_id", None, cut, F.col("input_end"), require_onset=True)
    return out.select("anchor_id", *KEYS, "horizon", "filtered_label", "filter_reason")


def label_invariants(spark: SparkSession, d: str) -> DataFrame:
    """Violations of what must hold, counted: all zero."""
    wide = label_onset_horizon(spark, d).groupBy("anchor_id", *KEYS).agg(
        F.max(F.when(F.col("horizon") == 5, F.col("label"))).alias("l5"),
        F.max(F.when(F.col("horizon") == 10, F.col("label"))).alias("l10"),
        F.count(F.lit(1)).alias("n"), F.count_if((F.col("label") == -1) != (F.col("reason") > 0)).alias("unexplained"),
    )
    return wide.agg(
        F.count_if((F.col("l5") == 1) & (F.col("l10") == 0)).alias("short_positive_long_negative"),
        F.count_if(F.col("n") != 2).alias("missing_horizon"), F.sum("unexplained").alias("unexplained_invalid"),
    )


def phase_grids(spark: SparkSession, d: str) -> DataFrame:
    """Minute medians on one grid per phase: anchors whose input starts at the same second of the minute share a grid.

    ``segment_id, channel_name, phase, minute, value, n``; minute 0 of a grid begins at
    its earliest input start, and a reading counts for each of its segment's grids.
    """
    start = F.col("anchor_time") - 60.0 * INPUT_MINUTES
    grids = table(spark, d, "feature_cache").filter("anchor_time is not null").select("segment_id", start.alias("s")).distinct()
    grids = grids.groupBy("segment_id", F.pmod(F.rint("s").cast("long"), F.lit(60)).alias("phase")).agg(F.min("s").alias("origin"))
    rows = table(spark, d, "minute_timeline").filter(usable_reading()).select(
        "segment_id", "channel_name", "reading_id", "minute_time", F.col("minute_value").cast("double").alias("v")
    ).dropDuplicates(["segment_id", "channel_name", "reading_id", "minute_time"])
    x = rows.join(grids, "segment_id").filter(F.col("minute_time") >= F.col("origin"))
    minute = F.floor((F.col("minute_time") - F.col("origin")) / 60.0).cast("long")
    return tl.bin_median(x, ["segment_id", "channel_name", "phase"], minute, F.col("v"))


def overlay_last_wins(spark: SparkSession, d: str) -> DataFrame:
    """Per segment and minute, the feature windows' last listed heart rate."""
    rows = table(spark, d, "feature_cache").filter("anchor_time is not null").select(
        "segment_id", "anchor_id", "built_at", F.get("feature_values", F.lit(1)).cast("double").alias("hr"),
        F.get("feature_mask", F.lit(1)).alias("ok"),
        (F.floor(F.col("anchor_time") / 60) * 60 + F.col("minute_idx") * 60).cast("long").alias("second"),
    ).filter("ok")
    return tl.overlay_last_wins(rows, ["segment_id"], "second", "hr", ["built_at", "anchor_id"])


QUERIES = {
    f.__name__: f
    for f in (
        minute_bins, minute_validity_fraction, sustained_episodes, sustained_starts_collapsed, sustained_starts_all,
        longest_qualifying_run, label_onset_horizon, label_onset_strict_clean, label_fixed_gap, label_reason_counts,
        cube_reason_counts, legacy_anchor_horizon, legacy_filtered_negatives, negative_filter_group,
        negative_filter_mean_cutoff, negative_filter_group_cutoff, label_invariants, overlay_last_wins, phase_grids,
    )
}

# ---- SQL

_TL = """
    rd as (select distinct segment_id, channel_name, reading_id,
                  cast(round_even((minute_time - origin_seconds) / 60, 0) as bigint) m, cast(minute_value as double) v
           from minute_timeline
           where minute_valid and isfinite(minute_value) and finite_samples_per_minute > 0),
    tb as (select segment_id, channel_name, m "minute", median(v) "value", count(*) n from rd group by 1, 2, 3),
    tl as (select *, case channel_name when 'ABP Mean' then 'hypotension' when 'HR' then 'tachycardia'
                          when 'SpO2' then 'hypoxia' end event_name,
                  case channel_name when 'ABP Mean' then "value" <= 65 when 'HR' then "value" > 110
                       when 'SpO2' then "value" < 90 else false end event from tb),
    ru as (select segment_id, event_name, g, min("minute") "start", max("minute") + 1 end_exclusive, count(*) duration
           from (select *, "minute" - row_number() over (partition by segment_id, event_name order by "minute") g
                 from tl where event) group by 1, 2, 3),
    es as (select segment_id, event_name, "start", end_exclusive, duration from ru where duration >= 5)"""

_AN = """
    oo as (select segment_id, min(origin_seconds) o from minute_timeline group by 1),
    an as (select a.anchor_id, a.segment_id, e.event_name,
                  cast(round_even((a.anchor_time - o.o) / 60, 0) as bigint) input_end
           from (select distinct anchor_id, segment_id, anchor_time from feature_cache where anchor_time is not null) a
           join oo o using (segment_id), (values ('hypotension'), ('tachycardia'), ('hypoxia')) e(event_name))"""

_LEN = """
    ln as (select segment_id, event_name, max("minute") + 1 length from tl group by 1, 2),
    st as (select t.segment_id, t.event_name, t."minute", t.event, e."start" is not null in_episode,
                  coalesce(e."start" = t."minute", false) starts_episode
           from tl t left join es e on e.segment_id = t.segment_id and e.event_name = t.event_name
                and t."minute" >= e."start" and t."minute" < e.end_exclusive)"""


def _onset_sql(strict: bool) -> str:
    mixed = "when e > 0 then -16" if strict else ""
    return f"""
    hz as (select * from (values (5), (10)) h(horizon)),
    ct as (select a.anchor_id, a.segment_id, a.event_name, h.horizon, a.input_end,
                  count(*) filter (where s."minute" < a.input_end) n_in,
                  count(*) filter (where s.in_episode and s."minute" < a.input_end) n_act,
                  count(*) filter (where s."minute" >= a.input_end and s."minute" < a.input_end + h.horizon) f,
                  count(*) filter (where s.starts_episode and s."minute" >= a.input_end
                                         and s."minute" < a.input_end + h.horizon) so,
                  count(*) filter (where s."minute" >= a.input_end and s."minute" < a.input_end + h.horizon + 4) c,
                  count(*) filter (where s.event and s."minute" >= a.input_end
                                         and s."minute" < a.input_end + h.horizon) e
           from an a cross join hz h left join st s on s.segment_id = a.segment_id and s.event_name = a.event_name
                and s."minute" >= a.input_end - 10 and s."minute" < a.input_end + h.horizon + 4
           group by 1, 2, 3, 4, 5),
    cd as (select ct.*, case when l.length is null then -18 when n_in < 10 then -12 when n_act > 0 then -19
                             when f < horizon then -13 when input_end + horizon + 4 > l.length then -14
                             when so > 0 then 1 when c < horizon + 4 then -14 {mixed} else 0 end code
           from ct left join ln l using (segment_id, event_name)),
    la as (select anchor_id, segment_id, event_name, horizon, case when code <= -10 then -1 else code end label,
                  case when code <= -10 then -code - 10 else 0 end reason, input_end from cd)"""


_BASE = f"with {_TL},{_AN},{_LEN},{_onset_sql(False)}"
_LEGACY = f"""
    with {_TL},{_AN},
    mi as (select a.*, x.k, t.event from an a cross join (select unnest(range(-10, 10)) k) x
           left join tl t on t.segment_id = a.segment_id and t.event_name = a.event_name
                and t."minute" = a.input_end + x.k),
    sg as (select * from (values ('in', -10, -1), ('f5', 0, 4), ('f10', 0, 9)) s(kind, lo, hi)),
    rr as (select m.anchor_id, m.segment_id, m.event_name, kind, k, event from mi m join sg on k between lo and hi),
    r1 as (select *, sum(case when coalesce(event, false) then 0 else 1 end)
                     over (partition by anchor_id, segment_id, event_name, kind order by k rows unbounded preceding) g
           from rr),
    r2 as (select anchor_id, segment_id, event_name, kind, g, count(*) filter (where event) n,
                  count(event) d from r1 group by 1, 2, 3, 4, 5),
    r3 as (select anchor_id, segment_id, event_name, kind, max(n) >= 5 has_event, sum(d) > 0 has_data
           from r2 group by 1, 2, 3, 4),
    sb as (select anchor_id, not max(has_event) stable from r3 where kind = 'in' group by 1),
    lg as (select r.anchor_id, r.segment_id, r.event_name, case kind when 'f5' then 5 else 10 end horizon,
                  case when s.stable and r.has_data then cast(r.has_event as int) else -1 end label
           from r3 r join sb s using (anchor_id) where kind <> 'in')"""

SQL = {
    "phase_grids": """
        with a as (select distinct segment_id, anchor_time - 600.0 s from feature_cache where anchor_time is not null),
             g as (select segment_id, ((cast(round_even(s, 0) as bigint) % 60) + 60) % 60 phase, min(s) origin from a group by 1, 2),
             r as (select distinct segment_id, channel_name, reading_id, minute_time, cast(minute_value as double) v from minute_timeline
                   where coalesce(minute_valid and isfinite(minute_value) and finite_samples_per_minute > 0, false))
        select segment_id, channel_name, phase, cast(floor((minute_time - origin) / 60) as bigint) "minute", median(v) "value", count(*) n
        from r join g using (segment_id) where minute_time >= origin group by 1, 2, 3, 4""",
    "minute_bins": f"""with {_TL} select segment_id, channel_name, "minute", "value", n, event from tl""",
    "minute_validity_fraction": f"""
        with {_TL},
        x as (select segment_id, channel_name, min(cast(round_even((minute_time - origin_seconds) / 60, 0) as bigint)) lo,
                     max(cast(round_even((minute_time - origin_seconds) / 60, 0) as bigint)) hi
              from minute_timeline group by 1, 2),
        c as (select segment_id, channel_name, count(*) n from tl group by 1, 2)
        select segment_id, channel_name, coalesce(n, 0) n_valid, hi - lo + 1 n_steps,
               round(coalesce(n, 0) / (hi - lo + 1), 9) valid_fraction
        from x left join c using (segment_id, channel_name)""",
    "sustained_episodes": f"with {_TL} select * from es",
    "sustained_starts_collapsed": f"""
        with {_TL} select segment_id, event_name, unnest(range("start", end_exclusive - 4, 5)) "minute" from es""",
    "sustained_starts_all": f"""
        with {_TL} select segment_id, event_name, unnest(range("start", end_exclusive - 4)) "minute" from es""",
    "longest_qualifying_run": f"""
        with {_TL} select segment_id, event_name, "start", end_exclusive, duration from ru where duration >= 3
        qualify row_number() over (partition by segment_id, event_name order by duration desc, end_exclusive desc) = 1""",
    "label_onset_horizon": f"{_BASE} select anchor_id, segment_id, event_name, horizon, label, reason from la",
    "label_onset_strict_clean": f"""with {_TL},{_AN},{_LEN},{_onset_sql(True)}
        select anchor_id, segment_id, event_name, horizon, label, reason from la""",
    "label_fixed_gap": f"""
        with {_TL},{_AN},{_LEN},
        gp as (select * from (values (2), (5)) h(gap)),
        ct as (select a.anchor_id, a.segment_id, a.event_name, h.gap, a.input_end,
                      count(*) filter (where s."minute" < a.input_end) n_in,
                      count(*) filter (where s.in_episode and s."minute" < a.input_end) n_act,
                      count(*) filter (where s."minute" >= a.input_end + gap and s."minute" < a.input_end + gap + 5) v,
                      count(*) filter (where s.event and s."minute" >= a.input_end + gap
                                             and s."minute" < a.input_end + gap + 5) e,
                      count(*) filter (where s.starts_episode and s."minute" = a.input_end + gap) so,
                      count(*) filter (where s.in_episode and s."minute" = a.input_end + gap) ac
               from an a cross join gp h left join st s on s.segment_id = a.segment_id
                    and s.event_name = a.event_name and s."minute" >= a.input_end - 10
                    and s."minute" < a.input_end + h.gap + 5 group by 1, 2, 3, 4, 5),
        cd as (select ct.*, case when l.length is null then -18 when n_in < 10 then -12 when n_act > 0 then -19
                                 when input_end + gap + 5 > l.length then -14 when v < 5 then -15
                                 when so > 0 then 1 when ac > 0 then -17 when e = 0 then 0 else -16 end code
               from ct left join ln l using (segment_id, event_name))
        select anchor_id, segment_id, event_name, gap, case when code <= -10 then -1 else code end label,
               case when code <= -10 then -code - 10 else 0 end reason from cd""",
    "label_reason_counts": f"""{_BASE}
        select coalesce(horizon, -1) horizon, coalesce(event_name, 'all') event_name, count(*) n,
               count(*) filter (where label = 1) n_positive, count(*) filter (where label = 0) n_negative,
               count(*) filter (where label = -1) n_invalid
        from la group by rollup (horizon, event_name)""",
    "cube_reason_counts": f"""{_BASE}
        select coalesce(horizon, -1) horizon, coalesce(reason, -1) reason, count(*) n
        from la group by cube (horizon, reason)""",
    "legacy_anchor_horizon": f"{_LEGACY} select * from lg",
    "legacy_filtered_negatives": f"""{_LEGACY},
        ls as (select segment_id, event_name, max(m) last_start from
                   (select segment_id, event_name, unnest(range("start", end_exclusive - 4, 5)) m from es)
               group by 1, 2),
        mc as (select event_name, avg(last_start) cutoff from ls group by 1),
        cl as (select l.anchor_id, l.segment_id, l.event_name, l.horizon, count(*) filter (where not t.event) = 5 clean
               from lg l join an a using (anchor_id, segment_id, event_name)
               left join tl t on t.segment_id = l.segment_id and t.event_name = l.event_name
                    and t."minute" >= a.input_end + l.horizon and t."minute" < a.input_end + l.horizon + 5
               where l.label = 0 group by 1, 2, 3, 4),
        fr as (select l.*, case when l.label <> 0 then 0 when ls.last_start is not null then 3
                                when a.input_end + l.horizon > mc.cutoff then 4
                                when not coalesce(cl.clean, false) then 5 else 0 end filter_reason
               from lg l join an a using (anchor_id, segment_id, event_name)
               left join ls using (segment_id, event_name) left join mc using (event_name)
               left join cl using (anchor_id, segment_id, event_name, horizon))
        select anchor_id, segment_id, event_name, horizon, filter_reason,
               case when filter_reason = 0 then label else -1 end filtered_label from fr""",
    "negative_filter_group": f"""{_BASE},
        g as (select distinct segment_id, event_name from es),
        f as (select la.*, case when label = -1 then 1 when label = 1 then 2 when g.segment_id is not null then 3
                                else 0 end filter_reason from la left join g using (segment_id, event_name))
        select anchor_id, segment_id, event_name, horizon, case when filter_reason >= 3 then -1 else label end filtered_label,
               filter_reason from f""",
    "negative_filter_mean_cutoff": f"""{_BASE},
        l as (select segment_id, event_name, max("start") s from es group by 1, 2),
        g as (select event_name, avg(s) cutoff from l group by 1),
        f as (select la.*, case when label = -1 then 1 when label = 1 then 2 when input_end + horizon > cutoff then 4
                                else 0 end filter_reason from la left join g using (event_name))
        select anchor_id, segment_id, event_name, horizon, case when filter_reason >= 3 then -1 else label end filtered_label,
               filter_reason from f""",
    "negative_filter_group_cutoff": f"""{_BASE},
        g as (select segment_id, event_name, max("start") cutoff from es group by 1, 2),
        f as (select la.*, case when label = -1 then 1 when label = 1 then 2 when cutoff is null then 8
                                when input_end > cutoff then 4 else 0 end filter_reason
              from la left join g using (segment_id, event_name))
        select anchor_id, segment_id, event_name, horizon, case when filter_reason >= 3 then -1 else label end filtered_label,
               filter_reason from f""",
    "label_invariants": f"""{_BASE},
        w as (select anchor_id, segment_id, event_name, max(label) filter (where horizon = 5) l5,
                     max(label) filter (where horizon = 10) l10, count(*) n,
                     count(*) filter (where (label = -1) <> (reason > 0)) u from la group by 1, 2, 3)
        select count(*) filter (where l5 = 1 and l10 = 0) short_positive_long_negative,
               count(*) filter (where n <> 2) missing_horizon, cast(sum(u) as bigint) unexplained_invalid from w""",
    "overlay_last_wins": """
        with r as (select segment_id, anchor_id, built_at, cast(feature_values[2] as double) hr,
                          cast(floor(anchor_time / 60) * 60 + minute_idx * 60 as bigint) "second"
                   from feature_cache where anchor_time is not null and feature_mask[2] and isfinite(feature_values[2]))
        select segment_id, "second", arg_max(hr, (built_at, anchor_id)) hr from r group by 1, 2""",
}
