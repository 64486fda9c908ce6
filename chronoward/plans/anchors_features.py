"""Queries of anchors, targets, key alignment and feature preparation."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from chronoward.functions.timeparts import micros_since_1970
from chronoward.operators import anchors as an
from chronoward.operators import features as ft
from chronoward.operators.quantiles import exact_quantiles
from chronoward.operators.timeline import alignment_residual, finite
from chronoward.plans.episodes_labels import timeline
from chronoward.session import table

#: Order of feature_cache.feature_values.
NAMES = ["map_mean", "hr_mean", "spo2_mean", "resp_rate", "pulse_amp", "hrv_power"]
PROPORTIONS = [("train", 0.7), ("val", 0.15), ("test", 0.15)]


def cache_rows(spark: SparkSession, d: str) -> DataFrame:
    """Feature rows, repeated rows once (the first built)."""
    return an.keep_first(table(spark, d, "feature_cache"), ["anchor_id", "minute_idx"], ["built_at"])


def long_cache(spark: SparkSession, d: str) -> DataFrame:
    return ft.long_features(cache_rows(spark, d), ["anchor_id", "minute_idx", "segment_id", "split_label"],
                            "feature_values", "feature_mask", NAMES)


def anchor_grid(spark: SparkSession, d: str) -> DataFrame:
    """20-minute windows every five minutes inside each series' extent."""
    ext = timeline(spark, d).groupBy("segment_id", "channel_name").agg(
        F.min("minute").alias("lo"), F.max("minute").alias("hi")
    )
    return an.anchor_grid(ext, F.col("lo") + 20, F.col("hi") + 1, 5).select("segment_id", "channel_name", "anchor")


def best_segment(spark: SparkSession, d: str) -> DataFrame:
    """Per parent record the segment with the most samples; ties by id."""
    rows = table(spark, d, "waveform_segment").filter("parent_record is not null and waveform_samples is not null")
    return rows.groupBy("parent_record").agg(
        F.max(F.struct("waveform_samples", "segment_id")).alias("b")
    ).select("parent_record", F.col("b.segment_id").alias("segment_id"), F.col("b.waveform_samples").alias("n_samples"))


def future_target_center(spark: SparkSession, d: str) -> DataFrame:
    t = timeline(spark, d).select("segment_id", "channel_name", "minute", "value")
    return an.future_values(t, t, ["segment_id", "channel_name"], "minute", "value", [5, 10, 15])


def future_target_gap(spark: SparkSession, d: str) -> DataFrame:
    t = timeline(spark, d).select("segment_id", "channel_name", "minute", "value")
    return an.future_values(t, t, ["segment_id", "channel_name"], "minute", "value", [5, 10], gap=2)


def target_match_rate(spark: SparkSession, d: str) -> DataFrame:
    return an.match_rate(future_target_center(spark, d))


def anchor_semi_join(spark: SparkSession, d: str) -> DataFrame:
    """Distinct anchors whose segment has a timeline of any channel."""
    a = table(spark, d, "feature_cache").select("anchor_id", "segment_id").distinct()
    t = table(spark, d, "minute_timeline").select("segment_id")
    return a.join(t, "segment_id", "left_semi").select("anchor_id", "segment_id")


def key_alignment_audit(spark: SparkSession, d: str) -> DataFrame:
    """Segments of the feature cache against the listed waveform segments."""
    left = table(spark, d, "feature_cache").select("segment_id").distinct()
    return an.key_audit(left, table(spark, d, "waveform_segment").select("segment_id"), ["segment_id"])


def _wide(spark: SparkSession, d: str, places: range, prefix: str) -> DataFrame:
    """Mean of some features per anchor, one column each."""
    rows = cache_rows(spark, d)
    return rows.groupBy("anchor_id").agg(*[
        F.round(F.avg(F.when(F.get("feature_mask", F.lit(i)), finite(F.get("feature_values", F.lit(i))))), 5).alias(f"{prefix}{NAMES[i]}")
        for i in places
    ])


def combined_features(spark: SparkSession, d: str) -> DataFrame:
    """Two feature tables of the same anchors, validated and side by side."""
    return an.concat_columns(_wide(spark, d, range(0, 3), "a_"), _wide(spark, d, range(3, 6), "b_"), ["anchor_id"])


def aligned_targets(spark: SparkSession, d: str) -> DataFrame:
    """Anchors with the last minute's targets, by the best key both tables have."""
    rows = cache_rows(spark, d).filter("anchor_id is not null")
    anchors = rows.groupBy("anchor_id").agg(F.min("segment_id").alias("segment_id"))
    targets = rows.groupBy("anchor_id").agg(
        F.max("minute_idx").alias("last_minute"), F.count(F.lit(1)).alias("n_minutes")
    )
    return an.align_targets(anchors, targets, [["anchor_id", "segment_id"], ["anchor_id"]])


def subset_by_ids(spark: SparkSession, d: str) -> DataFrame:
    """Feature rows of the anchors that lie on a full minute of their segment's first channel."""
    wanted = table(spark, d, "feature_cache").filter("minute_idx = 19").select("anchor_id").distinct()
    return an.subset_by_ids(cache_rows(spark, d).select("anchor_id", "minute_idx"), wanted, "anchor_id")


def cohort_intersect(spark: SparkSession, d: str) -> DataFrame:
    """Patients with both numerics and segments."""
    a = table(spark, d, "numerics_record").select("patient_id")
    b = table(spark, d, "waveform_segment").select(F.col("subject_id_str").alias("patient_id"))
    return a.intersect(b).filter("patient_id is not null")


def cohort_dropped(spark: SparkSession, d: str) -> DataFrame:
    """Patients with segments but no numerics."""
    a = table(spark, d, "numerics_record").select("patient_id")
    b = table(spark, d, "waveform_segment").select(F.col("subject_id_str").alias("patient_id"))
    return b.exceptAll(a).distinct().filter("patient_id is not null")


def dedupe_keep_first(spark: SparkSession, d: str) -> DataFrame:
    """First arrival of every reading."""
    rows = table(spark, d, "minute_timeline").select("reading_id", "segment_id", "channel_name", "ingested_at")
    first = an.keep_first(rows, ["reading_id"], ["ingested_at", "segment_id", "channel_name"])
    return first.withColumn("ingested_at", micros_since_1970(F.col("ingested_at")))


def stratified_sample_hash(spark: SparkSession, d: str) -> DataFrame:
    rows = table(spark, d, "feature_cache").select("anchor_id", "split_label").distinct()
    return an.stratified_sample(rows.withColumn("split_label", F.lower(F.trim("split_label"))), ["split_label"], "anchor_id", 50)


def grouped_batches(spark: SparkSession, d: str) -> DataFrame:
    rows = table(spark, d, "feature_cache").select("anchor_id", "segment_id").distinct()
    return an.grouped_batches(rows, "segment_id", "anchor_id", 4)


def entity_split(spark: SparkSession, d: str) -> DataFrame:
    rows = table(spark, d, "waveform_segment").select("subject_id").distinct().filter("subject_id is not null")
    return an.entity_split(rows, F.col("subject_id"), PROPORTIONS)


def alignment_audit(spark: SparkSession, d: str) -> DataFrame:
    """Per channel: how far readings lie from the minute grid."""
    rows = table(spark, d, "minute_timeline").select(
        "channel_name", alignment_residual(F.col("minute_time"), F.col("origin_seconds")).alias("r")
    )
    q = exact_quantiles(rows, ["channel_name"], "r", {"p50": 0.5, "p95": 0.95})
    agg = rows.groupBy("channel_name").agg(
        F.count(F.lit(1)).alias("n"), F.round(F.max("r"), 6).alias("max_residual"), F.count_if(F.col("r") > 10.0).alias("n_far")
    )
    return agg.join(q, "channel_name").select(
        "channel_name", "n", F.round("p50", 6).alias("p50"), F.round("p95", 6).alias("p95"), "max_residual", "n_far"
    )


def channel_moments(spark: SparkSession, d: str) -> DataFrame:
    m = ft.moments(long_cache(spark, d), ["feature_name"], "value")
    return m.select("feature_name", "n", "n_excluded", F.round("mean", 6).alias("mean"), F.round("std", 6).alias("std"))


def clip_and_zscore(spark: SparkSession, d: str) -> DataFrame:
    """Per feature and split: moments of values clipped to the 1st and 99th percentile and z-scored."""
    long = long_cache(spark, d)
    bounds = exact_quantiles(long, ["feature_name"], "value", {"lo": 0.01, "hi": 0.99}).join(
        ft.moments(long, ["feature_name"], "value").select("feature_name", "mean", "std"), "feature_name"
    )
    x = ft.clip_and_scale(long, bounds, ["feature_name"], "value")
    return x.groupBy("feature_name", F.lower(F.trim("split_label")).alias("split")).agg(
        F.count(F.lit(1)).alias("n"), F.round(F.avg("scaled"), 6).alias("mean_scaled"),
        F.round(F.min("scaled"), 6).alias("min_scaled"), F.round(F.max("scaled"), 6).alias("max_scaled"),
    )


def impute_normalize(spark: SparkSession, d: str) -> DataFrame:
    train = F.lower(F.trim("split_label")) == "train"
    x = ft.impute_normalise(long_cache(spark, d), F.coalesce(train, F.lit(False)), ["feature_name"])
    return x.select("anchor_id", "minute_idx", "feature_name", F.round("scaled", 6).alias("scaled"), "was_missing")


def history_summary(spark: SparkSession, d: str) -> DataFrame:
    h = ft.history_summary(long_cache(spark, d), ["anchor_id", "feature_name"], "minute_idx", "value", 20)
    numbers = ["mean", "median", "std", "min", "max", "first", "last", "delta", "slope", "valid_fraction"]
    return h.select("anchor_id", "feature_name", *[F.round(c, 5).alias(c) for c in numbers])


def minute_deltas(spark: SparkSession, d: str) -> DataFrame:
    x = ft.minute_deltas(long_cache(spark, d), ["anchor_id", "feature_name"], "minute_idx", "value")
    return x.select("anchor_id", "feature_name", "minute_idx", F.round("delta", 5).alias("delta"))


def derived_ratios(spark: SparkSession, d: str) -> DataFrame:
    """Shock-index like ratios per anchor and minute."""
    def feature(i: int):
        return F.when(F.get("feature_mask", F.lit(i)), finite(F.get("feature_values", F.lit(i))))

    x = cache_rows(spark, d).select(
        "anchor_id", "minute_idx", feature(0).alias("map"), feature(1).alias("hr"), feature(2).alias("spo2"),
        feature(3).alias("resp"), feature(4).alias("amp"),
    )
    return x.select(
        "anchor_id", "minute_idx", F.round(ft.safe_ratio(F.col("hr"), F.col("map")), 6).alias("shock_index"),
        F.round(ft.safe_ratio(F.col("hr") * F.col("resp"), F.col("map")), 6).alias("respiratory_shock_index"),
        F.round(ft.safe_ratio(F.col("amp"), F.col("map")), 6).alias("amplitude_ratio"),
        F.round(ft.agreement(F.col("hr"), F.col("map")), 6).alias("agreement_score"),
        F.round(F.col("hr") - F.col("map"), 6).alias("difference"),
    )


def feature_quality_report(spark: SparkSession, d: str) -> DataFrame:
    """Fourteen statistics per feature."""
    long = long_cache(spark, d)
    names = {"p01": 0.01, "p05": 0.05, "p50": 0.5, "p95": 0.95, "p99": 0.99}
    agg = long.groupBy("feature_name").agg(
        F.count(F.lit(1)).alias("n_rows"), F.count("value").alias("n_valid"), F.avg("value").alias("mean"),
        F.stddev_pop("value").alias("std"), F.min("value").alias("min"), F.max("value").alias("max"),
        F.count_if(F.col("value") == 0).alias("n_zero"), F.count_if(F.col("value") < 0).alias("n_negative"),
        F.countDistinct("value").alias("n_distinct"),
    ).join(exact_quantiles(long, ["feature_name"], "value", names), "feature_name")
    return agg.select(
        "feature_name", "n_rows", "n_valid", F.round(F.col("n_valid") / F.col("n_rows"), 9).alias("valid_fraction"),
        *[F.round(c, 5).alias(c) for c in ("mean", "std", "min", "max", *names)], "n_zero", "n_negative", "n_distinct",
    )


def shard_report_merge(spark: SparkSession, d: str) -> DataFrame:
    """Per-segment reports combined to the whole, as partial aggregates combine."""
    shard = long_cache(spark, d).groupBy("feature_name", "segment_id").agg(
        F.count("value").alias("n"), F.count_if(F.col("value").isNull()).alias("missing"), F.avg("value").alias("m"),
        F.coalesce(F.stddev_pop("value"), F.lit(0.0)).alias("s"), F.min("value").alias("lo"), F.max("value").alias("hi"),
    )
    n = F.sum("n")
    mean = F.sum(F.col("m") * F.col("n")) / n
    second = F.sum((F.col("s") * F.col("s") + F.col("m") * F.col("m")) * F.col("n")) / n
    return shard.groupBy("feature_name").agg(
        F.count_if(F.col("n") > 0).alias("n_shards"), n.alias("n"), F.sum("missing").alias("n_missing"), F.round(mean, 5).alias("mean"),
        F.round(F.sqrt(F.greatest(second - mean * mean, F.lit(0.0))), 4).alias("std"), F.min("lo").alias("min"), F.max("hi").alias("max"),
    )


def balanced_shards(spark: SparkSession, d: str) -> DataFrame:
    """Segments dealt to eight shards by their number of feature rows."""
    work = table(spark, d, "feature_cache").groupBy("segment_id").agg(F.count(F.lit(1)).alias("n_rows"))
    return an.balanced_shards(work, "segment_id", "n_rows", 8)


QUERIES = {
    f.__name__: f
    for f in (
        anchor_grid, best_segment, future_target_center, future_target_gap, target_match_rate, anchor_semi_join,
        key_alignment_audit, cohort_intersect, cohort_dropped, dedupe_keep_first, stratified_sample_hash, grouped_batches,
        entity_split, alignment_audit, channel_moments, clip_and_zscore, impute_normalize, history_summary,
        minute_deltas, derived_ratios, feature_quality_report, shard_report_merge, balanced_shards, combined_features,
        aligned_targets, subset_by_ids,
    )
}

from chronoward.plans.episodes_labels import _TL  # noqa: E402

_N = ", ".join(f"({i + 1}, '{n}')" for i, n in enumerate(NAMES))
_C = f"""
    cr as (select * from feature_cache qualify row_number() over (partition by anchor_id, minute_idx order by built_at) = 1),
    nm as (select * from (values {_N}) t(i, feature_name)),
    lc as (select anchor_id, minute_idx, segment_id, split_label, feature_name,
                  case when feature_mask[i] and isfinite(feature_values[i]) then cast(feature_values[i] as double) end v
           from cr, nm)"""
_U = "(({}::hugeint * 2654435761) % 1000003) / 1000003.0"
_AU = _U.format("anchor_id")

SQL = {
    "anchor_grid": f"""with {_TL}, e as (select segment_id, channel_name, min("minute") lo, max("minute") hi from tl group by 1, 2)
        select segment_id, channel_name, unnest(range(lo + 20, hi + 2, 5)) anchor from e where hi + 1 >= lo + 20""",
    "best_segment": """select parent_record, segment_id, waveform_samples n_samples from
        (select distinct parent_record, segment_id, waveform_samples from waveform_segment
         where parent_record is not null and waveform_samples is not null)
        qualify row_number() over (partition by parent_record order by waveform_samples desc, segment_id desc) = 1""",
    "future_target_center": f"""with {_TL}, h as (select * from (values (5), (10), (15)) h(horizon))
        select a.segment_id, a.channel_name, a."minute", horizon, b."value" target from tl a cross join h
        left join tl b on a.segment_id = b.segment_id and a.channel_name = b.channel_name
             and b."minute" = a."minute" + horizon""",
    "future_target_gap": f"""with {_TL}, h as (select * from (values (5), (10)) h(horizon))
        select a.segment_id, a.channel_name, a."minute", horizon, b."value" target from tl a cross join h
        left join tl b on a.segment_id = b.segment_id and a.channel_name = b.channel_name
             and b."minute" = a."minute" + horizon + 2""",
    "target_match_rate": f"""with {_TL}, h as (select * from (values (5), (10), (15)) h(horizon))
        select horizon, count(*) n, count(b."value") n_matched, round(count(b."value") / count(*), 9) match_rate
        from tl a cross join h left join tl b on a.segment_id = b.segment_id and a.channel_name = b.channel_name
             and b."minute" = a."minute" + horizon group by 1""",
    "anchor_semi_join": """select distinct anchor_id, segment_id from feature_cache where segment_id in
        (select segment_id from minute_timeline)""",
    "key_alignment_audit": """with l as (select distinct segment_id, 1 l from feature_cache),
        r as (select segment_id, count(*) r from waveform_segment group by 1)
        select count(*) filter (where l is not null and r is not null) n_both,
               count(*) filter (where r is null) n_left_only, count(*) filter (where l is null) n_right_only,
               0::bigint n_left_duplicated, count(*) filter (where r > 1) n_right_duplicated
        from l full join r using (segment_id)""",
    "cohort_intersect": """select patient_id from numerics_record where patient_id is not null
        intersect select subject_id_str from waveform_segment""",
    "cohort_dropped": """with b as (select subject_id_str p, count(*) n from waveform_segment group by 1),
        a as (select patient_id p, count(*) m from numerics_record group by 1)
        select b.p patient_id from b left join a using (p) where b.p is not null and b.n > coalesce(a.m, 0)""",
    "dedupe_keep_first": """select reading_id, segment_id, channel_name, epoch_us(ingested_at) ingested_at from minute_timeline
        qualify row_number() over (partition by reading_id order by ingested_at, segment_id, channel_name) = 1""",
    "stratified_sample_hash": f"""select anchor_id, split_label from
        (select distinct anchor_id, lower(trim(split_label)) split_label from
            (select distinct anchor_id, split_label from feature_cache))
        qualify row_number() over (partition by split_label order by {_AU}, anchor_id) <= 50""",
    "grouped_batches": f"""select anchor_id, segment_id, (row_number() over (partition by segment_id order by {_AU}, anchor_id) - 1) // 4
        batch_id from (select distinct anchor_id, segment_id from feature_cache)""",
    "entity_split": f"""select subject_id, case when {_U.format('subject_id')} < 0.7 then 'train'
        when {_U.format('subject_id')} < 0.85 then 'val' else 'test' end split_label
        from (select distinct subject_id from waveform_segment where subject_id is not null)""",
    "alignment_audit": """with r as (select channel_name, abs((minute_time - origin_seconds) / 60
            - round_even((minute_time - origin_seconds) / 60, 0)) * 60 r from minute_timeline)
        select channel_name, count(*) n, round(quantile_cont(r, 0.5), 6) p50, round(quantile_cont(r, 0.95), 6) p95,
               round(max(r), 6) max_residual, count(*) filter (where r > 10.0) n_far from r group by 1""",
    "channel_moments": f"""with {_C} select feature_name, count(v) n, count(*) filter (where v is null) n_excluded,
        round(avg(v), 6) mean, round(case when stddev_pop(v) < 1e-8 then 1 else stddev_pop(v) end, 6) "std"
        from lc group by 1""",
    "clip_and_zscore": f"""with {_C},
        b as (select feature_name, quantile_cont(v, 0.01) lo, quantile_cont(v, 0.99) hi, avg(v) m,
                     case when stddev_pop(v) < 1e-8 then 1 else stddev_pop(v) end s from lc group by 1),
        x as (select feature_name, lower(trim(split_label)) split,
                     coalesce((case when v is null then null else least(greatest(v, lo), hi) end - m) / s, 0) z
              from lc join b using (feature_name))
        select feature_name, split, count(*) n, round(avg(z), 6) mean_scaled, round(min(z), 6) min_scaled,
               round(max(z), 6) max_scaled from x group by 1, 2""",
    "impute_normalize": f"""with {_C},
        f as (select feature_name, median(v) md, avg(v) m, stddev_pop(v) s, count(v) n from lc
              where lower(trim(split_label)) = 'train' group by 1)
        select anchor_id, minute_idx, feature_name,
               round((coalesce(v, md) - m) / case when s > 1e-8 then s else 1 end, 6) scaled, v is null was_missing
        from lc join f using (feature_name)""",
    "history_summary": f"""with {_C} select anchor_id, feature_name, round(avg(v), 5) mean, round(median(v), 5) median,
        round(stddev_pop(v), 5) "std", round(min(v), 5) "min", round(max(v), 5) "max",
        round(arg_min(v, minute_idx), 5) "first", round(arg_max(v, minute_idx), 5) "last",
        round(arg_max(v, minute_idx) - arg_min(v, minute_idx), 5) delta,
        round(case when count(v) >= 2 then regr_slope(v, minute_idx) when count(v) = 1 then 0 end, 5) slope,
        round(count(v) / 20, 5) valid_fraction from lc group by 1, 2""",
    "minute_deltas": f"""with {_C} select anchor_id, feature_name, minute_idx,
        round(v - case when lag(minute_idx) over w = minute_idx - 1 then lag(v) over w end, 5) delta from lc
        window w as (partition by anchor_id, feature_name order by minute_idx)""",
    "derived_ratios": f"""with {_C},
        p as (select anchor_id, minute_idx, max(v) filter (where feature_name = 'map_mean') p,
                     max(v) filter (where feature_name = 'hr_mean') h, max(v) filter (where feature_name = 'resp_rate') r,
                     max(v) filter (where feature_name = 'pulse_amp') a from lc group by 1, 2)
        select anchor_id, minute_idx, round(case when abs(p) >= 1e-8 then h / p end, 6) shock_index,
               round(case when abs(p) >= 1e-8 then h * r / p end, 6) respiratory_shock_index,
               round(case when abs(p) >= 1e-8 then a / p end, 6) amplitude_ratio,
               round(1.0::double / (1.0::double + abs(h - p) / 10.0::double), 6) agreement_score,
               round(h - p, 6) difference from p""",
    "feature_quality_report": f"""with {_C} select feature_name, count(*) n_rows, count(v) n_valid,
        round(count(v) / count(*), 9) valid_fraction, round(avg(v), 5) mean, round(stddev_pop(v), 5) "std",
        round(min(v), 5) "min", round(max(v), 5) "max", round(quantile_cont(v, 0.01), 5) p01,
        round(quantile_cont(v, 0.05), 5) p05, round(quantile_cont(v, 0.5), 5) p50, round(quantile_cont(v, 0.95), 5) p95,
        round(quantile_cont(v, 0.99), 5) p99, count(*) filter (where v = 0) n_zero,
        count(*) filter (where v < 0) n_negative, count(distinct v) n_distinct from lc group by 1""",
    "shard_report_merge": f"""with {_C} select feature_name, count(distinct case when v is not null then segment_id end) n_shards,
        count(v) n, count(*) filter (where v is null) n_missing, round(avg(v), 5) mean, round(stddev_pop(v), 4) "std",
        min(v) "min", max(v) "max" from lc group by 1""",
    "combined_features": f"""with {_C} select anchor_id,
        round(avg(v) filter (where feature_name = 'map_mean'), 5) a_map_mean, round(avg(v) filter (where feature_name = 'hr_mean'), 5) a_hr_mean,
        round(avg(v) filter (where feature_name = 'spo2_mean'), 5) a_spo2_mean, round(avg(v) filter (where feature_name = 'resp_rate'), 5) b_resp_rate,
        round(avg(v) filter (where feature_name = 'pulse_amp'), 5) b_pulse_amp, round(avg(v) filter (where feature_name = 'hrv_power'), 5) b_hrv_power
        from lc group by 1""",
    "aligned_targets": f"""with {_C} select anchor_id, min(segment_id) segment_id, max(minute_idx) last_minute, count(*) n_minutes
        from cr where anchor_id is not null group by 1""",
    "subset_by_ids": f"""with {_C} select anchor_id, minute_idx from cr
        where anchor_id in (select anchor_id from feature_cache where minute_idx = 19)""",
    "balanced_shards": """with w as (select segment_id, count(*) n_rows from feature_cache group by 1),
        p as (select *, row_number() over (order by n_rows desc, segment_id) - 1 i from w)
        select segment_id, n_rows, cast(case when (i // 8) % 2 = 0 then i % 8 else 7 - i % 8 end as int) shard from p""",
}
