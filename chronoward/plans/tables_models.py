"""Queries of sources, cache integrity and baseline models."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from chronoward.operators import models as md
from chronoward.operators.timeline import channel_events
from chronoward.plans.anchors_features import _C, future_target_center
from chronoward.plans.episodes_labels import _TL, RULES
from chronoward.plans.intervals_cohort import _SEG
from chronoward.plans.signal_features import history_features
from chronoward.session import checkpoint, scratch_folder, table
from chronoward.sources import readers as rd
from chronoward.sources import sinks as sk


def header_offsets(spark: SparkSession, d: str) -> DataFrame:
    """Start sample of every listed segment inside its parent record."""
    rows = table(spark, d, "waveform_segment").select("segment_id", "parent_record", "waveform_samples").distinct()
    return rd.segment_offsets(rows, "parent_record", ["segment_id"], "waveform_samples").select(
        "parent_record", "segment_id", "start_sample"
    )


def channel_resolution(spark: SparkSession, d: str) -> DataFrame:
    """Place of pressure and saturation in each record's channel list; several matches would fail."""
    rows = table(spark, d, "numerics_record").select("record_id", "sig_names").distinct()
    return rows.select("record_id", *[
        rd.resolve_channel(F.col("sig_names"), name, rd.VITAL_ALIASES[name]).alias(at)
        for name, at in (("ABP Mean", "abp_at"), ("SpO2", "spo2_at"))
    ])


def numerics_index(spark: SparkSession, d: str) -> DataFrame:
    """Records with a start: their span and the place of each vital sign, by name or first alias."""
    rows = table(spark, d, "numerics_record").filter("start_epoch is not null")
    return rows.select(
        "record_id", "patient_id", "start_epoch", F.round(F.col("start_epoch") + F.col("sig_len") / F.col("fs"), 3).alias("end_epoch"),
        *[rd.first_alias(F.col("sig_names"), n, a).alias(f"at_{i}") for i, (n, a) in enumerate(rd.VITAL_ALIASES.items())],
    ).distinct()


def free_segment_manifest(spark: SparkSession, d: str) -> DataFrame:
    """Segments classified as free of the drugs, checked for repeats and contradictions."""
    from chronoward.plans.intervals_cohort import exposure_classification

    manifest = exposure_classification(spark, d).select("segment_id", "vasopressor_free")
    return rd.free_segments(manifest, "segment_id", "vasopressor_free")


def target_bundle(spark: SparkSession, d: str) -> DataFrame:
    """Future values of each minute as target and mask arrays, written with a sidecar and read back."""
    t = future_target_center(spark, d).groupBy("segment_id", "channel_name", "minute").agg(
        F.sort_array(F.collect_list(F.struct("horizon", F.col("target").isNotNull().alias("ok"), F.coalesce("target", F.lit(0.0)).alias("y")))).alias("x")
    )
    bundle = t.select(
        "segment_id", "channel_name", "minute", F.transform("x", lambda s: s["y"]).alias("targets"), F.transform("x", lambda s: s["ok"]).alias("mask")
    )
    path = scratch_folder(spark, "bundle")
    sk.write_bundle(bundle, path, "targets", "mask", [f"value_in_{h}" for h in (5, 10, 15)], "1")
    return sk.read_bundle(spark, path, "1").select(
        "segment_id", "channel_name", "minute", F.posexplode("targets").alias("target_index", "y"), "mask"
    ).select("segment_id", "channel_name", "minute", "target_index", F.when(F.get("mask", F.col("target_index")), F.col("y")).alias("y"))


def channel_stats(spark: SparkSession, d: str) -> DataFrame:
    """Normalisation statistics of the training rows, kept on disk and read back."""
    from chronoward.operators import features as ft
    from chronoward.plans.anchors_features import long_cache

    train = long_cache(spark, d).filter(F.lower(F.trim("split_label")) == "train")
    path = scratch_folder(spark, "channel-stats")
    sk.write_channel_stats(ft.moments(train, ["feature_name"], "value"), path)
    x = sk.read_channel_stats(spark, path)
    return x.select("feature_name", "n", F.round("mean", 6).alias("mean"), F.round("std", 6).alias("std"))


def feature_schema(spark: SparkSession, d: str) -> DataFrame:
    """Schema rows of the feature cache: place, name, unit and how many valid entries it has."""
    from chronoward.plans.anchors_features import NAMES, long_cache

    rows = sk.schema_rows(spark, [(n, u) for n, u in zip(NAMES, ("mmHg", "1/min", "%", "1/min", "a.u.", "ms2"), strict=True)], "per minute")
    n = long_cache(spark, d).groupBy("feature_name").agg(F.count("value").alias("n_valid"))
    return rows.join(F.broadcast(n), "feature_name", "left").select("feature_index", "feature_name", "unit", "window", "n_valid")


def cache_integrity(spark: SparkSession, d: str) -> DataFrame:
    return sk.integrity(table(spark, d, "feature_cache"), ["anchor_id"], "minute_idx", 20)


def event_properties(spark: SparkSession, d: str) -> DataFrame:
    """JSON properties of events: how many carry a whole number ``k``, and its extent and mean by type."""
    k = F.get_json_object("props", "$.k").try_cast("long")
    return table(spark, d, "events").groupBy("event_type").agg(
        F.count(F.lit(1)).alias("n"), F.count(k).alias("n_k"), F.min(k).alias("least"), F.max(k).alias("greatest"),
        F.round(F.avg(k), 6).alias("mean_k"),
    )


def _training(spark: SparkSession, d: str) -> DataFrame:
    """Every channel's trailing features, its value five minutes later and whether that is an event."""
    keys = ["segment_id", "channel_name", "minute"]
    t = future_target_center(spark, d).filter("horizon = 5 and target is not null").select(*keys, "target")
    x = history_features(spark, d).join(t, keys)
    _, event = channel_events(F.col("channel_name"), F.col("target"), RULES)
    flags = {f"is_{i}": (F.col("channel_name") == c).cast("double") for i, c in enumerate(RULES)}
    return checkpoint(x.withColumns(flags).withColumn("event", event).withColumn(
        "part", F.when(F.pmod(F.xxhash64("segment_id"), F.lit(10)) < 6, "train").when(
            F.pmod(F.xxhash64("segment_id"), F.lit(10)) < 8, "val").otherwise("test")
    ))


FEATURES = ["mean_5", "min_5", "max_5", "std_5", "slope_5", *(f"is_{i}" for i in range(len(RULES)))]


def gbt_train(spark: SparkSession, d: str) -> DataFrame:
    """Event in five minutes from trailing features: the boosted trees best on validation, and logistic regression."""
    return md.classifier_report(_training(spark, d), FEATURES, "event", "part")


def linear_baseline(spark: SparkSession, d: str) -> DataFrame:
    """Value in five minutes from trailing features: the boosted trees best on validation, and linear regression."""
    return md.regressor_report(_training(spark, d), FEATURES, "target", "part")


QUERIES = {
    f.__name__: f
    for f in (
        header_offsets, channel_resolution, numerics_index, free_segment_manifest, target_bundle, channel_stats, feature_schema,
        cache_integrity, event_properties, gbt_train, linear_baseline,
    )
}

SQL = {
    "header_offsets": """with r as (select distinct segment_id, parent_record, waveform_samples from waveform_segment
            where parent_record is not null)
        select parent_record, segment_id, cast(coalesce(sum(waveform_samples) over (partition by parent_record
            order by segment_id rows between unbounded preceding and 1 preceding), 0) as bigint) start_sample from r""",
    "channel_resolution": """with r as (select distinct record_id, sig_names from numerics_record)
        select record_id,
               nullif(list_position(list_transform(sig_names, lambda x: x in ('ABP Mean', 'ABPMean', 'ART Mean', 'ARTMean')), true), 0) - 1 abp_at,
               nullif(list_position(list_transform(sig_names, lambda x: x in ('SpO2', '%SpO2')), true), 0) - 1 spo2_at from r""",
    "numerics_index": """select distinct record_id, patient_id, start_epoch, round(start_epoch + sig_len / fs, 3) end_epoch,
        coalesce(nullif(list_position(sig_names, 'ABP Mean'), 0), nullif(list_position(sig_names, 'ABPMean'), 0),
                 nullif(list_position(sig_names, 'ART Mean'), 0), nullif(list_position(sig_names, 'ARTMean'), 0)) - 1 at_0,
        nullif(list_position(sig_names, 'PULSE'), 0) - 1 at_1,
        coalesce(nullif(list_position(sig_names, 'SpO2'), 0), nullif(list_position(sig_names, '%SpO2'), 0)) - 1 at_2,
        nullif(list_position(sig_names, 'RESP'), 0) - 1 at_3, nullif(list_position(sig_names, 'HR'), 0) - 1 at_4
        from numerics_record where start_epoch is not null""",
    "free_segment_manifest": f"with {_SEG} select segment_id from cl where c = 'classified_no_overlap'",
    "target_bundle": f"""with {_TL}, h as (select * from (values (0, 5), (1, 10), (2, 15)) h(i, horizon))
        select a.segment_id, a.channel_name, a."minute", i target_index, b."value" y from tl a cross join h
        left join tl b on a.segment_id = b.segment_id and a.channel_name = b.channel_name and b."minute" = a."minute" + horizon""",
    "channel_stats": f"""with {_C} select feature_name, count(v) n, round(avg(v), 6) mean,
        round(case when stddev_pop(v) < 1e-8 then 1 else stddev_pop(v) end, 6) "std" from lc
        where lower(trim(split_label)) = 'train' group by 1""",
    "feature_schema": f"""with {_C}, u as (select * from (values ('map_mean', 'mmHg'), ('hr_mean', '1/min'), ('spo2_mean', '%'),
            ('resp_rate', '1/min'), ('pulse_amp', 'a.u.'), ('hrv_power', 'ms2')) u(feature_name, unit))
        select nm.i - 1 feature_index, feature_name, unit, 'per minute' "window", count(v) n_valid
        from nm join u using (feature_name) left join lc using (feature_name) group by nm.i, feature_name, unit""",
    "cache_integrity": """with s as (select anchor_id, minute_idx, count(*) c from feature_cache group by 1, 2),
        k as (select anchor_id, count(*) filter (where minute_idx between 0 and 19) k,
                     count(*) filter (where minute_idx not between 0 and 19) o, count(*) filter (where c > 1) r from s group by 1)
        select count(*) n_groups, count(*) filter (where k < 20) n_incomplete, cast(sum(o) as bigint) n_outside,
               cast(sum(r) as bigint) n_repeated from k""",
    "event_properties": """with k as (select event_type, try_cast(json_extract_string(props, '$.k') as bigint) k from events)
        select event_type, count(*) n, count(k) n_k, min(k) least, max(k) greatest, round(avg(k), 6) mean_k from k group by 1""",
}
