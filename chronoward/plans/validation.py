"""Queries of validators, audits, fallbacks, examples and report rows."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from chronoward.functions import arrays as ar
from chronoward.functions import validators as va
from chronoward.operators import anchors as an
from chronoward.operators import evaluation as ev
from chronoward.operators import features as ft
from chronoward.operators import intervals as iv
from chronoward.operators.timeline import minute_index
from chronoward.plans.anchors_features import NAMES, PROPORTIONS, _C, cache_rows, long_cache
from chronoward.plans.episodes_labels import _AN, _TL, INPUT_MINUTES, anchors, sustained_episodes, timeline
from chronoward.plans.evaluation_stats import _P, _reg, predictions
from chronoward.session import table


def validated_anchors(spark: SparkSession, d: str) -> DataFrame:
    """Anchors with their ids checked: a fractional anchor id or an empty segment id fails the query."""
    rows = table(spark, d, "feature_cache").filter("anchor_id is not null and segment_id is not null")
    return rows.select(
        va.integral_id(F.col("anchor_id"), "anchor_id").alias("anchor_id"), va.identifier(F.col("segment_id"), "segment_id").alias("segment_id")
    ).distinct()


def identifier_audit(spark: SparkSession, d: str) -> DataFrame:
    """Patient ids of the feature cache: rows, missing ids, and spellings per distinct number."""
    rows = table(spark, d, "feature_cache").select("patient_id", F.regexp_replace("patient_id", r"\D", "").try_cast("long").alias("number"))
    per = rows.groupBy("number").agg(F.count(F.lit(1)).alias("n"), F.countDistinct("patient_id").alias("k"))
    return per.agg(
        F.sum("n").alias("n_rows"), F.coalesce(F.sum(F.when(F.col("number").isNull(), F.col("n"))), F.lit(0)).alias("n_without_number"),
        F.count("number").alias("n_patients"), F.count_if(F.col("number").isNotNull() & (F.col("k") > 1)).alias("n_spelt_differently"),
    )


def rate_audit(spark: SparkSession, d: str) -> DataFrame:
    """Numerics records by sampling rate, and how many spans agree with their number of samples to a second."""
    rows = table(spark, d, "numerics_record").select("record_id", "start_epoch", "end_epoch", "fs", "sig_len").distinct()
    agrees = F.abs(F.col("end_epoch") - F.col("start_epoch") - F.col("sig_len") / F.col("fs")) <= 1.0
    return rows.groupBy(va.rate_class(F.col("fs")).alias("rate")).agg(
        F.count(F.lit(1)).alias("n_records"), F.count_if(F.coalesce(agrees, F.lit(False))).alias("n_consistent"),
        F.count_if(agrees.isNull()).alias("n_without_span"),
    )


def column_swap(spark: SparkSession, d: str) -> DataFrame:
    """Rate of an event: purchases and signups keep theirs in the properties, the others in the value."""
    k = F.get_json_object("props", "$.k").try_cast("double")
    rate = va.swap_for(F.col("event_type"), ["purchase", "signup"], k, F.col("value"))
    return table(spark, d, "events").groupBy("event_type").agg(
        F.count(rate).alias("n"), F.round(F.avg(rate), 6).alias("mean_rate"), F.max(rate).alias("max_rate")
    )


def split_label_map(spark: SparkSession, d: str) -> DataFrame:
    """Segments with the split of their subject; a subject without a split fails the query."""
    rows = table(spark, d, "waveform_segment").filter("subject_id is not null").select("segment_id", "subject_id").distinct()
    splits = an.entity_split(rows.select("subject_id").distinct(), F.col("subject_id"), PROPORTIONS)
    return an.apply_splits(rows, splits, "subject_id")


def group_scopes(spark: SparkSession, d: str) -> DataFrame:
    """Number of exclusion groups of the segments by scope."""
    rows = table(spark, d, "waveform_segment").filter("segment_id is not null")
    recording = va.record_of_segment(F.col("segment_name"))
    args = (F.col("segment_id"), recording, F.lit(None).cast("string"), F.col("subject_id_str"))
    scopes = F.array(*[
        F.struct(F.lit(s).alias("scope"), va.group_id(s, *args).alias("g")) for s in ("none", "segment", "recording", "icu-stay", "patient")
    ])
    return rows.select(F.explode(scopes).alias("x")).groupBy("x.scope").agg(F.countDistinct("x.g").alias("n_groups"))


def source_identity_audit(spark: SparkSession, d: str) -> DataFrame:
    """Do anchors' segments and names match the listed segments? Counts of each way they fail."""
    a = table(spark, d, "feature_cache").select("anchor_id", "segment_id", "segment_name").distinct()
    s = table(spark, d, "waveform_segment").filter("segment_id is not null").groupBy("segment_id").agg(
        F.collect_set("segment_name").alias("names")
    )
    x = a.join(s, "segment_id", "left")
    known = F.col("names").isNotNull()
    return x.agg(
        F.count(F.lit(1)).alias("n_anchors"), F.count_if(F.col("segment_id").isNull()).alias("n_without_segment"),
        F.count_if(F.col("segment_id").isNotNull() & ~known).alias("n_unlisted"),
        F.count_if(known & ~F.coalesce(F.array_contains("names", F.col("segment_name")), F.lit(False))).alias("n_other_name"),
    )


def subwindow_means(spark: SparkSession, d: str) -> DataFrame:
    """Mean of each feature's valid minutes in four windows of five minutes per anchor."""
    x = long_cache(spark, d).filter("minute_idx between 0 and 19")
    return x.groupBy("anchor_id", "feature_name", F.floor(F.col("minute_idx") / 5).cast("int").alias("part")).agg(
        F.round(F.avg("value"), 5).alias("mean"), F.count("value").alias("n_valid")
    )


def array_variation(spark: SparkSession, d: str) -> DataFrame:
    """Spread measures of each segment: interquartile range, variation coefficient, relative and pulse variation."""
    x = table(spark, d, "embeddings").select("vec_id", ar.as_double(F.col("embedding")).alias("x"))
    return x.select(
        "vec_id", F.round(ar.iqr(F.col("x")), 6).alias("iqr"), F.round(ar.variation_coefficient(F.col("x")), 4).alias("cv"),
        F.round(ar.relative_variation(F.col("x")), 4).alias("relative_variation"), F.round(ar.peak_variation(F.col("x")), 4).alias("peak_variation"),
        ar.longest_true_span(F.col("x"), lambda v: v > 0).alias("s"),
    ).select("vec_id", "iqr", "cv", "relative_variation", "peak_variation", F.col("s.start").alias("start"), F.col("s.end").alias("end"))


def anchors_with_fallback(spark: SparkSession, d: str) -> DataFrame:
    """Anchors of the cache where a segment has any, else every five minutes of its series' extent."""
    listed = anchors(spark, d).groupBy("segment_id", F.col("input_end").alias("minute")).agg(F.lit("manifest").alias("origin"))
    ext = timeline(spark, d).groupBy("segment_id").agg(F.min("minute").alias("lo"), F.max("minute").alias("hi"))
    none = ext.join(listed.select("segment_id").distinct(), "segment_id", "left_anti")
    grid = an.anchor_grid(none, F.col("lo") + 20, F.col("hi") + 1, 5, min_count=3).select(
        "segment_id", F.col("anchor").alias("minute"), F.lit("grid").alias("origin")
    )
    return listed.unionByName(grid)


def qc_examples(spark: SparkSession, d: str) -> DataFrame:
    """The three longest episodes of each event, ties by segment and start."""
    e = sustained_episodes(spark, d).select("segment_id", "event_name", "start", "duration", (-F.col("duration")).alias("falling"))
    top = an.top_per_group(e, ["event_name"], ["falling", "segment_id", "start"], 3)
    return top.select("event_name", "segment_id", "start", "duration")


def prediction_report(spark: SparkSession, d: str) -> DataFrame:
    """Agreement of a perfect, a mean and both model predictions with the truth, one labelled row each."""
    p = predictions(spark, d)
    mean = p.filter("split = 'N'").agg(F.avg("y").alias("m"))
    rows = p.join(F.broadcast(mean)).select("y", F.explode(F.array(*[
        F.struct(F.lit(n).alias("row_name"), F.col(c).cast("double").alias("p"))
        for n, c in (("perfect", "y"), ("training_mean", "m"), ("model_a", "pa"), ("model_b", "pb"))
    ])).alias("x")).select("y", "x.*")
    out = rows.groupBy("row_name").agg(*ev.bland_altman(F.col("y"), F.col("p")))
    return out.select("row_name", "n", *[(F.round(c, 4) + 0.0).alias(c) for c in ("bias", "sd", "loa_low", "loa_high", "slope")])


def metric_deltas(spark: SparkSession, d: str) -> DataFrame:
    """Differences of both models' metrics per split, from their sums alone."""
    p = predictions(spark, d)
    sides = [
        p.groupBy("split").agg(*ev.regression_sums(F.col("y"), F.col(c))).select("split", *ev.regression_metrics_from_sums())
        for c in ("pa", "pb")
    ]
    b = sides[1].select("split", *[F.col(c).alias(f"{c}_b") for c in ("mae", "rmse", "r2")])
    return sides[0].join(b, "split").select("split", *[F.round(F.col(c) - F.col(f"{c}_b"), 5).alias(f"{c}_delta") for c in ("mae", "rmse", "r2")])


def random_baseline(spark: SparkSession, d: str) -> DataFrame:
    """Ranking metrics of a score that knows nothing: a hash of the line."""
    p = predictions(spark, d).withColumn("s", an.hash_unit(F.col("l_orderkey") * 7 + F.col("l_linenumber")))
    m = ev.ranking_metrics(ev.score_levels(p, F.col("label"), F.col("s")))
    return m.select("n_pos", "n_neg", F.round("auroc", 8).alias("auroc"), F.round("auprc", 8).alias("auprc"))


def observed_windows(spark: SparkSession, d: str) -> DataFrame:
    """Which anchors' input windows are whole and vary, from running sums at their two ends.

    ``anchor_id, segment_id, event_name, n, mean, std, is_observed``: no window is
    expanded to its minutes. Values are counted in thousandths, so sums are exact.
    """
    t = timeline(spark, d).select(
        F.concat_ws("|", "segment_id", "event_name").alias("label"), F.col("minute").alias("at"), F.lit(1).cast("long").alias("one"),
        F.rint(F.col("value") * 1000).cast("long").alias("v"),
    ).withColumn("vv", F.col("v") * F.col("v"))
    a = anchors(spark, d).withColumn("label", F.concat_ws("|", "segment_id", "event_name"))
    ends = a.select("anchor_id", "segment_id", "event_name", "label", F.explode(F.array(
        F.struct(F.lit(-1).alias("side"), (F.col("input_end") - INPUT_MINUTES).alias("at")), F.struct(F.lit(1).alias("side"), F.col("input_end").alias("at")),
    )).alias("e")).select("anchor_id", "segment_id", "event_name", "label", "e.side", "e.at")
    keys = ["anchor_id", "segment_id", "event_name"]
    sums = iv.sums_earlier(ends, t, [*keys, "side"], ["one", "v", "vv"]).groupBy(*keys).agg(
        *[F.sum(F.col(c) * F.col("side")).alias(c) for c in ("one", "v", "vv")]
    )
    mean = F.try_divide(F.col("v"), F.col("one")) / 1000.0
    std = F.when(F.col("one") > 0, F.sqrt(F.greatest(F.try_divide(F.col("vv"), F.col("one")) / 1e6 - mean * mean, F.lit(0.0))))
    return sums.select(
        *keys, F.col("one").alias("n"), F.round(mean, 5).alias("mean"), F.round(std, 4).alias("std"),
        F.coalesce((F.col("one") == INPUT_MINUTES) & (F.round(std, 4) > 1e-3), F.lit(False)).alias("is_observed"),
    )


def sliced_episodes(spark: SparkSession, d: str) -> DataFrame:
    """Sustained episodes inside each anchor's twenty minutes, cut to the window and counted from its start."""
    w = anchors(spark, d).select(
        F.concat_ws("|", "segment_id", "event_name").alias("k"), "anchor_id", "event_name", (F.col("input_end") - 20).alias("ls"), F.col("input_end").alias("le")
    )
    e = sustained_episodes(spark, d).select(
        F.concat_ws("|", "segment_id", "event_name").alias("k"), F.col("start").alias("rs"), F.col("end_exclusive").alias("re")
    )
    x = iv.overlap_join(w, e, 64)
    return x.select(
        "anchor_id", "event_name", (F.greatest("ls", "rs") - F.col("ls")).alias("start"), (F.least("le", "re") - F.col("ls")).alias("end_exclusive")
    ).distinct()


def local_interval_patterns(spark: SparkSession, d: str) -> DataFrame:
    """Short-long beat intervals against the local median of the valid neighbours, per segment.

    Minute intervals stand for beats: for each pair of neighbouring minutes the
    baseline is the median of the valid intervals from six before to six after it,
    without the pair, if there are at least five.
    """
    rr = timeline(spark, d).filter("channel_name = 'HR' and value between 30 and 220").select(
        "segment_id", "minute", (60.0 / F.col("value")).alias("rr")
    )
    places = F.array(*[F.lit(-k) for k in range(-6, 7)])
    sent = rr.select("segment_id", "rr", F.explode(places).alias("k"), "minute").select(
        "segment_id", "rr", (F.col("minute") + F.col("k")).alias("minute"), (-F.col("k")).alias("offset")
    )
    others = F.when(~F.col("offset").isin(0, 1), F.col("rr"))
    x = sent.groupBy("segment_id", "minute").agg(
        F.max(F.when(F.col("offset") == 0, F.col("rr"))).alias("a"), F.max(F.when(F.col("offset") == 1, F.col("rr"))).alias("b"),
        F.count(others).alias("n"), F.median(others).alias("base"),
    ).filter("a is not null and b is not null and n >= 5 and base > 1e-8")
    short_long = (F.col("a") < SHORT_RATIO * F.col("base")) & (F.col("b") > LONG_RATIO * F.col("base"))
    pause = short_long & (F.abs((F.col("a") + F.col("b")) / (2.0 * F.col("base")) - 1.0) <= PAUSE_TOLERANCE)
    return x.groupBy("segment_id").agg(
        F.count(F.lit(1)).alias("n_pairs"), F.count_if(short_long).alias("n_short_long"), F.count_if(pause).alias("n_compensatory")
    )


# What counts as a short, a long and a compensated interval against the local baseline.
SHORT_RATIO, LONG_RATIO, PAUSE_TOLERANCE = 0.80, 1.20, 0.25


def shock_indices(spark: SparkSession, d: str) -> DataFrame:
    """The five derived pressure and rate features; pulse amplitude splits the mean pressure into its two others."""
    def feature(i: int):
        v = F.get("feature_values", F.lit(i)).cast("double")
        return F.when(F.get("feature_mask", F.lit(i)) & ~F.isnan(v) & (F.abs(v) < float("inf")), v)

    x = cache_rows(spark, d).select("anchor_id", "minute_idx", feature(NAMES.index("map_mean")).alias("p"), feature(NAMES.index("hr_mean")).alias("hr"),
                                    feature(NAMES.index("pulse_amp")).alias("amp"))
    x = x.withColumn("sbp", F.col("p") + 2.0 * F.col("amp") / 3.0).withColumn("dbp", F.col("p") - F.col("amp") / 3.0)
    return x.select("anchor_id", "minute_idx", *[F.round(c, 5).alias(n) for n, c in ft.shock_family(F.col("hr"), F.col("sbp"), F.col("dbp"), F.col("p")).items()])


def timeline_preflight(spark: SparkSession, d: str) -> DataFrame:
    """Per channel: are times on the segment's basis? Share of readings within its grid, and the verdict (99.9 % rule)."""
    t = table(spark, d, "minute_timeline")
    m = minute_index(F.col("minute_time"), F.col("origin_seconds"))
    return t.groupBy("channel_name").agg(
        F.count(F.lit(1)).alias("n"), F.round(F.avg(F.coalesce(m.between(0, 1440), F.lit(False)).cast("double")), 6).alias("plausible_fraction")
    ).withColumn("basis", F.when(F.col("plausible_fraction") >= 0.999, "segment").otherwise("unknown"))


QUERIES = {
    f.__name__: f
    for f in (
        validated_anchors, identifier_audit, rate_audit, column_swap, split_label_map, group_scopes, source_identity_audit,
        subwindow_means, array_variation, anchors_with_fallback, qc_examples, prediction_report, metric_deltas, random_baseline,
        observed_windows, sliced_episodes, local_interval_patterns, shock_indices, timeline_preflight,
    )
}

_U = "(({}::hugeint * 2654435761) % 1000003) / 1000003.0"

SQL = {
    "validated_anchors": "select distinct anchor_id, trim(segment_id) segment_id from feature_cache where anchor_id is not null and segment_id is not null",
    "identifier_audit": """with r as (select patient_id, try_cast(regexp_replace(patient_id, '\\D', '', 'g') as bigint) k from feature_cache),
        p as (select k, count(*) n, count(distinct patient_id) s from r group by 1)
        select cast(sum(n) as bigint) n_rows, cast(coalesce(sum(n) filter (where k is null), 0) as bigint) n_without_number,
               count(k) n_patients, count(*) filter (where k is not null and s > 1) n_spelt_differently from p""",
    "rate_audit": """with r as (select distinct record_id, start_epoch, end_epoch, fs, sig_len from numerics_record),
        a as (select case when fs is null then null when abs(fs - 1) <= 1e-3 then 'per_second' when abs(fs - 1.0::double / 60) <= 1e-3
                          then 'per_minute' else 'other' end rate, abs(end_epoch - start_epoch - sig_len / fs) <= 1 g from r)
        select rate, count(*) n_records, count(*) filter (where g) n_consistent, count(*) filter (where g is null) n_without_span from a group by 1""",
    "column_swap": """with r as (select event_type, case when event_type in ('purchase', 'signup')
            then try_cast(json_extract_string(props, '$.k') as double) else "value" end x from events)
        select event_type, count(x) n, round(avg(x), 6) mean_rate, max(x) max_rate from r group by 1""",
    "split_label_map": f"""select segment_id, subject_id, case when {_U.format('subject_id')} < 0.7 then 'train'
        when {_U.format('subject_id')} < 0.85 then 'val' else 'test' end split_label
        from (select distinct segment_id, subject_id from waveform_segment where subject_id is not null)""",
    "group_scopes": """with r as (select * from waveform_segment where segment_id is not null)
        select 'none' scope, count(distinct '') n_groups from r union all select 'segment', count(distinct segment_id) from r
        union all select 'recording', count(distinct regexp_replace(segment_name, '_\\d+$', '')) from r
        union all select 'icu-stay', count(distinct segment_id) from r union all select 'patient', count(distinct subject_id_str) from r""",
    "source_identity_audit": """with a as (select distinct anchor_id, segment_id, segment_name from feature_cache),
        s as (select segment_id, list(distinct segment_name) l from waveform_segment where segment_id is not null group by 1)
        select count(*) n_anchors, count(*) filter (where a.segment_id is null) n_without_segment,
               count(*) filter (where a.segment_id is not null and l is null) n_unlisted,
               count(*) filter (where l is not null and not coalesce(list_contains(l, segment_name), false)) n_other_name
        from a left join s on a.segment_id = s.segment_id""",
    "subwindow_means": f"""with {_C} select anchor_id, feature_name, cast(minute_idx // 5 as int) part, round(avg(v), 5) mean, count(v) n_valid
        from lc where minute_idx between 0 and 19 group by 1, 2, 3""",
    "array_variation": """with v as (select vec_id, unnest(range(0, len(embedding))) i, cast(unnest(embedding) as double) x from embeddings),
        a as (select vec_id, quantile_cont(x, 0.75) - quantile_cont(x, 0.25) q, avg(x) m, stddev_pop(x) s, min(x) lo, max(x) hi from v group by 1),
        r as (select vec_id, min(i) "start", max(i) + 1 "end" from (select *, i - row_number() over (partition by vec_id order by i) g
              from v where x > 0) group by vec_id, g qualify row_number() over (partition by vec_id order by max(i) - min(i) desc, min(i)) = 1)
        select vec_id, round(q, 6) iqr, round(case when abs(m) >= 1e-8 then s / abs(m) end, 4) cv,
               round(case when abs((hi + lo) / 2) >= 1e-8 then 100 * (hi - lo) / abs((hi + lo) / 2) end, 4) relative_variation,
               round(case when abs(hi) >= 1e-8 then 100 * (hi - lo) / abs(hi) end, 4) peak_variation, "start", "end"
        from a left join r using (vec_id)""",
    "anchors_with_fallback": f"""with {_TL},{_AN}, l as (select distinct segment_id, input_end "minute" from an),
        e as (select segment_id, min("minute") lo, max("minute") hi from tl group by 1),
        g as (select segment_id, unnest(range(lo + 20, hi + 2, 5)) "minute" from e
              where hi + 1 >= lo + 20 + 10 and segment_id not in (select segment_id from l))
        select segment_id, "minute", 'manifest' origin from l union all select segment_id, "minute", 'grid' from g""",
    "qc_examples": f"""with {_TL}, r as (select segment_id, event_name, "start", duration from ru where duration >= 5)
        select event_name, segment_id, "start", duration from r
        qualify row_number() over (partition by event_name order by duration desc, segment_id, "start") <= 3""",
    "prediction_report": f"""with {_P}, k as (select avg(y) m from pd where split = 'N'),
        r as (select y, unnest(['perfect', 'training_mean', 'model_a', 'model_b']) row_name, unnest([y, m, pa, pb]) p from pd, k)
        select row_name, count(*) n, round(avg(p - y), 4) + 0.0 bias, round(stddev_samp(p - y), 4) + 0.0 sd,
               round(avg(p - y) - 1.96 * stddev_samp(p - y), 4) + 0.0 loa_low, round(avg(p - y) + 1.96 * stddev_samp(p - y), 4) + 0.0 loa_high,
               round(regr_slope(p - y, (p + y) / 2), 4) + 0.0 slope from r group by 1""",
    "metric_deltas": f"""with {_P}, a as (select split, avg(abs(y - pa)) - avg(abs(y - pb)) m,
            sqrt(avg((y - pa) * (y - pa))) - sqrt(avg((y - pb) * (y - pb))) r,
            (sum((y - pb) * (y - pb)) - sum((y - pa) * (y - pa))) / (sum(y * y) - sum(y) * sum(y) / count(*)) d from pd group by 1)
        select split, round(m, 5) mae_delta, round(r, 5) rmse_delta, round(d, 5) r2_delta from a""",
    "random_baseline": f"""with {_P}, s as (select label, {_U.format('(l_orderkey * 7 + l_linenumber)')} s from pd),
        lv as (select s, count(*) filter (where label) p, count(*) filter (where not label) q from s group by 1),
        cu as (select *, sum(p) over w tp, sum(q) over w fp, sum(p) over () m, sum(q) over () n from lv
               window w as (order by s desc rows unbounded preceding))
        select cast(m as bigint) n_pos, cast(n as bigint) n_neg, round(sum(p * (n - fp + q / 2)) / (m * n), 8) auroc,
               round(sum(case when p > 0 then p * tp / (tp + fp) end) / m, 8) auprc from cu group by m, n""",
    "observed_windows": f"""with {_TL},{_AN},
        x as (select anchor_id, an.segment_id, an.event_name, count(tl."minute") n, avg(round_even("value" * 1000, 0)) / 1000 m,
                     stddev_pop(round_even("value" * 1000, 0)) / 1000 s
              from an left join tl on tl.segment_id = an.segment_id and tl.event_name = an.event_name
                   and tl."minute" between input_end - 10 and input_end - 1 group by 1, 2, 3)
        select anchor_id, segment_id, event_name, n, round(m, 5) mean, round(s, 4) "std",
               coalesce(n = 10 and round(s, 4) > 1e-3, false) is_observed from x""",
    "sliced_episodes": f"""with {_TL},{_AN}
        select distinct anchor_id, an.event_name, greatest(input_end - 20, "start") - (input_end - 20) "start",
               least(input_end, end_exclusive) - (input_end - 20) end_exclusive
        from an join ru on ru.segment_id = an.segment_id and ru.event_name = an.event_name
        where duration >= 5 and "start" < input_end and end_exclusive > input_end - 20""",
    "local_interval_patterns": f"""with {_TL}, r as (select segment_id, "minute" m, 60.0::double / "value" rr from tl
              where channel_name = 'HR' and "value" between 30 and 220),
        p as (select a.segment_id, a.m, a.rr a, b.rr b from r a join r b on a.segment_id = b.segment_id and b.m = a.m + 1),
        n as (select p.segment_id, p.m, any_value(a) a, any_value(b) b, count(*) k, median(r.rr) base from p join r on r.segment_id = p.segment_id
              and r.m between p.m - 6 and p.m + 6 and r.m <> p.m and r.m <> p.m + 1 group by 1, 2),
        f as (select segment_id, a < 0.8 * base and b > 1.2 * base sl, abs((a + b) / (2 * base) - 1) <= 0.25 c from n where k >= 5 and base > 1e-8)
        select segment_id, count(*) n_pairs, count(*) filter (where sl) n_short_long, count(*) filter (where sl and c) n_compensatory
        from f group by 1""",
    "shock_indices": f"""with {_C},
        p as (select anchor_id, minute_idx, max(v) filter (where feature_name = 'map_mean') p, max(v) filter (where feature_name = 'hr_mean') h,
                     max(v) filter (where feature_name = 'pulse_amp') a from lc group by 1, 2),
        q as (select *, p + 2.0::double * a / 3.0::double sb, p - a / 3.0::double db from p)
        select anchor_id, minute_idx, round(case when abs(sb) > 1e-8 then h / sb end, 5) shock_index,
               round(case when abs(p) > 1e-8 then h / p end, 5) modified_shock_index,
               round(case when abs(db) > 1e-8 then h / db end, 5) diastolic_shock_index,
               round(p - 65, 5) map_margin_65, round(sb - 90, 5) sbp_margin_90 from q""",
    "timeline_preflight": """with r as (select channel_name, count(*) n, round(avg(case when round_even((minute_time - origin_seconds) / 60, 0)
            between 0 and 1440 then 1.0::double else 0 end), 6) plausible_fraction from minute_timeline group by 1)
        select *, case when plausible_fraction >= 0.999 then 'segment' else 'unknown' end basis from r""",
}
