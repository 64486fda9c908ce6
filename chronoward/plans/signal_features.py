"""Queries of array functions, series features and waveform features.

A row of embeddings stands for one waveform segment of 64 samples (32 Hz).
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from chronoward.functions import arrays as ar
from chronoward.operators import episodes as ep
from chronoward.operators import series as sr
from chronoward.operators import signals as sg
from chronoward.operators.ordered_scan import running_sums
from chronoward.operators.quantiles import exact_quantiles
from chronoward.plans.episodes_labels import _AN, _TL, timeline
from chronoward.session import checkpoint, settled_side, table

FS = 32.0
KEYS = ["segment_id", "channel_name"]


def _vectors(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "embeddings").select("vec_id", "label", ar.as_double(F.col("embedding")).alias("x"))


def array_quality(spark: SparkSession, d: str) -> DataFrame:
    x = F.col("x")
    return _vectors(spark, d).select(
        "vec_id", F.size(x).alias("n"), F.round(F.array_min(x), 6).alias("min"), F.round(F.array_max(x), 6).alias("max"),
        F.round(ar.flatline_fraction(x, 8, 0.08), 6).alias("flatline_fraction"),
        F.round(ar.extreme_fraction(x), 6).alias("extreme_fraction"), ar.zero_crossings(x).alias("zero_crossings"),
    )


def array_robust_scale(spark: SparkSession, d: str) -> DataFrame:
    x = F.col("x")
    return _vectors(spark, d).select(
        "vec_id", F.round(ar.median(x), 6).alias("median"), F.round(ar.robust_scale(x), 6).alias("scale"),
        F.round(ar.mean(x), 6).alias("mean"), F.round(ar.slope(x), 6).alias("slope"),
    )


def array_runs(spark: SparkSession, d: str) -> DataFrame:
    """Runs of positive samples per segment."""
    bins = _vectors(spark, d).select("vec_id", F.posexplode("x").alias("minute", "v")).withColumn("event", F.col("v") > 0)
    return ep.runs(bins, ["vec_id"])


def array_moments(spark: SparkSession, d: str) -> DataFrame:
    """Bias-corrected skewness and excess kurtosis, longest positive run."""
    x, n = F.col("x"), F.size("x")
    m2, m3, m4 = (ar.central_moment(x, k) for k in (2, 3, 4))
    g1, g2 = m3 / F.pow(m2, F.lit(1.5)), m4 / (m2 * m2) - 3.0
    return _vectors(spark, d).select(
        "vec_id", F.round(F.sqrt(n * (n - 1)) / (n - 2) * g1, 5).alias("skewness"),
        F.round((n - 1) / ((n - 2) * (n - 3)) * ((n + 1) * g2 + 6), 5).alias("excess_kurtosis"),
        ar.longest_true_run(x, lambda v: v > 0).alias("longest_positive"),
    )


def poincare(spark: SparkSession, d: str) -> DataFrame:
    p = _vectors(spark, d).select("vec_id", ar.poincare(F.col("x")).alias("p"))
    return p.select("vec_id", *[F.round(f"p.{c}", 6).alias(c) for c in ("sd1", "sd2", "ratio")])


def resample_template(spark: SparkSession, d: str) -> DataFrame:
    """Each segment at 16 points (one row per point)."""
    x = _vectors(spark, d).select("vec_id", F.posexplode(ar.resample(F.col("x"), 16)).alias("point", "v"))
    return x.select("vec_id", "point", F.round("v", 6).alias("v"))


def _leave_one_out(spark: SparkSession, d: str) -> DataFrame:
    """``vec_id, label, point, v, t``: each sample with the median of the other segments of its class at that point.

    The median without one value follows from the three middle order statistics, so
    no class is gathered.
    """
    long = checkpoint(_vectors(spark, d).filter("label is not null").select("vec_id", "label", F.posexplode("x").alias("point", "v")))
    place = ["label", "point"]
    levels = long.groupBy(*place, "v").agg(F.count(F.lit(1)).alias("n")).withColumn("g", F.concat_ws("|", *place))
    run = running_sums(levels, "g", ["v"], ["n"])
    middle = settled_side(run.groupBy("g").agg(F.sum("n").alias("total")))
    at = F.floor((F.col("total") - 1) / 2)  # the middle, or the lower one of two
    here = run.join(middle, "g").groupBy(*place, "total").agg(*[
        F.max(F.when((at + k >= F.col("before_n")) & (at + k < F.col("before_n") + F.col("n")), F.col("v"))).alias(c)
        for k, c in ((-1, "below"), (0, "mid"), (1, "above"))
    ])
    v = F.col("v")
    odd = (
        F.when(v < F.col("mid"), F.col("mid") + F.col("above")).when(v > F.col("mid"), F.col("below") + F.col("mid"))
        .otherwise(F.col("below") + F.col("above")) / 2.0
    )
    even = F.when(v <= F.col("mid"), F.col("above")).otherwise(F.col("mid"))
    x = long.join(settled_side(here), place)
    return x.select("vec_id", *place, "v", F.when(F.col("total") % 2 == 1, odd).otherwise(even).alias("t"), "total")


def template_distance(spark: SparkSession, d: str) -> DataFrame:
    """Correlation and root mean square distance to the median template of the other segments of the class."""
    x = _leave_one_out(spark, d).filter("total >= 3")
    return x.groupBy("vec_id", "label").agg(
        F.round(F.when((F.stddev_pop("v") >= 1e-8) & (F.stddev_pop("t") >= 1e-8), F.corr("v", "t")), 5).alias("correlation"),
        F.round(F.sqrt(F.avg((F.col("v") - F.col("t")) * (F.col("v") - F.col("t")))), 5).alias("distance"),
    )


def template_consistency(spark: SparkSession, d: str) -> DataFrame:
    """Per class the median correlation of its segments with the template of the others."""
    x = template_distance(spark, d).filter("correlation is not null")
    q = exact_quantiles(x, ["label"], "correlation", {"median": 0.5})
    return q.select("label", F.round("median", 5).alias("median_correlation"))


def gap_interpolation(spark: SparkSession, d: str) -> DataFrame:
    bins = timeline(spark, d).select(*KEYS, "minute", "value")
    x = sr.fill_short_gaps(bins, KEYS, 3).filter("is_filled")
    return x.select(*KEYS, "minute", F.round("value", 6).alias("value"))


def adjacent_ratios(spark: SparkSession, d: str) -> DataFrame:
    """Per series: average real variability, root mean square of successive differences, mean ratio, drops."""
    x = sr.with_previous(timeline(spark, d).select(*KEYS, "minute", "value"), KEYS)
    diff = F.col("value") - F.col("previous")
    return x.groupBy(*KEYS).agg(
        F.count(diff).alias("n_pairs"), F.round(F.avg(F.abs(diff)), 6).alias("arv"),
        F.round(F.sqrt(F.avg(diff * diff)), 6).alias("rmssd"),
        F.round(F.avg(F.when(F.abs("previous") >= 1e-8, F.col("value") / F.col("previous"))), 6).alias("mean_ratio"),
        F.count_if(F.coalesce(diff <= -10, F.lit(False))).alias("n_drops"),
    )


def decline_runs(spark: SparkSession, d: str) -> DataFrame:
    """Longest run of falling minutes per series."""
    x = sr.with_previous(timeline(spark, d).select(*KEYS, "minute", "value"), KEYS)
    falling = x.withColumn("event", F.coalesce(F.col("value") < F.col("previous"), F.lit(False)))
    return ep.longest_run(falling.select(*KEYS, "minute", "event"), KEYS, 2)


def rr_validity(spark: SparkSession, d: str) -> DataFrame:
    """Beat intervals from heart rate: plausible share (30 to 220 a minute), SD1 and SD2 of neighbours."""
    hr = timeline(spark, d).filter("channel_name = 'HR'").select("segment_id", "minute", "value")
    rr = hr.withColumn("value", F.when(F.col("value").between(30, 220), 60.0 / F.col("value")))
    x = sr.with_previous(rr, ["segment_id"])
    ok = F.col("value").isNotNull() & F.col("previous").isNotNull()
    step = F.when(ok, F.col("value") - F.col("previous"))
    agg = x.groupBy("segment_id").agg(
        F.count(F.lit(1)).alias("n"), F.avg(F.col("value").isNotNull().cast("double")).alias("plausible"),
        F.stddev_pop("value").alias("v"), F.stddev_pop(step).alias("d"), F.count(step).alias("pairs"),
    )
    sd1, sd2 = ar.poincare_axes(F.col("v"), F.col("d"))
    enough = F.col("pairs") >= 20
    return agg.select(
        "segment_id", "n", F.round("plausible", 6).alias("plausible_fraction"), F.round(F.when(enough, sd1), 6).alias("sd1"),
        F.round(F.when(enough, sd2), 6).alias("sd2"),
    )


def baseline_jumps(spark: SparkSession, d: str) -> DataFrame:
    return sr.block_jumps(timeline(spark, d).select(*KEYS, "minute", "value"), KEYS, 5, F.lit(8.0))


def history_features(spark: SparkSession, d: str) -> DataFrame:
    """Trailing five-minute features, emitted only where all five minutes exist."""
    bins = timeline(spark, d).select(*KEYS, "minute", "value")
    x = sr.trailing(bins, KEYS, 5, [
        F.round(F.avg("value"), 6).alias("mean_5"), F.round(F.min("value"), 6).alias("min_5"), F.round(F.max("value"), 6).alias("max_5"),
        F.round(F.stddev_pop("value"), 6).alias("std_5"),
        (F.round(F.regr_slope("value", F.col("offset").cast("double")), 6) + 0.0).alias("slope_5"),
    ])
    return x


def component_dedup(spark: SparkSession, d: str) -> DataFrame:
    """Per anchor and event: history features of its last three minutes, each distinct interval computed once."""
    from chronoward.plans.episodes_labels import RULES, anchors

    channel = F.create_map(*[F.lit(x) for c, r in RULES.items() for x in (r[0], c)])[F.col("event_name")]
    wanted = anchors(spark, d).select(
        "anchor_id", "segment_id", channel.alias("channel_name"),
        F.explode(F.array(*[F.col("input_end") - k for k in (1, 2, 3)])).alias("minute"),
    )
    distinct = wanted.select(*KEYS, "minute").distinct()
    feats = history_features(spark, d).join(distinct, [*KEYS, "minute"], "left_semi")
    return wanted.join(feats.select(*KEYS, "minute", "mean_5", "min_5", "slope_5"), [*KEYS, "minute"]).select(
        "anchor_id", *KEYS, "minute", "mean_5", "min_5", "slope_5"
    )


def burden_features(spark: SparkSession, d: str) -> DataFrame:
    """Per series: share and longest run of event minutes, lowest and highest value."""
    t = timeline(spark, d)
    base = t.groupBy(*KEYS).agg(
        F.count(F.lit(1)).alias("n"), F.round(F.avg(F.col("event").cast("double")), 6).alias("event_fraction"),
        F.min("value").alias("lowest"), F.max("value").alias("highest"),
    )
    longest = ep.longest_run(t.select(*KEYS, "minute", "event"), KEYS, 1).select(*KEYS, F.col("duration").alias("longest_event"))
    return base.join(longest, KEYS, "left").withColumn("longest_event", F.coalesce("longest_event", F.lit(0)))


def quality_features(spark: SparkSession, d: str) -> DataFrame:
    """Per signal: windows, mean fractions and share of usable micro-windows."""
    rows = table(spark, d, "signal_quality").dropDuplicates(["window_id"])

    def clean(c: str):
        return F.when(~F.isnan(c) & F.col(c).between(0, 1), F.col(c))

    mask = F.size(F.filter("valid_micro_mask", lambda x: x))
    return rows.groupBy("segment_id", "channel_name").agg(
        F.count(F.lit(1)).alias("n_windows"), F.round(F.avg(clean("flatline_fraction")), 8).alias("flatline"),
        F.round(F.avg(clean("extreme_value_fraction")), 8).alias("extreme"),
        F.round(F.avg(clean("missing_micro_fraction")), 8).alias("missing"),
        F.round(F.sum(F.when(F.col("valid_micro_mask").isNotNull(), mask)) / F.sum(F.size("valid_micro_mask")), 8).alias("usable"),
    )


def pressure_interval_coupling(spark: SparkSession, d: str) -> DataFrame:
    """Per segment and lag of 0 to 2 minutes: correlation and slope of beat interval on pressure.

    Without variation a figure is NaN, as in SQL; Spark's own ``corr`` divides by zero there.
    """
    t = timeline(spark, d)
    p = t.filter("channel_name = 'ABP Mean'").select(
        "segment_id", F.col("value").alias("p"), "minute", F.explode(F.array(F.lit(0), F.lit(1), F.lit(2))).alias("lag")
    ).withColumn("at", F.col("minute") + F.col("lag"))
    r = t.filter("channel_name = 'HR' and value between 30 and 220").select(
        "segment_id", F.col("minute").alias("at"), (60.0 / F.col("value")).alias("rr")
    )
    nan = F.lit(float("nan"))
    corr = F.coalesce(F.try_divide(F.covar_pop("p", "rr"), F.stddev_pop("p") * F.stddev_pop("rr")), nan)
    slope = F.coalesce(F.regr_slope("rr", "p"), nan)
    x = p.join(r, ["segment_id", "at"]).groupBy("segment_id", "lag").agg(
        F.count(F.lit(1)).alias("n"), (F.round(corr, 5) + 0.0).alias("r"), (F.round(slope, 7) + 0.0).alias("slope"),
    )
    return x.filter("n >= 10")


def minute_patterns(spark: SparkSession, d: str) -> DataFrame:
    """Event flags of each anchor's ten input minutes as text: E event, . quiet, ? missing."""
    from chronoward.plans.episodes_labels import anchors

    wide = anchors(spark, d).withColumn("k", F.explode(F.sequence(F.lit(-10), F.lit(-1)))).withColumn(
        "minute", F.col("input_end") + F.col("k")
    )
    t = timeline(spark, d).select("segment_id", "event_name", "minute", "event")
    x = wide.join(t, ["segment_id", "event_name", "minute"], "left").withColumn(
        "c", F.when(F.col("event").isNull(), "?").when(F.col("event"), "E").otherwise(".")
    )
    pattern = F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("k", "c"))), lambda s: s["c"]), "")
    return x.groupBy("anchor_id", "segment_id", "event_name").agg(pattern.alias("pattern"))


def waveform_spectral(spark: SparkSession, d: str) -> DataFrame:
    return sg.segment_features(table(spark, d, "embeddings"), "vec_id", "embedding", FS, ["spectral"])


def waveform_entropy(spark: SparkSession, d: str) -> DataFrame:
    return sg.segment_features(table(spark, d, "embeddings"), "vec_id", "embedding", FS, ["entropy"])


def waveform_morphology(spark: SparkSession, d: str) -> DataFrame:
    return sg.segment_features(table(spark, d, "embeddings"), "vec_id", "embedding", FS, ["morphology"])


def beat_table(spark: SparkSession, d: str) -> DataFrame:
    return sg.beat_table(table(spark, d, "embeddings"), "vec_id", "embedding", FS)


def cyclic_variation(spark: SparkSession, d: str) -> DataFrame:
    """Variation of beat heights within slow cycles of each segment."""
    x = table(spark, d, "embeddings")
    return sg.cyclic_variation(
        sg.beat_table(x, "vec_id", "embedding", FS), sg.cycle_table(x, "vec_id", "embedding", FS, FS / 12), "vec_id"
    )


def pulse_timing(spark: SparkSession, d: str) -> DataFrame:
    """Per pair of segments (an even number leads, the next follows): paired beats and their delays."""
    beats = sg.beat_table(table(spark, d, "embeddings"), "vec_id", "embedding", FS).withColumn(
        "pair", F.floor(F.col("vec_id") / 2).cast("long")
    )
    pairs = sg.forward_pairs(beats.filter("vec_id % 2 = 0"), beats.filter("vec_id % 2 = 1"), "pair", 0, 6)
    return pairs.groupBy("pair").agg(
        F.count(F.lit(1)).alias("n_pairs"), F.avg("delay").alias("mean_delay"), F.stddev_pop("delay").alias("sd_delay")
    )


QUERIES = {
    f.__name__: f
    for f in (
        array_quality, array_robust_scale, array_runs, array_moments, poincare, resample_template, template_distance,
        template_consistency,
        gap_interpolation, adjacent_ratios, decline_runs, rr_validity, baseline_jumps, history_features, component_dedup,
        burden_features, quality_features, pressure_interval_coupling,
        minute_patterns, waveform_spectral, waveform_entropy, waveform_morphology, beat_table,
        cyclic_variation, pulse_timing,
    )
}

_V = "vx as (select vec_id, label, cast(embedding as double[]) x from embeddings)"
_PV = f"{_V}, pv as (select vec_id, label, unnest(range(0, len(x))) i, unnest(x) v from vx)"
_LOO = """
    os as (select label, i, list(v order by v) s from pv where label is not null group by 1, 2),
    lt as (select pv.vec_id, pv.label, pv.i, v, median(x) t from pv join (select label, i, s, unnest(range(1, len(s) + 1)) r, unnest(s) x
                  from os where len(s) >= 3) o on o.label = pv.label and o.i = pv.i where r <> list_position(s, v) group by 1, 2, 3, 4),
    td as (select vec_id, label, round(case when stddev_pop(v) >= 1e-8 and stddev_pop(t) >= 1e-8 then corr(v, t) end, 5) correlation,
                  round(sqrt(avg((v - t) * (v - t))), 5) distance from lt group by 1, 2)"""

SQL = {
    "array_quality": f"""with {_PV}, m as (select vec_id, count(*) n, min(v) lo, max(v) hi from pv group by 1),
        e as (select vec_id, avg(case when least(v - lo, hi - v) <= greatest((hi - lo) * 0.01, 1e-8) then 1.0::double else 0 end) ef
              from pv join m using (vec_id) group by 1),
        fw as (select vec_id, i // 8 k, stddev_pop(v) < 0.08 flat from pv group by 1, 2),
        f as (select vec_id, count(*) filter (where flat) / count(*) fl from fw group by 1),
        z as (select vec_id, count(*) filter (where pr < 0) zc from
              (select vec_id, v * lag(v) over (partition by vec_id order by i) pr from pv) group by 1)
        select vec_id, n, round(lo, 6) "min", round(hi, 6) "max", round(fl, 6) flatline_fraction,
               round(case when hi - lo < 1e-8 then 1 else ef end, 6) extreme_fraction, zc zero_crossings
        from m join f using (vec_id) join e using (vec_id) join z using (vec_id)""",
    "array_robust_scale": f"""with {_PV}, m as (select vec_id, median(v) md, avg(v) me, regr_slope(v, i) sl, stddev_pop(v) sd from pv group by 1),
        a as (select vec_id, md, me, sl, sd, 1.4826 * median(abs(v - md)) sc from pv join m using (vec_id) group by 1, 2, 3, 4, 5)
        select vec_id, round(md, 6) median, round(case when sc > 1e-8 then sc else greatest(sd, 1) end, 6) scale, round(me, 6) mean,
               round(sl, 6) slope from a""",
    "array_runs": f"""with {_PV}, g as (select vec_id, i, i - row_number() over (partition by vec_id order by i) g from pv where v > 0)
        select vec_id, min(i) "start", max(i) + 1 end_exclusive, count(*) duration from g group by vec_id, g""",
    "array_moments": f"""with {_PV}, m as (select vec_id, v, i, avg(v) over (partition by vec_id) m from pv),
        c as (select vec_id, count(*) n, avg(pow(v - m, 2)) m2, avg(pow(v - m, 3)) m3, avg(pow(v - m, 4)) m4 from m group by 1),
        g as (select vec_id, i - row_number() over (partition by vec_id order by i) g from pv where v > 0),
        l as (select vec_id, max(k) k from (select vec_id, g, count(*) k from g group by 1, 2) group by 1)
        select vec_id, round(sqrt(n * (n - 1)) / (n - 2) * m3 / pow(m2, 1.5), 5) skewness,
               round((n - 1) / ((n - 2) * (n - 3)) * ((n + 1) * (m4 / (m2 * m2) - 3) + 6), 5) excess_kurtosis,
               coalesce(k, 0) longest_positive from c left join l using (vec_id)""",
    "poincare": f"""with {_PV}, q as (select vec_id, v, v - lag(v) over (partition by vec_id order by i) d from pv),
        k as (select vec_id, count(*) n, sqrt(0.5) * stddev_pop(d) sd1,
                     sqrt(greatest(2 * pow(stddev_pop(v), 2) - 0.5 * pow(stddev_pop(d), 2), 0)) sd2 from q group by 1)
        select vec_id, round(case when n > 20 then sd1 end, 6) sd1, round(case when n > 20 then sd2 end, 6) sd2,
               round(case when n > 20 and sd2 > 1e-8 then sd1 / sd2 end, 6) ratio from k""",
    "resample_template": f"""with {_V}, p as (select vec_id, x, unnest(range(0, 16)) point from vx),
        q as (select *, point * (len(x) - 1) / 15.0::double t from p),
        r as (select *, cast(least(floor(t), len(x) - 2) as int) lo from q)
        select vec_id, cast(point as int) point, round(x[lo + 1] + (x[lo + 2] - x[lo + 1]) * (t - lo), 6) v from r""",
    "template_distance": f"""with {_PV},{_LOO} select vec_id, label, correlation, distance from td""",
    "template_consistency": f"""with {_PV},{_LOO} select label, round(median(correlation), 5) median_correlation from td
        where correlation is not null group by 1""",
    "gap_interpolation": f"""with {_TL}, n as (select segment_id, channel_name, "minute" a, "value" va,
              lead("minute") over w b, lead("value") over w vb from tl window w as (partition by segment_id, channel_name order by "minute")),
        g as (select *, unnest(range(a + 1, b)) m from n where b - a between 2 and 4)
        select segment_id, channel_name, m "minute", round(va + (vb - va) * (m - a) / (b - a), 6) "value" from g""",
    "adjacent_ratios": f"""with {_TL}, j as (select a.segment_id, a.channel_name, a."value" v, b."value" p from tl a left join tl b
            on a.segment_id = b.segment_id and a.channel_name = b.channel_name and b."minute" = a."minute" - 1)
        select segment_id, channel_name, count(p) n_pairs, round(avg(abs(v - p)), 6) arv,
               round(sqrt(avg((v - p) * (v - p))), 6) rmssd,
               round(avg(case when abs(p) >= 1e-8 then v / p end), 6) mean_ratio,
               count(*) filter (where v - p <= -10) n_drops from j group by 1, 2""",
    "decline_runs": f"""with {_TL}, j as (select a.segment_id, a.channel_name, a."minute" m from tl a join tl b
            on a.segment_id = b.segment_id and a.channel_name = b.channel_name and b."minute" = a."minute" - 1
            where a."value" < b."value"),
        g as (select *, m - row_number() over (partition by segment_id, channel_name order by m) g from j),
        r as (select segment_id, channel_name, min(m) "start", max(m) + 1 end_exclusive, count(*) duration from g
              group by segment_id, channel_name, g having count(*) >= 2)
        select * from r qualify row_number() over (partition by segment_id, channel_name
                                                   order by duration desc, end_exclusive desc) = 1""",
    "rr_validity": f"""with {_TL}, r as (select segment_id, "minute" m, case when "value" between 30 and 220 then 60.0::double / "value" end v
            from tl where channel_name = 'HR'),
        j as (select a.segment_id, a.v, b.v p from r a left join r b on a.segment_id = b.segment_id and b.m = a.m - 1)
        select segment_id, count(*) n, round(count(v) / count(*), 6) plausible_fraction,
               round(case when count(v - p) >= 20 then sqrt(0.5) * stddev_pop(v - p) end, 6) sd1,
               round(case when count(v - p) >= 20 then sqrt(greatest(2 * pow(stddev_pop(v), 2) - 0.5 * pow(stddev_pop(v - p), 2), 0)) end, 6) sd2
        from j group by 1""",
    "baseline_jumps": f"""with {_TL}, b as (select segment_id, channel_name, cast(floor("minute" / 5) as bigint) k, median("value") v
            from tl group by 1, 2, 3)
        select a.segment_id, a.channel_name, count(*) n_blocks, count(*) filter (where abs(a.v - c.v) > 8) n_jumps
        from b a left join b c on a.segment_id = c.segment_id and a.channel_name = c.channel_name and c.k = a.k - 1 group by 1, 2""",
    "history_features": f"""with {_TL}, w as (select a.segment_id, a.channel_name, a."minute" m, b."minute" k, b."value" v from tl a join tl b
            on a.segment_id = b.segment_id and a.channel_name = b.channel_name
            and b."minute" between a."minute" - 4 and a."minute")
        select segment_id, channel_name, m "minute", round(avg(v), 6) mean_5, round(min(v), 6) min_5, round(max(v), 6) max_5,
               round(stddev_pop(v), 6) std_5, round(regr_slope(v, k - m + 4), 6) + 0.0 slope_5
        from w group by 1, 2, 3 having count(*) = 5""",
    "component_dedup": f"""with {_TL},{_AN},
        h as (select a.segment_id, a.channel_name, a.event_name, a."minute" m, b."minute" k, b."value" v from tl a join tl b
              on a.segment_id = b.segment_id and a.channel_name = b.channel_name and b."minute" between a."minute" - 4 and a."minute"),
        f as (select segment_id, channel_name, event_name, m, round(avg(v), 6) mean_5, round(min(v), 6) min_5,
                     round(regr_slope(v, k - m + 4), 6) + 0.0 slope_5 from h group by 1, 2, 3, 4 having count(*) = 5)
        select anchor_id, an.segment_id, channel_name, m "minute", mean_5, min_5, slope_5
        from an join (select unnest([1, 2, 3]) k) on true join f on f.segment_id = an.segment_id and f.event_name = an.event_name
             and f.m = input_end - k""",
    "burden_features": f"""with {_TL}, b as (select segment_id, channel_name, event_name, count(*) n,
              round(count(*) filter (where event) / count(*), 6) event_fraction, min("value") lowest, max("value") highest
              from tl group by 1, 2, 3),
        l as (select segment_id, event_name, max(duration) d from ru group by 1, 2)
        select segment_id, channel_name, n, event_fraction, lowest, highest, coalesce(d, 0) longest_event
        from b left join l using (segment_id, event_name)""",
    "quality_features": """with r as (select distinct on (window_id) * from signal_quality)
        select segment_id, channel_name, count(*) n_windows,
               round(avg(case when not isnan(flatline_fraction) and flatline_fraction between 0 and 1 then flatline_fraction end), 8) flatline,
               round(avg(case when not isnan(extreme_value_fraction) and extreme_value_fraction between 0 and 1
                              then extreme_value_fraction end), 8) extreme,
               round(avg(case when not isnan(missing_micro_fraction) and missing_micro_fraction between 0 and 1
                              then missing_micro_fraction end), 8) missing,
               round(sum(len(list_filter(valid_micro_mask, lambda x: x))) / sum(len(valid_micro_mask)), 8) usable
        from r group by 1, 2""",
    "pressure_interval_coupling": f"""with {_TL},
        p as (select segment_id, "minute" m, "value" p from tl where channel_name = 'ABP Mean'),
        r as (select segment_id, "minute" m, 60.0::double / "value" rr from tl where channel_name = 'HR' and "value" between 30 and 220),
        l as (select unnest([0, 1, 2]) lag)
        select p.segment_id, lag, count(*) n, round(corr(p, rr), 5) + 0.0 r, round(regr_slope(rr, p), 7) + 0.0 slope
        from p cross join l join r on r.segment_id = p.segment_id and r.m = p.m + lag group by 1, 2 having count(*) >= 10""",
    "minute_patterns": f"""with {_TL},{_AN},
        w as (select *, unnest(range(-10, 0)) k from an)
        select anchor_id, w.segment_id, w.event_name,
               string_agg(case when event is null then '?' when event then 'E' else '.' end, '' order by k) pattern
        from w left join tl t on t.segment_id = w.segment_id and t.event_name = w.event_name and t."minute" = w.input_end + w.k
        group by 1, 2, 3""",
}
