"""Queries of interval algebra and cohort classification."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from chronoward.functions.timeparts import micros_since_1970, seconds_since_2000
from chronoward.operators import cohort as co
from chronoward.operators import intervals as iv
from chronoward.session import checkpoint, table

# The status and evidence names in this module are fixed values: results are compared by them.
SECOND = 1_000_000
DAY = 86_400 * SECOND


def _us(c: str):
    return micros_since_1970(F.col(c))


def segments(spark: SparkSession, d: str) -> DataFrame:
    """First listed row of each segment: ``segment_id, k, ls, le, ok``."""
    rows = table(spark, d, "waveform_segment")
    first = rows.groupBy("segment_id").agg(
        F.min_by(F.struct("subject_id", "segment_start_time", "segment_end_time", "timestamp_status"),
                 F.struct("listed_at", "segment_path")).alias("r")
    )
    ls, le = micros_since_1970(F.col("r.segment_start_time")), micros_since_1970(F.col("r.segment_end_time"))
    return first.select(
        "segment_id", F.col("r.subject_id").alias("k"), ls.alias("ls"), le.alias("le"),
        F.coalesce((F.col("r.timestamp_status") == "valid") & (le > ls), F.lit(False)).alias("ok"),
    )


def stays(spark: SparkSession, d: str) -> DataFrame:
    """Distinct stays with a known end: ``k, icustay_id, rs, re``."""
    return table(spark, d, "icu_stay").select(
        F.col("subject_id").alias("k"), "icustay_id", _us("intime").alias("rs"), _us("outtime").alias("re")
    ).distinct().filter("re is not null and rs is not null")


def drugs(spark: SparkSession, d: str) -> DataFrame:
    """Timed drug intervals once per row id."""
    return table(spark, d, "vaso_interval").groupBy("row_id").agg(
        F.first(F.struct("subject_id", "hadm_id", "icustay_id", "vasopressor_name", "vasopressor_source",
                         "source_order_id", "itemid", "vaso_start", "vaso_end")).alias("r")
    ).select("row_id", "r.*").withColumn("vs", _us("vaso_start")).withColumn("ve", _us("vaso_end"))


def _stay_pairs(spark: SparkSession, d: str) -> DataFrame:
    pairs = iv.overlap_join(segments(spark, d).filter("ok"), stays(spark, d), DAY)
    return pairs.withColumn("overlap", iv.overlap_length(F.col("ls"), F.col("le"), F.col("rs"), F.col("re")))


def interval_overlap_match(spark: SparkSession, d: str) -> DataFrame:
    return _stay_pairs(spark, d).select("segment_id", "icustay_id", F.col("overlap").alias("overlap_us"))


def interval_containment(spark: SparkSession, d: str) -> DataFrame:
    inside = iv.contained(F.col("ls"), F.col("le"), F.col("rs"), F.col("re"), SECOND)
    return _stay_pairs(spark, d).select("segment_id", "icustay_id", inside.alias("is_contained"))


def best_overlap(spark: SparkSession, d: str) -> DataFrame:
    return iv.best_overlap(_stay_pairs(spark, d), ["segment_id"], ["icustay_id"]).select(
        "segment_id", "icustay_id", F.col("overlap").alias("overlap_us")
    )


def nearest_distance(spark: SparkSession, d: str) -> DataFrame:
    """Distance in milliseconds from each segment start to the nearest numerics start within an hour."""
    left = table(spark, d, "waveform_segment").select(
        "segment_id", F.col("subject_id_str").alias("k"),
        F.rint(seconds_since_2000(F.col("wfdb_segment_start_time")) * 1000).cast("long").alias("t"),
    ).filter("t is not null and k is not null").distinct()
    right = table(spark, d, "numerics_record").select(
        F.col("patient_id").alias("k"), F.rint(F.col("start_epoch") * 1000).cast("long").alias("t")
    )
    return iv.nearest_distance(left, right, 3_600_000).select("segment_id", "distance")


def stay_matching(spark: SparkSession, d: str) -> DataFrame:
    return co.match_stays(segments(spark, d), _stay_pairs(spark, d), SECOND).select(
        "segment_id", "icu_match_status", "icustay_id", F.col("overlap").alias("overlap_us")
    )


def _certain(x: DataFrame) -> DataFrame:
    return x.filter("icustay_id is not null and vs is not null and ve is not null and ve > vs")


def _exposed(spark: SparkSession, d: str) -> DataFrame:
    """Segments fully inside one stay with the timed drug intervals that overlap them."""
    matched = co.match_stays(segments(spark, d), _stay_pairs(spark, d), SECOND).filter(
        "icu_match_status = 'matched_full'"
    ).select("segment_id", F.col("icustay_id").alias("k"), "ls", "le")
    timed = _certain(drugs(spark, d)).select(
        F.col("icustay_id").alias("k"), F.col("vs").alias("rs"), F.col("ve").alias("re"), "vasopressor_name",
        "vasopressor_source", "row_id",
    )
    return iv.overlap_join(matched, timed, DAY)


def exposure_details(spark: SparkSession, d: str) -> DataFrame:
    return _exposed(spark, d).select(
        "segment_id", F.col("k").alias("icustay_id"), "row_id", "vasopressor_name", "vasopressor_source",
        F.col("rs").alias("start_us"), F.col("re").alias("end_us"),
    )


def uncertain_overlap(spark: SparkSession, d: str) -> DataFrame:
    """Segments touched by drug rows whose time is not fully known, with the kinds of evidence.

    Evidence with both times counts if it overlaps, with one time if it can, and
    without any time always; it belongs by stay, else by subject. Rows without both
    times are counted per owner and source, never paired with every segment.
    """
    matched = checkpoint(
        co.match_stays(segments(spark, d), _stay_pairs(spark, d), SECOND).filter("icu_match_status = 'matched_full'")
        .join(segments(spark, d).select("segment_id", "k"), "segment_id")
        .select("segment_id", "k", F.col("icustay_id").alias("sid"), "ls", "le")
    )
    vs, ve, ls, le = (F.col(c) for c in ("vs", "ve", "ls", "le"))
    loose = drugs(spark, d).filter("icustay_id is null or vs is null or ve is null or ve <= vs").select(
        F.col("subject_id").alias("k"), F.col("icustay_id").alias("owner"), "vs", "ve", F.col("vasopressor_source").alias("source"),
    ).filter("k is not null")
    loose = checkpoint(loose.withColumn(
        "label", F.concat_ws("|", F.lit("d"), "k", F.coalesce(F.col("owner").cast("string"), F.lit("-")), F.coalesce("source", F.lit("-")))
    ))
    own = F.col("owner").isNull() | (F.col("owner") == F.col("sid"))

    timed = loose.filter(vs.isNotNull() & ve.isNotNull()).withColumns({"rs": F.least("vs", "ve"), "re": F.greatest("vs", "ve") + 1})
    overlaps = iv.overlap_join(matched, timed, DAY).filter(own & (vs < le) & (ve > ls)).groupBy("segment_id", "source").agg(
        F.count(F.lit(1)).alias("n")
    ).withColumn("kind", F.lit("uncertain_interval_overlap"))

    def owners(rows: DataFrame) -> DataFrame:
        """Segments with each owner and source that has such rows, and how many."""
        few = rows.groupBy("k", "owner", "source", "label").agg(F.count(F.lit(1)).alias("n"))
        return matched.join(few, "k").filter(own)

    found = [overlaps]
    starts, ends = loose.filter(vs.isNotNull() & ve.isNull()), loose.filter(vs.isNull() & ve.isNotNull())
    for rows, time, limit, name in ((starts, vs, le, "uncertain_start_only"), (ends, -ve, -ls, "uncertain_end_only")):
        asked = owners(rows).select("segment_id", "source", "label", limit.alias("at"))
        counted = iv.count_earlier(asked, rows.select("label", time.alias("at")), ["segment_id", "source"])
        found.append(counted.filter("n > 0").withColumn("kind", F.lit(name)))
    untimed = F.when(F.col("owner").isNotNull(), F.lit("untimed_same_icustay")).otherwise(F.lit("untimed_patient_only"))
    found.append(owners(loose.filter(vs.isNull() & ve.isNull())).withColumn("kind", untimed))
    every = found[0].select("segment_id", "source", "kind", "n")
    for part in found[1:]:
        every = every.unionByName(part.select("segment_id", "source", "kind", "n"))
    return every.groupBy("segment_id").agg(
        co.sorted_names(F.col("kind")).alias("reasons"), co.sorted_names(F.col("source")).alias("sources"), F.sum("n").alias("n_rows"),
    )


def exposure_classification(spark: SparkSession, d: str) -> DataFrame:
    """Three-valued: exposed, free, or unknown with the reason."""
    base = co.match_stays(segments(spark, d), _stay_pairs(spark, d), SECOND).select("segment_id", "icu_match_status")
    hit = _exposed(spark, d).groupBy("segment_id").agg(
        F.count(F.lit(1)).alias("n_overlaps"), F.min("rs").alias("first_us"), F.max("re").alias("last_us"),
        co.sorted_names(F.col("vasopressor_source")).alias("sources"),
    )
    loose = uncertain_overlap(spark, d).select("segment_id", F.col("reasons").alias("uncertain_reasons"))
    x = base.join(hit, "segment_id", "left").join(loose, "segment_id", "left")
    full = F.col("icu_match_status") == "matched_full"
    status = (
        F.when(F.col("icu_match_status") == "matched_partial", F.lit("unknown_partial_icu_coverage"))
        .when(~full, F.concat(F.lit("unknown_"), "icu_match_status"))
        .when(F.col("n_overlaps").isNotNull(), F.lit("classified_overlap"))
        .when(F.col("uncertain_reasons").isNotNull(), F.lit("unknown_unresolved_vasopressor_episode_timing"))
        .otherwise(F.lit("classified_no_overlap"))
    )
    free = F.when(status == "classified_overlap", F.lit(False)).when(status == "classified_no_overlap", F.lit(True))
    return x.select(
        "segment_id", status.alias("classification_status"), free.alias("vasopressor_free"),
        F.when(status == "classified_no_overlap", F.lit(0)).when(full, F.col("n_overlaps")).alias("n_overlaps"),
        F.when(full, F.col("first_us")).alias("first_us"), F.when(full, F.col("last_us")).alias("last_us"),
        F.when(status == "classified_overlap", F.col("sources")).alias("sources"),
    )


def exposure_status_counts(spark: SparkSession, d: str) -> DataFrame:
    return exposure_classification(spark, d).groupBy("classification_status").agg(F.count(F.lit(1)).alias("n"))


def order_episode_group(spark: SparkSession, d: str) -> DataFrame:
    """Drug orders: rows of one stay and order become one episode."""
    rows = _certain(drugs(spark, d)).filter("source_order_id is not null")
    return co.group_orders(
        rows, ["icustay_id", "source_order_id"], "vs", "ve",
        {"vasopressor_name": "names", "itemid": "item_ids", "vasopressor_source": "sources"},
    )


def drug_uncertainty(spark: SparkSession, d: str) -> DataFrame:
    """Rows without a usable interval and why."""
    rows = drugs(spark, d).filter("icustay_id is null or vs is null or ve is null or ve <= vs")
    reasons = co.uncertainty_reasons([
        ("missing_icustay_id", F.col("icustay_id").isNull()), ("missing_starttime", F.col("vs").isNull()),
        ("missing_endtime", F.col("ve").isNull()), ("non_positive_duration", F.col("ve") <= F.col("vs")),
    ])
    return rows.select("row_id", reasons.alias("uncertainty_reason"))


def _charted(spark: SparkSession, d: str) -> DataFrame:
    """Events as charted rows: signup has no rate, error stops, a value under 20 is rate zero."""
    v = F.col("value")
    rows = table(spark, d, "events").select(
        F.col("user_id"), micros_since_1970(F.col("ts")).alias("t"),
        F.when(F.col("event_type") == "signup", F.lit(None)).when(v < 20, F.lit(0.0)).otherwise(v).cast("double").alias("rate"),
        (F.col("event_type") == "error").alias("stopped"),
    )
    return co.charted_states(rows, ["user_id"])


def charted_state_machine(spark: SparkSession, d: str) -> DataFrame:
    x = co.charted_episodes(_charted(spark, d), ["user_id"])
    return x.select("user_id", "episode", F.col("start").alias("start_us"), F.col("end").alias("end_us"),
                    "first_time", "max_rate", "n")


def charted_drop_rules(spark: SparkSession, d: str) -> DataFrame:
    x = co.charted_episodes(_charted(spark, d), ["user_id"]).withColumn("verdict", co.episode_verdict())
    return x.groupBy("verdict").agg(F.count(F.lit(1)).alias("n_episodes"), F.sum("n").alias("n_rows"))


QUERIES = {
    f.__name__: f
    for f in (
        interval_overlap_match, interval_containment, best_overlap, nearest_distance, stay_matching, exposure_details,
        uncertain_overlap, exposure_classification, exposure_status_counts, order_episode_group, drug_uncertainty,
        charted_state_machine, charted_drop_rules,
    )
}

_SEG = """
    sg as (select segment_id, subject_id k, epoch_us(segment_start_time) ls, epoch_us(segment_end_time) le,
                  coalesce(timestamp_status = 'valid' and segment_end_time > segment_start_time, false) ok
           from waveform_segment
           qualify row_number() over (partition by segment_id order by listed_at nulls first, segment_path nulls first) = 1),
    sy as (select distinct subject_id k, icustay_id, epoch_us(intime) rs, epoch_us(outtime) re from icu_stay
           where intime is not null and outtime is not null),
    pr as (select s.segment_id, y.icustay_id, s.ls, s.le, y.rs, y.re, least(le, re) - greatest(ls, rs) overlap
           from sg s join sy y on s.k = y.k and s.ls < y.re and s.le > y.rs and y.re > y.rs where s.ok),
    ag as (select segment_id, count(*) n, min(icustay_id) icustay_id, min(rs) rs, max(re) re, max(overlap) overlap
           from pr group by 1),
    mt as (select s.segment_id, s.k, s.ls, s.le,
                  case when not ok then 'unknown_segment_time' when n is null then 'unmatched'
                       when n > 1 then 'ambiguous_multiple_icu_stays'
                       when ls >= rs - 1000000 and le <= re + 1000000 then 'matched_full' else 'matched_partial' end st,
                  case when n = 1 and ok then icustay_id end icustay_id, case when n = 1 and ok then overlap end ov
           from sg s left join ag using (segment_id)),
    dr as (select distinct on (row_id) *, epoch_us(vaso_start) vs, epoch_us(vaso_end) ve from vaso_interval),
    ex as (select m.segment_id, m.icustay_id, d.row_id, d.vasopressor_name, d.vasopressor_source, d.vs, d.ve
           from mt m join dr d on d.icustay_id = m.icustay_id and d.ve > d.vs and d.vs < m.le and d.ve > m.ls
           where m.st = 'matched_full'),
    lo as (select * from dr where icustay_id is null or vs is null or ve is null or ve <= vs),
    uk as (select m.segment_id, l.vasopressor_source,
                  case when vs is not null and ve is not null and vs < le and ve > ls then 'uncertain_interval_overlap'
                       when vs is not null and ve is null and vs < le then 'uncertain_start_only'
                       when vs is null and ve is not null and ve > ls then 'uncertain_end_only'
                       when vs is null and ve is null and l.icustay_id is not null then 'untimed_same_icustay'
                       when vs is null and ve is null then 'untimed_patient_only' end kind
           from mt m join lo l on l.subject_id = m.k and (l.icustay_id is null or l.icustay_id = m.icustay_id)
           where m.st = 'matched_full'),
    un as (select segment_id, array_to_string(list_sort(list(distinct kind)), ',') reasons,
                  array_to_string(list_sort(list(distinct vasopressor_source)), ',') sources, count(*) n_rows
           from uk where kind is not null group by 1),
    ht as (select segment_id, count(*) n_overlaps, min(vs) first_us, max(ve) last_us,
                  array_to_string(list_sort(list(distinct vasopressor_source)), ',') sources from ex group by 1),
    cl as (select m.segment_id, case when st = 'matched_partial' then 'unknown_partial_icu_coverage'
                                     when st <> 'matched_full' then 'unknown_' || st
                                     when n_overlaps is not null then 'classified_overlap'
                                     when un.reasons is not null then 'unknown_unresolved_vasopressor_episode_timing'
                                     else 'classified_no_overlap' end c, h.*, st
           from mt m left join ht h on h.segment_id = m.segment_id left join un on un.segment_id = m.segment_id)"""

_CHART = """
    e0 as (select user_id, epoch_us(ts) t, case when event_type = 'signup' then null when "value" < 20 then 0.0
                  else "value" end rate, event_type = 'error' stopped from events),
    e1 as (select user_id, t, max(rate) rate,
                  max(cast(stopped as int)) - max(cast(coalesce(rate > 0 and not stopped, false) as int)) > 0 stopped,
                  count(*) n from e0 group by 1, 2),
    e2 as (select *, count(rate) over (partition by user_id order by t) part from e1),
    e3 as (select *, max(rate) over (partition by user_id, part) known from e2),
    e4 as (select *, lag(known) over (partition by user_id order by t) held,
                  coalesce(lag(stopped) over (partition by user_id order by t), false) halted from e3),
    e5 as (select *, count(*) filter (where case when held = 0 then known <> 0 else halted or (held is null and rate > 0) end)
                     over (partition by user_id order by t) episode from e4),
    ce as (select user_id, episode, min(t) filter (where rate is not null) start_us,
                  coalesce(min(t) filter (where stopped or rate = 0), max(t)) end_us,
                  min(t) first_time, max(rate) max_rate, sum(n) n from e5 where episode > 0 group by 1, 2)"""

SQL = {
    "interval_overlap_match": f"with {_SEG} select segment_id, icustay_id, overlap overlap_us from pr",
    "interval_containment": f"""with {_SEG} select segment_id, icustay_id,
        ls >= rs - 1000000 and le <= re + 1000000 is_contained from pr""",
    "best_overlap": f"""with {_SEG} select segment_id, icustay_id, overlap overlap_us from pr
        qualify row_number() over (partition by segment_id order by overlap desc, icustay_id) = 1""",
    "nearest_distance": """
        with l as (select distinct segment_id, subject_id_str k,
                          cast(round_even((epoch_us(wfdb_segment_start_time) / 1e6 - 946684800) * 1000, 0) as bigint) t
                   from waveform_segment where wfdb_segment_start_time is not null and subject_id_str is not null),
             r as (select distinct patient_id k, cast(round_even(start_epoch * 1000, 0) as bigint) t
                   from numerics_record where start_epoch is not null)
        select l.segment_id, min(abs(l.t - r.t)) distance from l left join r on l.k = r.k and abs(l.t - r.t) <= 3600000
        group by l.segment_id, l.k, l.t""",
    "stay_matching": f"""with {_SEG} select segment_id, st icu_match_status, icustay_id,
        case when ov is not null then ov when st = 'unmatched' then 0 end overlap_us from mt""",
    "exposure_details": f"""with {_SEG} select segment_id, icustay_id, row_id, vasopressor_name, vasopressor_source,
        vs start_us, ve end_us from ex""",
    "uncertain_overlap": f"with {_SEG} select * from un",
    "exposure_classification": f"""with {_SEG} select cl.segment_id, c classification_status,
        case c when 'classified_overlap' then false when 'classified_no_overlap' then true end vasopressor_free,
        case when c = 'classified_no_overlap' then 0 when st = 'matched_full' then n_overlaps end n_overlaps,
        first_us, last_us, case when c = 'classified_overlap' then sources end sources from cl""",
    "exposure_status_counts": f"with {_SEG} select c classification_status, count(*) n from cl group by 1",
    "order_episode_group": f"""with {_SEG} select icustay_id, source_order_id, min(vs) episode_start, max(ve) episode_end,
        array_to_string(list_sort(list(distinct vasopressor_name)), ',') names,
        array_to_string(list_sort(list(distinct cast(itemid as varchar))), ',') item_ids,
        array_to_string(list_sort(list(distinct vasopressor_source)), ',') sources, count(*) row_count
        from dr where icustay_id is not null and ve > vs and source_order_id is not null group by 1, 2""",
    "drug_uncertainty": f"""with {_SEG} select row_id, concat_ws(';',
        case when icustay_id is null then 'missing_icustay_id' end, case when vs is null then 'missing_starttime' end,
        case when ve is null then 'missing_endtime' end, case when ve <= vs then 'non_positive_duration' end)
        uncertainty_reason from lo""",
    "charted_state_machine": f"""with {_CHART} select user_id, cast(episode as bigint) episode, start_us, end_us, first_time,
        max_rate, cast(n as bigint) n from ce""",
    "charted_drop_rules": f"""with {_CHART},
        v as (select *, case when start_us is null or end_us is null then 'missing_bounds'
                             when first_time = end_us then 'start_equals_end'
                             when coalesce(max_rate <= 0, true) then 'nonpositive_rate' else 'kept' end verdict from ce)
        select verdict, count(*) n_episodes, cast(sum(n) as bigint) n_rows from v group by 1""",
}
