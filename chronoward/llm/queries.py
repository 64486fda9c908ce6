"""Queries of the training-data problems tagged llm, and their SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from chronoward.functions.timeparts import seconds_since_2000
from chronoward.llm.abuse import score_abuse
from chronoward.llm.event_runs import episode_runs, minute_runs
from chronoward.llm.leakage import find_leaks
from chronoward.llm.linked_splits import assign_splits, connected_components
from chronoward.llm.mixing import mix_sources
from chronoward.llm.nearest_time import nearest_in_time
from chronoward.llm.percentiles import combine_counts, percentiles_of_counts, value_counts
from chronoward.session import table

PROBABILITIES = [0.01, 0.05, 0.25, 0.5, 0.75, 0.95, 0.99]

#: Order of feature_cache.feature_values.
FEATURE_NAMES = ["map_mean", "hr_mean", "spo2_mean", "resp_rate", "pulse_amp", "hrv_power"]


def canonical_split(label):
    """Trimmed lower-case split label; valid, validation and dev mean val."""
    low = F.lower(F.trim(label))
    return F.when(low.isin("valid", "validation", "dev"), F.lit("val")).otherwise(low)


def patient_number(pid):
    """The digits of a patient id read as a number; null without digits."""
    return F.regexp_replace(pid, r"\D", "").try_cast("bigint")


def p3_feature_percentiles(spark: SparkSession, d: str) -> DataFrame:
    cache = table(spark, d, "feature_cache").dropDuplicates(["anchor_id", "minute_idx"])
    cells = cache.select(
        canonical_split(F.col("split_label")).alias("split"),
        F.explode(F.arrays_zip(
            F.array(*[F.lit(n) for n in FEATURE_NAMES]).alias("name"), F.col("feature_values").alias("v"),
            F.col("feature_mask").alias("ok"),
        )).alias("c"),
    ).filter("c.ok")
    counts = value_counts(cells, {"split": F.col("split"), "feature_name": F.col("c.name")}, F.col("c.v"))
    return percentiles_of_counts(counts, ["split", "feature_name"], PROBABILITIES)


def residual_counts_by_day(spark: SparkSession, d: str) -> DataFrame:
    """Mergeable summary of alignment residuals per channel and arrival day."""
    return value_counts(
        table(spark, d, "minute_timeline"), {"channel_name": F.col("channel_name"), "arrival_day": F.to_date("ingested_at").cast("string")},
        F.col("alignment_residual_seconds"),
    )


def p3_residual_percentiles(spark: SparkSession, d: str) -> DataFrame:
    return percentiles_of_counts(residual_counts_by_day(spark, d), ["channel_name", "arrival_day"], PROBABILITIES)


def p3_residual_combined(spark: SparkSession, d: str) -> DataFrame:
    """Percentiles per channel over all days, from the daily summaries alone."""
    days = residual_counts_by_day(spark, d)
    return percentiles_of_counts(combine_counts(days, ["channel_name"]), ["channel_name"], PROBABILITIES)


def grid_minute():
    return F.rint((F.col("minute_time") - F.col("origin_seconds")) / 60.0).cast("long")


#: The event each channel carries.
CHANNEL_EVENTS = {"ABP Mean": "hypotension", "HR": "tachycardia", "SpO2": "hypoxia"}


def _event_of_channel():
    return F.create_map(*[F.lit(x) for pair in CHANNEL_EVENTS.items() for x in pair])[F.col("channel_name")]


def p4_runs(spark: SparkSession, d: str) -> DataFrame:
    """Every run with its number of minutes (events for episodes) and its duration."""
    minutes = minute_runs(
        table(spark, d, "minute_timeline"), ["segment_id", "channel_name"], grid_minute(),
        F.col("minute_valid") & F.col("event_minute"),
    ).select(
        F.lit("minute").alias("run_kind"), "segment_id", _event_of_channel().alias("event_name"),
        "first_minute", "last_minute", F.col("n_minutes").alias("n_events"),
    )
    start, duration = F.col("start_minute_index"), F.col("duration_minutes")
    episodes = episode_runs(
        table(spark, d, "event_episode"), "segment_id", "episode_id", F.lower(F.trim("event_name")), start,
        F.coalesce(F.col("end_minute_index_exclusive"), start + duration), max_gap=2,
    ).select(
        F.lit("episode").alias("run_kind"), "segment_id", "event_name", "first_minute", "last_minute", "n_events"
    )
    return minutes.unionByName(episodes).withColumn(
        "duration_minutes", F.col("last_minute") - F.col("first_minute") + 1
    )


def p4_found(spark: SparkSession, d: str) -> DataFrame:
    return p4_runs(spark, d).select("run_kind", "segment_id", "event_name", "first_minute", "last_minute").distinct()


def _split_targets(spark: SparkSession, d: str) -> list[tuple[str, float]]:
    return sorted((r[0], r[1]) for r in table(spark, d, "split_target").select("split_label", "proportion").collect())


def p5_found(spark: SparkSession, d: str) -> DataFrame:
    """Groups of the new split that the existing labels divide; the new label of a group is one."""
    rows = table(spark, d, "feature_cache").select(
        patient_number(F.col("patient_id")).alias("patient"), F.col("segment_id").alias("segment"),
        canonical_split(F.col("split_label")).alias("label"),
    ).distinct().withColumn("record", F.to_json(F.struct("patient", "segment")))
    new = assign_splits(rows, "record", [F.col("patient").cast("string"), F.col("segment")], _split_targets(spark, d))
    return (
        rows.join(new, "record").groupBy("group_key")
        .agg(
            F.min("patient").alias("group_subject_id"), F.min("label").alias("a"), F.max("label").alias("b"),
            F.min("split_label").alias("new_a"), F.max("split_label").alias("new_b"),
        )
        .filter("a <> b and new_a = new_b and group_subject_id is not null")
        .select("group_subject_id")
    )


def p5_splits(spark: SparkSession, d: str) -> DataFrame:
    """A new split label for every anchor, in the proportions of split_target."""
    return assign_splits(
        table(spark, d, "feature_cache"), "anchor_id",
        [patient_number(F.col("patient_id")).cast("string"), F.col("segment_id")], _split_targets(spark, d),
    )


def p5_split_shares(spark: SparkSession, d: str) -> DataFrame:
    """Per new split: its target share, and the shares of groups and of anchors it got."""
    splits = p5_splits(spark, d).groupBy("split_label").agg(
        F.count(F.lit(1)).alias("n_anchors"), F.countDistinct("group_key").alias("n_groups")
    )
    total = splits.agg(F.sum("n_anchors").alias("anchors"), F.sum("n_groups").alias("groups"))
    return (
        table(spark, d, "split_target").join(splits, "split_label", "left").join(F.broadcast(total))
        .select(
            "split_label", "proportion", F.coalesce("n_anchors", F.lit(0)).alias("n_anchors"),
            F.coalesce("n_groups", F.lit(0)).alias("n_groups"),
            (F.coalesce("n_anchors", F.lit(0)) / F.col("anchors")).alias("anchor_share"),
            (F.coalesce("n_groups", F.lit(0)) / F.col("groups")).alias("group_share"),
        )
    )


def p6_found(spark: SparkSession, d: str) -> DataFrame:
    segments = nearest_in_time(
        table(spark, d, "waveform_segment"), table(spark, d, "numerics_record"), 120.0,
        (F.col("subject_id_str"), seconds_since_2000(F.col("wfdb_segment_start_time")), F.col("segment_id")),
        (F.col("patient_id"), F.col("start_epoch"), F.col("record_id")),
    )
    anchors = nearest_in_time(
        table(spark, d, "feature_cache"), table(spark, d, "minute_timeline").filter("channel_name = 'ABP Mean'"), 30.0,
        (F.col("segment_id"), F.col("anchor_time"), F.col("anchor_id")),
        (F.col("segment_id"), F.col("minute_time"), F.col("reading_id")),
    )

    def shaped(df: DataFrame, kind: str) -> DataFrame:
        return df.select(
            F.lit(kind).alias("pair_kind"), F.col("left_id").cast("string").alias("left_id"),
            F.col("right_id").cast("string").alias("right_id"),
        )

    return shaped(segments, "segment").unionByName(shaped(anchors, "anchor")).distinct()


def p8_leaks(spark: SparkSession, d: str) -> DataFrame:
    return find_leaks(
        table(spark, d, "documents"), table(spark, d, "eval_item"), "doc_id", "page_id", "text", "item_id", "text"
    )


def p8_found(spark: SparkSession, d: str) -> DataFrame:
    return p8_leaks(spark, d).select("doc_id", "item_id").distinct()


def canonical_source(source):
    """Trimmed, lower-case, with ``-`` as ``_``."""
    return F.regexp_replace(F.lower(F.trim(source)), "-", "_")


def _documents(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "documents").select(
        F.col("doc_id").alias("id"), canonical_source(F.col("source")).alias("source"), "text"
    )


#: Vocabulary of a public tokenizer; a parameter, never copied.
TOKENIZER_PATH = "/opt/tokenizers/byte_bpe_multi_50k.tiktoken"


def _mix(spark: SparkSession, d: str) -> tuple[DataFrame, DataFrame]:
    targets = table(spark, d, "mix_target").withColumn("source", canonical_source(F.col("source")))
    return mix_sources(_documents(spark, d), targets, TOKENIZER_PATH)


def p9_mixture(spark: SparkSession, d: str) -> DataFrame:
    return _mix(spark, d)[0]


def p9_mix_shares(spark: SparkSession, d: str) -> DataFrame:
    return _mix(spark, d)[1]


#: Calibrated probability from which a document counts as abusive.
ABUSE_THRESHOLD = 0.5


def p10_scores(spark: SparkSession, d: str) -> DataFrame:
    docs = table(spark, d, "documents").select(
        F.col("doc_id").alias("id"), canonical_source(F.col("source")).alias("source"), "text", F.col("page_id").alias("group")
    )
    labels = table(spark, d, "review_label").select(F.col("doc_id").alias("id"), F.col("abusive").alias("label"))
    return score_abuse(docs, labels)


def p10_found(spark: SparkSession, d: str) -> DataFrame:
    return p10_scores(spark, d).filter(F.col("score") >= ABUSE_THRESHOLD).select("doc_id")


def p10_rates(spark: SparkSession, d: str) -> DataFrame:
    """Per source: documents, flagged documents, their rate and the mean score."""
    flagged = (F.col("score") >= ABUSE_THRESHOLD).cast("int")
    return p10_scores(spark, d).groupBy("source").agg(
        F.count(F.lit(1)).alias("n_documents"), F.sum(flagged).alias("n_flagged"),
        F.avg(flagged).alias("flagged_rate"), F.avg("score").alias("mean_score"),
    )


QUERIES = {
    "p3_feature_percentiles": p3_feature_percentiles,
    "p3_residual_percentiles": p3_residual_percentiles,
    "p3_residual_combined": p3_residual_combined,
    "p4_found": p4_found,
    "p4_runs": p4_runs,
    "p5_found": p5_found,
    "p5_splits": p5_splits,
    "p5_split_shares": p5_split_shares,
    "p6_found": p6_found,
    "p8_found": p8_found,
    "p8_leaks": p8_leaks,
    "p9_mixture": p9_mixture,
    "p9_mix_shares": p9_mix_shares,
    "p10_found": p10_found,
    "p10_scores": p10_scores,
    "p10_rates": p10_rates,
}

_PROBS = f"[{', '.join(str(p) for p in PROBABILITIES)}]"
_SPLIT = """case when lower(trim(split_label)) in ('valid', 'validation', 'dev') then 'val'
                 else lower(trim(split_label)) end"""
_NAMES = ", ".join(f"({i + 1}, '{n}')" for i, n in enumerate(FEATURE_NAMES))
_RUNS = """
        with m as (select distinct segment_id, channel_name,
                          cast(round_even((minute_time - origin_seconds) / 60, 0) as bigint) m
                   from minute_timeline where minute_valid and event_minute),
             g as (select *, m - row_number() over (partition by segment_id, channel_name order by m) g from m),
             a as (select segment_id, channel_name, min(m) a, max(m) b, count(*) n from g
                   group by segment_id, channel_name, g having count(*) >= 2),
             e as (select distinct episode_id id, segment_id k, lower(trim(event_name)) v, start_minute_index s,
                          coalesce(end_minute_index_exclusive, start_minute_index + duration_minutes) e
                   from event_episode where start_minute_index is not null),
             p as (select *, lag(v) over (partition by k order by s, id) pv from e),
             q as (select *, sum(case when pv is distinct from v then 1 else 0 end)
                                 over (partition by k order by s, id rows unbounded preceding) st from p),
             r as (select *, max(e) over (partition by k, st order by s, id
                                          rows between unbounded preceding and 1 preceding) reach from q),
             t as (select *, sum(case when reach is null or s > reach + 2 then 1 else 0 end)
                                 over (partition by k, st order by s, id rows unbounded preceding) part from r),
             u as (select k, v, st, part, min(s) a, max(e) - 1 b, count(*) n from t group by 1, 2, 3, 4
                   having count(*) >= 2),
             z as (select 'minute' run_kind, segment_id, case channel_name when 'ABP Mean' then 'hypotension'
                          when 'HR' then 'tachycardia' when 'SpO2' then 'hypoxia' end event_name,
                          a first_minute, b last_minute, n n_events from a
                   union all
                   select 'episode', k, v, cast(a as bigint), cast(b as bigint), n from u)"""

_SPLITS = """
        with recursive
             r as (select distinct anchor_id id, try_cast(regexp_replace(patient_id, '\\D', '', 'g') as bigint) p, segment_id s
                   from feature_cache where anchor_id is not null),
             n as (select id, '0:' || p node from r where p is not null union select id, '1:' || s from r where s is not null
                   union select id, 'r:' || id from r where p is null and s is null),
             e as (select distinct a.node x, b.node y from n a join n b using (id)),
             c(x, y) as (select x, y from e union select c.x, e.y from c join e on c.y = e.x),
             g as (select x node, min(y) group_key from c group by x),
             t as (select split_label, proportion,
                          sum(proportion) over (order by split_label) / sum(proportion) over () bound,
                          row_number() over (order by split_label desc) = 1 last from split_target),
             k as (select distinct id anchor_id, group_key,
                          cast(('0x' || substr(md5(group_key || '#0'), 1, 8)) as bigint) / 4294967296.0 h
                   from n join g using (node)),
             z as (select anchor_id, group_key, min(split_label) split_label from k, t where h < bound or last group by 1, 2)"""

SQL = {
    "p3_feature_percentiles": f"""
        with r as (select distinct on (anchor_id, minute_idx) {_SPLIT} split, feature_values fv, feature_mask fm
                   from feature_cache),
             n as (select * from (values {_NAMES}) t(i, feature_name)),
             v as (select split, feature_name, cast(fv[i] as double) x from r, n where fm[i] and isfinite(fv[i]))
        select split, feature_name, cast(unnest({_PROBS}) as double) probability,
               unnest(quantile_cont(x, {_PROBS})) "value", count(*) n_values
        from v group by split, feature_name""",
    "p3_residual_percentiles": f"""
        with v as (select channel_name, cast(cast(ingested_at as date) as varchar) arrival_day,
                          cast(alignment_residual_seconds as double) x
                   from minute_timeline where isfinite(alignment_residual_seconds))
        select channel_name, arrival_day, cast(unnest({_PROBS}) as double) probability,
               unnest(quantile_cont(x, {_PROBS})) "value", count(*) n_values
        from v group by channel_name, arrival_day""",
    "p3_residual_combined": f"""
        with v as (select channel_name, cast(alignment_residual_seconds as double) x
                   from minute_timeline where isfinite(alignment_residual_seconds))
        select channel_name, cast(unnest({_PROBS}) as double) probability,
               unnest(quantile_cont(x, {_PROBS})) "value", count(*) n_values
        from v group by channel_name""",
    "p4_found": f"{_RUNS} select distinct run_kind, segment_id, event_name, first_minute, last_minute from z",
    "p4_runs": f"{_RUNS} select *, last_minute - first_minute + 1 duration_minutes from z",
    "p5_found": f"""
        with recursive
             r as (select distinct try_cast(regexp_replace(patient_id, '\\D', '', 'g') as bigint) p, segment_id s,
                          {_SPLIT} l from feature_cache),
             e as (select distinct a.p x, b.p y from r a join r b using (s) where a.p is not null and b.p is not null),
             c(x, y) as (select x, y from e union select c.x, e.y from c join e on c.y = e.x),
             g as (select x p, min(y) g from c group by x),
             sg as (select s, min(g) g from r join g using (p) group by s),
             l as (select sg.g, r.l from r join sg using (s) where r.l is not null)
        select g group_subject_id from l group by g having count(distinct l) > 1""",
    "p5_splits": f"{_SPLITS} select anchor_id, group_key, split_label from z",
    "p5_split_shares": f"""{_SPLITS},
             m as (select split_label, count(*) n_anchors, count(distinct group_key) n_groups from z group by 1)
        select split_label, proportion, coalesce(n_anchors, 0) n_anchors, coalesce(n_groups, 0) n_groups,
               coalesce(n_anchors, 0) / (select sum(n_anchors) from m) anchor_share,
               coalesce(n_groups, 0) / (select sum(n_groups) from m) group_share
        from split_target left join m using (split_label)""",
    "p6_found": """
        with a as (select distinct subject_id_str k, segment_id id,
                          epoch_us(wfdb_segment_start_time) / 1e6 - 946684800 t from waveform_segment
                   where wfdb_segment_start_time is not null),
             b as (select distinct patient_id k, record_id id, start_epoch t from numerics_record),
             s as (select 'segment' pair_kind, a.id left_id, b.id right_id,
                          row_number() over (partition by a.id, a.t order by abs(a.t - b.t), b.t, b.id) n
                   from a join b on a.k = b.k and abs(a.t - b.t) <= 120),
             c as (select distinct segment_id k, anchor_id id, anchor_time t from feature_cache
                   where anchor_time is not null),
             e as (select distinct segment_id k, reading_id id, minute_time t from minute_timeline
                   where channel_name = 'ABP Mean'),
             f as (select 'anchor' pair_kind, cast(c.id as varchar) left_id, cast(e.id as varchar) right_id,
                          row_number() over (partition by c.id, c.t order by abs(c.t - e.t), e.t, e.id) n
                   from c join e on c.k = e.k and abs(c.t - e.t) <= 30)
        select pair_kind, left_id, right_id from s where n = 1
        union all select pair_kind, left_id, right_id from f where n = 1""",
}
