"""Event-onset labels of anchors, with the reason of every invalid label.

An anchor is exploded into the minutes it looks at (input, forecast, confirmation),
joined to the annotated timeline by equality on (series, minute), and reduced to
counts; the label is one ordered ``when``. Work is linear in anchors, whatever the
length of a series.
"""

from __future__ import annotations

from enum import IntEnum

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


# Label states, reasons of invalid labels, reasons of filtered negatives.
class Label(IntEnum):
    INVALID = -1
    NEGATIVE = 0
    POSITIVE = 1


class Reason(IntEnum):
    KEPT = 0
    TIME_ALIGNMENT = 1
    INPUT_COVERAGE = 2
    FORECAST_COVERAGE = 3
    CONFIRMATION_COVERAGE = 4
    OUTCOME_MISSING = 5
    OUTCOME_MIXED = 6
    ACTIVE_BEFORE_OUTCOME = 7
    NO_SERIES = 8
    ACTIVE_IN_INPUT = 9


class FilterReason(IntEnum):
    KEPT = 0
    BASE_INVALID = 1
    POSITIVE = 2
    EXCLUDED_GROUP = 3
    AFTER_CUTOFF = 4
    NOT_CLEAN = 5
    NO_ONSET_IN_GROUP = 8


def _looked_at(
    anchors: DataFrame, series: DataFrame, on: list[str], input_minutes: int, after_minutes: int
) -> DataFrame:
    """Anchors crossed with their events' minutes; ``offset`` counts from the input end."""
    span = F.sequence(F.lit(-input_minutes), F.lit(after_minutes - 1))
    wide = anchors.withColumn("offset", F.explode(span)).withColumn(
        "minute", F.col("input_end") + F.col("offset")
    )
    return wide.join(series, [*on, "minute"], "left")


def _count(condition: Column) -> Column:
    return F.count_if(F.coalesce(condition, F.lit(False)))


def onset_labels(
    anchors: DataFrame, series: DataFrame, lengths: DataFrame, on: list[str], input_minutes: int, horizons: list[int],
    sustain: int, exclude_active: bool = True, strict_clean: bool = False,
) -> DataFrame:
    """``anchor_id, on..., horizon, label, reason``: is there an onset within the horizon?

    ``anchors(anchor_id, on..., input_end)``; ``series(on..., minute, event,
    in_episode, starts_episode)`` holds the valid minutes; ``lengths(on..., length)``
    the series lengths. Order of tests: input coverage, active event in the input,
    forecast coverage, confirmation length, onset, confirmation coverage, and for
    ``strict_clean`` any event minute in the horizon. Anchors without a series get
    reason NO_SERIES.
    """
    longest = max(horizons) + sustain - 1
    o, valid = F.col("offset"), F.col("event").isNotNull()
    per_horizon = []
    for h in horizons:
        per_horizon += [
            _count(valid & o.between(0, h - 1)).alias(f"f{h}"),
            _count(F.col("starts_episode") & o.between(0, h - 1)).alias(f"s{h}"),
            _count(valid & o.between(0, h + sustain - 2)).alias(f"c{h}"),
            _count(F.col("event") & o.between(0, h - 1)).alias(f"e{h}"),
        ]
    counts = _looked_at(anchors, series, on, input_minutes, longest).groupBy("anchor_id", *on, "input_end").agg(
        _count(valid & (o < 0)).alias("n_input"), _count(F.col("in_episode") & (o < 0)).alias("n_active"), *per_horizon
    )
    counts = counts.join(lengths, on, "left")
    states = []
    for h in horizons:
        outcome = (
            F.when(F.col("length").isNull(), F.lit(-10 - Reason.NO_SERIES))
            .when(F.col("n_input") < input_minutes, F.lit(-10 - Reason.INPUT_COVERAGE))
            .when(F.lit(exclude_active) & (F.col("n_active") > 0), F.lit(-10 - Reason.ACTIVE_IN_INPUT))
            .when(F.col(f"f{h}") < h, F.lit(-10 - Reason.FORECAST_COVERAGE))
            .when(F.col("input_end") + h + sustain - 1 > F.col("length"), F.lit(-10 - Reason.CONFIRMATION_COVERAGE))
            .when(F.col(f"s{h}") > 0, F.lit(int(Label.POSITIVE)))
            .when(F.col(f"c{h}") < h + sustain - 1, F.lit(-10 - Reason.CONFIRMATION_COVERAGE))
            .when(F.lit(strict_clean) & (F.col(f"e{h}") > 0), F.lit(-10 - Reason.OUTCOME_MIXED))
            .otherwise(F.lit(int(Label.NEGATIVE)))
        )
        states.append(F.struct(F.lit(h).alias("horizon"), outcome.alias("code")))
    out = counts.select("anchor_id", *on, F.explode(F.array(*states)).alias("x"))
    return out.select("anchor_id", *on, "x.horizon", *_split("x.code"))


def _split(code: str) -> list[Column]:
    c = F.col(code)
    return [
        F.when(c <= -10, F.lit(int(Label.INVALID))).otherwise(c).alias("label"),
        F.when(c <= -10, -c - 10).otherwise(F.lit(0)).alias("reason"),
    ]


def fixed_gap_labels(
    anchors: DataFrame, series: DataFrame, lengths: DataFrame, on: list[str], input_minutes: int, gaps: list[int],
    sustain: int, exclude_active: bool = True,
) -> DataFrame:
    """``anchor_id, on..., gap, label, reason``: does an episode start exactly at the gap?

    Order of tests: input coverage, active event in the input, series length,
    outcome coverage, start at the outcome, already active, no event minute at all.
    """
    longest = max(gaps) + sustain
    o, valid = F.col("offset"), F.col("event").isNotNull()
    per_gap = []
    for g in gaps:
        inside = o.between(g, g + sustain - 1)
        per_gap += [
            _count(valid & inside).alias(f"v{g}"), _count(F.col("event") & inside).alias(f"e{g}"),
            _count(F.col("starts_episode") & (o == g)).alias(f"s{g}"), _count(F.col("in_episode") & (o == g)).alias(f"a{g}"),
        ]
    counts = _looked_at(anchors, series, on, input_minutes, longest).groupBy("anchor_id", *on, "input_end").agg(
        _count(valid & (o < 0)).alias("n_input"), _count(F.col("in_episode") & (o < 0)).alias("n_active"), *per_gap
    )
    counts = counts.join(lengths, on, "left")
    states = []
    for g in gaps:
        outcome = (
            F.when(F.col("length").isNull(), F.lit(-10 - Reason.NO_SERIES))
            .when(F.col("n_input") < input_minutes, F.lit(-10 - Reason.INPUT_COVERAGE))
            .when(F.lit(exclude_active) & (F.col("n_active") > 0), F.lit(-10 - Reason.ACTIVE_IN_INPUT))
            .when(F.col("input_end") + g + sustain > F.col("length"), F.lit(-10 - Reason.CONFIRMATION_COVERAGE))
            .when(F.col(f"v{g}") < sustain, F.lit(-10 - Reason.OUTCOME_MISSING))
            .when(F.col(f"s{g}") > 0, F.lit(int(Label.POSITIVE)))
            .when(F.col(f"a{g}") > 0, F.lit(-10 - Reason.ACTIVE_BEFORE_OUTCOME))
            .when(F.col(f"e{g}") == 0, F.lit(int(Label.NEGATIVE)))
            .otherwise(F.lit(-10 - Reason.OUTCOME_MIXED))
        )
        states.append(F.struct(F.lit(g).alias("gap"), outcome.alias("code")))
    out = counts.select("anchor_id", *on, F.explode(F.array(*states)).alias("x"))
    return out.select("anchor_id", *on, "x.gap", *_split("x.code"))


def sustained_in_range(
    anchors: DataFrame, series: DataFrame, on: list[str], first_offset: int, last_offset: int, sustain: int
) -> DataFrame:
    """``anchor_id, on..., has_data, has_event``: a sustained event among the offsets?

    Offsets are minutes from the input end, both included; runs are cut at the range,
    and a missing minute resets the run. ``series(on..., minute, event)``.
    """
    wide = anchors.withColumn("offset", F.explode(F.sequence(F.lit(first_offset), F.lit(last_offset)))).withColumn(
        "minute", F.col("input_end") + F.col("offset")
    )
    joined = wide.join(series.select(*on, "minute", "event"), [*on, "minute"], "left")
    # bounded arrays (one entry per offset), so the run is a fold over a small array
    folded = joined.groupBy("anchor_id", *on).agg(
        F.array_sort(F.collect_list(F.struct("offset", "event"))).alias("xs")
    )
    longest = F.aggregate(
        "xs",
        F.struct(F.lit(0).alias("now"), F.lit(0).alias("best")),
        lambda acc, x: F.struct(
            F.when(x["event"], acc["now"] + 1).otherwise(0).alias("now"),
            F.greatest(acc["best"], F.when(x["event"], acc["now"] + 1).otherwise(0)).alias("best"),
        ),
        lambda acc: acc["best"],
    )
    return folded.select(
        "anchor_id", *on, F.exists("xs", lambda x: x["event"].isNotNull()).alias("has_data"),
        (longest >= sustain).alias("has_event"),
    )


def filter_negatives(
    labels: DataFrame, group: str, positive_groups: DataFrame | None, cutoffs: DataFrame | None,
    elapsed: Column, require_onset: bool = False,
) -> DataFrame:
    """``labels`` with ``filtered_label`` and ``filter_reason``.

    Only valid negatives are filtered, and the first rule that applies wins: their
    group had the event (``positive_groups(event_name, group)``), then, with
    ``cutoffs(event_name[, group], cutoff)``, no onset in the group (only if
    ``require_onset``), then an elapsed time after the cutoff. A missing cutoff
    filters nothing else.
    """
    out = labels
    excluded: Column = F.lit(False)
    if positive_groups is not None:
        flagged = positive_groups.select("event_name", F.col(group), F.lit(True).alias("_positive_group")).distinct()
        out = out.join(flagged, ["event_name", group], "left")
        excluded = F.coalesce("_positive_group", F.lit(False))
    cutoff: Column = F.lit(None).cast("double")
    if cutoffs is not None:
        keys = ["event_name", group] if group in cutoffs.columns else ["event_name"]
        out = out.join(cutoffs.select(*keys, F.col("cutoff").alias("_cutoff")), keys, "left")
        cutoff = F.col("_cutoff")
    missing = F.lit(require_onset and cutoffs is not None) & cutoff.isNull()
    reason = (
        F.when(F.col("label") == int(Label.INVALID), F.lit(int(FilterReason.BASE_INVALID)))
        .when(F.col("label") == int(Label.POSITIVE), F.lit(int(FilterReason.POSITIVE)))
        .when(excluded, F.lit(int(FilterReason.EXCLUDED_GROUP)))
        .when(missing, F.lit(int(FilterReason.NO_ONSET_IN_GROUP)))
        .when(elapsed > cutoff, F.lit(int(FilterReason.AFTER_CUTOFF)))
        .otherwise(F.lit(int(FilterReason.KEPT)))
    )
    return out.withColumn("filter_reason", reason).withColumn(
        "filtered_label",
        F.when(F.col("filter_reason") >= int(FilterReason.EXCLUDED_GROUP), F.lit(int(Label.INVALID))).otherwise(F.col("label")),
    ).drop("_positive_group", "_cutoff")
