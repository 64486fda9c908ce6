"""Interval joins: overlap, containment, best overlap, nearest distance.

Overlap is strict (touching intervals do not overlap). Joins always have the entity
as equality key; where an entity may hold very many intervals, both sides are also
cut into time buckets, so no entity is joined all against all.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from chronoward.operators.ordered_scan import running_sums


def overlap_length(a_start: Column, a_end: Column, b_start: Column, b_end: Column) -> Column:
    """Length of the common part, 0 if there is none."""
    return F.greatest(F.least(a_end, b_end) - F.greatest(a_start, b_start), F.lit(0))


def contained(a_start: Column, a_end: Column, b_start: Column, b_end: Column, tolerance: float) -> Column:
    """Does [b_start, b_end] contain [a_start, a_end], give or take ``tolerance``?"""
    return (a_start >= b_start - tolerance) & (a_end <= b_end + tolerance)


def overlap_join(left: DataFrame, right: DataFrame, bucket: int) -> DataFrame:
    """Pairs of overlapping intervals of one entity: columns of both sides.

    Sides have ``k`` (entity), start and end columns ``ls``/``le`` and ``rs``/``re`` in
    whole units; nulls and empty intervals overlap nothing. Both sides are exploded to
    buckets of ``bucket`` units, joined on (k, bucket), and a pair is kept in the
    bucket where its common part begins, so it appears once. Choose ``bucket`` near
    the usual interval length.
    """
    def cut(df: DataFrame, s: str, e: str) -> DataFrame:
        return df.filter(f"k is not null and {s} is not null and {e} is not null and {e} > {s}").withColumn(
            "_bucket",
            F.explode(F.sequence(F.floor(F.col(s) / bucket).cast("long"), F.floor((F.col(e) - 1) / bucket).cast("long"))),
        )

    pairs = cut(left, "ls", "le").join(cut(right, "rs", "re"), ["k", "_bucket"])
    begin = F.greatest("ls", "rs")
    return pairs.filter(
        (F.col("ls") < F.col("re")) & (F.col("le") > F.col("rs")) & (F.floor(begin / bucket) == F.col("_bucket"))
    ).drop("_bucket")


def best_overlap(pairs: DataFrame, left_id: list[str], tie: list[str]) -> DataFrame:
    """Per left id the pair with the greatest ``overlap``; ties by ``tie`` ascending."""
    order = Window.partitionBy(*left_id).orderBy(F.desc("overlap"), *tie)
    return pairs.withColumn("_n", F.row_number().over(order)).filter("_n = 1").drop("_n")


def nearest_distance(left: DataFrame, right: DataFrame, reach: int) -> DataFrame:
    """``left`` (``k``, ``t``, ...) plus ``distance`` to the nearest right time of its entity within ``reach``.

    Times are whole units. Right times are put into buckets of ``reach`` and looked up
    in the own and both neighbouring buckets; null if none is near.
    """
    cells = F.floor(F.col("t") / reach).cast("long")
    near = right.filter("k is not null and t is not null").select("k", F.col("t").alias("_rt")).distinct().withColumn(
        "_cell", F.floor(F.col("_rt") / reach).cast("long")
    )
    # per cell only the extremes and the sorted times matter; keep the times, they are distinct
    wide = left.withColumn("_row", F.monotonically_increasing_id()).withColumn(
        "_cell", F.explode(F.array(cells - 1, cells, cells + 1))
    )
    hit = wide.join(near, ["k", "_cell"], "left").withColumn("_d", F.abs(F.col("t") - F.col("_rt")))
    names = left.columns
    return hit.groupBy("_row", *names).agg(F.min(F.when(F.col("_d") <= reach, F.col("_d"))).alias("distance")).drop("_row")


def sums_earlier(asked: DataFrame, rows: DataFrame, keep: list[str], columns: list[str]) -> DataFrame:
    """``keep..., columns...``: sums over the rows of ``rows(label, at, columns...)`` of a question's label with a lesser ``at``.

    ``asked`` has ``label, at, keep...``; the columns are whole numbers without nulls.
    One range sort of both sides with running sums; no label is joined all against all.
    """
    zero = [F.lit(0).cast("long").alias(c) for c in columns]
    both = asked.select("label", "at", *keep, *zero, F.lit(0).alias("_row")).unionByName(
        rows.select("label", "at", *columns, F.lit(1).alias("_row")), allowMissingColumns=True
    )
    # at equal times the question comes first
    counted = running_sums(both, "label", ["at", "_row"], columns)
    return counted.filter("_row = 0").select(*keep, *[F.col(f"before_{c}").alias(c) for c in columns])


def count_earlier(asked: DataFrame, rows: DataFrame, keep: list[str]) -> DataFrame:
    """``keep..., n``: for each of ``asked(label, at, keep...)`` the rows of ``rows(label, at)`` of its label with a lesser ``at``."""
    return sums_earlier(asked, rows.withColumn("n", F.lit(1).cast("long")), keep, ["n"])
