"""Pairs of records nearest in time within a tolerance.

The right side's times become nearest-neighbour intervals: from the midpoint to
the previous time to the midpoint to the next one, cut to the tolerance. A left
time lies in at most one of them, so the match is a range join on a partitioned
interval index of time buckets. Neighbours are looked up inside bounded time
blocks that overlap by the tolerance, so a hot entity is spread over many tasks.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def nearest_in_time(
    left: DataFrame, right: DataFrame, tolerance: float,
    left_cols: tuple[Column, Column, Column], right_cols: tuple[Column, Column, Column],
    block: float = 14400.0,
) -> DataFrame:
    """``left_id, right_id, distance``: each left record with its nearest right record.

    The column triples are (entity, time in seconds, id). Rows with a null entity, id
    or time, or a time that is not finite, are ignored; repeated rows count once. A
    tie between two right times goes to the earlier one, equal right times to the
    least id. At most one pair per distinct left (entity, time, id); no right record
    within ``tolerance``, no pair.
    """

    def pick(df: DataFrame, cols: tuple[Column, Column, Column]) -> DataFrame:
        k, t, i = cols
        out = df.select(k.alias("k"), t.cast("double").alias("t"), i.alias("id"))
        return out.filter("k is not null and t is not null and id is not null and not isnan(t) and abs(t) < 1e300")

    width = 2.0 * tolerance
    lefts = pick(left, left_cols).distinct().withColumn("bucket", F.floor(F.col("t") / width).cast("long"))
    rights = pick(right, right_cols).withColumn("home", F.floor(F.col("t") / block).cast("long"))
    # neighbours farther than two tolerances do not shape an interval
    offset = F.col("t") - F.col("home") * block
    rights = rights.withColumn(
        "shift",
        F.explode(
            F.array_compact(
                F.array(F.lit(0), F.when(offset <= width, F.lit(-1)), F.when(offset >= block - width, F.lit(1)))
            )
        ),
    )
    rights = (
        rights.withColumn("block", F.col("home") + F.col("shift"))
        .groupBy("k", "block", "t")
        .agg(F.min("id").alias("id"), F.max(F.col("shift") == 0).alias("own"))
    )
    order = Window.partitionBy("k", "block").orderBy("t")
    before, after = F.lag("t").over(order), F.lead("t").over(order)
    half_back = F.coalesce((F.col("t") - before) / 2, F.lit(tolerance + 1.0))
    half_on = F.coalesce((after - F.col("t")) / 2, F.lit(tolerance + 1.0))
    # open towards the earlier neighbour (it owns the midpoint), closed towards the later one
    intervals = (
        rights.withColumn("back", half_back).withColumn("on", half_on).filter("own")
        .withColumn("lo", F.col("t") - F.least("back", F.lit(tolerance)))
        .withColumn("hi", F.col("t") + F.least("on", F.lit(tolerance)))
        .withColumn("lo_open", F.col("back") <= tolerance)
    )
    indexed = intervals.withColumn(
        "bucket",
        F.explode(
            F.sequence(F.floor(F.col("lo") / width).cast("long"), F.floor(F.col("hi") / width).cast("long"))
        ),
    ).select(
        F.col("k").alias("rk"), F.col("bucket").alias("rb"), F.col("id").alias("rid"), F.col("t").alias("rt"),
        "lo", "hi", "lo_open",
    )
    inside = (F.col("t") <= F.col("hi")) & ((F.col("t") > F.col("lo")) | (~F.col("lo_open") & (F.col("t") >= F.col("lo"))))
    joined = lefts.join(indexed, (F.col("k") == F.col("rk")) & (F.col("bucket") == F.col("rb")) & inside)
    # rounding of midpoints can put a time into two touching intervals: keep the nearer
    best = joined.withColumn("distance", F.abs(F.col("t") - F.col("rt"))).groupBy("k", "t", "id").agg(
        F.min(F.struct("distance", "rt", "rid")).alias("m")
    )
    return best.filter(F.col("m.distance") <= tolerance).select(
        F.col("id").alias("left_id"), F.col("m.rid").alias("right_id"), F.col("m.distance").alias("distance")
    )
