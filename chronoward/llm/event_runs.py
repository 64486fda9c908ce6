"""Repeated consecutive events collapsed into runs.

Runs are found by the difference of two row numbers: the place of an event within
its entity, and its place within its entity and canonical value. The difference is
constant exactly along a run. Row numbers are taken within bounded blocks of an
entity, so a hot entity is spread over many tasks; runs cut by a block border are
stitched from one row per cut piece.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

#: Minutes per block of an entity.
BLOCK_MINUTES = 2048


def minute_runs(df: DataFrame, entity: list[str], minute: Column, event: Column, min_length: int = 2) -> DataFrame:
    """``entity..., first_minute, last_minute, n_minutes`` of longest runs of event minutes.

    ``minute`` is the whole minute of a row, ``event`` whether the row has the event
    (null counts as false). On a minute grid the place within the entity is the
    minute itself; the place within entity and event is the position among its
    event minutes. Repeated rows count once; rows with a null entity or minute are
    ignored; an empty input gives an empty result.
    """
    keys = [f"k{i}" for i in range(len(entity))]
    hits = df.filter(F.coalesce(event, F.lit(False))).select(
        *[F.col(f"`{c}`").alias(k) for c, k in zip(entity, keys, strict=True)], minute.cast("long").alias("m")
    )
    hits = hits.filter("m is not null")
    for k in keys:
        hits = hits.filter(F.col(k).isNotNull())
    block = F.floor(F.col("m") / BLOCK_MINUTES).cast("long")
    # a block holds at most BLOCK_MINUTES distinct minutes, so the set is bounded
    placed = (
        hits.withColumn("block", block)
        .groupBy(*keys, "block")
        .agg(F.array_sort(F.collect_set("m")).alias("minutes"))
        .select(*keys, "block", F.posexplode("minutes").alias("place", "m"))
    )
    pieces = placed.groupBy(*keys, "block", (F.col("m") - F.col("place")).alias("difference")).agg(
        F.min("m").alias("a"), F.max("m").alias("b")
    )
    at_border = (F.pmod("a", F.lit(BLOCK_MINUTES)) == 0) | (F.pmod("b", F.lit(BLOCK_MINUTES)) == BLOCK_MINUTES - 1)
    inner = pieces.filter(~at_border).select(*keys, "a", "b")
    order = Window.partitionBy(*keys).orderBy("a")
    cut = (
        pieces.filter(at_border)
        .withColumn("opens", F.coalesce((F.col("a") != F.lag("b").over(order) + 1).cast("int"), F.lit(1)))
        .withColumn("run", F.sum("opens").over(order.rowsBetween(Window.unboundedPreceding, 0)))
        .groupBy(*keys, "run")
        .agg(F.min("a").alias("a"), F.max("b").alias("b"))
        .select(*keys, "a", "b")
    )
    return (
        inner.unionByName(cut)
        .withColumn("n_minutes", F.col("b") - F.col("a") + 1)
        .filter(F.col("n_minutes") >= min_length)
        .select(
            *[F.col(k).alias(c) for c, k in zip(entity, keys, strict=True)],
            F.col("a").alias("first_minute"), F.col("b").alias("last_minute"), "n_minutes",
        )
    )


def episode_runs(
    df: DataFrame, entity: str, event_id: str, value: Column, start: Column, end: Column,
    max_gap: int, min_length: int = 2, block_minutes: int = BLOCK_MINUTES,
) -> DataFrame:
    """``entity, event_name, first_minute, last_minute, n_events`` of runs of equal consecutive events.

    Each ``event_id`` counts once; events with a null entity, id, value, start or end
    are ignored. An entity's events are ordered by start, then id. Neighbours belong
    to one run if their canonical value is the same and the later starts at most
    ``max_gap`` after the greatest (exclusive) end so far in the run.
    """
    rows = df.select(
        F.col(f"`{entity}`").alias("k"), F.col(f"`{event_id}`").alias("id"), value.alias("v"),
        start.cast("long").alias("s"), end.cast("long").alias("e"),
    ).filter("k is not null and id is not null and v is not null and s is not null and e is not null")
    # repeated rows agree in everything but the arrival time
    rows = rows.groupBy("id").agg(*[F.min(c).alias(c) for c in ("k", "v", "s", "e")])
    rows = rows.withColumn("block", F.floor(F.col("s") / block_minutes).cast("long"))
    place = Window.partitionBy("k", "block").orderBy("s", "id")
    place_v = Window.partitionBy("k", "block", "v").orderBy("s", "id")
    stretch = (
        rows.withColumn("place", F.row_number().over(place))
        .withColumn("is_last", F.lead("id").over(place).isNull())
        .withColumn("difference", F.col("place") - F.row_number().over(place_v))
    )
    so_far = Window.partitionBy("k", "block", "v", "difference").orderBy("s", "id")
    reach = F.max("e").over(so_far.rowsBetween(Window.unboundedPreceding, -1))
    split = stretch.withColumn("opens", F.coalesce((F.col("s") > reach + max_gap).cast("int"), F.lit(1))).withColumn(
        "part", F.sum("opens").over(so_far.rowsBetween(Window.unboundedPreceding, 0))
    )
    pieces = split.groupBy("k", "block", "v", "difference", "part").agg(
        F.min("s").alias("s"), F.max("e").alias("e"), F.count(F.lit(1)).alias("n"),
        F.min("place").alias("place"), F.max("is_last").alias("is_last"),
    )
    stretches = Window.partitionBy("k", "block", "v", "difference")
    pieces = pieces.withColumn("touches_left", F.min("place").over(stretches) == 1).withColumn(
        "touches_right", F.max("is_last").over(stretches)
    )
    # a block's first and last stretch may continue in the neighbouring block: same rule, on all their
    # pieces, since an end carried in may cover several of them
    edge = pieces.filter("touches_left or touches_right")
    order = Window.partitionBy("k").orderBy("block", "s", "difference", "part")
    follows = (
        (F.lag("v").over(order) == F.col("v")) & F.lag("touches_right").over(order) & F.col("touches_left")
        & (F.lag("block").over(order) < F.col("block"))
    )
    same = (
        (F.lag("v").over(order) == F.col("v")) & (F.lag("difference").over(order) == F.col("difference"))
        & (F.lag("block").over(order) == F.col("block"))
    )
    chained = edge.withColumn("other", F.coalesce((~(follows | same)).cast("int"), F.lit(1))).withColumn(
        "chain", F.sum("other").over(order.rowsBetween(Window.unboundedPreceding, 0))
    )
    along = Window.partitionBy("k", "chain").orderBy("block", "s", "part")
    reach = F.max("e").over(along.rowsBetween(Window.unboundedPreceding, -1))
    stitched = (
        chained.withColumn("opens", F.coalesce((F.col("s") > reach + max_gap).cast("int"), F.lit(1)))
        .withColumn("link", F.sum("opens").over(along.rowsBetween(Window.unboundedPreceding, 0)))
        .groupBy("k", "v", "chain", "link")
        .agg(F.min("s").alias("s"), F.max("e").alias("e"), F.sum("n").alias("n"))
        .select("k", "v", "s", "e", "n")
    )
    runs = pieces.filter("not touches_left and not touches_right").select("k", "v", "s", "e", "n").unionByName(stitched)
    return runs.filter(F.col("n") >= min_length).select(
        F.col("k").alias(entity), F.col("v").alias("event_name"), F.col("s").alias("first_minute"),
        (F.col("e") - 1).alias("last_minute"), F.col("n").alias("n_events"),
    )
