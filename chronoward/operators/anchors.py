"""Anchor grids, future-value targets, key alignment, splits, samples and batches."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from chronoward.operators.ordered_scan import running_sums


def anchor_grid(extents: DataFrame, first: Column, last: Column, stride: int, min_count: int = 1) -> DataFrame:
    """``extents`` exploded to ``anchor`` = first, first + stride, ... up to last; none if there are under ``min_count``."""
    return extents.filter(last >= first + (min_count - 1) * stride).withColumn(
        "anchor", F.explode(F.sequence(first.cast("long"), last.cast("long"), F.lit(stride).cast("long")))
    )


def quantised(time: Column) -> Column:
    """Time in whole micro-units (6 decimals, ties to even): an exact join key."""
    return F.rint(time * 1e6).cast("long")


def best_key(left: DataFrame, right: DataFrame, choices: list[list[str]]) -> list[str]:
    """The first of the key choices whose columns both sides have without nulls on the left."""
    for keys in choices:
        if all(k in left.columns and k in right.columns for k in keys):
            empty = F.lit(False)
            for k in keys:
                empty = empty | F.col(k).isNull()
            if left.filter(empty).isEmpty():
                return keys
    raise ValueError(f"no usable key among {choices}")


def align_targets(anchors: DataFrame, targets: DataFrame, choices: list[list[str]], times: list[str] | None = None) -> DataFrame:
    """``anchors`` with the columns of their ``targets`` row, by the best available key.

    Key columns in ``times`` are compared to six decimals. The query fails for an
    anchor without targets or a key that targets hold twice; extra targets are left out.
    """
    keys = best_key(anchors, targets, choices)

    def keyed(df: DataFrame) -> DataFrame:
        return df.withColumns({f"_k{i}": quantised(F.col(k)) if k in (times or []) else F.col(k) for i, k in enumerate(keys)})

    names = [f"_k{i}" for i in range(len(keys))]
    rest = [c for c in targets.columns if c not in anchors.columns]
    right = require_unique(keyed(targets), names).select(*names, *rest, F.lit(True).alias("_hit"))
    found = keyed(anchors).join(right, names, "left").filter(
        F.when(F.col("_hit"), F.lit(True)).otherwise(F.raise_error(F.lit(f"anchor without targets by {keys}")).cast("boolean"))
    )
    return found.drop(*names, "_hit")


def subset_by_ids(df: DataFrame, wanted: DataFrame, key: str) -> DataFrame:
    """Rows of ``df`` with a wanted id; the query fails if a wanted id has none."""
    ids = wanted.select(key).filter(F.col(key).isNotNull()).distinct()
    some = df.select(F.col(key).alias("_have")).distinct()
    checked = ids.join(some, ids[key] == some["_have"], "left").filter(
        F.when(F.col("_have").isNotNull(), F.lit(True)).otherwise(F.raise_error(F.lit(f"requested {key} is missing")).cast("boolean"))
    ).select(key)
    return df.join(checked, key)


def concat_columns(left: DataFrame, right: DataFrame, keys: list[str]) -> DataFrame:
    """Two feature tables of the same keys side by side.

    An error if other columns share a name; the query fails if a key is on one side
    only or occurs twice.
    """
    shared = sorted((set(left.columns) & set(right.columns)) - set(keys))
    if shared:
        raise ValueError(f"columns in both tables: {shared}")
    a = require_unique(left, keys).withColumn("_a", F.lit(True))
    b = require_unique(right, keys).withColumn("_b", F.lit(True))
    whole = a.join(b, keys, "full").filter(
        F.when(F.col("_a") & F.col("_b"), F.lit(True)).otherwise(F.raise_error(F.lit(f"key {keys} on one side only")).cast("boolean"))
    )
    return whole.drop("_a", "_b")


def future_values(
    anchors: DataFrame, source: DataFrame, keys: list[str], time: str, value: str, horizons: list[int], gap: int = 0
) -> DataFrame:
    """``keys, time, horizon, target``: the value ``gap + horizon`` steps later, null if there is none.

    An equality join on (keys, time + offset): the anchors are exploded by horizon
    (a small constant), the source is matched once.
    """
    wide = anchors.select(*keys, time, F.explode(F.array(*[F.lit(h) for h in horizons])).alias("horizon"))
    wide = wide.withColumn("_at", F.col(time) + F.col("horizon") + gap)
    later = source.select(*keys, F.col(time).alias("_at"), F.col(value).alias("target"))
    return wide.join(later, [*keys, "_at"], "left").select(*keys, time, "horizon", "target")


def match_rate(targets: DataFrame) -> DataFrame:
    """Per horizon: rows, matched rows and their share."""
    return targets.groupBy("horizon").agg(
        F.count(F.lit(1)).alias("n"), F.count("target").alias("n_matched"),
        F.round(F.count("target") / F.count(F.lit(1)), 9).alias("match_rate"),
    )


def key_audit(left: DataFrame, right: DataFrame, keys: list[str]) -> DataFrame:
    """One row: distinct keys on both sides, only left, only right, and duplicated keys."""
    marks = left.select(*keys, F.lit(1).alias("_l"), F.lit(0).alias("_r")).unionByName(
        right.select(*keys, F.lit(0).alias("_l"), F.lit(1).alias("_r"))
    )
    per_key = marks.groupBy(*keys).agg(F.sum("_l").alias("l"), F.sum("_r").alias("r"))
    return per_key.agg(
        F.count_if((F.col("l") > 0) & (F.col("r") > 0)).alias("n_both"),
        F.count_if(F.col("r") == 0).alias("n_left_only"), F.count_if(F.col("l") == 0).alias("n_right_only"),
        F.count_if(F.col("l") > 1).alias("n_left_duplicated"), F.count_if(F.col("r") > 1).alias("n_right_duplicated"),
    )


def require_unique(df: DataFrame, keys: list[str]) -> DataFrame:
    """``df`` unchanged; running it fails if a key occurs twice (many-to-one joins rely on it)."""
    n = F.count(F.lit(1)).over(Window.partitionBy(*keys))
    checked = df.withColumn("_n", n).filter(
        F.when(F.col("_n") == 1, F.lit(True)).otherwise(F.raise_error(F.lit(f"duplicate key {keys}")).cast("boolean"))
    )
    return checked.drop("_n")


def keep_first(df: DataFrame, keys: list[str], order: list[str | Column]) -> DataFrame:
    """First row per key in a total order."""
    w = Window.partitionBy(*keys).orderBy(*order)
    return df.withColumn("_n", F.row_number().over(w)).filter("_n = 1").drop("_n")


def hash_unit(value: Column) -> Column:
    """Deterministic number in [0, 1) of a whole number, by arithmetic any engine repeats."""
    return F.pmod(value.cast("decimal(38,0)") * F.lit(2654435761).cast("decimal(38,0)"), F.lit(1000003)).cast("double") / 1000003.0


def entity_split(df: DataFrame, entity: Column, proportions: list[tuple[str, float]]) -> DataFrame:
    """``df`` plus ``split_label`` from the entity's hash."""
    x, label, reached = hash_unit(entity), F.lit(proportions[-1][0]), 0.0
    bounds = []
    for name, share in proportions[:-1]:
        reached += share
        bounds.append((name, reached))
    for name, bound in reversed(bounds):
        label = F.when(x < bound, F.lit(name)).otherwise(label)
    return df.withColumn("split_label", label)


def stratified_sample(df: DataFrame, strata: list[str], id_column: str, size: int) -> DataFrame:
    """At most ``size`` rows per stratum, by hash of the id (a sampling operator)."""
    w = Window.partitionBy(*strata).orderBy(hash_unit(F.col(id_column)), id_column)
    return df.withColumn("_n", F.row_number().over(w)).filter(F.col("_n") <= size).drop("_n")


def apply_splits(df: DataFrame, splits: DataFrame, entity: str) -> DataFrame:
    """``df`` with its entity's ``split_label``; the query fails for an entity without one."""
    labels = require_unique(splits.select(entity, "split_label"), [entity])
    found = df.join(labels, entity, "left")
    label = F.when(F.col("split_label").isNotNull(), F.col("split_label")).otherwise(F.raise_error(F.lit(f"no split for {entity}")))
    return found.withColumn("split_label", label)


def top_per_group(df: DataFrame, group: list[str], order: list[str], n: int, parts: int = 64) -> DataFrame:
    """The first ``n`` rows of each group in a total order: of hashed parts of it first, then of their best."""
    best = Window.partitionBy(*group, "_part").orderBy(*order)
    some = df.withColumn("_part", F.pmod(F.xxhash64(*order), F.lit(parts))).withColumn("_n", F.row_number().over(best)).filter(F.col("_n") <= n)
    return some.withColumn("_n", F.row_number().over(Window.partitionBy(*group).orderBy(*order))).filter(F.col("_n") <= n).drop("_n", "_part")


def grouped_batches(df: DataFrame, group: str, row_id: str, batch: int) -> DataFrame:
    """``df`` plus ``batch_id``: rows of a group in hash order, cut into batches; a group may fill many tasks."""
    rows = df.withColumns({
        "_label": F.coalesce(F.col(group).cast("string"), F.lit("\u0000")), "_unit": hash_unit(F.col(row_id)), "_one": F.lit(1).cast("long"),
    })
    placed = running_sums(rows, "_label", ["_unit", row_id], ["_one"])
    return placed.withColumn("batch_id", F.floor(F.col("before__one") / batch).cast("long")).drop("_label", "_unit", "_one", "before__one")


def balanced_shards(work: DataFrame, key: str, cost: str, shards: int) -> DataFrame:
    """``work`` plus ``shard``: keys in order of falling cost dealt out in serpentine order."""
    placed = running_sums(
        work.select("*", F.lit("all").alias("_label"), (-F.col(cost)).alias("_order"), F.lit(1).cast("long").alias("_one")),
        "_label", ["_order", key], ["_one"],
    )
    place = F.col("before__one")
    lap, spot = F.floor(place / shards), place % shards
    return placed.withColumn(
        "shard", F.when(lap % 2 == 0, spot).otherwise(F.lit(shards - 1) - spot).cast("int")
    ).drop("_label", "_order", "_one", "before__one")
