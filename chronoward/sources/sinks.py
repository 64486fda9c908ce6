"""Sinks: feature caches with a sidecar, shard merges with coverage checks, reports."""

from __future__ import annotations

import hashlib

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def schema_hash(df: DataFrame, revision: str) -> str:
    """Stable hash of column names, types and a revision."""
    text = revision + ";" + ";".join(f"{f.name}:{f.dataType.simpleString()}" for f in df.schema)
    return hashlib.sha256(text.encode()).hexdigest()


def write_cache(df: DataFrame, path: str, revision: str) -> None:
    """Parquet plus a one-row sidecar with row count and schema hash."""
    df.write.mode("overwrite").parquet(f"{path}/data")
    written = df.sparkSession.read.parquet(f"{path}/data")
    written.agg(F.count(F.lit(1)).alias("n_rows")).withColumn("schema_hash", F.lit(schema_hash(df, revision))).coalesce(1).write.mode(
        "overwrite"
    ).json(f"{path}/meta")


def read_cache(spark: SparkSession, path: str, revision: str) -> DataFrame:
    """The cache at ``path``; an error if its schema or row count is not what was written."""
    df = spark.read.parquet(f"{path}/data")
    meta = spark.read.json(f"{path}/meta").first()
    if meta["schema_hash"] != schema_hash(df, revision):
        raise ValueError("cache schema or revision differs")
    if meta["n_rows"] != df.count():
        raise ValueError("cache is incomplete")
    return df


def integrity(df: DataFrame, keys: list[str], minutes: str, length: int) -> DataFrame:
    """One row: groups, groups with missing steps, steps out of range, repeated keys."""
    per_step = df.groupBy(*keys, minutes).agg(F.count(F.lit(1)).alias("c"))
    per_key = per_step.groupBy(*keys).agg(
        F.count_if(F.col(minutes).between(0, length - 1)).alias("k"),
        F.count_if(~F.col(minutes).between(0, length - 1)).alias("outside"), F.count_if(F.col("c") > 1).alias("repeated"),
    )
    return per_key.agg(
        F.count(F.lit(1)).alias("n_groups"), F.count_if(F.col("k") < length).alias("n_incomplete"),
        F.sum("outside").alias("n_outside"), F.sum("repeated").alias("n_repeated"),
    )


def merge_shards(shards: list[DataFrame], expected: DataFrame, keys: list[str]) -> DataFrame:
    """Union of shards with equal schemas; running the checks fails on missing, extra or repeated keys."""
    first = shards[0]
    if any(s.schema.simpleString() != first.schema.simpleString() for s in shards[1:]):
        raise ValueError("shard schemas differ")
    out = first
    for s in shards[1:]:
        out = out.unionByName(s)
    seen = out.groupBy(*keys).agg(F.count(F.lit(1)).alias("_c"))
    wrong = seen.join(expected.select(*keys, F.lit(True).alias("_e")).distinct(), keys, "full").filter(
        (F.col("_c") != 1) | F.col("_c").isNull() | F.col("_e").isNull()
    )
    if wrong.limit(1).count():
        raise ValueError("shards do not cover the expected keys exactly once")
    return out


def write_bundle(df: DataFrame, path: str, values: str, mask: str, names: list[str], revision: str) -> None:
    """A table of target and mask arrays with a sidecar that also names the targets; an error if an array has another length."""
    whole = (F.size(values) == len(names)) & (F.size(mask) == len(names))
    checked = df.filter(F.when(whole, F.lit(True)).otherwise(F.raise_error(F.lit("array of another length")).cast("boolean")))
    write_cache(checked, path, revision)
    named = df.sparkSession.range(1).select(F.array(*[F.lit(n) for n in names]).alias("names"))
    named.coalesce(1).write.mode("overwrite").json(f"{path}/names")


def read_bundle(spark: SparkSession, path: str, revision: str) -> DataFrame:
    """A bundle of :func:`write_bundle` plus ``target_names``."""
    names = spark.read.json(f"{path}/names").first()["names"]
    return read_cache(spark, path, revision).withColumn("target_names", F.array(*[F.lit(n) for n in names]))


def write_channel_stats(stats: DataFrame, path: str) -> None:
    """Normalisation statistics (one row per channel) as JSON lines."""
    stats.coalesce(1).write.mode("overwrite").json(path)


def read_channel_stats(spark: SparkSession, path: str) -> DataFrame:
    """Statistics of :func:`write_channel_stats`; an error if a spread is not positive."""
    stats = spark.read.schema("feature_name string, n long, n_excluded long, mean double, std double").json(path)
    return stats.filter(
        F.when(F.col("std") > 0, F.lit(True)).otherwise(F.raise_error(F.lit("spread is not positive")).cast("boolean"))
    )


def schema_rows(spark: SparkSession, columns: list[tuple[str, str]], window: str) -> DataFrame:
    """One row per feature: ``feature_index, feature_name, unit, window``."""
    return spark.createDataFrame(
        [(i, name, unit, window) for i, (name, unit) in enumerate(columns)],
        "feature_index int, feature_name string, unit string, window string",
    )


def markdown_table(df: DataFrame, order: list[str], max_rows: int = 200) -> str:
    """A report of at most ``max_rows`` rows as a Markdown table."""
    rows = df.orderBy(*order).limit(max_rows).collect()
    lines = ["| " + " | ".join(df.columns) + " |", "|" + "---|" * len(df.columns)]
    lines += ["| " + " | ".join("" if v is None else str(v) for v in r) + " |" for r in rows]
    return "\n".join(lines)
