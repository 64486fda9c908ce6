"""Readers: record headers, JSON and CSV manifests, array files, window extraction."""

from __future__ import annotations

import io
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T


def read_headers(spark: SparkSession, path: str) -> DataFrame:
    """First line of each record header: ``file, record, n_segments, n_signals, fs, n_samples, base_time, base_date``.

    The line is ``name[/segments] signals [fs[/counter] [samples [time [date]]]]``;
    missing fields are null, comment lines are skipped.
    """
    lines = spark.read.option("wholetext", True).text(path).select(F.input_file_name().alias("file"), F.col("value"))
    first = F.get(F.filter(F.split("value", r"\r?\n"), lambda x: (F.trim(x) != "") & ~x.startswith("#")), F.lit(0))
    p = F.split(F.trim(first), r"\s+")
    name = F.split(F.get(p, F.lit(0)), "/")
    return lines.select(
        "file", F.get(name, F.lit(0)).alias("record"), F.get(name, F.lit(1)).try_cast("int").alias("n_segments"),
        F.get(p, F.lit(1)).try_cast("int").alias("n_signals"),
        F.get(F.split(F.get(p, F.lit(2)), r"[/(]"), F.lit(0)).try_cast("double").alias("fs"),
        F.get(p, F.lit(3)).try_cast("long").alias("n_samples"), F.get(p, F.lit(4)).alias("base_time"),
        F.get(p, F.lit(5)).alias("base_date"),
    )


def segment_offsets(segments: DataFrame, parent: str, order: list[str], samples: str) -> DataFrame:
    """``segments`` plus ``start_sample``: samples of the parent's earlier segments."""
    from chronoward.operators.ordered_scan import running_sums

    rows = segments.filter(F.col(parent).isNotNull()).withColumn("_label", F.col(parent).cast("string")).withColumn(
        "_n", F.coalesce(F.col(samples), F.lit(0)).cast("long")
    )
    out = running_sums(rows, "_label", order, ["_n"])
    return out.withColumnRenamed("before__n", "start_sample").drop("_label", "_n")


def read_window_manifest(spark: SparkSession, path: str) -> DataFrame:
    """``{patient: {file, window_times: [...]}}`` as one row per patient and window."""
    entry = T.StructType([
        T.StructField("file", T.StringType()), T.StructField("seg_name", T.StringType()),
        T.StructField("sampling_rate_hz", T.DoubleType()), T.StructField("samples_per_window", T.LongType()),
        T.StructField("window_times", T.ArrayType(T.DoubleType())),
    ])
    raw = spark.read.option("wholetext", True).text(path)
    entries = raw.select(F.explode(F.from_json("value", T.MapType(T.StringType(), entry))).alias("patient_id", "e"))
    windows = entries.select("patient_id", "e.*", F.posexplode("e.window_times").alias("window_index", "window_time"))
    span = F.col("samples_per_window") / F.col("sampling_rate_hz")
    return windows.drop("window_times").withColumn("input_start_time", F.col("window_time") - span / 2).withColumn(
        "input_end_time", F.col("window_time") + span / 2
    )


def read_typed_csv(spark: SparkSession, path: str, schema: str, required: list[str]) -> DataFrame:
    """CSV (plain or gzip) with header; fails if a required column is missing, odd values become null."""
    header = set(spark.read.option("header", True).csv(path).columns)
    missing = sorted(set(required) - header)
    if missing:
        raise ValueError(f"missing columns: {missing}")
    text = spark.read.option("header", True).csv(path)
    fields = T._parse_datatype_string(schema).fields
    return text.select(*[
        (F.col(f.name).try_cast(f.dataType) if f.name in header else F.lit(None).cast(f.dataType)).alias(f.name) for f in fields
    ])


def read_arrays(spark: SparkSession, path: str, channels: list[int] | None = None) -> DataFrame:
    """``.npy`` files of shape (channels, samples): one row per file and wanted channel."""
    files = spark.read.format("binaryFile").load(path).select("path", "content")

    def parse(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for name, content in zip(batch.column("path").to_pylist(), batch.column("content").to_pylist(), strict=True):
                data = np.load(io.BytesIO(content), allow_pickle=False)
                for c in channels if channels is not None else range(data.shape[0]):
                    yield pa.RecordBatch.from_arrays(
                        [pa.array([name]), pa.array([c], pa.int32()), pa.array([data[c].astype(np.float32)], pa.list_(pa.float32()))],
                        names=["path", "channel", "samples"],
                    )

    return files.mapInArrow(parse, "path string, channel int, samples array<float>")


def cut_window(samples: Column, start: Column, length: int) -> Column:
    """``length`` samples from a zero-based start, null where the array has none."""
    return F.transform(F.sequence(F.lit(0), F.lit(length - 1)), lambda i: F.when(start + i >= 0, F.get(samples, (start + i).cast("int"))))


# Vital signs and the other names their channels go by, in order of preference.
VITAL_ALIASES = {
    "ABP Mean": ["ABPMean", "ART Mean", "ARTMean"],
    "PULSE": [],
    "SpO2": ["%SpO2"],
    "RESP": [],
    "HR": [],
}


def first_alias(names: Column, preferred: str, aliases: list[str]) -> Column:
    """Zero-based place of the preferred channel, else of the first alias that is there; null if none is."""
    return F.coalesce(*[F.nullif(F.array_position(names, n), F.lit(0)) - 1 for n in (preferred, *aliases)]).cast("int")


def resolve_channel(
    names: Column, preferred: str, aliases: list[str], finite_fraction: Column | None = None, least_finite: float = 0.0,
    required: bool = False,
) -> Column:
    """Zero-based place of the one channel called ``preferred`` or by an alias; null if absent.

    The query fails if several match, if a ``required`` one is absent, or if the share
    ``finite_fraction`` of its finite samples is under ``least_finite``.
    """
    listed = F.array(*[F.lit(n) for n in (preferred, *aliases)])
    hits = F.filter(F.transform(names, lambda x, i: F.when(F.array_contains(listed, x), i)), lambda x: x.isNotNull())

    def fail(text: str) -> Column:
        return F.raise_error(F.lit(f"{text}: {preferred}")).cast("int")

    place = F.when(F.size(hits) > 1, fail("ambiguous channel"))
    if required:
        place = place.when(F.size(hits) < 1, fail("no supported channel"))
    if finite_fraction is not None:
        place = place.when((F.size(hits) == 1) & (finite_fraction < least_finite), fail("too few finite samples"))
    return place.otherwise(F.get(hits, F.lit(0)))


def free_segments(manifest: DataFrame, segment: str, free: str) -> DataFrame:
    """Segments a manifest marks as free; running it fails on a repeated free segment or one that is also marked not free."""
    per = manifest.filter(F.col(segment).isNotNull()).groupBy(segment).agg(
        F.count_if(F.col(free)).alias("_free"), F.count_if(~F.col(free)).alias("_not")
    ).filter(F.col("_free") > 0)
    wrong = F.when(F.col("_free") > 1, F.lit("repeated free segment")).when(F.col("_not") > 0, F.lit("contradictory segment"))
    return per.filter(F.when(wrong.isNull(), F.lit(True)).otherwise(F.raise_error(wrong).cast("boolean"))).select(segment)
