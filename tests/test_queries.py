"""Every core query with SQL against DuckDB, over whole (small) tables."""

import math

import pytest

from chronoward.plans import catalogue
from tests.oracle import connection, difference

FOLDER = "/root/testdata/sf0.001"


@pytest.fixture(scope="module")
def con():
    return connection(FOLDER)


@pytest.mark.parametrize("name", sorted(catalogue.SQL))
def test_query_equals_sql(spark, con, name):
    assert difference(catalogue.QUERIES[name](spark, FOLDER), catalogue.SQL[name], con) == ""


@pytest.mark.parametrize(
    "name", ["waveform_spectral", "waveform_entropy", "waveform_morphology", "beat_table", "cyclic_variation",
             "pulse_timing"]
)
def test_query_runs(spark, name):
    assert catalogue.QUERIES[name](spark, FOLDER).count() > 0


def test_entry_point(spark):
    import __spark_entry__ as e

    assert e.entry(spark).count() >= 0
    assert set(e.oracle_sql()) <= set(e.queries())


def test_coupling_without_variation(spark, tmp_path):
    """Constant sides, of few and of enough minutes, neither fail nor differ from SQL."""
    pairs = {
        "few": [(70.0, 80.0)] * 5, "pressure": [(70.0, 60.0 + i) for i in range(20)], "rate": [(70.0 + i, 80.0) for i in range(20)],
        "both": [(70.0, 80.0)] * 20, "varied": [(70.0 + i * i % 7, 80.0 - i) for i in range(20)],
    }
    rows = [
        (s, ch, 40 * k + 2 * i + j, 0.0, 60.0 * i, v, True, 60)
        for k, (s, x) in enumerate(pairs.items()) for i, both in enumerate(x) for j, (ch, v) in enumerate(zip(("ABP Mean", "HR"), both))
    ]
    spark.createDataFrame(
        rows, "segment_id string, channel_name string, reading_id long, origin_seconds double, minute_time double, minute_value float, "
        "minute_valid boolean, finite_samples_per_minute int",
    ).write.parquet(f"{tmp_path}/minute_timeline.parquet")
    name = "pressure_interval_coupling"

    def text(values):
        return sorted(tuple(map(str, v)) for v in values)  # NaN and null stay apart

    got = catalogue.QUERIES[name](spark, str(tmp_path)).select("segment_id", "lag", "n", "r", "slope").collect()
    assert text(got) == text(connection(tmp_path).execute(catalogue.SQL[name]).fetchall())
    at = {(r.segment_id, r.lag): r for r in got}
    assert {s for s, _ in at} == set(pairs) - {"few"} and len(at) == 12
    assert all(math.isnan(at[s, lag].r) == (s != "varied") for s, lag in at)
    assert all(math.isnan(at[s, lag].slope) == (s in ("pressure", "both")) for s, lag in at)
    assert at["rate", 0].slope == 0.0
