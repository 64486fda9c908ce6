"""Session helpers: table access, checkpoint folder, size-checked broadcast."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """The Parquet table ``name`` of the data folder."""
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def ensure_checkpoint_dir(spark: SparkSession) -> None:
    """Use the shared folder named by ``spark.checkpoint.dir``.

    Only on one machine (a local master, as in tests) is a temporary folder set when
    neither the context nor the session names one; on a cluster that is an error.
    """
    sc = spark.sparkContext
    if sc.getCheckpointDir() is None:
        shared = spark.conf.get("spark.checkpoint.dir", None)
        if shared is None and not sc.master.startswith("local"):
            raise ValueError("set spark.checkpoint.dir to a folder that all machines share")
        sc.setCheckpointDir(shared or tempfile.mkdtemp(prefix="chronoward-ckpt-"))


def scratch_folder(spark: SparkSession, name: str) -> str:
    """A new folder under the shared checkpoint folder of this session, for a table a query writes and reads again."""
    ensure_checkpoint_dir(spark)
    return f"{spark.sparkContext.getCheckpointDir()}/{name}-{uuid.uuid4().hex}"


def checkpoint(df: DataFrame) -> DataFrame:
    """Reliable (replicated by the shared file system) eager checkpoint."""
    ensure_checkpoint_dir(df.sparkSession)
    return df.checkpoint(eager=True)


def settled_side(df: DataFrame, max_rows: int = 100_000) -> DataFrame:
    """A summary that a larger table is joined to: computed once, and broadcast if it has at most ``max_rows`` rows."""
    return broadcast_if_small(checkpoint(df), max_rows)


def broadcast_if_small(df: DataFrame, max_rows: int) -> DataFrame:
    """Broadcast ``df`` only if counting shows at most ``max_rows`` rows.

    The count stops early (``limit``), so an unexpectedly large side costs one
    bounded probe and then stays an ordinary shuffled join side.
    """
    if df.limit(max_rows + 1).count() <= max_rows:
        return F.broadcast(df)
    return df
