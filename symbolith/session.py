"""Session settings for local runs, and cutting lineage where a relation is read several times."""

from __future__ import annotations

import tempfile

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

SETTINGS = {
    "spark.sql.adaptive.enabled": "true",
    "spark.sql.adaptive.skewJoin.enabled": "true",
    "spark.sql.session.timeZone": "UTC",
    "spark.sql.execution.arrow.pyspark.enabled": "true",
    "spark.cleaner.referenceTracking.cleanCheckpoints": "true",
}


def local_session(cores: int = 8, memory: str = "16g", partitions: int | None = None) -> SparkSession:
    b = SparkSession.builder.master(f"local[{cores}]").appName("symbolith").config("spark.ui.enabled", "false")
    b = b.config("spark.driver.memory", memory).config("spark.sql.shuffle.partitions", str(partitions or cores))
    return b.config(map=SETTINGS).getOrCreate()


def materialize(df: DataFrame) -> DataFrame:
    """Compute ``df`` once, reliably: into the cluster's ``spark.checkpoint.dir``, or one of our own if none is set."""
    spark, sc = df.sparkSession, df.sparkSession.sparkContext
    if not (spark.conf.get("spark.checkpoint.dir", None) or sc.getCheckpointDir()):
        local = sc.master.startswith("local")
        sc.setCheckpointDir(tempfile.mkdtemp(prefix="symbolith-") if local else spark.conf.get("spark.sql.warehouse.dir").rstrip("/") + "/_checkpoints")
    return df.checkpoint(eager=True)


#: Narrow rows that are broadcast at most; a side of more is joined by key.
BROADCAST_ROWS = 250_000


def small(df: DataFrame) -> DataFrame:
    """``df``, materialised, with a hint to broadcast it if it has been counted to be small."""
    df = materialize(df)
    return F.broadcast(df) if df.count() <= BROADCAST_ROWS else df
