"""Cutting lineage and measuring sizes before a physical choice is made."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

_own_folder: dict[str, str] = {}


def staging_folder(spark: SparkSession) -> str:
    """Shared folder for staged tables: ``spark.checkpoint.dir`` of the session.

    Where the session names none, a temporary folder is made in local mode only;
    on a cluster each executor would write to its own disk, so that raises.
    """
    named = spark.conf.get("spark.checkpoint.dir", None)
    if named:
        return named.rstrip("/")
    master = spark.sparkContext.master
    if master.partition("[")[0] != "local":
        raise ValueError(f"spark.checkpoint.dir must name a folder that all executors of {master} share")
    app = spark.sparkContext.applicationId
    if app not in _own_folder:
        _own_folder[app] = tempfile.mkdtemp(prefix="spark_analog_")
    return _own_folder[app]


def stage(df: DataFrame) -> DataFrame:
    """Write ``df`` once and read it back.

    The result survives lost executors, freezes values that several branches
    must agree on, and has a known size, so Catalyst broadcasts it only when it
    is below ``spark.sql.autoBroadcastJoinThreshold`` and shuffles otherwise.
    """
    spark = df.sparkSession
    path = f"{staging_folder(spark)}/stage-{uuid.uuid4().hex}"
    df.write.parquet(path)
    read = spark.read.schema(df.schema).parquet(path)
    read._staged = True
    return read


def attach(df: DataFrame, side: DataFrame, keys, how: str = "inner") -> DataFrame:
    """Join a per-key table back; its measured size decides the join strategy."""
    known = side if getattr(side, "_staged", False) else stage(side)
    return df.join(known, list(keys), how)


def largest_group(df: DataFrame, keys) -> int:
    """Rows of the biggest group (map-side counted, one number to the driver)."""
    row = df.groupBy(*keys).count().agg(F.max("count")).first()
    return int(row[0] or 0)
