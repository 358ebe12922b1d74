"""Intermediate tables in the folder that all executors share.

A lost executor never loses such a table, and lineage ends at its files.
"""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import Column, DataFrame, Observation, SparkSession

_OWN: list[str] = []


def shared_dir(spark: SparkSession) -> str:
    """The folder named by spark.checkpoint.dir.

    Where it is unset: in local mode, as in tests, one temporary folder per process; on a cluster, a folder in the
    warehouse, which all executors share.
    """
    found = spark.conf.get("spark.checkpoint.dir", None)
    if found:
        return found.rstrip("/")
    if not spark.sparkContext.master.startswith("local[") and spark.sparkContext.master != "local":
        return spark.conf.get("spark.sql.warehouse.dir").rstrip("/") + "/_tesserae"
    if not _OWN:
        _OWN.append("file://" + tempfile.mkdtemp(prefix="tesserae-shared-"))
    return _OWN[0]


def new_dir(spark: SparkSession, name: str) -> str:
    """A path in the shared folder that no other call gets."""
    return f"{shared_dir(spark)}/{name}-{uuid.uuid4().hex}"


def save(df: DataFrame, name: str, observed: Observation | None = None, *metrics: Column) -> DataFrame:
    """Write df as Parquet to the shared folder and read it back; metrics are computed on the way."""
    spark = df.sparkSession
    path = new_dir(spark, name)
    (df.observe(observed, *metrics) if observed else df).write.parquet(path)
    return spark.read.schema(df.schema).parquet(path)
