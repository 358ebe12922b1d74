"""Files by ranges of bytes: what a source needs that finds its own record borders.

A file's name and size come from Spark's listing, the bytes through pyarrow's file systems, so that a task reads what
it needs and no more.
"""

from __future__ import annotations

import tempfile
import uuid
from urllib.parse import urlsplit

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

BLOCK = 64 << 20
_OWN = f"tesserae-shared-{uuid.uuid4().hex}"


def file_ranges(spark: SparkSession, path: str | list[str], block: int = BLOCK) -> DataFrame:
    """file, size, start, stop: ranges of at most `block` bytes, dealt out to as many tasks as there are, 4 a core at most."""
    files = spark.read.format("binaryFile").load(path).select(F.col("path").alias("file"), F.col("length").alias("size")).where("size > 0")  # no content is read
    starts = F.transform(F.sequence(F.lit(0).cast("long"), F.ceil(F.col("size") / block).cast("long") - 1), lambda i: i * block)
    rows = files.select("file", "size", F.explode(starts).alias("start")).withColumn("stop", F.least(F.col("start") + block, F.col("size")))
    return rows.repartition(4 * spark.sparkContext.defaultParallelism, "file", "start")


def open_file(name: str):
    """(file system, place in it) of a name as Spark gives it."""
    from pyarrow import fs

    if name.startswith("file:/") and not name.startswith("file://"):
        name = name.replace("file:/", "file:///", 1)
    return fs.FileSystem.from_uri(name)


def shared_folder(spark: SparkSession, name: str) -> str:
    """A new folder that all tasks can reach: in the folder of spark.checkpoint.dir, else in the warehouse.

    Without the former, local mode takes a temporary folder, and a cluster refuses a warehouse on the driver's own disk.
    """
    root = spark.conf.get("spark.checkpoint.dir", None)
    if not root and spark.sparkContext.master.split("[")[0] == "local":
        root = f"file://{tempfile.gettempdir()}/{_OWN}"
    elif not root:
        root = spark.conf.get("spark.sql.warehouse.dir")
        if urlsplit(root).scheme in ("", "file"):
            raise ValueError("set spark.checkpoint.dir to a folder that executors share")
    return f"{root.rstrip('/')}/{name}-{uuid.uuid4().hex}"


def folders(folder: str) -> list[str]:
    """The folders in a folder."""
    from pyarrow import fs

    system, place = open_file(folder)
    return [f.path for f in system.get_file_info(fs.FileSelector(place)) if f.type == fs.FileType.Directory]
