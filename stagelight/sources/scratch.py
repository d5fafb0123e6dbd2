"""A fresh folder for files that a query derives and reads back, and files of any file system inside tasks."""

from __future__ import annotations

import gc
import tempfile
import uuid
from urllib.parse import quote

from pyarrow import fs
from pyspark.sql import SparkSession


def scratch_dir(spark: SparkSession) -> str:
    """A new path below the shared folder of the session; a local session without one gets a temporary folder."""
    shared = spark.conf.get("spark.checkpoint.dir", None)
    if shared:
        return f"{shared.rstrip('/')}/derived-{uuid.uuid4().hex}"
    if not spark.sparkContext.master.startswith("local"):
        raise ValueError("spark.checkpoint.dir must name a shared folder on a cluster")
    return tempfile.mkdtemp(prefix="spark-", dir="/tmp") + "/derived"


def open_path(path: str) -> tuple[fs.FileSystem, str]:
    """The Arrow file system of a path or URI as Spark spells it, and the path in it; a path without a scheme is a mounted one."""
    if "://" not in path or path.startswith("file:"):
        return fs.LocalFileSystem(), "/" + path.removeprefix("file:").lstrip("/")
    scheme, rest = path.split("://", 1)
    return fs.FileSystem.from_uri(f"{scheme}://{quote(rest, safe='/:@=&,;~!$*()')}")


def free_shuffles(spark: SparkSession) -> None:
    """Let Spark delete the shuffle files of tables that are written: its cleaner waits for a collection of the driver's heap, which may not come for long."""
    gc.collect()
    spark.sparkContext._jvm.System.gc()
