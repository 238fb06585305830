"""Tables in the folder that the driver and all executors see, spark.checkpoint.dir."""

from __future__ import annotations

import re
import tempfile
import uuid
from functools import lru_cache

from pyspark.sql import SparkSession


def shared_dir(spark: SparkSession) -> str:
    """Only where the setting is absent and all runs in one process (local tests) a temporary folder serves."""
    found = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getConf().get("spark.checkpoint.dir")
    if not found:
        if not re.fullmatch(r"local(\[.*\])?", spark.sparkContext.master):
            raise ValueError("set spark.checkpoint.dir to a folder that all executors share")
        found = _own_dir(spark.sparkContext.applicationId)
    if ":/" not in found:  # on the cluster's default file system
        path = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(found)
        found = path.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).makeQualified(path).toString()
    return re.sub(r"^file:/+", "file:///", found).rstrip("/")


@lru_cache(None)
def _own_dir(application: str) -> str:
    return "file://" + tempfile.mkdtemp(prefix="tastemill-")


def new_path(spark: SparkSession, name: str) -> str:
    return f"{shared_dir(spark)}/{name}-{uuid.uuid4().hex}"


def remove(spark: SparkSession, path: str) -> None:
    found = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    found.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(found, True)
