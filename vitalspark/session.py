"""Session settings and tables."""

from __future__ import annotations

import atexit
import re
import shutil
import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession


def session(name: str = "vitalspark", **conf: str) -> SparkSession:
    """A session in UTC with adaptive execution; other settings are the cluster's or the caller's."""
    builder = SparkSession.builder.appName(name).config("spark.sql.session.timeZone", "UTC").config("spark.sql.adaptive.enabled", "true")
    for key, value in conf.items():
        builder = builder.config(key, value)
    return builder.getOrCreate()


def table(spark: SparkSession, folder: str, name: str) -> DataFrame:
    """One Parquet table of a folder."""
    return spark.read.parquet(f"{folder}/{name}.parquet")


def exists(spark: SparkSession, path: str) -> bool:
    """Whether a path is there, on any file system that Spark reads."""
    target = spark._jvm.org.apache.hadoop.fs.Path(path)
    return target.getFileSystem(spark._jsc.hadoopConfiguration()).exists(target)


def scratch_folder(spark: SparkSession) -> str:
    """A fresh path in the folder that driver and executors share, spark.checkpoint.dir.  Where that is unset and Spark runs in this process alone, it is a folder of our own; on a cluster it must be set."""
    shared = spark.conf.get("spark.checkpoint.dir", None)
    if not shared:
        if not re.match(r"local($|\[)", spark.sparkContext.master):
            raise ValueError("set spark.checkpoint.dir to a folder that the driver and all executors share")
        own = tempfile.mkdtemp(prefix="vitalspark-")
        atexit.register(shutil.rmtree, own, True)
        shared = f"file://{own}"
    return f"{shared.rstrip('/')}/vitalspark-{uuid.uuid4().hex}"
