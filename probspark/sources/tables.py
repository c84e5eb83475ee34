"""Tables kept between the steps of a job."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession


def shared_folder(spark: SparkSession) -> str | None:
    """spark.checkpoint.dir; None in local mode without it, an error on a cluster, whose machines don't see each other's
    folders."""
    found = spark.conf.get("spark.checkpoint.dir", None)
    if not found and not spark.sparkContext.master.startswith("local"):
        raise RuntimeError("spark.checkpoint.dir is unset: name a folder that the driver and all executors share")
    return found


def stored(df: DataFrame, name: str = "steps") -> DataFrame:
    """df written to the shared folder and read again: what follows does not recompute it, and a lost executor loses nothing of
    it. In local mode without such a folder it is cached."""
    folder = shared_folder(df.sparkSession)
    if folder is None:
        return df.cache()
    path = f"{folder}/{name}/{uuid.uuid4().hex}"
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def stream_folder(spark: SparkSession, name: str) -> str:
    """Where a stream keeps its progress."""
    return f"{shared_folder(spark) or tempfile.mkdtemp(prefix='probspark-')}/streams/{name}"
