"""The folder that the driver and all executors share."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import SparkSession

_OWN_KEY = "tidewell.own.shared.dir"


def shared_dir(spark: SparkSession) -> str:
    """spark.checkpoint.dir of the session.

    Only a session on one machine (master local) that names none gets a temporary folder of its own.
    """
    named = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getConf().get("spark.checkpoint.dir")
    if named:
        return named.rstrip("/")
    own = spark.conf.get(_OWN_KEY, None)
    if own is None:
        if not spark.sparkContext.master.startswith("local"):
            raise ValueError("spark.checkpoint.dir must name a folder that all executors share")
        already = spark.sparkContext.getCheckpointDir()
        own = already if already else "file://" + tempfile.mkdtemp(prefix="tidewell-")
        if not already:
            spark.sparkContext.setCheckpointDir(own)
        spark.conf.set(_OWN_KEY, own)
    return own.rstrip("/")


def work_dir(spark: SparkSession, name: str) -> str:
    """A new folder name for one run of an operator, in the shared folder."""
    return f"{shared_dir(spark)}/{name}-{uuid.uuid4().hex}"
