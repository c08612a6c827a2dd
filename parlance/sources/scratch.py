"""Where jobs put files that they read again: the session's shared folder."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import SparkSession


def scratch(spark: SparkSession, what: str) -> str:
    """A new path in the folder that driver and executors share: spark.checkpoint.dir, else the context's checkpoint folder; a temporary one only on a local master."""
    named = spark.conf.get("spark.checkpoint.dir", None)
    if not named:
        own = spark.sparkContext._jsc.sc().getCheckpointDir()
        if own.isDefined():
            named = own.get()
        elif spark.sparkContext.master.startswith("local"):
            named = f"file://{tempfile.mkdtemp(prefix='spark-')}"
        else:
            raise ValueError("set spark.checkpoint.dir to a folder that driver and executors share")
    return f"{named}/{what}-{uuid.uuid4().hex}"
