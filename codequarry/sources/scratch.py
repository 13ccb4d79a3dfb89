"""A folder that all executors share, for tables written on the way."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import SparkSession

FOLDER = "spark.checkpoint.dir"


def shared_folder(spark: SparkSession, name: str) -> str:
    """A new folder below the session's `spark.checkpoint.dir`.

    Only a local session without that setting gets a temporary one.
    """
    conf = spark.sparkContext.getConf()
    folder = conf.get(FOLDER) or spark.conf.get(FOLDER, None)
    if not folder:
        if not spark.sparkContext.master.startswith("local["):
            raise ValueError(f"set {FOLDER} to a folder that all executors share")
        folder = tempfile.mkdtemp(prefix="codequarry-")
        spark.conf.set(FOLDER, folder)
    return f"{folder.rstrip('/')}/codequarry-{name}-{uuid.uuid4().hex}"
