"""Files in whatever store a path names, and the folder that driver and executors share."""

from __future__ import annotations

import re
import uuid

from pyarrow import fs
from pyspark.sql import SparkSession

LOCAL_SCRATCH = "/tmp/checkpoints"


def store_of(path: str) -> tuple[fs.FileSystem, str]:
    """The store and the path in it, for local paths and for URIs that Arrow knows (file, hdfs, s3, gs, ...)."""
    local = re.sub("^file:/+", "/", path)
    if re.match(r"[A-Za-z][A-Za-z0-9+.-]+://", local):
        store, place = fs.FileSystem.from_uri(path)
        return store, place.rstrip("/")
    return fs.LocalFileSystem(), local.rstrip("/") or "/"


def scratch(spark: SparkSession, what: str) -> str:
    """A new path in the folder that the session names in spark.checkpoint.dir; in local mode it may name none."""
    folder = spark.sparkContext.getConf().get("spark.checkpoint.dir") or spark.sparkContext.getCheckpointDir()
    if not folder:
        if not re.match(r"local(\[|$)", spark.sparkContext.master):
            raise ValueError("spark.checkpoint.dir must name a folder that the driver and all executors share")
        folder = LOCAL_SCRATCH
    return f"{folder.rstrip('/')}/{what}-{uuid.uuid4().hex}"
