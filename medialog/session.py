"""Session settings and the shared working folder."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import SparkSession


def configure(spark: SparkSession) -> SparkSession:
    """Pin the session zone: every stored instant is UTC."""
    spark.conf.set("spark.sql.session.timeZone", "UTC")
    return spark


def workspace(spark: SparkSession, purpose: str) -> str:
    """A fresh folder, reachable from every executor, for checkpoints and written tables.

    The cluster names the parent in ``spark.checkpoint.dir``. Only a local session, as in
    tests, may go without.
    """
    root = spark.conf.get("spark.checkpoint.dir", None)
    if not root:
        if not spark.sparkContext.master.startswith("local"):
            raise ValueError("set spark.checkpoint.dir to a folder shared by all executors")
        root = tempfile.mkdtemp(prefix="medialog-")
    return f"{root.rstrip('/')}/medialog/{purpose}-{uuid.uuid4().hex}"
