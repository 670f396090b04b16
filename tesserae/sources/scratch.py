"""A folder for tables that a query builds on the way, shared by the driver and all executors."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import SparkSession


def scratch(spark: SparkSession, label: str) -> str:
    """A new path under `spark.checkpoint.dir`; only where the session names none, under a temporary folder (local mode) or the warehouse."""
    local = spark.sparkContext.master.startswith("local")
    unnamed = "file://" + tempfile.gettempdir() if local else spark.conf.get("spark.sql.warehouse.dir")
    root = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getCheckpointDir() or unnamed
    return f"{root.rstrip('/')}/tesserae-{label}-{uuid.uuid4().hex}"
