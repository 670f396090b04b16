"""Where intermediate tables go: the folder that the cluster shares under `spark.checkpoint.dir`."""

from __future__ import annotations

import tempfile
import uuid
from collections.abc import Iterator
from contextlib import contextmanager
from contextvars import ContextVar

from pyspark.sql import DataFrame, SparkSession

#: Paths of the tables written in the innermost `cleared` block; None outside of one.
_WRITTEN: ContextVar[list[str] | None] = ContextVar("written", default=None)


def shared_dir(spark: SparkSession) -> str:
    """The session's `spark.checkpoint.dir`; only where it names none, a temporary folder (local mode) or the warehouse."""
    named = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getCheckpointDir()
    if not named:
        local = spark.sparkContext.master.startswith("local")
        named = "file://" + tempfile.mkdtemp(prefix="tesserae-") if local else spark.conf.get("spark.sql.warehouse.dir")
        spark.sparkContext.setCheckpointDir(named)
    return named.rstrip("/")


def written(df: DataFrame, label: str) -> tuple[DataFrame, str]:
    """`df` written once as Parquet in the shared folder and read back, and its path."""
    spark = df.sparkSession
    path = f"{shared_dir(spark)}/tesserae/{label}-{uuid.uuid4().hex}"
    df.write.parquet(path)
    inside = _WRITTEN.get()
    if inside is not None:
        inside.append(path)
    return spark.read.schema(df.schema).parquet(path), path


def stored(df: DataFrame, label: str) -> DataFrame:
    """`df` written once as Parquet in the shared folder and read back: cuts lineage, survives lost executors."""
    return written(df, label)[0]


def remove(spark: SparkSession, path: str) -> None:
    """Deletes a table that nothing reads any more."""
    place = spark._jvm.org.apache.hadoop.fs.Path(path)
    place.getFileSystem(spark._jsc.hadoopConfiguration()).delete(place, True)


@contextmanager
def cleared(spark: SparkSession) -> Iterator[set[str]]:
    """Deletes the tables written inside when the block ends without an error, but for the paths put into the set."""
    kept: set[str] = set()
    paths: list[str] = []
    outer = _WRITTEN.set(paths)
    try:
        yield kept
    finally:
        _WRITTEN.reset(outer)
    for path in paths:
        if path not in kept:
            remove(spark, path)
