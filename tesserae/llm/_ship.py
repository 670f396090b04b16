"""Sends this package to the executors' Python workers, which need not have it installed."""

from __future__ import annotations

import tempfile
import zipfile
from pathlib import Path

from pyspark.sql import SparkSession

_sent: set[str] = set()


#: Rows of a batch that goes to a Python worker: texts of some KB each, held on both sides of the pipe.
BATCH_ROWS = 2500


def ship(spark: SparkSession) -> None:
    """Adds the package's sources to the application once; Spark's own file server carries them.

    Also bounds the batches that go to Python workers, unless the session says less itself.
    """
    setting = "spark.sql.execution.arrow.maxRecordsPerBatch"
    if not 0 < int(spark.conf.get(setting)) <= BATCH_ROWS:
        spark.conf.set(setting, BATCH_ROWS)
    context = spark.sparkContext
    if context.applicationId in _sent:
        return
    package = Path(__file__).resolve().parent.parent
    archive = Path(tempfile.mkdtemp(prefix="tesserae-")) / "tesserae.zip"
    with zipfile.ZipFile(archive, "w") as out:
        for source in sorted(package.rglob("*.py")):
            out.write(source, str(source.relative_to(package.parent)))
    context.addPyFile(str(archive))
    _sent.add(context.applicationId)
