"""Makes the package importable on executors, whatever their working folder."""

from __future__ import annotations

import os
import tempfile
import zipfile
from pathlib import Path

from pyspark.sql import SparkSession

_shipped: set[str] = set()


def ship(spark: SparkSession) -> SparkSession:
    """Sends the package's source to the executors of this application, once."""
    sc = spark.sparkContext
    if sc.applicationId not in _shipped:
        top = Path(__file__).parent
        path = os.path.join(tempfile.mkdtemp(), "tidewheel_src.zip")
        with zipfile.ZipFile(path, "w") as z:
            for p in sorted(top.rglob("*.py")):
                z.write(p, f"{top.name}/{p.relative_to(top)}")
        sc.addPyFile(path)
        # Texts are long: small Arrow batches keep a worker's memory low.
        spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", "2000")
        _shipped.add(sc.applicationId)
    return spark
