"""Make this package importable in the Python workers of a session."""

from __future__ import annotations

import os
import tempfile
import zipfile
from pathlib import Path

from pyspark.sql import SparkSession

_shipped: set[str] = set()
#: Arrow batches to Python: rows hold whole texts or files, so a batch of Spark's usual 10,000 rows would be large
BATCH = {"spark.sql.execution.arrow.maxRecordsPerBatch": "1000", "spark.sql.execution.arrow.maxBytesPerBatch": str(4 << 20)}


def ship(spark: SparkSession) -> SparkSession:
    """Send the package's source to the executors, once a context, unless PYTHONPATH has it already.

    Also makes the session's Arrow batches small, where its builder or context did not set their size.
    """
    given = dict(spark.sparkContext.getConf().getAll())
    for key, value in BATCH.items():
        if key not in given:
            spark.conf.set(key, value)
    root = Path(__file__).resolve().parent
    app = spark.sparkContext.applicationId
    on_path = str(root.parent) in os.environ.get("PYTHONPATH", "").split(os.pathsep)
    if app not in _shipped and not on_path:
        path = Path(tempfile.mkdtemp(prefix="parcelyard-")) / f"{root.name}.zip"
        with zipfile.ZipFile(path, "w") as out:
            for file in sorted(root.rglob("*.py")):
                out.write(file, file.relative_to(root.parent))
        spark.sparkContext.addPyFile(str(path))
    _shipped.add(app)
    return spark
