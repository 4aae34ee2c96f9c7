"""Archives that arrive in a folder, as a stream of their entries. An extension: stock Structured Streaming does the work."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators.archive import DIRECTORY, _list


def arriving_entries(spark: SparkSession, folder: str, *, max_files: int = 1000) -> DataFrame:
    """Directory rows of each new archive in ``folder``, with its time of change; only ends and directories of files are read."""
    files = spark.readStream.format("binaryFile").schema("path string, modificationTime timestamp, length long, content binary").option("pathGlobFilter", "*.zip").option("maxFilesPerTrigger", max_files).load(folder)
    return files.select(F.col("path").alias("archive"), F.regexp_replace("path", "^file:/+", "/").alias("path")).mapInArrow(_list, DIRECTORY)
