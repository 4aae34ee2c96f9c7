"""Where intermediate tables live, and how they are written and read again."""

from __future__ import annotations

import tempfile
import uuid
from collections.abc import Iterator
from contextlib import contextmanager

from pyspark.sql import DataFrame, SparkSession


def shared_dir(spark: SparkSession) -> str:
    """The folder that the driver and all executors share.

    It is the session's ``spark.checkpoint.dir``; only where that is unset and the session runs in one
    process (tests) a temporary folder of this machine is set as the checkpoint folder.
    """
    sc = spark.sparkContext
    root = sc.getConf().get("spark.checkpoint.dir") or spark.conf.get("spark.checkpoint.dir", None) or sc.getCheckpointDir()
    if not root:
        if not sc.master.startswith("local"):
            raise ValueError("spark.checkpoint.dir is not set: executors and driver need a folder that they share")
        root = "file://" + tempfile.mkdtemp(prefix="parcelyard-")
        sc.setCheckpointDir(root)
    return root.rstrip("/")


def new_path(spark: SparkSession, name: str) -> str:
    """A path in the shared folder that no other call gets."""
    return f"{shared_dir(spark)}/parcelyard/{name}-{uuid.uuid4().hex}"


class Stored:
    """A DataFrame written as Parquet to the shared folder, so that its lineage is cut. With ``keep``, it outlives :func:`scratch`."""

    def __init__(self, df: DataFrame, name: str, keep: bool = False):
        self.spark = df.sparkSession
        self.path = new_path(self.spark, name)
        if not keep:
            for made in _open:
                made.append(self)
        df.write.parquet(self.path)
        self.df = self.spark.read.schema(df.schema).parquet(self.path)

    def drop(self) -> None:
        """Delete the files; the DataFrame can't be read any more."""
        jvm = self.spark._jvm
        path = jvm.org.apache.hadoop.fs.Path(self.path)
        path.getFileSystem(self.spark._jsc.hadoopConfiguration()).delete(path, True)


#: tables made so far in each open :func:`scratch`
_open: list[list[Stored]] = []


@contextmanager
def scratch() -> Iterator[None]:
    """Deletes the tables that are written within, when it ends: what is lazily read from them must be written before.

    Files of other kinds (archives, token shards) are results and stay.
    """
    made: list[Stored] = []
    _open.append(made)
    try:
        yield
    finally:
        _open[:] = [x for x in _open if x is not made]
        for table in made:
            table.drop()


def stored(df: DataFrame, name: str) -> DataFrame:
    """``df`` read again from a table written in the shared folder."""
    return Stored(df, name).df


def open_shared(uri: str):
    """The pyarrow file system and the path in it for a URI of the shared folder."""
    from pyarrow import fs

    return fs.FileSystem.from_uri(uri)
