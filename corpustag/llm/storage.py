"""Scratch tables in the folder that driver and executors share.

Long jobs cut their lineage by writing a table and reading it again; an executor lost later costs a
reread, not a recomputation. ``spark.checkpoint.dir`` names the folder.
"""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession


def shared_folder(spark: SparkSession) -> str:
    """The session's ``spark.checkpoint.dir``. In local mode an unset one becomes a temporary folder."""
    folder = spark.conf.get("spark.checkpoint.dir", None)
    if folder:
        return folder.rstrip("/")
    master = spark.sparkContext.master
    if not (master == "local" or master.startswith("local[")):
        raise ValueError("set spark.checkpoint.dir to a folder that driver and executors share")
    return tempfile.mkdtemp(prefix="corpustag-")


class Scratch:
    """Named tables of one job, under one new subfolder of the shared folder."""

    def __init__(self, spark: SparkSession, job: str, compression: str = "snappy"):
        self.spark = spark
        self.compression = compression
        self.folder = f"{shared_folder(spark)}/{job}-{uuid.uuid4().hex}"
        self.used: set[str] = set()

    def keep(self, df: DataFrame, name: str) -> DataFrame:
        """``df`` written and read again.

        Executors hold the shuffle files of a finished write until the driver collects the garbage of its plan. A driver with
        room may not do so for long; it is asked to after each table, so that disks hold one step's shuffles and not all.
        """
        while name in self.used:
            name += "_"
        self.used.add(name)
        path = f"{self.folder}/{name}"
        df.write.option("compression", self.compression).parquet(path)
        self.spark._jvm.System.gc()
        return self.spark.read.schema(df.schema).parquet(path)

    def drop(self, name: str) -> None:
        """Delete a table of this job that nothing reads any more."""
        jvm, hadoop = self.spark._jvm, self.spark._jsc.hadoopConfiguration()
        path = jvm.org.apache.hadoop.fs.Path(f"{self.folder}/{name}")
        path.getFileSystem(hadoop).delete(path, True)


def partitions(spark: SparkSession) -> int:
    """Partitions of a shuffle in this session."""
    return int(spark.conf.get("spark.sql.shuffle.partitions"))
