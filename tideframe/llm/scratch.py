"""Tables that cut a lineage, written to the folder every executor shares."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession


def shared_folder(spark: SparkSession) -> str:
    """The cluster's spark.checkpoint.dir. Only a session on this one machine may go without: it takes a temporary folder."""
    folder = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getConf().get("spark.checkpoint.dir")
    if not folder:
        if not spark.sparkContext.master.startswith("local"):
            raise RuntimeError("set spark.checkpoint.dir to a folder that all executors share")
        folder = f"file://{tempfile.mkdtemp(prefix='tideframe-')}"
        spark.conf.set("spark.checkpoint.dir", folder)
    return folder.rstrip("/")


class Scratch:
    """Parquet tables of one query run. They outlive the call, as its lazy result reads them, and go when the driver ends;
    drop() frees one early."""

    def __init__(self, spark: SparkSession):
        self.spark = spark
        self.root = f"{shared_folder(spark)}/tideframe-{uuid.uuid4().hex}"
        self.count = 0

    def _file_system(self, path: str):
        """The Hadoop path and its file system."""
        found = self.spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
        return found, found.getFileSystem(self.spark.sparkContext._jsc.hadoopConfiguration())

    def cut(self, df: DataFrame) -> DataFrame:
        """Write df as a table and return a scan of it, so that a lost executor costs no more than one stage."""
        self.count += 1
        path = f"{self.root}/t{self.count}"
        df.write.mode("overwrite").parquet(path)
        if self.count == 1:
            root, files = self._file_system(self.root)
            files.deleteOnExit(root)
        out = self.spark.read.schema(df.schema).parquet(path)
        out._scratch_path = path
        return out

    def drop(self, *tables: DataFrame) -> None:
        """Delete tables no later step reads."""
        for table in tables:
            path, files = self._file_system(table._scratch_path)
            files.delete(path, True)
