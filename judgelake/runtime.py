"""Session-level helpers: reading tables and cutting lineage in storage that all executors share."""

from __future__ import annotations

import shutil
import tempfile
import uuid
from pathlib import Path

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import types as T


def ship(spark: SparkSession) -> SparkSession:
    """Give the executors' Python workers this package, once a session."""
    sc = spark.sparkContext
    if not getattr(sc, "_judgelake_shipped", False):
        package = Path(__file__).parent
        made = tempfile.mkdtemp(prefix="judgelake-package-")
        tree = shutil.copytree(package, f"{made}/tree/{package.name}", ignore=shutil.ignore_patterns("__pycache__"))
        sc.addPyFile(shutil.make_archive(f"{made}/{package.name}", "zip", tree.rsplit("/", 1)[0]))
        sc._judgelake_shipped = True
    return spark


def read_table(spark: SparkSession, sf_dir: str, name: str, schema: T.StructType | str | None = None) -> DataFrame:
    """One of the project's tables. A narrower schema, nested fields included, prunes the scan."""
    reader = spark.read if schema is None else spark.read.schema(schema)
    return reader.parquet(f"{sf_dir}/{name}.parquet")


def shared_dir(spark: SparkSession) -> str:
    """The folder of spark.checkpoint.dir. Where that is unset a temporary one is made, but only in a local session: on a
    cluster the executors don't share this machine's folders, so that is an error."""
    configured = spark.conf.get("spark.checkpoint.dir", None)
    if configured:
        return configured
    sc = spark.sparkContext
    current = sc._jsc.sc().getCheckpointDir()
    if not current.isDefined():
        if not (sc.master == "local" or sc.master.startswith("local[")):
            raise ValueError("spark.checkpoint.dir must name a folder that all executors share")
        sc.setCheckpointDir(tempfile.mkdtemp(prefix="judgelake-"))
        current = sc._jsc.sc().getCheckpointDir()
    return current.get()


class Stage:
    """Tables written to the shared folder, so that a lost executor costs no recomputation of the lineage above."""

    def __init__(self, spark: SparkSession) -> None:
        self.spark = spark
        self.root = f"{shared_dir(spark).rstrip('/')}/{spark.sparkContext.applicationId}/{uuid.uuid4().hex}"
        self.made = 0
        path = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(self.root)
        path.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).deleteOnExit(path)  # goes with the application

    def keep(self, df: DataFrame) -> DataFrame:
        """Write df once and return it as a scan of what was written."""
        self.made += 1
        path = f"{self.root}/{self.made}"
        df.write.mode("overwrite").parquet(path)
        return self.spark.read.schema(df.schema).parquet(path)

    def drop(self, df: DataFrame) -> None:
        """Delete the files of a table kept before that no later step reads."""
        for name in df.inputFiles()[:1]:
            self._delete(name.rsplit("/", 1)[0])

    def _delete(self, path: str) -> None:
        jvm = self.spark.sparkContext._jvm
        target = jvm.org.apache.hadoop.fs.Path(path)
        target.getFileSystem(self.spark.sparkContext._jsc.hadoopConfiguration()).delete(target, True)
