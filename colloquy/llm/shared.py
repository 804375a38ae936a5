"""Tables in the cluster's shared folder, which cut lineage and outlive a lost executor."""

from __future__ import annotations

import atexit
import os
import shutil
import tempfile
import uuid

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F


def ship(spark: SparkSession) -> None:
    """Gives the executors' Python this package, once for each session's context."""
    context = spark.sparkContext
    if not getattr(context, "_colloquy_shipped", False):
        package = os.path.dirname(os.path.dirname(os.path.abspath(__file__)))
        context.addPyFile(shutil.make_archive(os.path.join(tempfile.mkdtemp(), "colloquy_package"), "zip", os.path.dirname(package), os.path.basename(package)))
        context._colloquy_shipped = True


def shared_root(spark: SparkSession) -> str:
    """The folder named by ``spark.checkpoint.dir``.

    Where the setting is absent and Spark runs on one machine (as in tests) a temporary folder is made and put in the
    session; on a cluster that would be a folder of the driver's alone, so there it raises RuntimeError.
    """
    root = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getConf().get("spark.checkpoint.dir")
    if not root:
        if not spark.sparkContext.master.startswith("local") or spark.sparkContext.master.startswith("local-cluster"):
            raise RuntimeError("spark.checkpoint.dir isn't set")
        folder = tempfile.mkdtemp(prefix="colloquy-")
        atexit.register(shutil.rmtree, folder, ignore_errors=True)
        root = "file://" + folder
        spark.conf.set("spark.checkpoint.dir", root)
    return root.rstrip("/")


def shared_path(spark: SparkSession, name: str) -> str:
    """A fresh path below the shared folder; no two calls give the same."""
    return f"{shared_root(spark)}/colloquy-{name}-{uuid.uuid4().hex}"


class Scratch:
    """Intermediate tables of one job.

    ``write`` materialises a frame as Parquet and returns a frame that reads it, so that a later stage neither
    repeats the work nor depends on shuffle files of an executor that may be lost.  ``drop`` removes a table that no
    later stage reads and lets Spark's cleaner give back the shuffle files of the stages that made it.
    """

    def __init__(self, spark: SparkSession, name: str):
        ship(spark)
        self.spark, self.name, self.paths = spark, name, {}

    def write(self, df: DataFrame, step: str, *by: str) -> DataFrame:
        path = shared_path(self.spark, f"{self.name}-{step}")
        df.write.option("compression", "zstd").partitionBy(*by).parquet(path)
        out = self.spark.read.schema(df.schema).parquet(path)
        self.paths[id(out)] = (out, path)
        return out

    def drop(self, *tables: DataFrame) -> None:
        jvm = self.spark.sparkContext._jvm
        for table in tables:
            _, path = self.paths.pop(id(table))
            target = jvm.org.apache.hadoop.fs.Path(path)
            target.getFileSystem(self.spark.sparkContext._jsc.hadoopConfiguration()).delete(target, True)
        self.free()

    def free(self) -> None:
        """Shuffle files go once the JVM has collected the plans that wrote them.

        Spark holds on to the last plan that was run, so one without a job is run first.
        """
        import gc

        self.spark.sql("SELECT 1").collect()
        gc.collect()
        self.spark.sparkContext._jvm.System.gc()


def has(df: DataFrame, *columns: str) -> None:
    """Raises ValueError where an input lacks a column that the operator reads."""
    if missing := [c for c in columns if c not in df.columns]:
        raise ValueError(f"missing columns {missing}; there are {df.columns}")


def text_digest() -> Column:
    """16 bytes that tell rows of one doc_id (or of none) apart by their text; a null text is an empty one."""
    return F.unhex(F.md5(F.coalesce(F.col("text"), F.lit("")).cast("binary")))
