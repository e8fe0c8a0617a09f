"""Session settings and shared storage for intermediate tables."""

from __future__ import annotations

import uuid
from collections.abc import Callable
from concurrent.futures import ThreadPoolExecutor

from pyspark import inheritable_thread_target
from pyspark.sql import DataFrame, SparkSession

SETTINGS = {
    "spark.sql.session.timeZone": "UTC",
    "spark.sql.adaptive.enabled": "true",
    "spark.sql.adaptive.coalescePartitions.enabled": "true",
    "spark.sql.adaptive.skewJoin.enabled": "true",
    # split a hot key's partitions even when that costs one more exchange
    "spark.sql.adaptive.forceOptimizeSkewedJoin": "true",
    "spark.sql.sources.partitionOverwriteMode": "dynamic",
    # the place in the Python code of every column operation costs more than building the plan
    "spark.python.sql.dataFrameDebugging.enabled": "false",
}


def build_session(name: str = "contagrid", master: str | None = None, **settings: str) -> SparkSession:
    builder = SparkSession.builder.appName(name)
    if master:
        builder = builder.master(master)
    for key, value in {**SETTINGS, **settings}.items():
        builder = builder.config(key, value)
    return builder.getOrCreate()


def shared_folder(spark: SparkSession) -> str:
    """The cluster's checkpoint folder; where it names none, one in the warehouse.

    A warehouse on a local disk is not shared, so on any master but a local one that is an error.
    """
    folder = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getCheckpointDir()
    if folder:
        return folder
    warehouse = spark.conf.get("spark.sql.warehouse.dir").rstrip("/")
    if not is_shared(spark.sparkContext.master, warehouse, spark.conf.get("spark.hadoop.fs.defaultFS", "file:///")):
        raise ValueError(f"set spark.checkpoint.dir to a folder that all executors share; the warehouse {warehouse} is on a local disk")
    return f"{warehouse}/_work"


def is_shared(master: str, folder: str, default_files: str) -> bool:
    """Whether the driver and all executors on ``master`` see one ``folder``; a path without a scheme is in the default file system."""
    if master == "local" or master.startswith("local["):
        return True
    return not (folder if ":/" in folder else default_files).startswith("file:")


def temporary_folder(spark: SparkSession, name: str) -> str:
    """A new place in the shared folder; what is written there goes when the driver's JVM ends."""
    path = f"{shared_folder(spark).rstrip('/')}/{name}-{uuid.uuid4().hex}"
    place = spark._jvm.org.apache.hadoop.fs.Path(path)
    files = place.getFileSystem(spark._jsc.hadoopConfiguration())
    files.mkdirs(place)
    files.deleteOnExit(place)
    return path


class Stage:
    """Writes intermediate tables once, so several results share one scan.

    A written table survives lost executors and keeps column pruning and filter
    pushdown for its readers. ``remove`` deletes them all; what is left when the
    driver ends goes then.
    """

    def __init__(self, spark: SparkSession):
        self.spark = spark
        self.folder = f"{shared_folder(spark).rstrip('/')}/contagrid-{uuid.uuid4().hex}"

    def __call__(self, df: DataFrame, name: str) -> DataFrame:
        path = f"{self.folder}/{name}"
        df.write.mode("overwrite").parquet(path)
        place, files = self._place()
        files.deleteOnExit(place)
        return self.spark.read.schema(df.schema).parquet(path)

    def _place(self):
        place = self.spark._jvm.org.apache.hadoop.fs.Path(self.folder)
        return place, place.getFileSystem(self.spark._jsc.hadoopConfiguration())

    def remove(self) -> None:
        place, files = self._place()
        files.delete(place, True)

    def together(self, **tables: DataFrame) -> list[DataFrame]:
        """Write independent tables at the same time."""
        jobs = {name: lambda df=df, name=name: self(df, name) for name, df in tables.items()}
        return list(run_together(self.spark, jobs).values())


def run_together(spark: SparkSession, jobs: dict[str, Callable], at_once: int = 8) -> dict:
    """Run small independent Spark jobs side by side; the first failure is raised."""
    with ThreadPoolExecutor(at_once) as pool:
        running = {name: pool.submit(inheritable_thread_target(spark)(job)) for name, job in jobs.items()}
        return {name: future.result() for name, future in running.items()}
