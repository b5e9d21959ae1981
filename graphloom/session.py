"""What the engine asks of a Spark session."""

from __future__ import annotations

import atexit
import contextlib
import tempfile
import uuid
from pathlib import Path

from pyspark.sql import DataFrame, SparkSession


def workers_find_package(spark: SparkSession) -> None:
    """Python workers import this package from the same place as the driver, whatever the working folder is."""
    root, env = str(Path(__file__).resolve().parent.parent), spark.sparkContext.environment
    if root not in env.get("PYTHONPATH", "").split(":"):
        env["PYTHONPATH"] = ":".join(x for x in (root, env.get("PYTHONPATH", "")) if x)


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def shared_folder(spark: SparkSession) -> str:
    """This application's folder below the one that spark.checkpoint.dir names, which all executors share. It goes when the application ends.

    Where the setting is missing a temporary folder stands in, on a local master only; a cluster without it is an error.
    """
    name = spark.conf.get("graphloom.folder", None)
    if not name:
        above = spark.sparkContext.getConf().get("spark.checkpoint.dir")
        if not above and not spark.sparkContext.master.startswith("local"):
            raise ValueError("spark.checkpoint.dir must name a folder that all executors share")
        name = f"{(above or tempfile.gettempdir()).rstrip('/')}/graphloom-{spark.sparkContext.applicationId}"
        spark.conf.set("graphloom.folder", name)
        atexit.register(_forget, spark, name)
    return name


def remove_folder(spark: SparkSession, path: str) -> None:
    where = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    where.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(where, True)


def _forget(spark: SparkSession, path: str) -> None:
    with contextlib.suppress(Exception):  # the session may be gone already; the folder's name says whose it was
        remove_folder(spark, path)


def held(frame: DataFrame) -> DataFrame:
    """The frame, written to the shared folder and read again: its plan is cut there, and a lost executor loses nothing."""
    path = f"{shared_folder(frame.sparkSession)}/held-{uuid.uuid4().hex}"
    frame.write.parquet(path)
    return frame.sparkSession.read.schema(frame.schema).parquet(path)
