"""Tables in the shared checkpoint folder: they cut lineage and outlive lost executors."""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession

from graphloom.session import remove_folder, shared_folder


class Scratch:
    """Writes tables below one folder of its own, so that one call removes what is no longer needed.

    A table that the returned result still reads must be kept: call `keep` on it.
    """

    def __init__(self, spark: SparkSession, name: str):
        self.spark = spark
        self.folder = f"{shared_folder(spark)}/{name}-{uuid.uuid4().hex}"
        self.tables: dict[int, str] = {}
        self.made = 0

    def path(self) -> str:
        self.made += 1
        return f"{self.folder}/{self.made}"

    def table(self, frame: DataFrame) -> DataFrame:
        """The frame, written once as Parquet and read again."""
        path = self.path()
        frame.write.parquet(path)
        out = self.spark.read.schema(frame.schema).parquet(path)
        self.tables[id(out)] = path
        out._graphloom_scratch = self  # the frame keeps its own bookkeeping alive
        return out

    def drop(self, *frames: DataFrame) -> None:
        for frame in frames:
            if path := self.tables.pop(id(frame), None):
                remove_folder(self.spark, path)

    def keep(self, frame: DataFrame) -> None:
        self.tables.pop(id(frame), None)

    def close(self) -> None:
        for path in self.tables.values():
            remove_folder(self.spark, path)
        self.tables.clear()
