"""Intermediate tables in the shared folder: written once, read back, removed when no longer needed."""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession

from riskgraph.runtime import shared_dir


class Scratch:
    """Tables written to ``spark.checkpoint.dir``; they survive lost executors and cut the lineage.

    ``keep`` writes a table, ``drop`` removes one. What isn't dropped is what a returned DataFrame still reads.
    """

    def __init__(self, spark: SparkSession):
        self.spark, self._paths = spark, {}

    def keep(self, df: DataFrame, label: str) -> DataFrame:
        path = f"{shared_dir(self.spark)}/{label}-{uuid.uuid4().hex}"
        df.write.parquet(path)
        back = self.spark.read.schema(df.schema).parquet(path)
        self._paths[id(back)] = (back, path)
        return back

    def drop(self, *tables: DataFrame) -> None:
        for table in tables:
            _, path = self._paths.pop(id(table), (None, None))
            if path:
                where = self.spark._jvm.org.apache.hadoop.fs.Path(path)
                where.getFileSystem(self.spark._jsc.hadoopConfiguration()).delete(where, True)
