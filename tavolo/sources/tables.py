"""Driver tables: one parquet file (or folder) per table.

Reads are lazy; Catalyst prunes columns and pushes filters into the
parquet scan for whatever the operators select.
"""

from __future__ import annotations

from functools import cached_property

from pyspark.sql import DataFrame, SparkSession

TABLES = ("region", "nation", "customer", "supplier", "part", "orders",
          "lineitem", "events", "documents", "embeddings", "pages",
          "benchmark", "labels", "conversations")


class Tables:
    """Lazy accessor: ``Tables(spark, dir).orders`` -> DataFrame."""

    def __init__(self, spark: SparkSession, root: str):
        self.spark = spark
        self.root = root.rstrip("/")

    def read(self, name: str) -> DataFrame:
        return self.spark.read.parquet(f"{self.root}/{name}.parquet")

    def __getattr__(self, name: str) -> DataFrame:
        if name in TABLES:
            return self.read(name)
        raise AttributeError(name)

    @cached_property
    def shop(self):
        from tavolo.sources.fixtures import Shop
        return Shop(self)
