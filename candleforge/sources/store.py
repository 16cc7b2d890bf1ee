"""A store of strategies and collections of them, as Parquet tables of one row each."""

from __future__ import annotations

import json
from typing import Any

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

STRATEGIES = "id string, name string, tags array<string>, memo string, favorite boolean, params string, metrics string, saved_at timestamp"
COLLECTIONS = "name string, strategy_id string"


class Store:
    """Every change is a new version of the whole (small) table, so that readers never see half of one."""

    def __init__(self, spark: SparkSession, path: str):
        self.spark, self.path = spark, path.rstrip("/")

    def _versions(self, kind: str) -> list[int]:
        jvm = self.spark.sparkContext._jvm
        root = jvm.org.apache.hadoop.fs.Path(f"{self.path}/{kind}")
        fs = root.getFileSystem(self.spark.sparkContext._jsc.hadoopConfiguration())
        names = [s.getPath() for s in fs.listStatus(root)] if fs.exists(root) else []
        return sorted(int(p.getName()) for p in names if fs.exists(jvm.org.apache.hadoop.fs.Path(p, "_SUCCESS")))

    def _read(self, kind: str, schema: str) -> DataFrame:
        have = self._versions(kind)
        return self.spark.read.schema(schema).parquet(f"{self.path}/{kind}/{have[-1]}") if have else self.spark.createDataFrame([], schema)

    def _write(self, kind: str, df: DataFrame) -> None:
        df.coalesce(1).write.parquet(f"{self.path}/{kind}/{(self._versions(kind) or [0])[-1] + 1}")

    def strategies(self, tag: str | None = None, favorite: bool | None = None) -> DataFrame:
        out = self._read("strategies", STRATEGIES)
        if tag is not None:
            out = out.where(F.array_contains("tags", tag))
        return out if favorite is None else out.where(F.col("favorite") == favorite)

    def save(self, id: str, name: str, params: dict[str, Any], metrics: dict[str, Any] | None = None, tags: tuple[str, ...] = (), memo: str = "", favorite: bool = False) -> None:
        """Add a strategy, or replace the one with its id."""
        row = self.spark.createDataFrame([(id, name, list(tags), memo, favorite, json.dumps(params), json.dumps(metrics or {}))], STRATEGIES.rsplit(", ", 1)[0]).withColumn("saved_at", F.current_timestamp())
        self._write("strategies", self.strategies().where(F.col("id") != id).unionByName(row))

    def delete(self, id: str) -> None:
        self._write("strategies", self.strategies().where(F.col("id") != id))
        self._write("collections", self.collections().where(F.col("strategy_id") != id))

    def collections(self, name: str | None = None) -> DataFrame:
        out = self._read("collections", COLLECTIONS)
        return out if name is None else out.where(F.col("name") == name)

    def put(self, collection: str, id: str) -> None:
        row = self.spark.createDataFrame([(collection, id)], COLLECTIONS)
        self._write("collections", self.collections().unionByName(row).distinct())

    def take(self, collection: str, id: str | None = None) -> None:
        """Remove one strategy from a collection, or the collection."""
        gone = F.col("name") == collection
        self._write("collections", self.collections().where(~(gone if id is None else gone & (F.col("strategy_id") == id))))

    def rename(self, collection: str, to: str) -> None:
        self._write("collections", self.collections().withColumn("name", F.when(F.col("name") == collection, F.lit(to)).otherwise(F.col("name"))).distinct())
