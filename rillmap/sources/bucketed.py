"""A growing keyed table in hash buckets: what meets it on its key is dealt, it never is."""

from __future__ import annotations

import re
import uuid

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F


class BucketedTable:
    """A Parquet table of (key, h, ..), bucketed and sorted by `key`, in the newest version below a folder.

    The folder holds `buckets=N/version=K`; files carry their bucket in their names, so any session can read them as
    buckets. Rows of one key and h are one entry. Appends add a file to each bucket; `compact` writes a next version with one file a
    bucket, and drops the old one. One writer at a time.
    """

    def __init__(self, spark: SparkSession, path: str, schema: str, buckets: int = 64, most_files: int = 16):
        self.spark, self.path, self.schema, self.most_files = spark, path, schema, most_files
        self.key = schema.split()[0]
        hadoop = spark.sparkContext._jvm.org.apache.hadoop.fs
        self._path, self._fs = hadoop.Path, hadoop.Path(path).getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())
        found = [n for n in self._names(path) if n.startswith("buckets=")]
        self.buckets = int(found[0].partition("=")[2]) if found else buckets
        self.home = f"{path}/buckets={self.buckets}"
        # a version is whole once its marker is written
        whole = [int(m[1]) for n in self._names(self.home) if (m := re.fullmatch(r"version=(\d+)", n)) and "_SUCCESS" in self._names(f"{self.home}/{n}")]
        self.version = max(whole, default=0)
        self.name = self._register(self.version or 1)

    def _names(self, path: str) -> list[str]:
        place = self._path(path)
        return [s.getPath().getName() for s in self._fs.listStatus(place)] if self._fs.exists(place) else []

    def _register(self, version: int) -> str:
        """A name for a version in this session's catalog; the files alone are the table."""
        name = f"bucketed_{uuid.uuid4().hex}"
        place = self._path(f"{self.home}/version={version}")
        self._fs.mkdirs(place)
        where = self._fs.makeQualified(place).toString().replace("'", "\\'")
        self.spark.sql(f"CREATE TABLE {name} ({self.schema}) USING parquet CLUSTERED BY ({self.key}) SORTED BY ({self.key}) INTO {self.buckets} BUCKETS LOCATION '{where}'")
        return name

    def read(self) -> DataFrame:
        """All entries, once each; neither this nor a join on the key deals them."""
        return self.spark.table(self.name).dropDuplicates([self.key, "h"])

    @staticmethod
    def same(a: Column, b: Column) -> Column:
        """Equality of the second half of the key, said so that a join is dealt by the first half alone, as the buckets are."""
        return (a <= b) & (a >= b)

    def missing(self, rows: DataFrame) -> DataFrame:
        """Rows (key, h, ..) that have no entry."""
        have = self.spark.table(self.name).select(F.col(self.key).alias("_k"), F.col("h").alias("_h"))
        return rows.join(have, (rows[self.key] == F.col("_k")) & self.same(rows["h"], F.col("_h")), "left_anti")

    def append(self, rows: DataFrame) -> None:
        """Adds entries; only they are dealt, to one file for each bucket."""
        self._insert(rows.repartition(self.buckets, self.key), self.name)
        if sum(n.startswith("part-") for n in self._names(f"{self.home}/version={self.version or 1}")) > self.most_files * self.buckets:
            self.compact()

    def _insert(self, rows: DataFrame, name: str) -> None:
        rows.select(*(c.split()[0] for c in self.schema.split(", "))).write.insertInto(name)

    def compact(self) -> None:
        """The entries once each, a file for each bucket, as the next version; the old one goes when that is whole."""
        old = f"{self.home}/version={self.version or 1}"
        self.version = (self.version or 1) + 1
        name = self._register(self.version)
        self._insert(self.read().repartition(self.buckets, self.key), name)
        self.name = name
        self._fs.delete(self._path(old), True)
