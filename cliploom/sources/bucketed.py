"""A keyed table in hash buckets: a batch reads and rewrites only the buckets it touches.

``data/version=N/bucket=K`` holds what batch N wrote of bucket K; ``pointer/version=N`` says, in one row per bucket, which
version of each bucket is valid after batch N. The pointer is written last, so a batch that fails leaves the table as it was and
may be repeated under its number."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

BUCKETS = 32


class BucketedTable:
    def __init__(self, spark: SparkSession, path: str, schema: StructType, keys: list[str], buckets: int = BUCKETS):
        self.spark, self.path, self.schema, self.keys, self.buckets = spark, path.rstrip("/"), schema, keys, buckets

    def _bucket(self):
        return F.pmod(F.xxhash64(*self.keys), F.lit(self.buckets)).cast("int")

    def valid(self, below: int | None = None) -> tuple[int, dict[int, int]]:
        """The last version (before ``below``), and the valid version of each bucket: one row per bucket."""
        try:
            pointers = self.spark.read.schema("bucket int, written bigint, version bigint").parquet(f"{self.path}/pointer")
        except AnalysisException:  # nothing written yet
            return -1, {}
        if below is not None:
            pointers = pointers.filter(F.col("version") < below)
        last = pointers.agg(F.max("version")).first()[0]
        if last is None:
            return -1, {}
        return last, {r.bucket: r.written for r in pointers.filter(F.col("version") == last).collect()}

    def _rows(self, valid: dict[int, int], touched: set[int] | None = None) -> DataFrame:
        paths = [f"{self.path}/data/version={v}/bucket={b}" for b, v in sorted(valid.items()) if touched is None or b in touched]
        reader = self.spark.read.schema(self.schema)
        return reader.parquet(*paths) if paths else self.spark.createDataFrame([], self.schema)

    def read(self) -> DataFrame:
        """The rows that are valid now."""
        return self._rows(self.valid()[1])

    def merge(self, batch: DataFrame, reduce_rows: Callable[[DataFrame], DataFrame], version: int | None = None) -> None:
        """Fold ``batch`` into the table: ``reduce_rows`` gets the batch and the old rows of the buckets it touches, whole
        keys at a time, and returns at least one row for each key."""
        before, valid = self.valid(version)
        version = before + 1 if version is None else version
        names = self.schema.names
        rows = batch.select(*names).persist()
        try:
            touched = {r[0] for r in rows.select(self._bucket().alias("bucket")).distinct().collect()}  # at most ``buckets``
            if touched:
                merged = reduce_rows(rows.unionByName(self._rows(valid, touched))).select(*names)
                merged.withColumn("bucket", self._bucket()).repartition("bucket").write.partitionBy("bucket").mode("overwrite").parquet(
                    f"{self.path}/data/version={version}"
                )
        finally:
            rows.unpersist()
        now = valid | dict.fromkeys(touched, version)
        pointer = self.spark.createDataFrame(sorted(now.items()), "bucket int, written bigint")
        pointer.coalesce(1).write.mode("overwrite").parquet(f"{self.path}/pointer/version={version}")
        self._sweep(before, set(valid.values()) | set(now.values()))

    def _sweep(self, before: int, live: set[int]) -> None:
        """Delete versions that neither this pointer nor the one before names, and older pointers."""
        jvm, names = self.spark._jvm, {}
        where = lambda p: jvm.org.apache.hadoop.fs.Path(p)
        store = where(self.path).getFileSystem(self.spark._jsc.hadoopConfiguration())
        for folder in ("data", "pointer"):
            root = where(f"{self.path}/{folder}")
            found = [s.getPath().getName() for s in store.listStatus(root)] if store.exists(root) else []
            names[folder] = [int(n.split("=")[1]) for n in found if n.startswith("version=")]
        newest = max(names["pointer"], default=-1)
        for v in names["data"]:
            if v not in live and v < newest:
                store.delete(where(f"{self.path}/data/version={v}"), True)
        for v in names["pointer"]:
            if v < before:
                store.delete(where(f"{self.path}/pointer/version={v}"), True)
