"""Backups of tables by content (K19, W12, P8): unchanged parts are stored once.

A table is cut into buckets by a hash of its key. A bucket's blob is named by its content (row count and the sum of its rows' hashes, whatever their order), so a generation
stores only the buckets that no earlier one holds; its manifest lists the blobs that make it up.
"""

from __future__ import annotations

import json

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from marrowlake.operators.versions import Versions

#: Buckets of a table: the granule of what is stored again, and the number of names that reach the driver.
BUCKETS = 64


def _named(table: DataFrame, key: str, buckets: int) -> DataFrame:
    return table.withColumn("_bucket", F.pmod(F.xxhash64(key), F.lit(buckets)).cast("int"))


def row_hash(table: DataFrame) -> Column:
    """A hash of all columns; nulls keep their place, arrays and structs count by their content."""
    return F.xxhash64(*(F.coalesce(F.to_json(F.struct(c)), F.lit("")) for c in sorted(table.columns)))


def digests(table: DataFrame, key: str, buckets: int = BUCKETS) -> DataFrame:
    """(bucket, blob): the content name of each bucket that has rows."""
    parts = _named(table.withColumn("_h", row_hash(table).cast("decimal(38,0)")), key, buckets).groupBy("_bucket").agg(F.count("*").alias("n"), F.sum("_h").alias("h"), F.sum(F.pmod("_h", F.lit(1_000_003))).alias("m"))
    name = F.concat_ws("-", F.lit("b"), "_bucket", "n", F.substring(F.sha2(F.concat_ws(":", "h", "m", "n"), 256), 1, 24))
    return parts.select(F.col("_bucket").alias("bucket"), name.alias("blob"))


class Backups:
    """Generations of one table below a shared folder: blobs/<name>/ and manifests/<generation>.json."""

    def __init__(self, spark: SparkSession, path: str) -> None:
        self.spark, self.path = spark, path.rstrip("/")
        self.versions = Versions(spark, f"{self.path}/manifests")

    def stored(self) -> set[str]:
        return {b for n in self.versions.numbers() for b in self.versions.read(n)["blobs"]}

    def back_up(self, table: DataFrame, key: str, buckets: int = BUCKETS) -> dict:
        """A new generation of the table. The blobs that are new are written by one job, a folder a blob; the manifest comes last, so a failure leaves only unlisted blobs."""
        names = {r["bucket"]: r["blob"] for r in digests(table, key, buckets).collect()}  # at most `buckets` names
        new = {b: n for b, n in names.items() if n not in self.stored()}
        if new:
            run = f"{self.path}/blobs/{(self.versions.numbers() or [0])[-1] + 1:010d}-{abs(hash(frozenset(new.values()))):x}"
            fresh = _named(table, key, buckets).filter(F.col("_bucket").isin(list(new)))
            fresh.hint("rebalance", "_bucket").write.mode("overwrite").partitionBy("_bucket").parquet(run)
        where = {b: f for n in self.versions.numbers() for b, f in self.versions.read(n)["blobs"].items()}
        manifest = {"version": (self.versions.numbers() or [0])[-1] + 1, "schema": json.loads(table.schema.json()), "blobs": {n: where.get(n) or f"{run}/_bucket={b}" for b, n in names.items()}, "uploaded": len(new)}
        self.versions.publish(manifest)
        return manifest

    def restore(self, generation: int | None = None) -> DataFrame:
        """The table of a generation, the newest without one; raises if there is none."""
        from pyspark.sql.types import StructType

        m = self.versions.read(generation)
        if m is None:
            raise ValueError(f"no backup at {self.path}")
        schema = StructType.fromJson(m["schema"])
        folders = list(m["blobs"].values())
        return self.spark.read.schema(schema).parquet(*folders) if folders else self.spark.createDataFrame([], schema)

    def prune(self, keep: int) -> list[str]:
        """Drops all but the newest max(keep, 1) generations and the blobs that none of those names; the folders that went."""
        numbers = self.versions.numbers()
        gone, kept = numbers[: -max(keep, 1)], numbers[-max(keep, 1) :]
        live = {f for n in kept for f in self.versions.read(n)["blobs"].values()}
        dead = {f for n in gone for f in self.versions.read(n)["blobs"].values()} - live
        for n in gone:
            self.versions.drop(n)
        for f in dead:
            self.versions.remove(f)
        return sorted(dead)
