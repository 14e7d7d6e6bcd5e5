"""Processing only what is new or changed (p7): the target is the state."""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from marrowlake.operators.versions import Versions
from marrowlake.runtime import scratch_path


class IncrementalTarget:
    """A table of processed records under a shared folder, published version by version.

    Every output row stores the key and the version of its source record and the batch that made it, so the target itself says what is
    done; no separate bookkeeping can disagree with it. A batch writes its rows to a folder of its own and is published by creating
    the next manifest, a list of the folders that make up the target. The manifest is written aside and renamed to a number
    that must be free, so readers see the old or the new target and never a part. A batch that fails before leaves only an unlisted folder;
    a batch that is listed is not processed again.
    """

    def __init__(self, spark: SparkSession, path: str) -> None:
        self.spark, self.path = spark, path.rstrip("/")
        self._versions = Versions(spark, f"{self.path}/manifests")

    def manifest(self) -> dict:
        """The newest one: {"version": n, "batches": {batch: folder}, "state": folder}."""
        return self._versions.read() or {"version": 0, "batches": {}}

    def rows(self, manifest: dict | None = None) -> DataFrame | None:
        """All rows of the target, None before the first batch."""
        folders = list((manifest or self.manifest())["batches"].values())
        return self.spark.read.parquet(*folders) if folders else None

    def state(self, key: str, version: str, manifest: dict | None = None) -> DataFrame | None:
        """(key, version): the version of each key that was processed last.

        Every published batch keeps it as a table beside its rows, so it costs the number of keys, however many batches the target holds.
        """
        m = manifest or self.manifest()
        if m.get("state"):
            return self.spark.read.parquet(m["state"])
        rows = self.rows(m)
        return None if rows is None else rows.groupBy(key).agg(F.max_by(version, "_seq").alias(version))

    def pending(self, source: DataFrame, key: str, version: str) -> DataFrame:
        """The source rows whose key and version are not in the target's state: one anti join."""
        state = self.state(key, version)
        return source if state is None else source.join(state, [key, version], "left_anti")

    def advance(self, batch: str, source: DataFrame, key: str, version: str, make=lambda rows: rows) -> str | None:
        """Processes what is new or changed in source as one batch and publishes it; its folder, or None if the batch was published before.

        source has one row a key; rows with a null key or version are left alone, and keys that it does not list keep their state. make maps the pending
        rows to output rows, which must keep key and version. Rows and the state after them are written first, the manifest names both at once.
        """
        now = self.manifest()
        if batch in now["batches"]:
            return None
        todo = make(self.pending(source.filter(F.col(key).isNotNull() & F.col(version).isNotNull()), key, version))
        name = f"{now['version'] + 1:010d}-{uuid.uuid4().hex}"
        folder, state = f"{self.path}/rows/{name}", f"{self.path}/state/{name}"
        todo.withColumn("_batch", F.lit(batch)).withColumn("_seq", F.lit(now["version"] + 1)).write.parquet(folder)
        fresh, old = self.spark.read.parquet(folder).select(key, version), self.state(key, version, now) if now["batches"] else None
        (fresh if old is None else old.join(fresh.select(key), key, "left_anti").unionByName(fresh)).write.parquet(state)
        self._publish({"version": now["version"] + 1, "batches": {**now["batches"], batch: folder}, "state": state})
        if now.get("state"):
            self._versions.remove(now["state"])  # the target's rows still say the same
        return folder

    def _publish(self, manifest: dict) -> None:
        self._versions.publish(manifest)


def run_listings(scans: DataFrame) -> DataFrame:
    """(run_id, uri, content_hash) of every run: the hash in lower case without outer blanks, of the listing seen last; null if it has none. One pass over all runs."""
    h = F.lower(F.regexp_replace("content_hash", r"^\s+|\s+$", ""))
    rows = scans.filter("run_id is not null and uri is not null").select("run_id", "uri", F.when(h != "", h).alias("content_hash"), "seen_at")
    # max_by skips no null hash: the struct keeps it
    return rows.groupBy("run_id", "uri").agg(F.max_by(F.struct("content_hash"), F.struct("seen_at", F.coalesce("content_hash", F.lit("")))).alias("s")).select("run_id", "uri", "s.content_hash")


def run_listing(scans: DataFrame, run_id: int) -> DataFrame:
    """(uri, content_hash) of one run, as run_listings."""
    return run_listings(scans.filter(F.col("run_id") == run_id)).drop("run_id")


def replay_runs(scans: DataFrame, runs: DataFrame, target: IncrementalTarget, make=lambda run, rows: rows) -> DataFrame:
    """(run_id, uri, content_hash) of every successful run after the first: what was new or changed in it.

    Runs are processed one batch each, in order of run_id, as they would have been when they ended; only the list of runs is
    on the driver. The listings are made in one pass and stored by run, so a batch reads its own. Runs that the target holds already are skipped, so a replay that failed
    goes on where it stopped. make(run, rows) maps a batch's rows. No rows if there is no second successful run.
    """
    spark = scans.sparkSession
    good = sorted(r["run_id"] for r in runs.filter("lower(trim(status)) = 'ok' and run_id is not null").select("run_id").distinct().collect())
    path = scratch_path(spark, "listings")
    ok = runs.filter("lower(trim(status)) = 'ok'").select("run_id").distinct()
    run_listings(scans.join(ok, "run_id", "left_semi")).write.partitionBy("run_id").parquet(path)
    listed = spark.read.schema("uri string, content_hash string, run_id long").parquet(path)
    for run in good:
        rows = listed.filter(F.col("run_id") == run).drop("run_id")
        target.advance(str(run), rows, "uri", "content_hash", lambda rows, run=run: make(run, rows.withColumn("run_id", F.lit(run).cast("long"))))
    later = target.rows()
    if later is None:
        return scans.select("run_id", "uri", "content_hash").limit(0)
    return later.filter(F.col("run_id") > (good[0] if good else 0)).select("run_id", "uri", "content_hash")
