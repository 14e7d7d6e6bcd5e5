"""Queries of incremental processing."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from marrowlake.operators.incremental import IncrementalTarget, replay_runs
from marrowlake.runtime import scratch_path, table


def p7_found(spark: SparkSession, d: str) -> DataFrame:
    return replay_runs(table(spark, d, "scans"), table(spark, d, "index_runs"), IncrementalTarget(spark, scratch_path(spark, "target"))).select("run_id", "uri")


def p7_resumed(spark: SparkSession, d: str) -> DataFrame:
    """p7_found by a replay whose third batch fails, and that a second replay of the same target takes up: nothing is skipped and nothing repeated."""
    scans, runs = table(spark, d, "scans"), table(spark, d, "index_runs")
    target = IncrementalTarget(spark, scratch_path(spark, "target"))
    third = [r["run_id"] for r in runs.filter("lower(trim(status)) = 'ok'").select("run_id").distinct().orderBy("run_id").limit(3).collect()][-1]

    def fails(run: int, rows: DataFrame) -> DataFrame:
        return rows.withColumn("uri", F.raise_error(F.lit("planned failure"))) if run == third else rows

    try:
        replay_runs(scans, runs, target, fails)
    except Exception as e:
        if "planned failure" not in str(e):
            raise
    return replay_runs(scans, runs, target).select("run_id", "uri")


QUERIES = {"p7_found": p7_found, "p7_resumed": p7_resumed}
SQL = {
    "p7_found": """WITH ok AS (SELECT run_id FROM index_runs WHERE status = 'ok'),
 s AS (SELECT run_id, uri, arg_max(nullif(lower(trim(content_hash)), ''), seen_at) FILTER (WHERE true) x, max(seen_at) t FROM scans JOIN ok USING (run_id) GROUP BY 1, 2),
 l AS (SELECT s.run_id, s.uri, nullif(lower(trim(c.content_hash)), '') h FROM s JOIN scans c ON c.run_id = s.run_id AND c.uri = s.uri AND c.seen_at = s.t),
 u AS (SELECT run_id, uri, max(h) h FROM l GROUP BY 1, 2),
 v AS (SELECT *, lag(h) OVER (PARTITION BY uri ORDER BY run_id) before FROM u WHERE h IS NOT NULL)
 SELECT run_id, uri FROM v WHERE run_id > (SELECT min(run_id) FROM ok) AND (before IS NULL OR before <> h)""",
}
SQL["p7_resumed"] = SQL["p7_found"]
