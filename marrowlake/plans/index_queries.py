"""Queries of index maintenance."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from marrowlake.functions.identity import content_hash, model_id
from marrowlake.operators import index
from marrowlake.plans import fragments as q
from marrowlake.plans.retrieval_queries import pack_of
from marrowlake.runtime import scratch_path, table

Spark = SparkSession
NOW = 1_780_272_000


def _listing(spark: Spark, d: str, run: int) -> DataFrame:
    s = table(spark, d, "scans").filter((F.col("run_id") == run) & F.col("uri").isNotNull())
    return s.groupBy("uri").agg(F.max_by(F.struct("stamp", "content_hash"), F.struct("seen_at", F.coalesce("stamp", F.lit("")), F.coalesce("content_hash", F.lit("")))).alias("s")).select("uri", "s.stamp", F.lower(F.trim("s.content_hash")).alias("hash"))


def stat_first(spark: Spark, d: str) -> DataFrame:
    """The third run against the stamps of the first."""
    return index.stat_first(_listing(spark, d, 3), _listing(spark, d, 1).filter("stamp is not null"))


def chunk_diff(spark: Spark, d: str) -> DataFrame:
    """K3: the documents of run 1 against those of run 6 by their hash."""
    old, new = (_listing(spark, d, r).select(F.col("uri").alias("id"), F.col("hash").alias("embed_hash")) for r in (1, 6))
    return index.chunk_delta(old, new)


def chunk_diff_counts(spark: Spark, d: str) -> DataFrame:
    return index.delta_counts(chunk_diff(spark, d))


def upsert(spark: Spark, d: str) -> DataFrame:
    """K1: run 1 with the rows of run 3 put in."""
    return index.upserted(_listing(spark, d, 1), _listing(spark, d, 3), "uri")


def prune_missing(spark: Spark, d: str) -> DataFrame:
    """Documents that the last good run could have found and did not."""
    return index.prunable(table(spark, d, "documents").select("doc_id", "uri"), _listing(spark, d, 6))


def embed_dedup(spark: Spark, d: str) -> DataFrame:
    """Texts that need embedding when chunks of documents with an even doc_id are known, each once."""
    c = table(spark, d, "chunks").filter("embed_text is not null").withColumn("embed_hash", content_hash(F.col("embed_text")))
    _, need = index.embedding_plan(c.filter("doc_id % 2 = 0").select("embed_hash", "embedding"), c.filter("doc_id % 2 = 1"))
    return need.select("embed_hash", F.length("embed_text").alias("chars"))


def vector_backlog(spark: Spark, d: str) -> DataFrame:
    """A batch of 64 chunks without a vector in any of their rows."""
    return index.backlog(table(spark, d, "chunks").groupBy("id").agg(F.max("embedding").alias("embedding")), 64).select("id")


def settled_sessions(spark: Spark, d: str) -> DataFrame:
    """Transcripts by whether they are quiet and young enough."""
    t = table(spark, d, "documents").filter("source_type = 'transcript'").withColumn("m", F.unix_timestamp("indexed_at"))
    return t.select("doc_id", index.settled(F.col("m"), NOW).alias("settled"), index.young_enough(F.col("m"), NOW, 30).alias("young"))


def ignored_paths(spark: Spark, d: str) -> DataFrame:
    """S3 with the folders of two vaults."""
    return table(spark, d, "documents").filter(~index.ignored(F.col("uri"), ("vault-ops", "papers"))).select("doc_id", "uri")


def pack_round_trip(spark: Spark, d: str) -> DataFrame:
    """Chunks with a vector, built, validated and read again."""
    p = pack_of(spark, d)
    rows = p.chunks.join(p.vectors, "id").select("id", "doc", "ord", "heading_path", F.col("vec").alias("embedding"))
    path, model = scratch_path(spark, "pack"), model_id("hash", 64, "none")
    index.build_pack(rows, path, model, 64)
    return index.open_pack(spark, path, model, 64).groupBy("doc").agg(F.count("*").alias("rows"), F.max("ord").alias("last"))


def keep_generations(spark: Spark, d: str) -> DataFrame:
    """Of the runs, the newest three and the first, which the pointer names."""
    return index.generations_kept(table(spark, d, "scans").select(F.col("run_id").alias("generation")), 3, "1")


def blob_garbage(spark: Spark, d: str) -> DataFrame:
    """Hashes that no kept run lists. Listings are kept in long form, so no list of a whole run is built."""
    s = table(spark, d, "scans").filter("content_hash is not null").select(F.col("run_id").alias("generation"), F.lower(F.trim("content_hash")).alias("hash")).distinct()
    kept = s.join(keep_generations(spark, d), "generation", "left_semi").select("hash").distinct()
    return s.select("hash").distinct().join(kept, "hash", "left_anti")


def upload_plan(spark: Spark, d: str) -> DataFrame:
    """The files of run 6 against the blobs of run 1."""
    return index.to_upload(_listing(spark, d, 6).filter("hash is not null"), _listing(spark, d, 1).filter("hash is not null"))[1]


QUERIES = {
    f.__name__: f
    for f in (stat_first, chunk_diff, chunk_diff_counts, upsert, prune_missing, embed_dedup, vector_backlog, settled_sessions, ignored_paths, pack_round_trip, keep_generations, blob_garbage, upload_plan)
}


def _run(n: int) -> str:
    return f"l{n} AS (SELECT uri, s.stamp AS stamp, lower(trim(s.h)) AS hash FROM (SELECT uri, arg_max({{'stamp': stamp, 'h': content_hash}}, (seen_at, coalesce(stamp, ''), coalesce(content_hash, ''))) s FROM scans WHERE run_id = {n} AND uri IS NOT NULL GROUP BY 1))"


_DIFF = f"WITH {_run(1)}, {_run(6)}, x AS (SELECT coalesce(l1.uri, l6.uri) id, CASE WHEN l1.uri IS NULL THEN 'inserted' WHEN l6.uri IS NULL THEN 'deleted' WHEN l1.hash IS NOT DISTINCT FROM l6.hash THEN 'kept' ELSE 'changed' END AS action FROM l1 FULL JOIN l6 ON l1.uri = l6.uri)"
_KEPT = "(SELECT DISTINCT run_id FROM scans WHERE run_id = 1 OR run_id IN (SELECT DISTINCT run_id FROM scans ORDER BY 1 DESC LIMIT 3))"
SQL = {
    "stat_first": f"WITH {_run(3)}, {_run(1)} SELECT l3.uri, l3.stamp, CASE WHEN l3.stamp IS NULL THEN 'skipped' WHEN l1.stamp IS NULL THEN 'new' WHEN l1.stamp = l3.stamp THEN 'unchanged' ELSE 'changed' END AS state FROM l3 LEFT JOIN l1 ON l1.uri = l3.uri",
    "chunk_diff": f"{_DIFF} SELECT * FROM x",
    "chunk_diff_counts": f"{_DIFF} SELECT count(*) FILTER (WHERE action IN ('inserted', 'changed')) inserted, count(*) FILTER (WHERE action IN ('deleted', 'changed')) deleted, count(*) FILTER (WHERE action = 'kept') kept FROM x",
    "upsert": f"WITH {_run(1)}, {_run(3)} SELECT * FROM l1 WHERE uri NOT IN (SELECT uri FROM l3) UNION ALL SELECT * FROM l3",
    "prune_missing": f"WITH {_run(6)} SELECT doc_id, uri FROM documents WHERE (starts_with(uri, 'file://') OR starts_with(uri, 'claude-session://') OR starts_with(uri, 'codex-session://')) AND uri NOT IN (SELECT uri FROM l6)",
    "embed_dedup": "WITH c AS (SELECT *, sha256(embed_text) h FROM chunks WHERE embed_text IS NOT NULL) SELECT h AS embed_hash, CAST(length(min(embed_text)) AS INTEGER) chars FROM c WHERE doc_id % 2 = 1 AND h NOT IN (SELECT h FROM c WHERE doc_id % 2 = 0 AND embedding IS NOT NULL) GROUP BY 1",
    "vector_backlog": "SELECT id FROM chunks GROUP BY id HAVING count(embedding) = 0 ORDER BY id LIMIT 64",
    "settled_sessions": f"SELECT doc_id, {NOW} - floor(epoch(indexed_at)) >= 600 settled, indexed_at IS NULL OR {NOW} - floor(epoch(indexed_at)) <= 2592000 young FROM documents WHERE source_type = 'transcript'",
    "ignored_paths": "SELECT doc_id, uri FROM documents WHERE NOT list_has_any(string_split(uri, '/'), ['vault-ops', 'papers'])",
    "pack_round_trip": f"WITH {q.ONCE}, {q.VEC} SELECT doc, count(*) AS rows, max(ord) AS last FROM once JOIN vec USING (id) GROUP BY 1",
    "keep_generations": f"SELECT run_id AS generation FROM {_KEPT}",
    "blob_garbage": f"WITH s AS (SELECT DISTINCT run_id, lower(trim(content_hash)) hash FROM scans WHERE content_hash IS NOT NULL) SELECT DISTINCT hash FROM s WHERE hash NOT IN (SELECT hash FROM s WHERE run_id IN {_KEPT})",
    "upload_plan": f"WITH {_run(6)}, {_run(1)}, n AS (SELECT count(DISTINCT hash) u FROM l6 WHERE hash IS NOT NULL AND hash NOT IN (SELECT hash FROM l1 WHERE hash IS NOT NULL)), f AS (SELECT count(*) f FROM l6 WHERE hash IS NOT NULL) SELECT f AS files, u AS uploads, f - u AS deduplicated FROM n, f",
}
