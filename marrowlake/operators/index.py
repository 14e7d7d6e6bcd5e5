"""Index maintenance (K1-K9, K16, S4-S6, J6, J8): every mutation is a join of two versions."""

from __future__ import annotations

import uuid

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from marrowlake.functions.identity import ANALYZER
from marrowlake.operators.versions import Versions

SETTLE_SECONDS = 600
ROW_FORMAT = 4


def upserted(old: DataFrame, new: DataFrame, key: str = "id") -> DataFrame:
    """K1: rows of old that new does not replace, and all of new."""
    return old.join(new.select(key), key, "left_anti").unionByName(new, allowMissingColumns=True)


def edges_after_upsert(edges: DataFrame, replaced: DataFrame, fresh: DataFrame) -> DataFrame:
    """K1: edges out of replaced documents are made anew, those into them stay. Distinct by (src, dst, kind) (K6)."""
    kept = edges.join(replaced.select(F.col("id").alias("src")), "src", "left_anti").select("src", "dst", "kind")
    return kept.unionByName(fresh.select("src", "dst", "kind")).distinct()


def chunk_delta(old: DataFrame, new: DataFrame) -> DataFrame:
    """(id, action) of a re-indexed document's chunks: kept, changed, inserted or deleted by id and hash of the embedded text (K3)."""
    o, n = old.select("id", F.col("embed_hash").alias("_o"), F.lit(1).alias("_in_old")), new.select("id", F.col("embed_hash").alias("_n"), F.lit(1).alias("_in_new"))
    action = F.when(F.col("_in_old").isNull(), "inserted").when(F.col("_in_new").isNull(), "deleted").when(F.col("_o").eqNullSafe(F.col("_n")), "kept").otherwise("changed")
    return o.join(n, "id", "full").select("id", action.alias("action"))


def delta_counts(delta: DataFrame) -> DataFrame:
    """(inserted, deleted, kept): a changed chunk counts as deleted and as inserted."""
    a = F.col("action")
    return delta.agg(F.count_if(a.isin("inserted", "changed")).alias("inserted"), F.count_if(a.isin("deleted", "changed")).alias("deleted"), F.count_if(a == "kept").alias("kept"))


def deleted(tables: dict[str, tuple[DataFrame, str]], gone: DataFrame, key: str = "id") -> dict[str, DataFrame]:
    """K4: each (table, column) without the rows that belong to gone documents."""
    return {name: df.join(gone.select(F.col(key).alias(c)), c, "left_anti") for name, (df, c) in tables.items()}


def with_embeddings(chunks: DataFrame, made: DataFrame) -> DataFrame:
    """K5: chunks with the vectors of made (id, embedding) where there are any."""
    return chunks.join(made.select("id", F.col("embedding").alias("_e")), "id", "left").withColumn("embedding", F.coalesce("_e", "embedding")).drop("_e")


def embedding_plan(old: DataFrame, new: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(reused, needed): chunks whose text was embedded before, with the vector, and each other text once by hash."""
    known = old.filter("embedding is not null").groupBy("embed_hash").agg(F.max("embedding").alias("embedding"))
    need = new.join(known, "embed_hash", "left_anti").groupBy("embed_hash").agg(F.min("embed_text").alias("embed_text"))
    return new.drop("embedding").join(known, "embed_hash"), need


def backlog(chunks: DataFrame, most: int) -> DataFrame:
    """The first chunks, by id, that have no vector."""
    return chunks.filter("embedding is null").orderBy("id").limit(most)


def stat_first(listing: DataFrame, stamps: DataFrame) -> DataFrame:
    """(uri, stamp, state): new, changed or unchanged against the stamps of the last run (S4). An unreadable file has a null stamp and is skipped."""
    known = stamps.select("uri", F.col("stamp").alias("_k"))
    state = F.when(F.col("stamp").isNull(), "skipped").when(F.col("_k").isNull(), "new").when(F.col("_k") == F.col("stamp"), "unchanged").otherwise("changed")
    return listing.select("uri", "stamp").join(known, "uri", "left").select("uri", "stamp", state.alias("state"))


def scan_result(listing: DataFrame, stamps: DataFrame, deferred: DataFrame | None = None, failed: DataFrame | None = None) -> DataFrame:
    """S4 as a whole: (uri, state, stamp, live) of a listing against the last run's stamps.

    deferred and failed (uri) are files that are put off and files that could not be loaded. State: unchanged, new, changed, deferred, skipped or failed; stamp is what to
    remember: a deferred or failed file keeps its old one, so it is looked at again. All but files that could not even be listed (null stamp, never indexed) are live.
    """
    s = stat_first(listing, stamps).join(stamps.select("uri", F.col("stamp").alias("_old")), "uri", "left")
    none = listing.select("uri").limit(0)
    s = s.join((deferred if deferred is not None else none).select("uri", F.lit(True).alias("_d")).distinct(), "uri", "left").join((failed if failed is not None else none).select("uri", F.lit(True).alias("_f")).distinct(), "uri", "left")
    todo = F.col("state").isin("new", "changed")
    state = F.when(todo & F.col("_f").isNotNull(), "failed").when(todo & F.col("_d").isNotNull(), "deferred").otherwise(F.col("state"))
    s = s.withColumn("state", state)
    kept = F.col("state").isin("failed", "deferred", "skipped")
    return s.select("uri", "state", F.when(kept, F.col("_old")).otherwise(F.col("stamp")).alias("stamp"), (~((F.col("state") == "skipped") & F.col("_old").isNull())).alias("live"))


def merged_scans(parts: list[DataFrame]) -> DataFrame:
    """The results of partial scans as one; a uri that several list takes its most telling state (failed, changed, new, deferred, unchanged, skipped)."""
    order = {"failed": 0, "changed": 1, "new": 2, "deferred": 3, "unchanged": 4, "skipped": 5}
    rank = F.coalesce(*(F.when(F.col("state") == k, v) for k, v in order.items()))
    both = parts[0]
    for p in parts[1:]:
        both = both.unionByName(p)
    best = both.groupBy("uri").agg(F.min(F.struct(rank.alias("r"), "state", "stamp")).alias("b"), F.max("live").alias("live"))
    return best.select("uri", "b.state", "b.stamp", "live")


def may_reindex(last: Column, now: Column | int, least_seconds: int = 900) -> Column:
    """Whether the last index is old enough for another run; no last index always is."""
    return F.coalesce(F.lit(now) - last >= least_seconds if isinstance(now, int) else now - last >= least_seconds, F.lit(True))


def ordered_response(response: DataFrame, group: str, index: str, value: str) -> DataFrame:
    """(group, value in order of index) of an embedder's responses; raises in the job where the indices are not exactly 0 .. n - 1. A response is one request's batch."""
    got = response.groupBy(group).agg(F.array_sort(F.collect_list(F.struct(F.col(index).alias("i"), F.col(value).alias("v")))).alias("r"))
    fits = F.transform("r", lambda x: x["i"].cast("int")) == F.sequence(F.lit(0), F.size("r") - 1)
    checked = F.when(fits, F.col("r")).otherwise(F.raise_error(F.concat(F.lit("response indices are not 0..n-1 for "), F.col(group).cast("string"))))
    return got.select(group, F.transform(checked, lambda x: x["v"]).alias("values"))


def response_faults(response: DataFrame, group: str, index: str) -> DataFrame:
    """P9 without raising: the groups whose indices are not exactly 0 .. n - 1. Counts only, so a group may be of any size."""
    i = F.col(index)
    agg = response.groupBy(group).agg(F.count("*").alias("n"), F.count_distinct(i).alias("d"), F.min(i).alias("lo"), F.max(i).alias("hi"))
    return agg.filter("n <> d or lo <> 0 or hi <> n - 1").select(group)


def backfilled(chunks: DataFrame, embed, budget: int, dims: int, batch: int = 64) -> tuple[DataFrame, DataFrame]:
    """(id, embedding) of the first `budget` chunks, by id, that have no usable vector, and (left), how many still wait after them.

    embed maps a list of at most `batch` texts to as many vectors of dims numbers; another count or width fails the batch (M3). Chunks: id, embed_text, embedding; an
    id with a vector in any of its rows does not wait. Texts are embedded where they lie.
    """
    from collections.abc import Iterator

    import pyarrow as pa

    wait = chunks.groupBy("id").agg(F.max(F.col("embedding").isNotNull()).alias("_has"), F.min("embed_text").alias("embed_text")).filter("not _has and embed_text is not null").select("id", "embed_text")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for a in range(0, b.num_rows, batch):
                part = b.slice(a, batch)
                texts = part.column(1).to_pylist()
                vectors = embed(texts)
                if len(vectors) != len(texts) or any(len(v) != dims for v in vectors):
                    raise ValueError(f"{len(texts)} texts gave {len(vectors)} vectors, or not all of {dims} numbers")
                yield pa.RecordBatch.from_arrays([part.column(0), pa.array([[float(x) for x in v] for v in vectors], pa.list_(pa.float32()))], names=["id", "embedding"])

    made = wait.orderBy("id").limit(budget).mapInArrow(run, "id string, embedding array<float>")
    return made, wait.agg(F.greatest(F.count("*") - budget, F.lit(0)).alias("left"))


def hash_embedding(dims: int):
    """A deterministic embedder for tests: numbers from SHA-256 of text and place, of length one."""
    import hashlib
    import math

    def embed(texts: list[str]) -> list[list[float]]:
        out = []
        for t in texts:
            raw = [int.from_bytes(hashlib.sha256(f"{i}:{t}".encode()).digest()[:4], "big") / 2**31 - 1 for i in range(dims)]
            n = math.sqrt(sum(x * x for x in raw)) or 1.0
            out.append([x / n for x in raw])
        return out

    return embed


def young_enough(modified: Column, now: int, max_days: int) -> Column:
    """Unreadable times are kept."""
    return modified.isNull() | (now - modified <= max_days * 86400)


def settled(modified: Column, now: int, quiet: int = SETTLE_SECONDS) -> Column:
    """Files that grew within the quiet period wait."""
    return now - modified >= quiet


def prunable(indexed: DataFrame, live: DataFrame, schemes: tuple[str, ...] = ("file://", "claude-session://", "codex-session://")) -> DataFrame:
    """Indexed documents that could have been found and were not (K16). Raises if nothing was found at all but something would be pruned."""
    found_by_walk = F.coalesce(sum((F.col("uri").startswith(s).cast("int") for s in schemes), F.lit(0)) > 0, F.lit(False))
    gone = indexed.filter(found_by_walk).join(live.select("uri"), "uri", "left_anti")
    if live.isEmpty() and not gone.isEmpty():
        raise ValueError("nothing was found; refusing to prune everything")
    return gone


def distinct_roots(roots: list[str]) -> list[str]:
    """Roots sorted, without repeats and without roots inside another."""
    out: list[str] = []
    for r in sorted({x.rstrip("/") for x in roots}):
        if not any(r.startswith(o + "/") for o in out):
            out.append(r)
    return out


def ignored(path: Column, names: tuple[str, ...] = ("_templates",)) -> Column:
    """S3: a path with a component of one of these names."""
    return F.arrays_overlap(F.split(path, "/"), F.array(*(F.lit(n) for n in names)))


def build_pack(chunks: DataFrame, path: str, model: str, dims: int) -> dict:
    """A chunk table in order of id as the newest version below path. Refuses to mix rows with and without vectors.

    Rows are ranged and sorted by id, so a point read touches one file and row group. They go to a folder of their own, which a manifest then names: readers keep what they
    opened, and a failure before that changes nothing. The whole search pack is operators/pack.py.
    """
    n = chunks.agg(F.count("*").alias("rows"), F.count("embedding").alias("vectors")).first()
    if 0 < n["vectors"] < n["rows"]:
        raise ValueError(f"{n['vectors']} of {n['rows']} rows have a vector; a pack has all or none")
    versions = Versions(chunks.sparkSession, f"{path}/manifests")
    version, folder = (versions.numbers() or [0])[-1] + 1, f"rows-{uuid.uuid4().hex}"
    chunks.repartitionByRange("id").sortWithinPartitions("id").write.parquet(f"{path}/{folder}")
    manifest = {"version": version, "folder": folder, "format": ROW_FORMAT, "model_id": model, "dims": dims, "rows": n["rows"], "rows_with_vectors": n["vectors"], "analyzer": ANALYZER}
    versions.publish(manifest)
    return manifest


def open_pack(spark: SparkSession, path: str, model: str, dims: int) -> DataFrame:
    """The rows of the newest version; raises if format, model, width, analyzer or row count differ from its manifest."""
    m = Versions(spark, f"{path}/manifests").read()
    if m is None:
        raise ValueError(f"no pack at {path}")
    for name, want in (("format", ROW_FORMAT), ("model_id", model), ("dims", dims), ("analyzer", ANALYZER)):
        if m[name] != want:
            raise ValueError(f"the pack has {name} {m[name]}, not {want}")
    rows = spark.read.parquet(f"{path}/{m['folder']}")
    if (n := rows.count()) != m["rows"]:
        raise ValueError(f"the pack has {n} rows, its manifest {m['rows']}")
    return rows


def record(pack: DataFrame, chunk_id: str) -> DataFrame:
    """One row by id; the sorted files prune all but one row group."""
    return pack.filter(F.col("id") == chunk_id)


def live_bytes(chunks: DataFrame) -> DataFrame:
    """Bytes of text columns and vectors."""
    size = sum((F.coalesce(F.octet_length(c), F.lit(0)) for c in ("id", "text", "heading_path")), F.lit(0)) + 4 * F.coalesce(F.array_size("embedding"), F.lit(0))
    return chunks.agg(F.coalesce(F.sum(size.cast("long")), F.lit(0)).alias("bytes"))


def generations_kept(generations: DataFrame, keep: int, latest: str | None = None) -> DataFrame:
    """The newest max(keep, 1) generations and the one that the pointer names. generations: generation, hashes."""
    from pyspark.sql import Window

    n = generations.select("generation").distinct().withColumn("n", F.row_number().over(Window.orderBy(F.desc("generation"))))  # a row a backup
    return n.filter((F.col("n") <= max(keep, 1)) | (F.col("generation") == F.lit(latest))).select("generation")


def blobs_to_delete(blobs: DataFrame, generations: DataFrame, kept: DataFrame) -> DataFrame:
    """Blobs that no kept generation names."""
    used = generations.join(kept, "generation", "left_semi").select(F.explode("hashes").alias("hash")).distinct()
    return blobs.join(used, "hash", "left_anti")


def to_upload(files: DataFrame, blobs: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(hashes that are not stored yet, counts of files, uploads and deduplicated files)."""
    new = files.select("hash").distinct().join(blobs.select("hash"), "hash", "left_anti")
    n = files.agg(F.count("*").alias("files")).crossJoin(new.agg(F.count("*").alias("uploads")))  # single rows
    return new, n.withColumn("deduplicated", F.col("files") - F.col("uploads"))
