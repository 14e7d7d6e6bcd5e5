"""The stored pack (K7-K17, S25-S27): what search reads, built once, published version by version, opened by path.

A version is a folder of tables that is never changed: rows (chunks in order of id, numbered), postings by bucket of their term, vectors by cell, documents with
inbound links, stage and last use, edges, the stamps of what was indexed. A manifest names the folder and holds the totals, the centres of the cells and
key-value pairs; search needs no more than the path.
"""

from __future__ import annotations

import uuid
from functools import cached_property

import numpy as np
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from marrowlake.functions.identity import ANALYZER
from marrowlake.functions.weights import CURRENT, lifecycle
from marrowlake.operators import bm25, graph, knn
from marrowlake.operators.versions import Versions

FORMAT = 5
#: Rows that one bucket of postings is made for, and the most buckets.
ROWS_PER_BUCKET, MOST_BUCKETS = 50_000, 1_024
#: Versions that stay readable after they were replaced.
KEEP = 2


class Pack:
    """A published version, read lazily: chunks (row, id, doc, ord, text, heading_path, page_no), vectors (id, vec, cell), index, edges, documents, stamps."""

    def __init__(self, spark: SparkSession, path: str, manifest: dict) -> None:
        self.spark, self.path, self.manifest = spark, path, manifest
        self.dims, self.stemmed = manifest["dims"], manifest["stemmed"]

    def _read(self, name: str, schema: str) -> DataFrame:
        return self.spark.read.schema(schema).parquet(f"{self.path}/{self.manifest['folder']}/{name}")

    @cached_property
    def chunks(self) -> DataFrame:
        return self._read("rows", "row long, id string, doc string, ord long, text string, heading_path string, page_no long, embed_hash string")

    @cached_property
    def vectors(self) -> DataFrame:
        return self.spark.read.schema("id string, vec array<float>, cell int").parquet(f"{self.path}/{self.manifest['vectors']}") if self.manifest["vectors"] else self.spark.createDataFrame([], "id string, vec array<float>, cell int")

    @cached_property
    def cells(self) -> knn.Cells | None:
        c = self.manifest["cells"]
        return knn.Cells(np.array(c["centres"], np.float64), np.array(c["sizes"], np.int64)) if c else None

    @cached_property
    def index(self) -> bm25.Index:
        m = self.manifest
        return bm25.opened(self.spark, f"{self.path}/{m['folder']}/postings", m["rows"], m["all_terms"], "row", "long", m["buckets"], stemmed=m["stemmed"])

    @property
    def postings(self) -> DataFrame:
        """(term, id, tf, impact)."""
        return self.index.postings().join(self.chunks.select("row", "id"), "row").select("term", "id", "tf", "impact")

    @cached_property
    def edges(self) -> DataFrame:
        return self._read("edges", "src string, dst string, kind string")

    @cached_property
    def documents(self) -> DataFrame:
        return self._read("documents", "id string, uri string, title string, source_type string, inbound long, lifecycle int, last_used long")

    @cached_property
    def stamps(self) -> DataFrame:
        """(uri, stamp) of what the version indexed."""
        return self._read("stamps", "uri string, stamp string")

    @property
    def max_inbound(self) -> int:
        return self.manifest["max_inbound"]


def open_pack(spark: SparkSession, path: str, model: str | None = None, dims: int | None = None, version: int | None = None) -> Pack:
    """The newest version below path (or the one asked for); raises if there is none or format, model, width or analyzer differ from what is wanted."""
    m = Versions(spark, f"{path}/manifests").read(version)
    if m is None:
        raise ValueError(f"no pack at {path}")
    for name, want in (("format", FORMAT), ("analyzer", ANALYZER if m["stemmed"] else f"{ANALYZER}-unstemmed"), ("model_id", model), ("dims", dims)):
        if want is not None and m[name] != want:
            raise ValueError(f"the pack has {name} {m[name]}, not {want}")
    return Pack(spark, path, m)


def numbered(chunks: DataFrame) -> DataFrame:
    """Chunks in order of id, each id once, with `row`, which grows with the id. One exchange by ranges of the id serves order, numbering and the removal of copies."""
    cols = [c for c in ("ord", "text", "heading_path", "page_no", "embed_hash") if c in chunks.columns]
    ranged = chunks.filter("id is not null").select("id", *cols).repartitionByRange("id").sortWithinPartitions("id")
    once = ranged.groupBy("id").agg(*(F.min(c).alias(c) for c in cols))
    missing = [F.lit(None).cast("string").alias("embed_hash")] if "embed_hash" not in cols else []
    return once.select(F.monotonically_increasing_id().alias("row"), "id", F.substring_index("id", ":", 1).alias("doc"), F.col("ord").cast("long"), "text", "heading_path", F.col("page_no").cast("long"), *([] if missing else ["embed_hash"]), *missing)


def document_rows(documents: DataFrame, edges: DataFrame, usage: DataFrame | None = None) -> DataFrame:
    """Documents with inbound links, stage and last use (null where never used)."""
    d = documents.select("id", "uri", "title", "source_type", F.get_json_object("meta", "$.status").alias("status")).join(graph.inbound_counts(edges), "id", "left")
    stage = F.when(F.col("status").isNull(), CURRENT).otherwise(lifecycle(F.col("status"), F.col("inbound")))
    d = d.select("id", "uri", "title", "source_type", F.coalesce("inbound", F.lit(0)).cast("long").alias("inbound"), stage.cast("int").alias("lifecycle"))
    used = usage.select(F.col("doc_id").alias("id"), F.col("last_used").cast("long")) if usage is not None else None
    return d.join(used, "id", "left") if used is not None else d.withColumn("last_used", F.lit(None).cast("long"))


def digest(stamps: DataFrame) -> str:
    """A name for a set of (uri, stamp): their number and the sum of their hashes, whatever their order."""
    r = stamps.agg(F.count("*").alias("n"), F.sum(F.xxhash64("uri", "stamp").cast("decimal(38,0)")).alias("h")).first()
    return f"{r['n']}-{r['h']}"


def publish(spark: SparkSession, path: str, documents: DataFrame, chunks: DataFrame, model: str = "hash@64+none", dims: int = 64, stemmed: bool = True, stamps: DataFrame | None = None, usage: DataFrame | None = None, force: bool = False, two_phases: bool = False) -> Pack:
    """The pack of documents and chunks as the newest version below path.

    If the newest version was made from the same stamps (uri, stamp), nothing is built. Otherwise all tables go to a fresh folder and one manifest publishes them; a
    failure before that leaves the live version as it is. With two_phases (T4) texts are published first and vectors in a version of their own, so words can be searched while
    vectors are laid out. Versions older than the last KEEP lose their folders.
    """
    versions = Versions(spark, f"{path}/manifests")
    now = versions.read()
    mark = digest(stamps) if stamps is not None else None
    if not force and now is not None and mark is not None and (now["digest"], now["model_id"], now["dims"], now["stemmed"], now["format"]) == (mark, model, dims, stemmed, FORMAT):
        return Pack(spark, path, now)
    number = (now["version"] if now else 0) + 1
    folder = f"v{number:010d}-{uuid.uuid4().hex}"
    base = f"{path}/{folder}"
    numbered(chunks).write.parquet(f"{base}/rows")
    rows = spark.read.schema("row long, id string, text string").parquet(f"{base}/rows")
    n = rows.select("row").count()
    buckets = int(min(MOST_BUCKETS, max(4, n // ROWS_PER_BUCKET)))
    index = bm25.build(rows.select("row", "text"), f"{base}/postings", "row", stemmed=stemmed, buckets=buckets)
    graph.resolved_links(documents).write.parquet(f"{base}/edges")
    edges = spark.read.schema("src string, dst string, kind string").parquet(f"{base}/edges")
    document_rows(documents, edges, usage).write.parquet(f"{base}/documents")
    top = spark.read.schema("inbound long").parquet(f"{base}/documents").agg(F.coalesce(F.max("inbound"), F.lit(0))).first()[0]
    (stamps if stamps is not None else spark.createDataFrame([], "uri string, stamp string")).select("uri", "stamp").write.parquet(f"{base}/stamps")
    manifest = {
        "version": number, "folder": folder, "format": FORMAT, "model_id": model, "dims": dims, "stemmed": stemmed, "analyzer": ANALYZER if stemmed else f"{ANALYZER}-unstemmed", "rows": n, "all_terms": index.all_terms, "buckets": buckets,
        "max_inbound": top, "digest": mark, "meta": (now or {}).get("meta", {}), "vectors": None, "cells": None, "rows_with_vectors": 0,
    }
    if two_phases:
        versions.publish(manifest)
        manifest["version"] = number + 1
    manifest.update(_vectors(spark, path, folder, knn.usable(chunks, "id", "embedding", dims), dims))
    versions.publish(manifest)
    swept(spark, path)
    return Pack(spark, path, manifest)


def _vectors(spark: SparkSession, path: str, folder: str, vectors: DataFrame, dims: int) -> dict:
    """Vectors written by cell, in a folder of their own below the version's; what the manifest says of them."""
    name = f"{folder}/vectors-{uuid.uuid4().hex}"
    flat = f"{path}/{name}-flat"
    vectors.write.parquet(flat)
    flat_rows = spark.read.schema("id string, vec array<float>").parquet(flat)
    centres = knn.fit_cells(flat_rows, dims)
    # cells are ranged into files, in order; a cell of any size is split by the rebalancing
    knn.placed(flat_rows, centres, dims).hint("rebalance", "cell").sortWithinPartitions("cell", "id").write.parquet(f"{path}/{name}")
    stored = spark.read.schema("cell int").parquet(f"{path}/{name}")
    sizes = {r["cell"]: r["n"] for r in stored.groupBy("cell").agg(F.count("*").alias("n")).collect()}  # a row a cell
    Versions(spark, path).remove(flat)
    return {"vectors": name, "cells": {"centres": np.round(centres, 7).tolist(), "sizes": [sizes.get(i, 0) for i in range(len(centres))]}, "rows_with_vectors": sum(sizes.values())}


def swept(spark: SparkSession, path: str, keep: int = KEEP) -> list[int]:
    """Drops all but the newest `keep` versions; folders that a kept version names stay. The numbers that were dropped."""
    v = Versions(spark, f"{path}/manifests")
    numbers = v.numbers()
    gone, kept = numbers[: -max(keep, 1)], numbers[-max(keep, 1) :]
    live = {v.read(n)["folder"] for n in kept}
    for n in gone:
        m = v.read(n)
        v.drop(n)
        if m["folder"] not in live:
            v.remove(f"{path}/{m['folder']}")
    return gone


def republished(pack: Pack, **changes) -> Pack:
    """The pack as a new version whose manifest differs in `changes`."""
    m = {**pack.manifest, **changes, "version": pack.manifest["version"] + 1}
    Versions(pack.spark, f"{pack.path}/manifests").publish(m)
    return Pack(pack.spark, pack.path, m)


def set_meta(pack: Pack, key: str, value: str | None) -> Pack:
    """K7: the pack with one key-value pair set, or removed if the value is None."""
    meta = {k: v for k, v in pack.manifest["meta"].items() if k != key}
    return republished(pack, meta=meta if value is None else {**meta, key: value})


def with_vectors(pack: Pack, vectors: DataFrame) -> Pack:
    """The pack with other vectors (id, vec), the texts untouched."""
    return republished(pack, **_vectors(pack.spark, pack.path, pack.manifest["folder"], vectors.select("id", "vec"), pack.dims))


def compacted(pack: Pack, path: str, gone: DataFrame | None = None) -> Pack:
    """K8: a pack of the same rows at another path, without documents named in gone (id); vectors and stamps are copied, nothing is embedded or read anew."""
    spark = pack.spark
    docs, chunks, edges, stamps, vectors = pack.documents, pack.chunks, pack.edges, pack.stamps, pack.vectors.select("id", "vec")
    if gone is not None:
        out = gone.select(F.col("id").alias("doc")).distinct()
        stamps = stamps.join(docs.join(out.withColumnRenamed("doc", "id"), "id", "left_semi").select("uri"), "uri", "left_anti")
        docs, chunks = docs.join(out.withColumnRenamed("doc", "id"), "id", "left_anti"), chunks.join(out, "doc", "left_anti")
        edges = edges.join(out.withColumnRenamed("doc", "src"), "src", "left_anti").join(out.withColumnRenamed("doc", "dst"), "dst", "left_anti")
        vectors = vectors.withColumn("doc", F.substring_index("id", ":", 1)).join(out, "doc", "left_anti").select("id", "vec")
    folder = f"v{1:010d}-{uuid.uuid4().hex}"
    base = f"{path}/{folder}"
    numbered(chunks).write.parquet(f"{base}/rows")
    rows = spark.read.schema("row long, id string, text string").parquet(f"{base}/rows")
    index = bm25.build(rows.select("row", "text"), f"{base}/postings", "row", stemmed=pack.stemmed, buckets=pack.manifest["buckets"])
    for name, df in (("edges", edges), ("documents", docs), ("stamps", stamps)):
        df.write.parquet(f"{base}/{name}")
    m = {**pack.manifest, "version": 1, "folder": folder, "rows": index.rows, "all_terms": index.all_terms, "digest": digest(stamps), **_vectors(spark, path, folder, vectors, pack.dims)}
    Versions(spark, f"{path}/manifests").publish(m)
    return Pack(spark, path, m)

