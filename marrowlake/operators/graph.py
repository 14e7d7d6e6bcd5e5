"""Links between documents and neighbours of chunks."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from marrowlake.functions.text import link_key, uri_stem
from marrowlake.functions.weights import CURRENT, lifecycle
from marrowlake.operators.fusion import interleaved


def document_keys(documents: DataFrame) -> DataFrame:
    """(key, id): what a document can be called: its title, the stem of its uri, the id in its metadata. Blank names are none."""
    names = F.array(link_key(F.col("title")), uri_stem(F.col("uri")), link_key(F.get_json_object("meta", "$.id")))
    return documents.select("id", F.explode(F.array_distinct(F.array_compact(names))).alias("key")).filter("key <> ''").select("key", "id")


def unique_keys(documents: DataFrame) -> DataFrame:
    """(key, id) of names that belong to one document only; an ambiguous name leads nowhere. Partial aggregation copes with hot names."""
    return document_keys(documents).groupBy("key").agg(F.min("id").alias("id"), F.max("id").alias("last")).filter("id = last").select("key", "id")


def resolved_links(documents: DataFrame) -> DataFrame:
    """Distinct edges (src, dst, kind): wikilinks of the text, supersedes and superseded-by of the metadata (J4). No self links."""
    wiki = documents.select(F.col("id").alias("src"), F.explode("links").alias("k")).withColumn("kind", F.lit("wikilink"))
    relations = [documents.select(F.col("id").alias("src"), F.get_json_object("meta", f"$.{m}").alias("k")).filter("k is not null").withColumn("kind", F.lit(kind)) for m, kind in (("supersedes", "supersedes"), ("superseded_by", "superseded-by"))]
    named = wiki.unionByName(relations[0]).unionByName(relations[1]).withColumn("key", link_key(F.col("k"))).filter("key <> ''")
    return named.join(unique_keys(documents).withColumnRenamed("id", "dst"), "key").filter("src <> dst").select("src", "dst", "kind").distinct()


def ambiguous_titles(documents: DataFrame) -> DataFrame:
    """(key, documents): titles and stems that several documents share."""
    names = F.array(link_key(F.col("title")), uri_stem(F.col("uri")))
    keys = documents.select("id", F.explode(F.array_distinct(F.array_compact(names))).alias("key")).filter("key <> ''")
    return keys.groupBy("key").agg(F.count("*").alias("documents")).filter("documents > 1")


def inbound_counts(edges: DataFrame) -> DataFrame:
    """(id, inbound): wikilinks that lead to a document (A4); only documents with one."""
    return edges.filter("kind = 'wikilink'").groupBy(F.col("dst").alias("id")).agg(F.count("*").alias("inbound"))


def lifecycles(documents: DataFrame, inbound: DataFrame) -> DataFrame:
    """(id, lifecycle) of documents that are not current."""
    d = documents.select("id", F.get_json_object("meta", "$.status").alias("status")).filter("status is not null").join(inbound, "id", "left")
    return d.select("id", lifecycle(F.col("status"), F.col("inbound")).alias("lifecycle")).filter(F.col("lifecycle") != CURRENT)


def adjacent(seeds: DataFrame, chunks: DataFrame, hops: int, most: int) -> DataFrame:
    """(query_id, chunk_id, doc, ord, position): chunks up to hops before or behind a seed in its document.

    seeds: query_id, chunk_id, doc, ord. Ordinals are dense, so a path of 1 .. hops steps is a difference of ordinals; each seed names its neighbours
    and one equi join on (doc, ord) fetches them. Seeds are left out; at most `most` a query, by document and ordinal.
    """
    steps = [s for d in range(1, hops + 1) for s in (-d, d)]
    near = seeds.select("query_id", "doc", F.explode(F.array(*((F.col("ord") + s) for s in steps))).alias("ord")).distinct()
    got = near.join(chunks.select(F.col("id").alias("chunk_id"), "doc", "ord"), ["doc", "ord"]).join(seeds.select("query_id", "chunk_id"), ["query_id", "chunk_id"], "left_anti")
    w = Window.partitionBy("query_id").orderBy("doc", "ord")
    return got.withColumn("position", F.row_number().over(w)).filter(F.col("position") <= most).select("query_id", "chunk_id", "doc", "ord", "position")


def linked(seeds: DataFrame, chunks: DataFrame, edges: DataFrame, hops: int, most: int) -> DataFrame:
    """The first chunk of documents that a seed's document leads to over 1 .. hops wikilinks or superseded-by edges."""
    follow = edges.filter(F.col("kind").isin("wikilink", "superseded-by")).select("src", "dst").distinct()
    at = seeds.select("query_id", "doc").distinct()
    reached = None
    for _ in range(max(1, hops)):
        at = at.join(follow, at.doc == follow.src).select("query_id", F.col("dst").alias("doc")).distinct()
        reached = at if reached is None else reached.unionByName(at)
    first = chunks.filter("ord = 0").select(F.col("id").alias("chunk_id"), "doc", "ord")
    got = reached.distinct().join(first, "doc").join(seeds.select("query_id", "chunk_id"), ["query_id", "chunk_id"], "left_anti")
    w = Window.partitionBy("query_id").orderBy("doc", "ord")
    return got.withColumn("position", F.row_number().over(w)).filter(F.col("position") <= most).select("query_id", "chunk_id", "doc", "ord", "position")


def expanded(seeds: DataFrame, chunks: DataFrame, edges: DataFrame, hops: int, most: int) -> DataFrame:
    """(query_id, chunk_id, position): adjacent and linked chunks by turns."""
    keep = ["query_id", "chunk_id", "position"]
    return interleaved(adjacent(seeds, chunks, hops, most).select(*keep), linked(seeds, chunks, edges, hops, most).select(*keep), most)


def related(documents: DataFrame, chunks: DataFrame, edges: DataFrame, hops: int = 2, most: int = 10) -> DataFrame:
    """expanded from the first chunk of every given document; query_id is its id."""
    first = chunks.filter("ord = 0").select(F.col("id").alias("chunk_id"), "doc", "ord")
    return expanded(documents.select(F.col("id").alias("doc")).join(first, "doc").withColumn("query_id", F.col("doc")), chunks, edges, hops, most)


def document_nodes(documents: DataFrame, chunks: DataFrame, edges: DataFrame) -> DataFrame:
    """(id, uri, title, source_type, chunks, inbound, lifecycle), counts 0 where there are none."""
    inbound = inbound_counts(edges)
    counts = chunks.groupBy(F.col("doc").alias("id")).agg(F.count("*").alias("chunks"))
    d = documents.select("id", "uri", "title", "source_type").join(counts, "id", "left").join(inbound, "id", "left").join(lifecycles(documents, inbound), "id", "left")
    return d.select("id", "uri", "title", "source_type", F.coalesce("chunks", F.lit(0)).alias("chunks"), F.coalesce("inbound", F.lit(0)).alias("inbound"), F.coalesce("lifecycle", F.lit(CURRENT)).alias("lifecycle"))


def document_details(documents: DataFrame, chunks: DataFrame, edges: DataFrame) -> DataFrame:
    """A10: document_nodes with chunk_ids, the document's chunks in order; empty where it has none. A list is one document's."""
    ids = chunks.groupBy(F.col("doc").alias("id")).agg(F.transform(F.array_sort(F.collect_list(F.struct("ord", F.col("id").alias("c")))), lambda x: x["c"]).alias("chunk_ids"))
    return document_nodes(documents, chunks, edges).join(ids, "id", "left").withColumn("chunk_ids", F.coalesce("chunk_ids", F.array().cast("array<string>")))


def all_edges(documents: DataFrame, chunks: DataFrame, edges: DataFrame) -> DataFrame:
    """Distinct (src, dst, kind): links, tags, mentioned projects, source domains and the order of chunks."""
    tag = F.lower(F.trim(F.regexp_replace(F.trim("t"), "^#+", "")))
    tagged = documents.select("id", F.explode("tags").alias("t")).select(F.col("id").alias("src"), tag.alias("dst"), F.lit("tagged").alias("kind")).filter("dst <> ''")
    mention = documents.select(F.col("id").alias("src"), F.concat(F.lit("project:"), F.get_json_object("meta", "$.project")).alias("dst"), F.lit("mentions").alias("kind")).filter("dst is not null and dst <> 'project:'")
    derived = documents.select(F.col("id").alias("src"), F.coalesce(F.get_json_object("meta", "$.domain"), F.parse_url("uri", F.lit("HOST"))).alias("dst"), F.lit("derived-from").alias("kind")).filter("dst is not null and dst <> ''")
    return edges.select("src", "dst", "kind").unionByName(tagged).unionByName(mention).unionByName(derived).unionByName(next_chunks(chunks)).distinct()


def next_chunks(chunks: DataFrame) -> DataFrame:
    """Edges from each chunk to the next of its document (K2, W3). Ordinals are dense, so it is an equi join, not a sort of the document."""
    a = chunks.select(F.col("id").alias("src"), "doc", (F.col("ord") + 1).alias("ord"))
    return a.join(chunks.select(F.col("id").alias("dst"), "doc", "ord"), ["doc", "ord"]).select("src", "dst", F.lit("next-chunk").alias("kind"))


def view(nodes: DataFrame, edges: DataFrame, hidden: str = "transcript") -> tuple[DataFrame, DataFrame]:
    """Nodes without a source type, and the edges both ends of which are left; tags and entities count as nodes."""
    docs = nodes.filter(F.col("source_type") != hidden).select("id", F.lit("document").alias("type"))
    other = edges.filter("kind in ('tagged', 'mentions')").select(F.col("dst").alias("id"), F.when(F.col("kind") == "tagged", "tag").otherwise("entity").alias("type")).distinct()
    shown = docs.unionByName(other)
    ids = shown.select("id").distinct()
    return shown, edges.filter("kind <> 'next-chunk'").join(ids.withColumnRenamed("id", "src"), "src", "left_semi").join(ids.withColumnRenamed("id", "dst"), "dst", "left_semi")


def incident(nodes: DataFrame, edges: DataFrame) -> DataFrame:
    """Distinct (id, direction, title) of linked documents, mentions and tags left out."""
    e = edges.filter("kind not in ('mentions', 'tagged', 'next-chunk', 'derived-from')")
    t = nodes.select(F.col("id").alias("other"), "title")
    out = e.select(F.col("src").alias("id"), F.lit("out").alias("direction"), F.col("dst").alias("other"))
    into = e.select(F.col("dst").alias("id"), F.lit("in").alias("direction"), F.col("src").alias("other"))
    return out.unionByName(into).join(t, "other").select("id", "direction", "title").distinct()
