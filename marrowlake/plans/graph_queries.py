"""Queries of links, neighbours and statistics."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from marrowlake.functions.identity import model_id
from marrowlake.operators import graph, index
from marrowlake.plans import fragments as q
from marrowlake.plans.retrieval_queries import pack_of, query_set
from marrowlake.runtime import cut, table

Spark = SparkSession


def linked_documents(spark: Spark, d: str) -> tuple[DataFrame, DataFrame]:
    """Documents whose links also name another document's title, and edges that say it is superseded by or supersedes that one.

    The tables' own links name no document; the rule for the other one is (7 doc_id + 3) mod count + 1.
    """
    docs = table(spark, d, "documents")
    n = docs.count()
    to = docs.select((F.col("doc_id")).alias("to"), F.col("id").alias("other"), F.col("title").alias("other_title"))
    both = docs.withColumn("to", F.pmod(F.col("doc_id") * 7 + 3, F.lit(max(n, 1))) + 1).join(to, "to", "left")
    made = both.filter("doc_id % 3 > 0 and other is not null and other <> id").select(F.col("id").alias("src"), F.col("other").alias("dst"), F.when(F.col("doc_id") % 3 == 1, "superseded-by").otherwise("supersedes").alias("kind"))
    links = F.concat(F.coalesce("links", F.array().cast("array<string>")), F.array_compact(F.array("other_title")))
    return both.withColumn("links", links).drop("to", "other", "other_title"), made


def _frames(spark: Spark, d: str) -> tuple[DataFrame, DataFrame, DataFrame]:
    docs, made = linked_documents(spark, d)
    return docs, pack_of(spark, d).chunks, cut(graph.resolved_links(docs).unionByName(made).distinct())


def resolve_links(spark: Spark, d: str) -> DataFrame:
    return _frames(spark, d)[2]


def ambiguous_titles(spark: Spark, d: str) -> DataFrame:
    return graph.ambiguous_titles(table(spark, d, "documents"))


def inbound_links(spark: Spark, d: str) -> DataFrame:
    return graph.inbound_counts(_frames(spark, d)[2])


def max_inbound(spark: Spark, d: str) -> DataFrame:
    """A5."""
    return inbound_links(spark, d).agg(F.coalesce(F.max("inbound"), F.lit(0)).alias("max_inbound"))


def lifecycles(spark: Spark, d: str) -> DataFrame:
    docs, _, edges = _frames(spark, d)
    return graph.lifecycles(docs, graph.inbound_counts(edges))


def _seeds(spark: Spark, d: str) -> DataFrame:
    """The first chunk of every document of the query set."""
    p = pack_of(spark, d)
    s = query_set(spark, d, p).select("query_id").join(table(spark, d, "documents").select(F.col("doc_id").alias("query_id"), F.col("id").alias("doc")), "query_id")
    return cut(s.join(p.chunks.filter("ord = 0").select(F.col("id").alias("chunk_id"), "doc", "ord"), "doc").select("query_id", "chunk_id", "doc", "ord"))


def expand_adjacent(spark: Spark, d: str) -> DataFrame:
    return graph.adjacent(_seeds(spark, d), _frames(spark, d)[1], 2, 12)


def expand_linked(spark: Spark, d: str) -> DataFrame:
    _, chunks, edges = _frames(spark, d)
    return graph.linked(_seeds(spark, d), chunks, edges, 2, 12)


def expand_interleaved(spark: Spark, d: str) -> DataFrame:
    _, chunks, edges = _frames(spark, d)
    return graph.expanded(_seeds(spark, d), chunks, edges, 2, 12)


def related_documents(spark: Spark, d: str) -> DataFrame:
    """J13 for every document."""
    docs, chunks, edges = _frames(spark, d)
    return graph.related(docs, chunks, edges)


def graph_nodes(spark: Spark, d: str) -> DataFrame:
    return graph.document_nodes(*_frames(spark, d))


def graph_edges(spark: Spark, d: str) -> DataFrame:
    return graph.all_edges(*_frames(spark, d))


def graph_view(spark: Spark, d: str) -> DataFrame:
    """Edges shown, by kind."""
    docs, chunks, edges = _frames(spark, d)
    return graph.view(graph.document_nodes(docs, chunks, edges), graph.all_edges(docs, chunks, edges))[1].groupBy("kind").agg(F.count("*").alias("edges"))


def graph_neighbours(spark: Spark, d: str) -> DataFrame:
    """P7, J19."""
    docs, chunks, edges = _frames(spark, d)
    return graph.incident(docs.select("id", "title"), graph.all_edges(docs, chunks, edges))


def counts_by_source(spark: Spark, d: str) -> DataFrame:
    """A7, with rows for source types that have no document."""
    t = table(spark, d, "documents").groupBy("source_type").agg(F.count("*").alias("documents"))
    every = spark.createDataFrame([(s,) for s in ("markdown", "pdf", "web", "transcript", "memory", "audio")], "source_type string")
    return every.join(t, "source_type", "left").select("source_type", F.coalesce("documents", F.lit(0)).alias("documents"))


def counts_rollup(spark: Spark, d: str) -> DataFrame:
    """A7 as a rollup over source type and language."""
    t = table(spark, d, "documents").select("source_type", F.lower(F.trim("lang")).alias("lang"))
    return t.rollup("source_type", "lang").agg(F.count("*").alias("documents"), F.grouping_id().cast("int").alias("level"))


def sessions_by_agent(spark: Spark, d: str) -> DataFrame:
    """Sessions by the agent that the uri's scheme names (S20), zero for agents without any."""
    agent = F.when(F.col("uri").startswith("claude-session://"), "claude").when(F.col("uri").startswith("codex-session://"), "codex")
    t = table(spark, d, "documents").select(agent.alias("agent")).filter("agent is not null").groupBy("agent").agg(F.count("*").alias("sessions"))
    return spark.createDataFrame([("claude",), ("codex",)], "agent string").join(t, "agent", "left").select("agent", F.coalesce("sessions", F.lit(0)).alias("sessions"))


def status_snapshot(spark: Spark, d: str) -> DataFrame:
    """Totals in one row; skipped are the uris that the newest run could not read."""
    c = pack_of(spark, d)
    n = table(spark, d, "documents").agg(F.count("*").alias("documents"))
    m = c.chunks.select("id").join(c.vectors.select("id", F.lit(1).alias("v")), "id", "left").agg(F.count("*").alias("chunks"), F.count_if(F.col("v").isNull()).alias("without_vector"))
    scans = table(spark, d, "scans")
    last = scans.join(scans.agg(F.max("run_id").alias("run_id")), "run_id", "left_semi").filter("uri is not null").groupBy("uri").agg(F.max(F.struct("seen_at", "content_hash")).alias("s"))
    skipped = last.agg(F.count_if(F.col("s.content_hash").isNull()).alias("skipped"))
    return n.crossJoin(m).crossJoin(skipped).withColumn("model", F.lit(model_id("hash", 64, "none")))  # single rows


def live_bytes(spark: Spark, d: str) -> DataFrame:
    """A12 over the chunk rows as they are."""
    return index.live_bytes(table(spark, d, "chunks").select("id", "text", "heading_path", "embedding"))


QUERIES = {
    f.__name__: f
    for f in (
        resolve_links, ambiguous_titles, inbound_links, max_inbound, lifecycles, expand_adjacent, expand_linked, expand_interleaved, related_documents, graph_nodes, graph_edges, graph_view,
        graph_neighbours, counts_by_source, counts_rollup, sessions_by_agent, status_snapshot, live_bytes,
    )
}

_SEEDS = f"{q.QUERIES}, seeds AS (SELECT query_id, o.id AS chunk_id, o.doc, o.ord FROM q JOIN once o ON o.doc = qdoc AND o.ord = 0)"
_ADJ = "adj AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY doc, ord) p FROM (SELECT DISTINCT s.query_id, o.id, o.doc, o.ord FROM seeds s JOIN once o ON o.doc = s.doc AND abs(o.ord - s.ord) BETWEEN 1 AND 2 WHERE NOT EXISTS (SELECT 1 FROM seeds z WHERE z.query_id = s.query_id AND z.chunk_id = o.id)) QUALIFY p <= {n})"
_LNK = """foll AS (SELECT DISTINCT src, dst FROM edges WHERE kind IN ('wikilink', 'superseded-by')),
 reach AS (SELECT s.query_id, f.dst doc FROM seeds s JOIN foll f ON f.src = s.doc UNION SELECT s.query_id, g.dst FROM seeds s JOIN foll f ON f.src = s.doc JOIN foll g ON g.src = f.dst),
 lnk AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY doc, ord) p FROM (SELECT r.query_id, o.id, o.doc, o.ord FROM reach r JOIN once o ON o.doc = r.doc AND o.ord = 0 WHERE NOT EXISTS (SELECT 1 FROM seeds z WHERE z.query_id = r.query_id AND z.chunk_id = o.id)) QUALIFY p <= {n})"""
_MIX = "mixed AS (SELECT query_id, id, min((p, l)) k FROM (SELECT query_id, id, p, 0 l FROM adj UNION ALL SELECT query_id, id, p, 1 FROM lnk) GROUP BY 1, 2) SELECT query_id, id AS chunk_id, CAST(row_number() OVER (PARTITION BY query_id ORDER BY k) AS INTEGER) AS position FROM mixed QUALIFY position <= {n}"
_ALL = f"""{q.ONCE}, {q.LINKED_EDGES}, alle AS (SELECT src, dst, kind FROM edges
 UNION SELECT id, lower(trim(regexp_replace(trim(t), '^#+', ''))), 'tagged' FROM (SELECT id, unnest(tags) t FROM documents) WHERE lower(trim(regexp_replace(trim(t), '^#+', ''))) <> ''
 UNION SELECT id, 'project:' || json_extract_string(meta, '$.project'), 'mentions' FROM documents WHERE json_extract_string(meta, '$.project') <> ''
 UNION SELECT id, coalesce(json_extract_string(meta, '$.domain'), h), 'derived-from' FROM (SELECT *, nullif(regexp_extract(uri, '^[a-z-]+://([^/]+)', 1), '') h FROM documents) WHERE coalesce(json_extract_string(meta, '$.domain'), h) <> ''
 UNION SELECT a.id, b.id, 'next-chunk' FROM once a JOIN once b ON a.doc = b.doc AND b.ord = a.ord + 1)"""
SQL = {
    "resolve_links": f"WITH {q.LINKED_EDGES} SELECT * FROM edges",
    "ambiguous_titles": f"SELECT key, count(*) documents FROM (SELECT DISTINCT id, k AS key FROM (SELECT id, unnest([{q.TITLE_KEY}, {q.STEM_KEY}]) k FROM documents) WHERE k IS NOT NULL) GROUP BY 1 HAVING count(*) > 1",
    "inbound_links": f"WITH {q.LINKED_EDGES} SELECT * FROM inb",
    "max_inbound": f"WITH {q.LINKED_EDGES} SELECT coalesce(max(inbound), 0) max_inbound FROM inb",
    "lifecycles": f"WITH {q.LINKED_EDGES}, {q.LIFECYCLES} SELECT id, CAST(lifecycle AS INTEGER) lifecycle FROM life WHERE lifecycle <> 0",
    "expand_adjacent": f"WITH {q.ONCE}, {_SEEDS}, {_ADJ.format(n=12)} SELECT query_id, id AS chunk_id, doc, ord, CAST(p AS INTEGER) AS position FROM adj",
    "expand_linked": f"WITH {q.ONCE}, {q.LINKED_EDGES}, {_SEEDS}, {_LNK.format(n=12)} SELECT query_id, id AS chunk_id, doc, ord, CAST(p AS INTEGER) AS position FROM lnk",
    "expand_interleaved": f"WITH {q.ONCE}, {q.LINKED_EDGES}, {_SEEDS}, {_ADJ.format(n=12)}, {_LNK.format(n=12)}, {_MIX.format(n=12)}",
    "related_documents": f"WITH {q.ONCE}, {q.LINKED_EDGES}, seeds AS (SELECT o.doc AS query_id, o.id AS chunk_id, o.doc, o.ord FROM once o JOIN documents d ON d.id = o.doc WHERE o.ord = 0), {_ADJ.format(n=10)}, {_LNK.format(n=10)}, {_MIX.format(n=10)}",
    "graph_nodes": f"""WITH {q.ONCE}, {q.LINKED_EDGES}, {q.LIFECYCLES} SELECT d.id, uri, title, source_type, coalesce(n, 0) chunks, coalesce(inbound, 0) inbound, CAST(lifecycle AS INTEGER) lifecycle
 FROM documents d LEFT JOIN (SELECT doc, count(*) n FROM once GROUP BY 1) c ON c.doc = d.id LEFT JOIN inb ON inb.id = d.id JOIN life ON life.id = d.id""",
    "graph_edges": f"WITH {_ALL} SELECT * FROM alle",
    "graph_view": f"WITH {_ALL}, shown AS (SELECT id FROM documents WHERE source_type <> 'transcript' UNION SELECT dst FROM alle WHERE kind IN ('tagged', 'mentions')) SELECT kind, count(*) edges FROM alle WHERE kind <> 'next-chunk' AND src IN (SELECT id FROM shown) AND dst IN (SELECT id FROM shown) GROUP BY 1",
    "graph_neighbours": f"WITH {q.LINKED_EDGES} SELECT DISTINCT src AS id, 'out' AS direction, title FROM edges JOIN documents d ON d.id = dst UNION SELECT DISTINCT dst, 'in', title FROM edges JOIN documents d ON d.id = src",
    "counts_by_source": "SELECT s AS source_type, count(d.id) documents FROM (VALUES ('markdown'), ('pdf'), ('web'), ('transcript'), ('memory'), ('audio')) v(s) LEFT JOIN documents d ON source_type = s GROUP BY 1",
    "counts_rollup": "SELECT source_type, l AS lang, count(*) documents, CAST(grouping(source_type, l) AS INTEGER) AS level FROM (SELECT source_type, lower(trim(lang)) l FROM documents) GROUP BY ROLLUP (source_type, l)",
    "sessions_by_agent": "SELECT a AS agent, count(id) sessions FROM (VALUES ('claude'), ('codex')) v(a) LEFT JOIN documents ON starts_with(uri, a || '-session://') GROUP BY 1",
    "status_snapshot": "WITH " + q.ONCE + ", " + q.VEC + " SELECT (SELECT count(*) FROM documents) documents, count(*) chunks, count(*) FILTER (WHERE v IS NULL) without_vector, (SELECT count(*) FROM (SELECT uri, max({'t': seen_at, 'h': content_hash}) s FROM scans WHERE run_id = (SELECT max(run_id) FROM scans) AND uri IS NOT NULL GROUP BY 1) WHERE s.h IS NULL) skipped, 'hash@64+none' AS model FROM once LEFT JOIN vec USING (id)",
    "live_bytes": "SELECT CAST(sum(strlen(id) + coalesce(strlen(text), 0) + coalesce(strlen(heading_path), 0) + 4 * coalesce(len(embedding), 0)) AS BIGINT) AS bytes FROM chunks",
}
