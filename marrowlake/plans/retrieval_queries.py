"""Queries of search."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from marrowlake.functions import weights
from marrowlake.functions.text import rendered_entry, rendered_hits
from marrowlake.operators import bm25, budget, fusion, knn, usage
from marrowlake.plans import fragments as q
from marrowlake.plans import retrieve
from marrowlake.plans.profiles import SURFACES, TIERS
from marrowlake.operators.pack import Pack, publish
from marrowlake.runtime import cut, scratch_path, table

Spark = SparkSession
#: The time that decay is counted to: 2026-06-01 UTC.
NOW = 1_780_272_000


_PACKS: dict[tuple[str, str, bool], str] = {}


def pack_of(spark: Spark, d: str, stemmed: bool = True) -> Pack:
    """The pack of the tables below d, published in the shared folder when first asked for and opened by path after that.

    The stamps of the tables' files are the sources' stamps, so a table that changed is indexed anew.
    """
    documents, chunks = table(spark, d, "documents"), table(spark, d, "chunks")
    path = _PACKS.setdefault((spark.sparkContext.applicationId, d, stemmed), scratch_path(spark, "pack"))
    return publish(spark, path, documents, chunks, stemmed=stemmed, stamps=file_stamps(spark, [*documents.inputFiles(), *chunks.inputFiles()]))


def file_stamps(spark: Spark, files: list[str]) -> DataFrame:
    """(uri, stamp) of the files of a table, by their time and length."""
    path = spark._jvm.org.apache.hadoop.fs.Path
    rows = []
    for f in sorted(set(files)):
        s = path(f).getFileSystem(spark._jsc.hadoopConfiguration()).getFileStatus(path(f))
        rows.append((f, f"{s.getModificationTime()}:{s.getLen()}"))
    return spark.createDataFrame(rows, "uri string, stamp string")


def query_set(spark: Spark, d: str, pack: Pack) -> DataFrame:
    """The stated query set: titles of the documents whose doc_id is divisible by 100, with the vector of their first chunk."""
    t = table(spark, d, "documents").filter("doc_id % 100 = 0 and title is not null").select(F.col("doc_id").alias("query_id"), F.concat("id", F.lit(":0")).alias("id"), F.col("title").alias("text"))
    return cut(t.join(pack.vectors, "id", "left").select("query_id", "text", "vec"))


def bm25_postings(spark: Spark, d: str) -> DataFrame:
    """A1: the stored index, scored."""
    return pack_of(spark, d).postings.select("term", "id", "tf", F.round("impact", 6).alias("impact"))


def bm25_search(spark: Spark, d: str) -> DataFrame:
    p = pack_of(spark, d)
    return retrieve.keyword_hits(query_set(spark, d, p), p, 20).select("query_id", "id", F.round("score", 6).alias("score"), "position")


def bm25_unstemmed(spark: Spark, d: str) -> DataFrame:
    """A2 without the stemmer, over a pack of its own."""
    p = pack_of(spark, d, stemmed=False)
    return retrieve.keyword_hits(query_set(spark, d, p), p, 20).select("query_id", "id", F.round("score", 6).alias("score"), "position")


def knn_exact(spark: Spark, d: str) -> DataFrame:
    p = pack_of(spark, d)
    near = knn.knn(query_set(spark, d, p).filter("vec is not null"), p.vectors, 10)
    return near.select(F.col("query_id").cast("long").alias("query_id"), "id", F.round("relevance", 6).alias("relevance"), "position")


def knn_embeddings(spark: Spark, d: str) -> DataFrame:
    """J9 on the embeddings table, queries with vec_id divisible by 100; J14: with the labels' near duplicates."""
    e = table(spark, d, "embeddings").select(F.col("vec_id").cast("string").alias("id"), F.col("embedding").alias("vec"))
    near = knn.knn(e.filter("cast(id as long) % 100 = 0").withColumnRenamed("id", "query_id"), e, 10)
    return near.select("query_id", "id", F.round("relevance", 6).alias("relevance"), "position")


def near_duplicates(spark: Spark, d: str) -> DataFrame:
    """For the same queries, the nearest other vector of the same label among the 5 nearest of all others, at a relevance of 0.6."""
    e = table(spark, d, "embeddings").select(F.col("vec_id").cast("string").alias("id"), F.col("embedding").alias("vec"), F.col("label").alias("kind"))
    probes = e.filter("cast(id as long) % 100 = 0").withColumnRenamed("id", "query_id")
    return knn.near_duplicate(probes, e, least=0.6).withColumn("relevance", F.round("relevance", 6))


def measured_hits(spark: Spark, d: str) -> DataFrame:
    """Hits measured against the first hit's vector of their query."""
    h = table(spark, d, "hits").select("query_id", F.col("chunk_id").alias("id")).distinct()
    v = pack_of(spark, d).vectors
    lead = h.groupBy("query_id").agg(F.min("id").alias("id")).join(v, "id").select("query_id", "vec")
    return knn.measured(h, lead, v).withColumn("relevance", F.round("relevance", 6))


def _lists(spark: Spark, d: str, tier: int) -> tuple[Pack, DataFrame, DataFrame]:
    p = pack_of(spark, d)
    asked = query_set(spark, d, p)
    return p, asked, retrieve.stage_lists(asked, p, TIERS[tier], exact=True)


def rrf_fusion(spark: Spark, d: str) -> DataFrame:
    _, _, lists = _lists(spark, d, 1)
    return fusion.rrf(lists).select("query_id", "chunk_id", F.round("score", 6).alias("score"), F.round("relevance", 6).alias("relevance"), "position")


def explain_stages(spark: Spark, d: str) -> DataFrame:
    """How many rows each stage gave each query at tier 1."""
    return _lists(spark, d, 1)[2].groupBy("query_id", "stage").agg(F.count("*").alias("hits"), F.max("position").alias("last"))


def weighted_gate(spark: Spark, d: str) -> DataFrame:
    """The pool of tier 1, measured, weighted and gated at 0.66, before any diversifying."""
    p, asked, lists = _lists(spark, d, 1)
    pool = retrieve.hydrated(retrieve.fused_pool(asked, p, lists), p)
    kept = fusion.weight_and_gate(pool, weights.rank_weight(NOW, weights.Weights(), F.lit(0)), SURFACES["hook"][1])
    return kept.select("query_id", "chunk_id", F.round("relevance", 6).alias("relevance"), "position")


def _tier(n: int):
    def run(spark: Spark, d: str) -> DataFrame:
        p = pack_of(spark, d)
        return retrieve.search(query_set(spark, d, p), p, TIERS[n], now=NOW, exact=True).select("query_id", "position", "chunk_id", F.round("relevance", 6).alias("relevance"))

    run.__name__ = f"hybrid_tier{n}"
    run.__doc__ = f"R1 at tier {n}, {TIERS[n].name}, with an exact vector list, so that SQL can say the same."
    return run


def authority_search(spark: Spark, d: str) -> DataFrame:
    """R1 with authority 0.3 and usage decay (M6, M8)."""
    p = pack_of(spark, d)
    used = usage.folded(table(spark, d, "hits").select(F.substring_index("chunk_id", ":", 1).alias("doc_id"), F.unix_timestamp("searched_at").alias("ts")))
    w = weights.Weights(authority=0.3, decay=True)
    return retrieve.search(query_set(spark, d, p), p, TIERS[1], now=NOW, weights=w, usage=used, exact=True).select("query_id", "position", "chunk_id", F.round("relevance", 6).alias("relevance"))


def token_budget(spark: Spark, d: str) -> DataFrame:
    """How much of every query's hits, best relevance first, the prompt's budget takes."""
    p = pack_of(spark, d)
    h = table(spark, d, "hits").groupBy("query_id", "chunk_id").agg(F.max("relevance").alias("relevance"))
    from pyspark.sql import Window

    h = h.withColumn("position", F.row_number().over(Window.partitionBy("query_id").orderBy(F.desc("relevance"), "chunk_id")))
    full = h.join(p.chunks.withColumnRenamed("id", "chunk_id"), "chunk_id").join(p.documents.withColumnRenamed("id", "doc"), "doc")
    e = rendered_entry(F.col("title"), F.col("heading_path"), F.col("page_no"), F.col("uri"), F.col("text"))
    taken = budget.admitted(full.select("query_id", "chunk_id", "position", e.alias("entry")).filter("entry is not null"), SURFACES["hook"][2])
    return taken.select("query_id", "chunk_id", "position", "cut", F.length("shown").alias("shown_chars"))


def injected_context(spark: Spark, d: str) -> DataFrame:
    """The rendered context of every query at tier 1."""
    p = pack_of(spark, d)
    hits = retrieve.search(query_set(spark, d, p), p, TIERS[1], least=0.5, now=NOW, exact=True)
    return rendered_hits(retrieve.injected(hits, SURFACES["hook"][2]))


def mmr_select(spark: Spark, d: str) -> DataFrame:
    """Every query's hits diversified at lambda 0.6."""
    from pyspark.sql import Window

    h = table(spark, d, "hits").groupBy("query_id", "chunk_id").agg(F.max("relevance").alias("relevance"), F.max("doc_id").alias("doc_id"))
    h = h.withColumn("position", F.row_number().over(Window.partitionBy("query_id").orderBy(F.desc("relevance"), "chunk_id")))
    c = pack_of(spark, d).chunks.select(F.col("id").alias("chunk_id"), "text")
    return fusion.mmr(h.join(c, "chunk_id").select("query_id", "chunk_id", "doc_id", "text", "position"), 0.6).select("query_id", "chunk_id", "position")


def usage_fold(spark: Spark, d: str) -> DataFrame:
    """A13, S24 on the event log."""
    e = table(spark, d, "events").select(F.col("user_id").cast("string").alias("doc_id"), F.unix_timestamp("ts").alias("ts"))
    return usage.folded(e)


def usage_decay(spark: Spark, d: str) -> DataFrame:
    """M8 of every user as if a transcript, M9 by the first event."""
    w = weights.Weights(decay=True)
    u = usage_fold(spark, d)
    return u.select("doc_id", F.round(weights.decay_weight(F.lit("transcript"), F.col("last_used"), NOW, w), 6).alias("decay"), F.round(weights.episode_decay(F.col("first_seen"), NOW, w), 6).alias("episode"))


QUERIES = {
    f.__name__: f
    for f in (
        bm25_postings, bm25_search, bm25_unstemmed, knn_exact, knn_embeddings, near_duplicates, measured_hits, rrf_fusion, explain_stages, weighted_gate,
        *(_tier(n) for n in range(5)), authority_search, token_budget, injected_context, mmr_select, usage_fold, usage_decay,
    )
}


def _pool(k: int) -> str:
    return f"""WITH {q.ONCE}, {q.VEC}, {q.QUERIES}, {q.QVEC}, {q.POSTINGS}, {q.knn(k)}, {q.words(k)},
 lists AS (SELECT query_id, id, p, relevance FROM near UNION ALL SELECT query_id, id, p, NULL FROM kw),
 fused AS (SELECT query_id, id, round(sum(1.0 / (60 + p)), 12) score, coalesce(max(relevance), 0.0) relevance FROM lists GROUP BY 1, 2),
 pool AS (SELECT f.query_id, f.id, score, CASE WHEN f.relevance > 0 THEN f.relevance ELSE coalesce({q.REL.replace('cosine', 'c.cosine')}, 0.0) END relevance FROM fused f LEFT JOIN cosq c ON c.query_id = f.query_id AND c.id = f.id),
 {q.EDGES}, {q.LIFECYCLES},
 weighted AS (SELECT query_id, p.id, round(relevance * (CASE WHEN source_type = 'transcript' THEN 0.45 ELSE 1.0 END * CASE WHEN lifecycle = 3 THEN 0.88 ELSE 1.0 END), 12) relevance
  FROM pool p JOIN once o ON o.id = p.id JOIN documents d ON d.id = o.doc JOIN life ON life.id = o.doc)"""


_ENTRY = "chr(10) || '[' || coalesce(title, '') || CASE WHEN coalesce(heading_path, '') <> '' THEN ' > ' || heading_path ELSE '' END || CASE WHEN page_no IS NOT NULL THEN ' p.' || page_no ELSE '' END || '](' || uri || ')' || chr(10) || o.text || chr(10)"
_EMB = "SELECT CAST(a.vec_id AS VARCHAR) query_id, CAST(b.vec_id AS VARCHAR) id, round(list_cosine_similarity(a.embedding::DOUBLE[], b.embedding::DOUBLE[]), 12) cosine, a.label la, b.label lb FROM embeddings a, embeddings b WHERE a.vec_id % 100 = 0"
SQL = {
    "bm25_postings": f"WITH {q.ONCE}, {q.QUERIES}, {q.POSTINGS} SELECT term, id, tf, round(impact, 6) impact FROM postings",
    "bm25_search": f"WITH {q.ONCE}, {q.QUERIES}, {q.POSTINGS}, {q.words(20)} SELECT query_id, id, round(score, 6) score, CAST(p AS INTEGER) AS position FROM kw",
    "bm25_unstemmed": f"WITH {q.ONCE}, {q.QUERIES}, {q.POSTINGS_UNSTEMMED}, {q.words(20)} SELECT query_id, id, round(score, 6) score, CAST(p AS INTEGER) AS position FROM kw",
    "knn_exact": f"WITH {q.VEC}, {q.QUERIES}, {q.QVEC}, {q.knn(10)} SELECT query_id, id, round(relevance, 6) relevance, CAST(p AS INTEGER) AS position FROM near",
    "knn_embeddings": f"SELECT query_id, id, round({q.REL}, 6) relevance, CAST(row_number() OVER (PARTITION BY query_id ORDER BY cosine DESC, id) AS INTEGER) AS position FROM ({_EMB}) QUALIFY position <= 10",
    "near_duplicates": f"SELECT query_id, id, round(relevance, 6) relevance FROM (SELECT *, {q.REL} relevance, row_number() OVER (PARTITION BY query_id ORDER BY cosine DESC, id) p FROM ({_EMB} AND a.vec_id <> b.vec_id) QUALIFY p <= 5) WHERE la = lb AND relevance >= 0.6 QUALIFY row_number() OVER (PARTITION BY query_id ORDER BY p) = 1",
    "measured_hits": f"WITH {q.VEC}, h AS (SELECT DISTINCT query_id, chunk_id id FROM hits), l AS (SELECT query_id, min(id) id FROM h GROUP BY 1), m AS (SELECT h.query_id, h.id, round(list_cosine_similarity(a.v, b.v), 12) cosine FROM h JOIN l ON l.query_id = h.query_id JOIN vec a ON a.id = l.id JOIN vec b ON b.id = h.id) SELECT query_id, id, round({q.REL}, 6) relevance FROM m",
    "rrf_fusion": f"{_pool(20)} SELECT query_id, id AS chunk_id, round(score, 6) score, round(relevance, 6) relevance, CAST(row_number() OVER (PARTITION BY query_id ORDER BY score DESC, id) AS INTEGER) AS position FROM fused",
    "explain_stages": f"{_pool(20)} SELECT query_id, 'vector' AS stage, count(*) hits, CAST(max(p) AS INTEGER) AS last FROM near GROUP BY 1 UNION ALL SELECT query_id, 'keyword', count(*), CAST(max(p) AS INTEGER) FROM kw GROUP BY 1",
    "weighted_gate": f"{_pool(20)} SELECT query_id, id AS chunk_id, round(relevance, 6) relevance, CAST(row_number() OVER (PARTITION BY query_id ORDER BY weighted.relevance DESC, id) AS INTEGER) AS position FROM weighted WHERE weighted.relevance >= 0.66",
    "hybrid_tier0": f"{_pool(5)} SELECT query_id, id AS chunk_id, round(relevance, 6) relevance, CAST(row_number() OVER (PARTITION BY query_id ORDER BY weighted.relevance DESC, id) AS INTEGER) AS position FROM weighted QUALIFY position <= 10",
    "token_budget": f"""WITH {q.ONCE}, h AS (SELECT query_id, chunk_id, max(relevance) r FROM hits GROUP BY 1, 2), e AS (SELECT query_id, chunk_id, row_number() OVER (PARTITION BY query_id ORDER BY r DESC, chunk_id) p, {_ENTRY} entry FROM h JOIN once o ON o.id = chunk_id JOIN documents d ON d.id = o.doc),
 s AS (SELECT *, sum(strlen(entry)) OVER (PARTITION BY query_id ORDER BY p) after FROM e WHERE entry IS NOT NULL), t AS (SELECT *, 6000 - (after - strlen(entry)) room, sum(CASE WHEN after > 6000 THEN 1 ELSE 0 END) OVER (PARTITION BY query_id ORDER BY p) overs FROM s)
 SELECT query_id, chunk_id, CAST(p AS INTEGER) AS position, overs > 0 AS cut, CAST(CASE WHEN overs > 0 THEN least(room, length(entry)) ELSE length(entry) END AS INTEGER) shown_chars FROM t WHERE overs = 0 OR (overs = 1 AND after > 6000 AND room > 200)""",
    "usage_fold": "SELECT CAST(user_id AS VARCHAR) doc_id, CAST(min(floor(epoch(ts))) AS BIGINT) first_seen, CAST(max(floor(epoch(ts))) AS BIGINT) last_used FROM events GROUP BY 1",
    "usage_decay": f"""SELECT doc_id, round(CASE WHEN age > 90 THEN greatest(0.1, pow(0.5, (age - 90) / 100)) ELSE 1.0 END, 6) decay, round(0.85 + 0.15 * pow(0.5, greatest(first, 0) / 30), 6) episode
 FROM (SELECT CAST(user_id AS VARCHAR) doc_id, ({NOW} - max(floor(epoch(ts)))) / 86400.0 age, ({NOW} - min(floor(epoch(ts)))) / 86400.0 AS first FROM events GROUP BY 1)""",
}
_FOUND = "SELECT query_id, position, id AS chunk_id, round(relevance, 6) relevance FROM picked JOIN ordered USING (query_id, id)"
for _n, _t in enumerate(TIERS):
    if _t.mmr < 1:
        SQL[f"hybrid_tier{_n}"] = f"{q.tier(_t.candidates, _t.hops, _t.neighbours, _t.mmr)} {_FOUND}"
_USED = "used AS (SELECT string_split(chunk_id, ':')[1] uid, max(floor(epoch(searched_at))) last_used FROM hits GROUP BY 1),"
_AGE = f"(({NOW} - (SELECT last_used FROM used WHERE uid = o.doc)) / 86400.0)"
SQL["authority_search"] = f"""{q.tier(20, 0, 0, 0.7, f"CASE WHEN source_type = 'transcript' AND coalesce({_AGE} > 90, false) THEN greatest(0.1, pow(0.5, ({_AGE} - 90) / 100)) ELSE 1.0 END * (1 + 0.3 * coalesce((SELECT inbound FROM inb WHERE inb.id = o.doc), 0) / greatest((SELECT coalesce(max(inbound), 0) FROM inb), 1))", extra=_USED)} {_FOUND}"""
SQL["injected_context"] = f"""{q.tier(20, 0, 0, 0.7, gate=0.5)}, e AS (SELECT query_id, picked.position, title, uri, relevance, text, strlen({_ENTRY.replace('o.text', 'text')}) n FROM picked JOIN ordered USING (query_id, id)),
 s AS (SELECT *, sum(n) OVER (PARTITION BY query_id ORDER BY position) after FROM e), t AS (SELECT *, 6000 - (after - n) room, sum(CASE WHEN after > 6000 THEN 1 ELSE 0 END) OVER (PARTITION BY query_id ORDER BY position) overs FROM s)
 SELECT query_id, string_agg('### [' || coalesce(title, '') || '](' || uri || ') (' || printf('%.3f', relevance) || ')' || chr(10) || chr(10) || text, chr(10) || chr(10) || '---' || chr(10) || chr(10) ORDER BY position) rendered FROM t WHERE overs = 0 OR (overs = 1 AND after > 6000 AND room > 200) GROUP BY 1"""
SQL["mmr_select"] = f"""WITH RECURSIVE {q.ONCE}, h AS (SELECT query_id, chunk_id, max(relevance) r, max(doc_id) doc FROM hits GROUP BY 1, 2), hp AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY r DESC, chunk_id) hpos FROM h),
 hc AS (SELECT query_id, chunk_id AS id, hp.doc, o.text, row_number() OVER (PARTITION BY query_id ORDER BY hpos) p FROM hp JOIN once o ON o.id = chunk_id), {q.mmr('hc', 0.6)} SELECT query_id, id AS chunk_id, position FROM picked"""
