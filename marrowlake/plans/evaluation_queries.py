"""Queries of evaluation (A14-A28, J16) and memories.

The cases: every search of `hits` is one. A query's distinct chunks are its ranked list, by relevance. Odd queries are positive and accept the
documents of the three hits with most links; even ones are negative.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from marrowlake.functions.text import fold_newlines
from marrowlake.operators import budget, evaluation, memory
from marrowlake.operators.knn import knn
from marrowlake.plans.retrieval_queries import pack_of
from marrowlake.runtime import cut, table

Spark = SparkSession
NOW = 1_780_272_000


def _ranked(spark: Spark, d: str) -> DataFrame:
    h = table(spark, d, "hits").groupBy("query_id", "chunk_id").agg(F.max("relevance").cast("double").alias("relevance"), F.min("uri").alias("uri"), F.max(F.coalesce("inbound", F.lit(0))).alias("inbound"))
    w = Window.partitionBy("query_id").orderBy(F.desc("relevance"), "chunk_id")
    return h.withColumn("position", F.row_number().over(w)).withColumnRenamed("query_id", "case_id")


def _cases(spark: Spark, d: str) -> tuple[DataFrame, DataFrame, DataFrame]:
    """(classified hits, cases, expected)."""
    r = cut(_ranked(spark, d))
    cases = r.select("case_id").distinct().withColumn("negative", F.col("case_id") % 2 == 0)
    w = Window.partitionBy("case_id").orderBy(F.desc("inbound"), "chunk_id")
    expected = r.filter("case_id % 2 = 1").withColumn("n", F.row_number().over(w)).filter("n <= 3").select("case_id", "uri").distinct()
    return evaluation.classified(r, cases, expected), cases, expected


def recall_at_k(spark: Spark, d: str) -> DataFrame:
    r, _, e = _cases(spark, d)
    out = [evaluation.recall_at(r, e, k).withColumn("k", F.lit(k)) for k in (1, 5, 10)]
    return out[0].unionByName(out[1]).unionByName(out[2]).withColumn("recall", F.round("recall", 6))


def recall_gated(spark: Spark, d: str) -> DataFrame:
    r, _, e = _cases(spark, d)
    return evaluation.recall_gated(r, e, 5, 0.5).withColumn("recall", F.round("recall", 6))


def threshold_tradeoff(spark: Spark, d: str) -> DataFrame:
    r, c, e = _cases(spark, d)
    return evaluation.trade_off(r, c, e).withColumn("recall", F.round("recall", 6))


def clean_gate(spark: Spark, d: str) -> DataFrame:
    return evaluation.cheapest_clean_gate(threshold_tradeoff(spark, d))


def relevance_spread(spark: Spark, d: str) -> DataFrame:
    r, _, _ = _cases(spark, d)
    s = evaluation.spread(r, group=["class"])
    return s.select("class", "n", *(F.round(c, 6).alias(c) for c in ("min", "p10", "p25", "p50", "p75", "p90", "max")))


def origin_breakdown(spark: Spark, d: str) -> DataFrame:
    """Which measure alone would have put a hit among its query's first ten: relevance (vector), score (keyword), links (graph)."""
    r, _, _ = _cases(spark, d)
    h = table(spark, d, "hits").groupBy(F.col("query_id"), "chunk_id").agg(F.max("score").alias("vs"))
    r = r.join(h.withColumnRenamed("query_id", "case_id"), ["case_id", "chunk_id"])
    stages = None
    for stage, c in (("vector", "relevance"), ("keyword", "vs"), ("graph", "inbound")):
        w = Window.partitionBy("case_id").orderBy(F.desc(c), "chunk_id")
        one = r.withColumn("n", F.row_number().over(w)).filter("n <= 10").select(F.col("case_id").alias("query_id"), "chunk_id", F.lit(stage).alias("stage"))
        stages = one if stages is None else stages.unionByName(one)
    s = evaluation.spread(evaluation.origin(r.withColumnRenamed("case_id", "query_id"), stages), group=["class", "origin"])
    return s.select("class", "origin", "n", F.round("p50", 6).alias("p50"), F.round("max", 6).alias("max"))


def gate_recommendation(spark: Spark, d: str) -> DataFrame:
    r, c, _ = _cases(spark, d)
    got = evaluation.recommendation(r, c.filter("negative"))
    return got.select("kind", *(F.round(x, 6).alias(x) for x in ("threshold", "min_relevant", "max_negative")), "negative_cases")


def absent_documents(spark: Spark, d: str) -> DataFrame:
    """Per negative query, whether the document of its best hit passes the gate and a budget of 1,500 tokens of chunk text."""
    r, _, _ = _cases(spark, d)
    absent = r.filter("class = 'negative' and position = 1").select("case_id", "uri")
    kept = r.filter("relevance >= 0.5").join(pack_of(spark, d).chunks.select(F.col("id").alias("chunk_id"), F.col("text").alias("entry")), "chunk_id").filter("entry is not null")
    kept = kept.withColumn("position", F.row_number().over(Window.partitionBy("case_id").orderBy("position")))
    return evaluation.absent_scores(r, budget.admitted(kept, 1500, group="case_id"), absent)


def duplicate_queries(spark: Spark, d: str) -> DataFrame:
    """A24 with titles as queries."""
    return evaluation.duplicate_queries(table(spark, d, "documents").select(F.col("doc_id").alias("case_id"), F.col("title").alias("query")))


def faulty_cases(spark: Spark, d: str) -> DataFrame:
    """Titles as queries, links as what is named; memories are negative."""
    t = table(spark, d, "documents").select(F.col("doc_id").alias("case_id"), F.col("title").alias("query"), F.col("links").alias("acceptable"), (F.col("source_type") == "memory").alias("negative"))
    return evaluation.faulty_cases(t)


def title_echo(spark: Spark, d: str) -> DataFrame:
    """Documents whose text repeats their title."""
    t = table(spark, d, "documents").filter("text is not null and title is not null")
    p = t.select(F.col("doc_id").alias("case_id"), "uri", fold_newlines(F.col("text")).alias("query"), "title")
    return evaluation.title_echoes(p).withColumn("overlap", F.round("overlap", 6))


def golden_report(spark: Spark, d: str) -> DataFrame:
    """A26 over the cases of faulty_cases with their links as expected uris, by level and check."""
    t = table(spark, d, "documents")
    cases = t.select(F.col("doc_id").alias("case_id"), F.col("title").alias("query"), F.col("links").alias("acceptable"), (F.col("source_type") == "memory").alias("negative"))
    expected = t.filter("title is not null").select(F.col("doc_id").alias("case_id"), "uri")
    return evaluation.golden_report(cases, t.select("uri", "title"), expected).groupBy("level", "check").agg(F.count("*").alias("findings"))


def latency_summary(spark: Spark, d: str) -> DataFrame:
    """p50 and p95 of event values by type, by nearest and by floor rank."""
    return evaluation.ranked_quantiles(table(spark, d, "events"), "event_type", "value", {"p50": 0.5, "p95": 0.95})


def run_comparability(spark: Spark, d: str) -> DataFrame:
    """Each indexing run against the one before, by listed uris and distinct hashes."""
    s = table(spark, d, "scans").groupBy("run_id").agg(F.countDistinct("uri").alias("documents"), F.countDistinct("content_hash").alias("chunks"))
    w = Window.orderBy("run_id")  # one row a run
    p = cut(s.withColumn("previous", F.lag("run_id").over(w)))
    before = p.select(F.col("run_id").alias("previous"), "documents", "chunks").join(p.filter("previous is not null").select("previous", F.col("run_id").alias("of")), "previous")
    return evaluation.comparability(before.select(F.col("of").alias("run_id"), "documents", "chunks"), p.drop("previous"), "run_id")


def _memories(spark: Spark, d: str) -> DataFrame:
    m = table(spark, d, "documents").filter("source_type = 'memory' and text is not null")
    part = lambda n: F.split_part(F.regexp_replace("uri", "^memory://", ""), F.lit("/"), F.lit(n))
    return m.select(part(2).alias("id"), F.col("id").alias("doc"), part(1).alias("kind"), "text", "title", F.get_json_object("meta", "$.project").alias("project"), F.unix_timestamp("indexed_at").alias("created"), F.lit(None).cast("string").alias("session"), F.lit("claude").alias("origin"), (F.col("doc_id") % 101).cast("int").alias("confidence"), "doc_id")


def remember(spark: Spark, d: str) -> DataFrame:
    """Every memory offered again against the memories with an even doc_id, near ones by their first chunk's vector."""
    m = cut(_memories(spark, d))
    v = pack_of(spark, d).vectors.withColumn("doc", F.substring_index("id", ":", 1)).filter(F.col("id").endswith(":0")).select("doc", "vec")
    stored = m.filter("doc_id % 2 = 0")
    rows = stored.join(v, "doc").select(F.concat_ws("/", "kind", "id").alias("id"), "vec")
    near = knn(m.join(v, "doc").select(F.col("doc_id").alias("query_id"), "vec"), rows, 5, least=memory.DUPLICATE)
    near = near.join(m.select(F.col("doc_id").cast("string").alias("query_id"), "kind", F.col("id").alias("own")), "query_id").withColumn("of", F.split_part("id", F.lit("/"), F.lit(2)))
    near = near.filter(F.col("id").startswith(F.concat("kind", F.lit("/"))) & (F.col("of") != F.col("own"))).groupBy(F.col("query_id").cast("long").alias("seq")).agg(F.min_by("of", "position").alias("of"))
    return memory.remembered(m.select(F.col("doc_id").alias("seq"), "kind", "text", "origin", "confidence"), stored.select("id", "text"), near)


def memory_eviction(spark: Spark, d: str) -> DataFrame:
    """W13 with a cap of half of the smallest table's memories."""
    return memory.evicted(_memories(spark, d), 20)


def lessons(spark: Spark, d: str) -> DataFrame:
    """All lessons as one block of 500 tokens a project."""
    m = _memories(spark, d).filter("kind = 'lesson'")
    m = m.select(F.coalesce("project", F.lit("global")).alias("project"), "id", "created", memory.lesson_line(F.col("id"), F.col("created"), F.col("project"), F.col("text")).alias("text"))
    return budget.lessons_block(m, 500)


def memory_graph(spark: Spark, d: str) -> DataFrame:
    """Nodes and edges as one list."""
    n, e = memory.memory_graph(_memories(spark, d))
    return n.select(F.col("id").alias("a"), F.col("type").alias("b"), F.lit("node").alias("kind")).unionByName(e.select(F.col("src").alias("a"), F.col("dst").alias("b"), "kind"))


def memory_list(spark: Spark, d: str) -> DataFrame:
    """Memories that speak of a cache, newest first."""
    return memory.listed(_memories(spark, d), contains="Cache").select("id", "kind", "created")


def memory_reach(spark: Spark, d: str) -> DataFrame:
    """Chunks of other documents that a memory's vector reaches at a relevance of 0.7."""
    p = pack_of(spark, d)
    doc = F.substring_index("id", ":", 1)
    m = _memories(spark, d).select("doc", F.col("id").alias("memory"))
    v = p.vectors.withColumn("doc", doc)
    asked = v.join(m, "doc").filter(F.col("id").endswith(":0")).select(F.col("memory").alias("query_id"), "vec").groupBy("query_id").agg(F.max("vec").alias("vec"))
    others = v.join(m, "doc", "left_anti").select("id", "vec")
    return knn(asked, others, 10, least=0.7).select("query_id", "id", F.round("relevance", 6).alias("relevance"), "position")


def distill_candidates(spark: Spark, d: str) -> DataFrame:
    """Transcripts large and quiet enough, whose last stamp of the scans differs from the first one."""
    docs = table(spark, d, "documents").filter("source_type = 'transcript' and text is not null")
    sc = table(spark, d, "scans").filter("stamp is not null")
    first, last = sc.groupBy("uri").agg(F.min_by("stamp", F.struct("run_id", "stamp")).alias("source_stamp")), sc.groupBy("uri").agg(F.max_by("stamp", F.struct("run_id", "stamp")).alias("stamp"))
    s = docs.select("uri", F.octet_length("text").alias("bytes"), F.unix_timestamp("indexed_at").alias("modified"), F.lower("content_hash").alias("hash")).join(last, "uri")
    return memory.distill_candidates(s, first.withColumn("source_hash", F.lit(None).cast("string")), NOW, 24).select("uri", "stamp")


QUERIES = {
    f.__name__: f
    for f in (
        recall_at_k, recall_gated, threshold_tradeoff, clean_gate, relevance_spread, origin_breakdown, gate_recommendation, absent_documents, duplicate_queries, faulty_cases, title_echo, golden_report,
        latency_summary, run_comparability, remember, memory_eviction, lessons, memory_graph, memory_list, memory_reach, distill_candidates,
    )
}

from marrowlake.plans import fragments as q  # noqa: E402

_BASE = """r AS (SELECT query_id AS case_id, chunk_id, max(relevance)::DOUBLE relevance, min(uri) uri, max(coalesce(inbound, 0)) inbound, max(score) vs FROM hits GROUP BY 1, 2),
 k AS (SELECT *, row_number() OVER (PARTITION BY case_id ORDER BY relevance DESC, chunk_id) AS position FROM r),
 e AS (SELECT DISTINCT case_id, uri FROM (SELECT *, row_number() OVER (PARTITION BY case_id ORDER BY inbound DESC, chunk_id) n FROM k WHERE case_id % 2 = 1) WHERE n <= 3),
 c AS (SELECT k.*, CASE WHEN k.case_id % 2 = 0 THEN 'negative' WHEN e.uri IS NOT NULL THEN 'answer' ELSE 'other' END AS class FROM k LEFT JOIN e ON e.case_id = k.case_id AND e.uri = k.uri)"""
_RANK = "(SELECT case_id, uri, row_number() OVER (PARTITION BY case_id ORDER BY p, uri) n FROM (SELECT case_id, uri, min(position) p FROM k WHERE relevance >= {g} GROUP BY 1, 2))"
_RECALL = "(SELECT count(DISTINCT e.case_id) FROM e JOIN " + _RANK + " x ON x.case_id = e.case_id AND x.uri = e.uri WHERE n <= {k}) / (SELECT count(DISTINCT case_id) FROM e)::DOUBLE"


def _trade(g: float) -> str:
    return f"""SELECT CAST({g} AS DOUBLE) gate, (SELECT count(*) FROM c WHERE class = 'negative' AND relevance >= {g}) negative_hits_admitted, (SELECT count(*) FROM c WHERE class = 'answer' AND relevance < {g}) answer_hits_cut,
 (SELECT count(*) FROM (SELECT max(relevance) m FROM c WHERE class = 'negative' GROUP BY case_id) WHERE m >= {g}) negative_cases_injected, (SELECT count(*) FROM (SELECT max(relevance) m FROM c WHERE class = 'answer' GROUP BY case_id) WHERE m < {g}) answer_cases_lost,
 round({_RECALL.format(g=g, k=5)}, 6) recall"""


_TRADE = " UNION ALL ".join(_trade(g) for g in evaluation.GATES)
_DISC = ", ".join(f"round(quantile_disc(relevance, {p}), 6) {n}" for p, n in ((0.1, "p10"), (0.25, "p25"), (0.5, "p50"), (0.75, "p75"), (0.9, "p90")))
_MEM = "m AS (SELECT string_split(regexp_replace(uri, '^memory://', ''), '/')[2] id, id AS doc, string_split(regexp_replace(uri, '^memory://', ''), '/')[1] kind, text, title, json_extract_string(meta, '$.project') project, CAST(floor(epoch(indexed_at)) AS BIGINT) created, doc_id FROM documents WHERE source_type = 'memory' AND text IS NOT NULL)"
SQL = {
    "recall_at_k": f"WITH {_BASE} " + " UNION ALL ".join(f"SELECT (SELECT count(DISTINCT case_id) FROM e) cases, round({_RECALL.format(g='-1', k=k)}, 6) recall, {k} AS k" for k in (1, 5, 10)),
    "recall_gated": f"WITH {_BASE} SELECT (SELECT count(DISTINCT case_id) FROM e) cases, round({_RECALL.format(g=0.5, k=5)}, 6) recall",
    "threshold_tradeoff": f"WITH {_BASE} {_TRADE}",
    "clean_gate": f"WITH {_BASE} SELECT min(gate) FILTER (WHERE negative_cases_injected = 0) gate FROM ({_TRADE})",
    "relevance_spread": f"WITH {_BASE} SELECT class, count(relevance) n, round(min(relevance), 6) AS min, {_DISC}, round(max(relevance), 6) AS max FROM c GROUP BY 1",
    "origin_breakdown": f"""WITH {_BASE}, o AS (SELECT *, row_number() OVER (PARTITION BY case_id ORDER BY relevance DESC, chunk_id) a, row_number() OVER (PARTITION BY case_id ORDER BY vs DESC, chunk_id) b, row_number() OVER (PARTITION BY case_id ORDER BY inbound DESC, chunk_id) g FROM c)
 SELECT class, CASE WHEN a <= 10 THEN 'vector' WHEN b <= 10 THEN 'keyword' WHEN g <= 10 THEN 'graph' ELSE 'unattributed' END origin, count(relevance) n, round(quantile_disc(relevance, 0.5), 6) p50, round(max(relevance), 6) AS max FROM o GROUP BY 1, 2""",
    "gate_recommendation": f"""WITH {_BASE}, x AS (SELECT min(relevance) FILTER (WHERE class = 'answer') a, max(relevance) FILTER (WHERE class = 'negative') b, (SELECT count(DISTINCT case_id) FROM c WHERE case_id % 2 = 0) n FROM c)
 SELECT CASE WHEN n < 5 OR a IS NULL OR b IS NULL THEN 'too_few_negatives' WHEN a > b THEN 'calibrated' ELSE 'overlapping' END AS kind, round(CASE WHEN n >= 5 AND a > b THEN (a + b) / 2 ELSE 0.66 END, 6) threshold, round(a, 6) min_relevant, round(b, 6) max_negative, n negative_cases FROM x""",
    "absent_documents": f"""WITH {_BASE}, {q.ONCE}, s AS (SELECT c.case_id, c.uri, strlen(o.text) n, sum(strlen(o.text)) OVER (PARTITION BY case_id ORDER BY position) after FROM c JOIN once o ON o.id = chunk_id WHERE relevance >= 0.5 AND o.text IS NOT NULL),
 t AS (SELECT *, sum(CASE WHEN after > 6000 THEN 1 ELSE 0 END) OVER (PARTITION BY case_id ORDER BY after, uri ROWS UNBOUNDED PRECEDING) overs FROM s), a AS (SELECT case_id, uri FROM c WHERE class = 'negative' AND position = 1)
 SELECT a.case_id, a.uri, EXISTS (SELECT 1 FROM t WHERE t.case_id = a.case_id AND t.uri = a.uri AND (overs = 0 OR (overs = 1 AND after > 6000 AND 6000 - (after - n) > 200))) injected, 1 AS rank FROM a""",
    "duplicate_queries": "SELECT lower(trim(title)) AS key, list(doc_id ORDER BY doc_id) cases FROM documents WHERE trim(title) <> '' GROUP BY 1 HAVING count(*) > 1",
    "faulty_cases": "SELECT doc_id case_id, 'blank' fault FROM documents WHERE trim(coalesce(title, '')) = '' UNION ALL SELECT doc_id, 'contradictory' FROM documents WHERE source_type = 'memory' AND len(links) > 0 UNION ALL SELECT doc_id, 'unnamed' FROM documents WHERE source_type <> 'memory' AND coalesce(len(links), 0) = 0",
    "latency_summary": """SELECT event_type, quantile_disc(value, 0.5) near_p50, quantile_disc(value, 0.95) near_p95, list(value ORDER BY value)[CAST(floor((count(*) - 1) * 0.5) AS BIGINT) + 1] floor_p50, list(value ORDER BY value)[CAST(floor((count(*) - 1) * 0.95) AS BIGINT) + 1] floor_p95 FROM events WHERE value IS NOT NULL GROUP BY 1""",
    "run_comparability": """WITH s AS (SELECT run_id, count(DISTINCT uri) a, count(DISTINCT content_hash) b FROM scans GROUP BY 1), p AS (SELECT *, lag(a) OVER (ORDER BY run_id) a0, lag(b) OVER (ORDER BY run_id) b0 FROM s)
 SELECT run_id, 'documents' AS change, a0::VARCHAR AS before, a::VARCHAR AS after FROM p WHERE a0 <> a UNION ALL SELECT run_id, 'chunks', b0::VARCHAR, b::VARCHAR FROM p WHERE b0 <> b""",
    "memory_eviction": f"WITH {_MEM} SELECT id FROM (SELECT id, row_number() OVER (ORDER BY created, id) r FROM m WHERE kind = 'episode') WHERE r <= (SELECT count(*) FROM m) - 20",
    "memory_graph": f"WITH {_MEM} SELECT id AS a, 'memory' AS b, 'node' AS kind FROM m UNION ALL SELECT DISTINCT project, 'project', 'node' FROM m WHERE project IS NOT NULL UNION ALL SELECT id, project, 'scoped-to' FROM m WHERE project IS NOT NULL",
    "memory_list": f"WITH {_MEM} SELECT id, kind, created FROM m WHERE contains(lower(text), 'cache') OR contains(lower(title), 'cache') OR contains(lower(id), 'cache')",
    "memory_reach": f"""WITH {_MEM}, {q.VEC}, v AS (SELECT *, string_split(id, ':')[1] doc FROM vec), a AS (SELECT m.id AS query_id, max(v.v) qv FROM v JOIN m ON m.doc = v.doc WHERE v.id = m.doc || ':0' GROUP BY 1),
 n AS (SELECT query_id, v.id, round(list_cosine_similarity(qv, v.v), 12) cosine FROM a, v WHERE v.doc NOT IN (SELECT doc FROM m))
 SELECT query_id, id, round({q.REL}, 6) relevance, CAST(row_number() OVER (PARTITION BY query_id ORDER BY cosine DESC, id) AS INTEGER) AS position FROM n WHERE {q.REL} >= 0.7 QUALIFY position <= 10""",
    "distill_candidates": f"""WITH s AS (SELECT uri, arg_min(stamp, (run_id, stamp)) s0, arg_max(stamp, (run_id, stamp)) s1 FROM scans WHERE stamp IS NOT NULL GROUP BY 1)
 SELECT uri, s1 AS stamp FROM documents JOIN s USING (uri) WHERE source_type = 'transcript' AND strlen(text) >= 4096 AND {NOW} - floor(epoch(indexed_at)) >= 86400 AND s0 <> s1""",
}
_T, _Q = (f"list_filter({q.toks(c)}, lambda x: x <> '' AND x NOT IN ({q.STOP}))" for c in ("title", q.FOLDED))
SQL |= {
    "title_echo": f"""WITH x AS (SELECT doc_id case_id, uri, {_T} t, {_Q} q FROM documents WHERE text IS NOT NULL AND title IS NOT NULL),
 y AS (SELECT *, len(list_distinct(t)) n, CASE WHEN len(t) > 0 THEN len(list_intersect(list_distinct(t), list_distinct(q))) / len(list_distinct(t))::DOUBLE ELSE 0 END overlap, ' ' || array_to_string(q, ' ') || ' ' hay FROM x),
 z AS (SELECT *, coalesce(list_max(list_transform(flatten(list_transform(range(1, len(t) + 1), lambda i: list_transform(range(i, len(t) + 1), lambda j: [i, j]))), lambda p: CASE WHEN contains(hay, ' ' || array_to_string(t[p[1]:p[2]], ' ') || ' ') THEN p[2] - p[1] + 1 ELSE 0 END)), 0) run FROM y)
 SELECT case_id, uri, round(overlap, 6) overlap, CAST(run AS INTEGER) run FROM z WHERE (n >= 3 AND overlap >= 0.6) OR run >= 3""",
    "golden_report": f"""WITH f AS ({SQL["faulty_cases"]}), d AS ({SQL["duplicate_queries"]}) SELECT 'error' AS level, fault AS "check", count(*) findings FROM f GROUP BY 2 UNION ALL SELECT 'warning', 'duplicate', count(*) FROM d HAVING count(*) > 0
 UNION ALL SELECT 'warning', 'echo', count(*) FROM documents WHERE source_type <> 'memory' AND title IS NOT NULL AND len({_T}) >= 3 HAVING count(*) > 0
 UNION ALL SELECT 'warning', 'few negatives', 1 FROM documents HAVING count(*) FILTER (WHERE source_type = 'memory') < 5""",
    "lessons": f"""WITH {_MEM}, l AS (SELECT coalesce(project, 'global') project, id, created, '- [' || id || ' · ' || strftime(to_timestamp(created) AT TIME ZONE 'UTC', '%Y-%m-%d') || ' · ' || coalesce(project, 'global') || '] ' || trim(text, ' ') || chr(10) line FROM m WHERE kind = 'lesson'),
 u AS (SELECT *, row_number() OVER w p, 11 + sum(strlen(line)) OVER (w ROWS UNBOUNDED PRECEDING) used FROM l WINDOW w AS (PARTITION BY project ORDER BY created DESC, id)),
 g AS (SELECT project, count(*) FILTER (WHERE used <= 2000) shown, count(*) FILTER (WHERE used > 2000) omitted, string_agg(line, '' ORDER BY p) FILTER (WHERE used <= 2000) body FROM u GROUP BY 1)
 SELECT project, CASE WHEN shown > 0 THEN '# Lessons' || chr(10) || body || CASE WHEN omitted > 0 THEN '(' || omitted || ' more)' || chr(10) ELSE '' END || chr(10) END body, shown, omitted FROM g""",
    "remember": f"""WITH {_MEM}, {q.VEC}, w AS (SELECT m.*, v, substr(sha256(kind || '|' || trim(text, ' ')), 1, 12) own, CASE WHEN length(trim(text, ' ')) NOT BETWEEN 10 AND 2000 OR doc_id % 101 < 60 THEN true ELSE false END bad FROM m LEFT JOIN vec ON vec.id = m.doc || ':0'),
 c AS (SELECT a.doc_id seq, a.kind, a.id own, b.kind bk, b.id bid, round(list_cosine_similarity(a.v, b.v), 12) cosine FROM w a, w b WHERE b.doc_id % 2 = 0 AND a.v IS NOT NULL AND b.v IS NOT NULL),
 n AS (SELECT *, row_number() OVER (PARTITION BY seq ORDER BY cosine DESC, bk || '/' || bid) p FROM c WHERE {q.REL} >= 0.94 QUALIFY p <= 5), near_ AS (SELECT seq, arg_min(bid, p) of_ FROM n WHERE bk = kind AND bid <> own GROUP BY 1),
 s AS (SELECT w.doc_id seq, own AS id, kind, bad, EXISTS (SELECT 1 FROM m z WHERE z.doc_id % 2 = 0 AND z.id = w.own AND trim(z.text, ' ') = trim(w.text, ' ')) same, CASE WHEN of_ <> own THEN of_ END of_ FROM w LEFT JOIN near_ ON near_.seq = w.doc_id),
 o AS (SELECT *, CASE WHEN bad THEN 'rejected' WHEN same THEN 'duplicate' WHEN of_ IS NOT NULL AND kind = 'episode' THEN 'duplicate' WHEN of_ IS NOT NULL THEN 'replaced' ELSE 'saved' END outcome FROM s)
 SELECT seq, id, outcome, CASE WHEN outcome IN ('duplicate', 'replaced') THEN CASE WHEN same THEN id ELSE of_ END END AS of FROM o""",
}
