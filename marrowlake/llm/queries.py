"""The pN_ queries of this package and, where SQL can say the same, their SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from marrowlake.llm import conversations, distinctive, markup, mixing, neighbours, ocr, packing, score_fusion, tokens, toxicity
from marrowlake.operators import knn
from marrowlake.runtime import cut, table


def p1_found(spark: SparkSession, d: str) -> DataFrame:
    return score_fusion.best_items(table(spark, d, "hits"), least_items=8)


def p1_leximin(spark: SparkSession, d: str) -> DataFrame:
    return score_fusion.leximin_order(table(spark, d, "hits")).select("query_id", "chunk_id", "position")


def _vectors(spark: SparkSession, d: str) -> DataFrame:
    return neighbours.unit_vectors(table(spark, d, "chunks"), "id", "embedding")


def p2_found(spark: SparkSession, d: str) -> DataFrame:
    units = _vectors(spark, d)
    pairs = neighbours.similar_pairs(neighbours.distinct_vectors(units), 0.92).select("id_a", "id_b")
    return pairs.unionByName(neighbours.copy_links(units)).distinct()


def p2_nearest(spark: SparkSession, d: str) -> DataFrame:
    """The 10 most similar chunks of every chunk whose doc_id is divisible by 100, against all chunks, exact copies among them."""
    chunks = table(spark, d, "chunks")
    sought = neighbours.unit_vectors(chunks.filter("doc_id % 100 = 0"), "id", "embedding").groupBy("id").agg(F.min("vec").alias("vec"))
    units = _vectors(spark, d)
    return neighbours.with_copies(neighbours.nearest(neighbours.distinct_vectors(units), sought), units, sought)


def p2_recall(spark: SparkSession, d: str) -> DataFrame:
    """The recall of p2_nearest against an exact search of all chunks: queries, the 10 nearest of each, and whether at least 0.9 of them are found. Ties at the tenth count if the cosine is the same."""
    units = _vectors(spark, d)
    rows = cut(units.groupBy("id").agg(F.min("vec").alias("vec")))
    floats = rows.mapInArrow(neighbours.as_floats, "id string, vec array<float>")
    asked = floats.join(p2_nearest(spark, d).select("id").distinct(), "id", "left_semi").select(F.col("id").alias("query_id"), "vec")
    exact = knn.knn(cut(asked), floats, 10, itself=False)
    last = exact.groupBy("query_id").agg(F.min("cosine").alias("least"), F.count("*").alias("n"))
    got = p2_nearest(spark, d).join(last, F.col("id") == F.col("query_id")).filter(F.col("cosine") >= F.col("least") - 1e-6).groupBy("query_id", "n").agg(F.count("*").alias("hit"))
    total = last.agg(F.count("*").alias("queries"), F.sum("n").alias("nearest"))
    return total.crossJoin(got.agg(F.sum(F.least("hit", "n")).alias("hit"))).select("queries", "nearest", (F.col("hit") >= 0.9 * F.col("nearest")).alias("enough"))  # one row each


def p3_found(spark: SparkSession, d: str) -> DataFrame:
    status = conversations.conversation_status(conversations.conversation_rows(table(spark, d, "finished")))
    return status.filter("status <> 'ok' and session is not null").select("session")


def p3_turns(spark: SparkSession, d: str) -> DataFrame:
    return conversations.conversations(table(spark, d, "finished"))


def p3_linked(spark: SparkSession, d: str) -> DataFrame:
    """Sessions hidden and rebuilt from links: rows and recovered rows, by whether the session lost some or all of its names.

    Every third row (row_id) loses its session, and all rows of a session whose first row_id is divisible by 10 do. Contents are replaced by "ref <row_id>" and a line; a row
    answers the row before it in its session by reply_to, or every seventh by quoting its first line where both have the same cwd and the earlier one quotes none. A row is recovered if its
    component is one whole session and nothing else.
    """
    f = table(spark, d, "finished").filter(F.trim("session") != "").withColumnRenamed("session", "hidden")
    w = Window.partitionBy("hidden").orderBy("row_id")  # planting, not the operator
    f = f.withColumn("before", F.lag("row_id").over(w)).withColumn("cwd0", F.lag("cwd").over(w)).withColumn("first", F.min("row_id").over(Window.partitionBy("hidden")))
    quotes = (F.col("row_id") % 7 == 0) & (F.col("before") % 7 != 0) & F.col("cwd").eqNullSafe(F.col("cwd0"))
    body = F.concat(F.when(quotes, F.concat(F.lit("> ref "), F.col("before").cast("string"))).otherwise(F.concat(F.lit("ref "), F.col("row_id").cast("string"))), F.lit("\nbody "), F.col("row_id").cast("string"))
    answer = F.when(~quotes, F.col("before"))
    lost = F.col("first") % 10 == 0
    log = f.select("row_id", "hidden", lost.alias("lost"), F.when(~lost & (F.col("row_id") % 3 != 0), F.col("hidden")).alias("session"), "type", "cwd", "timestamp", "loaded_at", F.struct("message.role", body.alias("content")).alias("message"), answer.alias("reply_to"))
    log = cut(log.withColumn("reply_to", F.coalesce("reply_to", F.lit(None).cast("long"))))
    rows = conversations.conversation_rows(log.drop("hidden", "lost"), "reply_to").select("row_id", "conversation").join(log.select("row_id", "hidden", "lost", "session"), "row_id")
    whole = rows.groupBy("conversation").agg(F.min("hidden").alias("a"), F.max("hidden").alias("b"), F.count("*").alias("n")).filter("a = b")
    sizes = rows.groupBy("hidden").agg(F.count("*").alias("size"))
    good = whole.join(sizes, whole["a"] == sizes["hidden"]).filter("n = size").select("conversation", F.lit(1).alias("ok"))
    got = rows.filter("session is null").join(good, "conversation", "left")
    return got.groupBy(F.when(F.col("lost"), "all names").otherwise("some names").alias("lost")).agg(F.count("*").alias("rows"), F.count("ok").alias("recovered"))


def _enriched(spark: SparkSession, d: str) -> tuple[DataFrame, DataFrame]:
    words = distinctive.enrichment(distinctive.chunk_terms(table(spark, d, "chunks")), "doc_id", "term")
    tags = distinctive.enrichment(distinctive.document_tags(table(spark, d, "documents")), "doc_id", "term")
    return words, tags


def p4_found(spark: SparkSession, d: str) -> DataFrame:
    words, tags = _enriched(spark, d)
    cases = words.filter("score is not null and k >= 4 and df <= 3").unionByName(tags.filter("score is not null and df <= 3"))
    return cases.select("doc_id", "term").distinct()


def p4_terms(spark: SparkSession, d: str) -> DataFrame:
    words, tags = _enriched(spark, d)
    return words.withColumn("kind", F.lit("term")).unionByName(tags.withColumn("kind", F.lit("tag"))).select("kind", "doc_id", "term", "k", "df", F.round("score", 6).alias("score"))


def p4_scores(spark: SparkSession, d: str) -> DataFrame:
    """p4_terms with scores to two places, where the log-gammas of two engines agree."""
    return p4_terms(spark, d).withColumn("score", F.round("score", 2))


def p5_found(spark: SparkSession, d: str) -> DataFrame:
    done = markup.clean_markup(table(spark, d, "chunks"), keep=["doc_id", "ord"], want_text=False)
    return done.filter("residue = 1").select("doc_id", "ord").distinct()


def p5_clean(spark: SparkSession, d: str) -> DataFrame:
    return markup.clean_markup(table(spark, d, "documents"), keep=["doc_id"])


def p5_clean_chunks(spark: SparkSession, d: str) -> DataFrame:
    return markup.clean_markup(table(spark, d, "chunks"), keep=["id", "doc_id", "ord"])


def p5_labels(spark: SparkSession, d: str) -> DataFrame:
    """How many texts of all documents the cut looks at, labels residue, and labels otherwise than each by itself would be, by source type."""
    c = markup.label_counts(table(spark, d, "documents"), keep=["source_type"])
    return c.groupBy("source_type").agg(*(F.sum(n).alias(n) for n in ("texts", "residue", "changed")))


def p6_found(spark: SparkSession, d: str) -> DataFrame:
    return ocr.pages_to_repair(table(spark, d, "loaded_pages")).select("doc_id", "number").distinct()


def p6_paragraphs(spark: SparkSession, d: str) -> DataFrame:
    """The repaired text of every document by paragraphs, joined over pages."""
    return ocr.repaired_paragraphs(table(spark, d, "loaded_pages"))


def p8_found(spark: SparkSession, d: str) -> DataFrame:
    packed = packing.pack(tokens.count_tokens(table(spark, d, "documents"), "text", ["doc_id"]))
    return packed.filter("piece = 2").select("doc_id")


def p8_containers(spark: SparkSession, d: str) -> DataFrame:
    return packing.pack(tokens.count_tokens(table(spark, d, "documents"), "text", ["doc_id"]))


def p8_report(spark: SparkSession, d: str) -> DataFrame:
    return packing.packing_report(p8_containers(spark, d))


def _mix(spark: SparkSession, d: str) -> tuple[DataFrame, DataFrame]:
    return mixing.mix(tokens.count_tokens(table(spark, d, "documents"), "text", ["doc_id", "source"]), table(spark, d, "mix_targets"))


def p9_found(spark: SparkSession, d: str) -> DataFrame:
    return _mix(spark, d)[1].filter("not reachable").select("source")


def p9_mix(spark: SparkSession, d: str) -> DataFrame:
    return mixing.shuffled(_mix(spark, d)[0])


def p9_shares(spark: SparkSession, d: str) -> DataFrame:
    return _mix(spark, d)[1]


def _scored(spark: SparkSession, d: str) -> tuple[DataFrame, float]:
    documents = table(spark, d, "documents")
    model = toxicity.train(documents, table(spark, d, "review_labels"))
    return toxicity.toxicity(documents, model, ["doc_id", "source"]), model.threshold


def p10_found(spark: SparkSession, d: str) -> DataFrame:
    scored, threshold = _scored(spark, d)
    return scored.filter(F.col("toxicity") >= threshold).select("doc_id")


def p10_scores(spark: SparkSession, d: str) -> DataFrame:
    return _scored(spark, d)[0]


def p10_rates(spark: SparkSession, d: str) -> DataFrame:
    scored, threshold = _scored(spark, d)
    return toxicity.toxicity_rates(cut(scored.select("source", "toxicity")), threshold=threshold)


QUERIES = {
    f.__name__: f
    for f in (
        p1_found, p1_leximin, p2_found, p2_nearest, p2_recall, p3_found, p3_turns, p3_linked, p4_found, p4_terms, p4_scores, p5_found, p5_clean, p5_clean_chunks, p5_labels, p6_found, p6_paragraphs, p8_found, p8_containers, p8_report,
        p9_found, p9_mix, p9_shares, p10_found, p10_scores, p10_rates,
    )
}

_HITS = "SELECT query_id, chunk_id, max(score) s, max(relevance) r, max(coalesce(inbound, 0)) i FROM hits GROUP BY 1, 2"
_RANKS = f"""SELECT query_id, chunk_id, count(*) OVER (PARTITION BY query_id) n, rank() OVER (PARTITION BY query_id ORDER BY s DESC NULLS LAST) a,
 rank() OVER (PARTITION BY query_id ORDER BY r DESC NULLS LAST) b, rank() OVER (PARTITION BY query_id ORDER BY i DESC NULLS LAST) c FROM ({_HITS})"""
_WORST_FIRST = "greatest(a, b, c), a + b + c - greatest(a, b, c) - least(a, b, c), least(a, b, c), chunk_id"
_WORDS = r"""SELECT doc_id, t FROM (SELECT doc_id, unnest(string_split(regexp_replace(lower(text), '[^\p{L}\p{N}]+', ' ', 'g'), ' ')) t
 FROM (SELECT id, min(doc_id) doc_id, min(text) text FROM chunks WHERE text IS NOT NULL GROUP BY id)) WHERE regexp_full_match(t, '[a-z]{5,}')"""

_MESSAGES = r"""m AS (SELECT session, type, cwd, "timestamp" ts, message.role r, message.content c, min(row_id) row_id FROM finished WHERE trim(session) <> '' GROUP BY ALL),
 x AS (SELECT *, CASE WHEN lower(trim(r)) IN ('user', 'human') THEN 'u' WHEN lower(trim(r)) IN ('assistant', 'ai', 'model') THEN 'a' WHEN lower(trim(r)) IN ('system', 'developer') THEN 'x' END w, try_cast(trim(ts) AS TIMESTAMPTZ) at_,
  coalesce(regexp_matches(c, '^\s*\[\s*\{'), false) starts, coalesce(CASE WHEN json_valid(c) AND json_type(c) = 'ARRAY' THEN list_bool_and([true] || list_transform(from_json(c, '["JSON"]'), lambda i: json_type(i) = 'OBJECT')) END, false) items FROM m),
 y0 AS (SELECT *, w IS NULL OR at_ IS NULL OR (starts AND NOT items) bad, CASE WHEN items THEN array_to_string(list_transform(list_filter(from_json(c, '[{"type":"VARCHAR","text":"VARCHAR"}]'), lambda i: i.type = 'text' AND regexp_replace(i.text, '\s+', '', 'g') <> ''), lambda i: i.text), chr(10)) WHEN NOT starts THEN c END t FROM x),
 y AS (SELECT *, CASE WHEN regexp_replace(t, '\s+', '', 'g') <> '' THEN t END said FROM y0),
 g AS (SELECT session, bool_or(bad) bad, count(*) FILTER (WHERE said IS NOT NULL AND w IN ('u', 'a')) n, arg_min(w, (coalesce(at_, TIMESTAMPTZ '9999-12-31'), row_id)) FILTER (WHERE said IS NOT NULL AND w IN ('u', 'a')) f,
  arg_max(w, (coalesce(at_, TIMESTAMPTZ '9999-12-31'), row_id)) FILTER (WHERE said IS NOT NULL AND w IN ('u', 'a')) l FROM y GROUP BY 1)"""

SQL = {
    "p1_found": f"SELECT query_id, chunk_id FROM (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY a + b + c, {_WORST_FIRST}) p FROM ({_RANKS}) WHERE n >= 8) WHERE p = 1",
    "p1_leximin": f"SELECT query_id, chunk_id, CAST(row_number() OVER (PARTITION BY query_id ORDER BY {_WORST_FIRST}) AS INTEGER) AS position FROM ({_RANKS})",
    "p3_found": f"WITH {_MESSAGES} SELECT session FROM g WHERE bad OR n = 0 OR f = 'a' OR l = 'u'",
    "p3_turns": f"""WITH {_MESSAGES}, ok AS (SELECT session FROM g WHERE NOT (bad OR n = 0 OR f = 'a' OR l = 'u')), k AS (SELECT session, arg_min(cwd, (at_, row_id)) FILTER (WHERE cwd IS NOT NULL) known FROM y GROUP BY 1)
 SELECT session AS conversation, CAST(row_number() OVER (PARTITION BY session ORDER BY at_, row_id) AS INTEGER) AS turn, CASE w WHEN 'u' THEN 'user' ELSE 'assistant' END speaker, said AS text, at_ AT TIME ZONE 'UTC' AS at, coalesce(cwd, known) cwd
 FROM y JOIN ok USING (session) LEFT JOIN k USING (session) WHERE said IS NOT NULL AND w IN ('u', 'a')""",
    "p3_linked": """WITH s AS (SELECT session, min(row_id) f FROM finished WHERE trim(session, ' ') <> '' GROUP BY 1), r AS (SELECT row_id, f % 10 = 0 l FROM finished JOIN s USING (session))
 SELECT CASE WHEN l THEN 'all names' ELSE 'some names' END lost, count(*) AS rows, count(*) recovered FROM r WHERE l OR row_id % 3 = 0 GROUP BY 1""",
    "p4_found": rf"""WITH k AS (SELECT doc_id, t, count(*) k FROM ({_WORDS}) GROUP BY 1, 2), d AS (SELECT t, count(*) df FROM k GROUP BY 1),
 g AS (SELECT DISTINCT doc_id, lower(trim(regexp_replace(trim(x), '^#+', ''))) t FROM (SELECT doc_id, unnest(tags) x FROM documents)), e AS (SELECT t, count(*) df FROM g WHERE t <> '' GROUP BY 1)
 SELECT doc_id, t AS term FROM k JOIN d USING (t) WHERE k >= 4 AND df <= 3 UNION SELECT doc_id, t FROM g JOIN e USING (t) WHERE df <= 3""",
}
_COUNTS = rf"""k1 AS (SELECT doc_id, t AS term, count(*) k FROM ({_WORDS}) GROUP BY 1, 2), t1 AS (SELECT DISTINCT doc_id, lower(trim(regexp_replace(trim(x), '^#+', ''))) term FROM (SELECT doc_id, unnest(tags) x FROM documents)),
 k0 AS (SELECT 'term' kind, doc_id, term, k FROM k1 UNION ALL SELECT 'tag', doc_id, term, 1 FROM t1 WHERE term <> ''),
 c AS (SELECT *, CAST(sum(k) OVER (PARTITION BY kind, doc_id) AS BIGINT) n, CAST(sum(k) OVER (PARTITION BY kind, term) AS BIGINT) good, count(*) OVER (PARTITION BY kind, term) df, CAST(sum(k) OVER (PARTITION BY kind) AS BIGINT) total FROM k0)"""
_USABLE = "id IS NOT NULL AND len(embedding) = 64 AND list_bool_and(list_transform(embedding, lambda x: x IS NOT NULL AND isfinite(x))) AND list_bool_or(list_transform(embedding, lambda x: x <> 0))"
_CHOOSE = "(lgamma({a} + 1) - lgamma({b} + 1) - lgamma({a} - ({b}) + 1))"
_TAIL = f"list_sum(list_transform(range(k, least(n, good) + 1), lambda x: exp({_CHOOSE.format(a='good', b='x')} + {_CHOOSE.format(a='(total - good)', b='(n - x)')} - {_CHOOSE.format(a='total', b='n')})))"
SQL |= {
    "p2_found": """WITH u AS (SELECT DISTINCT id, embedding::DOUBLE[] v FROM chunks WHERE id IS NOT NULL AND len(embedding) = 64 AND list_bool_and(list_transform(embedding, lambda x: x IS NOT NULL AND isfinite(x))) AND list_bool_or(list_transform(embedding, lambda x: x <> 0))),
 f AS (SELECT id, list_transform(v, lambda x: CAST(x / sqrt(list_dot_product(v, v)) AS FLOAT)) n FROM u), r AS (SELECT n, min(id) id FROM f GROUP BY 1)
 SELECT a.id id_a, b.id id_b FROM r a JOIN r b ON a.id < b.id WHERE list_cosine_similarity(a.n::DOUBLE[], b.n::DOUBLE[]) >= 0.92 UNION SELECT r.id, f.id FROM f JOIN r USING (n) WHERE f.id <> r.id""",
    "p2_recall": f"""WITH u AS (SELECT DISTINCT id FROM chunks WHERE {_USABLE}), q AS (SELECT DISTINCT id FROM chunks WHERE {_USABLE} AND doc_id % 100 = 0)
 SELECT count(*) queries, CAST(count(*) * least(10, (SELECT count(*) FROM u) - 1) AS BIGINT) nearest, true AS enough FROM q""",
    "p4_scores": f"""WITH {_COUNTS}, d AS (SELECT DISTINCT kind, k, n, good, total FROM c), p AS (SELECT *, round(least(greatest(-log10(least(greatest({_TAIL}, 0), 1)), 0), 1e12), 6) p FROM d),
 m AS (SELECT c.*, p.p FROM c JOIN p ON p.kind = c.kind AND p.k = c.k AND p.n = c.n AND p.good = c.good), r AS (SELECT kind, p, p - log10(sum(count(*)) OVER (PARTITION BY kind) / sum(count(*)) OVER (PARTITION BY kind ORDER BY p DESC)) raw FROM m GROUP BY 1, 2),
 s AS (SELECT kind, p, greatest(max(raw) OVER (PARTITION BY kind ORDER BY p ROWS UNBOUNDED PRECEDING), 0) score FROM r) SELECT m.kind, doc_id, term, k, df, round(round(score, 6), 2) score FROM m JOIN s ON s.kind = m.kind AND s.p = m.p""",
    # any measure of size will do, as no document and no source lies near a limit: four bytes are about a token
    "p8_found": "SELECT doc_id FROM documents WHERE strlen(text) > 4 * 4096",
    "p9_found": """WITH s AS (SELECT lower(trim(source)) source, sum(coalesce(strlen(text), 0)) n FROM documents GROUP BY 1), t AS (SELECT sum(n) t FROM s)
 SELECT m.source FROM mix_targets m LEFT JOIN s ON s.source = lower(trim(m.source)), t WHERE m.target_share * t > m.max_repeats * coalesce(n, 0)""",
}
