"""Queries of identity and text functions (X, F, M11, M14-M16)."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from marrowlake.functions import identity, text, weights
from marrowlake.plans import fragments as q
from marrowlake.plans.retrieval_queries import pack_of
from marrowlake.runtime import table

Spark = SparkSession


def doc_identity(spark: Spark, d: str) -> DataFrame:
    """X1, X2."""
    t = table(spark, d, "documents")
    return t.select("doc_id", identity.doc_id(F.col("uri")).alias("made_id"), (identity.doc_id(F.col("uri")) == F.col("id")).alias("same_id"), identity.content_hash(F.col("text")).alias("made_hash"))


def chunk_identity(spark: Spark, d: str) -> DataFrame:
    """X3, X4."""
    c, t = table(spark, d, "chunks"), table(spark, d, "documents").select("doc_id", F.col("id").alias("doc"), "title")
    j = c.join(t, "doc_id")
    return j.select("id", identity.chunk_id(F.col("doc"), F.col("ord")).alias("made_id"), F.sha2(identity.embed_text(F.col("title"), F.col("heading_path"), F.col("text")), 256).alias("embed_hash"))


def memory_identity(spark: Spark, d: str) -> DataFrame:
    """X5, F8 on the memories."""
    m = table(spark, d, "documents").filter("source_type = 'memory'")
    kind = F.split_part(F.regexp_replace("uri", "^memory://", ""), F.lit("/"), F.lit(1))
    return m.select("doc_id", kind.alias("kind"), identity.memory_id(kind, F.col("text")).alias("memory_id"), text.summary_title(F.col("text")).alias("summary"))


def tokenize_counts(spark: Spark, d: str) -> DataFrame:
    """occurrences and documents of each term."""
    t = table(spark, d, "documents").select("doc_id", F.explode(text.without_stop_words(text.tokens(text.fold_newlines(F.col("text"))))).alias("term"))
    per = t.groupBy("term", "doc_id").agg(F.count("*").alias("n"))
    return per.groupBy("term").agg(F.sum("n").alias("occurrences"), F.count("*").alias("documents"))


def excerpts(spark: Spark, d: str) -> DataFrame:
    """F7, F9, F11 as lengths and hashes of the whole results."""
    t = table(spark, d, "documents").filter("text is not null")
    return t.select("doc_id", F.sha2(text.excerpt(F.col("text")), 256).alias("excerpt"), F.length(text.head_and_tail(F.col("text"))).alias("window_chars"), F.sha2(text.clip_lines(F.col("text")), 256).alias("clipped"))


def prompts(spark: Spark, d: str) -> DataFrame:
    """F15, F14, F16 on user messages."""
    m = table(spark, d, "finished").select("row_id", F.col("message.content").alias("c")).filter("c is not null")
    return m.select("row_id", text.worth_retrieving(F.col("c")).alias("worth"), F.sha2(text.context_envelope(F.col("c"), "<ctx>", "</ctx>"), 256).alias("envelope"), F.length(text.with_prefix(F.col("c"), "search", True)).alias("prefixed"))


def link_keys(spark: Spark, d: str) -> DataFrame:
    """F6, F17."""
    return table(spark, d, "documents").select("doc_id", text.link_key(F.col("title")).alias("title_key"), text.uri_stem(F.col("uri")).alias("stem"), text.url_decoded(F.col("uri")).alias("decoded"))


def rendered_chunks(spark: Spark, d: str) -> DataFrame:
    """chunks as prompt entries."""
    p = pack_of(spark, d)
    j = p.chunks.join(p.documents.withColumnRenamed("id", "doc"), "doc")
    e = text.rendered_entry(F.col("title"), F.col("heading_path"), F.col("page_no"), F.col("uri"), F.col("text"))
    return j.select("id", F.octet_length(e).alias("bytes"), F.sha2(e, 256).alias("entry"))


def lifecycle_ladder(spark: Spark, d: str) -> DataFrame:
    """M11, M12 by status and stage."""
    p = pack_of(spark, d)
    return p.documents.groupBy("lifecycle").agg(F.count("*").alias("documents"), F.sum("inbound").alias("inbound"))


def fitted_vectors(spark: Spark, d: str) -> DataFrame:
    """M1, M2, M3: vectors cut to 32 numbers and padded to 80, of length one."""
    e = table(spark, d, "embeddings").filter(weights.usable_vector(F.col("embedding"), 64))
    short, long_ = weights.fitted(F.col("embedding"), 32), weights.fitted(F.col("embedding"), 80)
    return e.select("vec_id", F.round(short[0], 6).alias("first"), F.round(weights.norm(short), 6).alias("short_norm"), F.size(long_).alias("width"), F.round(weights.norm(long_), 6).alias("long_norm"))


def civil_dates(spark: Spark, d: str) -> DataFrame:
    """Documents indexed a day."""
    return table(spark, d, "documents").groupBy(weights.civil_date(F.unix_timestamp("indexed_at")).alias("day")).agg(F.count("*").alias("documents"))


QUERIES = {f.__name__: f for f in (doc_identity, chunk_identity, memory_identity, tokenize_counts, excerpts, prompts, link_keys, rendered_chunks, lifecycle_ladder, fitted_vectors, civil_dates)}
_ENTRY = "chr(10) || '[' || coalesce(title, '') || CASE WHEN coalesce(heading_path, '') <> '' THEN ' > ' || heading_path ELSE '' END || CASE WHEN page_no IS NOT NULL THEN ' p.' || page_no ELSE '' END || '](' || uri || ')' || chr(10) || text || chr(10)"
_CLIP = "CASE WHEN length(text) > 1200 THEN substr(text, 1, 1200) || '…' ELSE text END"
SQL = {
    "doc_identity": "SELECT doc_id, substr(sha256(uri), 1, 32) made_id, substr(sha256(uri), 1, 32) = id same_id, sha256(text) made_hash FROM documents",
    "chunk_identity": "SELECT c.id, d.id || ':' || ord made_id, sha256(coalesce(title, '') || CASE WHEN coalesce(heading_path, '') <> '' THEN ' > ' || heading_path ELSE '' END || chr(10) || chr(10) || c.text) embed_hash FROM chunks c JOIN documents d USING (doc_id)",
    "memory_identity": r"""SELECT doc_id, kind, substr(sha256(kind || '|' || trim(text, ' ')), 1, 12) memory_id, CASE WHEN coalesce(t, '') = '' THEN 'memory' WHEN length(t) > 80 THEN substr(t, 1, 80) || '…' ELSE t END summary
 FROM (SELECT doc_id, string_split(regexp_replace(uri, '^memory://', ''), '/')[1] kind, text, trim(regexp_extract(trim(text, ' '), '^[^.\n!?]*'), ' ') t FROM documents WHERE source_type = 'memory')""",
    "tokenize_counts": f"SELECT term, CAST(sum(n) AS BIGINT) occurrences, count(*) documents FROM (SELECT t AS term, doc_id, count(*) n FROM (SELECT doc_id, unnest({q.toks(q.FOLDED)}) t FROM documents) WHERE t <> '' AND t NOT IN ({q.STOP}) GROUP BY 1, 2) GROUP BY 1",
    "excerpts": f"""WITH l AS (SELECT doc_id, text, unnest(string_split(text, chr(10))) line, generate_subscripts(string_split(text, chr(10)), 1) i FROM documents WHERE text IS NOT NULL),
 c AS (SELECT *, sum(length(line) + CASE WHEN i > 1 THEN 1 ELSE 0 END) OVER (PARTITION BY doc_id ORDER BY i) used FROM l),
 k AS (SELECT doc_id, coalesce(string_agg(line, chr(10) ORDER BY i) FILTER (WHERE used <= 2000), '') clip FROM c GROUP BY doc_id)
 SELECT doc_id, sha256({_CLIP}) excerpt, CAST(CASE WHEN length(text) <= 12000 THEN length(text) ELSE 12005 END AS INTEGER) window_chars, sha256(CASE WHEN length(text) <= 2000 THEN text ELSE clip END) clipped FROM documents JOIN k USING (doc_id) WHERE text IS NOT NULL""",
    "prompts": r"""SELECT row_id, trim(c, ' ') <> '' AND len(regexp_split_to_array(trim(c, ' '), '\s+')) >= 4 worth, CASE WHEN trim(c, ' ') <> '' THEN sha256('<ctx>' || c || '</ctx>') END envelope, CAST(length('search_query: ' || c) AS INTEGER) prefixed FROM (SELECT row_id, message.content c FROM finished) WHERE c IS NOT NULL""",
    "link_keys": "SELECT doc_id, lower(trim(title, ' ')) title_key, lower(trim(string_split(string_split(uri, '/')[-1], '.')[1], ' ')) stem, url_decode(uri) decoded FROM documents",
    "rendered_chunks": f"WITH {q.ONCE} SELECT o.id, CAST(strlen({_ENTRY.replace('text ', 'o.text ')}) AS INTEGER) bytes, sha256({_ENTRY.replace('text ', 'o.text ')}) entry FROM once o JOIN documents d ON d.id = o.doc".replace("o.o.", "o."),
    "lifecycle_ladder": f"WITH {q.EDGES}, {q.LIFECYCLES} SELECT CAST(lifecycle AS INTEGER) lifecycle, count(*) documents, CAST(sum(coalesce(inbound, 0)) AS BIGINT) inbound FROM life LEFT JOIN inb USING (id) GROUP BY 1",
    "fitted_vectors": f"SELECT vec_id, round(embedding[1]::DOUBLE / sqrt(list_dot_product(embedding[1:32]::DOUBLE[], embedding[1:32]::DOUBLE[])), 6) AS first, CAST(1.0 AS DOUBLE) short_norm, 80 AS width, CAST(1.0 AS DOUBLE) long_norm FROM embeddings WHERE {q.USABLE}",
    "civil_dates": "SELECT strftime(indexed_at, '%Y-%m-%d') AS day, count(*) documents FROM documents GROUP BY 1",
}
