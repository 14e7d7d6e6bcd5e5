"""Queries of loaders, chunking and sessions."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from marrowlake.functions import chunking
from marrowlake.sources import files, pages, transcripts
from marrowlake.streaming.sessions import quiet_sessions
from marrowlake.runtime import table

Spark = SparkSession


def _messages(spark: Spark, d: str) -> DataFrame:
    m = table(spark, d, "finished").select("row_id", "session", "cwd", F.col("timestamp").alias("at"), F.col("message.role").alias("role"), F.col("message.content").alias("content"))
    return m.withColumn("role", F.coalesce("role", F.lit("unknown")))


def session_sections(spark: Spark, d: str) -> DataFrame:
    """Sections of all sessions in order of arrival."""
    s = transcripts.session_sections(_messages(spark, d), order=["row_id"])
    return s.select("session", "turn", "role", F.sha2("section", 256).alias("section"))


def session_transcripts(spark: Spark, d: str) -> DataFrame:
    """A document a session."""
    return transcripts.session_documents(_messages(spark, d), order=["row_id"]).select("session", "title", F.sha2("text", 256).alias("text_hash"), "turns", "project", "files")


def file_mentions(spark: Spark, d: str) -> DataFrame:
    """S19 on all documents."""
    t = table(spark, d, "documents").filter("text is not null")
    return t.select("doc_id", F.explode(transcripts.file_mentions(F.col("text"))).alias("file"))


def page_assembly(spark: Spark, d: str) -> DataFrame:
    """Documents of their pages, against the documents' texts."""
    a = pages.assembled(table(spark, d, "loaded_pages"))
    t = table(spark, d, "documents").select("doc_id", F.col("text").alias("known"))
    return a.join(t, "doc_id").select("doc_id", F.octet_length("text").alias("bytes"), F.size("pages").alias("pages"), (F.col("text") == F.col("known")).alias("same"))


def page_offsets(spark: Spark, d: str) -> DataFrame:
    """W9."""
    return pages.page_offsets(table(spark, d, "loaded_pages")).select("doc_id", "number", "offset")


def page_of_offset(spark: Spark, d: str) -> DataFrame:
    """The page that byte 1,000 of every paged document is on."""
    a = pages.assembled(table(spark, d, "loaded_pages"))
    return a.select("doc_id", pages.page_at(F.col("pages"), F.lit(1000)).alias("page"))


def wikilinks(spark: Spark, d: str) -> DataFrame:
    """Links in the texts, by target."""
    t = table(spark, d, "documents").filter("text is not null")
    return t.select("doc_id", F.explode(chunking.wikilinks(F.col("text"))).alias("target")).groupBy("target").agg(F.count("*").alias("links"), F.countDistinct("doc_id").alias("documents"))


def first_headings(spark: Spark, d: str) -> DataFrame:
    """S8, S9."""
    t = table(spark, d, "documents").filter("text is not null")
    body = chunking.without_frontmatter(F.col("text"))
    return t.select("doc_id", chunking.first_heading(body).alias("heading"))


def chunk_documents(spark: Spark, d: str) -> DataFrame:
    """All documents chunked anew."""
    c = chunking.chunked(table(spark, d, "documents").select("id", "title", "text"))
    return c.select("id", "ord", F.length("text").alias("chars"), "heading_path", F.sha2("embed_text", 256).alias("embed_hash"))


def quiet_event_sessions(spark: Spark, d: str) -> DataFrame:
    """Sessions of users' events that end with two hours of quiet."""
    return quiet_sessions(table(spark, d, "events"), gap="2 hours").groupBy("user_id").agg(F.count("*").alias("sessions"), F.max("events").alias("longest"))


def synthetic_corpus(spark: Spark, d: str) -> DataFrame:
    """A corpus of as many documents as the table has, by document."""
    n = table(spark, d, "documents").count()
    return files.synthetic_corpus(spark, n).groupBy("uri").agg(F.count("*").alias("chunks"), F.sum(F.size(F.split("text", " "))).alias("words"))


def session_agents(spark: Spark, d: str) -> DataFrame:
    """S20."""
    return table(spark, d, "documents").select("doc_id", transcripts.agent_of(F.col("uri")).alias("agent")).filter("agent is not null")


def upsert_edges(spark: Spark, d: str) -> DataFrame:
    """K1, K4, K6: edges when documents with a doc_id divisible by 5 are indexed anew without links and those divisible by 7 are deleted."""
    from marrowlake.operators import index
    from marrowlake.plans.graph_queries import _frames

    docs, _, edges = _frames(spark, d)
    kept = index.edges_after_upsert(edges, docs.filter("doc_id % 5 = 0").select("id"), edges.limit(0))
    gone = docs.filter("doc_id % 7 = 0").select("id")
    out = index.deleted({"e": (kept, "src")}, gone)["e"]
    return index.deleted({"e": (out, "dst")}, gone)["e"].groupBy("kind").agg(F.count("*").alias("edges"))


QUERIES = {
    f.__name__: f
    for f in (
        session_sections, session_transcripts, file_mentions, page_assembly, page_offsets, page_of_offset, wikilinks, first_headings, chunk_documents, quiet_event_sessions, synthetic_corpus, session_agents, upsert_edges,
    )
}

from marrowlake.plans import fragments as q  # noqa: E402

_PAGES = r"""p AS (SELECT doc_id, number, max(markdown) markdown FROM loaded_pages WHERE trim(regexp_replace(markdown, '\s+', ' ', 'g')) <> '' GROUP BY 1, 2),
 o AS (SELECT *, coalesce(sum(strlen(markdown) + 2) OVER (PARTITION BY doc_id ORDER BY number ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0)::BIGINT AS offset_ FROM p)"""
SQL = {
    "page_assembly": f"WITH {_PAGES}, a AS (SELECT doc_id, string_agg(markdown, chr(10) || chr(10) ORDER BY number) || chr(10) || chr(10) t, count(*) n FROM p GROUP BY 1) SELECT doc_id, CAST(strlen(t) AS INTEGER) AS bytes, CAST(n AS INTEGER) AS pages, t = text AS same FROM a JOIN documents USING (doc_id)",
    "page_offsets": f'WITH {_PAGES} SELECT doc_id, number, offset_ AS "offset" FROM o',
    "page_of_offset": f"WITH {_PAGES} SELECT doc_id, max(number) FILTER (WHERE offset_ <= 1000) AS page FROM o GROUP BY 1",
    "quiet_event_sessions": """WITH e AS (SELECT user_id, ts, CASE WHEN ts - lag(ts) OVER w < INTERVAL 2 HOUR THEN 0 ELSE 1 END s FROM events WINDOW w AS (PARTITION BY user_id ORDER BY ts)), i AS (SELECT user_id, sum(s) OVER (PARTITION BY user_id ORDER BY ts ROWS UNBOUNDED PRECEDING) n FROM e),
 c AS (SELECT user_id, n, count(*) k FROM i GROUP BY 1, 2) SELECT user_id, count(*) sessions, max(k) longest FROM c GROUP BY 1""",
    "session_agents": "SELECT doc_id, CASE WHEN starts_with(uri, 'claude-session://') THEN 'claude' ELSE 'codex' END AS agent FROM documents WHERE starts_with(uri, 'claude-session://') OR starts_with(uri, 'codex-session://')",
    "upsert_edges": f"WITH {q.LINKED_EDGES}, n AS (SELECT id, doc_id FROM documents) SELECT kind, count(*) edges FROM edges JOIN n s ON s.id = src JOIN n t ON t.id = dst WHERE s.doc_id % 5 <> 0 AND s.doc_id % 7 <> 0 AND t.doc_id % 7 <> 0 GROUP BY 1",
}
_EXT, _END, _HOSTS = (", ".join(f"'{x}'" for x in v) for v in (transcripts.EXTENSIONS, transcripts.HOST_ENDINGS, transcripts.HOSTS))


def _mentions(source: str, key: str) -> str:
    """CTEs that end in mention (key, file) of source (key, text), by splitting words, then tokens, then the dotted parts of a path's end."""
    return rf"""wd AS (SELECT {key}, unnest(regexp_split_to_array(text, '\s+')) w FROM {source}), tk AS (SELECT {key}, unnest(regexp_split_to_array(split_part(split_part(split_part(w, 'http://', 1), 'https://', 1), 'www.', 1), '[^\p{{L}}\p{{N}}_./-]+')) t FROM wd),
 pt AS (SELECT {key}, t, string_split(t, '/')[-1] e, string_split(string_split(t, '/')[-1], '.') x, string_split(string_split(t, '/')[1], '.') h FROM tk WHERE contains(t, '.')),
 ok AS (SELECT *, list_filter(range(2, len(x) + 1), lambda i: list_contains([{_EXT}], x[i]) AND regexp_matches(x[i - 1], '[A-Za-z]'))[1] a FROM pt WHERE NOT list_has_any(list_transform(h[2:], lambda y: lower(y)), [{_END}])),
 mention AS (SELECT DISTINCT {key}, ltrim(CASE WHEN a = 2 THEN left(t, length(t) - length(e)) ELSE '' END || x[a - 1] || '.' || x[a], './-') AS file FROM ok WHERE a IS NOT NULL)"""


_CODELESS = r"regexp_replace(regexp_replace({t}, '(?ms)^[ \t]*```.*?(?:^[ \t]*```[ \t]*$|\z)|^[ \t]*~~~.*?(?:^[ \t]*~~~[ \t]*$|\z)', ' ', 'g'), '`[^`\n]*`', ' ', 'g')"
_BODY = r"regexp_replace(regexp_replace(text, '^﻿', ''), '(?s)\A---[ \t]*\r?\n.*?\r?\n(?:---|\.\.\.)[ \t]*(?:\r?\n|\z)', '')"
_TARGET = "coalesce(" + ", ".join(f"CASE WHEN NOT regexp_matches(json_extract_string(i.input, '$.{k}'), '^[\\[{{]') THEN json_extract_string(i.input, '$.{k}') END" for k in transcripts.TARGET_KEYS) + ", '')"
_RESULT = "trim(CASE json_type(i.content) WHEN 'ARRAY' THEN array_to_string(list_filter(list_transform(from_json(i.content, '[{\"type\":\"VARCHAR\",\"text\":\"VARCHAR\"}]'), lambda y: y.text), lambda z: trim(coalesce(z, ''), ' ') <> ''), chr(10)) ELSE json_extract_string(i.content, '$') END, ' ')"
_LINES = f"""CASE i.type WHEN 'tool_use' THEN '[tool: ' || coalesce(i.name, 'tool') || CASE WHEN {_TARGET} <> '' THEN ' ' || {_TARGET} ELSE '' END || ']'
  WHEN 'tool_result' THEN CASE WHEN {_RESULT} <> '' THEN '[result] ' || CASE WHEN length({_RESULT}) > 600 THEN substr({_RESULT}, 1, 600) || '…' ELSE {_RESULT} END END WHEN 'thinking' THEN NULL ELSE i.text END"""
_SECTIONS = rf"""fm AS (SELECT row_id, session, cwd, "timestamp" at_, coalesce(message.role, 'unknown') r, message.content c FROM finished),
 ff AS (SELECT *, CASE WHEN regexp_matches(c, '^\s*\[') AND json_valid(c) THEN array_to_string(list_filter(list_transform(from_json(c, '[{{"type":"VARCHAR","text":"VARCHAR","name":"VARCHAR","input":"JSON","content":"JSON"}}]'), lambda i: {_LINES}), lambda z: trim(coalesce(z, ''), ' ') <> ''), chr(10)) ELSE c END x FROM fm),
 fs AS (SELECT *, row_number() OVER (PARTITION BY session ORDER BY row_id) turn FROM ff WHERE trim(x, ' ') <> ''), sec AS (SELECT session, CAST(turn AS INTEGER) turn, r, '## ' || r || ' (turn ' || turn || ')' || chr(10) || chr(10) || x || chr(10) || chr(10) s FROM fs)"""
SQL |= {
    "file_mentions": f"WITH {_mentions('(SELECT doc_id, text FROM documents WHERE text IS NOT NULL)', 'doc_id')} SELECT doc_id, file FROM mention WHERE file NOT IN ({_HOSTS})",
    "wikilinks": rf"WITH l AS (SELECT doc_id, trim(unnest(regexp_extract_all({_CODELESS.format(t='text')}, '\[\[([^\[\]|#\n]+)(?:[#|][^\[\]\n]*)?\]\]', 1)), ' ') t FROM documents WHERE text IS NOT NULL) SELECT t AS target, count(*) links, count(DISTINCT doc_id) documents FROM l WHERE t <> '' GROUP BY 1",
    "first_headings": rf"SELECT doc_id, nullif(trim(regexp_extract({_CODELESS.format(t=_BODY)}, '(?m)^ {{0,3}}#{{1,6}}[ \t]+(.*?)[ \t]*#*[ \t]*$', 1), ' '), '') heading FROM documents WHERE text IS NOT NULL",
    "session_sections": f'WITH {_SECTIONS} SELECT session, turn, r AS "role", sha256(s) AS section FROM sec',
    "session_transcripts": rf"""WITH {_SECTIONS}, tx AS (SELECT session, string_agg(s, '' ORDER BY turn) AS text, count(*) turns FROM sec GROUP BY 1), pj AS (SELECT session, arg_min(cwd, row_id) FILTER (WHERE coalesce(cwd, '') <> '') cwd FROM fm GROUP BY 1),
 {_mentions('tx', 'session')}, fl AS (SELECT session, list(file ORDER BY file) files FROM mention WHERE file NOT IN ({_HOSTS}) GROUP BY 1)
 SELECT tx.session, coalesce(string_split(cwd, '/')[-1], 'unknown') || ' session (' || left(tx.session, 8) || ')' title, sha256(text) text_hash, turns, cwd AS project, coalesce(files, []) files FROM tx LEFT JOIN pj USING (session) LEFT JOIN fl USING (session)""",
}
