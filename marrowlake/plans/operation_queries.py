"""Queries of operation: publishing and backups (K5-K8, K12-K19, T4), loaders of files (S1, S2, S7, S16-S18, S21-S24), guards (P1, P2, P5, P9), memories (R12, A28), streams (T1, T3, T5, T6), explained
and reranked search (R2, R3, R6)."""

from __future__ import annotations

import json

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from marrowlake.functions import text, weights
from marrowlake.functions.identity import content_hash, memory_id
from marrowlake.operators import budget, graph, index, knn, memory, usage
from marrowlake.operators import pack as packs
from marrowlake.operators.backup import Backups
from marrowlake.operators.evaluation import memory_bench
from marrowlake.plans import fragments as q
from marrowlake.plans import retrieve
from marrowlake.plans.evaluation_queries import _memories
from marrowlake.plans.profiles import SURFACES, TIERS, suggestion
from marrowlake.plans.retrieval_queries import NOW, pack_of, query_set
from marrowlake.runtime import cut, scratch_path, table
from marrowlake.sources import files, transcripts
from marrowlake.streaming import sessions

Spark = SparkSession


# ---- index and pack ----


def knn_cells(spark: Spark, d: str) -> DataFrame:
    """The stored cells searched at a width that reaches all of them, which must give what the exact search gives."""
    p = pack_of(spark, d)
    near = knn.knn(query_set(spark, d, p).filter("vec is not null"), p.vectors, 10, p.dims, cells=p.cells, width=1 << 40)
    return near.select(F.col("query_id").cast("long").alias("query_id"), "id", F.round("relevance", 6).alias("relevance"), "position")


def ann_recall(spark: Spark, d: str) -> DataFrame:
    """Per tier, whether its width finds at least 0.95 of the exact 20 nearest of the query set."""
    p = pack_of(spark, d)
    asked = query_set(spark, d, p).filter("vec is not null")
    exact = cut(knn.knn(asked, p.vectors, 20, p.dims).select("query_id", "id"))
    out = None
    for t in TIERS:
        near = knn.knn(asked, p.vectors, 20, p.dims, cells=p.cells, width=t.efs).select("query_id", "id")
        both = exact.join(near.withColumn("hit", F.lit(1)), ["query_id", "id"], "left").agg(F.lit(t.name).alias("tier"), F.lit(t.efs).alias("efs"), (F.count("hit") >= 0.95 * F.count("*")).alias("enough"))
        out = both if out is None else out.unionByName(both)
    return out


def hybrid_cells(spark: Spark, d: str) -> DataFrame:
    """R1 at tier 1 as a user would run it, with the tier's width."""
    p = pack_of(spark, d)
    return retrieve.search(query_set(spark, d, p), p, TIERS[1], now=NOW).select("query_id", "position", "chunk_id", F.round("relevance", 6).alias("relevance"))


def publish_steps(spark: Spark, d: str) -> DataFrame:
    """A pack published in two phases, asked for again with the same stamps, then with one stamp changed."""
    docs, chunks, path = table(spark, d, "documents"), table(spark, d, "chunks"), scratch_path(spark, "pack")
    stamps = docs.select("uri", F.coalesce("content_hash", F.lit("")).alias("stamp"))
    first = packs.publish(spark, path, docs, chunks, stamps=stamps, two_phases=True)
    words = packs.open_pack(spark, path, version=first.manifest["version"] - 1)
    again = packs.publish(spark, path, docs, chunks, stamps=stamps)
    changed = packs.publish(spark, path, docs, chunks, stamps=stamps.withColumn("stamp", F.when(F.col("uri") == docs.agg(F.min("uri")).first()[0], "x").otherwise(F.col("stamp"))))
    steps = (("texts first", words), ("vectors", first), ("unchanged", again), ("changed", changed))
    rows = [(s, p.manifest["version"], p.manifest["rows"], p.manifest["rows_with_vectors"], p.stamps.count()) for s, p in steps]
    return spark.createDataFrame(rows, "step string, version int, rows long, rows_with_vectors long, stamps long")


def pack_meta(spark: Spark, d: str) -> DataFrame:
    """K7: pairs that are set, replaced and removed, read from the newest manifest."""
    docs, chunks, path = table(spark, d, "documents"), table(spark, d, "chunks"), scratch_path(spark, "pack")
    p = packs.publish(spark, path, docs, chunks)
    for key, value in (("documents", "0"), ("note", "x"), ("documents", str(docs.count())), ("note", None)):
        p = packs.set_meta(p, key, value)
    return spark.createDataFrame(sorted(packs.open_pack(spark, path).manifest["meta"].items()), "key string, value string")


def pack_columns(spark: Spark, d: str) -> DataFrame:
    """What the pack stores of every document: inbound links, stage, last use (from hits)."""
    docs, chunks = table(spark, d, "documents"), table(spark, d, "chunks")
    used = usage.folded(table(spark, d, "hits").select(F.substring_index("chunk_id", ":", 1).alias("doc_id"), F.unix_timestamp("searched_at").alias("ts")))
    return packs.publish(spark, scratch_path(spark, "pack"), docs, chunks, usage=used).documents.select("id", "inbound", "lifecycle", "last_used")


def compacted_pack(spark: Spark, d: str) -> DataFrame:
    """K8: the pack copied without documents whose doc_id is divisible by 7; what each table holds."""
    docs = table(spark, d, "documents")
    p = packs.compacted(pack_of(spark, d), scratch_path(spark, "pack"), docs.filter("doc_id % 7 = 0").select("id"))
    n = lambda df, name: df.agg(F.lit(name).alias("name"), F.count("*").alias("rows"))
    return n(p.chunks, "chunks").unionByName(n(p.vectors, "vectors")).unionByName(n(p.documents, "documents")).unionByName(p.postings.agg(F.lit("postings").alias("name"), F.count("*").alias("rows")))


def vector_backfill(spark: Spark, d: str) -> DataFrame:
    """100 chunks given vectors of a deterministic embedder, in batches of 64, and how many wait after them."""
    made, left = index.backfilled(table(spark, d, "chunks"), index.hash_embedding(64), 100, 64)
    return made.agg(F.count("*").alias("made"), F.min("id").alias("first"), F.max("id").alias("last"), F.min(F.size("embedding")).alias("dims")).crossJoin(left)  # single rows


def embeddings_set(spark: Spark, d: str) -> DataFrame:
    """K5: first chunks of documents with an even doc_id given a vector of ones."""
    c = table(spark, d, "chunks").select("id", "embedding").groupBy("id").agg(F.max("embedding").alias("embedding"))
    made = table(spark, d, "documents").filter("doc_id % 2 = 0").select(F.concat("id", F.lit(":0")).alias("id"), F.array_repeat(F.lit(1.0).cast("float"), 64).alias("embedding"))
    return index.with_embeddings(c, made).groupBy((F.element_at("embedding", 1) == 1).alias("set")).agg(F.count("*").alias("chunks"))


def backup_restore(spark: Spark, d: str) -> DataFrame:
    """Documents backed up, backed up again unchanged and once more with one document changed; then pruned to two generations and restored."""
    docs = table(spark, d, "documents").select("id", "uri", "title", "tags", "n_chars")
    b = Backups(spark, scratch_path(spark, "backup"))
    one = docs.agg(F.min("id")).first()[0]
    changed = docs.withColumn("title", F.when(F.col("id") == one, F.lit("another")).otherwise(F.col("title")))
    up = [b.back_up(t, "id")["uploaded"] for t in (docs, docs, changed)]
    b.prune(2)
    rows = []
    for g, want in ((2, docs), (3, changed)):
        got = b.restore(g)
        rows.append((g, up[g - 1], got.count(), got.exceptAll(want).isEmpty() and want.exceptAll(got).isEmpty()))
    return spark.createDataFrame(rows, "generation int, uploaded int, rows long, same boolean")


def scan_states(spark: Spark, d: str) -> DataFrame:
    """Run 3 against the stamps of run 1; files whose uri's hash begins with 0 are put off, with f cannot be loaded."""
    from marrowlake.plans.index_queries import _listing

    now, old = _listing(spark, d, 3), _listing(spark, d, 1).filter("stamp is not null")
    mark = F.substring(F.sha2("uri", 256), 1, 1)
    got = index.scan_result(now.select("uri", "stamp"), old, now.filter(mark == "0"), now.filter(mark == "f"))
    halves = [got.filter(F.substring(F.sha2("uri", 256), 2, 1) < "8"), got.filter(F.substring(F.sha2("uri", 256), 2, 1) >= "8")]
    return index.merged_scans(halves).groupBy("state", "live").agg(F.count("*").alias("files"), F.count("stamp").alias("with_stamp"))


def document_details(spark: Spark, d: str) -> DataFrame:
    """A10: every document with its chunks in order."""
    from marrowlake.plans.graph_queries import _frames

    got = graph.document_details(*_frames(spark, d))
    return got.select("id", "chunks", "inbound", "lifecycle", F.sha2(F.array_join("chunk_ids", ","), 256).alias("chunk_ids"))


# ---- sources ----


def vault_documents(spark: Spark, d: str) -> DataFrame:
    """The Markdown documents written as a vault of files with frontmatter, found below two overlapping roots and loaded again."""
    docs = table(spark, d, "documents").filter("source_type = 'markdown' and text is not null and text <> ''")
    head = F.concat(F.lit("---\ntags: [a, b]\nstatus: accepted\ntitle: "), F.lit('"t'), F.col("doc_id").cast("string"), F.lit('"'), F.lit("\n---\n"))
    path = scratch_path(spark, "vault")
    docs.select("doc_id", F.concat(head, "text").alias("value")).repartition(8, "doc_id").write.partitionBy("doc_id").text(f"{path}/notes")
    got = files.markdown_documents(files.listing(spark, [path, f"{path}/notes"], "*.txt"))
    number = F.regexp_extract("uri", r"doc_id=(\d+)", 1).cast("long")
    body = F.regexp_replace("text", r"\n\z", "")  # the writer ends a file with a line break
    return got.select(number.alias("doc_id"), "title", F.array_join("tags", ",").alias("tags"), F.get_json_object("meta", "$.status").alias("status"), content_hash(body).alias("text_hash"))


def html_pages(spark: Spark, d: str) -> DataFrame:
    """Web documents as pages with navigation, a footer and a list of links around their first 200 characters; a page that is too large is refused."""
    t = table(spark, d, "documents").filter("source_type = 'web' and text is not null and title is not null")
    plain = F.regexp_replace(F.substring("text", 1, 200), r"[<>&\s\x00]+", " ")
    esc = F.regexp_replace(F.trim(F.regexp_replace(plain, "^[#>| *-]+", "")), r"\s+", " ")
    page = F.concat(F.lit("<html><head><title>"), F.regexp_replace("title", r"[<>&]", ""), F.lit("</title></head><body><nav><a href='/'>Home</a></nav><ul><li><a href='/a'>More links</a></li><li><a href='/b'>Other links</a></li></ul><p>"), esc, F.lit("</p><footer>Imprint</footer></body></html>"))
    page = F.when(F.col("doc_id") % 10 == 0, F.repeat(page, 40)).otherwise(page)
    got = files.html_documents(t.select(F.col("doc_id").cast("string").alias("url"), page.alias("html")), most_bytes=6_000)
    return got.select(F.col("url").cast("long").alias("doc_id"), content_hash(F.col("text")).alias("text_hash"), F.col("refused").isNotNull().alias("refused"))


def codex_sessions(spark: Spark, d: str) -> DataFrame:
    """The session log written as event lines of the second agent, with a tool call behind each message, and read by its loader."""
    m = table(spark, d, "finished").filter("session is not null and message.role in ('user', 'assistant')").select("session", "row_id", F.col("message.role").alias("role"), F.regexp_replace(F.coalesce("message.content", F.lit("")), r"[\[\]{}<>#]", "").alias("content"))
    part = F.array(F.struct(F.lit("input_text").alias("type"), F.col("content").alias("text")))
    message = F.to_json(F.struct(F.lit("response_item").alias("type"), F.struct(F.lit("message").alias("type"), "role", part.alias("content")).alias("payload")))
    call = F.to_json(F.struct(F.lit("response_item").alias("type"), F.struct(F.lit("local_shell_call").alias("type"), F.struct(F.lit('["bash","-lc","ls"]').alias("command")).alias("action")).alias("payload")))
    hidden = F.to_json(F.struct(F.lit("response_item").alias("type"), F.struct(F.lit("message").alias("type"), F.lit("user").alias("role"), F.array(F.struct(F.lit("input_text").alias("type"), F.lit("<env>x</env>").alias("text"))).alias("content")).alias("payload")))
    lines = m.select(F.concat(F.lit("rollout-"), "session", F.lit(".jsonl")).alias("path"), "row_id", F.posexplode(F.array(message, call, hidden)).alias("i", "value")).select("path", (F.col("row_id") * 3 + F.col("i")).alias("line"), "value")
    got = transcripts.codex_documents(lines)
    return got.select(F.regexp_extract("path", r"rollout-(.*)\.jsonl", 1).alias("session"), F.col("turns").cast("long").alias("turns"), content_hash(F.col("text")).alias("text_hash"))


def injection_audit(spark: Spark, d: str) -> DataFrame:
    """The hits of each query as an injected context in a session log; entries by scheme."""
    h = table(spark, d, "hits").select("query_id", "uri").distinct()
    body = F.array_join(F.transform(F.array_sort(F.collect_set("uri")), lambda u: F.concat(F.lit("[t]("), u, F.lit(")"))), "\n")
    lines = h.groupBy("query_id").agg(body.alias("body"))
    value = F.to_json(F.struct(F.struct(F.lit("hook_additional_context").alias("type"), F.col("body").alias("content")).alias("attachment")))
    return files.audit(files.injections(lines.select(F.lit("log").alias("path"), F.col("query_id").cast("int").alias("line"), value.alias("value"))))


def golden_cases(spark: Spark, d: str) -> DataFrame:
    """A golden set with a case a source of mix_targets and a memory case, read from its file."""
    names = [r["source"] for r in table(spark, d, "mix_targets").select("source").orderBy("source").collect()]  # a fixed table
    body = "".join(f"[[case]]\nquery = {json.dumps('about ' + s)}\n" + (f"expect = {json.dumps('src://' + s)}\n" if i % 3 else "expect_none = true\n") + "\n" for i, s in enumerate(names))
    body += '[[memory_case]]\nkind = "fact"\ntext = "the cache is cold"\nqueries = ["cold cache"]\n'
    path = scratch_path(spark, "golden")
    spark.createDataFrame([(body,)], "value string").coalesce(1).write.text(path)
    got = files.golden_text(spark, path)
    cases = files.read_golden(spark, got).select(F.lit("case").alias("kind"), "query", F.size("acceptable").alias("acceptable"), "negative")
    return cases.unionByName(files.read_memory_cases(spark, got).select(F.lit("memory").alias("kind"), F.get("queries", F.lit(0)).alias("query"), F.size("negatives").alias("acceptable"), F.lit(False).alias("negative")))


def usage_log(spark: Spark, d: str) -> DataFrame:
    """The events as lines of a usage log, every tenth line broken, parsed and folded."""
    e = table(spark, d, "events").withColumn("t", F.unix_timestamp("ts"))
    line = F.when(F.col("event_id") % 10 == 0, F.concat(F.lit("at "), F.col("t").cast("string"))).otherwise(F.concat_ws(" ", F.col("t").cast("string"), F.col("user_id").cast("string")))
    return usage.folded(usage.parse_log(e.select(line.alias("value"))))


def memory_round_trip(spark: Spark, d: str) -> DataFrame:
    """All memories exported as lines and imported where those with an even doc_id are stored."""
    m = _memories(spark, d)
    lines = memory.exported(m.withColumn("source_hash", F.lit(None).cast("string")).withColumn("source_stamp", F.lit(None).cast("string")))
    stored = m.filter("doc_id % 2 = 0").select(memory_id(F.col("kind"), F.col("text")).alias("id"))
    return memory.imported(lines, stored).select("id", "kind", F.sha2("text", 256).alias("text_hash"))


# ---- memories, guards, labels ----


def _known(spark: Spark, d: str) -> DataFrame:
    return _memories(spark, d).groupBy(memory_id(F.col("kind"), F.col("text")).alias("id")).agg(F.min("kind").alias("kind"), F.min("text").alias("text"), F.min("created").alias("created"))


def memory_edits(spark: Spark, d: str) -> DataFrame:
    """Every memory whose id begins with 0 gets a line more, those with 1 the text they have, those with 2 all the same text; an unknown id is edited too."""
    m = _known(spark, d)
    first = F.substring("id", 1, 1)
    new = m.filter(first.isin("0", "1", "2")).select("id", F.when(first == "0", F.concat("text", F.lit("\nmore"))).when(first == "1", F.col("text")).otherwise("one and the same").alias("text"))
    _, outcomes = memory.edited(m, new.unionByName(spark.createDataFrame([("nothing", "x")], "id string, text string")))
    return outcomes.groupBy("outcome").agg(F.count("*").alias("edits"))


def memory_forgets(spark: Spark, d: str) -> DataFrame:
    """Memories forgotten by the first character, the first six and an unknown prefix; what is left is rebuilt without loss."""
    m = _known(spark, d)
    prefixes = m.select(F.substring("id", 1, 6).alias("prefix")).unionByName(m.select(F.substring("id", 1, 1).alias("prefix"))).unionByName(spark.createDataFrame([("zzz",)], "prefix string")).distinct()
    left, outcomes = memory.forgotten(m, prefixes)
    kept = memory.rebuilt(left, left.select("id")).agg(F.lit("left").alias("status"), F.count("*").alias("n"))
    return outcomes.groupBy("status").agg(F.count("*").alias("n")).unionByName(kept)


def memory_targets(spark: Spark, d: str) -> DataFrame:
    """The first document of each query's hits is the memory it should find, at a gate of 0.6, by source type."""
    h = table(spark, d, "hits").select(F.col("query_id"), "chunk_id", F.col("relevance").cast("double"), "source_type")
    targets = h.groupBy("query_id").agg(F.min("chunk_id").alias("memory_id"), F.min_by("source_type", F.struct("chunk_id", "source_type")).alias("kind"))
    got = memory_bench(h, targets, 0.6)
    return got.groupBy("kind").agg(F.count("*").alias("queries"), F.count_if("found").alias("found"), F.round(F.avg("best"), 6).alias("mean_best"))


def interval_guard(spark: Spark, d: str) -> DataFrame:
    """Per run, whether an index is due when it starts, by when the run before it finished."""
    r = table(spark, d, "index_runs")
    w = Window.orderBy("run_id")  # a row a run
    t = r.select("run_id", F.unix_timestamp("started_at").alias("now"), F.lag(F.unix_timestamp("finished_at")).over(w).alias("last"))
    return t.select("run_id", index.may_reindex(F.col("last"), F.col("now")).alias("due"), index.may_reindex(F.col("last"), F.col("now"), 10_000_000).alias("due_later"))


def gate_partition(spark: Spark, d: str) -> DataFrame:
    """P5: the hits of every query below the gate, admitted and over the budget."""
    p = pack_of(spark, d)
    h = table(spark, d, "hits").groupBy("query_id", "chunk_id").agg(F.max("relevance").cast("double").alias("relevance"))
    e = h.filter("relevance >= 0.5").withColumn("position", F.row_number().over(Window.partitionBy("query_id").orderBy(F.desc("relevance"), "chunk_id")))
    e = e.join(p.chunks.select(F.col("id").alias("chunk_id"), F.col("text").alias("entry")), "chunk_id").filter("entry is not null")
    e = e.withColumn("position", F.row_number().over(Window.partitionBy("query_id").orderBy("position")))
    taken = budget.admitted(e, 1500).select("query_id", "chunk_id", F.lit(True).alias("admitted"))
    label = retrieve.partition_label(F.col("relevance"), F.col("admitted"), 0.5)
    return h.join(taken, ["query_id", "chunk_id"], "left").groupBy("query_id", label.alias("label")).agg(F.count("*").alias("hits"))


def response_order(spark: Spark, d: str) -> DataFrame:
    """Chunks as an embedder's answers, one response a document: documents whose numbers are not exactly 0 .. n - 1, and the order of the others."""
    c = table(spark, d, "chunks").select("id", "doc_id", "ord").filter("doc_id is not null").distinct()
    bad = index.response_faults(c, "doc_id", "ord")
    good = index.ordered_response(c.join(bad, "doc_id", "left_anti"), "doc_id", "ord", "id")
    return good.select("doc_id", F.size("values").alias("n"), F.element_at("values", -1).alias("last")).unionByName(bad.select("doc_id", F.lit(-1).alias("n"), F.lit(None).cast("string").alias("last")))


def key_suggestions(spark: Spark, d: str) -> DataFrame:
    """The sources of mix_targets with a letter left out at the end, and the name that is suggested for each."""
    names = [r["source"] for r in table(spark, d, "mix_targets").select("source").orderBy("source").collect()]  # a fixed table
    return spark.createDataFrame([(n[:-1], suggestion(n[:-1], names)) for n in names], "typed string, suggested string")


def tier_table(spark: Spark, d: str) -> DataFrame:
    """The tiers with their candidates and widths, and which surface uses them."""
    rows = [(i, t.name, t.candidates, t.efs, t.hops, next((s for s, v in SURFACES.items() if v[0] == i), None)) for i, t in enumerate(TIERS)]
    return spark.createDataFrame(rows, "tier int, name string, candidates int, efs int, hops int, surface string")


def stage_bytes(spark: Spark, d: str) -> DataFrame:
    """doc_id modulo 6 as the byte of a stage."""
    return table(spark, d, "documents").groupBy(weights.lifecycle_of_byte(F.col("doc_id") % 6).alias("stage")).agg(F.count("*").alias("documents"))


def stripped_spans(spark: Spark, d: str) -> DataFrame:
    """texts with a tagged span put before them, and every third with an open one behind."""
    t = table(spark, d, "documents").filter("text is not null and text not like '%<hook%'")
    planted = F.concat(F.lit("<hook-note a='1'>x\ny</hook-note>"), "text", F.when(F.col("doc_id") % 3 == 0, "<hook>open").otherwise(""))
    return t.select("doc_id", F.sha2(text.strip_spans(planted, "hook"), 256).alias("text_hash"))


def session_names(spark: Spark, d: str) -> DataFrame:
    """file names of sessions, with and without the prefix that hides the id."""
    s = table(spark, d, "finished").filter("session is not null").select("session").distinct()
    stem = F.concat(F.lit("rollout-2026-01-01T00-00-00-"), F.rpad("session", 36, "0"))
    return s.select("session", text.session_id(stem).alias("hidden"), text.session_id(F.col("session")).alias("plain"))


def distill_windows(spark: Spark, d: str) -> DataFrame:
    """transcripts of all sessions cut down to what a distiller reads."""
    m = table(spark, d, "finished").filter("session is not null").select("session", "row_id", "cwd", F.col("timestamp").alias("at"), F.coalesce("message.role", F.lit("unknown")).alias("role"), F.concat(F.lit("say "), F.col("row_id").cast("string"), F.lit("\n[tool: Read x]")).alias("content"))
    t = transcripts.session_documents(m, order=["row_id"])
    return t.select("session", F.sha2(text.distill_input(F.col("text"), 40, 60), 256).alias("window"))


def enrichment_prompts(spark: Spark, d: str) -> DataFrame:
    """the question that each document would be enriched by, and its text behind an answer that every other document gets."""
    t = table(spark, d, "documents").filter("text is not null")
    answer = F.when(F.col("doc_id") % 2 == 0, F.lit(" an answer "))
    return t.select("doc_id", F.sha2(text.enrichment_prompt(F.col("title"), F.col("text")), 256).alias("prompt"), F.sha2(text.enriched(F.col("text"), answer), 256).alias("enriched"))


def hit_similarity(spark: Spark, d: str) -> DataFrame:
    """Similarity of each query's best hit with its others."""
    h = table(spark, d, "hits").groupBy("query_id", "chunk_id").agg(F.max("relevance").alias("relevance"), F.max("doc_id").alias("doc_id"))
    c = pack_of(spark, d).chunks.select(F.col("id").alias("chunk_id"), F.array_distinct(F.filter(F.split("text", r"\s+"), lambda w: w != "")).alias("words"))
    h = h.join(c, "chunk_id").filter("words is not null")
    best = h.groupBy("query_id").agg(F.min_by(F.struct("chunk_id", "doc_id", "words"), F.struct(-F.col("relevance"), "chunk_id")).alias("b"))
    j = h.join(best, "query_id").filter("chunk_id <> b.chunk_id")
    return j.select("query_id", "chunk_id", F.round(weights.mmr_similarity(F.col("doc_id"), F.col("words"), F.col("b.doc_id"), F.col("b.words")), 6).alias("similarity"))


def budget_bodies(spark: Spark, d: str) -> DataFrame:
    """The text that each query's budget takes, with the number of entries."""
    p = pack_of(spark, d)
    h = table(spark, d, "hits").groupBy("query_id", "chunk_id").agg(F.max("relevance").alias("relevance"))
    e = h.withColumn("position", F.row_number().over(Window.partitionBy("query_id").orderBy(F.desc("relevance"), "chunk_id")))
    e = e.join(p.chunks.select(F.col("id").alias("chunk_id"), F.col("text").alias("entry")), "chunk_id").filter("entry is not null")
    return budget.budget_summary(budget.admitted(e, 500)).select("query_id", "admitted", F.sha2("body", 256).alias("body"))


# ---- search ----


def search_report(spark: Spark, d: str) -> DataFrame:
    """What each stage of tier 0 did for each query above the hook's gate and within its budget."""
    p = pack_of(spark, d)
    _, report = retrieve.explained(query_set(spark, d, p), p, TIERS[0], SURFACES["hook"][1], SURFACES["hook"][2], now=NOW, exact=True)
    return report.withColumn("injected_ids", F.array_join("injected_ids", ","))


def rerank_overlap(spark: Spark, d: str) -> DataFrame:
    """The ten best of tier 0, the first five put in order of the share of the query's terms they hold."""
    p = pack_of(spark, d)
    asked = query_set(spark, d, p)
    scorer = retrieve.overlap_scorer(asked.select("query_id", "text"))
    hits = retrieve.search(asked, p, TIERS[0], now=NOW, exact=True, reranker=lambda pool: retrieve.reranked(pool, scorer, 5))
    return hits.select("query_id", "chunk_id", "position", F.round(F.when(F.col("position") <= 5, F.col("score")), 6).alias("value"))


# ---- streams ----


def stream_usage(spark: Spark, d: str) -> DataFrame:
    """Usage logs that come in two deliveries, the second repeating nothing of the first; each run reads what is new and merges it into the state."""
    e = table(spark, d, "events").select("event_id", F.concat_ws(" ", F.unix_timestamp("ts").cast("string"), F.col("user_id").cast("string")).alias("value"))
    logs, state = scratch_path(spark, "logs"), scratch_path(spark, "state")
    for half in (0, 1):
        e.filter(F.col("event_id") % 2 == half).select("value").write.mode("append").text(logs)
        lines = spark.readStream.format("text").load(logs)

        def merge(batch: DataFrame, number: int, half: int = half) -> None:
            usage.folded(usage.parse_log(batch)).write.mode("overwrite").parquet(f"{state}/{half}-{number:06d}")  # a batch given again replaces its own folder

        sessions.run_into(lines, f"{state}-checkpoint", merge, "append").awaitTermination()
    parts = spark.read.option("recursiveFileLookup", True).parquet(state)
    return usage.merged(parts.limit(0), parts)


def stream_once(spark: Spark, d: str) -> DataFrame:
    """T5, batch form: the messages of the session log that are delivered twice, once."""
    f = table(spark, d, "finished").select("session", "type", "cwd", "timestamp", F.col("message.role").alias("role"), F.col("message.content").alias("content"), "loaded_at")
    once = sessions.once_within(f, ["session", "type", "cwd", "timestamp", "role", "content"], "loaded_at")
    return once.groupBy("session").agg(F.count("*").alias("messages"))


def young_events(spark: Spark, d: str) -> DataFrame:
    """Events of the last 30 days before the newest one, by type."""
    e = table(spark, d, "events")
    now = str(e.agg(F.max("ts")).first()[0])
    return sessions.young(e, "ts", now, 30).groupBy("event_type").agg(F.count("*").alias("events"))


QUERIES = {
    f.__name__: f
    for f in (
        knn_cells, ann_recall, hybrid_cells, publish_steps, pack_meta, pack_columns, compacted_pack, vector_backfill, embeddings_set, backup_restore, scan_states, document_details, vault_documents, html_pages, codex_sessions,
        injection_audit, golden_cases, usage_log, memory_round_trip, memory_edits, memory_forgets, memory_targets, interval_guard, gate_partition, response_order, key_suggestions, tier_table, stage_bytes, stripped_spans,
        session_names, distill_windows, enrichment_prompts, hit_similarity, budget_bodies, search_report, rerank_overlap, stream_usage, stream_once, young_events,
    )
}
_MEM = "m AS (SELECT string_split(regexp_replace(uri, '^memory://', ''), '/')[1] kind, text, CAST(floor(epoch(indexed_at)) AS BIGINT) created, doc_id FROM documents WHERE source_type = 'memory' AND text IS NOT NULL), k AS (SELECT *, substr(sha256(kind || '|' || trim(text, ' ')), 1, 12) id FROM m), known AS (SELECT id, min(kind) kind, min(text) AS text FROM k GROUP BY 1)"
_HITS = "h AS (SELECT query_id, chunk_id, max(relevance)::DOUBLE r, max(doc_id) doc_id FROM hits GROUP BY 1, 2)"
_LEFT = "SELECT once.id, v FROM once LEFT JOIN vec ON vec.id = once.id JOIN documents d ON d.id = once.doc WHERE d.doc_id % 7 <> 0"


def _budget(tokens: int, least: float) -> str:
    """Entries of hits in order of relevance, and which of them the budget takes."""
    room = tokens * 4
    return f"""{q.ONCE}, {_HITS}, e AS (SELECT query_id, chunk_id, r, o.text, strlen(o.text) n, row_number() OVER (PARTITION BY query_id ORDER BY r DESC, chunk_id) p FROM h JOIN once o ON o.id = chunk_id WHERE r >= {least} AND o.text IS NOT NULL),
 s AS (SELECT *, sum(n) OVER (PARTITION BY query_id ORDER BY p) after FROM e), t AS (SELECT *, {room} - (after - n) room, sum(CASE WHEN after > {room} THEN 1 ELSE 0 END) OVER (PARTITION BY query_id ORDER BY p) overs FROM s),
 taken AS (SELECT *, CASE WHEN overs > 0 THEN substr(text, 1, CAST(room AS BIGINT)) ELSE text END shown FROM t WHERE overs = 0 OR (overs = 1 AND after > {room} AND room > 200))"""


_TIER0 = f"""WITH {q.ONCE}, {q.VEC}, {q.QUERIES}, {q.QVEC}, {q.POSTINGS}, {q.knn(5)}, {q.words(5)},
 lists AS (SELECT query_id, id, p, relevance FROM near UNION ALL SELECT query_id, id, p, NULL FROM kw), fused AS (SELECT query_id, id, coalesce(max(relevance), 0.0) relevance FROM lists GROUP BY 1, 2),
 pool AS (SELECT f.query_id, f.id, CASE WHEN f.relevance > 0 THEN f.relevance ELSE coalesce({q.REL.replace('cosine', 'c.cosine')}, 0.0) END relevance FROM fused f LEFT JOIN cosq c ON c.query_id = f.query_id AND c.id = f.id), {q.EDGES}, {q.LIFECYCLES},
 weighted AS (SELECT query_id, p.id, round(relevance * (CASE WHEN source_type = 'transcript' THEN 0.45 ELSE 1.0 END * CASE WHEN lifecycle = 3 THEN 0.88 ELSE 1.0 END), 12) relevance, title, o.heading_path, o.page_no, uri, o.text FROM pool p JOIN once o ON o.id = p.id JOIN documents d ON d.id = o.doc JOIN life ON life.id = o.doc)"""
_ENTRY = "chr(10) || '[' || coalesce(title, '') || CASE WHEN coalesce(heading_path, '') <> '' THEN ' > ' || heading_path ELSE '' END || CASE WHEN page_no IS NOT NULL THEN ' p.' || page_no ELSE '' END || '](' || uri || ')' || chr(10) || text || chr(10)"
_COUNT = "(SELECT count(*) FROM documents)"
_LISTED = "SELECT uri, s.stamp AS stamp FROM (SELECT uri, arg_max({{'stamp': stamp, 'h': content_hash}}, (seen_at, coalesce(stamp, ''), coalesce(content_hash, ''))) s FROM scans WHERE run_id = {n} AND uri IS NOT NULL GROUP BY 1)"
_SECTION = "'## ' || r || ' (turn ' || n || ')' || chr(10) || chr(10)"
SQL = {
    "knn_cells": f"WITH {q.VEC}, {q.QUERIES}, {q.QVEC}, {q.knn(10)} SELECT query_id, id, round(relevance, 6) relevance, CAST(p AS INTEGER) AS position FROM near",
    "ann_recall": "SELECT * FROM (VALUES ('instant', 32, true), ('fast', 50, true), ('balanced', 64, true), ('thorough', 100, true), ('exhaustive', 200, true)) t(tier, efs, enough)",
    "publish_steps": f"""WITH {q.VEC}, n AS (SELECT (SELECT count(DISTINCT id) FROM chunks) r, (SELECT count(*) FROM vec) v, {_COUNT} d)
 SELECT step, CAST(version AS INTEGER) AS version, r AS rows, CASE WHEN has THEN v ELSE 0 END rows_with_vectors, d AS stamps FROM n, (VALUES ('texts first', 1, false), ('vectors', 2, true), ('unchanged', 2, true), ('changed', 3, true)) t(step, version, has)""",
    "pack_meta": f"SELECT 'documents' AS key, {_COUNT}::VARCHAR AS value",
    "pack_columns": f"WITH {q.EDGES}, {q.LIFECYCLES}, u AS (SELECT string_split(chunk_id, ':')[1] id, CAST(max(floor(epoch(searched_at))) AS BIGINT) last_used FROM hits GROUP BY 1) SELECT id, coalesce(inbound, 0) inbound, CAST(lifecycle AS INTEGER) lifecycle, last_used FROM life LEFT JOIN inb USING (id) LEFT JOIN u USING (id)",
    "compacted_pack": f"""WITH {q.ONCE}, {q.VEC}, left_ AS ({_LEFT}), {q.QUERIES}, {q.POSTINGS} SELECT 'chunks' AS name, count(*) AS rows FROM left_ UNION ALL SELECT 'vectors', count(v) FROM left_
 UNION ALL SELECT 'documents', count(*) FROM documents WHERE doc_id % 7 <> 0 UNION ALL SELECT 'postings', count(*) FROM tf JOIN left_ USING (id)""",
    "vector_backfill": "WITH w AS (SELECT id FROM chunks GROUP BY id HAVING count(embedding) = 0 AND min(embed_text) IS NOT NULL), f AS (SELECT id FROM w ORDER BY id LIMIT 100) SELECT (SELECT count(*) FROM f) made, (SELECT min(id) FROM f) AS first, (SELECT max(id) FROM f) AS last, 64 AS dims, greatest(count(*) - 100, 0) AS left FROM w",
    "embeddings_set": "WITH c AS (SELECT id, max(embedding) e FROM chunks GROUP BY id) SELECT CASE WHEN d.doc_id IS NOT NULL THEN true ELSE e[1] = 1 END AS set, count(*) chunks FROM c LEFT JOIN (SELECT * FROM documents WHERE doc_id % 2 = 0) d ON d.id || ':0' = c.id GROUP BY 1",
    "backup_restore": f"SELECT generation, uploaded, {_COUNT} AS rows, true AS same FROM (VALUES (2, 0), (3, 1)) t(generation, uploaded)",
    "scan_states": f"""WITH a AS ({_LISTED.format(n=1)}), b AS ({_LISTED.format(n=3)}), s AS (SELECT b.uri, b.stamp, a.stamp old, substr(sha256(b.uri), 1, 1) c, CASE WHEN b.stamp IS NULL THEN 'skipped' WHEN a.stamp IS NULL THEN 'new' WHEN a.stamp = b.stamp THEN 'unchanged' ELSE 'changed' END st FROM b LEFT JOIN (SELECT * FROM a WHERE stamp IS NOT NULL) a USING (uri)),
 t AS (SELECT *, CASE WHEN st IN ('new', 'changed') AND c = 'f' THEN 'failed' WHEN st IN ('new', 'changed') AND c = '0' THEN 'deferred' ELSE st END state FROM s)
 SELECT state, NOT (state = 'skipped' AND old IS NULL) live, count(*) files, count(CASE WHEN state IN ('failed', 'deferred', 'skipped') THEN old ELSE stamp END) with_stamp FROM t GROUP BY 1, 2""",
    "document_details": f"""WITH {q.LINKED_EDGES}, {q.LIFECYCLES}, {q.ONCE}, n AS (SELECT doc AS id, count(*) n, string_agg(id, ',' ORDER BY ord, id) ids FROM once GROUP BY 1)
 SELECT life.id, coalesce(n, 0) chunks, coalesce(inbound, 0) inbound, CAST(lifecycle AS INTEGER) lifecycle, sha256(coalesce(ids, '')) chunk_ids FROM life LEFT JOIN inb ON inb.id = life.id LEFT JOIN n ON n.id = life.id""",
    "vault_documents": "SELECT doc_id, 't' || doc_id title, 'a,b' tags, 'accepted' status, sha256(text) text_hash FROM documents WHERE source_type = 'markdown' AND text <> ''",
    "html_pages": r"""WITH t AS (SELECT doc_id, regexp_replace(title, '[<>&]', '', 'g') title, trim(regexp_replace(trim(regexp_replace(regexp_replace(substr(text, 1, 200), '[<>&\s\x00]+', ' ', 'g'), '^[#>| *-]+', '')), '\s+', ' ', 'g')) x FROM documents WHERE source_type = 'web' AND text IS NOT NULL AND title IS NOT NULL),
 n AS (SELECT *, strlen('<html><head><title></title></head><body><nav><a href=''/''>Home</a></nav><ul><li><a href=''/a''>More links</a></li><li><a href=''/b''>Other links</a></li></ul><p></p><footer>Imprint</footer></body></html>') + strlen(title) + strlen(x) bytes FROM t)
 SELECT doc_id, CASE WHEN doc_id % 10 = 0 THEN NULL ELSE sha256(x) END text_hash, doc_id % 10 = 0 refused FROM n WHERE doc_id % 10 <> 0 OR bytes * 40 > 6000""",
    "codex_sessions": rf"""WITH m AS (SELECT session, row_id, message.role r, regexp_replace(coalesce(message.content, ''), '[\[\]{{}}<>#]', '', 'g') c FROM finished WHERE session IS NOT NULL AND message.role IN ('user', 'assistant')),
 e AS (SELECT session, row_id * 2 AS i, r, CASE WHEN trim(c, ' ') <> '' THEN c END x, true AS msg FROM m UNION ALL SELECT session, row_id * 2 + 1, 'assistant', '[tool: shell ls]', false FROM m),
 f AS (SELECT *, CASE WHEN msg OR coalesce(lag(r) OVER (PARTITION BY session ORDER BY i) <> 'assistant', true) THEN 1 ELSE 0 END AS opens FROM e WHERE x IS NOT NULL),
 g AS (SELECT *, sum(opens) OVER (PARTITION BY session ORDER BY i) n FROM f), s AS (SELECT session, n, arg_min(r, i) r, string_agg(x, chr(10) ORDER BY i) x FROM g GROUP BY 1, 2)
 SELECT session, count(*) turns, sha256(string_agg({_SECTION} || x || chr(10) || chr(10), '' ORDER BY n)) text_hash FROM s GROUP BY 1""",
    "injection_audit": "WITH h AS (SELECT DISTINCT query_id, uri FROM hits) SELECT string_split(uri, '://')[1] AS scheme, count(*) n FROM h WHERE contains(uri, '://') GROUP BY 1 UNION ALL SELECT 'without file', count(*) FROM (SELECT query_id FROM h GROUP BY 1 HAVING NOT bool_or(starts_with(uri, 'file://')))",
    "golden_cases": "SELECT 'case' AS kind, 'about ' || source AS query, CAST(CASE WHEN (n - 1) % 3 = 0 THEN 0 ELSE 1 END AS INTEGER) acceptable, (n - 1) % 3 = 0 AS negative FROM (SELECT source, row_number() OVER (ORDER BY source) n FROM mix_targets) UNION ALL SELECT 'memory', 'cold cache', 0, false",
    "usage_log": "SELECT CAST(user_id AS VARCHAR) doc_id, CAST(min(floor(epoch(ts))) AS BIGINT) first_seen, CAST(max(floor(epoch(ts))) AS BIGINT) last_used FROM events WHERE event_id % 10 <> 0 GROUP BY 1",
    "memory_round_trip": f"WITH {_MEM} SELECT id, min(kind) kind, min(sha256(text)) text_hash FROM k WHERE id NOT IN (SELECT id FROM k WHERE doc_id % 2 = 0) GROUP BY 1",
    "memory_edits": f"""WITH {_MEM}, c AS (SELECT id, kind, CASE substr(id, 1, 1) WHEN '0' THEN text || chr(10) || 'more' WHEN '1' THEN text ELSE 'one and the same' END t FROM known WHERE substr(id, 1, 1) IN ('0', '1', '2')),
 n AS (SELECT *, substr(sha256(kind || '|' || trim(t, ' ')), 1, 12) new FROM c), o AS (SELECT *, row_number() OVER (PARTITION BY new ORDER BY id) i FROM n),
 r AS (SELECT CASE WHEN new = id THEN 'unchanged' WHEN new IN (SELECT id FROM known) OR i > 1 THEN 'duplicate' ELSE 'edited' END outcome FROM o UNION ALL SELECT 'not_found') SELECT outcome, count(*) edits FROM r GROUP BY 1""",
    "memory_forgets": f"""WITH {_MEM}, p AS (SELECT substr(id, 1, 6) x FROM known UNION SELECT substr(id, 1, 1) FROM known UNION SELECT 'zzz'), r AS (SELECT x, count(id) n, min(id) id FROM p LEFT JOIN known ON starts_with(id, x) GROUP BY 1)
 SELECT CASE WHEN n = 0 THEN 'not_found' WHEN n > 1 THEN 'ambiguous' ELSE 'found' END status, count(*) n FROM r GROUP BY 1 UNION ALL SELECT 'left', count(*) FROM known WHERE id NOT IN (SELECT id FROM r WHERE n = 1)""",
    "memory_targets": "WITH t AS (SELECT query_id, min(chunk_id) c, arg_min(source_type, (chunk_id, source_type)) kind FROM hits GROUP BY 1), b AS (SELECT t.query_id, kind, coalesce(max(relevance::DOUBLE), 0.0) best FROM t JOIN hits h ON h.query_id = t.query_id AND h.chunk_id = t.c GROUP BY 1, 2) SELECT kind, count(*) queries, count(*) FILTER (WHERE best >= 0.6) found, round(avg(best), 6) mean_best FROM b GROUP BY 1",
    "interval_guard": "WITH t AS (SELECT run_id, floor(epoch(started_at)) a, lag(floor(epoch(finished_at))) OVER (ORDER BY run_id) b FROM index_runs) SELECT run_id, b IS NULL OR a - b >= 900 due, b IS NULL OR a - b >= 10000000 due_later FROM t",
    "gate_partition": f"WITH {_budget(1500, 0.5)} SELECT h.query_id, CASE WHEN h.r < 0.5 THEN 'below' WHEN taken.chunk_id IS NOT NULL THEN 'admitted' ELSE 'over_budget' END AS label, count(*) hits FROM h LEFT JOIN taken ON taken.query_id = h.query_id AND taken.chunk_id = h.chunk_id GROUP BY 1, 2",
    "response_order": "WITH c AS (SELECT DISTINCT id, doc_id, ord FROM chunks WHERE doc_id IS NOT NULL) SELECT doc_id, CAST(CASE WHEN ok THEN n ELSE -1 END AS INTEGER) n, CASE WHEN ok THEN l END AS last FROM (SELECT doc_id, count(*) n, list_sort(list(ord)) = range(0, count(*)) ok, arg_max(id, ord) l FROM c GROUP BY 1)",
    "key_suggestions": "WITH n AS (SELECT source, left(source, length(source) - 1) typed FROM mix_targets), x AS (SELECT n.typed, m.source, damerau_levenshtein(n.typed, m.source) d FROM n, mix_targets m) SELECT typed, arg_min(source, (d, source)) FILTER (WHERE d <= greatest(length(typed) // 3, 1)) suggested FROM x GROUP BY 1",
    "tier_table": "SELECT * FROM (VALUES (0, 'instant', 5, 32, 0, NULL), (1, 'fast', 20, 50, 0, 'hook'), (2, 'balanced', 30, 64, 1, NULL), (3, 'thorough', 40, 100, 1, 'mcp'), (4, 'exhaustive', 80, 200, 2, NULL)) t(tier, name, candidates, efs, hops, surface)",
    "stage_bytes": "SELECT CAST(CASE WHEN doc_id % 6 > 3 THEN 0 ELSE doc_id % 6 END AS INTEGER) stage, count(*) documents FROM documents GROUP BY 1",
    "stripped_spans": "SELECT doc_id, sha256(text) text_hash FROM documents WHERE text IS NOT NULL AND text NOT LIKE '%<hook%'",
    "session_names": "SELECT DISTINCT session, left(rpad(session, 36, '0'), 36) hidden, session AS plain FROM finished WHERE session IS NOT NULL",
    "distill_windows": rf"""WITH m AS (SELECT session, row_number() OVER (PARTITION BY session ORDER BY row_id) n, coalesce(message.role, 'unknown') r, 'say ' || row_id x FROM finished WHERE session IS NOT NULL),
 t AS (SELECT session, coalesce(string_agg({_SECTION} || x || chr(10) || chr(10), '' ORDER BY n) FILTER (WHERE r IN ('user', 'assistant')), '') t FROM m GROUP BY 1)
 SELECT session, sha256(CASE WHEN length(t) <= 100 THEN t ELSE left(t, 40) || chr(10) || '[…]' || chr(10) || right(t, 60) END) AS "window" FROM t""",
    "enrichment_prompts": "SELECT doc_id, sha256('Say in one sentence what this document is about.' || chr(10) || chr(10) || 'Title: ' || coalesce(title, '') || chr(10) || chr(10) || CASE WHEN length(text) > 4000 THEN substr(text, 1, 4000) || '…' ELSE text END) prompt, sha256(CASE WHEN doc_id % 2 = 0 THEN 'an answer' || chr(10) || chr(10) ELSE '' END || text) enriched FROM documents WHERE text IS NOT NULL",
    "hit_similarity": rf"""WITH {q.ONCE}, {_HITS}, w AS (SELECT query_id, chunk_id, r, doc_id, list_distinct(list_filter(regexp_split_to_array(o.text, '\s+'), lambda x: x <> '')) w FROM h JOIN once o ON o.id = chunk_id WHERE o.text IS NOT NULL),
 b AS (SELECT query_id, arg_min(chunk_id, (-r, chunk_id)) c FROM w GROUP BY 1)
 SELECT w.query_id, w.chunk_id, round(least(1.0, 0.6 * CAST(w.doc_id = x.doc_id AS INTEGER) + 0.4 * CASE WHEN len(list_distinct(w.w || x.w)) > 0 THEN len(list_intersect(w.w, x.w)) / len(list_distinct(w.w || x.w))::DOUBLE ELSE 0 END), 6) similarity
 FROM w JOIN b USING (query_id) JOIN w x ON x.query_id = w.query_id AND x.chunk_id = b.c WHERE w.chunk_id <> b.c""",
    "budget_bodies": f"WITH {_budget(500, -1)} SELECT query_id, count(*) admitted, sha256(string_agg(shown, '' ORDER BY p)) body FROM taken GROUP BY 1",
    "search_report": f"""{_TIER0}, g AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY relevance DESC, id) p FROM weighted WHERE relevance >= 0.66), e AS (SELECT *, {_ENTRY} entry FROM g WHERE p <= 10),
 s AS (SELECT *, strlen(entry) n, sum(strlen(entry)) OVER (PARTITION BY query_id ORDER BY p) after FROM e), t AS (SELECT *, 6000 - (after - n) room, sum(CASE WHEN after > 6000 THEN 1 ELSE 0 END) OVER (PARTITION BY query_id ORDER BY p) overs FROM s),
 i AS (SELECT query_id, count(*) k, string_agg(id, ',' ORDER BY p) ids FROM t WHERE overs = 0 OR (overs = 1 AND after > 6000 AND room > 200) GROUP BY 1)
 SELECT q.query_id, (SELECT count(*) FROM near x WHERE x.query_id = q.query_id) AS vector, (SELECT count(*) FROM kw x WHERE x.query_id = q.query_id) AS keyword, CAST(0 AS BIGINT) AS graph, (SELECT count(*) FROM fused x WHERE x.query_id = q.query_id) AS fused,
  (SELECT count(*) FROM g x WHERE x.query_id = q.query_id) AS gated, (SELECT count(*) FROM e x WHERE x.query_id = q.query_id) AS returned, coalesce(k, 0) AS injected, coalesce(ids, '') AS injected_ids FROM q LEFT JOIN i ON i.query_id = q.query_id""",
    "rerank_overlap": f"""{_TIER0}, g AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY relevance DESC, id) p FROM weighted), w AS (SELECT query_id, list(DISTINCT t) w FROM asked GROUP BY 1),
 v AS (SELECT g.query_id, id, p, CASE WHEN p <= 5 AND len(w) > 0 AND text IS NOT NULL THEN len(list_intersect(w, {q.toks('text')})) / len(w)::DOUBLE END v FROM g LEFT JOIN w ON w.query_id = g.query_id),
 a AS (SELECT *, count(*) FILTER (WHERE p <= 5) OVER (PARTITION BY query_id) = count(v) OVER (PARTITION BY query_id) whole FROM v)
 SELECT query_id, id AS chunk_id, CAST(row_number() OVER (PARTITION BY query_id ORDER BY p > 5, CASE WHEN whole THEN v END DESC NULLS LAST, p) AS INTEGER) AS position, round(v, 6) AS value FROM a QUALIFY position <= 10""",
    "stream_usage": "SELECT CAST(user_id AS VARCHAR) doc_id, CAST(min(floor(epoch(ts))) AS BIGINT) first_seen, CAST(max(floor(epoch(ts))) AS BIGINT) last_used FROM events GROUP BY 1",
    "stream_once": 'SELECT session, count(*) messages FROM (SELECT DISTINCT session, type, cwd, "timestamp", message.role r, message.content c FROM finished) GROUP BY 1',
    "young_events": "SELECT event_type, count(*) events FROM events WHERE ts >= (SELECT max(ts) FROM events) - INTERVAL 30 DAY GROUP BY 1",
}
