"""Memories (R11-R15, W13, J20, S23)."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from marrowlake.functions.identity import memory_id
from marrowlake.functions.weights import civil_date
from marrowlake.operators.ranking import rank_in_group

# fixed values: lengths of a memory, the floor of confidence, the similarity of near duplicates, and the least size of a session worth distilling
LEAST_CHARS, MOST_CHARS, MIN_CONFIDENCE, DUPLICATE, LEAST_BYTES = 10, 2000, 60, 0.94, 4096


def rejected(text: Column, origin: Column, confidence: Column) -> Column:
    """Why a memory is not taken, null if it is (R11): its length, or low confidence of one that was written unasked."""
    n = F.length(F.trim(F.coalesce(text, F.lit(""))))
    return F.when(~n.between(LEAST_CHARS, MOST_CHARS), "length").when((origin == "claude") & (F.coalesce(confidence, F.lit(0)) < MIN_CONFIDENCE), "confidence")


def remembered(incoming: DataFrame, stored: DataFrame, near: DataFrame) -> DataFrame:
    """(seq, id, outcome, of) of incoming memories against the stored ones.

    incoming: seq, kind, text, origin, confidence; stored: id, text; near: seq, of (the nearest stored memory of the kind at DUPLICATE or
    more). rejected, duplicate (same id and text, or a near episode), replaced (near lesson or fact) or saved.
    """
    i = incoming.withColumn("id", memory_id(F.col("kind"), F.col("text"))).withColumn("why", rejected(F.col("text"), F.col("origin"), F.col("confidence")))
    same = stored.select(F.col("id").alias("_id"), F.trim("text").alias("_t"), F.lit(True).alias("_same")).distinct()
    j = i.join(same, (F.col("id") == F.col("_id")) & (F.trim("text") == F.col("_t")), "left").join(near.select("seq", "of"), "seq", "left")
    j = j.withColumn("of", F.when(F.col("_same"), F.col("id")).when(F.col("of") != F.col("id"), F.col("of")))
    outcome = F.when(F.col("why").isNotNull(), "rejected").when(F.col("_same"), "duplicate").when(F.col("of").isNotNull() & (F.col("kind") == "episode"), "duplicate").when(F.col("of").isNotNull(), "replaced").otherwise("saved")
    return j.select("seq", "id", outcome.alias("outcome"), F.when(outcome.isin("duplicate", "replaced"), F.col("of")).alias("of"))


def evicted(memories: DataFrame, most: int, growth: int = 0) -> DataFrame:
    """Ids of the oldest episodes beyond the cap; other kinds are never evicted (W13). Episodes are numbered in slices of time, so any number may be beyond the cap."""
    total = memories.agg(F.count("*").alias("n"))
    eps = rank_in_group(memories.filter("kind = 'episode'").select("id", "created", F.lit(0).alias("_g")), "_g", [("created", False), ("id", False)], "r", "row_number")
    return eps.crossJoin(total).filter(F.col("r") <= F.col("n") + growth - most).select("id")  # total is one row


def edited(memories: DataFrame, changes: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(memories, outcomes) after edits (id, text), one an id: the id follows the text.

    An edit of an unknown id is not_found; one whose new id another memory holds, or another edit takes first (by old id), is a duplicate and changes nothing; the same text
    again is unchanged. Outcomes: id, new_id, outcome.
    """
    c = changes.groupBy("id").agg(F.max("text").alias("_text"))
    j = c.join(memories, "id", "left").withColumn("new_id", F.when(F.col("kind").isNotNull(), memory_id(F.col("kind"), F.col("_text"))))
    held = memories.select(F.col("id").alias("new_id"), F.lit(True).alias("_held"))
    first = Window.partitionBy("new_id").orderBy("id")
    j = j.join(held, "new_id", "left").withColumn("_n", F.row_number().over(first))
    outcome = F.when(F.col("kind").isNull(), "not_found").when(F.col("new_id") == F.col("id"), "unchanged").when(F.col("_held") | (F.col("_n") > 1), "duplicate").otherwise("edited")
    done = j.select("id", "new_id", outcome.alias("outcome"), "_text")
    ok = done.filter("outcome = 'edited'").select("id", "new_id", "_text")
    out = memories.join(ok, "id", "left").withColumn("text", F.coalesce("_text", "text")).withColumn("id", F.coalesce("new_id", "id")).drop("_text", "new_id")
    return out.select(*memories.columns), done.drop("_text")


def forgotten(memories: DataFrame, prefixes: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(memories, outcomes) after memories are forgotten by a prefix of their id; an ambiguous or unknown prefix forgets nothing. Outcomes: prefix, status, id."""
    found = resolved_prefix(memories, prefixes)
    gone = found.filter("status = 'found'").select("id").distinct()
    return memories.join(gone, "id", "left_anti"), found


def rebuilt(memories: DataFrame, indexed: DataFrame) -> DataFrame:
    """The memories of a store made anew; raises in the job if one that is indexed (id) would be lost."""
    lost = indexed.select("id").join(memories.select("id"), "id", "left_anti").agg(F.count("*").alias("_lost"))
    checked = memories.crossJoin(lost)  # one row
    return checked.filter(F.when(F.col("_lost") == 0, F.lit(True)).otherwise(F.raise_error(F.concat(F.lit("a rebuild would lose "), F.col("_lost").cast("string"), F.lit(" memories"))))).drop("_lost")


def listed(memories: DataFrame, kind: str | None = None, project: str | None = None, contains: str | None = None) -> DataFrame:
    """Newest first, then by id; contains looks into text, title and id without regard to case."""
    m = memories
    if kind is not None:
        m = m.filter(F.col("kind") == kind)
    if project is not None:
        m = m.filter(F.col("project") == project)
    if contains is not None:
        low = F.lit(contains.lower())
        m = m.filter(F.contains(F.lower("text"), low) | F.contains(F.lower("title"), low) | F.contains(F.lower("id"), low))
    return m.orderBy(F.desc("created"), "id")


def resolved_prefix(memories: DataFrame, prefixes: DataFrame) -> DataFrame:
    """(prefix, status, id): found, not_found or ambiguous (R12). A join by equality: each id is cut to the lengths that prefixes have, at most those of an id."""
    lengths = prefixes.select(F.length("prefix").alias("n")).distinct().agg(F.collect_set("n").alias("lengths"))  # one row, at most as many as an id has characters and one
    cut = memories.select("id").crossJoin(lengths).select("id", F.explode(F.filter("lengths", lambda n: n <= F.length("id"))).alias("n"))
    cut = cut.select("id", F.substring(F.col("id"), F.lit(1), F.col("n")).alias("prefix"))
    known = cut.groupBy("prefix").agg(F.count("id").alias("n"), F.min("id").alias("id"))
    m = prefixes.select("prefix").distinct().join(known, "prefix", "left").withColumn("n", F.coalesce("n", F.lit(0)))
    return m.select("prefix", F.when(F.col("n") == 0, "not_found").when(F.col("n") > 1, "ambiguous").otherwise("found").alias("status"), F.when(F.col("n") == 1, F.col("id")).alias("id"))


def in_scope(project: Column, cwd: Column) -> Column:
    """A lesson without project is global; others apply below their project's folder, by whole components."""
    return project.isNull() | (cwd.isNotNull() & ((cwd == project) | cwd.startswith(F.concat(project, F.lit("/")))))


def lesson_line(id_: Column, created: Column, project: Column, text: Column) -> Column:
    return F.concat(F.lit("["), id_, F.lit(" · "), civil_date(created), F.lit(" · "), F.coalesce(project, F.lit("global")), F.lit("] "), F.trim(text))


def distill_candidates(sessions: DataFrame, known: DataFrame, now: int, after_hours: float) -> DataFrame:
    """Sessions worth distilling: large, quiet, and with a stamp and a hash that are not known (R15). sessions: uri, bytes, modified, stamp, hash."""
    k = known.select("uri", F.col("source_stamp").alias("_s"), F.col("source_hash").alias("_h"))
    s = sessions.filter((F.col("bytes") >= LEAST_BYTES) & (now - F.col("modified") >= after_hours * 3600)).join(k, "uri", "left")
    same = F.coalesce(F.col("_s") == F.col("stamp"), F.lit(False)) | F.coalesce(F.col("_h") == F.col("hash"), F.lit(False))
    return s.filter(~same).drop("_s", "_h")


def memory_graph(memories: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Nodes (memories, projects) and edges (distilled-from, scoped-to)."""
    nodes = memories.select("id", F.lit("memory").alias("type")).unionByName(memories.filter("project is not null").select(F.col("project").alias("id"), F.lit("project").alias("type")).distinct())
    edges = memories.filter("session is not null").select(F.col("id").alias("src"), F.col("session").alias("dst"), F.lit("distilled-from").alias("kind"))
    return nodes, edges.unionByName(memories.filter("project is not null").select(F.col("id").alias("src"), F.col("project").alias("dst"), F.lit("scoped-to").alias("kind")))


def exported(memories: DataFrame) -> DataFrame:
    """One JSON line a memory, by creation and text."""
    cols = [c for c in ("kind", "text", "title", "project", "confidence", "origin", "created", "session", "source_hash", "source_stamp") if c in memories.columns]
    return memories.orderBy("created", "text").select(F.to_json(F.struct(*cols)).alias("value"))


def imported(lines: DataFrame, stored: DataFrame) -> DataFrame:
    """Memories of exported lines that are not stored yet, each once; lines that are no JSON are skipped."""
    schema = "kind string, text string, title string, project string, confidence int, origin string, created long, session string, source_hash string, source_stamp string"
    rows = lines.select(F.from_json("value", schema).alias("m")).select("m.*").filter("kind is not null and text is not null").withColumn("id", memory_id(F.col("kind"), F.col("text")))
    return rows.dropDuplicates(["id"]).join(stored.select("id"), "id", "left_anti")
