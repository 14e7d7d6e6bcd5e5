"""Conversations from message rows (p3)."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from marrowlake.llm.components import connected_components
from marrowlake.operators.ranking import rank_in_group
from marrowlake.runtime import cut

# fixed values: the speakers behind the spellings of a role, and the roles that are left out
USER_ROLES = ["user", "human"]
ASSISTANT_ROLES = ["assistant", "ai", "model"]
OUTSIDE_ROLES = ["system", "developer"]

ITEMS = "array<struct<type:string,text:string>>"
INSTANT = r"^\d{4}-\d{2}-\d{2}[T ]\d{2}:\d{2}(:\d{2}(\.\d+)?)?\s*(Z|z|[+-]\d{2}:?\d{2})?$"
BLANKS = r"^\s+|\s+$"


def speaker(role: Column) -> Column:
    """user, assistant, outside, or null for any other role and for none."""
    r = F.lower(F.regexp_replace(role, BLANKS, ""))
    return F.when(r.isin(USER_ROLES), "user").when(r.isin(ASSISTANT_ROLES), "assistant").when(r.isin(OUTSIDE_ROLES), "outside")


def instant(stamp: Column) -> Column:
    """The instant of an ISO 8601 stamp (UTC where it names no zone), null if it is none."""
    s = F.regexp_replace(stamp, BLANKS, "")
    return F.when(s.rlike(INSTANT), s.try_cast("timestamp"))


def opens_items(content: Column) -> Column:
    """Whether content starts an array of items."""
    return F.coalesce(content.rlike(r"^\s*\[\s*\{"), F.lit(False))


def valid_json(content: Column) -> Column:
    # the parser ignores what follows the value, so the array must also end the text
    return F.try_parse_json(content).isNotNull() & content.rlike(r"\]\s*$")


def is_items(content: Column) -> Column:
    """Whether content is a JSON array of items: of objects, or of nothing. Other brackets, such as "[1]", are plain text."""
    bracket = content.rlike(r"^\s*\[\s*[{\]]")
    objects = F.forall(F.from_json(content, "array<string>"), lambda x: x.rlike(r"^\s*\{"))
    return F.coalesce(F.when(bracket, valid_json(content) & objects), F.lit(False))


def message_text(content: Column) -> Column:
    """Plain content, or the text items of an array joined by line breaks; null if blank or an array of items that is not valid JSON."""
    items = F.filter(F.from_json(content, ITEMS), lambda x: (x["type"] == "text") & (F.regexp_replace(x["text"], r"\s+", "") != ""))
    text = F.when(is_items(content), F.array_join(F.transform(items, lambda x: x["text"]), "\n")).when(~opens_items(content), content)
    return F.when(F.regexp_replace(text, r"[\s\p{Z}]+", "") != "", text)


SAME = ["session", "type", "cwd", "timestamp", "role", "content"]


def _raw(log: DataFrame) -> DataFrame:
    return log.select("row_id", "session", "type", "cwd", "timestamp", F.col("message.role").alias("role"), F.col("message.content").alias("content"))


def message_rows(log: DataFrame) -> DataFrame:
    """One row a message: rows equal in all but row_id and loaded_at become one, the lowest row_id.

    Columns: row_id, session (null if blank), speaker, text, at, cwd, broken. broken marks a role that is
    unknown, a timestamp that is no instant and an array of items that is not valid JSON.
    """
    m = _raw(log).groupBy(*SAME).agg(F.min("row_id").alias("row_id"))
    session = F.when(F.regexp_replace("session", BLANKS, "") != "", F.col("session"))
    c = F.col("content")
    m = m.select("row_id", session.alias("session"), speaker(F.col("role")).alias("speaker"), message_text(c).alias("text"), instant(F.col("timestamp")).alias("at"), "cwd", (opens_items(c) & ~is_items(c)).alias("bad_items"))
    return m.withColumn("broken", F.col("speaker").isNull() | F.col("at").isNull() | F.col("bad_items")).drop("bad_items")


def representatives(log: DataFrame) -> DataFrame:
    """(row_id, kept): for every row of the log the row_id that message_rows keeps in its place."""
    raw = _raw(log)
    kept = raw.groupBy(*SAME).agg(F.min("row_id").alias("kept")).select(*(F.col(c).alias(f"_{c}") for c in SAME), "kept")
    same = F.lit(True)
    for c in SAME:
        same &= F.col(c).eqNullSafe(F.col(f"_{c}"))
    return raw.join(kept, same).select("row_id", "kept")


def link_edges(rows: DataFrame, reply_to: str | None = None) -> DataFrame:
    """(a, b) between nodes of the link graph, of which at least one lacks a session.

    A node is a session (contracted: its rows need no links among themselves) or a row without one. A quote link joins a
    row whose first line is a Markdown quote to the one node of the same cwd that holds just this line as a first line; a line that several nodes hold
    ("Thanks") says nothing and links nothing. A reply link joins a row to the row_id in the column reply_to.
    """
    node = F.coalesce(F.concat(F.lit("s:"), "session"), F.concat(F.lit("r:"), F.col("row_id").cast("string")))
    n = rows.select("row_id", node.alias("node"), F.col("session").isNull().alias("loose"), "cwd", "text", *([reply_to] if reply_to else []))
    first_line = F.regexp_replace(F.substring_index("text", "\n", 1), BLANKS, "")
    quoting = n.filter("text like '>%'").select(F.col("node").alias("a"), "loose", "cwd", F.regexp_replace(first_line, r"^>\s*", "").alias("line")).filter("line <> ''")
    quoted = n.filter("text is not null and text not like '>%'").select(F.col("cwd").alias("_cwd"), first_line.alias("_line"), "node", F.col("loose").alias("l2"))
    # a line that many rows hold is reduced to its ends first: never all pairs
    quoted = quoted.groupBy("_cwd", "_line").agg(F.min("node").alias("b"), F.max("node").alias("z"), F.max("l2").alias("l2")).filter("b = z")
    edges = quoting.join(quoted, (F.col("line") == F.col("_line")) & F.col("cwd").eqNullSafe(F.col("_cwd"))).filter("loose or l2").select("a", "b")
    if reply_to:
        target = n.select(F.col("row_id").alias("t"), F.col("node").alias("b"), F.col("loose").alias("l2"))
        replies = n.filter(F.col(reply_to).isNotNull()).select(F.col("node").alias("a"), F.col(reply_to).alias("t"), "loose")
        edges = edges.unionByName(replies.join(target, "t").filter("loose or l2").select("a", "b"))
    return edges


def conversation_rows(log: DataFrame, reply_to: str | None = None) -> DataFrame:
    """message_rows with `conversation`: the session, or for rows without one the component of their links.

    Components are found by large-star and small-star rounds over the contracted link graph. A row without session that links to
    a session joins the component of that session (its name, the smallest if it links several).
    """
    rows = message_rows(log)
    if reply_to:
        # replies to a row that was delivered again go to the one that is kept
        kept = cut(representatives(log))
        given = log.select("row_id", F.col(reply_to).alias("_to")).join(kept, "row_id").filter("_to is not null").groupBy("kept").agg(F.min("_to").alias("_to"))
        given = given.join(kept.select(F.col("row_id").alias("_to"), F.col("kept").alias(reply_to)), "_to").select(F.col("kept").alias("row_id"), reply_to)
        rows = rows.join(given, "row_id", "left")
    rows = cut(rows)
    parts = connected_components(link_edges(rows, reply_to))
    named = parts.groupBy("component").agg(F.min(F.when(F.col("node").startswith("s:"), F.col("node"))).alias("s"))
    name = parts.join(named, "component").select("node", F.coalesce("s", "component").alias("conv"))
    loose = rows.filter("session is null").withColumn("node", F.concat(F.lit("r:"), F.col("row_id").cast("string")))
    loose = loose.join(name, "node", "left").withColumn("conversation", F.regexp_replace(F.coalesce("conv", "node"), "^s:", "")).drop("node", "conv")
    return rows.filter("session is not null").withColumn("conversation", F.col("session")).unionByName(loose)


def conversation_status(rows: DataFrame) -> DataFrame:
    """(conversation, session, status, turns) for every conversation: ok, empty, broken or no_reply.

    empty: no user or assistant message has text. broken: a row is broken or the first message with text is the assistant's.
    no_reply: the last message with text is the user's. Messages are in order of instant, then row_id. One pre-aggregated
    groupBy; a conversation of any length costs one small state.
    """
    key = F.struct(F.coalesce("at", F.lit("9999-12-31").cast("timestamp")).alias("at"), "row_id")
    spoken = F.col("text").isNotNull() & F.col("speaker").isin("user", "assistant")
    got = rows.groupBy("conversation").agg(
        F.max("session").alias("session"),
        F.max("broken").alias("broken"),
        F.count_if(spoken).alias("turns"),
        F.min_by("speaker", F.when(spoken, key)).alias("first"),
        F.max_by("speaker", F.when(spoken, key)).alias("last"),
    )
    status = F.when(F.col("broken"), "broken").when(F.col("turns") == 0, "empty").when(F.col("first") == "assistant", "broken").when(F.col("last") == "user", "no_reply").otherwise("ok")
    return got.select("conversation", "session", status.alias("status"), "turns")


def conversations(log: DataFrame, reply_to: str | None = None) -> DataFrame:
    """One row a turn of every sound conversation: conversation, turn, speaker, text, at, cwd.

    cwd is the row's own or the first one that the conversation names. Dropped conversations are those whose
    conversation_status is not ok. An empty log gives no rows; other columns of the log are not read. Turns of a
    conversation too long for one task are numbered in slices of time.
    """
    rows = conversation_rows(log, reply_to)
    sound = conversation_status(rows).filter("status = 'ok'").select("conversation")
    turns = rows.filter("speaker in ('user', 'assistant') and text is not null").join(sound, "conversation", "left_semi")
    turns = rank_in_group(turns.select("conversation", "speaker", "text", "at", "cwd", "row_id"), "conversation", [("at", False), ("row_id", False)], "turn", "row_number")
    known = rows.filter("cwd is not null").groupBy("conversation").agg(F.min_by("cwd", F.struct("at", "row_id")).alias("known"))
    return turns.join(known, "conversation", "left").select("conversation", "turn", "speaker", "text", "at", F.coalesce("cwd", "known").alias("cwd"))
