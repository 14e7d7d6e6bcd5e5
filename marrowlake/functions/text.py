"""Text functions (F1-F19) as column expressions; only the stemmer is Python, and runs on distinct words."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

# fixed values: the characters that end a token, besides the space
SEPARATORS = "!@#$%^&*()_+={}[]:;<>,.?~/|'\"`-"
#: The same as a regular expression class; Java and RE2 read it alike.
TOKEN_SPLIT = r"[ !@#$%^&*()_+={}\[\]:;<>,.?~/|'\"`-]+"

#: The default stop list: English function words. A parameter wherever it is used.
STOP_WORDS = tuple(
    """a about above after again against all also am an and any are as at be because been before being below between both but by can
could did do does doing down during each few for from further had has have having he her here hers him his how i if in into is it its
itself just me more most my no nor not now of off on once only or other our out over own same she should so some such than that the
their them then there these they this those through to too under until up very was we were what when where which while who whom why
will with would you your""".split()
)


def fold_newlines(text: Column) -> Column:
    """line breaks become spaces; the index side folds them, the query side does not unless strict."""
    return F.translate(text, "\n\r", "  ")


def tokens(text: Column) -> Column:
    """lower case, split at spaces and ASCII punctuation; digits, tabs and line breaks stay in tokens."""
    return F.filter(F.split(F.lower(text), TOKEN_SPLIT), lambda t: t != "")


def without_stop_words(words: Column, stop: tuple[str, ...] = STOP_WORDS) -> Column:
    """exact matches are removed, before stemming."""
    return F.filter(words, lambda t: ~t.isin(*stop)) if stop else words


def link_key(c: Column) -> Column:
    """F6."""
    return F.lower(F.trim(c))


def uri_stem(uri: Column) -> Column:
    """the last part of a path up to its first dot."""
    return F.lower(F.trim(F.split_part(F.element_at(F.split(uri, "/"), -1), F.lit("."), F.lit(1))))


def excerpt(text: Column, most: int = 1200) -> Column:
    """at most `most` characters, marked where something is cut off."""
    return F.when(F.length(text) > most, F.concat(F.substring(text, 1, most), F.lit("…"))).otherwise(text)


def summary_title(text: Column, most: int = 80) -> Column:
    """F8: the first clause of the trimmed text; "memory" if it is blank."""
    t = F.trim(F.get(F.split(F.trim(text), r"[.\n!?]"), F.lit(0)))
    return F.when(F.coalesce(t, F.lit("")) == "", "memory").otherwise(excerpt(t, most))


def clip_lines(text: Column, most: int = 2000) -> Column:
    """whole lines as long as they fit into `most` characters."""
    lines = F.split(text, "\n")
    kept = F.aggregate(
        lines,
        F.struct(F.lit("").alias("t"), F.lit(False).alias("full"), F.lit(True).alias("first")),
        lambda a, x: F.when(a["full"] | (F.length(a["t"]) + F.length(x) + F.when(a["first"], 0).otherwise(1) > most), F.struct(a["t"].alias("t"), F.lit(True).alias("full"), F.lit(False).alias("first"))).otherwise(
            F.struct(F.when(a["first"], x).otherwise(F.concat(a["t"], F.lit("\n"), x)).alias("t"), F.lit(False).alias("full"), F.lit(False).alias("first"))
        ),
        lambda a: a["t"],
    )
    return F.when(F.length(text) <= most, text).otherwise(kept)


def strip_spans(text: Column, prefix: str) -> Column:
    """elements whose name starts with prefix are removed; one that is never closed takes the rest with it."""
    return F.regexp_replace(text, rf"(?s)<({prefix}[\w-]*)[^>]*>.*?(?:</\1>|\z)", "")


def head_and_tail(text: Column, head: int = 4000, tail: int = 8000) -> Column:
    """the ends of a long text around a mark."""
    return F.when(F.length(text) <= head + tail, text).otherwise(F.concat(F.substring(text, 1, head), F.lit("\n[…]\n"), F.right(text, F.lit(tail))))


def distill_input(text: Column, head: int = 4000, tail: int = 8000) -> Column:
    """F11 as a whole: the user's and assistant's sections of a session without tool lines, then its two ends."""
    sections = F.filter(F.split(text, r"(?m)^(?=## .* \(turn \d+\)$)"), lambda s: s.rlike(r"^## (?:user|assistant) \(turn \d+\)\n"))
    lines = lambda s: F.array_join(F.filter(F.split(s, "\n"), lambda x: ~x.rlike(r"^\[(?:tool: |result\] )")), "\n")
    return head_and_tail(F.array_join(F.transform(sections, lines), ""), head, tail)


def enrichment_prompt(title: Column, text: Column, most: int = 4000) -> Column:
    """what a model is asked in order to enrich a document: title and the beginning of its text."""
    return F.concat(F.lit("Say in one sentence what this document is about.\n\nTitle: "), F.coalesce(title, F.lit("")), F.lit("\n\n"), excerpt(text, most))


def enriched(embed: Column, blurb: Column) -> Column:
    """the text to embed behind what the model said; a missing or blank answer changes nothing."""
    return F.when(F.trim(F.coalesce(blurb, F.lit(""))) != "", F.concat(F.trim(blurb), F.lit("\n\n"), embed)).otherwise(embed)


def rendered_entry(title: Column, heading_path: Column, page_no: Column, uri: Column, text: Column) -> Column:
    """a hit as it is put into a prompt."""
    head = F.when(F.coalesce(heading_path, F.lit("")) != "", F.concat(F.lit(" > "), heading_path)).otherwise("")
    page = F.when(page_no.isNotNull(), F.concat(F.lit(" p."), page_no.cast("string"))).otherwise("")
    return F.concat(F.lit("\n["), F.coalesce(title, F.lit("")), head, page, F.lit("]("), uri, F.lit(")\n"), text, F.lit("\n"))


def rendered_hits(hits: DataFrame, group: str = "query_id") -> DataFrame:
    """the admitted hits of each query as one Markdown text, in order of position; a query has few."""
    one = F.concat(F.lit("### ["), F.coalesce("title", F.lit("")), F.lit("]("), F.col("uri"), F.lit(") ("), F.format_string("%.3f", F.col("relevance").cast("double")), F.lit(")\n\n"), F.col("text"))
    listed = F.array_sort(F.collect_list(F.struct("position", one.alias("t"))))
    return hits.groupBy(group).agg(F.array_join(F.transform(listed, lambda x: x["t"]), "\n\n---\n\n").alias("rendered"))


def context_envelope(body: Column, header: str, footer: str) -> Column:
    """null for a blank body."""
    return F.when(F.trim(F.coalesce(body, F.lit(""))) != "", F.concat(F.lit(header), body, F.lit(footer)))


def worth_retrieving(prompt: Column, least: int = 4) -> Column:
    """prompts of fewer words are not looked up."""
    p = F.trim(F.coalesce(prompt, F.lit("")))
    return (p != "") & (F.size(F.split(p, r"\s+")) >= least)


# fixed values: what an embedding model wants in front of documents and queries
PREFIXES = {"none": ("", ""), "search": ("search_document: ", "search_query: "), "passage": ("passage: ", "query: ")}


def with_prefix(text: Column, scheme: str, query: bool = False) -> Column:
    """F16."""
    return F.concat(F.lit(PREFIXES[scheme][query]), text)


def url_decoded(c: Column) -> Column:
    """percent escapes and plus signs; null where an escape is broken."""
    return F.try_url_decode(c)


def session_id(stem: Column) -> Column:
    """the id at the end of a rollout file's name; other names are ids themselves."""
    return F.when(stem.startswith("rollout-") & (F.length(stem) > 36), F.right(stem, F.lit(36))).otherwise(stem)


def lifted(df: DataFrame, name: str, func) -> DataFrame:
    """df with func applied to the column name."""
    return df.withColumn(name, func(F.col(name)))
