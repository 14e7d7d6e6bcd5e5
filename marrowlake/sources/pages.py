"""Pages of documents."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def page_offsets(pages: DataFrame) -> DataFrame:
    """(doc_id, number, ocr, offset): byte offset of each page with text, pages being joined by a blank line.

    Pages that repeat count once, pages without text not at all.
    """
    p = pages.filter(F.trim(F.regexp_replace("markdown", r"\s+", " ")) != "").groupBy("doc_id", "number").agg(F.max("markdown").alias("markdown"), F.max("ocr").alias("ocr"))
    w = Window.partitionBy("doc_id").orderBy("number").rowsBetween(Window.unboundedPreceding, -1)
    return p.select("doc_id", "number", "ocr", F.coalesce(F.sum(F.octet_length("markdown") + 2).over(w), F.lit(0)).alias("offset"), "markdown")


def assembled(pages: DataFrame) -> DataFrame:
    """(doc_id, text, pages): a document of its pages in order, a blank line behind each, with where each begins."""
    rows = F.array_sort(F.collect_list(F.struct("number", "offset", "ocr", "markdown")))  # the pages of one document become one row
    d = page_offsets(pages).groupBy("doc_id").agg(rows.alias("rows"))
    text = F.concat(F.array_join(F.transform("rows", lambda x: x["markdown"]), "\n\n"), F.lit("\n\n"))
    return d.select("doc_id", text.alias("text"), F.transform("rows", lambda x: F.struct(x["number"].alias("page"), x["offset"].alias("offset"), x["ocr"].alias("ocr"))).alias("pages"))


def page_at(pages: Column, offset: Column) -> Column:
    """The last page that begins at or before the offset; null before the first. pages: array of (page, offset) in order."""
    return F.try_element_at(F.filter(pages, lambda p: p["offset"] <= offset), F.lit(-1))["page"]
