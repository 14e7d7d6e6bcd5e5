"""Usage log."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def parse_log(lines: DataFrame, value: str = "value") -> DataFrame:
    """(ts, doc_id) of lines "<epoch seconds> <doc id>"; malformed lines are skipped."""
    v = F.trim(value)
    return lines.filter(v.rlike(r"^-?\d+\s+\S+$")).select(F.split(v, r"\s+")[0].try_cast("long").alias("ts"), F.split(v, r"\s+")[1].alias("doc_id")).filter("ts is not null")


def folded(log: DataFrame) -> DataFrame:
    """(doc_id, first_seen, last_used): pre-aggregated minimum and maximum."""
    return log.groupBy("doc_id").agg(F.min("ts").alias("first_seen"), F.max("ts").alias("last_used"))


def merged(state: DataFrame, fresh: DataFrame) -> DataFrame:
    """The state of all documents after a fold is merged into it."""
    return state.unionByName(fresh).groupBy("doc_id").agg(F.min("first_seen").alias("first_seen"), F.max("last_used").alias("last_used"))


def retained(usage: DataFrame, documents: DataFrame, doc: str = "doc_id") -> DataFrame:
    """Usage of documents that are still indexed."""
    return usage.join(documents.select(F.col(doc).alias("doc_id")).distinct(), "doc_id", "left_semi")
