"""Fusing, weighting, gating and diversifying ranked lists."""

from __future__ import annotations

import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

RRF_K = 60


def rrf(lists: DataFrame, k: int = RRF_K, row_id: str = "chunk_id") -> DataFrame:
    """(query_id, row_id, score, relevance, position) from (query_id, list, weight, row_id, position 1-based, relevance).

    Each list adds weight / (k + position). relevance is the largest that any list measured, 0 if none did. Order: score, then row_id.
    """
    fused = lists.groupBy("query_id", row_id).agg(F.sum(F.col("weight") / (k + F.col("position"))).alias("score"), F.coalesce(F.max("relevance"), F.lit(0.0)).alias("relevance"))
    fused = fused.withColumn("score", F.round("score", 12))
    return fused.withColumn("position", F.row_number().over(Window.partitionBy("query_id").orderBy(F.desc("score"), row_id)))


def weight_and_gate(pool: DataFrame, weight, least: float, row_id: str = "chunk_id") -> DataFrame:
    """Relevance times weight, rows below `least` dropped, position by relevance, then row_id (R4). Gating comes before any diversifying."""
    w = pool.withColumn("relevance", F.round(F.col("relevance") * weight, 12)).filter(F.col("relevance") >= least)
    return w.withColumn("position", F.row_number().over(Window.partitionBy("query_id").orderBy(F.desc("relevance"), row_id)))


def mmr_order(docs: list, texts: list, lam: float, take: int) -> list[int]:
    """Indices of a ranked list in order of selection: what is gained in rank less what is said already; ties go to the earlier."""
    n = len(docs)
    norm = [1.0 if n <= 1 else 1.0 - i / (n - 1) for i in range(n)]
    words = [set((t or "").split()) for t in texts]
    most = [0.0] * n
    left, out = list(range(n)), []
    while left and len(out) < take:
        best = max(left, key=lambda i: (lam * norm[i] - (1 - lam) * most[i], -i))
        out.append(best)
        left.remove(best)
        for i in left:
            both = words[i] | words[best]
            jac = len(words[i] & words[best]) / len(both) if both else 0.0
            most[i] = max(most[i], min(1.0, 0.6 * (docs[i] == docs[best]) + 0.4 * jac))
    return out


def mmr(pool: DataFrame, lam: float, take: int = 10, doc: str = "doc_id", text: str = "text") -> DataFrame:
    """The `take` rows of each query chosen by maximal marginal relevance, with position renewed.

    The pool of a query is bounded by the candidate numbers of its profile, so a group is small whatever the corpus holds.
    """
    names = pool.columns

    def run(t: pa.Table) -> pa.Table:
        t = t.sort_by("position")
        t = t.take(mmr_order(t.column(doc).to_pylist(), t.column(text).to_pylist(), lam, take))
        return t.set_column(names.index("position"), t.schema.field("position"), pa.array(range(1, t.num_rows + 1), t.schema.field("position").type))

    return pool.groupBy("query_id").applyInArrow(run, pool.schema)


def interleaved(first: DataFrame, second: DataFrame, most: int, row_id: str = "chunk_id") -> DataFrame:
    """Rows of two ordered lists by turns, each row once at its first place, at most `most` a query."""
    both = first.withColumn("_l", F.lit(0)).unionByName(second.withColumn("_l", F.lit(1)), allowMissingColumns=True)
    key = F.struct(F.col("position").alias("p"), F.col("_l").alias("l"))
    once = both.groupBy("query_id", row_id).agg(F.min(key).alias("key"))
    return once.withColumn("position", F.row_number().over(Window.partitionBy("query_id").orderBy("key"))).filter(F.col("position") <= most).drop("key")
