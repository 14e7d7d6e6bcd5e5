"""One order from several differently scaled scores (p1)."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from marrowlake.operators.ranking import large_groups, rank_in_group

MEASURES = {"score": None, "relevance": None, "inbound": 0.0}


def fused_scores(hits: DataFrame, group: str = "query_id", item: str = "chunk_id", measures: dict[str, float | None] = MEASURES, equal_say: bool = False) -> DataFrame:
    """Per group and item: the rank and percentile of each measure and the leximin vector.

    Of repeated rows the largest value of each measure counts. measures gives, by column, the value
    that stands for null; None leaves it missing, and a missing value ranks behind all others. Equal
    values share the best rank. The percentile is 1 - (rank - 1) / (n - 1), 1 in a group of one item.
    `vector` holds the item's ranks, worst first, negated: larger arrays are better, so comparing two of
    them lexicographically compares the weakest measure first, then the next (leximin), and no
    strong measure can mask a weak one. With equal_say the vector starts with the negated sum of ranks, so the total
    decides and leximin breaks its ties. Rows without group or item are left out. Other columns are
    not read. An empty table gives no rows.
    """
    names = list(measures)
    fill = {m: F.col(m).cast("double") if v is None else F.coalesce(F.col(m).cast("double"), F.lit(float(v))) for m, v in measures.items()}
    large = large_groups(hits, group)
    large = None if large.isEmpty() else large
    items = hits.select(F.col(group).alias("g"), F.col(item).alias("i"), *(F.when(~F.isnan(c), c).alias(f"m{k}") for k, c in enumerate(fill.values())))
    items = items.filter("g is not null and i is not null").groupBy("g", "i").agg(*(F.max(f"m{k}").alias(f"m{k}") for k in range(len(names))))
    if large is None:
        from pyspark.sql import Window

        ranked = items.withColumn("n", F.count("*").over(Window.partitionBy("g")))
    else:
        ranked = items.join(items.groupBy("g").agg(F.count("*").alias("n")), "g")
        large = large.withColumnRenamed(group, "g")
    for k in range(len(names)):
        ranked = rank_in_group(ranked, "g", [(f"m{k}", True)], f"r{k}", large=large, rows_per_task=1 << 62)
    ranks = [F.col(f"r{k}") for k in range(len(names))]
    vector = F.array_sort(F.array(*(-r for r in ranks)))
    if equal_say:
        vector = F.concat(F.array(-sum(ranks[1:], ranks[0])), vector)
    share = [F.when(F.col("n") > 1, 1 - (r - 1) / (F.col("n") - 1)).otherwise(F.lit(1.0)).alias(f"{m}_pct") for r, m in zip(ranks, names)]
    return ranked.select(F.col("g").alias(group), F.col("i").alias(item), "n", *share, vector.alias("vector"))


def leximin_order(hits: DataFrame, group: str = "query_id", item: str = "chunk_id", measures: dict[str, float | None] = MEASURES, equal_say: bool = False) -> DataFrame:
    """fused_scores with `position`, 1 for the best; items equal in all measures are ordered by name."""
    scored = fused_scores(hits, group, item, measures, equal_say)
    width = len(measures) + equal_say
    parts = scored.select("*", *(F.col("vector")[k].alias(f"v{k}") for k in range(width)))
    return rank_in_group(parts, group, [*((f"v{k}", True) for k in range(width)), (item, False)], "position", "row_number").drop(*(f"v{k}" for k in range(width)))


def best_items(hits: DataFrame, group: str = "query_id", item: str = "chunk_id", measures: dict[str, float | None] = MEASURES, least_items: int = 1, equal_say: bool = True) -> DataFrame:
    """The first item of every group of at least least_items items; one aggregation, no global order."""
    scored = fused_scores(hits, group, item, measures, equal_say).filter(F.col("n") >= least_items)
    # the smallest struct: vectors negated back, then the name
    key = F.struct(F.transform("vector", lambda x: -x).alias("v"), F.col(item).alias("i"))
    return scored.groupBy(group).agg(F.min(key).alias("k")).select(group, F.col("k.i").alias(item))
