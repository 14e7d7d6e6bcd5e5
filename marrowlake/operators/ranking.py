"""Ranks within groups of any size."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.types import StringType

#: A group of more rows than this is ranked in slices by several tasks.
ROWS_PER_TASK = 200_000
#: Quantiles that such a group is cut at.
SLICES = 256
#: Stands for large groups that are not known yet; None says that there are none.
UNKNOWN = "unknown"


def large_groups(df: DataFrame, group: str, rows_per_task: int = ROWS_PER_TASK) -> DataFrame:
    """Groups of more than rows_per_task rows; at most count(df) / rows_per_task of them."""
    return df.groupBy(group).count().filter(F.col("count") > rows_per_task).select(group)


def _number(df: DataFrame, column: str) -> Column:
    """A number that grows with the column: itself, or the first 60 bits of a text."""
    c = F.col(column)
    if isinstance(df.schema[column].dataType, StringType):
        return F.conv(F.rpad(F.substring(F.hex(F.encode(c, "UTF-8")), 1, 15), 15, "0"), 16, 10).cast("double")
    return c.cast("double")


def _sorted(order: list[tuple[str, bool]]) -> list[Column]:
    return [F.col(c).desc_nulls_last() if down else F.col(c).asc_nulls_last() for c, down in order]


def _before(rows: DataFrame, group: str, order: list[tuple[str, bool]], rows_per_task: int) -> DataFrame:
    """rows (which have the weight _c) with _b, the weight of the rows of their group that come earlier; equal rows are in any order.

    A group is cut at quantiles of the first column of the order, and each cut value is a slice of its own, so a value that fills much of the group fills whole slices; such a
    slice is cut again by the next column.
    """
    lead, down = order[0]
    x = _number(rows, lead)
    cuts = rows.groupBy(group).agg(F.array_distinct(F.percentile_approx(x, [i / SLICES for i in range(1, SLICES)], 10_000)).alias("_cuts"))
    place = 2 * F.size(F.filter("_cuts", lambda c: c < x)) + F.array_contains("_cuts", x).cast("int")
    last = -1 if down else 4 * SLICES
    r = rows.join(cuts, group).withColumn("_slice", F.coalesce(F.when(x.isNull(), F.lit(last)).otherwise(place), F.lit(last))).drop("_cuts")
    sizes = r.groupBy(group, "_slice").agg(F.sum("_c").alias("_w"), F.count("*").alias("_rows"), F.min(lead).eqNullSafe(F.max(lead)).alias("_same"))
    by_slice = Window.partitionBy(group).orderBy(F.col("_slice").desc() if down else F.col("_slice").asc())
    sizes = sizes.withColumn("_off", F.sum("_w").over(by_slice) - F.col("_w")).withColumn("_deep", F.col("_same") & (F.col("_rows") > rows_per_task)).drop("_w", "_rows", "_same")
    r = r.join(sizes, [group, "_slice"])
    deep = len(order) > 1 and not sizes.filter("_deep").isEmpty()
    flat = r.filter("not _deep") if deep else r
    w = Window.partitionBy(group, "_slice").orderBy(*_sorted(order)).rowsBetween(Window.unboundedPreceding, 0)
    out = flat.withColumn("_b", F.col("_off") + F.sum("_c").over(w) - F.col("_c")).select(*rows.columns, "_b")
    if deep:
        key, off = f"_key{len(order)}", f"_off{len(order)}"  # names of this depth
        inner = r.filter("_deep").withColumn(key, F.struct(group, "_slice")).withColumn(off, F.col("_off")).drop("_deep", "_slice", "_off")
        inner = _before(inner, key, order[1:], rows_per_task).withColumn("_b", F.col("_b") + F.col(off))
        out = out.unionByName(inner.select(*rows.columns, "_b"))
    return out


def rank_in_group(
    df: DataFrame, group: str, order: list[tuple[str, bool]], out: str = "position", ties: str = "rank", rows_per_task: int = ROWS_PER_TASK, large: DataFrame | None | str = UNKNOWN
) -> DataFrame:
    """Adds `out`, the 1-based rank of each row in its group.

    order: (column, descending) pairs of numbers, timestamps or texts. ties: "rank" gives equal rows the same rank, "row_number" numbers them (give a total order).
    Groups up to rows_per_task rows are ranked by one window. Of larger ones, ranks are made of the distinct values with their counts, and numbers of the rows themselves, in
    slices cut at quantiles, so no task holds a whole large group even where a column is constant. large names the large groups, None that there are none. Nulls come last. An
    empty frame gives an empty frame.
    """
    func = F.rank() if ties == "rank" else F.row_number()
    if isinstance(large, str):
        large = large_groups(df, group, rows_per_task)
        large = None if large.isEmpty() else large
    if large is None:
        return df.withColumn(out, func.over(Window.partitionBy(group).orderBy(*_sorted(order))))
    flagged = df.join(large.withColumn("_large", F.lit(True)), group, "left")
    small = flagged.filter(F.col("_large").isNull()).drop("_large").withColumn(out, func.over(Window.partitionBy(group).orderBy(*_sorted(order))))
    hot = flagged.filter("_large").drop("_large")
    if ties == "rank":
        names = [c for c, _ in order]
        counts = _before(hot.groupBy(group, *names).agg(F.count("*").alias("_c")), group, order, rows_per_task)
        known = counts.select(F.col(group).alias("_g"), *(F.col(c).alias(f"_k{i}") for i, c in enumerate(names)), "_b")
        same = F.col(group) == F.col("_g")
        for i, c in enumerate(names):
            same &= F.col(c).eqNullSafe(F.col(f"_k{i}"))
        ranked = hot.join(known, same)
    else:
        ranked = _before(hot.withColumn("_c", F.lit(1)), group, order, rows_per_task)
    return small.unionByName(ranked.withColumn(out, (F.col("_b") + 1).cast("int")).select(*small.columns))
