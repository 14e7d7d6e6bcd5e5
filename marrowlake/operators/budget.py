"""Token budgets."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

#: A part of an entry is worth showing if more than this is left.
LEAST_ROOM = 200


def admitted(entries: DataFrame, max_tokens: int, entry: str = "entry", group: str = "query_id") -> DataFrame:
    """Entries that the budget of 4 bytes a token takes in order of position, with `shown`, the text as shown, and `cut`.

    Whole entries are taken while they fit; the first that does not is shown in part if more than LEAST_ROOM is left,
    and ends the walk. Sizes are bytes, the part is counted in characters.
    """
    room = max_tokens * 4
    w = Window.partitionBy(group).orderBy("position")
    size = F.octet_length(entry)
    e = entries.withColumn("_after", F.sum(size).over(w.rowsBetween(Window.unboundedPreceding, 0))).withColumn("_left", room - (F.col("_after") - size))
    e = e.withColumn("_over", (F.col("_after") > room).cast("int")).withColumn("_overs", F.sum("_over").over(w.rowsBetween(Window.unboundedPreceding, 0)))
    fits, part = F.col("_overs") == 0, (F.col("_overs") == 1) & (F.col("_over") == 1) & (F.col("_left") > LEAST_ROOM)
    return e.filter(fits | part).withColumn("cut", ~fits).withColumn("shown", F.when(fits, F.col(entry)).otherwise(F.substring(F.col(entry), F.lit(1), F.col("_left").cast("int")))).drop("_after", "_left", "_over", "_overs")


def budget_summary(taken: DataFrame, group: str = "query_id") -> DataFrame:
    """(group, admitted, body): how many entries were taken, and the text of all."""
    body = F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("position", "shown"))), lambda x: x["shown"]), "")  # bounded by the budget
    return taken.groupBy(group).agg(F.count("*").alias("admitted"), body.alias("body"))


def lessons_block(lessons: DataFrame, max_tokens: int, header: str = "# Lessons\n", footer: str = "\n", group: str = "project") -> DataFrame:
    """(group, body, shown, omitted): newest lessons first while header, lines and footer fit into 4 bytes a token.

    lessons: group, id, text, created. The first that does not fit ends the list; what is left out is counted in a last line.
    """
    w = Window.partitionBy(group).orderBy(F.desc("created"), "id")
    line = F.concat(F.lit("- "), F.col("text"), F.lit("\n"))
    n = lessons.withColumn("line", line).withColumn("position", F.row_number().over(w)).withColumn("used", F.sum(F.octet_length("line")).over(w.rowsBetween(Window.unboundedPreceding, 0)) + len(header.encode()) + len(footer.encode()))
    fit = n.withColumn("fits", F.col("used") <= max_tokens * 4)
    agg = fit.groupBy(group).agg(F.count_if(F.col("fits")).alias("shown"), F.count_if(~F.col("fits")).alias("omitted"), F.array_sort(F.collect_list(F.when(F.col("fits"), F.struct("position", "line")))).alias("rows"))
    lines = F.array_join(F.transform("rows", lambda x: x["line"]), "")
    more = F.when(F.col("omitted") > 0, F.concat(F.lit("("), F.col("omitted").cast("string"), F.lit(" more)\n"))).otherwise("")
    return agg.select(group, F.when(F.col("shown") > 0, F.concat(F.lit(header), lines, more, F.lit(footer))).alias("body"), "shown", "omitted")
