"""How distinctive terms and values are per record (p4): hypergeometric enrichment."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from marrowlake.runtime import through_table

#: Scores are kept to 1 / SCALE, so that equal tests share one row of the adjustment.
SCALE = 1_000_000


def log_gamma(x: np.ndarray) -> np.ndarray:
    """ln gamma(x) for x >= 1: Stirling's series after shifting small x up by the recurrence."""
    x = np.asarray(x, dtype=np.float64)
    shift = np.where(x < 8, 8.0, 0.0)
    y = x + shift
    inv = 1 / y
    inv2 = inv * inv
    series = inv * (1 / 12 - inv2 * (1 / 360 - inv2 * (1 / 1260 - inv2 * (1 / 1680 - inv2 / 1188))))
    out = (y - 0.5) * np.log(y) - y + 0.5 * np.log(2 * np.pi) + series
    if (small := x < 8).any():
        xs = x[small]
        prod = np.ones_like(xs)
        for k in range(8):
            prod *= xs + k
        out[small] -= np.log(prod)
    return out


def log_choose(n: np.ndarray, k: np.ndarray) -> np.ndarray:
    return log_gamma(n + 1) - log_gamma(k + 1) - log_gamma(n - k + 1)


def log_upper_tail(k: np.ndarray, n: np.ndarray, good: np.ndarray, total: np.ndarray) -> np.ndarray:
    """ln P(X >= k), X the hits among n draws without return from total of which good hit; exact to rounding.

    The first probability comes from log-gamma sums, the further ones from the ratio of neighbours, summed until they no longer
    count. Where k lies below the mean the lower tail is summed and subtracted, as it is the shorter sum.
    """
    k, n, good, total = (np.asarray(a, dtype=np.float64) for a in (k, n, good, total))
    out = np.zeros(len(k))
    least = np.maximum(0, n + good - total)
    most = np.minimum(n, good)
    out[k > most] = -np.inf
    todo = (k > least) & (k <= most)
    upper = todo & (k >= n * good / np.maximum(total, 1))
    for up in (True, False):
        i = np.flatnonzero(upper if up else todo & ~upper)
        if not len(i):
            continue
        x = k[i] if up else k[i] - 1
        ni, gi, ti = n[i], good[i], total[i]
        first = log_choose(gi, x) + log_choose(ti - gi, ni - x) - log_choose(ti, ni)
        term, acc = np.ones(len(i)), np.ones(len(i))
        live = np.arange(len(i))
        while len(live):
            xl, nl, gl, tl = x[live], ni[live], gi[live], ti[live]
            if up:
                ratio = (gl - xl) * (nl - xl) / ((xl + 1) * (tl - gl - nl + xl + 1))
                x[live] = xl + 1
            else:
                ratio = xl * (tl - gl - nl + xl) / ((gl - xl + 1) * (nl - xl + 1))
                x[live] = xl - 1
            term[live] *= np.maximum(ratio, 0)
            acc[live] += term[live]
            live = live[term[live] > acc[live] * 1e-17]
        tail = first + np.log(acc)
        out[i] = np.minimum(tail, 0) if up else np.log1p(-np.minimum(np.exp(tail), 1 - 1e-16))
    return out


def with_p(counts: DataFrame) -> DataFrame:
    """Adds micro, -log10 of the upper-tail probability in units of 1 / SCALE, from k, n, good and total."""
    from pyspark.sql.types import LongType, StructField, StructType

    names = counts.columns

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            a = [b.column(names.index(c)).to_numpy(zero_copy_only=False) for c in ("k", "n", "good", "total")]
            # many rows of a batch share their four numbers
            key, back = np.unique(np.stack(a), axis=1, return_inverse=True)
            p = -log_upper_tail(*key) / np.log(10)
            micro = np.rint(np.minimum(p, 1e12) * SCALE).astype(np.int64)[back.ravel()]
            yield pa.RecordBatch.from_arrays([*b.columns, pa.array(micro)], names=[*names, "micro"])

    return counts.mapInArrow(run, StructType([*counts.schema.fields, StructField("micro", LongType())]))


def adjusted(tests: DataFrame) -> DataFrame:
    """(micro, score): the false-discovery adjusted -log10 probability (step-up) for every distinct micro.

    The adjustment needs every test's rank and a running extreme over the order of all tests. The order is taken over
    distinct values with their counts, cut in slices of SCALE / 16; totals and extremes of the slices are
    chained first, then the rows of each slice by themselves.
    """
    v = tests.groupBy("micro").agg(F.count("*").alias("c")).withColumn("slice", F.floor(F.col("micro") / (SCALE // 16)))
    per = v.groupBy("slice").agg(F.sum("c").alias("sc"))
    total = per.agg(F.sum("sc").cast("double").alias("m"))
    before = per.withColumn("before", F.sum("sc").over(Window.orderBy(F.desc("slice"))) - F.col("sc")).crossJoin(total)  # a row a slice: scores are bounded
    inside = Window.partitionBy("slice").orderBy(F.desc("micro"))
    v = v.join(before.select("slice", "before", "m"), "slice").withColumn("rank", F.col("before") + F.sum("c").over(inside))
    # -log10(p m / rank), then the largest value among the tests of equal or less significance
    v = v.withColumn("raw", F.col("micro") / SCALE - F.log10(F.col("m") / F.col("rank")))
    up = Window.partitionBy("slice").orderBy("micro").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    tops = v.groupBy("slice").agg(F.max("raw").alias("top"))
    lower = tops.withColumn("floor", F.max("top").over(Window.orderBy("slice").rowsBetween(Window.unboundedPreceding, -1))).select("slice", "floor")
    v = v.join(lower, "slice").withColumn("score", F.greatest(F.lit(0.0), F.max("raw").over(up), F.coalesce("floor", F.lit(0.0))))
    return v.select("micro", "score")


def term_tests(values: DataFrame, record: str, value: str) -> DataFrame:
    """(record, value, k, n, good, total, df, micro) from one row per occurrence of a value in a record.

    k: occurrences in the record, n: all occurrences in it, good: of the value in the collection, total: all, df: records with the
    value. Counts are pre-aggregated; no record, value or hot term is held by one task.
    """
    k = through_table(values.groupBy(record, value).agg(F.count("*").alias("k")), "terms")
    n = k.groupBy(record).agg(F.sum("k").alias("n"))
    terms = k.groupBy(value).agg(F.sum("k").alias("good"), F.count("*").alias("df"))
    total = k.agg(F.coalesce(F.sum("k"), F.lit(0)).alias("total"))
    return with_p(k.join(n, record).join(terms, value).crossJoin(total))  # total is one row


def enrichment(values: DataFrame, record: str, value: str) -> DataFrame:
    """term_tests with score: -log10 of the upper-tail probability, false-discovery adjusted over all tests.

    0 means not distinctive at all. Rows with a null record or value are left out; an empty table gives no rows.
    """
    tests = through_table(term_tests(values.filter(F.col(record).isNotNull() & F.col(value).isNotNull()), record, value), "tests")
    return tests.join(adjusted(tests), "micro").withColumn("p_score", F.col("micro") / SCALE).drop("micro")


def words(text: Column) -> Column:
    """Maximal runs of letters and digits in lower case that consist of at least five letters a-z."""
    return F.filter(F.split(F.lower(text), r"[^\p{L}\p{N}]+"), lambda w: w.rlike("^[a-z]{5,}$"))


def tag_key(tag: Column) -> Column:
    """A tag trimmed, without leading '#', in lower case; null if nothing is left."""
    t = F.lower(F.regexp_replace(F.regexp_replace(F.regexp_replace(tag, r"^\s+|\s+$", ""), "^#+", ""), r"^\s+|\s+$", ""))
    return F.when(t != "", t)


def chunk_terms(chunks: DataFrame) -> DataFrame:
    """(doc_id, term), a row an occurrence; every chunk id once."""
    one = chunks.select("id", "doc_id", "text").filter("text is not null")
    once = one.groupBy("id").agg(F.min(F.struct("doc_id", "text")).alias("c"))
    return once.select("c.doc_id", F.explode(words(F.col("c.text"))).alias("term"))


def document_tags(documents: DataFrame) -> DataFrame:
    """(doc_id, term), a row a tag; a tag that a document repeats counts once."""
    t = documents.select("doc_id", F.explode("tags").alias("tag")).select("doc_id", tag_key(F.col("tag")).alias("term"))
    return t.filter("term is not null").distinct()
