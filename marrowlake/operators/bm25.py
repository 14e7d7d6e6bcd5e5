"""BM25: index build (A1, K11) and search (A2).

Terms are counted inside each row, so texts never move; what moves is blocks of counts, once, to the bucket of their term, where they are stored in order. Scores are made from
the counts of the terms that are asked for, the dictionary (term, df) and three totals.
"""

from __future__ import annotations

from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, IntegerType, StringType, StructField, StructType

from marrowlake.functions.stem import porter
from marrowlake.functions.text import SEPARATORS, STOP_WORDS, fold_newlines
from marrowlake.runtime import through_table

K1, B = 1.2, 0.75
#: Rows whose counts go back to the JVM at once.
ROWS_AT_ONCE = 1_000
_SPACES = str.maketrans(dict.fromkeys(SEPARATORS, " "))


def row_terms(text: str | None, stop: frozenset[str], stemmed: bool) -> list[str]:
    """the terms of a text in lower case: split, without stop words, stemmed, without empty ones."""
    words = [w for w in (text or "").translate(_SPACES).split(" ") if w and w not in stop]
    return [s for w in words if (s := porter(w))] if stemmed else words


def _flat(texts: list[str | None], stop: frozenset[str], stemmed: bool) -> tuple[list[int], list[str], list[int], list[int]]:
    """(place of the text, term, occurrences, terms of the text), one entry a text and distinct term."""
    at: list[int] = []
    term: list[str] = []
    tf: list[int] = []
    dl: list[int] = []
    for i, t in enumerate(texts):
        counts = Counter(row_terms(t, stop, stemmed))
        n = len(counts)
        at += [i] * n
        term += counts
        tf += counts.values()
        dl += [sum(counts.values())] * n
    return at, term, tf, dl


def term_counts(rows: DataFrame, row_id: str = "id", text: Column | None = None, stop: tuple[str, ...] = STOP_WORDS, stemmed: bool = True) -> DataFrame:
    """(row_id, term, tf, dl) of rows: occurrences of each term in its row, and all terms of the row. No exchange; rows without terms give no row."""
    source = fold_newlines(F.col("text")) if text is None else text
    words, kind = frozenset(stop), rows.schema[row_id].dataType
    schema = StructType([StructField(row_id, kind), StructField("term", StringType()), StructField("tf", IntegerType()), StructField("dl", IntegerType())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for a in range(0, b.num_rows, ROWS_AT_ONCE):
                part = b.slice(a, ROWS_AT_ONCE)
                at, term, tf, dl = _flat(part.column(1).to_pylist(), words, stemmed)
                yield pa.RecordBatch.from_arrays([part.column(0).take(pa.array(at, pa.int64())), pa.array(term, pa.string()), pa.array(tf, pa.int32()), pa.array(dl, pa.int32())], names=schema.names)

    return rows.select(row_id, F.lower(source)).mapInArrow(run, schema)


def term_blocks(rows: DataFrame, row_id: str = "id", text: Column | None = None, stop: tuple[str, ...] = STOP_WORDS, stemmed: bool = True) -> DataFrame:
    """term_counts by blocks: (term, rows, tfs, dls) of the rows of one batch that hold the term. No exchange; no block holds more rows than a batch has."""
    source = fold_newlines(F.col("text")) if text is None else text
    words, kind = frozenset(stop), rows.schema[row_id].dataType
    schema = StructType([StructField("term", StringType()), StructField("rows", ArrayType(kind)), *(StructField(c, ArrayType(IntegerType())) for c in ("tfs", "dls"))])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            at, term, tf, dl = _flat(b.column(1).to_pylist(), words, stemmed)
            coded = pa.array(term, pa.string()).dictionary_encode()
            code = coded.indices.to_numpy()
            order = np.argsort(code, kind="stable")
            ends = pa.array(np.concatenate([[0], np.cumsum(np.bincount(code, minlength=len(coded.dictionary)))]).astype(np.int32))
            values = (b.column(0).take(pa.array(np.array(at, np.int64)[order])), pa.array(np.array(tf, np.int32)[order]), pa.array(np.array(dl, np.int32)[order]))
            yield pa.RecordBatch.from_arrays([coded.dictionary, *(pa.ListArray.from_arrays(ends, v) for v in values)], names=schema.names)

    return rows.select(row_id, F.lower(source)).mapInArrow(run, schema)


@dataclass(frozen=True)
class Index:
    """postings: blocks (bucket, term, rows, tfs, dls) if buckets is set, else counts (term, row_id, tf, dl); terms: (term, df). rows and all_terms are totals over all rows."""

    stored: DataFrame
    terms: DataFrame
    rows: int
    all_terms: int
    row_id: str = "id"
    buckets: int | None = None
    stop: tuple[str, ...] = STOP_WORDS
    stemmed: bool = True

    def impact(self) -> Column:
        """What a row adds to the score of a query with the term, from tf, dl and df."""
        idf = F.log(1 + (F.lit(float(self.rows)) - F.col("df") + 0.5) / (F.col("df") + 0.5))
        mean = self.all_terms / self.rows if self.rows else 1.0
        return idf * F.col("tf") * (K1 + 1) / (F.col("tf") + K1 * (1 - B + B * F.col("dl") / (mean or 1.0)))

    def entries(self, terms: DataFrame, buckets: list[int] | None = None) -> DataFrame:
        """The columns of terms (term and others) with row_id, tf and dl of each row that holds the term. Blocks are opened behind the join."""
        if self.buckets is None:
            return terms.join(self.stored, "term")
        blocks = self.stored if buckets is None else self.stored.filter(F.col("bucket").isin(buckets) if buckets else F.lit(False))
        return blocks.drop("bucket").join(terms, "term").select(*terms.columns, F.inline(F.arrays_zip("rows", "tfs", "dls")).alias(self.row_id, "tf", "dl"))

    def postings(self) -> DataFrame:
        """(term, row_id, tf, impact) of all rows."""
        return self.entries(self.terms.select("term", "df")).select("term", self.row_id, F.col("tf").cast("long").alias("tf"), self.impact().alias("impact"))


def bucket_of(term: Column, buckets: int) -> Column:
    return F.pmod(F.xxhash64(term), F.lit(buckets)).cast("int")


def build(rows: DataFrame, path: str, row_id: str = "id", stop: tuple[str, ...] = STOP_WORDS, stemmed: bool = True, buckets: int = 16) -> Index:
    """The index of rows (row_id unique, text) written below path: blocks of postings by bucket and in order of term, the dictionary.

    One pass over the texts and one exchange of blocks; the rebalancing splits a bucket that a frequent term makes large and joins small ones.
    """
    spark = rows.sparkSession
    made = term_blocks(rows, row_id, stop=stop, stemmed=stemmed).withColumn("bucket", bucket_of(F.col("term"), buckets))
    made.hint("rebalance", "bucket").sortWithinPartitions("bucket", "term").write.partitionBy("bucket").parquet(f"{path}/blocks")
    blocks = spark.read.schema(made.schema).parquet(f"{path}/blocks")
    n_in = F.aggregate("tfs", F.lit(0).cast("long"), lambda s, x: s + x)
    terms = blocks.groupBy("bucket", "term").agg(F.sum(F.size("tfs")).alias("df"), F.sum(n_in).alias("n"))
    terms.sortWithinPartitions("bucket", "term").write.parquet(f"{path}/terms")
    terms = spark.read.schema(terms.schema).parquet(f"{path}/terms")
    n = rows.select(row_id).count()
    total = terms.agg(F.coalesce(F.sum("n"), F.lit(0))).first()[0]
    return Index(blocks, terms, n, total, row_id, buckets, stop, stemmed)


def opened(spark, path: str, rows: int, all_terms: int, row_id: str, row_type: str, buckets: int, stop: tuple[str, ...] = STOP_WORDS, stemmed: bool = True) -> Index:
    """The index that build wrote below path; nothing is read but file names."""
    blocks = spark.read.schema(f"term string, rows array<{row_type}>, tfs array<int>, dls array<int>, bucket int").parquet(f"{path}/blocks")
    terms = spark.read.schema("bucket int, term string, df long, n long").parquet(f"{path}/terms")
    return Index(blocks, terms, rows, all_terms, row_id, buckets, stop, stemmed)


def indexed(rows: DataFrame, row_id: str = "id", text: str = "text", stop: tuple[str, ...] = STOP_WORDS, stemmed: bool = True) -> Index:
    """The index of rows for one use; counts are kept in the shared folder, without buckets."""
    counts = through_table(term_counts(rows.select(row_id, F.col(text).alias("text")), row_id, stop=stop, stemmed=stemmed), "counts")
    terms = counts.groupBy("term").agg(F.count("*").alias("df"))
    t = counts.agg(F.coalesce(F.sum("tf"), F.lit(0))).first()[0]
    return Index(counts, terms, rows.count(), t, row_id, None, stop, stemmed)


def postings(rows: DataFrame, row_id: str = "id", text: str = "text", stop: tuple[str, ...] = STOP_WORDS, stemmed: bool = True) -> DataFrame:
    """(term, row_id, tf, impact) of rows with a unique row_id. N and the mean length count every row, also those without a term; null texts have no terms."""
    return indexed(rows, row_id, text, stop, stemmed).postings()


def query_terms(queries: DataFrame, query_id: str = "query_id", text: str = "text", strict: bool = False, stop: tuple[str, ...] = STOP_WORDS, stemmed: bool = True) -> DataFrame:
    """(query_id, term, times). Line breaks are folded only if strict."""
    source = fold_newlines(F.col(text)) if strict else F.col(text)
    return term_counts(queries, query_id, source, stop, stemmed).select(query_id, "term", F.col("tf").alias("times"))


def search(queries: DataFrame, index: Index | DataFrame, k: int = 20, query_id: str = "query_id", text: str = "text", strict: bool = False, row_id: str = "id") -> DataFrame:
    """(query_id, row_id, score, position) of the k best rows of each query, over an index or over postings (term, row_id, impact) made with the default analysis.

    A term that a query repeats adds each time; ties go to the smaller row_id. Only the buckets of the terms asked for are read (their numbers, at most
    index.buckets, reach the driver), the dictionary is joined to the asked terms first, and what each (query, row) gets is summed with partial sums.
    """
    if isinstance(index, Index):
        row_id, wanted = index.row_id, None
        asked = query_terms(queries, query_id, text, strict, index.stop, index.stemmed)
        if index.buckets:
            wanted = [r[0] for r in asked.select(bucket_of(F.col("term"), index.buckets)).distinct().collect()]
        found = index.entries(asked.join(index.terms.select("term", "df"), "term"), wanted).withColumn("impact", index.impact())
    else:
        found = query_terms(queries, query_id, text, strict).join(index, "term")
    hits = found.groupBy(query_id, row_id).agg(F.round(F.sum(F.col("impact") * F.col("times")), 9).alias("score"))
    w = Window.partitionBy(query_id).orderBy(F.desc("score"), row_id)
    return hits.withColumn("position", F.row_number().over(w)).filter(F.col("position") <= k)
