"""Nearest neighbours, exact and through an index of cells (J9, K12), measuring (J7) and near-duplicate probes."""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from marrowlake.functions.weights import dot, norm, relevance, usable_vector

#: Queries whose vectors are sent to the executors at once: BLOCK * dims * 8 bytes.
BLOCK = 4_096
#: Rows of a batch that are compared at a time, so that the product of a full block stays below BLOCK * SLAB * 8 bytes.
SLAB = 4_096
#: Vectors that cells are fitted on (the bound of what reaches the driver), rows of the sample that teach a cell, and rounds of the fit.
FIT_ROWS, ROWS_TO_LEARN, ROUNDS = 16_384, 16, 12
#: A search of width w looks at the nearest cells until they hold w * ROWS_A_STEP rows.
ROWS_A_STEP = 128


def usable(rows: DataFrame, row_id: str, vector: str, dims: int = 64) -> DataFrame:
    """(id, vec) of rows whose vector can be compared, each id once (the largest vector)."""
    return rows.filter(F.col(row_id).isNotNull() & usable_vector(F.col(vector), dims)).groupBy(F.col(row_id).alias("id")).agg(F.max(vector).alias("vec"))


def _matrix(column: pa.Array, dims: int) -> np.ndarray:
    x = np.asarray(column.flatten().to_numpy(zero_copy_only=False), np.float64).reshape(-1, dims)
    return x / np.linalg.norm(x, axis=1, keepdims=True)


# ---- cells ----


@dataclass(frozen=True)
class Cells:
    """Centres of length one (cells x dims) and the rows that each cell holds."""

    centres: np.ndarray
    sizes: np.ndarray

    def nearest(self, x: np.ndarray) -> np.ndarray:
        return np.argmax(x @ self.centres.T, axis=1).astype(np.int32)

    def probed(self, x: np.ndarray, width: int) -> np.ndarray:
        """(rows of x, cells): whether a search of that width looks into the cell."""
        s = x @ self.centres.T
        order = np.argsort(-s, axis=1, kind="stable")
        held = np.cumsum(self.sizes[order], axis=1) - self.sizes[order]
        out = np.zeros(s.shape, bool)
        np.put_along_axis(out, order, held < width * ROWS_A_STEP, axis=1)
        return out


def fit_centres(x: np.ndarray, cells: int, seed: int = 3) -> np.ndarray:
    """Spherical k-means from random rows; an empty cell is moved to the row that its own centre fits least."""
    rng = np.random.default_rng(seed)
    c = x[rng.choice(len(x), cells, replace=False)].copy()
    for _ in range(ROUNDS):
        s = x @ c.T
        at = s.argmax(1)
        far = np.argsort(s[np.arange(len(x)), at], kind="stable")
        new = np.zeros_like(c)
        np.add.at(new, at, x)
        empty = np.flatnonzero(np.bincount(at, minlength=cells) == 0)
        new[empty] = x[far[: len(empty)]]
        c = new / np.maximum(np.linalg.norm(new, axis=1, keepdims=True), 1e-12)
    return c


def fit_cells(vectors: DataFrame, dims: int = 64, fit_rows: int = FIT_ROWS) -> np.ndarray:
    """Centres for vectors (id, vec), about the root of their number, at most fit_rows / ROWS_TO_LEARN.

    They are fitted on the fit_rows with the smallest hash of the id, by a top-k that every task cuts first; every row is then stored.
    """
    n = vectors.count()
    sample = vectors.select("vec", F.xxhash64("id").alias("h")).orderBy("h").limit(fit_rows).select("vec").toArrow()
    x = _matrix(sample.column("vec").combine_chunks(), dims) if sample.num_rows else np.zeros((0, dims))
    cells = max(1, min(int(np.sqrt(n)), len(x) // ROWS_TO_LEARN))
    return fit_centres(x, cells) if cells > 1 else np.zeros((1, dims))


def placed(vectors: DataFrame, centres: np.ndarray, dims: int = 64) -> DataFrame:
    """vectors (id, vec) with `cell`, that of the nearest centre. One pass, no shuffle; the centres are a bounded broadcast."""
    from pyspark.sql.types import IntegerType, StructField, StructType

    shared = vectors.sparkSession.sparkContext.broadcast(Cells(centres, np.zeros(len(centres), np.int64)))
    schema = StructType([*(vectors.schema[c] for c in ("id", "vec")), StructField("cell", IntegerType())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            if b.num_rows:
                yield pa.RecordBatch.from_arrays([*b.columns, pa.array(shared.value.nearest(_matrix(b.column(1), dims)))], names=schema.names)

    return vectors.select("id", "vec").mapInArrow(run, schema)


# ---- search ----


def knn(queries: DataFrame, rows: DataFrame, k: int, dims: int = 64, block: int = BLOCK, least: float | None = None, itself: bool = True, cells: Cells | None = None, width: int = 0) -> DataFrame:
    """(query_id, id, cosine, relevance, position): the k rows of greatest cosine for each query.

    queries: (query_id, vec), rows: (id, vec), both usable. Exact without cells; with them rows need `cell`, only the cells that some query probes are read, and a
    query sees the rows of its nearest cells, max(width, k) * ROWS_A_STEP or more of them. The queries go to the executors in blocks of a fixed size; rows are
    compared by matrix products, and a task keeps its k best of each query, so what is shuffled is k rows a query and task. Ties go to the smaller id. least drops rows below
    that relevance; without itself, rows that have the query's own id are left out before the k best are taken. queries is evaluated twice: cut it if it is dear.
    """
    asked = queries.select(F.col("query_id").cast("string").alias("query_id"), "vec")
    parts = max(1, -(-asked.count() // block))
    found = None
    for b in range(parts):
        mine = asked if parts == 1 else asked.filter(F.pmod(F.xxhash64("query_id"), F.lit(parts)) == b)
        t = mine.toArrow()  # about `block` vectors
        if not t.num_rows:
            continue
        x = _matrix(t.column("vec").combine_chunks(), dims)
        looks = cells.probed(x, max(width, k)) if cells else None
        q = rows.sparkSession.sparkContext.broadcast((np.array(t.column("query_id").to_pylist(), object), x, looks))

        def run(batches: Iterator[pa.RecordBatch], q=q) -> Iterator[pa.RecordBatch]:
            names, x, looks = q.value
            text = names.astype(str)
            kept, waiting, held = None, [], 0

            def best(tables: list[pa.Table]) -> pa.Table:
                t = pa.concat_tables(tables)
                t = t.take(pc.sort_indices(t, [("q", "ascending"), ("cosine", "descending"), ("id", "ascending")]))
                own = t.column("q").to_numpy()
                first = np.searchsorted(own, own)  # where the rows of a query begin
                return t.filter(pa.array(np.arange(len(own)) - first < k))

            def compare(at: np.ndarray, ids: pa.Array, y: np.ndarray) -> pa.Table:
                """The k best of some rows, which are in order of id, for the queries `at`."""
                s = np.round(x[at] @ y.T, 12)  # beyond the 12th digit the order would depend on how a sum was split
                if not itself:
                    s[text[at][:, None] == np.asarray(ids.to_pylist(), str)[None, :]] = -np.inf
                m = min(k, s.shape[1])
                edge = np.partition(s, s.shape[1] - m, axis=1)[:, s.shape[1] - m]
                good = s >= edge[:, None]
                for r in np.flatnonzero(good.sum(1) > m):  # ties at the edge: the smaller ids stay
                    good[r] = False
                    good[r, np.argsort(-s[r], kind="stable")[:m]] = True
                i, j = np.nonzero(good & (s > -np.inf))
                return pa.table({"q": pa.array(at[i], pa.int32()), "id": ids.take(pa.array(j)), "cosine": pa.array(s[i, j])})

            for batch in batches:
                for a in range(0, batch.num_rows, SLAB):
                    part = batch.slice(a, SLAB)
                    part = part.take(pc.sort_indices(part.column(0)))
                    ids, y = part.column(0), _matrix(part.column(1), dims)
                    if looks is None:
                        waiting.append(compare(np.arange(len(names)), ids, y))
                    else:
                        cell = part.column(2).to_numpy()
                        for c in np.unique(cell):
                            at, here = np.flatnonzero(looks[:, c]), np.flatnonzero(cell == c)
                            if len(at):
                                waiting.append(compare(at, ids.take(pa.array(here)), y[here]))
                    held = sum(w.num_rows for w in waiting)
                    if held > 8 * k * len(names):
                        kept, waiting = best([*([kept] if kept else []), *waiting]), []
            if kept is not None or waiting:
                kept = best([*([kept] if kept is not None else []), *waiting])
                yield from pa.table({"query_id": pa.array(names[kept.column("q").to_numpy()].tolist(), pa.string()), "id": kept.column("id"), "cosine": kept.column("cosine")}).to_batches()

        source = rows
        if looks is not None:
            wanted = np.flatnonzero(looks.any(0)).tolist()  # at most the number of cells
            source = rows.filter(F.col("cell").isin(wanted)) if len(wanted) < looks.shape[1] else rows
        source = source.select(F.col("id").cast("string"), "vec", *(["cell"] if looks is not None else []))
        one = source.mapInArrow(run, "query_id string, id string, cosine double")
        found = one if found is None else found.unionByName(one)
    if found is None:
        found = rows.sparkSession.createDataFrame([], "query_id string, id string, cosine double")
    found = found.withColumn("relevance", relevance(F.col("cosine")))
    if least is not None:
        found = found.filter(F.col("relevance") >= least)
    w = Window.partitionBy("query_id").orderBy(F.desc("cosine"), "id")
    return found.withColumn("position", F.row_number().over(w)).filter(F.col("position") <= k)


def measured(pairs: DataFrame, queries: DataFrame, rows: DataFrame) -> DataFrame:
    """pairs (query_id, id) with relevance where both vectors are usable; others are left out, never 0."""
    q = queries.select("query_id", F.col("vec").alias("_q"))
    r = rows.select("id", F.col("vec").alias("_r"))
    cos = dot(F.col("_q"), F.col("_r")) / (norm(F.col("_q")) * norm(F.col("_r")))
    return pairs.select("query_id", "id").distinct().join(q, "query_id").join(r, "id").select("query_id", "id", relevance(F.round(cos, 12)).alias("relevance"))


def near_duplicate(probes: DataFrame, rows: DataFrame, kind: str = "kind", least: float = 0.94, take: int = 5, dims: int = 64) -> DataFrame:
    """(query_id, id, relevance): the first of the take nearest other rows of the same kind with at least that relevance."""
    near = knn(probes, rows, take, dims, itself=False).join(probes.select(F.col("query_id").cast("string"), F.col(kind).alias("_k")), "query_id").join(rows.select(F.col("id").cast("string"), F.col(kind).alias("_r")), "id")
    fit = near.filter((F.col("_k") == F.col("_r")) & (F.col("relevance") >= least))
    return fit.groupBy("query_id").agg(F.min_by(F.struct("id", "relevance"), "position").alias("h")).select("query_id", "h.id", "h.relevance")
