"""Most similar vectors for every vector (p2): learned partitions.

A router is fitted on a bounded sample: the sample's neighbour graph is cut into balanced parts, and a linear softmax
classifier learns which part a vector belongs to. Where the sample cannot teach as many parts as the collection needs, each part is cut again by a router of its own,
fitted on the executors on a bounded sample of the part. Every vector is then stored in its likeliest part and
searched for in the few likeliest ones, where exact cosines are computed in blocks.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from marrowlake.runtime import cut, through_table

#: Vectors of the sample that the router is fitted on (the bound of what reaches the driver: 4 bytes a number).
FIT_ROWS = 12_288
#: Vectors that a part should hold, and the most parts that the sample can teach.
ROWS_PER_PART, ROWS_TO_LEARN = 1_000, 24
#: Rows of one block of the search; larger parts are searched in several blocks.
BLOCK = 4_000
GRAPH_K, ROUNDS, SLACK, SMOOTHING = 12, 6, 1.15, 20
EPOCHS, BATCH, SHARPNESS = 12, 1024, 12.0


@dataclass(frozen=True)
class Router:
    """weights (dim x parts) and bias (parts) of the classifier; children cut a part again, first says where a part's leaves begin."""

    weights: np.ndarray
    bias: np.ndarray
    children: tuple[tuple[np.ndarray, np.ndarray] | None, ...] = ()

    @property
    def first(self) -> np.ndarray:
        sizes = [len(c[1]) if c else 1 for c in self.children] or [1] * len(self.bias)
        return np.concatenate([[0], np.cumsum(sizes)])

    @property
    def parts(self) -> int:
        """Leaves."""
        return int(self.first[-1])

    def likeliest(self, x: np.ndarray, probes: int) -> np.ndarray:
        """The probes likeliest leaves of each row, best first, by the product of the probabilities on the way; of a part's leaves only where the part is among the probes likeliest."""
        logits = log_softmax(x @ self.weights + self.bias)
        m = min(probes, len(self.bias))
        top = np.argpartition(-logits, m - 1, axis=1)[:, :m]
        if not any(self.children):
            order = np.argsort(-np.take_along_axis(logits, top, 1), axis=1, kind="stable")
            return np.take_along_axis(top, order, 1)
        first, m = self.first, min(probes, self.parts)
        leaf, value = np.full((len(x), 2 * m), -1, np.int64), np.full((len(x), 2 * m), -np.inf, np.float64)
        for p in np.unique(top):
            rows = np.flatnonzero((top == p).any(1))
            child = self.children[p] if self.children else None
            inner = log_softmax(x[rows] @ child[0] + child[1]) if child else np.zeros((len(rows), 1))
            k = min(m, inner.shape[1])
            best = np.argpartition(-inner, k - 1, axis=1)[:, :k]
            # the leaves of this part take the places behind the m best so far, then the m best of all go in front
            leaf[rows, m : m + k], value[rows, m : m + k] = first[p] + best, logits[rows, p][:, None] + np.take_along_axis(inner, best, 1)
            order = np.argsort(-value[rows], axis=1, kind="stable")
            leaf[rows], value[rows] = np.take_along_axis(leaf[rows], order, 1), np.take_along_axis(value[rows], order, 1)
            value[rows, m:] = -np.inf
        return np.where(value[:, :m] > -np.inf, leaf[:, :m], leaf[:, :1])


def log_softmax(z: np.ndarray) -> np.ndarray:
    z = z - z.max(1, keepdims=True)
    return z - np.log(np.exp(z).sum(1, keepdims=True))


def neighbour_graph(x: np.ndarray, k: int = GRAPH_K) -> np.ndarray:
    """Indices of the k most similar rows of each row, itself left out."""
    k = min(k, len(x) - 1)
    out = np.empty((len(x), k), np.int32)
    for a in range(0, len(x), 1024):
        s = x[a : a + 1024] @ x.T
        s[np.arange(len(s)), np.arange(a, a + len(s))] = -2
        out[a : a + 1024] = np.argpartition(-s, k - 1, axis=1)[:, :k]
    return out


def bisector(x: np.ndarray, graph: np.ndarray, rows: np.ndarray, place: np.ndarray, rng: np.random.Generator) -> np.ndarray:
    """A number for each of rows that changes little along the edges of their graph: the direction of most spread, smoothed over neighbours (the second eigenvector of
    the walk on the graph, by power steps). place is scratch of the length of x."""
    y = x[rows] - x[rows].mean(0)
    v = rng.standard_normal(x.shape[1])
    for _ in range(12):
        v = y.T @ (y @ v)
        v /= np.linalg.norm(v) + 1e-12
    f = y @ v
    place[:] = -1
    place[rows] = np.arange(len(rows))
    near = place[graph[rows]]
    a, c = np.nonzero(near >= 0)
    b = near[a, c]
    degree = np.bincount(a, minlength=len(rows)) + np.bincount(b, minlength=len(rows))
    for _ in range(SMOOTHING):
        sums = np.bincount(a, weights=f[b], minlength=len(rows)) + np.bincount(b, weights=f[a], minlength=len(rows))
        f = 0.5 * f + 0.5 * sums / np.maximum(degree, 1)
        f -= f.mean()
        f /= np.linalg.norm(f) + 1e-12
    return f


def balanced_parts(x: np.ndarray, graph: np.ndarray, parts: int, rng: np.random.Generator) -> np.ndarray:
    """A part for each row: the neighbour graph is halved again and again where few edges are cut, then rows are moved to where their neighbours are.

    Halving gives equal sizes; a move is made only while the part it goes to stays below SLACK times the mean size.
    """
    label = np.zeros(len(x), np.int64)
    place = np.empty(len(x), np.int64)
    todo = [(np.arange(len(x)), 0, parts)]
    while todo:
        rows, first, n = todo.pop()
        if n == 1:
            label[rows] = first
            continue
        left = n // 2
        order = np.argsort(bisector(x, graph, rows, place, rng), kind="stable")
        at = len(rows) * left // n
        todo += [(rows[order[:at]], first, left), (rows[order[at:]], first + left, n - left)]
    most = int(np.ceil(SLACK * len(x) / parts)) + 1
    size = np.bincount(label, minlength=parts)
    for _ in range(ROUNDS):
        near = np.sort(label[graph], axis=1)
        # the most frequent label among the neighbours: the middle of the longest run
        same = (near[:, :, None] == near[:, None, :]).sum(2)
        best = near[np.arange(len(x)), same.argmax(1)]
        own = (near == label[:, None]).sum(1)
        gain = same.max(1) - own
        moved = 0
        for i in np.argsort(-gain, kind="stable"):
            if gain[i] <= 0:
                break
            if size[best[i]] < most:
                size[label[i]] -= 1
                size[best[i]] += 1
                label[i] = best[i]
                moved += 1
        if moved < len(x) // 200:
            break
    return label


def fit_router(x: np.ndarray, parts: int, seed: int = 5) -> Router:
    """Neighbour graph, balanced partition, softmax regression; x has rows of length one."""
    dim = x.shape[1] if x.ndim == 2 else 1
    if parts <= 1 or len(x) <= parts:
        return Router(np.zeros((dim, 1), np.float32), np.zeros(1, np.float32))
    rng = np.random.default_rng(seed)
    label = balanced_parts(x, neighbour_graph(x), parts, rng)
    w = np.zeros((dim, parts), np.float32)
    np.add.at(w.T, label, x)
    w *= SHARPNESS / (np.linalg.norm(w, axis=0) + 1e-9)
    b = np.zeros(parts, np.float32)
    mw, vw, mb, vb, t = np.zeros_like(w), np.zeros_like(w), np.zeros_like(b), np.zeros_like(b), 0
    for _ in range(EPOCHS):
        order = rng.permutation(len(x))
        for a in range(0, len(x), BATCH):
            i = order[a : a + BATCH]
            z = x[i] @ w + b
            z -= z.max(1, keepdims=True)
            p = np.exp(z)
            p /= p.sum(1, keepdims=True)
            p[np.arange(len(i)), label[i]] -= 1
            p /= len(i)
            gw, gb = x[i].T @ p, p.sum(0)
            t += 1
            for g, m, v, theta in ((gw, mw, vw, w), (gb, mb, vb, b)):  # Adam
                m += 0.1 * (g - m)
                v += 0.01 * (g * g - v)
                theta -= 0.05 * (m / (1 - 0.9**t)) / (np.sqrt(v / (1 - 0.99**t)) + 1e-8)
    return Router(w.astype(np.float32), b.astype(np.float32))


def unit_vectors(rows: DataFrame, item: str, vector: str, dim: int = 64) -> DataFrame:
    """(id, vec) of usable rows: vectors of dim finite numbers, not all zero, as the bytes of dim floats of length one."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            v = b.column(1)
            good = np.flatnonzero(np.asarray(v.value_lengths().fill_null(0)) == dim)
            ids, v = b.column(0).take(pa.array(good)), v.take(pa.array(good))
            x = np.asarray(v.flatten().to_numpy(zero_copy_only=False), np.float64).reshape(-1, dim)
            top = np.abs(x).max(1, initial=0)
            keep = np.flatnonzero(np.isfinite(top) & (top > 0))
            x = x[keep] / top[keep, None]
            x /= np.linalg.norm(x, axis=1, keepdims=True)
            raw = x.astype(np.float32)
            yield pa.RecordBatch.from_arrays([ids.take(pa.array(keep)), packed(raw)], names=["id", "vec"])

    usable = rows.filter(F.col(item).isNotNull() & (F.size(vector) == dim)).select(item, vector)
    return usable.mapInArrow(run, "id string, vec binary")


def packed(x: np.ndarray) -> pa.Array:
    """Rows of float32 as a binary column."""
    width = x.shape[1] * 4 if x.ndim == 2 else 4
    offsets = pa.py_buffer(np.arange(len(x) + 1, dtype=np.int32) * width)
    return pa.Array.from_buffers(pa.binary(), len(x), [None, offsets, pa.py_buffer(np.ascontiguousarray(x))])


def unpacked(column: pa.Array | pa.ChunkedArray) -> np.ndarray:
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks() if column.num_chunks != 1 else column.chunk(0)
    if isinstance(column, pa.ChunkedArray):
        return np.concatenate([unpacked(c) for c in column.chunks]) if column.num_chunks else np.zeros((0, 1), np.float32)
    n = len(column)
    if not n:
        return np.zeros((0, 1), np.float32)
    offsets = np.frombuffer(column.buffers()[1], np.int32, n + 1, column.offset * 4)
    return np.frombuffer(column.buffers()[2], np.float32, (offsets[-1] - offsets[0]) // 4, offsets[0]).reshape(n, -1)


def as_floats(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(id, vec binary) with vec as a list of floats, for mapInArrow."""
    for b in batches:
        if b.num_rows:
            x = unpacked(b.column(1))
            yield pa.RecordBatch.from_arrays([b.column(0), pa.ListArray.from_arrays(pa.array(np.arange(len(x) + 1, dtype=np.int32) * x.shape[1]), pa.array(x.ravel()))], names=["id", "vec"])


def distinct_vectors(units: DataFrame) -> DataFrame:
    """(id, vec, copies): each different vector once, under its smallest id, with the number of rows that hold it."""
    return units.groupBy("vec").agg(F.min("id").alias("id"), F.count("*").alias("copies"))


def learn(vectors: DataFrame, rows: int, fit_rows: int = FIT_ROWS, rows_per_part: int = ROWS_PER_PART) -> Router:
    """The router for `rows` vectors, fitted on the fit_rows with the smallest hash.

    If those cannot teach rows / rows_per_part parts, each part is cut by its own router into as many as its rows want, at most fit_rows / ROWS_TO_LEARN, fitted on the executors
    on a sample by hash of about ROWS_TO_LEARN rows a leaf. What reaches the driver and is broadcast is (dim + 1) numbers a leaf.
    """
    sample = vectors.select("vec", F.xxhash64("vec").alias("h")).orderBy("h").limit(fit_rows).select("vec").toArrow()
    x = unpacked(sample.column("vec"))
    teach = max(1, len(x) // ROWS_TO_LEARN)
    wanted = max(1, rows // rows_per_part)
    top = fit_router(x, int(min(wanted, teach)))
    if wanted <= teach:
        return top
    at = routed(vectors.select("vec"), top, 1).select("vec", F.col("parts")[0].alias("part"))
    sizes = at.groupBy("part").agg(F.count("*").alias("n")).select("part", F.least(F.ceil(F.col("n") / rows_per_part), F.lit(teach)).cast("int").alias("leaves"), "n")  # a row a part
    share = F.col("leaves") * ROWS_TO_LEARN / F.col("n")
    drawn = at.join(F.broadcast(sizes), "part").filter((F.col("leaves") > 1) & (F.pmod(F.xxhash64("vec", F.lit(7)), F.lit(1_000_000)) < share * 1_000_000)).select("part", "leaves", "vec")

    def fit(t: pa.Table) -> pa.Table:
        r = fit_router(unpacked(t.column("vec")), t.column("leaves")[0].as_py())
        return pa.table({"part": t.column("part")[:1], "leaves": pa.array([len(r.bias)], pa.int32()), "weights": pa.array([r.weights.tobytes()], pa.binary()), "bias": pa.array([r.bias.tobytes()], pa.binary())})

    children: list = [None] * len(top.bias)
    for r in drawn.groupBy("part").applyInArrow(fit, "part int, leaves int, weights binary, bias binary").collect():
        if r["leaves"] > 1:
            children[r["part"]] = np.frombuffer(r["weights"], np.float32).reshape(-1, r["leaves"]), np.frombuffer(r["bias"], np.float32)
    return Router(top.weights, top.bias, tuple(children))


def routed(vectors: DataFrame, router: Router, probes: int) -> DataFrame:
    """vectors with `parts`, their likeliest parts, best first; the first is where they are stored."""
    from pyspark.sql.types import ArrayType, IntegerType, StructField, StructType

    names = vectors.columns
    shared = vectors.sparkSession.sparkContext.broadcast(router)  # dim + 1 numbers a leaf, at most (FIT_ROWS / ROWS_TO_LEARN) squared leaves

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            if b.num_rows:
                top = shared.value.likeliest(unpacked(b.column(names.index("vec"))), probes).astype(np.int32)
                lists = pa.ListArray.from_arrays(pa.array(np.arange(len(top) + 1, dtype=np.int32) * top.shape[1]), pa.array(top.ravel()))
                yield pa.RecordBatch.from_arrays([*b.columns, lists], names=[*names, "parts"])

    return vectors.mapInArrow(run, StructType([*vectors.schema.fields, StructField("parts", ArrayType(IntegerType()))]))


def _search_blocks(stored: DataFrame, sought: DataFrame, run, schema: str, block: int) -> DataFrame:
    """Applies run to every (stored block, sought block) of a part. stored and sought: (part, id, vec).

    Parts of more than `block` stored rows are cut into blocks, and so are the sought rows; each row is copied to the blocks of the
    other side, so every pair meets exactly once and no task holds more than a block of each.
    """
    sizes = stored.groupBy("part").agg(F.count("*").alias("ns")).join(sought.groupBy("part").agg(F.count("*").alias("nq")), "part")
    cuts = sizes.select("part", F.ceil(F.col("ns") / block).cast("int").alias("bs"), F.ceil(F.col("nq") / (4 * block)).cast("int").alias("bq"))  # a row a part

    def spread(rows: DataFrame, own: str, other: str, side: int) -> DataFrame:
        mine = F.pmod(F.xxhash64("id"), F.col(own)).cast("int")
        both = F.explode(F.sequence(F.lit(0), F.col(other) - 1)).alias("_o")
        r = rows.join(cuts, "part").select("part", "id", "vec", mine.alias("_m"), both)
        s, q = ("_m", "_o") if side == 0 else ("_o", "_m")
        return r.select("part", F.col(s).alias("sb"), F.col(q).alias("qb"), F.lit(side).alias("side"), "id", "vec")

    both = spread(stored, "bs", "bq", 0).unionByName(spread(sought, "bq", "bs", 1))
    return both.groupBy("part", "sb", "qb").applyInArrow(run, schema)


def similar_pairs(vectors: DataFrame, least: float = 0.92, probes: int = 3, fit_rows: int = FIT_ROWS, rows_per_part: int = ROWS_PER_PART, block: int = BLOCK) -> DataFrame:
    """(id_a, id_b, cosine) of the pairs of different vectors with a cosine of at least `least`, id_a < id_b.

    vectors: (id, vec) as distinct_vectors gives. A pair is found where one of the two probes the part that stores the other.
    """
    vectors = through_table(vectors.select("id", "vec"), "vectors")
    router = learn(vectors, vectors.count(), fit_rows, rows_per_part)
    placed = routed(vectors, router, probes)
    # one row a (vector, probe); the first probe is also the place it is stored
    rows = through_table(placed.select("id", "vec", F.posexplode("parts").alias("rank", "part")), "probes")
    ns = rows.groupBy("part").agg(F.count_if(F.col("rank") == 0).alias("ns"), F.count("*").alias("nq"))
    cuts = ns.filter("ns > 0").select("part", F.ceil(F.col("ns") / block).cast("int").alias("bs"), F.ceil(F.col("nq") / (4 * block)).cast("int").alias("bq"))
    r = rows.join(cuts, "part")  # a row a part, a leaf of the router
    own_s, own_q = F.pmod(F.xxhash64("id"), F.col("bs")).cast("int"), F.pmod(F.xxhash64("id", F.lit(1)), F.col("bq")).cast("int")
    # a stored row goes to all sought blocks of its stored block, a sought row to all stored blocks of its sought block
    as_stored = F.when(F.col("rank") == 0, F.transform(F.sequence(F.lit(0), F.col("bq") - 1), lambda q: F.struct(own_s.alias("sb"), q.alias("qb"), F.lit(0).alias("side"))))
    as_sought = F.transform(F.sequence(F.lit(0), F.col("bs") - 1), lambda s: F.struct(s.alias("sb"), own_q.alias("qb"), F.lit(1).alias("side")))
    # where the part is one block, a stored row is sought in the same group: one copy (side 2) serves both
    single = F.array(F.struct(F.lit(0).alias("sb"), F.lit(0).alias("qb"), F.when(F.col("rank") == 0, 2).otherwise(1).alias("side")))
    cells = F.when((F.col("bs") == 1) & (F.col("bq") == 1), single).when(F.col("rank") == 0, F.concat(as_stored, as_sought)).otherwise(as_sought)
    cells = r.select("part", "id", "vec", F.explode(cells).alias("c")).select("part", "c.sb", "c.qb", "c.side", "id", "vec")

    def run(t: pa.Table) -> pa.Table:
        side, x = t.column("side").to_numpy(), unpacked(t.column("vec"))
        ids = np.array(t.column("id").to_pylist(), dtype=object)
        s, q = np.flatnonzero(side != 1), np.flatnonzero(side != 0)
        a, b, c = [], [], []
        if len(s) and len(q):
            xs, ids_s = np.ascontiguousarray(x[s]), ids[s]
            for at in range(0, len(q), 1024):
                i = q[at : at + 1024]
                m = x[i] @ xs.T
                hit, to = np.nonzero(m >= least - 1e-4)
                if len(hit):
                    exact = np.einsum("ij,ij->i", x[i[hit]].astype(np.float64), xs[to].astype(np.float64))
                    for u, v, w in zip(ids[i[hit]], ids_s[to], exact):
                        if w >= least and u != v:
                            a.append(min(u, v)), b.append(max(u, v)), c.append(float(w))
        return pa.table({"id_a": pa.array(a, pa.string()), "id_b": pa.array(b, pa.string()), "cosine": pa.array(c, pa.float64())})

    found = cells.groupBy("part", "sb", "qb").applyInArrow(run, "id_a string, id_b string, cosine double")
    return found.groupBy("id_a", "id_b").agg(F.max("cosine").alias("cosine"))


def copy_links(units: DataFrame) -> DataFrame:
    """(id_a, id_b) linking every id to the smallest id that holds the same vector; no other pairs of a group of copies."""
    one = units.select("id", F.xxhash64("vec").alias("h"), "vec")
    repeated = one.groupBy("vec").agg(F.min("id").alias("id_a"), F.max("id").alias("last"), F.first("h").alias("h")).filter("id_a <> last")
    return one.join(repeated.select("h", F.col("vec").alias("v"), "id_a"), "h").filter("vec = v and id <> id_a").select("id_a", F.col("id").alias("id_b")).distinct()


def nearest(vectors: DataFrame, sought: DataFrame, k: int = 10, probes: int = 24, fit_rows: int = FIT_ROWS, rows_per_part: int = ROWS_PER_PART, block: int = BLOCK) -> DataFrame:
    """(id, neighbour, cosine, rank) of the k most similar other vectors of each sought one, over the probed parts.

    vectors and sought: (id, vec). Ties go to the smaller id. Fewer than k rows where the probed parts hold fewer.
    """
    vectors = through_table(vectors.select("id", "vec"), "vectors")
    router = learn(vectors, vectors.count(), fit_rows, rows_per_part)
    stored = through_table(routed(vectors, router, 1).select("id", "vec", F.col("parts")[0].alias("part")), "stored")
    asked = through_table(routed(sought.select("id", "vec"), router, probes).select("id", "vec", F.explode("parts").alias("part")), "asked")

    def run(t: pa.Table) -> pa.Table:
        side, x = t.column("side").to_numpy(), unpacked(t.column("vec"))
        ids = np.array(t.column("id").to_pylist(), dtype=object)
        s, q = np.flatnonzero(side == 0), np.flatnonzero(side == 1)
        a, b, c = [], [], []
        if len(s) and len(q):
            s = s[np.argsort(ids[s], kind="stable")]
            xs = x[s].astype(np.float64)
            for at in range(0, len(q), 256):
                i = q[at : at + 256]
                m = x[i].astype(np.float64) @ xs.T
                n = min(k + 1, len(s))
                top = np.argsort(-m, axis=1, kind="stable")[:, :n]
                a += np.repeat(ids[i], n).tolist()
                b += ids[s[top.ravel()]].tolist()
                c += np.take_along_axis(m, top, 1).ravel().tolist()
        keep = [u != v for u, v in zip(a, b)]
        return pa.table({"id": pa.array(a, pa.string()), "neighbour": pa.array(b, pa.string()), "cosine": pa.array(c, pa.float64())}).filter(pa.array(keep, pa.bool_()))

    near = _search_blocks(stored, asked, run, "id string, neighbour string, cosine double", block)
    from pyspark.sql import Window

    w = Window.partitionBy("id").orderBy(F.desc("cosine"), "neighbour")
    return near.groupBy("id", "neighbour").agg(F.max("cosine").alias("cosine")).withColumn("rank", F.row_number().over(w)).filter(F.col("rank") <= k)


def with_copies(near: DataFrame, units: DataFrame, sought: DataFrame, k: int = 10) -> DataFrame:
    """What nearest() found among distinct vectors, with all ids that hold them: the k most similar other ids, the sought one's own copies too.

    Of a group of copies the k + 1 smallest ids suffice, as ties go to the smaller id; so a row becomes k + 1 at most.
    """
    from pyspark.sql import Window

    links = copy_links(units).withColumn("n", F.row_number().over(Window.partitionBy("id_a").orderBy("id_b"))).filter(F.col("n") <= k)
    own = sought.select("id", F.col("id").alias("neighbour"), F.lit(1.0).alias("cosine"))
    heads = cut(near.select("id", "neighbour", "cosine").unionByName(own))
    copies = heads.join(links.withColumnRenamed("id_a", "neighbour"), "neighbour").select("id", F.col("id_b").alias("neighbour"), "cosine")
    every = heads.unionByName(copies).filter("id <> neighbour").groupBy("id", "neighbour").agg(F.max("cosine").alias("cosine"))
    return every.withColumn("rank", F.row_number().over(Window.partitionBy("id").orderBy(F.desc("cosine"), "neighbour"))).filter(F.col("rank") <= k)
