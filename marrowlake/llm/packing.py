"""Items packed into containers of a fixed capacity (p8)."""

from __future__ import annotations

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from marrowlake.runtime import cut

LENGTHS = (512, 1024, 2048, 4096)
#: What a container costs besides its length, in tokens.
OVERHEAD = 16
#: Items that one task packs; each such shard leaves at most a few half-empty containers.
ITEMS_PER_SHARD = 50_000


def best_fit(sizes: list[int], lengths: tuple[int, ...] = LENGTHS, overhead: int = OVERHEAD) -> tuple[list[int], list[int]]:
    """(bin of each item, final length of each bin) by variable-capacity best fit over descending sizes.

    An item goes to the open bin whose room it leaves smallest. If none has room, a bin is opened with the length of least cost a
    token, (length + overhead) / what it can be expected to hold: the item and as much of the rest as fits. In
    the end every bin shrinks to the shortest length that holds its contents. sizes must be 1 .. max(lengths).
    """
    lengths = tuple(sorted(lengths))
    order = sorted(range(len(sizes)), key=lambda i: -sizes[i])
    rooms: list[list[int]] = [[] for _ in range(lengths[-1] + 1)]
    some = 0  # bit r is set where rooms[r] isn't empty
    where, full = [0] * len(sizes), []
    rest = sum(sizes)
    for i in order:
        s = sizes[i]
        rest -= s
        if fits := some >> s:
            r = s + (fits & -fits).bit_length() - 1
            b = rooms[r].pop()
            if not rooms[r]:
                some ^= 1 << r
            r -= s
        else:
            c = min((c for c in lengths if c >= s), key=lambda c: ((c + overhead) / (s + min(c - s, rest)), c))
            b, r = len(full), c - s
            full.append(0)
        full[b] += s
        where[i] = b
        rooms[r].append(b)
        some |= 1 << r
    return where, [next(c for c in lengths if c >= f) for f in full]


def pieces(sized: DataFrame, item: str = "doc_id", tokens: str = "tokens", capacity: int = 4096) -> DataFrame:
    """(item, piece, start, tokens): an item larger than capacity is cut into full pieces and a rest, others stay whole.

    Null and empty items have no piece.
    """
    n = F.col(tokens)
    one = sized.filter(n > 0).select(item, n.alias("_n"), F.explode(F.sequence(F.lit(0), F.floor((n - 1) / capacity).cast("int"))).alias("_k"))
    return one.select(item, (F.col("_k") + 1).alias("piece"), (F.col("_k").cast("long") * capacity).alias("start"), F.least(F.lit(capacity), F.col("_n") - F.col("_k") * capacity).cast("int").alias("tokens"))


def pack(sized: DataFrame, item: str = "doc_id", tokens: str = "tokens", lengths: tuple[int, ...] = LENGTHS, overhead: int = OVERHEAD, items_per_shard: int = ITEMS_PER_SHARD) -> DataFrame:
    """(container, length, item, piece, start, tokens) of every piece.

    Pieces are spread over shards of about items_per_shard by a hash of item and piece, whatever their source or size, and each
    shard is packed by best_fit in one task that holds only numbers. item must be unique; equal sizes are packed in order of item. Nothing is
    dropped. An empty table gives no rows.
    """
    cap = max(lengths)
    sized = cut(sized.select(item, tokens))  # sizes are costly to make and are read twice
    parts = pieces(sized, item, tokens, cap)
    shards = max(1, -(-parts.count() // items_per_shard))
    kind = dict(parts.dtypes)[item]

    def run(key: tuple, t: pa.Table) -> pa.Table:
        t = t.sort_by([(item, "ascending"), ("piece", "ascending")])
        where, length = best_fit(t.column("tokens").to_pylist(), lengths, overhead)
        shard = key[0].as_py()
        return pa.table({"container": pa.array([f"{shard}-{b}" for b in where]), "length": pa.array([length[b] for b in where], pa.int32()), **{c: t.column(c) for c in (item, "piece", "start", "tokens")}})

    sharded = parts.withColumn("shard", F.pmod(F.xxhash64(item, "piece"), F.lit(shards)).cast("int"))
    return sharded.groupBy("shard").applyInArrow(run, f"container string, length int, {item} {kind}, piece int, start long, tokens int")


def packing_report(packed: DataFrame) -> DataFrame:
    """(length, containers, tokens, fill) by final length."""
    each = packed.groupBy("container", "length").agg(F.sum("tokens").alias("t"))
    return each.groupBy("length").agg(F.count("*").alias("containers"), F.sum("t").alias("tokens")).withColumn("fill", F.col("tokens") / (F.col("containers") * F.col("length")))
