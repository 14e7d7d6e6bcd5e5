"""Sources mixed to target weights (p9)."""

from __future__ import annotations

import math
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from marrowlake.runtime import cut

SEED = 17


def source_key(c: Column) -> Column:
    return F.lower(F.regexp_replace(c, r"^\s+|\s+$", ""))


def poisson_cdf(mean: float, most: int) -> list[float]:
    """P(X <= k) for k = 0 .. most - 1; a draw is the number of entries below a uniform number, so at most `most`."""
    if math.isinf(mean):
        return [0.0] * most
    out, term, total = [], math.exp(-mean), 0.0
    for k in range(most):
        total += term
        out.append(min(1.0, total))
        term *= mean / (k + 1)
    return out


def capped_mean(mean: float, most: int) -> float:
    return sum(1 - c for c in poisson_cdf(mean, most))


def poisson_for(rate: float, most: int) -> float:
    """The Poisson mean whose draws, capped at most, have the mean rate; infinite where rate reaches the cap."""
    if rate <= 0 or most <= 0:
        return 0.0
    if rate >= most:
        return math.inf
    low, high = rate, max(1.0, rate)
    while capped_mean(high, most) < rate and high < 700:
        high *= 2
    for _ in range(80):
        mid = (low + high) / 2
        low, high = (mid, high) if capped_mean(mid, most) < rate else (low, mid)
    return low


def mixing_plan(sized: DataFrame, targets: DataFrame, source: str = "source", tokens: str = "tokens") -> DataFrame:
    """One row a target: its size, the repetition rate it needs, what it can reach, and the draw's distribution.

    Names compare without case and outer blanks; sized rows without a target are drawn never, but count in the total. If targets
    name a source more than once, shares add up and the largest cap holds.
    """
    size = sized.groupBy(source_key(F.col(source)).alias("k")).agg(F.sum(tokens).alias("size"))
    total = size.agg(F.coalesce(F.sum("size"), F.lit(0)).cast("double").alias("total"))
    want = targets.groupBy(source_key(F.col("source")).alias("k")).agg(F.min("source").alias("source"), F.sum("target_share").alias("target_share"), F.max("max_repeats").alias("max_repeats"))
    rows = want.join(size, "k", "left").crossJoin(total).withColumn("size", F.coalesce("size", F.lit(0)).cast("double"))  # total is one row
    need = F.col("target_share") * F.col("total")
    rows = rows.withColumn("reachable", ~(need > F.col("max_repeats") * F.col("size")))
    rows = rows.withColumn("rate", F.when(F.col("size") > 0, F.least(need / F.col("size"), F.col("max_repeats").cast("double"))).otherwise(F.lit(0.0)))

    def draws(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            b["cdf"] = [poisson_cdf(poisson_for(r, int(m)), int(m)) for r, m in zip(b["rate"], b["max_repeats"].fillna(0))]
            yield b

    from pyspark.sql.types import ArrayType, DoubleType, StructField, StructType

    return rows.mapInPandas(draws, StructType([*rows.schema.fields, StructField("cdf", ArrayType(DoubleType()))]))


def draw_mix(sized: DataFrame, plan: DataFrame, item: str = "doc_id", source: str = "source", tokens: str = "tokens", seed: int = SEED) -> DataFrame:
    """(item, source, copy, tokens, place): every item as often as drawn, in a global shuffle by place.

    The count is the inverse of the capped Poisson distribution at a uniform number hashed from item and seed, so a rerun or a
    lost executor draws the same. Items without a target and null or empty items are left out. place orders the mix over all partitions.
    """
    u = (F.shiftrightunsigned(F.xxhash64(F.lit(seed), item), 11) + 0.5) / float(1 << 53)
    d = sized.filter(F.col(tokens) > 0).select(item, source_key(F.col(source)).alias("k"), F.col(tokens).alias("tokens"), u.alias("u"))
    d = d.join(plan.select("k", F.col("source"), "cdf"), "k")
    n = F.size(F.filter("cdf", lambda c: c < F.col("u")))
    out = d.withColumn("n", n).filter("n > 0").select(item, "source", F.explode(F.sequence(F.lit(1), F.col("n"))).alias("copy"), "tokens")
    return out.withColumn("place", F.xxhash64(F.lit(seed + 1), item, "copy"))


def shuffled(mix: DataFrame) -> DataFrame:
    """The mix in order of place: range partitions, each sorted."""
    return mix.repartitionByRange("place").sortWithinPartitions("place")


def mixing_report(mix: DataFrame, plan: DataFrame) -> DataFrame:
    """Per target: shares wanted, to be expected under the caps and reached, size, tokens drawn, highest copy, and whether the cap lets it reach its share.

    What capped sources cannot give is not drawn from others, so the mix is smaller by it and the expected shares of the others exceed their targets in proportion.
    """
    got = mix.groupBy("source").agg(F.sum("tokens").alias("drawn"), F.max("copy").alias("most_copies"))
    all_drawn = got.agg(F.sum("drawn").alias("all_drawn"))
    expected = plan.agg(F.sum(F.col("rate") * F.col("size")).alias("all_expected"))
    rows = plan.drop("cdf").crossJoin(expected).join(got, "source", "left").crossJoin(all_drawn)  # one row
    return rows.select(
        "source", "target_share", "max_repeats", F.col("size").cast("long").alias("size"), "rate", "reachable",
        F.coalesce("drawn", F.lit(0)).alias("drawn"), F.coalesce("most_copies", F.lit(0)).alias("most_copies"), (F.coalesce("drawn", F.lit(0)) / F.col("all_drawn")).alias("share"),
        (F.col("rate") * F.col("size") / F.col("all_expected")).alias("expected_share"),
    )


def mix(sized: DataFrame, targets: DataFrame, **names: str) -> tuple[DataFrame, DataFrame]:
    """(drawn items, report)."""
    sized = cut(sized)
    plan = mixing_plan(sized, targets, **{k: v for k, v in names.items() if k in ("source", "tokens")})
    plan = cut(plan)
    drawn = draw_mix(sized, plan, **names)
    return drawn, mixing_report(drawn, plan)
