"""Vector and ranking scalars (M1-M18) as column expressions."""

from __future__ import annotations

from dataclasses import dataclass, field

from pyspark.sql import Column
from pyspark.sql import functions as F


def dot(a: Column, b: Column) -> Column:
    """Inner product in double precision."""
    return F.aggregate(F.zip_with(a, b, lambda x, y: x.cast("double") * y.cast("double")), F.lit(0.0), lambda s, x: s + x)


def norm(v: Column) -> Column:
    return F.sqrt(F.aggregate(v, F.lit(0.0), lambda s, x: s + x.cast("double") * x.cast("double")))


def l2_normalised(v: Column) -> Column:
    """M1: a zero vector stays as it is."""
    n = norm(v)
    return F.when(n > 0, F.transform(v, lambda x: x.cast("double") / n)).otherwise(F.transform(v, lambda x: x.cast("double")))


def fitted(v: Column, dims: int) -> Column:
    """M2: cut or padded with zeros to dims, then M1."""
    return l2_normalised(F.slice(F.concat(F.transform(v, lambda x: x.cast("double")), F.array_repeat(F.lit(0.0), dims)), 1, dims))


def usable_vector(v: Column, dims: int) -> Column:
    """M3: dims finite numbers that are not all zero."""
    return F.coalesce((F.size(v) == dims) & F.forall(v, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf"))) & F.exists(v, lambda x: x != 0), F.lit(False))


def relevance(cosine: Column) -> Column:
    """M4: the cosine on the scale 0 .. 1 that every gate uses."""
    return F.least(F.greatest((1 + cosine) / 2, F.lit(0.0)), F.lit(1.0))


@dataclass(frozen=True)
class Weights:
    """Multipliers of relevance."""

    by_source: dict[str, float] = field(default_factory=lambda: {"markdown": 1.0, "pdf": 1.0, "web": 1.0, "memory": 1.0, "transcript": 0.45})
    authority: float = 0.0
    superseded: float = 0.88
    decay: bool = False
    half_life_days: float = 100.0
    grace_days: float = 90.0
    floor: float = 0.1
    episode_half_life_days: float = 30.0
    episode_floor: float = 0.85


def source_weight(source_type: Column, w: Weights = Weights()) -> Column:
    """M5: unknown sources weigh like markdown."""
    out = F.lit(w.by_source["markdown"])
    for s, x in w.by_source.items():
        out = F.when(source_type == s, x).otherwise(out)
    return out


def authority_lift(inbound: Column, max_inbound: Column, authority: float) -> Column:
    """M6."""
    return F.when(F.lit(authority > 0) & (F.coalesce(max_inbound, F.lit(0)) > 0), 1 + authority * F.coalesce(inbound, F.lit(0)) / max_inbound).otherwise(F.lit(1.0))


# fixed values: the stages of a document's life
CURRENT, INVESTIGATING, PROPOSED, SUPERSEDED = 0, 1, 2, 3


def lifecycle(status: Column, inbound: Column | None = None) -> Column:
    """No status means current; one that is unknown means proposed; a proposal that notes link to is being investigated."""
    s = F.lower(F.trim(status))
    out = F.when(s.isNull() | (s == "") | s.isin("accepted", "active"), CURRENT).when(s == "investigating", INVESTIGATING).when(s == "superseded", SUPERSEDED).otherwise(PROPOSED)
    return out if inbound is None else F.when((out == PROPOSED) & (F.coalesce(inbound, F.lit(0)) > 0), INVESTIGATING).otherwise(out)


def lifecycle_of_byte(b: Column) -> Column:
    """Unknown bytes mean current."""
    return F.when(b.between(0, 3), b.cast("int")).otherwise(CURRENT)


def lifecycle_weight(stage: Column, w: Weights = Weights()) -> Column:
    """M7."""
    return F.when(stage == SUPERSEDED, w.superseded).otherwise(1.0)


def decay_weight(source_type: Column, last_used: Column, now: int, w: Weights = Weights()) -> Column:
    """M8: transcripts fade once they were not used for the days of grace; never used ones keep their weight."""
    age = (now - last_used) / 86400.0
    faded = F.greatest(F.lit(w.floor), F.pow(F.lit(0.5), (age - w.grace_days) / w.half_life_days))
    return F.when(F.lit(w.decay) & (source_type == "transcript") & last_used.isNotNull() & (age > w.grace_days), faded).otherwise(1.0)


def episode_decay(created: Column, now: int, w: Weights = Weights()) -> Column:
    """M9: from 1 down to the floor with the age of an episode."""
    age = F.greatest((now - created) / 86400.0, F.lit(0.0))
    return w.episode_floor + (1 - w.episode_floor) * F.pow(F.lit(0.5), age / w.episode_half_life_days)


def rank_weight(now: int, w: Weights = Weights(), max_inbound: Column | None = None) -> Column:
    """The product of all weights of a row with source_type, inbound, lifecycle, last_used, kind and created."""
    out = source_weight(F.col("source_type"), w) * lifecycle_weight(F.col("lifecycle"), w) * decay_weight(F.col("source_type"), F.col("last_used"), now, w)
    out = out * authority_lift(F.col("inbound"), max_inbound if max_inbound is not None else F.lit(0), w.authority)
    return out * F.when(F.col("kind") == "episode", episode_decay(F.col("created"), now, w)).otherwise(1.0)


def mmr_similarity(doc_a: Column, words_a: Column, doc_b: Column, words_b: Column) -> Column:
    """Same document and shared words; 0 for two empty texts of different documents."""
    both = F.size(F.array_union(words_a, words_b))
    jaccard = F.when(both > 0, F.size(F.array_intersect(words_a, words_b)) / both).otherwise(0.0)
    return F.least(F.lit(1.0), 0.6 * (doc_a == doc_b).cast("double") + 0.4 * jaccard)


def civil_date(seconds: Column) -> Column:
    """The UTC date of epoch seconds."""
    return F.date_format(F.timestamp_seconds(seconds), "yyyy-MM-dd")


def nearest_rank(values: Column, q: float) -> Column:
    """Of a sorted array, the element ceil(q n)."""
    n = F.size(values)
    return F.when(n > 0, F.element_at(values, F.greatest(F.lit(1), F.least(n, F.ceil(n * F.lit(q)).cast("int")))))


def floor_rank(values: Column, q: float) -> Column:
    """Of a sorted array, the element at floor((n - 1) q); differs from M17."""
    n = F.size(values)
    return F.when(n > 0, F.element_at(values, (F.floor((n - 1) * F.lit(q)) + 1).cast("int")))
