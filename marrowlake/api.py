"""One object for what a program asks of a stored pack (R16-R18): search, related, documents, statistics, the graph, memories."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from marrowlake.functions.identity import memory_id
from marrowlake.functions.weights import Weights
from marrowlake.operators import graph, memory
from marrowlake.operators import pack as packs
from marrowlake.operators.usage import merged
from marrowlake.plans import retrieve
from marrowlake.plans.profiles import SURFACES, TIERS, overridden


@dataclass
class Engine:
    """A pack by its path, and the documents and memories that belong to it. Every answer is a DataFrame."""

    spark: SparkSession
    path: str
    weights: Weights = Weights()

    @property
    def pack(self) -> packs.Pack:
        """The newest version at the time of the call."""
        return packs.open_pack(self.spark, self.path)

    def index(self, documents: DataFrame, chunks: DataFrame, **options) -> packs.Pack:
        return packs.publish(self.spark, self.path, documents, chunks, **options)

    def search(self, queries: DataFrame, surface: str = "mcp", now: int = 0, least: float | None = None, usage: DataFrame | None = None, **changes) -> DataFrame:
        """The hits of queries (query_id, text, vec) by the surface's tier and gate; changes override single knobs of the tier."""
        tier, gate, _ = SURFACES[surface]
        return retrieve.search(queries, self.pack, overridden(TIERS[tier], changes), gate if least is None else least, now, self.weights, usage)

    def explain(self, queries: DataFrame, surface: str = "mcp", now: int = 0, **changes) -> tuple[DataFrame, DataFrame]:
        tier, gate, tokens = SURFACES[surface]
        return retrieve.explained(queries, self.pack, overridden(TIERS[tier], changes), gate, tokens, now, self.weights)

    def related(self, ids: DataFrame) -> DataFrame:
        """What lies beside and behind documents (id)."""
        p = self.pack
        return graph.related(ids.select("id"), p.chunks, p.edges)

    def document(self, id_: str) -> DataFrame:
        p = self.pack
        ids = p.chunks.filter(F.col("doc") == id_).agg(F.count("*").alias("chunks"), F.transform(F.array_sort(F.collect_list(F.struct("ord", "id"))), lambda x: x["id"]).alias("chunk_ids"))
        return p.documents.filter(F.col("id") == id_).crossJoin(ids)  # one row each

    def stats(self) -> DataFrame:
        """One row: documents, chunks, vectors, the version and its model; all but the first from the manifest."""
        p = self.pack
        m = p.manifest
        return p.documents.agg(F.count("*").alias("documents"), F.lit(m["rows"]).alias("chunks"), F.lit(m["rows_with_vectors"]).alias("vectors"), F.lit(m["version"]).alias("version"), F.lit(m["model_id"]).alias("model"))

    def graph(self) -> tuple[DataFrame, DataFrame]:
        p = self.pack
        return p.documents.select("id", "title", "source_type", "inbound", "lifecycle"), p.edges

    def remember(self, stored: DataFrame, incoming: DataFrame, near: DataFrame) -> DataFrame:
        return memory.remembered(incoming, stored, near)

    def forget(self, stored: DataFrame, prefixes: DataFrame) -> tuple[DataFrame, DataFrame]:
        return memory.forgotten(stored, prefixes)

    def memories(self, stored: DataFrame, **filters) -> DataFrame:
        return memory.listed(stored.withColumn("id", memory_id(F.col("kind"), F.col("text"))) if "id" not in stored.columns else stored, **filters)

    def note_usage(self, state: DataFrame, fresh: DataFrame) -> DataFrame:
        return merged(state, fresh)
