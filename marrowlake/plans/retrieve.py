"""Hybrid search of a batch of queries (R1-R10): one lazy plan from candidates to admitted entries."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from marrowlake.functions.text import STOP_WORDS, rendered_entry, tokens, without_stop_words
from marrowlake.functions.weights import Weights, rank_weight
from marrowlake.operators import bm25, budget, fusion, graph, knn
from marrowlake.operators.pack import Pack, publish
from marrowlake.plans.profiles import Profile
from marrowlake.runtime import scratch_path

GRAPH_WEIGHT, SEEDS, TAKE = 0.2, 5, 10


def build_pack(documents: DataFrame, chunks: DataFrame, dims: int = 64, stemmed: bool = True) -> Pack:
    """A pack of raw tables in the shared folder, for this session."""
    spark = documents.sparkSession
    return publish(spark, scratch_path(spark, "pack"), documents, chunks, dims=dims, stemmed=stemmed)


def stage_lists(queries: DataFrame, pack: Pack, profile: Profile, exact: bool = False) -> DataFrame:
    """(query_id, stage, weight, chunk_id, position, relevance) of every list that is fused.

    queries: query_id, text, vec (null where a query has no vector: it has no vector list, R10). Vectors are looked for in the cells that the profile's width
    reaches, or in all with exact. Where no tier needs links, neither edges nor places of chunks are read (R9). Only ids and scores move here; texts are joined to the
    few survivors.
    """
    asked = queries.filter("vec is not null").select("query_id", "vec")
    near = knn.knn(asked, pack.vectors, profile.candidates, pack.dims, cells=None if exact else pack.cells, width=profile.efs).select("query_id", F.lit("vector").alias("stage"), F.lit(1.0).alias("weight"), F.col("id").alias("chunk_id"), "position", "relevance")
    near = near.join(queries.select(F.col("query_id").cast("string").alias("_q"), F.col("query_id").alias("_id")), F.col("query_id") == F.col("_q")).withColumn("query_id", F.col("_id")).drop("_q", "_id")
    lists = near
    if profile.bm25:
        words = keyword_hits(queries, pack, profile.candidates)
        lists = lists.unionByName(words.select("query_id", F.lit("keyword").alias("stage"), F.lit(1.0).alias("weight"), F.col("id").alias("chunk_id"), "position", F.lit(None).cast("double").alias("relevance")))
    if profile.hops:
        seeds = near.filter(F.col("position") <= SEEDS).join(pack.chunks.select(F.col("id").alias("chunk_id"), "doc", "ord"), "chunk_id").select("query_id", "chunk_id", "doc", "ord")
        more = graph.expanded(seeds, pack.chunks, pack.edges, profile.hops, profile.neighbours)
        lists = lists.unionByName(more.select("query_id", F.lit("graph").alias("stage"), F.lit(GRAPH_WEIGHT).alias("weight"), "chunk_id", "position", F.lit(None).cast("double").alias("relevance")))
    return lists


def keyword_hits(queries: DataFrame, pack: Pack, k: int, strict: bool = False) -> DataFrame:
    """A2 over a pack: (query_id, id, score, position); row numbers become ids once the k best are known."""
    found = bm25.search(queries.select("query_id", "text"), pack.index, k, strict=strict)
    return found.join(pack.chunks.select("row", "id"), "row").select("query_id", "id", "score", "position")


def fused_pool(queries: DataFrame, pack: Pack, lists: DataFrame) -> DataFrame:
    """The fused rows with a measured relevance (R5): what no list measured is measured, what cannot be stays 0."""
    pool = fusion.rrf(lists)
    todo = pool.filter("relevance <= 0").select("query_id", F.col("chunk_id").alias("id"))
    got = knn.measured(todo, queries.filter("vec is not null"), pack.vectors).select("query_id", F.col("id").alias("chunk_id"), F.col("relevance").alias("_m"))
    return pool.join(got, ["query_id", "chunk_id"], "left").withColumn("relevance", F.when(F.col("relevance") > 0, F.col("relevance")).otherwise(F.coalesce("_m", F.lit(0.0)))).drop("_m")


def hydrated(pool: DataFrame, pack: Pack, usage: DataFrame | None = None) -> DataFrame:
    """pool with the columns of chunk and document (J1-J3): only survivors are joined to texts."""
    c = pack.chunks.select(F.col("id").alias("chunk_id"), "doc", "ord", "text", "heading_path", "page_no")
    out = pool.join(c, "chunk_id").join(pack.documents.withColumnRenamed("id", "doc"), "doc").withColumnRenamed("doc", "doc_id")
    if usage is not None:  # fresher than what the pack was published with
        out = out.drop("last_used").join(usage.select("doc_id", "last_used"), "doc_id", "left")
    kind = F.when(F.col("source_type") == "memory", F.split_part(F.regexp_replace("uri", "^memory://", ""), F.lit("/"), F.lit(1)))
    return out.withColumn("kind", kind).withColumn("created", F.lit(None).cast("long"))


def search(
    queries: DataFrame, pack: Pack, profile: Profile, least: float = 0.0, now: int = 0, weights: Weights = Weights(), usage: DataFrame | None = None, reranker: Callable[[DataFrame], DataFrame] | None = None, exact: bool = False
) -> DataFrame:
    """The at most TAKE best hits of each query in order of position.

    Candidates are fused by reciprocal rank, which decides who is in the pool; order is by weighted relevance. The gate comes before
    diversifying, which is skipped where the profile gives it no weight. reranker maps the gated rows to rows with a new position, see reranked.
    """
    kept = _gated(queries, pack, profile, stage_lists(queries, pack, profile, exact), least, now, weights, usage)
    return _chosen(reranker(kept) if reranker is not None else kept, profile)


def _gated(queries: DataFrame, pack: Pack, profile: Profile, lists: DataFrame, least: float, now: int, weights: Weights, usage: DataFrame | None) -> DataFrame:
    pool = hydrated(fused_pool(queries, pack, lists), pack, usage)
    return fusion.weight_and_gate(pool, rank_weight(now, weights, F.lit(pack.max_inbound)), least)


def _chosen(kept: DataFrame, profile: Profile) -> DataFrame:
    chosen = kept.filter(F.col("position") <= TAKE) if profile.mmr >= 1.0 else fusion.mmr(kept, profile.mmr, TAKE)
    return chosen.select("query_id", "position", "chunk_id", "doc_id", "uri", "title", "source_type", "heading_path", "page_no", "text", "score", "relevance", "inbound", "lifecycle")


def reranked(pool: DataFrame, scorer: Callable[[DataFrame], DataFrame], top_n: int) -> DataFrame:
    """The first top_n rows of each query in order of a scorer's value, if it has one for each of them; else the order stays (all or nothing).

    scorer gives (query_id, chunk_id, value) for (query_id, chunk_id, text, position); a value that is null or missing counts as none. Equal values keep their order, rows
    behind top_n follow as they are; only score (the value) and position change. A query's pool is bounded by its profile.
    """
    first = pool.filter(F.col("position") <= top_n)
    given = scorer(first.select("query_id", "chunk_id", "text", "position")).groupBy("query_id", "chunk_id").agg(F.max("value").alias("_v"))
    whole = first.select("query_id", "chunk_id").join(given, ["query_id", "chunk_id"], "left").groupBy("query_id").agg((F.count("*") == F.count("_v")).alias("_all"))
    out = pool.join(given, ["query_id", "chunk_id"], "left").join(whole, "query_id", "left")
    used = F.coalesce(F.col("_all"), F.lit(False)) & (F.col("position") <= top_n)
    out = out.withColumn("score", F.when(used, F.col("_v").cast("double")).otherwise(F.col("score")))
    w = Window.partitionBy("query_id").orderBy(F.when(F.col("position") <= top_n, 0).otherwise(1), F.when(used, F.col("_v")).desc_nulls_last(), "position")
    return out.withColumn("position", F.row_number().over(w)).drop("_v", "_all")


def overlap_scorer(queries: DataFrame, stop: tuple[str, ...] = STOP_WORDS) -> Callable[[DataFrame], DataFrame]:
    """A deterministic scorer for reranked: the share of the query's distinct terms that a text holds; none for a query without terms or a null text."""
    asked = queries.select("query_id", F.array_distinct(without_stop_words(tokens(F.col("text")), stop)).alias("_q"))

    def score(rows: DataFrame) -> DataFrame:
        both = rows.join(asked, "query_id", "left").withColumn("_t", tokens(F.col("text")))
        return both.select("query_id", "chunk_id", F.when(F.size("_q") > 0, F.size(F.array_intersect("_q", "_t")) / F.size("_q")).alias("value"))

    return score


def explained(queries: DataFrame, pack: Pack, profile: Profile, threshold: float, max_tokens: int, now: int = 0, weights: Weights = Weights(), usage: DataFrame | None = None, exact: bool = False) -> tuple[DataFrame, DataFrame]:
    """(hits, report): the hits above the threshold, with whether the budget takes them (injected), and a row a query of what each stage did.

    report: query_id, vector, keyword, graph (rows of each list), fused, gated, returned, injected, and injected_ids in order. A query without hits has zeros.
    """
    lists = stage_lists(queries, pack, profile, exact)
    kept = _gated(queries, pack, profile, lists, threshold, now, weights, usage)
    hits = _chosen(kept, profile)
    taken = injected(hits, max_tokens).select("query_id", "chunk_id", "position")
    per_stage = lists.groupBy("query_id").agg(*(F.count_if(F.col("stage") == s).alias(s) for s in ("vector", "keyword", "graph")), F.count_distinct("chunk_id").alias("fused"))
    n = lambda df, name: df.groupBy("query_id").agg(F.count("*").alias(name))
    ids = taken.groupBy("query_id").agg(F.count("*").alias("injected"), F.transform(F.array_sort(F.collect_list(F.struct("position", "chunk_id"))), lambda x: x["chunk_id"]).alias("injected_ids"))  # TAKE at most
    report = queries.select("query_id").distinct()
    for part in (per_stage, n(kept, "gated"), n(hits, "returned"), ids):
        report = report.join(part, "query_id", "left")
    counts = ("vector", "keyword", "graph", "fused", "gated", "returned", "injected")
    report = report.select("query_id", *(F.coalesce(F.col(c), F.lit(0)).alias(c) for c in counts), F.coalesce("injected_ids", F.array().cast("array<string>")).alias("injected_ids"))
    flagged = hits.join(taken.select("query_id", "chunk_id", F.lit(True).alias("injected")), ["query_id", "chunk_id"], "left").withColumn("injected", F.coalesce("injected", F.lit(False)))
    return flagged, report


def partition_label(relevance, admitted, threshold: float):
    """P5: where a hit ends: below the gate, above it and shown, or above it and over the budget."""
    return F.when(relevance < threshold, "below").when(F.coalesce(admitted, F.lit(False)), "admitted").otherwise("over_budget")


def injected(hits: DataFrame, max_tokens: int) -> DataFrame:
    """What of the hits the prompt's budget takes, with the text as shown."""
    entry = rendered_entry(F.col("title"), F.col("heading_path"), F.col("page_no"), F.col("uri"), F.col("text"))
    return budget.admitted(hits.withColumn("entry", entry), max_tokens)
