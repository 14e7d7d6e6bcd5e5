"""Retrieval quality: recall, spreads, gates, golden-set checks."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from marrowlake.functions.text import STOP_WORDS, tokens, without_stop_words
from marrowlake.runtime import cut

# fixed values: the gates that are priced, the default gate, and the least number of negative cases that supports a recommendation
GATES = [0.50, 0.55, 0.60, 0.62, 0.64, 0.66, 0.68, 0.70, 0.72, 0.74, 0.76, 0.78, 0.80, 0.85, 0.90]
DEFAULT_GATE, LEAST_NEGATIVES = 0.66, 5
# fixed values: when a query echoes a title
ECHO_OVERLAP, ECHO_TERMS, ECHO_RUN = 0.6, 3, 3


def distinct_ranks(ranked: DataFrame) -> DataFrame:
    """(case_id, uri, rank): rank of the first appearance among distinct uris (W8). ranked: case_id, uri, position."""
    first = ranked.groupBy("case_id", "uri").agg(F.min("position").alias("position"))
    return first.withColumn("rank", F.row_number().over(Window.partitionBy("case_id").orderBy("position", "uri"))).drop("position")


def recall_at(ranked: DataFrame, expected: DataFrame, k: int, group: list[str] = []) -> DataFrame:
    """(group, cases, recall): share of cases one of whose acceptable uris is among the first k distinct ones.

    expected: case_id, uri and the group columns. A case without hits counts as missed; no cases give 0.
    """
    hit = distinct_ranks(ranked).filter(F.col("rank") <= k).join(expected.select("case_id", "uri").distinct(), ["case_id", "uri"]).select("case_id").distinct().withColumn("hit", F.lit(1.0))
    cases = expected.select("case_id", *group).distinct().join(hit, "case_id", "left")
    agg = cases.groupBy(*group) if group else cases
    return agg.agg(F.count("*").alias("cases"), F.coalesce(F.avg(F.coalesce("hit", F.lit(0.0))), F.lit(0.0)).alias("recall"))


def recall_gated(ranked: DataFrame, expected: DataFrame, k: int, gate: float) -> DataFrame:
    """recall_at of the hits whose relevance reaches the gate."""
    return recall_at(ranked.filter(F.col("relevance") >= gate), expected, k)


def classified(ranked: DataFrame, cases: DataFrame, expected: DataFrame) -> DataFrame:
    """ranked with class: answer, other (a hit of a positive case that answers nothing) or negative (A23). cases: case_id, negative."""
    answers = expected.select("case_id", "uri").distinct().withColumn("_a", F.lit(True))
    r = ranked.join(cases.select("case_id", "negative"), "case_id").join(answers, ["case_id", "uri"], "left")
    return r.withColumn("class", F.when(F.col("negative"), "negative").when(F.col("_a"), "answer").otherwise("other")).drop("_a", "negative")


def spread(values: DataFrame, value: str = "relevance", group: list[str] = []) -> DataFrame:
    """n, min, p10, p25, p50, p75, p90 and max by nearest rank (A18, M17), by group; empty groups have no row."""
    keyed = values.select(F.struct(*group).alias("_g") if group else F.struct(F.lit(0).alias("_")).alias("_g"), value)
    at = ranked_quantiles(keyed, "_g", value, {"p10": 0.1, "p25": 0.25, "p50": 0.5, "p75": 0.75, "p90": 0.9}, ends=True)
    return at.select(*(F.col("_g")[c].alias(c) for c in group), "n", "min", *(F.col(f"near_{p}").alias(p) for p in ("p10", "p25", "p50", "p75", "p90")), "max")


def ranked_quantiles(rows: DataFrame, group: str, value: str, at: dict[str, float], ends: bool = False) -> DataFrame:
    """Per group (not null), near_<name> and floor_<name>: the elements of rank ceil(q n) and floor((n - 1) q) + 1 of its values (A21, M17, M18); with ends also n, min and max. Nulls are left out.

    Values are counted first; the running counts are taken in slices of each group's own distinct values, cut at approximate quantiles, so no task sorts a whole group.
    """
    c = cut(rows.filter(F.col(value).isNotNull()).groupBy(group, value).agg(F.count("*").alias("_c")))
    cuts = c.groupBy(group).agg(F.percentile_approx(value, [i / 64 for i in range(1, 64)], 1000).alias("_cuts"), F.sum("_c").alias("_n"))
    c = c.join(cuts, group).withColumn("_slice", F.size(F.filter("_cuts", lambda x: x < F.col(value)))).drop("_cuts")
    per = c.groupBy(group, "_slice").agg(F.sum("_c").alias("_s"))
    before = per.withColumn("_before", F.sum("_s").over(Window.partitionBy(group).orderBy("_slice")) - F.col("_s")).drop("_s")  # 64 slices a group
    c = c.join(before, [group, "_slice"]).withColumn("_to", F.col("_before") + F.sum("_c").over(Window.partitionBy(group, "_slice").orderBy(value)))
    n = F.col("_n")
    ranks = {f"near_{k}": F.greatest(F.lit(1), F.least(n, F.ceil(n * F.lit(q)))) for k, q in at.items()} | {f"floor_{k}": F.floor((n - 1) * F.lit(q)) + 1 for k, q in at.items()}
    holds = lambda r: F.when((F.col("_to") >= r) & (F.col("_to") - F.col("_c") < r), F.col(value))
    more = (F.sum("_c").alias("n"), F.min(value).alias("min"), F.max(value).alias("max")) if ends else ()
    return c.groupBy(group).agg(*more, *(F.max(holds(r)).alias(k) for k, r in ranks.items()))


def origin(pool: DataFrame, stages: DataFrame) -> DataFrame:
    """pool with the stage that produced each hit: vector before keyword before graph (J16). stages: query_id, chunk_id, stage."""
    order = F.when(F.col("stage") == "vector", 0).when(F.col("stage") == "keyword", 1).when(F.col("stage") == "graph", 2).otherwise(3)
    best = stages.groupBy("query_id", "chunk_id").agg(F.min_by("stage", order).alias("origin"))
    return pool.join(best, ["query_id", "chunk_id"], "left").withColumn("origin", F.coalesce("origin", F.lit("unattributed")))


def trade_off(hits: DataFrame, cases: DataFrame, expected: DataFrame, gates: list[float] = GATES, k: int = 5) -> DataFrame:
    """Per gate: negative hits admitted, answer hits cut, negative cases injected, answer cases lost, recall.

    hits: classified rows with case_id, uri, position, relevance. Each hit is counted once per gate by conditional sums, not copied; recall takes each
    case's best distinct rank per gate.
    """
    neg, ans = hits.filter("class = 'negative'"), hits.filter("class = 'answer'")
    ladder = hits.sparkSession.createDataFrame([(float(g),) for g in gates], "gate double")

    def counts(df: DataFrame, name: str, above: bool, per_case: bool) -> DataFrame:
        base = df.groupBy("case_id").agg(F.max("relevance").alias("relevance")) if per_case else df
        one = base.agg(*(F.count_if(F.col("relevance") >= g if above else F.col("relevance") < g).alias(f"g{i}") for i, g in enumerate(gates)))
        return one.select(F.explode(F.array(*(F.struct(F.lit(float(g)).alias("gate"), F.col(f"g{i}").alias(name)) for i, g in enumerate(gates)))).alias("x")).select("x.gate", f"x.{name}")

    # a uri's rank under a gate: distinct uris whose first admitted hit comes no later
    first = hits.filter("class <> 'negative'").crossJoin(F.broadcast(ladder)).filter("relevance >= gate").groupBy("gate", "case_id", "uri").agg(F.min("position").alias("position"))  # a row a gate
    rank = first.withColumn("rank", F.row_number().over(Window.partitionBy("gate", "case_id").orderBy("position", "uri"))).filter(F.col("rank") <= k)
    good = rank.join(expected.select("case_id", "uri").distinct(), ["case_id", "uri"]).select("gate", "case_id").distinct().groupBy("gate").agg(F.count("*").alias("found"))
    total = expected.select("case_id").distinct().agg(F.count("*").alias("total"))
    recall = ladder.join(good, "gate", "left").crossJoin(total).select("gate", F.when(F.col("total") > 0, F.coalesce("found", F.lit(0)) / F.col("total")).otherwise(0.0).alias("recall"))
    out = counts(neg, "negative_hits_admitted", True, False)
    for df, name, above, per_case in ((ans, "answer_hits_cut", False, False), (neg, "negative_cases_injected", True, True), (ans, "answer_cases_lost", False, True)):
        out = out.join(counts(df, name, above, per_case), "gate")
    return out.join(recall, "gate")


def cheapest_clean_gate(table: DataFrame) -> DataFrame:
    """The lowest gate that injects no negative case (A17); null if none does."""
    return table.agg(F.min(F.when(F.col("negative_cases_injected") == 0, F.col("gate"))).alias("gate"))


def recommendation(hits: DataFrame, negative_cases: DataFrame, keep: float = DEFAULT_GATE) -> DataFrame:
    """(kind, threshold, min_relevant, max_negative, negative_cases) from classified hits.

    calibrated: the middle between the worst answer and the best negative hit, if the first is above. overlapping and
    too_few_negatives keep the default.
    """
    a = hits.agg(F.min(F.when(F.col("class") == "answer", F.col("relevance"))).alias("min_relevant"), F.max(F.when(F.col("class") == "negative", F.col("relevance"))).alias("max_negative"))
    r = a.crossJoin(negative_cases.agg(F.count("*").alias("negative_cases")))  # single rows
    few = (F.col("negative_cases") < LEAST_NEGATIVES) | F.col("min_relevant").isNull() | F.col("max_negative").isNull()
    kind = F.when(few, "too_few_negatives").when(F.col("min_relevant") > F.col("max_negative"), "calibrated").otherwise("overlapping")
    return r.withColumn("kind", kind).withColumn("threshold", F.when(F.col("kind") == "calibrated", (F.col("min_relevant") + F.col("max_negative")) / 2).otherwise(F.lit(keep))).select("kind", "threshold", "min_relevant", "max_negative", "negative_cases")


def absent_scores(hits: DataFrame, admitted: DataFrame, absent: DataFrame) -> DataFrame:
    """(case_id, uri, injected, rank) of uris that should not come: shown after gate and budget, and rank before the gate."""
    rank = hits.groupBy("case_id", "uri").agg(F.min("position").alias("rank"))
    shown = admitted.select("case_id", "uri").distinct().withColumn("injected", F.lit(True))
    return absent.select("case_id", "uri").join(rank, ["case_id", "uri"], "left").join(shown, ["case_id", "uri"], "left").select("case_id", "uri", F.coalesce("injected", F.lit(False)).alias("injected"), "rank")


def duplicate_queries(cases: DataFrame) -> DataFrame:
    """(key, cases): queries asked more than once, without regard to case and outer blanks, with their numbers (A24). cases: case_id, query."""
    key = F.lower(F.trim("query"))
    return cases.select(key.alias("key"), "case_id").filter("key <> ''").groupBy("key").agg(F.array_sort(F.collect_list("case_id")).alias("cases")).filter(F.size("cases") > 1)


def faulty_cases(cases: DataFrame) -> DataFrame:
    """(case_id, fault): blank, contradictory (none expected, yet a document named) and unnamed (nothing named) cases."""
    named = F.coalesce(F.size("acceptable"), F.lit(0)) > 0
    faults = F.array_compact(
        F.array(
            F.when(F.trim(F.coalesce("query", F.lit(""))) == "", "blank"),
            F.when(F.col("negative") & named, "contradictory"),
            F.when(~F.col("negative") & ~named, "unnamed"),
        )
    )
    return cases.select("case_id", F.explode(faults).alias("fault"))


def longest_run(a: Column, b: Column) -> Column:
    """The length of the longest contiguous run that two word arrays share; a fold over one row of the table of common suffixes."""
    zero = F.transform(F.sequence(F.lit(0), F.size(b)), lambda _: F.lit(0))
    row = lambda prev, x: F.transform(F.sequence(F.lit(0), F.size(b)), lambda j: F.when((j > 0) & (F.get(b, j - 1) == x), F.get(prev, j - 1) + 1).otherwise(0))
    step = lambda s, x: F.struct(row(s["prev"], x).alias("prev"), F.greatest(s["best"], F.array_max(row(s["prev"], x))).alias("best"))
    return F.when((F.size(a) > 0) & (F.size(b) > 0), F.aggregate(a, F.struct(zero.alias("prev"), F.lit(0).alias("best")), step, lambda s: s["best"])).otherwise(0)


def title_echoes(pairs: DataFrame, stop: tuple[str, ...] = STOP_WORDS) -> DataFrame:
    """(case_id, uri, overlap, run) where the query repeats the title (A25, M14). pairs: case_id, uri, query, title."""
    q, t = without_stop_words(tokens(F.col("query")), stop), without_stop_words(tokens(F.col("title")), stop)
    p = pairs.select("case_id", "uri", q.alias("q"), t.alias("t"), F.array_distinct(t).alias("terms"))
    p = p.withColumn("overlap", F.when(F.size("terms") > 0, F.size(F.array_intersect("terms", "q")) / F.size("terms")).otherwise(0.0)).withColumn("run", longest_run(F.col("q"), F.col("t")))
    return p.filter(((F.size("terms") >= ECHO_TERMS) & (F.col("overlap") >= ECHO_OVERLAP)) | (F.col("run") >= ECHO_RUN)).select("case_id", "uri", "overlap", "run")


def golden_report(cases: DataFrame, documents: DataFrame, expected: DataFrame) -> DataFrame:
    """(level, check, detail) of a golden set: faults, duplicates, echoes, uris that are not indexed, too few negatives."""
    bad = faulty_cases(cases).select(F.lit("error").alias("level"), F.col("fault").alias("check"), F.col("case_id").cast("string").alias("detail"))
    dup = duplicate_queries(cases).select(F.lit("warning").alias("level"), F.lit("duplicate").alias("check"), F.col("key").alias("detail"))
    gone = expected.select("uri").distinct().join(documents.select("uri"), "uri", "left_anti").select(F.lit("error").alias("level"), F.lit("missing").alias("check"), F.col("uri").alias("detail"))
    pairs = expected.select("case_id", "uri").join(cases.filter("not negative").select("case_id", "query"), "case_id").join(documents.select("uri", "title"), "uri")
    echo = title_echoes(pairs).select(F.lit("warning").alias("level"), F.lit("echo").alias("check"), F.concat_ws(" ", "case_id", "uri").alias("detail"))
    few = cases.agg(F.count_if(F.col("negative")).alias("n")).filter(F.col("n") < LEAST_NEGATIVES).select(F.lit("warning").alias("level"), F.lit("few negatives").alias("check"), F.col("n").cast("string").alias("detail"))
    return bad.unionByName(dup).unionByName(gone).unionByName(echo).unionByName(few)


def comparability(before: DataFrame, after: DataFrame, key: str | None = None) -> DataFrame:
    """(change, before, after) between two provenances (A27); no rows mean comparable. Unknown counts are a change of their own.

    Provenances are one row each, or with key one row a value of it, which are then compared value by value and shown with it. Columns that a frame lacks are unknown.
    """
    names = ["golden_sha256", "cases", "documents", "chunks", "memories", "no_graph"]

    def side(df: DataFrame, mark: str) -> DataFrame:
        values = (F.coalesce(F.col(n).cast("string") if n in df.columns else F.lit(None).cast("string"), F.lit("false") if n == "no_graph" else F.lit(None)).alias(f"{mark}_{n}") for n in names)
        return df.select(*([key] if key else []), *values)

    b, a = side(before, "b"), side(after, "a")
    both = b.join(a, key) if key else b.crossJoin(a)  # one row each
    rows = F.array(*(F.struct(F.lit(n).alias("change"), F.col(f"b_{n}").alias("before"), F.col(f"a_{n}").alias("after")) for n in names))
    unknown = F.array(F.struct(F.when(F.expr("b_documents is null or a_documents is null or b_chunks is null or a_chunks is null"), "corpus_unknown").alias("change"), F.lit(None).cast("string").alias("before"), F.lit(None).cast("string").alias("after")))
    x = both.select(*([key] if key else []), F.explode(F.concat(rows, unknown)).alias("x")).select(*([key] if key else []), "x.*")
    return x.filter("(change = 'corpus_unknown') or (change = 'golden_sha256' and not (before <=> after)) or before <> after")


def corpus_view(documents: DataFrame | None, reason: str | None = None) -> DataFrame | str:
    """(uri, title) of the indexed documents, each uri once, or why there are none to check a golden set against."""
    if documents is None:
        return f"unavailable: {reason or 'no index'}"
    return documents.groupBy("uri").agg(F.min("title").alias("title"))


def memory_bench(hits: DataFrame, targets: DataFrame, gate: float) -> DataFrame:
    """(query_id, kind, best, found): the largest relevance of the wanted memory and whether it passes the gate (A28). targets: query_id, kind, memory_id."""
    best = targets.join(hits.select("query_id", F.col("chunk_id").alias("memory_id"), "relevance"), ["query_id", "memory_id"], "left").groupBy("query_id", "kind").agg(F.coalesce(F.max("relevance"), F.lit(0.0)).alias("best"))
    return best.withColumn("found", F.col("best") >= gate)
