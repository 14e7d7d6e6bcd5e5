import math
import random
from collections import Counter

import numpy as np
from pyspark.sql import Window
from pyspark.sql import functions as F

from marrowlake.functions.text import STOP_WORDS
from marrowlake.operators import bm25, budget, fusion, graph, knn, ranking
from marrowlake.plans import profiles, retrieve


def test_rank_in_group_slices_equal_one_window(spark):
    rng = random.Random(2)
    rows = [("hot" if i % 3 else f"g{i % 7}", float(rng.choice([rng.random(), 0.5])) if i % 11 else None, i) for i in range(3000)]
    df = spark.createDataFrame(rows, "g string, v double, i int")
    for ties in ("rank", "row_number"):
        order = [("v", True)] if ties == "rank" else [("v", True), ("i", False)]
        cut = ranking.rank_in_group(df, "g", order, "r", ties, rows_per_task=100)
        whole = ranking.rank_in_group(df, "g", order, "r", ties)
        assert sorted(map(tuple, cut.collect()), key=str) == sorted(map(tuple, whole.collect()), key=str)
    assert ranking.rank_in_group(df.limit(0), "g", [("v", True)]).count() == 0


def test_bm25_against_brute_force(spark):
    rng = random.Random(3)
    texts = {f"r{i}": " ".join(rng.choice("alpha beta gamma delta the of epsilon".split()) for _ in range(rng.randrange(0, 12))) for i in range(30)}
    rows = spark.createDataFrame([*texts.items(), ("rn", None)], "id string, text string")
    got = {(r["term"], r["id"]): r["impact"] for r in bm25.postings(rows).collect()}
    words = {k: [w for w in t.split() if w not in STOP_WORDS] for k, t in texts.items()}
    n, avg = len(texts) + 1, sum(map(len, words.values())) / (len(texts) + 1)
    df = Counter(w for ws in words.values() for w in set(ws))
    want = {}
    for k, ws in words.items():
        for w, tf in Counter(ws).items():
            want[w, k] = math.log(1 + (n - df[w] + 0.5) / (df[w] + 0.5)) * tf * 2.2 / (tf + 1.2 * (0.25 + 0.75 * len(ws) / avg))
    assert got.keys() == want.keys() and all(abs(got[x] - want[x]) < 1e-9 for x in want)
    q = spark.createDataFrame([(1, "alpha alpha beta"), (2, "the"), (3, None)], "query_id int, text string")
    hits = bm25.search(q, bm25.postings(rows), 5).collect()
    score = {k: 2 * want.get(("alpha", k), 0) + want.get(("beta", k), 0) for k in words}
    best = sorted((-round(s, 9), k) for k, s in score.items() if s)[:5]
    assert [(h["id"]) for h in sorted(hits, key=lambda h: h["position"])] == [k for _, k in best] and {h["query_id"] for h in hits} == {1}


def test_knn_blocks_and_ties(spark):
    rng = np.random.default_rng(0)
    x = rng.standard_normal((60, 8)).astype(np.float32)
    x[5] = x[6]
    rows = spark.createDataFrame([(f"v{i:02d}", v.tolist()) for i, v in enumerate(x)], "id string, vec array<float>").repartition(3)
    asked = rows.filter("id < 'v20'").withColumnRenamed("id", "query_id")
    got = {(r["query_id"], r["position"]): r["id"] for r in knn.knn(asked, rows, 3, dims=8, block=7).collect()}
    u = x.astype(float) / np.linalg.norm(x.astype(float), axis=1, keepdims=True)
    s = np.round(u @ u.T, 12)
    for i in range(20):
        best = sorted(range(60), key=lambda j: (-s[i, j], j))[:3]
        assert [got[f"v{i:02d}", k] for k in (1, 2, 3)] == [f"v{j:02d}" for j in best]
    assert knn.knn(asked.limit(0), rows, 3, dims=8).count() == 0 and knn.knn(asked, rows.limit(0), 3, dims=8).count() == 0


def lists(spark, *ls):
    rows = [(1, f"l{k}", 1.0, c, i + 1, r) for k, l in enumerate(ls) for i, (c, r) in enumerate(l)]
    return spark.createDataFrame(rows, "query_id int, list string, weight double, chunk_id string, position int, relevance double")


def test_rrf_consensus_ties_and_relevance(spark):
    order = lambda df: [r["chunk_id"] for r in df.orderBy("position").collect()]
    assert order(fusion.rrf(lists(spark, [("1", None), ("2", None)], [("3", None), ("2", None)])))[0] == "2"
    assert order(fusion.rrf(lists(spark, *[[(str(i), None)] for i in reversed(range(8))]))) == [str(i) for i in range(8)]
    for a, b in ((0.8, 0.0), (0.0, 0.8)):
        assert fusion.rrf(lists(spark, [("x", a)], [("x", b)])).first()["relevance"] == 0.8


def test_gate_after_demotion(spark):
    pool = spark.createDataFrame([(1, "a", 0.70), (1, "b", 0.9), (1, "c", 0.9)], "query_id int, chunk_id string, relevance double")
    got = fusion.weight_and_gate(pool, F.when(F.col("chunk_id") == "a", 0.9).otherwise(1.0), 0.66).orderBy("position").collect()
    assert [r["chunk_id"] for r in got] == ["b", "c"]


def test_mmr_trades_rank_for_variety():
    docs, texts = ["A", "A", "B"], ["x y", "x y", "z"]
    assert fusion.mmr_order(docs, texts, 0.9, 2) == [0, 1]
    assert fusion.mmr_order(docs, texts, 0.2, 2) == [0, 2]
    assert fusion.mmr_order([], [], 0.5, 3) == [] and fusion.mmr_order(["A"], [None], 0.5, 3) == [0]


def test_mmr_by_query(spark):
    df = spark.createDataFrame([(1, "a", "A", "x y", 1), (1, "b", "A", "x y", 2), (1, "c", "B", "z", 3), (2, "d", "A", None, 1)], "query_id int, chunk_id string, doc_id string, text string, position int")
    got = [(r["query_id"], r["chunk_id"]) for r in fusion.mmr(df, 0.2, 2).orderBy("query_id", "position").collect()]
    assert got == [(1, "a"), (1, "c"), (2, "d")]


def test_budget_stops_at_first_overflow(spark):
    df = spark.createDataFrame([(1, 1, "a" * 100), (1, 2, "é" * 200), (1, 3, "b")], "query_id int, position int, entry string")
    got = budget.admitted(df, 100).orderBy("position").collect()
    assert [(r["position"], r["cut"], len(r["shown"])) for r in got] == [(1, False, 100), (2, True, 200)]
    got = budget.admitted(df, 75).orderBy("position").collect()
    assert [r["position"] for r in got] == [1]  # 200 left is not more than 200


def test_lessons(spark):
    df = spark.createDataFrame([("p", "a", "x" * 20, 1), ("p", "b", "y" * 20, 2), ("p", "c", "z" * 50, 3)], "project string, id string, text string, created long")
    r = budget.lessons_block(df, 22, header="H\n", footer="F").first()
    assert (r["shown"], r["omitted"]) == (2, 1) and r["body"].startswith("H\n- zzz") and "(1 more)" in r["body"]


def docs_frame(spark):
    rows = [
        ("d1", "u/a.md", "Pooling", "markdown", ["baking", " POOLING ", "gone"], ["#Db"], '{"status":"draft"}'),
        ("d2", "u/b.md", "Baking", "markdown", ["pooling", "dup"], None, '{"superseded_by":"ADR-3"}'),
        ("d3", "u/c.md", "Dup", "markdown", None, [], '{"id":"adr-3"}'),
        ("d4", "u/d.md", "dup ", "transcript", ["b"], ["x"], None),
        ("d5", "u/e.md", None, "web", [], None, "{}"),
    ]
    return spark.createDataFrame(rows, "id string, uri string, title string, source_type string, links array<string>, tags array<string>, meta string")


def test_links_need_unique_names(spark):
    got = {tuple(r) for r in graph.resolved_links(docs_frame(spark)).collect()}
    assert got == {("d1", "d2", "wikilink"), ("d2", "d1", "wikilink"), ("d4", "d2", "wikilink"), ("d2", "d3", "superseded-by")}
    assert [r["key"] for r in graph.ambiguous_titles(docs_frame(spark)).collect()] == ["dup"]
    inb = {r["id"]: r["inbound"] for r in graph.inbound_counts(graph.resolved_links(docs_frame(spark))).collect()}
    assert inb == {"d1": 1, "d2": 2}
    life = {r["id"]: r["lifecycle"] for r in graph.lifecycles(docs_frame(spark), graph.inbound_counts(graph.resolved_links(docs_frame(spark)))).collect()}
    assert life == {"d1": 1}  # a proposal that is linked to


def chunk_frame(spark):
    return spark.createDataFrame([(f"d{d}:{o}", f"d{d}", o) for d in (1, 2, 3) for o in range(12)], "id string, doc string, ord long")


def test_expansion(spark):
    chunks = chunk_frame(spark)
    seeds = spark.createDataFrame([(1, "d1:9", "d1", 9), (1, "d1:10", "d1", 10)], "query_id int, chunk_id string, doc string, ord long")
    near = graph.adjacent(seeds, chunks, 2, 10).orderBy("position").collect()
    assert [r["chunk_id"] for r in near] == ["d1:7", "d1:8", "d1:11"]  # by number, not by name
    edges = spark.createDataFrame([("d1", "d2", "wikilink"), ("d2", "d3", "superseded-by"), ("d1", "d3", "supersedes")], "src string, dst string, kind string")
    assert [r["chunk_id"] for r in graph.linked(seeds, chunks, edges, 1, 5).collect()] == ["d2:0"]
    assert [r["chunk_id"] for r in graph.linked(seeds, chunks, edges, 2, 5).orderBy("position").collect()] == ["d2:0", "d3:0"]
    both = graph.expanded(seeds, chunks, edges, 2, 4).orderBy("position").collect()
    assert [r["chunk_id"] for r in both] == ["d1:7", "d2:0", "d1:8", "d3:0"]


def test_search_end_to_end(spark):
    docs = docs_frame(spark)
    v = [[1.0, 0.0] + [0.0] * 62, [0.9, 0.1] + [0.0] * 62, [0.0, 1.0] + [0.0] * 62]
    chunks = spark.createDataFrame([("d1:0", 0, "pool of connections", "", None, v[0]), ("d1:0", 0, "pool of connections", "", None, None), ("d2:0", 0, "bread and connections", "H", 2, v[1]), ("d4:0", 0, "other", "", None, v[2])], "id string, ord long, text string, heading_path string, page_no long, embedding array<float>")
    pack = retrieve.build_pack(docs, chunks)
    q = spark.createDataFrame([(1, "connections pool", v[0]), (2, "bread", None), (3, "", None)], "query_id long, text string, vec array<float>")
    for tier in profiles.TIERS:
        got = retrieve.search(q, pack, tier).orderBy("query_id", "position").collect()
        assert [r["chunk_id"] for r in got if r["query_id"] == 1][:2] == ["d1:0", "d2:0"]
        assert [r["chunk_id"] for r in got if r["query_id"] == 2] == ["d2:0"] and not [r for r in got if r["query_id"] == 3]
    got = retrieve.injected(retrieve.search(q, pack, profiles.TIERS[1], least=0.9), 1500).collect()
    assert {r["chunk_id"] for r in got} == {"d1:0", "d2:0"} and any(r["shown"] == "\n[Baking > H p.2](u/b.md)\nbread and connections\n" for r in got)


def test_profiles():
    assert profiles.suggestion("candiates", ["candidates", "mmr"]) == "candidates" and profiles.suggestion("zzz", ["candidates"]) is None
    assert profiles.edit_distance("ab", "ba") == 1 and profiles.edit_distance("", "abc") == 3
    p = profiles.overridden(profiles.TIERS[0], {"candidates": 7, "mmr": None})
    assert p.candidates == 7 and p.mmr == 1.0
    try:
        profiles.overridden(p, {"candidats": 1})
    except KeyError as e:
        assert "candidates" in str(e)
    else:
        raise AssertionError


def test_windows_of_the_plan_are_partitioned(spark):
    df = spark.range(10).withColumn("g", F.col("id") % 2)
    assert ranking.rank_in_group(df, "g", [("id", False)]).filter("position = 1").count() == 2
    assert Window is not None


def test_near_duplicates_search_all_other_rows(spark, tmp_path):
    from marrowlake.plans import retrieval_queries

    rng = np.random.default_rng(4)
    x = rng.standard_normal((350, 64)).astype(np.float32)
    x[100] = x[0] + 0.01 * x[1]
    x[200], x[201:207] = x[300], x[300]
    rows = [(i, v.tolist(), "a") for i, v in enumerate(x)]
    spark.createDataFrame(rows, "vec_id long, embedding array<float>, label string").repartition(3).write.parquet(f"{tmp_path}/embeddings.parquet")
    got = {r["query_id"]: (r["id"], r["relevance"]) for r in retrieval_queries.near_duplicates(spark, str(tmp_path)).collect()}
    u = x.astype(float) / np.linalg.norm(x.astype(float), axis=1, keepdims=True)
    s = np.round(u @ u.T, 12)
    want = {}
    for i in range(0, 350, 100):
        j = min((j for j in range(350) if j != i), key=lambda j: (-s[i, j], str(j)))
        if (1 + s[i, j]) / 2 >= 0.6:
            want[str(i)] = (str(j), round((1 + s[i, j]) / 2, 6))
    assert got == want and got["0"][0] == "100" and got["300"][0] == "200"
