import datetime as dt
import json
import random
from collections import Counter
from fractions import Fraction
from math import comb

import numpy as np
import pytest
from pyspark.sql import functions as F

from marrowlake.llm import components, conversations, distinctive, mixing, neighbours, packing, score_fusion, tokens
from marrowlake.operators import ranking

HITS = "query_id long, chunk_id string, score double, relevance double, inbound int, n int, g string, position int"


def brute_ranks(rows):
    best = {}
    for q, c, s, r, i, *_ in rows:
        if q is None or c is None:
            continue
        o = best.setdefault((q, c), [None, None, 0.0])
        for k, v in enumerate((s, r, float(i or 0))):
            if v is not None and v == v:
                o[k] = v if o[k] is None else max(o[k], v)
    out = {}
    for (q, c), v in best.items():
        peers = [w for (q2, _), w in best.items() if q2 == q]
        key = lambda x: float("-inf") if x is None else x
        out[q, c] = [1 + sum(key(w[k]) > key(v[k]) for w in peers) for k in range(3)]
    return out


@pytest.mark.parametrize("hot", [False, True])
def test_fusion_against_brute_force(spark, hot, monkeypatch):
    rng = random.Random(7)
    rows = [(rng.choice([1, 1, 1, 2, 3, None]), f"c{rng.randrange(40)}", rng.choice([None, round(rng.random(), 1), float("nan")]), rng.choice([None, 0.0, rng.random()]), rng.choice([None, 0, 5]), 1, "x", 2) for _ in range(300)]
    if hot:
        monkeypatch.setattr(score_fusion, "large_groups", lambda df, g: ranking.large_groups(df, g, 60))
    ranks = brute_ranks(rows)
    df = spark.createDataFrame(rows, HITS)
    got = {(r["query_id"], r["chunk_id"]): r for r in score_fusion.fused_scores(df).collect()}
    assert got.keys() == ranks.keys()
    assert all(list(got[k]["vector"]) == sorted(-x for x in v) for k, v in ranks.items())
    want = {q: min((sum(v), sorted(v, reverse=True), c) for (q2, c), v in ranks.items() if q2 == q)[2] for q in (1, 2, 3)}
    assert {r["query_id"]: r["chunk_id"] for r in score_fusion.best_items(df).collect()} == want
    order = {(r["query_id"], r["position"]): r["chunk_id"] for r in score_fusion.leximin_order(df).collect()}
    for q in (1, 2, 3):
        best = sorted((sorted(v, reverse=True), c) for (q2, c), v in ranks.items() if q2 == q)
        assert [order[q, i + 1] for i in range(len(best))] == [c for _, c in best]
    assert score_fusion.best_items(df.limit(0)).count() == 0


def test_leximin_does_not_mask(spark):
    df = spark.createDataFrame([(1, "a", 9.0, 9.0, 0), (1, "b", 5.0, 5.0, 5), (1, "c", 1.0, 1.0, 9)], "query_id int, chunk_id string, score double, relevance double, inbound int")
    assert score_fusion.leximin_order(df).orderBy("position").first()["chunk_id"] == "b"


def union_find(edges):
    p = {}

    def f(x):
        p.setdefault(x, x)
        while p[x] != x:
            x = p[x]
        return x

    for a, b in edges:
        if a is not None and b is not None and a != b:
            x, y = f(a), f(b)
            p[max(x, y)] = min(x, y)
    return {x: f(x) for x in p}


def test_components_against_union_find(spark):
    rng = random.Random(1)
    edges = [(rng.randrange(60), rng.randrange(60)) for _ in range(35)] + [(100 + i, 101 + i) for i in range(12)] + [(200, 201 + i) for i in range(30)] + [(5, 5), (None, 3)]
    got = {r["node"]: r["component"] for r in components.connected_components(spark.createDataFrame(edges, "a long, b long")).collect()}
    assert got == union_find(edges)
    assert components.connected_components(spark.createDataFrame([], "a long, b long")).count() == 0


MSG = "row_id long, session string, type string, cwd string, timestamp string, message struct<role:string,content:string>, loaded_at timestamp"


def log(spark, rows):
    return spark.createDataFrame([(i, s, None, c, t, (r, x), dt.datetime(2026, 1, 1)) for i, s, c, t, r, x in rows], MSG)


def test_conversation_status(spark):
    t = "2026-01-01T00:00:0{}Z".format
    text = lambda x: json.dumps([{"type": "text", "text": x}])
    rows = [
        (1, "ok", "/a", t(2), " AI ", text("yes")), (2, "ok", None, t(1), "Human", "hi"), (3, "ok", None, t(1), "Human", "hi"), (4, "ok", None, t(0), "system", "rules"),
        (10, "empty", None, t(1), "user", " "), (11, "empty", None, t(2), "assistant", json.dumps([{"type": "tool_use"}])),
        (20, "noreply", None, t(1), "user", "a"), (21, "noreply", None, t(2), "assistant", "b"), (22, "noreply", None, "2026-01-01 02:00:03+02:00", "user", "c"),
        (30, "first", None, t(1), "model", "a"), (40, "role", None, t(1), "user", "a"), (41, "role", None, t(2), None, "b"), (42, "role", None, t(3), "assistant", "b"),
        (50, "time", None, "yesterday", "user", "a"), (51, "time", None, t(3), "assistant", "b"), (60, "json", None, t(1), "user", '[{"type":"text"'), (61, "json", None, t(2), "assistant", "b"),
        (70, "wip", None, t(1), "user", "[wip] a"), (71, "wip", None, t(2), "assistant", "b"),
    ]
    got = {r["conversation"]: r["status"] for r in conversations.conversation_status(conversations.conversation_rows(log(spark, rows))).collect()}
    assert got == {"ok": "ok", "empty": "empty", "noreply": "no_reply", "first": "broken", "role": "broken", "time": "broken", "json": "broken", "wip": "ok"}
    turns = conversations.conversations(log(spark, rows)).filter("conversation = 'ok'").orderBy("turn").collect()
    assert [(r["speaker"], r["text"], r["cwd"]) for r in turns] == [("user", "hi", "/a"), ("assistant", "yes", "/a")]
    assert conversations.conversations(log(spark, rows).limit(0)).count() == 0


def test_rows_without_session_follow_quotes_and_replies(spark):
    t = "2026-01-01T00:00:0{}Z".format
    rows = [(1, None, "/a", t(1), "user", "first question"), (2, " ", "/a", t(2), "assistant", "> first question\nanswer"), (3, None, "/a", t(3), "user", "> answer line\nthanks"), (4, "s", "/b", t(1), "user", "known"), (5, None, "/b", t(2), "assistant", "> known\nok"), (6, None, "/b", t(3), "user", "> first question\nother folder")]
    got = {r["row_id"]: r["conversation"] for r in conversations.conversation_rows(log(spark, rows)).collect()}
    assert got[1] == got[2] and got[5] == "s" == got[4] and len({got[1], got[3], got[6], "s"}) == 4
    linked = log(spark, rows).withColumn("reply_to", F.when(F.col("row_id") == 3, 2))
    got = {r["row_id"]: r["conversation"] for r in conversations.conversation_rows(linked, "reply_to").collect()}
    assert got[1] == got[2] == got[3]


def tail(k, n, g, t):
    return Fraction(sum(comb(g, x) * comb(t - g, n - x) for x in range(k, min(n, g) + 1)), comb(t, n))


def test_hypergeometric_tail_is_exact():
    rng = np.random.default_rng(3)
    for _ in range(300):
        t = int(rng.integers(1, 300))
        g, n = int(rng.integers(0, t + 1)), int(rng.integers(0, t + 1))
        k = int(rng.integers(0, n + 2))
        want = float(tail(k, n, g, t)) if k <= min(n, g) else 0.0
        assert abs(float(np.exp(distinctive.log_upper_tail([k], [n], [g], [t]))[0]) - want) <= 1e-9 * want + 1e-15


def test_enrichment_against_brute_force(spark):
    rng = random.Random(5)
    rows = [(rng.randrange(6), rng.choice(["aa", "bb", "cc", f"w{rng.randrange(9)}"])) for _ in range(160)] + [(None, "aa"), (1, None)]
    got = {(r["d"], r["t"]): r for r in distinctive.enrichment(spark.createDataFrame(rows, "d int, t string"), "d", "t").collect()}
    good = [x for x in rows if None not in x]
    k, n, g = Counter(good), Counter(d for d, _ in good), Counter(t for _, t in good)
    p = {x: round(-np.log10(float(tail(c, n[x[0]], g[x[1]], len(good)))), 6) for x, c in k.items()}
    assert got.keys() == p.keys() and all(abs(got[x]["p_score"] - p[x]) < 2e-6 for x in p)
    for x in p:  # step-up: the best bound of all tests that are at most as significant
        q = max(0.0, max(p[y] - np.log10(len(p) / sum(p[z] >= p[y] - 1e-6 for z in p)) for y in p if p[y] <= p[x] + 1e-6))
        assert abs(got[x]["score"] - q) < 1e-4
    assert distinctive.enrichment(spark.createDataFrame([], "d int, t string"), "d", "t").count() == 0


def test_terms_and_tags(spark):
    c = spark.createDataFrame([("1:0", 1, "Hello hello, wörld abc12 abcde_fghij"), ("1:0", 1, "Hello hello, wörld abc12 abcde_fghij"), ("2:0", 2, None)], "id string, doc_id long, text string")
    assert Counter(r["term"] for r in distinctive.chunk_terms(c).collect()) == {"hello": 2, "abcde": 1, "fghij": 1}
    d = spark.createDataFrame([(1, ["#Db ", "db", " ", "#"]), (2, None), (3, [None])], "doc_id long, tags array<string>")
    assert [tuple(r) for r in distinctive.document_tags(d).collect()] == [(1, "db")]


def test_best_fit():
    rng = random.Random(2)
    for _ in range(40):
        sizes = [rng.randrange(1, 4097) for _ in range(rng.randrange(0, 200))]
        where, length = packing.best_fit(sizes)
        full = Counter()
        for s, b in zip(sizes, where):
            full[b] += s
        assert all(full[b] <= length[b] and (length[b] == 512 or full[b] > {1024: 512, 2048: 1024, 4096: 2048}[length[b]]) for b in full) and len(full) == len(length)
        assert not sizes or len(length) <= 2 * (sum(sizes) / 4096) + 5
    assert packing.best_fit([]) == ([], [])


def test_pack_keeps_everything(spark):
    sizes = [(1, 10000), (2, 4096), (3, 0), (4, None), (5, 4097), *((i, i % 700 + 1) for i in range(6, 400))]
    df = spark.createDataFrame(sizes, "doc_id long, tokens long")
    rows = packing.pack(df, items_per_shard=50).collect()
    got = Counter()
    for r in rows:
        got[r["doc_id"]] += r["tokens"]
    assert got == {i: n for i, n in sizes if n}
    full = Counter()
    for r in rows:
        full[r["container"], r["length"]] += r["tokens"]
    assert all(v <= k[1] for k, v in full.items())
    assert {r["doc_id"] for r in rows if r["piece"] > 1} == {1, 5} and [r["start"] for r in sorted(rows, key=lambda r: (r["doc_id"], r["piece"])) if r["doc_id"] == 1] == [0, 4096, 8192]
    assert packing.pack(df.limit(0)).count() == 0


def test_mixing(spark):
    for rate, most in ((0.3, 2), (1.7, 3), (2.9, 3), (0.0, 3), (3.0, 3)):
        assert abs(mixing.capped_mean(mixing.poisson_for(rate, most), most) - rate) < 1e-6
    docs = spark.range(4000).select(F.col("id").alias("doc_id"), F.when(F.col("id") % 10 == 0, " Small").when(F.col("id") % 10 == 1, "none").otherwise("big").alias("source"), F.lit(100).alias("tokens"))
    targets = spark.createDataFrame([("small", 0.2, 4), ("big", 0.5, 2), ("gone", 0.1, 3), ("none", 0.2, 1)], "source string, target_share double, max_repeats int")
    drawn, report = mixing.mix(docs, targets)
    r = {x["source"]: x for x in report.collect()}
    assert r["small"]["reachable"] and not r["gone"]["reachable"] and not r["none"]["reachable"] and r["gone"]["drawn"] == 0
    assert abs(r["small"]["drawn"] / (0.2 * 400_000) - 1) < 0.1 and abs(r["big"]["drawn"] / (0.5 * 400_000) - 1) < 0.1 and r["small"]["most_copies"] <= 4 and r["none"]["drawn"] == 40_000
    assert abs(sum(x["share"] for x in r.values()) - 1) < 1e-9
    again, _ = mixing.mix(docs.repartition(7), targets)
    assert drawn.exceptAll(again).count() == 0
    assert mixing.mix(docs.limit(0), targets)[0].count() == 0


def test_tokens(spark):
    df = spark.createDataFrame([(1, "hello world"), (2, ""), (3, None), (4, "<|endoftext|>"), (5, "x" * 30000)], "doc_id long, text string")
    got = {r["doc_id"]: r["tokens"] for r in tokens.count_tokens(df, "text", ["doc_id"]).collect()}
    assert got[1] == 2 and got[2] == got[3] == 0 and got[4] > 1 and got[5] > 100


def vectors(spark, x, names=None):
    return spark.createDataFrame([(n, v.tolist() if v is not None else None) for n, v in zip(names or [f"v{i:03d}" for i in range(len(x))], x)], "id string, e array<float>")


@pytest.mark.parametrize("block", [4000, 17])
def test_similar_pairs_against_brute_force(spark, block):
    rng = np.random.default_rng(1)
    centre = rng.standard_normal((6, 64))
    x = np.concatenate([centre[i % 6] + 0.5 * rng.standard_normal(64) for i in range(300)]).reshape(300, 64)
    x[150:200] = x[:50] + 0.15 * rng.standard_normal((50, 64))
    x *= rng.uniform(0.1, 9, (300, 1))
    df = neighbours.distinct_vectors(neighbours.unit_vectors(vectors(spark, x.astype(np.float32)), "id", "e"))
    got = {(r["id_a"], r["id_b"]) for r in neighbours.similar_pairs(df, 0.92, probes=4, rows_per_part=60, block=block).collect()}
    u = x.astype(np.float32).astype(float)
    u /= np.linalg.norm(u, axis=1, keepdims=True)
    s = u @ u.T
    want = {(f"v{i:03d}", f"v{j:03d}") for i in range(300) for j in range(i + 1, 300) if s[i, j] >= 0.92}
    assert len(want) > 30 and got <= want and len(got) >= 0.9 * len(want)
    near = neighbours.nearest(df, df.filter("id < 'v020'"), 5, probes=5, rows_per_part=60, block=block).collect()
    hits = sum(r["neighbour"] in {f"v{j:03d}" for j in np.argsort(-s[int(r["id"][1:])])[1:6]} for r in near)
    assert len(near) == 100 and hits >= 90


def test_unusable_vectors_and_copies(spark):
    ok = np.r_[np.ones(32), np.zeros(32)]
    rows = [ok, None, np.zeros(64), np.ones(32), np.full(64, np.nan), ok * 1, ok * 1]
    u = neighbours.unit_vectors(vectors(spark, rows, ["a", "b", "c", "d", "e", "f", "g"]), "id", "e")
    assert sorted(r["id"] for r in u.collect()) == ["a", "f", "g"]
    assert {(r["id_a"], r["id_b"]) for r in neighbours.copy_links(u).collect()} == {("a", "f"), ("a", "g")}
    assert neighbours.similar_pairs(neighbours.distinct_vectors(u)).count() == 0
    assert neighbours.similar_pairs(neighbours.distinct_vectors(u.limit(0))).count() == 0


def test_balanced_parts():
    rng = np.random.default_rng(0)
    x = rng.standard_normal((600, 16)).astype(np.float32)
    x /= np.linalg.norm(x, axis=1, keepdims=True)
    size = np.bincount(neighbours.balanced_parts(x, neighbours.neighbour_graph(x), 10, rng), minlength=10)
    assert size.max() <= np.ceil(neighbours.SLACK * 60) + 1


def test_nearest_has_all_copies(spark, tmp_path):
    from marrowlake.llm import queries

    rng = np.random.default_rng(6)
    x = rng.standard_normal((60, 64)).astype(np.float32)
    x[1:4] = x[0]
    x[20:35] = x[19]
    x[36] = x[35] + 0.1 * x[37]
    x[38] = x[36]
    df = vectors(spark, x).withColumn("doc_id", F.when(F.col("id").isin("v000", "v002", "v019", "v034", "v035"), 100).otherwise(1).cast("long")).withColumnRenamed("e", "embedding")
    df.write.parquet(f"{tmp_path}/chunks.parquet")
    got: dict[str, list[str]] = {}
    for r in queries.p2_nearest(spark, str(tmp_path)).orderBy("id", "rank").collect():
        got.setdefault(r["id"], []).append(r["neighbour"])
    u = x.astype(float) / np.linalg.norm(x.astype(float), axis=1, keepdims=True)
    s = np.round(u @ u.T, 5)
    for i in (0, 2, 19, 34, 35):
        assert got[f"v{i:03d}"] == [f"v{j:03d}" for j in sorted(set(range(60)) - {i}, key=lambda j: (-s[i, j], j))[:10]], i


def test_parts_are_cut_again_where_the_sample_teaches_too_few(spark):
    rng = np.random.default_rng(8)
    centres = rng.standard_normal((150, 16))
    x = (centres[rng.integers(0, 150, 3000)] + 0.22 * rng.standard_normal((3000, 16))).astype(np.float32)
    df = spark.createDataFrame([(f"v{i:04d}", v.tolist()) for i, v in enumerate(x)], "id string, embedding array<float>")
    units = neighbours.distinct_vectors(neighbours.unit_vectors(df, "id", "embedding", 16)).cache()
    router = neighbours.learn(units, 3000, fit_rows=480, rows_per_part=40)
    assert len(router.bias) == 20 and 60 <= router.parts <= 100 and any(router.children)
    u = x / np.linalg.norm(x, axis=1, keepdims=True)
    top = router.likeliest(u, 6)
    assert top.shape == (3000, 6) and top.max() < router.parts and all(len(set(r)) == 6 for r in top[:200])
    sizes = np.bincount(top[:, 0], minlength=router.parts)
    assert sizes.max() < 400
    s = u.astype(float) @ u.T.astype(float)
    want = {(f"v{i:04d}", f"v{j:04d}") for i, j in zip(*np.nonzero(np.triu(s >= 0.92, 1)))}
    got = {(r["id_a"], r["id_b"]) for r in neighbours.similar_pairs(units, 0.92, probes=4, fit_rows=480, rows_per_part=40).collect()}
    assert len(want) > 500 and got <= want and len(got) >= 0.97 * len(want)


def test_the_graph_is_what_is_halved():
    # two rings that lie on top of one another along every direction but the last: halving by spread alone would cut both
    t = np.linspace(0, 2 * np.pi, 200, endpoint=False)
    x = np.concatenate([np.stack([np.cos(t), np.sin(t), np.full(200, h)], 1) for h in (0.35, -0.35)]).astype(np.float32)
    x /= np.linalg.norm(x, axis=1, keepdims=True)
    label = neighbours.balanced_parts(x, neighbours.neighbour_graph(x, 8), 2, np.random.default_rng(0))
    graph = neighbours.neighbour_graph(x, 8)
    cut = (label[graph] != label[:, None]).mean()
    assert cut < 0.05 and abs(np.bincount(label, minlength=2) - 200).max() <= 40
