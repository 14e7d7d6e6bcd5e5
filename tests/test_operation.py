import json
import re

import numpy as np
import pytest
from pyspark.sql import functions as F

from marrowlake import runtime
from marrowlake.functions import text
from marrowlake.operators import bm25, evaluation, index, knn, memory, pack
from marrowlake.operators.backup import Backups
from marrowlake.operators.versions import Versions
from marrowlake.plans import retrieve
from marrowlake.plans.profiles import TIERS
from marrowlake.sources import files, transcripts


def documents(spark, n=6):
    rows = [(f"d{i}", f"file:///{i}.md", f"Title {i}", "markdown", [f"title {(i + 1) % n}"], [], None) for i in range(n)]
    return spark.createDataFrame(rows, "id string, uri string, title string, source_type string, links array<string>, tags array<string>, meta string")


def chunks(spark, n=6, dims=64):
    rng = np.random.default_rng(1)
    rows = [(f"d{i}:{o}", o, f"running dogs and {'cats' if i % 2 else 'birds'} number {i}", "", None, rng.standard_normal(dims).astype(float).tolist() if i != 3 else None) for i in range(n) for o in range(2)]
    rows.append(rows[0])
    return spark.createDataFrame(rows, "id string, ord long, text string, heading_path string, page_no long, embedding array<float>")


def test_versions_are_published_once(spark, tmp_path):
    v = Versions(spark, f"file://{tmp_path}/m")
    assert v.read() is None and v.numbers() == []
    v.publish({"version": 1, "a": "x"})
    v.publish({"version": 12, "a": "y"})
    with pytest.raises(RuntimeError):
        v.publish({"version": 12, "a": "z"})
    assert v.numbers() == [1, 12] and v.read()["a"] == "y" and v.read(1)["a"] == "x"
    v.drop(12)
    assert v.read()["version"] == 1


def test_pack_is_published_opened_and_swept(spark, tmp_path):
    path, docs, c = f"file://{tmp_path}/p", documents(spark), chunks(spark)
    stamps = docs.select("uri", F.lit("1").alias("stamp"))
    first = pack.publish(spark, path, docs, c, stamps=stamps, two_phases=True)
    assert first.manifest["version"] == 2 and first.manifest["rows"] == 12 and first.manifest["rows_with_vectors"] == 10
    words = pack.open_pack(spark, path, version=1)
    assert words.vectors.count() == 0 and words.postings.count() == first.postings.count()  # texts were there before vectors
    assert pack.publish(spark, path, docs, c, stamps=stamps).manifest["version"] == 2  # nothing changed
    again = pack.publish(spark, path, docs, c, stamps=stamps, force=True)
    assert again.manifest["version"] == 3 and Versions(spark, f"{path}/manifests").numbers() == [2, 3]
    opened = pack.open_pack(spark, path, "hash@64+none", 64)
    assert opened.manifest == again.manifest and [r["row"] for r in opened.chunks.orderBy("id").collect()] == sorted(r["row"] for r in opened.chunks.collect())
    with pytest.raises(ValueError):
        pack.open_pack(spark, path, "other")
    with pytest.raises(ValueError):
        pack.open_pack(spark, f"file://{tmp_path}/nothing")
    p = pack.set_meta(pack.set_meta(opened, "k", "1"), "k", "2")
    assert pack.open_pack(spark, path).manifest["meta"] == {"k": "2"} and pack.set_meta(p, "k", None).manifest["meta"] == {}
    assert opened.documents.filter("id = 'd1'").first()["inbound"] == 1 and opened.stamps.count() == 6


def test_a_failed_publish_leaves_the_live_version(spark, tmp_path):
    path, docs, c = f"file://{tmp_path}/p", documents(spark), chunks(spark)
    pack.publish(spark, path, docs, c)
    with pytest.raises(Exception):
        pack.publish(spark, path, docs, c.withColumn("text", F.raise_error(F.lit("broken"))))
    live = pack.open_pack(spark, path)
    assert live.manifest["version"] == 1 and live.chunks.count() == 12


def test_compaction_leaves_out_what_is_gone(spark, tmp_path):
    p = pack.publish(spark, f"file://{tmp_path}/p", documents(spark), chunks(spark), stamps=documents(spark).select("uri", F.lit("1").alias("stamp")))
    q = pack.compacted(p, f"file://{tmp_path}/q", spark.createDataFrame([("d1",)], "id string"))
    assert q.chunks.count() == 10 and q.documents.count() == 5 and q.stamps.count() == 5 and q.vectors.filter("id like 'd1%'").count() == 0
    assert not [e for e in q.edges.collect() if "d1" in (e["src"], e["dst"])]


def test_empty_pack(spark, tmp_path):
    p = pack.publish(spark, f"file://{tmp_path}/p", documents(spark).limit(0), chunks(spark).limit(0))
    q = spark.createDataFrame([(1, "dogs", [1.0] * 64)], "query_id long, text string, vec array<float>")
    assert all(retrieve.search(q, p, t).count() == 0 for t in (TIERS[0], TIERS[4]))


def test_stemmed_blocks_equal_single_counts(spark, tmp_path):
    rows = spark.createDataFrame([(i, t) for i, t in enumerate(["Running runs\nran", None, "", "the of", "run-run! cats", "ponies' relational"] * 3)], "row long, text string")
    built = bm25.build(rows, f"file://{tmp_path}/b", "row", buckets=3)
    once = bm25.indexed(rows, "row")
    as_set = lambda ix: {(r["term"], r["row"], r["tf"], round(r["impact"], 9)) for r in ix.postings().collect()}
    assert as_set(built) == as_set(once) and built.rows == 18 and built.all_terms == once.all_terms
    q = spark.createDataFrame([(1, "running cat cat")], "query_id int, text string")
    hits = [(r["row"], round(r["score"], 6)) for r in bm25.search(q, built, 4).orderBy("position").collect()]
    assert hits == [(r["row"], round(r["score"], 6)) for r in bm25.search(q, once, 4).orderBy("position").collect()] and hits[0][0] == 4
    opened = bm25.opened(spark, f"file://{tmp_path}/b", built.rows, built.all_terms, "row", "long", 3)
    assert as_set(opened) == as_set(built)


def test_cells_reach_recall_by_width(spark):
    rng = np.random.default_rng(2)
    centre = rng.standard_normal((40, 64))
    x = (centre[rng.integers(0, 40, 4000)] + 0.7 * rng.standard_normal((4000, 64))).astype(np.float32)
    rows = spark.createDataFrame([(f"v{i:04d}", v.tolist()) for i, v in enumerate(x)], "id string, vec array<float>").repartition(4).cache()
    centres = knn.fit_cells(rows)
    placed = knn.placed(rows, centres).cache()
    sizes = {r["cell"]: r["count"] for r in placed.groupBy("cell").count().collect()}
    cells = knn.Cells(centres, np.array([sizes.get(i, 0) for i in range(len(centres))]))
    assert len(centres) == 63 and sum(cells.sizes) == 4000
    asked = rows.filter("id < 'v0100'").withColumnRenamed("id", "query_id")
    pairs = lambda df: {(r["query_id"], r["id"]) for r in df.collect()}
    exact = pairs(knn.knn(asked, placed, 20))
    assert pairs(knn.knn(asked, placed, 20, cells=cells, width=10_000)) == exact
    assert all(len(exact & pairs(knn.knn(asked, placed, 20, cells=cells, width=t.efs))) >= 0.95 * len(exact) for t in TIERS)
    u = x[:100].astype(float) / np.linalg.norm(x[:100].astype(float), axis=1, keepdims=True)
    looked = cells.probed(u, 2)
    assert looked.any(1).all() and (looked @ cells.sizes).max() < 1_000  # a quarter of the rows at most


def test_backups_store_only_what_changed(spark, tmp_path):
    df = spark.createDataFrame([(f"k{i}", i, [f"t{i}"] if i % 3 else None) for i in range(200)], "id string, v int, tags array<string>")
    b = Backups(spark, f"file://{tmp_path}/b")
    with pytest.raises(ValueError):
        b.restore()
    assert b.back_up(df, "id", 8)["uploaded"] == 8 and b.back_up(df.orderBy(F.rand()), "id", 8)["uploaded"] == 0
    changed = df.withColumn("v", F.when(F.col("id") == "k7", -1).otherwise(F.col("v")))
    assert b.back_up(changed, "id", 8)["uploaded"] == 1
    same = lambda a, c: a.exceptAll(c).isEmpty() and c.exceptAll(a).isEmpty()
    assert same(b.restore(1), df) and same(b.restore(), changed)
    assert len(b.prune(1)) == 1 and same(b.restore(), changed)
    assert b.back_up(df.limit(0), "id", 8)["uploaded"] == 0 and b.restore().count() == 0


def test_backfill_in_batches_and_its_guard(spark):
    c = spark.createDataFrame([("b", "x", None), ("a", "y", None), ("a", "y", [1.0, 0.0]), ("c", "z", None), ("d", None, None)], "id string, embed_text string, embedding array<float>")
    made, left = index.backfilled(c, index.hash_embedding(2), 1, 2)
    got = made.collect()
    assert [r["id"] for r in got] == ["b"] and abs(sum(v * v for v in got[0]["embedding"]) - 1) < 1e-6 and left.first()["left"] == 1
    with pytest.raises(Exception, match="gave 0 vectors"):
        index.backfilled(c, lambda texts: [], 5, 2)[0].collect()
    with pytest.raises(Exception, match="not all of 3 numbers"):
        index.backfilled(c, index.hash_embedding(2), 5, 3)[0].collect()


def test_response_order_is_checked(spark):
    r = spark.createDataFrame([(1, 1, "b"), (1, 0, "a"), (2, 0, "x"), (2, 2, "y"), (3, 0, "p"), (3, 0, "q")], "batch int, i int, v string")
    assert sorted(x["batch"] for x in index.response_faults(r, "batch", "i").collect()) == [2, 3]
    assert index.ordered_response(r.filter("batch = 1"), "batch", "i", "v").first()["values"] == ["a", "b"]
    with pytest.raises(Exception, match="0..n-1"):
        index.ordered_response(r, "batch", "i", "v").collect()


def test_scan_results_keep_stamps_of_what_was_put_off(spark):
    now = spark.createDataFrame([("a", "2"), ("b", "1"), ("c", "1"), ("d", None), ("e", "9"), ("f", None)], "uri string, stamp string")
    old = spark.createDataFrame([("a", "1"), ("b", "1"), ("e", "8"), ("f", "3")], "uri string, stamp string")
    got = index.scan_result(now, old, now.filter("uri = 'a'").select("uri"), now.filter("uri = 'e'").select("uri"))
    assert {r["uri"]: (r["state"], r["stamp"], r["live"]) for r in got.collect()} == {
        "a": ("deferred", "1", True), "b": ("unchanged", "1", True), "c": ("new", "1", True), "d": ("skipped", None, False), "e": ("failed", "8", True), "f": ("skipped", "3", True),
    }
    assert index.merged_scans([got, got.filter("uri = 'b'").withColumn("state", F.lit("changed"))]).filter("uri = 'b'").first()["state"] == "changed"
    due = spark.createDataFrame([(None,), (100,), (9_000,)], "last long").select(index.may_reindex(F.col("last"), 9_500).alias("x"))
    assert [r["x"] for r in due.collect()] == [True, True, False]


def test_memory_edits_and_forgetting(spark):
    from marrowlake.functions.identity import memory_id

    m = spark.createDataFrame([("fact", "one text here"), ("fact", "two text here"), ("fact", "three text here")], "kind string, text string").withColumn("id", memory_id(F.col("kind"), F.col("text")))
    ids = {r["text"].split()[0]: r["id"] for r in m.collect()}
    changes = spark.createDataFrame([(ids["one"], "two text here"), (ids["two"], "another text"), (ids["three"], "three text here "), ("zz", "x")], "id string, text string")
    after, outcomes = memory.edited(m, changes)
    assert {r["id"]: r["outcome"] for r in outcomes.collect()} == {ids["one"]: "duplicate", ids["two"]: "edited", ids["three"]: "unchanged", "zz": "not_found"}
    assert sorted(r["text"] for r in after.collect()) == ["another text", "one text here", "three text here"]
    left, found = memory.forgotten(m, spark.createDataFrame([(ids["one"][:5],), ("",), ("zz",)], "prefix string"))
    assert {r["prefix"]: r["status"] for r in found.collect()} == {ids["one"][:5]: "found", "": "ambiguous", "zz": "not_found"} and left.count() == 2
    assert memory.rebuilt(left, left).count() == 2
    with pytest.raises(Exception, match="would lose 1"):
        memory.rebuilt(left, m).collect()


def test_reranking_is_all_or_nothing(spark):
    pool = spark.createDataFrame([(q, f"c{i}", "cat dog" if i == 3 else "cat", i, 0.0, 0.5) for q in (1, 2) for i in (1, 2, 3, 4)], "query_id int, chunk_id string, text string, position int, score double, relevance double")
    scorer = retrieve.overlap_scorer(spark.createDataFrame([(1, "cat dog"), (2, "the of")], "query_id int, text string"))
    got = {q: [r["chunk_id"] for r in retrieve.reranked(pool, scorer, 3).filter(F.col("query_id") == q).orderBy("position").collect()] for q in (1, 2)}
    assert got == {1: ["c3", "c1", "c2", "c4"], 2: ["c1", "c2", "c3", "c4"]}
    part = lambda rows: scorer(rows).withColumn("value", F.when(F.col("chunk_id") != "c2", F.col("value")))
    assert [r["chunk_id"] for r in retrieve.reranked(pool, part, 3).filter("query_id = 1").orderBy("position").collect()] == ["c1", "c2", "c3", "c4"]


def test_explained_search_accounts_for_every_stage(spark, tmp_path):
    p = pack.publish(spark, f"file://{tmp_path}/p", documents(spark), chunks(spark))
    q = spark.createDataFrame([(1, "running cats", [1.0] * 64), (2, "nothing of it", None)], "query_id long, text string, vec array<float>")
    hits, report = retrieve.explained(q, p, TIERS[1], 0.0, 60)
    r = {x["query_id"]: x for x in report.collect()}
    assert r[1]["vector"] == 10 and r[1]["keyword"] > 0 and r[1]["fused"] >= r[1]["gated"] >= r[1]["returned"] >= r[1]["injected"] == len(r[1]["injected_ids"]) > 0
    assert (r[2]["vector"], r[2]["keyword"], r[2]["fused"], r[2]["injected"]) == (0, 0, 0, 0)
    assert {h["chunk_id"] for h in hits.collect() if h["injected"]} == set(r[1]["injected_ids"])


def test_quantiles_in_slices(spark):
    rng = np.random.default_rng(5)
    values = np.round(rng.standard_normal(3000), 2)
    df = spark.createDataFrame([("a" if i % 3 else "b", float(v)) for i, v in enumerate(values)] + [("c", 1.0), ("d", None)], "g string, v double")
    got = {r["g"]: r for r in evaluation.ranked_quantiles(df, "g", "v", {"p50": 0.5, "p95": 0.95}, ends=True).collect()}
    for g, pick in (("a", [v for i, v in enumerate(values) if i % 3]), ("b", list(values[::3])), ("c", [1.0])):
        s, n = sorted(pick), len(pick)
        assert got[g]["n"] == n and (got[g]["min"], got[g]["max"]) == (s[0], s[-1])
        for name, q in (("p50", 0.5), ("p95", 0.95)):
            assert got[g][f"near_{name}"] == s[max(1, int(np.ceil(q * n))) - 1] and got[g][f"floor_{name}"] == s[int((n - 1) * q)]
    assert set(got) == {"a", "b", "c"}


def test_file_names_by_parts(spark):
    # brute force: words up to an address, runs of name characters, the last dotted part that is an extension behind a stem with a letter
    t = "see a.test.js, src/x/y.py. docs.rs (lib/z.toml) https://e.org/q.rs 1.rs v1.2.3 www.h.com/a.md e.g. this; crates.io/k.rs é/ß.md -f.sh ..h a/b.yaml:12 x.json5 main.rs.bak"
    got = spark.createDataFrame([(t,), (None,), ("",)], "t string").select(transcripts.file_mentions(F.col("t")).alias("x")).collect()
    assert got[0]["x"] == sorted(["test.js", "src/x/y.py", "lib/z.toml", "f.sh", "a/b.yaml", "main.rs"]) and got[1]["x"] is None and got[2]["x"] == []


def test_distill_and_enrichment(spark):
    t = "## user (turn 1)\n\nhello\n[tool: Read x]\n\n## system (turn 2)\n\nhidden\n\n## assistant (turn 3)\n\n[result] y\nworld\n\n"
    r = spark.createDataFrame([(t,)], "t string").select(text.distill_input(F.col("t")).alias("x"), text.enriched(F.col("t"), F.lit(" ")).alias("y"), text.enriched(F.lit("b"), F.lit(" a ")).alias("z"), text.enrichment_prompt(F.lit(None), F.lit("q" * 5000)).alias("p")).first()
    assert "hello" in r["x"] and "world" in r["x"] and not re.search(r"hidden|tool:|result", r["x"]) and r["y"] == t and r["z"] == "a\n\nb" and r["p"].endswith("q…")


def test_html_content_and_refusal(spark, tmp_path):
    page = "<body><ul><li><a href=/a>More links</a></li></ul><article><h1>Top</h1><p>The text of the page is here, and it is long enough.</p></article><aside>Ad</aside></body>"
    rows = {r["url"]: r for r in files.html_documents(spark.createDataFrame([("u", page), ("big", "x" * 100), ("none", None)], "url string, html string"), most_bytes=len(page)).collect()}
    assert rows["u"]["text"] == "# Top\n\nThe text of the page is here, and it is long enough." and rows["u"]["refused"] is None and rows["none"]["text"] == ""
    refused = {r["url"]: r["refused"] for r in files.html_documents(spark.createDataFrame([("big", "x" * 100)], "url string, html string"), most_bytes=10).collect()}
    assert refused["big"].startswith("more than 10 bytes")
    assert files.load_one(spark, "https://e.org/p", page).first()["source_type"] == "web"
    (tmp_path / "n.md").write_text("---\ntitle: N\n---\nbody")
    assert files.load_one(spark, f"file://{tmp_path}/n.md").first()["title"] == "N"


def test_golden_sets_with_memory_cases(spark, tmp_path):
    (tmp_path / "g.toml").write_text('[[memory_case]]\nkind = "fact"\ntext = "t"\nqueries = ["q"]\nnegatives = ["n"]\n')
    body = files.golden_text(spark, str(tmp_path / "g.toml"))
    assert files.read_memory_cases(spark, body).first()["negatives"] == ["n"] and files.read_golden(spark, body).count() == 0
    with pytest.raises(ValueError):
        files.read_memory_cases(spark, '[[memory_case]]\nkind = "fact"\n')
    assert evaluation.corpus_view(None, "no pack") == "unavailable: no pack"


def test_scratch_is_cleaned(spark):
    kept, gone = runtime.through_table(spark.range(3), "kept"), runtime.through_table(spark.range(3), "gone")
    assert runtime.clean(spark, keep=("kept", "pack", "target", "checkpoint")) >= 1 and kept.count() == 3
    with pytest.raises(Exception):
        gone.select("id").collect()
    json.dumps(TIERS[0].efs)


def test_engine_and_command_line(spark, tmp_path, capsys):
    from marrowlake.__main__ import main
    from marrowlake.api import Engine

    documents(spark).write.parquet(f"{tmp_path}/documents.parquet")
    chunks(spark).write.parquet(f"{tmp_path}/chunks.parquet")
    path = f"file://{tmp_path}/p"
    assert main(["--pack", path, "index", f"{tmp_path}/documents.parquet", f"{tmp_path}/chunks.parquet"]) == [{"documents": 6, "chunks": 12, "vectors": 10, "version": 1, "model": "hash@64+none"}]
    found = main(["--pack", path, "search", "cat", "--surface", "hook"])
    assert {r["uri"] for r in found} == {f"file:///{i}.md" for i in (1, 3, 5)} and json.loads(capsys.readouterr().out.splitlines()[-1]) == found[-1]
    assert {r["chunk_id"] for r in main(["--pack", path, "related", "d0"])} == {"d0:1", "d1:0", "d2:0"}
    assert main(["--pack", path, "document", "d0"])[0]["chunk_ids"] == ["d0:0", "d0:1"] and main(["--pack", path, "document", "zz"]) == []
    e = Engine(spark, path)
    nodes, edges = e.graph()
    q = spark.createDataFrame([(1, "running cats", [1.0] * 64)], "query_id long, text string, vec array<float>")
    assert nodes.count() == 6 and edges.count() == 6 and e.explain(q)[1].count() == 1 and e.search(q, candidates=3, least=0.0).count() > 0
    with pytest.raises(KeyError, match="candidates"):
        e.search(q, candidats=3)
    m = spark.createDataFrame([("fact", "a text about caches", "T", None, 5), ("episode", "another one", "T", "p", 6)], "kind string, text string, title string, project string, created long")
    assert e.memories(m, kind="fact").count() == 1 and e.memories(m, contains="CACHE").count() == 1
