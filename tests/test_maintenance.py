import datetime as dt
import json
import os

import pytest
from pyspark.sql import functions as F

from marrowlake.operators import evaluation, index, memory, usage
from marrowlake.operators.incremental import IncrementalTarget, replay_runs
from marrowlake.sources import files, pages, transcripts
from marrowlake.streaming import sessions


def kv(spark, rows):
    return spark.createDataFrame(rows, "k string, v string")


def test_incremental_target_skips_and_survives(spark, tmp_path):
    t = IncrementalTarget(spark, f"file://{tmp_path}/t")
    assert t.rows() is None and t.manifest()["version"] == 0
    t.advance("1", kv(spark, [("a", "1"), ("b", "1"), (None, "1"), ("c", None)]), "k", "v")
    with pytest.raises(Exception):
        t.advance("2", kv(spark, [("a", "2")]), "k", "v", lambda rows: rows.select(F.raise_error(F.lit("x")).alias("k"), "v"))
    assert t.manifest()["version"] == 1  # the failed batch is not part of the target
    t.advance("2", kv(spark, [("a", "2"), ("b", "1")]), "k", "v")
    assert t.advance("2", kv(spark, [("z", "9")]), "k", "v") is None  # published before
    assert sorted((r["k"], r["v"], r["_batch"]) for r in t.rows().collect()) == [("a", "1", "1"), ("a", "2", "2"), ("b", "1", "1")]
    t.advance("3", kv(spark, [("a", "1")]), "k", "v")  # back to an old version is a change
    assert {r["k"]: r["v"] for r in t.state("k", "v").collect()} == {"a": "1", "b": "1"}
    now = t.manifest()
    with pytest.raises(RuntimeError):
        t._publish({"version": now["version"], "batches": {}})


def test_replay_runs(spark, tmp_path):
    at = lambda m: dt.datetime(2026, 1, 1, 0, m)
    rows = [
        (1, "a", "X ", "s", at(0)), (1, "b", "1", "s", at(0)), (1, "n", None, "s", at(0)),
        (2, "a", "y", "s", at(1)),
        (3, "a", "x", "s", at(2)), (3, "b", "1", "s", at(2)), (3, "b", "2", "s", at(3)), (3, "n", "n1", "s", at(2)), (3, "c", "", "s", at(2)),
        (4, "b", "2", "s", at(4)), (4, "a", None, "s", at(4)), (4, None, "q", "s", at(4)),
    ]
    scans = spark.createDataFrame(rows, "run_id long, uri string, content_hash string, stamp string, seen_at timestamp")
    runs = spark.createDataFrame([(1, "ok"), (2, "failed"), (3, " OK"), (4, "ok"), (None, "ok")], "run_id long, status string")
    got = replay_runs(scans, runs, IncrementalTarget(spark, f"file://{tmp_path}/r"))
    assert sorted((r["run_id"], r["uri"]) for r in got.collect()) == [(3, "b"), (3, "n")]
    assert replay_runs(scans, runs.limit(0), IncrementalTarget(spark, f"file://{tmp_path}/e")).count() == 0


def test_chunk_delta(spark):
    old = spark.createDataFrame([("1", "a"), ("2", "b"), ("3", "c")], "id string, embed_hash string")
    new = spark.createDataFrame([("1", "a"), ("2", "x"), ("4", "d")], "id string, embed_hash string")
    assert {r["id"]: r["action"] for r in index.chunk_delta(old, new).collect()} == {"1": "kept", "2": "changed", "3": "deleted", "4": "inserted"}
    assert tuple(index.delta_counts(index.chunk_delta(old, new)).first()) == (2, 2, 1)


def test_embedding_plan_requests_each_text_once(spark):
    old = spark.createDataFrame([("h1", [1.0])], "embed_hash string, embedding array<float>")
    new = spark.createDataFrame([("1", "h1", "A"), ("2", "h2", "B"), ("3", "h2", "B")], "id string, embed_hash string, embed_text string").withColumn("embedding", F.lit(None).cast("array<float>"))
    have, need = index.embedding_plan(old, new)
    assert [r["id"] for r in have.collect()] == ["1"] and [r["embed_hash"] for r in need.collect()] == ["h2"]


def test_prune_refuses_to_empty(spark):
    docs = spark.createDataFrame([("file:///a",), ("https://x/b",), ("memory://c",)], "uri string")
    live = spark.createDataFrame([("file:///z",)], "uri string")
    assert [r["uri"] for r in index.prunable(docs, live).collect()] == ["file:///a"]
    with pytest.raises(ValueError):
        index.prunable(docs, live.limit(0))


def test_pack_refuses_mixed_and_stale(spark, tmp_path):
    rows = spark.createDataFrame([("b", [1.0]), ("a", [2.0])], "id string, embedding array<float>")
    index.build_pack(rows, str(tmp_path / "p"), "m@1+none", 1)
    assert index.record(index.open_pack(spark, str(tmp_path / "p"), "m@1+none", 1), "a").count() == 1
    with pytest.raises(ValueError):
        index.open_pack(spark, str(tmp_path / "p"), "other", 1)
    with pytest.raises(ValueError):
        index.build_pack(rows.unionByName(rows.withColumn("embedding", F.lit(None).cast("array<float>"))), str(tmp_path / "q"), "m", 1)


def test_roots_and_retention(spark):
    assert index.distinct_roots(["/a/b", "/a", "/a/", "/ab"]) == ["/a", "/ab"]
    g = spark.createDataFrame([(i, [f"h{i}", "x"]) for i in range(1, 6)], "generation int, hashes array<string>")
    kept = index.generations_kept(g, 0, "2")
    assert sorted(r[0] for r in kept.collect()) == [2, 5]
    blobs = spark.createDataFrame([(h,) for h in ("h1", "h2", "h5", "x", "y")], "hash string")
    assert sorted(r[0] for r in index.blobs_to_delete(blobs, g, kept).collect()) == ["h1", "y"]


def test_usage(spark):
    lines = spark.createDataFrame([("10 a",), ("5 a",), ("x b",), ("7",), ("8 b c",), (" 9 b ",)], "value string")
    got = {r["doc_id"]: (r["first_seen"], r["last_used"]) for r in usage.folded(usage.parse_log(lines)).collect()}
    assert got == {"a": (5, 10), "b": (9, 9)}


def test_usage_stream_and_quiet_sessions(spark, tmp_path):
    log = tmp_path / "log"
    log.mkdir()
    (log / "1.usage").write_text("10 a\n5 b\n")
    seen = {}

    def write(df, n):
        seen.update({r["doc_id"]: (r["first_seen"], r["last_used"]) for r in df.collect()})

    for text in (None, "3 a\n20 b\nbroken\n"):
        if text:
            (log / "2.usage").write_text(text)
        sessions.run_into(sessions.usage_stream(spark, str(log)), str(tmp_path / "cp"), write).awaitTermination()
    assert seen == {"a": (3, 10), "b": (5, 20)}

    at = lambda h, m: dt.datetime(2026, 1, 1, h, m)
    ev = [(1, at(0, 0)), (1, at(0, 5)), (1, at(1, 0)), (2, at(0, 1)), (2, at(9, 0))]
    src = tmp_path / "ev"
    spark.createDataFrame(ev, "user_id int, ts timestamp").coalesce(1).write.parquet(str(src))
    batch = {(r["user_id"], r["started"], r["events"]) for r in sessions.quiet_sessions(spark.read.parquet(str(src))).collect()}
    assert (1, at(0, 0), 2) in batch and len(batch) == 4
    out = []
    stream = sessions.quiet_sessions(spark.readStream.schema("user_id int, ts timestamp").parquet(str(src)))
    sessions.run_into(stream, str(tmp_path / "cp2"), lambda df, n: out.extend((r["user_id"], r["started"], r["events"]) for r in df.collect()), "append").awaitTermination()
    assert set(out) <= batch and (1, at(0, 0), 2) in out  # the last session is still open


def test_recall_counts_distinct_uris(spark):
    ranked = spark.createDataFrame([(1, "a", 1, 0.9), (1, "a", 2, 0.8), (1, "b", 3, 0.7), (2, "c", 1, 0.5)], "case_id int, uri string, position int, relevance double")
    exp = spark.createDataFrame([(1, "b"), (2, "z"), (3, "q")], "case_id int, uri string")
    assert tuple(evaluation.recall_at(ranked, exp, 2).first()) == (3, 1 / 3)
    assert evaluation.recall_at(ranked, exp, 1).first()["recall"] == 0
    assert evaluation.recall_gated(ranked, exp, 2, 0.75).first()["recall"] == 0
    assert tuple(evaluation.recall_at(ranked, exp.limit(0), 2).first()) == (0, 0.0)


def test_recommendation(spark):
    neg = spark.range(5)
    hits = lambda rows: spark.createDataFrame(rows, "class string, relevance double")
    r = evaluation.recommendation(hits([("answer", 0.8), ("negative", 0.6)]), neg).first()
    assert r["kind"] == "calibrated" and abs(r["threshold"] - 0.7) < 1e-9
    assert evaluation.recommendation(hits([("answer", 0.5), ("negative", 0.6)]), neg).first()["kind"] == "overlapping"
    assert evaluation.recommendation(hits([("answer", 0.5)]), neg).first()["kind"] == "too_few_negatives"


def test_golden(spark):
    toml = '[[case]]\nquery = "Connection pooling in postgres"\nexpect = "u/a"\n[[case]]\nquery = " connection POOLING in postgres "\nexpect_any = ["u/b"]\n[[case]]\nquery = "x"\nexpect_none = true\n'
    cases = files.read_golden(spark, toml)
    docs = spark.createDataFrame([("u/a", "Postgres connection pooling")], "uri string, title string")
    exp = cases.select("case_id", F.explode("acceptable").alias("uri"))
    got = {(r["check"], r["detail"]) for r in evaluation.golden_report(cases, docs, exp).collect()}
    assert got == {("duplicate", "connection pooling in postgres"), ("missing", "u/b"), ("echo", "1 u/a"), ("few negatives", "1")}
    bad = '[[case]]\nquery = ""\n[[case]]\nquery = "q"\nexpect_none = true\nexpect = "u"\n'
    with pytest.raises(ValueError):
        files.read_golden(spark, bad)
    assert {(r["case_id"], r["fault"]) for r in evaluation.faulty_cases(files.read_golden(spark, bad, strict=False)).collect()} == {(1, "blank"), (1, "unnamed"), (2, "contradictory")}


def test_comparability(spark):
    s = "golden_sha256 string, cases int, documents int, chunks int, memories int, no_graph boolean"
    a, b = spark.createDataFrame([("h", 3, 10, 20, None, None)], s), spark.createDataFrame([("h", 4, 10, None, 2, False)], s)
    assert {r["change"] for r in evaluation.comparability(a, b).collect()} == {"cases", "corpus_unknown"}
    assert evaluation.comparability(a, a).count() == 0


def test_memories(spark):
    inc = spark.createDataFrame([(1, "fact", "short", "user", 0), (2, "fact", "long enough text", "claude", 10), (3, "fact", "long enough text", "user", 0), (4, "episode", "another long text", "user", 0), (5, "fact", "a third long text", "user", 0), (6, "fact", "known long text", "user", 0)], "seq int, kind string, text string, origin string, confidence int")
    known = memory.memory_id(F.lit("fact"), F.lit("known long text"))
    stored = spark.range(1).select(known.alias("id"), F.lit("known long text").alias("text"))
    near = spark.createDataFrame([(4, "m1"), (5, "m2")], "seq int, of string")
    assert {r["seq"]: r["outcome"] for r in memory.remembered(inc, stored, near).collect()} == {1: "rejected", 2: "rejected", 3: "saved", 4: "duplicate", 5: "replaced", 6: "duplicate"}
    m = spark.createDataFrame([("a", "episode", 1), ("b", "episode", 2), ("c", "lesson", 0)], "id string, kind string, created long")
    assert [r["id"] for r in memory.evicted(m, 2).collect()] == ["a"] and memory.evicted(m, 0).count() == 2
    p = spark.createDataFrame([("a",), ("",), ("zz",)], "prefix string")
    assert {r["prefix"]: r["status"] for r in memory.resolved_prefix(m, p).collect()} == {"a": "found", "": "ambiguous", "zz": "not_found"}
    full = spark.createDataFrame([("lesson", "b text of it", "t", None, 2), ("fact", "a text of it", "t", "/p", 1)], "kind string, text string, title string, project string, created long")
    lines = memory.exported(full)
    assert json.loads(lines.first()["value"])["text"] == "a text of it"
    assert memory.imported(lines.union(lines).union(spark.createDataFrame([("{no",)], "value string")), spark.createDataFrame([], "id string")).count() == 2


def test_flatten(spark):
    items = [{"type": "text", "text": "hello"}, {"type": "thinking", "thinking": "no"}, {"type": "tool_use", "name": "Read", "input": {"path": "a.py"}}, {"type": "tool_result", "content": [{"type": "text", "text": "x" * 700}]}, {"type": "tool_result", "content": " "}]
    df = spark.createDataFrame([(json.dumps(items),), ("plain",), ("[wip] note",), (None,)], "c string")
    got = [r["x"] for r in df.select(transcripts.flattened(F.col("c")).alias("x")).collect()]
    assert got == ["hello\n[tool: Read a.py]\n[result] " + "x" * 600 + "…", "plain", "[wip] note", None]


def test_file_mentions(spark):
    t = "src/db/pool.rs and 1.rs, version 1.2.3, main.go, config.toml, https://example.com/index.js, Cargo.lock, docs.rs, README.md, main.go"
    assert spark.createDataFrame([(t,)], "t string").select(transcripts.file_mentions(F.col("t")).alias("x")).first()["x"] == ["Cargo.lock", "README.md", "config.toml", "main.go", "src/db/pool.rs"]


def test_codex_sessions(spark, tmp_path):
    ev = [
        {"type": "session_meta", "timestamp": "t0", "payload": {"id": "12345678-x", "cwd": "/w/app", "timestamp": "t1"}},
        {"type": "response_item", "payload": {"type": "message", "role": "developer", "content": [{"type": "input_text", "text": "rules"}]}},
        {"type": "response_item", "payload": {"type": "message", "role": "user", "content": [{"type": "input_text", "text": "<ctx>a</ctx>"}, {"type": "input_text", "text": "fix main.go"}]}},
        {"type": "response_item", "payload": {"type": "reasoning", "content": "hm"}},
        {"type": "response_item", "payload": {"type": "function_call", "name": "shell", "arguments": json.dumps({"command": ["bash", "-lc", "ls src"]})}},
        {"type": "response_item", "payload": {"type": "function_call_output", "output": json.dumps({"output": "ok"})}},
        {"type": "response_item", "payload": {"type": "message", "role": "assistant", "content": [{"type": "output_text", "text": "done"}]}},
        {"type": "response_item", "payload": {"type": "custom_tool_call", "name": "patch", "input": "*** Begin\n*** Update File: a.py\n"}},
    ]
    (tmp_path / "rollout-1.jsonl").write_text("\n".join([*map(json.dumps, ev), "{broken", ""]))
    lines = transcripts.read_lines(spark, str(tmp_path))
    assert transcripts.sniffed(lines).first()["agent"] == "codex"
    d = transcripts.codex_documents(lines).first()
    assert d["title"] == "app codex session (12345678)" and d["started"] == "t1" and d["files"] == ["a.py", "main.go"]
    assert d["text"] == "## user (turn 1)\n\nfix main.go\n\n## assistant (turn 2)\n\n[tool: shell ls src]\n[result] ok\n\n## assistant (turn 3)\n\ndone\n[tool: patch a.py]\n\n"


def test_session_files(spark, tmp_path):
    rows = [{"type": "user", "cwd": "/w/app", "timestamp": "t1", "message": {"role": "user", "content": "hi"}}, {"message": {"role": "assistant", "content": [{"type": "text", "text": "yo"}]}}, {"message": {"role": "user", "content": " "}}]
    (tmp_path / "sess1234abcd.jsonl").write_text("\n".join([*map(json.dumps, rows), "nope"]))
    d = transcripts.read_sessions(spark, str(tmp_path)).first()
    assert d["title"] == "app session (sess1234)" and d["turns"] == 2 and d["text"] == "## user (turn 1)\n\nhi\n\n## assistant (turn 2)\n\nyo\n\n"


def test_markdown_vault(spark, tmp_path):
    (tmp_path / "_templates").mkdir()
    (tmp_path / "_templates" / "t.md").write_text("# no")
    (tmp_path / "a.md").write_text("---\ntitle: My Note\ntags: [db, x]\nstatus: draft\nsuperseded-by: ADR-2\n---\n# H\n[[b]]\n")
    (tmp_path / "b.md").write_text("---\ntitle:\n---\n# Head\ntext")
    (tmp_path / "c.md").write_text("plain")
    d = {os.path.basename(r["uri"]): r for r in files.markdown_documents(files.listing(spark, [str(tmp_path), str(tmp_path / "_templates")])).collect()}
    assert d["a.md"]["title"] == "My Note" and d["a.md"]["tags"] == ["db", "x"] and d["a.md"]["links"] == ["b"] and json.loads(d["a.md"]["meta"]) == {"status": "draft", "superseded_by": "ADR-2"}
    assert d["b.md"]["title"] == "Head" and d["b.md"]["text"] == "# Head\ntext" and d["c.md"]["title"] == "c" and len(d) == 3
    with pytest.raises(Exception):
        files.listing(spark, [str(tmp_path / "missing")]).count()


def test_html(spark):
    h = "<html><head><title> A  page </title><script>x</script></head><body><nav>menu</nav><h1>Top</h1><p>Some &amp; text</p><ul><li>one<li>two</ul><pre>a\n b</pre></body></html>"
    rows = files.html_documents(spark.createDataFrame([("https://ex.org/p", h), ("https://ex.org/q", ""), ("bad url", None)], "url string, html string")).collect()
    assert rows[0]["title"] == "A page" and rows[0]["text"].startswith("# Top\n\nSome & text\n\n- one\n- two") and "menu" not in rows[0]["text"] and rows[0]["domain"] == "ex.org"
    assert rows[1]["title"] == "https://ex.org/q"


def test_audit(spark):
    line = json.dumps({"a": [{"type": "hook_additional_context", "content": ["[T](file:///x)", "text", "[U](https://y)"]}], "b": {"type": "hook_additional_context", "content": "none"}})
    lines = spark.createDataFrame([("p", 0, line), ("p", 1, "{broken")], "path string, line int, value string")
    assert {r["scheme"]: r["n"] for r in files.audit(files.injections(lines)).collect()} == {"file": 1, "https": 1, "without file": 1}


def test_pages(spark):
    df = spark.createDataFrame([(1, 1, "ab", True), (1, 1, "ab", True), (1, 3, "é", None), (1, 2, " ", False), (2, 1, None, None)], "doc_id long, number int, markdown string, ocr boolean")
    r = pages.assembled(df).first()
    assert r["text"] == "ab\n\né\n\n" and [(p["page"], p["offset"]) for p in r["pages"]] == [(1, 0), (3, 4)]
    at = lambda o: pages.assembled(df).select(pages.page_at(F.col("pages"), F.lit(o)).alias("x")).first()["x"]
    assert (at(3), at(4), at(-1)) == (1, 3, None)


def test_synthetic(spark):
    a = files.synthetic_corpus(spark, 5)
    assert a.exceptAll(files.synthetic_corpus(spark, 5)).count() == 0
    per = a.groupBy("doc").count().collect()
    assert len(per) == 5 and all(5 <= r["count"] <= 60 for r in per)
