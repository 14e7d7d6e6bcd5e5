import hashlib
import random

import pytest
from pyspark.sql import functions as F

from marrowlake.functions import chunking, identity, text, weights
from marrowlake.functions.stem import porter, stems
from marrowlake.operators.evaluation import longest_run

PORTER = {
    "caresses": "caress", "ponies": "poni", "ties": "ti", "caress": "caress", "cats": "cat", "feed": "feed", "agreed": "agre", "plastered": "plaster", "bled": "bled", "motoring": "motor", "sing": "sing",
    "conflated": "conflat", "troubled": "troubl", "sized": "size", "hopping": "hop", "tanned": "tan", "falling": "fall", "hissing": "hiss", "fizzed": "fizz", "failing": "fail", "filing": "file",
    "happy": "happi", "sky": "sky", "relational": "relat", "conditional": "condit", "rational": "ration", "valenci": "valenc", "digitizer": "digit", "conformabli": "conform", "radicalli": "radic",
    "vileli": "vile", "analogousli": "analog", "vietnamization": "vietnam", "predication": "predic", "operator": "oper", "feudalism": "feudal", "decisiveness": "decis", "hopefulness": "hope",
    "callousness": "callous", "formaliti": "formal", "sensitiviti": "sensit", "sensibiliti": "sensibl", "triplicate": "triplic", "formative": "form", "formalize": "formal", "electriciti": "electr",
    "electrical": "electr", "hopeful": "hope", "goodness": "good", "revival": "reviv", "allowance": "allow", "inference": "infer", "airliner": "airlin", "adjustable": "adjust", "defensible": "defens",
    "irritant": "irrit", "replacement": "replac", "adjustment": "adjust", "dependent": "depend", "adoption": "adopt", "communism": "commun", "activate": "activ", "effective": "effect", "bowdlerize": "bowdler",
    "probate": "probat", "rate": "rate", "cease": "ceas", "controll": "control", "roll": "roll", "s": "",
}


@pytest.mark.parametrize("word,stem", PORTER.items())
def test_porter(word, stem):
    assert porter(word) == stem


def test_stems_drops_empty(spark):
    df = spark.createDataFrame([("cats",), ("s",), ("cats",), (None,)], "term string")
    assert [tuple(r) for r in stems(df).collect()] == [("cats", "cat")]


def one(spark, expr, schema, row):
    return spark.createDataFrame([row], schema).select(expr.alias("x")).first()["x"]


def test_identity(spark):
    uri = "file:///a.md"
    assert one(spark, identity.doc_id(F.col("u")), "u string", (uri,)) == hashlib.sha256(uri.encode()).hexdigest()[:32]
    assert one(spark, identity.memory_id(F.col("k"), F.col("t")), "k string, t string", ("fact", " x ")) == hashlib.sha256(b"fact|x").hexdigest()[:12]
    assert one(spark, identity.embed_text(F.col("a"), F.col("b"), F.col("c")), "a string, b string, c string", ("T", "H", "x")) == "T > H\n\nx"
    assert one(spark, identity.embed_text(F.col("a"), F.col("b"), F.col("c")), "a string, b string, c string", (None, None, "x")) == "\n\nx"


def test_tokens_keep_digits_and_tabs(spark):
    assert one(spark, text.tokens(F.col("t")), "t string", ("Foo-bar v2\tx, C:\\d!",)) == ["foo", "bar", "v2\tx", "c", "\\d"]
    assert one(spark, text.tokens(F.col("t")), "t string", ("",)) == []


def test_clip_lines_and_spans(spark):
    assert one(spark, text.clip_lines(F.col("t"), 7), "t string", ("abc\ndef\nghi",)) == "abc\ndef"
    assert one(spark, text.clip_lines(F.col("t"), 2), "t string", ("abc\ndef",)) == ""
    assert one(spark, text.strip_spans(F.col("t"), "hook"), "t string", ("a<hook-x y>b</hook-x>c<hook>d",)) == "ac"
    assert one(spark, text.summary_title(F.col("t")), "t string", ("  ",)) == "memory"
    assert one(spark, text.worth_retrieving(F.col("t")), "t string", ("one two three",)) is False
    assert one(spark, text.session_id(F.col("t")), "t string", ("rollout-x-" + "a" * 36,)) == "a" * 36


def test_weights_multiply(spark):
    w = weights.Weights(superseded=0.5)
    df = spark.createDataFrame([("transcript", 3, None, 0, None, None)], "source_type string, lifecycle int, last_used long, inbound int, kind string, created long")
    assert round(0.8 * df.select(weights.rank_weight(0, w).alias("x")).first()["x"], 6) == 0.18


def test_decay_floor_and_null(spark):
    w = weights.Weights(decay=True)
    now = 1_000_000_000
    df = spark.createDataFrame([("transcript", now - 86400 * 730), ("transcript", None), ("pdf", 0), ("transcript", now - 86400 * 190)], "s string, u long")
    got = [round(r["x"], 6) for r in df.select(weights.decay_weight(F.col("s"), F.col("u"), now, w).alias("x")).collect()]
    assert got == [0.1, 1.0, 1.0, 0.5]


def test_lifecycle(spark):
    df = spark.createDataFrame([(" Accepted", 0), ("draft", 0), ("draft", 2), ("superseded", 1), ("investigating", 0), (None, 0)], "s string, i int")
    assert [r["x"] for r in df.select(weights.lifecycle(F.col("s"), F.col("i")).alias("x")).collect()] == [0, 2, 1, 3, 1, 0]


def test_vectors(spark):
    df = spark.createDataFrame([([3.0, 4.0],), ([0.0, 0.0],), ([float("nan"), 1.0],), ([1.0],), (None,)], "v array<float>")
    assert [r["x"] for r in df.select(weights.usable_vector(F.col("v"), 2).alias("x")).collect()] == [True, False, False, False, False]
    assert one(spark, weights.fitted(F.col("v"), 3), "v array<float>", ([3.0, 4.0],)) == [0.6, 0.8, 0.0]
    assert one(spark, weights.l2_normalised(F.col("v")), "v array<float>", ([0.0, 0.0],)) == [0.0, 0.0]


def test_percentiles_differ(spark):
    v = [float(i) for i in range(1, 11)]
    assert one(spark, weights.nearest_rank(F.col("v"), 0.95), "v array<double>", (v,)) == 10.0
    assert one(spark, weights.floor_rank(F.col("v"), 0.95), "v array<double>", (v,)) == 9.0
    assert one(spark, weights.nearest_rank(F.col("v"), 0.5), "v array<double>", ([],)) is None


def brute_run(a, b):
    return max((n for i in range(len(a)) for j in range(len(b)) for n in range(1, min(len(a) - i, len(b) - j) + 1) if a[i : i + n] == b[j : j + n]), default=0)


def test_longest_run_against_brute_force(spark):
    rng = random.Random(4)
    rows = [([rng.choice("abc") for _ in range(rng.randrange(7))], [rng.choice("abc") for _ in range(rng.randrange(7))]) for _ in range(60)]
    got = [r["x"] for r in spark.createDataFrame(rows, "a array<string>, b array<string>").select(longest_run(F.col("a"), F.col("b")).alias("x")).collect()]
    assert got == [brute_run(a, b) for a, b in rows]


def test_split_covers_text_without_overlap():
    rng = random.Random(1)
    for _ in range(50):
        t = "\n\n".join(rng.choice(["# H", "word " * rng.randrange(1, 900), "x" * rng.randrange(1, 5000), "- a\n- b"]) for _ in range(rng.randrange(1, 9)))
        parts = chunking.split(t)
        end = 0
        for a, c in parts:
            assert a >= end and t[a : a + len(c)] == c and len(c) <= chunking.MOST
            assert not t[end:a].strip()
            end = a + len(c)
        assert not t[end:].strip()
    assert chunking.split("") == [] and chunking.split(" \n ") == []


def test_heading_paths():
    t = "# A\n\n## B\n\ntext\n\nSet\n---\n\nmore\n\n### C\n\nend\n\n```\n# no\n```\n"
    at = [t.index("text"), t.index("more"), t.index("end"), 0]
    assert chunking.heading_paths(t, at) == ["B", "Set", "Set > C", ""]
    assert chunking.is_heading_only("# A\n\nB\n===\n") and not chunking.is_heading_only("# A\nx")
    assert chunking.content_start("# A\n\nB\n---\nxy") == len("# A\n\nB\n---\n")


def test_markdown_expressions(spark):
    md = "a [[One]] `[[no]]` [[ Two |x]] [[Three#s]]\n```\n[[no]]\n```\n[[One]]"
    assert one(spark, chunking.wikilinks(F.col("t")), "t string", (md,)) == ["One", "Two", "Three", "One"]
    assert one(spark, chunking.without_frontmatter(F.col("t")), "t string", ("---\na: b\n---\nx",)) == "x"
    assert one(spark, chunking.without_frontmatter(F.col("t")), "t string", ("---\na: b\nx",)) == "---\na: b\nx"
    assert one(spark, chunking.first_heading(F.col("t")), "t string", ("x\n```\n# no\n```\n## Yes ##\n",)) == "Yes"
    assert one(spark, chunking.first_heading(F.col("t")), "t string", ("none",)) is None


def test_chunked_ids_and_empty_texts(spark):
    df = spark.createDataFrame([("d1", "T", "# H\n\n" + "word " * 700), ("d2", None, None), ("d3", "T", ""), ("d4", "T", "# only")], "id string, title string, text string")
    rows = chunking.chunked(df).orderBy("id").collect()
    assert {r["doc"] for r in rows} == {"d1"} and [r["ord"] for r in rows] == list(range(len(rows)))
    assert rows[0]["id"] == "d1:0" and rows[0]["embed_text"].startswith("T\n\n")
