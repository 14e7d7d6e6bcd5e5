import itertools
import random

import pytest
from pyspark.sql import functions as F

from marrowlake.llm import markup, ocr, toxicity

CASES = {
    "plain": ("Compare a == b before R&D signs off on [[x-notes|the x notes]] and [[y]].", False),
    "autolink": ("Source: <https://a.example/1> here", False),
    "generic": ("The type is `Vec<String>` or Option<u32>, Map<String, Vec<u8>> and 149 < limit but limit > 3.", False),
    "path": ("Paths like C:\\temp\\new and $HOME/x are left alone.", False),
    "fence": ("```py\nif a <b> c: return '''x'''\n# == 7 ==\n```", False),
    "open fence": ("```html\n<div>{{x}}", False),
    "tick": ("write `<b>` and `{{x}}` and ``a ` <i>``", False),
    "math": ("Formula: $r_k = \\frac{h}{15} + \\alpha$ for each", False),
    "display": ("$$\n\\sum_k \\frac{1}{1 + k}\n$$", False),
    "markdown": ("# H\n\n- *a* **b** [c](https://d)\n\n| a | b |\n|---|---|\n\n> q", False),
    "tag": ("a <span style=\"x\">b", True),
    "upper tag": ("<P ALIGN=left>x</P>", True),
    "sub": ("n<sup>2</sup>", True),
    "br": ("a<br/>b", True),
    "comment": ("a <!-- b --> c", True),
    "entity": ("a&nbsp;b", True),
    "numeric": ("a&#8217;b", True),
    "template": ("{{nowrap|x}} y", True),
    "bold": ("'''Owner''' of", True),
    "italic": ("a ''b'' c", True),
    "wiki heading": ("== Head ==\ntext", True),
    "category": ("[[Category:x]]", True),
    "file": ("[[File:x.png|thumb|y]]", True),
    "external": ("[https://x.example/1 name]", True),
    "magic": ("__TOC__", True),
    "wiki table": ("{|\n|-\n| a || 1\n|}", True),
    "emph": ("a \\emph{b} c", True),
    "cite": ("(see Section~\\ref{sec:a} and \\cite{b})", True),
    "env": ("\\begin{itemize}\n\\item a\n\\end{itemize}", True),
    "inline latex": ("About \\(n_{q}\\) stay", True),
    "display latex": ("x \\[ h \\leq 9 \\] y", True),
    "empty": ("", False),
    "null": (None, False),
}


@pytest.mark.parametrize("name", CASES)
def test_residue(name):
    text, want = CASES[name]
    assert markup.needs_cleaning(text) is want


def test_clean():
    html = "<h2>Top</h2>\n<ul>\n<li>one</li>\n<LI>two &amp; <b>three</b></LI>\n</ul>\n<pre><code class=\"x\">\ny &lt; z\n</code></pre>\n<script>bad()</script><a href=\"/u\">link</a>"
    out = markup.clean(html)
    assert "## Top" in out and "- one" in out and "- two & **three**" in out and "```\n\ny < z\n\n```" in out.replace("`\n", "`\n") and "bad" not in out and "[link](/u)" in out
    assert markup.clean("== H ==\n'''a''' ''b'' {{nowrap|c}} {{Infobox|x=1}}[[Category:z]]") == "## H\n**a** *b* c"
    assert markup.clean("\\section{A}\\label{s}\nB \\emph{c} \\(x\\) 20\\% \\cite{d}") == "# A\n\nB *c* $x$ 20%"
    assert markup.clean("plain $a$ `<b>`") == "plain $a$ `<b>`"


def test_min_cut_against_enumeration():
    rng = random.Random(9)
    for _ in range(150):
        n = rng.randrange(1, 8)
        costs = [(rng.randrange(9), rng.randrange(9)) for _ in range(n)]
        edges = [(rng.randrange(n), rng.randrange(n), rng.randrange(5)) for _ in range(rng.randrange(8))]
        edges = [e for e in edges if e[0] != e[1]]
        cost = lambda lab: sum(c[x] for c, x in zip(costs, lab)) + sum(w for i, j, w in edges if lab[i] != lab[j])
        assert cost([int(x) for x in markup.min_cut(costs, edges)]) == min(map(cost, itertools.product((0, 1), repeat=n)))


def test_clean_markup_frame(spark):
    df = spark.createDataFrame([(1, "a<br>b", "x"), (2, None, "y"), (3, "", None), (4, "z" * 100_000, "w")], "doc_id long, text string, residue string")
    got = {r["doc_id"]: r for r in markup.clean_markup(df, keep=["doc_id"]).collect()}
    assert (got[1]["residue"], got[1]["clean"]) == (1, "a\nb") and got[2]["clean"] is None and got[3]["clean"] == "" and len(got[4]["clean"]) == 100_000
    assert markup.clean_markup(df.limit(0), keep=["doc_id"]).count() == 0


def corpus(spark):
    body = "The review asked for a second copy of the report and the change was merged before noon on that day."
    rows = [(d, p, f"{body} {body}\n\nMore of the report was read on that day.", False) for d in range(1, 21) for p in (1, 2)]
    rows += [
        (50, 1, "Handbook of Things\n\nThe report was read.\n\n12", True), (50, 2, "Handb0ok of Thin9s\n\nThe change was merged.", True), (50, 3, "The report was read.", True),
        (51, 1, "The sec-\nond copy was read.", True), (51, 2, "The rep¬\nort was read.", None), (51, 3, "The re\u00ad\nview was read.", None), (51, 4, "alias x:\n10\n6\n367", None), (51, 5, "The second copy was read.", True),
        (52, 1, "The rcport was read on tbat day.", True), (52, 2, "The r¢port was read on tha† day.", True), (52, 3, "`rcport` and https://x.y/rep0rt are code.", True), (52, 4, "xii", True), (52, 5, "Page 3 of 9\n\nThe report was read.", True),
        (52, 5, "Page 3 of 9\n\nThe report was read.", True), (53, 1, None, None), (53, 2, "  ", None), (54, 1, "## Second\n\nThe report.", True), (54, 2, "## Second\n\nThe change.", True),
    ]
    return spark.createDataFrame(rows, "doc_id long, number int, markdown string, ocr boolean")


def test_pages_to_repair(spark):
    got = {(r["doc_id"], r["number"]) for r in ocr.pages_to_repair(corpus(spark)).collect()}
    assert got == {(50, 1), (50, 2), (51, 1), (51, 2), (51, 3), (52, 1), (52, 2), (52, 4), (52, 5)}
    assert ocr.pages_to_repair(corpus(spark).limit(0)).count() == 0


def test_repaired_pages(spark):
    got = {}
    for r in ocr.repaired_pages(corpus(spark)).orderBy("doc_id", "number", "k").collect():
        got.setdefault((r["doc_id"], r["number"]), []).append(r["text"])
    assert got[50, 1] == ["The report was read."] and got[50, 2] == ["The change was merged."]
    assert got[51, 1] == ["The second copy was read."] and got[51, 2] == ["The report was read."] and got[51, 4] == ["alias x:\n10\n6\n367"]
    assert got[52, 1] == ["The report was read on that day."] == got[52, 2]
    assert got[52, 3] == ["`rcport` and https://x.y/rep0rt are code."] and (52, 4) not in got and (53, 1) not in got


def test_viterbi_uses_the_line():
    doubts = [{"position": 1, "n": 3, "states": [{"was": "her", "n_was": 500, "logp": -4.0}]}]
    with_pair = {("to", "ber"): (3, 900), ("to", "her"): (0, 900), ("ber", "now"): (3, 3), ("her", "now"): (0, 500)}
    assert ocr.viterbi(["to", "ber", "now"], doubts, with_pair, 100_000) == []
    doubts[0]["n"] = 1
    seen_once = {("to", "ber"): (1, 900), ("to", "her"): (90, 900), ("ber", "now"): (1, 1), ("her", "now"): (20, 500)}
    assert ocr.viterbi(["to", "ber", "now"], doubts, seen_once, 100_000) == [(1, "her")]


def test_page_numbers(spark):
    yes = ["12", "- 12 -", "[28]", "xii", "XLIV", "Page 13 of 72", "14/72", "Seite 3", "p. 4", "1O"]
    no = ["Chapter", "alias x:", "12 apples", "mix", "2026 was a year", "civil", ""]
    df = spark.createDataFrame([(t,) for t in yes + no], "t string").select("t", ocr.is_page_number(F.col("t")).alias("x"))
    assert [r["t"] for r in df.collect() if r["x"]] == yes


def model():
    good = ["The report was read by the group today.", "We merged the change because of a full disk.", "The word filter blocks terms such as idiot and moron."]
    bad = ["You are a worthless idiot and nobody wants you.", "Shut your mouth, you pathetic moron.", "What a disgusting loser you are."]
    rng = random.Random(1)
    rows = []
    for i in range(240):
        t = [rng.choice(good) for _ in range(5)]
        if i % 4 == 0:
            t.insert(rng.randrange(5), rng.choice(bad))
        rows.append((" ".join(t), float(i % 4 == 0) if i % 37 else 0.5))
    words = " ".join(good * 20 + bad).lower().replace(".", "").replace(",", "").split()
    counts: dict[str, int] = {}
    for w in set(words):
        s = "^" * (toxicity.ORDER - 1) + w + "$"
        for i in range(toxicity.ORDER, len(s) + 1):
            for k in range(1, toxicity.ORDER + 1):
                counts[s[i - k : i]] = counts.get(s[i - k : i], 0) + 1
    corpus = {w: words.count(w) * 20 for w in set(words)}
    return toxicity.fit(rows, toxicity.CharModel(counts), corpus, 1200)


def test_toxicity_learns_and_restores():
    m = model()
    bad = ["You are a worthless idiot and nobody wants you.", "SHUT YOUR MOUTH, YOU PATHETIC MORON.", "Shut your mouth, you p a t h e t i c m0r0n.", "What a d.i.s.g.u.s.t.i.n.g l*ser you are.", "You are a worthless idiiiiot."]
    for t in bad:
        assert m.document(f"The report was read. {t} It is late.")[0] >= toxicity.THRESHOLD, t
    for t in ["The word filter blocks terms such as idiot and moron.", "We merged the change.", "`you worthless idiot`", "", None, "x" * 200_000]:
        assert m.document(t)[0] < toxicity.THRESHOLD, t


def test_decode():
    m = model()
    known = frozenset({"idiot", "moron", "loser"})
    assert toxicity.restore("an 1d10t, a m o r o n, l.o.s.e.r, l*ser, looooser and v2 p95", m.chars, known) == "an idiot, a moron, loser, loser, loser and v2 p95"


def test_toxicity_frame(spark):
    df = spark.createDataFrame([(1, "You are a worthless idiot and nobody wants you.", " A"), (2, None, "a"), (3, "", None)], "doc_id long, text string, source string")
    got = toxicity.toxicity(df, model(), ["doc_id", "source"])
    assert {r["doc_id"] for r in got.filter(F.col("toxicity") >= toxicity.THRESHOLD).collect()} == {1}
    rates = {r["source"]: (r["documents"], r["flagged"]) for r in toxicity.toxicity_rates(got).collect()}
    assert rates == {"a": (2, 1), None: (1, 0)}
    labels = spark.createDataFrame([(1, "r1", 1, "abusive", None), (1, "r1", 1, "abusive", None), (2, "r2", 0, None, None), (None, "r", 1, None, None)], "doc_id long, rater string, toxic int, category string, rated_at timestamp")
    assert toxicity.judged(df, labels) == [("You are a worthless idiot and nobody wants you.", 1.0)]
    assert toxicity.train(df.limit(0), labels.limit(0)).document("you fucking worthless idiot")[0] >= toxicity.THRESHOLD


def untaught():
    return toxicity.fit([], toxicity.CharModel({}), {}, 0)


@pytest.mark.parametrize("word", ["1d10t", "a55hole", "pu55y", "bi+ch", "m€rde", "i·d·i·o·t", "i d i o t", "i  d  i  o  t", "nud3", "IDIOOOT", "1d1ot", "sal@ud idi0t"])
def test_every_masked_form_alone_is_decoded(word):
    m = untaught()
    for t in (word, f"The report was read. What an {word}, they said.", f"`code` {word}"):
        assert m.document(t)[0] > 0, t


def test_no_masked_form_passes_the_gate():
    rng = random.Random(3)
    for _ in range(20_000):
        t = "".join(rng.choice("abIé·€œя  .-_*@$!+1059²") for _ in range(rng.randrange(3, 14)))
        if any(r.search(t) for r in (toxicity.SPACED, toxicity.SIGNED, toxicity.REPEATED)):
            assert toxicity.may_be_masked(t), t


def spelt(words):
    """A character model of these words, each counted n times."""
    counts: dict[str, int] = {}
    for w, n in words.items():
        s = "^" * (toxicity.ORDER - 1) + w + "$"
        for i in range(toxicity.ORDER, len(s) + 1):
            for k in range(1, toxicity.ORDER + 1):
                counts[s[i - k : i]] = counts.get(s[i - k : i], 0) + n
    return toxicity.CharModel(counts)


@pytest.mark.parametrize("masked, word", [("f**k", "fuck"), ("b***h", "bitch"), ("c**t", "cunt"), ("w****r", "wanker"), ("a*******h", "arschloch")])
def test_rare_words_survive_many_wildcards(masked, word):
    common = {a + b + c + "er": 500 for a in "fbcwa" for b in "aeiourl" for c in "nrstl"}
    assert toxicity.restore(f"you {masked} there", spelt(common), frozenset({word, "moron"})) == f"you {word} there"


def test_decode_against_enumeration():
    rng = random.Random(5)
    chars = spelt({"abba": 9, "bab": 3, "caab": 1})
    for _ in range(300):
        known = frozenset("".join(rng.choice("abc") for _ in range(rng.randrange(2, 6))) for _ in range(6))
        lattice = [rng.choice([["a"], ["b", ""], ["a", "b", "c"], ["c", "a", ""]]) for _ in range(rng.randrange(3, 7))]
        score = lambda path: sum(chars.log_p(("^" * 3 + "".join(path) + "$")[i - 3 : i], ("^" * 3 + "".join(path) + "$")[i]) for i in range(3, len("".join(path)) + 4)) - path.count("")
        spelling = [(score(p), "".join(p)) for p in itertools.product(*lattice) if "".join(p) in known]
        got = chars.decode(lattice, known)
        assert got in {w for s, w in spelling if s > max(spelling)[0] - 1e-9} if spelling else got == ""


def test_all_n_grams_are_kept(spark):
    letters = [c for c in toxicity.LETTERS if c.isascii()]
    words = [a + b + c + d for a in letters for b in letters for c in letters for d in "aeo"]
    df = spark.createDataFrame([(w, 1) for w in words], "word string, n long")
    assert sum(len(g) == toxicity.ORDER for g in toxicity.char_model(df).counts) > 60_000


def test_texts_of_page_furniture_are_residue():
    page = (
        "<div class=\"top-menu\"><a href=\"/\">Home</a> | <a href=\"/p\">Our products</a></div>\n<ul><li><a href=\"/a\">About</a></li><li><a href=\"/c\">Contact</a></li><li><a href=\"/t\">Terms &amp; More</a></li></ul>\n"
        "<h2>Menu</h2>\n<p>The <b>report</b> was read, see <a href=\"/r\">here</a>.</p>\n<ul><li>one</li><li>two</li><li><a href=\"/x\">three</a></li></ul>\n<div id='cookie-banner'><p>We use cookies on this site.</p> <span>OK</span></div>\n<pre>x = 1</pre>"
    )
    out = markup.clean(page)
    for lost in ("Home", "products", "About", "Contact", "Terms", "&", "cookies", "OK", "](/)", "](/a)"):
        assert lost not in out, lost
    for kept in ("## Menu", "The **report** was read, see [here](/r).", "- one", "- two", "- [three](/x)", "x = 1"):
        assert kept in out, kept
    long = "This paragraph stands in a box that somebody named a banner, but it is what the page has to say about the matter."
    assert markup.clean(f"<div class=banner><p>{long}</p></div>") == long
    assert markup.clean("<b>a</b> <i>b</i><a href=\"/1\">c</a>") == "**a** *b*[c](/1)"


def test_footers_that_look_like_sentences(spark):
    rows = [(1, n, f"{n + 11}. Acme Proceedings\n\n{w} were read here\n\nby {w} people\n\nand then {w} left\n\n{last}") for n, (w, last) in enumerate([("Reports", "All rights reserved."), ("Changes", "All rights reserved."), ("Notes", "A11 rights reserved."), ("Drafts", "Nobody wrote more.")], 1)]
    rows += [(2, n, f"Start of {w}\n\nThe {w} were old\n\n{w} went on\n\nover there {w}\n\n{'The report was read.' if n < 3 else w + ' end.'}") for n, w in enumerate("abacus bubble cactus donkey eleven".split(), 1)]
    long = "Copyright by the society of all authors, who have written this in many years and do not wish that it is copied in part or in whole by anyone"
    rows += [(3, n, f"{w} one\n\n{w} two\n\n{w} three\n\n{w} four\n\n{long}") for n, w in enumerate("fossil gopher hamlet".split(), 1)]
    got = {(r["doc_id"], r["number"], r["k"]) for r in ocr.furniture(spark.createDataFrame(rows, "doc_id long, number int, markdown string")).collect()}
    assert got == {(1, 1, 0), (1, 2, 0), (1, 3, 0), (1, 4, 0), (1, 1, 4), (1, 2, 4), (1, 3, 4), (3, 1, 4), (3, 2, 4), (3, 3, 4)}


@pytest.mark.parametrize("text", ["a \\hfill b", "\\toprule", "the \\nabla of f", "for \\forall x", "\\partial", "a & b \\\\\nc", "line\\\\[2pt]\nnext", "\\alpha_1 is", "made with \\LaTeX."])
def test_any_bare_command_is_residue(text):
    assert markup.needs_cleaning(text)


def test_backslashes_that_are_no_commands():
    for t in ("C:\\temp\\new", "\\\\server\\share\\x", "\\Users\\me", "run \\file.txt", "regex \\d+ and \\w", "a \\n b", "..\\foo", "%TEMP%\\foo", "`\\nabla` and $\\nabla$", "\\my_dir"):
        assert not markup.needs_cleaning(t), t
    assert markup.clean("a \\hfill b \\nabla f\\\\\nand \\LaTeX.") == "a  b $\\nabla$ f\nand LaTeX."


def test_chunks_are_cleaned(spark, small):
    from marrowlake.llm import queries

    chunks = spark.read.parquet(f"{small}/chunks.parquet")
    got = queries.QUERIES["p5_clean_chunks"](spark, small).collect()
    flagged = {(r["doc_id"], r["ord"]) for r in queries.p5_found(spark, small).collect()}
    assert len(got) == chunks.count() and {(r["doc_id"], r["ord"]) for r in got if r["residue"]} == flagged != set()
    text = {r["id"]: r["text"] for r in chunks.select("id", "text").collect()}
    assert all(r["clean"] == (markup.clean(text[r["id"]]) if r["residue"] else text[r["id"]]) for r in got)


def test_threshold_and_prevalence_come_from_the_judged_documents():
    import numpy as np

    scores, toxic = np.array([0.9, 0.8, 0.7, 0.2, 0.1] * 10), np.array([True, True, True, False, False] * 10)
    assert 0.2 < toxicity.best_threshold(scores, toxic) <= 0.7 and toxicity.best_threshold(scores[:5], toxic[:5]) == toxicity.THRESHOLD
    per = np.zeros((toxicity.FOLDS, 2), np.int64)
    per[0] = 400, 100
    seen = {f"bad{chr(97 + i)}": np.array([[0, 10]] + [[0, 0]] * 4) for i in range(12)} | {"common": np.array([[300, 80]] + [[0, 0]] * 4)}
    c = toxicity.Counted(seen, per, {**{f"bad{chr(97 + i)}": 19 for i in range(12)}, "common": 9000}, 10_000)
    words, odds = c.evidence()
    assert "bada" in words and "common" not in words and set(odds) == set(seen) - {"common"}
    assert 10 < c.clean_weight(odds) < 14  # words fifty times as frequent in toxic documents: two in a hundred are toxic, a fifth of the judged
    assert abs(toxicity.log_tail(1, 3, 0.5) - np.log(0.875)) < 1e-12 and toxicity.log_tail(0, 3, 0.5) == 0.0


def test_scores_without_a_gate():
    m = untaught()
    clean, blank = m.document("We merged the change."), m.document("")
    assert 0 < clean[0] == m.base < toxicity.THRESHOLD and blank == (0.0, None)


def test_any_number_of_signs_is_a_lattice(spark):
    assert ocr.confusions("i11i1111", "illillil") is not None and ocr.confusions("rep0rt", "report") == 1 and ocr.confusions("rcp0rt", "report") == 2
    assert ocr.confusions("modem", "modern") == 1 and ocr.confusions("report", "repair") is None and ocr.confusions("ﬁnd", "find") == 1
    words = ["illillilill", "report", "reports", "modern"]
    rows = [(w, 50) for w in words] + [("i11i11i1i11", 1), ("rcp0rt", 1), ("m0dem", 1), ("x0y", 1)]
    got = {r["word"]: {s["was"] for s in r["states"]} for r in ocr.suspects(spark.createDataFrame(rows, "word string, n long")).collect()}
    assert got == {"i11i11i1i11": {"illillilill"}, "rcp0rt": {"report"}, "m0dem": {"modern"}}


def planted_pages(seed=5):
    """Clean paragraphs of a document, and its pages with headers, page numbers, lines broken inside words and at hyphens, and misread characters."""
    rng = random.Random(seed)
    nouns = "report ledger harbour lantern engine garden letter mirror copper window village orchard".split()
    verbs = "was read again|had been moved|is well-known here|stays where it was|came back late|looked state-of-art then".split("|")
    clean = [" ".join(f"The {rng.choice(nouns)} near the {rng.choice(nouns)} {rng.choice(verbs)}." for _ in range(5)) for _ in range(40)]
    pages = []
    for n in range(0, 40, 2):
        body = []
        for k, p in enumerate(clean[n : n + 2]):
            words, line, out = p.split(" "), "", []
            for w in words:
                if len(line) + len(w) > 44:
                    cut = w.index("-") + 1 if "-" in w else len(w) // 2 if len(w) > 5 and rng.random() < 0.5 and w.isalpha() else 0
                    out.append((line + " " + w[:cut] + ("" if w[:cut].endswith("-") or not cut else "-")).strip())
                    line = w[cut:]
                else:
                    line = (line + " " + w).strip()
            text = "\n".join([*out, line])
            if rng.random() < 0.4:
                text = text.replace("report", "rep0rt", 1).replace("mirror", "m1rror", 1)
            body.append(text)
        pages.append((70, n // 2 + 1, "\n\n".join(["Annals of the Harbour Society", *body, str(n // 2 + 11)])))
    return clean, pages


def test_paragraphs_of_planted_pages_come_out_clean(spark):
    clean, pages = planted_pages()
    got = [r["text"] for r in ocr.repaired_paragraphs(spark.createDataFrame(pages, "doc_id long, number int, markdown string")).orderBy("doc_id", "paragraph").collect()]
    assert len(got) == len(clean) and sum(a == b for a, b in zip(got, clean)) >= 0.95 * len(clean), [x for x in zip(got, clean) if x[0] != x[1]][:3]


def test_paragraphs_go_on_over_pages(spark):
    rows = [(1, 1, "The first page ends in the mid-"), (1, 2, None), (1, 900, "dle of a word and goes\n\nOn."), (1, 901, "and on."), (2, 1, "")]
    got = [tuple(r) for r in ocr.repaired_paragraphs(spark.createDataFrame(rows, "doc_id long, number int, markdown string")).orderBy("paragraph").collect()]
    assert got == [(1, 1, 1, 900, "The first page ends in the middle of a word and goes"), (1, 2, 900, 900, "On."), (1, 3, 901, 901, "and on.")]


def test_the_cut_corrects_single_labels():
    page = "<div><p>Yes.</p><p>Garden Letter Index policy</p><p>The ledger of the reader, which was late, holds again.</p></div>"
    parts = markup.split(page)
    costs, edges = markup.costs_and_edges(parts)
    i = next(i for i, (_, p) in enumerate(parts) if p.startswith("Garden"))
    assert costs[i][0] > costs[i][1] and not markup.min_cut(costs, edges)[i]  # alone it would go, between its neighbours it stays
    assert "Garden Letter Index policy" in markup.clean(page) and markup.cut_changes(page)[2] >= 1 and markup.cut_changes(None) == (0, 0, 0)


def test_boilerplate_of_unseen_pages_is_found():
    rng = random.Random(77)
    right = alone = wrong = 0
    for _ in range(120):
        page, texts = markup.made_page(rng)
        parts, left = markup.split(page), list(texts)
        costs, edges = markup.costs_and_edges(parts)
        cut = markup.min_cut(costs, edges)
        for i, (k, p) in enumerate(parts):
            at = next((j for j, (u, _) in enumerate(left) if k == "text" and u.strip() == p.strip()), None)
            if at is not None:
                y = left.pop(at)[1]
                right, wrong, alone = right + (cut[i] == y), wrong + (cut[i] != y), alone + ((costs[i][0] > costs[i][1]) == y)
    assert right / (right + wrong) > 0.97 and right > alone


def test_planted_boilerplate_is_dropped_from_a_document(spark):
    body = "# Notes\n\nThe report was read, then it was <b>moved</b>.\n\n- one\n- two"
    nav = '<div class="nav"><a href="/">Home</a> <a href="/p">Our products</a> <a href="/c">Contact</a></div>\n'
    foot = '\n<footer><p>© 2026 All rights reserved</p><a href="/i">Imprint</a></footer>'
    df = spark.createDataFrame([(1, nav + body + foot), (2, body), (3, None), (4, "")], "doc_id int, text string")
    got = {r["doc_id"]: r["clean"] for r in markup.clean_markup(df, keep=["doc_id"]).collect()}
    assert got[1].strip() == got[2].strip() == "# Notes\n\nThe report was read, then it was **moved**.\n\n- one\n- two" and got[3] is None and got[4] == ""


def test_nesting_of_any_depth():
    deep = "{{a|" * 60 + "x" + "}}" * 60
    assert markup.split(f"{deep} y") == [("template", deep), ("text", " y")] and markup.clean(f"{deep} y").strip() == "x y"
    assert markup.clean("{{a|b=1|{{b|{{c}}}}}} x").strip() == "x" and markup.clean("{{ open") == "{{ open"
    assert markup.clean("\\emph{a \\textbf{b \\textit{c}} d} e") == "*a **b *c*** d* e"
    assert markup.needs_cleaning("{{" * 20_000) is False
