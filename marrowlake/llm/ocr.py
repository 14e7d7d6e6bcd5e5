"""Noise in text from scanned pages (p6): page furniture, broken words and misrecognised characters.

Furniture is found by what pages of a document share. Characters are repaired by a noisy channel: what a word may have
been before recognition (confusions), times how likely that is in its line (word and word-pair counts over all
pages), decoded by Viterbi over the candidates of each line.
"""

from __future__ import annotations

import math
import re
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from marrowlake.runtime import through_table

# fixed values: what is read in place of what. Signs are no part of words; letters may be right as they are.
SIGNS = {
    "0": ["o"], "1": ["l", "i"], "5": ["s"], "6": ["b"], "8": ["b"], "9": ["g"], "!": ["i", "l"], "|": ["l", "i"], "¢": ["e", "c"], "†": ["t"], "$": ["s"], "@": ["a"], "€": ["e"], "£": ["e"],
    "ﬁ": ["fi"], "ﬂ": ["fl"], "ﬀ": ["ff"], "ﬃ": ["ffi"], "ﬄ": ["ffl"],
}
LETTERS = [("c", "e"), ("e", "c"), ("b", "h"), ("h", "b"), ("rn", "m"), ("m", "rn"), ("n", "ri"), ("h", "li"), ("vv", "w"), ("d", "cl"), ("cl", "d"), ("ii", "u"), ("f", "t"), ("q", "g")]
#: Probability that a confusion happened in a word, and that a word holds a sign though it is right.
P_CONFUSION, P_SIGN = 0.02, 1e-7
#: Weight of the word's own frequency against that of the pair.
BACKOFF = 4.0
#: A line that ends or begins like a sentence of the text is page furniture only if it returns on so many pages, and this share of the document's.
LEAST_PAGES, LEAST_SHARE = 3, 0.5

WORD = re.compile(r"[^\W_][\w!|¢†$@€£]*[\w¢†$@€£]|[^\W\d_]")
CODE = re.compile(r"```[\s\S]*?(?:```|\Z)|`[^`\n]*`|https?://\S+")
BREAK = re.compile(r"([^\W\d_¢†]+[^\W_]*)[-¬­‐][ \t]*\n[ \t]*([^\W\d_][\w¢†!|]*(?:-[^\W\d_]\w*)*)")


def unbroken(text: str) -> str:
    """Words broken across two lines put together on the first of them."""
    return BREAK.sub(lambda m: m.group(1) + m.group(2) + "\n", text)


def line_words(text: str) -> list[list[str]]:
    """The words of each line in lower case, without code and addresses; broken words are put together."""
    plain = CODE.sub(lambda m: re.sub(r"[^\n]", " ", m.group()), text)
    return [[w.lower() for w in WORD.findall(line) if any(c.isalpha() for c in w)] for line in unbroken(plain).split("\n")]


def has_sign(word: str) -> bool:
    return any(c in SIGNS for c in word)


def candidates(word: str) -> list[tuple[str, float]]:
    """(what a word without signs may have been, log probability of the confusion), without the word itself: one confusion of letters."""
    found: dict[str, float] = {}
    if len(word) >= 3 and not has_sign(word):
        for bad, good in LETTERS:
            at = word.find(bad)
            while at >= 0:
                found[word[:at] + good + word[at + len(bad) :]] = math.log(P_CONFUSION)
                at = word.find(bad, at + 1)
    found.pop(word, None)
    return list(found.items())


def readings(word: str) -> list[str]:
    """The places of a word as what may stand there: a sign has the letters it is read for, another character itself. A lattice, never its paths."""
    return [SIGNS.get(c, [c]) for c in word]


def confusions(word: str, was: str) -> int | None:
    """The fewest confusions by which `was` is read as `word`, None if there is no way: signs by the lattice of the word, and letters beside them."""
    if len(was) > 2 * len(word) + 2:
        return None
    places = readings(word)
    best: dict[tuple[int, int], int] = {(0, 0): 0}
    for i in range(len(word) + 1):
        for j in range(len(was) + 1):
            n = best.get((i, j))
            if n is None:
                continue
            if i < len(word):
                for o in places[i]:
                    if was.startswith(o, j):
                        to, cost = (i + 1, j + len(o)), n + (word[i] in SIGNS)
                        best[to] = min(best.get(to, cost), cost)
            for bad, good in LETTERS:
                if word.startswith(bad, i) and was.startswith(good, j):
                    to, cost = (i + len(bad), j + len(good)), n + 1
                    best[to] = min(best.get(to, cost), cost)
    return best.get((len(word), len(was)))


def pages_once(pages: DataFrame) -> DataFrame:
    """(doc_id, number, markdown): each page once; of differing rows the largest text counts. Empty pages are left out."""
    p = pages.filter(F.regexp_replace("markdown", r"\s+", "") != "")
    return p.groupBy("doc_id", "number").agg(F.max("markdown").alias("markdown"))


# ---- furniture ----

ALONE = r"(?i)^\W*(?:(?:page|pages|seite|página|pagina|pág|pag|p|s)\.?\s*)?[0-9OolI|]{0,3}[0-9][0-9OolI|]{0,3}(?:\s*(?:/|of|von|de|sur|out of)\s*[0-9OolI|]{1,5})?\W*$"
ROMAN = r"(?i)^\W*(?=[ivxlc])(?:x[cl]|l?x{0,3})(?:i[xv]|v?i{0,3})\W*$"


def is_page_number(paragraph: Column) -> Column:
    return paragraph.rlike(ALONE) | paragraph.rlike(ROMAN)


def skeleton(line: Column) -> Column:
    """The line without a page number at either end, with everything that is confused with one another made equal."""
    s = F.lower(F.regexp_replace(F.regexp_replace(line, r"^[\W_]*[0-9]{1,5}[\W_]{2,}", ""), r"[\W_]{2,}[0-9]{1,5}[\W_]*$", ""))
    s = F.regexp_replace(s, r"\b(page|seite|página)\s+[0-9]+\b", "")
    return F.regexp_replace(folded(s), r"[^\p{L}]+", " ")


def folded(s: Column) -> Column:
    """Lower-case text with everything that is confused with one another made equal."""
    for bad, good in (("rn", "m"), ("vv", "w"), ("ri", "n"), ("li", "h"), ("cl", "d")):
        s = F.replace(s, F.lit(bad), F.lit(good))
    s = F.translate(s, "01569!|¢†c8$@€il", "olsbgllete" + "bsaell")
    return F.translate(s, "bc", "he")


#: One letter for the letters and signs of a class: what a sign may stand for falls together with it.
SIGN_CLASS = {"l": "i", "c": "e"} | {c: {"l": "i", "c": "e"}.get(r[0], r[0]) for c, r in SIGNS.items() if len(r[0]) == 1}
LIGATURES = {c: r[0] for c, r in SIGNS.items() if len(r[0]) > 1}


def word_key(word: Column) -> Column:
    """What a word and everything that its signs may be read as have in common: ligatures spelt out, each sign and the letters it is read for made one letter."""
    s = word
    for c, letters in LIGATURES.items():
        s = F.replace(s, F.lit(c), F.lit(letters))
    return F.translate(s, "".join(SIGN_CLASS), "".join(SIGN_CLASS.values()))


def variants(word: str) -> set[str]:
    """A word with signs as it is, and with one confusion of its letters undone."""
    out = {word}
    for bad, good in LETTERS:
        at = word.find(bad)
        while at >= 0:
            out.add(word[:at] + good + word[at + len(bad) :])
            at = word.find(bad, at + 1)
    return out


def paragraphs(pages: DataFrame) -> DataFrame:
    """(doc_id, number, k, paragraph, alone, top, bottom, sentence): alone marks a page number, top and bottom a line that may be a header or footer,
    sentence one that may as well be text, by its end, numbering or length."""
    parts = F.filter(F.split("markdown", r"\n[ \t]*\n\s*"), lambda p: F.trim(p) != "")
    p = pages.select("doc_id", "number", parts.alias("parts")).select("doc_id", "number", F.size("parts").alias("n"), F.posexplode("parts").alias("k", "paragraph"))
    p = p.withColumn("paragraph", F.regexp_replace("paragraph", r"^\s+|\s+$", ""))
    line = ~F.col("paragraph").contains("\n") & ~F.col("paragraph").rlike(r"^(#|>|\||[-*+] |```)")
    sentence = F.col("paragraph").rlike(r"^\d+[.)] |[.?:;]$") | (F.length("paragraph") > 120)
    return p.select("doc_id", "number", "k", "paragraph", is_page_number(F.col("paragraph")).alias("alone"), (line & (F.col("k") < 2)).alias("top"), (line & (F.col("k") >= F.col("n") - 2)).alias("bottom"), sentence.alias("sentence"))


def furniture(pages: DataFrame) -> DataFrame:
    """(doc_id, number, k) of the paragraphs that are page numbers, or headers and footers that return on another page.

    A header is a single line among the first or last two paragraphs whose skeleton stands there on at least two pages of the document; a line that may
    be a sentence of the text must stand at the same edge of LEAST_SHARE of the document's pages, and of LEAST_PAGES. Counts are pre-aggregated per document and skeleton.
    """
    p = paragraphs(pages).filter("alone or top or bottom")
    e = p.filter("not alone").withColumn("skeleton", skeleton(F.col("paragraph"))).filter(F.length("skeleton") >= 3)
    lines = e.filter("not sentence")
    often = lines.select("doc_id", "skeleton", "number").distinct().groupBy("doc_id", "skeleton").agg(F.count("*").alias("pages")).filter("pages > 1")
    heads = lines.join(often, ["doc_id", "skeleton"], "left_semi").select("doc_id", "number", "k")
    at = e.filter("sentence").withColumn("side", F.explode(F.filter(F.array(F.when(F.col("top"), 0), F.when(F.col("bottom"), 1)), lambda x: x.isNotNull())))
    there = at.select("doc_id", "skeleton", "side", "number").distinct().groupBy("doc_id", "skeleton", "side").agg(F.count("*").alias("pages")).filter(F.col("pages") >= LEAST_PAGES)
    whole = pages.groupBy("doc_id").agg(F.count("*").alias("of"))
    steady = there.join(whole, "doc_id").filter(F.col("pages") >= LEAST_SHARE * F.col("of"))
    repeated = at.join(steady, ["doc_id", "skeleton", "side"], "left_semi").select("doc_id", "number", "k").distinct()
    return p.filter("alone").select("doc_id", "number", "k").unionByName(heads).unionByName(repeated)


# ---- broken words ----


FOUND_BREAK = re.compile(r"((?:[^\W\d_]|[¢†])+)[-¬­‐][ \t]*\n[ \t]*((?:[^\W\d_]|[¢†])+)")
COMPOUND = re.compile(r"(?<![\w-])[^\W\d_]+(?:-[^\W\d_]+)+(?![\w-])")


def compound_pairs(text: str) -> list[str]:
    """Neighbouring parts of the words with hyphens of a text: "state-of-art" has state-of and of-art."""
    return [f"{a}-{b}" for m in COMPOUND.finditer(text) for ps in (m.group().lower().split("-"),) for a, b in zip(ps, ps[1:])]


def judged_breaks(rows: DataFrame, vocabulary: DataFrame) -> DataFrame:
    """(l, r, compound) of every pair of word halves that a line break divides, from lines() and the counts of words.

    A word divided by a plain hyphen is taken for a compound only where the corpus writes the compound more often than the joined word; the breaks themselves, which are
    counted as joined words, say nothing. Pairs are counted first.
    """
    pairs = rows.select(F.explode("breaks").alias("b")).groupBy(F.col("b.l").alias("l"), F.col("b.r").alias("r")).agg(F.count("*").alias("n_break"))
    compounds = rows.select(F.explode("compounds").alias("c")).groupBy("c").agg(F.count("*").alias("n_compound"))
    both = pairs.withColumn("c", F.concat_ws("-", "l", "r")).withColumn("joined", F.concat("l", "r")).join(compounds, "c", "left")
    own = both.groupBy("joined").agg(F.sum("n_break").alias("own"))
    both = both.join(own, "joined").join(vocabulary.select(F.col("word").alias("joined"), F.col("n").alias("n_word")), "joined", "left")
    free = F.coalesce("n_word", F.lit(0)) - F.col("own")
    return both.select("l", "r", (F.coalesce("n_compound", F.lit(0)) > F.greatest(free, F.lit(0))).alias("compound"))


def broken_words(rows: DataFrame, vocabulary: DataFrame) -> DataFrame:
    """(doc_id, number) of pages that break a word across lines, from lines() and the counts of words."""
    at = rows.select("doc_id", "number", F.explode("breaks").alias("b")).select("doc_id", "number", "b.l", "b.r")
    return at.join(judged_breaks(rows, vocabulary).filter("not compound"), ["l", "r"]).select("doc_id", "number").distinct()


# ---- misrecognised characters ----


def lines(pages: DataFrame) -> DataFrame:
    """(doc_id, number, line, words, breaks, compounds) of every line that has words: the one pass over the texts.

    breaks are the halves (l, r) of words that the page breaks across lines and compounds its words with a hyphen, both in lower case and on the page's first row.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        halves = pa.list_(pa.struct([("l", pa.string()), ("r", pa.string())]))
        for b in batches:
            for i in range(0, b.num_rows, 512):
                rows = []
                for d, n, t in zip(*(c.to_pylist() for c in b.slice(i, 512).columns)):
                    plain = CODE.sub(lambda m: re.sub(r"[^\n]", " ", m.group()), t)
                    broken = [{"l": m.group(1).lower(), "r": m.group(2).lower()} for m in FOUND_BREAK.finditer(plain)] if "\n" in plain else []
                    hyphened = compound_pairs(plain) if "-" in plain else []
                    mine = [(d, n, k, ws, [], []) for k, ws in enumerate(line_words(t)) if ws] or ([(d, n, 0, [], [], [])] if broken or hyphened else [])
                    if mine:
                        mine[0] = (*mine[0][:4], broken, hyphened)
                    rows += mine
                d, n, k, ws, br, co = zip(*rows) if rows else ((),) * 6
                cols = [pa.array(d, pa.int64()), pa.array(n, pa.int32()), pa.array(k, pa.int32()), pa.array(ws, pa.list_(pa.string())), pa.array(br, halves), pa.array(co, pa.list_(pa.string()))]
                yield pa.RecordBatch.from_arrays(cols, names=["doc_id", "number", "line", "words", "breaks", "compounds"])

    schema = "doc_id long, number int, line int, words array<string>, breaks array<struct<l:string,r:string>>, compounds array<string>"
    return pages.select(F.col("doc_id").cast("long"), F.col("number").cast("int"), "markdown").mapInArrow(run, schema)


def read_lines(pages: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(lines, counts of words) of pages, both kept in the shared folder."""
    rows = through_table(lines(pages), "lines")
    return rows, through_table(rows.select(F.explode("words").alias("word")).groupBy("word").agg(F.count("*").alias("n")), "vocabulary")


def suspects(vocabulary: DataFrame) -> DataFrame:
    """(word, n, states): words that may be misread, with what they may have been: array of (word, count, log probability).

    vocabulary: (word, n). A candidate must occur. Words with signs, as they are and with one confusion of letters undone, are joined to the words without by word_key, so any number
    of signs costs no enumeration; confusions() then counts. A word without signs is suspect only if the candidate is so frequent that P_CONFUSION of it reach the word's own
    count less one.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            rows = [(w, n, c, p) for w, n in zip(b.column(0).to_pylist(), b.column(1).to_pylist()) for c, p in candidates(w)]
            w, n, c, p = zip(*rows) if rows else ((), (), (), ())
            yield pa.RecordBatch.from_arrays([pa.array(w, pa.string()), pa.array(n, pa.int64()), pa.array(c, pa.string()), pa.array(p, pa.float64())], names=["word", "n", "was", "logp"])

    def varied(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            rows = [(w, n, v) for w, n in zip(b.column(0).to_pylist(), b.column(1).to_pylist()) for v in sorted(variants(w))]
            w, n, v = zip(*rows) if rows else ((),) * 3
            yield pa.RecordBatch.from_arrays([pa.array(w, pa.string()), pa.array(n, pa.int64()), pa.array(v, pa.string())], names=["word", "n", "variant"])

    def counted(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            rows = [(w, n, c, m, k * math.log(P_CONFUSION)) for w, n, c, m in zip(*(x.to_pylist() for x in b.columns)) if (k := confusions(w, c))]
            w, n, c, m, p = zip(*rows) if rows else ((),) * 5
            yield pa.RecordBatch.from_arrays([pa.array(w, pa.string()), pa.array(n, pa.int64()), pa.array(c, pa.string()), pa.array(m, pa.int64()), pa.array(p, pa.float64())], names=["word", "n", "was", "n_was", "logp"])

    sign = F.col("word").rlike("[" + "".join(SIGNS) + "]")
    plain = vocabulary.filter(~sign)
    made = plain.mapInArrow(run, "word string, n long, was string, logp double")
    known = plain.select(F.col("word").alias("was"), F.col("n").alias("n_was"))
    kept = made.join(known, "was").filter(F.col("n_was") * P_CONFUSION > F.col("n") - 1).select("word", "n", "was", "n_was", "logp")
    odd = vocabulary.filter(sign & F.col("word").rlike(r"\p{L}.*\p{L}")).mapInArrow(varied, "word string, n long, variant string")
    odd = odd.select("word", "n", word_key(F.col("variant")).alias("key"))
    even = known.filter(F.col("was").rlike(r"^\p{L}+$")).select("was", "n_was", word_key(F.col("was")).alias("key"))
    signs = odd.join(even, "key").select("word", "n", "was", "n_was").distinct().mapInArrow(counted, "word string, n long, was string, n_was long, logp double")
    return kept.unionByName(signs).groupBy("word").agg(F.first("n").alias("n"), F.collect_list(F.struct("was", "n_was", "logp")).alias("states"))  # a word has few confusions


def corrections(rows: DataFrame, vocabulary: DataFrame) -> DataFrame:
    """(doc_id, number, line, position, word, was): the words that the decoding of their line replaces. rows and vocabulary as read_lines() gives.

    Every line with a suspect word is a lattice of candidates; Viterbi picks the path of greatest confusion times language
    probability. Pair probabilities back off to word frequencies; a word does not support itself: its own occurrence is taken off its counts.
    Counts cover all pages. Joins are by word and by word pair; a line is the largest group.
    """
    doubt = through_table(suspects(vocabulary), "suspects")
    total = vocabulary.agg(F.coalesce(F.sum("n"), F.lit(0)).alias("total"))
    key = ["doc_id", "number", "line"]
    rows = rows.select(*key, "words")
    at = rows.select(*key, F.posexplode("words").alias("position", "word"))
    hit = at.join(doubt, "word").groupBy(*key).agg(F.collect_list(F.struct("position", "n", "states")).alias("doubts"))
    lattice = through_table(rows.join(hit, key), "lattice")

    def keyed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            out = [(d, n, k, x, y) for d, n, k, ws, ds in zip(*(b.column(c).to_pylist() for c in (*key, "words", "doubts"))) for x, y in needed_pairs(ws, ds)]
            d, n, k, x, y = zip(*out) if out else ((),) * 5
            yield pa.RecordBatch.from_arrays([pa.array(d, pa.int64()), pa.array(n, pa.int32()), pa.array(k, pa.int32()), pa.array(x, pa.string()), pa.array(y, pa.string())], names=[*key, "a", "b"])

    asked = through_table(lattice.mapInArrow(keyed, "doc_id long, number int, line int, a string, b string"), "asked")
    need = asked.select("a", "b").distinct()
    pair = F.transform(F.sequence(F.lit(1), F.size("words") - 1), lambda i: F.struct(F.get("words", i - 1).alias("a"), F.get("words", i).alias("b")))
    pairs = rows.filter(F.size("words") > 1).select(F.explode(pair).alias("p")).groupBy("p.a", "p.b").agg(F.count("*").alias("n"))
    heads = vocabulary.select(F.col("word").alias("a"), F.col("n").alias("n_a"))
    counts = need.join(pairs, ["a", "b"], "left").join(heads, "a", "left").select("a", "b", F.coalesce("n", F.lit(0)).alias("n"), F.coalesce("n_a", F.lit(0)).alias("n_a"))
    per_line = asked.join(counts, ["a", "b"]).groupBy(*key).agg(F.collect_list(F.struct("a", "b", "n", "n_a")).alias("pairs"))
    ready = lattice.join(per_line, key, "left").crossJoin(total)  # total is one row

    def decode(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            out = []
            for d, n, k, ws, ds, ps, t in zip(*(b.column(c).to_pylist() for c in (*key, "words", "doubts", "pairs", "total"))):
                out += [(d, n, k, i, ws[i], was) for i, was in viterbi(ws, ds, {(p["a"], p["b"]): (p["n"], p["n_a"]) for p in ps or ()}, t)]
            d, n, k, i, w, was = zip(*out) if out else ((),) * 6
            yield pa.RecordBatch.from_arrays([pa.array(d, pa.int64()), pa.array(n, pa.int32()), pa.array(k, pa.int32()), pa.array(i, pa.int32()), pa.array(w, pa.string()), pa.array(was, pa.string())], names=[*key, "position", "word", "was"])

    return ready.mapInArrow(decode, "doc_id long, number int, line int, position int, word string, was string")


def _states(words: list[str], doubts: list[dict]) -> dict[int, list[tuple[str, float, float]]]:
    """By position of a suspect: (word, count, log probability of the reading), the word itself first, less its own occurrence."""
    return {d["position"]: [(w := words[d["position"]], d["n"] - 1, math.log(P_SIGN) if has_sign(w) else 0.0), *((s["was"], s["n_was"], s["logp"]) for s in d["states"])] for d in doubts}


def needed_pairs(words: list[str], doubts: list[dict]) -> set[tuple[str, str]]:
    """The word pairs whose counts the decoding of the line asks for."""
    states = {i: [s[0] for s in v] for i, v in _states(words, doubts).items()}
    out = set()
    for i in states:
        for j, k in ((i - 1, i), (i, i + 1)):
            if j >= 0 and k < len(words):
                out |= {(a, b) for a in states.get(j, [words[j]]) for b in states.get(k, [words[k]])}
    return out


def viterbi(words: list[str], doubts: list[dict], counts: dict[tuple[str, str], tuple[int, int]], total: int) -> list[tuple[int, str]]:
    """(position, word) of the suspects that the best path through the line replaces."""
    states = _states(words, doubts)

    def pair(a: str, b: str, n_b: float, as_read: bool) -> float:
        n, n_a = counts.get((a, b), (0, 0))
        n -= as_read  # this very occurrence
        return math.log((max(n, 0) + BACKOFF * (n_b + 0.1) / total) / (max(n_a, 1) + BACKOFF))

    out: list[tuple[int, str]] = []
    done = set()
    for start in sorted(states):
        if start in done:
            continue
        run = [start]
        while run[-1] + 1 in states:
            run.append(run[-1] + 1)
        done |= set(run)
        left = words[start - 1] if start else None
        best = [(math.log((n + 0.1) / total) + p if left is None else pair(left, w, n, k == 0) + p, [k]) for k, (w, n, p) in enumerate(states[start])]
        for i in run[1:]:
            best = [max((s + pair(states[i - 1][path[-1]][0], w, n, k == 0 and path[-1] == 0) + p, [*path, k]) for s, path in best) for k, (w, n, p) in enumerate(states[i])]
        if run[-1] + 1 < len(words):
            nxt = words[run[-1] + 1]
            best = [(s + pair(states[run[-1]][path[-1]][0], nxt, 0, path[-1] == 0), path) for s, path in best]
        out += [(i, states[i][k][0]) for i, k in zip(run, max(best)[1]) if k]
    return out


# ---- results ----


def pages_to_repair(pages: DataFrame) -> DataFrame:
    """(doc_id, number, reason) of every page with furniture, a broken word or a misread one."""
    once = through_table(pages_once(pages), "pages")
    rows, vocabulary = read_lines(once)
    f = furniture(once).select("doc_id", "number", F.lit("furniture").alias("reason"))
    w = broken_words(rows, vocabulary).withColumn("reason", F.lit("broken word"))
    c = corrections(rows, vocabulary).select("doc_id", "number", F.lit("misread").alias("reason"))
    return f.unionByName(w).unionByName(c).distinct()


def mended(text: str, compounds: frozenset[tuple[str, str]]) -> str:
    """Words broken across two lines put together on the first of them; compounds keep their hyphen."""

    def put(m: re.Match) -> str:
        halves = FOUND_BREAK.match(m.group())
        keep = halves is not None and (halves.group(1).lower(), halves.group(2).lower()) in compounds
        return m.group(1) + ("-" if keep else "") + m.group(2) + "\n"

    return BREAK.sub(put, text)


def repair(text: str, drop: set[int], fixes: dict[tuple[int, int], str], compounds: frozenset[tuple[str, str]] = frozenset()) -> list[str]:
    """The paragraphs of a page: furniture dropped, words repaired and put together, lines joined. compounds are the (l, r) that are broken at a hyphen of their own."""
    if fixes:
        marked = CODE.sub(lambda m: re.sub(r"[^\n]", "\x00", m.group()), text)
        held = [m for m in re.finditer(CODE, text)]
        got = []
        # words are numbered by line as line_words() does it; a compound stands there as one word, so what it is cut into is put back by its own halves
        for k, line in enumerate(unbroken(marked).split("\n")):
            i = -1

            def put(m: re.Match) -> str:
                nonlocal i
                w = m.group()
                if not any(c.isalpha() for c in w):
                    return w
                i += 1
                new = fixes.get((k, i))
                return w if new is None else new.upper() if w.isupper() and len(w) > 1 else new.capitalize() if w[0].isupper() else new

            got.append(WORD.sub(put, line))
        text = "\n".join(got)
        for left, right in compounds:
            text = re.sub(rf"(?<!\w)({re.escape(left)})({re.escape(right)})(?!\w)", r"\1-\2", text, flags=re.I)
        spans = iter(held)
        text = re.sub(r"\x00(?:[\x00\n]*\x00)?", lambda m: next(spans).group(), text)
    parts = [p.strip() for p in re.split(r"\n[ \t]*\n\s*", text) if p.strip()]
    out = []
    for k, p in enumerate(parts):
        if k in drop:
            continue
        p = mended(p, compounds)
        if re.match(r"(#|>|\||[-*+] |\d+[.)] |```)", p) or re.search(r":\n\d", p):
            out.append(p)
        else:
            out.append(re.sub(r"\s*\n\s*", " ", p))
    return out


#: Page numbers of one slice of a document: no document is sorted by one task.
SLICE = 256


def repaired_pages(pages: DataFrame) -> DataFrame:
    """(doc_id, number, k, text, continues): the repaired paragraphs in page order; continues marks one that goes on from the page before.

    A paragraph continues the previous page's last one if this one starts in lower case and that ends without closing punctuation; a hyphen behind a letter at
    its end breaks a word over the pages. Null and empty pages give no rows. A page is the largest group that a task holds.
    """
    once = through_table(pages_once(pages), "pages")
    rows, vocabulary = read_lines(once)
    key = ["doc_id", "number"]
    drop = furniture(once).select(F.col("doc_id").cast("long"), F.col("number").cast("int"), "k").groupBy(*key).agg(F.collect_set("k").alias("drop"))
    fix = corrections(rows, vocabulary).groupBy(*key).agg(F.collect_list(F.struct("line", "position", "was")).alias("fix"))
    whole = rows.select(*key, F.explode("breaks").alias("b")).select(*key, "b.l", "b.r").join(judged_breaks(rows, vocabulary).filter("compound"), ["l", "r"])
    kept = whole.groupBy(*key).agg(F.collect_set(F.struct("l", "r")).alias("kept"))
    every = once.select(F.col("doc_id").cast("long"), F.col("number").cast("int"), "markdown").join(drop, key, "left").join(fix, key, "left").join(kept, key, "left")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            rows = []
            for d, n, t, dr, fx, co in zip(*(b.column(c).to_pylist() for c in (*key, "markdown", "drop", "fix", "kept"))):
                fixes, compounds = {(x["line"], x["position"]): x["was"] for x in fx or ()}, frozenset((x["l"], x["r"]) for x in co or ())
                rows += [(d, n, k, p) for k, p in enumerate(repair(t, set(dr or ()), fixes, compounds))]
            d, n, k, p = zip(*rows) if rows else ((),) * 4
            yield pa.RecordBatch.from_arrays([pa.array(d, pa.int64()), pa.array(n, pa.int32()), pa.array(k, pa.int32()), pa.array(p, pa.string())], names=[*key, "k", "text"])

    parts = through_table(every.mapInArrow(run, "doc_id long, number int, k int, text string").withColumn("slice", F.floor(F.col("number") / SLICE)), "parts")
    # the end of the nearest earlier slice that has pages, however far it lies
    last = parts.groupBy("doc_id", "slice").agg(F.max_by(F.right("text", F.lit(2)), F.struct("number", "k")).alias("end"))
    carried = last.select("doc_id", "slice", F.lag("end").over(Window.partitionBy("doc_id").orderBy("slice")).alias("carried"))  # a row a slice
    w = Window.partitionBy("doc_id", "slice").orderBy("number", "k")
    joined = parts.join(carried, ["doc_id", "slice"])
    before = F.coalesce(F.lag(F.right("text", F.lit(2))).over(w), F.col("carried"))
    goes_on = (F.col("k") == 0) & F.col("text").rlike(r"^\p{Ll}") & ~before.rlike(r"[.!?:;…»”\"|]$")
    return joined.withColumn("continues", F.coalesce(goes_on, F.lit(False))).select(*key, "k", "text", "continues")


def repaired_paragraphs(pages: DataFrame) -> DataFrame:
    """(doc_id, paragraph, number, last_number, text): the paragraphs of each document in order, joined over pages; number and last_number are the pages they begin and end on.

    A word broken over the end of a page is put together. A paragraph is one row, so its parts meet there; documents are cut in slices of pages otherwise.
    """
    p = through_table(repaired_pages(pages).withColumn("slice", F.floor(F.col("number") / SLICE)), "repaired")
    # which paragraph a part belongs to: the number of those that begin up to it, counted by slice and carried on
    begins = (~F.col("continues")).cast("int")
    per = p.groupBy("doc_id", "slice").agg(F.sum(begins).alias("n"))
    offset = per.select("doc_id", "slice", (F.sum("n").over(Window.partitionBy("doc_id").orderBy("slice")) - F.col("n")).alias("offset"))  # a row a slice
    w = Window.partitionBy("doc_id", "slice").orderBy("number", "k").rowsBetween(Window.unboundedPreceding, 0)
    p = p.join(offset, ["doc_id", "slice"]).withColumn("paragraph", (F.col("offset") + F.sum(begins).over(w)).cast("int"))
    whole = F.array_sort(F.collect_list(F.struct("number", "k", "text")))
    step = lambda s, x: F.when(s.rlike(r"\p{L}[-\u00ad\u00ac\u2010]$"), F.concat(F.regexp_replace(s, r"[-\u00ad\u00ac\u2010]$", ""), x["text"])).when(s == "", x["text"]).otherwise(F.concat(s, F.lit(" "), x["text"]))
    got = p.groupBy("doc_id", "paragraph").agg(whole.alias("parts"))
    return got.select("doc_id", "paragraph", F.get("parts", F.lit(0))["number"].alias("number"), F.element_at("parts", -1)["number"].alias("last_number"), F.aggregate("parts", F.lit(""), step).alias("text"))
