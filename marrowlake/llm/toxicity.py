"""Abusive, hateful or sexual content (p10).

Masked spellings are restored by a noisy channel: the characters of a suspicious token span a lattice (look-alikes, separators,
repeated letters, wildcards); the likeliest known word through it, under a character language model of the corpus, is found by walking a trie. The restored passages are scored by a logistic
regression, fitted on documents that people judged, with the passage as the unit: a document is as bad as its worst passage. What speaks for the class are words that a test finds more
frequent in documents judged toxic than in the corpus, and a short prior list; a passage without any of them has the model's base probability.
"""

from __future__ import annotations

import math
import re
from collections import Counter, defaultdict
from collections.abc import Iterator
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from marrowlake.runtime import through_table

#: Judged documents that the classifier is fitted on at most (the bound of what reaches the driver).
FIT_DOCUMENTS = 4_000
#: Order of the character model. Its n-grams are of LETTERS and all are kept, so the table is bounded by the alphabet, not by the corpus.
ORDER = 4
LETTERS = "abcdefghijklmnopqrstuvwxyzàáâäçèéêëíîïñóôöœùúûüß"
BUCKETS = 1 << 19
#: The decision where fewer than LEAST_TOXIC documents were judged toxic; with more it is found by cross-validation over FOLDS parts of the judged documents.
THRESHOLD, LEAST_TOXIC, FOLDS = 0.5, 20, 5

# fixed values: characters that stand for letters in masked words; * may be any letter
LOOK_ALIKES = {"@": "a", "4": "a", "3": "e", "€": "e", "1": "il", "!": "il", "0": "o", "$": "s", "5": "s", "7": "t", "+": "t", "8": "b", "9": "g", "6": "g", "2": "z", "*": LETTERS}
# fixed values: words that weigh towards the class before any judged document is seen
OFFENSIVE = """idiot idiots moron imbecile bastard scumbag asshole dumbass jackass loser stupid brainless worthless pathetic disgusting
fuck fucking fucked shit bitch cunt whore slut dick cock pussy tits porn porno nude nudes naked horny sex vermin subhuman filthy
scum trash kill rape retard retarded faggot stupide imbécile crétin connard connasse salaud salope abruti débile merde pute nique
baiser bite chatte nue nues vermine rats sale sales crever gueule arschloch wichser hurensohn fotze schlampe idiot trottel
mistkerl drecksack depp vollidiot ficken nackt nackte titten pornos ungeziefer dreckig dreckige verreck abschaum gilipollas idiota
imbécil cabrón puta puto mierda payaso inútil follar desnuda desnudas desnudo cachondo cachonda plaga ratas asquerosos asqueroso
basura mueras""".split()
PRIOR_WEIGHT, PRIOR_BIAS, PENALTY = 1.6, -3.5, 3e-6
#: How much dearer weight is for words and pairs that are no evidence and only speak against the class.
CONTEXT = 1000.0
#: How much more frequent a word must be in toxic documents than in the corpus to speak for the class.
LIFT = 3.0

WORD = re.compile(r"[^\W\d_]+")
PASSAGE = re.compile(r"(?<=[.!?])[)\"'»”]*\s+|\n\s*\n|\n(?=\s*(?:[-*#>|]|\d+\.|<))|\s+(?=[¿¡])")
CODE = re.compile(r"```[\s\S]*?(?:```|\Z)|`[^`\n]*`|https?://\S+")
_SIGN = r"@$*!€+0-9"
SPACED = re.compile(r"(?<![\w.])[^\W_](?:([ .\-_·*])[^\W_]|[ .\-_·]{2}[^\W_]){3,}(?!\w)")
SIGNED = re.compile(rf"(?<![\w/.=&#\\{{$])(?=[\w{_SIGN}]*[^\W\d_][\w{_SIGN}]*[^\W\d_])[\w{_SIGN}]*(?:[^\W\d_][{_SIGN}]|[@*$][^\W\d_])[\w{_SIGN}]*(?![\w/=])")
REPEATED = re.compile(r"\w*([^\W\d_])\1{2,}\w*")
# classes of the characters in Latin-1, "?" being every other one: a letter, * sign before or after one, 1 after one only; for
# SPACED a single character or a separator
_BY_SIGN = bytes(97 if chr(i).isalpha() or i >= 128 or i == 63 else 42 if chr(i) in "@*$" else 49 if chr(i) in "!+0123456789" else 120 for i in range(256))
_BY_SPACE = bytes(32 if chr(i) in " .-_*·" else 97 if chr(i).isalnum() or i >= 128 or i == 63 else 120 for i in range(256))
_LETTER = np.array([c == 97 for c in _BY_SIGN])
_KEEP = bytes(i if chr(i).isalnum() or i >= 128 else 32 for i in range(256))


_WIDE_SIGNS = re.compile(rb"\xc2[\x80-\xbf]|\xe2[\x80-\xbf]{2}")


def byte_words(low: bytes) -> list[bytes]:
    """The words of a lower-case UTF-8 text; signs of ASCII, Latin-1 and general punctuation separate them."""
    return _WIDE_SIGNS.sub(b" ", low).translate(_KEEP).split()


def may_be_masked(text: str) -> bool:
    """False only if none of SPACED, SIGNED and REPEATED matches anywhere in the text, or in a part of it.

    Each of them needs two or three characters side by side that are looked for here whatever stands around them.
    """
    raw = text.encode("latin-1", "replace")
    by_sign = raw.translate(_BY_SIGN)
    if b"a1" in by_sign or b"a*" in by_sign or b"*a" in by_sign or "€" in text:
        return True
    by_space = raw.translate(_BY_SPACE)
    if b" a a " in by_space or b" a  a " in by_space:
        return True
    codes = np.frombuffer(raw, np.uint8)
    same = codes[1:] == codes[:-1]
    return bool(_LETTER[codes[2:][same[1:] & same[:-1]]].any())


@dataclass
class CharModel:
    """Character n-grams with counts; the probability of a letter backs off to shorter contexts."""

    counts: dict[str, int]
    heads: dict[str, int] = field(default_factory=dict)
    _lexicons: dict = field(default_factory=dict, init=False, repr=False, compare=False)

    def __post_init__(self) -> None:
        if not self.heads:
            heads: dict[str, int] = defaultdict(int)
            for g, n in self.counts.items():
                heads[g[:-1]] += n
            self.heads = dict(heads)

    def log_p(self, context: str, c: str) -> float:
        """Witten-Bell-like interpolation from the empty context up."""
        p = 1 / (len(LETTERS) + 1)
        for k in range(0, ORDER):
            h = context[len(context) - k :] if k else ""
            if n := self.heads.get(h, 0):
                p = (self.counts.get(h + c, 0) + 4 * p) / (n + 4)
        return math.log(p)

    def lexicon(self, known: frozenset[str]) -> tuple[list[dict[str, int]], dict[int, tuple[float, str]]]:
        """The known words as a trie: the next node by letter of each node, and (log probability, word) where a word ends."""
        if known not in self._lexicons:
            after: list[dict[str, int]] = [{}]
            ends: dict[int, tuple[float, str]] = {}
            for word in known:
                at = 0
                for c in word:
                    if c not in after[at]:
                        after[at][c] = len(after)
                        after.append({})
                    at = after[at][c]
                s = "^" * (ORDER - 1) + word + "$"
                ends[at] = (sum(self.log_p(s[i - ORDER + 1 : i], s[i]) for i in range(ORDER - 1, len(s))), word)
            self._lexicons[known] = after, ends
        return self._lexicons[known]

    def decode(self, lattice: list[list[str]], known: frozenset[str]) -> str:
        """The likeliest known word through the lattice (alternatives of each place, "" for none, which costs 1), or "" if there is none.

        Every path that spells a known word is followed: what is kept for a prefix is its fewest places without a letter, and its probability is the same on each path.
        """
        after, ends = self.lexicon(known)
        paths = {0: 0}
        for options in lattice:
            nxt: dict[int, int] = {}
            for at, skipped in paths.items():
                for o in options:
                    to, n = (after[at].get(o), skipped) if o else (at, skipped + 1)
                    if to is not None and n < nxt.get(to, n + 1):
                        nxt[to] = n
            paths = nxt
        return max(((ends[at][0] - n, ends[at][1]) for at, n in paths.items() if at in ends), default=(0.0, ""))[1]


def restore(passage: str, model: CharModel, known: frozenset[str]) -> str:
    """The passage with masked words replaced by what they stand for, where that is a known word."""

    def put(token: str) -> str:
        letters: list[list[str]] = []
        run = 0
        chars = [c for c in token.lower() if c.isalnum() or c in LOOK_ALIKES]
        for i, c in enumerate(chars):
            run = run + 1 if i and c == chars[i - 1] and c.isalpha() else 1
            if run > 2:
                continue
            options = list(LOOK_ALIKES.get(c, c))
            letters.append([*options, ""] if run == 2 or c in "*!+$" and i in (0, len(chars) - 1) else options)
        return len(letters) >= 3 and model.decode(letters, known) or token

    def spaced(m: re.Match) -> str:
        """A run of single characters; other words of one letter may stand at either end of it."""
        at = [k for k, c in enumerate(m.group()) if c not in " .-_·*" or (k % 2 == 0 and c == "*")]
        for skip in range(3):
            for a in range(skip + 1):
                part = at[a : len(at) - (skip - a)]
                if len(part) > 3 and (word := put("".join(m.group()[k] for k in part))) in known:
                    return m.group()[: part[0]] + word + m.group()[part[-1] + 1 :]
        return m.group()

    s = SPACED.sub(spaced, passage)
    s = SIGNED.sub(lambda m: put(m.group()), s)
    return REPEATED.sub(lambda m: put(m.group()), s)


def features(words: list[str]) -> np.ndarray:
    """Hashed words and word pairs of a passage, each once."""
    grams = {*words, *(f"{a} {b}" for a, b in zip(words, words[1:]))}
    return np.fromiter((xxhash.xxh32_intdigest(g) % BUCKETS for g in grams), np.int64, len(grams))


def pair_feature(pair: str) -> int:
    return xxhash.xxh32_intdigest(pair) % BUCKETS


@dataclass
class Classifier:
    weights: np.ndarray
    bias: float
    triggers: frozenset[str]
    chars: CharModel

    threshold: float = THRESHOLD

    @property
    def base(self) -> float:
        """The probability of a passage without evidence."""
        return 1 / (1 + math.exp(-max(-30.0, min(30.0, self.bias))))

    def score(self, words: list[str]) -> float:
        """The probability of a passage."""
        if self.triggers.isdisjoint(words):
            return self.base
        return 1 / (1 + math.exp(-max(-30.0, min(30.0, self.bias + float(self.weights[features(words)].sum())))))

    def document(self, text: str | None) -> tuple[float, str | None]:
        """(score, passage) of the worst passage of the whole text; its evidence may be masked. (0, None) for null and empty texts, (base, None) for texts without evidence."""
        if not text:
            return 0.0, None
        p = plain(text)
        if self._bytes().isdisjoint(byte_words(p.lower().encode("utf-8", "replace"))) and (not may_be_masked(p) or restore(p, self.chars, self.triggers) == p):
            return self.base, None
        best = (self.base, None)
        for p in PASSAGE.split(p):
            q = restore(p, self.chars, self.triggers) if may_be_masked(p) else p
            s = self.score(WORD.findall(q.lower()))
            if s > best[0]:
                best = (s, p)
        return best

    def _bytes(self) -> frozenset[bytes]:
        if not hasattr(self, "_raw"):
            self._raw = frozenset(t.encode() for t in self.triggers)
        return self._raw


def plain(text: str) -> str:
    """The text without code and addresses."""
    return CODE.sub(" ", text) if "`" in text or "://" in text else text


def passages(text: str) -> list[str]:
    """Sentences, lines of lists and headings of the text without code and addresses; a broken line does not end one."""
    return [p for p in PASSAGE.split(plain(text)) if p and not p.isspace()]


def word_counts(documents: DataFrame, text: str = "text") -> DataFrame:
    """(word, n) of words of letters over all whole texts, counted per batch first."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        seen: Counter[bytes] = Counter()

        def out() -> pa.RecordBatch:
            got = [(w, n) for b, n in seen.items() if (w := b.decode("utf-8", "ignore")).isalpha()]
            seen.clear()
            w, n = zip(*got) if got else ((), ())
            return pa.RecordBatch.from_arrays([pa.array(w, pa.string()), pa.array(n, pa.int64())], names=["word", "n"])

        for b in batches:
            for t in b.column(0).to_pylist():
                if t:
                    seen.update(byte_words(t.lower().encode("utf-8", "replace")))
            if len(seen) > 200_000:
                yield out()
        yield out()

    return documents.select(text).mapInArrow(run, "word string, n long").groupBy("word").agg(F.sum("n").alias("n"))


def char_model(words: DataFrame) -> CharModel:
    """The character model of all words of LETTERS, each weighted by the logarithm of its frequency."""
    w = words.filter(F.col("word").rlike(f"^[{LETTERS}]+$")).select(F.concat(F.lit("^" * (ORDER - 1)), "word", F.lit("$")).alias("w"), F.ceil(F.log2(F.col("n") + 1)).cast("long").alias("n"))
    grams = F.explode(F.flatten(F.transform(F.sequence(F.lit(ORDER), F.length("w")), lambda i: F.transform(F.sequence(F.lit(1), F.lit(ORDER)), lambda k: F.substring(F.col("w"), i - k + 1, k)))))
    counted = w.select(grams.alias("g"), "n").groupBy("g").agg(F.sum("n").alias("n"))
    return CharModel({r["g"]: r["n"] for r in counted.collect()})


def verdicts(labels: DataFrame, most: int = FIT_DOCUMENTS) -> DataFrame:
    """(doc_id, share): the share of raters that found a document toxic, of up to most documents by smallest hash; a rater's last word counts."""
    votes = labels.filter("doc_id is not null and toxic is not null").select("doc_id", "rater", "toxic", "rated_at").distinct()
    votes = votes.groupBy("doc_id", "rater").agg(F.max_by("toxic", F.struct(F.coalesce("rated_at", F.lit("1970-01-01").cast("timestamp")), "toxic")).alias("toxic")).groupBy("doc_id").agg(F.avg("toxic").alias("share"))
    return votes.orderBy(F.xxhash64("doc_id")).limit(most)


def judged_texts(documents: DataFrame, labels: DataFrame, most: int = FIT_DOCUMENTS) -> DataFrame:
    """(doc_id, text, share) of the judged documents that have a text."""
    return documents.select("doc_id", "text").filter("text is not null").join(F.broadcast(verdicts(labels, most)), "doc_id").select("doc_id", "text", "share")  # at most `most` votes


def judged(documents: DataFrame, labels: DataFrame, most: int = FIT_DOCUMENTS) -> list[tuple[str, float]]:
    """judged_texts on the driver, for small texts; train() leaves texts where they are."""
    return [(r["text"], r["share"]) for r in judged_texts(documents, labels, most).select("text", "share").collect()]


def heard(text: str, chars: CharModel, known: frozenset[str]) -> list[list[str]]:
    """The words of each passage, masked ones restored."""
    return [WORD.findall((restore(p, chars, known) if may_be_masked(p) else p).lower()) for p in passages(text)]


def fold_of(text: str) -> int:
    return xxhash.xxh32_intdigest(text) % FOLDS


@dataclass
class Example:
    """A judged document: its passages with evidence, how many others it has, and the fold it is held out in."""

    toxic: bool
    passages: list[list[str]]
    others: int
    fold: int


@dataclass
class Counted:
    """By word: in how many judged documents of each fold and class it occurs (folds x 2, toxic last), and how often in the corpus."""

    seen: dict[str, np.ndarray]
    documents_of: np.ndarray
    corpus: dict[str, int]
    documents: int

    def evidence(self, without: int | None = None) -> tuple[frozenset[str], dict[str, float]]:
        """(words that speak for the class, log odds of those that were learned), by all folds but one.

        A word is learned if it occurs in toxic documents LIFT times as often as in the corpus and a binomial test says that less than one word
        would by chance. A word of OFFENSIVE counts unless the judged documents speak against it.
        """
        use = np.ones(FOLDS, bool)
        if without is not None:
            use[without] = False
        toxic = int(self.documents_of[use, 1].sum())
        rate = lambda w: min(1.0, (self.corpus.get(w, 0) + 1) / max(self.documents, 1))
        n = {w: int(c[use, 1].sum()) for w, c in self.seen.items() if len(w) > 2}
        n = {w: k for w, k in n.items() if k}
        odds = {}
        for w, k in n.items():
            if k > 1 and (k - 1) / toxic >= LIFT * rate(w) and log_tail(k, toxic, rate(w)) <= -math.log(len(n)):
                odds[w] = math.log(k / toxic / rate(w))
        known = {w for w in OFFENSIVE if w not in self.seen or not self.seen[w][use].sum() or (n.get(w, 0) + 0.5) / max(1, toxic) >= LIFT * rate(w)}
        return frozenset(odds) | known, odds


    def clean_weight(self, odds: dict[str, float]) -> float:
        """How many documents of the corpus a judged clean one stands for, against a toxic one.

        People are shown more toxic documents than the corpus holds. A word that only toxic documents use is 1 / prevalence times as frequent in them as in the corpus, so
        the lift of the strongest tenth of what was learned tells the prevalence. 1 with fewer than 10 learned words.
        """
        toxic, clean = int(self.documents_of[:, 1].sum()), int(self.documents_of[:, 0].sum())
        if len(odds) < 10 or not toxic or not clean:
            return 1.0
        lift = math.exp(float(np.quantile(list(odds.values()), 0.9)))
        return max(1.0, (lift - 1) * toxic / clean)


def log_tail(k: int, n: int, p: float) -> float:
    """ln P(X >= k) of a binomial distribution."""
    if p >= 1 or k <= 0:
        return 0.0
    term = math.lgamma(n + 1) - math.lgamma(k + 1) - math.lgamma(n - k + 1) + k * math.log(p) + (n - k) * math.log1p(-p)
    total, t, x = 1.0, 1.0, k
    while x < n and t > total * 1e-12:
        t *= (n - x) / (x + 1) * p / (1 - p)
        total += t
        x += 1
    return min(0.0, term + math.log(total))


def regression(examples: list[Example], triggers: frozenset[str], odds: dict[str, float], clean_weight: float = 1.0, rounds: int = 3, steps: int = 200) -> tuple[dict[str, float], float]:
    """(weights of words and pairs, bias) by alternation: the worst passage of a document judged toxic stands for it, all passages of others are clean.

    Weights are drawn towards a prior that knows OFFENSIVE words. Only words that speak for the class and pairs with one may weigh for it. Words and pairs of a single judged
    document are not learned. Passages without evidence count by their number, clean ones clean_weight times.
    """
    known = frozenset(OFFENSIVE)
    ids: dict[str, int] = {}
    seen_in: Counter[str] = Counter()
    grams_of: list[tuple[int, set[str]]] = []
    rest = 0
    for d, e in enumerate(examples):
        mine: set[str] = set()
        kept = [p for p in e.passages if not triggers.isdisjoint(p)]
        rest += 0 if e.toxic else e.others + len(e.passages) - len(kept)
        for p in kept:
            grams = {*p, *(f"{a} {b}" for a, b in zip(p, p[1:]))}
            grams_of.append((d, grams))
            mine |= grams
        seen_in.update(mine)
    for g in sorted(seen_in):
        if seen_in[g] > 1 or g in known:
            ids[g] = len(ids)
    index_of = [np.fromiter(sorted(ids[g] for g in gs if g in ids), np.int64) for _, gs in grams_of]
    doc = np.array([d for d, _ in grams_of], np.int64)
    row = np.repeat(np.arange(len(index_of)), [len(i) for i in index_of])
    index = np.concatenate(index_of) if index_of else np.zeros(0, np.int64)
    n, size = len(index_of), len(ids)
    prior, may_rise, lift = np.zeros(size), np.zeros(size, bool), np.zeros(size)
    for g, i in ids.items():
        may_rise[i] = not triggers.isdisjoint(g.split(" "))
        prior[i] = PRIOR_WEIGHT if g in known and g in triggers else 0.0
        lift[i] = odds.get(g, 0.0)
    top = np.where(may_rise, 8.0, 0.0)
    penalty = np.where(may_rise, PENALTY, CONTEXT * PENALTY)
    w, bias = prior.copy(), PRIOR_BIAS
    score = np.bincount(row, weights=np.maximum(lift, prior)[index], minlength=n) if len(index) else np.zeros(n)
    clean = ~np.array([e.toxic for e in examples], bool)[doc] if n else np.zeros(0, bool)
    m, v, mb, vb, t = np.zeros(size), np.zeros(size), 0.0, 0.0, 0
    for _ in range(rounds if len(index) else 0):
        order = np.lexsort((score, doc))
        worst = np.zeros(n, bool)
        worst[order[np.append(doc[order][1:] != doc[order][:-1], True)]] = True
        y = (worst & ~clean).astype(float)
        weight = np.maximum(y, clean * clean_weight)
        total = y.sum() + clean.sum() + rest  # the penalty is against passages, whatever they weigh
        for _ in range(steps):
            t += 1
            z = bias + np.bincount(row, weights=w[index], minlength=n)
            g = weight / total * (1 / (1 + np.exp(-np.clip(z, -30, 30))) - y)
            gw = np.bincount(index, weights=g[row], minlength=size) + penalty * (w - prior)
            gb = g.sum() + rest * clean_weight / total / (1 + math.exp(-max(-30.0, min(30.0, bias))))
            m, v = 0.9 * m + 0.1 * gw, 0.99 * v + 0.01 * gw * gw
            mb, vb = 0.9 * mb + 0.1 * gb, 0.99 * vb + 0.01 * gb * gb
            w = np.minimum(w - 0.08 * (m / (1 - 0.9**t)) / (np.sqrt(v / (1 - 0.99**t)) + 1e-7), top)
            bias -= 0.08 * (mb / (1 - 0.9**t)) / (math.sqrt(vb / (1 - 0.99**t)) + 1e-7)
        score = bias + np.bincount(row, weights=w[index], minlength=n)
    return {**{g: PRIOR_WEIGHT for g in known & triggers}, **{g: float(w[i]) for g, i in ids.items()}}, float(bias)


def held_out(examples: list[Example], counted: Counted) -> tuple[np.ndarray, np.ndarray]:
    """(score, judged toxic) of every example by a model of the other folds."""
    scores = np.zeros(len(examples))
    for f in range(FOLDS):
        triggers, odds = counted.evidence(f)
        weights, bias = regression([e for e in examples if e.fold != f], triggers, odds, counted.clean_weight(odds))
        for i, e in enumerate(examples):
            if e.fold == f:
                zs = [sum(weights.get(g, 0.0) for g in {*p, *(f"{a} {b}" for a, b in zip(p, p[1:]))}) for p in e.passages if not triggers.isdisjoint(p)]
                scores[i] = 1 / (1 + math.exp(-max(-30.0, min(30.0, bias + max([0.0, *zs])))))
    return scores, np.array([e.toxic for e in examples], bool)


def best_threshold(scores: np.ndarray, toxic: np.ndarray, clean_weight: float = 1.0) -> float:
    """The middle of the thresholds of greatest F1 that lie side by side, clean documents counting clean_weight times; THRESHOLD where too few are toxic."""
    if toxic.sum() < LEAST_TOXIC:
        return THRESHOLD
    grid = 1 / (1 + np.exp(-np.linspace(-5, 5, 201)))
    found = scores[None, :] >= grid[:, None]
    hit = (found & toxic).sum(1)
    wrong = (found & ~toxic).sum(1) * clean_weight
    f1 = 2 * hit / np.maximum(1, hit + wrong + toxic.sum())
    at = first = int(f1.argmax())
    while at + 1 < len(grid) and f1[at + 1] == f1[first]:
        at += 1
    return float(math.sqrt(grid[first] * grid[at]))


def assembled(examples: list[Example], counted: Counted, chars: CharModel) -> Classifier:
    triggers, odds = counted.evidence()
    share = counted.clean_weight(odds)
    made, bias = regression(examples, triggers, odds, share)
    weights = np.zeros(BUCKETS, np.float32)
    for g in sorted(made):
        weights[pair_feature(g)] = made[g]
    enough = sum(e.toxic for e in examples) >= LEAST_TOXIC
    return Classifier(weights, bias, triggers, chars, best_threshold(*held_out(examples, counted), share) if enough else THRESHOLD)


def fit(rows: list[tuple[str, float]], chars: CharModel, corpus: dict[str, int], documents: int) -> Classifier:
    """The classifier of judged texts (text, share of raters that found it toxic) on the driver; corpus holds the occurrences of words in all documents."""
    known = frozenset(OFFENSIVE)
    texts = [(heard(t, chars, known), s >= 0.5, fold_of(t)) for t, s in rows]
    seen: dict[str, np.ndarray] = defaultdict(lambda: np.zeros((FOLDS, 2), np.int64))
    per = np.zeros((FOLDS, 2), np.int64)
    for ps, toxic, fold in texts:
        per[fold, int(toxic)] += 1
        for w in {w for p in ps for w in p}:
            seen[w][fold, int(toxic)] += 1
    counted = Counted(dict(seen), per, corpus, documents)
    wanted = _candidates(counted)
    examples = []
    for (t, s), (_, toxic, fold) in zip(rows, texts):
        ps = heard(t, chars, wanted)
        kept = [p for p in ps if not wanted.isdisjoint(p)]
        examples.append(Example(toxic, kept, len(ps) - len(kept), fold))
    return assembled(examples, counted, chars)


def _candidates(counted: Counted) -> frozenset[str]:
    """The words that speak for the class in the whole or without one of the folds."""
    return frozenset().union(*(counted.evidence(f)[0] for f in (None, *range(FOLDS))))


def train(documents: DataFrame, labels: DataFrame, most: int = FIT_DOCUMENTS) -> Classifier:
    """The classifier for these documents: character model and word rates of all of them, judgements of up to `most`.

    Judged texts stay on the executors: what comes to the driver are counts of words that occur in two documents judged toxic or are OFFENSIVE, and the passages that hold a word
    that speaks for the class.
    """
    spark = documents.sparkSession
    counts = through_table(word_counts(documents), "words")
    chars = char_model(counts)
    shared = spark.sparkContext.broadcast(chars)  # n-grams of LETTERS
    texts = through_table(judged_texts(documents, labels, most).select("text", "share"), "judged")
    known = frozenset(OFFENSIVE)

    def per_word(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            out = [(w, fold_of(t), int(s >= 0.5)) for t, s in zip(b.column(0).to_pylist(), b.column(1).to_pylist()) for w in {w for p in heard(t, shared.value, known) for w in p}]
            out += [("", fold_of(t), int(s >= 0.5)) for t, s in zip(b.column(0).to_pylist(), b.column(1).to_pylist())]
            w, f, y = zip(*out) if out else ((),) * 3
            yield pa.RecordBatch.from_arrays([pa.array(w, pa.string()), pa.array(f, pa.int32()), pa.array(y, pa.int32())], names=["word", "fold", "toxic"])

    cells = texts.mapInArrow(per_word, "word string, fold int, toxic int").groupBy("word").agg(*(F.count_if((F.col("fold") == f) & (F.col("toxic") == y)).alias(f"n{f}{y}") for f in range(FOLDS) for y in (0, 1)))
    toxic = sum((F.col(f"n{f}1") for f in range(FOLDS)), F.lit(0))
    cells = cells.join(counts, "word", "left").filter((toxic > 0) | F.col("word").isin(sorted(known)) | (F.col("word") == ""))
    seen, corpus, per = {}, {}, np.zeros((FOLDS, 2), np.int64)
    for r in cells.collect():  # words of at most `most` documents judged toxic
        grid = np.array([[r[f"n{f}{y}"] for y in (0, 1)] for f in range(FOLDS)], np.int64)
        if r["word"]:
            seen[r["word"]], corpus[r["word"]] = grid, r["n"] or 0
        else:
            per = grid
    for r in counts.filter(F.col("word").isin(sorted(known - corpus.keys()))).collect():
        corpus[r["word"]] = r["n"]
    counted = Counted(seen, per, corpus, documents.count())
    wanted = _candidates(counted)

    def per_text(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            rows = []
            for t, s in zip(b.column(0).to_pylist(), b.column(1).to_pylist()):
                ps = heard(t, shared.value, wanted)
                kept = [" ".join(p) for p in ps if not wanted.isdisjoint(p)]
                rows.append((s >= 0.5, kept, len(ps) - len(kept), fold_of(t)))
            y, p, o, f = zip(*rows) if rows else ((),) * 4
            yield pa.RecordBatch.from_arrays([pa.array(y, pa.bool_()), pa.array(p, pa.list_(pa.string())), pa.array(o, pa.int64()), pa.array(f, pa.int32())], names=["toxic", "passages", "others", "fold"])

    got = texts.mapInArrow(per_text, "toxic boolean, passages array<string>, others long, fold int").collect()
    examples = sorted((Example(r["toxic"], [p.split(" ") for p in r["passages"]], r["others"], r["fold"]) for r in got), key=lambda e: (e.fold, e.toxic, e.passages))
    return assembled(examples, counted, chars)


def toxicity(documents: DataFrame, model: Classifier, keep: list[str], text: str = "text") -> DataFrame:
    """The columns keep with toxicity (0 .. 1, of the worst passage) and that passage. Null and empty texts score 0, texts without evidence the model's base. One pass, no shuffle."""
    from pyspark.sql.types import DoubleType, StringType, StructField, StructType

    shared = documents.sparkSession.sparkContext.broadcast(model)  # BUCKETS weights, the n-grams of words of LETTERS
    schema = StructType([*(documents.schema[c] for c in keep), StructField("toxicity", DoubleType(), False), StructField("passage", StringType())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            got = [shared.value.document(t) for t in b.column(len(keep)).to_pylist()]
            s, p = zip(*got) if got else ((), ())
            yield pa.RecordBatch.from_arrays([*b.columns[: len(keep)], pa.array(s, pa.float64()), pa.array(p, pa.string())], names=schema.names)

    return documents.select(*keep, text).mapInArrow(run, schema)


def toxicity_rates(scored: DataFrame, source: str = "source", threshold: float = THRESHOLD) -> DataFrame:
    """(source, documents, flagged, rate); names compare without case and outer blanks, null is its own source."""
    key = F.lower(F.regexp_replace(source, r"^\s+|\s+$", ""))
    return scored.groupBy(key.alias("source")).agg(F.count("*").alias("documents"), F.count_if(F.col("toxicity") >= threshold).alias("flagged")).withColumn("rate", F.col("flagged") / F.col("documents"))
