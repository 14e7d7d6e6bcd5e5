"""Markup residue in text (p5): pieces of a text are labelled content or residue by a minimum cut.

A text is split into pieces: code, formulas, markup constructs of HTML, wiki and LaTeX, and the runs of text between them. What a
classifier would pay for either label of a piece is its capacity to the two terminals; neighbouring texts, texts of one element and the tags of an
HTML element are joined by smoothness edges; a maximum flow gives the cheapest labelling. The kind of a construct settles its label; what a text would pay comes from a
logistic regression on its length, links, punctuation and the elements around it, fitted on pages that are made by rule, and the cut decides between it and its neighbours.
"""

from __future__ import annotations

import html
import math
import random
import re
from collections import deque
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql.types import IntegerType, StringType, StructField, StructType

# fixed values: the element names of HTML
ELEMENTS = """a abbr acronym address applet area article aside audio b base basefont bdi bdo big blockquote body br button canvas caption
center cite code col colgroup data datalist dd del details dfn dialog dir div dl dt em embed fieldset figcaption figure font footer
form frame frameset h1 h2 h3 h4 h5 h6 head header hr html i iframe img input ins kbd label legend li link main map mark math menu
meta meter nav noframes noscript object ol optgroup option output p param picture pre progress q ref references rp rt ruby s samp
script section select small source span strike strong style sub summary sup svg table tbody td template textarea tfoot th thead
time title tr track tt u ul var video wbr nowiki gallery poem""".split()
# fixed values: LaTeX commands that stand without an argument and say nothing, and those that are words or signs of a text; others are formulas
LAYOUT = frozenset("""noindent indent newline linebreak pagebreak newpage clearpage cleardoublepage maketitle tableofcontents listoffigures listoftables centering
raggedright raggedleft hline toprule midrule bottomrule par bigskip medskip smallskip hfill vfill hrule quad qquad appendix tiny scriptsize footnotesize small
normalsize large Large LARGE huge Huge bfseries itshape ttfamily sffamily rmfamily selectfont null relax protect frontmatter mainmatter backmatter""".split())
SAID = {"LaTeX": "LaTeX", "TeX": "TeX", "ldots": "…", "dots": "…", "textbackslash": "\\"}

CODE = r"(?P<fence>^[ \t]{0,3}(?P<f>`{3,}|~{3,})[^\n]*(?:\n(?!^[ \t]{0,3}(?P=f))[^\n]*)*(?:\n[ \t]{0,3}(?P=f)[`~]*[ \t]*$)?)|(?P<tick>(?P<t>`+)(?!`)(?:(?!\n\s*\n)[\s\S])*?(?<!`)(?P=t)(?!`))"
MATH = r"(?P<display>\$\$[\s\S]*?\$\$)|(?P<math>(?<![\\$\w])\$(?=[^\s$])[^$\n]*?(?<=[^\s\\$])\$(?![\d$]))"
TAG = rf"(?P<tag></?(?P<name>(?i:{'|'.join(sorted(ELEMENTS, key=len, reverse=True))}))(?=[\s/>])(?:[^<>\"']|\"[^\"]*\"|'[^']*')*>)"
HTML = rf"(?P<comment><!--[\s\S]*?(?:-->|\Z))|(?P<doctype><!(?i:doctype)[^>]*>)|(?P<script><(?P<raw>(?i:script|style))\b[^>]*>[\s\S]*?</(?P=raw)\s*>)|{TAG}|(?P<entity>&(?:\#\d{{1,7}}|\#[xX][0-9a-fA-F]{{1,6}}|[a-zA-Z][a-zA-Z0-9]{{1,31}});)"
WIKI = r"(?P<template>\{\{)|(?P<table>^[ \t]*(?:\{\||\|\}|\|-+(?![^\n]*\|)|\|\+)[^\n]*$)|(?P<cell>^[ \t]*[|!][^|\n]*?(?:\|\||!!)[^\n]*$)|(?P<heading>^(?P<eq>={1,6})[ \t]*[^=\n][^\n]*?(?P=eq)[ \t]*$)|(?P<media>\[\[(?i:category|file|image|media|kategorie|datei|bild|catégorie|fichier|categoría|archivo):(?:[^\[\]]|\[\[[^\[\]]*\]\])*\]\])|(?P<magic>__[A-Z]{3,}__)|(?P<xlink>\[(?:https?|ftp)://[^\s\]]+(?:\s[^\]\n]*)?\](?!\())|(?P<quotes>(?<!')'{2,5}(?!'))"
LATEX = rf"(?P<dispmath>\\\[[\s\S]*?(?:\\\]|\Z))|(?P<inmath>\\\([\s\S]*?(?:\\\)|\Z))|(?P<env>\\(?:begin|end)\s*\{{[^{{}}\n]*\}}(?:\[[^\]\n]*\])?(?:\{{[^{{}}\n]*\}})?)|(?P<command>\\[a-zA-Z]+\*?(?:\[[^\]\n]*\])?\{{)|(?P<bare>(?<![\w:\\/.])(?<!\w%)\\(?![bdfnrstvwzABDSWZ](?![a-zA-Z]))[a-zA-Z]+\*?(?![a-zA-Z\\/:]|\.\w|_[a-zA-Z]{{2}}|-[a-zA-Z])|(?<![:\\/.])\\\\(?:\[[^\]\n]*\])?(?=[ \t]*$))"
OTHER = r"(?P<autolink><(?:https?|ftp|mailto):[^<>\s]*>)|(?P<generic>\b[A-Z]\w*<(?:[\w:&]+(?:,[ ]?[\w:&]+)*|[A-Z]\w*<[\w:&]+>)>)|(?P<note>\[\[(?!(?i:category|file|image|media|kategorie|datei|bild|catégorie|fichier|categoría|archivo):)[^\[\]\n]*\]\])"
PIECES = re.compile("|".join((CODE, MATH, OTHER, HTML, WIKI, LATEX)), re.M)
#: Texts without any of these have no piece that could be markup.
HINT = re.compile(r"[<&\\]|\{\{|\{\||\[\[|\[https?:|\[ftp:|''|^=|__[A-Z]|^[ \t]*[|!]", re.M)
CODE_OR_MATH = ("fence", "tick", "display", "math")

# What the two labels of a piece cost: (content, residue). Fixed parameters of the classifier.
COSTS = {
    "fence": (0, 90), "tick": (0, 90), "display": (0, 90), "math": (0, 90), "autolink": (2, 60), "generic": (2, 60), "note": (2, 60),
    "comment": (90, 0), "doctype": (90, 0), "script": (90, 0), "tag": (80, 2), "entity": (70, 4), "template": (80, 2), "table": (80, 2), "cell": (60, 6), "heading": (70, 4),
    "media": (80, 2), "magic": (80, 2), "xlink": (70, 4), "quotes": (60, 6), "dispmath": (70, 4), "inmath": (70, 4), "env": (80, 2), "command": (80, 2), "bare": (60, 6),
}
NEXT, SAME_ELEMENT = 3, 2
# fixed values: words in the class, id or role of what a page has around its content
FURNITURE = frozenset("""nav navbar navigation menu submenu breadcrumb breadcrumbs cookie cookies consent gdpr banner footer sidebar advert advertisement ads
promo share sharing social newsletter subscribe pager pagination toolbar masthead popup modal contentinfo skiplink""".split())
BLOCK_TAG = re.compile(r"</?(?:p|div|blockquote|table|tr|td|th|ul|ol|li|section|article|figure|form|pre|center|dl|dt|dd|h[1-6]|nav|header|footer|aside|main|menu|dialog|br|hr)\b", re.I)


def min_cut(costs: list[tuple[int, int]], edges: list[tuple[int, int, int]]) -> list[bool]:
    """For each node whether it is cut off from the source, that is takes its second label, at least total cost.

    A node pays costs[i][0] for the first label and costs[i][1] for the second, and each edge (i, j, w) pays w if its ends
    differ. Shortest augmenting paths; a tie goes to the first label.
    """
    n = len(costs)
    # source -> i has the cost of the second label, i -> sink that of the first; what flows straight through is taken off
    src = [b - min(a, b) for a, b in costs]
    snk = [a - min(a, b) for a, b in costs]
    cap: list[dict[int, int]] = [{} for _ in range(n)]
    for i, j, w in edges:
        cap[i][j] = cap[i].get(j, 0) + w
        cap[j][i] = cap[j].get(i, 0) + w
    while True:
        seen: list[int | None] = [None] * n
        queue = deque(i for i in range(n) if src[i])
        for i in queue:
            seen[i] = -1
        end = None
        while queue:
            i = queue.popleft()
            if snk[i]:
                end = i
                break
            for j, w in cap[i].items():
                if w and seen[j] is None:
                    seen[j] = i
                    queue.append(j)
        if end is None:
            # reachable backwards from the sink: the second label only where the first would cost more
            back = [bool(s) for s in snk]
            todo = [i for i in range(n) if back[i]]
            while todo:
                j = todo.pop()
                for i in cap[j]:
                    if cap[i].get(j) and not back[i]:
                        back[i] = True
                        todo.append(i)
            return back
        path = [end]
        while seen[path[-1]] != -1:
            path.append(seen[path[-1]])
        path.reverse()
        flow = min([src[path[0]], snk[end], *(cap[a][b] for a, b in zip(path, path[1:]))])
        src[path[0]] -= flow
        snk[end] -= flow
        for a, b in zip(path, path[1:]):
            cap[a][b] -= flow
            cap[b][a] += flow


def balanced(text: str, token: str) -> dict[int, int]:
    """Where each opening token ends that is closed, by a stack over one pass; token matches openings (which end in "{") and closings."""
    ends: dict[int, int] = {}
    opened: list[int] = []
    for m in re.finditer(token, text):
        if m.group().endswith("{"):
            opened.append(m.start())
        elif opened:
            ends[opened.pop()] = m.end()
    return ends


def split(text: str) -> list[tuple[str, str]]:
    """(kind, piece) over the whole text; kind "text" for what is no construct. Templates and the arguments of commands may be nested to any depth."""
    out: list[tuple[str, str]] = []
    at = done = 0
    double: dict[int, int] | None = None
    single: dict[int, int] | None = None
    while m := PIECES.search(text, at):
        kind = m.lastgroup if m.lastgroup in COSTS else next(k for k in COSTS if m.group(k) is not None)
        end: int | None = m.end()
        if kind == "template":
            double = balanced(text, r"\{\{|\}\}") if double is None else double
            end = double.get(m.start())
        elif kind == "command":
            single = balanced(text, r"(?<!\\)[{}]") if single is None else single
            end = single.get(m.end() - 1)
            if end is None:  # an argument that never ends: the command stands by itself
                kind, end = "bare", m.start() + len(re.match(r"\\[a-zA-Z]+\*?", m.group()).group())
        if end is None:
            at = m.end()
            continue
        if m.start() > done:
            out.append(("text", text[done : m.start()]))
        out.append((kind, text[m.start() : end]))
        at = done = end
    if done < len(text):
        out.append(("text", text[done:]))
    return out


def elements(parts: list[tuple[str, str]]) -> list[tuple[int, int, int]]:
    """(first tag, last tag, first tag of the element around it or -1) of each HTML element that is closed, inner ones first."""
    out: list[tuple[int, int, int]] = []
    open_tags: list[tuple[str, int]] = []
    for i, (k, p) in enumerate(parts):
        if k == "tag":
            name = re.match(r"</?(\w+)", p).group(1).lower()
            if p.startswith("</"):
                for d in range(len(open_tags) - 1, -1, -1):
                    if open_tags[d][0] == name:
                        out.append((open_tags[d][1], i, open_tags[d - 1][1] if d else -1))
                        del open_tags[d:]
                        break
            elif not p.endswith("/>") and name not in ("br", "img", "hr", "input", "meta", "link", "wbr", "col"):
                open_tags.append((name, i))
    return out


def is_furniture(tag: str) -> bool:
    """Whether a tag opens a part of a page that is there on every page: by its name, role, class or id."""
    if re.match(r"<(?:footer|menu|dialog)\b", tag, re.I):
        return True
    given = re.findall(r"""\b(?:class|id|role)\s*=\s*(?:"([^"]*)"|'([^']*)'|([^\s>"']+))""", tag, re.I)
    return any(w in FURNITURE for g in given for w in re.split(r"[\s_-]+", "".join(g).lower()))


FEATURES = ("bias", "words", "linked", "sentence", "commas", "furniture", "menu", "short", "kept", "capitals", "outside")


def features(parts: list[tuple[str, str]], closed: list[tuple[int, int, int]]) -> dict[int, list[float]]:
    """What the classifier sees of each text with words, in order of FEATURES."""
    words = {i: p.split() for i, (k, p) in enumerate(parts) if k == "text" and not p.isspace()}
    words = {i: w for i, w in words.items() if any(c.isalnum() for x in w for c in x)}
    linked, furniture, menu, kept, inside_any = set(), set(), set(), set(), set()
    for a, z, _ in closed:
        name = re.match(r"<(\w+)", parts[a][1]).group(1).lower()
        inside = [i for i in range(a + 1, z) if i in words]
        if name == "a":
            linked.update(inside)
        elif re.fullmatch("h[1-6]|pre|code", name):
            kept.update(inside)
        if BLOCK_TAG.match(parts[a][1]) or name == "a":
            inside_any.update(inside)
        if is_furniture(parts[a][1]):
            furniture.update(inside)
    for a, z, _ in closed:
        if re.match(r"<(?:ul|ol|div|p|td|section)\b", parts[a][1], re.I):
            inside = [i for i in range(a + 1, z) if i in words]
            if len(inside) >= 3 and linked.issuperset(inside) and all(len(words[i]) <= 3 for i in inside) and all(k in ("tag", "text", "entity") for k, _ in parts[a:z]):
                menu.update(inside)
    out = {}
    for i, w in words.items():
        t = parts[i][1].strip()
        capitals = sum(x[:1].isupper() for x in w) / len(w)
        out[i] = [1.0, min(len(w), 40) / 10, i in linked, bool(re.search(r"[.!?…;]$", t)), min(t.count(","), 3) / 3, i in furniture, i in menu, len(w) <= 3, i in kept and i not in linked, capitals, i not in inside_any]
    return out


def made_page(rng: random.Random) -> tuple[str, list[tuple[str, bool]]]:
    """A page made by rule, and its texts with whether each is boilerplate: what the classifier is fitted on.

    Menus, consent boxes, footers and link lists stand around an article; some of them have no telling name, and some boxes with a telling name hold content.
    """
    noun = lambda: rng.choice("report ledger harbour engine garden letter window index reader queue change policy table night".split())
    sentence = lambda: f"The {noun()} of the {noun()}{rng.choice(['', ', which was late,', ' and the ' + noun()])} {rng.choice(['holds', 'was read', 'had moved', 'waits'])} {rng.choice(['again', 'since the ' + noun(), 'after all, as the ' + noun() + ' said'])}."
    label = lambda: rng.choice(["Home", "About us", "Contact", "Our products", "Terms", "Privacy policy", "Log in", "Read more", "Next page", "Careers", "Help", "Share this"])
    out: list[tuple[str, bool]] = []

    def say(text: str, residue: bool) -> str:
        out.append((text, residue))
        return text

    name = lambda telling: f' class="{telling}"' if rng.random() < 0.7 else f' class="c{rng.randrange(99)}"'
    parts = []
    title = lambda: " ".join(noun().title() for _ in range(rng.randrange(1, 4)))
    for kind in rng.sample(["menu", "consent", "footer", "links", "article", "article", "boxed", "plain", "table", "names", "notes"], rng.randrange(4, 11)):
        if kind == "menu":
            parts.append(f"<ul{name('nav')}>" + "".join(f'<li><a href="/{i}">{say(label(), True)}</a></li>' for i in range(rng.randrange(3, 7))) + "</ul>")
        elif kind == "consent":
            parts.append(f"<div{name('cookie-banner')}><p>{say('We use cookies to make this site better.', True)}</p><span>{say('OK', True)}</span></div>")
        elif kind == "footer":
            parts.append(f"<footer><p>{say('© 2026 All rights reserved', True)}</p><a href='/i'>{say('Imprint', True)}</a></footer>")
        elif kind == "links":
            parts.append(f"<div{name('share')}>" + " ".join(f'<a href="/{i}">{say(label(), True)}</a>' for i in range(rng.randrange(3, 6))) + "</div>")
        elif kind == "article":
            parts.append(f"<h2>{say(noun().title() + ' notes', False)}</h2>" + "".join(f"<p>{say(' '.join(sentence() for _ in range(rng.randrange(1, 4))), False)}</p>" for _ in range(rng.randrange(1, 4))))
            parts.append(f"<p>{say('See the', False)} <a href='/r'>{say(noun() + ' pages', False)}</a> {say('of the ' + noun() + '.', False)}</p><ul>" + "".join(f"<li>{say(noun() + ' ' + noun(), False)}</li>" for _ in range(3)) + "</ul>")
        elif kind == "table":
            parts.append("<table>" + "".join("<tr>" + "".join(f"<td>{say(rng.choice([title(), str(rng.randrange(999)), noun(), label()]), False)}</td>" for _ in range(3)) + "</tr>" for _ in range(rng.randrange(1, 4))) + "</table>")
        elif kind == "names":
            parts.append("<ul>" + "".join(f"<li>{say(rng.choice([title(), label() + ' ' + noun(), title() + '.', noun()]), False)}</li>" for _ in range(rng.randrange(2, 5))) + "</ul>")
        elif kind == "notes":
            parts.append("<div>" + "".join(f"<p>{say(rng.choice([title() + '.', 'Yes.', title() + ' ' + noun(), sentence(), label() + ', ' + noun()]), False)}</p>" for _ in range(rng.randrange(1, 4))) + "</div>")
        elif kind == "boxed":
            parts.append(f'<div class="banner"><p>{say(" ".join(sentence() for _ in range(3)), False)}</p></div>')
        else:
            parts.append("\n\n" + say(rng.choice([sentence(), noun().title(), "- " + noun(), "# " + noun().title() + " " + noun()]), False) + "\n\n")
    return "\n".join(parts), out


@lru_cache(maxsize=1)
def block_model(pages: int = 200, seed: int = 9) -> tuple[float, ...]:
    """Weights of FEATURES for boilerplate: logistic regression by Newton's steps, with a small penalty, over the texts of pages made by rule."""
    rng = random.Random(seed)
    x, y = [], []
    for _ in range(pages):
        page, texts = made_page(rng)
        parts = split(page)
        got = features(parts, elements(parts))
        queue = list(texts)
        for i in sorted(got):
            t = parts[i][1].strip()
            at = next((k for k, (u, _) in enumerate(queue) if u.strip() == t), None)
            if at is not None:
                x.append(got[i])
                y.append(float(queue.pop(at)[1]))
    a, b, w = np.array(x), np.array(y), np.zeros(len(FEATURES))
    for _ in range(25):
        p = 1 / (1 + np.exp(-a @ w))
        g = a.T @ (p - b) + w
        h = (a * (p * (1 - p))[:, None]).T @ a + np.eye(len(w))
        w = w - np.linalg.solve(h, g)
    return tuple(float(v) for v in w)


def text_costs(parts: list[tuple[str, str]], closed: list[tuple[int, int, int]], model: tuple[float, ...] | None = None) -> dict[int, tuple[int, int]]:
    """What either label of each text with words costs, (content, residue): the negative log probability that the classifier gives it, in tenths, 90 at most."""
    model = model or block_model()
    out = {}
    for i, f in features(parts, closed).items():
        z = sum(w * v for w, v in zip(model, f))
        out[i] = (min(90, round(10 * math.log1p(math.exp(min(z, 50.0))))), min(90, round(10 * math.log1p(math.exp(min(-z, 50.0))))))
    return out


def costs_and_edges(parts: list[tuple[str, str]], model: tuple[float, ...] | None = None) -> tuple[list[tuple[int, int]], list[tuple[int, int, int]]]:
    """The capacities of the cut: what each piece pays for either label, and what neighbours pay for different ones.

    A text is joined to the next one, most strongly where no block begins or ends between them, then where both lie in one innermost block.
    """
    closed = elements(parts)
    costs = [COSTS.get(k, (0, 0)) for k, _ in parts]
    texts = text_costs(parts, closed, model)
    for i, c in texts.items():
        costs[i] = c
    edges = [(a, z, 4 * SAME_ELEMENT) for a, z, _ in closed] + [(around, a, SAME_ELEMENT) for a, _, around in closed if around >= 0]
    # the block around a text, and the block around that one; inner elements come first
    blocks = [(a, z) for a, z, _ in closed if BLOCK_TAG.match(parts[a][1]) and not re.match(r"<(?:li|tr|td|th|p|h[1-6]|dt|dd|br|hr)\b", parts[a][1], re.I)]
    parent: dict[int, int] = {}
    for a, z in blocks:
        for i in range(a + 1, z):
            parent.setdefault(i, a)
    at = sorted(texts)
    for i, j in zip(at, at[1:]):
        inline = all(k in ("tag", "entity", "quotes") and not (k == "tag" and BLOCK_TAG.match(p)) for k, p in parts[i + 1 : j])
        edges.append((i, j, 4 * NEXT if inline else 3 * NEXT if i in parent and parent.get(i) == parent.get(j) else NEXT if i in parent and j in parent else 1))
    return costs, edges


def label(parts: list[tuple[str, str]], model: tuple[float, ...] | None = None) -> list[bool]:
    """Whether each piece is residue."""
    return min_cut(*costs_and_edges(parts, model))


def cut_changes(text: str | None, model: tuple[float, ...] | None = None) -> tuple[int, int, int]:
    """(texts with words, those that are residue, those whose label is not the one that is cheaper for them alone)."""
    if not text or not HINT.search(text):
        return (0, 0, 0)
    parts = split(text)
    costs, edges = costs_and_edges(parts, model)
    got = min_cut(costs, edges)
    at = [i for i, (k, p) in enumerate(parts) if k == "text" and not p.isspace()]
    return (len(at), sum(got[i] for i in at), sum(got[i] != (costs[i][0] > costs[i][1]) for i in at))


def needs_cleaning(text: str | None, model: tuple[float, ...] | None = None) -> bool:
    """Whether any piece of the text is markup residue. Null and empty texts have none."""
    if not text or not HINT.search(text):
        return False
    parts = split(text)
    if all(k == "text" or COSTS[k][0] < COSTS[k][1] for k, _ in parts):
        return False
    return any(r for r, (k, _) in zip(label(parts, model), parts) if k not in ("text", *CODE_OR_MATH))


BLOCKS = {"p", "div", "blockquote", "table", "ul", "ol", "section", "article", "figure", "form", "pre", "center", "dl"}
DROPPED = {"ref", "button", "nav", "noscript"}
MARKS = {"b": "**", "strong": "**", "i": "*", "em": "*"}


def _arguments(body: str) -> list[str]:
    """The parts of a template between bars that are not inside another one or a link."""
    out, depth, start = [], 0, 0
    for m in re.finditer(r"\{\{|\}\}|\[\[|\]\]|\|", body):
        if m.group() == "|":
            if not depth:
                out.append(body[start : m.start()])
                start = m.end()
        else:
            depth = max(0, depth + (1 if m.group() in ("{{", "[[") else -1))
    return [*out, body[start:]]


def _template(piece: str, model: tuple[float, ...] | None) -> str:
    """The text of a formatting template; boxes and notes are dropped."""
    name, *args = _arguments(piece[2:-2])
    plain = [a for a in args if "=" not in re.sub(r"\{\{.*\}\}", "", a, flags=re.S)]
    return clean(plain[-1], model) if len(plain) == len(args) == 1 else ""


def _command(piece: str, model: tuple[float, ...] | None) -> str:
    m = re.match(r"\\([a-zA-Z]+)\*?(?:\[[^\]]*\])?\{([\s\S]*)\}$", piece)
    name, arg = m.group(1), m.group(2)
    level = {"part": 1, "chapter": 1, "section": 1, "subsection": 2, "subsubsection": 3, "paragraph": 4}.get(name)
    if level:
        return f"\n{'#' * level} {clean(arg, model)}\n"
    if name in ("ref", "cite", "citep", "citet", "label", "eqref", "pageref", "vspace", "hspace", "usepackage", "documentclass", "bibliography"):
        return ""
    wrap = {"emph": "*", "textit": "*", "textbf": "**", "texttt": "`"}.get(name, "")
    arg = arg if wrap == "`" else clean(arg, model)
    return f"{wrap}{arg}{wrap}" if arg else ""


def clean(text: str, model: tuple[float, ...] | None = None) -> str:
    """The text without markup residue: headings, lists, code, formulas, tables and links become Markdown.

    Code and formulas stay as they are. Scripts, comments, page furniture of wikis, references and labels are dropped, and texts that
    the cut labels residue, with the HTML elements that hold nothing else.
    """
    parts = split(text)
    residue = label(parts, model)
    gone = {i for i, (k, p) in enumerate(parts) if k == "text" and residue[i] and not p.isspace()}
    for a, z, _ in elements(parts) if gone else []:
        if any(i in gone and parts[i][0] == "text" for i in range(a, z)) and all(i in gone or k in ("tag", "entity", "comment") and not p.lower().startswith("<img") or p.isspace() for i, (k, p) in enumerate(parts[a:z], a)):
            gone.update(range(a, z + 1))
    out: list[str] = []
    lists: list[list] = []
    links: list[str] = []
    skip: str | None = None
    pre = False
    env: list[str] = []
    quotes: list[str] = []
    for i, ((kind, p), bad) in enumerate(zip(parts, residue)):
        if i in gone:
            continue
        if skip:
            if kind == "tag" and p.lower().startswith(f"</{skip}"):
                skip = None
            continue
        if not bad or kind in ("text", *CODE_OR_MATH):
            if out and out[-1].endswith("- ") and kind == "text":
                p = p.lstrip(" ")
            if kind == "text" and env and env[-1] == "tabular":
                p = re.sub(r"\s*\\\\", "", p).replace("&", "|")
            if kind == "text" and not pre:
                p = re.sub(r"\\([%&#_$])", r"\1", p)
            out.append(p)
            continue
        if kind == "tag":
            name, closing = re.match(r"</?(\w+)", p).group(1).lower(), p.startswith("</")
            if name in DROPPED and not closing and not p.endswith("/>"):
                skip = name
            elif re.fullmatch("h[1-6]", name):
                out.append("\n" if closing else f"\n{'#' * int(name[1])} ")
            elif name in ("ul", "ol"):
                lists.pop() if closing and lists else None if closing else lists.append([name, 0])
                out.append("\n")
            elif name == "li" and not closing:
                lists[-1:] and lists[-1].__setitem__(1, lists[-1][1] + 1)
                out.append(f"\n{lists[-1][1]}. " if lists and lists[-1][0] == "ol" else "\n- ")
            elif name == "pre":
                pre = not closing
                out.append("\n```\n")
            elif name == "code":
                out.append("" if pre else "`")
            elif name in ("td", "th"):
                out.append(" | " if closing else "")
            elif name in ("tr", "br", "li"):
                out.append("\n" if name == "br" or closing else "")
            elif name == "a":
                if closing:
                    out.append(f"]({links.pop()})" if links else "")
                elif m := re.search(r"""href\s*=\s*["']?([^"'\s>]+)""", p, re.I):
                    links.append(m.group(1))
                    out.append("[")
            elif name in ("sup", "sub"):
                out.append("" if closing else "^" if name == "sup" else "_")
            elif name == "img":
                m = re.search(r"""alt\s*=\s*["']([^"']*)""", p, re.I)
                out.append(m.group(1) if m else "")
            elif name in MARKS:
                out.append(MARKS[name])
            elif name in BLOCKS:
                out.append("\n")
        elif kind == "entity":
            out.append(html.unescape(p).replace("\xa0", " "))
        elif kind == "template":
            out.append(_template(p, model))
        elif kind == "heading":
            m = re.match(r"(=+)\s*(.*?)\s*=+\s*$", p)
            out.append(f"{'#' * len(m.group(1))} {m.group(2)}")
        elif kind == "cell":
            out.append("| " + " | ".join(c.strip() for c in re.split(r"\|\||!!", p.strip()[1:])) + " |")
        elif kind == "media":
            out.append(clean(p[2:-2].split("|")[-1], model) if "|" in p and not re.match(r"\[\[(?i:category|kategorie|catégorie|categoría)", p) else "")
        elif kind == "xlink":
            url, _, name = p[1:-1].partition(" ")
            out.append(f"[{name.strip()}]({url})" if name.strip() else f"<{url}>")
        elif kind == "quotes":
            mark = {2: "*", 3: "**"}.get(len(p), "***")
            quotes.pop() if quotes and quotes[-1] == mark else quotes.append(mark)
            out.append(mark)
        elif kind in ("inmath", "dispmath"):
            body = re.sub(r"^\\[(\[]|\\[)\]]$", "", p).strip()
            out.append(f"${body}$" if kind == "inmath" else f"\n$$\n{body}\n$$\n")
        elif kind == "env":
            name = re.search(r"\{([^{}]*)\}", p).group(1).rstrip("*")
            if p.startswith("\\begin"):
                env.append(name)
            elif env:
                env.pop()
            out.append("\n$$\n" if name in ("equation", "align", "gather", "displaymath", "math") else "\n```\n" if name in ("verbatim", "lstlisting") else "\n")
        elif kind == "command":
            out.append(p if env and env[-1] in ("equation", "align", "gather", "displaymath", "math") else _command(p, model))
        elif kind == "bare":
            name, maths = p[1:].rstrip("*"), bool(env) and env[-1].rstrip("*") in ("equation", "align", "gather", "displaymath", "math")
            if p.startswith("\\\\"):
                out.append(p if maths else "")
            else:
                out.append("- " if p == "\\item" else p if maths else "" if name in LAYOUT else SAID.get(name, f"${p}$"))
    joined = "".join(out)
    return re.sub(r"[ \t]+\n", "\n", re.sub(r"\n{3,}", "\n\n", joined)).strip("\n").rstrip() if joined != text else text


def clean_markup(df: DataFrame, text: str = "text", keep: list[str] | None = None, want_text: bool = True) -> DataFrame:
    """The columns keep with residue (whether the text holds markup residue) and, if wanted, clean, the text without it.

    Text without residue is returned unchanged; null gives null and no residue. Every text is read whole. One pass, no shuffle.
    """
    keep = keep if keep is not None else [c for c in df.columns if c != text]
    fields = [*(df.schema[c] for c in keep), StructField("residue", IntegerType(), False), *([StructField("clean", StringType())] if want_text else [])]

    model = block_model()  # fitted once, on the driver

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            texts = b.column(len(keep)).to_pylist()
            found = [needs_cleaning(t, model) for t in texts]
            cols = [*b.columns[: len(keep)], pa.array([int(f) for f in found], pa.int32())]
            if want_text:
                cols.append(pa.array([clean(t, model) if f else t for t, f in zip(texts, found)], pa.string()))
            yield pa.RecordBatch.from_arrays(cols, names=[f.name for f in fields])

    return df.select(*keep, text).mapInArrow(run, StructType(fields))


def label_counts(df: DataFrame, text: str = "text", keep: list[str] | None = None) -> DataFrame:
    """The columns keep with texts, residue and changed of each row, as cut_changes() gives."""
    keep = keep or []
    fields = [*(df.schema[c] for c in keep), *(StructField(c, IntegerType(), False) for c in ("texts", "residue", "changed"))]
    model = block_model()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            got = [cut_changes(t, model) for t in b.column(len(keep)).to_pylist()]
            cols = list(zip(*got)) if got else [(), (), ()]
            yield pa.RecordBatch.from_arrays([*b.columns[: len(keep)], *(pa.array(c, pa.int32()) for c in cols)], names=[f.name for f in fields])

    return df.select(*keep, text).mapInArrow(run, StructType(fields))
