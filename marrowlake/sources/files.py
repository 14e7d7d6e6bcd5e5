"""Files as sources: Markdown vaults, HTML, golden sets, audits, synthetic corpora."""

from __future__ import annotations

import re
import tomllib
from collections.abc import Iterator
from html.parser import HTMLParser

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from marrowlake.functions.chunking import first_heading, wikilinks, without_frontmatter
from marrowlake.functions.identity import content_hash, doc_id, file_stamp
from marrowlake.operators.index import distinct_roots, ignored

MOST_HTML = 8 << 20
LIFECYCLE_KEYS = ("id", "status", "supersedes", "superseded_by")


def listing(spark: SparkSession, roots: list[str], glob: str = "*.md", ignore: tuple[str, ...] = ("_templates",)) -> DataFrame:
    """(uri, stamp, content) of files below roots, in order of uri; a missing root raises. Contents are read only where a plan uses them."""
    out = None
    for root in distinct_roots(roots):
        f = spark.read.format("binaryFile").option("recursiveFileLookup", True).option("pathGlobFilter", glob).load(root)
        out = f if out is None else out.unionByName(f)
    if out is None:
        raise ValueError("no roots")
    uri = F.regexp_replace("path", "^file:/+", "file:///")
    return out.filter(~ignored(F.col("path"), ignore)).select(uri.alias("uri"), file_stamp(F.col("modificationTime"), F.col("length")).alias("stamp"), "modificationTime", "length", "content")


def frontmatter(text: str | None) -> dict:
    """Title, tags and lifecycle keys of a leading YAML block; nothing if it is broken."""
    m = re.match(r"\A﻿?---[ \t]*\r?\n(.*?)\r?\n(?:---|\.\.\.)[ \t]*(?:\r?\n|\Z)", text or "", re.S)
    if not m:
        return {}
    try:
        import yaml

        got = yaml.safe_load(m.group(1))
    except Exception:
        got = None
    if not isinstance(got, dict):
        got = dict(x.groups() for line in m.group(1).splitlines() if (x := re.match(r"([\w-]+):[ \t]*(.*)$", line)))
    flat = {str(k).replace("-", "_"): v for k, v in got.items()}
    tags = flat.get("tags")
    tags = [str(t) for t in tags if t is not None] if isinstance(tags, list) else [t.strip() for t in str(tags).split(",") if t.strip()] if tags else []
    text_of = lambda k: str(flat[k]).strip() if flat.get(k) is not None and str(flat[k]).strip() else None
    return {"title": text_of("title"), "tags": tags, **{k: text_of(k) for k in LIFECYCLE_KEYS}}


def markdown_documents(files: DataFrame) -> DataFrame:
    """Documents of Markdown files (uri, content): title from frontmatter, first heading or file name; links; metadata keys that are set."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            raw = [(c or b"").decode("utf-8", "replace") for c in b.column(1).to_pylist()]
            fm = [frontmatter(t) for t in raw]
            cols = [b.column(0), pa.array(raw, pa.string()), pa.array([f.get("title") for f in fm], pa.string()), pa.array([f.get("tags", []) for f in fm], pa.list_(pa.string()))]
            cols += [pa.array([f.get(k) for f in fm], pa.string()) for k in LIFECYCLE_KEYS]
            yield pa.RecordBatch.from_arrays(cols, names=["uri", "raw", "title", "tags", *LIFECYCLE_KEYS])

    keys = ", ".join(f"{k} string" for k in LIFECYCLE_KEYS)
    d = files.select("uri", "content").mapInArrow(run, f"uri string, raw string, title string, tags array<string>, {keys}")
    text = without_frontmatter(F.col("raw"))
    stem = F.regexp_extract("uri", r"([^/]+?)(?:\.[^./]*)?$", 1)
    d = d.withColumn("text", text).withColumn("meta", F.to_json(F.struct(*LIFECYCLE_KEYS)))
    return d.select(doc_id(F.col("uri")).alias("id"), "uri", F.coalesce("title", first_heading(F.col("text")), stem).alias("title"), F.lit("markdown").alias("source_type"), "text", content_hash(F.col("text")).alias("content_hash"), wikilinks(F.col("text")).alias("links"), "tags", "meta")


class _Page(HTMLParser):
    """The blocks of a page as Markdown with what speaks for or against each: its words, those inside links, commas, and the elements around it."""

    SKIP = frozenset(("script", "style", "noscript", "svg", "template", "button", "form"))
    EDGE = frozenset(("nav", "header", "footer", "aside", "menu"))
    BLOCK = frozenset(("p", "div", "section", "article", "main", "table", "ul", "ol", "blockquote", "li", "tr", "h1", "h2", "h3", "h4", "h5", "h6", "pre", "body", "td", "th", "dl", "dt", "dd", "figure"))

    def __init__(self) -> None:
        super().__init__(convert_charrefs=True)
        self.blocks: list[dict] = []
        self.title, self.skip, self.edge, self.link, self.main, self.in_title, self.pre = "", 0, 0, 0, 0, False, False
        self._open("")

    def _open(self, mark: str) -> None:
        self.blocks.append({"mark": mark, "text": [], "linked": 0, "edge": self.edge > 0, "main": self.main > 0, "pre": self.pre})

    def handle_starttag(self, tag: str, attrs: list) -> None:
        if tag in self.SKIP:
            self.skip += 1
        elif tag == "title":
            self.in_title = True
        elif tag == "a":
            self.link += 1
        elif tag == "br":
            self.blocks[-1]["text"].append("\n")
        self.edge += tag in self.EDGE
        self.main += tag in ("article", "main")
        if tag == "pre":
            self.pre = True
        if tag in self.BLOCK or tag in self.EDGE:
            self._open("#" * int(tag[1]) + " " if re.fullmatch("h[1-6]", tag) else "- " if tag == "li" else "")

    def handle_endtag(self, tag: str) -> None:
        if tag in self.SKIP:
            self.skip = max(0, self.skip - 1)
        elif tag == "title":
            self.in_title = False
        elif tag == "a":
            self.link = max(0, self.link - 1)
        self.edge = max(0, self.edge - (tag in self.EDGE))
        self.main = max(0, self.main - (tag in ("article", "main")))
        if tag == "pre":
            self.pre = False
        if tag in self.BLOCK or tag in self.EDGE:
            self._open("")

    def handle_data(self, data: str) -> None:
        if self.in_title:
            self.title += data
        elif not self.skip:
            b = self.blocks[-1]
            b["text"].append(data if self.pre else re.sub(r"[^\S\n]+|\n", " ", data))
            b["linked"] += len(data.split()) if self.link else 0

    def markdown(self) -> str:
        """The blocks that are content: those inside article or main if the page has any with words; of the rest, not those in navigation and not those that are mostly links."""
        rows = [(b, text) for b in self.blocks if (text := "".join(b["text"]).strip("\n" if b["pre"] else None))]
        inside = [r for r in rows if r[0]["main"] and not r[0]["edge"]]
        if sum(len(t.split()) for _, t in inside) >= 5:
            rows = inside
        out = []
        for b, text in rows:
            n = len(text.split())
            # links weigh against a block, full sentences and headings for it
            if not n or b["edge"] or (b["linked"] > 0.5 * n and not b["mark"].startswith("#") and text.count(",") + text.count(". ") < 2 and n < 40):
                continue
            out.append(f"```\n{text}\n```" if b["pre"] else b["mark"] + text)
        joined = []
        for i, t in enumerate(out):
            joined.append(("\n" if i and t.startswith("- ") and out[i - 1].startswith("- ") else "\n\n" if i else "") + t)
        return "".join(joined)


def html_documents(pages: DataFrame, url: str = "url", html: str = "html", most_bytes: int = MOST_HTML) -> DataFrame:
    """(url, title, text, domain, refused) of pages; a page without title is called by its url.

    A page of more than most_bytes is listed with the reason it was refused and without text; null pages have an empty text.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            titles, texts = [], []
            for h in b.column(1).to_pylist():
                p = _Page()
                p.feed(h or "")
                p.close()
                titles.append(re.sub(r"\s+", " ", p.title).strip() or None)
                texts.append(p.markdown())
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array(titles, pa.string()), pa.array(texts, pa.string())], names=["url", "title", "text"])

    fits = F.coalesce(F.octet_length(html), F.lit(0)) <= most_bytes
    read = pages.filter(fits).select(url, html).mapInArrow(run, "url string, title string, text string").withColumn("refused", F.lit(None).cast("string"))
    large = pages.filter(~fits).select(F.col(url).alias("url"), F.lit(None).cast("string").alias("title"), F.lit(None).cast("string").alias("text"), F.concat(F.lit(f"more than {most_bytes} bytes: "), F.octet_length(html).cast("string")).alias("refused"))
    return read.unionByName(large).select("url", F.coalesce("title", "url").alias("title"), "text", F.try_parse_url("url", F.lit("HOST")).alias("domain"), "refused")


def load_one(spark: SparkSession, target: str, html: str | None = None) -> DataFrame:
    """The document of one target: a page (its html given, as nothing is fetched here) or one Markdown file."""
    if html is not None:
        d = html_documents(spark.createDataFrame([(target, html)], "url string, html string"))
        return d.select(doc_id(F.col("url")).alias("id"), F.col("url").alias("uri"), "title", F.lit("web").alias("source_type"), "text", content_hash(F.col("text")).alias("content_hash"), F.to_json(F.struct("domain")).alias("meta"))
    path = re.sub(r"^file:/+", "/", target)
    f = spark.read.format("binaryFile").load(path).select(F.regexp_replace("path", "^file:/+", "file:///").alias("uri"), "content")
    return markdown_documents(f)


def read_golden(spark: SparkSession, text: str, strict: bool = True) -> DataFrame:
    """Cases of a golden set in TOML, given as text: case_id, query, acceptable, absent, negative. A strict reading refuses faulty cases."""
    rows = []
    for i, c in enumerate(tomllib.loads(text).get("case", []), 1):
        ok = [*([c["expect"]] if c.get("expect") else []), *c.get("expect_any", [])]
        neg = bool(c.get("expect_none", False))
        if strict and (not str(c.get("query", "")).strip() or neg == bool(ok)):
            raise ValueError(f"case {i} needs a query and either expected documents or expect_none")
        rows.append((i, str(c.get("query", "")), ok, list(c.get("expect_absent", [])), neg))
    return spark.createDataFrame(rows, "case_id int, query string, acceptable array<string>, absent array<string>, negative boolean")


def read_memory_cases(spark: SparkSession, text: str) -> DataFrame:
    """The memory cases of a golden set: case_id, kind, text, queries, negatives. A case without kind, text or queries is refused."""
    rows = []
    for i, c in enumerate(tomllib.loads(text).get("memory_case", []), 1):
        kind, body, asked = str(c.get("kind", "")).strip(), str(c.get("text", "")).strip(), list(c.get("queries", []))
        if not (kind and body and asked):
            raise ValueError(f"memory case {i} needs a kind, a text and queries")
        rows.append((i, kind, body, asked, list(c.get("negatives", []))))
    return spark.createDataFrame(rows, "case_id int, kind string, text string, queries array<string>, negatives array<string>")


def golden_text(spark: SparkSession, path: str) -> str:
    """The text of a golden set's file; a golden set is a file that people write."""
    return spark.read.text(path, wholetext=True).first()["value"]


def injections(lines: DataFrame, value: str = "value") -> DataFrame:
    """(path, line, n, title, uri, bytes): entries "[title](uri)" of every injected context in a session log.

    Contexts are objects of the type hook_additional_context at any depth; their content is text or a list of texts.
    """

    def found(v, out: list[str]) -> None:
        if isinstance(v, dict):
            if v.get("type") == "hook_additional_context":
                c = v.get("content")
                if isinstance(c, list):
                    out.append("\n".join(x for x in c if isinstance(x, str)))
                elif isinstance(c, str):
                    out.append(c)
                return
            v = list(v.values())
        if isinstance(v, list):
            for x in v:
                found(x, out)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        import json

        for b in batches:
            rows = []
            for path, line, t in zip(*(c.to_pylist() for c in b.columns)):
                bodies: list[str] = []
                try:
                    found(json.loads(t), bodies)
                except ValueError:
                    pass
                for n, body in enumerate(bodies):
                    entries = [m.groups() for x in body.splitlines() if (m := re.match(r"^\[(.*?)\]\((.*)\)$", x.strip())) and "://" in m.group(2)]
                    rows += [(path, line, n, a, u, len(body.encode())) for a, u in entries or [(None, None)]]
            p, ln, n, a, u, s = zip(*rows) if rows else ((),) * 6
            yield pa.RecordBatch.from_arrays([pa.array(p, pa.string()), pa.array(ln, pa.int32()), pa.array(n, pa.int32()), pa.array(a, pa.string()), pa.array(u, pa.string()), pa.array(s, pa.int64())], names=["path", "line", "n", "title", "uri", "bytes"])

    return lines.select("path", F.col("line").cast("int"), value).mapInArrow(run, "path string, line int, n int, title string, uri string, bytes long")


def audit(found: DataFrame) -> DataFrame:
    """Entries by scheme; contexts none of whose entries is a file."""
    by = found.filter("uri is not null").groupBy(F.substring_index("uri", "://", 1).alias("scheme")).agg(F.count("*").alias("n"))
    no_file = found.groupBy("path", "line", "n").agg(F.max(F.coalesce(F.col("uri").startswith("file://"), F.lit(False))).alias("f")).filter("not f").agg(F.count("*").alias("n"))
    return by.unionByName(no_file.select(F.lit("without file").alias("scheme"), "n"))


def synthetic_corpus(spark: SparkSession, documents: int, seed: int = 42, vocabulary: int = 20_000, dims: int = 64) -> DataFrame:
    """Chunks of made-up documents: 5-60 chunks of 150-300 words drawn by Zipf's law, with a unit vector. Any number of rows, same rows for a seed."""
    u = lambda *c: (F.shiftrightunsigned(F.xxhash64(F.lit(seed), *c), 11) + 0.5) / float(1 << 53)
    d = spark.range(1, documents + 1).withColumnRenamed("id", "doc")
    c = d.select("doc", F.explode(F.sequence(F.lit(0), (4 + F.floor(u("doc", F.lit("n")) * 56)).cast("int"))).alias("ord"))
    n = (150 + F.floor(u("doc", "ord", F.lit("w")) * 151)).cast("int")
    rank = lambda i: F.floor(F.pow(F.lit(float(vocabulary)), u("doc", "ord", i))).cast("long")  # noqa: E731  # P(rank >= r) falls as 1 / r
    words = F.array_join(F.transform(F.sequence(F.lit(1), n), lambda i: F.concat(F.lit("w"), F.conv(rank(i).cast("string"), 10, 36))), " ")
    gauss = lambda i: F.sqrt(-2 * F.log(u("doc", "ord", i, F.lit("a")))) * F.cos(6.283185307179586 * u("doc", "ord", i, F.lit("b")))
    v = F.transform(F.sequence(F.lit(1), F.lit(dims)), lambda i: gauss(i))
    rows = c.select("doc", "ord", words.alias("text"), v.alias("v"))
    norm: Column = F.sqrt(F.aggregate("v", F.lit(0.0), lambda s, x: s + x * x))
    return rows.select(F.format_string("synthetic:///doc-%07d.md", "doc").alias("uri"), "doc", "ord", "text", F.transform("v", lambda x: (x / norm).cast("float")).alias("embedding"))
