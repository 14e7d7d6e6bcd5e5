"""Markdown into chunks with their heading paths."""

from __future__ import annotations

import re
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from marrowlake.functions.identity import chunk_id, embed_text

#: A chunk has at most MOST characters, and closes once it has LEAST.
LEAST, MOST = 1024, 2048


def headings(text: str) -> list[tuple[int, int, str]]:
    """(offset, level, title) of ATX and setext headings outside fenced code; offsets are characters."""
    out, pos, fence, before = [], 0, "", None
    for line in text.split("\n"):
        bare = line.strip()
        if fence:
            fence = "" if bare.startswith(fence) else fence
            before = None
        elif m := re.match(r"(`{3,}|~{3,})", bare):
            fence, before = m.group(1), None
        elif bare.startswith("#"):
            level = len(bare) - len(bare.lstrip("#"))
            if title := bare[level:].strip():
                out.append((pos, level, title))
            before = None
        elif before and re.fullmatch(r"=+|-+", bare):
            out.append((before[0], 1 if bare[0] == "=" else 2, before[1]))
            before = None
        else:
            before = (pos, bare) if bare else None
        pos += len(line) + 1
    return out


def heading_paths(text: str, offsets: list[int]) -> list[str]:
    """The headings above each offset, joined by " > "; first-level ones in front are left out. A heading at the offset itself counts."""
    marks, out = headings(text), []
    for at in offsets:
        stack: list[tuple[int, str]] = []
        for pos, level, title in marks:
            if pos > at:
                break
            stack = [x for x in stack if x[0] < level] + [(level, title)]
        while stack and stack[0][0] == 1:
            stack = stack[1:]
        out.append(" > ".join(t for _, t in stack))
    return out


def is_heading_only(text: str) -> bool:
    """Whether nothing but headings and blank lines is left."""
    lines, k = text.split("\n"), 0
    while k < len(lines):
        bare = lines[k].strip()
        if not bare or bare.startswith("#"):
            k += 1
        elif k + 1 < len(lines) and re.fullmatch(r"=+|-+", lines[k + 1].strip()):
            k += 2
        else:
            return False
    return True


def content_start(text: str) -> int:
    """Where the text goes on behind leading blank lines and headings."""
    pos, lines, k = 0, text.split("\n"), 0
    while k < len(lines):
        bare = lines[k].strip()
        under = k + 1 < len(lines) and bool(re.fullmatch(r"=+|-+", lines[k + 1].strip()))
        if bare and not bare.startswith("#") and not under:
            break
        step = 2 if bare and not bare.startswith("#") and under else 1
        pos += sum(len(x) + 1 for x in lines[k : k + step])
        k += step
    return min(pos, len(text))


def split(text: str, least: int = LEAST, most: int = MOST) -> list[tuple[int, str]]:
    """(offset, chunk): paragraphs packed greedily, without overlap.

    A chunk takes whole paragraphs up to `most` characters; one that has `least` closes before a heading. A longer paragraph is cut behind a
    sentence, else a blank, else anywhere.
    """
    blocks = [(m.start(), m.group()) for m in re.finditer(r"(?:(?!\n[ \t]*\n)[\s\S])+(?:\n[ \t]*\n\s*)?", text) if m.group().strip()]
    pieces: list[tuple[int, str]] = []
    for at, b in blocks:
        while len(b.rstrip()) > most:
            cut = max((m.end() for m in re.finditer(r"[.!?\n]\s+", b[:most])), default=0) or (b.rfind(" ", 0, most) + 1) or most
            pieces.append((at, b[:cut]))
            at, b = at + cut, b[cut:]
        if b.strip():
            pieces.append((at, b))
    out: list[tuple[int, str]] = []
    start, now = 0, ""
    for at, b in pieces:
        if now and (len(now) + len(b.rstrip()) > most or (len(now) >= least and b.lstrip().startswith("#"))):
            out.append((start, now))
            now = ""
        if not now:
            start = at
        now += b
    if now:
        out.append((start, now))
    return [(a, c.rstrip()) for a, c in out]


def chunked(documents: DataFrame, doc: str = "id", text: str = "text", title: str = "title", pages: str | None = None, least: int = LEAST, most: int = MOST) -> DataFrame:
    """Chunks of documents: id, doc, ord, text, embed_text, heading_path, page_no (G1). pages: a column of (page, offset) arrays.

    Ordinals are dense after heading-only chunks are dropped. Null and blank texts have no chunk. One pass in Arrow batches, no shuffle; the rest are
    column expressions.
    """
    from marrowlake.sources.pages import page_at

    columns = [doc, title, text, *([pages] if pages else [])]
    kind = dict(documents.dtypes)
    extra = f", {pages} {kind[pages]}" if pages else ""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            take, ord_, texts, paths, offsets = [], [], [], [], []
            for i, t in enumerate(b.column(2).to_pylist()):
                parts = [(a, c) for a, c in split(t or "", least, most) if not is_heading_only(c)]
                for k, ((a, c), p) in enumerate(zip(parts, heading_paths(t or "", [a + content_start(c) for a, c in parts]))):
                    take.append(i), ord_.append(k), texts.append(c), paths.append(p), offsets.append(len(t[:a].encode()))
            at = pa.array(take, pa.int64())
            cols = [b.column(0).take(at), b.column(1).take(at), pa.array(ord_, pa.int64()), pa.array(texts, pa.string()), pa.array(paths, pa.string()), pa.array(offsets, pa.int64()), *([b.column(3).take(at)] if pages else [])]
            yield pa.RecordBatch.from_arrays(cols, names=["doc", "title", "ord", "text", "heading_path", "at", *([pages] if pages else [])])

    c = documents.select(*columns).mapInArrow(run, f"doc {kind[doc]}, title string, ord long, text string, heading_path string, at long{extra}")
    page = page_at(F.col(pages), F.col("at")).cast("long") if pages else F.lit(None).cast("long")
    return c.select(chunk_id(F.col("doc").cast("string"), F.col("ord")).alias("id"), "doc", "ord", "text", embed_text(F.col("title"), F.col("heading_path"), F.col("text")).alias("embed_text"), "heading_path", page.alias("page_no"))


# ---- column expressions on Markdown ----


def without_code(text: Column) -> Column:
    return F.regexp_replace(F.regexp_replace(text, r"(?ms)^[ \t]*(```|~~~).*?(?:^[ \t]*\1[ \t]*$|\z)", " "), r"`[^`\n]*`", " ")


def wikilinks(text: Column) -> Column:
    """Targets of [[target]], [[target|alias]] and [[target#section]] outside code, in order, repeats kept."""
    found = F.regexp_extract_all(without_code(text), F.lit(r"\[\[([^\[\]|#\n]+)(?:[#|][^\[\]\n]*)?\]\]"), 1)
    return F.filter(F.transform(found, lambda x: F.trim(x)), lambda x: x != "")


def first_heading(text: Column) -> Column:
    """The first ATX heading outside code; null if there is none or it is empty."""
    h = F.trim(F.regexp_extract(without_code(text), r"(?m)^ {0,3}#{1,6}[ \t]+(.*?)[ \t]*#*[ \t]*$", 1))
    return F.when(h != "", h)


def without_frontmatter(text: Column) -> Column:
    """A leading block between --- and --- or ... is cut off; one that never ends is left alone. A byte order mark is dropped."""
    return F.regexp_replace(F.regexp_replace(text, "^﻿", ""), r"(?s)\A---[ \t]*\r?\n.*?\r?\n(?:---|\.\.\.)[ \t]*(?:\r?\n|\z)", "")
