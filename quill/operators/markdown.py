"""Markdown: content blocks rendered as lines, and documents parsed into adjacency rows of blocks."""

from __future__ import annotations

import re

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F

from ..functions import text as tx

# --- rendering, in JVM expressions ----------------------------------------------------------


def render_block(b: Column) -> Column:
    """Markdown of one content block (struct as in pages); '' for an empty one.

    A heading is one level below the page's title, a fence outlasts the backticks in its code, a table is as wide as its widest row,
    list items are indented by level and numbered from the block's start, breaks stand as <br>.
    """
    br = lambda c: F.replace(F.coalesce(c, F.lit("")), F.lit("\n"), F.lit("<br>"))
    fence = tx.fence(b["text"])
    width = F.coalesce(F.array_max(F.transform(b["data"], lambda r: F.size(r))), F.lit(0))
    row = lambda cells: F.concat(F.lit("| "), F.array_join(cells, " | "), F.lit(" |"))
    padded = lambda r: F.concat(F.transform(r, tx.escape_cell), F.array_repeat(F.lit(""), F.greatest(width - F.size(r), F.lit(0))))
    rows = F.transform(b["data"], lambda r: row(padded(r)))
    table = F.array_join(F.concat(F.slice(rows, 1, 1), F.array(row(F.array_repeat(F.lit("---"), width))), F.slice(rows, 2, F.greatest(F.size(rows), F.lit(1)))), "\n")
    mark = lambda i: F.when(b["ordered"], F.concat((b["start"] + i + 1).cast("string"), F.lit("."))).otherwise("-")
    items = F.transform(b["items"], lambda x, i: F.concat(F.repeat(F.lit("    "), F.coalesce(b["level"], F.lit(0))), mark(i), F.lit(" "), br(x)))
    quoted = F.array_join(F.transform(F.split(F.trim(b["text"]), "\n"), lambda x: F.concat(F.lit("> "), x)), "\n")
    kind = b["type"]
    return (
        F.when(kind == "heading", F.concat(F.repeat(F.lit("#"), F.least(F.coalesce(b["level"], F.lit(2)) + 1, F.lit(6))), F.lit(" "), b["text"]))
        .when(kind == "paragraph", br(F.trim(b["text"])))
        .when(kind == "code", F.concat(fence, F.coalesce(b["language"], F.lit("")), F.lit("\n"), b["text"], F.lit("\n"), fence))
        .when(kind == "list", F.array_join(items, "\n"))
        .when((kind == "table") & (F.size(b["data"]) > 0), table)
        .when(kind == "image", F.concat(F.lit("!["), F.coalesce(b["alt"], F.lit("Image")), F.lit("]("), F.coalesce(b["src"], F.lit("")), F.lit(")")))
        .when((kind == "callout") & (F.trim(b["text"]) != ""), quoted)
        .otherwise("")
    )


def render_page(content: Column) -> Column:
    """Markdown of a page's blocks with blank lines between."""
    return F.array_join(F.filter(F.transform(content, render_block), lambda x: x != ""), "\n\n")


# --- parsing into adjacency rows -------------------------------------------------------------

BLOCKS = "array<struct<id:int,parent:int,pos:int,kind:string,level:int,text:string,lang:string,items:array<string>,rows:array<array<string>>,caption:string,path:string>>"
_BLANK = {"level": None, "text": None, "lang": None, "items": None, "rows": None, "caption": None, "path": None}
_ROW, _RULE, _ITEM = r"^\s*\|", r"^\s*\|?\s*:?-{2,}", r"^(\s*)(?:[-*+]|\d+[.)])\s+(.*)$"


def _cells(line: str) -> list[str]:
    inner = re.sub(r"^\||(?<!\\)\|$", "", line.strip())
    return [c.strip().replace("\\|", "|") for c in re.split(r"(?<!\\)\|", inner)]


class _Reader:
    """Lines to block rows; containers (``::: name`` to ``:::``) hold what stands inside them."""

    def __init__(self, text: str):
        self.lines = text.splitlines()
        self.rows: list[dict] = []
        self.open: list[int] = []
        self.counts: dict[int | None, int] = {}

    def put(self, kind: str, **fields: object) -> int:
        parent = self.open[-1] if self.open else None
        pos = self.counts[parent] = self.counts.get(parent, -1) + 1
        self.rows.append({"id": len(self.rows), "parent": parent, "pos": pos, "kind": kind, **_BLANK, **fields})
        return len(self.rows) - 1

    def take(self, at: int, test: str, limit: int | None = None) -> int:
        """The first line from ``at`` on that doesn't match."""
        while at < len(self.lines) and re.match(test, self.lines[at]) and (limit is None or at < limit):
            at += 1
        return at

    def read(self) -> list[dict]:
        at = 0
        while at < len(self.lines):
            at = self.step(at, self.lines[at])
        return self.rows

    def step(self, at: int, line: str) -> int:
        s = line.strip()
        if not s:
            return at + 1
        if m := re.match(r"^:::\s*(\w+)\s*(.*)$", s):
            self.open.append(self.put("container", lang=m[1], text=m[2]))
            return at + 1
        if s == ":::":
            if self.open:
                self.open.pop()
            return at + 1
        if m := re.match(r"^(```+|~~~+)\s*(\S*)", s):
            end = next((k for k in range(at + 1, len(self.lines)) if self.lines[k].strip().startswith(m[1])), len(self.lines))
            self.put("code", text="\n".join(self.lines[at + 1 : end]), lang=m[2])
            return end + 1
        if s.startswith("<!--"):
            end = next((k for k in range(at, len(self.lines)) if "-->" in self.lines[k]), len(self.lines))
            return end + 1
        if m := re.match(r"^(#{1,6})\s+(.*?)\s*#*$", s):
            self.put("heading", level=len(m[1]), text=m[2])
            return at + 1
        if re.fullmatch(r"(?:[-*_]\s*){3,}", s):
            self.put("rule")
            return at + 1
        if m := re.match(r"^!\[(.*?)\]\((\S+?)\)", s):
            self.put("image", caption=m[1], path=m[2])
            return at + 1
        if re.match(_ROW, line) and at + 1 < len(self.lines) and re.match(_RULE, self.lines[at + 1]):
            end = self.take(at + 2, _ROW)
            after = next((k for k in range(end, len(self.lines)) if self.lines[k].strip()), len(self.lines))
            caption = re.match(r"^Table:\s*(.*)$", self.lines[after].strip()) if after < len(self.lines) else None
            self.put("table", rows=[_cells(self.lines[at]), *(_cells(x) for x in self.lines[at + 2 : end])], caption=caption[1] if caption else None)
            return after + 1 if caption else end
        if re.match(_ITEM, line):
            end = self.take(at, _ITEM)
            found = [re.match(_ITEM, x) for x in self.lines[at:end]]
            self.put("list", items=[f"{'  ' * min(len(m[1]) // 2, 2)}{m[2]}" for m in found], lang="ordered" if s[0].isdigit() else "bullet")
            return end
        if s.startswith(">"):
            end = self.take(at, r"^\s*>")
            self.put("callout", text="\n".join(re.sub(r"^\s*>\s?", "", x) for x in self.lines[at:end]))
            return end
        end = at + 1
        while end < len(self.lines) and self.lines[end].strip() and not re.match(r"^\s*(?::::|#{1,6}\s|```|~~~|>|!\[|\||[-*+]\s|\d+[.)]\s)", self.lines[end]):
            end += 1
        self.put("paragraph", text=" ".join(x.strip() for x in self.lines[at:end]))
        return end


def parse_blocks(text: Column | str) -> Column:
    """Array of block rows of a Markdown document: id, parent, pos among its siblings, kind and content. Null has none."""

    def run(col: pd.Series) -> pd.Series:
        return col.map(lambda t: _Reader(t or "").read())

    return F.pandas_udf(run, BLOCKS)(text)


RUNS = "array<struct<text:string,bold:boolean,italic:boolean,code:boolean,link:string>>"
_INLINE = re.compile(r"\\([\\`*_\[\]{}()#+\-.!|>])|`([^`]+)`|\[([^\]]*)\]\(([^)\s]+)\)|\*\*(.+?)\*\*|\*(.+?)\*|<(https?://[^>]+)>")


def _runs(s: str, bold: bool = False, italic: bool = False) -> list[dict]:
    out: list[dict] = []

    def put(text: str, code: bool = False, link: str | None = None) -> None:
        if text:
            out.append({"text": text, "bold": bold, "italic": italic, "code": code, "link": link})

    at = 0
    for m in _INLINE.finditer(s):
        put(s[at : m.start()])
        escaped, code, label, target, strong, soft, auto = m.groups()
        if strong is not None:
            out += _runs(strong, True, italic)
        elif soft is not None:
            out += _runs(soft, bold, True)
        else:
            put(escaped or code or label or auto or "", code is not None, target or auto)
        at = m.end()
    put(s[at:])
    return out


def parse_inline(text: Column | str) -> Column:
    """Array of runs of a Markdown line: text, bold, italic, code and link."""

    def run(col: pd.Series) -> pd.Series:
        return col.map(lambda t: _runs(t or ""))

    return F.pandas_udf(run, RUNS)(text)


# --- front matter ------------------------------------------------------------------------------


def front_matter(text: Column) -> Column:
    """Struct (raw, body): what stands between a first line of --- and the next --- or ..., and the rest; raw is null without it."""
    pattern = r"(?s)^﻿?---[ \t]*\r?\n(.*?)(?:^|(?<=\n))(?:---|\.\.\.)[ \t]*(?:\r?\n|$)(.*)$"
    has = text.rlike(pattern)
    return F.struct(F.when(has, F.regexp_extract(text, pattern, 1)).alias("raw"), F.when(has, F.regexp_extract(text, pattern, 2)).otherwise(text).alias("body"))


def scalar_type(value: Column) -> Column:
    """How a front-matter value reads: text, boolean, integer or list. Text stays text: 1.10 and 000000 are no numbers."""
    v = F.trim(value)
    return (
        F.when(v.rlike("""^(".*"|'.*')$"""), "text")
        .when(v.rlike(r"^\[.*\]$"), "list")
        .when(F.lower(v).isin("true", "yes", "false", "no"), "boolean")
        .when(v.rlike(r"^-?(0|[1-9]\d*)$"), "integer")
        .otherwise("text")
    )


def front_matter_fields(raw: Column) -> Column:
    """Map of the plain ``key: value`` lines of front matter; comments after a value and outer quotes are dropped."""
    lines = F.filter(F.split(raw, "\r?\n"), lambda x: x.rlike(r"^[A-Za-z0-9_\-]+:"))
    keys = F.transform(lines, lambda x: F.regexp_extract(x, r"^([A-Za-z0-9_\-]+):", 1))
    bare = lambda x: F.regexp_replace(F.trim(F.regexp_extract(x, r"^[A-Za-z0-9_\-]+:(.*)$", 1)), r"\s+#(\s.*)?$|^#.*$", "")
    values = F.transform(lines, lambda x: F.regexp_replace(bare(x), """^(["'])(.*)\\1$""", "$2"))
    last = F.map_from_entries(F.filter(F.arrays_zip(keys.alias("k"), values.alias("v")), lambda e: F.array_position(keys, e["k"]) > 0))
    return F.when(F.size(F.array_distinct(keys)) == F.size(keys), last)
