"""Comments and code tokens of source files, and comments as units.

A language is a description: its comment marks, its strings and a few habits. From it one pattern is compiled whose alternatives
are tried at each place, so a comment mark inside a string, or a quote inside a comment, is never taken for one. Python is read by
its own tokenizer. Constructs that a description cannot decide mark the scan uncertain.
"""

from __future__ import annotations

import io
import re
import tokenize
from dataclasses import dataclass, field
from functools import cache

import numpy as np
import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F

from ..functions.languages import directives, language_of

_BACKSLASH = r'"(?:\\.|[^"\\\n])*"|' + r"'(?:\\.|[^'\\\n])*'"
_DOUBLE = r'"(?:\\.|[^"\\\n])*"'
_CHAR = r"'(?:\\[^\n]{1,10}?|[^'\\\n])'"
_TRIPLE = r'"""[\s\S]*?"""|' + r"'''[\s\S]*?'''"


@dataclass(frozen=True)
class Language:
    """line: marks that run to the line's end; block: (open, close); strings: a pattern of literals, longest forms first."""

    line: tuple[str, ...] = ()
    block: tuple[str, str] | None = None
    strings: str = ""
    nested: bool = False
    line_start: bool = False  # a line mark counts at the start of a line only
    spaced: bool = False  # a line mark counts at a line's start or after white space
    unsure: str = ""  # a pattern whose presence leaves the scan uncertain
    flags: int = 0


_C = (("//",), ("/*", "*/"))
LANGUAGES: dict[str, Language] = {
    "js": Language(*_C, r"`(?:\\.|[^`\\])*`|" + _BACKSLASH + r"|(?<=[(,=:\[!&|?{};+\-*%<>~^])\s*/(?![*/])(?:\\.|\[(?:\\.|[^\]\n])*\]|[^/\\\n])+/", unsure=r"`[^`]*\$\{"),
    "c": Language(*_C, r'R"(\w*)\([\s\S]*?\)\1"|' + _DOUBLE + "|" + _CHAR),
    "java": Language(*_C, _TRIPLE + "|" + _DOUBLE + "|" + _CHAR),
    "csharp": Language(*_C, r'\$?@\$?"(?:""|[^"])*"|' + _TRIPLE + "|" + _DOUBLE + "|" + _CHAR, unsure=r'\$"'),
    "kotlin": Language(*_C, _TRIPLE + "|" + _BACKSLASH, nested=True),
    "scala": Language(*_C, _TRIPLE + "|" + _BACKSLASH, nested=True),
    "swift": Language(*_C, _TRIPLE + "|" + _BACKSLASH, nested=True),
    "groovy": Language(*_C, _TRIPLE + "|" + _BACKSLASH),
    "dart": Language(*_C, _TRIPLE + "|" + _BACKSLASH),
    "apex": Language(*_C, _BACKSLASH),
    "go": Language(*_C, r"`[^`]*`|" + _DOUBLE + "|" + _CHAR),
    "rust": Language(*_C, r'r(#*)"[\s\S]*?"\1|"(?:\\[\s\S]|[^"\\])*"|' + _CHAR, nested=True),
    "proto": Language(*_C, _BACKSLASH),
    "css": Language((), ("/*", "*/"), _BACKSLASH),
    "scss": Language(*_C, r"url\([^)]*\)|" + _BACKSLASH),
    "sql": Language(("--",), ("/*", "*/"), r"\$(\w*)\$[\s\S]*?\$\1\$|'(?:''|[^'])*'|" + r'"(?:""|[^"])*"|\[[^\]\n]*\]', nested=True, unsure=r"'[^']*\\"),
    "php": Language(("//", "#"), ("/*", "*/"), r"<<<\s*['\"]?(\w+)['\"]?\r?\n[\s\S]*?\n\s*\1\b|" + r'"(?:\\[\s\S]|[^"\\])*"|' + r"'(?:\\[\s\S]|[^'\\])*'"),
    "powershell": Language(("#",), ("<#", "#>"), r"""@"[\s\S]*?\n"@|@'[\s\S]*?\n'@|"(?:`[\s\S]|""|[^"`])*"|'(?:''|[^'])*'""", spaced=True),
    "vb": Language(("'",), None, r'"(?:""|[^"\n])*"'),
    "fortran": Language(("!",), None, r'"(?:""|[^"\n])*"|' + r"'(?:''|[^'\n])*'"),
    "lua": Language(("--",), ("--[[", "]]"), r"\[(=*)\[[\s\S]*?\]\1\]|" + _BACKSLASH),
    "haskell": Language(("--",), ("{-", "-}"), _DOUBLE + "|" + _CHAR, nested=True),
    "lisp": Language((";",), None, r'"(?:\\[\s\S]|[^"\\])*"'),
    "gas": Language(("#",), ("/*", "*/"), _BACKSLASH),
    "shell": Language(("#",), None, r"<<-?\s*['\"]?(\w+)['\"]?[^\n]*\n[\s\S]*?\n\s*\1\b|" + r'"(?:\\[\s\S]|[^"\\])*"|' + r"'[^']*'|\\.|\$[#{(]", spaced=True, unsure=r"\$\(\("),
    "hash": Language(("#",), None, _BACKSLASH, spaced=True, unsure=r"%[qQwW]|<<[-~]?\w"),
    "hashline": Language(("#",), line_start=True),
    "ini": Language((";", "#"), line_start=True),
    "properties": Language(("#", "!"), line_start=True),
    "batch": Language(("::", "rem "), line_start=True, flags=re.I),
    "html": Language((), ("<!--", "-->"), r"<(?:script|style)\b[\s\S]*?</(?:script|style)>", unsure="<(?:script|style)"),
    "xml": Language((), ("<!--", "-->"), r"<!\[CDATA\[[\s\S]*?\]\]>"),
    "razor": Language((), ("@*", "*@"), r"<!--[\s\S]*?-->", unsure="@"),
    "aspnet": Language((), ("<%--", "--%>"), "", unsure="<%"),
    "fortran-fixed": Language(("c", "C", "*", "!"), line_start=True),
}
LANGUAGES |= {"jsx": LANGUAGES["js"], "sass": LANGUAGES["scss"]}
#: Languages whose description decides every construct that it meets.
CERTAIN = {"python", "java", "go", "css", "xml", "hashline", "ini", "properties"}


@dataclass
class Scan:
    """comments: (start, end, text inside the marks, kind); tokens: code without comments; uncertain: not every construct was decided."""

    comments: list[tuple[int, int, str, str]] = field(default_factory=list)
    tokens: list[str] = field(default_factory=list)
    uncertain: bool = False


@cache
def _pattern(lang: str) -> re.Pattern:
    d = LANGUAGES[lang]
    parts = []
    if d.block:
        parts.append(f"(?P<block>{re.escape(d.block[0])})")
    if d.line:
        before = r"^[ \t]*" if d.line_start else r"(?:(?<=\s)|(?<=^))" if d.spaced else ""
        parts.append(f"{before}(?P<line>(?:{'|'.join(map(re.escape, d.line))})[^\n]*)")
    if d.strings:  # group references inside count on from the groups before
        shift = len(re.compile("|".join(parts) or "x", re.M).groupindex) + 1 if parts else 1
        parts.append("(?P<string>" + re.sub(r"\\(\d)(?=[\"|$\]\\]|\b)", lambda m: "\\" + str(int(m[1]) + shift), d.strings) + ")")
    parts.append(r"(?P<word>[\w$]+|\n+|[^\w\s])")
    return re.compile("|".join(parts), re.M | d.flags)


def _block_end(text: str, at: int, mark: tuple[str, str], nested: bool) -> int | None:
    depth, pattern = 1, re.compile(f"{re.escape(mark[0])}|{re.escape(mark[1])}" if nested else re.escape(mark[1]))
    for m in pattern.finditer(text, at + len(mark[0])):
        depth += 1 if m[0] == mark[0] and nested and mark[0] != mark[1] else -1
        if not depth:
            return m.end()
    return None


def _described(text: str, lang: str) -> Scan:
    d, out, at, n = LANGUAGES[lang], Scan(), 0, len(text)
    pattern = _pattern(lang)
    while m := pattern.search(text, at):
        kind = m.lastgroup if m.lastgroup in ("block", "line", "string", "word") else "string"
        at = m.end()
        if kind == "block":
            end = _block_end(text, m.start(), d.block, d.nested)
            out.uncertain |= end is None
            at = n if end is None else end
            out.comments.append((m.start(), at, text[m.start() + len(d.block[0]) : at].removesuffix(d.block[1]), "comment"))
        elif kind == "line":
            start = m.start("line")
            mark = next(x for x in d.line if m["line"].lower().startswith(x.lower()))
            out.comments.append((start, at, m["line"][len(mark) :], "comment"))
        elif kind == "word" and m[0][0] == "\n":
            if out.tokens and out.tokens[-1] != "\n":
                out.tokens.append("\n")
        else:
            out.tokens.append(m[0])
    out.uncertain |= bool(d.unsure and re.search(d.unsure, text)) or lang not in CERTAIN
    return out


def _python(text: str, fine: bool) -> Scan:
    """Comments by the standard tokenizer; with ``fine``, docstrings (a string alone after a colon or at the start) too."""
    starts = [0]
    for line in text.splitlines(keepends=True):
        starts.append(starts[-1] + len(line))
    at = lambda p: starts[p[0] - 1] + p[1]
    out, before = Scan(), []
    try:
        for t in tokenize.generate_tokens(io.StringIO(text).readline):
            if t.type == tokenize.COMMENT:
                out.comments.append((at(t.start), at(t.end), t.string[1:], "comment"))
                continue
            alone = not before or (before[-1] == tokenize.INDENT and before[-3:-1] == [tokenize.OP, tokenize.NEWLINE])
            if fine and t.type == tokenize.STRING and alone:
                out.comments.append((at(t.start), at(t.end), t.string.strip("\"'"), "docstring"))
            if t.type == tokenize.NEWLINE:
                out.tokens.append("\n")
            elif t.type not in (tokenize.NL, tokenize.ENDMARKER, tokenize.ENCODING):
                out.tokens.append({tokenize.INDENT: ">", tokenize.DEDENT: "<"}.get(t.type, t.string))
            if t.type not in (tokenize.NL, tokenize.ENCODING):
                before.append(t.type)
    except (tokenize.TokenError, SyntaxError, ValueError, RecursionError):
        return Scan([], [text], True)
    return out


def scan(text: str, path: str, fine: bool = False) -> Scan:
    """Comments and tokens of a file by its name; a name without a known language gives no comments and is uncertain."""
    text = text.removeprefix("﻿")
    lang = language_of(path)
    if lang == "python":
        return _python(text, fine)
    if lang in LANGUAGES:
        return _described(text, lang)
    return Scan([], text.split(), lang != "none")


UNITS = "array<struct<sl:int,sc:int,el:int,ec:int,whole:boolean,kind:string,text:string>>"


def comment_units(text: str, path: str, fine: bool = False, extra: tuple[str, ...] = ()) -> list[dict]:
    """Comment units in file order; lines from 1 inclusive, columns from 0 with an open end.

    Comments that have their lines to themselves, on lines in a row, are one unit. With ``fine``, a comment after code and a docstring are units
    too. Directives split a run; a run with a licence marker, and everything before the first code of a file whose header has one, is left
    out, as are a first line's ``#!`` and Python's encoding line.
    """
    text = text.removeprefix("\ufeff")
    found = sorted(scan(text, path, fine).comments)
    if not found:
        return []
    kind = np.array([k for *_, k in found], object)
    a, b = (np.array([c[k] for c in found]) for k in (0, 1))
    code = _first_code(text, a, b)
    b = np.array([i + len(text[i:j].rstrip("\r\n")) for i, j in zip(a, b, strict=True)])
    begins = np.array([0, *(m.end() for m in re.finditer("\n", text))])
    sl, el = np.searchsorted(begins, a, "right"), np.searchsorted(begins, b, "right")
    stop = np.append(begins[1:] - 1, len(text))[el - 1]
    written = lambda x, y: np.array([not text[i:j].isspace() and i < j for i, j in zip(x, y, strict=True)])
    before, behind = written(begins[sl - 1], a), written(b, stop)
    flag = np.array(directives((c[2] for c in found), extra), object)
    if ((kind == "comment") & (flag == "license") & (a < code)).any():
        flag[(kind != "docstring") & (flag == "") & (b <= code)] = "license"
    told = (a == 0) & text.startswith("#!")
    if language_of(path) == "python":
        told |= np.array([n <= 2 and re.match(r"[ \t\f]*#.*?coding[:=]", text[begins[n - 1] :]) is not None for n in sl])
    stay = ~(before & behind) & ~told
    kind, a, b, sl, el, flag, whole = (x[stay] for x in (kind, a, b, sl, el, flag, ~(before | behind)))
    if not len(a):
        return []

    # gaps and islands: a run is whole lines in a row, an island of it what stands between directives
    alone = (kind != "docstring") & whole
    follows = np.zeros(len(a), bool)
    follows[1:] = alone[1:] & alone[:-1] & (sl[1:] == el[:-1] + 1)
    run = np.cumsum(~follows) - 1
    licensed = (np.bincount(run, flag == "license") > 0)[run]
    wanted = np.where(kind == "docstring", flag != "license", (flag == "") & ~licensed & (alone | fine))
    island = np.cumsum(flag != "")
    at = np.flatnonzero(wanted)
    head = np.append(True, (run[at[1:]] != run[at[:-1]]) | (island[at[1:]] != island[at[:-1]])) if len(at) else np.zeros(0, bool)
    first, last = at[head], at[np.append(head[1:], True)] if len(at) else at
    units = [
        {"sl": int(sl[i]), "sc": int(a[i] - begins[sl[i] - 1]), "el": int(el[j]), "ec": int(b[j] - begins[el[j] - 1]), "whole": bool(whole[i]), "kind": kind[i], "text": text[a[i] : b[j]]}
        for i, j in zip(first, last, strict=True)
    ]
    return sorted(units, key=lambda u: (u["sl"], u["sc"]))


def _first_code(text: str, a: np.ndarray, b: np.ndarray) -> int:
    """Where the first character stands that is neither white space nor in a comment."""
    bare = np.array(list(text))
    for i, j in zip(a, b, strict=True):
        bare[i:j] = " "
    return next((m.start() for m in re.finditer(r"\S", "".join(bare))), len(text))


def units_of(text: Column | str, path: Column | str, fine: bool = False, extra: tuple[str, ...] = ()) -> Column:
    """Column form of :func:`comment_units`; null text has none."""

    def run(t: pd.Series, p: pd.Series) -> pd.Series:
        return pd.Series([comment_units(a or "", b or "", fine, extra) for a, b in zip(t, p, strict=True)])

    return F.pandas_udf(run, UNITS)(text, path)


def tokens_of(text: Column | str, path: Column | str) -> Column:
    """Struct (tokens, uncertain) of a file's code without comments."""

    def run(t: pd.Series, p: pd.Series) -> pd.DataFrame:
        found = [scan(a or "", b or "") for a, b in zip(t, p, strict=True)]
        return pd.DataFrame({"tokens": [s.tokens for s in found], "uncertain": [s.uncertain for s in found]})

    return F.pandas_udf(run, "struct<tokens:array<string>,uncertain:boolean>")(text, path)


def invariance(before: Column, after: Column) -> Column:
    """proven, equal-uncertain, differs or unsupported, for two structs of :func:`tokens_of`: whether an edit left the code as it was."""
    unsure = before["uncertain"] | after["uncertain"]
    same = before["tokens"].eqNullSafe(after["tokens"])
    return F.when(before.isNull() | after.isNull(), "unsupported").when(~same, "differs").when(unsure, "equal-uncertain").otherwise("proven")
