"""Files of mixed kinds as rows of text: encodings, office containers, mail and web pages, read through Spark's binary source.

No file ever stops a job: what can't be read is a row with a status and a warning.
"""

from __future__ import annotations

import email
import email.policy
import io
import re
import zipfile
from xml.etree import ElementTree

import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import files as kinds

#: Caps on rows of a sheet and bytes of a file, and byte order marks with their encodings.
MOST_ROWS, MOST_BYTES = 5000, 25 << 20
MARKS = ((b"\xff\xfe\x00\x00", "utf-32"), (b"\x00\x00\xfe\xff", "utf-32"), (b"\xff\xfe", "utf-16"), (b"\xfe\xff", "utf-16"), (b"\xef\xbb\xbf", "utf-8-sig"))
READ = "struct<text:string,status:string,warnings:array<string>,attachments:array<struct<name:string,content:binary>>>"
_W = "{http://schemas.openxmlformats.org/wordprocessingml/2006/main}"
_S = "{http://schemas.openxmlformats.org/spreadsheetml/2006/main}"
_A = "{http://schemas.openxmlformats.org/drawingml/2006/main}"


def decode(data: bytes) -> str:
    """Text of bytes: a byte order mark decides, then the density of zeros in the first 2000 bytes, then UTF-8, cp1252 and latin-1."""
    for mark, name in MARKS:
        if data.startswith(mark):
            return data.decode(name, "replace")
    head = data[:2000]
    if head.count(0) >= 0.4 * max(len(head), 1):
        return data.decode("utf-16-be" if head[::2].count(0) > head[1::2].count(0) else "utf-16-le", "replace")
    for name in ("utf-8", "cp1252"):
        try:
            return data.decode(name)
        except UnicodeDecodeError:
            pass
    return data.decode("latin-1")


def _docx(data: bytes) -> tuple[str, list[str]]:
    """Body in order: headings with marks, list items, table rows with cells that merging repeats taken once."""
    with zipfile.ZipFile(io.BytesIO(data)) as z:
        body = ElementTree.fromstring(z.read("word/document.xml")).find(f"{_W}body")

    def words(p) -> str:
        return "".join(t.text or "" if t.tag == f"{_W}t" else "\t" if t.tag == f"{_W}tab" else "\n" if t.tag == f"{_W}br" else "" for t in p.iter())

    out = []
    for node in body:
        if node.tag == f"{_W}p":
            style = node.find(f"{_W}pPr/{_W}pStyle")
            name = style.get(f"{_W}val", "") if style is not None else ""
            text = words(node).strip()
            level = re.match(r"(?i)heading\s*(\d)", name)
            listed = "list" in name.lower() or node.find(f"{_W}pPr/{_W}numPr") is not None
            if text:
                out.append("#" * int(level[1]) + " " + text if level else "- " + text if listed else text)
        elif node.tag == f"{_W}tbl":
            for tr in node.iter(f"{_W}tr"):
                cells = [" ".join(words(c).split()) for c in tr.findall(f"{_W}tc")]
                out.append("| " + " | ".join(c for k, c in enumerate(cells) if not k or c != cells[k - 1]) + " |")
    return "\n".join(out), []


def _xlsx(data: bytes) -> tuple[str, list[str]]:
    """Sheets as tab-separated rows that aren't empty, MOST_ROWS of each at most."""
    warnings, out = [], []
    with zipfile.ZipFile(io.BytesIO(data)) as z:
        names = set(z.namelist())
        shared = ["".join(t.text or "" for t in si.iter(f"{_S}t")) for si in ElementTree.fromstring(z.read("xl/sharedStrings.xml"))] if "xl/sharedStrings.xml" in names else []
        titles = [s.get("name", "") for s in ElementTree.fromstring(z.read("xl/workbook.xml")).iter(f"{_S}sheet")]
        sheets = sorted((n for n in names if re.fullmatch(r"xl/worksheets/sheet\d+\.xml", n)), key=lambda n: int(re.search(r"\d+", n.rsplit("/", 1)[1])[0]))
        for k, name in enumerate(sheets):
            rows = []
            for row in ElementTree.fromstring(z.read(name)).iter(f"{_S}row"):
                cells: dict[int, str] = {}
                for at, c in enumerate(row.iter(f"{_S}c")):
                    letters = re.match("[A-Z]+", c.get("r", ""))
                    col = at
                    if letters:
                        col = 0
                        for ch in letters[0]:
                            col = 26 * col + ord(ch) - 64
                        col -= 1
                    v = c.find(f"{_S}v")
                    text = "".join(t.text or "" for t in c.iter(f"{_S}t")) if c.get("t") == "inlineStr" else (v.text or "" if v is not None else "")
                    cells[col] = shared[int(text)] if c.get("t") == "s" and text else text
                if any(x.strip() for x in cells.values()):
                    rows.append("\t".join(cells.get(i, "") for i in range(max(cells) + 1)))
            if len(rows) > MOST_ROWS:
                warnings.append(f"sheet {k + 1}: {len(rows) - MOST_ROWS} rows left out")
            out.append("\n".join([f"# {titles[k] if k < len(titles) else name}", *rows[:MOST_ROWS]]))
    return "\n\n".join(out), warnings


def _pptx(data: bytes) -> tuple[str, list[str]]:
    """Slides in order: their paragraphs, then their notes."""
    with zipfile.ZipFile(io.BytesIO(data)) as z:
        numbered = lambda stem: {int(m[1]): n for n in z.namelist() if (m := re.fullmatch(rf"ppt/{stem}(\d+)\.xml", n))}
        slides, notes = numbered("slides/slide"), numbered("notesSlides/notesSlide")
        lines = lambda n: [t for p in ElementTree.fromstring(z.read(n)).iter(f"{_A}p") if (t := "".join(x.text or "" for x in p.iter(f"{_A}t")).strip())]
        out = []
        for k in sorted(slides):
            out.append("\n".join([f"# Slide {k}", *lines(slides[k]), *(["Notes:", *lines(notes[k])] if k in notes else [])]))
    return "\n\n".join(out), []


def _eml(data: bytes) -> tuple[str, list[str], list[dict]]:
    """Five headers, the plain body or else the HTML body as text, and attachments."""
    from ..operators.html import text_of

    m = email.message_from_bytes(data, policy=email.policy.default)
    head = [f"{h}: {m[h]}" for h in ("From", "To", "Cc", "Date", "Subject") if m[h]]
    body = m.get_body(("plain", "html"))
    text = body.get_content() if body is not None else ""
    if body is not None and body.get_content_type() == "text/html":
        text = text_of(text)
    files = [{"name": a.get_filename() or "attachment", "content": a.get_payload(decode=True) or b""} for a in m.iter_attachments()]
    return "\n".join([*head, "", text]), [], files


def read_one(path: str, data: bytes | None) -> dict:
    """One file as text with a status: read, empty, binary, too large, unsupported or failed."""
    name = path.rsplit("/", 1)[-1].lower()
    ext = "." + name.rsplit(".", 1)[1] if "." in name else ""
    row = {"text": None, "status": "read", "warnings": [], "attachments": []}
    if data is None or len(data) > MOST_BYTES:
        return row | {"status": "too large"}
    try:
        if ext in (".docx", ".xlsx", ".xlsm", ".pptx"):
            row["text"], row["warnings"] = {"d": _docx, "x": _xlsx, "p": _pptx}[ext[1]](data)
        elif ext == ".eml":
            row["text"], row["warnings"], row["attachments"] = _eml(data)
        elif ext in kinds.OFFICE or ext == ".msg":
            row |= {"status": "unsupported", "warnings": [f"no reader for {ext}"]}
        elif ext in kinds.BINARY or ext in kinds.IMAGE:
            row["status"] = "binary"
        elif ext in (".html", ".htm", ".mhtml"):
            from ..operators.html import text_of

            row["text"] = text_of(decode(data))
        else:
            text = decode(data)
            row |= {"status": "binary"} if "\0" in text[:4096] else {"text": text}
    except (zipfile.BadZipFile, KeyError, ElementTree.ParseError, ValueError, LookupError) as error:
        return row | {"status": "failed", "warnings": [f"{type(error).__name__}: {error}"[:200]]}
    if row["status"] == "read" and not (row["text"] or "").strip():
        row["status"] = "empty"
    return row


def read_text(path: Column | str, content: Column | str) -> Column:
    """Column form of :func:`read_one`."""

    def run(p: pd.Series, c: pd.Series) -> pd.DataFrame:
        return pd.DataFrame([read_one(a, b) for a, b in zip(p, c, strict=True)], columns=["text", "status", "warnings", "attachments"])

    return F.pandas_udf(run, READ)(path, content)


def read_folder(spark: SparkSession, folder: str, most_bytes: int = MOST_BYTES) -> DataFrame:
    """(path, kind, status, chars, text, warnings): every file below a folder but those a walk leaves out, and mail attachments one level deep.
    Files of no bytes are left out by Spark itself.

    Files are split over tasks by Spark's binary source; content of files above ``most_bytes`` is dropped before Python sees it.
    """
    raw = spark.read.format("binaryFile").option("recursiveFileLookup", "true").load(folder)
    inner = F.expr("path")
    raw = raw.filter(~kinds.is_skipped(inner)).select("path", F.when(F.col("length") <= most_bytes, F.col("content")).alias("content"))
    read = raw.select("path", read_text("path", "content").alias("r"))
    more = read.select("path", F.explode("r.attachments").alias("a")).select(F.concat("path", F.lit("!"), "a.name").alias("path"), F.col("a.content").alias("content"))
    read = read.unionByName(more.select("path", read_text("path", "content").alias("r")))
    return read.select("path", kinds.classify(F.col("path")).alias("kind"), "r.status", F.coalesce(F.length("r.text"), F.lit(0)).alias("chars"), "r.text", "r.warnings")


def append_pages(existing: DataFrame, new: DataFrame) -> DataFrame:
    """Pages with new ones added whose exact URL isn't there; of new ones with one URL the first by its order column stays."""
    first = new.groupBy("url").agg(F.min_by(F.struct(*new.columns), "ord").alias("r")).select("r.*")
    return existing.unionByName(first.join(existing.select("url"), "url", "left_anti").select(*existing.columns))
