"""States that are carried along texts: fences and comments of Markdown lines, zones of HTML pieces, current headings and rows of tables.

What a line is depends on all lines before it, but only through the state of a small automaton; :mod:`quill.operators.scans` finds the states of all lines at once.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from . import scans

BLANK = r"[ \t\r\f]*"
TEXT, COMMENT = 0, 1
#: Zones of HTML whose content isn't text: their names, how they open and how they close.
ZONES = (("comment", r"^<!--(?!.*-->$)", r"-->$"), ("script", r"(?i)^<script\b", r"(?i)^</script\b"), ("style", r"(?i)^<style\b", r"(?i)^</style\b"))


def fence_automaton(kinds: list[tuple[str, int]]) -> list[list[int]]:
    """Next states by symbol and state: 0 is text, 1 a comment, 2 + k a fence of kind k (its character and length).

    Symbols are 2 * what the line opens (0 nothing, 1 a comment, 2 + k a fence of kind k), and one more if it holds the end of a comment. A fence ends at a fence of its own character that is as
    long or longer; a comment at a line with its end; inside either nothing else counts.
    """
    delta = []
    for opens in range(2 + len(kinds)):
        for closes in (False, True):
            row = [opens, TEXT if closes else COMMENT]
            for k, (char, length) in enumerate(kinds):
                ends = opens >= 2 and kinds[opens - 2][0] == char and kinds[opens - 2][1] >= length
                row.append(TEXT if ends else 2 + k)
            delta.append(row)
    return delta


def line_states(docs: DataFrame, key: str, text: str) -> DataFrame:
    """(key, ord, zone, heading, table_row) of every line, numbered from 1.

    zone: text, fence (with the lines that open and close it) or comment (HTML comments over several lines). heading: the last line up to this one that is a heading outside
    fences and comments, or null. table_row: in a run of lines with a bar outside them, the line's place from 1, else null. The lengths of fences that occur
    are collected, a number for each different length. Keys must be unique; null texts have no lines.
    """
    lines = docs.select(key, F.posexplode(F.split(text, "\n")).alias("at", "line")).withColumn("at", F.col("at").cast("long"))
    mark = F.regexp_extract("line", f"^{BLANK}(`{{3,}}|~{{3,}})", 1)
    closes = F.col("line").contains("-->")
    comment = F.col("line").rlike(f"^{BLANK}<!--") & ~closes
    marked = lines.withColumn("mark", mark)
    found = marked.filter("mark <> ''").select(F.left("mark", F.lit(1)).alias("c"), F.length("mark").alias("n")).distinct().collect()
    kinds = sorted((r.c, r.n) for r in found)
    opens = F.when(comment, F.lit(COMMENT))
    for k, (char, length) in enumerate(kinds):
        opens = opens.when(F.col("mark") == char * length, F.lit(2 + k))
    symbol = 2 * opens.otherwise(F.lit(0)) + closes.cast("int")
    flags = {"symbol": symbol, "is_heading": F.col("line").rlike(r"^#{1,6}[ \t]"), "is_row": F.col("line").contains("|")}
    got = scans.automaton(marked.select(key, "at", *(c.alias(n) for n, c in flags.items())), key, "at", "symbol", fence_automaton(kinds), keep=("is_heading", "is_row"))
    outside = (F.col("before") == TEXT) & (F.col("after") == TEXT)
    number = F.col("at") + 1
    carried = {"heading": (F.max, F.when(outside & F.col("is_heading"), number)), "__gap": (F.max, F.when(~(outside & F.col("is_row")), number))}
    got = scans.running(got.withColumn("ord", number), [key], ["at"], F.col("at"), carried)
    zone = F.when(outside, "text").when((F.col("before") == COMMENT) | (F.col("after") == COMMENT), "comment").otherwise("fence")
    row = F.col("ord") - F.coalesce("__gap", F.lit(0))
    return got.select(key, "ord", zone.alias("zone"), "heading", F.when(row > 0, row).alias("table_row"))


def pieces(html: Column) -> Column:
    """Tags and the texts between them, in order."""
    return F.regexp_extract_all(html, F.lit(r"<[^>]*>|[^<]+|<"), F.lit(0))


def piece_states(pages: DataFrame, key: str, html: str) -> DataFrame:
    """(key, pos, zone, heading, n_chars) of every tag and text of a page, from 0.

    zone: text, comment, script or style, with the tags that open and close it. heading: the place of the last h1 to h3 that opened outside such zones, or
    null. n_chars: the length of a text in no zone, without white space at its ends; 0 for all else. Keys must be unique.
    """
    rows = pages.select(key, F.posexplode(pieces(F.col(html))).alias("at", "piece")).withColumn("at", F.col("at").cast("long"))
    opens, closes = F.lit(0), F.lit(0)
    for k, (_, begin, end) in enumerate(ZONES):
        opens = F.when(F.col("piece").rlike(begin), k + 1).otherwise(opens)
        closes = closes + F.when(F.col("piece").rlike(end), 1 << k).otherwise(0)
    many = 1 << len(ZONES)
    delta = [[opened, *(0 if ended >> k & 1 else k + 1 for k in range(len(ZONES)))] for opened in range(len(ZONES) + 1) for ended in range(many)]
    size = F.when(F.col("piece").startswith("<"), 0).otherwise(F.length(F.regexp_replace("piece", r"^[ \t\r\n\f]+|[ \t\r\n\f]+$", "")))
    flags = {"symbol": opens * many + closes, "is_heading": F.col("piece").rlike(r"(?i)^<h[1-3]\b"), "size": size}
    got = scans.automaton(rows.select(key, "at", *(c.alias(n) for n, c in flags.items())), key, "at", "symbol", delta, keep=("is_heading", "size"))
    outside = (F.col("before") == TEXT) & (F.col("after") == TEXT)
    got = scans.running(got, [key], ["at"], F.col("at"), {"heading": (F.max, F.when(outside & F.col("is_heading"), F.col("at")))})
    inner = F.when(F.col("before") != TEXT, F.col("before")).otherwise(F.col("after"))
    zone = F.get(F.array(F.lit("text"), *(F.lit(n) for n, _, _ in ZONES)), inner)
    return got.select(key, F.col("at").alias("pos"), zone.alias("zone"), "heading", F.when(outside, F.col("size")).otherwise(0).cast("long").alias("n_chars"))
