"""A site as one Markdown document, its attachments, and portable paths."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions import text as tx
from . import markdown

#: Device names that no file may have.
RESERVED = ("con", "prn", "aux", "nul", *(f"com{k}" for k in range(1, 10)), *(f"lpt{k}" for k in range(1, 10)))


def portable_name(name: Column) -> Column:
    """A file name that every system takes: forbidden characters as _, no trailing dots or spaces, device names marked."""
    safe = F.regexp_replace(F.regexp_replace(name, r'[<>:"/\\|?*\x00-\x1f]', "_"), r"[. ]+$", "")
    stem = F.lower(F.substring_index(safe, ".", 1))
    return F.when(safe == "", "_").when(stem.isin(*RESERVED), F.concat(F.lit("_"), safe)).otherwise(safe)


def free_name(name: str, taken: set[str]) -> str:
    """A name that isn't taken: name_v2.ext, name_v3.ext and so on."""
    stem, dot, ext = name.rpartition(".")
    stem, ext = (stem, dot + ext) if dot else (name, "")
    names = (f"{stem}_v{k}{ext}" for k in range(2, len(taken) + 3))
    return name if name not in taken else next(n for n in names if n not in taken)


def attachments(pages: DataFrame) -> DataFrame:
    """(url, type, name): files that pages (pos, page) refer to, each URL once, in the order of its first place."""
    refs = pages.select("pos", F.posexplode("page.binary_references").alias("k", "r")).select("pos", "k", "r.*")
    first = refs.groupBy("url").agg(F.min_by(F.struct("type", "name"), F.struct("pos", "k")).alias("r"), F.min(F.struct("pos", "k")).alias("at"))
    return first.orderBy("at").select("url", "r.type", "r.name")


def unique_anchors(headings: DataFrame, scope: str, order: str, title: str) -> DataFrame:
    """Rows with ``anchor``: that of the title, with -1, -2 after repeats in a scope."""
    base = headings.withColumn("__a", tx.anchor(F.col(title)))
    n = F.row_number().over(Window.partitionBy(scope, "__a").orderBy(order)) - 1
    return base.withColumn("__n", n).withColumn("anchor", F.when(F.col("__n") == 0, F.col("__a")).otherwise(F.concat("__a", F.lit("-"), F.col("__n").cast("string")))).drop("__a", "__n")


def image_paths(content: Column, change) -> Column:
    """Content blocks with the source of each picture changed by ``change`` (Column to Column)."""
    return F.transform(content, lambda b: b.withField("src", F.when(b["type"] == "image", change(b["src"])).otherwise(b["src"])))


def toc(pages: DataFrame, depth: str) -> DataFrame:
    """(site, pos, line): contents lines of pages (site, pos, title, depth), indented by depth up to four, with unique anchors."""
    rows = unique_anchors(pages, "site", "pos", "title")
    indent = F.repeat(F.lit("  "), F.least(F.col(depth), F.lit(4)))
    return rows.select("site", "pos", F.concat(indent, F.lit("- ["), "title", F.lit("](#"), "anchor", F.lit(")")).alias("line"))


def archive(pages: DataFrame, gaps: DataFrame | None = None) -> DataFrame:
    """(site, markdown): each site's pages (site, pos, depth, page) as one document: contents, a section for each page, attachments, gaps.

    ``gaps``: (site, reason, item) of what was not archived. A site's document is one value, as its format has it.
    """
    flat = pages.select("site", "pos", "depth", "page", F.col("page.title").alias("title"))
    contents = toc(flat, "depth").groupBy("site").agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("pos", "line"))), lambda x: x["line"]), "\n").alias("toc"))
    section = F.concat(F.lit("## "), "title", F.lit("\n\n<"), "page.url", F.lit(">\n\n"), markdown.render_page(F.col("page.content")))
    body = flat.select("site", F.struct("pos", section.alias("text")).alias("s")).groupBy("site").agg(F.array_join(F.transform(F.array_sort(F.collect_list("s")), lambda x: x["text"]), "\n\n").alias("body"))
    refs = flat.select("site", "pos", F.posexplode("page.binary_references").alias("k", "r")).groupBy("site", "r.url").agg(F.min(F.struct("pos", "k", "r")).alias("f"))
    line = F.concat(F.lit("- ["), "f.r.name", F.lit("]("), "f.r.url", F.lit(") "), "f.r.type")
    refs = refs.select("site", F.struct("f.pos", "f.k", line.alias("text")).alias("s")).groupBy("site").agg(F.array_join(F.transform(F.array_sort(F.collect_list("s")), lambda x: x["text"]), "\n").alias("refs"))
    out = contents.join(body, "site").join(refs, "site", "left")
    if gaps is not None:
        listed = gaps.groupBy("site").agg(F.array_join(F.array_sort(F.collect_set(F.concat(F.lit("- "), "reason", F.lit(": "), "item"))), "\n").alias("gaps"))
        out = out.join(listed, "site", "left")
    else:
        out = out.withColumn("gaps", F.lit(None).cast("string"))
    part = lambda title, c: F.when(F.col(c).isNotNull(), F.concat(F.lit(f"\n\n## {title}\n\n"), c)).otherwise("")
    whole = F.concat(F.lit("# "), "site", F.lit("\n\n## Contents\n\n"), "toc", F.lit("\n\n"), "body", part("Attachments", "refs"), part("Not archived", "gaps"), F.lit("\n"))
    return out.select("site", whole.alias("markdown"))


def sitemap_urls(files: DataFrame, roots: list[str], max_depth: int = 3, most: int = 5000) -> DataFrame:
    """(url, depth): page addresses that sitemaps (url, body: their XML) list, from the roots through indexes up to ``max_depth`` deep.

    Indexes on other hosts than their parent's aren't followed. ``most`` is the limit that the operator has; addresses nearest the roots stay.
    """
    from ..functions import urls

    loc = F.regexp_extract_all("body", F.lit(r"(?s)<loc>\s*(?:<!\[CDATA\[)?\s*(.*?)\s*(?:\]\]>)?\s*</loc>"), 1)
    rows = files.select("url", F.col("body").rlike("<sitemapindex").alias("is_index"), F.explode(loc).alias("loc"))
    rows = rows.withColumn("loc", F.replace("loc", F.lit("&amp;"), F.lit("&"))).filter(F.col("loc").rlike("^https?://"))
    level = files.sparkSession.createDataFrame([(r,) for r in roots], "url string").withColumn("depth", F.lit(0))
    found = None
    for depth in range(max_depth + 1):  # a fixed number of joins
        here = rows.join(level.select("url").distinct(), "url")
        pages = here.filter("not is_index").select(F.col("loc").alias("url"), F.lit(depth).alias("depth"))
        found = pages if found is None else found.unionByName(pages)
        same = urls.strip_www(urls.netloc(F.col("loc"))) == urls.strip_www(urls.netloc(F.col("url")))
        level = here.filter(F.col("is_index") & same).select(F.col("loc").alias("url"))
    return found.groupBy("url").agg(F.min("depth").alias("depth")).orderBy("depth", "url").limit(most)
