"""Document quality rules as queries that return problem or issue rows over (doc, ord, line)."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from . import integrity

HEADING = r"^(#{1,6})\s+(.*?)\s*#*\s*$"


def _by(doc: str, *order: str) -> Window:
    return Window.partitionBy(doc).orderBy(*(order or ("ord",)))


def headings(lines: DataFrame, doc: str) -> DataFrame:
    """(doc, ord, level, title)."""
    line = F.trim("line")
    return lines.filter(line.rlike(HEADING)).select(doc, "ord", F.length(F.regexp_extract(line, HEADING, 1)).alias("level"), F.regexp_extract(line, HEADING, 2).alias("title"))


def with_heading(lines: DataFrame, doc: str) -> DataFrame:
    """Lines with the title of the heading that governs them, null before the first."""
    line = F.trim("line")
    title = F.when(line.rlike(HEADING), F.regexp_extract(line, HEADING, 2))
    return lines.withColumn("heading", F.last(title, ignorenulls=True).over(_by(doc)))


def outside_code(lines: DataFrame, doc: str) -> DataFrame:
    """Lines that no fenced block and no HTML comment of several lines holds; comments within a line are cut.

    Fences are told apart by parity of fence lines, so a fence shown inside a longer fence counts too.
    """
    fence = F.col("line").rlike(r"^\s*(```|~~~)")
    n = F.sum(fence.cast("int")).over(_by(doc))
    opens = F.trim("line").startswith("<!--") & ~F.col("line").contains("-->")
    df = lines.withColumn("__f", fence).withColumn("__n", n).filter("not __f and __n % 2 = 0")
    mark = F.when(opens, 1).when(F.col("line").contains("-->"), 0)
    state = F.coalesce(F.last(mark, ignorenulls=True).over(_by(doc)), F.lit(0))
    before = F.coalesce(F.lag("__s").over(_by(doc)), F.lit(0))
    df = df.withColumn("__s", state).withColumn("__b", before).filter("__s = 0 and __b = 0")
    return df.withColumn("line", F.regexp_replace("line", r"<!--.*?-->", "")).drop("__f", "__n", "__s", "__b")


def container_problems(lines: DataFrame, doc: str) -> DataFrame:
    """(doc, ord, problem): close marks that close nothing, and at line 0 how many containers stay open.

    Depth restarts at zero where it would fall below: it is the running sum less its least value so far.
    """
    s = F.trim("line")
    step = F.when(s.rlike(r"^:::\s*\w+"), 1).when(s == ":::", -1).otherwise(0)
    raw = lines.select(doc, "ord", step.alias("step")).withColumn("raw", F.sum("step").over(_by(doc)))
    low = F.least(F.lit(0), F.min("raw").over(_by(doc)))
    df = raw.withColumn("low", low).withColumn("before", F.coalesce(F.lag("low").over(_by(doc)), F.lit(0)))
    over = df.filter("low < before").select(doc, "ord", F.lit("closes nothing").alias("problem"))
    left = df.groupBy(doc).agg(F.max_by(F.col("raw") - F.col("low"), "ord").alias("n")).filter("n > 0")
    return over.unionByName(left.select(doc, F.lit(0).alias("ord"), F.concat(F.col("n").cast("string"), F.lit(" not closed")).alias("problem")))


def empty_sections(lines: DataFrame, doc: str) -> DataFrame:
    """(doc, ord, title) of headings followed by one of the same or a higher level with only blank lines between."""
    line = F.trim("line")
    is_head = line.rlike(HEADING)
    text = (~is_head & (line != "")).cast("int")
    df = lines.withColumn("h", is_head).withColumn("text", F.sum(text).over(_by(doc))).filter("h")
    df = df.select(doc, "ord", F.length(F.regexp_extract(line, HEADING, 1)).alias("level"), F.regexp_extract(line, HEADING, 2).alias("title"), "text")
    nxt = lambda c: F.lead(c).over(_by(doc))
    df = df.withColumn("next_level", nxt("level")).withColumn("next_text", nxt("text"))
    return df.filter("next_level <= level and next_text = text").select(doc, "ord", "title")


def inferred_prefixes(lines: DataFrame, doc: str) -> DataFrame:
    """(doc, prefix) of ids found at headings and in first table cells."""
    line = F.trim("line")
    found = F.array(F.regexp_extract(line, r"^#{2,6}\s+([A-Z]{1,3})\d{1,3}\s*[·–\-:.]", 1), F.regexp_extract(line, r"^\|\s*\**([A-Z]{1,3})\d{1,3}\**\s*\|", 1))
    return lines.select(doc, F.explode(found).alias("prefix")).filter("prefix <> ''").distinct()


def scan_ids(lines: DataFrame, doc: str, prefixes: list[str]) -> DataFrame:
    """(doc, ord, role, prefix, num, width, title): definitions (a heading, table row, bold line or item that begins with an id) and
    references (any other place). A table row whose id is defined before counts as a reference."""
    p = "|".join(sorted(prefixes, key=len, reverse=True))
    line = F.trim("line")
    forms = (rf"^#{{2,6}}\s+\**({p})(\d{{1,3}})\**\s*[·–\-:.](.*)$", rf"^\|\s*\**({p})(\d{{1,3}})\**\s*\|(.*)$", rf"^\**({p})(\d{{1,3}})\s*[–\-·:.](.*)$", rf"^[-*]\s+\**({p})(\d{{1,3}})\**\s*[–\-·:.](.*)$")
    part = lambda k: F.coalesce(*(F.when(line.rlike(f), F.regexp_extract(line, f, k)) for f in forms))
    row = line.rlike(forms[1]) & ~line.rlike(forms[0])
    title = F.lower(F.regexp_replace(F.regexp_replace(F.substring_index(part(3), "|", 1), "[*\"“”«»]", ""), r"^[ ·–\-:.]+|[ ·–\-:.]+$", ""))
    df = lines.select(doc, "ord", line.alias("line"), part(1).alias("prefix"), part(2).alias("digits"), title.alias("title"), row.alias("row"))
    earlier = F.count("prefix").over(Window.partitionBy(doc, "prefix", F.col("digits").cast("int")).orderBy("ord").rowsBetween(Window.unboundedPreceding, -1))
    df = df.withColumn("defines", F.col("prefix").isNotNull() & ~(F.col("row") & (earlier > 0)))
    defs = df.filter("defines").select(doc, "ord", F.lit("def").alias("role"), "prefix", F.col("digits").cast("int").alias("num"), F.length("digits").alias("width"), "title")
    rest = F.when(F.col("defines"), F.regexp_replace("line", rf"^[^A-Za-z]*({p})\d{{1,3}}", "")).otherwise(F.col("line"))
    each = F.explode(F.regexp_extract_all(rest, F.lit(rf"(?<![A-Za-z0-9_\-#@./])(?:{p})\d{{1,3}}(?![A-Za-z0-9_])"), 0)).alias("id")
    refs = df.select(doc, "ord", each).select(doc, "ord", F.lit("ref").alias("role"), F.regexp_extract("id", r"^[A-Z]+", 0).alias("prefix"), F.regexp_extract("id", r"\d+$", 0).alias("digits"))
    return defs.unionByName(refs.select(doc, "ord", "role", "prefix", F.col("digits").cast("int").alias("num"), F.length("digits").alias("width"), F.lit(None).cast("string").alias("title")))


def _id(width: int = 2) -> Column:
    return F.concat(F.col("prefix"), F.lpad(F.col("num").cast("string"), width, "0"))


def id_problems(ids: DataFrame, doc: str) -> DataFrame:
    """(severity, doc, ord, message): ids cited but not defined (only with a width the prefix is defined with, or of two digits where it has
    none), defined but never cited, defined twice, and gaps of a sequence."""
    key = [doc, "prefix", "num"]
    defs, refs = ids.filter("role = 'def'"), ids.filter("role = 'ref'")
    widths = defs.select(doc, "prefix", "width").distinct()
    known = widths.select(doc, "prefix").distinct().withColumn("__has", F.lit(True))
    cites = refs.join(widths.withColumn("__w", F.lit(True)), [doc, "prefix", "width"], "left").join(known, [doc, "prefix"], "left")
    cites = cites.filter(F.col("__w") | (F.col("__has").isNull() & (F.col("width") >= 2)))
    issue = lambda df, sev, text: df.select(F.lit(sev).alias("severity"), doc, "ord", F.concat(_id(), F.lit(text)).alias("message"))
    first = lambda df: df.groupBy(*key).agg(F.min("ord").alias("ord"))
    undefined = issue(first(cites).join(defs.select(*key).distinct(), key, "left_anti"), "E", " is cited but never defined")
    uncited = issue(first(defs).join(refs.select(*key).distinct(), key, "left_anti"), "W", " is defined but never cited")
    twice = issue(defs.groupBy(*key).agg(F.count("*").alias("n"), F.max("ord").alias("ord")).filter("n > 1"), "E", " is defined more than once")
    holes = integrity.sequence_gaps(defs.select(F.struct(doc, "prefix").alias("g"), "num").distinct(), "g", "num")
    gaps = holes.select(F.col(f"g.{doc}").alias(doc), F.col("g.prefix").alias("prefix"), F.col("missing").alias("num"), F.lit(0).alias("ord"))
    return undefined.unionByName(uncited).unionByName(twice).unionByName(issue(gaps, "W", " is missing: a gap"))


def section_reference_problems(lines: DataFrame, doc: str, words: tuple[str, ...]) -> DataFrame:
    """(doc, ord, ref): numbers after a section word that no heading of the document has."""
    numbers = headings(lines, doc).select(doc, F.regexp_extract("title", r"^(\d+(?:\.\d+)*)\.?\s", 1).alias("ref")).filter("ref <> ''")
    pattern = rf"(?i)\b(?:{'|'.join(sorted(words, key=len, reverse=True))})\s+(\d+(?:\.\d+)*)"
    refs = lines.filter(~F.trim("line").rlike(HEADING)).select(doc, "ord", F.explode(F.regexp_extract_all("line", F.lit(pattern), 1)).alias("ref"))
    return refs.join(numbers, [doc, "ref"], "left_anti").select(doc, "ord", "ref")


def numbering_problems(lines: DataFrame, doc: str) -> DataFrame:
    """(doc, ord, number, expected): numbered headings that don't follow the one before at their level under the same parent."""
    h = headings(lines, doc).withColumn("number", F.regexp_extract("title", r"^(\d+(?:\.\d+)*)\.?\s", 1)).filter("number <> ''")
    h = h.withColumn("parent", F.regexp_replace("number", r"\.?\d+$", "")).withColumn("own", F.substring_index("number", ".", -1).cast("int"))
    before = F.coalesce(F.lag("own").over(Window.partitionBy(doc, "parent").orderBy("ord")), F.lit(0)) + 1
    expected = F.concat(F.when(F.col("parent") != "", F.concat("parent", F.lit("."))).otherwise(""), before.cast("string"))
    return h.withColumn("expected", expected).filter("number <> expected").select(doc, "ord", "number", "expected")


def caption_numbers(lines: DataFrame, doc: str) -> DataFrame:
    """(doc, ord, kind, n): figures and captioned tables, numbered by kind."""
    line = F.trim("line")
    kind = F.when(line.startswith("!["), "figure").when(line.startswith("Table:"), "table")
    df = lines.select(doc, "ord", kind.alias("kind")).filter("kind is not null")
    return df.withColumn("n", F.row_number().over(Window.partitionBy(doc, "kind").orderBy("ord")))


def revision_problems(old: DataFrame, new: DataFrame) -> DataFrame:
    """(id, problem): ids of (id, title) that the new version lacks: renumbered where their title has another id now, else gone."""
    lost = old.join(new.select("id"), "id", "left_anti")
    moved = new.filter("title <> ''").select(F.col("title"), F.col("id").alias("now")).groupBy("title").agg(F.max("now").alias("now"))
    return lost.join(moved, "title", "left").select("id", F.when(F.col("now").isNotNull(), F.concat(F.lit("renumbered to "), "now")).otherwise("gone").alias("problem"))


def parity_problems(here: DataFrame, there: DataFrame) -> DataFrame:
    """(id, problem): ids that only one of two versions defines."""
    a, b = here.select("id").distinct(), there.select("id").distinct()
    only = lambda x, y, name: x.join(y, "id", "left_anti").withColumn("problem", F.lit(name))
    return only(a, b, "only here").unionByName(only(b, a, "only there"))


def set_reference_problems(refs: DataFrame, sections: DataFrame) -> DataFrame:
    """(ref, section, title): references (ref, section, title: documents they name) to exactly one document of the set that lacks the section."""
    known = refs.join(sections.select("title").distinct(), "title", "left_semi")
    one = known.groupBy("ref").agg(F.count_distinct("title").alias("n"), F.first("section").alias("section"), F.first("title").alias("title")).filter("n = 1")
    s = sections.select("title", F.col("number").alias("section"))
    return one.join(s, ["title", "section"], "left_anti").select("ref", "section", "title")


def translation_problems(rows: DataFrame) -> DataFrame:
    """(problem) over (id, src, dst, term, translated): numbers that a translation changes, terms with several translations."""
    digits = lambda c: F.sort_array(F.regexp_extract_all(c, F.lit(r"\d+"), 0))
    lost = rows.filter(digits("src") != digits("dst")).select(F.concat(F.lit("numbers differ in "), F.col("id").cast("string")).alias("problem"))
    terms = rows.groupBy("term").agg(F.count_distinct("translated").alias("n")).filter("n > 1")
    return lost.unionByName(terms.select(F.concat("term", F.lit(" has "), F.col("n").cast("string"), F.lit(" translations")).alias("problem")))


#: Bands of sentences and items by priority, and signal words from weak to strong.
BANDS = {"High": (3, 5, 5, 15), "Medium": (2, 3, 3, 8), "Low": (1, 2, 2, 5)}
SIGNALS = ("NOTICE", "CAUTION", "WARNING", "DANGER")


def use_case_problems(cases: DataFrame) -> DataFrame:
    """(code, problem) over (code, priority, sentences, items, depends)."""
    prefix, number = F.substring_index("code", "-", 1), F.substring_index("code", "-", -1).cast("int")
    order = F.row_number().over(Window.partitionBy(prefix).orderBy(number))
    issue = lambda df, text: df.select("code", text.alias("problem"))
    gaps = issue(cases.withColumn("k", order).filter(number != F.col("k")), F.lit("number out of sequence"))
    loose = cases.filter("depends is not null").join(cases.select(F.col("code").alias("depends")), "depends", "left_anti")
    ok = F.lit(None).cast("boolean")
    for name, (s1, s2, i1, i2) in BANDS.items():
        ok = F.when(F.col("priority") == name, F.col("sentences").between(s1, s2) & F.col("items").between(i1, i2)).otherwise(ok)
    size = issue(cases.filter(~ok), F.lit("size outside its band"))
    return gaps.unionByName(issue(loose, F.concat(F.lit("depends on "), F.col("depends")))).unionByName(size)


def weakened_signals(rows: DataFrame) -> DataFrame:
    """(id) of rows whose translated signal word is weaker than the source's."""
    rank = lambda c: F.array_position(F.array(*map(F.lit, SIGNALS)), F.upper(c))
    return rows.filter((rank(F.col("dst")) > 0) & (rank(F.col("dst")) < rank(F.col("src")))).select("id")


def chapter_problems(found: DataFrame, expected: DataFrame) -> DataFrame:
    """(doc, problem): chapters (doc, ord, title) against a type's list (pos, title): missing ones, and those before an earlier chapter of the list.

    A chapter is out of order where one of a larger place comes before it: a running maximum.
    """
    e = expected.select("pos", F.lower(F.trim("title")).alias("k"), F.col("title").alias("wanted"))
    f = found.withColumn("k", F.lower(F.trim(F.regexp_replace("title", r"^\d+(\.\d+)*\.?\s+", "")))).join(e, "k")
    before = F.max("pos").over(_by("doc").rowsBetween(Window.unboundedPreceding, -1))
    late = f.withColumn("b", before).filter("b > pos").select("doc", F.concat("wanted", F.lit(" is out of order")).alias("problem"))
    chapters = [F.struct(F.lit(r.k).alias("k"), F.lit(r.wanted).alias("wanted")) for r in e.select("k", "wanted").collect()]  # a type's list is written by hand
    every = found.select("doc").distinct().select("doc", F.explode(F.array(*chapters)).alias("c")).select("doc", "c.k", "c.wanted")
    lost = every.join(f.select("doc", "k").distinct(), ["doc", "k"], "left_anti")
    return late.unionByName(lost.select("doc", F.concat("wanted", F.lit(" is missing")).alias("problem")))


def version_numbers(text: Column) -> Column:
    """The first version in a text as whole numbers, null without one; arrays compare number by number."""
    v = F.regexp_extract(text, r"\d+(?:\.\d+)+|\d+", 0)
    return F.when(v != "", F.transform(F.split(v, r"\."), lambda x: x.cast("int")))


def names_other_document(before: Column, words: tuple[str, ...], own: Column, this: tuple[str, ...]) -> Column:
    """Whether the clause before a reference names another document: a document word, that isn't the document's own name and has no word
    for 'this' before it."""
    clause = F.lower(F.element_at(F.split(before, "[.;]"), -1))
    last = F.regexp_extract(clause, rf"(?s)^.*\b({'|'.join(sorted(words, key=len, reverse=True))})\b", 1)
    lead = F.regexp_extract(clause, rf"(?s)^(.*)\b(?:{'|'.join(sorted(words, key=len, reverse=True))})\b", 1)
    return (last != "") & ~F.array_contains(own, last) & ~lead.rlike(rf"\b(?:{'|'.join(this)})\b")


def card_fields(lines: DataFrame, doc: str) -> DataFrame:
    """(doc, card, ord, field, value): fields of cards, '**Name:** value' lines and bare continuation lines, under each heading with an id."""
    line = F.trim("line")
    card = F.last(F.when(line.rlike(HEADING), F.regexp_extract(line, r"^#+\s+([A-Z]{1,3}\d{1,3})\b", 1)), ignorenulls=True).over(_by(doc))
    name = F.when(line.rlike(r"^\*\*[^*]+:\*\*"), F.regexp_extract(line, r"^\*\*([^*]+):\*\*", 1))
    df = lines.withColumn("card", card).withColumn("name", name).withColumn("n", F.count("name").over(Window.partitionBy(doc, "card").orderBy("ord")))
    df = df.filter((F.coalesce("card", F.lit("")) != "") & (F.col("n") > 0) & (line != "") & ~line.rlike(HEADING))
    value = F.trim(F.regexp_replace(line, r"^\*\*[^*]+:\*\*", ""))
    rows = df.groupBy(doc, "card", "n").agg(F.min("ord").alias("ord"), F.max("name").alias("field"), F.array_sort(F.collect_list(F.struct("ord", value.alias("v")))).alias("vs"))
    return rows.select(doc, "card", "ord", "field", F.trim(F.array_join(F.transform("vs", lambda x: x["v"]), "\n")).alias("value"))


def to_be_confirmed(lines: DataFrame, doc: str) -> DataFrame:
    """Lines under a 'To be confirmed' heading of level two, up to the next heading of its level or above."""
    line = F.trim("line")
    level = F.length(F.regexp_extract(line, HEADING, 1))
    mark = F.when(line.rlike(HEADING) & (level <= 2), ((level == 2) & (F.lower(F.regexp_extract(line, HEADING, 2)) == "to be confirmed")).cast("int"))
    df = lines.withColumn("__in", F.coalesce(F.last(mark, ignorenulls=True).over(_by(doc)), F.lit(0))).withColumn("__m", mark)
    return df.filter("__in = 1 and __m is null").drop("__in", "__m")
