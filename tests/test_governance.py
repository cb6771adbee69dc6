from pyspark.sql import functions as F

from quill.operators import archive, gates, html, identifiers, quality, records


def test_archive(spark):
    raw = "<html><head><title>{}</title></head><body><article><h1>{}</h1><p>text of the page that is long enough to be the content area of this page, well above the bound</p><a href='f.pdf'>f</a></article></body></html>"
    rows = [("s", 1, 0, raw.format("One", "One"), "http://h.com/"), ("s", 2, 1, raw.format("One", "One"), "http://h.com/b")]
    pages = spark.createDataFrame(rows, "site string, pos int, depth int, raw string, url string").select("site", "pos", "depth", html.extract_page("raw", "url").alias("page"))
    gaps = spark.createDataFrame([("s", "blocked", "x.com"), ("s", "blocked", "x.com")], "site string, reason string, item string")
    text = archive.archive(pages, gaps).first().markdown
    assert text.startswith("# s\n\n## Contents\n\n- [One](#one)\n  - [One](#one-1)\n\n## One\n\n<http://h.com/>\n\ntext of")
    assert text.count("- [f.pdf](http://h.com/f.pdf) PDF") == 1 and text.endswith("## Not archived\n\n- blocked: x.com\n")
    assert archive.archive(pages).first().markdown.endswith("PDF\n")
    assert archive.free_name("a.md", {"a.md", "a_v2.md"}) == "a_v3.md" and archive.free_name("b", set()) == "b"
    moved = pages.select(archive.image_paths(F.col("page.content"), lambda c: F.concat(F.lit("img/"), c)).alias("c")).first().c
    assert moved[0].src is None


def test_records_round_trip(spark):
    header = spark.createDataFrame([("r", 1, "unit_id", "u"), ("r", 2, "scope", "a")], "record string, ord int, key string, value string")
    units = spark.createDataFrame([("r", 1, 1, "file", "a"), ("r", 1, 2, "edit", "x\ny"), ("r", 2, 1, "file", "b")], "record string, id int, ord int, key string, value string")
    text = records.render_record(header, units).first().text
    assert text == "unit_id: u\nscope: a\nunit: 1\nfile: a\nedit: x\n  y\nunit: 2\nfile: b\n"
    back = spark.createDataFrame([(text,)], "t string").select(records.parse_record("t").alias("r")).first().r
    assert back.units == [{"unit": "1", "file": "a", "edit": "x\ny"}, {"unit": "2", "file": "b"}]
    line = spark.createDataFrame([("d", "r", "b", {"zz": "", "state": "open", "kind": "k"}), ("d", "r", "b", {})], "d string, r string, b string, f map<string,string>")
    got = [r.x for r in line.select(records.render_intake(F.col("d"), F.col("r"), F.col("b"), F.col("f")).alias("x")).collect()]
    assert got == ["- d `r` — b [kind=k state=open zz]", "- d `r` — b"]
    rec = spark.createDataFrame([(1, "a", "1-2", "s1", "f"), (2, "a", "3-3", "s1", "g")], "id int, file string, lines string, span string, fingerprint string")
    fresh = spark.createDataFrame([(1, "a", "1-2", "s1", "f"), (3, "a", "9-9", "s9", "h")], "id int, file string, lines string, span string, fingerprint string")
    assert {(r.id, r.problem) for r in records.identity_problems(rec, fresh).collect()} == {(2, "missing"), (3, "extra"), (2, "span used twice")}
    sizes = spark.createDataFrame([("a", k * 10, k * 10 + 5, 4) for k in range(1, 6)], "path string, sl int, el int, removed int")
    assert [(r.lo, r.hi) for r in records.cut_ranges(sizes, 10, 8).orderBy("lo").collect()] == [(10, 15), (20, 35), (40, 55)]


def test_set_verified(spark):
    texts = ["---\ntitle: a\nlast-verified-at: old\n---\nbody", "---\ntitle: a\n---\nbody", "body"]
    df = spark.createDataFrame([(t,) for t in texts], "t string").select(records.set_verified(F.col("t"), F.lit("new")).alias("t"))
    assert [r.t for r in df.collect()] == ["---\ntitle: a\nlast-verified-at: new\n---\nbody", "---\nlast-verified-at: new\ntitle: a\n---\nbody", "---\nlast-verified-at: new\n---\n\nbody"]


def test_gates(spark):
    raw = spark.createDataFrame([('{"REMOVED_LINE_CAP": "x", "FLOOR_STALENESS_THRESHOLD": 3, "odd": 1}',), (None,)], "r string")
    got = raw.select(gates.config(F.col("r"), F.lit(True)).alias("c"), gates.unknown_keys(F.col("r")).alias("u")).collect()
    assert got[0].c.REMOVED_LINE_CAP == 200 and got[0].c.FLOOR_STALENESS_THRESHOLD_DAYS == 3 and got[0].u == ["odd"] and got[1].u == []
    cases = spark.createDataFrame([("s", "1", "p", ["a", ""], ["../x"]), ("s", "1", "", None, [])], "skill string, id string, prompt string, assertions array<string>, files array<string>")
    assert {r.problem for r in gates.eval_problems(cases).collect()} == {"an empty assertion", "a file outside the skill", "no prompt", "no assertions", "id used twice"}
    assert gates.build_problems(spark.createDataFrame([("my-word", "d")], "name string, description string"), ("word",)).first().problem == "name holds a reserved word"


def test_text_rules(spark):
    df = spark.createDataFrame([("in the user manual, chapter 3",), ("in this document, chapter 3",), ("a manual. see",), ("in the guide",)], "b string")
    got = df.select(quality.names_other_document(F.col("b"), ("manual", "document", "guide"), F.array(F.lit("guide")), ("this",)).alias("x"))
    assert [r.x for r in got.collect()] == [True, False, False, False]
    v = spark.createDataFrame([("v 1.10 of", "1.9"), ("none", "2")], "a string, b string").select((quality.version_numbers(F.col("a")) > quality.version_numbers(F.col("b"))).alias("x"))
    assert [r.x for r in v.collect()] == [True, None]
    docs = spark.createDataFrame([(1, "see docs/a.md and x/docs/a.md\ndocs/a.md.bak docs/a.md")], "id int, t string")
    assert [(r.line, r.target) for r in identifiers.reference_occurrences(docs, "id", "t", ["docs/a.md"]).collect()] == [(1, "docs/a.md"), (2, "docs/a.md")]
    terms = spark.createDataFrame([(1, "Orbit"), (2, "shipping"), (3, "shipping")], "ord int, term string")
    assert [r.term for r in identifiers.frequent_terms(terms).collect()] == ["shipping"]
    assert {r.term for r in identifiers.distinct_terms(terms, spark.createDataFrame([(1, "ORBIT"), (2, "New")], "ord int, term string")).collect()} == {"Orbit", "shipping", "New"}
