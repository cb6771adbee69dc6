import email.message
import zipfile

import pandas as pd
import pytest
from pyspark.sql import functions as F

from quill.operators import graph, robots
from quill.sources import files
from quill.streaming import events as stream


def test_decode():
    assert files.decode("è".encode("utf-16")) == "è" and files.decode("ab".encode("utf-16-le") * 9) == "ab" * 9
    assert files.decode(b"\xef\xbb\xbfx") == "x" and files.decode("è".encode("cp1252")) == "è" and files.decode(b"\x81") == "\x81"


def _zip(path, parts):
    with zipfile.ZipFile(path, "w") as z:
        for name, text in parts.items():
            z.writestr(name, text)


def test_folder(spark, tmp_path):
    w = 'xmlns:w="http://schemas.openxmlformats.org/wordprocessingml/2006/main"'
    _zip(tmp_path / "a.docx", {"word/document.xml": f'<w:document {w}><w:body><w:p><w:pPr><w:pStyle w:val="Heading2"/></w:pPr><w:r><w:t>Title</w:t></w:r></w:p><w:p><w:r><w:t>body</w:t></w:r></w:p><w:tbl><w:tr><w:tc><w:p><w:r><w:t>x</w:t></w:r></w:p></w:tc><w:tc><w:p><w:r><w:t>y</w:t></w:r></w:p></w:tc></w:tr></w:tbl></w:body></w:document>'})
    s = 'xmlns="http://schemas.openxmlformats.org/spreadsheetml/2006/main"'
    _zip(tmp_path / "b.xlsx", {"xl/workbook.xml": f'<workbook {s}><sheets><sheet name="One"/></sheets></workbook>', "xl/sharedStrings.xml": f"<sst {s}><si><t>hi</t></si></sst>", "xl/worksheets/sheet1.xml": f'<worksheet {s}><sheetData><row><c r="A1" t="s"><v>0</v></c><c r="C1"><v>3</v></c></row><row/></sheetData></worksheet>'})
    a = 'xmlns:a="http://schemas.openxmlformats.org/drawingml/2006/main"'
    _zip(tmp_path / "c.pptx", {"ppt/slides/slide1.xml": f"<p {a}><a:p><a:r><a:t>Slide text</a:t></a:r></a:p></p>"})
    m = email.message.EmailMessage()
    m["From"], m["Subject"] = "a@b.c", "Hi"
    m.set_content("hello")
    m.add_attachment(b"att", maintype="text", subtype="plain", filename="n.txt")
    (tmp_path / "d.eml").write_bytes(bytes(m))
    (tmp_path / "e.bin").write_bytes(b"\0\1")
    (tmp_path / "f.docx").write_bytes(b"broken")
    (tmp_path / "g.txt").write_text(" ")
    (tmp_path / "h.pdf").write_bytes(b"%PDF")
    (tmp_path / "node_modules").mkdir()
    (tmp_path / "node_modules" / "x.js").write_text("no")
    got = {r.path.rsplit("/", 1)[1]: r for r in files.read_folder(spark, str(tmp_path)).collect()}
    assert got["a.docx"].text == "## Title\nbody\n| x | y |" and got["b.xlsx"].text == "# One\nhi\t\t3" and got["c.pptx"].text == "# Slide 1\nSlide text"
    assert "Subject: Hi" in got["d.eml"].text and got["d.eml!n.txt"].text == "att" and got["d.eml"].kind == "mail"
    assert {k: got[k].status for k in ("e.bin", "f.docx", "g.txt", "h.pdf")} == {"e.bin": "binary", "f.docx": "failed", "g.txt": "empty", "h.pdf": "unsupported"}
    assert "x.js" not in got


def test_append_pages(spark):
    old = spark.createDataFrame([("u1", "t1")], "url string, title string")
    new = spark.createDataFrame([("u1", "x", 1), ("u2", "b", 3), ("u2", "a", 2)], "url string, title string, ord int")
    assert sorted((r.url, r.title) for r in files.append_pages(old, new).collect()) == [("u1", "t1"), ("u2", "a")]


def test_reachable(spark):
    edges = spark.createDataFrame([("a", "b"), ("b", "c"), ("c", "a"), ("a", "c"), ("d", "e"), (None, "x"), ("c", None)], "src string, dst string")
    seeds = spark.createDataFrame([("a",)], "key string")
    assert sorted((r.key, r.depth) for r in graph.reachable(seeds, edges).collect()) == [("a", 0), ("b", 1), ("c", 1)]
    assert sorted(r.key for r in graph.reachable(seeds, edges, 0).collect()) == ["a"]


def test_robots(spark):
    text = "User-agent: *\nDisallow: /private\nAllow: /\nDisallow: /*.pdf$\nDisallow: /café\nDisallow:\nUser-agent: Bot/2\nDisallow: /bot\nCrawl-delay: 4\nCrawl-delay: x\nRequest-rate: 1/9"
    rules = robots.parse_rules(spark.createDataFrame([("h.com", text)], "host string, text string"))
    cases = {"http://h.com/private/a": False, "http://h.com/x.pdf": False, "http://h.com/x.pdf?v=2": True, "http://h.com/robots.txt": True, "http://h.com/caf%c3%a9/x": False, "http://other.com/private": True, "http://h.com": True}
    links = spark.createDataFrame([(u,) for u in cases], "url string")
    got = {r.url: r.allowed for r in robots.decide(links, robots.rules_for(rules, "any")).collect()}
    assert got == cases
    named = robots.rules_for(rules, "bot/9.9 (+http://x)")
    got = {r.url: r.allowed for r in robots.decide(links, named).collect()}
    assert all(got.values())
    p = robots.pace(named).first()
    assert (p.delay, p.requests, p.secs) == (4.0, 1, 9)


@pytest.mark.parametrize("kind", ["tumbling", "sessions", "blocks", "intake"])
def test_stream_equals_batch(spark, tmp_path, kind):
    if kind == "intake":
        rows = [("a", 1, "append", "q"), ("a", 2, "rule", ""), ("b", 3, "append", "obsolete-citation"), ("b", 4, "append", "obsolete-citation"), ("a", 5, "apply", ""), ("a", 6, "apply", ""), ("a", 7, "revert", "")]
        df, run = spark.createDataFrame(rows, "ident string, ord long, action string, kind string"), stream.intake_states
    else:
        df = spark.read.parquet("/root/testdata/sf0.001/events.parquet").withColumn("ts", F.col("ts").cast("timestamp"))
        run = {"tumbling": lambda d: stream.tumbling(d, "1 day"), "sessions": lambda d: stream.sessions(d, "6 hours"), "blocks": stream.failure_blocks}[kind]
    df.coalesce(1).write.parquet(str(tmp_path / "in"))
    source = spark.readStream.schema(df.schema).parquet(str(tmp_path / "in"))
    mode = "complete" if kind in ("tumbling", "sessions") else "append"
    q = run(source).writeStream.format("memory").queryName(f"s_{kind}").outputMode(mode).option("checkpointLocation", str(tmp_path / "c")).trigger(availableNow=True).start()
    q.awaitTermination(120)
    order = lambda d: d.toPandas().sort_values(sorted(d.columns)).reset_index(drop=True)[sorted(d.columns)]
    pd.testing.assert_frame_equal(order(spark.table(f"s_{kind}")), order(run(df)), check_dtype=False)
