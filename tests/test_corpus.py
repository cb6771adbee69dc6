import random

import pytest
from pyspark.sql import functions as F

from quill.functions import languages
from quill.operators import corpus, transcripts

DOCS = "/root/testdata/sf0.001/documents.parquet"


def test_lines_keep_their_ends(spark):
    rng = random.Random(1)
    texts = ["", "a", "a\n", "\n", "\r\n", "a\r\nb\n\nc\r", "é\r\r\n", *("".join(rng.choice(["a", "\n", "\r\n", "\r", "é"]) for _ in range(12)) for _ in range(100))]
    df = spark.createDataFrame([(i, t) for i, t in enumerate(texts)], "k int, t string").withColumn("l", corpus.lines_with_ends(F.col("t")))
    for r in df.select("k", "t", "l", corpus.joined_lines(F.col("l")).alias("back")).collect():
        want = [(p[:-2], "\r\n") if p.endswith("\r\n") else (p[:-1], "\n") if p.endswith("\n") else (p, "") for p in r.t.split("\n") and _kept(r.t)]
        assert [tuple(x) for x in r.l] == want and r.back == r.t


def _kept(text):
    parts = text.split("\n")
    return [p + "\n" for p in parts[:-1]] + [p for p in parts[-1:] if p]


def test_pieces_of_the_jvm_equal_the_batch_form(spark):
    rng = random.Random(2)
    texts = [r.text for r in spark.read.parquet(DOCS).select("text").collect()] + [None, "", "  ", "x" * 1500, "One. " * 300, " ".join("w" * rng.randint(1, 90) for _ in range(200))]
    df = spark.createDataFrame([(i, t) for i, t in enumerate(texts)], "k int, t string")
    for limit in (700, 60):
        got = {r.k: r.p for r in df.select("k", transcripts.split_text("t", limit).alias("p")).collect()}
        assert got == {i: transcripts.sentences(t or "", limit) for i, t in enumerate(texts)}
        assert all(len(p) <= limit for ps in got.values() for p in ps)


def test_directives_of_columns_and_batches_agree(spark):
    said = [" noqa", "* @ts-ignore", "\n * eslint-disable\n ", " Copyright 2020 X ", "!/ NOLINT", " plain words", "", " (c) 2021 Y", "* a\n * Licensed under\n * the MIT license", " type: ignore", "#region x"]
    df = spark.createDataFrame([(i, t) for i, t in enumerate(said)], "k int, t string")
    got = {r.k: r.d or "" for r in df.select("k", languages.directive(F.col("t")).alias("d")).collect()}
    assert [got[i] for i in range(len(said))] == languages.directives(said)
    assert languages.directives(said)[:6] == ["tool", "tool", "tool", "license", "tool", ""]


def test_index_and_notes(spark, tmp_path):
    sources = spark.createDataFrame([("S1", "Repo", "git", 2, ["odd"], ["main.py"] * 90), ("S2", "None", "-", 0, [], [])], "id string, label string, origin string, redactions int, warnings array<string>, entry_points array<string>")
    files = spark.createDataFrame([("S1", "b.py", "code", 1200, "ok", []), ("S1", "a.md", "text", 34, "ok", ["w"]), ("S1", "c.bin", "text", 0, "skipped", [])], "id string, path string, kind string, chars long, status string, warnings array<string>")
    got = {r.id: r for r in corpus.index_rows(sources, files).collect()}
    assert got["S1"].line == "| S1 | Repo | `git` | code 1, text 2 | 1,234 | 2 | 3 |"
    assert got["S2"].line == "| S2 | None | `-` | - | 0 | 0 | 0 |"
    notes = [(r.id, r.part, r.line) for r in corpus.index_notes(sources, files).orderBy("id", "part", "ord").collect()]
    assert len([n for n in notes if n[1] == 1]) == 80
    assert [n[2] for n in notes if n[1] == 2] == ["- odd", "- `a.md` (ok): w", "- `c.bin` (skipped): "]
    corpus.write_manifest(sources, files, str(tmp_path / "m"))
    assert [[f.path for f in r.files or []] for r in spark.read.json(str(tmp_path / "m")).orderBy("id").collect()] == [["a.md", "b.py", "c.bin"], []]


def test_pages_with_coverage(spark, tmp_path):
    pages = spark.createDataFrame([("u", "t")], "url string, title string")
    corpus.write_pages(pages, str(tmp_path / "a"), ["z.com", "a.com", "a.com"], ["u2"])
    got, blocked, excluded = corpus.read_pages(spark, str(tmp_path / "a"), "url string, title string")
    assert ([tuple(r) for r in got.collect()], blocked, excluded) == ([("u", "t")], ["a.com", "z.com"], ["u2"])
    pages.write.json(str(tmp_path / "b/pages"))
    assert corpus.read_pages(spark, str(tmp_path / "b"), "url string, title string")[1:] == ([], [])
    (tmp_path / "b/coverage").mkdir()
    (tmp_path / "b/coverage/part.json").write_text('{"blocked_domains": "oops", "robots_excluded": []}')
    assert corpus.read_pages(spark, str(tmp_path / "b"), "url string, title string")[1:] == ([], [])


def test_points_in_spans(spark):
    rng = random.Random(3)
    spans = [(rng.choice("ab"), lo := rng.randint(0, 80), lo + rng.randint(1, 15)) for _ in range(12)]
    points = [(rng.choice("abc"), rng.randint(0, 100), k) for k in range(200)]
    got = {r.n: r.inside for r in corpus.in_spans(spark.createDataFrame(points, "f string, offset int, n int"), spark.createDataFrame(spans, "f string, lo int, hi int"), "f").collect()}
    assert got == {n: any(f == g and lo <= o < hi for g, lo, hi in spans) for f, o, n in points}


def test_small_helpers(spark):
    lines = spark.createDataFrame([(1, "# tool: graph 1"), (2, "./a\\b.py\tx\ty"), (3, ""), (4, "c.py")], "ord int, line string")
    meta, rows = corpus.provider_rows(lines)
    assert [tuple(r) for r in meta.collect()] == [(1, "tool", "graph 1")]
    assert [tuple(r) for r in rows.orderBy("ord").collect()] == [(2, "a/b.py", ["x", "y"]), (4, "c.py", [])]
    commits = spark.createDataFrame([("r", 2, "b" * 40, []), ("r", 1, "a1234567" + "0" * 32, []), ("r", 0, "c" * 40, ["x"])], "repo string, ord int, sha string, parents array<string>")
    assert [tuple(r) for r in corpus.repository_identity(commits).collect()] == [("r", "a1234567")]
    paths = spark.createDataFrame([("out/x",), ("out",), ("output/x",)], "p string").select(corpus.is_output(F.col("p"), ["out/"]).alias("o"))
    assert [r.o for r in paths.collect()] == [True, True, False]
    ids = lambda rows: spark.createDataFrame(rows, "file string, id int, fp string")
    refs = spark.createDataFrame([("f", 1, 2), ("f", 2, 3)], "file string, id int, target int")
    got = corpus.remapped_references(refs, ids([("f", 1, "x"), ("f", 2, "y"), ("f", 3, "z")]), ids([("f", 7, "y"), ("f", 8, "x")]))
    assert [tuple(r) for r in got.collect()] == [("f", 8, 7)]


@pytest.mark.parametrize(("facts", "want"), [({}, "still true"), ({"stale": True, "gone": True}, "obsolete"), ({"ruled": None, "stale": True}, "stale fragment → strip")])
def test_decision_list(spark, facts, want):
    row = F.struct(*(F.lit(facts.get(f)).cast("boolean").alias(f) for f, _ in corpus.DISPOSITIONS))
    assert spark.range(1).select(corpus.suggested_disposition(row).alias("d")).first().d == want
