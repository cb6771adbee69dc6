"""Vector codes, shards along the curve and fill-in-the-middle against plain versions."""

import hashlib
import itertools
import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from quill.llm import fill_middle, hilbert, vector_codes
from quill.llm.common import shared_path, written


# ---------------------------------------------------------------- vector codes
@pytest.mark.parametrize("reach", [3, 300, 1 << 24, 1 << 28])
@pytest.mark.parametrize("width", [1, 4, 33])
def test_nearest_is_exact(reach, width):
    rng = np.random.default_rng(reach + width)
    c = rng.integers(-reach, reach + 1, (40, width))
    c[7], c[20] = c[3], c[3]
    far = c[9] + 2 * (c[3] - c[9])  # c[3] lies in the middle
    x = np.concatenate([rng.integers(-reach, reach + 1, (500, width)), c, c + 1, c - 1, [far], (c[:20] + c[20:]) // 2])
    at, error = vector_codes.nearest(x, c)
    whole = ((x[:, None, :].astype(object) - c[None].astype(object)) ** 2).sum(2)
    assert at.tolist() == [min(range(40), key=lambda k: (row[k], k)) for row in whole.tolist()]
    assert error.tolist() == whole.min(1).tolist()


def test_screening_needs_the_bound():
    """Entries that float32 can't tell apart are told apart in int64."""
    big = 1 << 26
    c = np.array([[big + 1, 0], [big, 1], [big, 0]], np.int64)
    x = np.array([[big, 0], [big + 1, 1], [big + 1, 0]], np.int64)
    at, error = vector_codes.nearest(x, c)
    assert at.tolist() == [2, 0, 0] and error.tolist() == [0, 1, 0]


def brute_codes(rows, parts, entries, rounds):
    """rows: (id, vector); codes, errors and codebooks by plain integers."""
    order = sorted(rows, key=lambda r: (r[0] is None, r[0] or 0, r[1]))[:entries]
    wide = len(rows[0][1]) // parts
    cut = lambda v, p: v[p * wide : (p + 1) * wide]
    books = [[list(cut(v, p)) for _, v in order] for p in range(parts)]
    far = lambda a, b: sum((x - y) ** 2 for x, y in zip(a, b, strict=True))
    assign = lambda v, p: min(range(len(books[p])), key=lambda k: (far(cut(v, p), books[p][k]), k))
    for _ in range(rounds):
        for p in range(parts):
            groups = {}
            for _, v in rows:
                groups.setdefault(assign(v, p), []).append(cut(v, p))
            for k, g in groups.items():
                books[p][k] = [sum(c) // len(g) for c in zip(*g, strict=True)]
    codes = [[assign(v, p) for p in range(parts)] for _, v in rows]
    return codes, [sum(far(cut(v, p), books[p][k]) for p, k in enumerate(c)) for (_, v), c in zip(rows, codes, strict=True)], books


def test_compress(spark):
    rng = random.Random(2)
    rows = [(rng.randrange(40) if k % 9 else None, [rng.randint(-50, 50) for _ in range(6)], k) for k in range(120)] + [(k, [1] * 6, k) for k in range(200, 240)]
    df = spark.createDataFrame([(*r, "x", k) for k, r in enumerate(rows)], "vec_id long, v array<int>, n int, code string, `a.b` int")
    df = df.unionByName(spark.sql("SELECT 1L vec_id, CAST(NULL AS array<int>) v, 0 n, '' code, 0 `a.b`"))
    got = vector_codes.compress(df, F.col("v"), ["n", "code", "a.b"], parts=3, entries=7, rounds=2)
    codes, errors, books = brute_codes([r[:2] for r in rows], 3, 7, 2)
    assert got.books.tolist() == books
    assert got.rows.columns == ["n", "code", "a.b", "_code", "error"]
    out = {r["a.b"]: (list(r["_code"]), r["error"]) for r in got.rows.collect()}
    assert out == {k: (c, e) for k, (c, e) in enumerate(zip(codes, errors, strict=True))}
    assert got.digest() == hashlib.sha256(",".join(str(x) for p in books for e in p for x in e).encode()).hexdigest()
    back = vector_codes.restore(got.rows, got.books, "_code").collect()
    assert all(r.vector == [x for p, k in enumerate(r["_code"]) for x in books[p][k]] for r in back)


def test_compress_edges(spark):
    make = lambda vs: spark.createDataFrame([(k, v) for k, v in enumerate(vs)], "vec_id long, v array<long>")
    none = vector_codes.compress(make([]), F.col("v"), ["vec_id"], parts=4)
    assert none.rows.collect() == [] and none.digest() == hashlib.sha256(b"").hexdigest()
    flat = vector_codes.compress(make([[], [], None]), F.col("v"), ["vec_id"], parts=4)
    assert [(bytes(r.code), r.error) for r in flat.rows.collect()] == [(b"\0" * 4, 0)] * 2
    one = vector_codes.compress(make([[-7, 5]]), F.col("v"), ["vec_id"], parts=2)
    assert [(bytes(r.code), r.error) for r in one.rows.collect()] == [(b"\0\0", 0)]
    for bad in ([[1, 2], [1]], [[1, 2, 3]], [[1 << 40, 0]]):
        with pytest.raises(ValueError):
            vector_codes.compress(make(bad), F.col("v"), ["vec_id"], parts=2)
    wide = vector_codes.compress(make([[k] for k in range(300)]), F.col("v"), ["vec_id"], parts=1, entries=300, rounds=1)
    assert sorted((r.vec_id, bytes(r.code)) for r in wide.rows.collect()) == [(k, k.to_bytes(2, "little")) for k in range(300)]


def test_with_total(spark):
    rows = [(k, None if k % 3 == 0 else (5 if k % 3 == 1 else k), k) for k in range(3000)]
    got = vector_codes.with_total(written(spark.createDataFrame(rows, "id long, label int, error long"), "t"), "label", "error", "total").collect()
    want = {}
    for _, label, error in rows:
        want[label] = want.get(label, 0) + error
    assert sorted((r.id, r.total) for r in got) == [(k, want[label]) for k, label, _ in rows]
    none = written(spark.createDataFrame([], "id long, label int, error long"), "t")
    assert vector_codes.with_total(none, "label", "error", "total").collect() == []


# ---------------------------------------------------------------- shards
@pytest.mark.parametrize("dims, bits", [(2, 4), (3, 3), (4, 2), (5, 2)])
def test_curve_visits_neighbours(spark, dims, bits):
    cells = spark.createDataFrame(list(itertools.product(range(1 << bits), repeat=dims)), ", ".join(f"c{k} int" for k in range(dims)))
    got = cells.withColumn("at", hilbert.curve_index([F.col(c) for c in cells.columns], bits)).collect()
    order = [r[:dims] for r in sorted(got, key=lambda r: r["at"])]
    assert sorted(r["at"] for r in got) == list(range(1 << (dims * bits)))
    assert all(sum(abs(x - y) for x, y in zip(a, b, strict=True)) == 1 for a, b in itertools.pairwise(order))


def test_bins_are_shares_of_smaller_rows(spark):
    rng = random.Random(1)
    values = [None] * 30 + ["hot"] * 200 + [f"https://x/{rng.randrange(90)}" for _ in range(300)]
    df = spark.createDataFrame([(v,) for v in values], "v string")
    got = df.withColumn("bin", hilbert.bin_of(F.col("v"), hilbert.cut_points(df, F.col("v"), 16))).collect()
    below = lambda v: sum(1 for x in values if (x or "") < (v or ""))
    assert all(r.bin == below(r.v) * 16 // len(values) for r in got)
    assert hilbert.cut_points(df.filter("false"), F.col("v"), 16) == []


def laws(rows, n, shards):
    by = {}
    for r in rows:
        by.setdefault(r["shard"], []).append(r["slot"])
    assert all(sorted(s) == list(range(len(s))) for s in by.values())
    sizes = [len(by.get(k, [])) for k in range(shards)]
    assert sum(sizes) == n and max(sizes) - min(sizes) <= 1


@pytest.mark.parametrize("n", [0, 1, 7, 39, 41, 1000])
def test_shards(spark, n):
    rng = random.Random(n)
    rows = [(None if k % 11 == 0 else k // 2, "hot" if k % 3 else None, rng.randrange(5) * 1.5, "x", k) for k in range(n)]
    df = spark.createDataFrame(rows, "doc_id long, source string, score double, SHARD string, `a.b` int")
    out = hilbert.shard(df, {"source": F.col("source"), "score": F.col("score")}, shards=40, bits=3, ties=[F.col("doc_id")])
    assert out.columns == ["doc_id", "source", "score", "a.b", "curve", "shard", "slot"]
    got = out.collect()
    laws(got, n, 40)
    assert sorted(r["a.b"] for r in got) == list(range(n))
    order = [(r["curve"], r["doc_id"] is not None, r["doc_id"] or 0) for r in sorted(got, key=lambda r: (r["shard"], r["slot"]))]
    assert order == sorted(order)


def test_equal_rows_and_long_texts(spark):
    rows = [(1, "same", 5)] * 400 + [(2, "long " * 400_000, 5)]
    df = spark.createDataFrame(rows, "doc_id long, text string, n int")
    got = hilbert.shard(df, {"n": F.col("n")}, shards=7, bits=2).select("doc_id", "shard", "slot").collect()
    laws(got, 401, 7)


def test_files_are_pruned(spark):
    rng = random.Random(9)
    rows = [(k, f"src{min(rng.randrange(30), 19)}", rng.choice("abcd"), int(rng.lognormvariate(5, 2))) for k in range(4000)]
    df = spark.createDataFrame(rows, "doc_id long, source string, lang string, n int")
    dims = {c: F.col(c) for c in ("source", "lang", "n")}
    path = shared_path(spark, "shards")
    manifest = hilbert.write_shards(df, dims, path, shards=64, bits=4)
    assert manifest.agg(F.sum("n_rows")).first()[0] == 4000
    for box in ({"source": ("src3", "src3")}, {"lang": ("b", "b"), "n": (0, 50)}, {"n": (400, 500)}):
        got, read = hilbert.read_box(spark, path, dims, box)
        want = [r[0] for r in rows if all(lo <= dict(zip(("source", "lang", "n"), r[1:], strict=True))[d] <= hi for d, (lo, hi) in box.items())]
        assert sorted(r.doc_id for r in got.select("doc_id").collect()) == want
        assert 0 < len(read) < 45  # of 64: each of three dimensions prunes


# ---------------------------------------------------------------- fill in the middle
def brute_middle(doc_id, text, unit="code point"):
    text = text or ""
    s = hashlib.sha256(f"1:{'' if doc_id is None else doc_id}".encode()).hexdigest()
    h = [int(s[8 * k : 8 * k + 8], 16) for k in range(4)]
    if unit == "code point":
        units = list(text)
    else:
        import re

        units = re.findall(r"[\x20\x09-\x0D]*[^\x20\x09-\x0D]+|[\x20\x09-\x0D]+", text)
    n = len(units)
    a, b = sorted((h[0] % (n + 1), h[1] % (n + 1)))
    if not text or any(m in text for m in ("<P>", "<S>", "<M>")) or h[2] % 100 >= 90:
        return n, "plain", None, None, text
    p, m, x = "".join(units[:a]), "".join(units[a:b]), "".join(units[b:])
    if h[3] % 100 < 20:
        return n, "spm", a, b - a, f"<S>{x}<P>{p}<M>{m}"
    return n, "psm", a, b - a, f"<P>{p}<S>{x}<M>{m}"


@pytest.mark.parametrize("unit", ["code point", "word"])
def test_fill_middle(spark, unit):
    rng = random.Random(3)
    letters = ["a", "é", "漢", "😀", " ", "\n", "\t", "<", ">", "P", "S", "M", "\x00", "\x85", " "]
    texts = [None, "", "<P>", "<P", "<", " ", "😀", "x" * 3_000_000, "漢 " * 400_000] + ["".join(rng.choice(letters) for _ in range(rng.randrange(60))) for _ in range(600)]
    rows = [(None if k % 50 == 49 else k - 40, t, k, "own") for k, t in enumerate(texts)]
    df = spark.createDataFrame(rows, "doc_id long, text string, `a.b` int, FIM_FORM string").repartition(3)
    out = fill_middle.restore(fill_middle.transform(df, unit=unit))
    assert out.columns == ["doc_id", "a.b", "fim_units", "fim_form", "fim_prefix", "fim_middle", "fim_text", "restored"]
    got = {r["a.b"]: tuple(r)[2:] for r in out.collect()}
    assert len(got) == len(rows)
    for doc_id, text, k, _ in rows:
        assert got[k] == (*brute_middle(doc_id, text, unit), text or ""), text
    forms = [v[1] for v in got.values()]
    assert {"plain", "psm", "spm"} == set(forms)


def test_fill_middle_edges(spark):
    assert fill_middle.restore(fill_middle.transform(spark.createDataFrame([], "doc_id long, text string"))).collect() == []
    with pytest.raises(ValueError):
        fill_middle.transform(spark.createDataFrame([], "doc_id long, text string"), unit="byte")
    assert len(fill_middle.restore(spark.createDataFrame([(None, None), (None, "plain")], "fim_text string, fim_form string")).collect()) == 2
    with pytest.raises(ValueError):
        fill_middle.uncut(np.frombuffer(b"<P><S>", np.uint8), np.array([0, 6]), np.array([1]))
