"""Scans in levels, dictionary phrases, states along texts and cuts under caps, against plain loops."""

import random
from collections import defaultdict

import pytest
from pyspark.sql import functions as F

from quill.operators import cuts, fuzzy, graph, phrases, scans, states
from quill.plans import phrases as phrase_queries
from quill.staging import numbered, written


def test_running_over_pieces(spark):
    rng = random.Random(1)
    rows = [(k, i, rng.randint(-9, 9) if rng.random() < 0.8 else None) for k, n in (("a", 700), ("b", 3), ("c", 1)) for i in range(n)]
    df = spark.createDataFrame(rows, "k string, i long, v long").repartition(5)
    for own in (True, False):
        got = scans.running(df, ["k"], ["i"], F.col("i"), {"s": (F.sum, F.col("v")), "m": (F.max, F.col("v"))}, piece=16, own=own).collect()
        assert len(got) == len(rows)
        for r in got:
            upto = [v for k, i, v in rows if k == r.k and (i <= r.i if own else i < r.i) and v is not None]
            assert r.s == (sum(upto) if upto else None) and r.m == max(upto, default=None)


@pytest.mark.parametrize("fan", [2, 5, 64])
def test_automaton(spark, fan):
    rng = random.Random(fan)
    delta = [[rng.randrange(4) for _ in range(4)] for _ in range(6)]
    texts = {k: [rng.randrange(6) for _ in range(n)] for k, n in ((1, 1), (2, 130), (3, 64), (4, 65))}
    rows = [(k, i, s, f"{k}-{i}") for k, t in texts.items() for i, s in enumerate(t)]
    df = spark.createDataFrame(rows, "k int, i int, s int, tag string")
    got = {(r.k, r.i): (r.before, r.after, r.tag) for r in scans.automaton(df, "k", "i", "s", delta, keep=("tag",), start=2, fan=fan).collect()}
    want = {}
    for k, t in texts.items():
        q = 2
        for i, s in enumerate(t):
            want[k, i] = (q, delta[s][q], f"{k}-{i}")
            q = delta[s][q]
    assert got == want
    assert scans.automaton(df.filter("false"), "k", "i", "s", delta).collect() == []


def test_chain(spark):
    rng = random.Random(5)
    pointers = [(k, i, i + rng.randint(1, 4) if rng.random() < 0.97 else None) for k in range(3) for i in range(200)]
    at = {(k, i): t for k, i, t in pointers}
    want = set()
    for k in range(3):
        i = 0
        while i is not None and (k, i) in at | {(k, i): 0}:
            want.add((k, i))
            i = at.get((k, i))
    got = scans.chain(spark.createDataFrame([(k, 0) for k in range(3)], "k int, i int"), spark.createDataFrame(pointers, "k int, i int, t int"), "k", "i", "t")
    assert sorted(tuple(r) for r in got.collect()) == sorted(want)


def test_numbered(spark):
    rows = [(i * 7919 % 1000, "x") for i in range(1000)]
    got = numbered(spark.createDataFrame(rows, "v long, x string"), [F.col("v")], "n").collect()
    assert sorted(r.place for r in got) == list(range(1000)) and all(r.place == r.v for r in got)


def brute_phrases(text, dictionary):
    import re

    ws = re.findall(r"[^\W_]+", (text or "").lower())
    out, i = [], 0
    while i < len(ws):
        best = max((len(p) for p in dictionary if tuple(ws[i : i + len(p)]) == p), default=0)
        if best:
            out.append((i, best, dictionary[tuple(ws[i : i + best])]))
        i += best or 1
    return out


@pytest.mark.parametrize("seed", [1, 2, 3])
def test_phrase_matches(spark, seed, monkeypatch):
    monkeypatch.setattr(phrases, "CHUNK", 7)
    rng = random.Random(seed)
    words = ["the", "of", "and", "été", "x"]
    least = 1 if seed == 1 else 2
    listed = [(k, [rng.choice(words) for _ in range(rng.randint(least, 9))]) for k in range(40)] + [(99, []), (50, ["the", "of", "x"]), (7, ["the", "of", "x"])]
    dictionary = {}
    for k, p in sorted(listed, reverse=True):
        if p:
            dictionary[tuple(p)] = k
    texts = [None, "", "The, of; X!", "the " * 300] + [" ".join(rng.choice(words + ["zz"]) for _ in range(rng.randrange(120))) for _ in range(30)]
    df = spark.createDataFrame(list(enumerate(texts)), "id long, t string")
    got = phrases.phrase_matches(df, "id", "t", spark.createDataFrame(listed, "p long, w array<string>"), "p", "w").collect()
    want = [(k, *m) for k, t in enumerate(texts) for m in brute_phrases(t, dictionary)]
    assert sorted((r.id, r.pos, r.n_words, r.phrase) for r in got) == sorted(want) and want


def test_leftmost_across_pieces(spark):
    """Reading goes on rightly where pieces meet, in one text of long runs of overlapping matches."""
    rng = random.Random(8)
    rows, taken, end = [], [], 0
    for i in range(3000):
        if rng.random() < 0.6 and not 500 < i < 900:
            n = rng.randint(1, 9)
            rows.append((1, i, n))
            if i >= end:
                taken.append(i)
                end = i + n
    got = phrases.leftmost(spark.createDataFrame(rows, "id long, pos long, n_words int"), "id", 9, piece=32)
    assert sorted(r.pos for r in got.collect()) == taken
    assert phrases.phrase_matches(spark.createDataFrame([(1, "a b")], "id long, t string"), "id", "t", spark.createDataFrame([], "p long, w array<string>"), "p", "w").collect() == []


def brute_lines(text):
    import re

    fence, comment, heading, row, out = None, False, None, 0, []
    for n, line in enumerate(text.split("\n"), 1):
        s = line.strip(" \t\r\f")
        zone = "text"
        if comment:
            zone = "comment"
            comment = "-->" not in s
        elif fence:
            zone = "fence"
            if s.startswith(fence):
                fence = None
        elif m := re.match("(`{3,}|~{3,})", s):
            zone, fence = "fence", m.group(1)
        elif s.startswith("<!--") and "-->" not in s:
            zone, comment = "comment", True
        if zone == "text" and re.match("#{1,6}[ \t]", line):
            heading = n
        row = row + 1 if zone == "text" and "|" in line else 0
        out.append((n, zone, heading, row or None))
    return out


def test_line_states_with_one_text_of_half_of_all_lines(spark):
    rng = random.Random(4)
    some = ["plain", "", "# Head", "## b", "a | b", "|", "```", "````py", "  ~~~", "~~~~~", "<!-- x", "y -->", "<!-- z -->", "``` -->", "#no", "\t```"]
    make = lambda n: "\n".join(rng.choice(some) for _ in range(n))
    texts = [make(rng.randrange(1, 60)) for _ in range(150)]
    texts = ["", "```\nopen to the end\n| a", *texts, make(sum(t.count("\n") + 1 for t in texts))]
    rows = [*enumerate(texts), (None, "x"), (999, None)]
    got = states.line_states(spark.createDataFrame(rows, "id long, text string").repartition(4), "id", "text").filter("id is not null").collect()
    want = [(k, *r) for k, t in enumerate(texts) for r in brute_lines(t)]
    assert sorted(tuple(r) for r in got) == sorted(want)
    assert {r.zone for r in got} == {"text", "fence", "comment"}


def test_piece_states(spark):
    page = "<h1>A</h1> x <!-- b <i>hidden</i> --><SCRIPT>if (a < b) '<h2>'</script>text<style>p{}</style><h2>B</h2>1<2 <!-- c -->"
    got = sorted(tuple(r) for r in states.piece_states(spark.createDataFrame([(1, page)], "id int, html string"), "id", "html").collect())
    zones = [r[2] for r in got]
    assert zones[:4] == ["text"] * 4 and zones[4:8] == ["comment"] * 4
    assert {"script", "style"} <= set(zones)
    assert sum(r[4] for r in got if r[3] == 0) == len("A") + len("x") + len("text")
    assert [r[4] for r in got if r[4] == 4] == [4]


def brute_parts(weights, caps):
    out, sums, part = [], None, -1
    for w in weights:
        if sums is None or any(s + x > c for s, x, c in zip(sums, w, caps, strict=True)):
            part, sums = part + 1, list(w)
        else:
            sums = [s + x for s, x in zip(sums, w, strict=True)]
        out.append(part)
    return out


def test_greedy_parts(spark):
    rng = random.Random(6)
    groups = {k: [(rng.choice([0, 1, 1, 2, 30]), rng.randint(0, 9)) for _ in range(n)] for k, n in (("a", 400), ("b", 1), ("c", 37))}
    rows = [(k, i, *w) for k, ws in groups.items() for i, w in enumerate(ws)]
    got = cuts.greedy_parts(spark.createDataFrame(rows, "k string, i long, a long, b int"), "k", "i", {"a": 10, "b": 25}).collect()
    want = {(k, i): p for k, ws in groups.items() for i, p in enumerate(brute_parts(ws, (10, 25)))}
    assert {(r.k, r.i): r.part for r in got} == want


def brute_cuts(units, pairs, caps):
    """units: (sl, el, n) by sl; ranges (part, lo, hi, n_units) by the definition, one unit at a time."""
    reach, blocks = 0, []
    for sl, el, n in units:
        cut = reach + 1
        if blocks and (cut > sl or any(lo < cut <= hi for lo, hi in pairs)):
            blocks[-1].append((sl, el, n))
        else:
            blocks.append([(sl, el, n)])
        reach = max(reach, el)
    blocks.reverse()
    parts = brute_parts([(len(b), sum(u[2] for u in b)) for b in blocks], caps)
    out = []
    for p in range(parts[-1] + 1):
        mine = [u for b, q in zip(blocks, parts, strict=True) if q == p for u in b]
        out.append([p, 1, max(u[1] for u in mine), len(mine)])
    for lower, upper in zip(out, out[1:], strict=False):
        lower[1] = upper[2] + 1
    return [tuple(r) for r in out]


def test_cut_files(spark):
    rng = random.Random(12)
    files, spans = {}, {}
    for f in ("a", "b", "c", "d"):
        at, us = 1, []
        for _ in range(90):
            size = rng.choice([1, 1, 1, 3])
            us.append((at, at + size - 1 + rng.choice([0, 0, 0, 2]), rng.randint(0, 6)))
            at += size + rng.choice([0, 0, 1])
        files[f] = us
        spans[f] = [tuple(sorted((rng.choice(us)[0], rng.choice(us)[1]))) for _ in range(0 if f == "a" else 4)]
    spans["d"].append((1, 10_000))
    u = spark.createDataFrame([(f, *r, 1) for f, us in files.items() for r in us], "f string, sl long, el long, n long, one long")
    p = spark.createDataFrame([(f, *s) for f, ss in spans.items() for s in ss], "f string, lo long, hi long")
    got = cuts.cut_files(u, p, "f", {"one": 7, "n": 15}).collect()
    want = [(f, *r) for f, us in files.items() for r in brute_cuts(us, spans[f], (7, 15))]
    assert sorted((r.f, r.part, r.lo, r.hi, r.n_units) for r in got) == sorted(want)


def test_cut_rows(spark):
    rng = random.Random(13)
    files, rows = {}, []
    for f in range(40):
        ats = sorted(rng.sample(range(1, 200), rng.choice([0, 1, 2, 30, 90])))
        files[f] = [(at, rng.choice(["a", "b", "", None]) if rng.random() < 0.1 else f"{f} {at}", rng.choice([0, 1, 3, 40])) for at in ats]
        rows.append((f, [(at, kind, n, 1, "x") for at, kind, n in files[f]]))
    rows += [(None, rows[3][1]), (99, None)]
    df = spark.createDataFrame(rows, "f int, u array<struct<sl: int, kind: string, n: long, one: int, other: string>>").repartition(3)
    got = cuts.cut_rows(df, "f", "u", {"one": 7, "n": 15}).collect()
    want = []
    for f, us in files.items():
        pairs = {k: (min(a for a, q, _ in us if q == k), max(a for a, q, _ in us if q == k)) for _, k, _ in us}
        want += [(f, *r) for r in (brute_cuts([(a, a, n) for a, _, n in us], pairs.values(), (7, 15)) if us else [])]
    assert sorted((r.f, r.part, r.lo, r.hi, r.n_units) for r in got) == sorted(want)
    assert {f: sum(r.n for r in got if r.f == f) for f in files} == {f: sum(n for _, _, n in us) for f, us in files.items()}


def test_cut_ranges_shuffles_no_lines_of_ordinary_documents(spark, tmp_path, monkeypatch):
    rng = random.Random(14)
    texts = [None, "", "\n \n", "one"] + ["\n".join(rng.choice(["a", "A ", " ", "b\tc", "x" * 200, f"{rng.random()}"]) for _ in range(rng.choice([3, 40, 120]))) for _ in range(30)]
    spark.createDataFrame([*enumerate(texts), (None, "a\nb")], "doc_id long, text string").write.parquet(f"{tmp_path}/documents.parquet")
    monkeypatch.setattr(phrase_queries, "LONG_TEXT", 900, raising=False)
    both = sorted(map(tuple, phrase_queries.cut_ranges(spark, str(tmp_path)).collect()))
    monkeypatch.setattr(phrase_queries, "LONG_TEXT", 1 << 22, raising=False)
    for module in (phrase_queries, cuts):
        monkeypatch.setattr(module, "written", None)
    assert sorted(map(tuple, phrase_queries.cut_ranges(spark, str(tmp_path)).collect())) == both and len({r[0] for r in both}) > 20


def test_written_needs_a_shared_folder_on_a_cluster(spark):
    assert written(spark.range(3), "x").count() == 3


@pytest.mark.parametrize(("max_pages", "max_depth"), [(None, None), (40, None), (None, 3), (25, 2), (0, None)])
def test_visit_order_is_that_of_a_queue(spark, max_pages, max_depth):
    rng = random.Random(3)
    links = [(f"n{rng.randrange(120)}", k, f"n{rng.randrange(150)}") for k in range(260)] + [(None, 1, "n1"), ("n1", 2, None)]
    seeds = ["n5", "n77", "n5", None, "n9"]
    of = {}
    for src, k, dst in links:
        if src and dst:
            of.setdefault(src, []).append((k, dst))
    queue, seen, visits = [], set(), []
    for s in seeds:
        if s and s not in seen:
            seen.add(s)
            queue.append((s, 0))
    while queue and (max_pages is None or len(visits) < max_pages):
        page, depth = queue.pop(0)
        visits.append((page, depth))
        for _, dst in sorted(of.get(page, [])):
            if dst not in seen and (max_depth is None or depth < max_depth):
                seen.add(dst)
                queue.append((dst, depth + 1))
    got = graph.visit_order(spark.createDataFrame([(s, k) for k, s in enumerate(seeds)], "key string, ord int"), spark.createDataFrame(links, "src string, ord int, dst string"), max_pages, max_depth)
    assert [(r.key, r.depth, r.place) for r in sorted(got.collect(), key=lambda r: r.place)] == [(p, d, k) for k, (p, d) in enumerate(visits)]


def test_only_runs_behind_repeated_pairs_become_rows(spark):
    rng = random.Random(12)
    rows = [(k % 40 or None, k % 3, [rng.choice("abcdef") for _ in range(rng.randrange(0, 30))]) for k in range(300)]  # several rows and null keys to a turn
    df = spark.createDataFrame([*rows, (1, 1, None)], "c long, t long, w array<string>").repartition(3)
    found = fuzzy.repeated_windows(df, ["c", "t"], "w")
    plan = found._jdf.queryExecution().executedPlan().toString()
    assert plan.count("Exchange hashpartitioning") == 1  # turns are brought together, their runs aren't shuffled any more
    want = defaultdict(list)
    for c, t, w in rows:
        for n in range(2, 6):
            for i in range(len(w) - n + 1):
                want[c, t, " ".join(w[i : i + n])].append(i)
    assert {(r.c, r.t, r.words): (list(r.places), r.width) for r in found.collect()} == {k: (sorted(v), k[2].count(" ") + 1) for k, v in want.items() if len(v) > 1}


def test_places_are_sifted_by_numbers(spark):
    rng = random.Random(13)
    rows = [(k, None if k == 3 else " ".join(rng.choice("abcd") for _ in range(rng.randrange(0, 40)))) for k in range(60)]
    df = spark.createDataFrame(rows, "k long, text string").repartition(3)
    for least in (1, 3):
        nodes = [" ".join(rng.choice("abcd") for _ in range(least)) for _ in range(2)]
        begins = spark.createDataFrame([(n.split(),) for n in nodes], "w array<string>").select(F.xxhash64(*(F.get("w", F.lit(i)) for i in range(least))).alias("__h")).distinct()
        sifted = phrases.sifted_places(df, "k", "text", begins, least, 5)
        plan = sifted._jdf.queryExecution().optimizedPlan().toString()
        assert "posexplode(transform(slice(" in plan and "xxhash64" in plan.split("posexplode")[1]  # numbers leave the rows to be sifted, not words
        want = {(k, i, " ".join(w[i : i + 5]), len(w[i : i + 5])) for k, w in ((k, (t or "").split()) for k, t in rows) for i in range(len(w) - least + 1) if " ".join(w[i : i + least]) in nodes}
        got = [tuple(r) for r in sifted.collect()]
        assert set(got) == want and len(got) == len(want)
