import itertools
import math
import random
import re
from collections import Counter, defaultdict

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from quill.llm import language_id as li
from quill.llm import mixing, packing, quality, vector_topk

SF = "/root/testdata/sf0.01"


def docs(spark):
    return spark.read.parquet(f"{SF}/documents.parquet")


# --- top-k -------------------------------------------------------------------------------


def test_top_k_against_brute_force(spark):
    rng = random.Random(1)
    rows = [(i, [rng.choice([0, 0, 1, -2, 3]) for _ in range(rng.choice([6, 6, 4]))]) for i in range(300)]
    rows += [(1000, []), (1001, None), (None, [1, 1]), (7, [9, 9]), (7, [9, 9])]
    df = spark.createDataFrame([(*r, "x") for r in rows], "vec_id long, e array<long>, score string")
    got = defaultdict(list)
    for r in vector_topk.top_k(df, F.col("e"), F.col("vec_id") % 10 == 0, k=4, query_block=7, row_block=50).orderBy("query_id", "rank").collect():
        got[r.query_id].append((r.vec_id, r.score))
    live = [r for r in rows if r[0] is not None and r[1] is not None]
    for q, w in live:
        if q % 10 == 0:
            want = sorted(((i, sum(a * b for a, b in zip(w, v, strict=False))) for i, v in live if i != q), key=lambda x: (-x[1], x[0]))[:4]
            assert got.pop(q) == want
    assert not got
    assert vector_topk.top_k(df.limit(0), F.col("e"), F.lit(True)).count() == 0
    assert vector_topk.top_k(df.filter("vec_id = 20"), F.col("e"), F.lit(True)).count() == 0


# --- language ------------------------------------------------------------------------------


def test_language_held_out_accuracy(spark):
    out = li.identify(docs(spark)).join(docs(spark).select("doc_id", "lang"), "doc_id").filter("held_out").collect()
    assert len(out) > 100
    assert sum(r.lang == r.lang_pred for r in out) / len(out) > 0.97
    assert all(0 <= r.score <= 1 for r in out)


def test_language_scores_against_plain_counts(spark):
    texts = [("aa bb", "x"), ("ab ab ab", "x"), ("cc dd", "y"), ("éé dé", "y")]
    df = spark.createDataFrame([(i, t, k) for i, (t, k) in enumerate(texts)], "doc_id long, text string, lang string")
    langs, logp = li.train(df)
    assert langs == ["x", "y"]
    count = defaultdict(Counter)
    for t, k in texts:
        idx, _, _ = li.grams([t])
        count[k].update(int(b) for b in idx.ravel() if b < li.BUCKETS)
    idx, _, _ = li.grams(["ad é"])
    total = [sum(math.log((count[k][int(b)] + 0.5) / (sum(count[k].values()) + 0.5 * li.BUCKETS)) for b in idx.ravel() if b < li.BUCKETS) for k in langs]
    got = li.predict(spark.createDataFrame([(1, "ad é")], "doc_id long, text string"), langs, logp).first()
    best = max(total)
    assert got.lang_pred == langs[total.index(best)]
    assert got.score == pytest.approx(1 / sum(math.exp(t - best) for t in total), rel=1e-4)


def test_language_edges(spark):
    rows = [(1, None, "x", 0), (2, "", "x", 0), (3, "12 !", None, 0), (4, "abc", "x", 0), (None, "def", "y", 0), (7, "z" * 500_000, None, 0)]
    out = {r.doc_id: r for r in li.identify(spark.createDataFrame(rows, "doc_id long, text string, lang string, score int")).collect()}
    assert [out[k].lang_pred for k in (1, 2, 3)] == ["und"] * 3
    assert out[7].lang_pred == "x" and len(out) == 6
    none = li.identify(spark.createDataFrame([(1, "abc", None)], "doc_id long, text string, lang string")).first()
    assert (none.lang_pred, none.score) == ("und", 0.0)
    assert li.identify(spark.createDataFrame([], "doc_id long, text string, lang string")).count() == 0


# --- quality -------------------------------------------------------------------------------


def plain_features(text):
    words = re.findall(rb"[^\x20\x09-\x0D]+", (text or "").encode())
    return words, list(zip(words[:-1], words[1:], strict=True))


def test_features_equal_plain_ones():
    from quill.llm.textnp import column_bytes
    import pyarrow as pa

    texts = ["Hello WORLD! a a 12 | x", None, "", "one", "Ab aB ab%% 123abc é É", "a a a a a a a a a"]
    idx, first = quality.features(*column_bytes(pa.array(texts)))
    names = {}
    for k, t in enumerate(texts):
        got = idx[first[k] : first[k + 1]]
        words, pairs = plain_features(t)
        assert (got[:1, 1] == quality.BUCKETS).all() and (got.shape[0], len(got[1:])) == (len(words), len(pairs))
        for f, b in zip([*words, *pairs], [*got[:, 0], *got[1:, 1]], strict=True):
            assert names.setdefault(f, b) == b


def test_quality_against_brute_force(spark):
    """Weights from plain counts in the operator's buckets, and the k best keys by a plain sort; nothing is taken from the output but its noise."""
    from quill.llm.textnp import column_bytes
    import pyarrow as pa

    d = docs(spark)
    labels = spark.read.parquet(f"{SF}/labels.parquet")
    out = quality.resample(d, labels).collect()
    texts = {r.doc_id: r.text for r in d.collect()}
    good = {r.doc_id: r.quality == 1 for r in labels.collect()}
    buckets = {}
    for i, t in texts.items():
        idx, _ = quality.features(*column_bytes(pa.array([t])))
        buckets[i] = Counter(int(b) for b in idx.ravel() if b < quality.BUCKETS)
    model = [Counter(), Counter()]
    for i, c in buckets.items():
        model[1].update(c)
        if good.get(i):
            model[0].update(c)
    total = [sum(m.values()) + 0.5 * quality.BUCKETS for m in model]
    ratio = lambda f: math.log((model[0][f] + 0.5) / total[0]) - math.log((model[1][f] + 0.5) / total[1])
    want = {i: sum(n * ratio(f) for f, n in c.items()) for i, c in buckets.items()}
    key = {}
    for r in out:
        assert r.log_weight == pytest.approx(want[r.doc_id], rel=1e-6, abs=1e-6)
        key[r.doc_id] = want[r.doc_id] + (r.sample_key - r.log_weight)
    k = math.ceil(1.03 * sum(good.values()) / len(good) * len(texts))
    best = set(sorted(key, key=key.get, reverse=True)[:k])
    assert {r.doc_id for r in out if r.kept} == best
    fewer = quality.resample(d, labels, keep=0.3)
    assert fewer.filter("kept").count() == 300


def test_noise_is_gumbel(spark):
    d = spark.range(20_000).select(F.col("id").alias("doc_id"), F.lit("").alias("text"))
    got = np.array([r.sample_key for r in quality.resample(d, spark.createDataFrame([], "doc_id long, quality int")).collect()])
    assert abs(got.mean() - 0.5772) < 0.03 and abs(got.var() - math.pi**2 / 6) < 0.12


def test_quality_on_held_out_labels(spark):
    """Labels of four in five documents fit the model; on the others nearly all good ones stay and most bad ones go."""
    at = "/root/testdata/sf0.1"
    d, labels = spark.read.parquet(f"{at}/documents.parquet"), spark.read.parquet(f"{at}/labels.parquet")
    held = F.crc32(F.col("doc_id").cast("string")) % 5 == 0
    out = quality.resample(d, labels.filter(~held)).join(labels.filter(held), "doc_id").collect()
    good, bad = ([r for r in out if r.quality == q] for q in (1, 0))
    assert len(good) > 500 and len(bad) > 50
    above = sum(g.sample_key > b.sample_key for g in good for b in bad) / (len(good) * len(bad))
    assert above > 0.98
    assert sum(r.kept for r in good) / len(good) > 0.97 and sum(not r.kept for r in bad) / len(bad) > 0.7


def test_quality_edges(spark):
    d = spark.createDataFrame([(1, None, 1), (2, "", 1), (None, "good words", 1), (4, "bad!! bad!!", 1), (4, "bad!! bad!!", 1)], "doc_id long, text string, kept int")
    labels = spark.createDataFrame([(1, 1), (4, 0), (None, 1), (9, 0), (2, None)], "doc_id long, quality int")
    out = quality.resample(d, labels).collect()
    assert len(out) == 5
    assert quality.keep_quality(d, labels).columns == d.columns
    clash = d.withColumns({c: F.lit(c) for c in ("id", "hash", "__id", "_id", "good")})
    assert quality.keep_quality(clash, labels, keep=0.5).columns == clash.columns
    assert quality.keep_quality(clash, labels, keep=0.5).count() in (3, 4)
    assert quality.keep_quality(d, labels.limit(0)).count() == 5
    assert quality.resample(d.limit(0), labels).count() == 0


def test_kth_largest(spark):
    rng = random.Random(9)
    v = [rng.choice([rng.randint(-(1 << 63), (1 << 63) - 1), rng.randint(-3, 3)]) for _ in range(400)]
    df = spark.createDataFrame([(x,) for x in v], "v long")
    for k in (1, 2, 57, 400):
        assert quality.kth_largest(df, "v", k) == sorted(v, reverse=True)[k - 1]
    assert quality.kth_largest(df, "v", 401) is None


def test_quality_models_count_all_good_texts(spark):
    d = spark.range(0, 30_000).select(F.col("id").alias("doc_id"), F.concat(F.lit("w"), F.col("id") % 1000).alias("text"))
    labels = spark.range(0, 30_000).select(F.col("id").alias("doc_id"), F.lit(1).alias("quality"))  # more than the 20,000 that were sampled once
    assert quality.resample(d, labels).agg(F.max(F.abs("log_weight"))).first()[0] == 0  # good text and all text are the same


# --- mixing ------------------------------------------------------------------------------------


def plain_mix(cells, weights, least):
    targets = {}
    for k, d in enumerate(mixing.DIMS):
        have = Counter()
        for c, n in cells.items():
            have[c[k]] += n
        raw = {v: n ** mixing.TEMPERATURES[d] for v, n in have.items()} if d not in weights else {v: weights[d].get(v, 0.0) for v in have}
        targets[k] = {v: x / sum(raw.values()) for v, x in raw.items()}
    w = {c: n / sum(cells.values()) for c, n in cells.items()}
    for _ in range(400):
        for k in range(3):
            have = Counter()
            for c, x in w.items():
                have[c[k]] += x
            w = {c: x * targets[k][c[k]] / have[c[k]] if have[c[k]] else 0.0 for c, x in w.items()}
    ratio = {c: w[c] / n for c, n in cells.items()}
    p = lambda t: {c: min(1.0, t * r) for c, r in ratio.items()}
    left = lambda t: sum(p(t)[c] * n for c, n in cells.items()) / sum(cells.values())
    t = 1 / max(ratio.values())
    if left(t) < least:
        lo, hi = t, t * 1e12
        for _ in range(300):
            mid = (lo + hi) / 2
            lo, hi = (mid, hi) if left(mid) < least else (lo, mid)
        t = hi
    return p(t)


@pytest.mark.parametrize(("weights", "least", "most_cells"), [({}, 0.25, 100_000), ({}, 0.9, 100_000), ({"lang": {"en": 1, "de": 3, "zz": 5}}, 0.1, 100_000), ({}, 0.25, 3), ({}, 0.9, 3)])
def test_mixing_against_brute_force(spark, weights, least, most_cells):
    d = docs(spark).withColumn("lang", F.when(F.col("doc_id") % 17 == 0, None).otherwise(F.col("lang"))).withColumn("mix_kept", F.lit("old"))
    if most_cells == 3:
        d = d.filter("doc_id < 300").withColumn("source", F.substring("source", 1, 4))
        # few cells, as each round of the form in DataFrames is a job
        out = mixing.mix(d, weights, least, most_cells=most_cells, topic=F.when(F.length("text") > 1000, "long").otherwise("short")).collect()
    else:
        out = mixing.mix(d, weights, least, most_cells=most_cells).collect()
    cells = Counter()
    for r in out:
        words = len(re.findall(r"[^\x20\x09-\x0D]+", r.text or "")) + 1
        assert r.mix_tokens == words
        cells[(r.source, r.lang or mixing.NONE, r.mix_topic)] += words
    want = plain_mix(cells, weights, least)
    for r in out:
        assert r.mix_probability == pytest.approx(want[(r.source, r.lang or mixing.NONE, r.mix_topic)], rel=1e-4, abs=1e-9)
    share = sum(r.mix_kept for r in out) / len(out)
    assert abs(share - sum(r.mix_probability for r in out) / len(out)) < 0.06
    assert all(not r.mix_kept for r in out if r.mix_probability == 0)


def test_raking_frames_ends_like_the_small_form(spark):
    """A missing cell makes raking slow (93 rounds here): both forms go on to the same tolerance."""
    cells = [("a", "x", "t", 10), ("a", "y", "t", 10), ("b", "y", "t", 10)]
    df = spark.createDataFrame(cells, "source string, lang string, topic string, tokens long")
    given = {"source": {"a": 0.5, "b": 0.5}, "lang": {"x": 0.45, "y": 0.55}}
    small, large = ({tuple(r)[:3]: r.p for r in mixing.probabilities(df, given, 0.0, most)[0].collect()} for most in (100, 0))
    for key, p in small.items():
        assert large[key] == pytest.approx(p, rel=1e-7)


def test_mixing_edges(spark):
    empty = spark.createDataFrame([], "doc_id long, text string, lang string, source string, n_chars long")
    assert mixing.mix(empty).count() == 0
    one = spark.createDataFrame([(None, None, None, None, None, 3)], "doc_id long, text string, lang string, source string, n_chars long, __source int")
    got = mixing.mix(one.withColumns({c: F.lit(c) for c in ("_source", "source_cell", "lang_cell", "topic", "p", "tokens")})).first()
    assert got.mix_probability == 1 and got.mix_kept and got.mix_topic == mixing.NONE
    assert got["__source"] == 3 and got.source_cell == "source_cell" and got.p == "p"
    clash = one.withColumns({"mix_ratio": F.lit(0.5), "MIX_topic": F.lit("old"), "a.b": F.lit("dot"), "own0": F.lit("mine")})
    out = mixing.mix(clash)
    assert out.columns == [*(c for c in clash.columns if c != "MIX_topic"), "mix_topic", "mix_tokens", "mix_probability", "mix_kept"]
    assert (out.first().mix_ratio, out.first()["a.b"], out.first().own0, out.first().mix_topic) == (0.5, "dot", "mine", mixing.NONE)


def test_topics_are_clusters_of_words(spark):
    rng = random.Random(6)
    kinds = [[f"{c}{k}" for k in range(40)] for c in "xyz"]
    rows = [(i, " ".join(rng.choice(kinds[i % 3]) for _ in range(60))) for i in range(90)] + [(90, None), (91, " "), (92, "")]
    df = spark.createDataFrame(rows, "doc_id long, text string")
    got = {r.doc_id: r.t for r in df.select("doc_id", mixing.topic_of("text", mixing.topic_model(df, topics=3)).alias("t")).collect()}
    assert [got[k] for k in (90, 91, 92)] == [mixing.NONE] * 3
    names = [{got[i] for i in range(k, 90, 3)} for k in range(3)]
    assert all(len(n) == 1 for n in names) and len(set.union(*names)) == 3


def test_topics_are_fitted_on_all_texts(spark):
    rng = random.Random(8)
    kinds = [[f"{c}{k}" for k in range(40)] for c in "xyz"]
    rows = [(i, " ".join(rng.choice(kinds[i % 2 if i % 3000 else 2]) for _ in range(60))) for i in range(9000)]  # three texts of the third kind
    df = spark.createDataFrame(rows, "doc_id long, text string")
    mean, centres = mixing.topic_model(df, topics=3)
    data, offs = mixing.column_bytes(pa.array([t for _, t in rows]))
    x = np.rint(mixing.word_vectors(data, offs) * 2**14).astype(float)
    assert np.array_equal(mean, np.rint(x.mean(axis=0)))
    dealt = mixing.topic_model(df.repartition(7, "text"), topics=3)
    assert np.array_equal(dealt[0], mean) and np.array_equal(dealt[1], centres)
    got = {r.doc_id: r.t for r in df.select("doc_id", mixing.topic_of("text", (mean, centres)).alias("t")).collect()}
    names = [{got[i] for i in range(9000) if (i % 2 if i % 3000 else 2) == k} for k in range(3)]
    assert all(len(n) == 1 for n in names) and len(set.union(*names)) == 3


def test_first_two_centres_come_with_the_vectors(spark, monkeypatch):
    rng = random.Random(9)
    texts = [" ".join(rng.choice([f"w{k}" for k in range(20 * (i % 7), 20 * (i % 7) + 50)]) for _ in range(30)) for i in range(700)]
    df = spark.createDataFrame([(t,) for t in texts], "text string").repartition(5)
    known, farthest = [], mixing._farthest
    monkeypatch.setattr(mixing, "_farthest", lambda vectors, centres: known.append(len(centres)) or farthest(vectors, centres))
    mean, got = mixing.topic_model(df, topics=5, rounds=0)
    assert known == [2, 3, 4]  # the passes over all vectors that only look for a centre
    data, offs = mixing.column_bytes(pa.array(texts))
    x = mixing._centred(np.rint(mixing.word_vectors(data, offs) * 2**14), mean)
    order = np.array([r.h for r in spark.createDataFrame([(t,) for t in texts], "text string").coalesce(1).select(F.xxhash64("text").alias("h")).collect()])
    want = [int(order.argmin())]
    while len(want) < 5:
        want.append(int(np.lexsort((order, (x @ x[want].T).max(axis=1)))[0]))
    assert np.array_equal(got, x[want])
    assert [len(mixing.topic_model(df, topics=k, rounds=1)[1]) for k in (0, 1, 2)] == [0, 1, 2]


def test_rounds_over_open_vectors_end_as_over_all(spark, monkeypatch):
    rng = random.Random(12)
    words = [f"w{k}" for k in range(200)]
    rows = [(i, " ".join(rng.choice(words[20 * (i % 5) : 20 * (i % 5) + 60]) for _ in range(40))) for i in range(3000)]
    df = spark.createDataFrame(rows, "doc_id long, text string")
    sizes = []
    parted = mixing._parted

    def seen(vectors, centres, margin):
        open_, settled = parted(vectors, centres, margin)
        sizes.append(sum(len(r.orders) // 8 for r in open_.collect()))
        assert sizes[-1] + settled.reshape(len(centres), -1)[:, 0].sum() == 3000
        return open_, settled

    monkeypatch.setattr(mixing, "_parted", seen)
    monkeypatch.setattr(mixing, "NEAR", 0.05)
    monkeypatch.setattr(mixing, "AHEAD", 1.5)
    got = mixing.topic_model(df, topics=4)
    monkeypatch.setattr(mixing, "NEAR", 0.0)
    n = len(sizes)
    every = mixing.topic_model(df, topics=4)
    assert n and len(sizes) == n and min(sizes) < 3000
    assert np.array_equal(got[0], every[0]) and np.array_equal(got[1], every[1])


def test_packed_pieces_carry_their_ids(spark):
    ids = {1: list(range(100, 110)), 2: [7], 3: list(range(5))}
    df = spark.createDataFrame([(k, len(v), np.array(v, "<u4").tobytes()) for k, v in ids.items()], "doc_id long, n long, ids binary").withColumn("text", F.lit("x"))
    packed = packing.pack(df, max_len=4, buckets=2, budget=8, tokens=F.col("n"))
    out = packing.emit(packed, df, pad_id=9).collect()
    got = defaultdict(list)
    for r in sorted(out, key=lambda r: (r.doc_id, -r.length)):
        x = np.frombuffer(r.ids, "<u4").tolist()
        assert len(x) == r.bucket and x[r.length :] == [9] * (r.bucket - r.length)
        got[r.doc_id] += x[: r.length]
    assert {k: sorted(v) for k, v in got.items()} == ids
    assert {(r.bucket, r.batch, r.slot) for r in out} == {(r.bucket, r.batch, r.slot) for r in packed.collect()}


# --- packing ------------------------------------------------------------------------------------


def test_boundaries_are_optimal():
    rng = random.Random(3)
    for _ in range(30):
        lengths = np.array(sorted(rng.sample(range(1, 60), rng.randint(1, 8))))
        counts = np.array([rng.randint(1, 9) for _ in lengths])
        k = rng.randint(1, 4)
        cost = lambda ends: sum(int(c) * (min(e for e in ends if e >= n) - int(n)) for n, c in zip(lengths, counts, strict=True))
        best = min(cost((*e, lengths[-1])) for m in range(k) for e in itertools.combinations(lengths[:-1].tolist(), min(m, len(lengths) - 1)))
        got = packing.boundaries(lengths, counts, k)
        assert len(got) <= k and cost(got) == best


@pytest.mark.parametrize("strip", [20_000, 40])
def test_packing(spark, strip):
    out = packing.pack(docs(spark), max_len=256, buckets=5, budget=2000, strip=strip).collect()
    want = Counter()
    for r in docs(spark).collect():
        n = len(re.findall(r"[^\x20\x09-\x0D]+", r.text or "")) + 1
        for k in range(-(-n // 256)):
            want[(r.doc_id, k, 256 * k, min(256, n - 256 * k))] += 1
    assert Counter((r.doc_id, r.piece, r.start, r.length) for r in out) == want
    ends = sorted({r.bucket for r in out})
    assert len(ends) <= 5
    by = defaultdict(list)
    for r in out:
        assert r.bucket == min(e for e in ends if e >= r.length)
        by[r.bucket].append((r.batch, r.slot))
    for e, places in by.items():
        cap = max(1, 2000 // e)
        assert sorted(places) == [(k // cap, k % cap) for k in range(len(places))]


def test_packing_edges(spark):
    assert packing.pack(spark.createDataFrame([], "doc_id long, text string")).count() == 0
    df = spark.createDataFrame([(None, None, 1), (1, "", 1), (1, "", 1), (2, "w " * 5000, 1)], "doc_id long, text string, bucket int")
    out = packing.pack(df, max_len=2048).collect()
    assert sorted(((r.doc_id or 0), r.length) for r in out) == [(0, 1), (1, 1), (1, 1), (2, 905), (2, 2048), (2, 2048)]
