import random
import re

import numpy as np
import pytest

from quill.llm import near_dup as nd
from quill.llm.components import connected_components

WORD = re.compile(r"[^\x20\x09-\x0D]+")


def sets(text, size):
    words = WORD.findall("".join(c.lower() if c < "\x80" else c for c in text or ""))
    if not words:
        return frozenset()
    return frozenset(tuple(words[i : i + size]) for i in range(len(words) - size + 1)) or frozenset([tuple(words)])


def brute(rows, size, percent):
    got = [sets(t, size) for _, t in rows]
    root = {i: i for i, _ in rows}

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    for a, (i, _) in enumerate(rows):
        for b, (j, _) in enumerate(rows[:a]):
            if got[a] and got[b] and 100 * len(got[a] & got[b]) >= percent * len(got[a] | got[b]):
                x, y = sorted((find(i), find(j)))
                root[y] = x
    return {i: (len(got[k]), find(i), find(i) == i) for k, (i, _) in enumerate(rows)}


def corpus(seed=5):
    rng = random.Random(seed)
    vocab = ["".join(rng.choice("abcdefé") for _ in range(rng.randint(1, 6))) for _ in range(400)]
    texts = []
    for _ in range(12):
        base = [rng.choice(vocab) for _ in range(rng.randint(30, 120))]
        texts.append(" ".join(base))
        for _ in range(rng.randint(0, 14)):
            words = list(base)
            for _ in range(rng.randint(0, 4)):
                words[rng.randrange(len(words))] = rng.choice(vocab)
            texts.append(rng.choice([" ", "\n", "  "]).join(w.upper() if rng.random() < 0.1 else w for w in words))
    texts += [None, "", " \t", "one", "One", "one two three", "ONE two  three", "x y z w v"]
    ids = rng.sample(range(1000), len(texts))
    return list(zip(ids, texts, strict=True))


@pytest.mark.parametrize(("size", "block"), [(4, 4096), (5, 4096), (4, 5)])
def test_against_brute_force(spark, size, block):
    rows = corpus()
    df = spark.createDataFrame([(i, t, 1) for i, t in rows], "doc_id long, text string, root int")
    got = {r.doc_id: (r.n_shingles, r.component_id, r.kept) for r in nd.near_duplicates(df, shingle=size, block_docs=block).collect()}
    assert got == brute(rows, size, 80)


def test_edges(spark):
    assert nd.near_duplicates(spark.createDataFrame([], "doc_id long, text string")).count() == 0
    rows = [(None, "a b c"), (None, "a b c"), (1, "a b c"), (1, "a b c"), (2, "a b c"), (3, None)]
    df = spark.createDataFrame(rows, "doc_id long, text string")
    got = sorted(((r.doc_id or -1), r.component_id, r.kept) for r in nd.near_duplicates(df).collect())
    assert got == [(-1, None, True), (-1, None, True), (1, 1, True), (1, 1, True), (2, 1, False), (3, 3, True)]
    kept = nd.drop_near_duplicates(df.selectExpr("doc_id", "text", "doc_id AS __x"))
    assert sorted(r.doc_id or -1 for r in kept.collect()) == [-1, -1, 1, 1, 3]
    assert kept.columns == ["doc_id", "text", "__x"]


def test_several_texts_under_one_id(spark):
    """Each text of an id is linked for itself: near copies of any of them are found, and none takes another's component."""
    words = [[f"{c}{k}" for k in range(60)] for c in "tuvw"]
    near = lambda w: " ".join([*w[:-1], "other"])
    t, u, v, w = (" ".join(x) for x in words)
    rows = [(2, near(words[0])), (5, t), (5, u), (5, v), (7, near(words[1])), (8, near(words[2])), (9, w), (4, u)]
    df = spark.createDataFrame(rows, "doc_id long, text string")
    got = {(r.doc_id, r.text_hash): (r.component_id, r.kept) for r in nd.near_duplicates(df).collect()}
    hashed = {(r.doc_id, r.text): r.h for r in df.selectExpr("doc_id", "text", "xxhash64(text) AS h").collect()}
    want = [(2, True), (2, False), (4, False), (5, True), (4, False), (5, False), (9, True), (4, True)]
    assert {k: got[k[0], hashed[k]] for k in rows} == dict(zip(rows, want, strict=True))
    kept = {(r.doc_id, r.text) for r in nd.drop_near_duplicates(df).collect()}
    assert kept == {r for r, (_, keep) in zip(rows, want, strict=True) if keep}


def test_colliding_hashes_link_nothing(spark):
    """A Thue-Morse word and its complement collide under polynomial hashes; texts that differ in it share no shingle of four words."""
    bits = [k.bit_count() % 2 for k in range(1024)]
    t, u = "".join("ab"[b] for b in bits), "".join("ba"[b] for b in bits)
    rows = [(1, f"{t} q w e"), (2, f"{u} q w e"), (3, f"{t} Q  w e")]
    got = {r.doc_id: (r.n_shingles, r.component_id, r.kept) for r in nd.near_duplicates(spark.createDataFrame(rows, "doc_id long, text string"), shingle=4).collect()}
    assert got == {1: (1, 1, True), 2: (1, 2, True), 3: (1, 1, False)}


@pytest.mark.parametrize("block", [4096, 200])
def test_large_groups_are_taken_apart(spark, monkeypatch, block):
    """A group that chance ties hold together, larger than a block, gives the links of brute force."""
    monkeypatch.setattr(nd, "SMALL", 32)
    rng = random.Random(8)
    base = [f"w{k}" for k in range(60)]
    rows = []
    for k in range(220):
        words = [w if rng.random() < 0.93 else f"x{rng.randrange(50)}" for w in base]
        rows.append((k, " ".join(words)))
    df = spark.createDataFrame(rows, "doc_id long, text string")
    got = {r.doc_id: (r.n_shingles, r.component_id, r.kept) for r in nd.near_duplicates(df, shingle=4, block_docs=block).collect()}
    assert got == brute(rows, 4, 80)


def test_dropping_keeps_clashing_columns(spark):
    df = spark.createDataFrame([(1, "a b c", 7, 8, 9), (2, "a b c", 7, 8, 9)], "doc_id long, text string, id int, hash int, __id int")
    out = nd.drop_near_duplicates(df)
    assert out.columns == df.columns and [tuple(r) for r in out.collect()] == [(1, "a b c", 7, 8, 9)]


def test_registers_merge_and_estimate():
    rng = np.random.default_rng(2)
    keys = rng.integers(0, 1 << 63, 3000).astype(np.uint64)
    reg = lambda k: nd.registers(np.sort(k), np.array([0, len(k)]))[0]
    a, b = keys[:2000], keys[400:2400]
    assert (nd.merge(reg(a), reg(b)) == reg(keys[:2400])).all()
    x, y = reg(a), reg(b)
    got = nd.estimate(2000, np.array([2000.0]), np.array([(x > y).sum()]), np.array([(x < y).sum()]))[0]
    assert abs(got - 1600 / 2400) < 0.12


def test_components(spark):
    rng = random.Random(4)
    edges = [(rng.randrange(60), rng.randrange(60)) for _ in range(40)] + [(k, k + 1) for k in range(100, 160)] + [(7, 7), (None, 3)]
    got = {r.node: r.root for r in connected_components(spark.createDataFrame(edges, "u long, v long")).collect()}
    root = {}
    for u, v in edges:
        if u is not None and u != v:
            root.setdefault(u, u), root.setdefault(v, v)
    for _ in range(70):
        for u, v in edges:
            if u is not None and u != v:
                root[u] = root[v] = min(root[u], root[v])
    assert got == root
