import hashlib
import random
from collections import Counter

import numpy as np
import pyarrow as pa
import pytest

from quill.llm.suffix_dedup import Shard, kasai, remove_repeats, search, suffix_array, words8


def brute(texts, length):
    data = [(t or "").encode() for t in texts]
    seen = Counter(d[i : i + length] for d in data for i in range(len(d) - length + 1))
    out = []
    for d in data:
        gone = np.zeros(len(d), bool)
        for i in range(len(d) - length + 1):
            if seen[d[i : i + length]] > 1:
                gone[i : i + length] = True
        edge = np.diff(np.concatenate(([0], gone.astype(int), [0])))
        kept = bytes(np.frombuffer(d, np.uint8)[~gone]) if d else b""
        out.append((len(d), int(gone.sum()), int((edge == 1).sum()), hashlib.sha256(kept).hexdigest()))
    return out


def test_suffix_array_and_prefixes():
    rng = random.Random(1)
    for n in (0, 1, 7, 300):
        data = bytes(rng.choice(b"ab") for _ in range(n)) + b"abab" * (n // 20)
        a = np.frombuffer(data, np.uint8)
        sa, rank = suffix_array(a)
        assert sa.tolist() == sorted(range(len(data)), key=lambda i: data[i:])
        if not n:
            continue
        lcp = kasai(words8(a), sa, rank, np.array([0]), np.array([len(a)]), 40)
        for i in range(len(a)):
            j = sa[rank[i] - 1] if rank[i] else None
            k = 0
            while j is not None and k < 40 and max(i, j) + k < len(a) and data[i + k] == data[j + k]:
                k += 1
            assert lcp[i] == k


def test_search():
    a, b = b"the cat sat on the mat and the dog ran on", b"a dog ran on and the cat sat down"
    x, y = np.frombuffer(a, np.uint8), np.frombuffer(b, np.uint8)
    sa, _ = suffix_array(x)
    for most in (3, 8, 9, 12):
        starts = np.arange(len(b) - most + 1)
        got = search(words8(x), sa, words8(y), starts, most)
        assert got.tolist() == [b[i : i + most] in a for i in starts]


def test_shard_found():
    texts = pa.array([b"x" * 10 + b"hello wonderful world" * 4, b"abc"], pa.binary())
    other = pa.array([b"hello wonderful worldhello wonderful world and more of it"], pa.binary())
    a, b = Shard(texts, 30), Shard(other, 30)
    flag = a.found(b)
    data = texts[0].as_py()
    assert [bool(flag[i]) for i in range(len(data) - 29)] == [data[i : i + 30] in other[0].as_py() for i in range(len(data) - 29)]


def test_separators_match_no_text():
    """Text 116's separator once ended in the byte of 't', so 't' and the next text looked like a string of the shard."""
    tail = b"his is the continuation of a text that goes on for a while"
    texts = [b"%03d plain" % k for k in range(116)] + [b"one hundred and sixteen", tail, b"a t" + tail]
    shard = Shard(pa.array(texts, pa.binary()), len(tail) + 1)
    assert not shard.repeated().any()


def corpus(seed):
    rng = random.Random(seed)
    word = lambda: "".join(rng.choice("abcdeé") for _ in range(rng.randint(1, 7)))
    passage = " ".join(word() for _ in range(60))
    texts = []
    for k in range(60):
        body = [word() for _ in range(rng.randint(0, 150))]
        if k % 3 == 0:
            cut = rng.randint(0, 40)
            body.insert(len(body) // 2, passage[cut:])
        texts.append(" ".join(body))
    texts += [texts[0], texts[0], None, None, "", "aaaa" * 200, "ab" * 300, texts[5] + texts[5]]
    return texts


@pytest.mark.parametrize(("length", "shard"), [(60, 3 << 20), (60, 600), (100, 2000)])
def test_against_brute_force(spark, length, shard):
    texts = corpus(length)
    df = spark.createDataFrame([(i, t, "x") for i, t in enumerate(texts)], "doc_id long, text string, spans string")
    got = {r.doc_id: (r.n_bytes, r.n_removed, len(r.spans), r.kept_sha256) for r in remove_repeats(df, length, shard).collect()}
    assert [got[i] for i in range(len(texts))] == brute(texts, length)


def test_edges(spark):
    empty = spark.createDataFrame([], "doc_id long, text string")
    assert remove_repeats(empty).count() == 0
    row = "some words " * 60
    df = spark.createDataFrame([(None, row), (None, row), (3, None), (4, "y"), (4, "y")], "doc_id long, text string")
    got = sorted((r.doc_id or -1, r.n_removed) for r in remove_repeats(df).collect())
    assert got == [(-1, 660), (-1, 660), (3, 0), (4, 0), (4, 0)]


def test_passage_in_a_third_of_all_documents(spark):
    """The class of one passage holds more than a thousandth of all runs, so its join with the hits is dealt out by document."""
    rng = random.Random(9)
    word = lambda: "".join(rng.choice("abcdefgh") for _ in range(6))
    hot = " ".join(word() for _ in range(40))
    texts = [(hot if i % 3 == 0 else "") + " ".join(word() for _ in range(30)) for i in range(240)]
    df = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string").repartition(6)
    got = {r.doc_id: (r.n_bytes, r.n_removed, len(r.spans), r.kept_sha256) for r in remove_repeats(df, 64).collect()}
    assert got == dict(enumerate(brute(texts, 64)))
