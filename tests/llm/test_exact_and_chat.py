import hashlib
import random
import re

import pytest
from pyspark.sql import functions as F

from quill.llm import chat_format as cf
from quill.llm import exact_dedup as ed


def plain(rows):
    norm = [re.sub(r"[\x20\x09-\x0D]+", " ", t or "") for _, t in rows]
    out = []
    for (i, _), n in zip(rows, norm, strict=True):
        same = [j for (j, _), m in zip(rows, norm, strict=True) if m == n]
        out.append((i, min(same), len(same), i == min(same), hashlib.sha256(n.encode()).hexdigest()))
    return sorted(out)


@pytest.mark.parametrize(("capacity", "hashed"), [(1 << 20, None), (1, None), (30, lambda x: F.shiftleft(F.length(x).cast("long"), 60))])
def test_exact_dedup(spark, capacity, hashed):
    """Also where the directory is deep, and where the keys of different texts collide and are chained."""
    rng = random.Random(1)
    texts = ["a b", "a  b", "a\tb\n", " a b", None, "", " ", " ", "é", "x" * 100_000] + [f"t{rng.randint(0, 40)}" for _ in range(150)]
    rows = [(i * 7 % 1009, t) for i, t in enumerate(texts)]
    df = spark.createDataFrame([(i, t, "old", 1, "k") for i, t in rows], "doc_id long, text string, kept string, bucket int, key string")
    out = ed._verdicts(df, capacity, hashed) if hashed else ed.exact_dedup(df, capacity)
    assert out.columns == ["doc_id", "text", "bucket", "key", "keep_id", "group_size", "kept", "text_sha256"]
    got = out.collect()
    assert sorted((r.doc_id, r.keep_id, r.group_size, r.kept, r.text_sha256) for r in got) == plain(rows)
    assert {(r.text, r.bucket, r.key) for r in got} == {(t, 1, "k") for t in texts}


def test_exact_dedup_edges(spark):
    assert ed.exact_dedup(spark.createDataFrame([], "doc_id long, text string")).count() == 0
    df = spark.createDataFrame([(None, "a"), (None, "a"), (5, "a"), (5, "a"), (None, "b")], "doc_id long, text string")
    got = sorted((r.doc_id or -1, r.keep_id or -1, r.group_size, r.kept) for r in ed.exact_dedup(df).collect())
    assert got == [(-1, -1, 1, True), (-1, 5, 4, False), (-1, 5, 4, False), (5, 5, 4, True), (5, 5, 4, True)]
    names = ["__key", "__norm", "norm", "cell", "own0", "digest", "hit", "salt"]
    wide = spark.createDataFrame([(k % 3, "t", *names) for k in range(6)], ["doc_id", "text", *names])
    got = ed.exact_dedup(wide)
    assert got.columns == ["doc_id", "text", *names, "keep_id", "group_size", "kept", "text_sha256"]
    assert sorted(tuple(r)[2:-3] for r in got.collect()) == [(*names, 0)] * 6


def test_directory_splits_overfull_buckets(spark):
    rng = random.Random(4)
    keys = {k: rng.randint(1, 20) for k in {rng.randint(-(1 << 63), (1 << 63) - 1) for _ in range(400)} | set(range(20)) | {-1, -(1 << 63)}}
    df = spark.createDataFrame(list(keys.items()), "key long, n_bytes long")
    for capacity in (1 << 20, 300, 60):
        table, top = ed.build_directory(df, capacity)
        cells = sorted(table.collect())
        buckets = {r.bucket: (r.depth, r.n_bytes) for r in cells}
        assert top == max(d for d, _ in buckets.values()) and len({r.cell for r in cells}) == len(cells)
        within = lambda k, b: (k % (1 << 64)) >> (64 - buckets[b][0]) == b >> (top - buckets[b][0]) if buckets[b][0] else True
        for b, (depth, size) in buckets.items():
            held = sum(n for k, n in keys.items() if within(k, b))
            assert held == size
            parent = sum(n for k, n in keys.items() if depth and (k % (1 << 64)) >> (65 - depth) == b >> (top - depth + 1))
            assert depth == 0 or parent > capacity  # split for a reason
            assert size <= capacity or b == 0  # the keys 0 to 19 share their leading bits: theirs alone may stay overfull
        assert sum(n for _, n in buckets.values()) == sum(keys.values())
        assert (len(buckets) == 1) == (capacity == 1 << 20)


def test_splits_and_doublings_on_documents(spark):
    docs = spark.read.parquet("/root/testdata/sf0.01/documents.parquet")
    norm = ed.normalised(F.col("text"))
    index = ed.build_index(docs.select("doc_id", norm.alias("norm"), F.xxhash64(norm).alias("key")), 1 << 16)
    depths = {r.bucket: r.depth for r in index.directory.collect()}
    assert index.depth >= 5 and len(depths) > 20 and len(set(depths.values())) > 1  # doubled at least five times, and some buckets stand in two cells or more
    assert {r.bucket for r in index.entries.select("bucket").distinct().collect()} == set(depths)
    assert index.entries.agg(F.sum("group_size")).first()[0] == docs.count()


def test_keys_with_several_texts_are_chained(spark):
    rows = spark.createDataFrame([(1, 77, "aa"), (2, 77, "bb"), (3, 77, "aa"), (4, 5, "c")], "doc_id long, key long, norm string")
    for many in (1, 400):  # also where few of many rows bear a key
        index = ed.build_index(rows.unionByName(spark.range(many * 3).selectExpr("id + 10 doc_id", "id * 7919 + 1000 key", "cast(id as string) norm")), 1).entries.filter("key < 100")
        assert sorted((r.key, r.chain, r.keep_id, r.group_size) for r in index.collect()) == [(5, 1, 4, 1), (77, 2, 1, 2), (77, 2, 2, 1)]
        assert sorted(r.place for r in index.filter("key = 77").collect()) == [1, 2]


NASTY = ["", "plain", "</s>", "<s>", "[INST]", "[/INST]x", cf.ESC, "<" + cf.ESC, "<" + cf.ESC + "s>", cf.ESC * 3 + "<s>" + cf.ESC, "<s", "</s", "[/INST", "a</s>[INST] ok [/INST]", "<<s>>[[INST]]", "é😀\n\n", "x" * 50_000, "</</s>s>"]


def test_round_trip(spark):
    rng = random.Random(2)
    bits = ["<", "s>", "/", "[", "INST]", cf.ESC, "a", "\n", "0", "2"]
    texts = NASTY + ["".join(rng.choice(bits) for _ in range(rng.randint(0, 25))) for _ in range(300)]
    roles = ["user", "assistant", "system", None, "", "a[/INST]", "</s>"]
    rows = [(k % 9, k, roles[k % 7], t) for k, t in enumerate(texts)] + [(9, None, "assistant", None), (None, 3, "assistant", "last"), (10, 1, "user", "twice"), (10, 1, "user", "twice")]
    df = spark.createDataFrame(rows, "conv_id long, turn long, role string, text string").withColumn("formatted", F.lit(1))
    levels = cf.format_turns(df).collect()
    assert all(r.level is not None for r in levels)
    assert {r.level for r in levels if not re.search(r"</?s>|\[/?INST\]", (r.role or "") + "|" + (r.text or ""))} == {0}
    out = cf.format_conversations(df)
    for r in out.collect():
        assert "".join(s.text for s in r.segments) == r.formatted
    got = {r.conv_id: r for r in cf.read_back(out).collect()}
    for conv in {r[0] for r in rows}:
        want = sorted((r for r in rows if r[0] == conv), key=lambda r: (r[1] is not None, r[1]))
        turns = [(r[2] or "", r[3] or "") for r in want]
        assert [(t.role, t.text) for t in got[conv].turns] == turns
        assert got[conv].loss_text == "".join(t for role, t in turns if role == "assistant")
    assert cf.read_back(cf.format_conversations(df.limit(0))).count() == 0


def test_parser_refuses_what_the_grammar_lacks(spark):
    bad = ["<s>0[INST]user[/INST]a<s>b</s>", "<s>3[INST]user[/INST]a</s>", "user</s>", "<s>0[INST]user</s>"]
    df = spark.createDataFrame([(b,) for b in bad], "f string").select(cf.parse(F.col("f"))[0]["text"].alias("t"))
    assert [r.t for r in df.collect()] == [None] * 4
