"""Queries with SQL against DuckDB: on the smallest tables, and on documents with nulls, copies and cuts inside characters."""

import os
import random

import duckdb
import pyarrow as pa
import pyarrow.parquet as pq
import pytest

from quill.llm.queries import QUERIES, SQL

SF = "/root/testdata/sf0.001"


def both(spark, name, folder):
    con = duckdb.connect()
    for t in ("documents", "embeddings", "conversations"):
        if os.path.exists(f"{folder}/{t}.parquet"):
            con.execute(f"create view {t} as select * from '{folder}/{t}.parquet'")
    got = QUERIES[name](spark, str(folder))
    columns = sorted(got.columns)
    want = con.sql(SQL[name])
    assert sorted(want.columns) == columns
    rows = con.sql(f"select {', '.join(columns)} from ({SQL[name]})").fetchall()
    return sorted(map(repr, (tuple(r) for r in got.select(*columns).collect()))), sorted(map(repr, rows))


@pytest.mark.skipif(not os.path.isdir(SF), reason="tables aren't here")
@pytest.mark.parametrize("name", sorted(SQL))
def test_small_tables(spark, name):
    got, want = both(spark, name, SF)
    assert got == want
    assert got


@pytest.mark.parametrize("name", ["op1_suffix_array_dedup", "op5_exact_dedup", "op10_minhash_near_dedup", "op12_hilbert_shards", "op13_fill_middle"])
def test_hard_documents(spark, tmp_path, name):
    rng = random.Random(11)
    word = lambda: "".join(rng.choice("abAé漢😀") for _ in range(rng.randint(1, 5)))
    some = [" ".join(word() for _ in range(120)) for _ in range(4)]
    texts = [None, "", " \t\n", "one Two", "ONE two", "x" * 399, "x" * 400, "x" * 2000, "é" * 700, "a" + "é" * 300, "漢" * 300, "b漢" * 300, *some, some[0], some[1].upper()]
    # passages that begin and end inside characters of their own: neighbours share bytes with the other's, so cuts fall within characters
    texts += [f"{a}{some[2][:250]}{b}" for a, b in (("é", "漢"), ("ã©é", "漤"), ("q", "\n"))] + [some[3] + " " + some[3], "\v".join(some[:2]), "a <P> b", "<<S>>", "<M", "é<P", "<P" * 9]
    ids = rng.sample(range(-50, 1000), len(texts))
    tags = [None if i % 7 == 0 else f"s{i % 5}" for i in range(len(texts))]
    pq.write_table(pa.table({"doc_id": pa.array(ids, pa.int64()), "text": pa.array(texts, pa.string()), "lang": tags[::-1], "source": tags}), tmp_path / "documents.parquet")
    got, want = both(spark, name, tmp_path)
    assert got == want
    assert name != "op1_suffix_array_dedup" or any("�" in x for x in got)


def test_hard_vectors(spark, tmp_path):
    rng = random.Random(4)
    vector = lambda: [rng.uniform(-1, 1) for _ in range(32)]
    same = vector()
    rows = [(i, vector(), i % 3) for i in range(150)] + [(200 + i, same, None) for i in range(60)] + [(5, same, 1), (None, vector(), 2), (7, None, 1)]
    rows += [(300, [float("nan"), *same[1:]], 0), (301, [None, *same[1:]], 0), (302, [float("inf"), *same[1:]], 0), (303, [1000.0] * 32, 7)]
    rng.shuffle(rows)
    kinds = [("vec_id", pa.int64()), ("embedding", pa.list_(pa.float32())), ("label", pa.int32())]
    pq.write_table(pa.table({n: pa.array([r[k] for r in rows], t) for k, (n, t) in enumerate(kinds)}), tmp_path / "embeddings.parquet")
    for name in ("op3_exact_top_k", "op11_vector_codes"):
        got, want = both(spark, name, tmp_path)
        assert got == want and got
