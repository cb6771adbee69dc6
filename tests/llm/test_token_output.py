import random
import zlib
from collections import Counter

import numpy as np
import pyarrow as pa
import pytest

from quill.llm import queries
from quill.llm.textnp import column_bytes
from quill.llm.token_output import Encoder, compress, load, n_ids, read_ids, write_ids

P = pytest.importorskip("public_tokenizers")
PATH = P.path("byte_bpe_50k.json")


def plain(path=PATH):
    from tokenizers import Tokenizer

    return Tokenizer.from_file(path)


ODD = ["", " ", "  ", "a  b", " a", "a ", "a\n b", "a \nb", "a\n \nb", "x   y", "it's <|endoftext|> don't", "é à ñ", "a  b", "tab\tb c", "😀 ok 12 345,6", "\n\n x"]


def test_encoder_equals_whole_text():
    rng = random.Random(3)
    texts = [*ODD, *("".join(rng.choice(["ab", " ", " ", "\n", "'s", "é", "7", ".", "\t", "Zq"]) for _ in range(60)) for _ in range(300))]
    texts += ["".join(rng.choice(["ab", " ", "\u00a0", "\n", "'s", "'", "é", "—", "7", ".", "!", "\t", "\x1f", "\u2003", "Zq"]) for _ in range(40)) for _ in range(300)]
    want = [[*e.ids, 2] for e in plain().encode_batch(texts, add_special_tokens=False)]
    enc = Encoder(PATH, keep=50)
    data, offs = column_bytes(pa.array(texts))
    for _ in range(2):
        ids, lengths = enc.encode(data, offs, 2)
        assert [x.tolist() for x in np.split(ids, np.cumsum(lengths)[:-1])] == want


def test_counting_keeps_no_ids(monkeypatch):
    rng = random.Random(5)
    texts = [*ODD, *(" ".join("".join(rng.choice("abcdefgé7.") for _ in range(rng.choice([3, 9, 15, 16, 40]))) for _ in range(40)) for _ in range(40))]
    want = [len(e.ids) + 1 for e in plain().encode_batch(texts, add_special_tokens=False)]
    monkeypatch.setattr(Encoder, "COUNT_BITS", 5, raising=False)  # nearly every piece takes another's slot
    monkeypatch.setattr(Encoder, "LONG_KEPT", 7, raising=False)
    monkeypatch.setattr(Encoder, "LONG_BYTES", 30, raising=False)
    enc = Encoder(PATH)
    for rows in (texts, texts[::-1], texts[:1], ODD):
        data, offs = column_bytes(pa.array(rows))
        assert enc.count_ids(data, offs).tolist() == [want[texts.index(t)] for t in rows]
    assert enc.count == 1 and not enc.long and len(enc.long_many) <= 7


def thue_morse(n=1024):
    """A word and its complement, on which polynomial hashes modulo a power of two collide whatever their base."""
    bits = [k.bit_count() % 2 for k in range(n)]
    return "".join("ab"[b] for b in bits), "".join("ba"[b] for b in bits)


def test_pieces_are_told_apart_by_their_bytes():
    texts = [*thue_morse(), *(" " + t for t in thue_morse(64)), "a" * 15, "a" * 16, " " + "a" * 15, "é" * 7, "é" * 8, "x<|endoftext|>y", "x <|endoftext|> y"]
    enc = Encoder(PATH)
    ids, lengths = enc.encode(*column_bytes(pa.array(texts)), 2)
    assert [x.tolist() for x in np.split(ids, np.cumsum(lengths)[:-1])] == [[*plain().encode(t, add_special_tokens=False).ids, 2] for t in texts]
    assert plain().encode("x <|endoftext|> y", add_special_tokens=False).ids == [87, 220, 50256, 331]


def test_other_tokenizers_encode_whole_texts():
    path = P.path("word_bpe_49k.json")
    texts = ["Hello  World", "", "it's <|endoftext|> 12 345", "é\n\nx", *thue_morse()]
    enc = Encoder(path)
    assert not enc.plain
    data, offs = column_bytes(pa.array(texts))
    want = [[*plain(path).encode(t, add_special_tokens=False).ids, 7] for t in texts]
    ids, lengths = enc.encode(data, offs, 7)
    assert [x.tolist() for x in np.split(ids, np.cumsum(lengths)[:-1])] == want
    assert enc.count_ids(data, offs).tolist() == [len(x) for x in want]


@pytest.mark.parametrize("least", [4, 8])
def test_grammar_runs_to_its_floor(least):
    rng = np.random.default_rng(5)
    lengths = rng.integers(1, 300, 200)
    ids = np.concatenate([rng.zipf(1.3, int(lengths.sum())).clip(0, 60_000), [7] * 500, [1, 2] * 300]).astype(np.uint32)
    lengths = np.append(lengths, [500, 600])
    g = compress(ids, lengths, least)
    assert g.decode().tolist() == ids.tolist()
    assert g.sizes.tolist() == [len(g.expand(np.array([g.base + k]))) for k in range(len(g.rules))]
    ends = set(np.cumsum(lengths).tolist())
    at = np.cumsum(g.lengths(g.symbols)).tolist()
    pairs = Counter((a, b) for a, b, end in zip(g.symbols.tolist(), g.symbols[1:].tolist(), at, strict=False) if end not in ends)
    assert max(pairs.values()) < least
    assert len(g.symbols) + 2 * len(g.rules) < 0.9 * len(ids)


def test_grammar_round_trip():
    rng = np.random.default_rng(1)
    for n_docs, top in ((0, 5), (1, 3), (40, 4), (40, 70000)):
        lengths = rng.integers(0, 400, n_docs)
        ids = rng.integers(0, top, int(lengths.sum())).astype(np.uint32)
        g = compress(ids, lengths)
        assert g.decode().tolist() == ids.tolist()
        if top == 4 and n_docs:
            assert len(g.symbols) + 2 * len(g.rules) < len(ids)
        for _ in range(20):
            a, b = sorted(rng.integers(0, len(ids) + 1, 2).tolist())
            assert g.decode_range(a, b).tolist() == ids[a:b].tolist()


def test_files(spark, tmp_path, monkeypatch):
    texts = [None, "hello world " * 50, *ODD, "long " * 5000]
    rows = [(i * 3, t, "x") for i, t in enumerate(texts)]
    random.Random(2).shuffle(rows)
    spark.createDataFrame(rows, "doc_id long, text string, ids string").write.parquet(str(tmp_path / "in"))
    write_ids(spark.read.parquet(str(tmp_path / "in")), str(tmp_path / "out"), PATH, parts=3)
    got = {r.doc_id: r for r in read_ids(spark, str(tmp_path / "out")).collect()}
    t, start = plain(), 0
    for i, text in enumerate(texts):
        ids = [*t.encode(text or "", add_special_tokens=False).ids, 2]
        r = got[3 * i]
        assert (r.start, r.n_tokens, r.ids_crc32) == (start, len(ids), zlib.crc32(np.array(ids, "<u4").tobytes()))
        start += len(ids)
    block = spark.read.parquet(str(tmp_path / "out")).first().asDict()
    assert len(load(block).decode()) == block["n_ids"]
    monkeypatch.setattr("quill.llm.token_output.MOST_BOUNDS", 2)
    write_ids(spark.read.parquet(str(tmp_path / "in")), str(tmp_path / "ranged"), PATH, parts=3)
    ranged = {r.doc_id: (r.start, r.ids_crc32) for r in read_ids(spark, str(tmp_path / "ranged"), with_ids=False).collect()}
    assert ranged == {k: (r.start, r.ids_crc32) for k, r in got.items()}
    empty = spark.createDataFrame([], "doc_id long, text string")
    write_ids(empty, str(tmp_path / "none"), PATH)
    assert read_ids(spark, str(tmp_path / "none")).count() == 0


def test_counts_equal_whole_text(spark):
    texts = [None, *ODD, "a\u00a0b \x1f c", "long words " * 40_000]
    got = {r.k: r.n for r in spark.createDataFrame(list(enumerate(texts)), "k int, t string").select("k", n_ids("t", PATH).alias("n")).collect()}
    assert got == {k: len(plain().encode(t or "", add_special_tokens=False).ids) + 1 for k, t in enumerate(texts)}


def test_mixing_and_packing_queries_count_ids(spark):
    """op7 and op8 measure documents by the ids that op2 writes, not by words."""
    sf = "/root/testdata/sf0.001"
    rows = spark.read.parquet(f"{sf}/documents.parquet").select("doc_id", "text").collect()
    ids = sorted((r.doc_id, len(e.ids) + 1) for r, e in zip(rows, plain().encode_batch([r.text or "" for r in rows], add_special_tokens=False), strict=True))
    assert sorted((r.doc_id, r.mix_tokens) for r in queries.op7_mixing(spark, sf).collect()) == ids
    pieces = queries.op8_packing(spark, sf).collect()
    assert sorted((r.doc_id, r.start, r.length) for r in pieces) == sorted((d, s, min(2048, n - s)) for d, n in ids for s in range(0, n, 2048))
