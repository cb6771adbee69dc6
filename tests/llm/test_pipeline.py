"""The pipeline's stages against plain versions, each on its own input."""

import re

import corpus_pipeline as cp
import pytest

from .test_models import plain_mix
from .test_near_dup import brute
from quill.llm import mixing, token_output
from quill.llm.queries import tokenizer

SF = "/root/testdata/sf0.001"


@pytest.fixture(scope="module")
def steps(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    out = [("documents", docs.collect())]
    for name, stage in cp.STAGES:
        docs = cp.written(stage(spark, docs, SF), "test-stage")
        out.append((name, docs.collect()))
    return dict(out)


def test_stages_keep_the_columns_of_documents(steps):
    for name in ("quality", "exact_dedup", "near_dedup", "mixing"):
        assert steps[name][0].__fields__ == steps["documents"][0].__fields__
        assert set(steps[name]) <= set(steps["documents"])


def test_quality(spark, steps):
    label = {r.doc_id: r.quality for r in spark.read.parquet(f"{SF}/labels.parquet").collect()}
    kept = {r.doc_id for r in steps["quality"]}
    good = [k for k, q in label.items() if q == 1]
    assert len(kept) == -(-len(steps["documents"]) * 1.03 * len(good) // len(label))
    assert sum(k in kept for k in good) / len(good) > 0.97
    assert sum(k not in kept for k, q in label.items() if q == 0) > 0.5 * sum(q == 0 for q in label.values())  # of 200 rows, the spare share alone is 5


def test_exact(steps):
    first = {}
    for r in sorted(steps["quality"]):
        first.setdefault(re.sub(r"[\x20\x09-\x0D]+", " ", r.text or ""), r)
    assert sorted(steps["exact_dedup"]) == sorted(first.values())


def test_near(steps):
    want = brute([(r.doc_id, r.text) for r in steps["exact_dedup"]], 5, 80)
    assert {r.doc_id for r in steps["near_dedup"]} == {i for i, (_, _, kept) in want.items() if kept}


def n_ids(texts):
    from tokenizers import Tokenizer

    got = Tokenizer.from_file(tokenizer()).encode_batch([t or "" for t in texts], add_special_tokens=False)
    return [len(e.ids) + 1 for e in got]


def test_mix(spark, steps):
    docs = spark.createDataFrame(steps["near_dedup"])
    df = mixing.mix(docs, tokens=token_output.n_ids("text", tokenizer())).collect()
    cells = {}
    for r, n in zip(df, n_ids(r.text for r in df), strict=True):
        key = (r.source, r.lang, r.mix_topic)
        cells[key] = cells.get(key, 0) + n
    want = plain_mix(cells, {}, 0.25)
    for r in df:
        assert r.mix_probability == pytest.approx(want[(r.source, r.lang, r.mix_topic)], rel=1e-4)
    assert {r.doc_id for r in steps["mixing"]} == {r.doc_id for r in df if r.mix_kept}


def test_pack(steps):
    kept = steps["mixing"]
    want = {(r.doc_id, k) for r, n in zip(kept, n_ids(r.text for r in kept), strict=True) for k in range(-(-n // 2048))}
    assert {(r.doc_id, r.piece) for r in steps["packing"]} == want and len(steps["packing"]) == len(want)


def test_run(spark, steps):
    got = cp.run(spark, SF)
    assert sorted(got.collect()) == sorted(steps["packing"])


@pytest.mark.parametrize("rows", [[], [(None, None, None, None, None), (1, "", "en", "s", 0), (1, "", "en", "s", 0), (2, "one word", None, None, 8), (3, "long " * 30_000, "en", "s", None)]])
def test_stages_take_nulls_and_empty_tables(spark, rows):
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long")
    for _, stage in cp.STAGES[:-1]:
        docs = cp.written(stage(spark, docs, SF), "edge")
        assert docs.columns == ["doc_id", "text", "lang", "source", "n_chars"]
    out = cp.STAGES[-1][1](spark, docs, SF).collect()
    assert bool(out) == bool(rows)
