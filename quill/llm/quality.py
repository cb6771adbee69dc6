"""Quality selection by importance resampling over hashed n-gram models.

Two generative models over hashed words and pairs of words, one of target text and one of raw text, give each document the log ratio of its
probabilities under both; Gumbel noise is added and the best k documents are taken, which samples without replacement
in proportion to the ratio. The target is text that is labelled good, raw text is that of all documents.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import free, written
from .language_id import uniform
from .textnp import column_bytes, mix, prefix_hash, range_hash, row_chunks, segment_ids, trim, word_spans

BUCKETS = 1 << 16


def features(data: np.ndarray, offs: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(buckets as words x 2, index of each row's first word). Buckets of the word and of the pair that it ends;
    BUCKETS where the pair would begin before its row."""
    s, e, first = word_spans(data, offs)
    out = np.full((len(s), 2), BUCKETS, np.int64)
    if len(s):
        h = range_hash(prefix_hash(data), s, e)
        out[:, 0] = mix(h) >> np.uint64(48)
        row = segment_ids(first)
        pair = (mix(h[:-1] * np.uint64(3) + h[1:]) >> np.uint64(48)).astype(np.int64)
        out[1:, 1] = np.where(row[1:] == row[:-1], pair, BUCKETS)
    return out, first


def _chunks(b: pa.RecordBatch, most: int = 1 << 20):
    data, offs = column_bytes(b["text"])
    for i, j in row_chunks(offs, most):
        yield i, j, *features(data[offs[i] : offs[j]], offs[i : j + 1] - offs[i])


def _count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    total = np.zeros(BUCKETS + 1, np.int64)
    for b in batches:
        for _, _, idx, _ in _chunks(b):
            total += np.bincount(idx.ravel(), minlength=BUCKETS + 1)
        trim()
    bucket = np.flatnonzero(total[:BUCKETS])
    yield pa.RecordBatch.from_arrays([pa.array(bucket.astype(np.int32)), pa.array(total[bucket])], ["bucket", "n"])


def counts(docs: DataFrame) -> np.ndarray:
    """How often each bucket occurs in the texts; BUCKETS numbers on the driver."""
    got = docs.select("text").mapInArrow(_count, "bucket int, n long").groupBy("bucket").agg(F.sum("n").alias("n")).toArrow()
    out = np.zeros(BUCKETS)
    out[got["bucket"].to_numpy()] = got["n"].to_numpy()
    return out


def fit(target: DataFrame, raw: DataFrame) -> np.ndarray:
    """Log ratio of each bucket's probability in target text to that in raw text; a last 0 for no n-gram. Without target words all are 0."""
    good = counts(target)
    if not good.sum():
        return np.zeros(BUCKETS + 1)
    good, all_ = good + 0.5, counts(raw) + 0.5
    return np.append(np.log(good / good.sum()) - np.log(all_ / all_.sum()), 0.0)


def _weigh(model, seed: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        ratio = model.value
        for b in batches:
            weight = np.zeros(len(b))
            for i, j, idx, first in _chunks(b):
                run_ = np.append(0.0, np.cumsum(ratio[idx].sum(axis=1)))
                weight[i:j] = run_[first[1:]] - run_[first[:-1]]
            ids = b["doc_id"].fill_null(-1).to_numpy(zero_copy_only=False).astype(np.int64).view(np.uint64)
            u = ((mix(ids * np.uint64(0x9E3779B97F4A7C15) + mix(np.array([seed], np.uint64))) >> np.uint64(12)).astype(np.float64) + 0.5) / (1 << 52)
            key = weight - np.log(-np.log(u))
            bits = (key + 0.0).view(np.int64)
            order = np.where(bits < 0, bits ^ np.int64(0x7FFFFFFFFFFFFFFF), bits)  # whole numbers in the order of the keys
            yield pa.RecordBatch.from_arrays([b["doc_id"], b["text_hash"], pa.array(weight), pa.array(key), pa.array(order)], ["doc_id", "text_hash", "log_weight", "sample_key", "key_order"])
            trim()

    return run


def kth_largest(values: DataFrame, column: str, k: int, digit: int = 14) -> int | None:
    """The k-th largest value of a long column, exactly: radix selection by ``digit`` bits, with 2**digit counts on the driver at most."""
    if k < 1:
        return None
    biased = F.col(column).bitwiseXOR(F.lit(-(1 << 63)))
    rest, prefix, shift = values.select(biased.alias("v")), 0, 64
    while shift:
        step = min(digit, shift)
        shift -= step
        part = F.shiftrightunsigned("v", shift).bitwiseAND(F.lit((1 << step) - 1))
        counts = sorted(((r.d, r.n) for r in rest.groupBy(part.alias("d")).agg(F.count("*").alias("n")).collect()), reverse=True)
        for d, n in counts:
            if k <= n:
                prefix = (prefix << step) | d
                rest = rest.filter(part == d)
                break
            k -= n
        else:
            return None
    prefix ^= 1 << 63
    return prefix - (1 << 64) if prefix >= 1 << 63 else prefix


def resample(docs: DataFrame, labels: DataFrame, keep: float | None = None, spare: float = 1.03, sample: int | None = None, seed: int = 42) -> DataFrame:
    """doc_id, text_hash, log_weight, sample_key, kept for every document.

    The target is the text of all rows with quality 1 in ``labels`` (doc_id, quality), or of about ``sample`` such rows taken by a hash of doc_id;
    raw text is that of all rows. The k largest keys stay, with all that tie the last of them; k is the share ``keep`` of all rows, and by
    default ``spare`` times the share of good ones among the labels, since near the border good ones fall behind by chance. The noise depends
    on doc_id alone. A text without words has log weight 0. Without labels of quality 1
    all stay. Labels that are null or of unknown documents don't count; of several labels of a document the largest does.
    """
    known = labels.filter("doc_id is not null and quality is not null").groupBy("doc_id").agg((F.max("quality") == 1).alias("good"))
    known = written(known.join(docs.select("doc_id").distinct(), "doc_id", "left_semi"), "labels")
    n, good = known.agg(F.count("*"), F.count_if("good")).first()
    target = known.filter("good").select("doc_id")
    if sample is not None and good > sample:
        target = target.filter(uniform(F.lit("fit"), F.col("doc_id")) < sample / good)
    ratio = fit(docs.select("doc_id", "text").join(target.hint("merge"), "doc_id"), docs)  # good ids grow with the rows: they are never broadcast
    model = docs.sparkSession.sparkContext.broadcast(ratio)  # BUCKETS numbers
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text", F.xxhash64(F.coalesce("text", F.lit(""))).alias("text_hash"))
    keys = written(rows.mapInArrow(_weigh(model, seed), "doc_id long, text_hash long, log_weight double, sample_key double, key_order long"), "quality-keys")
    share = (min(1.0, spare * good / n) if n and good else 1.0) if keep is None else keep
    least = kth_largest(keys, "key_order", math.ceil(share * keys.count())) if share < 1 else None
    kept = F.lit(True) if least is None else F.col("key_order") >= least
    return keys.select("doc_id", "text_hash", "log_weight", "sample_key", kept.alias("kept"))


def keep_quality(docs: DataFrame, labels: DataFrame, **options: float) -> DataFrame:
    """The rows of ``docs`` that :func:`resample` keeps, with all their columns. Null ids and repeated rows share their text's verdict."""
    id_, hash_ = free(docs.columns, "id", "hash")
    gone = resample(docs, labels, **options).filter("not kept").select(F.col("doc_id").alias(id_), F.col("text_hash").alias(hash_)).distinct()
    same = F.col("doc_id").cast("long").eqNullSafe(F.col(id_)) & (F.xxhash64(F.coalesce("text", F.lit(""))) == F.col(hash_))
    return docs.join(gone, same, "left_anti")
