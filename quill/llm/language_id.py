"""Language identification: multinomial naive Bayes over hashed character n-grams.

Training counts n-grams per language in numpy on the executors, sums them in Spark and turns them into a matrix of
log-probabilities of fixed size (languages x buckets), which is broadcast. Scoring gathers the matrix rows of a batch of
texts' n-grams and sums them text by text.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

BUCKETS = 1 << 16
ORDERS = 3  # n-grams of 1, 2 and 3 characters
MOST_LANGUAGES = 1000
_LETTER: np.ndarray | None = None


def _letters() -> np.ndarray:
    global _LETTER
    if _LETTER is None:
        _LETTER = np.fromiter((chr(i).isalpha() for i in range(0x110000)), bool, 0x110000)
    return _LETTER


def grams(texts: list[str]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(buckets as positions x orders, offsets of the texts, whether each text has a letter).

    Characters are lower-cased; what isn't a letter counts as a space. Texts get a space before and after;
    n-grams that would run into the next text have the bucket BUCKETS.
    """
    texts = [f" {t.lower()} " for t in texts]
    offs = np.append(0, np.cumsum([len(t) for t in texts]))
    codes = np.frombuffer("".join(texts).encode("utf-32-le", "replace"), np.uint32)
    letter = _letters()[codes]
    count = np.append(0, np.cumsum(letter))
    c = np.where(letter, codes, np.uint32(32))
    out = np.full((len(c), ORDERS), BUCKETS, np.int32)
    left = np.repeat(offs[1:], np.diff(offs)) - np.arange(len(c))  # characters to the text's end
    h = c * np.uint32(0x9E3779B1)
    for n in range(ORDERS):
        if n:
            h = h[:-1] * np.uint32(0x85EBCA6B) + c[n:] * np.uint32(0x9E3779B1) + np.uint32(n)
        if not len(h):
            break
        idx = ((h ^ (h >> np.uint32(15))) * np.uint32(0xC2B2AE35)) >> np.uint32(16)
        out[: len(h), n] = np.where(left[: len(h)] > n, idx, BUCKETS)
    return out, offs, count[offs[1:]] > count[offs[:-1]]


def _batches(batches: Iterator[pa.RecordBatch], chars: int = 400_000) -> Iterator[tuple[pa.RecordBatch, list[str | None]]]:
    for b in batches:
        texts = b["text"].to_pylist()
        i = 0
        while i < len(texts):
            j, size = i, 0
            while j < len(texts) and (j == i or size + len(texts[j] or "") <= chars):
                size += len(texts[j] or "")
                j += 1
            yield b.slice(i, j - i), texts[i:j]
            i = j


def _count(n_langs: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros((n_langs, BUCKETS + 1), np.int64)
        for b, texts in _batches(batches):
            idx, offs, _ = grams([t or "" for t in texts])
            lang = np.repeat(b["lang_i"].to_numpy(), np.diff(offs))
            flat = (lang[:, None].astype(np.int64) * (BUCKETS + 1) + idx).ravel()
            total += np.bincount(flat, minlength=total.size).reshape(total.shape)
        lang, bucket = np.nonzero(total[:, :BUCKETS])
        yield pa.RecordBatch.from_arrays([pa.array(lang.astype(np.int32)), pa.array(bucket.astype(np.int32)), pa.array(total[lang, bucket])], ["lang_i", "bucket", "n"])

    return run


def uniform(*key: Column) -> Column:
    """A number in [0, 1) that depends on the key alone."""
    return F.shiftrightunsigned(F.xxhash64(*key), 11).cast("double") / float(1 << 53)


def train(labelled: DataFrame, per_language: int = 4000) -> tuple[list[str], np.ndarray]:
    """(languages in order, float32 log-probabilities with one row for each bucket and a last row of zeros).

    ``labelled``: doc_id, text, lang. Rows with a null among them don't count. The sample is bounded: about ``per_language``
    rows of each language, taken by a hash of doc_id. There may be at most MOST_LANGUAGES languages.
    """
    rows = labelled.select("doc_id", "text", "lang").dropna()
    found = rows.groupBy("lang").agg(F.count("*").alias("n")).limit(MOST_LANGUAGES + 1).collect()
    if len(found) > MOST_LANGUAGES:
        raise ValueError(f"more than {MOST_LANGUAGES} languages")
    counts = {r.lang: r.n for r in found}
    langs = sorted(counts)
    if not langs:
        return [], np.zeros((BUCKETS + 1, 0), np.float32)
    share = F.create_map(*(F.lit(x) for k in langs for x in (k, per_language / counts[k])))
    number = F.create_map(*(F.lit(x) for i, k in enumerate(langs) for x in (k, i)))
    sample = rows.filter(uniform(F.lit("train"), F.col("doc_id")) < share[F.col("lang")]).select("text", number[F.col("lang")].alias("lang_i"))
    got = sample.mapInArrow(_count(len(langs)), "lang_i int, bucket int, n long").groupBy("lang_i", "bucket").agg(F.sum("n").alias("n")).toArrow()
    n = np.zeros((BUCKETS + 1, len(langs)))
    n[got["bucket"].to_numpy(), got["lang_i"].to_numpy()] = got["n"].to_numpy()
    n[:BUCKETS] += 0.5
    logp = np.log(n[:BUCKETS] / n[:BUCKETS].sum(axis=0))
    return langs, np.vstack([logp, np.zeros(len(langs))]).astype(np.float32)


def _score(model):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        langs, logp = model.value
        names = np.array([*langs, "und"], object)
        for b, texts in _batches(batches):
            idx, offs, known = grams([t or "" for t in texts])
            if not langs:
                best, score = np.zeros(len(texts), np.int64), np.zeros(len(texts))
            else:
                gathered = logp[idx[:, 0]].astype(np.float64)
                for n in range(1, ORDERS):
                    gathered += logp[idx[:, n]]
                total = np.add.reduceat(gathered, offs[:-1], axis=0)
                best = total.argmax(axis=1)
                score = np.where(known, 1 / np.exp(total - total.max(axis=1, keepdims=True)).sum(axis=1), 0.0)
                best = np.where(known, best, len(langs))
            more = [pa.array(names[best], pa.string()), pa.array(score, pa.float64())]
            yield pa.RecordBatch.from_arrays([*(b[c] for c in b.schema.names if c != "text"), *more], [*(c for c in b.schema.names if c != "text"), "lang_pred", "score"])

    return run


def predict(docs: DataFrame, langs: list[str], logp: np.ndarray, keep: tuple[str, ...] = ("doc_id",)) -> DataFrame:
    """``keep`` columns, lang_pred and score (the posterior of the prediction under equal priors).

    Only the text is used. A null text, or one without a letter, has lang_pred ``und`` and score 0, as has every text where
    nothing was learned. Ties go to the first language in order.
    """
    model = docs.sparkSession.sparkContext.broadcast((langs, logp))  # languages x buckets, bounded
    rows = docs.select(*keep, "text")
    schema = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in rows.schema if f.name != "text")
    return rows.mapInArrow(_score(model), f"{schema}, lang_pred string, score double")


def held_out(doc_id: Column) -> Column:
    """Whether crc32 of the id's decimal text is divisible by 5; false for a null id."""
    return F.coalesce(F.crc32(F.encode(doc_id.cast("string"), "utf-8")) % 5 == 0, F.lit(False))


def identify(docs: DataFrame, per_language: int = 4000) -> DataFrame:
    """doc_id, held_out, lang_pred, score for every row; learned from the rows that aren't held out. A null doc_id teaches nothing."""
    learn = docs.filter(~held_out(F.col("doc_id")) & F.col("doc_id").isNotNull())
    langs, logp = train(learn, per_language)
    return predict(docs, langs, logp).select("doc_id", held_out(F.col("doc_id")).alias("held_out"), "lang_pred", "score")
