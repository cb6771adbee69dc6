"""Mixing sources to target weights by iterative proportional fitting.

Token counts by (source, lang, topic) are raked until their three marginals meet the targets; a cell's raked weight over the
tokens it has gives the probability by which each of its documents is sampled.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import free, written
from .language_id import uniform
from .textnp import column_bytes, lower_ascii, mix as scramble, prefix_hash, range_hash, row_chunks, segment_ids, trim, word_spans

DIMS = ("source", "lang", "topic")
NONE = "(none)"
#: Marginals by default: the share of tokens to this power, so 1 keeps shares and 0 makes them equal.
TEMPERATURES = {"source": 0.7, "lang": 0.7, "topic": 1.0}


def n_tokens(text: Column) -> Column:
    """Words between ASCII white space, and one for the end of the document; null counts as empty."""
    return F.regexp_count(F.coalesce(text, F.lit("")), F.lit(r"[^\x20\x09-\x0D]+")).cast("long") + 1


# --- topics: clusters of documents by their words ---------------------------------------------

DIMS_OF_WORDS = 512
#: Parts of one in components of vectors, and vectors that stand in one row of a table.
SCALE, ROWS_AT_ONCE = 1 << 14, 256
#: No centred vector is longer; a move of a centre, in parts of one, from which on vectors are settled; how many such moves they are settled for.
LONGEST, NEAR, AHEAD = SCALE + DIMS_OF_WORDS, 0.02, 4


def word_vectors(data: np.ndarray, offs: np.ndarray) -> np.ndarray:
    """Root counts of hashed words of each row (A-Z in lower case), of length 1; zeros without words."""
    data = lower_ascii(data)
    s, e, first = word_spans(data, offs)
    n = len(offs) - 1
    bucket = (scramble(range_hash(prefix_hash(data), s, e)) % np.uint64(DIMS_OF_WORDS)).astype(np.int64)
    out = np.sqrt(np.bincount(segment_ids(first) * DIMS_OF_WORDS + bucket, minlength=n * DIMS_OF_WORDS)).astype(np.float32).reshape(n, -1)
    return out / np.maximum(np.linalg.norm(out, axis=1, keepdims=True), 1e-9)


def _whole(data: np.ndarray, offs: np.ndarray) -> np.ndarray:
    """:func:`word_vectors` in whole numbers of ``1 / SCALE``: sums and products of these are exact, so no result depends on how rows are dealt out."""
    return np.rint(word_vectors(data, offs) * SCALE).astype(np.int16)


def _row(order: np.ndarray, x: np.ndarray) -> pa.RecordBatch:
    none = pa.nulls(1, pa.int64())
    return pa.RecordBatch.from_arrays([pa.array([order.astype(np.int64).tobytes()], pa.binary()), pa.array([x.astype(np.int16).tobytes()], pa.binary()), none, none], ["orders", "vectors", "slot", "total"])


def _vectors(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(orders, vectors) of texts with words, up to ``ROWS_AT_ONCE`` to a row: Spark handles a row of many vectors for the price of one. Then the vector of the task's least order, marked, and the task's sums, the number of vectors first."""
    total, first = np.zeros(1 + DIMS_OF_WORDS, np.int64), None
    for b in batches:
        orders = b["order"].to_numpy(zero_copy_only=False)
        for i, j, data, offs in _parts(b["text"]):
            x = _whole(data, offs)
            some = x.any(axis=1)
            x, order = x[some], orders[i:j][some]
            total += np.append(len(x), x.sum(axis=0, dtype=np.int64))
            for k in range(0, len(x), ROWS_AT_ONCE):
                yield _marked(_row(order[k : k + ROWS_AT_ONCE], x[k : k + ROWS_AT_ONCE]))
            first = _lesser(first, np.zeros(len(x)), order, x)
        trim()
    yield _marked(_nothing(), first)
    yield _marked(_sums(total))


_MARK = "near double, order long, mark binary"


def _lesser(best: tuple | None, near: np.ndarray, order: np.ndarray, x: np.ndarray) -> tuple | None:
    """Of ``best`` and the vectors the one with the least (near, order): these and the vector."""
    if not len(x):
        return best
    k = int(np.lexsort((order, near))[0])
    return best if best is not None and best[:2] <= (near[k], order[k]) else (float(near[k]), int(order[k]), x[k].astype(np.int16).tobytes())


def _marked(rows: pa.RecordBatch, best: tuple | None = None) -> pa.RecordBatch:
    """The rows with what :func:`_lesser` gave, if there is anything, as columns."""
    for name, kind, v in zip(("near", "order", "mark"), (pa.float64(), pa.int64(), pa.binary()), best or (None,) * 3, strict=True):
        rows = rows.append_column(name, pa.array([v] * len(rows), kind))
    return rows


def _least(rows: DataFrame) -> np.ndarray:
    """The least of the tasks' marked vectors."""
    best = rows.filter("mark is not null").agg(F.min(F.struct("near", "order", "mark")).alias("m")).first()["m"]
    return np.frombuffer(best["mark"], np.int16)[None].astype(float)


def _parts(text: pa.Array) -> Iterator[tuple[int, int, np.ndarray, np.ndarray]]:
    data, offs = column_bytes(text)
    for i, j in row_chunks(offs, 1 << 19):
        yield i, j, data[offs[i] : offs[j]], offs[i : j + 1] - offs[i]


def _centred(x: np.ndarray, mean: np.ndarray) -> np.ndarray:
    """Whole vectors less the mean, of length ``SCALE`` again, in whole numbers (as doubles)."""
    x = x - mean
    return np.rint(x * (SCALE / np.maximum(np.sqrt((x * x).sum(axis=1, keepdims=True)), 1)))


def _blocks(b: pa.RecordBatch) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """(order, vectors as whole doubles) of each row."""
    for order, x in zip(b["orders"], b["vectors"], strict=True):
        yield np.frombuffer(order.as_buffer(), np.int64), np.frombuffer(x.as_buffer(), np.int16).reshape(-1, DIMS_OF_WORDS).astype(float)


def _centred_rows(mean: np.ndarray, centres: np.ndarray) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    """(orders, vectors less the mean); then the task's vector that is least like its nearest centre, marked."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        best = None
        for b in batches:
            for order, x in _blocks(b):
                x = _centred(x, mean)
                yield _marked(_row(order, x).select(["orders", "vectors"]))
                best = _lesser(best, (x @ centres.T).max(axis=1), order, x)
        yield _marked(_nothing().select(["orders", "vectors"]), best)

    return run


_KINDS = "orders binary, vectors binary, slot long, total long"


def _nothing() -> pa.RecordBatch:
    """One row of nulls."""
    return pa.RecordBatch.from_arrays([pa.nulls(1, t) for t in (pa.binary(), pa.binary(), pa.int64(), pa.int64())], ["orders", "vectors", "slot", "total"])


def _sums(total: np.ndarray) -> pa.RecordBatch:
    """Rows (slot, total) of a task's sums, for a table that also holds vectors."""
    at = np.flatnonzero(total)
    none = pa.nulls(len(at), pa.binary())
    return pa.RecordBatch.from_arrays([none, none, pa.array(at), pa.array(total[at])], ["orders", "vectors", "slot", "total"])


def _added(rows: DataFrame, slots: int) -> np.ndarray:
    """The sums over all tasks of rows (slot, total)."""
    got = rows.filter("slot is not null").groupBy("slot").agg(F.sum("total").alias("total")).toArrow()
    out = np.zeros(slots, np.int64)
    out[got["slot"].to_numpy()] = got["total"].to_numpy()
    return out


def _by_centre(x: np.ndarray, near: np.ndarray) -> np.ndarray:
    """For each centre how many of the vectors are nearest to it, and their sum; ``near`` holds their products with the centres."""
    own = (np.arange(near.shape[1])[:, None] == near.argmax(axis=1)).astype(float)
    return np.hstack([own.sum(axis=1, keepdims=True), own @ x]).ravel().astype(np.int64)


def _round(vectors: DataFrame, centres: np.ndarray) -> np.ndarray:
    """:func:`_by_centre` over all vectors."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros(len(centres) * (1 + DIMS_OF_WORDS), np.int64)
        for b in batches:
            for _, x in _blocks(b):
                total += _by_centre(x, x @ centres.T)
        yield _sums(total).select(["slot", "total"])

    return _added(vectors.mapInArrow(run, "slot long, total long"), len(centres) * (1 + DIMS_OF_WORDS))


def _parted(vectors: DataFrame, centres: np.ndarray, margin: float) -> tuple[DataFrame, np.ndarray]:
    """(vectors whose product with their nearest centre is at most ``margin`` above that with another, :func:`_by_centre` over all other vectors)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros(len(centres) * (1 + DIMS_OF_WORDS), np.int64)
        for b in batches:
            for order, x in _blocks(b):
                near = x @ centres.T
                two = np.partition(near, len(centres) - 2, axis=1)[:, -2:]
                open_ = two[:, 1] - two[:, 0] <= margin
                total += _by_centre(x[~open_], near[~open_])
                if open_.any():
                    yield _row(order[open_], x[open_])
        yield _sums(total)

    got = written(vectors.mapInArrow(run, _KINDS), "parted")
    return got.filter("vectors is not null").select("orders", "vectors"), _added(got, len(centres) * (1 + DIMS_OF_WORDS))


def _farthest(vectors: DataFrame, centres: np.ndarray) -> np.ndarray:
    """The vector that is least like its nearest centre; of several the one with the least order."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        best = None
        for b in batches:
            for order, x in _blocks(b):
                best = _lesser(best, (x @ centres.T).max(axis=1), order, x)
        yield _marked(_nothing(), best).select(["near", "order", "mark"])

    return _least(vectors.mapInArrow(run, _MARK))


def topic_model(docs: DataFrame, topics: int = 8, rounds: int = 30) -> tuple[np.ndarray, np.ndarray]:
    """(mean, centres) of spherical k-means over the vectors of all texts with words, less their mean.

    The first centre is the text with the least hash, each next the one farthest from those before; the steps that write the vectors find the first two. Rounds add up all vectors, 1 kB each and written
    once with and once without the mean, by centre in the tasks: the driver gets one total for each component of each centre. Once centres move little,
    vectors whose nearest centre leads by more than their moves can make up for stay added up, and rounds read the others alone, which changes no sum.
    """
    rows = docs.filter("text is not null").select("text", F.xxhash64("text").alias("order"))
    vectors = written(rows.mapInArrow(_vectors, f"{_KINDS}, {_MARK}"), "vectors")
    n, *sums = _added(vectors, 1 + DIMS_OF_WORDS).tolist()
    mean = np.rint(np.array(sums) / max(n, 1))
    if not min(topics, n):
        return mean, np.zeros((0, DIMS_OF_WORDS))
    centres = _centred(_least(vectors), mean)
    vectors = written(vectors.filter("vectors is not null").select("orders", "vectors").mapInArrow(_centred_rows(mean, centres), f"orders binary, vectors binary, {_MARK}"), "centred")
    if min(topics, n) > 1:
        centres = np.vstack([centres, _least(vectors)])
    vectors = vectors.filter("vectors is not null").select("orders", "vectors")
    while len(centres) < min(topics, n):
        centres = np.vstack([centres, _farthest(vectors, centres)])
    moved, margin, open_, settled, base = np.inf, -1.0, vectors, 0, centres
    for _ in range(rounds):
        if 2 * LONGEST * _move(centres, base) >= margin and len(centres) > 1:  # someone settled might have another nearest centre by now
            margin, open_, settled, base = -1.0, vectors, 0, centres
            if moved < NEAR * SCALE:
                margin = 2 * LONGEST * AHEAD * moved
                open_, settled = _parted(vectors, centres, margin)
        got = (settled + _round(open_, centres)).reshape(len(centres), -1).astype(float)
        new = np.rint(got[:, 1:] * (SCALE / np.maximum(np.linalg.norm(got[:, 1:], axis=1, keepdims=True), 1)))
        new = np.where(got[:, :1] > 0, new, centres)
        moved = _move(new, centres)
        if not moved:
            break
        centres = new
    return mean, centres


def _move(new: np.ndarray, old: np.ndarray) -> float:
    return float(np.linalg.norm(new - old, axis=1).max(initial=0.0))


def topic_of(text: Column | str, model: tuple[np.ndarray, np.ndarray]) -> Column:
    """The nearest centre of a text, as t0, t1, ..; ``NONE`` for a text without words or null."""
    mean, centres = model

    def run(col: pa.Array) -> pa.Array:
        out: list[str] = []
        for _, _, data, offs in _parts(col):
            x = _whole(data, offs)
            near = (_centred(x, mean) @ centres.T).argmax(axis=1) if len(centres) else np.zeros(len(x), np.int64)
            out += [f"t{t}" if some else NONE for t, some in zip(near.tolist(), x.any(axis=1).tolist(), strict=True)]
        trim()
        return pa.array(out, pa.string())

    return F.arrow_udf(run, "string")(text)


# --- raking -----------------------------------------------------------------------------------


def rake(tokens: np.ndarray, codes: list[np.ndarray], targets: list[np.ndarray], tolerance: float = 1e-9, rounds: int = 500) -> np.ndarray:
    """Weights in proportion to ``tokens`` along every interaction whose marginals are ``targets`` (each sums to 1)."""
    w = tokens / tokens.sum()
    for _ in range(rounds):
        worst = 0.0
        for code, target in zip(codes, targets, strict=True):
            have = np.bincount(code, w, len(target))
            factor = np.divide(target, have, out=np.zeros(len(target)), where=have > 0)
            w = w * factor[code]
            on = target > 0
            worst = max(worst, float(np.abs(have[on] / target[on] - 1).max()) if on.any() else 0.0)
        if worst < tolerance:
            break
    return w


def scale(tokens: np.ndarray, ratio: np.ndarray, least_share: float) -> np.ndarray:
    """Probabilities min(1, t * ratio): t is the largest at which none is cut to 1, or, where that would leave less than ``least_share`` of
    all tokens, the one that leaves so much."""
    top = ratio.max(initial=0.0)
    if top <= 0:
        return np.zeros(len(ratio))
    p = ratio / top
    want = least_share * tokens.sum()
    if (p * tokens).sum() >= want:
        return p
    order = np.argsort(-ratio)
    r, n = ratio[order], tokens[order]
    whole = np.append(0, np.cumsum(n))[:-1]  # tokens of the cells before, kept whole
    rest = (r * n)[::-1].cumsum()[::-1]
    t = np.divide(want - whole, rest, out=np.full(len(r), np.inf), where=rest > 0)
    ok = np.flatnonzero(np.isfinite(t) & (np.where(np.isfinite(t), t, 0) * r <= 1 + 1e-12))
    return np.minimum(1.0, ratio * (t[ok[0]] if len(ok) else 1 / r[r > 0].min()))


def _targets(cells: DataFrame, dim: str, given: dict[str, float] | None) -> DataFrame:
    """(dim, target): given weights of the values that occur, or tempered shares; they sum to 1."""
    have = cells.groupBy(dim).agg(F.sum("tokens").alias("n"))
    if given is None:
        raw = have.select(dim, F.pow("n", F.lit(TEMPERATURES[dim])).alias("raw"))
    else:
        known = cells.sparkSession.createDataFrame([(str(k), float(v)) for k, v in given.items()], f"{dim} string, raw double")
        raw = have.join(known, dim, "left").select(dim, F.coalesce("raw", F.lit(0.0)).alias("raw"))
    total = raw.agg(F.sum("raw")).first()[0] or 1.0
    return raw.select(dim, (F.col("raw") / F.lit(total)).alias("target"))


def _rake_frames(cells: DataFrame, targets: dict[str, DataFrame], least_share: float, tolerance: float = 1e-9, rounds: int = 500) -> DataFrame:
    """The same fitting as joins and aggregations, for more cells than the driver should hold: it ends as :func:`rake` does, or at a round that
    changes no weight, after which none would."""
    cells = cells.withColumn("w", F.col("tokens").cast("double"))
    total = cells.agg(F.sum("w")).first()[0]
    cells = cells.withColumn("w", F.col("w") / F.lit(total))
    for _ in range(rounds):
        cells = cells.withColumn("old", F.col("w")).withColumn("worst", F.lit(0.0))
        for dim, target in targets.items():
            have = cells.groupBy(dim).agg(F.sum("w").alias("have")).join(target, dim)
            error = F.when(F.col("target") > 0, F.abs(F.col("have") / F.col("target") - 1)).otherwise(0.0)
            have = have.select(dim, (F.col("target") / F.greatest("have", F.lit(1e-300))).alias("factor"), error.alias("error"))
            cells = cells.join(have, dim).withColumn("w", F.col("w") * F.col("factor")).withColumn("worst", F.greatest("worst", "error")).drop("factor", "error")
        cells = written(cells, "raked")
        worst, change = cells.agg(F.max("worst"), F.max(F.when(F.col("old") > 0, F.abs(F.col("w") / F.col("old") - 1)).otherwise(0.0))).first()
        cells = cells.drop("old", "worst")
        if worst < tolerance or change < 1e-14:
            break
    cells = cells.withColumn("ratio", F.col("w") / F.col("tokens"))
    top, total = cells.agg(F.max("ratio"), F.sum("tokens")).first()
    left = lambda t: cells.agg(F.sum(F.least(F.lit(1.0), F.col("ratio") * t) * F.col("tokens"))).first()[0]
    low = 1 / top
    if left(low) < least_share * total:
        high = low
        while left(high) < least_share * total and high < low * 2.0**60:
            high *= 2
        for _ in range(40):
            mid = (low + high) / 2
            low, high = (mid, high) if left(mid) < least_share * total else (low, mid)
        low = high
    return cells.select(*DIMS, F.least(F.lit(1.0), F.col("ratio") * low).alias("p"))


def probabilities(cells: DataFrame, given: dict[str, dict[str, float]], least_share: float, most_cells: int) -> tuple[DataFrame, bool]:
    """((source, lang, topic, p), whether it is small) for cells (source, lang, topic, tokens).

    Up to ``most_cells`` cells are fitted on the driver; above, in DataFrames.
    """
    spark = cells.sparkSession
    targets = {d: _targets(cells, d, given.get(d)) for d in DIMS}
    rows = cells.limit(most_cells + 1).toPandas()
    if len(rows) > most_cells:
        return written(_rake_frames(cells, targets, least_share), "mix"), False
    schema = "source string, lang string, topic string, p double"
    if not len(rows):
        return spark.createDataFrame([], schema), True
    codes, wanted = [], []
    for d in DIMS:
        t = targets[d].toPandas().sort_values(d)
        codes.append(np.searchsorted(t[d].to_numpy(object), rows[d].to_numpy(object)))
        wanted.append(t["target"].to_numpy(float))
    tokens = rows["tokens"].to_numpy(float)
    p = scale(tokens, rake(tokens, codes, wanted) / tokens, least_share)
    return spark.createDataFrame([(*k, float(x)) for k, x in zip(rows[list(DIMS)].itertuples(index=False, name=None), p, strict=True)], schema), True


def mix(docs: DataFrame, weights: dict[str, dict[str, float]] | None = None, least_share: float = 0.25, topic: Column | None = None, most_cells: int = 100_000, seed: int = 7, tokens: Column | None = None) -> DataFrame:
    """All input columns plus mix_topic, mix_tokens, mix_probability and mix_kept, which replace input columns of these names; one row for each input row.

    ``weights`` may give target weights for "source", "lang" and "topic" (value -> weight; a null value is "(none)", values not named
    get 0, values that don't occur are left out); without them a marginal is the shares of tokens, tempered. Every document of a
    cell has the same probability, so token weights meet the targets in expectation, unless more than 1 would be needed to
    leave ``least_share`` of all tokens. ``topic`` is a document's topic, by default its cluster by words (:func:`topic_model`). ``tokens`` is a document's number of tokens, by default its words and one for its end; null or less than
    1 counts as 1; it is worked out once for each row. A document is sampled by a hash of its doc_id and text, so repeated rows share their fate.
    """
    results = ("mix_topic", "mix_tokens", "mix_probability", "mix_kept")
    named = [c for c in docs.columns if c.lower() not in results]
    own = free([*docs.columns, *results], *(f"own{k}" for k in range(len(named))))  # names with dots and such go through unread
    source, lang = free([*docs.columns, *own], "source_cell", "lang_cell")
    value = lambda c: F.coalesce(F.col(c).cast("string"), F.lit(NONE))
    text = F.col("text")
    keyed = docs.select(
        *(F.col(f"`{c}`").alias(a) for c, a in zip(named, own, strict=True)),
        value("source").alias(source),
        value("lang").alias(lang),
        (topic_of("text", topic_model(docs)) if topic is None else F.coalesce(topic.cast("string"), F.lit(NONE))).alias("mix_topic"),
        (n_tokens(text) if tokens is None else F.greatest(F.coalesce(tokens.cast("long"), F.lit(1)), F.lit(1))).alias("mix_tokens"),
    )
    keyed = written(keyed, "keyed")  # topics and tokens are dear, and the rows are read twice
    cells = written(keyed.groupBy(F.col(source).alias("source"), F.col(lang).alias("lang"), F.col("mix_topic").alias("topic")).agg(F.sum("mix_tokens").alias("tokens")), "cells")
    p, small = probabilities(cells, weights or {}, least_share, most_cells)
    p = p.select(F.col("source").alias(source), F.col("lang").alias(lang), F.col("topic").alias("mix_topic"), F.col("p").alias("mix_probability"))
    out = keyed.join(F.broadcast(p) if small else p, [source, lang, "mix_topic"])  # at most most_cells rows
    of = lambda name: F.col(next(a for c, a in zip(named, own, strict=True) if c.lower() == name))
    kept = uniform(F.lit(seed), of("doc_id"), F.coalesce(of("text"), F.lit(""))) < F.col("mix_probability")
    return out.select(*(F.col(a).alias(c) for c, a in zip(named, own, strict=True)), "mix_topic", "mix_tokens", "mix_probability", kept.alias("mix_kept"))
