"""Exact top-k search by inner product over sparse integer vectors, term at a time.

Queries and candidates are dealt into blocks of bounded size, and each pair of blocks is a task: the block of candidates
becomes an inverted index (for each dimension, the rows and weights of its postings), and every query row scatters
query weight times posting weight into a dense score array with one cell for each candidate. Partition selection keeps the
best k of the block, and the blocks' lists are merged by score, then by smaller id. All arithmetic is in 64-bit integers.
"""

from __future__ import annotations

import math

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

QUERY_BLOCK, ROW_BLOCK = 1024, 8192


def _matrix(col: pa.ChunkedArray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(row, dimension, weight) of the non-zero components."""
    a = col.combine_chunks()
    size = a.value_lengths().to_numpy(zero_copy_only=False)
    w = a.flatten().to_numpy(zero_copy_only=False)
    row = np.repeat(np.arange(len(size)), size)
    dim = np.arange(len(w)) - np.repeat(np.cumsum(size) - size, size)
    on = w != 0
    return row[on], dim[on], w[on]


def scores(query: tuple[np.ndarray, np.ndarray, np.ndarray], n_queries: int, cand: tuple[np.ndarray, np.ndarray, np.ndarray], n_cands: int):
    """Dense score arrays, one query after the other; each is valid until the next."""
    order = np.argsort(cand[1], kind="stable")
    rows, dims, weights = (x[order] for x in cand)
    last = int(max(dims[-1] if len(dims) else -1, query[1].max() if len(query[1]) else -1)) + 1
    post = np.searchsorted(dims, np.arange(last + 1))
    to = np.searchsorted(query[0], np.arange(n_queries + 1))
    acc = np.zeros(n_cands, np.int64)
    for q in range(n_queries):
        acc[:] = 0
        for d, w in zip(query[1][to[q] : to[q + 1]].tolist(), query[2][to[q] : to[q + 1]].tolist(), strict=True):
            a, b = post[d], post[d + 1]
            if b - a == n_cands:  # all rows, in order
                acc += w * weights[a:b]
            else:
                acc[rows[a:b]] += w * weights[a:b]  # a row stands once in a dimension's postings
        yield acc


def select(acc: np.ndarray, ids: np.ndarray, k: int, own: int) -> np.ndarray:
    """Positions of the k best by score, ties to smaller ids; the query's own id is left out."""
    keep = np.flatnonzero(ids != own)
    s = acc[keep]
    if len(keep) > k:
        least = np.partition(s, len(s) - k)[len(s) - k]
        keep, s = keep[s >= least], s[s >= least]
    return keep[np.lexsort((ids[keep], -s))[:k]]


def _tile(k: int):
    def run(t: pa.Table) -> pa.Table:
        is_query = t["is_query"].combine_chunks()
        q, c = t.filter(is_query), t.filter(pa.compute.invert(is_query))
        ids, own = c["id"].to_numpy(), q["id"].to_numpy()
        out: list[tuple[np.ndarray, ...]] = []
        if len(ids):
            for n, acc in enumerate(scores(_matrix(q["w"]), len(own), _matrix(c["w"]), len(ids))):
                best = select(acc, ids, k, own[n])
                out.append((np.full(len(best), own[n]), ids[best], acc[best]))
        cols = [np.concatenate([x[i] for x in out]) if out else np.zeros(0, np.int64) for i in range(3)]
        return pa.table({"query_id": cols[0], "vec_id": cols[1], "score": cols[2]})

    return run


def top_k(vectors: DataFrame, weights: Column, is_query: Column, k: int = 5, id_col: str = "vec_id", query_block: int = QUERY_BLOCK, row_block: int = ROW_BLOCK) -> DataFrame:
    """query_id, rank (from 1), vec_id, score: the k best candidates of each query by integer inner product.

    ``weights`` is an array of whole numbers, null where the row takes no part; components beyond the shorter of two vectors count
    as 0. Candidates are all rows but those with the query's own id; ties go to the smaller id. Rows with a null id take no part.
    Repeated candidate rows are candidates of their own; of query rows with one id the one with the largest vector asks. Fewer than k candidates give fewer rows.
    Other columns are not read.
    """
    rows = vectors.select(F.col(id_col).cast("long").alias("id"), weights.cast("array<long>").alias("w"), F.coalesce(is_query, F.lit(False)).alias("asks")).filter("id is not null and w is not null")
    n, asks = (x or 0 for x in rows.agg(F.count("*"), F.count_if("asks")).first())
    n_rows, n_asks = max(1, math.ceil(n / row_block)), max(1, math.ceil(asks / query_block))
    block = lambda many: F.pmod(F.xxhash64("id"), F.lit(many)).cast("int")
    every = lambda many: F.explode(F.sequence(F.lit(0), F.lit(many - 1)))
    cands = rows.select("id", "w", F.lit(False).alias("is_query"), block(n_rows).alias("rb"), every(n_asks).alias("qb"))
    queries = rows.filter("asks").groupBy("id").agg(F.max("w").alias("w")).select("id", "w", F.lit(True).alias("is_query"), every(n_rows).alias("rb"), block(n_asks).alias("qb"))
    tiles = queries.unionByName(cands).groupBy("rb", "qb").applyInArrow(_tile(k), "query_id long, vec_id long, score long")
    best = Window.partitionBy("query_id").orderBy(F.desc("score"), "vec_id")
    return tiles.withColumn("rank", F.row_number().over(best)).filter(F.col("rank") <= k).select("query_id", "rank", "vec_id", "score")
