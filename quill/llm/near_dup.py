"""Near-duplicate detection with SetSketch registers.

1. *Sketch.* Each text's set of word shingles gives registers: the least of exponentially distributed hashes, on a logarithmic scale
   of base 1.001 and truncated to 16 bits. Registers of a union are the larger of both, so sketches merge; the share of equal
   registers follows the sets' similarity.
2. *Classes.* Texts of the same words in the same order, by SHA-256, are one class; only one text of each goes on.
3. *Bands.* Sets that share one of 56 bands of 5 registers meet in its bucket. Every member of a bucket is tied to the
   bucket's smallest class, and the ties' connected components are the candidate groups; pairs are never listed. Large groups, which
   chance ties may hold together, are taken apart first: sketches alone are compared there, and near ones form the groups.
4. *Links.* A group's sketches and texts meet in one task. Each class's similarity with those not yet linked to it is
   estimated by maximum likelihood from the registers that are equal, larger and smaller; what comes within 0.15 (six
   standard deviations) of the threshold is verified on the full sets of shingles, word by word. Groups above a size are dealt into blocks, and each
   pair of blocks is a task; the links found are joined by connected components again.
"""

from __future__ import annotations

import hashlib
import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import doc_key, free, join_hot, written
from .components import connected_components
from .textnp import column_bytes, lower_ascii, mix, prefix_hash, range_hash, row_chunks, trim, word_bytes, word_spans

BANDS, ROWS = 56, 5
M = BANDS * ROWS
BASE, RATE = 1.001, 20.0
SPREAD, SMALL = 16, 256
_rng = np.random.default_rng(20260)
_A = _rng.integers(0, 1 << 32, M, dtype=np.uint64).astype(np.uint32) | np.uint32(1)
_C = _rng.integers(0, 1 << 32, M, dtype=np.uint64).astype(np.uint32)


def shingles(data: np.ndarray, offs: np.ndarray, size: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(numbers of distinct shingles, row offsets, hashes of the shingles). Words are compared with A-Z in lower case; a row of fewer words
    than ``size`` has them all as its one shingle, a row without words has none. Equal numbers mean equal words, byte for byte: words
    are numbered by a dictionary and shingles by their words' numbers; the hashes are for sketches alone."""
    data = lower_ascii(data)
    s, e, first = word_spans(data, offs)
    n = np.diff(first)
    count = np.where(n >= size, n - size + 1, np.minimum(n, 1))
    to = np.append(0, np.cumsum(count))
    if not to[-1]:
        return np.zeros(0, np.int64), to, np.zeros(0, np.uint64)
    lens = e - s
    inside = np.zeros(len(data) + 1, np.int8)
    inside[s] += 1
    inside[e] -= 1
    words = pa.Array.from_buffers(pa.large_binary(), len(s), [None, pa.py_buffer(np.append(0, np.cumsum(lens))), pa.py_buffer(data[np.cumsum(inside[:-1], dtype=np.int8).astype(bool)])]).dictionary_encode()
    code, (letters, at) = words.indices.to_numpy().astype(np.int64), column_bytes(words.dictionary)
    h = range_hash(prefix_hash(letters), at[:-1], at[1:])
    row = np.repeat(np.arange(len(n)), count)
    at = first[:-1][row] + np.arange(len(row)) - to[row]
    end = first[1:][row]
    number, key = np.zeros(len(at), np.int64), np.zeros(len(at), np.uint64)
    for k in range(size):
        there, word = at + k < end, code[np.minimum(at + k, len(code) - 1)]
        key = np.where(there, mix(key * np.uint64(3) + h[word]), key)
        number = (number << 32) | np.where(there, word + 1, 0)
        if k < size - 1:
            number = pa.array(number).dictionary_encode().indices.to_numpy().astype(np.int64)
    number = pa.array(number).dictionary_encode().indices.to_numpy().astype(np.int64)
    order = np.argsort((row << 32) | number)
    number, row, key = number[order], row[order], key[order]
    new = np.append(True, (number[1:] != number[:-1]) | (row[1:] != row[:-1]))
    return number[new], np.searchsorted(row[new], np.arange(len(n) + 1)), key[new]


def word_digests(data: np.ndarray, offs: np.ndarray) -> list[bytes]:
    """SHA-256 of each row's words, in lower case with one space between."""
    space = ~word_bytes(data)
    keep = ~space
    keep[1:] |= space[1:] & ~space[:-1]
    raw = np.where(space[keep], np.uint8(32), lower_ascii(data[keep])).tobytes()
    at = np.append(0, np.cumsum(keep))[offs].tolist()
    return [hashlib.sha256(raw[i:j].strip(b" ")).digest() for i, j in zip(at[:-1], at[1:], strict=True)]


def registers(keys: np.ndarray, to: np.ndarray) -> np.ndarray:
    """SetSketch registers (rows x M, unsigned 16 bit) of the sets; an empty set has zeros."""
    n = len(to) - 1
    out = np.zeros((n, M), np.uint16)
    some = np.diff(to) > 0
    if not some.any():
        return out
    h, at = (keys >> np.uint64(32)).astype(np.uint32), to[:-1][some]
    least = np.empty((int(some.sum()), M), np.uint32)
    for r in range(M):
        least[:, r] = np.minimum.reduceat(h * _A[r] + _C[r], at)
    x = -np.log1p(-(least + 0.5) / 2.0**32)
    out[some] = np.clip(np.floor(1 - np.log(x / RATE) / math.log(BASE)), 0, 65535).astype(np.uint16)
    return out


def merge(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Registers of the union."""
    return np.maximum(a, b)


_GRID = np.linspace(0, 1, 201)


def estimate(n_a: float, n_b: np.ndarray, larger: np.ndarray, smaller: np.ndarray, m: int = M) -> np.ndarray:
    """Similarity of set a with each set b by maximum likelihood, given both sizes and how many of a's registers are larger and smaller."""
    u = n_a / (n_a + n_b)
    v = 1 - u
    most = np.minimum(n_a, n_b) / np.maximum(n_a, n_b)
    j = _GRID[None, :] * most[:, None]

    def p(x: np.ndarray) -> np.ndarray:
        return np.clip(-np.log1p(-np.clip(x, 0, 1) * (BASE - 1) / BASE) / math.log(BASE), 1e-12, 1)

    up, down = p(u[:, None] - v[:, None] * j), p(v[:, None] - u[:, None] * j)
    like = larger[:, None] * np.log(up) + smaller[:, None] * np.log(down) + (m - larger - smaller)[:, None] * np.log(np.clip(1 - up - down, 1e-12, 1))
    return np.take_along_axis(j, like.argmax(axis=1)[:, None], 1)[:, 0]


def link(regs: np.ndarray, size: np.ndarray, percent: int, sets: tuple[np.ndarray, np.ndarray] | None = None, margin: float = 0.15, left: int | None = None) -> np.ndarray:
    """Component number of every set, links being pairs with 100 * intersection >= percent * union.

    ``sets`` are the shingles' numbers and row offsets, on which links are verified; without them the estimate alone counts, ``margin`` below the
    threshold. A pair is left out only where both are in one component already, or where the estimate is more than ``margin`` too small.
    With ``left``, only pairs of a set before that place and one from it on count.
    """
    n = len(regs)
    comp = np.arange(n)
    if sets is not None:
        keys, to = sets
        mark = np.zeros(int(keys.max()) + 1 if len(keys) else 1, bool)
    for a in range(n if left is None else left):
        rest = np.arange(a + 1 if left is None else left, n)
        rest = rest[(comp[rest] != comp[a]) & (100 * np.minimum(size[rest], size[a]) >= percent * np.maximum(size[rest], size[a]))]
        if not len(rest):
            continue
        x, y = regs[a][None, :], regs[rest]
        equal = (x == y).sum(axis=1)
        # a register is equal with a chance of about the similarity; far below it the likelihood needn't be worked out
        rest, y = rest[equal >= (percent / 100 - 2 * margin) * M], y[equal >= (percent / 100 - 2 * margin) * M]
        if not len(rest):
            continue
        hit = rest[estimate(size[a], size[rest].astype(float), (x > y).sum(axis=1), (x < y).sum(axis=1)) >= percent / 100 - margin]
        if len(hit) and sets is not None:
            mark[keys[to[a] : to[a + 1]]] = True
            lens = size[hit]
            begin = np.cumsum(lens) - lens
            at = np.repeat(to[hit] - begin, lens) + np.arange(int(lens.sum()))
            inter = np.add.reduceat(mark[keys[at]].astype(np.int64), begin)
            mark[keys[to[a] : to[a + 1]]] = False
            hit = hit[100 * inter >= percent * (size[a] + lens - inter)]
        if len(hit):
            joined = np.append(comp[hit], comp[a])
            comp[np.isin(comp, joined)] = joined.min()
    return comp


def _sketch(size: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            data, offs = column_bytes(b["text"])
            for i, j in row_chunks(offs, 1 << 19):
                part, at = data[offs[i] : offs[j]], offs[i : j + 1] - offs[i]
                _, to, keys = shingles(part, at, size)
                regs = registers(keys, to)
                yield pa.RecordBatch.from_arrays(
                    [b["did"].slice(i, j - i), b["dth"].slice(i, j - i), pa.array(np.diff(to)), pa.array(word_digests(part, at), pa.binary()), pa.array([x.tobytes() for x in regs], pa.binary())],
                    ["did", "dth", "n", "digest", "regs"],
                )
            trim()

    return run


def _registers_of(col: pa.Array) -> np.ndarray:
    return np.frombuffer(b"".join(col.to_pylist()), np.uint16).reshape(-1, M)


def _bands(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for b in batches:
        if not len(b):
            continue
        regs = _registers_of(b["regs"]).astype(np.uint64).reshape(-1, BANDS, ROWS)
        key = np.repeat(np.arange(BANDS, dtype=np.uint64)[None, :], len(regs), axis=0)
        for r in range(ROWS):
            key = mix(key * np.uint64(65537) + regs[:, :, r] + np.uint64(1))
        node = b["node"].to_numpy()
        yield pa.RecordBatch.from_arrays([pa.array(key.ravel().view(np.int64)), pa.array(np.repeat(node, BANDS))], ["bucket", "node"])
        trim()


def _links(size: int, percent: int, texts: bool):
    """Links within the candidate groups of a bin, or between the two blocks of a pair: (u, v) with v the smallest class linked.
    Without ``texts`` they are by the estimate alone."""

    def run(t: pa.Table) -> pa.Table:
        u: list[np.ndarray] = []
        v: list[np.ndarray] = []
        t = t.sort_by([("root", "ascending"), ("side", "ascending"), ("node", "ascending")])
        root = t["root"].to_numpy()
        cut = np.append(np.flatnonzero(np.append(True, root[1:] != root[:-1])), len(root)) if len(root) else np.zeros(1, np.int64)
        for i, j in zip(cut[:-1].tolist(), cut[1:].tolist(), strict=True):
            part = t.slice(i, j - i)
            node, side = part["node"].to_numpy(), part["side"].to_numpy()
            left = int((side == 0).sum()) if side.any() else None
            sets = shingles(*column_bytes(part["text"]), size)[:2] if texts else None
            comp = link(_registers_of(part["regs"].combine_chunks()), part["n"].to_numpy(), percent, sets, left=left)
            order = np.lexsort((node, comp))
            c = comp[order]
            head = np.append(True, c[1:] != c[:-1])
            least = node[order][np.maximum.accumulate(np.where(head, np.arange(len(c)), 0))]
            u.append(node[order][~head])
            v.append(least[~head])
        out = pa.table({"u": np.concatenate(u) if u else np.zeros(0, np.int64), "v": np.concatenate(v) if v else np.zeros(0, np.int64)})
        trim()
        return out

    return run


def _placed(members: DataFrame, columns: list[str], blocks: DataFrame, bins: int) -> tuple[DataFrame, DataFrame]:
    """(members of groups of one block, by bin; members of larger groups, once for each pair of blocks that theirs takes part in)."""
    placed = members.join(blocks, "root")
    whole = placed.filter("blocks = 1").select(F.pmod(F.xxhash64("root"), F.lit(bins)).alias("bin"), "root", F.lit(0).alias("side"), "node", *columns)
    block = F.pmod(F.xxhash64("node"), F.col("blocks")).cast("int")
    split = placed.filter("blocks > 1").withColumn("block", block).withColumn("other", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)))
    side = F.when(F.col("block") > F.col("other"), 1).otherwise(0).alias("side")
    return whole, split.select(F.col("root").alias("bin"), F.least("block", "other").alias("one"), F.greatest("block", "other").alias("two"), "root", side, "node", *columns)


def near_duplicates(docs: DataFrame, shingle: int = 5, percent: int = 80, bin_bytes: int = 2 << 20, block_docs: int = 4096, block_bytes: int = 32 << 20) -> DataFrame:
    """doc_id, text_hash, n_shingles, component_id, kept: one row for each input row.

    Documents are linked when 100 * intersection >= percent * union of their sets of distinct word shingles; component_id is the smallest
    doc_id that can be reached over links, and kept tells whether it is the row's own. Words are what stands between ASCII white
    space, compared with A-Z in lower case. A text of fewer words than a shingle has them all as one; a text without words, or null, has
    none and is linked with nothing. Rows with a null doc_id are linked with nothing, have a null component_id and are kept.
    Repeated ids are linked by their texts, each text for itself, and share a verdict where the texts do. ``bin_bytes`` is what small groups of one task have together; ``block_docs`` and ``block_bytes`` bound a block of a large group.
    A text must fit a task, with some 20 times its bytes of working memory.
    """
    rows = docs.select("doc_id", *doc_key(), "text")
    sketch = written(rows.select("did", "dth", "text").mapInArrow(_sketch(shingle), "did long, dth long, n long, digest binary, regs binary"), "sketches")
    usable = sketch.filter((F.col("n") > 0) & (F.col("did") != -(1 << 63)))
    # sketches, bands and links are of classes; an id with several texts is in the class of each
    classes = usable.groupBy("digest").agg(F.min(F.struct("did", "dth")).alias("rep"), F.first("n").alias("n"), F.first("regs").alias("regs"), F.count("*").alias("rows"))
    classes = written(classes.select(F.monotonically_increasing_id().alias("node"), "digest", "rep.did", "rep.dth", "n", "regs", "rows"), "classes")
    buckets = written(classes.select("node", "regs").mapInArrow(_bands, "bucket long, node long"), "bands")
    pivots = buckets.groupBy("bucket").agg(F.min("node").alias("v"), F.max("node").alias("most"), F.count("*").alias("many")).filter("most > v")
    pivots = written(pivots.select("bucket", "v", "many"), "pivots")
    ties = join_hot(buckets, pivots, ["bucket"], "many", buckets.count(), "node").filter("node <> v").select(F.col("node").alias("u"), "v").distinct()
    groups = written(connected_components(ties), "groups")

    # large groups held together by chance ties are taken apart by their sketches before any text is moved
    sizes = written(groups.groupBy("root").agg(F.count("*").alias("docs")), "sizes")
    spread = F.ceil(F.greatest(F.col("docs") / block_docs, F.least(F.lit(float(SPREAD)), F.col("docs") / SMALL))).cast("int")
    large = sizes.filter(F.col("docs") > 2 * SMALL).select("root", spread.alias("blocks"))
    if not large.isEmpty():
        of_large = groups.join(large.select("root"), "root").join(classes.select("node", "n", "regs"), "node")
        _, pairs = _placed(written(of_large, "large"), ["n", "regs"], large, 1)
        near = written(pairs.groupBy("bin", "one", "two").applyInArrow(_links(shingle, percent, False), "u long, v long"), "near")
        groups = written(groups.join(large, "root", "left_anti").select("node", "root").unionByName(connected_components(near)), "groups")

    reps = groups.join(classes.select("node", "did", "dth", "n", "regs"), "node")
    members = reps.join(rows.select("did", "dth", "text"), ["did", "dth"]).groupBy("did", "dth").agg(*(F.first(c).alias(c) for c in ("node", "root", "n", "regs", "text")))
    members = written(members.select("node", "root", "n", "regs", "text"), "members")
    sizes = members.groupBy("root").agg(F.count("*").alias("docs"), F.sum(F.octet_length("text") + 600).alias("bytes"))
    # a large group spreads over up to SPREAD blocks for the sake of parallel work, and over more only where its blocks would be too large
    spread = F.greatest(F.col("docs") / block_docs, F.col("bytes") / block_bytes, F.least(F.lit(float(SPREAD)), F.col("docs") / SMALL))
    blocks = sizes.select("root", F.ceil(spread).cast("int").alias("blocks"))
    total = sizes.agg(F.sum("bytes")).first()[0] or 0
    whole, split = _placed(members, ["n", "regs", "text"], blocks, max(1, math.ceil(total / bin_bytes)))
    inner = whole.groupBy("bin").applyInArrow(_links(shingle, percent, True), "u long, v long")
    outer = split.groupBy("bin", "one", "two").applyInArrow(_links(shingle, percent, True), "u long, v long")
    roots = connected_components(written(inner.unionByName(outer), "links"))
    known = classes.join(roots, "node", "left").select("digest", "did", "rows", F.coalesce("root", "node").alias("root"))
    least = known.groupBy("root").agg(F.min("did").alias("component"))
    known = written(known.join(least, "root").select("digest", "component", "rows"), "known")
    out = join_hot(sketch.select("did", "dth", "n", "digest"), known, ["digest"], "rows", sketch.count(), "did", "left")
    null_id = F.col("did") == -(1 << 63)
    doc_id = F.when(~null_id, F.col("did"))
    component = F.when(~null_id & (F.col("n") > 0), F.col("component")).when(~null_id, F.col("did"))
    return out.select(doc_id.alias("doc_id"), F.col("dth").alias("text_hash"), F.col("n").alias("n_shingles"), component.alias("component_id"), (null_id | (F.col("did") == component)).alias("kept"))


def drop_near_duplicates(docs: DataFrame, **options: int) -> DataFrame:
    """The rows of ``docs`` that :func:`near_duplicates` keeps, with all their columns."""
    id_, hash_ = free(docs.columns, "id", "hash")
    gone = near_duplicates(docs, **options).filter("not kept").select(F.col("doc_id").alias(id_), F.col("text_hash").alias(hash_)).distinct()
    same = (F.col("doc_id").cast("long") == F.col(id_)) & (F.xxhash64(F.coalesce("text", F.lit(""))) == F.col(hash_))
    return docs.join(gone, same, "left_anti")
