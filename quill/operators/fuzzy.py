"""Fuzzy matching of heard phrases against known terms: blocking, rules and choice in DataFrames; only the likeness of two strings is counted in Arrow batches."""

from __future__ import annotations

import math
import re
from difflib import SequenceMatcher

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..functions import text as tx
from .choice import best_first

MIN_RATIO, WORD_RATIO, HUMP_RATIO, WHOLE_RATIO, MOST_CANDIDATES, MOST_POSTINGS, MOST_WORDS = 0.75, 0.92, 0.5, 0.85, 60, 4000, 5
#: Rows of a block of terms and of keys, and rows that are counted in one go.
TERM_BLOCK, KEY_BLOCK, ROWS_AT_ONCE = 1000, 1000, 64
CAMEL = r"[A-Z][a-z0-9]+(?:[A-Z][a-z0-9]*)+|[a-z]+(?:[A-Z][a-z0-9]*)+"


def windows(df: DataFrame, tokens: str, most: int = MOST_WORDS) -> DataFrame:
    """One row for each run of 1 to ``most`` tokens: pos (from 0), k and words."""
    others = [c for c in df.columns if c != tokens]
    starts = df.select(*others, tokens, F.posexplode(tokens).alias("pos", "__t"))
    sizes = starts.select(*others, tokens, "pos", F.explode(F.sequence(F.lit(1), F.least(F.lit(most), F.size(tokens) - F.col("pos")))).alias("k"))
    return sizes.select(*others, "pos", "k", F.array_join(F.slice(F.col(tokens), F.col("pos") + 1, F.col("k")), " ").alias("words"))


def repeated_windows(df: DataFrame, key: list[str], tokens: str, most: int = MOST_WORDS) -> DataFrame:
    """(key, words, places, width): runs of 2 to ``most`` tokens that a key says more than once, with all their places (from 0) in order.

    A run that stands twice begins with a pair that stands twice, so a key's pairs are sorted and only runs from places of repeated pairs become rows. A key's rows, each with
    places of its own, are brought together once; runs are then counted where they are. A key must fit a task.
    """
    said = df.groupBy(*key).agg(F.collect_list(tokens).alias("said"))
    pairs = F.flatten(F.transform("said", lambda t, r: F.transform(F.slice(t, 1, F.greatest(F.size(t) - 1, F.lit(0))), lambda w, i: F.struct(F.concat(w, F.lit(" "), F.get(t, i + 1)).alias("pair"), r.alias("r"), i.alias("i")))))
    pair = lambda i: F.get(F.col("pairs"), i)["pair"]  # noqa: E731  (null beyond the ends)
    again = F.filter("pairs", lambda x, i: F.coalesce(x["pair"] == pair(i - 1), F.lit(False)) | F.coalesce(x["pair"] == pair(i + 1), F.lit(False)))
    spots = said.withColumn("pairs", F.array_sort(pairs)).select(*key, "said", F.explode(again).alias("x"))
    ahead = spots.select(*key, F.col("x.i").alias("pos"), F.slice(F.get("said", F.col("x.r")), F.col("x.i") + 1, most).alias("ahead"))
    runs = ahead.select(*key, "pos", "ahead", F.explode(F.sequence(F.lit(2), F.size("ahead"))).alias("k")).select(*key, "pos", "k", F.array_join(F.slice("ahead", 1, F.col("k")), " ").alias("words"))
    return runs.groupBy(*key, "words").agg(F.array_sort(F.collect_list("pos")).alias("places"), F.min("k").alias("width")).filter(F.size("places") > 1)


def _gram_keys(texts: list[str]) -> tuple[np.ndarray, np.ndarray]:
    """(trigrams of all texts as numbers, the text of each), as :func:`quill.functions.text.trigrams` pads them; not yet distinct."""
    code = np.frombuffer("".join(f"  {t} " for t in texts).encode("utf-32-le", "surrogatepass"), "<u4").astype(np.int64)
    many = np.array([len(t) + 3 for t in texts], np.int64)
    row, last = np.repeat(np.arange(len(texts)), many), np.cumsum(many)
    inside = np.ones(len(code), bool)
    inside[last - 1] = inside[last - 2] = False
    at = np.flatnonzero(inside)
    return (code[at] << 42) | (code[at + 1] << 21) | code[at + 2], row[at]


def _count_shared(terms: pa.Table, keys: pa.Table) -> pa.Table:
    """Shared trigrams of every pair of a block of terms (th, term, n) and a block of keys (kh, key, n), where they reach ``need``."""
    kind = pa.schema([("term", terms.schema.field("term").type), ("key", keys.schema.field("key").type), ("shared", pa.int64()), ("need", pa.int64())])
    if not len(terms) or not len(keys):
        return kind.empty_table()
    _, term_at, term_of = np.unique(terms["th"].to_numpy(), return_index=True, return_inverse=True)
    _, key_at, key_of = np.unique(keys["kh"].to_numpy(), return_index=True, return_inverse=True)
    width = len(term_at)
    gram, row = _gram_keys(terms["n"].to_pylist())
    pair = np.unique(np.stack([gram, row]), axis=1)  # distinct grams of each row, by gram
    grams, first = np.unique(pair[0], return_index=True)
    posting, first = term_of[pair[1]], np.append(first, pair.shape[1])
    need = np.maximum(2, np.floor(np.bincount(posting, minlength=width) * 0.3).astype(np.int64))

    order = np.argsort(key_of, kind="stable")  # rows of one key side by side
    texts, key_of = keys["n"].take(pa.array(order)).to_pylist(), key_of[order]
    cuts = [0]
    for i in range(1, len(order)):
        if i - cuts[-1] >= ROWS_AT_ONCE and key_of[i] != key_of[i - 1]:
            cuts.append(i)
    found: list[tuple[np.ndarray, np.ndarray, np.ndarray]] = []
    for i, j in zip(cuts, [*cuts[1:], len(order)], strict=True):
        here = int(key_of[i])
        shared = np.zeros((int(key_of[j - 1]) - here + 1) * width, np.int64)
        for k in range(i, j, ROWS_AT_ONCE):
            part = texts[k : min(k + ROWS_AT_ONCE, j)]
            gram, row = _gram_keys(part)
            at = np.minimum(np.searchsorted(grams, gram), len(grams) - 1)
            hit = grams[at] == gram
            seen = np.zeros(len(part) * len(grams), bool)
            seen[row[hit] * len(grams) + at[hit]] = True
            row, at = np.divmod(np.flatnonzero(seen), len(grams))
            many = first[at + 1] - first[at]
            place = np.repeat(first[at] - (np.cumsum(many) - many), many) + np.arange(int(many.sum()))
            shared += np.bincount(np.repeat(key_of[k + row] - here, many) * width + posting[place], minlength=len(shared))
        key, term = np.divmod(np.flatnonzero(shared >= np.tile(need, len(shared) // width)), width)
        found.append((term, key + here, shared[key * width + term]))
    term, key, shared = (np.concatenate(x) for x in zip(*found, strict=True))
    cols = [terms["term"].take(pa.array(term_at[term])), keys["key"].take(pa.array(key_at[key])), pa.array(shared), pa.array(need[term])]
    return pa.Table.from_arrays(cols, schema=kind)


def candidates(terms: DataFrame, term_id: str, keys: DataFrame, key_id: str, within: str | None = None, most_postings: int = MOST_POSTINGS) -> DataFrame:
    """(term_id, key_id, shared, need): keys that share at least max(2, 30 %) of a term's trigrams; both sides hold n, the normal form.

    Keys that are windows of a transcript name it by ``within``: grams of more than ``most_postings`` windows of one transcript
    are left out for that transcript, as the definition of the operator has it. Keys that stand for themselves, as whole documents, have no such
    list: every gram counts, however many keys hold it. There, blocks of terms meet blocks of keys and pairs are counted in
    place, so no posting list is gathered or shuffled; rows with one id count together.
    """
    if within is None:
        spark = keys.sparkSession
        n_terms, n_keys = (max(1, math.ceil(df.count() / rows)) for df, rows in ((terms, TERM_BLOCK), (keys, KEY_BLOCK)))
        left = terms.filter("n is not null").select(F.xxhash64(term_id).alias("th"), F.col(term_id).alias("term"), "n")
        right = keys.filter("n is not null").select(F.xxhash64(key_id).alias("kh"), F.col(key_id).alias("key"), "n")
        left = left.withColumn("tb", F.pmod("th", F.lit(n_terms))).join(F.broadcast(spark.range(n_keys).select(F.col("id").alias("kb"))))
        right = right.withColumn("kb", F.pmod("kh", F.lit(n_keys))).withColumn("tb", F.explode(F.sequence(F.lit(0).cast("long"), F.lit(n_terms - 1).cast("long"))))
        schema = T.StructType([T.StructField("term", terms.schema[term_id].dataType), T.StructField("key", keys.schema[key_id].dataType), *T.StructType.fromDDL("shared long, need long").fields])

        def run(a: pa.Table, b: pa.Table) -> pa.Table:
            return _count_shared(a, b)

        met = left.groupBy("tb", "kb").cogroup(right.groupBy("tb", "kb")).applyInArrow(run, schema)
        return met.select(F.col("term").alias(term_id), F.col("key").alias(key_id), "shared", "need")
    grams = keys.select(F.col(within).alias("__in"), key_id, F.explode(tx.trigrams(F.col("n"))).alias("g"))
    stop = grams.groupBy("__in", "g").count().filter(F.col("count") > most_postings).select("__in", "g")
    asked = terms.select(term_id, F.explode(tx.trigrams(F.col("n"))).alias("g"))
    stopped = asked.join(stop, "g").groupBy(term_id, "__in").agg(F.count("*").alias("off"))
    shared = asked.join(grams.join(stop, ["__in", "g"], "left_anti"), "g").groupBy(term_id, "__in", key_id).agg(F.count("*").alias("shared"))
    left_over = F.col("all") - F.coalesce("off", F.lit(0))
    need = F.greatest(F.lit(2).cast("long"), F.floor(left_over * 0.3)).alias("need")
    whole = asked.groupBy(term_id).agg(F.count("*").alias("all"))
    out = shared.join(whole, term_id).join(stopped, [term_id, "__in"], "left").select(term_id, key_id, "shared", need)
    return out.filter("shared >= need")


def likeness(pairs: Column) -> Column:
    """Of an array of pairs of strings, the share of letters in matching blocks (Ratcliff and Obershelp) of each; a pair that stands often is counted once a batch."""

    def run(col: pd.Series) -> pd.Series:
        asked = {(p["a"], p["b"]) for row in col for p in row}
        found = {p: SequenceMatcher(None, *p).ratio() for p in asked}
        return col.map(lambda row: [found[p["a"], p["b"]] for p in row])

    return F.pandas_udf(run, "array<double>")(pairs)


def _pair(a: Column, b: Column) -> Column:
    return F.struct(a.alias("a"), b.alias("b"))


def judged(df: DataFrame, heard: str, term: str, ratio: str = "ratio") -> DataFrame:
    """``df`` with the ratio at which a phrase heard may stand for a term, null where it may not.

    The same letters in another form are 1. Else the phrase must be 0.6 to 1.5 times as long and not hold the term; likeness is that of the spelling or, where both sounds have three letters
    and it is more, its mean with that of the sounds. One lower-case word heard for a CamelCase term needs 0.92 in spelling alone; several words must each resemble the part
    of the term in their place by half, or, if there are more or fewer of them, the whole spelling by 0.85. Ratios under 0.75 are null.
    """
    a, b = tx.letters_norm(F.col(term)), tx.letters_norm(F.col(heard))
    camel = F.col(term).rlike(f"^(?:{CAMEL})$")
    lone = ~F.col(heard).contains(" ") & F.col(heard).rlike(r"\p{Ll}") & ~F.col(heard).rlike(r"\p{Lu}")
    said = F.filter(F.transform(F.split(F.col(heard), " "), tx.letters_norm), lambda w: w != "")
    humps = F.transform(F.regexp_extract_all(F.col(term), F.lit("[A-Z][a-z0-9]*|[a-z0-9]+"), F.lit(0)), tx.letters_norm)
    in_step = F.size(said) == F.size(humps)
    steps = F.when(camel & in_step, F.zip_with(said, humps, _pair)).otherwise(F.array().cast("array<struct<a:string,b:string>>"))
    possible = F.length(b).between(F.length(a) * 0.6, F.length(a) * 1.5) & ~F.contains(b, a)
    asked = F.when(possible, F.concat(F.array(_pair(a, b), _pair(tx.skeleton(a), tx.skeleton(b)), _pair(b, a)), steps)).otherwise(F.array().cast("array<struct<a:string,b:string>>"))
    out = df.withColumn("__like", likeness(asked))
    spelled, sounded = F.get("__like", F.lit(0)), F.get("__like", F.lit(1))
    sounds = F.least(F.length(tx.skeleton(a)), F.length(tx.skeleton(b))) >= 3
    alike = F.when(sounds, F.greatest(spelled, (spelled + sounded) / 2)).otherwise(spelled)
    fits = F.when(in_step, F.forall(F.slice("__like", 4, F.greatest(F.size("__like") - 3, F.lit(0))), lambda x: x >= HUMP_RATIO)).otherwise(F.get("__like", F.lit(2)) >= WHOLE_RATIO)
    near = F.when(camel & lone, F.when(spelled >= WORD_RATIO, spelled)).when(~camel | fits, F.when(alike >= MIN_RATIO, alike))
    same = F.when(F.col(heard) != F.col(term), F.lit(1.0))
    return out.withColumn(ratio, F.when(a == b, same).when(possible, near)).drop("__like")


def suggest(transcript: DataFrame, doc: str, text: str, terms: DataFrame) -> DataFrame:
    """(doc, heard, term, ratio, count, first_pos): phrases of each transcript that seem to be mishearings of ``terms`` (term).

    Windows of 1 to 5 words are blocked by trigrams, at most 60 for a term by shared grams as the operator has it, and judged; of those
    that overlap the best ratio (to two places), then the longest, stays in each transcript. Of terms with the same letters the smallest counts.
    """
    body = F.regexp_replace(F.col(text), r"(?m)^\s*\[[^\]]*\]\s*(?:[^:\n]{1,80}:\s*)?", "")
    tokens = transcript.select(doc, F.regexp_extract_all(body, F.lit(r"[\p{L}\p{N}]+"), F.lit(0)).alias("tokens"))
    spots = windows(tokens, "tokens").groupBy(doc, "words").agg(F.array_sort(F.collect_list("pos")).alias("places"))
    keys = spots.select(doc, "words", F.struct(doc, "words").alias("k"), tx.letters_norm(F.col("words")).alias("n")).filter(F.length("n") >= 4)
    canon = terms.groupBy(tx.letters_norm(F.col("term")).alias("n")).agg(F.min("term").alias("term")).filter(F.length("n") >= 5)
    near = candidates(canon, "term", keys, "k", within=doc)
    best = F.row_number().over(Window.partitionBy("term", doc).orderBy(F.desc("shared"), "words"))
    near = near.select("term", F.col(f"k.{doc}").alias(doc), F.col("k.words").alias("words"), "shared").withColumn("__r", best).filter(F.col("__r") <= MOST_CANDIDATES)
    other = canon.select("n", F.col("term").alias("__other"))
    near = near.withColumn("n", tx.letters_norm(F.col("words"))).join(other, "n", "left").filter("__other is null or __other = term")
    scored = judged(near.join(spots, [doc, "words"]), "words", "term").filter("ratio is not null")
    scored = scored.select(doc, F.col("words").alias("heard"), "term", F.round("ratio", 2).alias("ratio"), "places", F.size(F.split("words", " ")).alias("width"))
    order = [-F.col("ratio"), -F.length("heard"), F.col("heard"), F.col("term")]
    kept = best_first(scored, doc, order, "places", "width")
    return kept.select(doc, "heard", "term", "ratio", F.size("places").alias("count"), F.element_at("places", 1).alias("first_pos"))


def _joined(phrase: Column) -> Column:
    """A phrase in lower case with one space for each run of spaces and hyphens."""
    return F.trim(F.regexp_replace(F.lower(phrase), r"(?U)[\s\-]+", " "))


def apply_glossary(text: Column | str, pairs: list[tuple[str, str]]) -> Column:
    """Struct (text, counts): every rule applied in one pass, the longest phrase first at each place; a replacement is never read again.

    Phrases match without case, between word bounds, across spaces or hyphens. Of phrases equal without case the first counts;
    rules that change nothing are left out. counts maps each phrase to its replacements. Null text stays null. The text is split at
    all phrases at once, and what stood there is looked up.
    """
    col = F.col(text) if isinstance(text, str) else text
    plain = lambda p: " ".join(re.split(r"[\s\-]+", p.strip())).lower().strip()
    rules = {plain(heard): (heard, correct) for heard, correct in reversed(pairs) if heard.strip() and heard.strip().lower() != correct.strip().lower()}
    empty = F.create_map().cast("map<string,int>")
    if not rules:
        return F.struct(col.alias("text"), empty.alias("counts"))
    quoted = lambda p: r"[\s\-]+".join(re.sub(r"([^\w])", r"\\\1", w) for w in p.split(" "))
    pattern = rf"(?iuU)(?<!\w)(?:{'|'.join(quoted(p) for p in sorted(rules, key=len, reverse=True))})(?!\w)"
    found = F.transform(F.regexp_extract_all(col, F.lit(pattern), F.lit(0)), _joined)
    table = F.create_map(*(F.lit(x) for p, (_, correct) in rules.items() for x in (p, correct)))
    put = F.concat(F.transform(found, lambda f: table[f]), F.array(F.lit("")))
    changed = F.array_join(F.zip_with(F.split(col, pattern, -1), put, lambda between, new: F.concat(between, new)), "")
    counts = F.create_map(*(x for p, (heard, _) in rules.items() for x in (F.lit(heard), F.size(F.array_remove(F.transform(found, _is(p)), 0)))))
    return F.struct(changed.alias("text"), F.when(col.isNull(), F.map_from_arrays(F.array(*(F.lit(h) for h, _ in rules.values())), F.array(*(F.lit(0) for _ in rules)))).otherwise(counts).alias("counts"))


def _is(phrase: str):
    """A column function: 1 where a phrase found is this one, else 0."""

    def run(found: Column) -> Column:
        return (found == phrase).cast("int")

    return run
