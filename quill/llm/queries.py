"""The registered queries of this subpackage: each applies its operator to whole tables."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from . import chat_format, exact_dedup, fill_middle, hilbert, language_id, mixing, near_dup, packing, quality, token_output, vector_codes, vector_topk
from .common import shared_path, table, written
from .suffix_dedup import remove_repeats


def op1_suffix_array_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = remove_repeats(table(spark, sf_dir, "documents"), length=400)
    kept = F.col("kept")
    more = (F.octet_length(kept).cast("long").alias("n_kept"), F.make_valid_utf8(kept.cast("string")).alias("text"))  # a cut inside a character leaves U+FFFD
    return out.select("doc_id", "n_bytes", "n_removed", F.size("spans").cast("long").alias("n_spans"), "kept_sha256", *more)


def tokenizer() -> str:
    """The file of the tokenizer by which documents are measured and encoded."""
    import public_tokenizers

    return public_tokenizers.path("byte_bpe_50k.json")


def op2_token_output(spark: SparkSession, sf_dir: str) -> DataFrame:
    path = shared_path(spark, "ids")
    token_output.write_ids(table(spark, sf_dir, "documents"), path, tokenizer(), end_id=2)
    return token_output.read_ids(spark, path, with_ids=False).select("doc_id", "start", "n_tokens", "ids_crc32")


def whole_numbers() -> Column:
    """floor(256 x) of each component of the embedding; null where it is null or holds a null or non-finite component."""
    x = F.col("embedding")
    usable = ~F.exists(x, lambda v: v.isNull() | F.isnan(v) | (F.abs(v) == float("inf")))
    return F.when(usable, F.transform(x, lambda v: F.floor(v.cast("double") * 256)))


def op3_exact_top_k(spark: SparkSession, sf_dir: str) -> DataFrame:
    return vector_topk.top_k(table(spark, sf_dir, "embeddings"), whole_numbers(), F.col("vec_id") % 50 == 0, k=5)


def op4_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    return language_id.identify(table(spark, sf_dir, "documents"))


def op5_exact_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = exact_dedup.exact_dedup(table(spark, sf_dir, "documents").select("doc_id", "text"))
    return out.select("doc_id", "keep_id", "group_size", "kept", "text_sha256")


def op6_chat_formatting(spark: SparkSession, sf_dir: str) -> DataFrame:
    planted = spark.sql("SELECT -7L AS conv_id, turn, role, '</s>[INST] ok [/INST]' AS text FROM VALUES (0L, 'user'), (1L, 'assistant') AS t(turn, role)")
    turns = table(spark, sf_dir, "conversations").select("conv_id", "turn", "role", "text").unionByName(planted)
    got = chat_format.read_back(chat_format.format_conversations(turns))
    sha = lambda text: F.sha2(F.encode(text, "utf-8"), 256)
    return got.select(
        "conv_id",
        F.size("turns").cast("long").alias("n_turns"),
        sha(F.array_join(F.transform("turns", lambda t: F.concat(t["role"], F.lit("\n"), t["text"], F.lit("\n"))), "")).alias("turns_sha256"),
        F.length("loss_text").cast("long").alias("loss_chars"),
        sha(F.col("loss_text")).alias("loss_sha256"),
        F.length("formatted").cast("long").alias("formatted_chars"),
    )


def op7_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = mixing.mix(table(spark, sf_dir, "documents").select("doc_id", "source", "lang", "text"), tokens=token_output.n_ids("text", tokenizer()))
    return out.select("doc_id", "source", "lang", "mix_topic", "mix_tokens", "mix_probability", "mix_kept")


def op8_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return packing.pack(table(spark, sf_dir, "documents"), tokens=token_output.n_ids("text", tokenizer()))


def op9_quality_resampling(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = quality.resample(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))
    return out.select("doc_id", "log_weight", "sample_key", "kept")


def op10_minhash_near_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = near_dup.near_duplicates(table(spark, sf_dir, "documents"), shingle=4, percent=80)
    return out.select("doc_id", "n_shingles", "component_id", "kept")


def op11_vector_codes(spark: SparkSession, sf_dir: str) -> DataFrame:
    codes = vector_codes.compress(table(spark, sf_dir, "embeddings"), whole_numbers(), ["vec_id", "label"], parts=16, entries=64, rounds=2)
    out = vector_codes.with_total(written(codes.rows, "codes"), "label", "error", "label_error")
    return out.select("vec_id", F.lower(F.hex("code")).alias("code"), "error", "label_error", F.lit(codes.digest()).alias("codebooks_sha256"))


def op12_hilbert_shards(spark: SparkSession, sf_dir: str) -> DataFrame:
    data = F.encode(F.coalesce("text", F.lit("")), "utf-8")
    docs = table(spark, sf_dir, "documents").select("doc_id", "lang", "source", F.octet_length(data).cast("long").alias("n_bytes"), F.crc32(data).alias("text_crc32"))
    dims = {"source": F.col("source"), "lang": F.col("lang"), "n_bytes": F.col("n_bytes")}
    out = hilbert.shard(written(docs, "metadata"), dims, shards=40, bits=5, ties=[F.col("text_crc32"), F.col("doc_id")])
    none = F.lit(None).cast("int").alias("grown_shard")
    return out.select("doc_id", (F.col("n_bytes") + 16).alias("size"), "text_crc32", F.lit("rows").alias("law"), "shard", "slot", none, "curve")


def op13_fill_middle(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = fill_middle.restore(fill_middle.transform(table(spark, sf_dir, "documents").select("doc_id", "text")))
    sha = lambda c: F.sha2(F.encode(c, "utf-8"), 256)
    cuts = (F.col("fim_prefix").alias("prefix_chars"), F.col("fim_middle").alias("middle_chars"))
    return out.select("doc_id", F.col("fim_units").alias("n"), F.col("fim_form").alias("form"), *cuts, sha("fim_text").alias("output_sha256"), sha("restored").alias("restored_sha256"))


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    "op1_suffix_array_dedup": op1_suffix_array_dedup,
    "op2_token_output": op2_token_output,
    "op3_exact_top_k": op3_exact_top_k,
    "op4_language_id": op4_language_id,
    "op5_exact_dedup": op5_exact_dedup,
    "op6_chat_formatting": op6_chat_formatting,
    "op7_mixing": op7_mixing,
    "op8_packing": op8_packing,
    "op9_quality_resampling": op9_quality_resampling,
    "op10_minhash_near_dedup": op10_minhash_near_dedup,
    "op11_vector_codes": op11_vector_codes,
    "op12_hilbert_shards": op12_hilbert_shards,
    "op13_fill_middle": op13_fill_middle,
}


def _lookup(numbers: list[int]) -> str:
    return f"[{', '.join(map(str, numbers))}]"


def _curve_sql(dims: list[str], bits: int) -> str:
    """The place on the Hilbert curve of the cell with these coordinates."""
    digits, after, _ = hilbert.states(len(dims))
    size = 1 << len(dims)
    corner = " + ".join(f"((({d} >> b) & 1) << {k})" for k, d in enumerate(dims))
    levels = f"list_transform(range({bits - 1}, -1, -1), lambda b: CAST({corner} AS BIGINT))"
    at = f"(a % 256) * {size} + c + 1"  # the state stands in the last eight bits
    step = f"((a // 256) * {size} + {_lookup(digits)}[{at}]) * 256 + {_lookup(after)}[{at}]"
    return f"list_reduce(list_prepend(CAST(0 AS BIGINT), {levels}), lambda a, c: {step}) // 256"

SQL: dict[str, str] = {
    "op1_suffix_array_dedup": """
WITH d AS (
  SELECT row_number() OVER () AS r, doc_id, hex(encode(coalesce(text, ''))) AS bytes FROM documents
), parts AS (
  SELECT r, i, substring(bytes, CAST(2 * i + 1 AS BIGINT), 1598) AS part
  FROM (SELECT r, bytes, unnest(range(0, CAST(length(bytes) // 2 - 399 AS BIGINT), 400)) AS i FROM d WHERE length(bytes) >= 800)
), h AS (
  SELECT r, i + j AS i, md5_number(substring(part, CAST(2 * j + 1 AS BIGINT), 800)) AS string
  FROM (SELECT r, i, part, unnest(range(CAST(length(part) // 2 - 399 AS BIGINT))) AS j FROM parts)
), again AS (
  SELECT r, i FROM h WHERE string IN (SELECT string FROM h GROUP BY string HAVING count(*) > 1)
), marked AS (
  SELECT r, i, CAST(coalesce(i > lag(i) OVER (PARTITION BY r ORDER BY i) + 400, true) AS INTEGER) AS opens FROM again
), numbered AS (
  SELECT r, i, sum(opens) OVER (PARTITION BY r ORDER BY i) AS run FROM marked
), runs AS (
  SELECT r, min(i) AS a, max(i) + 400 AS b FROM numbered GROUP BY r, run
), ends AS (
  SELECT r, a, b, true AS is_run FROM runs UNION ALL SELECT r, length(bytes) // 2, length(bytes) // 2, false FROM d
), pieces AS (
  SELECT r, a, b, is_run, coalesce(lag(b) OVER (PARTITION BY r ORDER BY a, b, is_run DESC), 0) AS z FROM ends
), kept AS (
  SELECT d.r, d.doc_id, length(d.bytes) // 2 AS n_bytes, sum(b - a) AS n_removed, count(*) FILTER (is_run) AS n_spans,
         coalesce(string_agg(substring(d.bytes, CAST(2 * z + 1 AS BIGINT), CAST(2 * (a - z) AS BIGINT)), '' ORDER BY a, b, is_run DESC), '') AS bytes
  FROM pieces JOIN d USING (r) GROUP BY d.r, d.doc_id, length(d.bytes)
), chars AS (
  SELECT *, regexp_extract_all(regexp_replace(bytes, '(..)', '\\1 ', 'g'),
    '[0-7]. |(?:C[2-9A-F]|D.) [89AB]. |(?:E0 [AB]|ED [89]|E[1-9A-CEF] [89AB]). (?:[89AB]. )?|(?:F0 [9AB]|F4 8|F[1-3] [89AB]). (?:[89AB]. ){0,2}|.. ') AS c
  FROM kept
)
SELECT doc_id, CAST(n_bytes AS BIGINT) AS n_bytes, CAST(n_removed AS BIGINT) AS n_removed, n_spans, sha256(unhex(bytes)) AS kept_sha256,
       CAST(n_bytes - n_removed AS BIGINT) AS n_kept,
       decode(unhex(replace(array_to_string(list_transform(c, lambda x: CASE
         WHEN length(x) = 3 AND x < '8' OR length(x) = 6 AND x < 'E' OR length(x) = 9 AND x < 'F' OR length(x) = 12 THEN x ELSE 'EF BF BD ' END), ''), ' ', ''))) AS text
FROM chars""",
    "op3_exact_top_k": """
WITH v AS (
  SELECT vec_id, list_transform(embedding, lambda x: CAST(floor(256 * CAST(x AS DOUBLE)) AS BIGINT)) AS w
  FROM embeddings
  WHERE vec_id IS NOT NULL AND embedding IS NOT NULL
    AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0
), s AS (
  SELECT q.vec_id AS query_id, c.vec_id,
         CAST(coalesce(list_sum(list_transform(range(1, least(len(q.w), len(c.w)) + 1), lambda i: q.w[i] * c.w[i])), 0) AS BIGINT) AS score
  FROM v q JOIN v c ON c.vec_id <> q.vec_id
  WHERE q.vec_id % 50 = 0
), r AS (
  SELECT query_id, CAST(row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id) AS INTEGER) AS rank, vec_id, score FROM s
)
SELECT query_id, rank, vec_id, score FROM r WHERE rank <= 5""",
    "op5_exact_dedup": """
WITH n AS (
  SELECT doc_id, sha256(regexp_replace(coalesce(text, ''), '[\\x20\\x09-\\x0D]+', ' ', 'g')) AS text_sha256 FROM documents
)
SELECT doc_id, min(doc_id) OVER (PARTITION BY text_sha256) AS keep_id,
       count(*) OVER (PARTITION BY text_sha256) AS group_size,
       doc_id = min(doc_id) OVER (PARTITION BY text_sha256) AS kept, text_sha256
FROM n""",
    "op6_chat_formatting": """
WITH c AS (
  SELECT conv_id, turn, coalesce(role, '') AS role, coalesce(text, '') AS text FROM conversations
  UNION ALL
  SELECT -7, t.turn, t.role, '</s>[INST] ok [/INST]' FROM (VALUES (0, 'user'), (1, 'assistant')) AS t(turn, role)
), e AS (
  SELECT *, CASE WHEN regexp_matches(role, '</?s>|\\[/?INST\\]') OR regexp_matches(text, '</?s>|\\[/?INST\\]')
    THEN length(regexp_replace(role, '(</?s>|\\[/?INST\\]|␛)', 'x\\1', 'g')) + length(regexp_replace(text, '(</?s>|\\[/?INST\\]|␛)', 'x\\1', 'g'))
    ELSE length(role) + length(text) END + 21 AS chars
  FROM c
)
SELECT conv_id, count(*) AS n_turns,
  sha256(string_agg(role || chr(10) || text || chr(10), '' ORDER BY turn, role, text)) AS turns_sha256,
  CAST(sum(CASE WHEN role = 'assistant' THEN length(text) ELSE 0 END) AS BIGINT) AS loss_chars,
  sha256(string_agg(CASE WHEN role = 'assistant' THEN text ELSE '' END, '' ORDER BY turn, role, text)) AS loss_sha256,
  CAST(sum(chars) AS BIGINT) AS formatted_chars
FROM e GROUP BY conv_id""",
    "op10_minhash_near_dedup": """
WITH RECURSIVE w AS (
  SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\\x20\\x09-\\x0D]+') AS words FROM documents
), t AS (
  SELECT doc_id, len(words) AS many, unnest(words) AS word, generate_subscripts(words, 1) AS i FROM w
), g AS (
  SELECT doc_id, many, i, concat_ws(' ', word, lead(word) OVER p, lead(word, 2) OVER p, lead(word, 3) OVER p) AS shingle FROM t WINDOW p AS (PARTITION BY doc_id ORDER BY i)
), u AS (
  SELECT DISTINCT doc_id, shingle FROM g WHERE i <= greatest(many - 3, 1)
), e AS (
  SELECT doc_id, shingle, count(*) OVER (PARTITION BY doc_id) AS n FROM u
), holders AS (
  SELECT docs, count(*) AS times FROM (SELECT list(struct_pack(id := doc_id, n := n) ORDER BY doc_id) AS docs FROM e GROUP BY shingle HAVING count(*) > 1) GROUP BY docs
), pairs AS (
  SELECT a, unnest(docs) AS b, times FROM (SELECT docs, unnest(docs) AS a, times FROM holders)
), l AS (
  SELECT a.id AS a, b.id AS b FROM pairs WHERE a.id <> b.id GROUP BY a, b HAVING 100 * sum(times) >= 80 * (a.n + b.n - sum(times))
), reach AS (
  SELECT doc_id AS node, doc_id AS other FROM w UNION SELECT r.node, l.b FROM reach r JOIN l ON l.a = r.other
), c AS (
  SELECT node, min(other) AS component_id FROM reach GROUP BY node
)
SELECT w.doc_id, coalesce(z.n, 0) AS n_shingles, c.component_id, w.doc_id = c.component_id AS kept
FROM w JOIN c ON c.node = w.doc_id LEFT JOIN (SELECT doc_id, count(*) AS n FROM u GROUP BY doc_id) z ON z.doc_id = w.doc_id""",
    "op11_vector_codes": """
WITH v AS MATERIALIZED (
  SELECT row_number() OVER () AS r, vec_id, label, list_transform(embedding, lambda x: CAST(floor(256 * CAST(x AS DOUBLE)) AS BIGINT)) AS w
  FROM embeddings WHERE embedding IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0
), p AS MATERIALIZED (
  SELECT r, part, w[part * (len(w) // 16) + 1:(part + 1) * (len(w) // 16)] AS x FROM (SELECT r, w, unnest(range(16)) AS part FROM v)
), books0 AS MATERIALIZED (
  SELECT p.part, f.entry, p.x FROM p JOIN (SELECT r, row_number() OVER (ORDER BY vec_id NULLS LAST, w) - 1 AS entry FROM v QUALIFY entry < 64) f USING (r)
), nearest0 AS MATERIALIZED (
  SELECT r, part, best % 64 AS entry, best // 64 AS far FROM (
    SELECT p.r, p.part, min(list_sum(list_transform(list_zip(p.x, b.x), lambda z: (z[1] - z[2]) * (z[1] - z[2]))) * 64 + b.entry) AS best
    FROM p JOIN books0 b USING (part) GROUP BY p.r, p.part)
), books1 AS MATERIALIZED (
  SELECT b.part, b.entry, coalesce(m.x, b.x) AS x FROM books0 b LEFT JOIN (
    SELECT part, entry, list((s - ((s % c) + c) % c) // c ORDER BY i) AS x
    FROM (SELECT part, entry, i, sum(v) AS s, count(*) AS c FROM (SELECT p.part, n.entry, unnest(p.x) AS v, unnest(range(len(p.x))) AS i FROM p JOIN nearest0 n USING (r, part)) GROUP BY part, entry, i)
    GROUP BY part, entry) m ON m.part = b.part AND m.entry = b.entry
), nearest1 AS MATERIALIZED (
  SELECT r, part, best % 64 AS entry, best // 64 AS far FROM (
    SELECT p.r, p.part, min(list_sum(list_transform(list_zip(p.x, b.x), lambda z: (z[1] - z[2]) * (z[1] - z[2]))) * 64 + b.entry) AS best
    FROM p JOIN books1 b USING (part) GROUP BY p.r, p.part)
), books2 AS MATERIALIZED (
  SELECT b.part, b.entry, coalesce(m.x, b.x) AS x FROM books1 b LEFT JOIN (
    SELECT part, entry, list((s - ((s % c) + c) % c) // c ORDER BY i) AS x
    FROM (SELECT part, entry, i, sum(v) AS s, count(*) AS c FROM (SELECT p.part, n.entry, unnest(p.x) AS v, unnest(range(len(p.x))) AS i FROM p JOIN nearest1 n USING (r, part)) GROUP BY part, entry, i)
    GROUP BY part, entry) m ON m.part = b.part AND m.entry = b.entry
), nearest2 AS MATERIALIZED (
  SELECT r, part, best % 64 AS entry, best // 64 AS far FROM (
    SELECT p.r, p.part, min(list_sum(list_transform(list_zip(p.x, b.x), lambda z: (z[1] - z[2]) * (z[1] - z[2]))) * 64 + b.entry) AS best
    FROM p JOIN books2 b USING (part) GROUP BY p.r, p.part)
), d AS (
  SELECT sha256(coalesce(string_agg(n, ',' ORDER BY part, entry, i), '')) AS codebooks_sha256
  FROM (SELECT part, entry, CAST(CAST(unnest(x) AS BIGINT) AS VARCHAR) AS n, unnest(range(len(x))) AS i FROM books2)
), e AS (
  SELECT r, string_agg(lower(printf('%02x', CAST(entry AS INTEGER))), '' ORDER BY part) AS code, CAST(sum(far) AS BIGINT) AS error FROM nearest2 GROUP BY r
)
SELECT v.vec_id, e.code, e.error, CAST(sum(e.error) OVER (PARTITION BY v.label) AS BIGINT) AS label_error, d.codebooks_sha256 FROM v JOIN e USING (r) CROSS JOIN d""",
    "op12_hilbert_shards": f"""
WITH d AS MATERIALIZED (
  SELECT row_number() OVER () AS r, doc_id, lang, source, hex(encode(coalesce(text, ''))) AS bytes FROM documents
), t AS (
  SELECT list_transform(range(256), lambda n: list_reduce([CAST(n AS BIGINT), 0, 0, 0, 0, 0, 0, 0, 0], lambda x, y: CASE WHEN x % 2 = 1 THEN xor(x >> 1, 3988292384) ELSE x >> 1 END)) AS crc
), c AS MATERIALIZED (
  SELECT d.r, d.doc_id, d.lang, d.source, length(d.bytes) // 2 AS n_bytes,
    xor(list_reduce(list_prepend(4294967295, list_transform(regexp_extract_all(d.bytes, '..'), lambda x: CAST('0x' || x AS BIGINT))),
      lambda x, y: xor(x >> 8, t.crc[(xor(x, y) & 255) + 1])), 4294967295) AS text_crc32
  FROM d CROSS JOIN t
), n AS (
  SELECT *, count(*) OVER () AS many, ((rank() OVER (ORDER BY source NULLS FIRST) - 1) * 32) // count(*) OVER () AS bin1,
    ((rank() OVER (ORDER BY lang NULLS FIRST) - 1) * 32) // count(*) OVER () AS bin2, ((rank() OVER (ORDER BY n_bytes NULLS FIRST) - 1) * 32) // count(*) OVER () AS bin3
  FROM c
), h AS (
  SELECT *, {_curve_sql(["bin1", "bin2", "bin3"], 5)} AS curve FROM n
), g AS (
  SELECT *, row_number() OVER (ORDER BY curve, text_crc32, doc_id NULLS FIRST, n_bytes, source NULLS FIRST, lang NULLS FIRST) - 1 AS g FROM h
)
SELECT doc_id, CAST(n_bytes + 16 AS BIGINT) AS size, CAST(text_crc32 AS BIGINT) AS text_crc32, 'rows' AS law, CAST(g * 40 // many AS INTEGER) AS shard,
       CAST(g - (g * 40 // many * many + 39) // 40 AS BIGINT) AS slot, CAST(NULL AS INTEGER) AS grown_shard, CAST(curve AS BIGINT) AS curve
FROM g""",
    "op13_fill_middle": """
WITH d AS (
  SELECT doc_id, coalesce(text, '') AS t, sha256('1:' || coalesce(CAST(doc_id AS VARCHAR), '')) AS s FROM documents
), h AS (
  SELECT doc_id, t, CAST(length(t) AS BIGINT) AS n, CAST('0x' || s[1:8] AS BIGINT) AS h1, CAST('0x' || s[9:16] AS BIGINT) AS h2,
         CAST('0x' || s[17:24] AS BIGINT) AS h3, CAST('0x' || s[25:32] AS BIGINT) AS h4 FROM d
), c AS (
  SELECT *, least(h1 % (n + 1), h2 % (n + 1)) AS a, greatest(h1 % (n + 1), h2 % (n + 1)) AS b,
    CASE WHEN t = '' OR contains(t, '<P>') OR contains(t, '<S>') OR contains(t, '<M>') OR h3 % 100 >= 90 THEN 'plain' WHEN h4 % 100 < 20 THEN 'spm' ELSE 'psm' END AS form FROM h
), o AS (
  SELECT *, substring(t, 1, a) AS p, substring(t, a + 1, b - a) AS m, substring(t, b + 1) AS s FROM c
)
SELECT doc_id, n, form, CASE WHEN form <> 'plain' THEN a END AS prefix_chars, CASE WHEN form <> 'plain' THEN b - a END AS middle_chars,
       sha256(CASE form WHEN 'plain' THEN t WHEN 'psm' THEN '<P>' || p || '<S>' || s || '<M>' || m ELSE '<S>' || s || '<P>' || p || '<M>' || m END) AS output_sha256,
       sha256(t) AS restored_sha256
FROM o""",
}
