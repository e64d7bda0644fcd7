"""One query per operator of this subpackage, each over its whole table with production parameters."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from plaintide.llm import (
    byte_bpe,
    decontamination,
    embedding_dedup,
    exact_dedup,
    mixing,
    order_minhash,
    quality,
    scratch,
    secret_scan,
    spelling_variants,
    token_counts,
    token_file,
    toxicity,
    whitening,
)
from plaintide.llm.shipping import ship_package

#: Vocabulary files; the folder is that of the installed public_tokenizers package.
BYTE_BPE, PIECE_BPE = "byte_bpe_50k.json", "piece_bpe_32k.model"


def tokenizer_file(name: str) -> str:
    import public_tokenizers

    return public_tokenizers.path(name)


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    ship_package(spark)
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def op1_embedding_near_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return embedding_dedup.near_duplicate_vectors(table(spark, sf_dir, "embeddings")).drop("copies")


def op2_exact_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return exact_dedup.exact_duplicates(table(spark, sf_dir, "documents"))


def op3_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return token_counts.token_counts(table(spark, sf_dir, "documents"), tokenizer_file(PIECE_BPE))


def op4_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    return quality.classify_quality(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))


def op5_order_minhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    return order_minhash.near_duplicates(table(spark, sf_dir, "documents"))


def op6_temperature_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "source", "text")
    blocks = mixing.block_permutations(docs, mixing.mixing_plan(docs))
    return mixing.copies_in(mixing.reading_order(blocks))


def op7_byte_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    return byte_bpe.bpe_round_trip(table(spark, sf_dir, "documents"), tokenizer_file(BYTE_BPE)).drop("exact")


def op8_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    return toxicity.classify_toxicity(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))


def op9_token_file(spark: SparkSession, sf_dir: str) -> DataFrame:
    path = scratch.new_path(spark, "token-file")
    token_file.write_token_file(table(spark, sf_dir, "documents"), path, tokenizer_file(BYTE_BPE))
    return token_file.token_file_digests(spark, path)


def op10_secret_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    return secret_scan.secret_summary(secret_scan.scan_secrets(table(spark, sf_dir, "documents")))


def op11_benchmark_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = decontamination.contamination(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))
    return found.select(
        "doc_id", "n_words", "n_hit", F.size("item_ids").cast("bigint").alias("n_items"),
        F.sha2(F.array_join("item_ids", ","), 256).alias("items_sha256"), "contaminated")


def op12_whitening(spark: SparkSession, sf_dir: str) -> DataFrame:
    return whitening.whitened_components(table(spark, sf_dir, "embeddings"))


def op13_spelling_variants(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spelling_variants.spelling_variants(table(spark, sf_dir, "documents"), slip=199)


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    own = [
        op1_embedding_near_dedup, op2_exact_dedup, op3_token_counts, op4_quality, op5_order_minhash,
        op6_temperature_mixing, op7_byte_bpe, op8_toxicity, op9_token_file, op10_secret_scan,
        op11_benchmark_decontamination, op12_whitening, op13_spelling_variants,
    ]
    return {q.__name__: q for q in own}


# Equal vectors, pairs in doubles, and reachability by repeated minimum over the closure of the links.
OP1_SQL = """
WITH RECURSIVE v AS (
  SELECT vec_id, CASE WHEN len(embedding) > 0 AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0
                       AND len(list_filter(embedding, lambda x: x <> 0)) > 0
                      THEN CAST(embedding AS DOUBLE[]) END AS e
  FROM embeddings),
links AS (
  SELECT a.vec_id AS a, b.vec_id AS b FROM v a JOIN v b
  ON a.vec_id <> b.vec_id AND a.e IS NOT NULL AND b.e IS NOT NULL AND len(a.e) = len(b.e)
  AND CASE WHEN len(a.e) = len(b.e) THEN list_cosine_similarity(a.e, b.e) >= 0.9 ELSE FALSE END),
reach AS (
  SELECT vec_id AS node, vec_id AS other FROM v
  UNION
  SELECT r.node, l.b FROM reach r JOIN links l ON l.a = r.other),
heads AS (SELECT node, min(other) AS component_id FROM reach GROUP BY node),
counts AS (SELECT a, count(*) AS n FROM links GROUP BY a)
SELECT v.vec_id, coalesce(c.n, 0) AS n_links, h.component_id, v.vec_id = h.component_id AS kept
FROM v JOIN heads h ON h.node = v.vec_id LEFT JOIN counts c ON c.a = v.vec_id
"""

OP2_SQL = r"""
WITH t AS (
  SELECT doc_id, length(coalesce(text, '')) AS n,
         sha256(regexp_replace(coalesce(text, ''), '[\x20\x09-\x0D]', '', 'g')) AS text_sha256
  FROM documents),
g AS (
  SELECT *, first_value(doc_id) OVER w AS keep_id, count(*) OVER (PARTITION BY text_sha256) AS group_size,
         max(n) OVER (PARTITION BY text_sha256) AS longest
  FROM t WINDOW w AS (PARTITION BY text_sha256 ORDER BY n DESC, doc_id))
SELECT doc_id, keep_id, group_size, doc_id = keep_id AND n = longest AS kept, text_sha256 FROM g
"""

OP6_SQL = r"""
WITH d AS (
  SELECT doc_id, coalesce(source, '') AS source,
         len(list_filter(regexp_split_to_array(coalesce(text, ''), '[\x20\x09-\x0D]+'), lambda x: x <> '')) AS n_tokens
  FROM documents),
s AS (SELECT source, CAST(sum(n_tokens) AS DOUBLE) AS tokens FROM d GROUP BY source),
p AS (SELECT source, tokens, tokens / (SELECT sum(tokens) FROM s) AS share FROM s WHERE tokens > 0),
steps AS (
  SELECT k, max(pow(share, k / 1024.0) / share) / min(pow(share, k / 1024.0) / share) AS passes
  FROM p, range(0, 1025) r(k) GROUP BY k),
chosen AS (SELECT min(k) AS k FROM steps WHERE passes <= 2.0),
w AS (SELECT source, tokens, pow(share, (SELECT k FROM chosen) / 1024.0) AS power FROM p),
b AS (SELECT sum(power) AS z, sum(power) / min(power / tokens) AS budget FROM w),
q AS (SELECT source, CAST(tokens AS BIGINT) AS tokens, CAST(round(power / z * budget) AS BIGINT) AS quota FROM w, b),
o AS (
  SELECT d.doc_id, d.source, d.n_tokens, coalesce(quota // tokens, 1) AS passes, coalesce(quota % tokens, 0) AS rest,
         md5('1|' || coalesce(quota // tokens, 1) || '|' || coalesce(CAST(doc_id AS VARCHAR), '')) AS k
  FROM d LEFT JOIN q USING (source)),
c AS (SELECT *, sum(n_tokens) OVER (PARTITION BY source ORDER BY k) AS upto FROM o)
SELECT doc_id, source, CAST(n_tokens AS BIGINT) AS n_tokens,
       CAST(passes + CASE WHEN rest > 0 AND upto <= rest THEN 1 ELSE 0 END AS BIGINT) AS copies
FROM c
"""


# Windows as joined words, looked up at every place of every document.
OP11_SQL = r"""
WITH d AS (
  SELECT row_number() OVER () AS r, doc_id, regexp_extract_all(
    translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS w
  FROM documents),
b AS (
  SELECT item_id, regexp_extract_all(
    translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS w
  FROM benchmark),
windows AS (
  SELECT DISTINCT item_id, least(len(w), 10) AS k, array_to_string(w[i : i + least(len(w), 10) - 1], ' ') AS words
  FROM (SELECT item_id, w, unnest(generate_series(1, len(w) - least(len(w), 10) + 1)) AS i FROM b WHERE len(w) > 0)),
sizes AS (SELECT DISTINCT k FROM windows),
places AS (
  SELECT r, k, i, array_to_string(w[i : i + k - 1], ' ') AS words
  FROM (SELECT r, w, k, unnest(generate_series(1, len(w) - k + 1)) AS i FROM d, sizes WHERE len(w) >= k)),
hits AS (SELECT p.r, p.k, p.i, v.item_id FROM places p JOIN windows v ON p.words = v.words AND p.k = v.k),
marked AS (
  SELECT r, count(DISTINCT j) AS n_hit
  FROM (SELECT r, unnest(generate_series(i, i + k - 1)) AS j FROM (SELECT DISTINCT r, k, i FROM hits)) GROUP BY r),
items AS (
  SELECT r, count(*) AS n_items, string_agg(name, ',' ORDER BY name) AS names
  FROM (SELECT DISTINCT r, CAST(item_id AS VARCHAR) AS name FROM hits) GROUP BY r)
SELECT doc_id, CAST(len(w) AS BIGINT) AS n_words, coalesce(n_hit, 0) AS n_hit, coalesce(n_items, 0) AS n_items,
       sha256(coalesce(names, '')) AS items_sha256, coalesce(n_hit, 0) > 0 AS contaminated
FROM d LEFT JOIN marked USING (r) LEFT JOIN items USING (r)
"""

# DuckDB's edit distance counts bytes, so each letter beyond ASCII is written as an ASCII character that no word holds.
_WIDE = "".join(map(chr, range(0xC0, 0x100)))
_NARROW = "".join(chr(c) for c in range(0x21, 0x7F) if not chr(c).islower() and c != 0x27)[: len(_WIDE)]

# crc32 bit by bit for the table and byte by byte for the words; all pairs by edit distance; chains by recursion.
OP13_SQL = r"""
WITH RECURSIVE t AS (
  SELECT list(list_reduce([i, 1, 1, 1, 1, 1, 1, 1, 1],
    lambda c, x: CASE WHEN c % 2 = 1 THEN xor(c >> 1, 3988292384) ELSE c >> 1 END) ORDER BY i) AS crc
  FROM range(0, 256) r(i)),
runs AS (
  SELECT doc_id, unnest(regexp_extract_all(
    translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[A-Za-z\x{C0}-\x{FF}]+')) AS run
  FROM documents),
counted AS (SELECT doc_id, run, count(*) AS n FROM runs WHERE length(run) >= 6 GROUP BY ALL),
summed AS (
  SELECT run, n, xor(list_reduce([4294967295] || flatten(list_transform(
      string_split(coalesce(CAST(doc_id AS VARCHAR), '') || ':' || run, ''),
      lambda c: CASE WHEN unicode(c) < 128 THEN [CAST(unicode(c) AS BIGINT)] ELSE [195, CAST(unicode(c) - 64 AS BIGINT)] END)),
    lambda c, b: xor(c >> 8, crc[CAST(1 + (xor(c, b) & 255) AS INTEGER)])), 4294967295) AS h
  FROM counted, t),
words AS (
  SELECT CASE WHEN h % 199 = 0 THEN left(run, CAST(h % length(run) AS INTEGER))
              || substr(run, CAST(h % length(run) AS INTEGER) + 2) ELSE run END AS word, CAST(sum(n) AS BIGINT) AS n
  FROM summed GROUP BY word HAVING length(word) >= 6 AND sum(n) >= 5),
plain AS (SELECT word, n, translate(word, '<wide>', '<narrow>') AS p FROM words),
pairs AS (
  SELECT a.word, a.n, b.word AS other, b.n AS m FROM plain a JOIN plain b
  ON a.word <> b.word AND abs(length(a.p) - length(b.p)) <= 1 AND levenshtein(a.p, b.p) = 1),
best AS (
  SELECT word, count(*) AS n_near, arg_min(other, (-m, other)) AS other, max(m) AS m FROM pairs GROUP BY word),
forms AS (
  SELECT w.word, CASE WHEN m >= 5 * n THEN other END AS form, n, coalesce(n_near, 0) AS n_near,
         CASE WHEN m >= 5 * n THEN m END AS form_n
  FROM words w LEFT JOIN best USING (word)),
chain AS (
  SELECT word, word AS at FROM forms
  UNION ALL
  SELECT c.word, f.form FROM chain c JOIN forms f ON f.word = c.at WHERE f.form IS NOT NULL),
ends AS (SELECT c.word, c.at AS root FROM chain c JOIN forms f ON f.word = c.at WHERE f.form IS NULL)
SELECT f.word, f.form, e.root, f.n, f.n_near, f.form_n FROM forms f JOIN ends e USING (word)
""".replace("<wide>", _WIDE).replace("<narrow>", _NARROW)


def oracle_sql() -> dict[str, str]:
    return {"op1_embedding_near_dedup": OP1_SQL, "op2_exact_dedup": OP2_SQL, "op6_temperature_mixing": OP6_SQL,
            "op11_benchmark_decontamination": OP11_SQL, "op13_spelling_variants": OP13_SQL}
