"""The registered queries of the training-data operators: thin, each over its whole table."""

from __future__ import annotations

from collections.abc import Callable

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import bpe_codec, html_text, line_dedup, media_chunks, order_minhash, phrase_index, pitman_yor, prefix_counts, source_mix, spelling_variants, token_planes, toxicity
from .common import table


def op1_media_chunks(spark: SparkSession, sf_dir: str) -> DataFrame:
    return media_chunks.media(table(spark, sf_dir, "documents"))


def op2_order_minhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = order_minhash.classes(table(spark, sf_dir, "documents"), similarity=0.8)
    return out.select("doc_id", "class_id", (F.col("doc_id") == F.col("class_id")).alias("kept"))


def op3_phrase_index(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = phrase_index.matches(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))
    return out.select(
        "doc_id",
        "n_words",
        "n_hit",
        F.size("item_ids").cast("long").alias("n_items"),
        F.sha2(F.array_join("item_ids", ","), 256).alias("items_sha256"),
        "contaminated",
    )


OP3_SQL = """
WITH d AS (
  SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'),
                                    '[^\\x00-\\x2F\\x3A-\\x60\\x7B-\\x7F]+') AS w FROM documents
), b AS (
  SELECT item_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'),
                                     '[^\\x00-\\x2F\\x3A-\\x60\\x7B-\\x7F]+') AS w FROM benchmark
), p AS (
  SELECT DISTINCT item_id, least(len(w), 10) AS n, array_to_string(w[i:i + 9], ' ') AS phrase
  FROM (SELECT item_id, w, unnest(range(1, greatest(len(w) - 9, 1) + 1)) AS i FROM b WHERE len(w) > 0)
), s AS (
  SELECT doc_id, w, unnest(range(1, len(w) + 1)) AS i FROM d
), m AS (
  SELECT s.doc_id, s.i, n.n, array_to_string(s.w[s.i:s.i + n.n - 1], ' ') AS phrase
  FROM s, (SELECT DISTINCT n FROM p) n WHERE s.i + n.n - 1 <= len(s.w)
), h AS (
  SELECT m.doc_id, m.i, m.n, p.item_id FROM m JOIN p ON m.phrase = p.phrase AND m.n = p.n
), k AS (
  SELECT doc_id, count(DISTINCT j) AS n_hit FROM (SELECT doc_id, unnest(range(i, i + n)) AS j FROM h) GROUP BY doc_id
), t AS (
  SELECT doc_id, count(*) AS n_items, string_agg(x, ',' ORDER BY x) AS ids
  FROM (SELECT DISTINCT doc_id, CAST(item_id AS VARCHAR) AS x FROM h) GROUP BY doc_id
)
SELECT d.doc_id, CAST(len(d.w) AS BIGINT) AS n_words, coalesce(k.n_hit, 0) AS n_hit, coalesce(t.n_items, 0) AS n_items,
       sha256(coalesce(t.ids, '')) AS items_sha256, coalesce(k.n_hit, 0) > 0 AS contaminated
FROM d LEFT JOIN k USING (doc_id) LEFT JOIN t USING (doc_id)
"""


def op4_pitman_yor(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pitman_yor.score(table(spark, sf_dir, "documents"))


def op5_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    return toxicity.classify(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"), threshold=0.7)


def op6_bpe_codec(spark: SparkSession, sf_dir: str) -> DataFrame:
    return bpe_codec.digests(table(spark, sf_dir, "documents"), public_tokenizers.path("byte_bpe_50k.json"))


def op7_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = line_dedup.dedup(table(spark, sf_dir, "documents"))
    return out.select("doc_id", "n_lines", "n_dropped", F.sha2(F.encode("kept", "UTF-8"), 256).alias("kept_sha256"))


def op8_html_text(spark: SparkSession, sf_dir: str) -> DataFrame:
    return html_text.extract(table(spark, sf_dir, "pages"))


def op9_token_planes(spark: SparkSession, sf_dir: str) -> DataFrame:
    files = token_planes.write_files(table(spark, sf_dir, "documents"), public_tokenizers.path("byte_bpe_50k.json"), end_id=0)
    return token_planes.read_files(files)


def op10_prefix_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = prefix_counts.prefix_counts(table(spark, sf_dir, "documents"), public_tokenizers.path("word_bpe_49k.json"), budget=2048)
    return out.select("doc_id", "n_bytes", "n_tokens", (F.col("n_tokens") > 2048).alias("over_limit"), "n_chars", "fit_chars")


def op11_source_mix(spark: SparkSession, sf_dir: str) -> DataFrame:
    return source_mix.mix(table(spark, sf_dir, "documents")).drop("source")


def op12_spelling_variants(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spelling_variants.variants(table(spark, sf_dir, "documents"))


OP7_SQL = """
WITH lines AS (
  SELECT doc_id, i AS pos, l AS line,
         translate(trim(l, E' \\t\\n\\x0b\\f\\r'), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS k
  FROM (SELECT doc_id, unnest(string_split(coalesce(text, ''), chr(10))) AS l,
               generate_subscripts(string_split(coalesce(text, ''), chr(10)), 1) AS i FROM documents)
), seen AS (
  SELECT k, min(doc_id) AS first FROM lines WHERE length(k) >= 10 GROUP BY k
), marked AS (
  SELECT l.*, coalesce(l.doc_id > s.first, false) AS dropped FROM lines l LEFT JOIN seen s ON l.k = s.k
)
SELECT doc_id, count(*) AS n_lines, count(*) FILTER (dropped) AS n_dropped,
       sha256(coalesce(string_agg(line, chr(10) ORDER BY pos) FILTER (NOT dropped), '')) AS kept_sha256
FROM marked GROUP BY doc_id
"""

OP11_SQL = """
WITH RECURSIVE d AS (
  SELECT doc_id, source, CAST(len(regexp_extract_all(coalesce(text, ''), '[^\\x20\\x09-\\x0D]+')) AS BIGINT) AS size,
         md5(concat('0:', coalesce(CAST(doc_id AS VARCHAR), ''), ':', coalesce(text, ''))) AS h FROM documents
), s AS (
  SELECT *, CASE (rank - 1) % 3 WHEN 0 THEN 3.0::DOUBLE WHEN 1 THEN 1.0::DOUBLE ELSE 2.0::DOUBLE END AS w, 2.0::DOUBLE * source_size AS cap FROM (
    SELECT source, CAST(sum(size) AS BIGINT) AS source_size, count(*) AS n_rows, row_number() OVER (ORDER BY source NULLS LAST) AS rank FROM d GROUP BY source)
), levels AS (
  SELECT 0 AS i, 1.5::DOUBLE * (SELECT sum(source_size) FROM s) / (SELECT sum(w) FROM s) AS level
  UNION ALL
  SELECT i + 1, (SELECT (1.5::DOUBLE * sum(source_size) - coalesce(sum(cap) FILTER (w * level > cap), 0)) / sum(w) FILTER (w * level <= cap) FROM s)
  FROM levels WHERE i < 30
), t AS (
  SELECT s.*, CASE WHEN w * level > cap THEN cap ELSE w * level END AS target, CAST(ceil((source_size + n_rows) / 1048576.0::DOUBLE) AS BIGINT) AS shards
  FROM s, (SELECT level FROM levels WHERE i = 30)
), p AS (
  SELECT d.*, t.rank, t.source_size, t.target, CAST('0x' || substr(h, 1, 15) AS BIGINT) % shards AS shard FROM d JOIN t ON d.source IS NOT DISTINCT FROM t.source
), c AS (
  SELECT rank, shard, cell_size, target * cell_size / source_size AS weight, CAST(ceil(cell_size / 16.0::DOUBLE) AS BIGINT) AS blocks
  FROM (SELECT rank, shard, CAST(sum(size) AS BIGINT) AS cell_size, any_value(target) AS target, any_value(source_size) AS source_size FROM p WHERE size > 0 GROUP BY rank, shard)
), seats AS (
  SELECT rank, shard, row_number() OVER (ORDER BY weight / (2 * j - 1) DESC, rank, shard, j) AS place
  FROM (SELECT *, unnest(range(1, 2 * blocks + 1)) AS j FROM c)
), q AS (
  SELECT c.*, coalesce(k.n, 0) // blocks AS rounds, coalesce(k.n, 0) % blocks AS rest, CAST('0x' || substr(md5(concat('0:', c.rank, ':', c.shard)), 1, 15) AS BIGINT) % blocks AS phase
  FROM c LEFT JOIN (
    SELECT rank, shard, count(*) AS n FROM seats WHERE place <= (SELECT CAST(floor(sum(weight) / 16 + 0.5) AS BIGINT) FROM c) GROUP BY rank, shard) k
  ON c.rank = k.rank AND c.shard = k.shard
), laid AS (
  SELECT p.*, coalesce(sum(size) OVER (PARTITION BY rank, shard ORDER BY h, doc_id ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS a FROM p WHERE size > 0
), z AS (
  SELECT l.*, q.rounds, q.blocks, q.rest, q.phase, CAST(l.a AS BIGINT) AS x, CAST(l.a + l.size AS BIGINT) AS y FROM laid l JOIN q ON l.rank = q.rank AND l.shard = q.shard
)
SELECT doc_id, size, source_size, target, CAST(rounds * size
       + 16 * ((y // 16 + phase) * rest // blocks - (x // 16 + phase) * rest // blocks)
       + CASE WHEN (y // 16 + phase) * rest % blocks >= blocks - rest THEN y % 16 ELSE 0 END
       - CASE WHEN (x // 16 + phase) * rest % blocks >= blocks - rest THEN x % 16 ELSE 0 END AS BIGINT) AS taken
FROM z UNION ALL SELECT doc_id, size, source_size, target, 0 FROM p WHERE size = 0
"""

def _crc_table() -> list[int]:
    """crc32 of the sixteen half bytes."""
    out = list(range(16))
    for _ in range(4):
        out = [(c >> 1) ^ (0xEDB88320 if c & 1 else 0) for c in out]
    return out


#: A step of crc32 by half a byte (a fixed polynomial), and letters as single bytes, which DuckDB's distance counts.
_CRC_STEP = "xor(c >> 4, list_extract([" + ", ".join(str(_c) for _c in _crc_table()) + "], CAST(xor(c, x) & 15 AS INTEGER) + 1))"
_LATIN, _BYTES = "".join(map(chr, range(0xC0, 0x100))), "".join(map(chr, range(0x21, 0x61))).replace("'", "''")

OP12_SQL = f"""
WITH RECURSIVE runs AS MATERIALIZED (
  SELECT d, run, count(*) AS k FROM (
    SELECT coalesce(CAST(doc_id AS VARCHAR), '') AS d,
           translate(unnest(regexp_extract_all(coalesce(text, ''), '[A-Za-z\\x{{00C0}}-\\x{{00FF}}]+')), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS run
    FROM documents) WHERE length(run) >= 6 GROUP BY d, run
), crc AS MATERIALIZED (
  SELECT run, k, xor(list_reduce(
      list_prepend(4294967295, flatten(list_transform(string_split_regex(rtrim(regexp_replace(hex(encode(d || ':' || run)), '(..)', '\\1 ', 'g')), ' '),
        lambda b: [instr('0123456789ABCDEF', b[2]) - 1, instr('0123456789ABCDEF', b[1]) - 1]))),
      lambda c, x: {_CRC_STEP}), 4294967295) AS h
  FROM runs
), words AS MATERIALIZED (
  SELECT word, CAST(sum(k) AS BIGINT) AS n, translate(word, '{_LATIN}', '{_BYTES}') AS b, length(word) AS len FROM (
    SELECT k, CASE WHEN h % 199 = 0 THEN substr(run, 1, CAST(h % length(run) AS BIGINT)) || substr(run, CAST(h % length(run) AS BIGINT) + 2) ELSE run END AS word FROM crc)
  WHERE length(word) >= 6 GROUP BY word HAVING sum(k) >= 5
), near AS MATERIALIZED (
  SELECT v.word, w.word AS other, w.n AS other_n FROM (SELECT *, unnest([len - 1, len, len + 1]) AS l FROM words) v
  JOIN words w ON w.len = v.l AND substr(w.word, 1, w.len // 2) = substr(v.word, 1, v.l // 2)
  WHERE levenshtein(v.b, w.b) = 1
  UNION
  SELECT v.word, w.word, w.n FROM (SELECT *, unnest([len - 1, len, len + 1]) AS l FROM words) v
  JOIN words w ON w.len = v.l AND substr(w.word, w.len // 2 + 1) = substr(v.word, v.len - (v.l - v.l // 2) + 1)
  WHERE levenshtein(v.b, w.b) = 1
), best AS (
  SELECT word, count(*) AS n_near, arg_min(other, struct_pack(a := -other_n, b := other)) AS near, max(other_n) AS near_n FROM near GROUP BY word
), form AS MATERIALIZED (
  SELECT w.word, w.n, coalesce(b.n_near, 0) AS n_near, CASE WHEN b.near_n >= 5 * w.n THEN b.near END AS form, CASE WHEN b.near_n >= 5 * w.n THEN b.near_n END AS form_n
  FROM words w LEFT JOIN best b ON w.word = b.word
), chain AS (
  SELECT word, word AS at, form AS next FROM form
  UNION ALL
  SELECT c.word, f.word, f.form FROM chain c JOIN form f ON c.next = f.word
)
SELECT f.word, f.form, c.at AS root, f.n, f.n_near, f.form_n FROM form f JOIN chain c ON f.word = c.word WHERE c.next IS NULL
"""

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    "op1_media_chunks": op1_media_chunks,
    "op2_order_minhash": op2_order_minhash,
    "op3_phrase_index": op3_phrase_index,
    "op4_pitman_yor": op4_pitman_yor,
    "op5_toxicity": op5_toxicity,
    "op6_bpe_codec": op6_bpe_codec,
    "op7_line_dedup": op7_line_dedup,
    "op8_html_text": op8_html_text,
    "op9_token_planes": op9_token_planes,
    "op10_prefix_counts": op10_prefix_counts,
    "op11_source_mix": op11_source_mix,
    "op12_spelling_variants": op12_spelling_variants,
}

ORACLES: dict[str, str] = {
    "op3_phrase_index": OP3_SQL,
    "op7_line_dedup": OP7_SQL,
    "op11_source_mix": OP11_SQL,
    "op12_spelling_variants": OP12_SQL,
}
