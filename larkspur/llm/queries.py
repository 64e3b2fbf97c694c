"""One query for each operator of this subpackage, over its whole table, and their SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from larkspur.llm import bloom_lm, language_id, lattice_dedup, line_dedup, mixing, ngram_join, packing, quality, suffix_dedup, toxicity
from larkspur.llm._common import cut, remainder, table

WORD = "[^\\x20\\x09-\\x0D]+"


def word_count():
    return F.coalesce(F.regexp_count("text", F.lit(WORD)), F.lit(0)).cast("long")


def op1_mix(spark: SparkSession, sf_dir: str) -> DataFrame:
    sized = table(spark, sf_dir, "documents").select("doc_id", "source", word_count().alias("size"))
    return mixing.mix(cut(sized))


def op5_pack(spark: SparkSession, sf_dir: str) -> DataFrame:
    import public_tokenizers

    return packing.pack(packing.pieces(table(spark, sf_dir, "documents"), public_tokenizers.path("word_bpe_49k.json")))


def op6_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    return quality.judge(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))


def op7_language(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    model = language_id.fit(docs, remainder(4) != 2)
    return language_id.identify(docs, model).select("doc_id", (remainder(4) == 2).alias("held_out"), "lang_pred", "score", "rejected")


def op8_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    model = toxicity.fit(docs, table(spark, sf_dir, "labels"), remainder(5) != 0)
    return toxicity.rate(docs, model).select("doc_id", (remainder(5) == 0).alias("held_out"), "score", "predicted")


def op10_jaccard(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ngram_join.link_components(table(spark, sf_dir, "documents"), 3, 90).select("doc_id", "n_shingles", "component_id")


def op3_bloom_lm(spark: SparkSession, sf_dir: str) -> DataFrame:
    return bloom_lm.score(table(spark, sf_dir, "documents"), remainder(5) == 1)


def op2_lattice(spark: SparkSession, sf_dir: str) -> DataFrame:
    return lattice_dedup.link(table(spark, sf_dir, "embeddings"))


def op4_lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = line_dedup.drop_repeated_lines(table(spark, sf_dir, "documents"))
    return docs.select("doc_id", "n_lines", "n_removed", F.length("text").cast("long").alias("kept_chars"), F.md5(F.col("text").cast("binary")).alias("kept_md5"))


def op9_suffix(spark: SparkSession, sf_dir: str) -> DataFrame:
    got = suffix_dedup.strip_repeats(table(spark, sf_dir, "documents"))
    return got.select("doc_id", "n_bytes", "n_removed", "n_spans", F.sha2("kept", 256).alias("kept_sha256"))


QUERIES = {
    "op1_mix": op1_mix,
    "op2_lattice": op2_lattice,
    "op3_bloom_lm": op3_bloom_lm,
    "op4_lines": op4_lines,
    "op5_pack": op5_pack,
    "op6_quality": op6_quality,
    "op7_language": op7_language,
    "op8_toxicity": op8_toxicity,
    "op9_suffix": op9_suffix,
    "op10_jaccard": op10_jaccard,
}

_OP4_SQL = """
WITH docs AS (SELECT row_number() OVER (ORDER BY doc_id) AS r, doc_id, text FROM documents),
lines AS (
  SELECT r, i - 1 AS pos, l AS line, list_distinct(regexp_extract_all(l, '[^\\x20\\x09-\\x0D]+')) AS words
  FROM (SELECT r, unnest(string_split(text, chr(10))) AS l, unnest(range(1, len(string_split(text, chr(10))) + 1)) AS i FROM docs WHERE text IS NOT NULL)
),
big AS (SELECT r, pos, list_sort(words) AS words, len(words) AS n FROM lines WHERE len(words) >= 5),
sets AS (SELECT words, any_value(n) AS n, min(struct_pack(r := r, pos := pos)) AS first FROM big GROUP BY words),
rarity AS (SELECT w, count(*) AS df FROM (SELECT unnest(words) AS w FROM sets) GROUP BY w),
ranked AS (
  SELECT s.words, s.n, s.first, t.w, row_number() OVER (PARTITION BY s.first ORDER BY f.df, t.w) AS k
  FROM sets s, LATERAL (SELECT unnest(s.words) AS w) t JOIN rarity f ON f.w = t.w
),
prefix AS (SELECT * FROM ranked WHERE k <= n - CAST(ceil(90 * n / 100.0) AS BIGINT) + 1),
pairs AS (SELECT DISTINCT y.first AS later, y.words AS yw, x.words AS xw FROM prefix x JOIN prefix y ON x.w = y.w AND x.first < y.first),
near AS (
  SELECT DISTINCT later FROM pairs
  WHERE 100 * len(list_intersect(xw, yw)) >= 90 * (len(xw) + len(yw) - len(list_intersect(xw, yw)))
),
gone AS (
  SELECT b.r, b.pos FROM big b JOIN sets s ON b.words = s.words LEFT JOIN near n ON n.later = s.first
  WHERE n.later IS NOT NULL OR struct_pack(r := b.r, pos := b.pos) <> s.first
),
kept AS (
  SELECT l.r, count(*) AS n_lines, count(g.pos) AS n_removed, string_agg(l.line, chr(10) ORDER BY l.pos) FILTER (WHERE g.pos IS NULL) AS text
  FROM lines l LEFT JOIN gone g ON g.r = l.r AND g.pos = l.pos GROUP BY l.r
)
SELECT d.doc_id, coalesce(k.n_lines, 0) AS n_lines, coalesce(k.n_removed, 0) AS n_removed,
  CASE WHEN d.text IS NOT NULL THEN length(coalesce(k.text, '')) END AS kept_chars,
  CASE WHEN d.text IS NOT NULL THEN md5(coalesce(k.text, '')) END AS kept_md5
FROM docs d LEFT JOIN kept k ON k.r = d.r
"""

#: The highest-quotient rule itself: every quotient is written out and ranked.
_OP1_SQL = """
WITH sized AS (
  SELECT doc_id, source, len(regexp_extract_all(coalesce(text, ''), '[^\\x20\\x09-\\x0D]+')) AS size, md5('mix:' || coalesce(CAST(doc_id AS VARCHAR), 'null')) AS ord
  FROM documents
),
per AS (SELECT source, CAST(sum(size) AS BIGINT) AS source_size, count(*) AS docs FROM sized GROUP BY source),
weighed AS (SELECT *, CAST([5, 2, 1][(row_number() OVER (ORDER BY source NULLS LAST) - 1) % 3 + 1] AS DOUBLE) AS weight, source_size * 3.0::DOUBLE AS cap FROM per),
levels AS (
  SELECT *, (sum(source_size) OVER () - coalesce(sum(cap) OVER b, 0)) / (sum(weight) OVER () - coalesce(sum(weight) OVER b, 0)) AS level
  FROM weighed WINDOW b AS (ORDER BY cap / weight, source NULLS LAST ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING)
),
targets AS (
  SELECT *, CASE WHEN cap / weight <= level THEN cap ELSE weight * max(level) FILTER (WHERE cap / weight > level) OVER () END AS target,
    sum(source_size) OVER () // 16 AS blocks FROM levels
),
quotients AS (
  SELECT source, source_size, blocks, target / (2 * k + 1) AS q, k
  FROM (SELECT *, unnest(range(0, CAST(ceil(target / 16) AS BIGINT) + 3)) AS k FROM targets WHERE target > 0)
),
seats AS (
  SELECT source, least(count(*), source_size * 3 // 16) AS quota
  FROM (SELECT *, row_number() OVER (ORDER BY q DESC, source NULLS FIRST, k) AS r FROM quotients) WHERE r <= blocks GROUP BY source, source_size
),
placed AS (
  SELECT d.*, t.source_size, t.target, CAST('0x' || substr(ord, 1, 8) AS BIGINT) % CAST(ceil(t.docs / 4096) AS BIGINT) AS shard
  FROM sized d JOIN targets t ON d.source IS NOT DISTINCT FROM t.source
),
shards AS (SELECT source, shard, CAST(sum(size) AS BIGINT) AS words FROM placed GROUP BY source, shard),
shard_quotients AS (
  SELECT h.source, h.shard, s.quota, h.words / (2 * k + 1) AS q, k
  FROM (SELECT *, unnest(range(0, words * 3 // 16 + 3)) AS k FROM shards WHERE words > 0) h JOIN seats s ON h.source IS NOT DISTINCT FROM s.source
),
shard_seats AS (
  SELECT source, shard, count(*) AS seats
  FROM (SELECT *, row_number() OVER (PARTITION BY source ORDER BY q DESC, shard, k) AS r FROM shard_quotients) WHERE r <= quota GROUP BY source, shard
),
ringed AS (
  SELECT p.*, h.words, least(coalesce(s.seats, 0) * 16, h.words * 3) AS take,
    coalesce(sum(size) OVER (PARTITION BY p.source, p.shard ORDER BY ord, doc_id, size ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS pos
  FROM placed p JOIN shards h ON p.source IS NOT DISTINCT FROM h.source AND p.shard = h.shard
  LEFT JOIN shard_seats s ON p.source IS NOT DISTINCT FROM s.source AND p.shard = s.shard
)
SELECT doc_id, source, size, source_size, target, CAST(w * size + part AS BIGINT) AS taken, CAST(w AS BIGINT) AS whole_turns, CAST(part AS BIGINT) AS part_words
FROM (SELECT *, greatest(least(pos + size, take - w * words) - pos, 0) AS part FROM (SELECT *, CASE WHEN words > 0 THEN take // words ELSE 0 END AS w FROM ringed))
"""

_OP10_SQL = """
WITH RECURSIVE worded AS (
  SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\\x20\\x09-\\x0D]+') AS w FROM documents
),
members AS (
  SELECT DISTINCT doc_id, CASE WHEN len(w) >= 3 THEN array_to_string(w[i:i + 2], ' ') ELSE array_to_string(w, ' ') END AS s
  FROM (SELECT doc_id, w, unnest(range(1, greatest(len(w) - 2, 1) + 1)) AS i FROM worded WHERE len(w) > 0)
),
sizes AS (SELECT doc_id, count(*) AS n FROM members GROUP BY doc_id),
links AS (
  SELECT a.doc_id AS x, b.doc_id AS y FROM members a JOIN members b ON a.s = b.s AND a.doc_id < b.doc_id
  JOIN sizes p ON p.doc_id = a.doc_id JOIN sizes q ON q.doc_id = b.doc_id
  GROUP BY a.doc_id, b.doc_id, p.n, q.n HAVING 100 * count(*) >= 90 * (p.n + q.n - count(*))
),
edges AS (SELECT x, y FROM links UNION ALL SELECT y, x FROM links),
reached AS (SELECT doc_id, doc_id AS root FROM documents UNION SELECT e.y, r.root FROM reached r JOIN edges e ON e.x = r.doc_id)
SELECT r.doc_id, coalesce(any_value(n), 0) AS n_shingles, min(root) AS component_id FROM reached r LEFT JOIN sizes s ON s.doc_id = r.doc_id GROUP BY r.doc_id
"""

ORACLE_SQL: dict[str, str] = {"op1_mix": _OP1_SQL, "op4_lines": _OP4_SQL, "op10_jaccard": _OP10_SQL}
