"""One query for each operator, over its whole table, and SQL where it can express one."""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession

from tidewell.llm import collocations, exact_dedup, html_main, language_id, licenses, neighbours, packing, pieces, quality, sharding, simhash, toxicity
from tidewell.llm.shared import table


def op1_simhash_pigeonring(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Fingerprints of 3-word shingles and components of links at two bits, of all documents."""
    return simhash.simhash_groups(table(spark, sf_dir, "documents"), words=3, max_bits=2)


def op2_rotated_bit_neighbours(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The 10 nearest of all embeddings for every hundredth one."""
    return neighbours.nearest_neighbours(table(spark, sf_dir, "embeddings"), k=10, every=100)


def op3_feistel_sharding(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Shard and slot of every document under the law `rows`."""
    return sharding.shard_rows(table(spark, sf_dir, "documents"), shards=16, seed=2026)


def op4_byte_gru_language(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Language of every document, learnt from those that are not held out."""
    return language_id.identify(table(spark, sf_dir, "documents"))


def op5_license_windows(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Licence texts found in all documents."""
    return licenses.scan_licenses(table(spark, sf_dir, "documents"))


def op6_nbsvm_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Quality of every document, learnt from labels.quality."""
    return quality.score(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))


def op7_merge_dropout_pieces(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Pieces of every document, merges skipped at a rate of 0.1."""
    return pieces.encode_texts(table(spark, sf_dir, "documents"), public_tokenizers.path("piece_bpe_32k.model"), rate=0.1, seed=2026)


def op8_bm25_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The pieces of all documents in windows of 4096 tokens, with a checksum in place of their ids."""
    path = public_tokenizers.path("word_bpe_49k.json")
    return packing.with_digest(packing.pack(table(spark, sf_dir, "documents"), path, end_id=2))


def op9_streaming_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Groups of equal documents and the row of each that stays."""
    return exact_dedup.exact_dedup(table(spark, sf_dir, "documents"))


def op10_consensus_html(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Main text of every page."""
    return html_main.main_text(table(spark, sf_dir, "pages"))


def op11_phrase_collocations(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Each language's best 2000 phrases of all documents."""
    return collocations.collocations(table(spark, sf_dir, "documents"))


def op12_kneser_ney_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Toxicity of every document, from class-conditional Kneser-Ney models of labels.toxic."""
    return toxicity.score(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))


QUERIES = {
    "op1_simhash_pigeonring": op1_simhash_pigeonring,
    "op2_rotated_bit_neighbours": op2_rotated_bit_neighbours,
    "op3_feistel_sharding": op3_feistel_sharding,
    "op4_byte_gru_language": op4_byte_gru_language,
    "op5_license_windows": op5_license_windows,
    "op6_nbsvm_quality": op6_nbsvm_quality,
    "op7_merge_dropout_pieces": op7_merge_dropout_pieces,
    "op8_bm25_packing": op8_bm25_packing,
    "op9_streaming_dedup": op9_streaming_dedup,
    "op10_consensus_html": op10_consensus_html,
    "op11_phrase_collocations": op11_phrase_collocations,
    "op12_kneser_ney_toxicity": op12_kneser_ney_toxicity,
}

ORACLE = {
    "op9_streaming_dedup": r"""
WITH d AS (
  SELECT doc_id, coalesce(text, '') AS t, regexp_replace(coalesce(text, ''), '[\x20\x09-\x0D]', '', 'g') AS clean FROM documents
), r AS (
  SELECT doc_id, clean, row_number() OVER (PARTITION BY clean ORDER BY length(t) DESC, doc_id) AS place FROM d
), g AS (
  SELECT clean, min(doc_id) FILTER (place = 1) AS keep_id, count(*) AS group_size FROM r GROUP BY clean
)
SELECT r.doc_id, g.keep_id, g.group_size, r.place = 1 AS kept, sha256(r.clean) AS text_sha256
FROM r JOIN g ON r.clean = g.clean
""",
    "op11_phrase_collocations": r"""
WITH d AS (
  SELECT coalesce(lang, 'und') AS lang, translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS t FROM documents
), s AS (
  SELECT lang, unnest(regexp_split_to_array(t, '[.,;:!?\x0A-\x0D]')) AS piece FROM d
), p AS (
  SELECT lang, list_filter(regexp_split_to_array(piece, '[\x20\x09]+'), lambda x: x <> '') AS words, count(*) AS copies FROM s GROUP BY ALL
), q AS (
  SELECT *, len(words) AS m FROM p WHERE len(words) > 0
), u AS (
  SELECT lang, sum(copies * m) AS n FROM q GROUP BY lang
), g AS (
  SELECT lang, k, array_to_string(words[i : i + k - 1], ' ') AS gram, sum(copies) AS f
  FROM (SELECT lang, copies, words, k, unnest(range(1, m - k + 2)) AS i FROM q, range(1, 6) AS t(k) WHERE m >= k) GROUP BY ALL HAVING sum(copies) >= 100
), c AS (
  SELECT lang, gram AS phrase, k AS size, f AS a, string_split(gram, ' ') AS words FROM g WHERE k > 1
), x AS (
  SELECT lang, phrase, a, k, array_to_string(words[1:k], ' ') AS first, array_to_string(words[k + 1:], ' ') AS rest FROM (SELECT *, unnest(range(1, size)) AS k FROM c)
), y AS (
  SELECT x.lang, phrase, a, x.k, l.f AS l, r.f AS r, n, (1000::HUGEINT * a * n) // (l.f::HUGEINT * r.f) AS score
  FROM x JOIN u USING (lang) JOIN g l ON l.lang = x.lang AND l.gram = first JOIN g r ON r.lang = x.lang AND r.gram = rest
), z AS (
  SELECT * FROM y QUALIFY row_number() OVER (PARTITION BY lang, phrase ORDER BY score, k) = 1
), o AS (
  SELECT lang, array_to_string(words[i : i + k - 1], ' ') AS phrase, max(a) AS inside
  FROM (SELECT *, unnest(range(1, size - k + 2)) AS i FROM (SELECT *, unnest(range(2, size)) AS k FROM c WHERE size > 2)) GROUP BY ALL
)
SELECT z.lang, row_number() OVER (PARTITION BY z.lang ORDER BY score DESC, a DESC, z.phrase) AS rank, z.phrase, a::BIGINT AS a, l::BIGINT AS l, r::BIGINT AS r, n::BIGINT AS n, score::BIGINT AS score
FROM z LEFT JOIN o ON o.lang = z.lang AND o.phrase = z.phrase WHERE inside IS NULL OR 100 * inside < 100 * a QUALIFY rank <= 2000
""",
}
