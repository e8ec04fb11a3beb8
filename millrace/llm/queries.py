"""The thin queries of the corpus operators, with production parameters, and their SQL."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from millrace.llm.common import read_table


def vocab_path(name: str = "byte_bpe_50k.json") -> str:
    import public_tokenizers

    return str(public_tokenizers.path(name))


def op1_bpe_round_trip(spark: SparkSession, sf_dir: str) -> DataFrame:
    from millrace.llm.bpe import encode

    coded = encode(read_table(spark, sf_dir, "documents"), vocab_path(), decode_too=True, memo=4_000_000, keep_memo=True, batch_bytes=4_000_000)
    ids = F.array_join(F.col("ids").cast("array<string>"), ",")
    return coded.select("doc_id", F.size("ids").cast("long").alias("n_tokens"), F.sha2(ids, 256).alias("ids_sha256"), F.sha2("decoded", 256).alias("decoded_sha256"))


def op2_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    from millrace.llm.token_count import token_counts

    return token_counts(read_table(spark, sf_dir, "documents"), vocab_path())


def op3_rotated_code_near_duplicates(spark: SparkSession, sf_dir: str) -> DataFrame:
    from millrace.llm.embedding_dedup import near_duplicate_vectors

    return near_duplicate_vectors(read_table(spark, sf_dir, "embeddings"))


def op4_hypergeometric_shards(spark: SparkSession, sf_dir: str) -> DataFrame:
    from millrace.llm.sharding import shard_digest

    return shard_digest(read_table(spark, sf_dir, "documents"), 40)


def op5_stupid_backoff(spark: SparkSession, sf_dir: str) -> DataFrame:
    from millrace.llm.lm_score import lm_scores

    scores = lm_scores(read_table(spark, sf_dir, "documents"))
    return scores.select("doc_id", "n_words", F.round("log_score", 4).alias("log_score"), F.round("mean_log_score", 6).alias("mean_log_score"))


def op6_bottom_k_near_duplicates(spark: SparkSession, sf_dir: str) -> DataFrame:
    from millrace.llm.minhash import near_duplicates

    return near_duplicates(read_table(spark, sf_dir, "documents"), width=4)


def op7_license_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    from millrace.llm.license_scan import license_scan

    return license_scan(read_table(spark, sf_dir, "documents"))


def op8_toxicity_neighbours(spark: SparkSession, sf_dir: str) -> DataFrame:
    from millrace.llm.toxicity import toxicity_scores

    return toxicity_scores(read_table(spark, sf_dir, "documents"), read_table(spark, sf_dir, "labels"))


def op9_spaced_seed_overlaps(spark: SparkSession, sf_dir: str) -> DataFrame:
    from millrace.llm.decontaminate import contaminated

    return contaminated(read_table(spark, sf_dir, "documents"), read_table(spark, sf_dir, "benchmark"))


def op10_latent_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    from millrace.llm.quality import quality_scores

    return quality_scores(read_table(spark, sf_dir, "documents"), read_table(spark, sf_dir, "labels"))


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return {f.__name__: f for f in (op1_bpe_round_trip, op2_token_counts, op3_rotated_code_near_duplicates, op4_hypergeometric_shards, op5_stupid_backoff, op6_bottom_k_near_duplicates, op7_license_scan, op8_toxicity_neighbours, op9_spaced_seed_overlaps, op10_latent_quality)}


#: Words as the operators cut them: A-Z lowered, between ASCII white space.
_WORDS = "list_filter(regexp_split_to_array(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[\\x20\\x09-\\x0D]+'), lambda x: x <> '')"

OP5_SQL = f"""
WITH docs AS (SELECT doc_id, {_WORDS} AS words FROM documents),
places AS (
  SELECT doc_id, i, words[i] AS w, CASE WHEN i > 1 THEN words[i - 1] END AS w1, CASE WHEN i > 2 THEN words[i - 2] END AS w2
  FROM (SELECT doc_id, words, unnest(range(1, len(words) + 1)) AS i FROM docs)
),
c1 AS (SELECT w, count(*) AS n FROM places GROUP BY w),
c2 AS (SELECT w1, w, count(*) AS n FROM places WHERE w1 IS NOT NULL GROUP BY w1, w HAVING count(*) >= 2),
c3 AS (SELECT w2, w1, w, count(*) AS n FROM places WHERE w2 IS NOT NULL GROUP BY w2, w1, w HAVING count(*) >= 2),
scored AS (
  SELECT p.doc_id,
    CASE
      WHEN t.n IS NOT NULL THEN ln(t.n / tc.n)
      WHEN b.n IS NOT NULL THEN ln(b.n / bc.n) + CASE WHEN p.w2 IS NOT NULL THEN ln(0.4) ELSE 0 END
      ELSE ln(u.n / (SELECT count(*) FROM places)) + CASE WHEN p.w2 IS NOT NULL THEN 2 * ln(0.4) WHEN p.w1 IS NOT NULL THEN ln(0.4) ELSE 0 END
    END AS s
  FROM places p
  JOIN c1 u ON u.w = p.w
  LEFT JOIN c2 b ON b.w1 = p.w1 AND b.w = p.w
  LEFT JOIN c1 bc ON bc.w = p.w1
  LEFT JOIN c3 t ON t.w2 = p.w2 AND t.w1 = p.w1 AND t.w = p.w
  LEFT JOIN c2 tc ON tc.w1 = p.w2 AND tc.w = p.w1
)
SELECT d.doc_id, len(d.words)::BIGINT AS n_words, round(coalesce(s.s, 0), 4) AS log_score, round(s.s / len(d.words), 6) AS mean_log_score
FROM docs d LEFT JOIN (SELECT doc_id, sum(s) AS s FROM scored GROUP BY doc_id) s USING (doc_id)
"""


def oracle_sql() -> dict[str, str]:
    return {"op5_stupid_backoff": OP5_SQL}
