"""The opN queries over the driver's tables, and SQL where SQL can express them."""

from __future__ import annotations

from collections.abc import Callable

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from haggleframe.llm import alignment, encoding, exact_dedup, imatch, jaccard_join, language_id, language_model, packing, quality, sharding, simhash, spelling, substring_dedup
from haggleframe.llm.common import fold

MULTI, ENGLISH, PIECES = "byte_bpe_multi_50k.tiktoken", "byte_bpe_50k.json", "piece_bpe_32k.model"


def documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/documents.parquet")


def op1_bloom_language(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = documents(spark, sf_dir)
    held_out = fold(F.col("doc_id"), 3) == 1
    model = language_id.train(docs.filter(~held_out))
    out = language_id.predict(docs.select("doc_id", held_out.alias("held_out"), "text"), model)
    return out.select("doc_id", "held_out", "lang_pred", "score")


def op2_window_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = documents(spark, sf_dir).select("doc_id", "text")
    return substring_dedup.remove_repeats(docs, window=20).select("doc_id", "n_words", "n_removed", "kept_sha256")


def op3_digest_index(spark: SparkSession, sf_dir: str) -> DataFrame:
    return exact_dedup.classify(documents(spark, sf_dir), exact_dedup.fresh_index(spark))


def quality_scores(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """Score and predict quality with a network that hasn't seen the held-out fifth of the labels."""
    net = quality.train(docs, labels.filter(fold(F.col("doc_id"), 5) != 0))
    return quality.score(docs, net).withColumn("predicted", (F.col("score") >= 0.3).cast("int"))


def op4_byte_cnn(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = documents(spark, sf_dir).select("doc_id", "text")
    out = quality_scores(docs, spark.read.parquet(f"{sf_dir}/labels.parquet"))
    return out.select("doc_id", (fold(F.col("doc_id"), 5) == 0).alias("held_out"), "score", "predicted")


def op5_multi_index_simhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    return simhash.cluster(documents(spark, sf_dir), reach=4, segments=2, shingle=4).select("doc_id", "fingerprint", "component_id")


def op6_backoff_automaton(spark: SparkSession, sf_dir: str) -> DataFrame:
    held_out = fold(F.col("doc_id"), 5) == 1
    out = language_model.score(documents(spark, sf_dir).select("doc_id", "text"), ~held_out)
    return out.select("doc_id", held_out.alias("held_out"), "n_tokens", "n_known", "train_tokens", "base_score", "score")


def op7_byte_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    return encoding.digests(documents(spark, sf_dir), public_tokenizers.path(MULTI))


def op8_imatch(spark: SparkSession, sf_dir: str) -> DataFrame:
    return imatch.fingerprint_edits(documents(spark, sf_dir))


def op9_best_two_fit(spark: SparkSession, sf_dir: str) -> DataFrame:
    return packing.pack_documents(documents(spark, sf_dir), public_tokenizers.path(ENGLISH), 2048)


def op10_bounded_ring(spark: SparkSession, sf_dir: str) -> DataFrame:
    return sharding.assign(documents(spark, sf_dir), 24)


def op11_interval_alignment(spark: SparkSession, sf_dir: str) -> DataFrame:
    return alignment.align_documents(documents(spark, sf_dir), public_tokenizers.path(ENGLISH), public_tokenizers.path(PIECES))


def op12_prefix_tree_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    return jaccard_join.cluster(documents(spark, sf_dir), size=5, percent=80)


def op13_wildcard_spelling(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spelling.variants(documents(spark, sf_dir))


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    "op1_bloom_language": op1_bloom_language,
    "op2_window_dedup": op2_window_dedup,
    "op3_digest_index": op3_digest_index,
    "op4_byte_cnn": op4_byte_cnn,
    "op5_multi_index_simhash": op5_multi_index_simhash,
    "op6_backoff_automaton": op6_backoff_automaton,
    "op7_byte_bpe": op7_byte_bpe,
    "op8_imatch": op8_imatch,
    "op9_best_two_fit": op9_best_two_fit,
    "op10_bounded_ring": op10_bounded_ring,
    "op11_interval_alignment": op11_interval_alignment,
    "op12_prefix_tree_join": op12_prefix_tree_join,
    "op13_wildcard_spelling": op13_wildcard_spelling,
}

ORACLES: dict[str, str] = {
    "op2_window_dedup": r"""
        WITH w AS (SELECT doc_id, regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+') AS w FROM documents),
             p AS (SELECT doc_id, w, unnest(range(1, greatest(len(w) - 18, 1))) AS i FROM w), k AS (SELECT doc_id, i, array_to_string(w[i:i + 19], ' ') AS k FROM p),
             f AS (SELECT doc_id, i, row_number() OVER (PARTITION BY k ORDER BY doc_id, i) AS n FROM k), g AS (SELECT DISTINCT doc_id, unnest(range(i, i + 20)) AS j FROM f WHERE n > 1),
             e AS (SELECT doc_id, unnest(w) AS word, unnest(range(1, len(w) + 1)) AS j FROM w),
             s AS (SELECT doc_id, string_agg(word, ' ' ORDER BY e.j) AS kept, count(*) AS n FROM e ANTI JOIN g USING (doc_id, j) GROUP BY doc_id)
        SELECT w.doc_id, CAST(len(w.w) AS BIGINT) AS n_words, CAST(len(w.w) - coalesce(s.n, 0) AS BIGINT) AS n_removed, sha256(coalesce(s.kept, '')) AS kept_sha256 FROM w LEFT JOIN s USING (doc_id)""",
    "op3_digest_index": r"""
        WITH t AS (SELECT doc_id, sha256(regexp_replace(coalesce(text, ''), '[\x20\x09-\x0D]+', ' ', 'g')) AS h FROM documents),
             g AS (SELECT h, min(doc_id) AS keep_id, count(*) AS group_size FROM t GROUP BY h)
        SELECT doc_id, keep_id, group_size, doc_id = keep_id AS kept, t.h AS text_sha256 FROM t JOIN g USING (h)""",
    "op12_prefix_tree_join": r"""
        WITH RECURSIVE w AS (SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x20\x09-\x0D]+') AS w FROM documents),
             s AS (SELECT DISTINCT doc_id, unnest(CASE WHEN len(w) = 0 THEN [] WHEN len(w) < 5 THEN [array_to_string(w, ' ')] ELSE list_transform(range(1, len(w) - 3), lambda i: array_to_string(w[i:i + 4], ' ')) END) AS g FROM w),
             n AS (SELECT doc_id, count(*) AS n FROM s GROUP BY doc_id), c AS (SELECT a.doc_id AS a, b.doc_id AS b, count(*) AS both_have FROM s a JOIN s b ON a.g = b.g AND a.doc_id < b.doc_id GROUP BY ALL),
             e AS (SELECT a, b FROM c JOIN n x ON x.doc_id = a JOIN n y ON y.doc_id = b WHERE 100 * both_have >= 80 * (x.n + y.n - both_have)), d AS (SELECT a, b FROM e UNION ALL SELECT b, a FROM e),
             r AS (SELECT a AS id, a AS c FROM d UNION SELECT d.b, r.c FROM r JOIN d ON d.a = r.id), m AS (SELECT id, min(c) AS c FROM r GROUP BY id)
        SELECT w.doc_id, coalesce(n.n, 0) AS n_shingles, coalesce(m.c, w.doc_id) AS component_id FROM w LEFT JOIN n USING (doc_id) LEFT JOIN m ON m.id = w.doc_id""",
}
