"""The ``opN_<name>`` queries over the driver's tables, and their SQL where SQL can express them."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def _table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def op1_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .langid import identify, learn

    docs = _table(spark, sf_dir, "documents")
    held_out = F.coalesce(F.crc32(F.col("doc_id").cast("string")) % 4 == 2, F.lit(False))
    model = learn(docs.where(~held_out))
    return identify(docs, model).select("doc_id", held_out.alias("held_out"), "lang_pred", "score", "family")


def op2_bpe_chunks(spark: SparkSession, sf_dir: str) -> DataFrame:
    import public_tokenizers

    from .bpe import digests

    return digests(_table(spark, sf_dir, "documents"), public_tokenizers.path("word_bpe_49k.json"))


def op3_url_filters(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .urlfilter import judge, page_edges

    pages = _table(spark, sf_dir, "pages")
    return judge(pages, page_edges(pages))


def op4_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .mixing import in_training_order, mix

    mixed = in_training_order(mix(_table(spark, sf_dir, "documents")))
    places = F.array_join(F.transform("positions", lambda x: F.round(x * 1_000_000).cast("long")), ",")
    return mixed.select("doc_id", "size", "source_size", F.round("target", 6).alias("target"), "taken", "copies", F.round("position", 9).alias("position"), places.alias("positions_ppm"))


def op5_simhash_golay(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .simhash import near_duplicates

    return near_duplicates(_table(spark, sf_dir, "documents")).select("doc_id", "fingerprint", "component_id")


def op6_license_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .licenses import scan

    return scan(_table(spark, sf_dir, "documents"))


def op7_lm_scores(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .lm import score

    return score(_table(spark, sf_dir, "documents"))


def op8_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .linededup import repeated_spans

    return repeated_spans(_table(spark, sf_dir, "documents")).drop("row_hash")


def op9_embedding_dups(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .embeddings import near_duplicates

    return near_duplicates(_table(spark, sf_dir, "embeddings"))


def op10_audio_features(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .media import audio_features, to_audio

    found = audio_features(to_audio(_table(spark, sf_dir, "documents")))
    return found.select("doc_id", "n_bytes", "payload_bytes", "payload_sha256", "tail_crc32", "media_bytes", "media_sha256", "feature")


def op11_substring_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .substrings import repeated_bytes

    found = repeated_bytes(_table(spark, sf_dir, "documents"))
    removed = F.aggregate("spans", F.lit(0).cast("long"), lambda n, s: n + s["end"] - s["start"])
    return found.select("doc_id", "n_bytes", removed.alias("n_removed"), F.size("spans").cast("long").alias("n_spans"), F.sha2("kept", 256).alias("kept_sha256"))


def op12_hard_negatives(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .negatives import mine

    vectors = _table(spark, sf_dir, "embeddings")
    label = F.when(F.col("vec_id") % 7 == 0, (F.col("label") + 1) % 10).otherwise(F.col("label"))
    return mine(vectors.withColumn("label", label), F.col("vec_id") % 100 == 0)


def op13_filter_audit(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .audit import audit

    return audit(_table(spark, sf_dir, "documents"), _table(spark, sf_dir, "labels"))


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    every = (op1_language_id, op2_bpe_chunks, op3_url_filters, op4_mixing, op5_simhash_golay, op6_license_scan, op7_lm_scores, op8_line_dedup, op9_embedding_dups, op10_audio_features, op11_substring_dedup, op12_hard_negatives, op13_filter_audit)
    return {f.__name__: f for f in every}


def oracle_sql() -> dict[str, str]:
    """Languages, tokens, fingerprints over XXH64, models, spans and files are beyond SQL: tested by brute force."""
    from . import audit, embeddings, licenses, mixing, negatives, urlfilter

    return {"op3_url_filters": urlfilter.SQL, "op4_mixing": mixing.sql(), "op6_license_scan": licenses.sql(), "op9_embedding_dups": embeddings.sql(), "op12_hard_negatives": negatives.sql(), "op13_filter_audit": audit.SQL}
