"""One query per text operator, with production parameters, over its whole table."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from pointframe.llm import alignment, centroids, fingerprints, htmltext, langid, licenses, mixing, neardup, oracle, packing, quality, sharding, simple8b, urlrep

TOKENIZER = "byte_bpe_50k.json"
PIECES = "piece_bpe_32k.model"
URL_RULES = [("allow", "org/"), ("block", "example.org/es/"), ("block", "example.org/en/1"), ("allow", "com/fr/"), ("block", "com/de/")]


def tokenizer_path(name: str = TOKENIZER) -> str:
    """Place of a public tokenizer file, the same on every machine."""
    import public_tokenizers

    return str(public_tokenizers.path(name))


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def page_outcomes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """page_id and bad, from the labels of the document that a page shows (the number that ends its path)."""
    path = F.regexp_extract("url", r"://[^/?#]*([^?#]*)", 1)
    shown = table(spark, sf_dir, "pages").select("page_id", F.regexp_extract(path, r"/(\d{1,18})(?:\.html)?/?\z", 1).try_cast("long").alias("doc_id"))
    labels = table(spark, sf_dir, "labels").select("doc_id", ((F.col("quality") == 0) | (F.col("toxic") == 1)).alias("bad"))
    return shown.where(F.col("doc_id").isNotNull()).join(labels, "doc_id").select("page_id", "bad")


def op1_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    return langid.identify(docs, langid.fit(docs))


def op2_token_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    return simple8b.encode_documents(table(spark, sf_dir, "documents"), tokenizer_path(), end_id=2)


def op3_near_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return neardup.near_duplicates(table(spark, sf_dir, "documents"), width=3, percent=85)


def op4_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    judged = quality.quality_rules(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))
    return judged.select("doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "kept", "anomaly")


def op5_license_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    return licenses.scan(table(spark, sf_dir, "documents"))


def op6_html_text(spark: SparkSession, sf_dir: str) -> DataFrame:
    return htmltext.extract(table(spark, sf_dir, "pages"))


def op7_mix_sources(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mixing.mix(table(spark, sf_dir, "documents"))


def op8_pack_sequences(spark: SparkSession, sf_dir: str) -> DataFrame:
    return packing.pack_documents(table(spark, sf_dir, "documents"), tokenizer_path(), size=2048, end_id=0)


def op9_url_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    return urlrep.judge_urls(table(spark, sf_dir, "pages"), page_outcomes(spark, sf_dir), URL_RULES)


def op10_fingerprints(spark: SparkSession, sf_dir: str) -> DataFrame:
    return fingerprints.fingerprint_edits(table(spark, sf_dir, "documents"))


def op11_shard_documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    return sharding.shard_documents(table(spark, sf_dir, "documents"), 40)


def op12_centroid_clusters(spark: SparkSession, sf_dir: str) -> DataFrame:
    return centroids.lloyd(table(spark, sf_dir, "embeddings"), k=16, rounds=3)


def op13_align_tokens(spark: SparkSession, sf_dir: str) -> DataFrame:
    return alignment.align_tokens(table(spark, sf_dir, "documents"), tokenizer_path(), tokenizer_path(PIECES))


def pipeline(spark: SparkSession, sf_dir: str) -> DataFrame:
    import corpus_pipeline

    return corpus_pipeline.run(spark, sf_dir)


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    ops = [op1_language_id, op2_token_files, op3_near_dedup, op4_quality_rules, op5_license_scan, op6_html_text, op7_mix_sources, op8_pack_sequences, op9_url_filter, op10_fingerprints, op11_shard_documents, op12_centroid_clusters, op13_align_tokens, pipeline]
    return {f.__name__: f for f in ops}


def oracle_sql() -> dict[str, str]:
    """What SQL can express as a whole; tests/llm holds the others against brute force."""
    return {"op5_license_scan": oracle.op5(), "op9_url_filter": oracle.op9(URL_RULES)}
