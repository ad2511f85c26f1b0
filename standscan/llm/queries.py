"""Registered queries of the training-data operators, with production parameters, and their SQL."""

from __future__ import annotations

import functools
from collections.abc import Callable

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from standscan.llm import bpe, classifier, divergence, jaccard, langid, licenses, merkle, mixing, quality_rules, topk, url_filter, warc, wavelet
from standscan.llm.batches import small_batches
from standscan.session import table

VOCABULARY = "byte_bpe_50k.tiktoken"
WORDS = "word_bpe_49k.json"
END_ID = 2


def fold(id_col: str, folds: int):
    """The remainder of the checksum of the id as text; null for a null id."""
    return F.crc32(F.col(id_col).cast("string").cast("binary")) % folds


def op1_warc_salvage(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every page written to archives and read back. Null html is an empty payload; copies are revisits of the largest id; very long urls and payloads are whole."""
    manifest = warc.write_archives(table(spark, sf_dir, "pages"))
    return warc.summary(warc.read_archives(manifest))


def op2_byte_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Token ids of every whole text and their decoding, as digests. Null and empty texts have no ids."""
    return bpe.round_trip(table(spark, sf_dir, "documents"), public_tokenizers.path(VOCABULARY), public_tokenizers.PATTERN)


def op3_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The language of every whole text; ``und`` for texts without letters. Ties go to the language with more training rows."""
    docs = table(spark, sf_dir, "documents")
    model = langid.fit(docs.where(fold("doc_id", 3) != 1))
    return langid.predict(docs, model, extra={"held_out": F.coalesce(fold("doc_id", 3) == 1, F.lit(False))})


def op4_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Base statistics and verdict of every whole text. Null and empty texts have no words and fail."""
    return quality_rules.judge(table(spark, sf_dir, "documents"))


def op5_url_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The rule and verdict of every url; null urls have an empty host and path and no rule."""
    rules = spark.createDataFrame(list(url_filter.RULES), "rule string, verdict string")
    return url_filter.judge(table(spark, sf_dir, "pages"), rules)


def op6_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Cell, probability and draw of every document; nulls are a category of their own, copies of a row are drawn alike."""
    return mixing.mix(table(spark, sf_dir, "documents"))


def op7_quality_classifier(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A score for every whole text; empty texts get that of the bias. Scores at the cut count as 1."""
    docs, labels = table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels")
    model = classifier.fit(docs, labels.where(fold("doc_id", 5) != 0))
    return classifier.score(docs, model, extra={"held_out": F.coalesce(fold("doc_id", 5) == 0, F.lit(False))})


def op8_license_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The licence of every document, its own or inherited; null texts have none of their own."""
    return licenses.scan(licenses.corpus_paths(table(spark, sf_dir, "documents")))


def op9_exact_topk(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The 10 best of all vectors for every hundredth one, ties to the smaller id. Vectors with nulls take no part."""
    vectors = table(spark, sf_dir, "embeddings")
    return topk.search(topk.build_index(vectors), vectors.where("vec_id % 100 = 0"))


def op10_jaccard_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Class and number of links of every document; texts without words are classes of their own."""
    return jaccard.near_duplicates(table(spark, sf_dir, "documents"))


def op11_wavelet_shards(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Place, number and checksum of the ids of every whole text, read back from the shards. Null and empty texts have the end id alone."""
    manifest = wavelet.write_shards(table(spark, sf_dir, "documents"), public_tokenizers.path(WORDS), END_ID)
    return wavelet.read_tokens(manifest).select("doc_id", "start", "n_tokens", F.crc32("ids").alias("ids_crc32"))


def op12_source_divergence(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Divergences of all sources of a language from each other, and the terms that set each apart. Nulls are ''."""
    return divergence.audit(table(spark, sf_dir, "documents"))


def op13_merkle_manifest(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Leaf, roots, proof and verdict of every document, after tampering with every third. Null fields are `-`."""
    docs = table(spark, sf_dir, "documents")
    return merkle.manifest(docs, tampered={"text": merkle.lowered("text")}, tamper=F.coalesce(fold("doc_id", 3) == 0, F.lit(False)))


def _bounded(query: Callable[[SparkSession, str], DataFrame]) -> Callable[[SparkSession, str], DataFrame]:
    @functools.wraps(query)
    def run(spark: SparkSession, sf_dir: str) -> DataFrame:
        small_batches(spark)
        return query(spark, sf_dir)

    return run


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    found = (op1_warc_salvage, op2_byte_bpe, op3_language_id, op4_quality_rules, op5_url_filter, op6_mixing, op7_quality_classifier, op8_license_scan, op9_exact_topk, op10_jaccard_join, op11_wavelet_shards, op12_source_divergence, op13_merkle_manifest)
    return {f.__name__: _bounded(f) for f in found}


def oracle_sql() -> dict[str, str]:
    return {"op1_warc_salvage": warc.ORACLE_SQL, "op4_quality_rules": quality_rules.ORACLE_SQL, "op5_url_filter": url_filter.ORACLE_SQL, "op9_exact_topk": topk.ORACLE_SQL, "op12_source_divergence": divergence.ORACLE_SQL, "op13_merkle_manifest": merkle.ORACLE_SQL}
