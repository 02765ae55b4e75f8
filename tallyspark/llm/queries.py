"""The registered queries of this subpackage, with production parameters, over whole tables."""

from __future__ import annotations

from functools import wraps

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import annulus, audit, bpe, chat, decontam, improbable, jaccard, lengths, resample, rules, secret_spans, templates, toxicity
from .common import ship
from .oracles import ORACLE  # noqa: F401


def vocabulary() -> str:
    """The byte-level vocabulary's file; every operator that needs one takes its path as a parameter."""
    import public_tokenizers

    return public_tokenizers.path("byte_bpe_50k.json")


def _table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def op1_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = _table(spark, sf_dir, "documents").select("doc_id", "text")
    return toxicity.grade(docs, _table(spark, sf_dir, "labels"), carry=["doc_id"])


def op2_ngram_jaccard_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    return jaccard.join(_table(spark, sf_dir, "documents"))


def op3_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = _table(spark, sf_dir, "documents").select("doc_id", "text")
    return decontam.digests(decontam.find(docs, _table(spark, sf_dir, "benchmark"), carry=["doc_id"])).drop("spans")


def op4_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return lengths.histogram(_table(spark, sf_dir, "documents"), vocabulary())


def op5_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = _table(spark, sf_dir, "documents").select("doc_id", "text")
    return bpe.digests(docs, vocabulary())


def op6_importance_resampling(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = _table(spark, sf_dir, "documents").select("doc_id", "text")
    return resample.resample(docs, _table(spark, sf_dir, "labels"))


def op7_chat_formatting(spark: SparkSession, sf_dir: str) -> DataFrame:
    return chat.digests(chat.render(chat.with_probe(_table(spark, sf_dir, "conversations"))))


def op8_secret_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = _table(spark, sf_dir, "documents").select("doc_id", "text")
    return secret_spans.digests(secret_spans.scan(docs, carry=["doc_id"]))


def op9_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rules.judge(_table(spark, sf_dir, "documents"))


def op10_html_extraction(spark: SparkSession, sf_dir: str) -> DataFrame:
    text = templates.extract(_table(spark, sf_dir, "pages"))
    return text.withColumn("n_chars", F.length("text").cast("long"))


def op11_document_fingerprints(spark: SparkSession, sf_dir: str) -> DataFrame:
    return improbable.digests(improbable.neighbours(_table(spark, sf_dir, "documents").select("doc_id", "text")))


def op12_centroid_clustering(spark: SparkSession, sf_dir: str) -> DataFrame:
    return annulus.cluster(_table(spark, sf_dir, "embeddings"))


def op13_filter_audit(spark: SparkSession, sf_dir: str) -> DataFrame:
    return audit.audit(_table(spark, sf_dir, "documents"), _table(spark, sf_dir, "labels"))


def _shipped(query):
    @wraps(query)
    def run(spark: SparkSession, sf_dir: str) -> DataFrame:
        ship(spark)
        return query(spark, sf_dir)

    return run


QUERIES = {f.__name__: _shipped(f) for f in (op1_toxicity, op2_ngram_jaccard_join, op3_decontamination, op4_token_counts, op5_bpe, op6_importance_resampling, op7_chat_formatting, op8_secret_scan, op9_quality_rules, op10_html_extraction, op11_document_fingerprints, op12_centroid_clustering, op13_filter_audit)}

