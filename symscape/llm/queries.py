"""The queries of this folder and their SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from symscape.llm import bpe, html, lm, minhash, packing, pii, quality, secrets, toxicity, vectors
from symscape.llm.common import table


def op1_minhash_near_duplicates(spark: SparkSession, sf_dir: str) -> DataFrame:
    return minhash.near_duplicates(table(spark, sf_dir, "documents"))


def op2_language_model_scores(spark: SparkSession, sf_dir: str) -> DataFrame:
    return lm.score(table(spark, sf_dir, "documents"))


def op3_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return packing.pieces(table(spark, sf_dir, "documents"))


def op4_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    return bpe.encoded(table(spark, sf_dir, "documents"))


def op5_html_main_text(spark: SparkSession, sf_dir: str) -> DataFrame:
    pages = table(spark, sf_dir, "pages")
    return html.extracted(pages, html.train(pages))


def op6_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    return toxicity.toxic_documents(docs, toxicity.train(docs, table(spark, sf_dir, "labels")))


def op7_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    return quality.filtered(table(spark, sf_dir, "documents"))


def op8_secret_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    return secrets.scan(table(spark, sf_dir, "documents"))


def op9_personal_data(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pii.findings(table(spark, sf_dir, "documents"))


def op10_embedding_near_duplicates(spark: SparkSession, sf_dir: str) -> DataFrame:
    return vectors.near_duplicates(table(spark, sf_dir, "embeddings"))


QUERIES = {
    f.__name__: f
    for f in (
        op1_minhash_near_duplicates,
        op2_language_model_scores,
        op3_packing,
        op4_bpe,
        op5_html_main_text,
        op6_toxicity,
        op7_quality_rules,
        op8_secret_scan,
        op9_personal_data,
        op10_embedding_near_duplicates,
    )
}

SQL = {"op3_packing": packing.sql(), "op7_quality_rules": quality.sql(), "op8_secret_scan": secrets.sql(), "op10_embedding_near_duplicates": vectors.sql()}
