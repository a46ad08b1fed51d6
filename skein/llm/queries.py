"""The contract's queries: thin callers of the operators, over whole tables."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from skein.llm import bpe, chat, decontamination, jaccard_join, packing, periodic, quality_model, quality_rules, secret_scan, sql, token_counts, token_files, url_rules, vector_codes


def _table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def op1_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    return decontamination.report(_table(spark, sf_dir, "documents"), _table(spark, sf_dir, "benchmark"))


def op2_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    return quality_rules.report(_table(spark, sf_dir, "documents"))


def _ledger(spark: SparkSession, sf_dir: str) -> DataFrame:
    return quality_rules.read_ledger(spark, quality_rules.write_ledger(_table(spark, sf_dir, "documents")))


def quality_ablation(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What each rule of the policy costs, from the stored ledger's bits."""
    return quality_rules.ablation(_ledger(spark, sf_dir))


def quality_policies(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What each policy keeps, from the stored ledger's bits."""
    return quality_rules.policy_counts(_ledger(spark, sf_dir))


def chat_layouts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Conversations dealt into four layouts and formatted by their fingerprints."""
    return chat.layout_report(_table(spark, sf_dir, "conversations"))


def op3_quality_classifier(spark: SparkSession, sf_dir: str) -> DataFrame:
    return quality_model.report(_table(spark, sf_dir, "documents"), _table(spark, sf_dir, "labels"))


def op4_chat_formatting(spark: SparkSession, sf_dir: str) -> DataFrame:
    return chat.report(_table(spark, sf_dir, "conversations"))


def op5_ngram_jaccard(spark: SparkSession, sf_dir: str) -> DataFrame:
    return jaccard_join.report(_table(spark, sf_dir, "documents"))


def op6_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return packing.pack(_table(spark, sf_dir, "documents"))


def op7_url_filters(spark: SparkSession, sf_dir: str) -> DataFrame:
    return url_rules.judge(_table(spark, sf_dir, "pages"))


def op8_secret_scans(spark: SparkSession, sf_dir: str) -> DataFrame:
    return secret_scan.report(_table(spark, sf_dir, "documents"))


def op9_token_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    return token_files.round_trip(_table(spark, sf_dir, "documents"))


def op10_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return token_counts.report(_table(spark, sf_dir, "documents"))


def op11_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    return bpe.report(_table(spark, sf_dir, "documents"))


def op12_vector_codes(spark: SparkSession, sf_dir: str) -> DataFrame:
    return vector_codes.report(_table(spark, sf_dir, "embeddings"))


def op13_periodic_runs(spark: SparkSession, sf_dir: str) -> DataFrame:
    return periodic.report(_table(spark, sf_dir, "documents"))


QUERIES = {f.__name__: f for f in (op1_decontamination, op2_quality_rules, op3_quality_classifier, op4_chat_formatting, op5_ngram_jaccard, op6_packing, op7_url_filters, op8_secret_scans, op9_token_files, op10_token_counts, op11_bpe, op12_vector_codes, op13_periodic_runs, quality_ablation, quality_policies, chat_layouts)}
ORACLE_SQL = {
    "op1_decontamination": sql.DECONTAMINATION,
    "op2_quality_rules": sql.QUALITY_RULES,
    "quality_ablation": sql.QUALITY_ABLATION,
    "quality_policies": sql.QUALITY_POLICIES,
    "op4_chat_formatting": sql.CHAT,
    "chat_layouts": sql.CHAT_LAYOUTS,
    "op5_ngram_jaccard": sql.NGRAM_JACCARD,
    "op7_url_filters": sql.URL_RULES,
    "op12_vector_codes": sql.VECTOR_CODES,
    "op13_periodic_runs": sql.PERIODIC,
}
