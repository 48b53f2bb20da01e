"""The queries of this subpackage: each applies one operator to its whole table."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import chosen_path, decontaminate, fuzzy_lines, langid, license_scan, packing, quality_model, quality_rules, token_store, warc_fixity
from .common import crc_fold, read_table
from .tokens import encoder, public_path


def op6_language_bayes(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = read_table(spark, sf_dir, "documents")
    held_out = crc_fold("doc_id", 4) == 2
    model = langid.train(docs.where(~held_out))
    return langid.identify(docs, model).select("doc_id", F.coalesce(held_out, F.lit(False)).alias("held_out"), "lang_pred", "score")


def op7_quality_model(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = read_table(spark, sf_dir, "documents")
    held_out = crc_fold("doc_id", 3) == 1
    weights = quality_model.train(docs, read_table(spark, sf_dir, "labels").where(~held_out))
    return quality_model.classify(docs, weights).select("doc_id", F.coalesce(held_out, F.lit(False)).alias("held_out"), "score", "predicted")


def op8_token_store(spark: SparkSession, sf_dir: str) -> DataFrame:
    return token_store.token_id_store(read_table(spark, sf_dir, "documents"), public_path("word_bpe_49k.json"), end_id=2)


def op9_hilbert_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    path = public_path("byte_bpe_50k.json")
    pieces = packing.pack_sequences(read_table(spark, sf_dir, "documents"), path, length=1024, end_id=0)
    return packing.digest(pieces, encoder(path).dtype)


def op1_qgram_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    return decontaminate.find_leaks(read_table(spark, sf_dir, "documents"), read_table(spark, sf_dir, "benchmark"))


def op2_merkle_fixity(spark: SparkSession, sf_dir: str) -> DataFrame:
    return warc_fixity.audited_pages(read_table(spark, sf_dir, "pages"))


def op3_fuzzy_lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = fuzzy_lines.dedup_lines(read_table(spark, sf_dir, "documents"))
    return out.select("doc_id", "n_lines", "n_dropped", F.md5(F.col("text").cast("binary")).alias("text_md5"))


def op4_chosen_path(spark: SparkSession, sf_dir: str) -> DataFrame:
    return chosen_path.near_duplicates(read_table(spark, sf_dir, "documents"), words=4)


def op5_rule_cascade(spark: SparkSession, sf_dir: str) -> DataFrame:
    return quality_rules.quality_cascade(read_table(spark, sf_dir, "documents"))


def op10_license_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    return license_scan.scan_licenses(read_table(spark, sf_dir, "documents"))


QUERIES = {
    "op1_qgram_decontamination": op1_qgram_decontamination,
    "op2_merkle_fixity": op2_merkle_fixity,
    "op3_fuzzy_lines": op3_fuzzy_lines,
    "op4_chosen_path": op4_chosen_path,
    "op5_rule_cascade": op5_rule_cascade,
    "op6_language_bayes": op6_language_bayes,
    "op7_quality_model": op7_quality_model,
    "op8_token_store": op8_token_store,
    "op9_hilbert_packing": op9_hilbert_packing,
    "op10_license_scan": op10_license_scan,
}
ORACLES: dict[str, str] = {"op2_merkle_fixity": warc_fixity.ORACLE_SQL, "op4_chosen_path": chosen_path.ORACLE_SQL, "op5_rule_cascade": quality_rules.ORACLE_SQL}
