"""The queries of this subpackage: one per operator, over whole tables."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from . import decontam, divergence, langid, line_rules, mixing, neardup, page_text, quality_model, secrets, suffix_dedup, tokens, variants, warc
from .common import table


def op1_mix(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mixing.mix_sources(table(spark, sf_dir, "documents")).select("doc_id", "size", "source_size", "target", "taken")


def op2_decontaminate(spark: SparkSession, sf_dir: str) -> DataFrame:
    return decontam.leak_digest(decontam.find_leaks(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark")))


def op3_minhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    return neardup.near_duplicates(table(spark, sf_dir, "documents")).select("doc_id", "n_shingles", "component_id", "kept")


def op4_langid(spark: SparkSession, sf_dir: str) -> DataFrame:
    return langid.identify_languages(table(spark, sf_dir, "documents"))


def op5_tokens(spark: SparkSession, sf_dir: str) -> DataFrame:
    return tokens.count_tokens(table(spark, sf_dir, "documents"))


def op6_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    return quality_model.score_quality(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))


def op7_suffix_array(spark: SparkSession, sf_dir: str) -> DataFrame:
    return suffix_dedup.substring_digest(suffix_dedup.remove_repeats(table(spark, sf_dir, "documents")))


def op8_secrets(spark: SparkSession, sf_dir: str) -> DataFrame:
    return secrets.secret_digest(secrets.scan_secrets(table(spark, sf_dir, "documents")))


def op9_line_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    return line_rules.rules_digest(line_rules.apply_rules(table(spark, sf_dir, "documents"), share=line_rules.SHARE))


def op10_warc(spark: SparkSession, sf_dir: str) -> DataFrame:
    return warc.round_trip(table(spark, sf_dir, "pages")).select("page_id", "payload_bytes", "payload_digest", "record_type", "refers_to")


def op11_divergence(spark: SparkSession, sf_dir: str) -> DataFrame:
    return divergence.audit(table(spark, sf_dir, "documents"))


def op12_variants(spark: SparkSession, sf_dir: str) -> DataFrame:
    return variants.group_variants(table(spark, sf_dir, "documents"))


def op13_page_text(spark: SparkSession, sf_dir: str) -> DataFrame:
    return page_text.extract_text(table(spark, sf_dir, "pages"))


QUERIES = {"op1_mix": op1_mix, "op2_decontaminate": op2_decontaminate, "op3_minhash": op3_minhash, "op4_langid": op4_langid, "op5_tokens": op5_tokens, "op6_quality": op6_quality, "op7_suffix_array": op7_suffix_array, "op8_secrets": op8_secrets, "op9_line_rules": op9_line_rules, "op10_warc": op10_warc, "op11_divergence": op11_divergence, "op12_variants": op12_variants, "op13_page_text": op13_page_text}
ORACLES = {"op1_mix": mixing.MIX_SQL, "op2_decontaminate": decontam.LEAKS_SQL, "op8_secrets": secrets.SECRETS_SQL, "op9_line_rules": line_rules.RULES_SQL, "op10_warc": warc.WARC_SQL, "op11_divergence": divergence.AUDIT_SQL, "op12_variants": variants.VARIANTS_SQL, "op13_page_text": page_text.PAGES_SQL}
