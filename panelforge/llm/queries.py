"""The queries of this subpackage, and SQL for those that SQL can express."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from . import (
    decontaminate, filter_audit, lexical_search, mixing, pii, quality_model, quality_rules, shards, simhash, suffix_dedup, token_counts, toxicity, url_rules,
)
from .common import table


def op1_virtual_slot_shards(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows, _ = shards.shard_records(table(spark, sf_dir, "documents"), 24)
    return rows.selectExpr("doc_id", "size", "text_crc32", "'bytes' AS law", "shard", "slot", "CAST(NULL AS INT) AS grown_shard", "vslot", "map_version")


def op2_rule_ledger(spark: SparkSession, sf_dir: str) -> DataFrame:
    return quality_rules.judged(table(spark, sf_dir, "documents"))


def op3_suffix_array_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return suffix_dedup.deduplicated(table(spark, sf_dir, "documents"))


def op4_simhash_pivots(spark: SparkSession, sf_dir: str) -> DataFrame:
    return simhash.near_duplicates(table(spark, sf_dir, "documents"))


def op5_contextual_pii(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pii.found(table(spark, sf_dir, "documents"))


def op6_temperature_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mixing.mix(table(spark, sf_dir, "documents"))[0]


def op7_compression_classifier(spark: SparkSession, sf_dir: str) -> DataFrame:
    return quality_model.classified(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))


def op8_transducer_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return token_counts.token_counts(table(spark, sf_dir, "documents"))


def op9_redirect_url_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    return url_rules.judged(table(spark, sf_dir, "pages"))


def op10_seed_align_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    return decontaminate.contaminated(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))


def op11_filter_orders(spark: SparkSession, sf_dir: str) -> DataFrame:
    return filter_audit.audited(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))


def op12_toxic_segments(spark: SparkSession, sf_dir: str) -> DataFrame:
    return toxicity.classified(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))


def op13_lexical_search(spark: SparkSession, sf_dir: str) -> DataFrame:
    return lexical_search.search(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    own = (
        op1_virtual_slot_shards, op2_rule_ledger, op3_suffix_array_dedup, op4_simhash_pivots, op5_contextual_pii, op6_temperature_mixing,
        op7_compression_classifier, op8_transducer_token_counts, op9_redirect_url_rules, op10_seed_align_decontamination,
        op11_filter_orders, op12_toxic_segments, op13_lexical_search,
    )
    return {f.__name__: f for f in own}


def oracle_sql() -> dict[str, str]:
    return {
        "op2_rule_ledger": quality_rules.SQL, "op3_suffix_array_dedup": suffix_dedup.SQL, "op5_contextual_pii": pii.SQL, "op9_redirect_url_rules": url_rules.SQL,
        "op11_filter_orders": filter_audit.SQL, "op13_lexical_search": lexical_search.SQL,
    }
