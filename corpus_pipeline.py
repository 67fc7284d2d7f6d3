"""From raw documents to a sharded training mixture: five stages, each written to the shared folder before the next reads it.

Rows are told apart by what they hold and never by doc_id alone: ids may be null or repeat at every stage. An empty table
passes through all stages as one. Extra columns are carried, whatever their names, up to the last stage, which returns its own.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from panelforge.llm import decontaminate, mixing, quality_rules, shards, simhash
from panelforge.llm.common import staged, table

SHARDS = 24


def rules(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the current policy of the rule ledger passes. Null and empty texts have too few words and go; repeated
    rows all stay or all go."""
    return quality_rules.keep(docs)


def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One row, that with the least id, of each group of near copies: fingerprints within 3 bits, or 5-word shingle sets with
    a similarity of 0.8 or more. Null ids come last, ties go by a hash of the row, and rows that are equal throughout leave
    one. Null and empty texts share a fingerprint and leave one row."""
    return simhash.keep_one(docs)


def benchmark(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents without a copy of a benchmark item. Null and empty texts hold none and stay; an empty benchmark removes
    nothing; repeated rows all stay or all go."""
    return decontaminate.keep_clean(docs, table(spark, sf_dir, "benchmark"))


def mixture(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents as often as the temperature mixture reads them; each at least once. A null source is a source of its own;
    texts without a word follow their block."""
    return mixing.mixed(docs)


def sharded(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The shard and place of every row of the mixture: doc_id, size, text_crc32, shard, slot, vslot, map_version. Rows that
    repeat each have a place; a null text has size 8 and no checksum."""
    return shards.shard_records(docs, SHARDS)[0]


STAGES = [
    ("quality rules", rules),
    ("simhash near-duplicates", near_duplicates),
    ("benchmark decontamination", benchmark),
    ("temperature mixing", mixture),
    ("virtual-slot sharding", sharded),
]

#: The alignment and the slot map's greedy assignment are no SQL.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    for i, (_, stage) in enumerate(STAGES):
        docs = stage(spark, docs, sf_dir)
        if i + 1 < len(STAGES):
            docs = staged(docs, f"stage-{i + 1}")
    return docs
