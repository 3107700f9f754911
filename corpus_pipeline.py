"""A corpus from raw documents: quality, exact and near duplicates, source mix, packed sequences.

Each stage takes ``(spark, docs, sf_dir)``; its result is written as Parquet and reread as the next one's
``docs``. All but the last return the columns of ``documents``.

Of odd input every stage does as its operator: null texts are empty (and go or stay by their quality score), null
ids are rows like others that no near copy replaces, repeated rows are exact copies of which one stays, very long
texts are read whole, an empty table stays empty, and other columns pass through under their names.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from tracewright.llm import exact_dedup, minhash, mixing, packing, quality
from tracewright.llm.common import table, tuned
from tracewright.llm.queries import vocabulary
from tracewright.storage import stored

#: Documents whose calibrated quality is below this go.
QUALITY = 0.7


def good_documents(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return quality.accepted(docs, table(spark, sf_dir, "labels"), QUALITY)


def without_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return exact_dedup.deduplicate(docs)


def without_near_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return minhash.distinct_rows(docs)


def mixed_sources(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return mixing.mixed_rows(docs)


def packed(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return packing.pack_documents(docs, vocabulary("word_bpe_49k.json"))


STAGES = [("quality", good_documents), ("exact_dedup", without_copies), ("minhash", without_near_copies), ("mixing", mixed_sources), ("packing", packed)]

#: Trained scores, signatures and tokenizers can't be expressed in SQL; tests hold each stage against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(tuned(spark), sf_dir, "documents")
    for name, stage in STAGES[:-1]:
        docs = stored(stage(spark, docs, sf_dir), name)
    return STAGES[-1][1](spark, docs, sf_dir)
