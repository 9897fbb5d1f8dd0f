"""The training-corpus pipeline: quality rules, near duplicates, repeated
passages, personal data, packing.

Each stage works on all that its predecessor kept. Texts that fail a quality
rule go; of each group of near duplicates the document with the smallest id
stays; byte strings of 50 or more that a document with a smaller id has are cut;
personal data is replaced by its kind; what is left is packed into sequences.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from rankloom.llm import jaccard, packing, pii, quality, suffix_dedup
from rankloom.llm.common import stored, table

#: Words that a worker remembers while texts become ids: what the stages before
#: took of an executor is still with its JVM then.
REMEMBERED = 125_000


def quality_rules(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return quality.keep(docs)


def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return jaccard.one_of_each(docs)


def repeated_passages(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return suffix_dedup.remove(docs)


def personal_data(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return pii.redact(docs)


def packed_sequences(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return packing.pack_documents(spark, docs, remembered=REMEMBERED)


STAGES = [("quality_rules", quality_rules), ("near_duplicates", near_duplicates), ("repeated_passages", repeated_passages),
          ("personal_data", personal_data), ("packed_sequences", packed_sequences)]

#: Token ids by a vocabulary file are beyond SQL; tests/llm holds the stages
#: against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    for name, stage in STAGES[:-1]:
        docs = stored(stage(spark, docs, sf_dir), name)
    return STAGES[-1][1](spark, docs, sf_dir)
