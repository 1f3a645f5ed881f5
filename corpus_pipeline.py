"""The corpus pipeline: five stages over ``documents``, each written as Parquet and read again as the next one's input.

In all stages null and empty texts are texts without words, texts of any
length are used whole, repeated rows are documents of their own (near_dedup
keeps one of those with words), rows without an id are kept unless toxicity
or decontamination reject their text, columns of any name pass through all
but the last, and an empty table gives an empty one.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from sparktrail.llm import decontamination, minhash, packing, pii, toxicity
from sparktrail.llm.common import discard, table, written


def reject_toxic(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Without the documents that score 0.7 or more; labels are learnt as op3 does."""
    return toxicity.drop_toxic(docs, table(spark, sf_dir, "labels"))


def drop_near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near-duplicates, that of the smallest doc_id."""
    return minhash.drop_near_duplicates(docs)


def decontaminate(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Without the documents that are contaminated by the rule of op7."""
    return decontamination.drop_contaminated(docs, table(spark, sf_dir, "benchmark"))


def redact_personal_data(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """All documents, personal data in their texts replaced by the name of its kind."""
    return pii.redact(docs)


def pack_lengths(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Each document's length bucket, batch and place (a null doc_id stays null)."""
    return packing.pack(docs)


STAGES = [
    ("toxicity", reject_toxic),
    ("near_dedup", drop_near_duplicates),
    ("decontamination", decontaminate),
    ("pii", redact_personal_data),
    ("packing", pack_lengths),
]

#: Toxicity scores, minima and the trees of the redaction can't be written as SQL; the stages are tested against plain versions.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    for name, stage in STAGES:
        done = written(stage(spark, docs, sf_dir), f"pipeline-{name}")
        discard(docs)
        docs = done
    return docs
