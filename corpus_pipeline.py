"""A corpus from raw documents to packed sequences: five stages, each one of the training-data operators.

Every stage is written as Parquet and reread as the next one's input, so a stage's decisions take effect and a lost
executor repeats no earlier stage. All but the last return the columns of ``documents``.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from auditloom.llm import mixing, near_copies, packing, pii, quality_rules
from auditloom.llm.common import remove, table, written
from auditloom.llm.queries import tokenizer_path


def quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the quality rules' posterior rejects go. Null, empty and very short texts are rejected; an empty table stays empty."""
    return quality_rules.keep_good(docs)


def near_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group linked by five-word shingle similarity of 0.8 or more stays: that of the smallest id. Texts without words are one group."""
    return near_copies.keep_one(docs, shingle=5, percent=80, seed=42)


def surrogates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Personal data and secrets give way to surrogates; every row stays. A null text stays null."""
    return pii.replaced_rows(docs, key=pii.session_key(spark))


def fair_mix(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents by the mix: none, one or up to three copies of each. Documents without words are in no mix."""
    return mixing.mixed_rows(docs)


def packed(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """A row a sequence of up to 4096 token ids, with the places of its pieces. A null text is one piece of the end id."""
    return packing.sequences(docs, tokenizer_path(), capacity=4096, end_id=1)


STAGES = [("quality rules", quality), ("near-dedup", near_dedup), ("PII surrogates", surrogates), ("mixing sources", fair_mix), ("best-fit packing", packed)]

#: SQL can express neither sketches, surrogates nor the tokenizer; tests/llm/test_pipeline.py runs all stages and run() against plain Python.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The packed sequences of the whole table of documents."""
    docs, before = table(spark, sf_dir, "documents"), None
    for _, stage in STAGES[:-1]:
        docs, path = written(stage(spark, docs, sf_dir))
        if before:
            remove(spark, before)
        before = path
    return STAGES[-1][1](spark, docs, sf_dir)
