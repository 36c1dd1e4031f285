"""A corpus for training: classified, deduplicated, decontaminated, cleared of secrets, packed.

Each stage reads what its predecessor wrote. All but the last return the columns of ``documents``:

1. quality: documents that the factorisation machine rejects go;
2. duplicates: one document of each group of near copies stays, the one with the smallest id;
3. benchmark: documents that hold a benchmark passage go;
4. secrets: secrets are masked;
5. packing: the token sequences.

Rows with a null id are never grouped; every stage keeps them unless its own decision about their text removes them.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from risemeter.llm.decontaminate import without_benchmark
from risemeter.llm.overlap import one_per_component
from risemeter.llm.packing import packed
from risemeter.llm.quality import keep_good
from risemeter.llm.secrets import without_secrets
from risemeter.llm.tables import read, saved


def good_documents(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return keep_good(docs, read(spark, sf_dir, "labels"))


def distinct_documents(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return one_per_component(docs)


def clean_documents(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return without_benchmark(docs, read(spark, sf_dir, "benchmark"))


def masked_documents(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return without_secrets(docs)


def packed_documents(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return packed(docs)


STAGES = [
    ("quality", good_documents),
    ("duplicates", distinct_documents),
    ("benchmark", clean_documents),
    ("secrets", masked_documents),
    ("packing", packed_documents),
]

#: The classifier, the tokenizer and the edit distances are beyond SQL; the stages are tested against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = read(spark, sf_dir, "documents")
    for name, stage in STAGES[:-1]:
        docs = saved(stage(spark, docs, sf_dir), name)
    return STAGES[-1][1](spark, docs, sf_dir)
