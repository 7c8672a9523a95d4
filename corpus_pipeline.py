"""A corpus pipeline of five stages: quality rules, toxicity, near duplicates, repeated passages, packing.

Each stage takes (spark, docs, sf_dir), works on all that its predecessor kept, and returns the columns of the documents, the last one pieces. Between
stages the rows are written as Parquet and read again. Rows without an id pass the first two stages on their text, and are left out
from the third on, where documents are compared by id; of rows that repeat an id one goes on.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from leafloom.llm import jaccard, packing, quality, suffix, toxicity
from leafloom.llm.common import one_row_per_id, ready, table, written
from leafloom.llm.queries import vocabulary


def quality_rules(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Operator 1: documents that fail a rule, or that boilerplate lines make up, go."""
    return quality.keep_good(docs)


def toxic_documents(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Operator 3: documents that score at the threshold or above go."""
    return toxicity.keep_clean(docs, table(spark, sf_dir, "labels"))


def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Operator 5: of every group of near duplicates the document with the least id stays."""
    kept = jaccard.near_duplicates(docs.select("doc_id", "text")).where("doc_id = component_id").select("doc_id")
    columns = [c for c in docs.columns if c != "doc_id"]
    return one_row_per_id(docs, *columns).join(kept, "doc_id", "left_semi").select(*docs.columns)


def repeated_passages(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Operator 4: passages of 50 words or more that also stand earlier are cut out."""
    return suffix.remove_passages(docs).select(*docs.columns)


def packed_sequences(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Operator 10: pieces of sequences of 2048 tokens."""
    return packing.pack(docs, vocabulary("byte_bpe_50k.json"))


STAGES = [
    ("quality_rules", quality_rules),
    ("toxic_documents", toxic_documents),
    ("near_duplicates", near_duplicates),
    ("repeated_passages", repeated_passages),
    ("packed_sequences", packed_sequences),
]

#: Scores, tokens and minimisers are beyond SQL; tests hold the stages against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(ready(spark), sf_dir, "documents")
    for name, stage in STAGES[:-1]:
        docs = written(stage(spark, docs, sf_dir), name)
    return STAGES[-1][1](spark, docs, sf_dir)
