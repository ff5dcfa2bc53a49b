"""A training corpus from raw documents: quality, toxicity, near duplicates, packing.

STAGES lists (name, function); a function takes (spark, docs, sf_dir), docs with the columns of
`documents`, and returns the rows it keeps with the same columns; the last returns packed pieces.
Each stage reads all rows its predecessor kept, written as Parquet in between.

Nulls, empty and repeated rows: as the operators say. A null text is scored, packed and compared as
an empty one; rows without doc_id pass the near-duplicate stage. Columns beyond those of `documents`
are carried by the filters and dropped by packing. An empty table gives no rows at every stage.
"""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession

from fieldloom.llm._common import discard, ready, table, written
from fieldloom.llm.jaccard import keep_one
from fieldloom.llm.packing import pack
from fieldloom.llm.quality import keep_good
from fieldloom.llm.toxicity import keep_clean, train


def quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents whose hierarchical empirical Bayes score is at least 0.2.

    Null and empty texts are scored like others; null ids take no label; repeated rows stay or go together.
    """
    ready(spark)
    return keep_good(docs, table(spark, sf_dir, "labels"))


def toxicity(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the string-kernel machine scores below 0.7.

    Null and empty texts hold no unit and stay; null ids and repeated rows are scored like others.
    """
    ready(spark)
    return keep_clean(docs, train(docs, table(spark, sf_dir, "labels")))


def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document, that of the least id, of each group linked by five-word shingles at 0.8.

    Null and empty texts and null ids stay; of rows with one id one stays.
    """
    ready(spark)
    return keep_one(docs, words=5, threshold=80)


def packing(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Pieces of sequences of 1024 ids. A null or empty text is one end sign; repeated rows are packed each."""
    ready(spark)
    return pack(docs, public_tokenizers.path("byte_bpe_50k.json"), size=1024, eos=0)


STAGES = [("quality", quality), ("toxicity", toxicity), ("near_duplicates", near_duplicates), ("packing", packing)]
#: SQL can express neither the machine nor the packing; tests hold the stages against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The last stage's rows over sf_dir's documents; each stage but the last is written and read again."""
    docs = table(spark, sf_dir, "documents")
    for name, stage in STAGES[:-1]:
        before, docs = docs, written(stage(spark, docs, sf_dir), f"pipeline-{name}")
        discard(before)  # a written stage, once its successor is; never a table of sf_dir
    return STAGES[-1][1](spark, docs, sf_dir)
