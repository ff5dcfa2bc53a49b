"""The operators' queries over the driver's tables, and their SQL."""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession

from ._common import table

BYTE_BPE, PIECE_BPE = "byte_bpe_50k.json", "piece_bpe_32k.model"


def op1_fingerprints(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .fingerprints import fingerprints

    return fingerprints(table(spark, sf_dir, "documents"))


def op2_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .packing import pack

    return pack(table(spark, sf_dir, "documents"), public_tokenizers.path(BYTE_BPE), size=1024, eos=0)


def op6_pivot_index(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .pivots import near_vectors

    return near_vectors(table(spark, sf_dir, "embeddings"), threshold=0.93)


def op7_sentencepiece(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .pieces import encode

    return encode(table(spark, sf_dir, "documents"), public_tokenizers.path(PIECE_BPE))


def op8_jaccard_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .jaccard import near_duplicates

    return near_duplicates(table(spark, sf_dir, "documents"), words=5, threshold=80)


def op9_language(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .language import identify, train

    docs = table(spark, sf_dir, "documents")
    return identify(docs, train(docs))


def op10_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .tokens import token_counts

    return token_counts(table(spark, sf_dir, "documents"), public_tokenizers.path(BYTE_BPE), limit=1024)


def op11_ranked_search(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .ranked import ranked_search

    return ranked_search(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"), k=50)


def op12_prefix_trie(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .turns import prefix_trie

    return prefix_trie(table(spark, sf_dir, "conversations"))


def op13_disclosure(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .sanitise import digests, sanitise

    return digests(sanitise(table(spark, sf_dir, "documents")))


def op3_min_cost_flow(spark: SparkSession, sf_dir: str) -> DataFrame:
    """From 16 shards by hash of the id to 24 of equal bytes."""
    from .resharding import hashed_layout, reshard

    return reshard(table(spark, sf_dir, "documents"), hashed_layout(16), 16, 24)


def op4_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .toxicity import toxicity, train

    docs = table(spark, sf_dir, "documents")
    return toxicity(docs, train(docs, table(spark, sf_dir, "labels")))


def op5_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .quality import quality

    return quality(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))


QUERIES = {f.__name__: f for f in (op1_fingerprints, op2_packing, op3_min_cost_flow, op4_toxicity, op5_quality, op6_pivot_index, op7_sentencepiece, op8_jaccard_join, op9_language, op10_token_counts, op11_ranked_search, op12_prefix_trie, op13_disclosure)}


def oracle_sql() -> dict[str, str]:
    from . import oracles, quality, ranked, turns

    return {"op5_quality": quality.oracle(), "op6_pivot_index": oracles.COSINE, "op8_jaccard_join": oracles.JACCARD, "op11_ranked_search": ranked.ORACLE, "op12_prefix_trie": turns.ORACLE}
