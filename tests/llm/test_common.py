"""Scratch tables and folds."""

import zlib

import pytest
from pyspark.sql import functions as F

from fieldloom.llm import _common


def test_scratch_goes_to_the_shared_folder(spark):
    df = _common.written(spark.range(5), "x")
    assert df.count() == 5 and all(spark.conf.get("spark.checkpoint.dir").rstrip("/") in f for f in df.inputFiles())


def test_no_local_scratch_on_a_cluster(monkeypatch):
    class Context:
        master = "spark://host:7077"

    class Session:
        sparkContext = Context()

        class conf:
            get = staticmethod(lambda key, default=None: default)

    with pytest.raises(ValueError):
        _common.scratch_root(Session())


def test_fold(spark):
    got = spark.range(50).select("id", _common.fold("id", 5).alias("f")).collect()
    assert all(r["f"] == zlib.crc32(str(r["id"]).encode()) % 5 for r in got)
    assert spark.createDataFrame([(None,)], "id bigint").select(_common.fold("id", 5).alias("f")).first()["f"] is None


def test_sample_is_bounded_and_repeats(spark):
    df = spark.range(1000).select(F.col("id").alias("doc_id"), F.concat(F.lit("t"), F.col("id")).alias("text"))
    a, b = (_common.sample_rows(d, 20, 10_000) for d in (df, df.unionAll(df).repartition(3)))
    assert a == b and len(a) == 20
    few = _common.sample_rows(df, 20, 30)
    assert 0 < len(few) < 20 and sum(len(r["text"]) for r in few) <= 30
    assert _common.sample_rows(df.limit(0), 20, 30) == []


def test_texts_in_parts():
    texts = ["a" * 100, None, "", "b" * 5, "c" * 200]
    parts = list(_common.by_characters(texts, 150))
    assert [t for p in parts for t in p] == texts and len(parts) > 1 and list(_common.by_characters([], 5)) == []


def test_discarded_tables_are_gone(spark):
    import os

    df = _common.written(spark.range(5), "x")
    path = df._fieldloom_path
    assert os.path.exists(path)
    _common.discard(df, spark.range(1))
    assert not os.path.exists(path)


def test_shuffled_rows_are_settled(spark):
    df = spark.read.parquet("/root/testdata/sf0.001/documents.parquet").select("doc_id", "text")
    assert _common.settled(df, "x") is df and not hasattr(_common.settled(df.where("doc_id > 3"), "x"), "_fieldloom_path")
    for shuffled in (df.repartition(3), df.distinct(), df.repartition(3).where("doc_id > 3"), df.join(df.select("doc_id").hint("merge"), "doc_id")):
        out = _common.settled(shuffled, "x")
        assert out._fieldloom_path and sorted(map(tuple, out.collect()), key=repr) == sorted(map(tuple, shuffled.collect()), key=repr)
        _common.discard(out)


def test_shuffled_documents_link_alike(spark):
    from fieldloom.llm.jaccard import near_duplicates

    df = spark.read.parquet("/root/testdata/sf0.001/documents.parquet")
    want, got = (sorted(map(tuple, near_duplicates(d).collect())) for d in (df, df.repartition(5)))
    assert got == want
