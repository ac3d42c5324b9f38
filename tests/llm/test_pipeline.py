"""The corpus pipeline on the smallest tables and on awkward rows."""

from __future__ import annotations

from pyspark.sql import functions as F

import corpus_pipeline

DATA = "/root/testdata/sf0.001"


def test_stages_keep_the_columns_and_only_drop(spark):
    docs = spark.read.parquet(f"{DATA}/documents.parquet")
    columns, n = docs.columns, docs.count()
    for name, stage in corpus_pipeline.STAGES:
        out = corpus_pipeline.written(stage(spark, docs, DATA), "t")
        assert out.count() <= n, name
        if name != corpus_pipeline.STAGES[-1][0]:
            assert out.columns == columns
            assert out.join(docs, "doc_id", "left_anti").count() == 0
            docs, n = out, out.count()
    assert out.count() == n


def test_stages_take_awkward_rows(spark):
    rows = [(1, None, "en", "s", 0), (2, "", None, None, None), (3, "word", "en", "s", 4), (3, "word", "en", "s", 4), (None, "other", "en", "s", 5), (4, "word word " * 30000, "de", "s", 1)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long")
    for name, stage in corpus_pipeline.STAGES:
        docs = corpus_pipeline.written(stage(spark, docs, DATA), "t")
    assert docs.count() == 4
    empty = spark.createDataFrame([], "doc_id long, text string, lang string, source string, n_chars long")
    for _, stage in corpus_pipeline.STAGES:
        empty = stage(spark, empty, DATA)
    assert empty.count() == 0


def test_every_query_is_registered():
    import __spark_entry__ as entry

    names = entry.queries()
    assert [any(q.startswith(f"op{n}_") for q in names) for n in range(1, 11)] == [True] * 10 and "pipeline" in names
    assert set(entry.oracle_sql()) <= set(names)


def test_query_column_is_plain(spark):
    import __spark_entry__ as entry

    out = entry.queries()["op7_token_counts"](spark, DATA)
    assert out.columns == ["doc_id", "n_bytes", "n_tokens", "over_limit"] and out.where(F.col("n_tokens") < 0).count() == 0
