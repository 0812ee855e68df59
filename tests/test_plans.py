"""Plan shapes that matter at scale."""

from pathlib import Path

import pytest
from pyspark.sql import functions as F

from corvane.operators import dense, lexical, stats
from corvane.plans import views

SF = "/root/testdata/sf0.001"

pytestmark = pytest.mark.skipif(not Path(SF).exists(), reason="no test tables")


def plan(df):
    return df._jdf.queryExecution().executedPlan().toString()


def test_filters_and_columns_reach_the_scan(spark):
    text = plan(stats.filter_hits(views.docs(spark, SF), language="en", min_stars=1000))
    assert "EqualTo(lang,en)" in text and "GreaterThanOrEqual(n_chars,1000)" in text
    assert "ReadSchema: struct<doc_id:bigint,lang:string,source:string,n_chars:bigint>" in text


def test_cosine_search_shuffles_only_best_rows(spark):
    stored = views.table(spark, SF, "embeddings").select(F.col("vec_id").alias("id"), "embedding")
    text = plan(dense.dense_topk(views.query_batch(spark, SF), stored, 10))
    assert text.count("Exchange") == 1
    assert text.index("Exchange") < text.index("MapInArrow")


def test_bm25_shuffles_only_best_rows(spark):
    rows = views.table(spark, SF, "documents").select(F.col("doc_id").alias("id"), "text")
    queries = views.table(spark, SF, "benchmark").select(F.col("item_id").alias("query_id"), "text")
    text = plan(lexical.bm25_topk(queries, lexical.doc_tokens(rows), 10))
    assert text.count("Exchange") == 1
    assert text.index("Exchange") < text.index("MapInArrow")


def test_term_statistics_are_cut_to_the_words_before_aggregating(spark):
    rows = views.table(spark, SF, "documents").select(F.col("doc_id").alias("id"), "text")
    words = F.broadcast(spark.createDataFrame([("the",)], "term string"))
    text = plan(lexical.term_stats(lexical.doc_tokens(rows)).join(words, "term", "left_semi"))
    assert text.rindex("HashAggregate") < text.index("LeftSemi")
