"""The plans behind the registered queries: early cuts, narrow scans, no products."""

import os
import re

import pytest

import __spark_entry__ as driver

FOLDER = driver.SMOKE_DIR
pytestmark = pytest.mark.skipif(not os.path.isdir(FOLDER), reason="needs the driver's tables")


def plan(spark, name):
    return driver.queries()[name](spark, FOLDER)._jdf.queryExecution().executedPlan().toString()


def test_every_oracle_belongs_to_a_query():
    assert set(driver.oracle_sql()) <= set(driver.queries())
    assert set(driver.QUERIES) - set(driver.ORACLES) == {"topic_cluster_words"}


@pytest.mark.parametrize("name", ["clean_raw_posts", "growth_trend", "interest_trend", "rss_first_n_per_feed", "curated"])
def test_rank_filters_cut_before_the_shuffle(spark, name):
    assert re.search(r"WindowGroupLimit .*Partial", plan(spark, name))


def test_topic_ranking_cuts_and_combines_early(spark):
    text = plan(spark, "emerging_topics")
    assert re.search(r"WindowGroupLimit \[scope.*, 60, Partial", text)
    assert "partial_sum" in text
    assert "CartesianProduct" not in text and "NestedLoop" not in text


@pytest.mark.parametrize("name", ["trend_score", "source_fallback", "daily_rollup", "burst"])
def test_no_products(spark, name):
    text = plan(spark, name)
    assert "CartesianProduct" not in text and "NestedLoop" not in text


def test_scans_read_only_what_is_used(spark):
    assert "ReadSchema: struct<doc_id:bigint,text:string,lang:string,n_chars:bigint>" in plan(spark, "velocity_trend")
    assert "ReadSchema: struct<conv_id:bigint,turn:bigint,text:string>" in plan(spark, "sentiment")


def test_posts_are_not_shuffled_again_for_text_signals(spark):
    for name in ("classify", "entity_keywords"):
        # texts and tokens are dealt by post alone; the other exchanges are the lexicon's
        keys = set(re.findall(r"Exchange hashpartitioning\((.*?), \d+\)", plan(spark, name)))
        assert {re.sub(r"#\d+", "", k) for k in keys} <= {"post_key", "_groupingexpression", "term, ws"}
    assert plan(spark, "ranked_key_phrases").count("Exchange hashpartitioning") == 1


def test_entry(spark):
    got = driver.entry(spark)
    assert got.columns == ["category", "bucket", "rank", "url", "trend_score"] and got.count() > 0
