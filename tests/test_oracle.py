"""Queries against their DuckDB oracles on the smallest data folder (the
driver runs the full set at sf0.01; tools/check_oracle.py does the same)."""

import os

import pytest

import __spark_entry__ as E
from communitylens.plans.check import compare, duck

SF = os.environ.get("TEST_SF_DIR", "/root/testdata/sf0.01")
KEYS = ["content_stats", "interaction_stats", "user_stats", "user_rollup", "iqr_outliers", "cooccurring_tags_topn",
        "tag_communities", "community_similarity_by_tag", "inter_post_gaps", "sample_share", "keyword_batches",
        "shard_by_word_budget", "interaction_edges", "post_cosine", "class_word_goodness", "tfidf", "class_scores",
        "annotator_agreement", "extract_entities", "analyse_text"]


@pytest.fixture(scope="module")
def con():
    return duck(SF)


@pytest.mark.parametrize("key", KEYS)
def test_query_matches_oracle(spark, con, key):
    df = E.queries()[key](spark, SF)
    res = compare(df, E.oracle_sql()[key], con)
    assert res["ok"], res


def test_entry_runs(spark):
    df = E.entry(spark)
    assert df.count() >= 0 and "total_tweets" in df.columns


def test_every_query_has_a_builder_and_most_an_oracle():
    q, o = E.queries(), E.oracle_sql()
    assert set(o) <= set(q)
    assert len(q) >= 150


def test_materialized_views_give_the_same_results(spark, con):
    import uuid

    from communitylens.session import scratch_path
    from communitylens.sources.tables import VIEWS_DIR_CONF, materialize_views
    materialize_views(spark, SF, scratch_path(spark, f"views-test-{uuid.uuid4().hex[:8]}"))
    try:
        for key in ("content_stats", "community_similarity_by_tag"):
            res = compare(E.queries()[key](spark, SF), E.oracle_sql()[key], con)
            assert res["ok"], (key, res)
    finally:
        spark.conf.unset(VIEWS_DIR_CONF)
        spark.conf.unset(VIEWS_DIR_CONF + ".source")
