"""Registered queries against their SQL on the smallest tables."""

from pathlib import Path

import pytest

from risemeter.queries import ORACLES, QUERIES
from risemeter.views import Views
from tests.compare import compare, connect

FOLDER = "/root/testdata/sf0.001"
CHECKED = [
    "src4_entity_stats", "src7_search_hits", "snk2_item_upsert", "snk4_replaced_auto_links", "snk6_mention_changes",
    "pf2_confirmed_links", "pf12_valid_votes", "j4_catalog_tags", "j11_title_matches", "j14_by_name_or_key", "u5_merged_and_removed",
    "w3_all_periods", "w4_newest_vs_oldest_of_last", "w6_chart_series", "w9_preferred_links", "a3_catalog_stats", "a5_vote_tally",
    "a16_merge_preview", "t7_page_after_key", "sf5_normalize_name", "sf10_content_class", "sf11_candidate_score", "sf17_parsed_judgments",
    "job1_growth_ranking_7d", "job2_trending_page", "job3_catalog_buzz", "job7_weekly_digest", "job11_summary", "job13_overridden_links",
    "job15_counts", "job16_merged_catalog", "job16_published_version", "job18_upserted_catalog", "st2_vote_outcomes", "st3_batch_bursts",
]

pytestmark = pytest.mark.skipif(not Path(FOLDER).exists(), reason="needs the given tables")


@pytest.fixture(scope="module")
def con():
    return connect(FOLDER)


def test_every_query_has_sql():
    assert set(QUERIES) == set(ORACLES)


@pytest.mark.parametrize("name", CHECKED)
def test_query(spark, con, name):
    assert compare(spark, con, name, QUERIES[name], ORACLES[name], FOLDER) is None


def test_alias_files_do_not_grow_with_the_catalog(spark):
    from risemeter.queries.tables import suggestion_files, suggestion_rows

    v = Views(spark, FOLDER)
    sizes = suggestion_files(v).selectExpr("size(from_json(body, 'suggestions ARRAY<STRING>').suggestions) AS n").groupBy("n").count().collect()
    entries = v.catalog().count()
    assert [tuple(r) for r in sizes] == [(1, entries)] and suggestion_rows(v).select("catalog_id").distinct().count() == entries
