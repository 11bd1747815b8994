"""Registered queries against their SQL. ``TEST_ALL=1`` runs every one, else one of each kind."""

from __future__ import annotations

import os

import pytest

from tests.harness import DATA, compare, connect
from tidings.plans import ORACLES, QUERIES

SAMPLE = """canonical_urls page_texts item_simhash canonical_items keyword_hits combined_matches relevance_prefilter cluster_decisions resolved_grouping ranked_stories
brief_sections topic_lines keyword_coverage drifted_weights budget_blocked rate_windows fetch_health weekly_evidence new_items hybrid_search rematch_items
stream_request_counts stream_feedback_once stream_arrivals_once stream_daily_briefs page_links listing_links grouping_links grouping_touched grouping_stories pending_retries written_briefs written_reading_list
title_searches trigram_languages cluster_agreement
keyword_hits_by_word cluster_decisions_by_cell clean_titles stage_backlogs""".split()
NAMES = list(QUERIES) if os.environ.get("TEST_ALL") else SAMPLE
FOLDER = f"{DATA}/sf0.001"


@pytest.fixture(scope="module")
def sql():
    return connect(FOLDER)


@pytest.mark.parametrize("name", NAMES)
def test_query(spark, sql, name):
    ok, message = compare(spark, sql, name, FOLDER)
    assert ok, message


def test_every_oracle_has_a_query():
    assert set(ORACLES) <= set(QUERIES)
