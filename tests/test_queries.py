"""A cross-section of the registered queries against DuckDB (all of them: python -m tests.check_oracle)."""

import pytest

import __spark_entry__ as E
from tests.check_oracle import compare, duck

SF = "/root/testdata/sf0.001"
NAMES = [
    "entry_issue_ranking", "ag10_controversy", "ag21_quota_checks", "cmp4_sensitivity", "cl1_claims", "vw7_comparison",
    "dd2_exact_duplicates", "prj4_validation_errors", "prj12_abstain_rows", "rv4_merge_overrides",
    "ev6_evaluate_run", "w7_grouped_split", "vec9_topic_baseline", "vec5_assign_topics", "ev4_cohen_kappa", "prj11_reply_contract", "pii2_string_leaks", "jn14_positional_merge",
    "st1_stream_import", "st2_stream_first_seen", "src2_json_lines", "src3_json_large_document", "ag23_resumed_run", "udf4_rules_table", "udf4_rules_topics", "sc5_free_times", "rv5_incremental", "vw8_queue_page", "rv1_route_review",
]


@pytest.fixture(scope="module")
def con():
    return duck(SF)


@pytest.mark.parametrize("name", NAMES)
def test_query_equals_sql(spark, con, name):
    assert compare(spark, con, E.queries()[name], E.oracle_sql()[name], SF) is None


def test_every_sql_has_a_query():
    from resona.plans import catalog

    assert set(E.oracle_sql()) <= set(E.queries())
    assert catalog.QUERIES.keys() - catalog.ORACLES.keys() == {
        "dd3_near_duplicates", "jn15_near_duplicate_join", "udf3_pair_similarity", "w8_stratified_sample", "vec6_kmeans",
        "vec7_emerging_topics", "vec7_priors", "vec7_study_priors", "ag23_fingerprint", "dd6_normalise_report"}
