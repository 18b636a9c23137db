"""Registered queries against their oracles, and the plans of those that must scale."""

import pytest

import __spark_entry__ as registry
from checks import load
from checks.compare import compare, connect
from checks.views import Views

SMALL = "/root/testdata/sf0.001"
# At least one query per operator family; `python -m checks.compare <dir>` runs them all.
SAMPLE = [
    "scf_01_fmt_bytes", "scf_18_table_category", "src_05_boxed_rows", "src_07_variables", "src_10_disks", "src_14_replication",
    "src_18_slow_log_entries", "src_23_backup_files", "cfg_01_resolve_config", "cat_01_schema_sizes", "cat_05_top_indexes",
    "cat_14_tables_without_pk", "usr_02_expiring_passwords", "idx_02_redundant_indexes", "ses_07_lock_waits", "eng_03_status_subset",
    "sql_00_digest_statements", "sql_06_no_index_statements", "flt_04_resolve_roles", "flt_05_rank_nodes", "rul_00_evaluate_rules_layered",
    "rul_54_param_inconsistent", "agg_02_number_issues", "scr_03_total_score", "rec_01_recommendations", "drf_02_judge_parameter",
    "drf_03_schema_diff", "cor_00_all_correlations", "bkp_06_backup_severity", "sec_01_security_checks", "mrt_12_releasable_space",
    "snk_02_cluster_documents", "dq_01_validate",
]


@pytest.fixture(scope="module")
def con():
    return connect(SMALL)


@pytest.mark.parametrize("name", SAMPLE)
def test_query_matches_oracle(spark, con, name):
    assert compare(spark, con, SMALL, name)[1] == ""


def test_every_query_has_an_oracle():
    assert set(load().QUERIES) == set(load().ORACLES)
    assert set(load().QUERIES) <= set(registry.queries()) and set(registry.oracle_sql()) <= set(registry.queries())


def test_schema_difference_makes_no_pairs(spark):
    df = load().QUERIES["drf_03_schema_diff"](Views(spark, SMALL))
    plan = df._jdf.queryExecution().optimizedPlan().toString()
    assert plan.count("Relation [") <= 8


def test_entry(spark):
    assert registry.entry(spark).columns == ["cluster_id", "total"]


@pytest.mark.parametrize(
    "name", ["flt_05_rank_nodes", "agg_02_number_issues", "cor_00_all_correlations", "ses_07_lock_waits", "drf_03_schema_diff", "idx_02_redundant_indexes"]
)
def test_no_cross_join(spark, name):
    plan = load().QUERIES[name](Views(spark, SMALL))._jdf.queryExecution().executedPlan().toString()
    assert "CartesianProduct" not in plan and "BroadcastNestedLoopJoin" not in plan


def test_scan_is_pruned(spark):
    plan = load().QUERIES["ses_03_top_sleep"](Views(spark, SMALL))._jdf.queryExecution().executedPlan().toString()
    assert "props" not in plan.split("ReadSchema")[1]
