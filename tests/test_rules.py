"""Rules at, just under and just over their thresholds; roles; skewed ranking."""

import datetime

import pytest
from pyspark.sql import functions as F

from fleetvitals.operators import fleet, rules
from fleetvitals.operators.ranking import range_row_number, top_k
from fleetvitals.sources.config import Config

DAY = datetime.date(2026, 4, 30)
TYPES = {
    "variables": "map<string,string>", "disks": fleet.DISK_TYPE, "tls_config": "map<string,string>",
    "replica_ips": "array<string>",
}


def node(spark, **values):
    """One node with only the given facts."""
    row = {"cluster_id": "c", "snapshot_date": DAY, "node_ip": "10.0.0.1", "node_order": "0|010.000.000.001", "role": "slave", **values}
    schema = ", ".join(
        f"{k} {fleet.NODE_COLUMNS.get(k, TYPES.get(k, 'date' if k == 'snapshot_date' else 'string'))}" for k in row
    )
    return fleet.conform(spark.createDataFrame([tuple(row.values())], schema))


def fired(spark, only, **values):
    found = rules.evaluate_rules(node(spark, **values), only=[only]).collect()
    return found[0]["priority"] if found else None


GB = 1048576
CASES = [
    ("mem_high", {"mem_pct": 90.0}, None), ("mem_high", {"mem_pct": 90.1}, "P1"), ("mem_high", {"mem_pct": 90.04}, None),
    ("innodb_hll_high", {"history_list": 10000}, None), ("innodb_hll_high", {"history_list": 10001}, "P2"),
    ("innodb_hll_high", {"history_list": 50000}, "P1"),
    ("disk_high", {"disks": [("/", 79)]}, None), ("disk_high", {"disks": [("/", 80)]}, "P1"), ("disk_high", {"disks": [("/", 90)]}, None),
    ("disk_critical", {"disks": [("/", 90)]}, "P0"),
    ("swap_used", {"swap_used_kb": 0, "swap_total_kb": 10}, None), ("swap_used", {"swap_used_kb": 1, "swap_total_kb": 10}, "P1"),
    ("repl_thread_down", {"is_replica": True, "io_running": "Yes", "sql_running": None}, "P0"),
    ("repl_delay_high", {"is_replica": True, "io_running": "Yes", "sql_running": "Yes", "lag_seconds": 300}, None),
    ("repl_delay_high", {"is_replica": True, "io_running": "Yes", "sql_running": "Yes", "lag_seconds": 301}, "P1"),
    ("repl_delay_low", {"is_replica": True, "io_running": "Yes", "sql_running": "Yes", "lag_seconds": 300}, "P2"),
    ("repl_delay_low", {"is_replica": True, "io_running": "Yes", "sql_running": "Yes", "lag_seconds": 60}, None),
    ("slow_query_abs_high", {"slow_queries": 1000000}, None), ("slow_query_abs_med", {"slow_queries": 1000000}, "P2"),
    ("slow_query_abs_high", {"slow_queries": 1000001}, "P1"),
    ("bp_hit_low", {"bp_hits": 949, "bp_lookups": 1000}, "P1"), ("bp_hit_low", {"bp_hits": 950, "bp_lookups": 1000}, None),
    ("bp_hit_sub99", {"bp_hits": 950, "bp_lookups": 1000}, "P3"), ("bp_hit_sub99", {"bp_hits": 990, "bp_lookups": 1000}, None),
    ("bp_too_small", {"mem_total_kb": 10 * GB, "variables": {"innodb_buffer_pool_size_in_mb": "4096"}}, None),
    ("bp_too_small", {"mem_total_kb": 10 * GB, "variables": {"innodb_buffer_pool_size_in_mb": "4095"}}, "P2"),
    ("bp_too_small", {"mem_total_kb": 10 * GB, "variables": {"innodb_buffer_pool_size_in_mb": "2047"}}, "P1"),
    ("bp_too_small", {"mem_total_kb": 3 * GB, "variables": {"innodb_buffer_pool_size_in_mb": "10"}}, None),
    ("bp_too_large", {"mem_total_kb": 10 * GB, "variables": {"innodb_buffer_pool_size_in_mb": "8193"}}, "P1"),
    ("redo_log_too_small", {"db_total_gb": 50.0, "variables": {"innodb_log_file_size_in_mb": "128"}}, "P2"),
    ("redo_log_too_small", {"db_total_gb": 50.0, "variables": {"innodb_log_file_size_in_mb": "127"}}, "P1"),
    ("redo_log_too_small", {"db_total_gb": 1.0, "qps": 200.0, "variables": {"innodb_log_file_size_in_mb": "127"}}, None),
    ("ibtmp1_oversize", {"temp_bytes": 5 * 1024**3}, None), ("ibtmp1_oversize", {"temp_bytes": 5 * 1024**3 + 1}, "P2"),
    ("expire_logs_long", {"variables": {"expire_logs_days": "30"}}, None), ("expire_logs_long", {"variables": {"expire_logs_days": "31"}}, "P3"),
    ("expire_logs_zero", {"variables": {"expire_logs_days": "0"}}, "P1"),
    ("long_query_time_loose", {"variables": {"long_query_time": "5"}}, "P3"), ("long_query_time_loose", {"variables": {"long_query_time": "4.9"}}, None),
    ("slave_skip_errors_set", {"variables": {"replica_skip_errors": "all"}}, "P0"), ("slave_skip_errors_set", {"variables": {"slave_skip_errors": "OFF"}}, None),
    ("tls_weak_protocol", {"tls_config": {"tls_version": "TLSv1.2,TLSv1.3"}}, None), ("tls_weak_protocol", {"tls_config": {"tls_version": "TLSv1.1"}}, "P2"),
    ("tls_weak_protocol", {"tls_config": {"tls_version": "TLSv1"}}, "P2"),
    ("auto_increment_exhausting", {"n_auto_full": 1, "max_auto_rate": 0.9}, "P0"), ("auto_increment_exhausting", {"n_auto_full": 1, "max_auto_rate": 0.8}, "P1"),
    ("data_to_memory_ratio_high", {"mem_total_kb": GB, "db_total_gb": 10.0}, None), ("data_to_memory_ratio_high", {"mem_total_kb": GB, "db_total_gb": 50.5}, "P1"),
    ("master_readonly", {"role": "primary", "variables": {"read_only": "1"}}, "P1"),
    ("master_readonly", {"role": "primary", "role_source": "standalone_readonly", "variables": {"read_only": "1"}}, "P3"),
    ("mysql_version_eol", {"server_version": "5.7.30"}, "P1"), ("mysql_version_security", {"server_version": "8.0.35"}, "P3"),
    ("mysql_version_eol", {"server_version": "8.4.0"}, None),
]


@pytest.mark.parametrize("rule,values,priority", CASES)
def test_threshold(spark, rule, values, priority):
    assert fired(spark, rule, **values) == priority


def test_run_override_and_disabling(spark):
    n = node(spark, mem_pct=80.0, variables={"gtid_mode": "OFF"})
    strict = Config(run_layer={"thresholds.memory.high_pct": "75", "priorities.mem_high": "P0", "disabledRules": "gtid_off"})
    found = {(r["type"], r["priority"]) for r in rules.evaluate_rules(n, strict).collect()}
    assert ("mem_high", "P0") in found and not any(t == "gtid_off" for t, _ in found)


def test_every_rule_has_advice():
    assert len(rules.ADVICE) == 55


ROLES = [
    ({"hostname": "dr-db", "is_replica": True}, "dr", "dr"),
    ({"hostname": "db", "connected_replicas": 1, "is_replica": True}, "primary", "evidence"),
    ({"hostname": "db", "replica_ips": ["10.0.0.2"]}, "primary", "evidence"),
    ({"hostname": "db-slave-1"}, "slave", "declared"),
    ({"hostname": "db", "is_replica": True}, "slave", "replica"),
    ({"hostname": "db", "variables": {"read_only": "0"}}, "primary", "standalone_rw"),
    ({"hostname": "db", "variables": {"read_only": "1", "log_bin": "on"}}, "primary", "standalone_readonly"),
    ({"hostname": "db", "variables": {"read_only": "1", "log_bin": "OFF"}}, "primary", "single_node_fallback"),
    ({"hostname": "db", "is_replica": True, "master_host": "10.0.0.1", "variables": {"read_only": "0"}}, "primary", "standalone_rw"),
    ({"hostname": "db.example", "is_replica": True, "master_host": "DB", "variables": {"read_only": "0"}}, "primary", "standalone_rw"),
]


@pytest.mark.parametrize("values,role,source", ROLES)
def test_role_of_a_lone_node(spark, values, role, source):
    row = fleet.resolve_roles(fleet.self_ref_replica(node(spark, **values).drop("role"))).first()
    assert (row["role"], row["role_source"]) == (role, source)


def test_ranking_matches_a_plain_window_under_skew(spark):
    # One cluster holds far more than a third of the rows.
    df = spark.range(3000).select(
        F.when(F.col("id") % 10 < 7, "hot").otherwise(F.concat(F.lit("c"), (F.col("id") % 97).cast("string"))).alias("c"),
        F.floor(F.col("id") / 100).alias("b"), F.col("id"),
    )
    got = {(r["c"], r["id"]): r["n"] for r in range_row_number(df.repartition(9), ["c"], ["b", "id"], "n").collect()}
    want: dict = {}
    counts: dict = {}
    for r in sorted(df.collect(), key=lambda r: r["id"]):
        counts[r["c"]] = counts.get(r["c"], 0) + 1
        want[(r["c"], r["id"])] = counts[r["c"]]
    assert got == want
    empty = range_row_number(df.limit(0), ["c"], ["id"], "n")
    assert empty.isEmpty()
    assert top_k(df, ["c"], [F.desc("id")], 3).filter("c = 'hot'").count() == 3


def test_top_k_limits_before_the_shuffle(spark):
    plan = top_k(spark.range(1000).withColumn("g", F.col("id") % 3), ["g"], [F.desc("id")], 5)
    text = plan._jdf.queryExecution().executedPlan().toString()
    assert text.count("WindowGroupLimit") == 2
