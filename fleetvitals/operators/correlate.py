"""Root-cause correlations between signals of one cluster.

One aggregate per cluster collects every signal the correlations need;
each correlation is then a predicate over that single row. Per-node findings
read node rows joined with that row.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from fleetvitals import CLUSTER_KEYS
from fleetvitals.functions import scalars as S
from fleetvitals.functions.once import made_once
from fleetvitals.operators import fleet

DAY = 86400
CONFIRMED, EXCLUDED, OPEN = "confirmed", "excluded", "needs-investigation"
VERDICT = "array<struct<state:string,cause:string>>"


def _v(state: str, cause: str) -> Column:
    return F.struct(F.lit(state).alias("state"), F.lit(cause).alias("cause"))


def _verdicts(*cases: tuple[Column, str, str]) -> Column:
    options = F.array(*[F.when(F.coalesce(c, F.lit(False)), _v(state, cause)) for c, state, cause in cases])
    return F.filter(options, lambda x: x.isNotNull())


def _metrics(**values: Column) -> Column:
    pairs = [x for name, value in values.items() for x in (F.lit(name), value.cast("double"))]
    return F.map_filter(F.create_map(*pairs), lambda k, v: v.isNotNull())


def _finding(code: str, subject: Column, metrics: Column, verdicts: Column) -> Column:
    return F.struct(
        F.lit(code).alias("code"),
        subject.cast("string").alias("subject_node"),
        metrics.alias("metrics"),
        verdicts.cast(VERDICT).alias("verdicts"),
    )


def _off(name: str, value: str = "0") -> Column:
    return F.coalesce(fleet.variable(name) == value, F.lit(False))


def _slow() -> Column:
    return F.coalesce("slow_queries", F.lit(0))


def _first(value: Column, condition: Column) -> Column:
    """The value of the first node, in node order, that meets a condition."""
    return F.min_by(F.when(condition, value), F.when(condition, F.col("node_order")))


@made_once
def _swap_verdicts() -> Column:
    ratio = _pool_ratio()
    return _verdicts(
        (ratio > 0.7, CONFIRMED, "buffer pool competes for memory"),
        (F.coalesce("qps", F.lit(0.0)) > 500, CONFIRMED, "busy workload keeps swap in use"),
        (fleet.number("max_connections") > 1000, CONFIRMED, "many connection buffers"),
    )


@made_once
def _pool_ratio() -> Column:
    name = "innodb_buffer_pool_size_in_mb"
    pool = F.nullif(S.size_to_mb(fleet.variable(name), name), F.lit(0.0))
    return (pool / 1024) / fleet.mem_gb()


@made_once
def _slow_log_verdicts() -> Column:
    threshold = fleet.number("long_query_time")
    return _verdicts(
        (fleet.variable("log_queries_not_using_indexes").isin("ON", "1"), CONFIRMED, "statements without index are logged"),
        ((threshold > 0) & (threshold < 1), CONFIRMED, "long_query_time is too low"),
        (_slow() > 1000000, CONFIRMED, "many truly slow statements"),
    )


def cluster_facts(nodes: DataFrame, cluster_keys: list[str] = CLUSTER_KEYS) -> DataFrame:
    """Every cluster-level signal, from one partial aggregation."""
    return nodes.groupBy(*cluster_keys).agg(*_signals())


@made_once
def _signals() -> list[Column]:
    primary = F.col("role") == "primary"
    other = ~primary
    has_temp = other & F.col("temp_bytes").isNotNull()
    busy = has_temp & (F.coalesce("qps", F.lit(0.0)) > 0)
    lagging = F.coalesce("is_replica", F.lit(False)) & (F.coalesce("lag_seconds", F.lit(0)) > 60)
    os = S.os_lifecycle("os_release")
    os_eol = F.coalesce(os["status"] == "eol", F.lit(False))
    swapping = (
        (F.coalesce("swap_pct", F.lit(0.0)) > 0)
        & _pool_ratio().isNotNull()
        & (F.size(_swap_verdicts()) > 0)
    )
    big_slow_log = (F.coalesce("slow_log_bytes", F.lit(0)) >= S.GIB) & (F.size(_slow_log_verdicts()) > 0)
    n_messages = F.coalesce("error_count", F.lit(0)) + F.coalesce("warning_count", F.lit(0))
    big_error_log = (F.coalesce("error_log_bytes", F.lit(0)) >= 100 * S.MIB) & (n_messages > 100)
    per_day = F.col("binlog_bytes") / (F.col("uptime_sec") / F.lit(float(DAY)))
    rated = F.coalesce((F.col("binlog_bytes") > 0) & (F.col("uptime_sec") > 0), F.lit(False))
    uptime = F.nullif(F.col("uptime_sec"), F.lit(0))

    chosen = F.struct(
        "node_ip",
        "mem_pct",
        "qps",
        "slow_queries",
        "questions",
        "temp_bytes",
        "server_version",
        "max_auto_rate",
    )
    worst = F.struct(
        F.col("node_ip"),
        F.col("lag_seconds"),
        F.coalesce("qps", F.lit(0.0)).alias("qps"),
        F.coalesce(fleet.number("slave_parallel_workers"), F.lit(0.0)).alias("workers"),
        F.coalesce(fleet.variable("binlog_format") != "ROW", F.lit(True)).alias("not_row"),
    )
    swap = F.struct("node_ip", _pool_ratio().alias("ratio"), "qps", "swap_pct", _swap_verdicts().alias("verdicts"))
    slow_log = F.struct("node_ip", "slow_log_bytes", _slow_log_verdicts().alias("verdicts"))
    error_log = F.struct("node_ip", "error_log_bytes", "error_count", "warning_count")
    # Among equals the first node in node order counts, as with 'first node' everywhere.
    reverse = F.translate("node_order", "0123456789", "9876543210")
    return [
        F.count(F.lit(1)).alias("n_nodes"),
        F.bool_and(_off("innodb_flush_log_at_trx_commit")).alias("all_weak_flush"),
        F.bool_and(_off("sync_binlog")).alias("all_weak_sync"),
        F.bool_and(F.coalesce(F.col("n_root_open") > 0, F.lit(False))).alias("all_root_open"),
        _first(chosen, primary).alias("primary"),
        F.count_if(has_temp).alias("n_temp"),
        F.min(F.when(has_temp, F.col("temp_bytes"))).alias("temp_min"),
        F.max(F.when(has_temp, F.col("temp_bytes"))).alias("temp_max"),
        F.max_by(F.when(has_temp, F.col("node_ip")), F.when(has_temp, F.struct("temp_bytes", reverse))).alias("temp_max_node"),
        F.bool_and(F.when(has_temp, uptime.isNotNull())).alias("temp_uptimes"),
        F.min(F.when(has_temp, uptime)).alias("temp_uptime_min"),
        F.max(F.when(has_temp, uptime)).alias("temp_uptime_max"),
        F.count_if(busy).alias("n_busy"),
        F.min(F.when(busy, F.col("qps"))).alias("qps_min"),
        F.max(F.when(busy, F.col("qps"))).alias("qps_max"),
        F.max_by(F.when(lagging, worst), F.when(lagging, F.struct("lag_seconds", reverse))).alias("worst"),
        F.count_if(lagging).alias("n_lagging"),
        F.max(F.when(lagging, F.col("lag_seconds"))).alias("worst_lag"),
        _first(swap, swapping).alias("swap"),
        F.bool_or(os_eol).alias("any_os_eol"),
        _first(F.col("node_ip"), os_eol).alias("os_eol_node"),
        _first(slow_log, big_slow_log).alias("slow_log"),
        _first(error_log, big_error_log).alias("error_log"),
        F.count_if(rated).alias("n_rated"),
        F.min(F.when(rated, per_day)).alias("rate_min"),
        F.max(F.when(rated, per_day)).alias("rate_max"),
        F.max_by(F.when(rated, F.col("node_ip")), F.when(rated, F.struct(per_day, reverse))).alias("rate_max_node"),
    ]


@made_once
def _cluster_findings() -> list[tuple[Column, Column]]:
    p, none = F.col("primary"), F.lit(None).cast("string")
    many = F.col("n_nodes") > 1
    weak = F.col("all_weak_flush") & F.col("all_weak_sync")
    p_slow = F.coalesce(p["slow_queries"], F.lit(0))
    p_qps = F.coalesce(p["qps"], F.lit(0.0))
    worst = F.col("worst")
    days = (F.col("temp_uptime_max") - F.col("temp_uptime_min")) / F.lit(float(DAY))
    far = F.col("temp_uptimes") & (days > 7)
    spread = (F.col("n_busy") >= 2) & (F.col("qps_max") > F.col("qps_min") * 2)
    causes = _verdicts(
        (far, CONFIRMED, "restart times differ"),
        (F.col("temp_uptimes") & ~(days > 7), EXCLUDED, "restart times are close"),
        (spread, CONFIRMED, "read load differs"),
        ((F.col("n_busy") >= 2) & ~spread, EXCLUDED, "read load is even"),
    )
    unknown = F.array(_v(OPEN, "no uptime or load data"))
    lag_causes = _verdicts(
        (worst["workers"] == 0, CONFIRMED, "single-threaded replication"),
        ((p_qps > 1000) & (worst["workers"] == 0), CONFIRMED, "primary is busy"),
        (worst["qps"] > p_qps, CONFIRMED, "replica is busier with reads than the primary"),
        (worst["not_row"], CONFIRMED, "binlog format is not ROW"),
    )
    old = p["server_version"].rlike(r"^(5\.5|5\.6|5\.7)")
    auto = F.coalesce(p["max_auto_rate"], F.lit(0.0))
    swap, slow_log, error_log = F.col("swap"), F.col("slow_log"), F.col("error_log")
    return [
        (
            weak & many,
            _finding("COR-02", none, _metrics(nodes=F.col("n_nodes")), F.array(_v(CONFIRMED, "no node is durable"))),
        ),
        (
            (p_slow > 1000000) & (p["temp_bytes"] > 5 * S.GIB),
            _finding(
                "COR-03",
                p["node_ip"],
                _metrics(
                    slow_queries=p_slow,
                    temp_bytes=p["temp_bytes"],
                    slow_pct=F.try_divide(p_slow * 100.0, p["questions"]),
                ),
                F.array(_v(CONFIRMED, "slow statements spill to temporary tables")),
            ),
        ),
        (
            (F.col("n_temp") >= 2) & (F.col("temp_max") > F.col("temp_min") * 4) & (F.col("temp_max") > S.GIB),
            _finding(
                "COR-04",
                F.col("temp_max_node"),
                _metrics(
                    temp_max=F.col("temp_max"),
                    temp_min=F.col("temp_min"),
                    uptime_gap_days=F.when(F.col("temp_uptimes"), days),
                    qps_max=F.col("qps_max"),
                    qps_min=F.col("qps_min"),
                ),
                F.when(F.size(causes) > 0, causes).otherwise(unknown),
            ),
        ),
        (
            F.col("all_root_open") & many,
            _finding("COR-05", none, _metrics(nodes=F.col("n_nodes")), F.array(_v(CONFIRMED, "root is open on every node"))),
        ),
        (
            worst.isNotNull() & p.isNotNull() & (F.size(lag_causes) > 0),
            _finding(
                "COR-07",
                worst["node_ip"],
                _metrics(lag=worst["lag_seconds"], workers=worst["workers"], primary_qps=p_qps, replica_qps=worst["qps"]),
                lag_causes,
            ),
        ),
        (
            swap.isNotNull(),
            _finding("COR-08", swap["node_ip"], _metrics(bp_ratio=swap["ratio"], qps=swap["qps"], swap_pct=swap["swap_pct"]), swap["verdicts"]),
        ),
        (
            F.col("any_os_eol") & old,
            _finding("COR-09", F.col("os_eol_node"), _metrics(), F.array(_v(CONFIRMED, "system and server are both out of support"))),
        ),
        (
            slow_log.isNotNull(),
            _finding("COR-10", slow_log["node_ip"], _metrics(slow_log_bytes=slow_log["slow_log_bytes"]), slow_log["verdicts"]),
        ),
        (
            error_log.isNotNull(),
            _finding(
                "COR-11",
                error_log["node_ip"],
                _metrics(
                    error_log_bytes=error_log["error_log_bytes"],
                    errors=error_log["error_count"],
                    warnings=error_log["warning_count"],
                ),
                F.array(_v(CONFIRMED, "errors and warnings are frequent")),
            ),
        ),
        (
            weak & (F.col("n_lagging") > 0) & p.isNotNull(),
            _finding(
                "COR-12",
                none,
                _metrics(worst_lag=F.col("worst_lag"), rpo_seconds=F.col("worst_lag") + 1),
                F.array(_v(CONFIRMED, "weak durability and delay add up")),
            ),
        ),
        (
            (auto >= 0.7) & (p_slow > 100000),
            _finding(
                "COR-14",
                p["node_ip"],
                _metrics(max_auto_rate=auto, slow_queries=p_slow),
                F.array(_v(CONFIRMED, "key range and statement speed degrade together")),
            ),
        ),
        (
            many & (F.col("n_rated") >= 2) & (F.col("rate_max") > F.col("rate_min") * 5) & (F.col("rate_max") > S.GIB),
            _finding(
                "COR-15",
                F.col("rate_max_node"),
                _metrics(rate_max=F.col("rate_max"), rate_min=F.col("rate_min")),
                F.array(_v(OPEN, "binlog growth differs between nodes")),
            ),
        ),
    ]


@made_once
def _disk_cause() -> tuple[Column, Column]:
    parts = fleet.disk_parts()
    top = F.get(parts, F.lit(0))
    second = F.get(parts, F.lit(1))
    full = F.get(F.filter("disks", lambda d: d["use_pct"] >= 80), F.lit(0))
    days = fleet.number("expire_logs_days")
    retention = (fleet.variable("expire_logs_days") == "0") | (days > 30)
    known = F.size(parts) > 0
    fires = full.isNotNull() & (known | F.coalesce(retention, F.lit(False)))
    verdict = F.when(
        known, F.array(F.struct(F.lit(CONFIRMED).alias("state"), top["kind"].alias("cause")))
    ).otherwise(F.array(_v(OPEN, "binlog retention")))
    metrics = _metrics(
        use_pct=full["use_pct"], top_bytes=top["bytes"], top_pct=top["pct"], second_pct=second["pct"], expire_days=days
    )
    return fires, _finding("COR-01", F.col("node_ip"), metrics, verdict)


def _cold_node(primary_mem: Column) -> tuple[Column, Column]:
    up = F.nullif(F.col("uptime_sec"), F.lit(0))
    mem = F.coalesce("mem_pct", F.lit(0.0))
    fires = (F.col("role") != "primary") & (mem < primary_mem - 30)
    verdicts = _verdicts(
        (up.isNull(), OPEN, "uptime is unknown"),
        (up < 7 * DAY, CONFIRMED, "restarted within 7 days"),
        ((up >= 7 * DAY) & (up < 30 * DAY), CONFIRMED, "still warming up"),
        (up >= 30 * DAY, EXCLUDED, "cold start; load is light"),
    )
    return fires, _finding("COR-06", F.col("node_ip"), _metrics(mem_pct=mem, primary_mem_pct=primary_mem), verdicts)


@made_once
def _writable_replica() -> tuple[Column, Column]:
    lagging = F.coalesce("is_replica", F.lit(False)) & (F.coalesce("lag_seconds", F.lit(0)) > 60)
    fires = lagging & fleet.variable("read_only").isin("0", "OFF")
    return fires, _finding(
        "COR-13", F.col("node_ip"), _metrics(lag=F.col("lag_seconds")), F.array(_v(CONFIRMED, "replica accepts writes while late"))
    )


def _fired(findings: list[tuple[Column, Column]]) -> Column:
    fired = F.array(*[F.when(F.coalesce(c, F.lit(False)), f) for c, f in findings])
    return F.explode(F.filter(fired, lambda x: x.isNotNull())).alias("f")


@made_once
def _of_clusters() -> Column:
    return _fired(_cluster_findings())


@made_once
def _of_nodes() -> Column:
    return _fired([_disk_cause(), _cold_node(F.col("primary_mem")), _writable_replica()])


def correlations(nodes: DataFrame, cluster_keys: list[str] = CLUSTER_KEYS) -> DataFrame:
    """(cluster, code, subject_node, metrics, verdicts) of every correlation that holds."""
    facts = cluster_facts(nodes, cluster_keys)
    per_cluster = facts.select(*cluster_keys, _of_clusters()).select(*cluster_keys, "f.*")
    primary_mem = facts.select(*cluster_keys, F.nullif(F.col("primary.mem_pct"), F.lit(0.0)).alias("primary_mem"))
    with_primary = nodes.join(primary_mem, cluster_keys, "left")
    per_node = with_primary.select(*cluster_keys, _of_nodes()).select(*cluster_keys, "f.*")
    return per_cluster.unionByName(per_node)
