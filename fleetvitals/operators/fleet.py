"""Node facts, role inference, topology and disk attribution."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from fleetvitals import CLUSTER_KEYS, KEYS
from fleetvitals.functions import scalars as S
from fleetvitals.functions.once import made_once
from fleetvitals.operators import workload
from fleetvitals.operators.ranking import range_row_number

DISK_TYPE = "array<struct<mount:string,use_pct:bigint>>"

# Columns of node_facts that the rules and reports read, with their types.
NODE_COLUMNS: dict[str, str] = {
    "hostname": "string", "file_name": "string", "project": "string",
    "os_release": "string", "os_kernel": "string", "cpu_cores": "bigint", "cpu_model": "string",
    "server_version": "string", "uptime_sec": "bigint", "threads_connected": "bigint",
    "questions": "bigint", "slow_queries": "bigint", "qps": "double",
    "mem_total_kb": "bigint", "mem_used_kb": "bigint", "mem_pct": "double",
    "swap_total_kb": "bigint", "swap_used_kb": "bigint", "swap_pct": "double",
    "variables": "map<string,string>", "sql_mode": "string",
    "is_replica": "boolean", "replica_ips": "array<string>", "connected_replicas": "bigint",
    "master_host": "string", "io_running": "string", "sql_running": "string", "lag_seconds": "bigint",
    "is_residue": "boolean",
    "history_list": "bigint", "bp_hits": "bigint", "bp_lookups": "bigint",
    "temp_bytes": "bigint", "db_total_gb": "double",
    "binlog_bytes": "bigint", "slow_log_bytes": "bigint", "error_log_bytes": "bigint",
    "relay_bytes": "bigint", "data_bytes": "bigint", "error_count": "bigint", "warning_count": "bigint",
    "disks": DISK_TYPE, "tls_config": "map<string,string>",
    "has_audit": "boolean", "has_password_policy": "boolean", "has_encryption": "boolean",
    "has_keyring": "boolean", "has_empty_password": "boolean", "has_old_auth": "boolean",
    "has_login_failures": "boolean",
    "role": "string", "role_source": "string", "needs_confirmation": "boolean", "node_order": "string",
    # Child tables summed up per node.
    "n_no_pk_business": "bigint", "n_no_pk_other": "bigint", "no_pk_example": "string",
    "n_ghost": "bigint", "ghost_bytes": "bigint", "ghost_example": "string",
    "n_non_utf8": "bigint", "non_utf8_example": "string",
    "n_fragmented": "bigint", "frag_example": "string",
    "n_auto_full": "bigint", "max_auto_rate": "double", "auto_example": "string",
    "n_long_sessions": "bigint", "top_session_s": "bigint", "top_session": "string",
    "n_users": "bigint", "n_root_open": "bigint",
    "n_open_critical": "bigint", "n_open_high": "bigint", "n_open_medium": "bigint",
    "open_critical_example": "string", "open_high_example": "string", "open_medium_example": "string",
    "has_dump_session": "boolean",
}


def conform(df: DataFrame, keys: list[str] = KEYS) -> DataFrame:
    """node_facts with every expected column; missing ones become typed nulls."""
    extra = [c for c in df.columns if c not in NODE_COLUMNS and c not in keys]
    return df.select(*keys, *_conformed(frozenset(df.columns)), *extra)


@made_once
def _conformed(have: frozenset) -> list[Column]:
    fixed = []
    for name, kind in NODE_COLUMNS.items():
        if name == "disks" and name in have:
            picked = F.transform("disks", lambda d: F.struct(d["mount"].alias("mount"), d["use_pct"].cast("bigint").alias("use_pct")))
            fixed.append(picked.alias(name))
        elif name == "temp_bytes" and name not in have and "temp" in have:
            fixed.append(F.col("temp.size_bytes").cast(kind).alias(name))
        elif name in have:
            fixed.append(F.col(name).cast(kind).alias(name))
        else:
            fixed.append(F.lit(None).cast(kind).alias(name))
    return fixed


@made_once
def variable(name: str) -> Column:
    return F.col("variables")[name]


@made_once
def number(name: str) -> Column:
    """A variable as a number; absent or textual values are null."""
    return variable(name).try_cast("double")


@made_once
def mem_gb() -> Column:
    return F.nullif(F.col("mem_total_kb"), F.lit(0)) / 1048576.0


def no_pk_facts(no_pk: DataFrame, keys: list[str] = KEYS) -> DataFrame:
    other = S.is_temp_or_history_table("table_name")
    name = F.concat_ws(".", "table_schema", "table_name")
    return no_pk.groupBy(*keys).agg(
        F.count_if(~other).alias("n_no_pk_business"),
        F.count_if(other).alias("n_no_pk_other"),
        F.min(F.when(~other, name)).alias("no_pk_example"),
    )


def fragment_facts(
    frag_tables: DataFrame, rate: Column, min_mb: Column, keys: list[str] = KEYS
) -> DataFrame:
    """Ghost tables of at least 1 GiB and heavily fragmented tables per node."""
    used = F.coalesce("data_length", F.lit(0)) + F.coalesce("data_free", F.lit(0))
    ghost = S.is_ghost_table("table_name") & (used >= S.GIB)
    heavy = (F.col("frag_rate") >= rate) & (F.col("data_free") >= min_mb * S.MIB)
    name = F.concat_ws(".", "table_schema", "table_name")
    return frag_tables.groupBy(*keys).agg(
        F.count_if(ghost).alias("n_ghost"),
        F.sum(F.when(ghost, used)).cast("bigint").alias("ghost_bytes"),
        F.min(F.when(ghost, name)).alias("ghost_example"),
        F.count_if(heavy).alias("n_fragmented"),
        F.min(F.when(heavy, name)).alias("frag_example"),
    )


def non_utf8_facts(non_utf8: DataFrame, keys: list[str] = KEYS) -> DataFrame:
    return non_utf8.groupBy(*keys).agg(
        F.count(F.lit(1)).alias("n_non_utf8"),
        F.min(F.concat_ws(".", "table_schema", "table_name")).alias("non_utf8_example"),
    )


def auto_increment_facts(usage: DataFrame, warn: Column, keys: list[str] = KEYS) -> DataFrame:
    name = F.concat_ws(".", "table_schema", "table_name", "column_name")
    return usage.groupBy(*keys).agg(
        F.count_if(F.col("rate") >= warn).alias("n_auto_full"),
        F.max("rate").alias("max_auto_rate"),
        F.max_by(name, F.struct("rate", name)).alias("auto_example"),
    )


def session_facts(sessions: DataFrame, min_s: int = 60, keys: list[str] = KEYS) -> DataFrame:
    long = workload.is_long_business_session(min_s)
    dump = (F.lower("user_name") == "repl") & F.lower("command").contains("binlog dump")
    text = F.concat_ws("@", "user_name", F.coalesce("host", F.lit("-")))
    return sessions.groupBy(*keys).agg(
        F.count_if(long).alias("n_long_sessions"),
        F.max(F.when(long, F.col("time_s"))).alias("top_session_s"),
        F.max_by(F.when(long, text), F.when(long, F.struct("time_s", "session_id"))).alias("top_session"),
        F.coalesce(F.bool_or(dump), F.lit(False)).alias("has_dump_session"),
    )


def account_facts(users: DataFrame, keys: list[str] = KEYS) -> DataFrame:
    """Accounts open to every host, counted by danger; the accounts themselves stay in wildcard_users."""
    open_host = F.col("host") == "%"
    level = S.wildcard_level("user_name")
    aggregates = [
        F.count(F.lit(1)).alias("n_users"),
        F.count_if(open_host & (F.col("user_name") == "root")).alias("n_root_open"),
    ]
    for name in ("critical", "high", "medium"):
        hit = open_host & (level == name)
        aggregates.append(F.count_if(hit).alias(f"n_open_{name}"))
        aggregates.append(F.min(F.when(hit, F.col("user_name"))).alias(f"open_{name}_example"))
    return users.groupBy(*keys).agg(*aggregates)


def add_child_facts(nodes: DataFrame, children: list[DataFrame], keys: list[str] = KEYS) -> DataFrame:
    """Joins the per-node sums; every side is already one row per node."""
    result = nodes
    for child in children:
        added = [c for c in child.columns if c not in keys]
        result = result.drop(*added).join(child, keys, "left")
    return result


def self_ref_replica(nodes: DataFrame) -> DataFrame:
    """A replica whose master is itself only carries a residue of an old configuration."""
    master, host = F.lower("master_host"), F.lower(F.coalesce("hostname", F.lit("")))
    own_name = (host != "") & ((master == host) | (master == F.substring_index(host, ".", 1)))
    itself = (
        (F.col("master_host") == F.col("node_ip")) | own_name | master.isin("localhost", "127.0.0.1", "::1")
    )
    residue = F.coalesce(F.col("is_replica") & (master != "") & itself, F.lit(False))
    return nodes.withColumn("is_residue", residue).withColumn(
        "is_replica", F.coalesce("is_replica", F.lit(False)) & ~F.col("is_residue")
    )


def has_primary_evidence() -> Column:
    """Replica addresses, connected replicas, or a replication account that dumps binlogs."""
    return (
        F.coalesce(F.size("replica_ips") > 0, F.lit(False))
        | F.coalesce(F.col("connected_replicas") > 0, F.lit(False))
        | F.coalesce("has_dump_session", F.lit(False))
    )


def primary_evidence(nodes: DataFrame) -> DataFrame:
    return nodes.withColumn("has_evidence", has_primary_evidence())


def _read_only() -> Column:
    return F.trim(F.coalesce(variable("read_only"), variable("super_read_only"), F.lit("")))


def standalone_source() -> Column:
    """Why a node that replicates from nobody counts as a primary, or null."""
    log_bin = F.coalesce(~variable("log_bin").isin("OFF", "0", ""), F.lit(False))
    free = ~F.coalesce("is_replica", F.lit(False))
    return F.when(free & _read_only().isin("0", "OFF"), "standalone_rw").when(
        free & _read_only().isin("1", "ON") & log_bin, "standalone_readonly"
    )


def standalone_primary(nodes: DataFrame) -> DataFrame:
    source = standalone_source()
    return nodes.select(
        "*",
        F.when(source.isNotNull(), "primary").alias("standalone_role"),
        source.alias("standalone_source"),
        (F.coalesce(source == "standalone_readonly", F.lit(False))).alias("standalone_confirm"),
    )


def resolve_roles(nodes: DataFrame, declared: str = "declared_role", cluster_keys: list[str] = CLUSTER_KEYS) -> DataFrame:
    """Role, its source and whether a person has to confirm it.

    Cluster facts (is there a primary, how many nodes) come from one
    aggregate that is joined back; a window over a cluster would put a whole
    cluster into one task.
    """
    role = F.col(declared) if declared in nodes.columns else F.lit(None).cast("string")
    declared_role = F.coalesce(S.canonical_role(role), S.canonical_role("file_name"), S.canonical_role("hostname"))
    host_role = S.canonical_role("hostname")
    replica = F.coalesce("is_replica", F.lit(False))
    first = S.first_case(
        [
            (S.is_dr(declared_role, "hostname", "file_name"), F.array(F.lit("dr"), F.lit("dr"))),
            (has_primary_evidence(), F.array(F.lit("primary"), F.lit("evidence"))),
            (declared_role.isNotNull(), F.array(declared_role, F.lit("declared"))),
            (replica, F.array(F.lit("slave"), F.lit("replica"))),
            (host_role.isNotNull(), F.array(host_role, F.lit("hostname"))),
            (standalone_source().isNotNull(), F.array(F.lit("primary"), standalone_source())),
        ],
        F.array(F.lit("unknown"), F.lit("unknown")),
    )
    kept = nodes.drop("role", "role_source", "needs_confirmation", "node_order")
    tagged = kept.withColumn("_first", first)
    is_primary = F.col("_first")[0] == "primary"
    facts = tagged.groupBy(*cluster_keys).agg(
        F.count(F.lit(1)).alias("_n"),
        F.min(F.when(is_primary, F.col("node_ip"))).alias("_found"),
        F.min(F.when(~replica & has_primary_evidence(), F.col("node_ip"))).alias("_fallback"),
    )
    joined = tagged.join(facts, cluster_keys).withColumn("_primary", F.coalesce("_found", "_fallback"))
    chosen = F.col("node_ip") == F.col("_primary")
    promoted = F.coalesce(F.col("_found").isNull() & chosen, F.lit(False))
    # A replica next to another primary is a replica; DR nodes stay what they are.
    demoted = F.coalesce(~chosen & replica & (F.col("_first")[0] != "dr"), F.lit(False))
    lonely = (F.col("_n") == 1) & (F.col("_first")[0] == "unknown")
    final = joined.withColumns(
        {
            "role": F.when(promoted | lonely, "primary").when(demoted, "slave").otherwise(F.col("_first")[0]),
            "role_source": F.when(promoted, "evidence")
            .when(lonely, "single_node_fallback")
            .otherwise(F.col("_first")[1]),
        }
    )
    confirm = F.col("role_source").isin("standalone_readonly", "single_node_fallback")
    return with_node_order(final.withColumn("needs_confirmation", confirm)).drop(
        "_first", "_n", "_found", "_fallback", "_primary"
    )


def with_node_order(nodes: DataFrame) -> DataFrame:
    """A text key, different for every node, that sorts the primary first, then by address; 'first node' means its minimum."""
    flag = F.when(F.col("role") == "primary", "0|").otherwise("1|")
    address = F.coalesce(S.ip_sort_key("node_ip"), F.lit(""))
    return nodes.withColumn("node_order", F.concat(flag, address, F.lit("|"), "node_ip"))


def rank_nodes(nodes: DataFrame, cluster_keys: list[str] = CLUSTER_KEYS) -> DataFrame:
    """node_rank 1..n per cluster."""
    return range_row_number(nodes, cluster_keys, ["node_order"], "node_rank")


def topology(nodes: DataFrame, cluster_keys: list[str] = CLUSTER_KEYS) -> DataFrame:
    primary = F.col("role") == "primary"
    counted = nodes.groupBy(*cluster_keys).agg(
        F.count(F.lit(1)).alias("n_nodes"),
        F.count_if(~primary).alias("n_replicas"),
        F.bool_or(primary).alias("has_primary"),
    )
    label = (
        F.when(
            F.col("has_primary") & (F.col("n_replicas") > 0),
            F.concat(F.lit("primary + "), F.col("n_replicas").cast("string"), F.lit(" replicas (async)")),
        )
        .when(F.col("n_nodes") == 1, "single node")
        .otherwise("cluster")
    )
    return counted.withColumn("label", label)


# Kinds of disk usage and the fact that holds each.
DISK_KINDS = {
    "binlog": "binlog_bytes",
    "slowLog": "slow_log_bytes",
    "errorLog": "error_log_bytes",
    "relayLog": "relay_bytes",
    "ibtmp1": "temp_bytes",
    "datadir": "data_bytes",
}


def disk_parts() -> Column:
    """Array of (kind, bytes, pct), largest first, of one node's known usage."""
    kinds = F.array(
        *[
            F.struct(F.col(c).cast("bigint").alias("bytes"), F.lit(-i).alias("pos"), F.lit(kind).alias("kind"))
            for i, (kind, c) in enumerate(DISK_KINDS.items())
        ]
    )
    known = F.filter(kinds, lambda p: F.coalesce(p["bytes"] > 0, F.lit(False)))
    total = F.aggregate(known, F.lit(0).cast("bigint"), lambda acc, p: acc + p["bytes"])
    return F.transform(
        F.sort_array(known, asc=False),
        lambda p: F.struct(p["kind"].alias("kind"), p["bytes"].alias("bytes"), (p["bytes"] / total).alias("pct")),
    )


def disk_attribution(nodes: DataFrame, keys: list[str] = KEYS) -> DataFrame:
    """Bytes and share per kind of disk usage, ranked inside the node's own row."""
    parts = nodes.select(*keys, F.posexplode(disk_parts()).alias("pos", "p"))
    return parts.select(*keys, "p.kind", "p.bytes", "p.pct", (F.col("pos") + 1).cast("bigint").alias("rnk"))
