"""Parameter and schema drift between the nodes of a cluster."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from fleetvitals import CLUSTER_KEYS, KEYS
from fleetvitals.functions import fixed_values as fv
from fleetvitals.operators import fleet


def _value(name: str) -> Column:
    if name == "server_version":
        return F.col("server_version")
    return fleet.variable(name)


def node_parameters(nodes: DataFrame, names: list[str], keys: list[str] = KEYS) -> DataFrame:
    """Long form (keys, role, name, value); absent values stay as null rows."""
    pairs = F.array(*[F.struct(F.lit(n).alias("name"), _value(n).alias("value")) for n in names])
    return nodes.select(*keys, "role", F.explode(pairs).alias("p")).select(*keys, "role", "p.name", "p.value")


# Reasons of parameters that have no rule of their own.
REASONS = {
    "long_query_time": "slow-log thresholds differ",
    "slow_query_log": "the slow log is off on some nodes",
    "innodb_buffer_pool_size_in_mb": "core parameters differ",
    "max_connections": "core parameters differ",
    "innodb_log_file_size_in_mb": "core parameters differ",
    "binlog_format": "replication peers need one binlog format",
}


def judge_parameter(summary: DataFrame) -> DataFrame:
    """Adds ok and reason to the per-parameter summary of parameter_drift."""
    name = F.col("name")
    primary, low, high = F.col("primary_number"), F.col("replica_min"), F.col("replica_max")
    read_only_ok = (F.col("n_primary_not_rw") == 0) & (F.col("n_replica_not_ro") == 0)
    retention_ok = F.coalesce((low >= primary) & (high - primary <= 30), F.lit(False))
    no_zero = F.col("n_zero") == 0
    ok = (
        F.when(name == "server_id", F.lit(True))
        .when(name == "read_only", read_only_ok)
        .when(name == "expire_logs_days", no_zero & retention_ok)
        .otherwise(F.lit(False))
    )
    reasons = F.create_map(*[F.lit(x) for pair in REASONS.items() for x in pair])
    reason = (
        F.when(name == "server_id", "must be unique per node")
        .when((name == "read_only") & read_only_ok, "primary writes, replicas read")
        .when(
            name == "read_only",
            F.format_string("%d read-only primaries, %d writable replicas", "n_primary_not_rw", "n_replica_not_ro"),
        )
        .when((name == "expire_logs_days") & ~no_zero, "some nodes never expire binlogs")
        .when((name == "expire_logs_days") & retention_ok, "replicas keep binlogs at least as long as the primary")
        .when(name == "expire_logs_days", "binlog retention differs")
        .otherwise(F.coalesce(reasons[name], F.lit("should agree")))
    )
    return summary.withColumns({"ok": ok, "reason": reason})


def parameter_drift(
    nodes: DataFrame, names: list[str] | None = None, cluster_keys: list[str] = CLUSTER_KEYS
) -> DataFrame:
    """Parameters with more than one value: (cluster, name, n_unique, first and last value, ok, reason).

    Values are first grouped per (cluster, name, value), so a cluster with a
    third of all nodes is counted map-side and the second step sees distinct
    values only. The value per node is in parameter_node_values.
    """
    long = node_parameters(nodes, names or fv.DRIFT_PARAMETERS, [*cluster_keys, "node_order"])
    # The first primary in node order is the one replicas are compared with.
    is_primary = F.col("role") == "primary"
    numeric = F.col("value").try_cast("double")
    per_value = long.groupBy(*cluster_keys, "name", "value").agg(
        F.count(F.lit(1)).alias("n"),
        F.count_if(is_primary).alias("n_primary"),
        F.min(F.when(is_primary, F.struct("node_order", numeric.alias("number")))).alias("first_primary"),
        F.count_if(~is_primary).alias("n_replica"),
    )
    number = F.col("value").try_cast("double")
    on_replicas = F.when(F.col("n_replica") > 0, number)
    not_rw = F.coalesce(F.col("value") != "0", F.lit(True))
    not_ro = F.coalesce(F.col("value") != "1", F.lit(True))
    summary = per_value.groupBy(*cluster_keys, "name").agg(
        F.sum("n").alias("n_nodes"),
        F.count("value").alias("n_unique"),
        F.min("value").alias("first_value"),
        F.max("value").alias("last_value"),
        F.min("first_primary")["number"].alias("primary_number"),
        F.min(on_replicas).alias("replica_min"),
        F.max(on_replicas).alias("replica_max"),
        F.count_if(number == 0).alias("n_zero"),
        F.sum(F.when(not_rw, F.col("n_primary")).otherwise(0)).alias("n_primary_not_rw"),
        F.sum(F.when(not_ro, F.col("n_replica")).otherwise(0)).alias("n_replica_not_ro"),
    )
    return judge_parameter(summary.filter((F.col("n_unique") > 1) & (F.col("n_nodes") > 1)))


def parameter_values(
    nodes: DataFrame, names: list[str] | None = None, cluster_keys: list[str] = CLUSTER_KEYS
) -> DataFrame:
    """How many nodes hold each value of each parameter."""
    long = node_parameters(nodes, names or fv.DRIFT_PARAMETERS, [*cluster_keys, "node_ip"])
    return (
        long.filter(F.col("value").isNotNull())
        .groupBy(*cluster_keys, "name", "value")
        .agg(F.count(F.lit(1)).alias("n_nodes"))
    )


def parameter_node_values(
    nodes: DataFrame, drifting: DataFrame, names: list[str] | None = None, cluster_keys: list[str] = CLUSTER_KEYS
) -> DataFrame:
    """The value of each node for the parameters that differ: (cluster, name, node_ip, role, value).

    drifting: what parameter_drift found. A table of its own, so that no cluster's nodes meet in one row.
    """
    long = node_parameters(nodes, names or fv.DRIFT_PARAMETERS, [*cluster_keys, "node_ip"])
    return long.join(drifting.select(*cluster_keys, "name"), [*cluster_keys, "name"], "left_semi")


def schema_diff(databases: DataFrame, nodes: DataFrame, cluster_keys: list[str] = CLUSTER_KEYS) -> DataFrame:
    """Schemas a node has beyond its primary, or lacks: (cluster, node_ip, name, difference).

    Without a primary the first node is the reference. A node's schemas are
    one array (a server's, so bounded), the reference is one array per cluster,
    and the two are compared inside the row: no schema meets a node.
    """
    by_node = [*cluster_keys, "node_ip"]
    held = databases.groupBy(*by_node).agg(F.collect_set("name").alias("names"))
    none = F.array().cast("array<string>")
    listed = nodes.select(*by_node, "node_order").join(held, by_node, "left").withColumn("names", F.coalesce("names", none))
    reference = listed.groupBy(*cluster_keys).agg(F.min_by(F.struct(F.col("node_ip").alias("ip"), "names"), "node_order").alias("first"))
    compared = (
        listed.join(reference, cluster_keys)
        .filter(F.col("node_ip") != F.col("first.ip"))
        .select(*by_node, "names", F.col("first.names").alias("wanted"))
    )

    def tagged(names: Column, difference: str) -> Column:
        return F.transform(names, lambda n: F.struct(n.alias("name"), F.lit(difference).alias("difference")))

    found = F.concat(tagged(F.array_except("names", "wanted"), "extra"), tagged(F.array_except("wanted", "names"), "missing"))
    return compared.select(*by_node, F.explode(found).alias("d")).select(*by_node, "d.name", "d.difference")


def parameter_matrix(
    nodes: DataFrame, names: list[tuple[str, str]] | None = None, keys: list[str] = KEYS
) -> DataFrame:
    """Long parameter matrix: (keys, role, name, value, advice)."""
    rows = names or fv.MATRIX_PARAMETERS
    advice = F.create_map(*[F.lit(x) for pair in rows for x in pair])
    long = node_parameters(nodes, [n for n, _ in rows], keys)
    return long.withColumns({"value": F.coalesce("value", F.lit("-")), "advice": advice[F.col("name")]})


def replication_matrix(nodes: DataFrame, keys: list[str] = KEYS) -> DataFrame:
    long = node_parameters(nodes, fv.REPLICATION_PARAMETERS, keys)
    return long.withColumn("value", F.coalesce("value", F.lit("-")))
